"""Language-model scores over a subword lattice.

The pieces of an existing vocabulary file span a lattice over each word (its bytes after the word mark): every way to cut the word
into pieces is a path, and the probability of the word is the sum over all paths. A forward recursion in log space gives it.
Byte pieces make every word reachable. A text's probability is the product over its words and one end token, as pieces
never cross words.

Weights start from the file's scores (ranks, taken as frequencies 1/(rank + 3)) and are re-estimated by a pass of expectation
maximisation over the words of the training rows: forward and backward recursions give each piece's expected count. The lattice
is there for words the training rows don't have, so it learns from distinct words, not from their uses: words are made distinct over
all training rows first, and each weighs 1, however the rows are dealt out. Counts are combined per task, so what is gathered are at
most as many numbers as there are pieces.

A word is also a path of its own, weighted by its count c: its probability is (1 - g) c / N + g lattice, and g = (s + 1) / (N + 1)
is the share of words to expect that were never seen (Good-Turing: s words were seen once). The end token is weighed likewise.

Word counts for the base score: documents are dealt into batches of about ``batch_bytes`` of text. Each batch sends the hashes
and counts of its distinct words, packed, to the words' bins; a bin adds them up over all batches and answers each batch with the
totals, in the order asked; then the batch is scored. A frequent word is one entry for each batch, never a row for each use.
Words are named by 64-bit hashes.

Nulls and odd rows: a null text is empty and has the end token only; a missing id counts as fold 0; repeated rows get equal
scores; without training rows N and V are 0 and the file's own weights are used. Every row comes back once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import find_words, mix, powers, ragged, slices
from tidemark.llm.tables import given_id, keyed

MARK = "▁".encode()
_FLUSH = 300_000
_PRIOR = 0.5


@dataclass
class Pieces:
    """A vocabulary: sorted span hashes, the natural log weight of each piece, of each byte, and of the end token."""

    hashes: np.ndarray
    log_p: np.ndarray
    byte_log_p: np.ndarray
    end_log_p: float
    longest: int

    def __post_init__(self):
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.hashes >> np.uint64(44)] = True

    def with_counts(self, counts: np.ndarray) -> Pieces:
        """The same pieces weighted by counts of the pieces, the bytes and the end, smoothed by the weights so far."""
        old = np.exp(np.r_[self.log_p, self.byte_log_p, self.end_log_p])
        p = counts + _PRIOR * len(old) * old / old.sum()
        p = np.log(p / p.sum())
        k = len(self.hashes)
        return Pieces(self.hashes, p[:k], p[k:-1], float(p[-1]), self.longest)


@functools.lru_cache(256)
def _up(n: int) -> np.ndarray:
    return powers(n, 0)[0]


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _prefix(rows: np.ndarray) -> np.ndarray:
    """(rows, length + 1) running sums of letter value times power."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.cumsum(_LETTER[rows] * _up(rows.shape[1]), axis=1, out=out[:, 1:])
    return out


def _span(total: np.ndarray, i: int, j: int) -> np.ndarray:
    return mix((total[:, j] - total[:, i]) * powers(i + 1, 0)[1][i])


def load(path: str) -> Pieces:
    """The vocabulary of a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    words, rank, byte_rank = [], [], np.zeros(256)
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_rank[int(sp.id_to_piece(i)[3:5], 16)] = sp.get_piece_size()
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            word = sp.id_to_piece(i).encode()
            if word.count(MARK) == word.startswith(MARK):  # pieces inside one word
                words.append(word)
                rank.append(-sp.get_score(i) if sp.get_score(i) > -1e8 else sp.get_piece_size())
    hashes = np.array([_span(_prefix(np.frombuffer(w, np.uint8)[None, :]), 0, len(w))[0] for w in words], np.uint64)
    order = np.argsort(hashes)
    weight = np.r_[1 / (np.array(rank)[order] + 3), 0.1 / (byte_rank + 3), 0.01]
    p = np.log(weight / weight.sum())
    return Pieces(hashes[order], p[:len(words)], p[len(words):-1], float(p[-1]), max(map(len, words)))


def lattice(words: np.ndarray, v: Pieces, counts: np.ndarray | None = None,
            expected: np.ndarray | None = None) -> np.ndarray:
    """Log probability of words of one length (rows of bytes, with the mark); adds expected counts of pieces and bytes."""
    n, length = words.shape
    total, k = _prefix(words), len(v.hashes)
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0.0
    arcs = []
    for j in range(1, length + 1):
        a = alpha[j - 1] + v.byte_log_p[words[:, j - 1]]
        for i in range(max(0, j - v.longest), j):
            h = _span(total, i, j)
            row = np.flatnonzero(v.filter[h >> np.uint64(44)])
            if not len(row):
                continue
            at = np.searchsorted(v.hashes, h[row])
            at[at == k] = 0
            good = v.hashes[at] == h[row]
            row, at = row[good], at[good]
            if len(row):
                a[row] = np.logaddexp(a[row], alpha[i][row] + v.log_p[at])
                arcs.append((i, j, row, at))
        alpha[j] = a
    if counts is None:
        return alpha[length]
    beta = np.full((length + 1, n), -np.inf)
    beta[length] = 0.0
    for j in range(length, 0, -1):
        back = v.byte_log_p[words[:, j - 1]]
        beta[j - 1] = np.logaddexp(beta[j - 1], beta[j] + back)
        share = np.exp(alpha[j - 1] + back + beta[j] - alpha[length]) * counts
        expected[k:k + 256] += np.bincount(words[:, j - 1], share, 256)
        while arcs and arcs[-1][1] == j:
            i, _, row, at = arcs.pop()
            through = beta[j][row] + v.log_p[at]
            beta[i][row] = np.logaddexp(beta[i][row], through)
            expected[:k] += np.bincount(at, np.exp(alpha[i][row] + through - alpha[length][row]) * counts[row], k)
    return alpha[length]


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_scores(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, v: Pieces, counts: np.ndarray | None = None,
                expected: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities of words that are spans of lower-cased bytes. Words of one length are done together."""
    out = np.empty(len(starts))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(sizes[order]) != 0, True]) if len(order) else [0]
    mark = np.frombuffer(MARK, np.uint8)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        size = int(sizes[order[a]])
        step = max(1, (1 << 19) // (size + 4))
        for lo in range(a, b, step):
            pick = order[lo:min(b, lo + step)]
            rows = np.empty((len(pick), size + 3), np.uint8)
            rows[:, :3] = mark
            rows[:, 3:] = data[ragged(starts[pick], sizes[pick])].reshape(len(pick), size)
            out[pick] = lattice(rows, v, None if counts is None else counts[pick], expected)
    return out


class Distinct:
    """Distinct words of many slices: sorted hashes, counts, and their bytes where these are kept."""

    def __init__(self):
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0)
        self.letters, self.sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64)

    def add(self, words, weight: np.ndarray) -> None:
        h, index, inverse = np.unique(words.hashes(lower=True), return_index=True, return_inverse=True)
        count = np.bincount(inverse, weight, len(h)) if len(h) else np.zeros(0)
        starts, sizes = words.starts[index], (words.ends - words.starts)[index]
        letters = _lower(words.data[ragged(starts, sizes)])
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        old = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        self.counts[at[old]] += count[old]
        new = ~old
        start = np.cumsum(sizes) - sizes
        merged = np.concatenate([self.hashes, h[new]])
        order = np.argsort(merged, kind="stable")
        size = np.concatenate([self.sizes, sizes[new]])
        first = np.cumsum(size) - size
        text = np.concatenate([self.letters, letters[ragged(start[new], sizes[new])]])
        self.letters, self.sizes = text[ragged(first[order], size[order])], size[order]
        self.hashes, self.counts = merged[order], np.concatenate([self.counts, count[new]])[order]

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cased words of training texts; a word may come again after ``_FLUSH`` others and from other tasks."""
    def close(seen: Distinct) -> pa.RecordBatch:
        offsets = np.r_[0, np.cumsum(seen.sizes)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(seen.sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(seen.letters.tobytes())])
        return pa.RecordBatch.from_arrays([words], ["word"])

    seen = Distinct()
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            words = find_words(data, offsets)
            seen.add(words, np.ones(len(words.starts)))
            if len(seen.hashes) > _FLUSH:
                yield close(seen)
                seen = Distinct()
    yield close(seen)


def _expect(shared):
    """Rows (piece, n) of expected counts over rows (word), each of which weighs 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        expected, held = np.zeros(len(v.hashes) + 256), []

        def flush() -> None:
            letters = np.frombuffer(b"".join(held), np.uint8)
            sizes = np.array([len(w) for w in held], np.int64)
            word_scores(letters, np.cumsum(sizes) - sizes, sizes, v, np.ones(len(held)), expected)

        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) > _FLUSH:
                flush()
                held = []
        flush()
        used = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(expected[used])], ["piece", "n"])
    return run


def fit(docs: DataFrame, path: str, parts: int, held: int, id_col: str, text_col: str) -> tuple[Pieces, int, int]:
    """(re-estimated pieces, training rows, bytes of all texts). Gathers one number for each piece at most."""
    v = load(path)
    shared = docs.sparkSession.sparkContext.broadcast(v)
    rows = keyed(docs, id_col, text_col).select(learns(parts, held).alias("learn"), "text")
    size = rows.agg(F.coalesce(F.sum(F.col("learn").cast("long")), F.lit(0)).alias("learn"),
                    F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    words = rows.filter("learn").select("text").mapInArrow(_vocabulary, "word binary").distinct()
    found = words.mapInArrow(_expect(shared), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(v.hashes) + 257)
    for r in found:
        counts[r.piece] = r.n
    counts[-1] = size.learn
    return (v.with_counts(counts) if size.learn else v), size.learn, size.bytes


def learns(parts: int, held: int):
    """Whether a row (id) is one to learn from."""
    return F.coalesce(F.crc32(given_id().cast("string").cast("binary")) % parts, F.lit(0)) != held


def _bin(h: np.ndarray, bins: int) -> np.ndarray:
    return ((h >> np.uint64(16)) % np.uint64(bins)).astype(np.int32)


def _ask(bins: int):
    """Packed distinct words (bin, batch, payload) of each batch of rows (batch, kind, learn, id, tag, text)."""
    def close(batch: int, seen: Distinct) -> Iterator[pa.RecordBatch]:
        where = _bin(seen.hashes, bins)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(bins + 1))
        full = np.flatnonzero(np.diff(cuts))
        payload = [seen.hashes[order[cuts[b]:cuts[b + 1]]].tobytes() + seen.counts[order[cuts[b]:cuts[b + 1]]].astype("<u4").tobytes()
                   for b in full]
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), batch, np.int32)),
                                          pa.array(payload, pa.binary())], ["bin", "batch", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, Distinct()
        for batch in batches:
            number, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(False)
            for cut in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(number)) + 1):
                if not len(cut):
                    continue
                if number[cut[0]] != now:
                    if now is not None:
                        yield from close(now, seen)
                    now, seen = int(number[cut[0]]), Distinct()
                for lo, hi, data, offsets in slices(batch.column(2).slice(cut[0], len(cut))):
                    words = find_words(data, offsets)
                    seen.add(words, learn[cut[0] + lo:cut[0] + hi][words.text_of].astype(float))
        if now is not None:
            yield from close(now, seen)
    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of bins, which come one after another: (batch, bin, payload of totals), and (-1, bin, null, n, v, once) at its end."""
    def close(number: int, asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        n = [len(p) // 12 for _, p in asked]
        h = np.concatenate([np.frombuffer(p, "<u8", k) for (_, p), k in zip(asked, n, strict=True)])
        c = np.concatenate([np.frombuffer(p, "<u4", k, 8 * k) for (_, p), k in zip(asked, n, strict=True)])
        distinct, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, c, len(distinct)).astype("<u8")
        back, at = total[inverse], np.r_[0, np.cumsum(n)]
        k = len(asked)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(b for b, _ in asked), -1], pa.int32()), pa.array([number] * (k + 1), pa.int32()),
             pa.array([*(back[at[i]:at[i + 1]].tobytes() for i in range(k)), None], pa.binary()),
             *(pa.array([0] * k + [int(x.sum())], pa.int64()) for x in (total, total > 0, total == 1))],
            ["batch", "bin", "payload", "n", "v", "once"])

    now, asked = None, []
    for batch in batches:
        for b, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if b != now:
                if asked:
                    yield from close(now, asked)
                now, asked = b, []
            asked.append((number, payload))
    if asked:
        yield from close(now, asked)


def _rate(shared, bins: int):
    """Scores a batch of documents with the totals of its distinct words."""
    schema = pa.schema([("id", pa.int64()), ("learn", pa.bool_()), ("words", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        v = shared.value
        if not docs.num_rows:
            return schema.empty_table()
        docs = docs.combine_chunks()
        text = docs.column("text").chunk(0)
        seen = Distinct()
        for _, _, data, offsets in slices(text):
            words = find_words(data, offsets)
            seen.add(words, np.zeros(len(words.starts)))
        where, total = _bin(seen.hashes, bins), np.zeros(len(seen.hashes))
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(bins + 1))
        for b, payload in zip(answers.column("bin").to_pylist(), answers.column("payload").to_pylist(), strict=True):
            total[order[cuts[b]:cuts[b + 1]]] = np.frombuffer(payload, "<u8")
        n, once = (int(answers.column(c)[0].as_py()) if answers.num_rows else 0 for c in ("train_tokens", "s"))
        unseen = (once + 1) / (n + 1)
        lattices = np.log(unseen) + word_scores(seen.letters, seen.starts(), seen.sizes, v)
        known = np.full(len(total), -np.inf)
        known[total > 0] = np.log((1 - unseen) * total[total > 0] / n)
        log_c, log_p = np.log10(total + 1), np.logaddexp(known, lattices) / np.log(10)
        out = {n: [] for n in ("words", "known", "logs", "score")}
        for lo, hi, data, offsets in slices(text):
            words = find_words(data, offsets)
            at = np.searchsorted(seen.hashes, words.hashes(lower=True))
            own = words.text_of
            out["words"].append(np.diff(words.first))
            out["known"].append(np.bincount(own, total[at] > 0, hi - lo).astype(np.int64))
            out["logs"].append(np.bincount(own, log_c[at], hi - lo))
            out["score"].append(np.bincount(own, log_p[at], hi - lo))
        return pa.Table.from_arrays([docs.column("id"), docs.column("learn"), *(pa.array(np.concatenate(x)) for x in out.values())], schema=schema)
    return run


def score(docs: DataFrame, path: str, parts: int = 7, held: int = 2, batch_bytes: int = 16 << 20, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10)."""
    pieces, train_rows, size = fit(docs, path, parts, held, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    bins = max(1, -(-size // batch_bytes))
    rows = keyed(docs, id_col, text_col).select(
        F.pmod(F.xxhash64("id", "tag"), F.lit(bins)).cast("int").alias("batch"), learns(parts, held).alias("learn"), "id", "text") \
        .repartition(bins, "batch")
    asked = rows.select("batch", "learn", "text").sortWithinPartitions("batch").mapInArrow(_ask(bins), "bin int, batch int, payload binary")
    answers = asked.repartition(bins, "bin").sortWithinPartitions("bin") \
        .mapInArrow(_answer, "batch int, bin int, payload binary, n long, v long, once long")
    end = 1 if train_rows else 0
    totals = answers.filter("batch = -1").agg(F.struct(
        (F.coalesce(F.sum("n"), F.lit(0)) + train_rows).alias("tokens"), (F.coalesce(F.sum("v"), F.lit(0)) + end).alias("distinct"),
        F.coalesce(F.sum("once"), F.lit(0)).alias("once")).alias("t")).scalar()
    back = answers.filter("batch >= 0").select("batch", "bin", "payload", totals["tokens"].alias("train_tokens"), totals["once"].alias("s"))
    rated = rows.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(
        _rate(shared, bins), "id long, learn boolean, words long, known long, logs double, score double")
    rated = rated.withColumn("t", totals)
    tokens = F.col("words") + 1
    base = F.col("logs") + F.lit(float(np.log10(train_rows + 1))) \
        - tokens * F.log10((F.col("t.tokens") + F.col("t.distinct") + 1).cast("double"))
    unseen = (F.col("t.once") + 1) / (F.col("t.tokens") + 1)
    end_p = (1 - unseen) * train_rows / F.greatest(F.col("t.tokens"), F.lit(1)) + unseen * float(np.exp(pieces.end_log_p))
    return rated.select(given_id().alias("doc_id"), (~F.col("learn")).alias("held_out"), tokens.alias("n_tokens"),
                        (F.col("known") + end).alias("n_known"), F.col("t.tokens").alias("train_tokens"), base.alias("base_score"),
                        (F.col("score") + F.log10(end_p)).alias("score"))
