"""Alignment of two public tokenizers on the same texts: where their tokens end together, and which tokens stand for which.

Tokenizer A is byte-level, B works on pieces with byte fallback; both see a space before the text. Their tokens are intervals of the same
bytes. Tokens that overlap are connected, and a component is a group: a stretch of bytes at whose ends both have a token boundary.

1. A text is cut into chunks before every space that follows another visible character. Neither tokenizer can merge across
   such a place (A's pattern ends a pre-token there; no piece of B has its space mark after another character), so a chunk
   has the same tokens wherever it stands. Only the distinct chunks of a slice are encoded, by the tokenizers' own libraries;
   a worker keeps those it knows in a table of bounded size, which is emptied when full and changes no result.
2. All tokens of the new chunks lie in flat arrays. Every token points to its farthest-right overlapping token, one of the other tokenizer
   unless it ends its component. The pointers are doubled (each takes its successor's successor) until nothing
   changes; then each points to its component's terminal token, which is the component's label. Rounds grow with the
   logarithm of the longest chain.
3. A linked pair of tokens ends at the same byte, so one of them is a suffix of the other. The pairs for which that holds
   follow from the two vocabularies alone; they are numbered, and a document's links are numbers of pairs.
4. Links are written once. Counts of pairs are added up in the tasks and then by pair; that table has at most as many rows as the
   vocabularies have such pairs (``Vocabularies.pairs``), whatever the corpus, so it goes to the tasks that judge the links.

Chunks are told apart by 64-bit hashes. The counts need a job while the query is built.

Nulls and odd rows: texts that are null, empty or whose tokens' bytes differ from space + text (B maps U+2581 to a space) have no
tokens and all zeros; a null id stays null; repeated rows are aligned alike, and each counts; no rows give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import ragged, slices, span_hashes
from tidemark.llm.bpe import byte_letters
from tidemark.llm.components import stored

KEEP_CHUNKS, KEEP_BYTES = 1 << 18, 64 << 20
#: The space mark of piece vocabularies, and their pieces for single bytes.
SPACE_MARK, BYTE_PIECES = "▁", [f"<0x{b:02X}>" for b in range(256)]
#: First and second bytes of characters of three bytes among which there is white space.
_WIDE = np.zeros(256, bool)
_WIDE[[0xE1, 0xE2, 0xE3]] = True
_WIDE_NEXT = np.zeros(256, bool)
_WIDE_NEXT[[0x80, 0x81, 0x9A, 0xA0]] = True


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the pairs of tokens that can end together."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        value = {c: b for b, c in enumerate(byte_letters())}
        names = self.a.get_vocab(with_added_tokens=False)
        self.size_a, self.size_b = 1 + max(names.values()), self.b.vocab_size()
        tokens_a = [b""] * self.size_a
        for token, i in names.items():
            if all(c in value for c in token):
                tokens_a[i] = bytes(value[c] for c in token)
        single = {name: bytes([b]) for b, name in enumerate(BYTE_PIECES)}
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        tokens_b = [b"" if self.b.is_control(i) or self.b.is_unknown(i)
                    else single[p] if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.letters_a, self.at_a, self.length_a = _flat(tokens_a)
        self.letters_b, self.at_b, self.length_b = _flat(tokens_b)
        self.digits, self.at_digits, self.n_digits = _flat([b"%d" % i for i in range(max(self.size_a, self.size_b))])
        self.keys = self._pair_keys(tokens_a, tokens_b)

    def _pair_keys(self, tokens_a: list[bytes], tokens_b: list[bytes]) -> np.ndarray:
        """Sorted keys a * size_b + b of all tokens of which one is a suffix of the other."""
        of_a, of_b = defaultdict(list), defaultdict(list)
        for of, tokens in ((of_a, tokens_a), (of_b, tokens_b)):
            for i, t in enumerate(tokens):
                if t:
                    of[t].append(i)
        keys = {a * self.size_b + b for t, ids in of_a.items() for k in range(len(t)) for b in of_b.get(t[k:], ()) for a in ids}
        keys |= {a * self.size_b + b for t, ids in of_b.items() for k in range(1, len(t)) for a in of_a.get(t[k:], ()) for b in ids}
        return np.array(sorted(keys), np.int64)

    @property
    def pairs(self) -> int:
        return len(self.keys)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """For each pair the highest count of a pair with its B token."""
        most = np.zeros(self.size_b, np.int64)
        np.maximum.at(most, self.keys % self.size_b, counts)
        return most[self.keys % self.size_b]


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


@functools.lru_cache(2)
def vocabularies(byte_path: str, piece_path: str) -> Vocabularies:
    return Vocabularies(byte_path, piece_path)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text, and at each space after a character that is surely no white space.

    A text's last byte begins none: a lone space is no text for tokenizer B.
    """
    n = len(data)
    before = np.zeros(n, np.uint8)
    before[1:] = data[:-1]
    second, third = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    second[2:], third[3:] = data[:-2], data[:-3]
    visible = (before > 0x20) & (before != 0x7F)
    wide = (before >= 0x80) & ((second == 0xC2) | (_WIDE[third] & _WIDE_NEXT[second]))
    start = (data == 0x20) & visible & ~wide
    full = np.diff(offsets) > 0
    start[offsets[1:][full] - 1] = False
    start[offsets[:-1][full]] = True
    return np.flatnonzero(start)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of tokens that overlap: the last B token of each token's component (for A, for B), and the
    A token that ends with each B token or reaches beyond it.

    ``ends_a`` and ``ends_b`` are the rising byte offsets at which tokens of the same texts end. Pointer jumping.
    """
    n = len(ends_a)
    right_a = np.searchsorted(ends_b, ends_a)  # the B token that has the last byte of an A token
    right_b = np.searchsorted(ends_a, ends_b)
    last = ends_a[right_b] == ends_b if n else np.zeros(0, bool)
    to = np.concatenate([n + right_a, np.where(last, n + np.arange(len(ends_b)), right_b)])
    while True:
        beyond = to[to]
        if np.array_equal(beyond, to):
            break
        to = beyond
    return to[:n] - n, to[n:] - n, right_b


@dataclass
class Aligned:
    """Of some texts: counts by text, and the flat links and group strings with their offsets."""

    n_a: np.ndarray
    n_b: np.ndarray
    exact: np.ndarray
    links: np.ndarray
    link_offsets: np.ndarray
    groups: np.ndarray
    group_offsets: np.ndarray


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def align(v: Vocabularies, texts: list[str]) -> Aligned:
    """Alignment of texts that begin with a space. Where the tokens' bytes differ from the text it isn't exact and has no tokens."""
    ids = [[e.ids for e in v.a.encode_batch(texts, add_special_tokens=False)], v.b.encode([t[1:] for t in texts], num_threads=1)]
    raw = [t.encode() for t in texts]
    exact = np.ones(len(texts), bool)
    sides = []
    for own, letters, at, length in ((ids[0], v.letters_a, v.at_a, v.length_a), (ids[1], v.letters_b, v.at_b, v.length_b)):
        flat = np.fromiter(itertools.chain.from_iterable(own), np.int64, sum(map(len, own)))
        first = _offsets(np.fromiter(map(len, own), np.int64, len(own)))
        ends = _offsets(length[flat])
        joined = letters[ragged(at[flat], length[flat])].tobytes()
        cuts = ends[first]
        exact &= np.array([joined[i:j] == r for i, j, r in zip(cuts[:-1].tolist(), cuts[1:].tolist(), raw, strict=True)], bool)
        sides.append((flat, first))
    kept = []
    for (flat, first), length in zip(sides, (v.length_a, v.length_b), strict=True):
        size = np.where(exact, np.diff(first), 0)
        flat = flat[ragged(first[:-1], size)]
        kept.append((flat, _offsets(size), np.cumsum(length[flat])))
    (a, first_a, ends_a), (b, first_b, ends_b) = kept
    of_a, of_b, beside = terminals(ends_a, ends_b)
    terminal = of_b == np.arange(len(b))
    number = np.cumsum(terminal) - 1  # of a terminal token: that of its group
    where = np.flatnonzero(terminal)
    links = np.searchsorted(v.keys, a[beside[where]] * v.size_b + b[where])
    group_a, group_b = number[of_a], number[of_b]
    last_a = np.ones(len(a), bool)
    last_a[:-1] = group_a[1:] != group_a[:-1]
    # A group's A tokens come before its B tokens, and groups one after another.
    until_a, until_b = np.cumsum(np.bincount(group_a, minlength=len(where))), _offsets(np.bincount(group_b, minlength=len(where)))
    place_a, place_b = np.arange(len(a)) + until_b[group_a], np.arange(len(b)) + until_a[group_b]
    token, mark = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.uint8)
    token[place_a], token[place_b] = a, b
    mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(terminal, ord(";"), ord(","))
    size = v.n_digits[token]
    text_end = _offsets(size + 1)
    groups = np.zeros(text_end[-1], np.uint8)
    groups[ragged(text_end[:-1], size)] = v.digits[ragged(v.at_digits[token], size)]
    groups[text_end[1:] - 1] = mark
    return Aligned(np.diff(first_a), np.diff(first_b), exact, links.astype(np.int32), np.searchsorted(where, first_b),
                   groups, text_end[first_a + first_b])


class Chunks:
    """Alignments of the chunks seen so far, by hash."""

    def __init__(self, v: Vocabularies):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.order = np.zeros(0, np.int64)
        self.known = align(self.v, [])

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        new, old = align(self.v, texts), self.known
        def join(name):
            return np.concatenate([getattr(old, name), getattr(new, name)])
        self.known = Aligned(join("n_a"), join("n_b"), join("exact"), join("links"),
                             np.concatenate([old.link_offsets[:-1], old.link_offsets[-1] + new.link_offsets]), join("groups"),
                             np.concatenate([old.group_offsets[:-1], old.group_offsets[-1] + new.group_offsets]))
        self.order = np.concatenate([self.order, len(self.order) + np.arange(len(hashes))])
        self.seen = np.concatenate([self.seen, hashes])
        by = np.argsort(self.seen, kind="stable")
        self.seen, self.order = self.seen[by], self.order[by]

    def align(self, data: np.ndarray, offsets: np.ndarray) -> Aligned:
        """Alignment of the texts data[offsets[i]:offsets[i + 1]], each of which is empty or begins with a space."""
        starts = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        distinct, index, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.seen) > KEEP_CHUNKS or len(self.known.groups) > KEEP_BYTES:
            self.forget()
        new = ~np.isin(distinct, self.seen, assume_unique=True)
        if new.any():
            raw = data.tobytes()
            spans = zip(starts[index[new]].tolist(), ends[index[new]].tolist(), strict=True)
            self._learn(distinct[new], [raw[i:j].decode() for i, j in spans])
        k, c = self.known, self.order[np.searchsorted(self.seen, distinct)][inverse]
        first = np.searchsorted(starts, offsets)
        bad = np.diff(_offsets(~k.exact[c])[first]) > 0
        c, of = c[np.repeat(~bad, np.diff(first))], np.where(bad, 0, np.diff(first))
        first = _offsets(of)
        n_links, n_groups = np.diff(k.link_offsets)[c], np.diff(k.group_offsets)[c]
        return Aligned(np.diff(_offsets(k.n_a[c])[first]), np.diff(_offsets(k.n_b[c])[first]), ~bad,
                       k.links[ragged(k.link_offsets[c], n_links)], _offsets(n_links)[first],
                       k.groups[ragged(k.group_offsets[c], n_groups)], _offsets(n_groups)[first])


@functools.lru_cache(2)
def chunks(byte_path: str, piece_path: str) -> Chunks:
    return Chunks(vocabularies(byte_path, piece_path))


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that aren't empty with a space before each."""
    sizes = np.diff(offsets)
    out = _offsets(np.where(sizes > 0, sizes + 1, 0))
    spaced = np.full(out[-1], 0x20, np.uint8)
    spaced[ragged((out[:-1] + 1)[sizes > 0], sizes[sizes > 0])] = data
    return spaced, out


_ALIGNED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("groups", pa.large_binary()),
                      ("links", pa.binary())])
DIGEST, TEXT = "sha256", "text"


def alignments(docs: DataFrame, byte_path: str, piece_path: str, groups: str = TEXT, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_links, groups and links (numbers of pairs as 32-bit integers) of every row.

    ``groups``: the groups as text, or the hexadecimal SHA-256 of that text (empty without tokens).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def shown(s: bytes) -> str:
        return (hashlib.sha256(s).hexdigest() if groups == DIGEST else s.decode()) if s else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunks(byte_path, piece_path)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                got = known.align(*_spaced(data, offsets))
                text, links = got.groups.tobytes(), got.links.tobytes()
                at, to = got.group_offsets.tolist(), (4 * got.link_offsets).tolist()
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(got.n_a), pa.array(got.n_b), pa.array(np.diff(got.link_offsets)),
                           pa.array([shown(text[i:max(i, j - 1)]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.string()),
                           pa.array([links[i:j] for i, j in zip(to[:-1], to[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, _ALIGNED.names)

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_links long, groups string, links binary")


def _flat_links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    flat = np.frombuffer(b"".join(parts), np.int32)
    return flat, _offsets(np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts)))


def pair_counts(aligned: DataFrame, pairs: int) -> DataFrame:
    """(pair, n): how many links are of each pair; at most ``pairs`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pairs, np.int64)
        for batch in batches:
            total += np.bincount(_flat_links(batch.column(0))[0], minlength=pairs)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, byte_path: str, piece_path: str, groups: str = DIGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row.

    ``n_best``: links whose pair is as frequent in the corpus as any pair of their B token; ``count_sum``: the frequencies of the
    links' pairs, added up. A group ends where an A and a B token do, so it has one link.
    """
    v = vocabularies(byte_path, piece_path)
    aligned = stored(alignments(docs, byte_path, piece_path, groups, id_col, text_col), "alignments")
    found = pair_counts(aligned, v.pairs).toArrow()
    counts = np.zeros(v.pairs, np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    known = docs.sparkSession.sparkContext.broadcast((counts, counts == v.best(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = known.value
        for batch in batches:
            links, at = _flat_links(batch.column(5))
            judged = [pa.array(np.diff(_offsets(x[links])[at])) for x in (best, count)]
            n = batch.column(3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n, n, *judged, batch.column(4)],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
