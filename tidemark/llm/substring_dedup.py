"""Removal of repeated passages by prefix-partitioned suffix trees.

A suffix is a word position with the ``width`` words that follow. The trees are cut at that depth: two suffixes that
meet in a node as deep as that begin with the same window. Every window of which an equal one starts in a document with
a smaller id is a repeat, and the words it covers go.

1. Suffixes that can't repeat are left out, exactly: of the ``SEED``-word runs inside a window the one with the least
   hash (the leftmost of equals) is the window's seed, so equal windows have equal seeds. Only windows whose seed occurs in
   two documents are suffixes. About one word in twenty is a seed.
2. A suffix's path is a 64-bit fingerprint of its first ``PREFIX`` words and one of the words from there to the full
   depth. Suffixes are split into groups by the prefix. Suffixes of equal windows meet first in the task that cuts
   them out: only those of its smallest document go on, the rest is settled.
3. A group that fits ``group_size`` becomes a subtree: its suffixes are sorted by path, neighbours compared, and
   nodes at the full depth with leaves in several documents give the repeats. A group that doesn't fit (a prefix that
   very many different passages share) isn't built but split by a longer prefix, the whole depth, where each group is one
   node and needs only its smallest document.
4. Consecutive repeats of a document are maximal repeats; its words are masked, all at once.

Fingerprints of both parts together have 128 bits. Documents are shuffled once: steps 2 and 4 use the same exchange.

Nulls and odd rows: a null text has no words; texts shorter than a window keep every word; a null id counts as the
largest and has no smaller one among the null ids; rows that repeat an id do not remove each other's words; repeats
inside one document stay. Every row comes back once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import Words, find_words, lists, mix, slices, window_hashes, window_inside
from tidemark.llm.tables import given_id, key_columns, keyed

SEED, PREFIX = 8, 16
_FLUSH = 300_000
_PACKED = "bin int, kind int, payload binary"
_SCHEMA = pa.schema([("bin", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
#: Kinds of packed rows: suffixes grouped by the prefix, suffixes grouped by the whole window, repeats grouped by document.
SHORT, DEEP, REPEAT = 0, 1, 2
_RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("at", "<i4")])
_FIELDS = {SHORT: _RECORD.names, DEEP: _RECORD.names, REPEAT: ("id", "tag", "at")}


def seeds(words: Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and the hash of each one's seed."""
    inside = np.flatnonzero(window_inside(words, width))
    low = window_hashes(h, SEED)
    have, need = 1, width - SEED + 1
    while have < need:  # least hash of runs of 1, 2, 4 ... and last of need starts
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return inside, low[inside] if len(inside) else np.zeros(0, np.uint64)


def _seed_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in slices(batch.column(2)):
                words = find_words(data, offsets)
                at, seed = seeds(words, words.hashes(), width)
                if not len(at):
                    continue
                text = words.text_of[at]
                new = np.r_[True, (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])]
                text, seed = text[new] + lo, seed[new]
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(ids[text]),
                                                  pa.array(tags[text])], ["seed", "id", "tag"])
    return run


def _pack(records: np.ndarray, bins: int, kind: int) -> Iterator[pa.RecordBatch]:
    """Records as one row for each bin: the parts of a record one after another, as they compress better so."""
    if not len(records):
        return
    key = {SHORT: lambda r: r["a"], DEEP: lambda r: mix(r["a"] ^ mix(r["b"])),
           REPEAT: lambda r: mix(r["tag"].view("<u8") ^ mix(r["id"].view("<u8")))}[kind](records)
    where = ((key >> np.uint64(20)) % np.uint64(bins)).astype(np.int32)
    order = np.argsort(where, kind="stable")
    records, where = records[order], where[order]
    cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
    payload = [_bytes(records[i:j], kind) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(where[cuts[:-1]]), pa.array(np.full(len(payload), kind, np.int32)),
                                      pa.array(payload, pa.binary())], schema=_SCHEMA)


def _bytes(records: np.ndarray, kind: int) -> bytes:
    return b"".join(np.ascontiguousarray(records[n]).tobytes() for n in _FIELDS[kind])


def _unpack(payloads: list[bytes], kind: int) -> np.ndarray:
    fields = [(n, _RECORD[n]) for n in _FIELDS[kind]]
    width = sum(t.itemsize for _, t in fields)
    out = np.empty(sum(map(len, payloads)) // width, fields)
    row = 0
    for p in payloads:
        n, at = len(p) // width, 0
        for name, t in fields:
            out[name][row:row + n] = np.frombuffer(p, t, n, at)
            at += n * t.itemsize
        row += n
    return out


def subtree(records: np.ndarray) -> np.ndarray:
    """For each suffix, in the order given, the smallest id below its node at full depth."""
    order = np.lexsort((records["b"], records["a"]))
    a, b = records["a"][order], records["b"][order]
    node = np.cumsum(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) - 1
    least = np.minimum.reduceat(records["id"][order], np.flatnonzero(np.r_[True, node[1:] != node[:-1]]))
    out = np.empty(len(records), np.int64)
    out[order] = least[node]
    return out


def _suffixes(width: int, bins: int):
    """Cuts the suffixes with a repeated seed out of documents (id, tag, text, seeds)."""
    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        records = np.concatenate(parts)
        later = records["id"] > subtree(records)
        yield from _pack(records[later], bins, REPEAT)
        yield from _pack(records[~later], bins, SHORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in slices(batch.column(2)):
                words = find_words(data, offsets)
                h = words.hashes()
                at, seed = seeds(words, h, width)
                known = batch.column(3).slice(lo, hi - lo).flatten().to_numpy().view(np.uint64)
                at = at[np.isin(seed, known)]
                text = words.text_of[at]
                out = np.empty(len(at), _RECORD)
                out["a"] = window_hashes(h, PREFIX)[at] if len(at) else 0
                out["b"] = window_hashes(h, width - PREFIX, 1)[at + PREFIX] if len(at) else 0
                out["id"], out["tag"], out["at"] = ids[text + lo], tags[text + lo], at - words.first[text]
                parts.append(out)
                n += len(out)
                if n >= _FLUSH:
                    yield from flush(parts)
                    parts, n = [], 0
        if parts:
            yield from flush(parts)
    return run


def _trees(bins: int, group_size: int, deep: bool):
    """Builds the subtrees of the groups of a partition, which come one after another; passes repeats on."""
    kind = DEEP if deep else SHORT

    def later(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        records = _unpack(group, kind)
        is_later = records["id"] > subtree(records)
        return records[is_later], records[~is_later]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, size, split = None, [], 0, False
        for batch in batches:
            passing = pa.array(batch.column(1).to_numpy() == REPEAT)
            yield batch.filter(passing)
            own = batch.filter(pa.array(~passing.to_numpy(zero_copy_only=False)))
            for k, payload in zip(own.column(0).to_pylist(), own.column(2).to_pylist(), strict=True):
                if k != now:
                    if group:
                        yield from _pack(later(group)[0], bins, REPEAT)
                    now, group, size, split = k, [], 0, False
                group.append(payload)
                size += len(payload) // _RECORD.itemsize
                if deep and size > group_size:  # a node for each window: only its smallest document stays
                    done, stay = later(group)
                    yield from _pack(done, bins, REPEAT)
                    group, size = [_bytes(stay, kind)], 0
                elif not deep and (split or size > group_size):
                    yield from _pack(_unpack(group, kind), bins, DEEP)
                    group, split = [], True
        if group:
            yield from _pack(later(group)[0], bins, REPEAT)
    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tag, starts) of the packed repeats of a partition, whose bins come one after another."""
    def close(group: list[bytes]) -> Iterator[pa.RecordBatch]:
        r = _unpack(group, REPEAT)
        r = r[np.lexsort((r["at"], r["tag"], r["id"]))]
        cuts = np.flatnonzero(np.r_[True, (r["id"][1:] != r["id"][:-1]) | (r["tag"][1:] != r["tag"][:-1]), True])
        first = r[cuts[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(first["id"])), pa.array(np.ascontiguousarray(first["tag"])),
                                          lists(pa.array(np.ascontiguousarray(r["at"])), cuts)], ["id", "tag", "starts"])

    now, group = None, []
    for batch in batches:
        for k, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != now and group:
                yield from close(group)
                group = []
            now = k
            group.append(payload)
    if group:
        yield from close(group)


def repeats(docs: DataFrame, width: int = 50, group_size: int = 1_000_000, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, tag, starts): the windows, by the number of their first word, that also start in a smaller document."""
    return _repeats(keyed(docs, id_col, text_col), width, group_size)


def _repeats(rows: DataFrame, width: int, group_size: int) -> DataFrame:
    """The same for rows (id, tag, text, ...); all their columns go the same way as in the caller's join with the result."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select("id", "tag", "text").mapInArrow(_seed_rows(width), "seed long, id long, tag long")
    shared = found.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("seed")
    of_doc = found.join(shared, "seed").groupBy("id", "tag").agg(F.collect_set("seed").alias("seeds"))
    cut = rows.join(of_doc.hint("shuffle_hash"), ["id", "tag"]).select("id", "tag", "text", "seeds", *rows.columns[3:]) \
        .mapInArrow(_suffixes(width, parts), _PACKED)

    def dealt(packed: DataFrame) -> DataFrame:
        return packed.repartitionById(parts, F.col("bin")).sortWithinPartitions("bin", "kind")

    for deep in (False, True):
        cut = dealt(cut).mapInArrow(_trees(parts, group_size, deep), _PACKED)
    return dealt(cut).mapInArrow(_by_document, "id long, tag long, starts array<int>")


def _mask(words: Words, i: int, starts: np.ndarray, width: int) -> np.ndarray:
    n = words.first[i + 1] - words.first[i]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, width: int = 50, group_size: int = 1_000_000, id_col: str = "doc_id",
                    text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row of docs: doc_id, tag, n_words, n_removed, ``kept`` (the words that stay, joined by one space) and ``text``
    (the text as it was where nothing goes, else with the removed words and the space after them cut out).

    With ``carry``, also ``row``: a struct of those columns of docs.
    """
    rows = docs.select(*key_columns(id_col, text_col), *([F.struct(*carry).alias("row")] if carry else []))
    found = _repeats(rows, width, group_size)
    joined = rows.join(found.hint("shuffle_hash"), ["id", "tag"], "left").select("id", "tag", "text", "starts", *rows.columns[3:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                words = find_words(data, offsets)
                raw, n_removed, kept, text = data.tobytes(), [], [], []
                for i in range(hi - lo):
                    whole = raw[offsets[i]:offsets[i + 1]]
                    parts = whole.split()
                    starts = batch.column(3)[lo + i].values if batch.column(3)[lo + i].is_valid else None
                    if starts is None or not len(starts):
                        n_removed.append(0)
                        kept.append(b" ".join(parts))
                        text.append(whole)
                        continue
                    gone = _mask(words, i, starts.to_numpy(), width)
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([p for p, g in zip(parts, gone.tolist(), strict=True) if not g]))
                    begin = np.r_[words.starts[words.first[i]:words.first[i + 1]], offsets[i + 1]]
                    turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    stay = np.r_[offsets[i], begin[turn], offsets[i + 1]].reshape(-1, 2).tolist()
                    text.append(b"".join([raw[x:y] for x, y in stay]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(words.first)), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()), pa.array(text, pa.binary()).cast(pa.string()),
                     *([batch.column(4).slice(lo, hi - lo)] if carry else [])],
                    ["id", "tag", "n_words", "n_removed", "kept", "text", *(["row"] if carry else [])])

    schema = "id long, tag long, n_words long, n_removed long, kept string, text string"
    if carry:
        schema += f", row {joined.schema['row'].dataType.simpleString()}"
    out = joined.mapInArrow(run, schema)
    return out.select(given_id().alias("doc_id"), "tag", "n_words", "n_removed", "kept", "text", *(["row"] if carry else []))
