"""How filters of a corpus act together: what each of five filters removes in every order they can be applied in.

Which filters a document fails doesn't depend on the others, so an order never has to be run. Each filter gets a posting list: the
sorted ids of the documents that fail it. What a filter removes after some others is its list without the union of theirs.

1. One pass over the texts judges filters A to D and takes the text's SHA-256; a text is a copy (E) if a smaller id has the same digest.
2. What was judged is written once, so that the smallest id of each digest and the documents it is joined with are read from
   there; a text with very many copies is a skewed key of that join, which Spark splits.
3. Each task sorts its documents by part and id and cuts them into id ranges of at most ``RANGE`` postings. Of each range it keeps
   a sorted list of ids for each filter, merges the lists (k-way, two at a time, each id of the shorter one galloping through the longer one)
   into the union for every set of filters, and takes every filter's list without it. The sizes are all that leaves the task.
   Ranges are disjoint, so sizes add up, and no part or id has to meet in one task.
4. Sizes are summed for each part, filter and set of filters applied before it (80 rows a part) and dealt to the 120 orders.

Step 2 runs a job while the query is built.

Nulls and odd rows: a null text is empty; a null part is the part of the empty string; a null id comes after every other id; rows that
repeat an id are documents of their own, and copies only of texts of smaller ids; a label counts as 1 if any row of the
id says so, and no label as 0. No documents give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import find_words, slices
from tidemark.llm.components import stored
from tidemark.llm.tables import LAST_ID

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
RANGE = 1 << 16
RUN = 64
#: What is counted of the documents in a list.
COUNTS = ("removed", "good_lost", "toxic_lost")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|"]] = True


def judge(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each of the texts data[offsets[i]:offsets[i + 1]] fails; words are told apart by 64-bit hashes."""
    def inside(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[offsets])

    words = find_words(data, offsets)
    n_words = np.diff(words.first)
    text, h = words.text_of, words.hashes()
    order = np.lexsort((h, text))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=len(offsets) - 1)
    points = inside((data & 0xC0) != 0x80)
    capitals = inside((data >= 65) & (data <= 90))
    fails = (n_words < 100, 100 * distinct < 80 * n_words, 100 * capitals > 10 * points, inside(_SYMBOL[data]) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(2)):
            raw = data.tobytes()
            digests = [hashlib.sha256(raw[i:j]).digest() for i, j in itertools.pairwise(offsets.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                                              pa.array(judge(data, offsets)), pa.array(digests, pa.binary())],
                                             ["id", "part", "fails", "digest"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, fails) of every row: the filters it fails as bits, A the lowest."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seen = stored(rows.mapInArrow(_judged, "id long, part string, fails int, digest binary"), "judged")
    first = seen.groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("first"), F.count("*").alias("n_of")) \
        .filter("n_of > 1").select("of", "first")
    found = seen.join(first, F.col("digest") == F.col("of"), "left")
    copy = F.when(F.col("id") > F.col("first"), COPY).otherwise(0)
    return found.select("id", "part", (F.col("fails") + copy).alias("fails"))


def gallop(ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each of the sorted ``ids`` whether the sorted ``others`` have it.

    The first of every ``RUN`` ids is looked up; the others start from there and find their place by doubling steps and
    then by halving, all ids at once.
    """
    if not len(others) or not len(ids):
        return np.zeros(len(ids), bool)
    end = len(others) - 1
    low = np.minimum(np.repeat(np.searchsorted(others, ids[::RUN]), RUN)[:len(ids)], end)
    step = np.ones(len(ids), np.int64)
    while True:
        at = np.minimum(low + step, end)
        short = (others[at] < ids) & (at < end)
        if not short.any():
            break
        low, step = np.where(short, at, low), np.where(short, step * 2, step)
    high = np.minimum(low + step, end)
    while (low < high).any():
        middle = (low + high) // 2
        below = (others[middle] < ids) & (low < high)
        low, high = np.where(below, middle + 1, low), np.where(below, high, middle)
    return others[low] == ids


def merge(lists: list[np.ndarray]) -> np.ndarray:
    """Union of sorted lists, two at a time, the shortest first; what the longer one lacks is put in its place."""
    out = np.zeros(0, np.int64)
    for ids in sorted(lists, key=len):
        short, long = (out, ids) if len(out) < len(ids) else (ids, out)
        new = short[~gallop(short, long)]
        out = np.insert(long, np.searchsorted(long, new), new)
    return out


def sizes(fails: np.ndarray, weights: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """What each filter removes after each set of others, for one id range.

    ``fails`` are the filters each document of the range fails, in the order of their ids; ``weights`` has one row for each
    and a column for each of COUNTS. Keys are (bits of the filters applied before, filter); values are the documents that
    fail the filter, those removed before, and COUNTS.
    """
    n = len(FILTERS)
    postings = [np.flatnonzero(fails >> f & 1) for f in range(n)]
    out = {}
    for before in range(1 << n):
        union = merge([postings[f] for f in range(n) if before >> f & 1])
        gone = weights[union, 0].sum()
        for f in range(n):
            if not before >> f & 1:
                left = postings[f][~gallop(postings[f], union)]
                out[before, f] = [int(weights[postings[f], 0].sum()), int(gone), *map(int, weights[left].sum(axis=0))]
    return out


_SIZES = pa.schema([("part", pa.string()), ("before", pa.int32()), ("filter", pa.int32()),
                    *((c, pa.int64()) for c in ("docs", "failing", "gone", *COUNTS))])


def _range_sizes(part: str, fails: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    docs = int(weights[:, 0].sum())
    rows = [[part, before, f, docs, *found] for (before, f), found in sizes(fails, weights).items()]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SIZES, strict=True)], schema=_SIZES)


def _posting_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by part and id; a range ends with its part or when it is full."""
    part, held, rows = None, [], 0
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        code = names.indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(code) else np.zeros(0, int)
        fails = batch.column(1).to_numpy()
        weights = np.stack([batch.column(2 + c).to_numpy() for c in range(len(COUNTS))], axis=1)
        for lo, hi in itertools.pairwise(cuts.tolist()):
            name = names.dictionary[code[lo]].as_py()
            for a in range(lo, hi, RANGE):
                b = min(hi, a + RANGE)
                if held and (name != part or rows + b - a > RANGE):
                    yield _range_sizes(part, *map(np.concatenate, zip(*held, strict=True)))
                    held, rows = [], 0
                part, rows = name, rows + b - a
                held.append((fails[a:b], weights[a:b]))
    if held:
        yield _range_sizes(part, *map(np.concatenate, zip(*held, strict=True)))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bits applied before, filter) of every step of every order: 600 rows."""
    out = []
    for p in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in p)
        out += [(name, k + 1, sum(1 << x for x in p[:k]), f) for k, f in enumerate(p)]
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (removed by the step's filter, summed over all orders)."""
    one = {c: F.max(F.when(F.col(c).cast("int") == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")}
    known = labels.select(F.col(id_col).cast("long").alias("of"), "quality", "toxic").filter("of IS NOT NULL AND (quality = 1 OR toxic = 1)") \
        .groupBy("of").agg(*one.values())
    weight = {"removed": F.lit(1), "good_lost": F.coalesce("quality", F.lit(0)), "toxic_lost": F.coalesce("toxic", F.lit(0))}
    rows = failures(docs, id_col, text_col, part_col).join(known, F.col("id") == F.col("of"), "left") \
        .select("part", "fails", *(w.cast("long").alias(c) for c, w in weight.items()), "id")
    found = rows.sortWithinPartitions("part", "id").mapInArrow(
        _posting_sizes, ", ".join(f"{f.name} {'string' if f.name == 'part' else 'int' if f.name in ('before', 'filter') else 'long'}" for f in _SIZES))
    summed = found.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in ("docs", "failing", "gone", *COUNTS)))
    n = len(FILTERS)
    placed = F.bit_count("before")  # orders that apply just these filters before: theirs and the rest's in any order
    times = sum(F.when(placed == k, math.factorial(k) * math.factorial(n - 1 - k)).otherwise(0) for k in range(n))
    of_filter = Window.partitionBy("part", "filter")
    listed = summed.select("*", F.sum(F.col("removed") * times).over(of_filter).alias("shapley"),
                           F.max(F.when(placed == n - 1, F.col("removed"))).over(of_filter).alias("unique_fails"))
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, before int, filter int")
    return listed.join(F.broadcast(steps), ["before", "filter"]).select(
        "part", "filter_order", "step", (F.col("docs") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
