"""Near duplicates: a multi-index Hamming join over b-bit MinHash signatures, confirmed on the full shingle sets.

A text's set is its distinct runs of ``SHINGLE`` words, as 64-bit hashes. Texts with equal sets (128-bit fingerprint) are
one node, named by its smallest id. A node's signature has ``SYMBOLS`` MinHash values of 16 bits. It is split into chunks of
``CHUNK`` symbols. If two signatures differ in at most ``GUARANTEED`` symbols, then by the pigeonhole principle some chunk
differs in at most one; the errors allowed are enumerated by leaving out each symbol of a chunk in turn, so those two share a
key. At the wanted similarity of 0.75 a chunk has at most one error with probability 0.74, and all twelve fail together in 1 of
10 million pairs.

A key's bucket never becomes a group in a task, and its pairs are never all drawn:

1. each member is compared with the bucket's pivot only, found by a pre-aggregated minimum; twice, with other pivots;
2. links that hold on the full sets make components; what already hangs together need not be compared;
3. what is left are pairs of different components, of texts that share a bucket with another component. Two sets that are
   similar enough must share one of their first shingles, in an order from rare to frequent, early enough that what follows
   can make up the overlap (prefix and position filter). Pairs that do, and are close enough by signature, are compared. No
   link that could join two components is lost by that, and copies that strayed too far from a large group's centre meet
   nobody, as their own shingles are rare.

A pivot with many partners is replicated to several tasks of ``STAR`` partners each. Intermediate results are written to the
shared folder.

Nulls and odd rows: a null text, or one without words, has an empty set, is linked with nothing and is kept; rows without
id are kept and are in no component (null); rows that repeat an id are one node of the graph; every row comes back once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import Words, find_words, mix, slices, window_hashes
from tidemark.llm.components import components, stored
from tidemark.llm.tables import LAST_ID, given_id, keyed

SHINGLE, SYMBOLS, CHUNK, STAR = 5, 48, 4, 64
GUARANTEED = 2 * (SYMBOLS // CHUNK) - 1
#: Pairs whose signatures differ in more symbols are not compared; at 0.75 that is 1 pair in a million.
FARTHEST = 27

#: Slots of the table of shingle counts that orders shingles; its size is fixed, and any order gives the same links.
ORDER_BITS = 18
#: Components of more nodes than this are large; large ones are joined with each other apart.
LARGE = 64

_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their offsets."""
    h = words.hashes(lower=True)
    counts = np.diff(words.first)
    out, at = [], np.zeros(len(counts) + 1, np.int64)
    runs = window_hashes(h, SHINGLE)
    for i, n in enumerate(counts.tolist()):
        first = words.first[i]
        if n >= SHINGLE:
            s = np.sort(runs[first:first + n - SHINGLE + 1])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        elif n:
            s = window_hashes(h[first:first + n], n) ^ np.uint64(n)
        else:
            s = h[:0]
        out.append(s)
        at[i + 1] = at[i] + len(s)
    return np.concatenate(out) if out else h[:0], at


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS 16-bit values for each set; sets must not be empty."""
    low = np.empty((len(at) - 1, SYMBOLS), np.uint64)
    for k in range(SYMBOLS):
        low[:, k] = np.minimum.reduceat(sets * _FACTORS[k], at[:-1])
    return (mix(low) >> np.uint64(48)).astype("<u2")


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(2)):
            sets, at = shingle_sets(find_words(data, offsets))
            size = np.diff(at)
            full = np.flatnonzero(size)
            sign, d1, d2 = [None] * (hi - lo), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            if len(full):
                starts = at[:-1][full]
                for i, s in zip(full.tolist(), signatures(sets, np.r_[starts, at[-1]]), strict=True):
                    sign[i] = s.tobytes()
                d1[full] = np.add.reduceat(mix(sets), starts).view(np.int64)
                d2[full] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size), pa.array(d1),
                 pa.array(d2), pa.array(sign, pa.binary())], ["id", "tag", "n", "d1", "d2", "sign"])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS).astype(np.uint64)
        for c in range(SYMBOLS // CHUNK):
            part = sign[:, c * CHUNK:(c + 1) * CHUNK]
            for left_out in range(CHUNK):
                key = np.full(len(ids), c * CHUNK + left_out + 1, np.uint64)
                for k in range(CHUNK):
                    if k != left_out:
                        key = (key << np.uint64(16)) | part[:, k]  # 48 bits of symbols below the chunk's number
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids)], ["key", "rep"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SYMBOLS) for i in (2, 3))
            close = pa.array((a != b).sum(1) <= FARTHEST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["p", "q"]).filter(close)


def _confirm(percent: int):
    """Rows (p, salt, q, text) sorted so that a pivot's texts (q null) come before its partners'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            p, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            is_pivot = np.asarray(batch.column(2).is_null())
            q = batch.column(2).fill_null(0).to_numpy()
            good = []
            for lo, hi, data, offsets in slices(batch.column(3)):
                sets, at = shingle_sets(find_words(data, offsets))
                for i in range(hi - lo):
                    k, mine = lo + i, sets[at[i]:at[i + 1]]
                    if (p[k], salt[k]) != now:
                        now, pivots = (p[k], salt[k]), []
                    if is_pivot[k]:
                        pivots.append(mine.copy())
                        continue
                    for s in pivots:
                        if not len(s):
                            continue
                        where = np.searchsorted(s, mine)
                        where[where == len(s)] = 0
                        both = int((s[where] == mine).sum())
                        if 100 * both >= percent * (len(s) + len(mine) - both) and both:
                            good.append(k)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(p[good]), pa.array(q[good])], ["a", "b"])
    return run


def _pairs_close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    sign = reps.select(F.col("rep").alias("p"), F.col("sign").alias("sp"))
    other = reps.select(F.col("rep").alias("q"), F.col("sign").alias("sq"))
    return pairs.join(sign, "p").join(other, "q").select("p", "q", "sp", "sq").mapInArrow(_near, "p long, q long")


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, q) that hold on the full sets, as (a, b)."""
    many = pairs.groupBy("p").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = pairs.join(many, "p").select("p", F.pmod(F.xxhash64("q"), F.col("parts")).alias("salt"), "q")
    partners = dealt.join(texts.select(F.col("rep").alias("q"), "text"), "q").select("p", "salt", "q", "text")
    pivots = dealt.select("p", "salt").distinct().join(texts.select(F.col("rep").alias("p"), "text"), "p") \
        .select("p", "salt", F.lit(None).cast("long").alias("q"), "text")
    # No number of partitions: Spark joins those of a few pairs, which else are as many tasks for the driver to keep as for many.
    return pivots.union(partners).repartition("p", "salt") \
        .sortWithinPartitions("p", "salt", F.col("q").asc_nulls_first()).mapInArrow(_confirm(percent), "a long, b long") \
        .distinct()


def _slot(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            total += np.bincount(_slot(shingle_sets(find_words(data, offsets))[0]), minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])


def _first_shingles(shared, percent: int):
    """Rows (shingle, rep, c, n, at) of the shingles of (rep, c, text) that a similar set must share one of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            rep, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in slices(batch.column(2)):
                sets, at = shingle_sets(find_words(data, offsets))
                own = np.repeat(np.arange(hi - lo), np.diff(at))
                sets = sets[np.lexsort((sets, counts[_slot(sets)], own))]
                n = np.diff(at)
                place = np.arange(len(sets)) - at[own]
                pick = place + -(-percent * n[own] // 100) <= n[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets[pick].view(np.int64)), pa.array(rep[lo + own[pick]]), pa.array(c[lo + own[pick]]),
                     pa.array(n[own[pick]].astype(np.int32)), pa.array(place[pick].astype(np.int32))],
                    ["shingle", "rep", "c", "n", "at"])
    return run


def _across(texts: DataFrame, place: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, q) of different components, both in buckets with several, that may be similar enough."""
    spark = texts.sparkSession
    placed = members.join(place, "rep")
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    left = stored(placed.join(mixed, "key").select("rep", "c").distinct(), "open")
    rows = stored(texts.join(left, "rep").select("rep", "c", "text"), "open-texts")
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    found = rows.select("text").mapInArrow(_count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    size = left.groupBy("c").agg((F.count("*") > LARGE).alias("large"))
    first = stored(rows.mapInArrow(_first_shingles(spark.sparkContext.broadcast(counts), percent),
                                   "shingle long, rep long, c long, n int, at int").join(size, "c"), "first-shingles")
    several = first.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("shingle")
    first = first.join(several, "shingle")
    large = first.filter("large")
    two = large.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("shingle")
    need = f"({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent}"
    meets = f"a.shingle = b.shingle and a.at + {need} <= a.n and b.at + {need} <= b.n"
    some = first.filter("not large").alias("a").join(first.alias("b"), F.expr(f"{meets} and a.c <> b.c and (b.large or a.c < b.c)"))
    others = large.join(two, "shingle")
    more = others.alias("a").join(others.alias("b"), F.expr(f"{meets} and a.c < b.c"))
    return some.select(F.col("a.rep").alias("p"), F.col("b.rep").alias("q")) \
        .union(more.select(F.col("a.rep").alias("p"), F.col("b.rep").alias("q")))


def _once(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, in one of its directions."""
    return pairs.groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.min("p").alias("p")) \
        .select("p", (F.col("x") + F.col("y") - F.col("p")).alias("q"), "x", "y")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, tag, n_shingles, component_id (smallest id reachable over links) and kept."""
    rows = keyed(docs, id_col, text_col)
    sets = stored(rows.mapInArrow(_set_rows, "id long, tag long, n long, d1 long, d2 long, sign binary"), "sets")
    nodes = sets.filter(F.col("sign").isNotNull() & (F.col("id") != LAST_ID))
    reps = stored(nodes.groupBy("d1", "d2", "sign").agg(F.min("id").alias("rep")), "nodes")
    keys = reps.select("rep", "sign").mapInArrow(_key_rows, "key long, rep long")
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("key")
    members = stored(keys.join(shared, "key").select("key", "rep"), "members")
    needed = members.select("rep").distinct()
    texts = stored(rows.select(F.col("id").alias("rep"), "text").join(needed, "rep"), "texts")

    place = needed.select("rep", F.col("rep").alias("c"))
    tested = None
    for turn in range(3):
        if turn < 2:
            order = F.col("rep") if turn == 0 else F.xxhash64("rep")
            pivot = members.groupBy("key").agg(F.min(F.struct(order.alias("s"), "rep"))["rep"].alias("p"))
            at = place.select(F.col("rep").alias("p"), F.col("c").alias("cp"))
            pairs = members.join(place, "rep").join(pivot.join(at, "p"), "key").filter("c <> cp") \
                .select("p", F.col("rep").alias("q"))
        else:
            pairs = _across(texts, place, members, percent)
        pairs = _once(pairs)
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = stored(_pairs_close(pairs.select("p", "q"), reps), "pairs")
        done = pairs.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
        tested = done if tested is None else tested.union(done)
        links = stored(_links(pairs, texts, percent), "links")
        one = place.select(F.col("rep").alias("a"), F.col("c").alias("ca"))
        two = place.select(F.col("rep").alias("b"), F.col("c").alias("cb"))
        joined = components(links.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        place = stored(place.join(joined.withColumnRenamed("node", "c"), "c", "left")
                       .select("rep", F.coalesce("component", "c").alias("c")), "places")
    of_set = reps.join(place, "rep", "left").select("d1", "d2", F.coalesce("c", "rep").alias("c"))
    out = sets.join(of_set.groupBy("d1", "d2").agg(F.min("c").alias("c")), ["d1", "d2"], "left")
    mine = F.coalesce(F.col("c"), F.col("id"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(mine)
    return out.select(given_id().alias("doc_id"), "tag", F.col("n").alias("n_shingles"),
                      F.when(F.col("id") != LAST_ID, component).alias("component_id"),
                      ((F.col("id") == LAST_ID) | (F.col("id") == component)).alias("kept"))
