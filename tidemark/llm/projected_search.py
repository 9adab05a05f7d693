"""Approximate nearest neighbours: low-dimensional stable projections, indexed by a kd-tree, verified until a chi-square test holds.

Every vector is multiplied by a fixed matrix of ``dims`` columns of standard normal numbers (a 2-stable projection). The squared distance
of two projections over that of their vectors is then chi-square distributed with ``dims`` degrees of freedom, whatever the vectors. A search takes
projected neighbours by rising distance and verifies each on the original vectors. With the k-th best verified distance d, it may
stop at a projected distance r once a vector as near as d would have shown itself within r with the wanted ``confidence``: r² > q·d², where
q is the chi-square quantile of the confidence. Each true neighbour is found at least with that probability.

1. Vectors and projections are written once, each row with a number of its own.
2. The upper kd-tree is fitted on at most ``SAMPLE`` projections (the smallest hashes of the row numbers); all else covers all rows. Its leaves are cells,
   so many that a cell has about a block of rows, and at most SAMPLE / 32.
3. Every vector is put into its cell. Cells are dealt to blocks of bounded size, so one that very many equal vectors share is
   many blocks. A block is one row with a lower kd-tree over its projections.
4. Queries are packed in the same way. Each pack first searches one block of its own cell, which gives every query a bound for d; then
   all blocks of those cells that the test doesn't exclude for some query of the pack. A work unit is one block and at most
   ``PACKS`` packs. Each unit returns its k best for a query, and a window over the query's rows keeps the k best.

Blocks and packs are written to the shared folder, so a lost executor costs a re-read; jobs run while the query is built. Only cell bounds (at most
SAMPLE / 32 boxes) go to all tasks. Rows are numbered by their place in the input's partitions, which must be the same when a task is
repeated, as in files.

Nulls and odd rows: vectors that are null, empty, zero or hold a null, an infinity or no number take no part, neither as query nor as
candidate; neighbours of a vector are looked for among those of its length; a null id is no query, and as a candidate it comes after every other; rows that
repeat an id or a vector are candidates of their own. No vectors give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import stored
from tidemark.llm.tables import LAST_ID, given_id

SAMPLE, LEAF, PACKS = 1 << 14, 64, 64
BLOCK_ROWS, BLOCK_BYTES, PACK_ROWS = 1 << 13, 4 << 20, 256


def chi_square_quantile(p: float, dims: int) -> float:
    """x of which a chi-square variable of ``dims`` degrees of freedom stays below with probability p."""
    def below(x: float) -> float:
        a, x = dims / 2, x / 2
        term = total = math.exp(a * math.log(x) - x - math.lgamma(a + 1))
        n = a
        while term > 1e-17 * total or n < x:
            n += 1
            term *= x / n
            total += term
        return total

    low, high = 1e-9, 10.0 * dims + 100
    while high - low > 1e-10 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(width: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, dims))


@dataclass
class Cells:
    """Upper kd-tree: inner nodes (axis, cut, left, right), leaves by their box. A child below 0 is the leaf -1 - child."""

    axis: list[int]
    cut: list[float]
    child: list[list[int]]
    low: np.ndarray
    high: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), 0 if self.axis else -1)
        axis, cut, child = np.array(self.axis, int), np.array(self.cut), np.array(self.child, int).reshape(-1, 2)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = child[node, (points[inner, axis[node]] >= cut[node]).astype(int)]
        return -1 - at


def fit_cells(points: np.ndarray, cells: int) -> Cells:
    """Splits the points at medians of their widest axes into about as many cells; equal points stay together."""
    dims = points.shape[1]
    out = Cells([], [], [], np.zeros((0, dims)), np.zeros((0, dims)))
    low, high = [], []
    todo = [(points, np.full(dims, -np.inf), np.full(dims, np.inf), max(1, cells), None)]
    while todo:
        own, lo, hi, want, parent = todo.pop()
        axis = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
        cut = float(np.median(own[:, axis])) if len(own) else 0.0
        right = own[:, axis] >= cut
        if right.all() and len(own):  # the median is the smallest value: cut above it, if there is anything
            above = own[own[:, axis] > cut, axis]
            cut = float(above.min()) if len(above) else cut
            right = own[:, axis] >= cut
        if want == 1 or len(own) < 2 or right.all():
            number = -1 - len(low)
            low.append(lo)
            high.append(hi)
        else:
            number = len(out.axis)
            out.axis.append(axis)
            out.cut.append(cut)
            out.child.append([0, 0])
            middle_hi, middle_lo = hi.copy(), lo.copy()
            middle_hi[axis] = middle_lo[axis] = cut
            todo.append((own[right], middle_lo, hi, want - want // 2, (number, 1)))
            todo.append((own[~right], lo, middle_hi, want // 2, (number, 0)))
        if parent:
            out.child[parent[0]][parent[1]] = number
    out.low, out.high = np.array(low), np.array(high)
    return out


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(axis=1)


def lower_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points by leaf of a kd-tree, and where its leaves of at most LEAF points begin and end."""
    order, cuts, todo = np.arange(len(points)), [0], [(0, len(points))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            cuts.append(hi)
            continue
        own = points[order[lo:hi]]
        half = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(own[:, int(np.argmax(np.ptp(own, axis=0)))], half)]
        todo += [(lo + half, hi), (lo, lo + half)]
    return order, np.array(cuts)


class Block:
    """Vectors of one block with their ids, row numbers, projections and leaves."""

    def __init__(self, row: dict, dtype: str, dims: int):
        width = row["width"]
        self.ids, self.rows = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], dtype).reshape(-1, width).astype(float)
        self.points = np.frombuffer(row["points"], "<f8").reshape(-1, dims)
        order, cuts = lower_tree(self.points)
        self.ids, self.rows, self.vectors, self.points = (x[order] for x in (self.ids, self.rows, self.vectors, self.points))
        self.cuts = cuts
        begin = cuts[:-1]
        self.low, self.high = np.minimum.reduceat(self.points, begin), np.maximum.reduceat(self.points, begin)

    def nearest(self, row: int, vector: np.ndarray, point: np.ndarray, bound: float, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest found, none farther than the bound, nearest first."""
        slack = 1e-12 * float(point @ point)
        leaves = np.flatnonzero(~(box_distances(point, self.low, self.high) > quantile * bound * bound + slack))
        at = np.concatenate([np.arange(self.cuts[i], self.cuts[i + 1]) for i in leaves]) if len(leaves) else np.zeros(0, int)
        away = ((self.points[at] - point) ** 2).sum(axis=1)
        order = np.argsort(away, kind="stable")
        at, away = at[order], away[order]
        best, far, done, step = np.zeros(0, int), np.zeros(0), 0, 2 * LEAF
        while done < len(at) and not away[done] > quantile * bound * bound + slack:
            take = at[done:done + step]
            take = take[self.rows[take] != row]
            distance = np.sqrt(((self.vectors[take] - vector) ** 2).sum(axis=1))
            near = distance <= bound
            best, far = np.concatenate([best, take[near]]), np.concatenate([far, distance[near]])
            first = np.lexsort((self.rows[best], self.ids[best], far))[:k]
            best, far = best[first], far[first]
            if len(best) == k:
                bound = min(bound, float(far[-1]))
            done, step = done + step, step * 2
        return best, far


def _packed(rows: DataFrame, size: Callable[[int], int], sizes: DataFrame) -> DataFrame:
    """Rows of (width, cell) packed into blocks: width, cell, block, ids, rows, vectors, points."""
    limit = F.greatest(F.ceil(F.col("n") / size(F.col("width"))), F.lit(1))
    dealt = rows.join(sizes, ["width", "cell"]).withColumn("block", F.pmod("spread", limit).cast("long"))

    def pack(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        by = np.argsort(batch["row"].to_numpy(), kind="stable")
        batch = batch.take(pa.array(by))
        return pa.table({"width": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()),
                         "block": pa.array([key[2].as_py()], pa.int64()),
                         "ids": [batch["vec_id"].to_numpy().astype("<i8").tobytes()], "rows": [batch["row"].to_numpy().astype("<i8").tobytes()],
                         "vectors": [b"".join(batch["vector"].to_pylist())], "points": [b"".join(batch["point"].to_pylist())]})

    return dealt.groupBy("width", "cell", "block").applyInArrow(
        pack, "width int, cell int, block long, ids binary, rows binary, vectors binary, points binary")


def _projected(vectors: DataFrame, id_col: str, vector_col: str, single: bool, dims: int, seed: int) -> DataFrame:
    dtype = "<f4" if single else "<f8"
    kind = "float" if single else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("vec_id"), v.alias("vector")).filter(usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, column = len(batch), batch.column(1)
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            width = np.diff(offsets).astype(np.int32)
            points = np.zeros((n, dims))
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                points[own] = flat[(offsets[own][:, None] + np.arange(w))].astype(float) @ projection(int(w), dims, seed)
            raw, size = flat.tobytes(), np.dtype(dtype).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number + np.arange(n)), pa.array(width),
                 pa.array([raw[i * size:j * size] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()),
                 pa.array([p.tobytes() for p in points], pa.binary())], ["vec_id", "row", "width", "vector", "point"])
            number += n

    return rows.mapInArrow(run, "vec_id long, row long, width int, vector binary, point binary")


def _in_cells(rows: DataFrame, trees: dict[int, Cells], dims: int) -> DataFrame:
    """Rows with their cell, and a number that deals the rows of a cell evenly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            width, points = batch.column("width").to_numpy(), np.frombuffer(b"".join(batch.column("point").to_pylist()), "<f8").reshape(-1, dims)
            cell = np.zeros(len(batch), np.int32)
            for w in np.unique(width):
                if w in trees:
                    cell[width == w] = trees[w].of(points[width == w])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(number + np.arange(len(batch)))], [*batch.schema.names, "cell", "spread"])
            number += len(batch)

    return rows.mapInArrow(run, "vec_id long, row long, width int, vector binary, point binary, cell int, spread long")


_FOUND = "query_row long, query_id long, vec_id long, vec_row long, score double"


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, dims: int = 8, confidence: float = 0.95, seed: int = 13,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of every row whose id ``is_query`` accepts the k nearest other rows found.

    ``score`` is the Euclidean distance of the original vectors in double precision; equally near rows come by smaller id.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    dtype, item = ("<f4", 4) if single else ("<f8", 8)
    quantile = chi_square_quantile(confidence, dims)
    rows = stored(_projected(vectors, id_col, vector_col, single, dims, seed), "projected")
    trees = _fit(rows, dims, item)
    placed = _in_cells(rows, trees, dims)
    sizes = stored(placed.groupBy("width", "cell").agg(F.count("*").alias("n")), "cells")
    blocks = stored(_packed(placed, lambda w: F.greatest(F.lit(LEAF), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (w * item)))), sizes), "blocks")
    asked = placed.filter((F.col("vec_id") != LAST_ID) & is_query(F.col("vec_id")))
    asked_sizes = asked.groupBy("width", "cell").agg(F.count("*").alias("n"))
    packs = _packed(asked, lambda w: F.lit(PACK_ROWS), asked_sizes)

    def queries_of(row: dict) -> list[tuple]:
        q = np.frombuffer(row["vectors"], dtype).reshape(-1, row["width"]).astype(float)
        p = np.frombuffer(row["points"], "<f8").reshape(-1, dims)
        bound = np.frombuffer(row["bounds"], "<f8") if row.get("bounds") else np.full(len(q), np.inf)
        return list(zip(np.frombuffer(row["rows"], "<i8").tolist(), np.frombuffer(row["ids"], "<i8").tolist(), q, p, bound.tolist(), strict=True))

    def at_home(block_table: pa.Table, pack_table: pa.Table) -> pa.Table:
        """Packs of a cell searched in its first block: the packs with their bounds and what was found."""
        block = Block(block_table.to_pylist()[0], dtype, dims) if len(block_table) else None
        out = []
        for row in pack_table.to_pylist():
            found = [(q, i, *block.nearest(q, v, p, b, k, quantile)) for q, i, v, p, b in queries_of(row)]
            bounds = np.array([far[-1] if len(far) == k else np.inf for *_, far in found])
            hits = [(q, i, int(block.ids[a]), int(block.rows[a]), float(d)) for q, i, at, far in found for a, d in zip(at, far, strict=True)]
            out.append(row | {"bounds": bounds.tobytes(), "found": [dict(zip(("query_row", "query_id", "vec_id", "vec_row", "score"), h, strict=True)) for h in hits]})
        return pa.Table.from_pylist(out, schema=home_schema)

    hit = pa.struct([(n, pa.float64() if n == "score" else pa.int64()) for n in ("query_row", "query_id", "vec_id", "vec_row", "score")])
    home_schema = pa.schema([("width", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("ids", "rows", "vectors", "points", "bounds")),
                             ("found", pa.list_(hit))])
    home = stored(blocks.filter("block = 0").groupBy("width", "cell").cogroup(packs.groupBy("width", "cell")).applyInArrow(
        at_home, "width int, cell int, block long, ids binary, rows binary, vectors binary, points binary, bounds binary, "
                 f"found array<struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>>"), "packs")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The packs once for each cell that the test doesn't exclude for some query of theirs."""
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                tree = trees.get(row["width"])
                cells = np.zeros(1, np.int32)
                if tree:
                    needed = np.zeros(len(tree.low), bool)
                    for _, _, _, p, b in queries_of(row):
                        needed |= ~(box_distances(p, tree.low, tree.high) > quantile * b * b + 1e-12 * float(p @ p))
                    cells = np.flatnonzero(needed).astype(np.int32)
                own = batch.slice(i, 1).take(pa.array(np.zeros(len(cells), int)))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cells)], [*own.schema.names, "at"])

    # A unit is one block and the packs of one hand; blocks are copied for each hand, packs for each block they visit.
    hands = max(1, math.ceil(home.count() / PACKS))
    n_blocks = blocks.groupBy("width", F.col("cell").alias("at")).agg(F.max("block").alias("last"))
    bare = home.select("width", "cell", "block", "ids", "rows", "vectors", "points", "bounds")
    visiting = bare.mapInArrow(visits, bare.schema.simpleString()[7:-1].replace(":", " ") + ", at int").join(n_blocks, ["width", "at"]) \
        .withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), "last"))) \
        .filter("NOT (at = cell AND to = 0)").withColumn("hand", F.pmod(F.xxhash64("width", "cell", "block"), F.lit(hands)))
    offered = blocks.withColumnsRenamed({"cell": "at", "block": "to"}).withColumn("hand", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hands - 1).cast("long"))))

    def in_block(block_table: pa.Table, pack_table: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        if len(pack_table):
            block = Block(block_table.to_pylist()[0], dtype, dims)
            for row in pack_table.to_pylist():
                for q, i, v, p, b in queries_of(row):
                    at, far = block.nearest(q, v, p, b, k, quantile)
                    for c, x in zip(columns, ([q] * len(at), [i] * len(at), block.ids[at], block.rows[at], far), strict=True):
                        c.extend(x)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, hit, strict=True)], names=[f.name for f in hit])

    unit, parts = ["width", "at", "to", "hand"], shuffle_partitions(vectors)
    found = offered.repartition(parts, *unit).groupBy(*unit).cogroup(visiting.repartition(parts, *unit).groupBy(*unit)).applyInArrow(in_block, _FOUND)
    every = found.union(home.select(F.inline("found")))
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "vec_row")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", given_id("vec_id").alias("vec_id"), "score")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fit(rows: DataFrame, dims: int, item: int) -> dict[int, Cells]:
    """Upper trees by vector length, for the lengths in the sample; vectors of another length are one cell."""
    n = rows.count()
    taken = rows.select("width", "point", F.xxhash64("row").alias("h"), "row").orderBy("h", "row").limit(SAMPLE).toArrow()
    width = taken["width"].to_numpy()
    points = np.frombuffer(b"".join(taken["point"].to_pylist()), "<f8").reshape(-1, dims)
    out = {}
    for w in np.unique(width):
        own = points[width == w]
        block = max(LEAF, min(BLOCK_ROWS, BLOCK_BYTES // (int(w) * item)))
        out[int(w)] = fit_cells(own, min(math.ceil(n * len(own) / len(width) / block), max(1, len(own) // 32)))
    return out
