"""Work along a sorted order without a task per key: the order is cut into blocks of equal size.

Spark samples the rows and range-partitions them, so a key with very many rows, even in one instant, is many blocks. A block is
folded as a stream; what the ones after it need from it is one row, its *mark*. There are as many marks as
blocks, a number that is set and doesn't grow with the rows, so they are broadcast.

Marks and rows are made from the same exchange, which Spark reuses: the input is read and shuffled once. Both would be
cut differently if it were not, so every row carries the first order values of its block and must find a mark with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]
BLOCK = T.StructType([T.StructField("_block", T.IntegerType()), T.StructField("_sign", T.LongType())])


def sorted_blocks(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rows in blocks of about equal size by their order, sorted; as many as shuffle partitions if not said otherwise."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        raise ValueError("blocks need spark.sql.exchange.reuse")
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


class Signed:
    """Adds the block's number and first order values to what ``fold`` yields; a picklable callable for ``mapInArrow``."""

    def __init__(self, fold: Callable[[Batches], Batches], order: Sequence[str]):
        self.fold, self.order = fold, list(order)

    def __call__(self, batches: Batches) -> Batches:
        block, sign = TaskContext.get().partitionId(), None

        def seen() -> Batches:
            nonlocal sign
            for batch in batches:
                if sign is None and len(batch):
                    first = repr([batch.column(c)[0].as_py() for c in self.order])
                    sign = int.from_bytes(hashlib.blake2b(first.encode(), digest_size=8).digest(), "little", signed=True)
                yield batch

        for out in self.fold(seen()):
            n = len(out)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(n, block, np.int32)), pa.array(np.full(n, sign, np.int64))],
                                             [*out.schema.names, "_block", "_sign"])


def block_rows(placed: DataFrame, order: Sequence[str], fold: Callable[[Batches], Batches], schema: T.StructType) -> DataFrame:
    """What ``fold`` yields for each block (``schema``), with ``_block`` and ``_sign``."""
    return placed.mapInArrow(Signed(fold, order), T.StructType([*schema.fields, *BLOCK.fields]))


def with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows with the columns of their block's mark; ``marks`` has one row for each block, so it is broadcast.

    They meet by the block's first order values alone: where Spark runs the rows in one stage with another branch of a union, the
    blocks' numbers don't begin with 0.
    """
    known = F.broadcast(marks.drop("_block").withColumn("_marked", F.lit(True)))
    both = rows.join(known, "_sign", "left")
    same = F.when(F.col("_marked"), True).otherwise(F.raise_error(F.lit("rows and marks come from different cuts")).cast("boolean"))
    return both.filter(same).drop("_marked", "_block", "_sign")


def before(value: Column) -> Column:
    """The value of the nearest block before the mark's own; marks are as many as blocks, so one task sorts them."""
    return F.lag(value).over(Window.orderBy("_block"))


class RunningCounts:
    """Rows with ``_n``, how many flagged rows their key has so far in the block; or the mark: the last key and its count."""

    def __init__(self, keys: Sequence[str], flags: Sequence[str], marks: bool):
        self.keys, self.flags, self.marks = list(keys), list(flags), marks

    def __call__(self, batches: Batches) -> Batches:
        last, carry, names = None, np.zeros(len(self.flags), np.int64), None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            starts = key_starts(batch, self.keys)
            first = tuple(batch.column(k)[0].as_py() for k in self.keys)
            counts = []
            for f, flag in enumerate(self.flags):
                total = np.cumsum(batch.column(flag).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64))
                base = np.repeat(np.where(starts > 0, total[starts - 1], 0), np.diff(np.append(starts, n)))
                own = total - base
                if first == last:
                    own[:starts[1] if len(starts) > 1 else n] += carry[f]
                counts.append(own)
            last = tuple(batch.column(k)[n - 1].as_py() for k in self.keys)
            carry = np.array([c[-1] for c in counts], np.int64)
            names = [*self.keys, *(f"_n{f}" for f in range(len(self.flags)))]
            end = batch.slice(n - 1, 1)
            if not self.marks:
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts)], [*batch.schema.names, *names[len(self.keys):]])
        if self.marks and names:
            yield pa.RecordBatch.from_arrays([*(end.column(k) for k in self.keys), *(pa.array([int(c)]) for c in carry)], names)


def key_starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows where a batch's key differs from that of the row before; the first is one."""
    new = np.zeros(len(batch), bool)
    new[0] = True
    for k in keys:
        column = batch.column(k).dictionary_encode()
        code = column.indices.fill_null(-1).to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def running_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], flags: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rows with each of the boolean columns ``flags`` replaced by how often it was true for the row's keys so far."""
    by = [*keys, *order]
    placed = sorted_blocks(df, by, blocks)
    n = [T.StructField(f"_n{f}", T.LongType()) for f in range(len(flags))]
    rows = block_rows(placed, by, RunningCounts(keys, flags, False), T.StructType([*df.schema.fields, *n]))
    named = [df.schema[k] for k in keys]
    marks = block_rows(placed, by, RunningCounts(keys, flags, True), T.StructType([*named, *n]))
    so_far = Window.partitionBy(*keys).orderBy("_block")
    ends = marks.select("_block", "_sign", F.struct(*keys).alias("_key"), *(F.sum(f.name).over(so_far).alias(f.name) for f in n))
    carry = ends.select("_block", "_sign", before(F.col("_key")).alias("_key"), *(before(F.col(f.name)).alias("_c" + f.name) for f in n))
    goes_on = F.struct(*keys).eqNullSafe(F.col("_key"))
    both = with_marks(rows, carry)
    counts = [(F.col(f.name) + F.when(goes_on, F.col("_c" + f.name)).otherwise(0)).alias(flag) for f, flag in zip(n, flags, strict=True)]
    return both.select(*(c for c in df.columns if c not in flags), *counts)


class LastBefore:
    """Points with the last range that starts at or before them in the block; or the mark: the block's last range."""

    def __init__(self, marks: bool):
        self.marks = marks

    def __call__(self, batches: Batches) -> Batches:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            point, span = batch.column("row"), batch.column("span")
            is_range = span.is_valid().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(is_range, np.arange(len(batch)), -1))
            if last is None:
                last = pa.nulls(1, span.type)
            source = pa.concat_arrays([last, span])
            if not self.marks:
                points = pa.array(np.flatnonzero(~is_range))
                yield pa.RecordBatch.from_arrays([point.take(points), source.take(pa.array(at + 1)).take(points), batch.column("n").take(points)],
                                                 ["row", "span", "n"])
            last = source.slice(int(at[-1]) + 1, 1)
        if self.marks and last is not None:
            yield pa.RecordBatch.from_arrays([last], ["span"])


def last_range(points: DataFrame, ranges: DataFrame, blocks: int | None = None) -> DataFrame:
    """As-of join: ``points(row, n)`` with ``span``, the last of ``ranges(n, span)`` that starts at or before n (null: none).

    Points and starts form one sorted stream; equal points are told apart by their place in the input, so many of them are many
    blocks.
    """
    kind = points.schema["row"].dataType
    stream = ranges.select("n", F.lit(0).cast("long").alias("tie"), F.lit(None).cast(kind).alias("row"), "span").unionByName(
        points.select("n", (F.monotonically_increasing_id() + 1).alias("tie"), "row", F.lit(None).cast(ranges.schema["span"].dataType).alias("span")))
    placed, span = sorted_blocks(stream, ["n", "tie"], blocks), stream.schema["span"]
    rows = block_rows(placed, ["n", "tie"], LastBefore(False), T.StructType([stream.schema["row"], span, stream.schema["n"]]))
    marks = block_rows(placed, ["n", "tie"], LastBefore(True), T.StructType([span]))
    held = F.last("span", ignorenulls=True).over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    both = with_marks(rows, marks.select("_block", "_sign", held.alias("_carry")))
    return both.select("row", "n", F.coalesce("span", "_carry").alias("span"))
