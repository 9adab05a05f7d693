"""Windowed operators that stay balanced when one key holds a third of the rows.

* Latest-n and first-occurrence use a ``row_number() <= n`` filter, which Spark also applies before
  the shuffle (WindowGroupLimit): a hot key sends n rows per task.
* Running totals are prefix sums over equal blocks of the sorted rows (``operators.blocks``); sliding counts cut a key's
  timeline into cells, so that a key is spread over as many groups as it has busy cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.time import epoch_micros
from tidemark.operators.blocks import running_counts


def share_of_total(df: DataFrame, part: Sequence[str], value: str) -> DataFrame:
    """Percent of the partition's total, from pre-aggregated totals."""
    totals = df.groupBy(*part).agg(F.sum(value).alias("part_total"))
    total = F.when(F.col("part_total") == 0, F.lit(1.0)).otherwise(F.col("part_total").cast("double"))
    return (df.join(totals, list(part))
            .withColumn("share", F.col(value).cast("double") / total * 100).drop("part_total"))


def _first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def latest_n(df: DataFrame, keys: Sequence[str], ts: str, tie: str, n: int = 20) -> DataFrame:
    return _first_n(df, keys, [F.col(ts).desc(), F.col(tie).desc()], n, "position")


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, *tie: str) -> DataFrame:
    """The newest row of each key; equal times are settled by the tie columns, largest first."""
    order = [F.col(c).desc() for c in (ts, *tie)]
    return _first_n(df, keys, order, 1, "_rank").drop("_rank")


def dedupe(df: DataFrame, keys: Sequence[str], pos: str, mode: str = "skip") -> DataFrame:
    """Repeated keys of an ordered stream: ``keep`` all, ``skip`` repeats, or ``stop`` at the first."""
    if mode == "keep":
        return df
    if mode == "skip":
        return _first_n(df, keys, [F.col(pos).asc()], 1, "_rank").drop("_rank")
    if mode == "stop":
        repeats = _first_n(df.select(*keys, pos), keys, [F.col(pos).asc()], 2, "_rank").filter("_rank = 2")
        first = repeats.agg(F.min(pos).alias("stop_at")).scalar()
        return df.filter(F.coalesce(F.col(pos) < first, F.lit(True)))
    raise ValueError(f"unknown mode {mode!r}")


def _cell(micros: Column, seconds: int) -> Column:
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("bigint")


def so_far(cell: WindowSpec, upto: int, flag: Column | None = None) -> Column:
    """Rows of the cell (with ``flag``: those where it is true) whose time is at most ``upto`` after this row's."""
    counted = F.count(F.lit(1)) if flag is None else F.count_if(flag)
    return counted.over(cell.rangeBetween(W.unboundedPreceding, upto))


def between(cell: WindowSpec, lo: int, hi: int, flag: Column | None = None) -> Column:
    """Rows of the cell from ``lo`` to ``hi`` after this row's time, as a difference of two running counts: Spark goes through the whole
    of a frame with two moving ends for each row, but only once through the cell for a frame with one."""
    return so_far(cell, hi, flag) - so_far(cell, lo - 1, flag)


def running_count(df: DataFrame, key: str, ts: str, tie: str, flag: str, out: str, blocks: int | None = None) -> DataFrame:
    """Running number of rows with ``flag``, per key in (ts, tie) order.

    Prefix sums over blocks of equal size of the sorted order, so that a key's burst in one instant is many blocks.
    """
    return running_counts(df.withColumn(out, F.coalesce(F.col(flag), F.lit(False))), [key], [ts, tie], [out], blocks)


def window_count(df: DataFrame, key: str, ts: str, seconds: int = 15, out: str = "requests_in_window",
                 cells_of: int = 20) -> DataFrame:
    """Rows of the key in ``(ts - seconds, ts]``.

    A cell spans ``cells_of`` windows. Rows of a cell's last window are sent to the next cell too,
    where they are counted but not returned: about one row in ``cells_of`` travels twice.
    """
    span = seconds * cells_of
    micros = df.withColumn("_us", epoch_micros(F.col(ts)))
    own = _cell(F.col("_us"), span)
    spill = _cell(F.col("_us") + F.lit(seconds * 1_000_000 - 1), span)
    placed = micros.select("*", own.alias("_own"), F.explode(F.array_distinct(F.array(own, spill))).alias("_cell"))
    w = W.partitionBy(key, "_cell").orderBy("_us")
    return (placed.withColumn(out, between(w, 1 - seconds * 1_000_000, 0))
            .filter(F.col("_cell") == F.col("_own")).drop("_us", "_own", "_cell"))
