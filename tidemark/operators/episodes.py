"""State machines over keys, with a task for each episode instead of each key.

What a state machine does to a row mostly doesn't depend on how its key got there: a request in a quiet window is accepted, a server that has
answered for hours has the shortest timeout. Such rows are *calm*: their verdict is a window expression over a bounded stretch of time, and
they never leave the JVM. A row that isn't calm needs the state before it, which is known again after a calm row. So a
key's rows that aren't calm fall into *episodes*, each of which begins in a known state and is folded on its own.

1. Timelines are cut into cells of time (``in_cells``); rows near an edge are copied to the next cell, so every window lies in a cell.
2. A cell is summed up in one row: how it begins and ends, and the last episode that begins in it. A window over a key's cells
   carries from cell to cell whether the row before was calm and which episode goes on (``episodes``).
3. Rows that aren't calm are sorted by key, episode and time and folded as a stream (``fold_sorted``): memory is one state and one batch. An
   episode is one task; it ends when the client or server lets off, and its length is what the state machine truly remembers.

No job runs while the query is built.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


class Fold:
    """A state machine of one key. ``columns`` are the input columns it reads."""

    columns: Sequence[str] = ()
    schema: T.StructType = T.StructType()

    def start(self, cols: dict[str, np.ndarray], i: int):
        """State before the episode's first row ``i``."""
        raise NotImplementedError

    def run(self, cols: dict[str, np.ndarray], lo: int, hi: int, state, out: dict[str, np.ndarray]):
        """Consume rows ``lo..hi`` of one episode, fill ``out`` there, return the state after them."""
        raise NotImplementedError

    def outputs(self, n: int) -> dict[str, np.ndarray]:
        dtypes = {"boolean": bool, "int": np.int32, "bigint": np.int64, "double": np.float64}
        return {f.name: np.zeros(n, dtypes.get(f.dataType.simpleString(), object)) for f in self.schema}


class _Folded:
    """Folds rows sorted by key; a picklable callable for ``mapInPandas``."""

    def __init__(self, fold: Fold, keys: Sequence[str]):
        self.fold, self.keys = fold, list(keys)

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = state = None
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            cols = {c: pdf[c].to_numpy() for c in {*self.keys, *self.fold.columns}}
            out, new = self.fold.outputs(n), np.ones(n, bool)
            new[1:] = False
            for k in self.keys:
                code = pd.factorize(cols[k], use_na_sentinel=True)[0]
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new).tolist()
            for lo, hi in zip(starts, [*starts[1:], n]):
                key = tuple(None if pd.isna(cols[k][lo]) else cols[k][lo] for k in self.keys)
                if key != last:
                    last, state = key, self.fold.start(cols, lo)
                state = self.fold.run(cols, lo, hi, state, out)
            for name, values in out.items():
                pdf[name] = values
            yield pdf


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, partitions: int | None = None) -> DataFrame:
    """Rows with the outputs of ``fold``, run over each key's rows in order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(n, *keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(_Folded(fold, keys), T.StructType([*df.schema.fields, *fold.schema.fields]))


def in_cells(df: DataFrame, us: str, span: int, back: int, ahead: int = 0) -> DataFrame:
    """Rows by ``_cell`` of ``span`` microseconds, each also in the cells that look ``back`` or ``ahead`` as far as it.

    ``_own`` tells a row from its copies.
    """
    cell = lambda t: F.floor(t / F.lit(span)).cast("bigint")
    cells = F.array_distinct(F.array(cell(F.col(us)), cell(F.col(us) + back), cell(F.col(us) - ahead)))
    return df.withColumn("_cell", F.explode(cells)).withColumn("_own", F.col("_cell") == cell(F.col(us)))


def episodes(rows: DataFrame, keys: Sequence[str], us: str, tie: str, calm: str, gap: int | None = None) -> DataFrame:
    """The rows that aren't ``calm``, with ``_episode`` and ``after_calm`` (the row before was calm).

    ``rows`` are the own rows of all cells. An episode begins after a calm row, with the key's first row, or after a pause of ``gap``.
    """
    keys = list(keys)
    inside = W.partitionBy(*keys, "_cell").orderBy(us, tie)

    def begins(is_calm: Column, now: Column, calm_before: Column, before: Column) -> Column:
        paused = (now - before >= gap) if gap else F.lit(False)
        return ~is_calm & (before.isNull() | F.coalesce(calm_before, F.lit(False)) | F.coalesce(paused, F.lit(False)))

    lagged = rows.withColumn("_calm1", F.lag(calm).over(inside)).withColumn("_us1", F.lag(us).over(inside)) \
        .withColumn("_first", F.col("_us1").isNull())
    at = F.struct(us, tie)
    within = F.when(~F.col("_first") & begins(F.col(calm), F.col(us), F.col("_calm1"), F.col("_us1")), F.col(us))
    cells = lagged.groupBy(*keys, "_cell").agg(
        F.max_by(calm, at).alias("_last_calm"), F.max(us).alias("_last_us"), F.min_by(calm, at).alias("_first_calm"),
        F.min(us).alias("_first_us"), F.max(within).alias("_within"))
    along = W.partitionBy(*keys).orderBy("_cell")
    cells = cells.withColumn("_calm0", F.lag("_last_calm").over(along)).withColumn("_us0", F.lag("_last_us").over(along))
    opens = begins(F.col("_first_calm"), F.col("_first_us"), F.col("_calm0"), F.col("_us0"))
    newest = F.coalesce("_within", F.when(opens, F.col("_first_us")))
    carried = F.last(newest, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    info = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_c"), "_calm0", "_us0", carried.alias("_carried"))
    same = F.col("_cell") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    open_rows = lagged.filter(~F.col(calm)).join(info, same)
    calm_before = F.when(F.col("_first"), F.col("_calm0")).otherwise(F.col("_calm1"))
    before = F.when(F.col("_first"), F.col("_us0")).otherwise(F.col("_us1"))
    start = F.when(begins(F.col(calm), F.col(us), calm_before, before), F.col(us))
    own = F.last(start, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return open_rows.select("*", F.coalesce(own, F.col("_carried")).alias("_episode"), F.coalesce(calm_before, F.lit(False)).alias("after_calm")) \
        .drop("_calm1", "_us1", "_first", "_c", "_calm0", "_us0", "_carried", *[f"_k{i}" for i in range(len(keys))])
