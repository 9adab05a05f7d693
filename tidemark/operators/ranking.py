"""Top-N, paging and the residual that stands for everything else.

``orderBy(...).limit(n)`` keeps n rows per task and merges them (TakeOrderedAndProject); n is a
clamped parameter, so a top list may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.numeric import round_even
from tidemark.functions.text import name_matches

OTHER = "Other"


def top_n(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(value).desc(), F.col(tie).asc()).limit(n)


def top_maps(contrib: DataFrame, n: int) -> DataFrame:
    return top_n(contrib, "contribution", "map", n)


def top_servers(averages: DataFrame, n: int) -> DataFrame:
    return top_n(averages, "total", "server", n)


def appended_maps(contrib: DataFrame, tokens: Sequence[str] | None, top: DataFrame) -> DataFrame:
    """Maps that match and are not among the top ones."""
    match = name_matches(F.col("map"), tokens)
    if match is None:
        return contrib.limit(0)
    return contrib.filter(match).join(F.broadcast(top.select("map")), "map", "left_anti")


def label_others(df: DataFrame, key: str, shown: DataFrame) -> DataFrame:
    """Adds ``label`` and ``kind``: those of ``shown(key, kind)``, ``Other`` for the rest."""
    return (df.join(shown.select(key, "kind"), key, "left")
            .withColumn("label", F.when(F.col("kind").isNotNull(), F.col(key)).otherwise(OTHER))
            .withColumn("kind", F.coalesce("kind", F.lit("other"))))


def with_other(ranked: DataFrame, key: str, value: str, n: int, divisor: Column | None = None,
               digits: int = 2) -> DataFrame:
    """Top ``n`` rows, then one residual row if it is positive: (id, pop, position, kind).

    ``pop`` is the value over ``divisor``; values are added up before they are divided.
    """
    top = top_n(ranked, value, key, n).withColumn("kind", F.lit("top"))
    labelled = label_others(ranked, key, F.broadcast(top))
    summed = (labelled.groupBy("label", "kind").agg(F.sum(value).alias("total"))
              .filter((F.col("kind") == "top") | (F.col("total") > 0)))
    pop = F.col("total").cast("double")
    # At most n + 1 rows are left here.
    order = W.orderBy((F.col("kind") == "other").asc(), F.col("total").desc(), F.col("label").asc())
    return summed.select(
        F.col("label").alias("id"), round_even(pop if divisor is None else pop / divisor, digits).alias("pop"),
        F.row_number().over(order).alias("position"), "kind")


def page(df: DataFrame, order: Sequence[Column], page_no: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset((page_no - 1) * limit).limit(limit)


def latest(df: DataFrame, ts: str, tie: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def seek_page(totals: DataFrame, value: str, key: str, page_no: int, limit: int, prefix: int = 6) -> DataFrame:
    """Page ``page_no`` of rows by ``value`` descending, then ``key``, without sorting the pages before it.

    A histogram of the values tells which of them the page holds, and one of the key's first characters, for those values
    only, where in a long tie it lies. At most ``limit`` stretches of either kind touch a page, so both go to all tasks. Only the rows of
    those stretches are sorted, each on its own.
    """
    first, last = (page_no - 1) * limit, page_no * limit

    def touching(counts: DataFrame, order: W, names: Sequence[str], base: Column) -> DataFrame:
        before = base + F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("_before", before)
        return placed.filter((F.col("_before") < last) & (F.col("_before") + F.col("_n") > first)).select(*names, "_before")

    values = touching(totals.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), W.orderBy(F.col(value).desc()), [value], F.lit(0))
    head = F.substring(key, 1, prefix)
    near = totals.join(F.broadcast(values), value).groupBy(value, head.alias("_head"), "_before").agg(F.count(F.lit(1)).alias("_n"))
    stretches = touching(near, W.partitionBy(value).orderBy("_head"), [value, "_head"], F.col("_before"))
    rows = totals.withColumn("_head", head).join(F.broadcast(stretches), [value, "_head"])
    place = F.col("_before") + F.row_number().over(W.partitionBy(value, "_head").orderBy(key))
    return rows.withColumn("_place", place).filter((F.col("_place") > first) & (F.col("_place") <= last)).select(*totals.columns)
