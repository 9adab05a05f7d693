"""Joins of facts, dimensions, denominators, labels and ranges.

Dimensions are stored tables: Spark knows their size and broadcasts them below its own threshold,
and AQE splits a skewed side above it. The one explicit hint is on tables with at most one row per
two-hour bucket of a window, which is clamped to 365 days (4380 rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.numeric import default_zero
from tidemark.functions.time import BUCKET_SECONDS, ntz
from tidemark.operators.blocks import last_range

ENDPOINT = ["ip", "port"]


def star_join(facts: DataFrame, snaps: DataFrame, servers: DataFrame, maps: DataFrame) -> DataFrame:
    """Facts with their three dimensions; a fact without a dimension row vanishes."""
    return (facts
            .join(snaps.select(F.col("id").alias("snapshot_id"), "guid", "timestamp"), "snapshot_id")
            .join(servers.select(F.col("id").alias("server_id"), "ip", "port", "country_code"), "server_id")
            .join(maps.select(F.col("id").alias("map_id"), F.col("name").alias("map")), "map_id"))


def wide_fetch(facts: DataFrame, snaps: DataFrame, servers: DataFrame, maps: DataFrame) -> DataFrame:
    return star_join(facts, snaps, servers, maps).select(
        "ip", "port", "map", "players", "timestamp", "country_code", F.col("guid").alias("snapshot_id"))


def join_endpoint(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    return a.join(b, ENDPOINT, how)


def merge_left(delta: DataFrame, stored: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``delta + stored`` for the keys of ``delta``; what is not stored counts as 0."""
    old = stored.select(*keys, F.col(value).alias("stored_value"))
    return (delta.join(old, list(keys), "left")
            .withColumn(value, F.col(value) + F.coalesce("stored_value", F.lit(0)))
            .drop("stored_value"))


def with_denominator(agg: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """Adds ``snapshots`` of the bucket, null and 0 counted as 1."""
    return (agg.join(per_bucket, "bucket", "left")
            .withColumn("snapshots", default_zero(F.col("snapshots"), 1).cast("bigint")))


def aligned_ratio(num: DataFrame, den: DataFrame, key: str, num_col: str, den_col: str) -> DataFrame:
    """``num / den`` on the union of keys. Where the denominator is missing or zero the ratio is 0."""
    return (num.select(key, num_col).join(den.select(key, den_col), key, "full_outer")
            .select(key, F.coalesce(
                F.try_divide(F.coalesce(num_col, F.lit(0)).cast("double"), F.col(den_col)),
                F.lit(0.0)).alias("ratio")))


def anti(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is absent from ``other``; unlike NOT IN it is not upset by nulls."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def ip_country(df: DataFrame, ranges: DataFrame, ip: str = "ip", blocks: int | None = None) -> DataFrame:
    """Country of the address range holding ``ip``, or ``N/A``.

    ``ranges(lo, hi, country)`` must not overlap. An as-of join: the last range that starts at or before the address is looked at
    for its end. Nothing is grouped by address or prefix.
    """
    starts = ranges.select(tx.ip_number(F.col("lo")).alias("n"), F.struct(tx.ip_number(F.col("hi")).alias("hi"), "country").alias("span")).filter("n IS NOT NULL")
    found = last_range(df.select(F.struct(*df.columns).alias("row"), tx.ip_number(F.col(ip)).alias("n")), starts, blocks)
    inside = F.when(F.col("n") <= F.col("span.hi"), F.col("span.country"))
    return found.select("row.*", F.coalesce(inside, F.lit("N/A")).alias("country_code"))


def resolve_labels(df: DataFrame, names: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds ``label``: the known name of an ``ip:port`` id, else the id (``Other`` stays)."""
    known = names.select(tx.endpoint(F.col("ip"), F.col("port")).alias(id_col),
                         F.col("name").alias("known_name"))
    return (df.join(known, id_col, "left")
            .withColumn("label", F.coalesce("known_name", id_col)).drop("known_name"))


def with_state(df: DataFrame, cooldowns: DataFrame) -> DataFrame:
    """Adds the stored back-off of each endpoint, with defaults for unknown ones."""
    stored = cooldowns.select("ip", "port", "timeout", "failures", "skip_until")
    return (df.join(stored, ENDPOINT, "left")
            .withColumn("timeout", F.coalesce("timeout", F.lit(2.0)))
            .withColumn("failures", F.coalesce("failures", F.lit(0)))
            .withColumn("skip_until", F.coalesce("skip_until", F.lit(0.0))))


def spine_array(start, end) -> Column:
    """All two-hour bucket starts in ``[start, end)`` as one array literal."""
    return F.sequence(ntz(start), ntz(end) - F.expr("INTERVAL '0.000001' SECOND"),
                      F.expr(f"INTERVAL '{BUCKET_SECONDS}' SECOND"))


def spine(spark, start, end) -> DataFrame:
    return spark.range(1).select(F.explode(spine_array(start, end)).alias("bucket"))


def gap_fill(df: DataFrame, keys: Sequence[str], values: Sequence[str], start, end) -> DataFrame:
    """Every series of ``keys`` on the whole two-hour grid, missing values 0.

    ``df`` has one row per series and bucket. A series is extended by a zero for each grid bucket and
    added up again: one pass and one shuffle by series, no cross join and no second look at ``df``.
    A series has at most one point per bucket of the clamped window.
    """
    types = dict(df.dtypes)
    zeros = F.transform(spine_array(start, end), lambda b: F.struct(
        b.alias("bucket"), *[F.lit(0).cast(types[v]).alias(v) for v in values]))
    series = df.groupBy(*keys).agg(F.collect_list(F.struct("bucket", *values)).alias("points"))
    return (series.select(*keys, F.inline(F.concat("points", zeros)))
            .groupBy(*keys, "bucket")
            .agg(*[F.sum(v).cast(types[v]).alias(v) for v in values]))


def flag_blocked(df: DataFrame, blocked: DataFrame) -> DataFrame:
    marks = blocked.select("ip", F.lit(True).alias("is_blocked"))
    return (df.join(marks, "ip", "left")
            .withColumn("is_blocked", F.coalesce("is_blocked", F.lit(False))))
