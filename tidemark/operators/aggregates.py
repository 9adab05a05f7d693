"""Aggregations. Each combines on the map side, so a hot bucket, map or server costs no more
than one partial row per task and group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.functions.numeric import round_even
from tidemark.operators.joins import aligned_ratio, spine, with_denominator

# Sums of averages are ranked. As decimals they do not depend on the order in which tasks finish.
AVG_TYPE = "decimal(28,6)"
CONTRIBUTION_TYPE = "decimal(28,10)"


def rollup_2h(samples: DataFrame, width: str = tm.BUCKET) -> DataFrame:
    """``samples(timestamp, server_id, map_id, players)`` summed per bucket, server and map."""
    return (samples
            .select(tm.time_bucket(width, F.col("timestamp")).alias("bucket"),
                    "server_id", "map_id", F.col("players").cast("bigint").alias("players"))
            .groupBy("bucket", "server_id", "map_id")
            .agg(F.sum("players").alias("players")))


def merge_rollup(*parts: DataFrame) -> DataFrame:
    """Rollups of disjoint sets of samples added up; equal to the rollup of their union."""
    cols = ["bucket", "server_id", "map_id", "players"]
    total = parts[0].select(*cols)
    for part in parts[1:]:
        total = total.unionByName(part.select(*cols))
    return total.groupBy("bucket", "server_id", "map_id").agg(F.sum("players").alias("players"))


def snapshots_per_bucket(snaps: DataFrame, start, end, width: str = tm.BUCKET) -> DataFrame:
    """Distinct snapshots per bucket, whatever maps or servers answered."""
    return (snaps.filter(tm.in_window(F.col("timestamp"), start, end))
            .select(tm.time_bucket(width, F.col("timestamp")).alias("bucket"), "guid")
            .filter(F.col("bucket").isNotNull())
            .groupBy("bucket").agg(F.countDistinct("guid").alias("snapshots")))


def players_per(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy("bucket", *keys).agg(F.sum("players").alias("players"))


def avg_players(agg: DataFrame, per_bucket: DataFrame, precision: int = 2) -> DataFrame:
    """Players per snapshot, rounded before anything is derived from it."""
    avg = F.col("players").cast("double") / F.col("snapshots")
    return with_denominator(agg, per_bucket).withColumn(
        "avg_players", round_even(avg, precision).cast(AVG_TYPE))


def map_share(avg: DataFrame) -> DataFrame:
    """Percent of the bucket's total."""
    totals = avg.groupBy("bucket").agg(F.sum("avg_players").alias("total"))
    total = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("total").cast("double"))
    return (avg.join(totals, "bucket")
            .withColumn("share", F.col("avg_players").cast("double") / total * 100)
            .drop("total"))


def contribution(avg: DataFrame, key: str = "map") -> DataFrame:
    """Sum, not mean, of bucket averages: what rankings are made of."""
    return avg.groupBy(key).agg(F.sum("avg_players").alias("contribution"))


def grand_total(contrib: DataFrame) -> Column:
    """Sum over all keys, as a scalar subquery: one value, no single-partition window."""
    return contrib.agg(F.sum("contribution").alias("total")).scalar()


def server_contribution(agg: DataFrame, per_bucket: DataFrame) -> DataFrame:
    value = F.col("players").cast("double") / F.col("snapshots")
    return with_denominator(agg, per_bucket).withColumn("avg_contrib", value.cast(CONTRIBUTION_TYPE))


def valid_buckets(per_bucket: DataFrame) -> DataFrame:
    """One row: grid buckets with snapshots, at least 1."""
    return per_bucket.agg(
        F.greatest(F.count_if(F.col("snapshots") > 0), F.lit(1)).alias("valid_buckets"))


def server_average(contrib: DataFrame, per_bucket: DataFrame, key: str = "server") -> DataFrame:
    """Sum over buckets, and that divided by the buckets that had snapshots: gaps do not count.

    Rank by ``total``: it is exact, so neither order nor residual depends on how tasks finish.
    """
    return (contrib.groupBy(key).agg(F.sum("avg_contrib").alias("total"))
            .withColumn("average", F.col("total").cast("double") / valid_buckets(per_bucket).scalar()))


def daily_totals(agg: DataFrame, per_bucket: DataFrame, start, end, precision: int = 2) -> DataFrame:
    """Players per snapshot on the grid; empty buckets are 0, and so are those without snapshots."""
    sums = agg.groupBy("bucket").agg(F.sum("players").alias("players"))
    ratio = aligned_ratio(sums, per_bucket, "bucket", "players", "snapshots")
    grid = spine(agg.sparkSession, start, end)
    return grid.join(ratio, "bucket", "left").select(
        "bucket", round_even(F.coalesce("ratio", F.lit(0.0)), precision).alias("avg_total"))


def snapshot_counts(per_bucket: DataFrame, start, end) -> DataFrame:
    return spine(per_bucket.sparkSession, start, end).join(per_bucket, "bucket", "left").select(
        "bucket", F.coalesce("snapshots", F.lit(0)).cast("bigint").alias("snapshots"))


def freshness(snaps: DataFrame) -> DataFrame:
    return snaps.agg(tm.format_ts(F.max("timestamp"), tm.SNAPSHOT_FORMAT).alias("latest_scan"))


def date_range(snaps: DataFrame) -> DataFrame:
    return snaps.agg(tm.format_ts(F.min("timestamp"), "yyyy-MM-dd").alias("min_date"),
                     tm.format_ts(F.max("timestamp"), "yyyy-MM-dd").alias("max_date"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_dims(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def server_dim(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("ip", "port").agg(F.max("country_code").alias("country_code"))


def region_counts(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("region").agg(F.count(F.lit(1)).alias("servers"))


def count_rows(df: DataFrame, keys: Sequence[str], alias: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))
