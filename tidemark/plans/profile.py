"""The same aggregate in two forms, for timing: rows first, or aggregation in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.operators import aggregates as ag
from tidemark.operators import filters as fl
from tidemark.operators import joins as jn


def profile_fetch(facts: DataFrame, snaps: DataFrame, servers: DataFrame, maps: DataFrame,
                  start, end) -> DataFrame:
    """Wide rows of the window, cleaned, then summed per bucket and map."""
    wide = jn.wide_fetch(facts, snaps.filter(tm.in_window(F.col("timestamp"), start, end)), servers, maps)
    return (fl.normalize(wide).select(tm.bucket_floor(F.col("timestamp")).alias("bucket"), "map", "players")
            .groupBy("bucket", "map").agg(F.sum("players").alias("players")))


def profile_sql(facts: DataFrame, snaps: DataFrame, maps: DataFrame, start, end) -> DataFrame:
    """Summed per bucket and map id, map names joined to the result."""
    timed = facts.join(snaps.filter(tm.in_window(F.col("timestamp"), start, end)).select(
        F.col("id").alias("snapshot_id"), "timestamp"), "snapshot_id")
    cells = timed.select(tm.time_bucket(tm.BUCKET, F.col("timestamp")).alias("bucket"), "map_id", "players")
    summed = ag.players_per(cells, "map_id")
    names = maps.select(F.col("id").alias("map_id"), F.col("name").alias("map"))
    return summed.join(names, "map_id").select("bucket", "map", "players")
