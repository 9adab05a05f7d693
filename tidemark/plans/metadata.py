"""Freshness, coverage, recent servers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import is_valid_public_ip
from tidemark.operators import sets


def status(snaps: DataFrame) -> DataFrame:
    """One row: latest scan, first and last date, whether there is no data."""
    return snaps.agg(
        F.date_format(F.max("timestamp"), "yyyy-MM-dd-HH:mm:ss").alias("latest_scan"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("max_date"),
        (F.count(F.lit(1)) == 0).alias("empty"))


def recent_servers(facts: DataFrame, snaps: DataFrame, servers: DataFrame, since: Column) -> DataFrame:
    """Endpoints with a sample since a time. Distinct ids first, endpoints after."""
    recent = snaps.filter(F.col("timestamp") >= since).select(F.col("id").alias("snapshot_id"))
    if "bucket_date" in facts.columns:
        facts = facts.filter(F.col("bucket_date") >= since.cast("date"))
    ids = facts.join(recent, "snapshot_id", "left_semi").select("server_id").distinct()
    return servers.join(ids, servers["id"] == ids["server_id"], "left_semi").select("ip", "port")


def scan_targets(listed: DataFrame, recent: DataFrame) -> DataFrame:
    """What the next cycle probes: listed servers and recent ones, with a usable address."""
    return sets.scan_targets(listed, recent).filter(is_valid_public_ip(F.col("ip")))
