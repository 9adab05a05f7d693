"""Request-log analytics: counts, threats, blocks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.threats import threat_type
from tidemark.functions.time import on_date
from tidemark.operators.state import BLOCK_AT
from tidemark.operators.windows import latest_n, running_count


def of_day(log: DataFrame, day: str) -> DataFrame:
    """One day of the log: the date partition, if there is one, and the time range."""
    if "log_date" in log.columns:
        log = log.filter(F.col("log_date") == F.lit(day).cast("date"))
    return log.filter(on_date(F.col("timestamp"), day))


def request_totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total_requests"), F.countDistinct("ip").alias("unique_ips"))


def requests_per_ip(log: DataFrame) -> DataFrame:
    return log.groupBy("ip").agg(F.count(F.lit(1)).alias("total_requests"))


def requests_per_endpoint(log: DataFrame) -> DataFrame:
    return log.groupBy("ip", "endpoint").agg(F.count(F.lit(1)).alias("requests"))


def with_threats(log: DataFrame) -> DataFrame:
    """The kind of threat, computed once a row: a filter on a generated column isn't pushed below as a copy."""
    return log.select("*", F.explode_outer(F.array(threat_type(F.col("full_path")))).alias("threat_type"))


def threat_summary(log: DataFrame) -> DataFrame:
    """Threats per client and the kinds seen, of which there are 11."""
    hits = with_threats(log).filter(F.col("threat_type").isNotNull())
    return hits.groupBy("ip").agg(
        F.count(F.lit(1)).alias("threat_count"),
        F.array_sort(F.collect_set("threat_type")).alias("threat_types"))


def running_threats(log: DataFrame, blocks: int | None = None) -> DataFrame:
    """(id, ip, timestamp, threats_so_far): each request with the client's threat count so far; the log is read once."""
    flagged = log.select("id", "ip", "timestamp", threat_type(F.col("full_path")).isNotNull().alias("is_threat"))
    return running_count(flagged, "ip", "timestamp", "id", "is_threat", "threats_so_far", blocks).drop("is_threat")


def auto_blocks(log: DataFrame, blocked: DataFrame, admins: Iterable[str] = (),
                at: int = BLOCK_AT) -> DataFrame:
    """Clients that reach ``at`` threats, at the time and with the kind of the threat that did it."""
    hits = with_threats(log).filter(
        F.col("threat_type").isNotNull() & ~tx.is_admin(F.col("ip"), admins))
    nth = _nth_threat(hits, at).join(blocked.select("ip"), "ip", "left_anti")
    reason = F.concat(F.lit("Auto-blocked: "), F.col("threat_type"),
                      F.lit(f" (detected {at} threats)"))
    return nth.select("ip", reason.alias("reason"), F.col("timestamp").alias("blocked_at"),
                      F.lit(True).alias("auto_blocked"))


def _nth_threat(hits: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("ip").orderBy("timestamp", "id")
    # "<= n" first: Spark applies it before the shuffle, n rows per client and task.
    return (hits.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n)
            .filter(F.col("_nth") == n).drop("_nth"))


def recent_requests(log: DataFrame, n: int = 20) -> DataFrame:
    return latest_n(log, ["ip"], "timestamp", "id", n)
