"""Request statistics and the block list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import ranking as rk
from tidemark.operators import requests as rq
from tidemark.operators.joins import flag_blocked
from tidemark.params import StatsParams
from tidemark.sources.tables import Store


def _page(day: DataFrame, params: StatsParams) -> DataFrame:
    """The clients of a page, at most 100, with their requests of the day."""
    return F.broadcast(rk.seek_page(rq.requests_per_ip(day), "total_requests", "ip", params.page, params.limit))


def request_page(log: DataFrame, blocked: DataFrame, params: StatsParams) -> DataFrame:
    """One page of clients by requests of the day, each with its latest 20, threats and block mark.

    Only the clients of the page reach the joins.
    """
    day = rq.of_day(log, params.target_day())
    ips = _page(day, params)
    theirs = day.join(ips.select("ip"), "ip", "left_semi")
    recent = rq.with_threats(rq.recent_requests(theirs)).groupBy("ip").agg(
        F.array_sort(F.collect_list(F.struct(
            "position", "endpoint", "full_path", F.date_format("timestamp", "HH:mm:ss").alias("time"),
            F.col("threat_type").isNotNull().alias("is_threat"), "threat_type"))).alias("recent_requests"))
    out = ips.join(recent, "ip", "left").join(rq.threat_summary(theirs), "ip", "left")
    return flag_blocked(out, blocked).select(
        "ip", "total_requests", "recent_requests",
        F.coalesce("threat_count", F.lit(0)).alias("threat_count"),
        F.coalesce("threat_types", F.array().cast("array<string>")).alias("threat_types"), "is_blocked"
    ).orderBy(F.col("total_requests").desc(), F.col("ip").asc())


def page_endpoints(log: DataFrame, params: StatsParams) -> DataFrame:
    """(ip, endpoint, requests) of the page's clients. In rows: a client may ask for any number of
    endpoints, as an unknown path counts as one."""
    day = rq.of_day(log, params.target_day())
    return rq.requests_per_endpoint(day.join(_page(day, params).select("ip"), "ip", "left_semi"))


def request_stats(log: DataFrame, blocked: DataFrame, params: StatsParams) -> dict:
    """The statistics page: totals of the day and one page of clients, at most 100 with 20 requests
    each. ``endpoints`` stays a DataFrame, see ``page_endpoints``."""
    day = params.target_day()
    totals = rq.request_totals(rq.of_day(log, day)).first()
    rows = [r.asDict(recursive=True) for r in request_page(log, blocked, params).collect()]
    for r in rows:
        r["threat_detected"] = r["threat_count"] > 0
    return {"date": day, "total_requests": totals["total_requests"],
            "unique_ips_today": totals["unique_ips"], "page": params.page, "limit": params.limit,
            "total_pages": params.total_pages(totals["unique_ips"]), "ip_breakdown": rows,
            "endpoints": page_endpoints(log, params)}


class BlockList:
    """Blocked clients in the store; admins are never blocked."""

    def __init__(self, store: Store, admins: Iterable[str] = ()):
        self.store, self.admins = store, set(admins)

    def blocked(self) -> DataFrame:
        return self.store.read("blocked_ips")

    def block(self, ips: Iterable[str], reason: str = "Manual block", auto: bool = False) -> list[str]:
        """Block these clients; returns those that were blocked."""
        wanted = sorted({ip.strip() for ip in ips} - self.admins - {""})
        if wanted:
            rows = self.store.spark.createDataFrame([(ip,) for ip in wanted], "ip STRING").select(
                "ip", F.lit(reason).alias("reason"), F.localtimestamp().alias("blocked_at"),
                F.lit(auto).alias("auto_blocked"))
            self.store.upsert(rows, "blocked_ips")
        return wanted

    def add_auto_blocks(self, log: DataFrame) -> None:
        self.store.upsert(rq.auto_blocks(log, self.blocked(), self.admins), "blocked_ips")

    def unblock(self, ips: Iterable[str]) -> list[str]:
        """Unblock these clients; returns those that had been blocked."""
        keys = self.store.spark.createDataFrame([(ip,) for ip in sorted(set(ips))], "ip STRING")
        hit = [r.ip for r in self.blocked().join(keys, "ip", "left_semi").select("ip").collect()]
        if hit:
            self.store.delete_keys(keys, "blocked_ips")
        return sorted(hit)


def log_rows(requests: DataFrame) -> DataFrame:
    """Requests as rows of the log table."""
    return requests.withColumn("log_date", F.col("timestamp").cast("date")).select(
        *schemas.REQUEST_LOG.fieldNames())
