"""The chart query: shares, totals and rankings of maps and servers over a window.

Everything is derived from two aggregates of the window's rollup cells, per (bucket, map) and per
(bucket, server); facts are touched once. Results stay in long form until they are written.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import nan_to_zero, round_even
from tidemark.functions.time import BUCKET_SECONDS, iso_label
from tidemark.operators import aggregates as ag
from tidemark.operators import joins as jn
from tidemark.operators import ranking as rk
from tidemark.params import ChartParams, resolve_window
from tidemark.plans.star import Star

GLOBAL_TOP = 10


class Chart:
    """One window and one set of filters over a star; each method is one result."""

    def __init__(self, star: Star, start, end, params: ChartParams | None = None):
        self.star, self.start, self.end = star, start, end
        self.params = params or ChartParams()
        self.per_bucket = ag.snapshots_per_bucket(star.snaps, start, end)
        self.cells = star.cells(start, end, self.params)
        self._map_avg = self._server_contrib = None

    @classmethod
    def resolve(cls, star: Star, params: ChartParams) -> "Chart | None":
        """With the window the parameters ask for; nothing if there are no snapshots."""
        newest = star.snaps.agg(F.max("timestamp")).first()[0]
        window = resolve_window(newest, params.start_date, params.days_to_show)
        return cls(star, *window, params) if window else None

    # -- aggregates everything else is derived from --------------------------------------------
    def map_players(self) -> DataFrame:
        return ag.players_per(self.cells, "map_id")

    def map_avg(self) -> DataFrame:
        """(bucket, map, players, snapshots, avg_players)"""
        if self._map_avg is None:
            named = self.star.name_maps(self.map_players()).drop("map_id")
            self._map_avg = ag.avg_players(named, self.per_bucket, self.params.precision)
        return self._map_avg

    def _contributions(self, cells: DataFrame) -> DataFrame:
        named = self.star.name_servers(ag.players_per(cells, "server_id")).drop("server_id")
        return ag.server_contribution(named, self.per_bucket)

    def server_contrib(self) -> DataFrame:
        """(bucket, server, players, snapshots, avg_contrib)"""
        if self._server_contrib is None:
            self._server_contrib = self._contributions(self.cells)
        return self._server_contrib

    def persist(self) -> "Chart":
        """Keep both aggregates for the results that share them."""
        self._map_avg, self._server_contrib = self.map_avg().persist(), self.server_contrib().persist()
        return self

    def unpersist(self) -> None:
        for df in (self._map_avg, self._server_contrib):
            if df is not None:
                df.unpersist()

    # -- maps -----------------------------------------------------------------------------------
    def map_share(self) -> DataFrame:
        return ag.map_share(self.map_avg())

    def top_maps(self) -> DataFrame:
        return rk.top_maps(ag.contribution(self.map_avg()), self.params.maps_to_show)

    def appended_maps(self) -> DataFrame:
        return rk.appended_maps(ag.contribution(self.map_avg()), self.params.append_maps_containing,
                                self.top_maps())

    def shown_maps(self) -> DataFrame:
        """(map, kind): top maps and appended ones."""
        top = self.top_maps().select("map", F.lit("top").alias("kind"))
        if not self.params.append_maps_containing:
            return F.broadcast(top)
        return top.unionByName(self.appended_maps().select("map", F.lit("appended").alias("kind")))

    def map_series(self) -> DataFrame:
        """(bucket, label, kind, share) on the grid, everything not shown as ``Other``."""
        labelled = rk.label_others(self.map_avg(), "map", self.shown_maps())
        summed = labelled.groupBy("bucket", "label", "kind").agg(F.sum("avg_players").alias("avg_players"))
        # Labels partition the maps, so their averages add up to the same total of a bucket.
        return jn.gap_fill(ag.map_share(summed), ["label", "kind"], ["share"], self.start, self.end)

    def map_ranking(self) -> DataFrame:
        """(label, pop, kind): percent of all contributions; ``Other`` only if positive."""
        contrib = ag.contribution(self.map_avg())
        labelled = rk.label_others(contrib, "map", self.shown_maps())
        summed = labelled.groupBy("label", "kind").agg(F.sum("contribution").alias("contribution"))
        total = ag.grand_total(contrib)
        pop = F.try_divide(F.col("contribution").cast("double"), total.cast("double")) * 100
        return (summed.filter((F.col("kind") != "other") | (F.col("contribution") > 0))
                .filter(total > 0)
                .select("label", round_even(pop, 2).alias("pop"), "kind"))

    # -- totals ---------------------------------------------------------------------------------
    def daily_totals(self) -> DataFrame:
        return ag.daily_totals(self.map_players(), self.per_bucket, self.start, self.end,
                               self.params.precision)

    def snapshot_counts(self) -> DataFrame:
        return ag.snapshot_counts(self.per_bucket, self.start, self.end)

    def totals(self) -> DataFrame:
        return self.daily_totals().join(self.snapshot_counts(), "bucket")

    # -- servers --------------------------------------------------------------------------------
    def server_averages(self) -> DataFrame:
        return ag.server_average(self.server_contrib(), self.per_bucket)

    def server_ranking(self) -> DataFrame:
        return self._ranked(self.server_averages(), self.params.top_servers)

    def global_server_ranking(self) -> DataFrame:
        contrib = self._contributions(self.star.cells(self.start, self.end))
        return self._ranked(ag.server_average(contrib, self.per_bucket), GLOBAL_TOP)

    def _ranked(self, averages: DataFrame, n: int) -> DataFrame:
        return rk.with_other(averages, "server", "total", n, ag.valid_buckets(self.per_bucket).scalar())

    def server_series(self) -> DataFrame:
        """(bucket, id, kind, avg) on the grid for the top servers, the others summed."""
        top = rk.top_servers(self.server_averages(), self.params.top_servers).select(
            "server", F.lit("top").alias("kind"))
        labelled = rk.label_others(self.server_contrib(), "server", F.broadcast(top))
        summed = labelled.groupBy("bucket", "label", "kind").agg(F.sum("avg_contrib").alias("avg"))
        filled = jn.gap_fill(summed, ["label", "kind"], ["avg"], self.start, self.end)
        return filled.select("bucket", F.col("label").alias("id"), "kind",
                             round_even(F.col("avg").cast("double"), self.params.precision).alias("avg"))

    def labelled(self, df: DataFrame) -> DataFrame:
        return jn.resolve_labels(df, self.star.names)

    # -- document -------------------------------------------------------------------------------
    def frames(self) -> dict[str, DataFrame]:
        return {
            "map_share": self.map_series(), "totals": self.totals(), "map_ranking": self.map_ranking(),
            "server_series": self.labelled(self.server_series()),
            "server_ranking": self.labelled(self.server_ranking()),
            "global_ranking": self.labelled(self.global_server_ranking())}


def _series(df: DataFrame, section: str, keys: list[str], value: str) -> DataFrame:
    """One row and JSON object per series: its points in bucket order, at most 4380 of them."""
    points = F.array_sort(F.collect_list(F.struct(
        "bucket", nan_to_zero(F.col(value).cast("double")).alias("v"))))
    return (df.groupBy(*keys).agg(points.alias("points"))
            .select(F.lit(section).alias("section"), F.to_json(F.struct(
                *keys, F.transform("points", lambda p: p["v"]).alias("data"))).alias("json")))


def _rows(df: DataFrame, section: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.to_json(F.struct("*")).alias("json"))


def chart_sections(chart: Chart) -> DataFrame:
    """The chart document as (section, json) rows, one per series or ranking entry."""
    f = chart.frames()
    totals = f["totals"].select(iso_label(F.col("bucket")).alias("label"), "avg_total", "snapshots")
    return (_series(f["map_share"], "datasets", ["label", "kind"], "share")
            .unionByName(_rows(totals, "totals"))
            .unionByName(_rows(f["map_ranking"], "ranking"))
            .unionByName(_series(f["server_series"], "totalPlayersServerDatasets",
                                 ["id", "label", "kind"], "avg"))
            .unionByName(_rows(f["server_ranking"], "serverRanking"))
            .unionByName(_rows(f["global_ranking"], "globalServerRanking")))


def write_chart_json(chart: Chart, path: str) -> None:
    """The document as JSON lines, one directory per section."""
    chart_sections(chart).write.mode("overwrite").partitionBy("section").text(path)


#: Buckets of two hours in a piece of a series: a week.
PIECE = 84


def document_rows(chart: Chart, piece: int = PIECE) -> DataFrame:
    """The chart document in pieces: (section, id, label, kind, part, buckets, data), at most ``piece`` points in a row.

    A series is cut on a grid of its own, so a piece holds the same buckets in every chart that has them whole. Nothing is as long as
    a series: neither a row, nor a group, nor what a reader holds.
    """
    f = chart.frames()

    def pieces(df: DataFrame, section: str, key: Column, value: str) -> DataFrame:
        part = F.floor(F.unix_seconds(F.col("bucket").cast("timestamp")) / F.lit(BUCKET_SECONDS * piece)).cast("bigint")
        points = F.array_sort(F.collect_list(F.struct("bucket", nan_to_zero(F.col(value).cast("double")).alias("v"))))
        cut = df.groupBy(key.alias("id"), "label", "kind", part.alias("part")).agg(points.alias("p"))
        return cut.select(F.lit(section).alias("section"), "id", "label", "kind", "part",
                          F.transform("p", lambda x: x["bucket"]).alias("buckets"), F.transform("p", lambda x: x["v"]).alias("data"))

    totals = f["totals"].select("bucket", F.lit("total").alias("label"), F.lit("total").alias("kind"), "avg_total", "snapshots")
    return (pieces(f["map_share"], "datasets", F.col("label"), "share")
            .unionByName(pieces(f["server_series"], "totalPlayersServerDatasets", F.col("id"), "avg"))
            .unionByName(pieces(totals, "dailyTotals", F.lit("total"), "avg_total"))
            .unionByName(pieces(totals, "snapshotCounts", F.lit("total"), "snapshots")))


def document_parts(rows: DataFrame) -> DataFrame:
    """What there is to read of each series: (section, id, label, kind, first_part, parts, points)."""
    return rows.groupBy("section", "id", "label", "kind").agg(
        F.min("part").alias("first_part"), F.count(F.lit(1)).alias("parts"), F.sum(F.size("data")).alias("points"))


def write_document(chart: Chart, path: str, piece: int = PIECE) -> None:
    """The series in pieces under ``pieces``, by section and sorted, and the list of parts under ``parts``."""
    rows = document_rows(chart, piece)
    rows.repartition("section", "id").sortWithinPartitions("section", "id", "part").write.mode("overwrite").partitionBy("section").json(f"{path}/pieces")
    spark = rows.sparkSession
    document_parts(spark.read.schema(rows.schema).json(f"{path}/pieces")).write.mode("overwrite").json(f"{path}/parts")


_EMPTY = {"labels": [], "datasets": [], "dailyTotals": [], "snapshotCounts": [], "ranking": [],
          "shownMapsCount": 0, "averageDailyPlayerCount": 0}


def chart_document(star: Star, params: ChartParams) -> dict:
    """The result of one chart request, as a dictionary: what a dashboard draws."""
    chart = Chart.resolve(star, params)
    if chart is None:
        return dict(_EMPTY)
    chart.persist()
    try:
        if chart.map_avg().isEmpty():
            return dict(_EMPTY)
        by_section: dict[str, list[dict]] = {}
        for row in chart_sections(chart).toLocalIterator():
            by_section.setdefault(row.section, []).append(json.loads(row.json))
    finally:
        chart.unpersist()
    return _assemble(by_section)


_KIND_ORDER = {"top": 0, "appended": 1, "other": 2}


def _assemble(sections: dict[str, list[dict]]) -> dict:
    ranking = sorted(sections.get("ranking", []),
                     key=lambda r: (_KIND_ORDER[r["kind"]], -r["pop"], r["label"]))
    place = {r["label"]: i for i, r in enumerate(ranking)}
    datasets = sorted(sections.get("datasets", []), key=lambda d: (
        _KIND_ORDER[d["kind"]], place.get(d["label"], len(place)), d["label"]))
    totals = sorted(sections.get("totals", []), key=lambda t: t["label"])

    def ranked(section: str) -> list[dict]:
        return sorted(sections.get(section, []), key=lambda r: r["position"])

    servers = ranked("serverRanking")
    seat = {r["id"]: r["position"] for r in servers}
    series = sorted(sections.get("totalPlayersServerDatasets", []),
                    key=lambda d: (_KIND_ORDER[d["kind"]], seat.get(d["id"], 0)))
    return {
        "labels": [t["label"] for t in totals],
        "datasets": [{"label": d["label"], "data": d["data"]} for d in datasets],
        "dailyTotals": [t["avg_total"] for t in totals],
        "snapshotCounts": [t["snapshots"] for t in totals],
        "ranking": [{"label": r["label"], "pop": r["pop"]} for r in ranking],
        "shownMapsCount": sum(d["kind"] == "top" for d in datasets),
        "totalPlayersServerDatasets": [{"label": d["label"], "data": d["data"]} for d in series],
        "serverRanking": [{"id": r["id"], "label": r["label"], "pop": r["pop"]} for r in servers],
        "globalServerRanking": [{"label": r["label"], "pop": r["pop"]} for r in ranked("globalServerRanking")],
        "appendedMapsCount": sum(d["kind"] == "appended" for d in datasets)}
