"""The star schema a chart reads, wherever its tables come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.time import BUCKET, in_window, time_bucket
from tidemark.operators import filters as fl
from tidemark.params import ChartParams


@dataclass(frozen=True)
class Star:
    """``rollup`` is the stored two-hour rollup, or samples with their bucket (``from_samples``): all
    that reads it adds players up, so it need not be aggregated."""

    snaps: DataFrame       # id, guid, timestamp
    servers: DataFrame     # id, ip, port, country_code
    maps: DataFrame        # id, name
    names: DataFrame       # ip, port, name, updated_at
    rollup: DataFrame      # bucket, server_id, map_id, players [, bucket_date]
    window: tuple | None = None  # the window ``rollup`` is already restricted to

    @classmethod
    def from_samples(cls, samples: DataFrame, snaps: DataFrame, servers: DataFrame, maps: DataFrame,
                     names: DataFrame, window: tuple | None = None) -> "Star":
        """The raw path. A window is applied to the samples' own time, where it prunes the scan."""
        if window is not None:
            samples = samples.filter(in_window(F.col("timestamp"), *window))
        cells = samples.select(
            time_bucket(BUCKET, F.col("timestamp")).alias("bucket"), "server_id", "map_id",
            F.col("players").cast("bigint").alias("players")
        ).filter(F.col("bucket").isNotNull())  # stated once, so that all users share one exchange
        return cls(snaps, servers, maps, names, cells, window)

    def cells(self, start, end, params: ChartParams | None = None) -> DataFrame:
        """Rollup rows of the window that pass the map and server filters.

        Filters select dimension rows; the rollup only meets their ids (semi-joins), and names are
        joined after aggregation.
        """
        cells = self.rollup
        if self.window != (start, end):
            cells = cells.filter(in_window(F.col("bucket"), start, end))
        if "bucket_date" in cells.columns:
            cells = cells.filter(F.col("bucket_date").between(
                F.lit(str(start)[:10]).cast("date"), F.lit(str(end)[:10]).cast("date")))
        if params is None:
            return cells
        match = tx.name_matches(F.col("name"), params.only_maps_containing)
        if match is not None:
            cells = cells.join(self.maps.filter(match).select(F.col("id").alias("map_id")),
                               "map_id", "left_semi")
        chosen = fl.server_filter(self.servers, params.server_filter)
        chosen = fl.server_name_matches(chosen, self.names, params.only_servers_containing)
        if chosen is not self.servers:
            cells = cells.join(chosen.select(F.col("id").alias("server_id")), "server_id", "left_semi")
        return cells

    def name_maps(self, agg: DataFrame) -> DataFrame:
        return agg.join(self.maps.select(F.col("id").alias("map_id"), F.col("name").alias("map")), "map_id")

    def name_servers(self, agg: DataFrame) -> DataFrame:
        ids = self.servers.select(F.col("id").alias("server_id"),
                                  tx.endpoint(F.col("ip"), F.col("port")).alias("server"))
        return agg.join(ids, "server_id")
