"""One cycle: samples to star schema, rollup, names, back-off, published results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import time as tm
from tidemark.operators import aggregates as ag
from tidemark.operators import filters as fl
from tidemark.operators import joins as jn
from tidemark.params import ChartParams
from tidemark.plans.chart import Chart, write_chart_json
from tidemark.plans.star import Star
from tidemark.sources.readers import parse_samples
from tidemark.sources.tables import Store


def key_id(*cols: Column) -> Column:
    """Surrogate id from the natural key: no sequence, no coordination, the same on every retry."""
    return F.xxhash64(*cols)


def check_ids(dim: DataFrame) -> None:
    """Two keys with one id would merge two servers or maps, so stop instead."""
    clash = dim.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    if not clash.isEmpty():
        raise ValueError("two natural keys share a surrogate id")


def server_rows(prepared: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Distinct endpoints first; the country is looked up for those, not for every sample."""
    if "country_code" in prepared.columns:
        dim = ag.server_dim(prepared)
    else:
        dim = prepared.select("ip", "port").distinct()
        dim = (jn.ip_country(dim, ranges) if ranges is not None
               else dim.withColumn("country_code", F.lit("N/A")))
    return dim.select(
        key_id(F.col("ip"), F.col("port")).alias("id"), "ip", "port", "country_code")


def map_rows(prepared: DataFrame) -> DataFrame:
    return prepared.select("map").filter(F.col("map").isNotNull()).distinct().select(
        key_id(F.col("map")).alias("id"), F.col("map").alias("name"))


def snap_rows(snapshots: DataFrame) -> DataFrame:
    """``snapshots(guid, timestamp)``"""
    return snapshots.filter(F.col("guid").isNotNull()).groupBy("guid").agg(
        F.min("timestamp").alias("timestamp")).select(key_id(F.col("guid")).alias("id"), "guid", "timestamp")


def fact_rows(prepared: DataFrame, snaps: DataFrame) -> DataFrame:
    """Facts of known snapshots. Server and map ids follow from the row itself: no join for them."""
    known = snaps.select("guid", F.col("id").alias("snapshot_id"), F.col("timestamp").alias("snap_ts"))
    joined = prepared.filter(F.col("map").isNotNull()).join(known, "guid")
    return joined.select(
        "snapshot_id", key_id(F.col("ip"), F.col("port")).alias("server_id"),
        key_id(F.col("map")).alias("map_id"), "players",
        tm.time_bucket(tm.BUCKET, F.col("snap_ts")).cast("date").alias("bucket_date"))


def rollup_rows(facts: DataFrame, snaps: DataFrame) -> DataFrame:
    timed = facts.join(snaps.select(F.col("id").alias("snapshot_id"), "timestamp"), "snapshot_id")
    return ag.rollup_2h(timed).withColumn("bucket_date", F.col("bucket").cast("date"))


def record_snapshots(store: Store, snapshots: DataFrame, batch_id: int) -> None:
    store.insert_ignore(snap_rows(snapshots), "snaps", batch_id)


def write_samples(store: Store, raw: DataFrame, batch_id: int, ranges: DataFrame | None = None) -> dict:
    """Raw string rows into dimensions, facts and rollup; returns the cycle's row counts.

    Every write goes to this batch's own folder: sending the batch again replaces it.
    """
    prepared, rejected = parse_samples(raw)
    prepared = prepared.persist()
    try:
        check_ids(store.insert_ignore(map_rows(prepared), "maps", batch_id))
        check_ids(store.insert_ignore(server_rows(prepared, ranges), "servers", batch_id))
        snaps = store.read("snaps")
        store.append(fact_rows(prepared, snaps), "facts", batch_id)
        written = store.read_batch("facts", batch_id)
        store.append(rollup_rows(written, snaps), "rollup_2h", batch_id)
        n_in = prepared.agg(F.count(F.lit(1))).first()[0]
        n_bad = rejected.agg(F.count(F.lit(1))).first()[0]
        n_out = written.agg(F.count(F.lit(1))).first()[0]
    finally:
        prepared.unpersist()
    return {"input_rows": n_in + n_bad, "parsed_rows": n_in, "written_rows": n_out}


def save_names(store: Store, raw: DataFrame, batch_id: int, now: Column) -> None:
    """Append names that are new or changed, of a batch the last;  ``Store.latest`` resolves them."""
    seen = raw.select("ip", tx.to_int(F.col("port")).alias("port"), "name", "timestamp").filter(
        F.col("port").isNotNull() & F.col("name").isNotNull()).groupBy("ip", "port").agg(F.max_by("name", F.struct("timestamp", "name")).alias("name"))
    changed = fl.changed_names(seen, store.latest("server_names", before_batch=batch_id))
    store.append(changed.withColumn("updated_at", now), "server_names", batch_id)


def backfill_rollup(store: Store) -> bool:
    """Rebuild the rollup from all facts if it is empty."""
    if fl.has_rows(store.read("rollup_2h")) or not fl.has_rows(store.read("facts")):
        return False
    store.append(rollup_rows(store.read("facts"), store.read("snaps")), "rollup_2h", 0)
    return True


def migrate_wide(samples: DataFrame, snapshots: DataFrame) -> dict[str, DataFrame]:
    """Legacy wide rows as dimensions and facts; snapshots come from their table, then from samples."""
    known = snapshots.select(F.col("snapshot_id").alias("guid"), "timestamp")
    missing = samples.select(F.col("snapshot_id").alias("guid"), "timestamp").join(
        known.select("guid"), "guid", "left_anti")
    snaps = snap_rows(known.unionByName(missing))
    prepared = samples.withColumnRenamed("snapshot_id", "guid")
    return {"servers": server_rows(prepared), "maps": map_rows(prepared), "snaps": snaps,
            "facts": fact_rows(prepared, snaps)}


def migrate_into(store: Store, samples: DataFrame, snapshots: DataFrame) -> None:
    parts = migrate_wide(samples, snapshots)
    for name in ("servers", "maps", "snaps"):
        store.insert_ignore(parts[name], name, 0)
    store.append(parts["facts"], "facts", 0)
    backfill_rollup(store)


def stored_star(store: Store) -> Star:
    return Star(store.read("snaps"), store.read("servers"), store.read("maps"),
                store.latest("server_names"), store.read("rollup_2h"))


def cycle_metrics(targets: DataFrame, probed: DataFrame) -> DataFrame:
    """Counts of one cycle: listed, filtered out, skipped by back-off, answered."""
    valid = tx.is_valid_public_ip(F.col("ip"))
    listed = targets.agg(F.count(F.lit(1)).alias("listed"), F.count_if(~valid).alias("filtered"))
    seen = probed.agg(F.count_if(~F.col("probed")).alias("skipped"),
                      F.count_if(F.col("probed") & F.col("ok")).alias("answered"))
    return listed.select("*", *[seen.select(c).scalar().alias(c) for c in ("skipped", "answered")])


def publish_default(store: Store, path: str, params: ChartParams | None = None) -> bool:
    """Write the default chart's results, those of the week that ends today, where a dashboard reads them."""
    chart = Chart.resolve(stored_star(store), params or ChartParams.parse({"maps_to_show": 15}))
    if chart is None:
        return False
    chart.persist()
    try:
        write_chart_json(chart, path)
    finally:
        chart.unpersist()
    return True
