"""The scan cycle over landed probe results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark import schemas
from tidemark.functions import time as tm
from tidemark.functions.text import is_valid_public_ip
from tidemark.operators import aggregates as ag
from tidemark.operators import filters as fl
from tidemark.operators import joins as jn
from tidemark.operators import state
from tidemark.plans import ingest
from tidemark.sources.readers import CORRUPT
from tidemark.sources.tables import Store


def read_probe_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Landed probe results; a line that isn't JSON is a row with nothing but its text in ``_corrupt_record``."""
    schema = T.StructType([*schemas.PROBE.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
            .option("maxFilesPerTrigger", max_files).json(path))


def stamp(batch: DataFrame, ts: Column | None = None) -> DataFrame:
    """One time for all rows of a cycle; rows that landed with their cycle's time keep it."""
    return batch if ts is None else batch.withColumn("snapshot_ts", ts)


@dataclass
class Cycle:
    """What one micro-batch does. Batch n reads state of batches before n and writes its own
    folders, so running it again after a failure gives the same tables.

    ``first_batch`` shifts batch ids when a query starts over with an empty stream checkpoint:
    pass the number of batches already stored. Lines that can't be read go to ``rejected_probes``, and the cycle's counts
    to ``cycle_metrics``; ``added`` are servers that were asked without being in ``listing(ip, port)``, if that is given. Old log rows go every ``expire_every`` batches. ``one_time`` gives all rows of a batch its newest time.
    """

    store: Store
    ranges: DataFrame | None = None
    publish_path: str | None = None
    first_batch: int = 0
    compact_every: int = 48
    one_time: bool = False
    expire_every: int = 12
    log_days: int = 30
    listing: DataFrame | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        at = F.lit(batch.agg(F.max("snapshot_ts")).first()[0]).cast("timestamp_ntz") if self.one_time else None
        batch = stamp(batch, at).persist()
        n = self.first_batch + batch_id
        try:
            if CORRUPT in batch.columns:
                self.store.append(batch.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("raw")), "rejected_probes", n)
                whole = batch.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
            else:
                whole = batch
            self._store(whole, n, batch)
        finally:
            batch.unpersist()

    def _store(self, batch: DataFrame, n: int, landed: DataFrame) -> None:
        if batch.isEmpty():
            return
        probes = batch.filter(is_valid_public_ip(F.col("ip")))
        ingest.record_snapshots(self.store, batch.select(
            tm.snapshot_id(F.col("snapshot_ts")).alias("guid"), F.col("snapshot_ts").alias("timestamp")), n)

        known = state.load_cooldowns(self.store.latest("server_cooldowns", before_batch=n))
        steps = state.cooldown_steps(jn.with_state(
            probes.withColumn("ts", F.col("snapshot_ts")).withColumn("tie", F.xxhash64("ok", "map_name", "player_count")),
            known)).persist()
        try:
            rows = fl.sample_rows(steps.filter(F.col("probed") & F.col("ok")))
            counts = ingest.write_samples(self.store, rows, n, self.ranges)
            newest = batch.agg(F.max("snapshot_ts")).first()[0]
            ingest.save_names(self.store, rows, n, tm.ntz(newest))
            seen = Observation("cycle")
            watched = steps.observe(seen, F.count_if(~F.col("probed")).alias("skipped"),
                                    F.count_if(F.col("probed") & F.col("ok")).alias("answered"))
            self.store.append(state.cooldown_state(watched), "server_cooldowns", n)
            rejected = F.col(CORRUPT).isNotNull() if CORRUPT in landed.columns else F.lit(False)
            listed = landed.agg(F.count_if(~rejected).alias("listed"), F.count_if(rejected).alias("rejected"),
                                F.count_if(~rejected & ~is_valid_public_ip(F.col("ip"))).alias("filtered")).first()
            asked = probes.select("ip", "port").distinct()
            added = None if self.listing is None else asked.join(self.listing.select("ip", "port"), ["ip", "port"], "left_anti").count()
            self._report({**listed.asDict(), **seen.get, "added": added, "cycle": n,
                          "parsed": counts["parsed_rows"], "written": counts["written_rows"]}, n)
        finally:
            steps.unpersist()
        if self.compact_every and (n + 1) % self.compact_every == 0:
            self.store.compact_all()
        if self.expire_every and (n + 1) % self.expire_every == 0:
            expire(self.store, self.log_days)
        if self.publish_path:
            ingest.publish_default(self.store, self.publish_path)

    def _report(self, counts: dict, n: int) -> None:
        names = schemas.CYCLE_METRICS.fieldNames()
        self.store.append(self.store.spark.createDataFrame([tuple(counts[c] for c in names)], schemas.CYCLE_METRICS), "cycle_metrics", n)


def run_cycle(stream: DataFrame, cycle: Cycle, checkpoint: str, available_now: bool = False,
              every: str = "300 seconds") -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def stream_rollup(samples: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Event-time rollup of ``samples(timestamp, server_id, map_id, players)``; use update mode.

    Rows later than ``lateness`` are left out; ``run_rollup`` takes them all.

    Watermarks need a timestamp with zone, so times are read as UTC.
    """
    return (samples.withColumn("event_time", F.col("timestamp").cast("timestamp"))
            .withWatermark("event_time", lateness)
            .groupBy(F.window("event_time", tm.BUCKET).alias("w"), "server_id", "map_id")
            .agg(F.sum(F.col("players").cast("bigint")).alias("players"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "server_id", "map_id", "players"))


def rollup_into(store: Store, first_batch: int = 0):
    """Sink that adds ``samples(timestamp, server_id, map_id, players)`` to the stored rollup, whatever their time.

    Nothing is dropped for being late: a batch appends its sums per bucket, and readers and compaction add them up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = ag.rollup_2h(batch).withColumn("bucket_date", F.col("bucket").cast("date"))
        store.append(sums, "rollup_2h", first_batch + batch_id)

    return write


def run_rollup(samples: DataFrame, store: Store, checkpoint: str, available_now: bool = False,
               every: str = "300 seconds", first_batch: int = 0) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (samples.writeStream.foreachBatch(rollup_into(store, first_batch)).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def expire(store: Store, days: int = 30, now: Column | None = None) -> None:
    """Drop logged requests older than ``days``; blocks stay."""
    store.retain("request_log", "timestamp", tm.shift_days(now if now is not None else F.localtimestamp(), -days))
