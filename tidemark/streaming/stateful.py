"""Keyed state machines on streams: back-off per server, admission per client.

The rules are those of ``operators.state``. A key's rows of one micro-batch are put in order in the
task; how many there are is bounded by the source's limit per trigger.

Nothing is dropped for being late: there is no watermark. A request older than the newest one its client has been judged on is *late*.
Blocks and threats, which only add up, are settled at once; what the limiter would have said at its time is left open, and the sink
decides it in a correcting batch against the stored verdicts of that time, and logs it like any other.

State lives as long as it is used: what a key leaves behind expires after a time without rows. Blocks stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.time import epoch_micros
from tidemark.operators import state as st
from tidemark.operators.windows import latest_per_key
from tidemark.schemas import flat_schema
from tidemark.sources.tables import Store


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


DAY_MS = 86_400_000


class CooldownProcessor(StatefulProcessor):
    """Back-off of a server that isn't probed any more is gone after ``ttl_ms``."""

    def __init__(self, ttl_ms: int | None = DAY_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cooldown", "timeout DOUBLE, failures INT, skip_until DOUBLE", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, "now_s", "tie")
        stored = self.state.get() if self.state.exists() else None
        current = tuple(stored) if stored is not None else (st.START_TIMEOUT, 0, 0.0)
        fold = st.CooldownFold()
        out = fold.outputs(len(pdf))
        current = fold.run({c: pdf[c].to_numpy() for c in ("now_s", "ok")}, 0, len(pdf), current, out)
        self.state.update((float(current[0]), int(current[1]), float(current[2])))
        for name, values in out.items():
            pdf[name] = values
        pdf["ip"], pdf["port"] = key
        yield pdf[COOLDOWN_OUT.fieldNames()]

    def close(self) -> None:
        pass


COOLDOWN_OUT = flat_schema("ip STRING, port INT, tie BIGINT, now_s DOUBLE, probed BOOLEAN, timeout DOUBLE, "
                           "failures INT, skip_until DOUBLE")


def cooldown_stream(probes: DataFrame, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """``probes(ip, port, ts, tie, ok)`` as a stream, each with the back-off after it."""
    keyed = probes.select("ip", "port", F.col("tie").cast("bigint").alias("tie"), "ok",
                          (epoch_micros(F.col("ts")) / F.lit(1e6)).alias("now_s"))
    return keyed.groupBy("ip", "port").transformWithStateInPandas(
        CooldownProcessor(ttl_ms), outputStructType=COOLDOWN_OUT, outputMode="Append", timeMode="ProcessingTime")


ADMISSION_OUT = flat_schema(
    "ip STRING, tie BIGINT, now_us BIGINT, endpoint STRING, full_path STRING, threat STRING, decision STRING, "
    "logged BOOLEAN, threats BIGINT, auto_blocked BOOLEAN, remaining INT, reset_s INT, retry_s INT")


class AdmissionProcessor(StatefulProcessor):
    """Of a client stays whether it is blocked, if the start list doesn't say so; its threat count, its newest time and its accepted times
    go after ``ttl_ms`` without a request."""

    def __init__(self, fold: st.AdmissionFold, ttl_ms: int | None = 30 * DAY_MS):
        self.fold, self.ttl_ms = fold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.block = handle.getValueState("block", "blocked BOOLEAN")
        self.standing = handle.getValueState("standing", "threats BIGINT, newest BIGINT", self.ttl_ms)
        self.accepted = handle.getListState("accepted", "us BIGINT", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, "now_us", "tie").astype({"command": object, "threat": object}).reset_index(drop=True)
        threats, newest = self.standing.get() if self.standing.exists() else (0, None)
        outset = bool(pdf["blocked0"].iloc[0])
        blocked = bool(self.block.get()[0]) if self.block.exists() else outset
        times = sorted(int(r[0]) for r in self.accepted.get()) if self.accepted.exists() else []
        cols = {c: pdf[c].to_numpy() for c in self.fold.columns}
        out, n = self.fold.outputs(len(pdf)), len(pdf)
        late = 0 if newest is None else int((pdf["now_us"] < newest).sum())
        threats, blocked = self.fold.run_late(cols, late, int(threats), blocked, out)
        threats, blocked, times = self.fold.run(cols, late, n, (threats, blocked, tuple(times)), out)
        self.standing.update((int(threats), max(int(pdf["now_us"].iloc[-1]), newest or 0)))
        if bool(blocked) != outset:
            self.block.update((bool(blocked),))
        else:
            self.block.clear()
        if times:
            self.accepted.put([(int(t),) for t in times])
        else:
            self.accepted.clear()
        for name, values in out.items():
            pdf[name] = values
        yield pdf[ADMISSION_OUT.fieldNames()]

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, blocked: DataFrame, admins=(), limit: int = st.MAX_REQUESTS,
                     seconds: int = st.WINDOW_SECONDS, block_at: int = st.BLOCK_AT, ttl_ms: int | None = 30 * DAY_MS) -> DataFrame:
    """Decisions on ``requests(ip, ts, tie, endpoint, full_path [, command])`` as a stream.

    ``blocked`` is the list at the start; later changes come in as rows with a ``command``. Late requests have the decision
    ``blocked`` or ``late``; ``run_admission`` decides the latter.
    """
    marks = blocked.select("ip", F.lit(True).alias("blocked0"))
    keyed = (st.admission_input(requests, admins)
             .join(marks, "ip", "left").withColumn("blocked0", F.coalesce("blocked0", F.lit(False)))
             .select("ip", F.col("tie").cast("bigint").alias("tie"), "now_us", "endpoint",
                     "full_path", "threat", "is_admin", "blocked0", "command"))
    return keyed.groupBy("ip").transformWithStateInPandas(
        AdmissionProcessor(st.AdmissionFold(limit, seconds, block_at), ttl_ms),
        outputStructType=ADMISSION_OUT, outputMode="Append", timeMode="ProcessingTime")


def rate_limit_stream(requests: DataFrame, limit: int = st.MAX_REQUESTS, seconds: int = st.WINDOW_SECONDS,
                      ttl_ms: int | None = 30 * DAY_MS) -> DataFrame:
    """The limiter alone: nobody is blocked and no path is a threat."""
    harmless = requests.withColumn("full_path", F.lit("")).withColumn("endpoint", F.lit(""))
    nobody = requests.sparkSession.createDataFrame([], "ip STRING")
    return admission_stream(harmless, nobody, (), limit, seconds, ttl_ms=ttl_ms)


def correct_late(batch: DataFrame, store: Store, n: int, limit: int, seconds: int) -> DataFrame:
    """Decisions of a batch with ``late`` ones settled by the verdicts stored for that time and those of this batch."""
    late = batch.filter("decision = 'late'")
    span = late.agg(F.min("now_us"), F.max("now_us")).first()
    if span[0] is None:
        return batch
    day = lambda us, shift: (F.timestamp_micros(F.lit(us)) + F.expr(f"INTERVAL '{shift}' DAY")).cast("date")
    back = -(-seconds // 86400)
    kept = store.read("request_verdicts", before_batch=n).filter(F.col("log_date").between(day(span[0], -back), day(span[1], 0)))
    taken = kept.filter("accepted").select("ip", "now_us").unionByName(batch.filter("decision = 'accepted'").select("ip", "now_us"))
    settled = st.decide_late(late.drop("decision", "remaining", "reset_s", "retry_s"), taken, limit, seconds)
    return batch.filter("decision IS NULL OR decision <> 'late'").unionByName(settled.select(
        *[c for c in settled.columns if c != "accepted"], F.when(F.col("accepted"), "accepted").otherwise("limited").alias("decision"),
        *[F.lit(0).alias(c) for c in ("remaining", "reset_s", "retry_s")]))


def store_decisions(store: Store, first_batch: int = 0, limit: int = st.MAX_REQUESTS, seconds: int = st.WINDOW_SECONDS):
    """Sink of an admission stream: logged requests and their verdicts, late ones too, and new blocks."""

    def write(batch: DataFrame, batch_id: int) -> None:
        n = first_batch + batch_id
        batch = batch.persist()
        try:
            at = F.timestamp_micros("now_us").cast("timestamp_ntz")
            logged = correct_late(batch, store, n, limit, seconds).filter("logged").withColumn("log_date", at.cast("date")).persist()
            store.append(logged.select(F.col("tie").alias("id"), at.alias("timestamp"), "ip", "endpoint", "full_path", "log_date"), "request_log", n)
            store.append(logged.select(F.col("tie").alias("id"), "ip", "now_us", (F.col("decision") == "accepted").alias("accepted"), "log_date"),
                         "request_verdicts", n)
            logged.unpersist()
            changes = latest_per_key(
                batch.filter(F.col("auto_blocked") | F.col("decision").isin("block", "unblock")),
                ["ip"], "now_us", "tie").persist()
            why = F.concat(F.lit("Auto-blocked: "), "threat", F.lit(" (detected "),
                           F.col("threats").cast("string"), F.lit(" threats)"))
            blocks = changes.filter("decision <> 'unblock'").select(
                "ip", F.when(F.col("auto_blocked"), why).otherwise("Manual block").alias("reason"),
                at.alias("blocked_at"), "auto_blocked")
            gone = changes.filter("decision = 'unblock'").select("ip")
            if not blocks.isEmpty():
                store.upsert(blocks, "blocked_ips")
            if not gone.isEmpty():
                store.delete_keys(gone, "blocked_ips")
            changes.unpersist()
        finally:
            batch.unpersist()

    return write


def run_admission(decisions: DataFrame, store: Store, checkpoint: str, available_now: bool = False, every: str = "10 seconds",
                  first_batch: int = 0, limit: int = st.MAX_REQUESTS, seconds: int = st.WINDOW_SECONDS) -> StreamingQuery:
    """Starts an admission stream into the store; ``limit`` and ``seconds`` are the stream's."""
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (decisions.writeStream.foreachBatch(store_decisions(store, first_batch, limit, seconds)).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())
