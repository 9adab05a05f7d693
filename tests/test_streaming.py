"""Streams over landed files give what the batch operators give."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_state import admission_df, admission_model, admission_rows, cooldown_model, probes_df, skewed_log

from tidemark.streaming.cycle import Cycle, read_probe_stream, run_cycle, stream_rollup
from tidemark.streaming.stateful import admission_stream, cooldown_stream, rate_limit_stream, run_admission

T0 = datetime(2024, 1, 1)


def land(df, folder, parts, column):
    """Files in order of ``column``, one per micro-batch."""
    rows = df.orderBy(column).collect()
    size = -(-len(rows) // parts)
    for n in range(parts):
        part = df.sparkSession.createDataFrame(rows[n * size:(n + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, name, checkpoint, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.table(name)


def probe(minute, ip, ok, players=5, map_="ctf", name="N"):
    t = T0 + timedelta(minutes=minute)
    return {"ip": ip, "port": 27015, "ok": ok, "map_name": map_ if ok else None, "player_count": players if ok else None,
            "server_name": name if ok else None, "snapshot_ts": t.isoformat()}


def test_cycle(spark, store, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    cycles = [[probe(0, "10.0.0.1", True), probe(0, "10.0.0.2", False), probe(0, "127.0.0.1", True)],
              # The second server is skipped for a minute, but asked again after five.
              [probe(5, "10.0.0.1", True, name="New"), probe(5, "10.0.0.2", False)],
              [probe(6, "10.0.0.2", True), probe(6, "10.0.0.1", False)],
              [probe(10, "10.0.0.2", True, players=3)]]
    for n, rows in enumerate(cycles):
        (inbox / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = read_probe_stream(spark, str(inbox), max_files=1)
        run_cycle(stream, Cycle(store, compact_every=3, publish_path=str(tmp_path / "doc")),
                  str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert store.read("snaps").count() == 4
    servers = store.read("servers").select(F.col("id").alias("server_id"), "ip")
    facts = store.read("facts").join(servers, "server_id")
    assert sorted((r.ip, r.players) for r in facts.collect()) == [("10.0.0.1", 5), ("10.0.0.1", 5), ("10.0.0.2", 3)]
    assert {r.ip: r.name for r in store.latest("server_names").collect()} == {"10.0.0.1": "New", "10.0.0.2": "N"}
    cooldowns = {r.ip: (round(r.timeout, 4), r.failures) for r in store.latest("server_cooldowns").collect()}
    assert cooldowns == {"10.0.0.1": (3.24, 1), "10.0.0.2": (4.5, 0)}
    assert store.read("rollup_2h").agg(F.sum("players")).first()[0] == 13
    assert "ctf" in "".join(r.value for r in spark.read.text(str(tmp_path / "doc" / "section=ranking")).collect())


def test_cooldown_stream(spark, tmp_path):
    rows = [(i, ip, t, i % 3 != 0) for i, ip, t in skewed_log(2, n=400)]
    out = run(cooldown_stream(land(probes_df(spark, rows), tmp_path / "in", 3, "ts")), "cool", tmp_path / "cp")
    want, _ = cooldown_model(rows)
    assert {r.tie: (r.probed, r.timeout, r.failures) for r in out.collect()} == want


def test_admission_stream_and_its_tables(spark, store, tmp_path):
    rows = [r[:3] + (r[3] or r[0] % 60 == 0, r[4]) for r in admission_rows(8)][:900]
    blocked = spark.createDataFrame([("10.0.0.3",)], "ip STRING")
    requests = land(admission_df(spark, rows), tmp_path / "in", 3, "ts")
    decisions = admission_stream(requests, blocked, ["10.0.0.4"], limit=4, seconds=120)
    want = admission_model(rows, 4, 120, ["10.0.0.3"], ["10.0.0.4"])
    assert {r.tie: r.decision for r in run(decisions, "admit", tmp_path / "cp").collect()} == want

    run_admission(decisions, store, str(tmp_path / "cp2"), available_now=True).awaitTermination()
    logged = {i for i, d in want.items() if d in ("accepted", "limited")}
    assert {r.id for r in store.read("request_log").collect()} == logged
    standing = {}
    for r in spark.table("admit").orderBy("now_us", "tie").collect():
        if r.auto_blocked or r.decision in ("block", "unblock"):
            standing[r.ip] = r.decision != "unblock"
    assert {r.ip for r in store.read("blocked_ips").collect()} == {ip for ip, on in standing.items() if on}
    assert any(standing.values())


def test_rate_limit_stream(spark, tmp_path):
    rows = skewed_log(4, n=300)
    df = spark.createDataFrame(rows, "tie BIGINT, ip STRING, ts TIMESTAMP_NTZ")
    out = run(rate_limit_stream(land(df, tmp_path / "in", 2, "ts"), limit=3, seconds=600), "rate", tmp_path / "cp")
    from test_state import limiter
    assert {r.tie: r.decision == "accepted" for r in out.collect()} == limiter(rows, 3, 600)


def test_event_time_rollup(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=30 * i), i % 3, i % 2, i) for i in range(200)]
    df = spark.createDataFrame(rows, "timestamp TIMESTAMP_NTZ, server_id BIGINT, map_id BIGINT, players INT")
    out = run(stream_rollup(land(df, tmp_path / "in", 4, "timestamp")), "roll", tmp_path / "cp", "update")
    newest = {}
    for r in out.collect():
        key = (r.bucket, r.server_id, r.map_id)
        newest[key] = max(r.players, newest.get(key, 0))
    from tidemark.operators.aggregates import rollup_2h
    assert newest == {(r.bucket, r.server_id, r.map_id): r.players for r in rollup_2h(df).collect()}


def test_late_rows_are_rolled_up(spark, store):
    from tidemark.streaming.cycle import rollup_into

    schema = "timestamp TIMESTAMP_NTZ, server_id BIGINT, map_id BIGINT, players BIGINT"
    write = rollup_into(store)
    write(spark.createDataFrame([(datetime(2024, 1, 5), 1, 1, 3)], schema), 0)
    write(spark.createDataFrame([(datetime(2024, 1, 3, 0, 30), 1, 1, 4), (datetime(2024, 1, 5, 1), 1, 1, 5)], schema), 1)
    got = {r.bucket: r.n for r in store.read("rollup_2h").groupBy("bucket").agg(F.sum("players").alias("n")).collect()}
    assert got == {datetime(2024, 1, 5): 8, datetime(2024, 1, 3): 4}


def late_admission(spark, store, tmp_path, batches, limit=2, seconds=60, **kw):
    """Runs batches of (id, minute, path) of one client through the stream and its sink, one file each."""
    schema = "tie BIGINT, ip STRING, ts TIMESTAMP_NTZ, endpoint STRING, full_path STRING"
    inbox, cp = tmp_path / "in", str(tmp_path / "cp")
    for rows in batches:
        df = spark.createDataFrame([(i, "10.0.0.1", T0 + timedelta(minutes=m), "e", p) for i, m, p in rows], schema)
        df.coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        out = admission_stream(stream, spark.createDataFrame([], "ip STRING"), limit=limit, seconds=seconds, **kw)
        run_admission(out, store, cp, available_now=True, limit=limit, seconds=seconds).awaitTermination()


def test_a_request_two_days_late_is_decided_and_logged(spark, store, tmp_path):
    day = 24 * 60
    late_admission(spark, store, tmp_path, [
        [(1, 0, "/"), (2, 0.5, "/"), (3, 5, "/")], [(4, 3 * day, "/")],
        # Two days and more late: one finds its window full, one finds room, one is the second of two for one place.
        [(5, 0.75, "/"), (6, 5.1, "/"), (7, 5.2, "/"), (8, 3 * day + 1, "/"), (9, day, "/.env")]])
    assert {r.id for r in store.read("request_log").collect()} == set(range(1, 10))
    verdicts = {r.id: r.accepted for r in store.read("request_verdicts").collect()}
    assert verdicts == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: False, 8: True, 9: True}
    assert store.read("request_log").filter("id = 6").first().log_date == T0.date()


def test_late_threats_block(spark, store, tmp_path):
    late_admission(spark, store, tmp_path, [[(1, 100, "/.env"), (2, 200, "/.env")], [(3, 5, "/.env"), (4, 6, "/"), (5, 300, "/")]])
    assert {r.id for r in store.read("request_log").collect()} == {1, 2}
    (block,) = store.read("blocked_ips").collect()
    assert (block.ip, block.auto_blocked, block.blocked_at) == ("10.0.0.1", True, T0 + timedelta(minutes=5))


def test_state_of_silent_clients_and_vanished_servers_expires(spark, store, tmp_path):
    import time

    schema = "tie BIGINT, ip STRING, port INT, ts TIMESTAMP_NTZ, ok BOOLEAN"
    for name, ttl, wait, failures in (("kept", 600_000, 0, [1, 2]), ("gone", 2_000, 4, [1, 1])):
        inbox, cp = tmp_path / name, tmp_path / f"cp-{name}"
        for n in range(2):
            spark.createDataFrame([(n, "10.0.0.1", 1, T0 + timedelta(minutes=60 * n), False)], schema).coalesce(1).write.mode("append").parquet(str(inbox))
            seen = []
            steps = cooldown_stream(spark.readStream.schema(schema).parquet(str(inbox)), ttl_ms=ttl)
            steps.writeStream.foreachBatch(lambda b, _: seen.extend(r.failures for r in b.collect())).outputMode("append").option(
                "checkpointLocation", str(cp)).trigger(availableNow=True).start().awaitTermination()
            assert seen == failures[n:n + 1]
            time.sleep(wait)
    # Two threats, a long silence, and a third: nobody is blocked, as the count has expired.
    for ttl, blocks in ((600_000, 1), (2_000, 0)):
        sub = tmp_path / f"adm{ttl}"
        from tidemark.sources.tables import Store

        own = Store(spark, str(sub / "tables"))
        late_admission(spark, own, sub, [[(1, 0, "/.env"), (2, 1, "/.env")]], ttl_ms=ttl)
        time.sleep(0 if blocks else 4)
        late_admission(spark, own, sub, [[(3, 90, "/.env")]], ttl_ms=ttl)
        assert own.read("blocked_ips").count() == blocks


def test_late_rows_of_no_rows(spark):
    from tidemark.operators import state

    none = spark.createDataFrame([], "tie BIGINT, ip STRING, now_us BIGINT, batch BIGINT")
    assert state.late_rows(none, "ip", "now_us", "batch").count() == 0
    assert state.decide_late(none, none).count() == 0
