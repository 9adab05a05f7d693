"""Tables, ingest and readers on a temporary store."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import time as tm
from tidemark.params import ChartParams, StatsParams
from tidemark.plans import discovery, ingest, metadata
from tidemark.plans.chart import Chart, chart_document
from tidemark.plans.requests import BlockList, log_rows, request_stats
from tidemark.sources import readers as rd
from tidemark.sources.tables import insert_ignored, upserted
from tidemark.streaming.cycle import expire

T0 = datetime(2024, 1, 1)
RAW = "ip STRING, port STRING, map STRING, players STRING, timestamp STRING, name STRING, guid STRING"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def sample(ip, map_, players, minute, port="27015", name=""):
    t = T0 + timedelta(minutes=minute)
    return (ip, port, map_, players, t.strftime("%Y-%m-%d-%H:%M:%S"), name, t.strftime("%Y%m%d%H%M%S"))


def snapshots(spark, *minutes):
    times = [T0 + timedelta(minutes=m) for m in minutes]
    return spark.createDataFrame([(t.strftime("%Y%m%d%H%M%S"), t) for t in times], "guid STRING, timestamp TIMESTAMP_NTZ")


def rollup_of(store):
    maps = store.read("maps").select(F.col("id").alias("map_id"), "name")
    rows = store.read("rollup_2h").groupBy("bucket", "server_id", "map_id").agg(F.sum("players").alias("p"))
    return sorted((r.bucket, r.name, r.p) for r in rows.join(maps, "map_id").collect())


BATCH1 = [sample("10.0.0.1", "ctf", "5", 0, name="One"), sample("10.0.0.2", "pl", "7", 0),
          sample("10.0.0.2", "pl", "x", 0), sample("10.0.0.3", "pl", None, 5, port=None)]
BATCH2 = [sample("10.0.0.1", "ctf", "6", 10, name="Zwei"), sample("10.0.0.1", "ctf", "1", 125, name="Uno"),
          sample("10.0.0.9", "new", "2", 999)]


def load(store, spark):
    ingest.record_snapshots(store, snapshots(spark, 0, 5), 0)
    first = ingest.write_samples(store, raw(spark, BATCH1), 0)
    ingest.save_names(store, raw(spark, BATCH1), 0, tm.ntz(T0))
    ingest.record_snapshots(store, snapshots(spark, 0, 10, 125), 1)
    second = ingest.write_samples(store, raw(spark, BATCH2), 1)
    ingest.save_names(store, raw(spark, BATCH2), 1, tm.ntz(T0 + timedelta(hours=1)))
    return first, second


WANT = [(T0, "ctf", 11), (T0, "pl", 0), (T0, "pl", 7), (T0 + timedelta(hours=2), "ctf", 1)]


def test_ingest_in_batches_and_again(spark, store):
    first, second = load(store, spark)
    assert first == {"input_rows": 4, "parsed_rows": 3, "written_rows": 3}
    # The last sample has no snapshot and is not stored.
    assert second == {"input_rows": 3, "parsed_rows": 3, "written_rows": 2}
    assert rollup_of(store) == WANT
    assert store.read("snaps").count() == 4
    assert {(r.ip, r.port) for r in store.read("servers").collect()} == {
        ("10.0.0.1", 27015), ("10.0.0.2", 27015), ("10.0.0.3", 0), ("10.0.0.9", 27015)}
    assert {r.ip: r.name for r in store.latest("server_names").collect()} == {"10.0.0.1": "Uno"}
    # A batch that is sent again replaces itself.
    ingest.write_samples(store, raw(spark, BATCH2), 1)
    ingest.save_names(store, raw(spark, BATCH2), 1, tm.ntz(T0 + timedelta(hours=1)))
    assert rollup_of(store) == WANT and store.read("facts").count() == 5
    assert store.latest("server_names").count() == 1


def test_compaction_keeps_content_and_the_newest_batch(spark, store):
    load(store, spark)
    before = {t: sorted(map(tuple, store.read(t).collect()), key=repr) for t in ("facts", "maps", "servers", "snaps")}
    store.compact_all()
    assert {t: sorted(map(tuple, store.read(t).collect()), key=repr) for t in before} == before
    assert rollup_of(store) == WANT
    ingest.write_samples(store, raw(spark, BATCH2), 1)
    assert rollup_of(store) == WANT and store.read("facts").count() == 5
    store.compact_all()
    store.compact_all()
    assert {n for _, n in store._folders("facts")} == {0, 1} and rollup_of(store) == WANT


def test_compaction_reads_only_parts_with_several_folders(spark, store, tmp_path):
    rows = [(T0 + timedelta(days=d), 1, 1, 2, (T0 + timedelta(days=d)).date()) for d in (0, 1, 2)]
    frame = lambda *days: spark.createDataFrame([rows[d] for d in days], schemas.ROLLUP)
    for n, days in enumerate(((0, 1), (0,), (2,), (2,))):
        store.append(frame(*days), "rollup_2h", n)
    files = lambda day: {str(p) for p in (tmp_path / "tables").rglob("*.parquet") if str(day.date()) in str(p)}
    alone, newest = files(T0 + timedelta(days=1)), files(T0 + timedelta(days=2))
    store.compact("rollup_2h")
    assert files(T0 + timedelta(days=1)) == alone and files(T0 + timedelta(days=2)) == newest
    assert {(part[-2:], n) for part, n in store._folders("rollup_2h")} == {("01", -1), ("02", 0), ("03", 2), ("03", 3)}
    total = store.read("rollup_2h").groupBy("bucket").agg(F.sum("players").alias("n"))
    assert sorted(map(tuple, total.collect())) == [(rows[0][0], 4), (rows[1][0], 2), (rows[2][0], 4)]


def test_rollup_backfill_equals_incremental(spark, store):
    load(store, spark)
    assert not ingest.backfill_rollup(store)
    rebuilt = ingest.rollup_rows(store.read("facts"), store.read("snaps"))
    stored = store.read("rollup_2h").groupBy("bucket", "server_id", "map_id").agg(F.sum("players").alias("players"))
    key = lambda df: sorted(map(tuple, df.select("bucket", "server_id", "map_id", "players").collect()))
    assert key(rebuilt) == key(stored)


def test_chart_from_the_store(spark, store):
    load(store, spark)
    doc = chart_document(ingest.stored_star(store), ChartParams(start_date="2024-01-01", days_to_show=1))
    assert doc["snapshotCounts"][:2] == [3, 1] and doc["dailyTotals"][:2] == [6.0, 1.0]
    assert doc["serverRanking"][0] == {"id": "10.0.0.1:27015", "label": "Uno", "pop": pytest.approx((11 / 3 + 1) / 2, abs=0.005)}
    plan = Chart(ingest.stored_star(store), "2024-01-01", "2024-01-02").map_players()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket_date" in plan
    assert ingest.publish_default(store, store.root + "/published")
    facts, snaps = store.read("facts"), store.read("snaps")
    recent = metadata.recent_servers(facts, snaps, store.read("servers"), tm.ntz("2024-01-01 01:00:00"))
    assert [tuple(r) for r in recent.collect()] == [("10.0.0.1", 27015)]


def test_migration_of_wide_rows(spark, store):
    wide = spark.createDataFrame(
        [("10.0.0.1", 1, "a", 3, T0, "DE", "s1"), ("10.0.0.1", 1, "b", 4, T0 + timedelta(hours=3), "FR", "s2"),
         ("10.0.0.2", 1, "a", 5, T0, "N/A", "s1")],
        "ip STRING, port INT, map STRING, players INT, timestamp TIMESTAMP_NTZ, country_code STRING, snapshot_id STRING")
    known = spark.createDataFrame([("s1", T0), ("s0", T0 - timedelta(hours=9))], "snapshot_id STRING, timestamp TIMESTAMP_NTZ")
    ingest.migrate_into(store, wide, known)
    assert {r.guid for r in store.read("snaps").collect()} == {"s0", "s1", "s2"}
    assert {(r.ip, r.country_code) for r in store.read("servers").collect()} == {("10.0.0.1", "FR"), ("10.0.0.2", "N/A")}
    assert rollup_of(store) == [(T0, "a", 3), (T0, "a", 5), (T0 + timedelta(hours=2), "b", 4)]


def test_readers(spark, store, tmp_path):
    for region, servers in {"eu": [{"addr": "10.0.0.1:27015", "appid": 440, "gamedir": "tf"},
                                   {"addr": "10.0.0.1:27015", "appid": 440},
                                   {"addr": "127.0.0.1:1", "appid": 440}, {"addr": "10.0.0.2:x", "appid": 440}],
                            "us": [{"addr": "10.0.0.3:1", "appid": 10, "gamedir": "TF"}, {"addr": "10.0.0.4:1", "appid": 10},
                                   {"addr": "0.0.0.0:0", "appid": 440}, {"addr": "noport", "appid": 440}]}.items():
        folder = tmp_path / "lists" / f"region={region}"
        folder.mkdir(parents=True)
        (folder / "list.json").write_text(json.dumps({"response": {"servers": servers}}, indent=1))
    found, counts = discovery.discover(spark, str(tmp_path / "lists"))
    assert sorted(map(tuple, found.collect())) == [("10.0.0.1", 27015), ("10.0.0.3", 1)]
    assert {r.region: r.servers for r in counts.collect()} == {"eu": 2, "us": 1}
    assert rd.union_regions(found, found).count() == 2
    assert {(r.name, r.code) for r in discovery.region_table(spark).collect()} >= {("as", 4), ("as", 6), ("rest", 255)}

    (tmp_path / "old.csv").write_text("10.0.0.1,27015,ctf,3,2024-01-01-00:00:00,A,s\n10.0.0.1,bad,ctf,3,2024-01-01-00:00:00,A,s\n")
    good, bad = rd.parse_samples(rd.read_samples_csv(spark, str(tmp_path / "old.csv")))
    assert good.first().players == 3 and bad.count() == 1


def test_request_log_statistics_and_blocks(spark, store):
    rows = [(i, T0 + timedelta(minutes=i), f"10.0.0.{i % 12}", "index" if i % 2 else "data", "/.env" if i % 12 == 1 else "/")
            for i in range(600)]
    log = spark.createDataFrame(rows, "id BIGINT, timestamp TIMESTAMP_NTZ, ip STRING, endpoint STRING, full_path STRING")
    old = log.withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 40 DAYS"))
    store.append(log_rows(log), "request_log", 1)
    store.append(log_rows(old), "request_log", 0)
    blocks = BlockList(store, admins=["10.0.0.5"])
    assert blocks.block(["10.0.0.2", "10.0.0.5", " "]) == ["10.0.0.2"]
    blocks.add_auto_blocks(store.read("request_log"))
    assert {(r.ip, r.auto_blocked) for r in blocks.blocked().collect()} == {("10.0.0.2", False), ("10.0.0.1", True)}
    stats = request_stats(store.read("request_log"), blocks.blocked(), StatsParams.parse({"page": 0, "limit": 5, "day": "2024-01-01"}))
    assert (stats["total_requests"], stats["unique_ips_today"], stats["page"], stats["limit"], stats["total_pages"]) == (600, 12, 1, 10, 2)
    assert [r["ip"] for r in stats["ip_breakdown"]] == sorted(f"10.0.0.{i}" for i in range(12))[:10]
    by_ip = {r["ip"]: r for r in stats["ip_breakdown"]}
    assert by_ip["10.0.0.1"]["threat_count"] == 50 and by_ip["10.0.0.1"]["threat_types"] == ["VULN_SCAN"]
    assert by_ip["10.0.0.1"]["is_blocked"] and by_ip["10.0.0.1"]["threat_detected"]
    assert [tuple(r) for r in stats["endpoints"].filter("ip = '10.0.0.1'").collect()] == [("10.0.0.1", "index", 50)]
    assert [r["time"] for r in by_ip["10.0.0.0"]["recent_requests"]][0] == "09:48:00" and len(by_ip["10.0.0.0"]["recent_requests"]) == 20
    assert blocks.unblock(["10.0.0.2", "10.0.0.7"]) == ["10.0.0.2"] and blocks.blocked().count() == 1
    empty = request_stats(store.read("request_log"), blocks.blocked(), StatsParams(day="2020-01-01"))
    assert empty["total_pages"] == 1 and empty["ip_breakdown"] == []
    expire(store, 30, tm.ntz("2024-01-10"))
    assert store.read("request_log").count() == 600 and blocks.blocked().count() == 1


def test_ids_that_clash_are_refused(spark):
    with pytest.raises(ValueError):
        ingest.check_ids(spark.createDataFrame([(1, "a"), (1, "b")], "id BIGINT, name STRING"))


def test_repeated_keys_in_one_batch(spark, store):
    stored = spark.createDataFrame([("a", 1)], "guid STRING, v INT")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 4, 2), ("b", 5, 1)], "guid STRING, v INT, pos INT")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(insert_ignored(stored, new, ["guid"], "pos")) == [("a", 1), ("b", 5)]
    assert rows(upserted(stored, new, ["guid"], "pos")) == [("a", 3), ("b", 4)]
    twice = spark.createDataFrame([("1.2.3.4", "x", T0, False), ("1.2.3.4", "y", T0 + timedelta(hours=1), False)],
                                  schemas.BLOCKED_IPS)
    store.upsert(twice, "blocked_ips", "blocked_at")
    assert [r.reason for r in store.read("blocked_ips").collect()] == ["y"]


def test_a_rewrite_touches_only_the_parts_of_its_keys(spark, store, tmp_path):
    rows = lambda ips, why: spark.createDataFrame([(i, why, T0, False) for i in ips], schemas.BLOCKED_IPS)
    files = lambda: {str(p) for p in (tmp_path / "tables").rglob("*.parquet")}
    every = [f"1.2.3.{k}" for k in range(40)]
    store.upsert(rows(every, "x"), "blocked_ips")
    before = files()
    store.upsert(rows(["1.2.3.4", None], "y"), "blocked_ips")
    assert len(before & files()) >= len(before) - 2
    assert {(r.ip, r.reason) for r in store.read("blocked_ips").collect()} == {(i, "y" if i in ("1.2.3.4", None) else "x") for i in [*every, None]}
    before = files()
    store.delete_keys(rows(["1.2.3.5", "9.9.9.9"], "z"), "blocked_ips")
    assert len(before & files()) >= len(before) - 2 and store.read("blocked_ips").count() == 40
    # The last row of a part takes its folder with it; a table may become empty and be filled again.
    store.delete_keys(rows(every, "z"), "blocked_ips")
    assert [r.ip for r in store.read("blocked_ips").collect()] == [None] and len(store._folders("blocked_ips")) == 1
    store.upsert(rows([], "y"), "blocked_ips")
    store.delete_keys(rows([], "y"), "blocked_ips")
    assert store.read("blocked_ips").count() == 1
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([], schemas.REQUEST_LOG), "request_log")


def test_a_batch_sent_again_with_fewer_rows_replaces_all_its_folders(spark, store):
    day = lambda d: (T0 + timedelta(days=d), 1, 1, 2, (T0 + timedelta(days=d)).date())
    undated = (T0, 2, 2, 2, None)
    store.append(spark.createDataFrame([day(0), day(1), undated], schemas.ROLLUP), "rollup_2h", 3)
    store.append(spark.createDataFrame([day(5)], schemas.ROLLUP), "rollup_2h", 2)
    store.append(spark.createDataFrame([day(1), undated], schemas.ROLLUP), "rollup_2h", 3)
    assert sorted((r.bucket, r.bucket_date) for r in store.read("rollup_2h").filter("bucket_date IS NOT NULL").collect()) == [
        (day(d)[0], day(d)[4]) for d in (1, 5)]
    assert store.read("rollup_2h").filter("bucket_date IS NULL").count() == 1
    store.append(spark.createDataFrame([], schemas.ROLLUP), "rollup_2h", 3)
    assert store.read("rollup_2h").count() == 1


def test_retention_leaves_the_files_of_kept_days_alone(spark, store, tmp_path):
    times = [datetime(2024, 1, d, h) for d in (1, 2, 3, 4) for h in (12, 20)]
    rows = [(k, t, "1.2.3.4", "e", "/", t.date()) for k, t in enumerate(times)]
    frame = lambda part: spark.createDataFrame(part, schemas.REQUEST_LOG)
    store.append(frame(rows[:3]), "request_log", 0)  # of the cutoff's day only a row that goes
    store.append(frame(rows[3:]), "request_log", 1)
    files = lambda: {str(p) for p in (tmp_path / "tables").rglob("*.parquet")}
    kept = {f for f in files() if "2024-01-03" in f or "2024-01-04" in f}
    cutoff = tm.ntz(datetime(2024, 1, 2, 18))
    store.retain("request_log", "timestamp", cutoff)
    assert kept < files() and not any("2024-01-01" in f for f in files())
    assert ("2024-01-02", 0) not in store._folders("request_log") and ("2024-01-02", 1) in store._folders("request_log")
    assert sorted(r.id for r in store.read("request_log").collect()) == [3, 4, 5, 6, 7]
    store.compact("request_log")
    assert sorted(r.id for r in store.read("request_log").collect()) == [3, 4, 5, 6, 7]
    # Rows that come later are there, however old, until retention runs again.
    store.append(frame(rows[:1]), "request_log", 2)
    assert store.read("request_log").count() == 6
    store.retain("request_log", "timestamp", cutoff)
    assert store.read("request_log").count() == 5
    store.append(frame(rows[3:]), "request_log", 1)
    assert store.read("request_log").count() == 5
