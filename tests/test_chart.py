"""Charts with values worked out by hand, on both the raw and the rollup path."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.aggregates import merge_rollup, rollup_2h
from tidemark.params import ChartParams
from tidemark.plans.chart import Chart, chart_document, write_chart_json
from tidemark.plans.star import Star

T0 = datetime(2024, 1, 1)
SERVERS = "id BIGINT, ip STRING, port INT, country_code STRING"


def make_star(spark, snaps, rows, servers, maps, stored=False, names=()):
    """``snaps``: times; ``rows``: (snapshot index, server id, map id, players)."""
    snaps_df = spark.createDataFrame(
        [(i, f"g{i}", t) for i, t in enumerate(snaps)], "id BIGINT, guid STRING, timestamp TIMESTAMP_NTZ")
    samples = spark.createDataFrame(
        [(snaps[i], s, m, p) for i, s, m, p in rows],
        "timestamp TIMESTAMP_NTZ, server_id BIGINT, map_id BIGINT, players INT")
    servers_df = spark.createDataFrame(servers, SERVERS)
    maps_df = spark.createDataFrame(list(enumerate(maps)), "id BIGINT, name STRING")
    names_df = spark.createDataFrame(list(names), "ip STRING, port INT, name STRING")
    if stored:
        return Star(snaps_df, servers_df, maps_df, names_df, rollup_2h(samples))
    return Star.from_samples(samples, snaps_df, servers_df, maps_df, names_df)


ONE = [(0, "10.0.0.1", 27015, "N/A")]
BOTH = pytest.mark.parametrize("stored", [False, True])


@BOTH
def test_spike_does_not_beat_consistency(spark, stored):
    snaps = [T0 + timedelta(hours=2 * i) for i in range(30 * 12)]
    rows = [(i, 0, 0, 10) for i in range(len(snaps))] + [(15 * 12 + i, 0, 1, 100) for i in range(12)]
    star = make_star(spark, snaps, rows, ONE, ["consistent_map", "spike_map"], stored)
    doc = chart_document(star, ChartParams(start_date="2024-01-01", days_to_show=30))
    assert doc["ranking"] == [{"label": "consistent_map", "pop": 75.0}, {"label": "spike_map", "pop": 25.0}]
    at = doc["labels"].index("2024-01-16T00:00:00")
    share = {d["label"]: d["data"][at] for d in doc["datasets"]}
    assert share["consistent_map"] == pytest.approx(100 / 11)
    assert share["spike_map"] == pytest.approx(1000 / 11)
    assert doc["shownMapsCount"] == 2 and doc["appendedMapsCount"] == 0


@BOTH
def test_gaps_do_not_lower_the_server_average(spark, stored):
    snaps = [T0 + timedelta(days=d, hours=2 * i) for d in (0, 2, 4, 6, 8) for i in range(12)]
    star = make_star(spark, snaps, [(i, 0, 0, 10) for i in range(len(snaps))], ONE, ["m"], stored)
    doc = chart_document(star, ChartParams(start_date="2024-01-01", days_to_show=10))
    assert doc["serverRanking"] == [{"id": "10.0.0.1:27015", "label": "10.0.0.1:27015", "pop": 10.0}]
    assert sum(n > 0 for n in doc["snapshotCounts"]) == 60 and len(doc["labels"]) == 120
    (series,) = doc["datasets"]
    assert sorted(set(series["data"])) == [0.0, 100.0] and series["data"].count(0.0) == 60


@BOTH
def test_buckets_weigh_the_same_however_many_snapshots(spark, stored):
    snaps = ([T0 + timedelta(minutes=5 * i) for i in range(100)]
             + [T0 + timedelta(days=1, minutes=30 * i) for i in range(10)])
    star = make_star(spark, snaps, [(i, 0, 0, 10) for i in range(len(snaps))], ONE, ["m"], stored)
    chart = Chart(star, "2024-01-01", "2024-01-03")
    per_bucket = {r.bucket: r.snapshots for r in chart.per_bucket.collect()}
    assert sum(1 for n in per_bucket.values() if n > 0) == 5 + 3
    first = chart.server_ranking().first()
    assert (first.id, first.pop) == ("10.0.0.1:27015", 10.0)


def random_workload(seed, days=4):
    rng = random.Random(seed)
    snaps = [T0 + timedelta(minutes=30 * i) for i in range(days * 48)]
    activity = [rng.uniform(0.1, 0.9) for _ in range(15)]
    rows = [(i, s, rng.randrange(15), rng.randrange(0, 32)) for i in range(len(snaps)) for s in range(15)
            if rng.random() < activity[s]]
    servers = [(s, f"192.168.0.{s + 1}", 27015, "N/A") for s in range(15)]
    return snaps, rows, servers, [f"map_{m}" for m in range(15)]


def test_rollup_and_raw_path_agree_and_shares_add_up(spark):
    work = random_workload(7)
    frames = []
    for stored in (False, True):
        star = make_star(spark, *work, stored=stored)
        chart = Chart(star, "2024-01-02", "2024-01-04", ChartParams(maps_to_show=5, top_servers=4))
        frames.append({name: sorted(map(tuple, df.collect()), key=repr) for name, df in chart.frames().items()})
    assert frames[0] == frames[1]
    star = make_star(spark, *work)
    total = Chart(star, "2024-01-02", "2024-01-04", ChartParams(maps_to_show=5)).map_series().groupBy("bucket").agg(
        F.sum("share").alias("s")).collect()
    assert len(total) == 24 and all(r.s == pytest.approx(100) for r in total)


def test_merged_batches_equal_backfill(spark):
    snaps, rows, *_ = random_workload(3, days=2)
    schema = "timestamp TIMESTAMP_NTZ, server_id BIGINT, map_id BIGINT, players INT"
    df = lambda part: spark.createDataFrame([(snaps[i], s, m, p) for i, s, m, p in part], schema)
    key = lambda d: sorted(map(tuple, d.select("bucket", "server_id", "map_id", "players").collect()))
    cut = len(rows) // 3
    merged = merge_rollup(rollup_2h(df(rows[:cut])), rollup_2h(df(rows[cut:])))
    assert key(merged) == key(rollup_2h(df(rows)))


def test_filters_labels_and_residuals(spark):
    snaps = [T0]
    servers = [(s, f"10.0.0.{s}", 27015, "N/A") for s in range(13)]
    rows = [(0, s, s % 3, 13 - s) for s in range(13)]
    star = make_star(spark, snaps, rows, servers, ["Ctf_a", "pl_b", "koth_c"], names=[("10.0.0.0", 27015, "Zero")])
    doc = chart_document(star, ChartParams(start_date="2024-01-01", days_to_show=1, maps_to_show=1,
                                           append_maps_containing=("KOTH",), top_servers=2))
    # Maps: 13+10+7+4+1 = 35, 12+9+6+3 = 30, 11+8+5+2 = 26.
    assert [d["label"] for d in doc["datasets"]] == ["Ctf_a", "koth_c", "Other"]
    assert [r["pop"] for r in doc["ranking"]] == [38.46, 28.57, 32.97]
    assert doc["serverRanking"] == [{"id": "10.0.0.0:27015", "label": "Zero", "pop": 13.0},
                                    {"id": "10.0.0.1:27015", "label": "10.0.0.1:27015", "pop": 12.0},
                                    {"id": "Other", "label": "Other", "pop": 66.0}]
    assert [r["label"] for r in doc["globalServerRanking"]][-1] == "Other" and len(doc["globalServerRanking"]) == 11
    only = chart_document(star, ChartParams(start_date="2024-01-01", days_to_show=1, only_maps_containing=("ctf",)))
    assert [d["label"] for d in only["datasets"]] == ["Ctf_a"] and only["dailyTotals"][0] == 35.0
    one = chart_document(star, ChartParams(start_date="2024-01-01", days_to_show=1, server_filter="10.0.0.3:27015"))
    assert one["dailyTotals"][0] == 10.0
    named = chart_document(star, ChartParams(start_date="2024-01-01", days_to_show=1, only_servers_containing=("zer",)))
    assert named["dailyTotals"][0] == 13.0
    none = chart_document(star, ChartParams(start_date="2024-01-01", days_to_show=1, only_maps_containing=("nope",)))
    assert none["labels"] == [] and none["ranking"] == []


def test_players_without_snapshot_count_as_zero_in_totals(spark):
    star = make_star(spark, [T0], [(0, 0, 0, 8)], ONE, ["m"])
    orphan = spark.createDataFrame([(T0 + timedelta(hours=4), 0, 0, 9)],
                                   "bucket TIMESTAMP_NTZ, server_id BIGINT, map_id BIGINT, players BIGINT")
    star = Star(star.snaps, star.servers, star.maps, star.names, star.rollup.unionByName(orphan))
    totals = {r.bucket: r.avg_total for r in Chart(star, "2024-01-01", "2024-01-02").daily_totals().collect()}
    assert totals[T0] == 8.0 and totals[T0 + timedelta(hours=4)] == 0.0


def test_document_is_written_per_section(spark, tmp_path):
    star = make_star(spark, [T0], [(0, 0, 0, 8)], ONE, ["m"])
    write_chart_json(Chart(star, "2024-01-01", "2024-01-02"), str(tmp_path / "doc"))
    sections = {r.section for r in spark.read.text(str(tmp_path / "doc")).select("section").distinct().collect()}
    assert sections == {"datasets", "totals", "ranking", "totalPlayersServerDatasets", "serverRanking",
                        "globalServerRanking"}
