"""Unreadable input is kept as it landed; a cycle counts what it did; late pages are found without sorting the earlier ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking as rk
from tidemark.queries import QUERIES
from tidemark.sources import readers as rd
from tidemark.streaming.cycle import Cycle, read_probe_stream, run_cycle
from test_streaming import probe


def test_a_list_that_is_cut_off_is_a_reject(spark, tmp_path):
    doc = json.dumps({"response": {"servers": [{"addr": "8.8.8.8:27015", "appid": 440, "gamedir": "tf"}]}}, indent=1)
    for name, text in (("a", doc), ("b", doc[:40]), ("c", "<html>503</html>"), ("d", '{"response": {}}')):
        (tmp_path / f"{name}.json").write_text(text)
    servers, rejects = rd.read_server_lists(spark, str(tmp_path))
    assert [(r.ip, r.port) for r in servers.collect()] == [("8.8.8.8", 27015)]
    assert {(r.file[-6:], r.raw) for r in rejects.collect()} == {("b.json", doc[:40]), ("c.json", "<html>503</html>")}


def test_a_line_with_surplus_fields_keeps_its_text(spark, tmp_path):
    lines = ["8.8.8.8,27015,ctf,5,2024-01-01-00:00:00,N,g", "8.8.8.8,27015,ctf,5,2024-01-01-00:00:00,N,g,more,fields", "8.8.8.8,27015,ctf"]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    rows, rejects = rd.read_sample_lines(spark, str(tmp_path / "s.csv"))
    assert [r.raw for r in rejects.collect()] == [lines[1]]
    assert sorted((r.ip, r.map, r.players) for r in rows.collect() if r.players) == [("8.8.8.8", "ctf", "5")]
    assert rows.count() == 2


def test_cycle_counts_and_rejects(spark, store, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    rows = [probe(0, "10.0.0.1", True), probe(0, "10.0.0.2", False), probe(0, "127.0.0.1", True)]
    (inbox / "0.json").write_text("\n".join(map(json.dumps, rows)) + '\n{"ip": "10.0')
    (inbox / "1.json").write_text("\n".join(map(json.dumps, [probe(0.5, "10.0.0.2", True), probe(1, "10.0.0.1", True)])))
    listing = spark.createDataFrame([("10.0.0.1", 27015)], "ip STRING, port INT")
    run_cycle(read_probe_stream(spark, str(inbox), max_files=1), Cycle(store, listing=listing), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert [r.raw for r in store.read("rejected_probes").collect()] == ['{"ip": "10.0']
    got = {r.cycle: r.asDict() for r in store.read("cycle_metrics").collect()}
    names = ("listed", "filtered", "added", "skipped", "answered", "parsed", "written", "rejected")
    assert tuple(got[0][c] for c in names) == (3, 1, 1, 0, 1, 1, 1, 1)
    assert tuple(got[1][c] for c in names) == (2, 0, 1, 1, 1, 1, 1, 0)


@pytest.mark.parametrize("limit", [1, 7, 10])
def test_every_page_equals_sorting_everything(spark, limit):
    rng = random.Random(limit)
    rows = [(f"10.{i % 3}.{i % 7}.{i}", rng.choice([1, 1, 1, 1, 2, 3, rng.randrange(50)])) for i in range(120)]
    df = spark.createDataFrame(rows, "ip STRING, total BIGINT").persist()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for page in (1, 2, 120 // limit // 2, 120 // limit, 120 // limit + 1, 500):
        got = rk.seek_page(df, "total", "ip", page, limit).orderBy(F.col("total").desc(), "ip").collect()
        assert [tuple(r) for r in got] == want[(page - 1) * limit:page * limit]
    df.unpersist()


def test_a_late_page_is_not_an_offset(spark):
    text = QUERIES["request_late_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" not in text and "Limit" not in text and "Sort" not in text
