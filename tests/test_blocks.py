"""Work along a sorted order in equal blocks: running counts and the as-of join, with one key or prefix that holds nearly all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks as bl
from tidemark.operators import joins as jn
from tidemark.operators import windows as wn
from tidemark.queries import QUERIES

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("blocks", [1, 5, 16])
def test_a_burst_inside_a_second_is_many_blocks(spark, blocks):
    rng = random.Random(blocks)
    rows = [(i, "hot" if rng.random() < 0.8 else f"c{rng.randrange(4)}", T0 + timedelta(microseconds=rng.randrange(3)), rng.random() < 0.3)
            for i in range(4000)] + [(9000, None, T0, True), (9001, None, None, None), (9002, "hot", None, True)]
    df = spark.createDataFrame(rows, "id BIGINT, ip STRING, ts TIMESTAMP_NTZ, f BOOLEAN").repartition(4)
    done = wn.running_count(df, "ip", "ts", "id", "f", "n", blocks)
    seen, want = {}, {}
    for i, ip, t, f in sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[0])):
        seen[ip] = seen.get(ip, 0) + bool(f)
        want[i] = seen[ip]
    assert {r.id: r.n for r in done.collect()} == want
    placed = bl.sorted_blocks(df, ["ip", "ts", "id"], blocks)
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 3 * len(rows) / blocks


def test_running_counts_of_no_rows_and_of_several_flags(spark):
    schema = "k STRING, o BIGINT, a BOOLEAN, b BOOLEAN"
    assert bl.running_counts(spark.createDataFrame([], schema), ["k"], ["o"], ["a", "b"]).count() == 0
    df = spark.createDataFrame([("x", i, i % 2 == 0, i % 3 == 0) for i in range(20)], schema)
    got = bl.running_counts(df, ["k"], ["o"], ["a", "b"], 6).orderBy("o").collect()
    assert [(r.a, r.b) for r in got] == [(i // 2 + 1, i // 3 + 1) for i in range(20)]


def test_one_scan_and_one_cut(spark):
    df = QUERIES["threat_running_count"](spark, "/root/testdata/sf0.001")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().executedPlan().toString()
    assert final.count("Exchange rangepartitioning") == 1 or "ReusedExchange" in final
    assert final.count("FileScan parquet [event_id") == 1 and final.count("RLIKE") <= 11


def address(n):
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


@pytest.mark.parametrize("blocks", [1, 7])
def test_all_addresses_and_many_ranges_in_one_prefix(spark, blocks):
    rng = random.Random(3)
    base = 10 << 24
    starts = sorted(rng.sample(range(1 << 16), 2000))
    ranges = [(address(base + a), address(base + min(a + rng.randrange(20), (b or 1 << 16) - 1)), f"C{a}")
              for a, b in zip(starts, [*starts[1:], None])]
    points = [(i, address(base + (77 if i % 3 == 0 else rng.randrange(1 << 16)))) for i in range(3000)] + [(9000, None), (9001, "x"), (9002, "255.0.0.1")]
    df = spark.createDataFrame(points, "id BIGINT, ip STRING")
    got = jn.ip_country(df, spark.createDataFrame(ranges, "lo STRING, hi STRING, country STRING"), blocks=blocks)
    numbered = [(tuple(map(int, lo.split("."))), tuple(map(int, hi.split("."))), c) for lo, hi, c in ranges]

    def country(ip):
        try:
            n = tuple(map(int, ip.split(".")))
        except (AttributeError, ValueError):
            return "N/A"
        return next((c for lo, hi, c in numbered if lo <= n <= hi), "N/A")

    assert got.columns == ["id", "ip", "country_code"]
    assert {r.id: r.country_code for r in got.collect()} == {i: country(ip) for i, ip in points}


def test_no_ranges_and_no_group_by_prefix(spark):
    df = spark.createDataFrame([(i, "10.0.0.1") for i in range(50)], "id BIGINT, ip STRING")
    none = jn.ip_country(df, spark.createDataFrame([], "lo STRING, hi STRING, country STRING"), blocks=3)
    assert {r.country_code for r in none.collect()} == {"N/A"} and none.count() == 50
    text = QUERIES["ip_country"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(n" in text and "hashpartitioning" not in text


def test_rows_and_marks_of_different_cuts_are_an_error(spark):
    df = spark.createDataFrame([("x", i, True) for i in range(50)], "k STRING, o BIGINT, f BOOLEAN")
    other = df.withColumn("o", F.col("o") + 1)
    cut = lambda d, marks: bl.block_rows(bl.sorted_blocks(d, ["k", "o"], 4), ["k", "o"], bl.RunningCounts(["k"], ["f"], marks),
                                         bl.T.StructType([*([d.schema["k"]] if marks else d.schema.fields), bl.T.StructField("_n0", bl.T.LongType())]))
    with pytest.raises(Exception, match="different cuts"):
        bl.with_marks(cut(df, False), cut(other, True).select("_block", "_sign")).collect()


def test_blocks_behind_another_branch_of_a_union(spark):
    """The rows run in the union's stage, where their blocks aren't numbered from 0."""
    df = spark.createDataFrame([("x", i, True) for i in range(50)], "k STRING, o BIGINT, f BOOLEAN")
    more = df.withColumn("f", F.lit(0).cast("long")).repartition(3)
    got = more.union(bl.running_counts(df, ["k"], ["o"], ["f"], 4).select("k", "o", "f")).collect()
    assert sorted(r.f for r in got) == [0] * 50 + list(range(1, 51))
