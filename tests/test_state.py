"""State machines against plain loops, with one key that fills most partitions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import requests as rq
from tidemark.operators import state
from tidemark.operators import windows as wn

T0 = datetime(2024, 1, 1)


def skewed_log(seed, n=3000, span=40_000):
    """(id, ip, ts): the hot client sends two thirds of all rows."""
    rng = random.Random(seed)
    times = sorted(rng.uniform(0, span) for _ in range(n))
    return [(i, "hot" if rng.random() < 0.66 else f"10.0.0.{rng.randrange(40)}",
             T0 + timedelta(microseconds=int(t * 1e6))) for i, t in enumerate(times)]


def log_df(spark, rows, path=None):
    df = spark.createDataFrame(rows, "tie BIGINT, ip STRING, ts TIMESTAMP_NTZ")
    return df if path is None else df.withColumn("full_path", path)


def limiter(rows, limit, seconds):
    seen, out = {}, {}
    for i, ip, t in sorted(rows, key=lambda r: (r[2], r[0])):
        lst = [x for x in seen.get(ip, []) if x > t - timedelta(seconds=seconds)]
        if out.setdefault(i, len(lst) < limit):
            lst.append(t)
        seen[ip] = lst
    return out


@pytest.mark.parametrize("limit,seconds", [(3, 60), (5, 600), (60, 15)])
@pytest.mark.parametrize("partitions", [1, 7])
def test_rate_limit_with_a_hot_client(spark, limit, seconds, partitions):
    rows = skewed_log(limit)
    got = {r.tie: r.accepted for r in state.rate_limit(
        log_df(spark, rows), limit=limit, seconds=seconds, partitions=partitions).collect()}
    assert got == limiter(rows, limit, seconds)


def test_rate_limit_at_one_instant(spark):
    rows = [(i, "a", T0) for i in range(61)] + [(61, "a", T0 + timedelta(seconds=15))]
    got = {r.tie: r for r in state.rate_limit(log_df(spark, rows)).collect()}
    assert [got[i].accepted for i in range(61)] == [True] * 60 + [False]
    assert got[60].retry_s == 15 and got[61].accepted
    assert (got[0].remaining, got[59].remaining, got[0].reset_s) == (59, 0, 15)


def test_rejected_requests_take_no_room(spark):
    rows = [(i, "a", T0 + timedelta(seconds=s)) for i, s in enumerate((0, 1, 2, 5, 5.5, 6, 20))]
    got = {r.tie: r.accepted for r in state.rate_limit(log_df(spark, rows), limit=2, seconds=5).collect()}
    assert [got[i] for i in range(7)] == [True, True, False, True, False, True, True]


def cooldown_model(rows):
    seen, out = {}, {}
    for i, ip, t, ok in rows:
        now = (t - T0).total_seconds()
        timeout, failures, skip = seen.get(ip, (2.0, 0, -1))
        probed = now >= skip
        if probed and ok:
            timeout, failures, skip = max(0.1, timeout * 0.9), 0, -1
        elif probed:
            failures += 1
            timeout, skip = min(5.0, timeout * 2), now + min(600, 60 * 2 ** (failures - 1))
        seen[ip] = (timeout, failures, skip)
        out[i] = (probed, timeout, failures)
    return out, seen


def probes_df(spark, rows):
    return spark.createDataFrame([(i, ip, 27015, t, ok) for i, ip, t, ok in rows],
                                 "tie BIGINT, ip STRING, port INT, ts TIMESTAMP_NTZ, ok BOOLEAN")


def test_cooldown_steps_by_hand(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(0, "a", at(0), False), (1, "a", at(30), True), (2, "a", at(60), False), (3, "a", at(180), False),
            (4, "a", at(419), True), (5, "a", at(420), True)]
    got = [tuple(r) for r in state.cooldown_steps(probes_df(spark, rows)).orderBy("tie").select(
        "probed", "timeout", "failures", (F.col("skip_until") - F.lit((T0 - datetime(1970, 1, 1)).total_seconds())).alias("s")).collect()]
    assert got[:4] == [(True, 4.0, 1, 60.0), (False, 4.0, 1, 60.0), (True, 5.0, 2, 180.0), (True, 5.0, 3, 420.0)]
    assert got[4][0] is False and got[5][:3] == (True, 4.5, 0)


def test_cooldown_with_a_hot_server(spark):
    rng = random.Random(5)
    rows = [(i, ip, t, rng.random() < 0.6) for i, ip, t in skewed_log(11)]
    steps = state.cooldown_steps(probes_df(spark, rows), partitions=9)
    want, final = cooldown_model(rows)
    assert {r.tie: (r.probed, r.timeout, r.failures) for r in steps.collect()} == want
    stored = {r.ip: (r.timeout, r.failures) for r in state.cooldown_state(steps).collect()}
    assert stored == {ip: s[:2] for ip, s in final.items()}


def test_stored_backoff_is_capped(spark):
    df = spark.createDataFrame([("a", 1, 9.0, 12, 5.0)], "ip STRING, port INT, timeout DOUBLE, failures INT, skip_until DOUBLE")
    assert tuple(state.load_cooldowns(df).first()) == ("a", 1, 5.0, 4, 5.0)


def admission_model(rows, limit, seconds, blocked=(), admins=()):
    """rows: (id, ip, time, threat, command)"""
    threats, out, closed, seen = {}, {}, set(blocked), {}
    for i, ip, t, threat, command in rows:
        if command:
            if command == "unblock":
                closed.discard(ip)
                threats[ip] = 0
            elif ip not in admins:
                closed.add(ip)
            out[i] = "refused" if command == "block" and ip in admins else command
            continue
        if ip not in closed and threat:
            threats[ip] = threats.get(ip, 0) + 1
            if threats[ip] >= 3 and ip not in admins:
                closed.add(ip)
        if ip in closed:
            out[i] = "blocked"
            continue
        lst = [x for x in seen.get(ip, []) if x > t - timedelta(seconds=seconds)]
        out[i] = "accepted" if len(lst) < limit else "limited"
        if len(lst) < limit:
            lst.append(t)
        seen[ip] = lst
    return out


def admission_rows(seed):
    rng = random.Random(seed)
    return [(i, ip, t, rng.random() < 0.004, rng.choices([None, "block", "unblock"], [0.997, 0.001, 0.002])[0])
            for i, ip, t in skewed_log(seed)]


def admission_df(spark, rows):
    df = spark.createDataFrame(rows, "tie BIGINT, ip STRING, ts TIMESTAMP_NTZ, t BOOLEAN, command STRING")
    return df.withColumn("full_path", F.when(F.col("t"), "/.env").otherwise("/home")).withColumn("endpoint", F.lit("e"))


def test_admission_with_a_hot_client(spark):
    rows = admission_rows(21)
    blocked = spark.createDataFrame([("10.0.0.3",)], "ip STRING")
    done = state.admit(admission_df(spark, rows), blocked, ["10.0.0.4"], limit=4, seconds=120, partitions=6)
    assert {r.tie: r.decision for r in done.collect()} == admission_model(rows, 4, 120, ["10.0.0.3"], ["10.0.0.4"])


def test_rounds_do_not_grow_with_the_partitions_of_a_hot_admin(spark):
    rows = [(i, "10.0.0.9", T0 + timedelta(milliseconds=400 * i), i % 5 == 0, None) for i in range(3000)]
    nobody = spark.createDataFrame([], "ip STRING")
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for n in (4, 16):
        spark.sparkContext.setJobGroup(f"hot-admin-{n}", "")
        done = state.admit(admission_df(spark, rows), nobody, ["10.0.0.9"], partitions=n)
        jobs[n] = len(tracker.getJobIdsForGroup(f"hot-admin-{n}"))
        assert {r.tie: r.threats for r in done.collect()} == {i: i // 5 + 1 for i, *_ in rows}
    spark.sparkContext.setJobGroup("", "")
    assert jobs[16] <= jobs[4] + 1


def test_sliding_count_and_running_count_with_a_hot_key(spark):
    rows = skewed_log(31)
    got = {r.tie: r.requests_in_window for r in wn.window_count(
        log_df(spark, rows), "ip", "ts", seconds=90, cells_of=3).collect()}
    want = {i: sum(1 for _, p, u in rows if p == ip and t - timedelta(seconds=90) < u <= t) for i, ip, t in rows}
    assert got == want
    flagged = log_df(spark, rows).withColumn("f", F.col("tie") % 7 == 0)
    run = {r.tie: r.n for r in wn.running_count(flagged, "ip", "ts", "tie", "f", "n", blocks=5).collect()}
    seen, expect = {}, {}
    for i, ip, _ in rows:
        seen[ip] = seen.get(ip, 0) + (i % 7 == 0)
        expect[i] = seen[ip]
    assert run == expect


def test_dedupe_modes(spark):
    stream = [(0, "192.0.2.0"), (1, "192.0.2.1"), (2, "192.0.2.2"), (3, "192.0.2.1"), (4, "192.0.2.3")]
    df = spark.createDataFrame(stream, "pos INT, ip STRING")
    pick = lambda mode: sorted(r.pos for r in wn.dedupe(df, ["ip"], "pos", mode).collect())
    assert pick("keep") == [0, 1, 2, 3, 4] and pick("skip") == [0, 1, 2, 4] and pick("stop") == [0, 1, 2]
    assert wn.dedupe(df.filter("pos < 3"), ["ip"], "pos", "stop").count() == 3
    with pytest.raises(ValueError):
        wn.dedupe(df, ["ip"], "pos", "no")


def test_third_threat_blocks(spark):
    rows = [(i, T0 + timedelta(seconds=i), ip, "e", path) for i, (ip, path) in enumerate(
        [("a", "/.env"), ("a", "/ok"), ("a", "/x.php"), ("b", "/.env"), ("a", "/../"), ("a", "/.env"), ("b", "/.env")])]
    log = spark.createDataFrame(rows, "id BIGINT, timestamp TIMESTAMP_NTZ, ip STRING, endpoint STRING, full_path STRING")
    none = spark.createDataFrame([], "ip STRING")
    (block,) = rq.auto_blocks(log, none).collect()
    assert tuple(block) == ("a", "Auto-blocked: PATH_TRAVERSAL (detected 3 threats)", T0 + timedelta(seconds=4), True)
    assert rq.auto_blocks(log, none, admins=["a"]).count() == 0
    assert rq.auto_blocks(log, spark.createDataFrame([("a",)], "ip STRING")).count() == 0


def pressure(seed, n=900):
    """Clients that are quiet, bursty, always over the limit, or silent for long; times repeat."""
    rng, rows, i = random.Random(seed), [], 0
    for ip, gap in (("quiet", 30.0), ("burst", 0.0), ("always", 0.7), ("edge", 5.0)):
        t = 0.0
        for _ in range(n // 4):
            t += gap if ip == "edge" else rng.expovariate(1 / gap) if gap else rng.choice([0, 0, 0, 0.2, 0.2, 40, 90])
            rows.append((i, ip, T0 + timedelta(microseconds=int(t * 1e6))))
            i += 1
    return rows


@pytest.mark.parametrize("limit,seconds", [(2, 10), (5, 10), (3, 15)])
def test_limiter_by_episodes_equals_the_loop(spark, limit, seconds):
    rows = pressure(limit)
    got = state.rate_limit(log_df(spark, rows), limit=limit, seconds=seconds, partitions=3).collect()
    assert {r.tie: r.accepted for r in got} == limiter(rows, limit, seconds)
    fold = state.RateFold(limit, seconds)
    for ip in {r[1] for r in rows}:  # and all numbers are those of one fold over the whole client
        own = sorted((t, i) for i, p, t in rows if p == ip)
        import numpy as np

        out, _ = fold.judge(np.array([int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)) for t, _ in own]), ())
        mine = {r.tie: r for r in got if r.ip == ip}
        for k, (_, i) in enumerate(own):
            assert tuple(mine[i][c] for c in ("accepted", "remaining", "reset_s", "retry_s")) == tuple(out[c][k] for c in ("accepted", "remaining", "reset_s", "retry_s"))


def test_episodes_are_cut_where_the_state_is_known(spark):
    from tidemark.operators import episodes as ep

    rows = [(i, "a", i * 1_000_000 + (i >= 50) * 10**9, not 20 <= i < 30 and i not in (60, 61)) for i in range(100)]
    df = spark.createDataFrame(rows, "tie BIGINT, ip STRING, us BIGINT, calm BOOLEAN")
    for span in (7_000_000, 10**12):
        placed = ep.in_cells(df, "us", span, 0).filter("_own")
        got = ep.episodes(placed, ["ip"], "us", "tie", "calm").collect()
        assert {(r.tie, r._episode // 1_000_000, r.after_calm) for r in got} == {
            *((i, 20, i == 20) for i in range(20, 30)), (60, 1060, True), (61, 1060, False)}


@pytest.mark.parametrize("first_ok", [True, False])
def test_backoff_of_servers_that_answer_for_hours(spark, first_ok):
    """Long runs of answers are calm; pauses, failures and a stored back-off in between are not."""
    rng, rows, t = random.Random(1), [], 0.0
    for i in range(1500):
        t += 200.0 if i % 400 != 399 else 200_000.0
        ok = first_ok if i == 0 else not (500 <= i < 506 or i in (900, 901) or (i > 1300 and rng.random() < 0.4))
        rows.append((i, "10.0.0.1", T0 + timedelta(seconds=t), ok))
    steps = state.cooldown_steps(probes_df(spark, rows), partitions=4)
    want, _ = cooldown_model(rows)
    assert {r.tie: (r.probed, r.timeout, r.failures) for r in steps.collect()} == want
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan
    stored = probes_df(spark, rows[:200]).withColumn("timeout", F.lit(5.0)).withColumn("failures", F.lit(4)).withColumn(
        "skip_until", F.lit((T0 - datetime(1970, 1, 1)).total_seconds() + 900.0))
    assert [r.probed for r in state.cooldown_steps(stored).orderBy("tie").limit(6).collect()] == [False] * 4 + [True] * 2


def test_limiter_and_backoff_go_through_a_cell_once(spark):
    """A frame with two moving ends is gone through for each row: it is only used where it holds no more rows than the limit."""
    rows = [(i, "a", T0 + timedelta(milliseconds=10 * (i // 3))) for i in range(3000)]
    done = state.rate_limit(log_df(spark, rows), limit=5, seconds=10)
    assert {r.tie: r.accepted for r in done.collect()} == limiter(rows, 5, 10)
    moving = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("specifiedwindowframe(RangeFrame, -")
    assert moving(done) <= 2  # named twice in the one place
    probed = spark.createDataFrame([(1, "a", 1, T0, True)], "tie BIGINT, ip STRING, port INT, ts TIMESTAMP_NTZ, ok BOOLEAN")
    assert moving(state.cooldown_steps(probed)) == 0
    assert moving(wn.window_count(log_df(spark, rows), "ip", "ts")) == 0


def test_rules_run_on_rows_dealt_out(spark):
    """One large file is one task of the scan; the rules, which are most of the work, run between two exchanges."""
    df = admission_df(spark, admission_rows(5)[:50]).drop("command").coalesce(1)
    text = state.admit(df, spark.createDataFrame([("10.0.0.3",)], "ip STRING"), partitions=6)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [tie" in text.split("RLIKE")[-1] and "RepartitionByExpression [ip" in text.split("RLIKE")[0]


def test_admission_without_commands(spark):
    rows = [(*r[:4], None) for r in admission_rows(22)]
    log, blocked = admission_df(spark, rows).drop("command"), spark.createDataFrame([("10.0.0.3",), ("10.0.0.3",)], "ip STRING")
    done = state.admit(log, blocked, ["10.0.0.4"], limit=4, seconds=120, partitions=6).collect()
    assert len(done) == len(rows)  # a client listed twice is one
    assert {r.tie: r.decision for r in done} == admission_model(rows, 4, 120, ["10.0.0.3"], ["10.0.0.4"])
    same = state.admit(admission_df(spark, rows), blocked, ["10.0.0.4"], limit=4, seconds=120, partitions=6).collect()
    told = lambda found: {r.tie: (r.decision, r.threats, r.logged, r.auto_blocked, r.remaining, r.reset_s, r.retry_s) for r in found}
    assert told(done) == told(same)
