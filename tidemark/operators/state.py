"""The state machines: back-off per server, rate limit and admission per client.

* Threats add up and saturate: a client's count is a running sum, and it is closed from the row on that brings the sum to
  the limit, or from a manual block; both are smallest positions per client and stretch between two unblockings. No fold is needed.
* The limiter forgets after its window. A request with no more than the limit in its window, and none in doubt there, is accepted;
  the others are folded by episodes (``operators.episodes``).
* Back-off forgets after a long run of answers, which leaves the shortest timeout. The rest is folded by episodes.

The folds are also those of the streaming operators.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import is_admin
from tidemark.functions.threats import threat_type
from tidemark.functions.time import epoch_micros
from tidemark.operators.blocks import running_counts
from tidemark.operators.episodes import Fold, episodes, fold_sorted, in_cells
from tidemark.operators.windows import between, so_far
from tidemark.schemas import flat_schema

# Back-off of servers that do not answer, in seconds.
START_TIMEOUT, MIN_TIMEOUT, MAX_TIMEOUT = 2.0, 0.1, 5.0
BASE_SKIP, MAX_SKIP = 60, 600
# Requests per window and client, window in seconds, threats until a block.
MAX_REQUESTS, WINDOW_SECONDS, BLOCK_AT = 60, 15, 3

MICROS = 1_000_000


def next_cooldown(timeout: float, failures: int, skip_until: float, now: float, ok: bool):
    """(probed, timeout, failures, skip_until) after a probe attempt at ``now`` seconds."""
    if now < skip_until:
        return False, timeout, failures, skip_until
    if ok:
        return True, max(MIN_TIMEOUT, timeout * 0.9), 0, 0.0
    failures += 1
    skip = min(MAX_SKIP, BASE_SKIP * 2 ** min(failures - 1, 10))
    return True, min(MAX_TIMEOUT, timeout * 2), failures, now + skip


class CooldownFold(Fold):
    """State: (timeout, failures, skip_until). Runs of answers are taken at once, and so are skipped attempts."""

    columns = ("now_s", "ok", "timeout0", "failures0", "skip_until0", "after_calm")
    schema = flat_schema("probed BOOLEAN, timeout DOUBLE, failures INT, skip_until DOUBLE")

    def start(self, cols, i):
        if cols["after_calm"][i]:
            return MIN_TIMEOUT, 0, 0.0
        return float(cols["timeout0"][i]), int(cols["failures0"][i]), float(cols["skip_until0"][i])

    def run(self, cols, lo, hi, state, out):
        now, ok = cols["now_s"][lo:hi].astype(float), cols["ok"][lo:hi].astype(bool)
        failed = np.append(np.flatnonzero(~ok), hi - lo)
        timeout, failures, skip_until = state
        i = 0
        while i < hi - lo:
            j = max(i, int(np.searchsorted(now, skip_until)))  # attempts before that are skipped
            self._put(out, lo + i, lo + min(j, hi - lo), False, timeout, failures, skip_until)
            i = j
            if i >= hi - lo:
                break
            j = int(failed[np.searchsorted(failed, i)])
            if j > i:  # answers: the timeout shrinks step by step
                steps = np.multiply.accumulate(np.r_[timeout, np.full(j - i, 0.9)])[1:]
                low = np.flatnonzero(steps < MIN_TIMEOUT)
                if len(low):
                    steps[low[0]:] = MIN_TIMEOUT
                self._put(out, lo + i, lo + j, True, steps, 0, 0.0)
                timeout, failures, skip_until, i = float(steps[-1]), 0, 0.0, j
            else:
                _, timeout, failures, skip_until = next_cooldown(timeout, failures, skip_until, float(now[i]), False)
                self._put(out, lo + i, lo + i + 1, True, timeout, failures, skip_until)
                i += 1
        return timeout, failures, skip_until

    def _put(self, out, a, b, *values):
        for f, v in zip(self.schema, values):
            out[f.name][a:b] = v


class RateFold(Fold):
    """State: the newest accepted times, at most as many as the limit.

    A request is accepted if the accepted one ``limit`` places before it has left the window. So as long as nothing
    is rejected, up to ``limit`` requests are judged at once; and a rejected one is followed by rejected ones until
    that place leaves the window, which is found by binary search.
    """

    columns = ("now_us",)
    schema = flat_schema("accepted BOOLEAN, remaining INT, reset_s INT, retry_s INT")

    def __init__(self, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS):
        self.limit, self.window = limit, seconds * MICROS

    def start(self, cols, i):
        return ()

    def judge(self, times: np.ndarray, state: tuple) -> tuple[dict[str, np.ndarray], tuple]:
        """Verdicts on requests at sorted ``times``, and the state after them."""
        long_ago = np.iinfo(np.int64).min // 2
        free = np.full(self.limit - len(state), long_ago)
        taken = np.concatenate([free, np.array(state, np.int64), np.empty(len(times), np.int64)])
        n, i, ok = self.limit, 0, np.zeros(len(times), bool)  # taken[:n] are accepted times, free places first
        while i < len(times):
            block = times[i:i + self.limit]
            late = np.flatnonzero(taken[n - self.limit:n - self.limit + len(block)] > block - self.window)
            k = int(late[0]) if len(late) else len(block)
            ok[i:i + k] = True
            taken[n:n + k] = block[:k]
            n, i = n + k, i + k
            if len(late):
                i = max(i, int(np.searchsorted(times, taken[n - self.limit] + self.window)))
        accepted = taken[:n]
        upto = self.limit + np.cumsum(ok)
        oldest = np.minimum(np.searchsorted(accepted, times - self.window, "right"), upto - 1)
        inside = upto - oldest
        wait = ((self.window - (times - accepted[oldest])) // MICROS).astype(np.int32)
        out = {"accepted": ok, "remaining": np.where(ok, self.limit - inside, 0).astype(np.int32),
               "reset_s": np.where(ok, wait, 0), "retry_s": np.where(ok, 0, wait)}
        last = accepted[-self.limit:]
        return out, tuple(last[last > times[-1] - self.window].tolist()) if len(times) else state

    def run(self, cols, lo, hi, state, out):
        found, state = self.judge(cols["now_us"][lo:hi].astype(np.int64), state)
        for name, values in found.items():
            out[name][lo:hi] = values
        return state


class AdmissionFold(Fold):
    """Blocked, then threat, then log, then rate. State: threats seen, blocked?, accepted times.

    A row with a ``command`` (``block`` or ``unblock``) is no request: it changes the state. Between two commands
    threats are a running sum, and the row that blocks is the first that brings it to the limit.
    """

    columns = ("now_us", "threat", "blocked0", "is_admin", "command")
    schema = flat_schema(
        "decision STRING, logged BOOLEAN, threats BIGINT, auto_blocked BOOLEAN, "
        "remaining INT, reset_s INT, retry_s INT")

    def __init__(self, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS, block_at: int = BLOCK_AT):
        self.rate, self.block_at = RateFold(limit, seconds), block_at

    def start(self, cols, i):
        return 0, bool(cols["blocked0"][i]), ()

    def run(self, cols, lo, hi, state, out):
        threats, blocked, accepted = state
        command = pd.Series(cols["command"][lo:hi], dtype=object)
        places = np.append(np.flatnonzero(command.notna().to_numpy()), hi - lo)
        i = 0
        for c in places.tolist():
            if c > i:
                threats, blocked, accepted = self._requests(cols, lo + i, lo + c, threats, blocked, accepted, out)
            if c < hi - lo:
                admin, what = bool(cols["is_admin"][lo + c]), command.iloc[c]
                if what == "unblock":
                    threats, blocked = 0, False
                else:
                    what, blocked = ("refused" if admin else what), not admin
                out["decision"][lo + c], out["threats"][lo + c] = what, threats
            i = c + 1
        return threats, blocked, accepted

    def run_late(self, cols, n, threats, blocked, out):
        """Rows before ``n`` are older than others already decided: blocks and threats are settled, the limiter is left open."""
        for i in range(n):
            what, admin = cols["command"][i], bool(cols["is_admin"][i])
            if not pd.isna(what):
                if what == "unblock":
                    threats, blocked = 0, False
                else:
                    what, blocked = ("refused" if admin else what), blocked or not admin
                out["decision"][i], out["threats"][i] = what, threats
                continue
            if not blocked and not pd.isna(cols["threat"][i]):
                threats += 1
                if threats >= self.block_at and not admin:
                    blocked = out["auto_blocked"][i] = True
            out["decision"][i], out["logged"][i], out["threats"][i] = ("blocked" if blocked else "late"), not blocked, threats
        return threats, blocked

    def _requests(self, cols, a, b, threats, blocked, accepted, out):
        hit = pd.notna(cols["threat"][a:b])
        so_far = threats + np.cumsum(hit)
        stop = 0 if blocked else b - a  # the first row that isn't served
        if not blocked:
            over = np.flatnonzero(hit & (so_far >= self.block_at) & ~cols["is_admin"][a:b].astype(bool))
            if len(over):
                stop, blocked = int(over[0]), True
                out["auto_blocked"][a + stop] = True
                so_far[stop:] = so_far[stop]
        else:
            so_far[:] = threats
        out["threats"][a:b] = so_far
        out["decision"][a + stop:b] = "blocked"
        if stop:
            found, accepted = self.rate.judge(cols["now_us"][a:a + stop].astype(np.int64), accepted)
            out["decision"][a:a + stop] = np.where(found.pop("accepted"), "accepted", "limited")
            out["logged"][a:a + stop] = True
            for name, values in found.items():
                out[name][a:a + stop] = values
        return int(so_far[-1]), blocked, accepted


class LateFold(Fold):
    """The limiter on requests that come in after others of their time were decided. State: accepted times in the window.

    ``fixed`` rows have been accepted and take their place whatever the count; they only come near late ones.
    """

    columns = ("now_us", "fixed")
    schema = flat_schema("accepted BOOLEAN")

    def __init__(self, limit: int, seconds: int):
        self.limit, self.window = limit, seconds * MICROS

    def start(self, cols, i):
        return ()

    def run(self, cols, lo, hi, state, out):
        taken = deque(state)
        for i in range(lo, hi):
            now = int(cols["now_us"][i])
            while taken and taken[0] <= now - self.window:
                taken.popleft()
            ok = bool(cols["fixed"][i]) or len(taken) < self.limit
            if ok:
                taken.append(now)
            out["accepted"][i] = ok
        return tuple(taken)


# Answers in a row after which a timeout of up to 84 s has shrunk to the shortest one, and the time looked back for them.
SETTLED, SETTLED_SECONDS = 64, 4 * 3600


def cooldown_steps(probes: DataFrame, partitions: int | None = None) -> DataFrame:
    """``probes(ip, port, ts, tie, ok)`` in order, each with the back-off after it.

    Stored back-off, if any, comes in as ``timeout, failures, skip_until`` (see ``with_state``).

    An answer is calm if ``SETTLED`` attempts of the last hours, and all that may have led to skipping one of them, were
    answers: the timeout is the shortest then, whatever came before.
    """
    start = {"timeout": START_TIMEOUT, "failures": 0, "skip_until": 0.0}
    given, keys = set(probes.columns), ["ip", "port"]
    kept = [c for c in probes.columns if c not in start]
    prepared = probes.select(
        *kept, epoch_micros(F.col("ts")).alias("_us"), (epoch_micros(F.col("ts")) / F.lit(1e6)).alias("now_s"),
        *[(F.col(c) if c in given else F.lit(v)).alias(c + "0") for c, v in start.items()])
    back = SETTLED_SECONDS * MICROS
    reach = back + MAX_SKIP * MICROS
    cell = W.partitionBy(*keys, "_cell").orderBy("_us")
    ok = F.coalesce("ok", F.lit(False))
    calm = (ok & (between(cell, -reach, 0, ~ok) == 0) & (between(cell, -back, -1) >= SETTLED) & (between(cell, 0, 0) == 1)
            & (F.col("skip_until0") * MICROS <= F.col("_us") - back))
    placed = in_cells(prepared, "_us", 20 * reach, reach).withColumn("_calm", calm).filter("_own")
    settled = {"probed": F.lit(True), "timeout": F.lit(MIN_TIMEOUT), "failures": F.lit(0), "skip_until": F.lit(0.0)}
    quiet = placed.filter("_calm").select(*kept, *[v.alias(c) for c, v in settled.items()])
    folded = fold_sorted(episodes(placed, keys, "_us", "tie", "_calm"), [*keys, "_episode"], ["_us", "tie"], CooldownFold(), partitions)
    return quiet.unionByName(folded.select(*kept, *settled))


def cooldown_state(steps: DataFrame) -> DataFrame:
    """Back-off of each server after its last probe, as stored."""
    newest = F.struct("ts", "tie")
    return steps.groupBy("ip", "port").agg(
        F.max_by("timeout", newest).alias("timeout"), F.max_by("failures", newest).alias("failures"),
        F.max_by("skip_until", newest).alias("skip_until"), F.max("ts").alias("updated_at"))


def load_cooldowns(stored: DataFrame) -> DataFrame:
    """Stored back-off as used after a restart: capped, so that nobody is skipped for long."""
    return stored.select(
        "ip", "port", F.least("timeout", F.lit(MAX_TIMEOUT)).alias("timeout"),
        F.least("failures", F.lit(4)).alias("failures"), "skip_until")


def rate_limit(requests: DataFrame, key: str = "ip", limit: int = MAX_REQUESTS,
               seconds: int = WINDOW_SECONDS, partitions: int | None = None) -> DataFrame:
    """``requests(ip, ts, tie)`` with the limiter's verdict. Rejected requests take no room.

    A request is *sure* if its window holds no more requests than the limit, and calm if all in its window are: then all of them were
    accepted, and its verdict is a count. Others are folded, with the window of requests before them.
    """
    window = seconds * MICROS
    kept = requests.columns
    cell = W.partitionBy(key, "_cell").orderBy("now_us")
    placed = in_cells(requests.withColumn("now_us", epoch_micros(F.col("ts"))), "now_us", 20 * window, 3 * window, window)
    # The place comes first: sorted by time and tie, the rows are in order for all that follows.
    judged = (placed.withColumn("_place", F.row_number().over(W.partitionBy(key, "_cell").orderBy("now_us", "tie")))
              .withColumn("_gone", so_far(cell, -window))
              .withColumn("_sure", so_far(cell, 0) - F.col("_gone") <= limit)
              .withColumn("_inside", (F.col("_place") - F.col("_gone")).cast("int"))
              .withColumn("_calm", between(cell, 1 - window, 0, ~F.col("_sure")) == 0)
              .withColumn("_apart", between(cell, 0, window - 1, ~F.col("_calm")) == 0))
    wait = F.expr(f"CAST(({window} - (now_us - _oldest)) div {MICROS} AS INT)")
    verdict = {"accepted": F.lit(True), "remaining": limit - F.col("_inside"), "reset_s": wait, "retry_s": F.lit(0)}
    oldest = F.min("now_us").over(cell.rangeBetween(1 - window, 0))  # windows of sure rows hold no more rows than the limit
    quiet = judged.filter("_sure").withColumn("_oldest", oldest).filter("_own AND _calm").select(*kept, *[v.alias(c) for c, v in verdict.items()])
    judged = judged.filter("_own")
    folded = fold_sorted(episodes(judged, [key], "now_us", "tie", "_apart", window), [key, "_episode"], ["now_us", "tie"], RateFold(limit, seconds), partitions)
    return quiet.unionByName(folded.filter("NOT _calm").select(*kept, *verdict))


def late_rows(requests: DataFrame, key: str, us: str, batch: str) -> DataFrame:
    """Adds ``late``: an earlier batch brought a newer request of the same client."""
    newest = requests.groupBy(F.col(key).alias("_key"), F.col(batch).alias("_batch")).agg(F.max(us).alias("_us"))
    before = F.max("_us").over(W.partitionBy("_key").orderBy("_batch").rowsBetween(W.unboundedPreceding, -1))
    seen = newest.select("_key", "_batch", before.alias("_newest"))
    return (requests.join(seen, F.col(key).eqNullSafe(F.col("_key")) & (F.col(batch) == F.col("_batch")))
            .withColumn("late", F.coalesce(F.col(us) < F.col("_newest"), F.lit(False))).drop("_key", "_batch", "_newest"))


def decide_late(late: DataFrame, taken: DataFrame, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS,
                partitions: int | None = None) -> DataFrame:
    """``late(ip, now_us, tie)`` with ``accepted``: fewer than the limit were accepted in the window before it.

    ``taken(ip, now_us)`` were accepted before and stay so. Only those within a window before a late request are looked at.
    """
    window = seconds * MICROS
    cell = lambda t: F.floor(t / F.lit(window)).cast("bigint")
    near = late.select("ip", F.explode(F.array(cell(F.col("now_us")), cell(F.col("now_us")) - 1)).alias("_cell")).distinct()
    fixed = taken.select("ip", "now_us", cell(F.col("now_us")).alias("_cell")).join(near, ["ip", "_cell"], "left_semi").drop("_cell")
    open_rows = late.withColumn("fixed", F.lit(False)).withColumn("_after", F.lit(1))
    both = open_rows.unionByName(fixed.withColumn("fixed", F.lit(True)).withColumn("_after", F.lit(0)), allowMissingColumns=True)
    done = fold_sorted(both, ["ip"], ["now_us", "_after", "tie"], LateFold(limit, seconds), partitions)
    return done.filter("NOT fixed").drop("fixed", "_after")


def admission_input(requests: DataFrame, admins=()) -> DataFrame:
    """The columns admission reads, added to ``requests(ip, ts, tie, full_path [, command])``."""
    if "command" not in requests.columns:
        requests = requests.withColumn("command", F.lit(None).cast("string"))
    return (requests.withColumn("threat", threat_type(F.col("full_path")))
            .withColumn("now_us", epoch_micros(F.col("ts")))
            .withColumn("is_admin", is_admin(F.col("ip"), admins)))


def admit(requests: DataFrame, blocked: DataFrame, admins=(), limit: int = MAX_REQUESTS,
          seconds: int = WINDOW_SECONDS, block_at: int = BLOCK_AT,
          partitions: int | None = None) -> DataFrame:
    """``requests(ip, ts, tie, full_path [, command])`` with the decision on each."""
    has_commands = "command" in requests.columns
    marks = blocked.select("ip", F.lit(True).alias("blocked0")).distinct()
    # Rows are dealt out before the rules run on them, as a file may hold very many in one piece; and again after them, so that what
    # the sort samples is that exchange and the rules run once.
    parts = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = admission_input(requests.repartition(parts, "tie"), admins).repartition(parts, "ip", "tie")
    prepared = judged.join(marks, "ip", "left").withColumn("blocked0", F.coalesce("blocked0", F.lit(False)))
    kept = [c for c in prepared.columns if c not in ("now_us", "blocked0", "is_admin")]
    request = F.col("command").isNull()
    hit = request & F.col("threat").isNotNull()
    flags = {"_hits": hit, "_stretch": F.col("command") == "unblock"} if has_commands else {"_hits": hit}
    rows = running_counts(prepared.withColumns(flags), ["ip"], ["now_us", "tie"], list(flags), partitions)
    if has_commands:
        rows = _closed_by_commands(rows, hit, block_at)
    else:  # the count alone tells: it is that of the closing row from there on
        full, held = F.lit(max(1, block_at)), F.col("_hits")
        rows = rows.withColumns({"_outset": F.col("blocked0"), "_after": F.coalesce(~F.col("is_admin") & (held >= full), F.lit(False)),
                                 "_closing": hit & (held == full)}).withColumn("_held", full)
    outset, after = F.col("_outset"), F.col("_after")
    told = F.when(F.col("is_admin") & (F.col("command") != "unblock"), "refused").otherwise(F.col("command"))
    decided = rows.select(
        *kept, F.when(~request, told).when(outset | after, "blocked").alias("decision"),
        F.when(outset, F.lit(0)).when(after, F.col("_held")).otherwise(F.col("_hits")).cast("bigint").alias("threats"),
        (request & ~outset & after & F.col("_closing")).alias("auto_blocked"))
    served = rate_limit(decided.filter("decision IS NULL"), "ip", limit, seconds, partitions)
    numbers = ("remaining", "reset_s", "retry_s")
    said = served.select(*kept, F.when(F.col("accepted"), "accepted").otherwise("limited").alias("decision"), F.lit(True).alias("logged"),
                         "threats", "auto_blocked", *numbers)
    rest = decided.filter("decision IS NOT NULL").select(
        *kept, "decision", F.lit(False).alias("logged"), "threats", "auto_blocked", *[F.lit(0).alias(c) for c in numbers])
    return said.unionByName(rest)


def _closed_by_commands(rows: DataFrame, hit: Column, block_at: int) -> DataFrame:
    """Rows with ``_outset`` (blocked from the start), ``_after`` and ``_closing`` (a block holds; it begins here) and ``_held``, the
    threats it began with, where counting begins anew with each unblocking."""
    base = rows.filter("command = 'unblock'").groupBy("ip", "_stretch").agg(F.min("_hits").alias("_base"))
    rows = _of_stretch(rows, base).withColumn("_hits", F.col("_hits") - F.coalesce("_base", F.lit(0))).drop("_base")
    at, request = F.struct("now_us", "tie"), F.col("command").isNull()
    closes = ~F.col("is_admin") & ((hit & (F.col("_hits") >= block_at)) | (~request & (F.col("command") != "unblock")))
    closing = rows.filter(closes).groupBy("ip", "_stretch").agg(F.min(at).alias("_closed"), F.min_by("_hits", at).alias("_held"))
    return _of_stretch(rows, closing).withColumns({
        "_outset": F.col("blocked0") & (F.col("_stretch") == 0), "_after": F.coalesce(at >= F.col("_closed"), F.lit(False)),
        "_closing": F.coalesce(at == F.col("_closed"), F.lit(False))})


def _of_stretch(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with what was found of their client and stretch between two unblockings, which is one row at most."""
    own = found.withColumnsRenamed({"ip": "_ip", "_stretch": "_s"})
    return rows.join(own, F.col("ip").eqNullSafe(F.col("_ip")) & (F.col("_stretch") == F.col("_s")), "left").drop("_ip", "_s")
