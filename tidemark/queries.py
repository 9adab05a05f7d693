"""Registered queries: each binds operators to the test tables, next to the SQL it must agree with.

The SQL is for DuckDB on the same tables. All queries read whole tables; a window or filter is there
where it is the operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import identity as idn
from tidemark.functions import numeric as nm
from tidemark.functions import text as tx
from tidemark.functions import threats as th
from tidemark.functions import time as tm
from tidemark.operators import aggregates as ag
from tidemark.operators import filters as fl
from tidemark.operators import joins as jn
from tidemark.operators import ranking as rk
from tidemark.operators import records as rec
from tidemark.operators import requests as rq
from tidemark.operators import sets as st
from tidemark.operators import state
from tidemark.operators import windows as wn
from tidemark.params import ChartParams, StatsParams
from tidemark.plans import bindings as b
from tidemark.plans import discovery, ingest, metadata, profile
from tidemark.plans.chart import Chart, document_rows
from tidemark.plans.requests import BlockList, page_endpoints, request_page
from tidemark.session import apply_semantics, ensure_checkpoint_dir
from tidemark.sources import readers as rd
from tidemark.sources.tables import Store, insert_ignored, upserted
from tidemark.streaming import cycle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

START, END, DAY = "2024-01-08", "2024-01-15", "2024-01-10"
WINDOW = (START, END)
#: All days of the test tables.
FIRST, PAST = "2024-01-01", "2024-02-01"
MIDDLE = "2024-01-16"

PRELUDE = f"""
samples AS (
  SELECT event_id AS id, time_bucket(INTERVAL '5 minutes', ts) AS timestamp, user_id AS server_id,
         CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS map_id,
         CAST(floor(value) AS BIGINT) AS players
  FROM events),
snaps AS (SELECT DISTINCT timestamp, strftime(timestamp, '%Y%m%d%H%M%S') AS guid FROM samples),
servers AS (
  SELECT c_custkey AS id,
         '10.' || ((c_custkey >> 16) & 255) || '.' || ((c_custkey >> 8) & 255) || '.' || (c_custkey & 255) AS ip,
         CAST(27015 + c_custkey % 4 AS INTEGER) AS port, n_name AS country_code, c_name, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
server_names AS (SELECT ip, port, c_name AS name FROM servers WHERE c_acctbal >= 1000),
maps AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || p_partkey AS name FROM part),
rollup_2h AS (
  SELECT time_bucket(INTERVAL '2 hours', timestamp) AS bucket, server_id, map_id,
         CAST(sum(players) AS BIGINT) AS players FROM samples GROUP BY 1, 2, 3),
per_bucket AS (
  SELECT time_bucket(INTERVAL '2 hours', timestamp) AS bucket, count(DISTINCT guid) AS snapshots
  FROM snaps WHERE timestamp >= '{START}' AND timestamp < '{END}' GROUP BY 1),
cells AS (
  SELECT r.*, m.name AS map, s.ip, s.port, s.ip || ':' || s.port AS server
  FROM rollup_2h r JOIN maps m ON m.id = r.map_id JOIN servers s ON s.id = r.server_id
  WHERE bucket >= '{START}' AND bucket < '{END}'),
spine AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL '1 microsecond',
                                        INTERVAL '2 hours')) AS bucket),
map_avg AS (
  SELECT bucket, map, CAST(sum(players) AS BIGINT) AS players,
         CAST(round_even(CAST(sum(players) AS DOUBLE) / any_value(coalesce(nullif(snapshots, 0), 1)), 2)
              AS DECIMAL(28,6)) AS avg_players
  FROM cells LEFT JOIN per_bucket USING (bucket) GROUP BY 1, 2),
shares AS (
  SELECT bucket, map, avg_players, CAST(avg_players AS DOUBLE) /
         coalesce(nullif(CAST(sum(avg_players) OVER (PARTITION BY bucket) AS DOUBLE), 0), 1) * 100 AS share
  FROM map_avg),
contrib AS (SELECT map, sum(avg_players) AS contribution FROM map_avg GROUP BY 1),
top_maps AS (SELECT map, 'top' AS kind FROM contrib ORDER BY contribution DESC, map LIMIT 10),
srv AS (
  SELECT bucket, server, CAST(CAST(sum(players) AS DOUBLE) / any_value(coalesce(nullif(snapshots, 0), 1))
                              AS DECIMAL(28,10)) AS avg_contrib
  FROM cells LEFT JOIN per_bucket USING (bucket) GROUP BY 1, 2),
valid AS (SELECT greatest(count(*) FILTER (WHERE snapshots > 0), 1) AS n FROM per_bucket),
srv_avg AS (SELECT server, sum(avg_contrib) AS total FROM srv GROUP BY 1),
requests AS (
  SELECT event_id AS id, ts AS timestamp,
         '10.' || ((user_id >> 16) & 255) || '.' || ((user_id >> 8) & 255) || '.' || (user_id & 255) AS ip,
         event_type AS endpoint,
         url || CASE event_id % 20 WHEN 3 THEN '?q=%3Cscript%3E' WHEN 7 THEN '/wp-login.php'
                WHEN 11 THEN '/.env' WHEN 13 THEN '?a=1;ls' ELSE '' END AS full_path
  FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)),
classified AS (
  SELECT *, CASE {" ".join(
      "WHEN regexp_matches(url_decode(full_path), '(?i)" + th.alternation(p).replace("'", "''") + "') THEN '" + k + "'"
      for k, p in th.RULES)} END AS threat_type FROM requests),
today AS (SELECT * FROM classified WHERE timestamp >= '{DAY}' AND timestamp < TIMESTAMP '{DAY}' + INTERVAL 1 DAY),
blocked AS (SELECT ip FROM servers WHERE country_code = 'NATION_7')
"""


def sql(body: str, ctes: str = "", recursive: bool = False) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {PRELUDE.strip()}{',' + ctes if ctes else ''}\n{body.strip()}"


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(apply_semantics(spark), sf)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


def r6(col) -> Column:
    return nm.round_even(F.col(col) if isinstance(col, str) else col, 6)


def chart(spark: SparkSession, sf: str, **params) -> Chart:
    return Chart(b.star(spark, sf, WINDOW), START, END, ChartParams(**params))


def whole_chart(spark: SparkSession, sf: str) -> Chart:
    """Over all days, for operators that have no window."""
    return Chart(b.star(spark, sf, (FIRST, PAST)), FIRST, PAST, ChartParams())


def all_days(text: str) -> str:
    return sql(text).replace(f"'{START}'", f"'{FIRST}'").replace(f"'{END}'", f"'{PAST}'")


# ---- chart ------------------------------------------------------------------------------------

@query("map_share", sql("""
SELECT bucket, map, round_even(CAST(avg_players AS DOUBLE), 6) AS avg_players, round_even(share, 6) AS share FROM shares"""))
def _(spark, sf):
    return chart(spark, sf).map_share().select("bucket", "map", r6("avg_players").alias("avg_players"),
                                               r6("share").alias("share"))


_SERIES = """
labelled AS (SELECT bucket, coalesce(k.map, 'Other') AS label, coalesce(kind, 'other') AS kind, share
             FROM shares s LEFT JOIN shown k ON k.map = s.map),
series AS (SELECT DISTINCT label, kind FROM labelled),
summed AS (SELECT bucket, label, kind, sum(share) AS share FROM labelled GROUP BY ALL)
"""
_SERIES_BODY = """
SELECT p.bucket, s.label, s.kind, round_even(coalesce(x.share, 0), 6) AS share
FROM series s CROSS JOIN spine p
LEFT JOIN summed x ON x.bucket = p.bucket AND x.label = s.label AND x.kind = s.kind"""


def _series(df: DataFrame) -> DataFrame:
    return df.select("bucket", "label", "kind", r6("share").alias("share"))


@query("map_share_top_other", sql(_SERIES_BODY, "shown AS (SELECT * FROM top_maps)," + _SERIES))
def _(spark, sf):
    return _series(chart(spark, sf).map_series())


@query("chart_document_rows", sql("""
SELECT label, kind, CAST(floor(epoch(bucket) / (7200 * 12)) AS BIGINT) AS part, count(*) AS points, min(bucket) AS first_bucket,
       round_even(sum(share), 4) AS total FROM points GROUP BY ALL""", "shown AS (SELECT * FROM top_maps)," + _SERIES + ", points AS (" + _SERIES_BODY + ")"))
def _(spark, sf):
    """The pieces of the map series, a day each, as a reader finds them."""
    rows = document_rows(chart(spark, sf), piece=12).filter("section = 'datasets'")
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + nm.round_even(x, 6))
    return rows.select("label", "kind", "part", F.size("data").cast("bigint").alias("points"), F.col("buckets")[0].alias("first_bucket"),
                       nm.round_even(total, 4).alias("total"))


_APPENDED = """
appended AS (SELECT map, contribution FROM contrib
             WHERE regexp_matches(map, '(?i)widget|ROD') AND map NOT IN (SELECT map FROM top_maps)),
shown AS (SELECT map, kind FROM top_maps UNION ALL SELECT map, 'appended' FROM appended)"""


@query("map_share_appended", sql(_SERIES_BODY, _APPENDED + "," + _SERIES))
def _(spark, sf):
    return _series(chart(spark, sf, append_maps_containing=("widget", "ROD")).map_series())


@query("appended_maps", sql("""
SELECT map, round_even(CAST(contribution AS DOUBLE), 6) AS contribution FROM appended""", _APPENDED))
def _(spark, sf):
    c = chart(spark, sf, append_maps_containing=("widget", "ROD"))
    return c.appended_maps().select("map", r6("contribution").alias("contribution"))


@query("map_share_filtered", sql("""
SELECT bucket, map, round_even(CAST(avg_players AS DOUBLE), 6) AS avg_players,
       round_even(CAST(avg_players AS DOUBLE) / coalesce(nullif(CAST(sum(avg_players) OVER (PARTITION BY bucket) AS DOUBLE), 0), 1) * 100, 6) AS share
FROM map_avg WHERE regexp_matches(map, '(?i)RING|ge_')"""))
def _(spark, sf):
    return chart(spark, sf, only_maps_containing=("RING", "ge_")).map_share().select(
        "bucket", "map", r6("avg_players").alias("avg_players"), r6("share").alias("share"))


def _totals_sql(where: str) -> str:
    return sql(f"""
SELECT p.bucket, round_even(coalesce(CAST(t.players AS DOUBLE) / b.snapshots, 0), 2) AS avg_total,
       coalesce(b.snapshots, 0) AS snapshots
FROM spine p LEFT JOIN per_bucket b ON b.bucket = p.bucket
LEFT JOIN (SELECT bucket, sum(players) AS players FROM cells WHERE {where} GROUP BY 1) t ON t.bucket = p.bucket""")


@query("server_filtered_totals", _totals_sql("ip = '10.0.0.7' AND port = 27018"))
def _(spark, sf):
    return chart(spark, sf, server_filter="10.0.0.7:27018").totals()


@query("server_name_filtered", _totals_sql(
    "EXISTS (SELECT 1 FROM server_names n WHERE n.ip = cells.ip AND n.port = cells.port "
    "AND regexp_matches(n.name, '(?i)customer#00000001|00007'))"))
def _(spark, sf):
    return chart(spark, sf, only_servers_containing=("customer#00000001", "00007")).totals()


@query("daily_totals", _totals_sql("true").replace(",\n       coalesce(b.snapshots, 0) AS snapshots", ""))
def _(spark, sf):
    return chart(spark, sf).daily_totals()


@query("snapshot_counts", sql("""
SELECT p.bucket, coalesce(snapshots, 0) AS snapshots FROM spine p LEFT JOIN per_bucket b ON b.bucket = p.bucket"""))
def _(spark, sf):
    return chart(spark, sf).snapshot_counts()


@query("gap_fill", all_days("""
SELECT m.map, p.bucket, coalesce(x.players, 0) AS players
FROM (SELECT DISTINCT map FROM map_avg) m CROSS JOIN spine p
LEFT JOIN map_avg x ON x.map = m.map AND x.bucket = p.bucket"""))
def _(spark, sf):
    return jn.gap_fill(whole_chart(spark, sf).map_avg(), ["map"], ["players"], FIRST, PAST)


@query("valid_buckets", sql("SELECT n AS valid_buckets FROM valid"))
def _(spark, sf):
    return ag.valid_buckets(chart(spark, sf).per_bucket)


@query("map_contribution", sql("""
SELECT map, round_even(CAST(contribution AS DOUBLE), 6) AS contribution FROM contrib"""))
def _(spark, sf):
    return ag.contribution(chart(spark, sf).map_avg()).select("map", r6("contribution").alias("contribution"))


_RANKING_BODY = """
SELECT label, round_even(CAST(c AS DOUBLE) / (SELECT CAST(sum(contribution) AS DOUBLE) FROM contrib) * 100, 2) AS pop, kind
FROM (SELECT coalesce(k.map, 'Other') AS label, coalesce(kind, 'other') AS kind, sum(contribution) AS c
      FROM contrib LEFT JOIN shown k ON k.map = contrib.map GROUP BY 1, 2)
WHERE kind <> 'other' OR c > 0"""


@query("map_ranking", sql(_RANKING_BODY, _APPENDED))
def _(spark, sf):
    return chart(spark, sf, append_maps_containing=("widget", "ROD")).map_ranking()


_TOP_SERVERS = "top_servers AS (SELECT server FROM srv_avg ORDER BY total DESC, server LIMIT 10)"


@query("server_series", sql("""
SELECT p.bucket, s.id, s.kind, round_even(CAST(coalesce(x.avg, 0) AS DOUBLE), 2) AS avg
FROM (SELECT DISTINCT id, kind FROM labelled) s CROSS JOIN spine p
LEFT JOIN (SELECT bucket, id, sum(avg_contrib) AS avg FROM labelled GROUP BY 1, 2) x
       ON x.bucket = p.bucket AND x.id = s.id""", _TOP_SERVERS + """,
labelled AS (SELECT bucket, coalesce(t.server, 'Other') AS id, CASE WHEN t.server IS NULL THEN 'other' ELSE 'top' END AS kind, avg_contrib
             FROM srv LEFT JOIN top_servers t ON t.server = srv.server)"""))
def _(spark, sf):
    return chart(spark, sf).server_series()


def _ranked_sql(averages: str, n: int) -> str:
    return f"""
top AS (SELECT server FROM {averages} ORDER BY total DESC, server LIMIT {n}),
summed AS (SELECT coalesce(t.server, 'Other') AS id, CASE WHEN t.server IS NULL THEN 'other' ELSE 'top' END AS kind,
                  sum(a.total) AS total
           FROM {averages} a LEFT JOIN top t ON t.server = a.server GROUP BY 1, 2),
ranked AS (SELECT id, round_even(CAST(total AS DOUBLE) / (SELECT n FROM valid), 2) AS pop, kind,
                  CAST(row_number() OVER (ORDER BY kind = 'other', total DESC, id) AS INTEGER) AS position
           FROM summed WHERE kind = 'top' OR total > 0)"""


@query("server_ranking", sql("SELECT * FROM ranked", _ranked_sql("srv_avg", 5)))
def _(spark, sf):
    return chart(spark, sf, top_servers=5).server_ranking()


@query("global_server_ranking", sql("SELECT * FROM ranked", _ranked_sql("srv_avg", 10)))
def _(spark, sf):
    return chart(spark, sf, only_maps_containing=("ring",)).global_server_ranking()


@query("server_labels", sql("""
SELECT s.ip || ':' || s.port AS id, coalesce(n.name, s.ip || ':' || s.port) AS label
FROM servers s LEFT JOIN server_names n ON n.ip = s.ip AND n.port = s.port"""))
def _(spark, sf):
    ids = b.servers(spark, sf).select(tx.endpoint(F.col("ip"), F.col("port")).alias("id"))
    return jn.resolve_labels(ids, b.server_names(spark, sf)).select("id", "label")


@query("maps_not_shown", all_days("SELECT map FROM contrib WHERE map NOT IN (SELECT map FROM top_maps)"))
def _(spark, sf):
    c = whole_chart(spark, sf)
    return st.difference(ag.contribution(c.map_avg()).select("map"), c.top_maps(), "map")


@query("share_of_total", all_days("""
SELECT bucket, server_id, players, round_even(CAST(players AS DOUBLE) /
       coalesce(nullif(CAST(sum(players) OVER (PARTITION BY bucket) AS DOUBLE), 0), 1) * 100, 6) AS share
FROM (SELECT bucket, server_id, CAST(sum(players) AS BIGINT) AS players FROM cells GROUP BY 1, 2)"""))
def _(spark, sf):
    per_server = ag.players_per(whole_chart(spark, sf).cells, "server_id")
    return wn.share_of_total(per_server, ["bucket"], "players").withColumn("share", r6("share"))


@query("aligned_ratio", all_days("""
SELECT coalesce(a.bucket, b.bucket) AS bucket, round_even(coalesce(CAST(a.players AS DOUBLE) / b.snapshots, 0), 6) AS ratio
FROM (SELECT bucket, sum(players) AS players FROM rollup_2h GROUP BY 1) a
FULL JOIN per_bucket b ON b.bucket = a.bucket"""))
def _(spark, sf):
    sums = ag.rollup_2h(b.samples(spark, sf)).groupBy("bucket").agg(F.sum("players").alias("players"))
    out = jn.aligned_ratio(sums, whole_chart(spark, sf).per_bucket, "bucket", "players", "snapshots")
    return out.select("bucket", r6("ratio").alias("ratio"))


@query("profile_fetch", sql("SELECT bucket, map, players FROM map_avg"))
def _(spark, sf):
    return profile.profile_fetch(b.facts(spark, sf), b.snaps(spark, sf), b.servers(spark, sf),
                                 b.maps(spark, sf), START, END)


@query("profile_sql", sql("SELECT bucket, map, players FROM map_avg"))
def _(spark, sf):
    return profile.profile_sql(b.facts(spark, sf), b.snaps(spark, sf), b.maps(spark, sf), START, END)


# ---- rollup -----------------------------------------------------------------------------------

@query("rollup_2h", sql("SELECT * FROM rollup_2h"))
def _(spark, sf):
    return ag.rollup_2h(b.samples(spark, sf))


@query("rollup_incremental", sql("SELECT * FROM rollup_2h"))
def _(spark, sf):
    """Two batches cut in the middle of a bucket and merged are the rollup of everything."""
    s, cut = b.samples(spark, sf), tm.ntz(MIDDLE + " 01:00:00")
    return ag.merge_rollup(ag.rollup_2h(s.filter(F.col("timestamp") < cut)),
                           ag.rollup_2h(s.filter(F.col("timestamp") >= cut)))


@query("rollup_merge_left", sql(f"""
SELECT d.bucket, d.server_id, d.map_id, CAST(d.players + coalesce(r.players, 0) AS BIGINT) AS players
FROM (SELECT time_bucket(INTERVAL '2 hours', timestamp) AS bucket, server_id, map_id, sum(players) AS players
      FROM samples WHERE timestamp >= '{MIDDLE} 01:00:00' GROUP BY 1, 2, 3) d
LEFT JOIN (SELECT time_bucket(INTERVAL '2 hours', timestamp) AS bucket, server_id, map_id, sum(players) AS players
           FROM samples WHERE timestamp < '{MIDDLE} 01:00:00' GROUP BY 1, 2, 3) r
  ON r.bucket = d.bucket AND r.server_id = d.server_id AND r.map_id = d.map_id"""))
def _(spark, sf):
    s, cut = b.samples(spark, sf), tm.ntz(MIDDLE + " 01:00:00")
    return jn.merge_left(ag.rollup_2h(s.filter(F.col("timestamp") >= cut)),
                         ag.rollup_2h(s.filter(F.col("timestamp") < cut)),
                         ["bucket", "server_id", "map_id"], "players")


@query("rollup_path_equal", all_days("""
SELECT bucket, map_id, CAST(sum(players) AS BIGINT) AS raw_players, CAST(sum(players) AS BIGINT) AS rollup_players
FROM cells GROUP BY 1, 2"""))
def _(spark, sf):
    """The same sums from raw samples and through the rollup."""
    raw = b.star(spark, sf, (FIRST, PAST))
    stored = raw.__class__(raw.snaps, raw.servers, raw.maps, raw.names, ag.rollup_2h(b.samples(spark, sf)))
    a = ag.players_per(raw.cells(FIRST, PAST), "map_id").withColumnRenamed("players", "raw_players")
    c = ag.players_per(stored.cells(FIRST, PAST), "map_id").withColumnRenamed("players", "rollup_players")
    return a.join(c, ["bucket", "map_id"], "full_outer")


@query("time_bucket_5h", """
SELECT time_bucket(INTERVAL '5 hours', ts) AS bucket, count(*) AS events FROM events GROUP BY 1""")
def _(spark, sf):
    e = b.events(spark, sf).select(tm.time_bucket("5 hours", F.col("ts")).alias("bucket"))
    return ag.count_rows(e, ["bucket"], "events")


@query("bucket_bounds", """
SELECT event_id, time_bucket(INTERVAL '2 hours', ts) AS low,
       CASE WHEN time_bucket(INTERVAL '2 hours', ts) = ts THEN ts
            ELSE time_bucket(INTERVAL '2 hours', ts) + INTERVAL '2 hours' END AS high FROM events""")
def _(spark, sf):
    e = b.events(spark, sf)
    low = e.select("event_id", "ts", tm.bucket_floor(F.col("ts")).alias("low"))
    return low.select("event_id", "low", tm.bucket_ceil(F.col("ts")).alias("high"))


@query("union_fact", sql(f"""
SELECT server_id, count(*) AS facts, CAST(sum(players) AS BIGINT) AS players FROM samples GROUP BY 1"""))
def _(spark, sf):
    """The older and the newer fact table read as one."""
    s = b.samples(spark, sf)
    old, new = s.filter(F.col("timestamp") < tm.ntz(MIDDLE)), s.filter(F.col("timestamp") >= tm.ntz(MIDDLE))
    return st.union_all(old, new).groupBy("server_id").agg(
        F.count(F.lit(1)).alias("facts"), F.sum("players").alias("players"))


# ---- metadata ---------------------------------------------------------------------------------

@query("freshness", sql("SELECT strftime(max(timestamp), '%Y-%m-%d-%H:%M:%S') AS latest_scan FROM snaps"))
def _(spark, sf):
    return ag.freshness(b.snaps(spark, sf))


@query("date_range", sql("""
SELECT strftime(min(timestamp), '%Y-%m-%d') AS min_date, strftime(max(timestamp), '%Y-%m-%d') AS max_date FROM snaps"""))
def _(spark, sf):
    return ag.date_range(b.snaps(spark, sf))


@query("status", sql("""
SELECT strftime(max(timestamp), '%Y-%m-%d-%H:%M:%S') AS latest_scan, strftime(min(timestamp), '%Y-%m-%d') AS min_date,
       strftime(max(timestamp), '%Y-%m-%d') AS max_date, count(*) = 0 AS empty FROM snaps"""))
def _(spark, sf):
    return metadata.status(b.snaps(spark, sf))


@query("table_counts", sql("""
SELECT 'samples' AS table_name, count(*) AS rows FROM samples UNION ALL SELECT 'snaps', count(*) FROM snaps
UNION ALL SELECT 'servers', count(*) FROM servers UNION ALL SELECT 'maps', count(*) FROM maps
UNION ALL SELECT 'server_names', count(*) FROM server_names"""))
def _(spark, sf):
    return ag.table_counts({"samples": b.samples(spark, sf), "snaps": b.snaps(spark, sf),
                            "servers": b.servers(spark, sf), "maps": b.maps(spark, sf),
                            "server_names": b.server_names(spark, sf)})


_RECENT = """
recent AS (SELECT DISTINCT ip, port FROM samples JOIN servers ON servers.id = server_id
           WHERE timestamp >= (SELECT max(timestamp) FROM snaps) - INTERVAL 7 DAY)"""


def _recent(spark, sf) -> DataFrame:
    snaps = b.snaps(spark, sf)
    newest = snaps.agg(F.max("timestamp").alias("t")).scalar()
    return metadata.recent_servers(b.facts(spark, sf), snaps, b.servers(spark, sf), tm.shift_days(newest, -7))


@query("recent_servers", sql("SELECT * FROM recent", _RECENT))
def _(spark, sf):
    return _recent(spark, sf)


@query("scan_targets", sql("""
SELECT ip, port FROM server_names UNION SELECT ip, port FROM recent""", _RECENT))
def _(spark, sf):
    """Named servers stand for the listed ones."""
    return metadata.scan_targets(b.server_names(spark, sf), _recent(spark, sf))


# ---- ingest -----------------------------------------------------------------------------------

def _raw(spark, sf) -> DataFrame:
    """Samples as landed: all text, two time formats, some ports and times that do not parse."""
    e = b.table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        b.server_ip(F.col("user_id")).alias("ip"),
        F.when(kind == "error", F.lit("port?")).when(kind != "signup", b.server_port(F.col("user_id")).cast("string"))
        .alias("port"),
        F.get_json_object("props", "$.k").alias("map"),
        F.when(kind != "view", F.floor("value").cast("string")).alias("players"),
        F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd-HH:mm:ss"))
        .when(F.col("value") > 400, F.concat(F.lit("on "), F.date_format("ts", "yyyy-MM-dd")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.col("event_id").cast("string").alias("guid"))


_RAW = """
raw AS (
  SELECT event_id, event_type, value, CAST(event_id AS VARCHAR) AS guid, date_trunc('second', ts) AS timestamp,
         '10.' || ((user_id >> 16) & 255) || '.' || ((user_id >> 8) & 255) || '.' || (user_id & 255) AS ip,
         CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(27015 + user_id % 4 AS INTEGER) END AS port,
         regexp_extract(props, '"k": ([0-9]+)', 1) AS map,
         CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS players
  FROM events),
good AS (SELECT * FROM raw WHERE event_type <> 'error' AND (event_type = 'click' OR value <= 400))"""


@query("parse_samples", sql("SELECT ip, port, map, players, timestamp, guid FROM good", _RAW))
def _(spark, sf):
    return rd.parse_samples(_raw(spark, sf))[0]


@query("rejected_samples", sql("SELECT guid FROM raw WHERE guid NOT IN (SELECT guid FROM good)", _RAW))
def _(spark, sf):
    return rd.parse_samples(_raw(spark, sf))[1].select("guid")


@query("normalize", sql("""
SELECT guid, players, timestamp FROM raw WHERE event_type <> 'click' AND value <= 400""", _RAW))
def _(spark, sf):
    """Only ISO times survive here; missing counts become 0."""
    return fl.normalize(_raw(spark, sf)).select("guid", F.col("players").cast("int").alias("players"), "timestamp")


@query("distinct_servers", sql("SELECT DISTINCT server_id, map_id FROM samples"))
def _(spark, sf):
    return ag.distinct_dims(b.samples(spark, sf), "server_id", "map_id")


@query("server_dim_country", sql("""
SELECT ip, port, max(country_code) AS country_code FROM samples JOIN servers ON servers.id = server_id GROUP BY 1, 2"""))
def _(spark, sf):
    s = b.samples(spark, sf).join(b.servers(spark, sf).withColumnRenamed("id", "server_id"), "server_id")
    return ag.server_dim(s)


@query("join_endpoint", sql("""
SELECT s.ip, s.port, s.country_code, n.name FROM servers s JOIN server_names n ON n.ip = s.ip AND n.port = s.port"""))
def _(spark, sf):
    return jn.join_endpoint(b.servers(spark, sf).drop("id"), b.server_names(spark, sf))


@query("insert_ignore", sql(f"""
SELECT guid, timestamp, CASE WHEN timestamp < '{MIDDLE}' THEN 'stored' ELSE 'new' END AS origin FROM snaps"""))
def _(spark, sf):
    """Snapshots of the first half are stored; all are sent again, twice: the first row of a key counts."""
    s = b.snaps(spark, sf).drop("id")
    stored = s.filter(F.col("timestamp") < tm.ntz(MIDDLE)).withColumn("origin", F.lit("stored"))
    new = s.withColumn("origin", F.lit("new")).withColumn("pos", F.lit(1))
    again = s.withColumn("origin", F.lit("again")).withColumn("pos", F.lit(2))
    return insert_ignored(stored, again.unionByName(new), ["guid"], "pos")


@query("upsert_replace", sql("""
SELECT id, ip, port, CASE WHEN c_acctbal >= 1000 THEN c_name ELSE 'unnamed' END AS name FROM servers"""))
def _(spark, sf):
    """Every server is stored unnamed; known names replace that, of two for a server the last one."""
    servers = b.servers(spark, sf)
    stored = servers.select("id", "ip", "port", F.lit("unnamed").alias("name"))
    new = jn.join_endpoint(servers, b.server_names(spark, sf)).select("id", "ip", "port", "name")
    early = new.withColumn("name", F.lit("early")).withColumn("pos", F.lit(1))
    return upserted(stored, new.withColumn("pos", F.lit(2)).unionByName(early), ["ip", "port"], "pos")


def _store(spark) -> Store:
    """Tables of their own in the folder that all machines share."""
    return Store(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}")


@query("store_upsert", sql("""
SELECT ip, port, CASE WHEN c_acctbal >= 1000 THEN c_name ELSE 'unnamed' END AS name FROM servers"""))
def _(spark, sf):
    """As upsert_replace, written to a table and read back."""
    store, at = _store(spark), tm.ntz(MIDDLE)
    servers = b.servers(spark, sf)
    store.append(servers.select("ip", "port", F.lit("unnamed").alias("name"), at.alias("updated_at")), "server_names", 0)
    named = b.server_names(spark, sf)
    new = named.select("ip", "port", "name", (at + F.expr("INTERVAL 2 HOURS")).alias("updated_at"))
    old = named.select("ip", "port", F.lit("early").alias("name"), (at + F.expr("INTERVAL 1 HOUR")).alias("updated_at"))
    store.upsert(new.unionByName(old), "server_names", "updated_at")
    return store.read("server_names").select("ip", "port", "name")


@query("rollup_backfill", sql("SELECT * FROM rollup_2h"))
def _(spark, sf):
    """Facts and snapshots are stored without a rollup, which is then made from them."""
    store, snaps = _store(spark), b.snaps(spark, sf)
    store.append(snaps, "snaps", 0)
    dated = b.facts(spark, sf).join(snaps.select(F.col("id").alias("snapshot_id"), "timestamp"), "snapshot_id")
    store.append(dated.withColumn("bucket_date", tm.time_bucket(tm.BUCKET, F.col("timestamp")).cast("date")), "facts", 0)
    ingest.backfill_rollup(store)
    return store.read("rollup_2h").drop("bucket_date")


@query("rollup_batches", sql("SELECT * FROM rollup_2h"))
def _(spark, sf):
    """The sink of the streaming rollup, given three batches whose rows come from any time; the second one is sent twice."""
    store, s = _store(spark), b.samples(spark, sf)
    write = cycle.rollup_into(store)
    for n, part in enumerate((2, 0, 1)):
        for _ in range(2 if n == 1 else 1):
            write(s.filter(F.pmod(F.hash("id"), F.lit(3)) == part), n)
    return store.read("rollup_2h").groupBy("bucket", "server_id", "map_id").agg(F.sum("players").alias("players"))


@query("block_list", sql("""
SELECT ip, auto_blocked FROM (SELECT ip, true AS auto_blocked FROM (
  SELECT ip, row_number() OVER (PARTITION BY ip ORDER BY timestamp, id) AS rn FROM classified WHERE threat_type IS NOT NULL)
WHERE rn = 3 AND ip NOT IN ('10.0.0.5', '10.0.0.7', '10.0.0.9') UNION ALL SELECT '10.0.0.7', false)"""))
def _(spark, sf):
    """A manual block, clients with three threats, and one that is unblocked again; an admin is never blocked."""
    blocks = BlockList(_store(spark), admins=["10.0.0.5"])
    blocks.block(["10.0.0.5", "10.0.0.7", " "])
    blocks.add_auto_blocks(b.requests(spark, sf))
    blocks.unblock(["10.0.0.9", "10.9.9.9"])
    return blocks.blocked().select("ip", "auto_blocked")


@query("store_insert_ignore", sql("SELECT guid, timestamp FROM snaps"))
def _(spark, sf):
    """Snapshots of the first half are stored; then all are sent, twice."""
    store, s = _store(spark), b.snaps(spark, sf)
    store.append(s.filter(F.col("timestamp") < tm.ntz(MIDDLE)), "snaps", 0)
    return store.insert_ignore(s.unionByName(s), "snaps", 1).select("guid", "timestamp")


@query("store_delete_keys", sql("SELECT ip, port, name FROM server_names WHERE ip NOT IN (SELECT ip FROM blocked)"))
def _(spark, sf):
    store, names = _store(spark), b.server_names(spark, sf)
    store.append(names.withColumn("updated_at", tm.ntz(MIDDLE)), "server_names", 0)
    store.delete_keys(names.join(_blocked(spark, sf), "ip", "left_semi"), "server_names")
    return store.read("server_names").select("ip", "port", "name")


@query("store_retention", sql("""
SELECT id, timestamp, ip FROM requests WHERE timestamp >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY"""))
def _(spark, sf):
    """As retention, written to a dated table and read back."""
    store = _store(spark)
    store.append(b.requests(spark, sf).withColumn("log_date", F.col("timestamp").cast("date")), "request_log", 0)
    newest = b.table(spark, sf, "events").agg(F.max("ts").alias("t")).scalar()
    store.retain("request_log", "timestamp", tm.shift_days(newest, -10))
    return store.read("request_log").select("id", "timestamp", "ip")


@query("store_compact", sql("SELECT bucket, server_id, map_id, players FROM rollup_2h"))
def _(spark, sf):
    """The rollup in three batches, cut inside a bucket and merged."""
    store, s = _store(spark), b.samples(spark, sf)
    cut = F.pmod(F.col("id"), F.lit(3))
    for k in range(3):
        part = ag.rollup_2h(s.filter(cut == k))
        store.append(part.withColumn("bucket_date", F.col("bucket").cast("date")), "rollup_2h", k)
    store.compact("rollup_2h")
    left = store.read("rollup_2h").groupBy("bucket", "server_id", "map_id")
    return left.agg(F.sum("players").alias("players"))


@query("upsert_latest", """
SELECT user_id, event_id, event_type, ts FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(spark, sf):
    e = b.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return wn.latest_per_key(e, ["user_id"], "ts", "event_id")


@query("delete_keys", sql("SELECT ip, port, name FROM server_names WHERE ip NOT IN (SELECT ip FROM blocked)"))
def _(spark, sf):
    return jn.anti(b.server_names(spark, sf), _blocked(spark, sf), ["ip"])


@query("retention", sql("""
SELECT id, timestamp, ip FROM requests WHERE timestamp >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY"""))
def _(spark, sf):
    newest = b.table(spark, sf, "events").agg(F.max("ts").alias("t")).scalar()
    return b.requests(spark, sf).filter(F.col("timestamp") >= tm.shift_days(newest, -10)).select(
        "id", "timestamp", "ip")


@query("wide_fetch", sql("""
SELECT ip, port, m.name AS map, CAST(players AS INTEGER) AS players, timestamp, country_code,
       strftime(timestamp, '%Y%m%d%H%M%S') AS snapshot_id
FROM samples JOIN servers s ON s.id = server_id JOIN maps m ON m.id = map_id"""))
def _(spark, sf):
    return jn.wide_fetch(b.facts(spark, sf), b.snaps(spark, sf), b.servers(spark, sf), b.maps(spark, sf))


@query("wide_to_star", sql("""
SELECT ip, port, m.name AS map, strftime(timestamp, '%Y%m%d%H%M%S') AS guid, CAST(players AS INTEGER) AS players
FROM samples JOIN servers s ON s.id = server_id JOIN maps m ON m.id = map_id"""))
def _(spark, sf):
    """Wide rows to dimensions and facts, and joined again: nothing is lost or doubled."""
    wide = jn.wide_fetch(b.facts(spark, sf), b.snaps(spark, sf), b.servers(spark, sf), b.maps(spark, sf))
    half = b.snaps(spark, sf).filter(F.col("timestamp") < tm.ntz(MIDDLE)).select(
        F.col("guid").alias("snapshot_id"), "timestamp")
    p = ingest.migrate_wide(wide, half)
    return jn.star_join(p["facts"], p["snaps"], p["servers"], p["maps"]).select(
        "ip", "port", "map", "guid", "players")


_PY_SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query("clean_names", rf"""
SELECT doc_id, md5(name) AS name_md5, length(name) AS name_length, md5(map) AS map_md5, length(map) AS map_length
FROM (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(text, '[\x{{2580}}-\x{{259F}}\x00-\x1F\x7F-\x{{9F}}]', '', 'g'), '^{_PY_SPACE}', ''), '{_PY_SPACE}$', '') AS name,
  regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F-\x{{9F}}]', '', 'g'), '^{_PY_SPACE}', ''), '{_PY_SPACE}$', '') AS map
  FROM documents)""")
def _(spark, sf):
    name, map_ = tx.clean_name(F.col("text")), tx.clean_map(F.col("text"))
    return b.table(spark, sf, "documents").select("doc_id", name.alias("n"), map_.alias("m")).select(
        "doc_id", F.md5("n").alias("name_md5"), F.length("n").cast("bigint").alias("name_length"),
        F.md5("m").alias("map_md5"), F.length("m").cast("bigint").alias("map_length"))


@query("name_changes", sql("""
SELECT s.ip, s.port, s.c_name AS name FROM servers s
LEFT JOIN (SELECT ip, port, CASE WHEN c_acctbal >= 5000 THEN c_name ELSE 'old ' || c_name END AS known
           FROM servers WHERE c_acctbal >= 1000) k ON k.ip = s.ip AND k.port = s.port
WHERE s.c_name <> '' AND s.c_name IS DISTINCT FROM k.known"""))
def _(spark, sf):
    """Some servers are known by their name, some by another one, some not at all."""
    c = b.table(spark, sf, "customer").join(b.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    new = c.select(b.server_ip(F.col("c_custkey")).alias("ip"), b.server_port(F.col("c_custkey")).alias("port"),
                   F.col("c_name").alias("name"), "c_acctbal")
    known = new.filter(F.col("c_acctbal") >= 1000).select(
        "ip", "port", F.when(F.col("c_acctbal") >= 5000, F.col("name"))
        .otherwise(F.concat(F.lit("old "), "name")).alias("name"))
    return fl.changed_names(new.drop("c_acctbal"), known)


@query("sample_rows", sql("""
SELECT ip, CAST(port AS VARCHAR) AS port, m.name AS map, CAST(players AS VARCHAR) AS players,
       strftime(timestamp, '%Y-%m-%d-%H:%M:%S') AS timestamp, c_name AS name,
       strftime(timestamp, '%Y%m%d%H%M%S') AS guid
FROM samples JOIN servers s ON s.id = server_id JOIN maps m ON m.id = map_id"""))
def _(spark, sf):
    """Probe answers with noise around map and server names, as rows to ingest."""
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("server_id"), "c_name",
                                              b.server_ip(F.col("c_custkey")).alias("ip"),
                                              b.server_port(F.col("c_custkey")).alias("port"))
    m = b.maps(spark, sf).select(F.col("id").alias("map_id"), F.col("name").alias("map"))
    info = b.samples(spark, sf).join(c, "server_id").join(m, "map_id").select(
        "ip", "port", F.concat(F.lit("\r\n "), "map", F.lit("\x07")).alias("map_name"),
        F.col("players").alias("player_count"),
        F.concat(F.lit("█ "), "c_name", F.lit(" ░")).alias("server_name"),
        F.col("timestamp").alias("snapshot_ts"))
    return fl.sample_rows(info)


@query("snapshot_ids", sql("SELECT guid, timestamp FROM snaps"))
def _(spark, sf):
    return b.snaps(spark, sf).select(tm.snapshot_id(F.col("timestamp")).alias("guid"), "timestamp")


# ---- discovery --------------------------------------------------------------------------------

def _addresses(spark, sf) -> DataFrame:
    """Addresses good and bad, one per event."""
    kind, key = F.col("event_type"), F.col("user_id")
    octet = (key % 256).cast("string")
    ip = (F.when(kind == "error", F.concat(F.lit("169.254.1."), octet))
          .when(kind == "signup", F.concat(F.lit("127.0.0."), octet))
          .when((kind == "click") & (F.col("value") < 50), F.lit("0.0.0.0"))
          .when((kind == "click") & (F.col("value") < 100), F.concat(octet, F.lit(".b.c.d")))
          .when((kind == "click") & (F.col("value") < 150), F.concat(F.lit("1.2."), octet))
          .when((kind == "click") & (F.col("value") < 200), F.concat(F.lit("300.1.1."), octet))
          .otherwise(F.concat(F.lit("10.0.0."), octet)))
    return b.table(spark, sf, "events").select("event_id", "event_type", "value", ip.alias("ip"))


_ADDRESSES = """
addresses AS (SELECT event_id, event_type, value, CASE
  WHEN event_type = 'error' THEN '169.254.1.' || user_id % 256 WHEN event_type = 'signup' THEN '127.0.0.' || user_id % 256
  WHEN event_type = 'click' AND value < 50 THEN '0.0.0.0' WHEN event_type = 'click' AND value < 100 THEN user_id % 256 || '.b.c.d'
  WHEN event_type = 'click' AND value < 150 THEN '1.2.' || user_id % 256 WHEN event_type = 'click' AND value < 200 THEN '300.1.1.' || user_id % 256
  ELSE '10.0.0.' || user_id % 256 END AS ip FROM events)"""


@query("public_ip_filter", sql("""
SELECT event_id, ip FROM addresses WHERE event_type NOT IN ('error', 'signup')
AND NOT (event_type = 'click' AND value < 150)""", _ADDRESSES))
def _(spark, sf):
    return fl.public_only(_addresses(spark, sf)).select("event_id", "ip")


@query("ip_country", sql("""
SELECT event_id, ip, CASE WHEN ip LIKE '10.0.0.%' THEN coalesce((SELECT n_name FROM nation
  WHERE n_nationkey = TRY_CAST(split_part(ip, '.', 4) AS INTEGER) // 10), 'N/A') ELSE 'N/A' END AS country_code
FROM addresses""", _ADDRESSES))
def _(spark, sf):
    return jn.ip_country(_addresses(spark, sf).select("event_id", "ip"), b.country_ranges(spark, sf))


def _listing(spark, sf, *also: str) -> DataFrame:
    """One landed list per customer: the own server, one with a bad port, and the terminator."""
    c = b.table(spark, sf, "customer")
    key = F.col("c_custkey")
    entry = lambda addr: F.struct(addr.alias("addr"), F.when(key % 3 == 0, F.lit(440)).otherwise(F.lit(10)).alias("appid"),
                                  F.when(F.col("c_acctbal") < 3000, F.lit("TF")).otherwise(F.lit("dod")).alias("gamedir"))
    own = F.concat(b.server_ip(key), F.lit(":"), b.server_port(key).cast("string"))
    doc = F.struct(F.struct(F.array(
        entry(own), entry(F.concat(b.server_ip(key), F.lit(":x1"))), entry(F.lit("0.0.0.0:0"))).alias("servers")).alias("response"))
    return c.select(F.col("c_mktsegment").alias("region"), F.to_json(doc).alias("json"), *also)


def _entries(spark, sf) -> DataFrame:
    parsed = _listing(spark, sf).select(
        "region", F.from_json("json", schemas.SERVER_LIST)["response"].alias("response"))
    return rd.server_entries(parsed)


_LISTED = """
listed AS (SELECT c_mktsegment AS region, s.ip, s.port FROM customer c JOIN servers s ON s.id = c_custkey
           WHERE c_custkey % 3 = 0 OR c.c_acctbal < 3000)"""


@query("server_list_flatten", sql("SELECT region, ip, port FROM listed", _LISTED))
def _(spark, sf):
    return rd.flatten_servers(_entries(spark, sf))


@query("server_list_rejects", """
SELECT c_mktsegment AS region, '{"response":{"server' || c_custkey AS raw FROM customer WHERE c_custkey % 7 = 0""")
def _(spark, sf):
    """Every seventh list was cut off when it landed."""
    cut = F.col("c_custkey") % 7 == 0
    whole = _listing(spark, sf, "c_custkey")
    docs = whole.select("region", F.when(cut, F.concat(F.substring("json", 1, 20), F.col("c_custkey").cast("string"))).otherwise(F.col("json")).alias("json"))
    return rd.parse_server_lists(docs)[1]


@query("server_list_union", sql("SELECT DISTINCT ip, port FROM listed UNION SELECT ip, port FROM server_names", _LISTED))
def _(spark, sf):
    return st.union_distinct(rd.flatten_servers(_entries(spark, sf)).select("ip", "port"),
                             b.server_names(spark, sf).select("ip", "port"))


@query("region_counts", sql("SELECT region, count(*) AS servers FROM listed GROUP BY 1", _LISTED))
def _(spark, sf):
    return ag.region_counts(rd.flatten_servers(_entries(spark, sf)))


@query("game_match", """
SELECT c_custkey, game, app, (app = coalesce(appid, 0)) OR (lower(coalesce(gamedir, '')) = 'tf') AS matches
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 440 WHEN c_custkey % 3 = 1 THEN 10 END AS appid,
             CASE WHEN c_acctbal < 3000 THEN 'TF' WHEN c_acctbal < 6000 THEN 'dod' END AS gamedir,
             lower(c_mktsegment) AS game, 440 AS app FROM customer)""")
def _(spark, sf):
    key, funds = F.col("c_custkey"), F.col("c_acctbal")
    c = b.table(spark, sf, "customer").select(
        "c_custkey", F.when(key % 3 == 0, 440).when(key % 3 == 1, 10).alias("appid"),
        F.when(funds < 3000, "TF").when(funds < 6000, "dod").alias("gamedir"), F.lower("c_mktsegment").alias("game"))
    return c.select("c_custkey", "game", idn.app_id(F.col("game")).alias("app"),
                    fl.matches_game(F.col("appid"), F.col("gamedir"), "tf").alias("matches"))


def _stream(spark, sf) -> DataFrame:
    """Addresses in the order of a listing; customers come by again and again in the orders."""
    return b.table(spark, sf, "orders").select(
        b.server_ip(F.col("o_custkey")).alias("ip"), b.server_port(F.col("o_custkey")).alias("port"),
        (F.col("o_custkey") % 8).cast("int").alias("region_code"), F.col("o_orderkey").alias("position"))


_STREAM = """
listing AS (SELECT '10.' || ((o_custkey >> 16) & 255) || '.' || ((o_custkey >> 8) & 255) || '.' || (o_custkey & 255) AS ip,
                   CAST(27015 + o_custkey % 4 AS INTEGER) AS port, CAST(o_custkey % 8 AS INTEGER) AS region_code,
                   o_orderkey AS position FROM orders),
numbered AS (SELECT *, row_number() OVER (PARTITION BY ip, port ORDER BY position) AS rn FROM listing)"""


@query("dedupe_keep", sql("SELECT ip, port, region_code, position FROM listing", _STREAM))
def _(spark, sf):
    return discovery.find(_stream(spark, sf), "all", "keep")


@query("dedupe_skip", sql("SELECT ip, port, region_code, position FROM numbered WHERE rn = 1", _STREAM))
def _(spark, sf):
    return discovery.find(_stream(spark, sf), "ALL", "skip")


@query("dedupe_stop", sql("""
SELECT ip, port, region_code, position FROM numbered
WHERE position < (SELECT min(position) FROM numbered WHERE rn > 1)""", _STREAM))
def _(spark, sf):
    return discovery.find(_stream(spark, sf), "all", "stop")


@query("find_region", sql("""
SELECT ip, port, region_code, position FROM numbered WHERE rn = 1 AND region_code IN (4, 6)""", _STREAM))
def _(spark, sf):
    return discovery.find(_stream(spark, sf), "as", "skip")


# ---- requests ---------------------------------------------------------------------------------

def _blocked(spark, sf) -> DataFrame:
    return b.servers(spark, sf).filter(F.col("country_code") == "NATION_7").select("ip")


def _today(spark, sf) -> DataFrame:
    return rq.of_day(b.requests(spark, sf), DAY)


@query("request_totals", sql("SELECT count(*) AS total_requests, count(DISTINCT ip) AS unique_ips FROM today"))
def _(spark, sf):
    return rq.request_totals(_today(spark, sf))


@query("request_endpoints", sql("SELECT ip, endpoint, count(*) AS requests FROM today GROUP BY 1, 2"))
def _(spark, sf):
    return rq.requests_per_endpoint(_today(spark, sf))


@query("request_top_ips", sql("""
SELECT ip, count(*) AS total_requests FROM today GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def _(spark, sf):
    return rk.page(rq.requests_per_ip(_today(spark, sf)), [F.col("total_requests").desc(), F.col("ip").asc()], 1, 20)


_PAGE = """
page AS (SELECT ip, count(*) AS total_requests FROM today GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 10)"""


@query("request_late_page", sql("""
SELECT ip, count(*) AS total_requests FROM requests GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7 OFFSET 77"""))
def _(spark, sf):
    """The twelfth page of clients of the whole log, found without sorting the eleven before it."""
    return rk.seek_page(rq.requests_per_ip(b.requests(spark, sf)), "total_requests", "ip", 12, 7)


@query("request_page", sql("""
SELECT p.ip, p.total_requests, r.recent, coalesce(t.threat_count, 0) AS threat_count,
       coalesce(t.threat_types, '') AS threat_types, p.ip IN (SELECT ip FROM blocked) AS is_blocked
FROM page p
LEFT JOIN (SELECT ip, string_agg(strftime(timestamp, '%H:%M:%S') || ' ' || full_path, ',' ORDER BY rn) AS recent
           FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY timestamp DESC, id DESC) AS rn FROM today)
           WHERE rn <= 20 GROUP BY 1) r ON r.ip = p.ip
LEFT JOIN (SELECT ip, count(*) AS threat_count, string_agg(DISTINCT threat_type, ',' ORDER BY threat_type) AS threat_types
           FROM today WHERE threat_type IS NOT NULL GROUP BY 1) t ON t.ip = p.ip""", _PAGE))
def _(spark, sf):
    page = request_page(b.requests(spark, sf), _blocked(spark, sf), StatsParams(page=2, limit=10, day=DAY))
    return page.select(
        "ip", "total_requests",
        F.array_join(F.transform("recent_requests", lambda r: F.concat_ws(" ", r["time"], r["full_path"])), ",")
        .alias("recent"),
        "threat_count", F.array_join("threat_types", ",").alias("threat_types"), "is_blocked")


@query("request_page_endpoints", sql("""
SELECT ip, endpoint, count(*) AS requests FROM today WHERE ip IN (SELECT ip FROM page) GROUP BY 1, 2""", _PAGE))
def _(spark, sf):
    return page_endpoints(b.requests(spark, sf), StatsParams(page=2, limit=10, day=DAY))


@query("request_recent20", sql("""
SELECT ip, id, timestamp, CAST(rn AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY timestamp DESC, id DESC) AS rn FROM requests) WHERE rn <= 20"""))
def _(spark, sf):
    return rq.recent_requests(b.requests(spark, sf)).select("ip", "id", "timestamp", "position")


@query("latest_requests", sql("SELECT id, timestamp, ip FROM requests ORDER BY timestamp DESC, id DESC LIMIT 20"))
def _(spark, sf):
    return rk.latest(b.requests(spark, sf).select("id", "timestamp", "ip"), "timestamp", "id")


@query("path_normalize", sql("""
SELECT id, url_decode(full_path || '+%zz%C3%A9') AS decoded, regexp_replace(full_path || '?', '\\?$', '') AS path FROM requests"""))
def _(spark, sf):
    p = F.col("full_path")
    return b.requests(spark, sf).select(
        "id", tx.percent_decode(F.concat(p, F.lit("+%zz%C3%A9"))).alias("decoded"),
        tx.strip_qmark(F.concat(p, F.lit("?"))).alias("path"))


@query("threat_classify", sql("SELECT id, full_path, threat_type FROM classified"))
def _(spark, sf):
    return rq.with_threats(b.requests(spark, sf)).select("id", "full_path", "threat_type")


@query("threat_summary", sql("""
SELECT ip, count(*) AS threat_count, string_agg(DISTINCT threat_type, ',' ORDER BY threat_type) AS threat_types
FROM classified WHERE threat_type IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return rq.threat_summary(b.requests(spark, sf)).withColumn("threat_types", F.array_join("threat_types", ","))


@query("threat_running_count", sql("""
SELECT id, ip, count(threat_type) OVER (PARTITION BY ip ORDER BY timestamp, id) AS threats_so_far FROM classified"""))
def _(spark, sf):
    return rq.running_threats(b.requests(spark, sf)).select("id", "ip", "threats_so_far")


@query("auto_block", sql("""
SELECT ip, 'Auto-blocked: ' || threat_type || ' (detected 3 threats)' AS reason, timestamp AS blocked_at, true AS auto_blocked
FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY timestamp, id) AS rn FROM classified
      WHERE threat_type IS NOT NULL)
WHERE rn = 3 AND ip NOT IN (SELECT ip FROM blocked) AND ip <> '10.0.0.5'"""))
def _(spark, sf):
    return rq.auto_blocks(b.requests(spark, sf), _blocked(spark, sf), admins=["10.0.0.5"])


@query("blocked_join", sql("SELECT id, ip, ip IN (SELECT ip FROM blocked) AS is_blocked FROM requests"))
def _(spark, sf):
    return jn.flag_blocked(b.requests(spark, sf).select("id", "ip"), _blocked(spark, sf))


_HALF_DAY = 12 * 3600


@query("rate_window_count", sql(f"""
SELECT id, ip, count(*) OVER (PARTITION BY ip ORDER BY epoch_us(timestamp)
                              RANGE BETWEEN {_HALF_DAY * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS requests_in_window
FROM requests"""))
def _(spark, sf):
    log = b.requests(spark, sf).select("id", "ip", "timestamp")
    return wn.window_count(log, "ip", "timestamp", seconds=_HALF_DAY).drop("timestamp")


_SEQ = """
seq AS (SELECT id, ip, epoch_us(timestamp) AS us, threat_type,
               row_number() OVER (PARTITION BY ip ORDER BY timestamp, id) AS rn FROM classified)"""


@query("rate_limit_exact", sql(f"""
SELECT ip, id, accepted, CASE WHEN accepted THEN CAST(3 - len(win) AS INTEGER) ELSE 0 END AS remaining FROM run""", _SEQ + f""",
run AS (
  SELECT ip, id, rn, true AS accepted, [us] AS win FROM seq WHERE rn = 1
  UNION ALL
  SELECT ip, id, rn, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END
  FROM (SELECT s.ip, s.id, s.rn, s.us, list_filter(r.win, lambda x: x > s.us - {_HALF_DAY * 1_000_000}) AS kept
        FROM run r JOIN seq s ON s.ip = r.ip AND s.rn = r.rn + 1))""", recursive=True))
def _(spark, sf):
    log = b.table(spark, sf, "events").select(
        F.col("event_id").alias("tie"), "ts", b.server_ip(F.col("user_id")).alias("ip"))
    done = state.rate_limit(log, limit=3, seconds=_HALF_DAY)
    return done.select("ip", F.col("tie").alias("id"), "accepted", "remaining")


@query("request_admission", sql("SELECT id, ip, decision, threats FROM run", _SEQ + f""",
run AS (
  SELECT ip, id, rn, CASE WHEN b THEN 'blocked' ELSE 'accepted' END AS decision,
         CAST(t AS BIGINT) AS threats, b AS is_blocked, CASE WHEN b THEN [] ELSE [us] END AS win
  FROM (SELECT *, ip IN (SELECT ip FROM blocked) AS b,
               CASE WHEN ip IN (SELECT ip FROM blocked) OR threat_type IS NULL THEN 0 ELSE 1 END AS t FROM seq WHERE rn = 1)
  UNION ALL
  SELECT ip, id, rn, CASE WHEN b THEN 'blocked' WHEN len(kept) < 3 THEN 'accepted' ELSE 'limited' END, t, b,
         CASE WHEN b THEN win WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END
  FROM (SELECT ip, id, rn, us, win, t, was_blocked OR (is_threat AND t >= 3 AND ip <> '10.0.0.5') AS b,
               list_filter(win, lambda x: x > us - {_HALF_DAY * 1_000_000}) AS kept
        FROM (SELECT s.ip, s.id, s.rn, s.us, r.win, r.is_blocked AS was_blocked, s.threat_type IS NOT NULL AS is_threat,
                     r.threats + CASE WHEN s.threat_type IS NULL OR r.is_blocked THEN 0 ELSE 1 END AS t
              FROM run r JOIN seq s ON s.ip = r.ip AND s.rn = r.rn + 1)))""", recursive=True))
def _(spark, sf):
    log = b.requests(spark, sf).select(F.col("id").alias("tie"), F.col("timestamp").alias("ts"), "ip", "full_path")
    done = state.admit(log, _blocked(spark, sf), admins=["10.0.0.5"], limit=3, seconds=_HALF_DAY)
    return done.select(F.col("tie").alias("id"), "ip", "decision", "threats")


@query("late_requests", sql(f"""
SELECT ip, id, accepted FROM run WHERE late""", f"""
arrivals AS (SELECT id, ip, epoch_us(timestamp) AS us, (id * 7919 % 100003) // 2000 AS batch FROM requests),
newest AS (SELECT ip, batch, max(max(us)) OVER (PARTITION BY ip ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
           FROM arrivals GROUP BY ip, batch),
lseq AS (SELECT a.id, a.ip, a.us, coalesce(a.us < n.seen, false) AS late,
                row_number() OVER (PARTITION BY a.ip ORDER BY a.us, coalesce(a.us < n.seen, false), a.id) AS rn
         FROM arrivals a JOIN newest n ON n.ip = a.ip AND n.batch = a.batch),
run AS (
  SELECT ip, id, rn, late, true AS accepted, [us] AS win FROM lseq WHERE rn = 1
  UNION ALL
  SELECT ip, id, rn, late, NOT late OR len(kept) < 3, CASE WHEN NOT late OR len(kept) < 3 THEN list_append(kept, us) ELSE kept END
  FROM (SELECT s.ip, s.id, s.rn, s.us, s.late, list_filter(r.win, lambda x: x > s.us - {_HALF_DAY * 1_000_000}) AS kept
        FROM run r JOIN lseq s ON s.ip = r.ip AND s.rn = r.rn + 1))""", recursive=True))
def _(spark, sf):
    """Requests arrive in another order than they were made; the late ones are decided beside those already accepted."""
    batch = F.floor((F.col("event_id") * 7919 % 100003) / 2000)
    log = b.table(spark, sf, "events").select(F.col("event_id").alias("tie"), b.server_ip(F.col("user_id")).alias("ip"),
                                              tm.epoch_micros(F.col("ts")).alias("now_us"), batch.alias("batch"))
    told = state.late_rows(log, "ip", "now_us", "batch")
    done = state.decide_late(told.filter("late"), told.filter("NOT late"), limit=3, seconds=_HALF_DAY)
    return done.select("ip", F.col("tie").alias("id"), "accepted")


# ---- back-off ---------------------------------------------------------------------------------

_PROBES = """
pseq AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS now, event_type <> 'error' AS ok,
                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
steps AS (
  SELECT user_id, event_id, rn, now, ok, true AS probed, CASE WHEN ok THEN 2.0 * CAST(0.9 AS DOUBLE) ELSE CAST(4 AS DOUBLE) END AS timeout,
         CASE WHEN ok THEN 0 ELSE 1 END AS failures, CASE WHEN ok THEN CAST(0 AS DOUBLE) ELSE now + 60 END AS skip_until
  FROM pseq WHERE rn = 1
  UNION ALL
  SELECT s.user_id, s.event_id, s.rn, s.now, s.ok, s.now >= r.skip_until,
         CASE WHEN s.now < r.skip_until THEN r.timeout WHEN s.ok THEN greatest(CAST(0.1 AS DOUBLE), r.timeout * CAST(0.9 AS DOUBLE))
              ELSE least(CAST(5 AS DOUBLE), r.timeout * 2) END,
         CASE WHEN s.now < r.skip_until THEN r.failures WHEN s.ok THEN 0 ELSE r.failures + 1 END,
         CASE WHEN s.now < r.skip_until THEN r.skip_until WHEN s.ok THEN 0
              ELSE s.now + least(600, 60 * pow(2, r.failures)) END
  FROM steps r JOIN pseq s ON s.user_id = r.user_id AND s.rn = r.rn + 1)"""


@query("cooldown_steps", sql("""
SELECT event_id, probed, round_even(timeout, 6) AS timeout, failures, round_even(skip_until, 3) AS skip_until FROM steps""",
                             _PROBES, recursive=True))
def _(spark, sf):
    return state.cooldown_steps(b.probes(spark, sf)).select(
        F.col("tie").alias("event_id"), "probed", r6("timeout").alias("timeout"), "failures",
        nm.round_even(F.col("skip_until"), 3).alias("skip_until"))


@query("cooldown_state", sql("""
SELECT '10.' || ((user_id >> 16) & 255) || '.' || ((user_id >> 8) & 255) || '.' || (user_id & 255) AS ip,
       CAST(27015 + user_id % 4 AS INTEGER) AS port, round_even(timeout, 6) AS timeout, failures
FROM steps QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1""", _PROBES, recursive=True))
def _(spark, sf):
    done = state.cooldown_state(state.cooldown_steps(b.probes(spark, sf)))
    return done.select("ip", "port", r6("timeout").alias("timeout"), "failures")


@query("state_lookup", sql("""
SELECT event_id, CAST(CASE WHEN known THEN 4 ELSE 2 END AS DOUBLE) AS timeout, CASE WHEN known THEN 4 ELSE 0 END AS failures
FROM (SELECT event_id, ts, s.c_acctbal >= 1000 AS known FROM events JOIN servers s ON s.id = user_id)
WHERE NOT known OR ts >= '2024-01-20'"""))
def _(spark, sf):
    """Named servers are in back-off until a fixed time; the rest starts with the defaults."""
    until = F.unix_timestamp(F.lit("2024-01-20 00:00:00")).cast("double")
    stored = b.server_names(spark, sf).select("ip", "port", F.lit(4.0).alias("timeout"), F.lit(9).alias("failures"),
                                              until.alias("skip_until"))
    looked_up = jn.with_state(b.probes(spark, sf), state.load_cooldowns(stored))
    now = tm.epoch_micros(F.col("ts")) / F.lit(1e6)
    return fl.not_cooling(looked_up, now).select(F.col("tie").alias("event_id"), "timeout", "failures")


@query("cycle_metrics", sql("""
SELECT (SELECT count(*) FROM addresses) AS listed,
       (SELECT count(*) FROM addresses WHERE event_type IN ('error', 'signup') OR (event_type = 'click' AND value < 150)) AS filtered,
       (SELECT count(*) FROM steps WHERE NOT probed) AS skipped,
       (SELECT count(*) FROM steps WHERE probed AND ok) AS answered""", _ADDRESSES + "," + _PROBES, recursive=True))
def _(spark, sf):
    return ingest.cycle_metrics(_addresses(spark, sf), state.cooldown_steps(b.probes(spark, sf)))


# ---- records ----------------------------------------------------------------------------------

@query("fragment_reassembly", """
SELECT conv_id AS message_id, count(*) AS parts, string_agg(text, '' ORDER BY turn) AS payload FROM conversations
GROUP BY 1 HAVING count(*) = max(turn) + 1""")
def _(spark, sf):
    """Conversations as messages; every fragment arrives twice."""
    c = b.table(spark, sf, "conversations")
    n = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("fragment_count"))
    f = c.join(n, "conv_id").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("fragment_id"),
                                    "fragment_count", F.col("text").alias("payload"))
    return rec.reassemble(st.union_all(f, f))


@query("fragment_rejects", """
SELECT conv_id AS message_id, turn AS fragment_id FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn >= n""")
def _(spark, sf):
    """Each message says that it has one fragment fewer than were sent."""
    c = b.table(spark, sf, "conversations")
    n = c.groupBy("conv_id").agg(F.max("turn").alias("fragment_count"))
    f = c.join(n, "conv_id").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("fragment_id"), "fragment_count")
    return rec.fragment_rejects(f).select("message_id", "fragment_id")


@query("named_player_count", """
SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS named_players,
       CAST(len(embedding) AS INTEGER) AS listed_players FROM embeddings""")
def _(spark, sf):
    """Vector components as players; those without a positive score have no name."""
    player = lambda x, i: F.struct(
        i.cast("int").alias("index"), F.when(x > 0, F.concat(F.lit("p"), i.cast("string"))).otherwise("").alias("name"),
        F.floor(x * 100).cast("int").alias("score"), x.alias("duration"))
    e = b.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", player).cast(schemas.PLAYERS).alias("players"))
    return e.select("vec_id", rec.named_player_count(F.col("players")).alias("named_players"),
                    F.size("players").alias("listed_players"))


_INFO_CODES = """
codes AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 76 WHEN 1 THEN 108 WHEN 2 THEN 109 WHEN 3 THEN 111 WHEN 4 THEN 119 ELSE 68 END AS code,
                 p_size FROM part)"""


def _codes(spark, sf) -> DataFrame:
    s = F.col("p_size") % 6
    code = F.when(s == 0, 76).when(s == 1, 108).when(s == 2, 109).when(s == 3, 111).when(s == 4, 119).otherwise(68)
    return b.table(spark, sf, "part").select("p_partkey", "p_size", code.alias("code"))


@query("platform_map", sql("""
SELECT p_partkey, CASE WHEN code IN (76, 108) THEN 'Linux' WHEN code IN (109, 111) THEN 'Mac OS X' WHEN code = 119 THEN 'Windows' END AS platform,
       CASE WHEN code = 119 THEN 'nt' WHEN code <> 68 THEN 'posix' END AS os_name,
       CASE code WHEN 68 THEN 'Dedicated' WHEN 108 THEN 'Non-Dedicated' END AS server_type,
       CASE WHEN code = 111 THEN 'm' ELSE lower(chr(code)) END AS letter FROM codes""", _INFO_CODES))
def _(spark, sf):
    code = F.col("code")
    return _codes(spark, sf).select(
        "p_partkey", idn.platform_name(code).alias("platform"), idn.os_name(code).alias("os_name"),
        idn.server_type_name(F.chr(code)).alias("server_type"), idn.platform_letter(F.chr(code)).alias("letter"))


@query("steam_id_64", f"""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 76561197960265728 + c_custkey * 2 + c_custkey % 2 END AS id64,
       CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE '[U:1:' || (c_custkey * 2 + c_custkey % 2) || ']' END AS id32,
       CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 'STEAM_0:' || c_custkey % 2 || ':' || c_custkey END AS text,
       103582791429521408 + c_custkey * 2 + c_custkey % 2 AS group64 FROM customer""")
def _(spark, sf):
    """Accounts by text, one in five out of range, and groups by address."""
    key = F.col("c_custkey")
    y = F.when(key % 5 == 4, 2).otherwise(key % 2).cast("string")
    text = F.concat(F.lit("STEAM_0:"), y, F.lit(":"), key.cast("string"))
    url = F.concat(F.lit("http://steamcommunity.com/groups/[g:1:"), (key * 2 + key % 2).cast("string"), F.lit("]?l=en"))
    c = b.table(spark, sf, "customer").select("c_custkey", idn.account_from_text(text).alias("a"),
                                              idn.account_from_url(url).alias("g"))
    c = c.withColumn("url", idn.community_url(F.col("a"))).withColumn("back", idn.account_from_url(F.col("url")))
    return c.select("c_custkey", idn.steam_id64(F.col("a")).alias("id64"), idn.steam_id32(F.col("a")).alias("id32"),
                    idn.steam_text(F.col("back")).alias("text"), idn.steam_id64(F.col("g")).alias("group64"))


@query("cvar_rows", """
SELECT p_partkey, replace(p_name, ' ', '_') AS name, CAST(p_size AS VARCHAR) AS value, 'a,' || lower(p_type) AS flags, p_brand || ': of ' || p_type AS description FROM part
UNION ALL SELECT p_partkey, 'price', CAST(p_partkey AS VARCHAR), '', p_brand FROM part""")
def _(spark, sf):
    """Each part as a landed listing of two variables."""
    p, nl = b.table(spark, sf, "part"), F.lit("\n")
    text = F.concat(
        F.lit("cvar list\n--------------\n"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("  : "),
        F.col("p_size").cast("string"), F.lit(' : , "a", "'), F.lower("p_type"), F.lit('", "a" : '), F.col("p_brand"),
        F.lit(": of "), F.col("p_type"), nl, F.lit("price : "), F.col("p_partkey").cast("string"), F.lit(" :   : "),
        F.col("p_brand"), nl, F.lit("--------------\n  2 total\n"))
    return rec.cvar_rows(p.select("p_partkey", text.alias("text"))).withColumn("flags", F.array_join("flags", ","))


@query("cvar_rejects", "SELECT p_partkey, 'size ' || p_size AS line FROM part")
def _(spark, sf):
    """Each part as a listing of a variable, a line without colons and a blank one."""
    p, nl = b.table(spark, sf, "part"), F.lit("\n")
    text = F.concat(F.lit("--\nprice : "), F.col("p_partkey").cast("string"), F.lit(" : : x"), nl, F.lit("size "),
                    F.col("p_size").cast("string"), nl, nl, F.lit("--\n"))
    return rec.cvar_rejects(p.select("p_partkey", text.alias("text")))


@query("rules_map", """
SELECT l_orderkey, l_returnflag || l_linestatus AS name, CAST(l_partkey AS VARCHAR) AS value FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, name ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1""")
def _(spark, sf):
    pairs = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_partkey").cast("string").alias("value"))
    rules = rec.rules_map(pairs, "l_orderkey", "l_linenumber", "name", "value", "l_partkey", "l_suppkey")
    return rules.select("l_orderkey", F.explode("rules").alias("name", "value"))


@query("edf_flags", """
SELECT p_partkey, (e & 128) <> 0 AS has_port, (e & 16) <> 0 AS has_steam_id, (e & 64) <> 0 AS has_stv,
       (e & 32) <> 0 AS has_keywords, (e & 1) <> 0 AS has_game_id FROM (SELECT p_partkey, CAST((p_partkey * 37) % 256 AS INTEGER) AS e FROM part)""")
def _(spark, sf):
    flags = idn.edf_flags((F.col("p_partkey") * 37) % 256)
    return b.table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in flags.items()])


@query("info_unify", """
SELECT s_name AS server_name, CAST(s_nationkey AS INTEGER) AS player_count, 440 AS app_id, NULL AS address FROM supplier
UNION ALL SELECT c_name, CAST(c_nationkey AS INTEGER), NULL, '10.0.0.1:' || c_custkey FROM customer""")
def _(spark, sf):
    newer = b.table(spark, sf, "supplier").select(
        F.col("s_name").alias("server_name"), F.col("s_nationkey").cast("int").alias("player_count"), F.lit(440).alias("app_id"))
    legacy = b.table(spark, sf, "customer").select(
        F.col("c_name").alias("server_name"), F.col("c_nationkey").cast("int").alias("player_count"),
        F.concat(F.lit("10.0.0.1:"), F.col("c_custkey").cast("string")).alias("address"))
    return st.unify_info(newer, legacy)


@query("null_defaults", """
SELECT c_custkey, CASE WHEN x IS NULL OR x = 0 THEN 1 ELSE x END AS denominator,
       round_even(coalesce(c_acctbal, 0) / CASE WHEN x IS NULL OR x = 0 THEN 1 ELSE x END, 2) AS ratio
FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey % 4 END AS x FROM customer)""")
def _(spark, sf):
    n = F.col("c_nationkey")
    x = F.when(n < 5, F.lit(None)).otherwise(n % 4).cast("int")
    c = b.table(spark, sf, "customer").select("c_custkey", "c_acctbal", x.alias("x"))
    return c.select("c_custkey", nm.default_zero(F.col("x"), 1).alias("denominator"),
                    nm.round_even(nm.nan_to_zero(nm.ratio(F.col("c_acctbal"), F.col("x"))), 2).alias("ratio"))
