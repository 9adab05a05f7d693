"""The star schema and the request log read from the test tables.

``events`` stands for samples and requests, ``customer`` for servers, ``part`` for maps and
``pages`` for requested paths. Every view covers its whole table.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import time as tm
from tidemark.plans.star import Star
from tidemark.schemas import flat_schema


# Given, so that opening a table reads no footer and runs no job.
TABLES = {
    "nation": flat_schema("n_nationkey INT, n_name STRING, n_regionkey INT"),
    "customer": flat_schema("c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"),
    "supplier": flat_schema("s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"),
    "part": flat_schema("p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"),
    "orders": flat_schema("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                          "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": flat_schema("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                            "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                            "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
    "events": flat_schema("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"),
    "documents": flat_schema("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"),
    "pages": flat_schema("page_id BIGINT, url STRING, html STRING"),
    "conversations": flat_schema("conv_id BIGINT, turn BIGINT, role STRING, text STRING"),
    "embeddings": T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                                T.StructField("label", T.IntegerType())]),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def server_ip(key: Column) -> Column:
    octet = lambda shift: F.shiftright(key, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", F.lit("10"), octet(16), octet(8), octet(0))


def server_port(key: Column) -> Column:
    return (F.lit(27015) + key % 4).cast("int")


def events(spark: SparkSession, sf: str, window: tuple | None = None) -> DataFrame:
    """Events, those of a window on the snapshot grid if one is given: the filter reaches the scan."""
    e = table(spark, sf, "events")
    return e if window is None else e.filter(tm.in_window(F.col("ts"), *window))


def samples(spark: SparkSession, sf: str, window: tuple | None = None) -> DataFrame:
    """(id, timestamp, server_id, map_id, players): the time is that of the five-minute snapshot."""
    return events(spark, sf, window).select(
        F.col("event_id").alias("id"), tm.time_bucket("5 minutes", F.col("ts")).alias("timestamp"),
        F.col("user_id").alias("server_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("map_id"),
        F.floor("value").cast("bigint").alias("players"))


def snaps(spark: SparkSession, sf: str, window: tuple | None = None) -> DataFrame:
    t = events(spark, sf, window).select(
        tm.time_bucket("5 minutes", F.col("ts")).alias("timestamp")).distinct()
    guid = tm.format_ts(F.col("timestamp"), tm.GUID_FORMAT)
    return t.select(guid.cast("bigint").alias("id"), guid.alias("guid"), "timestamp")


def servers(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer")
    return c.join(nation, c.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("id"), server_ip(F.col("c_custkey")).alias("ip"),
        server_port(F.col("c_custkey")).alias("port"), F.col("n_name").alias("country_code"))


def server_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the servers whose owner has funds; the others stay nameless."""
    c = table(spark, sf, "customer").filter(F.col("c_acctbal") >= 1000)
    return c.select(server_ip(F.col("c_custkey")).alias("ip"), server_port(F.col("c_custkey")).alias("port"),
                    F.col("c_name").alias("name"))


def maps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
        .alias("name"))


def star(spark: SparkSession, sf: str, window: tuple | None = None) -> Star:
    raw = Star.from_samples(samples(spark, sf, window), snaps(spark, sf, window), servers(spark, sf),
                            maps(spark, sf), server_names(spark, sf))
    return replace(raw, window=window)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that refer to their snapshot by id, as stored."""
    s = samples(spark, sf)
    return s.select(tm.format_ts(F.col("timestamp"), tm.GUID_FORMAT).cast("bigint").alias("snapshot_id"),
                    "server_id", "map_id", F.col("players").cast("int").alias("players"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """(id, timestamp, ip, endpoint, full_path): each event asks for one page, some with an attack."""
    e, pages = table(spark, sf, "events"), table(spark, sf, "pages").select("page_id", "url")
    n = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    slot = F.col("event_id") % 20
    suffix = (F.when(slot == 3, "?q=%3Cscript%3E").when(slot == 7, "/wp-login.php")
              .when(slot == 11, "/.env").when(slot == 13, "?a=1;ls").otherwise(""))
    e = e.withColumn("page_id", F.col("event_id") % n)
    return e.join(pages, "page_id").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), server_ip(F.col("user_id")).alias("ip"),
        F.col("event_type").alias("endpoint"), F.concat("url", suffix).alias("full_path"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("tie"), "ts", server_ip(F.col("user_id")).alias("ip"),
                    server_port(F.col("user_id")).alias("port"), (F.col("event_type") != "error").alias("ok"))


def country_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """One address range per nation, ten addresses wide."""
    n = F.col("n_nationkey")
    octet = lambda x: F.concat(F.lit("10.0.0."), x.cast("string"))
    return table(spark, sf, "nation").select(
        octet(n * 10).alias("lo"), octet(n * 10 + 9).alias("hi"), F.col("n_name").alias("country"))
