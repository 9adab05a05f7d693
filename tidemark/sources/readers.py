"""Readers of landed files. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import text as tx
from tidemark.functions.time import parse_ts
from tidemark.operators.filters import drop_null_addr, matches_game


def server_entries(df: DataFrame, response: Column | str = "response") -> DataFrame:
    """One row per listed server: (addr, appid, gamedir) besides the other columns."""
    response = F.col(response) if isinstance(response, str) else response
    keep = [c for c in df.columns if c != "response"]
    return df.select(*keep, F.explode(response["servers"]).alias("s")).select(*keep, "s.*")


def flatten_servers(entries: DataFrame, game: str = "tf") -> DataFrame:
    """Endpoints of the game's servers with a public address and a numeric port."""
    split = tx.split_endpoint(F.col("addr"), last=True)
    kept = [c for c in entries.columns if c not in ("addr", "appid", "gamedir")]
    rows = (entries.filter(matches_game(F.col("appid"), F.col("gamedir"), game))
            .select(*kept, split["host"].alias("ip"), tx.to_int(split["port"]).alias("port"))
            .filter(tx.is_valid_public_ip(F.col("ip")) & F.col("port").isNotNull()))
    return drop_null_addr(rows)


def read_server_list(spark: SparkSession, path: str, game: str = "tf") -> DataFrame:
    """Landed server lists, one JSON document per file; folders ``region=...`` become a column."""
    docs = spark.read.schema(schemas.SERVER_LIST).option("multiLine", True).json(path)
    return flatten_servers(server_entries(docs), game)


CORRUPT = "_corrupt_record"


def _with_raw(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def parse_server_lists(docs: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of server lists held as text. A rejected list keeps its columns, with its whole text as ``raw``."""
    parsed = docs.withColumn("_doc", F.from_json(json, _with_raw(schemas.SERVER_LIST), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"_doc.{CORRUPT}").isNotNull() | F.col("_doc").isNull()
    kept = [c for c in docs.columns if c != json]
    good = parsed.filter(~bad).select(*kept, F.col("_doc.response").alias("response"))
    return server_entries(good), parsed.filter(bad).select(*kept, F.col(json).alias("raw"))


def read_server_lists(spark: SparkSession, path: str, game: str = "tf") -> tuple[DataFrame, DataFrame]:
    """(servers, rejects(file, raw)) of landed lists; a document that is cut off or isn't JSON is a reject, whole."""
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    entries, rejects = parse_server_lists(docs, "value")
    return flatten_servers(entries.drop("file"), game), rejects.select("file", "raw")


def read_sample_lines(spark: SparkSession, path: str, header: bool = False) -> tuple[DataFrame, DataFrame]:
    """(raw sample rows, rejects(file, raw)) of legacy sample files; a line with surplus fields is a reject, as it stands."""
    names = schemas.RAW_SAMPLE.fieldNames()
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).filter("trim(value) <> ''")
    if header:
        lines = lines.filter(~F.lower("value").startswith(f"{names[0]},"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _with_raw(schemas.RAW_SAMPLE))
    rows = lines.withColumn("_row", F.from_csv("value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    surplus = F.col(f"_row.{CORRUPT}").isNotNull() & (F.size(F.split("value", ",")) > len(names))
    return rows.filter(~surplus).select(*[f"_row.{n}" for n in names]), rows.filter(surplus).select("file", F.col("value").alias("raw"))


def union_regions(*dfs: DataFrame) -> DataFrame:
    """Endpoints of all regions, each once. One read over all regions needs no union."""
    out = dfs[0].select("ip", "port")
    for df in dfs[1:]:
        out = out.unionByName(df.select("ip", "port"))
    return out.distinct()


def parse_samples(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prepared, rejected). Missing port and players count as 0; what does not parse is rejected."""
    port, players = tx.to_int(F.col("port")), tx.to_int(F.col("players"))
    ts = parse_ts(F.col("timestamp"))
    good = ((F.col("port").isNull() | port.isNotNull())
            & (F.col("players").isNull() | players.isNotNull()) & ts.isNotNull())
    guid = F.col("guid") if "guid" in raw.columns else F.lit(None).cast("string")
    prepared = raw.filter(good).select(
        "ip", F.coalesce(port, F.lit(0)).alias("port"), "map",
        F.coalesce(players, F.lit(0)).alias("players"), ts.alias("timestamp"), guid.alias("guid"),
        *[c for c in ("name",) if c in raw.columns])
    return prepared, raw.filter(~good)


def read_samples_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Legacy sample files as raw string rows; feed them to ``parse_samples``."""
    return spark.read.schema(schemas.RAW_SAMPLE).option("header", header).csv(path)
