"""Row filters and row shapes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.identity import app_id


_HOST_PORT = re.compile(r"\s*(?P<host>[^:\s](?:[^:]*[^:\s])?)\s*:\s*\+?(?P<port>\d+)\s*")


def parse_server_filter(value: str | None) -> tuple[str, int] | None:
    """``ip:port``; anything else, such as ``ALL``, means no filter."""
    found = _HOST_PORT.fullmatch(value) if isinstance(value, str) else None
    return (found["host"], int(found["port"])) if found else None


def server_filter(servers: DataFrame, value: str | None) -> DataFrame:
    wanted = parse_server_filter(value)
    if wanted is None:
        return servers
    ip, port = wanted
    return servers.filter((F.col("ip") == ip) & (F.col("port") == port))


def server_name_matches(servers: DataFrame, names: DataFrame, tokens: Iterable[str] | None) -> DataFrame:
    """Servers that have a name holding one of the tokens."""
    match = tx.name_matches(F.col("name"), tokens)
    if match is None:
        return servers
    return servers.join(names.filter(match).select("ip", "port"), ["ip", "port"], "left_semi")


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def public_only(df: DataFrame, ip: str = "ip") -> DataFrame:
    return df.filter(tx.is_valid_public_ip(F.col(ip)))


def matches_game(appid: Column, gamedir: Column, game: str) -> Column:
    """Both the id and the folder must differ for a server to be rejected."""
    same_id = F.coalesce(appid, F.lit(0)) == app_id(F.lit(game))
    same_dir = F.lower(F.coalesce(gamedir, F.lit(""))) == game.lower()
    return same_id | same_dir


def drop_null_addr(df: DataFrame) -> DataFrame:
    return df.filter(~((F.col("ip") == "0.0.0.0") & (F.col("port") == 0)))


def changed_names(new: DataFrame, known: DataFrame) -> DataFrame:
    """Non-empty names that differ from the known name of the same endpoint."""
    old = known.select("ip", "port", F.col("name").alias("known_name"))
    return (new.filter(F.col("name") != "")
            .join(old, ["ip", "port"], "left")
            .filter(~F.col("name").eqNullSafe(F.col("known_name")))
            .drop("known_name"))


def not_cooling(df: DataFrame, now: Column) -> DataFrame:
    """Drop probes of servers that are still skipped; needs the columns of ``with_state``."""
    return df.filter(now >= F.col("skip_until"))


def normalize(df: DataFrame) -> DataFrame:
    """Bad player counts become 0, rows with a bad timestamp go."""
    return (df.withColumn("players", F.coalesce(
                F.col("players").cast("string").try_cast("double").try_cast("bigint"), F.lit(0)))
            .withColumn("timestamp", F.col("timestamp").cast("string").try_cast("timestamp_ntz"))
            .dropna(subset=["timestamp"]))


def sample_rows(info: DataFrame) -> DataFrame:
    """Successful probe results as raw sample rows, all strings."""
    return info.select(
        "ip", F.col("port").cast("string").alias("port"),
        tx.clean_map(F.col("map_name")).alias("map"),
        F.col("player_count").cast("string").alias("players"),
        F.date_format("snapshot_ts", "yyyy-MM-dd-HH:mm:ss").alias("timestamp"),
        tx.clean_name(F.col("server_name")).alias("name"),
        F.date_format("snapshot_ts", "yyyyMMddHHmmss").alias("guid"))
