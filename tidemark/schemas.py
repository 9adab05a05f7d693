"""Table schemas. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(), "UINT64": T.DecimalType(20, 0)}


def flat_schema(columns: str) -> T.StructType:
    """``"name TYPE, ..."`` of plain types; unlike ``fromDDL`` it needs no running session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[type_]) for name, type_ in pairs])


RAW_SAMPLE = flat_schema(
    "ip STRING, port STRING, map STRING, players STRING, timestamp STRING, name STRING, guid STRING")
PREPARED_SAMPLE = flat_schema(
    "ip STRING, port INT, map STRING, players INT, timestamp TIMESTAMP_NTZ, country_code STRING, guid STRING")

SERVERS = flat_schema("id BIGINT, ip STRING, port INT, country_code STRING")
MAPS = flat_schema("id BIGINT, name STRING")
SNAPS = flat_schema("id BIGINT, guid STRING, timestamp TIMESTAMP_NTZ")
FACTS = flat_schema("snapshot_id BIGINT, server_id BIGINT, map_id BIGINT, players INT, bucket_date DATE")
ROLLUP = flat_schema("bucket TIMESTAMP_NTZ, server_id BIGINT, map_id BIGINT, players BIGINT, bucket_date DATE")
SERVER_NAMES = flat_schema("ip STRING, port INT, name STRING, updated_at TIMESTAMP_NTZ")
COOLDOWNS = flat_schema(
    "ip STRING, port INT, timeout DOUBLE, failures INT, skip_until DOUBLE, updated_at TIMESTAMP_NTZ")

LEGACY_SAMPLES = flat_schema(
    "ip STRING, port INT, map STRING, players INT, timestamp TIMESTAMP_NTZ, country_code STRING, snapshot_id STRING")
LEGACY_SNAPSHOTS = flat_schema("snapshot_id STRING, timestamp TIMESTAMP_NTZ")

REQUEST_LOG = flat_schema(
    "id BIGINT, timestamp TIMESTAMP_NTZ, ip STRING, endpoint STRING, full_path STRING, log_date DATE")
REQUEST_VERDICTS = flat_schema("id BIGINT, ip STRING, now_us BIGINT, accepted BOOLEAN, log_date DATE")
REJECTED_PROBES = flat_schema("raw STRING")
CYCLE_METRICS = flat_schema("cycle BIGINT, listed BIGINT, filtered BIGINT, added BIGINT, skipped BIGINT, answered BIGINT, parsed BIGINT, written BIGINT, rejected BIGINT")
BLOCKED_IPS = flat_schema("ip STRING, reason STRING, blocked_at TIMESTAMP_NTZ, auto_blocked BOOLEAN")

SERVER_LIST = T.StructType().add("response", T.StructType().add("servers", T.ArrayType(
    flat_schema("addr STRING, appid INT, gamedir STRING"))))
PLAYERS = "ARRAY<STRUCT<index: INT, name: STRING, score: INT, duration: FLOAT>>"
PROBE = flat_schema(
    "ip STRING, port INT, ok BOOLEAN, map_name STRING, player_count INT, server_name STRING, "
    "snapshot_ts TIMESTAMP_NTZ")

# Fields both server-info shapes share, then those of the newer and of the older shape only.
INFO_COMMON = ("server_name STRING, map_name STRING, folder STRING, game STRING, player_count INT, "
               "max_players INT, protocol INT, server_type STRING, platform STRING, "
               "password_protected BOOLEAN, vac_enabled BOOLEAN, bot_count INT, ping FLOAT")
INFO_NEWER = flat_schema(
    INFO_COMMON + ", app_id INT, version STRING, edf INT, port INT, steam_id UINT64, "
                  "stv_port INT, stv_name STRING, keywords STRING, game_id UINT64")
INFO_LEGACY = flat_schema(
    INFO_COMMON + ", address STRING, is_mod BOOLEAN, mod_website STRING, mod_download STRING, "
                  "mod_version BIGINT, mod_size BIGINT, multiplayer_only BOOLEAN, uses_hl_dll BOOLEAN")
