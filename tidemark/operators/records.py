"""Records of the listing and query protocols after they have landed as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let, strip
from tidemark.operators.windows import latest_per_key

# Fixed value: header that may precede a joined binary payload once more.
_HEADER = "FFFFFFFF"

# A listing between dashed lines, and its quoted or bare flags.
_LISTING = r"(?s)-{2,}\n(.+?)-{2,}\n"
_FLAG = r"\"[^\"]*\"|'[^']*'|[^\s\"']+"


def reassemble(fragments: DataFrame, key: str = "message_id", pos: str = "fragment_id",
               count: str = "fragment_count", payload: str = "payload") -> DataFrame:
    """Payloads of complete messages, joined in fragment order.

    Fragments sent twice are dropped before any are gathered, so a group holds at most as many as its message has,
    however often they were repeated. Payloads are text or binary. ``fragment_rejects`` has the others.
    """
    kept = fragments.filter(_belongs(pos, count))
    once = kept.groupBy(key, pos).agg(F.max(count).alias(count), F.max(payload).alias(payload))
    parts = once.groupBy(key).agg(
        F.count(F.lit(1)).alias("parts"), F.max(count).alias(count),
        F.array_sort(F.collect_list(F.struct(pos, payload))).alias("sorted"))
    return parts.filter(F.col("parts") == F.col(count)).select(
        key, F.col("parts").cast("bigint").alias("parts"),
        _joined(F.transform("sorted", lambda x: x[payload]), dict(fragments.dtypes)[payload]).alias(payload))


def _belongs(pos: str, count: str) -> Column:
    return F.coalesce((F.col(pos) >= 0) & (F.col(pos) < F.col(count)), F.lit(False))


def fragment_rejects(fragments: DataFrame, pos: str = "fragment_id", count: str = "fragment_count") -> DataFrame:
    """Fragments whose number their own message doesn't have."""
    return fragments.filter(~_belongs(pos, count))


def _joined(pieces: Column, type_: str) -> Column:
    if type_ != "binary":
        return F.array_join(pieces, "")
    whole = F.aggregate(pieces, F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x))
    return let(whole, lambda w: F.when(
        F.substring(w, 1, 4) == F.unhex(F.lit(_HEADER)), F.substring(w, F.lit(5), F.length(w))).otherwise(w))


def named_player_count(players: Column) -> Column:
    """Players without a name do not count."""
    return F.size(F.filter(players, lambda p: F.coalesce(p["name"], F.lit("")) != ""))


def cvar_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Console variables between two dashed lines: ``name : value : flags : description`` per line.

    ``cvar_rejects`` has the lines with fewer parts.
    """
    parts = F.split(F.col("line"), ":", 4)
    unquoted = F.transform(
        F.regexp_extract_all(F.regexp_replace(parts[2], ",", ""), F.lit(_FLAG), F.lit(0)),
        lambda f: F.regexp_replace(f, r"^[\"']|[\"']$", ""))
    return (_listed(df, text).filter(F.size(parts) == 4)
            .select(*[c for c in df.columns if c != text],
                    strip(parts[0]).alias("name"), strip(parts[1]).alias("value"),
                    F.array_distinct(unquoted).alias("flags"), strip(parts[3]).alias("description")))


def _listed(df: DataFrame, text: str) -> DataFrame:
    lines = F.split(F.regexp_extract(text, _LISTING, 1), r"\r\n|\n|\r")
    return df.select("*", F.explode(lines).alias("line"))


def cvar_rejects(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines of a listing, blank ones apart, that have fewer than four parts."""
    short = (F.size(F.split(F.col("line"), ":", 4)) < 4) & (strip(F.col("line")) != "")
    return _listed(df, text).filter(short).select(*[c for c in df.columns if c != text], "line")


def rules_map(pairs: DataFrame, key: str, pos: str, name: str = "name", value: str = "value",
              *tie: str) -> DataFrame:
    """One map of rules per server; of a repeated name the last value wins.

    Repeats go before the map is gathered. A record counts its rules in two bytes, so a map holds
    at most 32767 names.
    """
    last = latest_per_key(pairs, [key, name], pos, *tie)
    return last.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(name, value))).alias("rules"))
