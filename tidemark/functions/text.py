"""Endpoints, addresses, name cleaning, substring filters and percent-decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


# Java regex flags: i = ignore case, U = Unicode classes and folding, d = only \n ends a line.
_UNICODE = "(?iU)"
# All characters that count as white space.
_SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
           + "".join(map(chr, range(0x2000, 0x200B))))
_CONTROL = r"[\x00-\x1F\x7F-\x9F]"
_BLOCK_OR_CONTROL = r"[▀-▟\x00-\x1F\x7F-\x9F]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat_ws(":", ip, port.cast("string"))


def split_endpoint(s: Column, last: bool = False) -> Column:
    """``host:port`` split on the first (labels, filters) or the last (addresses) colon."""
    at = F.length(s) - F.length(F.substring_index(s, ":", -1)) if last else F.instr(s, ":")
    return F.when(
        s.contains(":"),
        F.struct(F.substring(s, F.lit(1), at - 1).alias("host"),
                 F.substring(s, at + 1, F.length(s)).alias("port")))


def to_int(s: Column, type_: str = "int") -> Column:
    """Null where the text is no integer; surrounding blanks and a sign are fine."""
    return s.try_cast(type_)


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(_SPACES))


def clean_map(s: Column) -> Column:
    return strip(F.regexp_replace(s, _CONTROL, ""))


def clean_name(s: Column) -> Column:
    return F.coalesce(strip(F.regexp_replace(s, _BLOCK_OR_CONTROL, "")), F.lit(""))


def clean_tokens(tokens: Iterable[str] | None) -> list[str]:
    """Tokens of a substring filter, whole."""
    return [t for t in tokens or [] if isinstance(t, str) and t]


def name_matches(col: Column, tokens: Iterable[str] | None) -> Column | None:
    """True where any token occurs, whatever the case. No tokens, no filter (``None``)."""
    kept = clean_tokens(tokens)
    if not kept:
        return None
    return col.rlike(_UNICODE + "|".join(re.escape(t) for t in kept))


def strip_qmark(path: Column) -> Column:
    return F.regexp_replace(path, r"\?$", "")


def percent_decode(s: Column) -> Column:
    """``%41`` to ``A``. A plus stays, a malformed percent sign stays, bad UTF-8 is replaced."""
    plus_kept = F.replace(s, F.lit("+"), F.lit("%2B"))
    decoded = F.url_decode(F.regexp_replace(plus_kept, "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(s.contains("%"), decoded).otherwise(s)


def ip_octets(ip: Column) -> Column:
    return F.transform(F.split(ip, r"\."), lambda part: part.try_cast("bigint"))


def is_valid_public_ip(ip: Column) -> Column:
    """Four integer parts, not link-local, not loopback, not all zero.

    Private ranges and octets above 255 do pass.
    """
    def valid(o: Column) -> Column:
        link_local = (F.get(o, F.lit(0)) == 169) & (F.get(o, F.lit(1)) == 254)
        loopback = F.get(o, F.lit(0)) == 127
        return ((F.size(o) == 4) & F.forall(o, lambda x: x.isNotNull()) & ~link_local & ~loopback
                & F.exists(o, lambda x: x != 0))

    return F.coalesce(let(ip_octets(ip), valid), F.lit(False))


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 as a number; null unless four parts of 0..255."""
    return let(ip_octets(ip), lambda o: F.when(
        (F.size(o) == 4) & F.forall(o, lambda x: x.isNotNull() & x.between(0, 255)),
        F.aggregate(o, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)))


def is_admin(ip: Column, admins: Iterable[str]) -> Column:
    """Allow-list test. IPv6 loopback counts as the IPv4 one; an empty list admits nobody."""
    allowed = sorted(set(admins))
    if not allowed:
        return F.lit(False)
    if "127.0.0.1" in allowed and "::1" not in allowed:
        allowed.append("::1")
    return F.coalesce(ip.isin(allowed), F.lit(False))
