"""Protocol codes, account ids, region and game lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

# Protocol codes and their names.
PLATFORMS = {76: "Linux", 108: "Linux", 109: "Mac OS X", 111: "Mac OS X", 119: "Windows"}
PLATFORM_CODES = {"linux": 108, "mac os x": 111, "windows": 119}
SERVER_TYPES = {68: "Dedicated", 100: "Dedicated", 108: "Non-Dedicated", 112: "SourceTV"}
SERVER_TYPE_CODES = {"dedicated": 100, "non-dedicated": 108, "sourcetv": 112}
OS_NAMES = {76: "posix", 108: "posix", 109: "posix", 111: "posix", 119: "nt"}

# Bits that say which optional fields a server-info record carries.
EXTRA_DATA_BITS = {"has_port": 0x80, "has_steam_id": 0x10, "has_stv": 0x40, "has_keywords": 0x20,
                   "has_game_id": 0x01}

# Region names of the listing service and their codes.
REGIONS = {
    "na-east": [0x00], "na-west": [0x01], "na": [0x00, 0x01], "sa": [0x02], "eu": [0x03],
    "as": [0x04, 0x06], "oc": [0x05], "af": [0x07], "rest": [0xFF],
    "all": [0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0xFF],
}
# Game folders and their application ids.
GAMES = {"tf": 440, "csgo": 730, "cs2": 730, "cstrike": 10, "dod": 30, "hl2dm": 320, "l4d": 500,
         "l4d2": 550}
DEFAULT_GAME = 440

# Account-id layout.
PERSON_BASE = 0x0110000100000000
GROUP_BASE = 0x0170000000000000
MAX_ACCOUNT = 2 ** 32 - 1
UNIVERSES = [0, 1, 2, 3, 4, 5]
TYPE_INVALID, TYPE_PERSON, TYPE_PENDING, TYPE_GROUP, TYPE_CHAT = 0, 1, 5, 7, 8
ACCOUNT_TYPES = list(range(11))
TYPE_LETTERS = {TYPE_PERSON: "U", TYPE_GROUP: "g", TYPE_CHAT: "T"}
COMMUNITY_URL = "http://steamcommunity.com/"
URL_PATHS = {TYPE_PERSON: "profiles", TYPE_GROUP: "groups"}

_ACCOUNT = "struct<account:bigint,instance:int,type:int,universe:int>"


def lookup(col: Column, table: dict) -> Column:
    """Small constant table as a map literal; unknown keys give null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def _code(value: Column, names: dict[str, int]) -> Column:
    """A code given as number, as one character or by name."""
    text = value.cast("string")
    return F.coalesce(
        F.when(text.rlike(r"^\d{2,}$"), text.try_cast("int")),
        F.when(F.length(text) == 1, F.ascii(text)),
        lookup(F.lower(text), names))


def platform_code(value: Column) -> Column:
    return _code(value, PLATFORM_CODES)


def platform_name(value: Column) -> Column:
    return lookup(platform_code(value), PLATFORMS)


def os_name(value: Column) -> Column:
    return lookup(platform_code(value), OS_NAMES)


def server_type_name(value: Column) -> Column:
    return lookup(_code(value, SERVER_TYPE_CODES), SERVER_TYPES)


def platform_letter(letter: Column) -> Column:
    """Lower case, with the outdated Mac letter replaced."""
    low = F.lower(letter)
    return F.when(low == "o", F.lit("m")).otherwise(low)


def edf_flags(edf: Column) -> dict[str, Column]:
    bits = F.coalesce(edf.cast("int"), F.lit(0))
    return {name: bits.bitwiseAND(F.lit(mask)) != 0 for name, mask in EXTRA_DATA_BITS.items()}


def region_codes(name: Column) -> Column:
    """Codes of a region name (any case) as an array; null for an unknown name."""
    pairs: list[Column] = []
    for region, codes in REGIONS.items():
        pairs += [F.lit(region), F.array(*[F.lit(c) for c in codes])]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def app_id(game: Column) -> Column:
    return F.coalesce(lookup(game, GAMES), F.lit(DEFAULT_GAME))


def _account(account: Column, instance: Column, type_: Column, universe: Column) -> Column:
    ok = (account.between(0, MAX_ACCOUNT) & instance.isin(0, 1)
          & universe.isin(UNIVERSES) & type_.isin(ACCOUNT_TYPES))
    return F.when(ok, F.struct(
        account.cast("bigint").alias("account"), instance.cast("int").alias("instance"),
        type_.cast("int").alias("type"), universe.cast("int").alias("universe")))


# The forms of an account as text, and of a community address with a 32-bit and a 64-bit number.
ACCOUNT_TEXT = r"^STEAM_(\d+):(\d+):(\d+)$"
ADDRESS_32 = r".*/(profiles|id|groups|gid)/\[([UgT]):1:(\d+)\]$"
ADDRESS_64 = r".*/(profiles|id|groups|gid)/(\d+)$"


def account_id(account: Column, instance: Column, type_: Column, universe: Column) -> Column:
    """The four components as a struct; null where one is out of range."""
    return _account(account, instance, type_, universe).cast(_ACCOUNT)


def account_from_text(s: Column, type_: int = TYPE_PERSON) -> Column:
    """``STEAM_X:Y:Z`` and the two special forms; anything else is null."""
    x, y, z = (F.regexp_extract(s, ACCOUNT_TEXT, i).try_cast("bigint") for i in (1, 2, 3))
    zero = F.lit(0)
    special = (F.when(s == "STEAM_ID_PENDING", _account(zero, zero, F.lit(TYPE_PENDING), zero))
               .when(s == "UNKNOWN", _account(zero, zero, F.lit(TYPE_INVALID), zero)))
    return F.coalesce(special, _account(z, y, F.lit(type_), x)).cast(_ACCOUNT)


def account_from_url(url: Column, universe: int = 0) -> Column:
    """Community address with a 32-bit (``[U:1:W]``) or a 64-bit number; anything else is null."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    letters = {letter: t for t, letter in TYPE_LETTERS.items()}
    w32 = F.regexp_extract(path, ADDRESS_32, 3).try_cast("bigint")
    w64 = F.regexp_extract(path, ADDRESS_64, 2).try_cast("bigint")
    person = F.regexp_extract(path, ADDRESS_64, 1).isin("profiles", "id")

    def build(number: Column, base: Column, type_: Column) -> Column:
        def parts(w: Column) -> Column:
            y = w.bitwiseAND(F.lit(1))
            return F.when(w.isNotNull(), _account(F.shiftright(w - y - base, 1), y, type_, F.lit(universe)))
        return let(number, parts)

    return F.coalesce(
        build(w32, F.lit(0), lookup(F.regexp_extract(path, ADDRESS_32, 2), letters)),
        build(w64, F.when(person, F.lit(PERSON_BASE)).otherwise(F.lit(GROUP_BASE)),
              F.when(person, F.lit(TYPE_PERSON)).otherwise(F.lit(TYPE_GROUP)))).cast(_ACCOUNT)


def steam_text(acc: Column) -> Column:
    return (F.when(acc["type"] == TYPE_PENDING, F.lit("STEAM_ID_PENDING"))
            .when(acc["type"] == TYPE_INVALID, F.lit("UNKNOWN"))
            .when(acc.isNotNull(), F.concat(
                F.lit("STEAM_"), acc["universe"].cast("string"), F.lit(":"),
                acc["instance"].cast("string"), F.lit(":"), acc["account"].cast("string"))))


def _number(acc: Column) -> Column:
    return acc["account"] * 2 + acc["instance"]


def steam_id64(acc: Column) -> Column:
    """64-bit form; only people and groups have one."""
    return (F.when(acc["type"] == TYPE_PERSON, _number(acc) + F.lit(PERSON_BASE))
            .when(acc["type"] == TYPE_GROUP, _number(acc) + F.lit(GROUP_BASE)))


def steam_id32(acc: Column) -> Column:
    """32-bit form with the type letter; only people, groups and chats have one."""
    letter = lookup(acc["type"], TYPE_LETTERS)
    return F.concat(F.lit("["), letter, F.lit(":1:"), _number(acc).cast("string"), F.lit("]"))


def community_url(acc: Column, id64: bool = True) -> Column:
    number = steam_id64(acc).cast("string") if id64 else steam_id32(acc)
    return F.concat(F.lit(COMMUNITY_URL), lookup(acc["type"], URL_PATHS), F.lit("/"), number)
