from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity as idn
from tidemark.functions import numeric as nm
from tidemark.functions import text as tx
from tidemark.functions import time as tm
from tidemark.functions.threats import RULES, threat_type
from tidemark.operators import records as rec


def apply(spark, values, fn, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {type_}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_public_addresses(spark):
    bad = ["169.254.1.1", "127.0.0.1", "0.0.0.0", "1.2.3", "a.b.c.d", None, "1.2.3.4.5"]
    good = ["10.0.0.1", "300.1.1.1", "192.168.1.1", "8.8.8.8"]
    assert apply(spark, bad + good, tx.is_valid_public_ip) == [False] * 7 + [True] * 4


def test_rounding_is_half_even_like_pandas(spark):
    import numpy as np

    values = [0.125, 0.375, 2.675, 4956.225, -0.125, 1.005, 12.3456789]
    for digits in (0, 2, 6):
        assert apply(spark, values, lambda c: nm.round_even(c, digits), "double") == list(np.round(values, digits))


def test_names(spark):
    names = ["█ My\x07 Server ░", None, "　 wide ", "\t"]
    assert apply(spark, names, tx.clean_name) == ["My Server", "", "wide", ""]
    assert apply(spark, ["\r\n ctf_\x01a \x9f"], tx.clean_map) == ["ctf_a"]


def test_threats(spark):
    paths = {"/a?q=%3Cscript%3E": "XSS", "/wp-login.php": "PHP_PROBE", "/.env": "VULN_SCAN", "/a?b=1;ls": "CMD_INJECTION",
             "/plain": None, "": None, "/x?u=%27%20or%201%3D1": "SQL_INJECTION", "/../../x": "PATH_TRAVERSAL",
             "/a?dns=AAAB": "SSRF_PROBE", "/dump.sql": "CONFIG_PROBE", "/a?x=shell_exec": "RCE_EXPLOIT",
             "/wp-json/x": "CMS_PROBE", "/run?c=whoami": "SHELL_PROBE", "/identity": None}
    assert apply(spark, list(paths), threat_type) == list(paths.values())
    assert sum(len(p) for _, p in RULES) == 62 and len(RULES) == 11


def test_percent_decoding_as_in_python(spark):
    from urllib.parse import unquote

    values = ["a+b%20c", "100%", "%zz%41", "%C3%A9", "%e2%82%ac", "%", "%4", "x%2Bx", "%25%34%31"]
    assert apply(spark, values, tx.percent_decode) == [unquote(v) for v in values]


def test_endpoints(spark):
    split = lambda last: lambda c: F.to_json(tx.split_endpoint(c, last))
    assert apply(spark, ["1.2.3.4:5", "a:b:c", "none"], split(True)) == [
        '{"host":"1.2.3.4","port":"5"}', '{"host":"a:b","port":"c"}', None]
    assert apply(spark, ["a:b:c"], split(False)) == ['{"host":"a","port":"b:c"}']
    assert apply(spark, ["12", " 12 ", "+1", "1_0", "x", "1.5", None], tx.to_int) == [12, 12, 1, None, None, None, None]


def test_times(spark):
    texts = ["2024-01-31-23:59:58", "2024-01-31T23:59:58", "2024-01-31", "2024-01-31 10", "31.1.2024", "2024", "2024-13-01", None]
    want = [datetime(2024, 1, 31, 23, 59, 58)] * 2 + [datetime(2024, 1, 31), datetime(2024, 1, 31, 10)] + [None] * 4
    assert apply(spark, texts, tm.parse_ts) == want
    ts = [datetime(2024, 1, 1, 3, 0), datetime(2024, 1, 1, 4, 0)]
    assert apply(spark, ts, tm.bucket_floor, "timestamp_ntz") == [datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 4)]
    assert apply(spark, ts, tm.bucket_ceil, "timestamp_ntz") == [datetime(2024, 1, 1, 4)] * 2
    assert apply(spark, ts, lambda c: tm.time_bucket("5 hours", c), "timestamp_ntz")[0] == datetime(2023, 12, 31, 23)
    assert apply(spark, ts, lambda c: tm.time_bucket("7 days", c), "timestamp_ntz")[0] == datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        tm.width_seconds("1 month")


def test_substring_filters(spark):
    names = ["PL_Éclair", "a.b", "axb", "ctf"]
    assert apply(spark, names, lambda c: tx.name_matches(c, ["éCL", "A.B"])) == [True, True, False, False]
    assert tx.name_matches(F.col("x"), []) is None and tx.name_matches(F.col("x"), ["", None]) is None
    assert tx.clean_tokens(["x" * 49 + ".y"]) == ["x" * 49 + ".y"]


def test_admins(spark):
    ips = ["127.0.0.1", "::1", "8.8.8.8"]
    assert apply(spark, ips, lambda c: tx.is_admin(c, ["127.0.0.1"])) == [True, True, False]
    assert apply(spark, ips, lambda c: tx.is_admin(c, [])) == [False] * 3


def test_protocol_codes(spark):
    codes = ["76", "108", "109", "111", "119", "l", "Windows", "5", "99"]
    assert apply(spark, codes, idn.platform_name) == ["Linux", "Linux", "Mac OS X", "Mac OS X", "Windows", "Linux", "Windows", None, None]
    assert apply(spark, [76, 108, 109, 111, 119], idn.os_name, "int") == ["posix"] * 4 + ["nt"]
    assert apply(spark, [68, 100, 108, 112], idn.server_type_name, "int") == ["Dedicated", "Dedicated", "Non-Dedicated", "SourceTV"]
    assert apply(spark, ["o", "W"], idn.platform_letter) == ["m", "w"]
    assert apply(spark, ["AS", "na", "x"], idn.region_codes) == [[4, 6], [0, 1], None]
    assert apply(spark, ["cs2", "tf", "other"], idn.app_id) == [730, 440, 440]


def test_accounts(spark):
    def one(account, instance, type_, fn):
        return spark.range(1).select(fn(idn.account_id(
            F.lit(account), F.lit(instance), F.lit(type_), F.lit(0))).alias("o")).first().o

    assert one(44647673, 0, 1, idn.steam_id64) == 76561198049561074
    assert one(44647673, 1, 7, idn.steam_id64) == 103582791518816755
    assert one(1, 0, 1, idn.steam_text) == "STEAM_0:0:1"
    assert one(-1, 0, 1, idn.steam_text) is None and one(4294967296, 0, 1, idn.steam_text) is None
    assert one(3, 1, 5, idn.steam_id64) is None and one(3, 1, 8, idn.steam_id32) == "[T:1:7]"
    text = lambda c: idn.steam_text(idn.account_from_text(c))
    assert apply(spark, ["STEAM_1:1:5", "STEAM_ID_PENDING", "UNKNOWN", "STEAM_9:0:1", "STEAM_0:2:1", "x"], text) == [
        "STEAM_1:1:5", "STEAM_ID_PENDING", "UNKNOWN", None, None, None]
    url = lambda c: idn.steam_text(idn.account_from_url(c))
    assert apply(spark, ["http://steamcommunity.com/profiles/76561198049561074?x=1", "http://steamcommunity.com/gid/[g:1:7]",
                         "http://steamcommunity.com/x/5", "http://steamcommunity.com/profiles/5"], url) == [
        "STEAM_0:0:44647673", "STEAM_0:1:3", None, None]
    back = lambda c: idn.community_url(idn.account_from_url(c), id64=False)
    assert apply(spark, ["http://steamcommunity.com/profiles/76561198049561074"], back) == [
        "http://steamcommunity.com/profiles/[U:1:89295346]"]


def test_variables(spark):
    listing = ('cvar list\n--------------\nfoo : cmd : , "a", "sv" : foo-description\nbar : 5 : : bar: description\n'
               "broken line\n--------------\n2 total\n")
    df = spark.createDataFrame([(1, listing), (2, "asdf")], "id INT, text STRING")
    assert [tuple(r) for r in rec.cvar_rows(df).collect()] == [
        (1, "foo", "cmd", ["a", "sv"], "foo-description"), (1, "bar", "5", [], "bar: description")]


def test_fragments(spark):
    rows = [(1, 2, 1, "b"), (1, 2, 0, "a"), (1, 2, 0, "a"), (2, 3, 0, "x"), (2, 3, 2, "z"), (3, 1, 0, "s")]
    df = spark.createDataFrame(rows, "message_id BIGINT, fragment_count INT, fragment_id INT, payload STRING")
    assert sorted((r.message_id, r.payload) for r in rec.reassemble(df).collect()) == [(1, "ab"), (3, "s")]


def test_binary_fragments(spark):
    rows = [(1, 2, 1, b"\x02"), (1, 2, 0, b"\xff\xff\xff\xff\x01"), (2, 1, 0, b"ab")]
    df = spark.createDataFrame(rows, "message_id BIGINT, fragment_count INT, fragment_id INT, payload BINARY")
    assert sorted((r.message_id, bytes(r.payload)) for r in rec.reassemble(df).collect()) == [(1, b"\x01\x02"), (2, b"ab")]


def test_rules_and_players(spark):
    pairs = spark.createDataFrame([(1, 0, "k", "old"), (1, 1, "k", "new"), (1, 2, "j", "x")],
                                  "server INT, pos INT, name STRING, value STRING")
    assert rec.rules_map(pairs, "server", "pos").first().rules == {"k": "new", "j": "x"}
    df = spark.sql("SELECT array(named_struct('name', 'a'), named_struct('name', ''), named_struct('name', null)) AS p")
    assert df.select(rec.named_player_count(F.col("p"))).first()[0] == 1
    flags = spark.range(1).select(*[c.alias(n) for n, c in idn.edf_flags(F.lit(0x80 | 0x20)).items()]).first().asDict()
    assert [n for n, on in flags.items() if on] == ["has_port", "has_keywords"]


def test_rejects_of_listings_and_fragments(spark):
    from tidemark.operators import records as rec

    text = "head\n----\na : 1 : x : y\nbad line\n\n----\n"
    assert [tuple(r) for r in rec.cvar_rejects(spark.createDataFrame([(1, text)], "k INT, text STRING")).collect()] == [(1, "bad line")]
    many = [(1, 300, k, f"{k},") for k in range(300)] + [(2, 2, 0, "a"), (2, 2, 5, "b"), (2, 2, None, "c")]
    df = spark.createDataFrame(many, "message_id BIGINT, fragment_count INT, fragment_id INT, payload STRING")
    (whole,) = rec.reassemble(df).collect()
    assert whole.parts == 300 and whole.payload.startswith("0,1,2,") and whole.payload.endswith("299,")
    assert {(r.message_id, r.fragment_id) for r in rec.fragment_rejects(df).collect()} == {(2, 5), (2, None)}


def test_filter_tokens_are_matched_whole(spark):
    from tidemark.functions.text import name_matches

    long = "x" * 60
    df = spark.createDataFrame([(long,), ("x" * 55,)], "name STRING")
    assert df.filter(name_matches(F.col("name"), [long])).count() == 1
