"""WARC archives and web pages."""

import base64
import gzip
import hashlib
import json
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

PAGES = ("page_id long, url string, html string, id long, uri string, payload string, sha string, first long, host string, "
         "record_type string")


def pages(spark, data):
    return spark.createDataFrame([(i, u, h, 1, "x", "y", "z", 2, "h", "t") for i, u, h in data], PAGES)


DATA = [(3, "http://a/1", "<p>same</p>"), (1, "http://b/2", "<p>same</p>"), (2, None, "<p>éß🙂</p>"), (4, "http://a/\r\nX: y", None),
        (5, "http://a/5", ""), (1, "http://b/2", "<p>same</p>"), (None, "http://c", "x" * 200_000), (6, "http://c", "\r\n\r\n")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    from tidemark.llm import warc

    warc.register(spark)
    at = str(tmp_path_factory.mktemp("warc") / "a")
    warc.deduplicated(pages(spark, DATA)).write.format("warc").mode("append").option("file_bytes", 1000).save(at)
    return at


def test_round_trip(spark, archive):
    from tidemark.llm import warc

    back = spark.read.format("warc").load(archive)
    got = Counter((r.id, r.record_type, r.to, r.payload_bytes, r.payload_digest, bytes(r.payload).decode()) for r in back.select(
        warc.page_id("record_id").alias("id"), "record_type", warc.page_id("refers_to").alias("to"), "payload_bytes", "payload_digest",
        "payload").collect())
    first = {"<p>same</p>": 1, "": 4}
    want = Counter()
    for i, _, h in DATA:
        h = h or ""
        again = h in first and first[h] != i
        want[i, "revisit" if again else "response", first[h] if again else None, len(h.encode()), digest(h), "" if again else h] += 1
    assert got == want
    uris = {r.target_uri for r in back.collect()}
    assert uris == {"http://a/1", "http://b/2", None, "http://a/%0D%0AX: y", "http://a/5", "http://c"}


def test_the_query_gives_revisits_their_full_length(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    pages(spark, DATA).select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to)
                  for r in QUERIES["op1_warc"](spark, str(tmp_path)).collect())
    first, want = {"<p>same</p>": 1, "": 4}, Counter()
    for i, _, h in DATA:
        h = h or ""
        again = h in first and first[h] != i
        want[i, "revisit" if again else "response", len(h.encode()), digest(h), first[h] if again else None] += 1
    assert got == want and any(t == "revisit" and n for _, t, n, _, _ in got)


def test_predicates_are_pushed_and_payloads_left_alone(spark, archive, monkeypatch):
    from tidemark.llm import warc

    back = spark.read.format("warc").schema("record_id string, record_type string, target_uri string").load(archive)
    few = back.filter("record_type = 'response' and target_uri like 'http://b%'")
    assert few.count() == 2 and "Filter" not in few._jdf.queryExecution().optimizedPlan().toString().replace("Filters", "")
    read = []
    files = sorted(Path(archive).glob("part-*"))
    real = warc._Member.upto
    monkeypatch.setattr(warc._Member, "upto", lambda self, n: read.append(n) or real(self, n))
    with open(files[0], "rb") as f:
        f.size = lambda: files[0].stat().st_size
        assert list(warc.records(f, True, lambda row: False, True)) == []
    assert None not in read  # nothing is inflated past its headers


def test_other_archives_and_stray_files(spark, archive, tmp_path):
    from tidemark.llm import warc

    Path(archive, "part-stray.warc.gz").write_bytes(b"left by a lost task")
    assert spark.read.format("warc").load(archive).count() == len(DATA)
    assert json.loads(Path(archive, "_manifest.json").read_text())
    row = {"record_id": "<urn:page:9>", "target_uri": "http://x", "payload": b"hello" * 3000, "record_type": "response"}
    plain = warc.record(row, "2024-01-01T00:00:00Z")
    (tmp_path / "one.warc").write_bytes(plain * 2)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(plain) * 3)
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert len(got) == 5 and {bytes(r.payload) for r in got} == {b"hello" * 3000}
    assert spark.read.format("warc").schema("record_id string").load(str(tmp_path / "two.warc.gz")).count() == 3
    (tmp_path / "two.warc.gz").write_bytes(warc.member(plain.replace(b"hello", b"jello", 1)))
    with pytest.raises(Exception, match="digest"):
        spark.read.format("warc").load(str(tmp_path / "two.warc.gz")).collect()


def test_no_rows_and_sizes_below_the_limit(spark, tmp_path):
    from tidemark.llm import warc

    at = str(tmp_path / "none")
    warc.deduplicated(pages(spark, [])).write.format("warc").mode("append").save(at)
    assert spark.read.format("warc").load(at).count() == 0
    assert warc.deduplicated(pages(spark, DATA), min_bytes=1000).filter("record_type = 'revisit'").count() == 0


def test_base32(spark):
    from tidemark.llm import warc

    df = spark.createDataFrame([(str(k),) for k in range(50)], "s string").withColumn("d", F.unhex(F.sha1("s")))
    assert all(r.b == digest(r.s) for r in df.withColumn("b", warc.base32("d")).collect())


# ---- 6: pages

def site(k):
    return (f"<!DOCTYPE html><html><head><title>t{k}</title><script>if (a<b) {{}}</script></head><body><header>Site {k}</header>"
            f"<nav><ul><li><a href=x>m{k}</a></ul></nav><div class='ad box'>buy {k}</div><div id=sidebar>s{k}</div>"
            f"<article><header><h1>Title {k}</h1></header><p>Read on, dear guest.</p><p>Body <b>of</b> pa<i>ge</i> {k} &amp; more<p>second&nbsp;{k}<br>line"
            f"<ul><li>one<li>two {k}</ul><form>q</form><section class=comments><p>me too {k}</p></section></article>"
            f"<footer>&copy; {k}</footer>")


def test_main_text_without_the_template(spark):
    from tidemark.llm import html_extract as he

    odd = [(900, "http://odd/1", None), (901, None, ""), (None, "http://odd/2", "plain <<< text"), (902, "nonsense", "<p>a<p>b<i>c</i>d"),
           (903, "http://odd/3", "<table><tr><td>1<td>2<tr><td>3</table>"), (904, "http://odd/4", "<article>un<!-- c -->closed"),
           (905, "http://odd/5", "<main><p>y &amp; z</p><aside>no</aside></main>")]
    data = [(k, f"https://User@Host:80/{k}", site(k)) for k in range(12)] + odd + [(0, "https://host/0", site(0))]
    got = Counter((r.page_id, r.text) for r in he.main_text(pages(spark, data)).collect())
    want = Counter((k, f"Title {k} Body of page {k} & more second {k} line two {k}") for k in [*range(12), 0])
    want += Counter([(900, ""), (901, ""), (None, "plain <<< text"), (902, "a bcd"), (903, "1 2 3"), (904, "unclosed"), (905, "y & z")])
    assert got == want
    assert he.main_text(pages(spark, [])).count() == 0


def test_copies_keep_their_text_and_small_hosts_have_no_template():
    from tidemark.llm import html_extract as he

    assert he.extract([site(1)] * 9) == ["Title 1 Read on, dear guest. Body of page 1 & more second 1 line one two 1"] * 9
    assert he.extract([site(k) for k in range(3)])[2] == "Title 2 Read on, dear guest. Body of page 2 & more second 2 line one two 2"


def article(*paragraphs):
    return "<article>" + "".join(f"<p>{x}</p>" for x in paragraphs) + "</article>"


def test_only_the_very_text_of_the_template_goes():
    from tidemark.llm import html_extract as he

    data = [article("the same line", f"own {k}", f"more {k}", f"end {k}") for k in range(9)]
    other = article("a line of my own", "own x", "more x", "end x")
    assert he.extract([*data, other])[-1] == "a line of my own own x more x end x"
    assert he.extract([*data, other])[0] == "own 0 more 0 end 0"
    short = [article("a long line of the template, far longer than all the rest", f"own {k}") for k in range(9)]
    assert he.extract(short) == [f"own {k}" for k in range(9)]
    assert he.extract(short[:1] * 9 + short[1:3])[0].startswith("a long line")  # three distinct pages


def test_templates_belong_to_hosts_whatever_the_partitions(spark):
    from tidemark.llm import html_extract as he

    long = "x" * 1_100_000
    data = [(k, f"http://large/{k}", article("the same line", f"{long} {k}")) for k in range(6)]
    data += [(100 + k, f"http://h{k % 3}/{k}", article(f"line of {k % 3}", f"own {k}")) for k in range(18)]
    want = {k: f"{long} {k}" for k in range(6)} | {100 + k: f"own {k}" for k in range(18)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert {r.page_id: r.text for r in he.main_text(pages(spark, data).repartition(5)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_child_lists_are_matched_in_order():
    from tidemark.llm import html_extract as he

    a = he.parse("<div>" + "".join(f"<div class=c{k}><i>1</i></div>" for k in range(300)) + "</div>")
    b = he.parse("<div><p>new</p>" + "".join(f"<div class=c{k}><b>1</b></div>" for k in range(300)) + "</div>")
    for t in (a, b):
        he.shaped(t)
    assert he.Matcher().score(a, b) == 302
    rng = np.random.default_rng(0)
    table = rng.integers(0, 3, (2100, 2200))
    best = np.zeros(2201, np.int64)
    for got in table:
        best[1:] = np.maximum(best[1:], best[:-1] + got)
        best = np.maximum.accumulate(best)
    out = he.in_order(2100, 2200, lambda i: table[i])
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(out, out[1:])) and sum(table[i, j] for i, j in out) == best[-1]


@pytest.mark.parametrize("seed", range(4))
def test_tree_matching_is_the_same_whatever_the_sizes(seed, monkeypatch):
    """The limits that choose how lists are matched change neither scores nor pairs, ties included."""
    from tidemark.llm import html_extract as he

    rng = random.Random(seed)

    def grown(depth):
        x = he.Node("", rng.choice("ab"), False)
        x.children = [grown(depth - 1) for _ in range(rng.randrange(4 if depth < 3 else 9))] if depth else []
        return x

    a, b = (he.Node("", "#", False) for _ in range(2))
    for x in (a, b):
        x.children = [grown(3) for _ in range(10)]
        he.shaped(x)

    def matched():
        todo, n = [b], 0
        while todo:
            x = todo.pop()
            x.slot, n = n, n + 1
            todo += reversed(x.children)
        m = he.Matcher()
        return m.score(a, b), sorted((id(x), x.slot) for x in m.align(a, b))

    want, least = matched(), he.in_order
    assert len(want[1]) == want[0]
    for cells, shapes, few, deep in ((0, 1 << 16, 16, 20), (0, 0, 16, 20), (0, 0, 1, 20), (0, 0, 1, 1), (30, 10, 2, 3)):
        for name, value in (("CELLS", cells), ("SHAPES", shapes), ("FEW", few), ("DEEP", deep)):
            monkeypatch.setattr(he.Matcher, name, value)
        monkeypatch.setattr(he, "in_order", lambda n, m, row: least(n, m, row, 40))
        monkeypatch.setattr(he.Group, "KEPT", 30)
        monkeypatch.setattr(he.Group, "CHILDREN", 40)
        monkeypatch.setattr(he._Hosts, "SCORES", 5)
        assert matched() == want


def test_many_different_rows_count_by_what_is_below_them():
    """1100 rows of different shapes on either side, in the same order but for one row put in front: all below them matches."""
    from tidemark.llm import html_extract as he

    def rows(first):
        found = []
        for k in [*first, *range(1, 1101)]:
            x = he.Node("", "li", False)
            x.children = [he.Node("", t, False) for t in format(k, "b").replace("0", "i").replace("1", "b")]
            found.append(x)
        root = he.Node("", "ul", False)
        root.children = found
        he.shaped(root)
        return root

    a, b = rows([2047, 2046]), rows([])
    b.children = [*b.children, rows([4095]).children[0]]
    he.shaped(b)
    assert len({c.shape for c in a.children}) * len({c.shape for c in b.children}) > 1_000_000
    # Every row of 1 to 1100 finds itself; the last row has another as its best only if the rest gives way.
    assert he.Matcher().score(a, b) == he.size(b, {}) - he.size(b.children[-1], {})


def test_tree_matching_is_best_in_order():
    from tidemark.llm import html_extract as he

    a = he.parse("<div><p>1</p><ul><li>x<li>y</ul><p>2</p></div>")
    b = he.parse("<div><p>1</p><h2>new</h2><ul><li>x</ul><p>2</p></div>")
    for t in (a, b):
        he.shaped(t)
    assert he.Matcher().score(a, b) == 6  # root, div, p, ul, li, p
    slots = {n.label for n in he.Matcher().align(b, a)}
    assert "h2" not in slots


def test_deep_pages_and_their_wrapper(spark):
    from tidemark.llm import html_extract as he

    pages = ["<html><body><div>menu of the site</div>" + "<div>" * 10_000 + f"<p>Own text of page {k}.</p>" + "<i>x</i>" * (k % 3) for k in range(6)]
    assert all(t.startswith(f"Own text of page {k}.") for k, t in enumerate(he.extract(pages)))
    df = spark.createDataFrame([(k, f"https://deep.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text[:19] for r in he.main_text(df).collect()} == {k: f"Own text of page {k}."[:19] for k in range(6)}


@pytest.mark.parametrize("page,text", [
    ('<div class="layout has-sidebar"><article><p>Body.</p></article><div class="sidebar">side</div></div>', "Body."),
    ('<div class="content no-sidebar"><p>Body.</p></div>', "Body."),
    ('<article><p class="market-share">Shares rose.</p><section id="related-work"><p>Others did.</p></section><p class="legal">Law.</p>'
     '<div class="ad">Buy</div><div class="related-posts">More</div></article>', "Shares rose. Others did. Law."),
    ('<main><p>Body.</p><article class="comment"><p>I disagree</p></article></main>', "Body."),
    ('<div class="widget-page"><main><p>Body.</p></main></div><div id="comments"><article><p>First!</p></article></div>', "Body."),
    ('<div class="promo"><p>Buy</p></div><div><p>Body.</p></div>', "Body."),
])
def test_names_switch_off_no_article(page, text):
    from tidemark.llm import html_extract as he

    assert he.extract([f"<html><body>{page}</body></html>"]) == [text]


def warc_of(kind, content_type, block, **headers):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}>", "Content-Type": content_type, "Content-Length": len(block), **headers}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def test_records_of_other_kinds(spark, tmp_path):
    from tidemark.llm import warc

    warc.register(spark)
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;a=b\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
    sha = hashlib.sha1(b"hello world").digest()
    data = [
        warc_of("resource", "text/plain", b"first\r\n\r\nsecond", **{"WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(b"first\r\n\r\nsecond").digest()).decode()}),
        warc_of("warcinfo", "application/warc-fields", b"software: x\r\nformat: y\r\n"),
        warc_of("metadata", "application/warc-fields", b""),
        warc_of("response", "application/http; msgtype=response", chunked, **{"WARC-Payload-Digest": "sha1:" + sha.hex()}),
        warc_of("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nContent-Length: abc\r\n\r\n", **{"WARC-Payload-Digest": "sha256:00ff"}),
        warc_of("conversion", "text/plain", b"bad", **{"WARC-Payload-Digest": "sha1:" + base64.b32encode(sha).decode()}),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    read = spark.read.format("warc").option("digests", "flag").schema(
        "record_type string, payload binary, payload_bytes bigint, payload_digest string, digest_ok boolean")
    for name in ("a.warc", "b.warc.gz"):
        got = {r.record_type: (bytes(r.payload), r.payload_bytes, r.digest_ok) for r in read.load(str(tmp_path / name)).collect()}
        assert got == {"resource": (b"first\r\n\r\nsecond", 15, True), "warcinfo": (b"software: x\r\nformat: y\r\n", 24, None), "metadata": (b"", 0, None),
                       "response": (b"hello world", 11, True), "request": (b"", 0, None), "conversion": (b"bad", 3, False)}
    assert {r.payload_digest for r in read.load(str(tmp_path / "a.warc")).filter("record_type = 'response'").collect()} == {base64.b32encode(sha).decode()}
    with pytest.raises(Exception, match="digest"):
        spark.read.format("warc").load(str(tmp_path / "a.warc")).collect()
    assert warc.dechunked(b"zz\r\nno") == b"zz\r\nno" and warc.sha1_of("sha1:not base32") == ("sha1:not base32", False)
