"""The chart document in pieces is the document."""

from collections import defaultdict

from tidemark.plans import chart as ch
from tidemark.queries import chart

SF = "/root/testdata/sf0.001"


def test_pieces_and_their_list_make_the_document(spark, tmp_path):
    c = chart(spark, SF)
    ch.write_document(c, str(tmp_path / "doc"), piece=10)
    parts = spark.read.json(str(tmp_path / "doc" / "parts")).collect()
    pieces = spark.read.json(str(tmp_path / "doc" / "pieces")).collect()
    assert max(len(p.data) for p in pieces) <= 10 and all(len(p.data) == len(p.buckets) for p in pieces)
    joined = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.part):
        joined[p.section, p.label].extend(p.data)
    for p in parts:
        assert len(joined[p.section, p.label]) == p.points and p.parts == sum(x.section == p.section and x.label == p.label for x in pieces)
    assert joined["snapshotCounts", "total"] and len(joined["dailyTotals", "total"]) == len(joined["snapshotCounts", "total"])
    sections = defaultdict(list)
    for r in ch.chart_sections(c).collect():
        sections[r.section].append(r.json)
    assert len(sections["datasets"]) == len({label for s, label in joined if s == "datasets"})
    import json

    assert {d["label"]: d["data"] for d in map(json.loads, sections["datasets"])} == {label: v for (s, label), v in joined.items() if s == "datasets"}
    assert len(sections["totals"]) == len(joined["dailyTotals", "total"])
