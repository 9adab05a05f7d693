"""The filter audit against running every order of the filters."""

import itertools
import random
from collections import Counter

import messy
import numpy as np
import pytest


def brute(data, labels):
    last = (1 << 63) - 1
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    failed = []
    for i, text, lang in data:
        text, ws = text or "", (text or "").encode().split()
        own = last if i is None else i
        f = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
             "D": any(c in "#$%&*|" for c in text), "E": any((t or "") == text and (last if j is None else j) < own for j, t, _ in data)}
        failed.append((i, lang or "", {k for k, v in f.items() if v}))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in failed}:
        docs = [(i, f) for i, p, f in failed if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[part, name] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(name in f for _, f in docs) - len(gone), sum(f == {name} for _, f in docs),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("seed", [0, 1])
def test_every_order_equals_running_it(spark, seed, monkeypatch):
    from tidemark.llm import filter_audit

    rng = random.Random(seed)
    odd = [(700 + k, " ".join(rng.choice(["Ab", "XY", "#a", "c|d", "é", "日本", f"w{k}"]) for _ in range(rng.choice([0, 3, 99, 100, 140]))))
           for k in range(40)]
    data = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in messy.rows(seed) + odd + odd[:12] + [(5, t) for _, t in odd[:5]] + [(None, odd[0][1])] * 2]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in data] + [(None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, "x", 1, 2, 3) for i, t, p in data],
                                 "doc_id long, text string, lang string, part string, fails int, n long, before int")
    got = filter_audit.audit(docs, labelled(spark, labels)).collect()
    assert {tuple(r) for r in got} == brute(data, labels)
    assert len(got) == 600 * len({p or "" for _, _, p in data})
    assert sum(r.shapley for r in got if r.filter_order == "ABCDE" and r.part == "en") % 120 == 0


def test_no_documents_give_no_rows(spark):
    from tidemark.llm import filter_audit

    assert filter_audit.audit(messy.empty(spark), labelled(spark, [(1, 1, 1)])).count() == 0
    one = filter_audit.audit(messy.table(spark, [(1, None)]), labelled(spark, [])).filter("filter_order = 'BACDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.good_lost) for r in one] == [(1, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_posting_lists_merge_and_gallop():
    from tidemark.llm.filter_audit import gallop, merge

    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b, c = (np.unique(rng.integers(0, rng.choice([3, 50, 5000]), rng.integers(0, 400))) for _ in range(3))
        assert (gallop(a, b) == np.isin(a, b)).all()
        assert (merge([a, b, c]) == np.unique(np.concatenate([a, b, c]))).all()


def test_ranges_are_cut_and_add_up(spark, monkeypatch):
    import pyarrow as pa

    from tidemark.llm import filter_audit as fa

    rng = np.random.default_rng(0)
    part, fails = np.sort(rng.choice(["", "a", "b"], 500)), rng.integers(0, 32, 500).astype(np.int32)
    one = np.ones(500, np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(part[i:i + 70]), pa.array(fails[i:i + 70]), *(pa.array(one[i:i + 70]),) * 3, pa.array(one[i:i + 70])],
                                          ["part", "fails", "removed", "good_lost", "toxic_lost", "id"]) for i in range(0, 500, 70)]

    def summed():
        total = Counter()
        for b in fa._posting_sizes(iter(batches)):
            for r in b.to_pylist():
                for c in ("docs", "failing", "gone", "removed"):
                    total[r["part"], r["before"], r["filter"], c] += r[c]
        return total

    whole = summed()
    monkeypatch.setattr(fa, "RANGE", 16)
    assert summed() == whole
    assert whole["a", 31 - 4, 2, "removed"] == int(((part == "a") & (fails == 4)).sum())
