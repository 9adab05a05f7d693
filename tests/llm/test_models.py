"""Classifiers: exact inference against brute force, held-out accuracy, messy and empty tables."""

import random

import numpy as np
import messy
import pytest


@pytest.fixture(scope="module")
def labelled(spark):
    """300 texts of which a third is toxic, and a third of low quality."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        w = messy.words(rng, rng.randrange(20, 120), 4000)
        toxic, good = int(i % 3 == 0), int(i % 5 > 1)
        if toxic:
            for _ in range(1 + len(w) // 12):
                w[rng.randrange(len(w))] = rng.choice(["Bad!", "nasty,", "vileka", "vilemi", "vileru"])
        if not good:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, good, toxic, "x"))
    labels += [(0, labels[0][1], labels[0][2], "again"), (None, 1, 1, "x"), (1, None, None, "x"), (9999, 1, 1, "no text")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    return rows, table, {i: (q, t) for i, q, t, _ in labels[:300]}


def test_marginals_equal_brute_force():
    from tidemark.llm.toxicity import marginals

    rng = np.random.default_rng(1)
    first = np.r_[0, np.cumsum([0, 1, 2, 33, 70, 0, 5, 64, 32])]
    u, pair = rng.normal(size=first[-1]) * 2, rng.normal(size=(2, 2))
    p, t = marginals(u, first, pair), np.exp(pair)
    for a, b in zip(first[:-1], first[1:]):
        psi = np.stack([np.ones(b - a), np.exp(u[a:b])], 1)
        ahead, back = psi.copy(), np.ones((b - a, 2))
        for k in range(1, b - a):
            ahead[k] = psi[k] * (ahead[k - 1] @ t)
            ahead[k] /= ahead[k].sum()
        for k in range(b - a - 2, -1, -1):
            back[k] = t @ (psi[k + 1] * back[k + 1])
            back[k] /= back[k].sum()
        q = ahead * back
        assert np.allclose(q[:, 1] / q.sum(1), p[a:b])
    assert len(marginals(np.zeros(0), np.zeros(1, np.int64), pair)) == 0


def test_toxicity_finds_held_out_documents_and_their_spans(spark, labelled):
    from tidemark.llm import toxicity

    rows, labels, truth = labelled
    docs = messy.table(spark, rows + [(5000, None), (5001, ""), (None, "bad nasty vile"), (5002, "é🙂 nasty, é bad é")])
    got = toxicity.score(docs, labels, carry=("doc_id", "tag")).collect()
    assert len(got) == 304
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum((r.score >= 0.7) == truth[r.doc_id][1] for r in held)
    assert len(held) > 60 and right >= 0.97 * len(held)
    text, found = dict(rows), []
    for r in got:
        assert 0 <= r.score <= 1 and r.row.doc_id == r.doc_id
        for s in r.spans:
            t = text.get(r.doc_id) or ("bad nasty vile" if r.doc_id is None else "é🙂 nasty, é bad é")
            found += [w.strip("#,!").lower()[:4] in ("bad", "nast", "vile") for w in t[s.start:s.end].split()]
    assert len(found) > 100 and sum(found) >= 0.95 * len(found)
    assert {(s.start, s.end) for r in got if r.doc_id == 5002 for s in r.spans} == {(3, 9), (12, 15)}
    assert toxicity.score(messy.empty(spark), labels).count() == 0
    nothing = toxicity.score(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.0}


def test_quality_machine(spark, labelled):
    from tidemark.llm import quality_model as qm

    rows, labels, truth = labelled
    docs = messy.table(spark, rows + [(5000, None), (5001, ""), (None, "some words")])
    got = qm.score(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 303 and len(held) > 30
    assert sum((r.score >= 0.3) == truth[r.doc_id][0] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert qm.score(messy.empty(spark), labels).count() == 0
    assert {r.score for r in qm.score(docs, labels.limit(0)).collect()} == {0.0}
    assert qm.score(messy.table(spark), labels).count() == len(messy.rows())


def test_linear_time_score_equals_all_pairs():
    from tidemark.llm import quality_model as qm

    m = qm.fit([("good plain words here " * k, 1) for k in range(1, 9)] + [("### bad $$ %% words " * k, 0) for k in range(1, 9)], rounds=3)
    text = b"good ### words words here"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    bucket, value, at, stats = qm.vectors(data, offsets)
    x = np.zeros(qm.BUCKETS + len(qm.STATS))
    x[bucket], x[qm.BUCKETS:] = value, m.dense(stats)[0]
    used = np.flatnonzero(x)
    pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for k, i in enumerate(used) for j in used[:k])
    assert m.parts(bucket, value, at, m.dense(stats))[1][0] == pytest.approx(m.w0 + m.w @ x + pairs)
