"""Operators on texts against brute force, on messy tables and on empty ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import messy


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def split(text):
    return (text or "").encode().split()


# ---- 2: BPE

def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = ["İstanbul ΣΑΣ ΟΔΟΣ", "a b c　d", "<|endoftext|>x <|startoftext|><|endoftext|> <|END|> it's I'LL don't",
           "aaaaaa aaa aaaaaaa !!!!!!!!", "é ́x á", "🙂👍🏽 日本語 ½ ² 123 ٣", "\x1c\x85x \x00y ẞ ﬁ", "ǅ Å", "'S 'sS ''s"]
    data = messy.rows() + [(1000 + k, t) for k, t in enumerate(odd)]
    docs = messy.table(spark, data)
    want = Counter()
    for i, t in data:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.round_trip(docs, path).collect()) == want
    two = bpe.decode(bpe.encode(docs, path), path)
    assert Counter((r.doc_id, r.decoded) for r in two.collect()) == Counter((i, d) for (i, _, d), n in want.items() for _ in range(n))
    assert bpe.round_trip(messy.empty(spark), path).count() == 0
    small = bpe.Bpe(path)
    small_texts = pa.array([t for t in odd] * 3)
    for _, _, d, o in bpe.slices(small_texts, 10):  # one text a slice, and a table that is emptied in between
        small.encode(d, o)
        small.forget()


# ---- 3: substring dedup

@pytest.mark.parametrize("width,group_size", [(50, 1_000_000), (20, 3)])
def test_repeats_equal_brute_force(spark, width, group_size):
    from tidemark.llm import substring_dedup as sd

    rng = random.Random(width)
    pool = [messy.words(rng, 70) for _ in range(3)]
    extra = [(1000 + k, " ".join(messy.words(rng, 20) + pool[k % 3][rng.randrange(20):] + messy.words(rng, 5))) for k in range(20)]
    data = messy.rows() + extra
    last = 1 << 62
    first = {}
    for i, t in data:
        w = split(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, last), last if i is None else i)
    want = Counter()
    for i, t in data:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < (last if i is None else i):
                gone[k:k + width] = [True] * width
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    got = sd.without_repeats(messy.table(spark, data), width, group_size, carry=("lang", "tag")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert all(r.text.split() == r.kept.split() or " " in r.text for r in got) and {r.row.tag for r in got} == {"x"}
    given = Counter((i, t or "") for i, t in data)
    assert all(given[r.doc_id, r.text] for r in got if not r.n_removed)
    assert sd.without_repeats(messy.empty(spark)).count() == 0


# ---- 5: near duplicates

def shingles(text):
    w = lower(text).encode().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(data):
    """Smallest id reachable over links, by comparing all pairs."""
    known = [(i, shingles(t)) for i, t in data if i is not None and t]
    parent = {i: i for i, _ in data if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            (i, x), (j, y) = known[a], known[b]
            n = len(x & y)
            if n and 100 * n >= 75 * (len(x) + len(y) - n):
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    return {i: root(i) for i in parent}


def near_data(seed):
    """A large group that strays from its centre, so that not all of it hangs together."""
    rng = random.Random(seed)
    base, out = messy.words(rng, 120), []
    for k in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8, 16])):
            text[rng.randrange(len(text))] = f"own{k}{rng.random()}"
        out.append((2000 + k, " ".join(text)))
    return out


def test_components_equal_brute_force(spark):
    from tidemark.llm import minhash_dedup as md

    data = messy.rows(1) + near_data(2)
    want = classes(data)
    got = md.near_duplicates(messy.table(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    sizes = Counter((i, len(shingles(t))) for i, t in data)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    assert md.near_duplicates(messy.empty(spark)).count() == 0


def test_few_pairs_are_few_tasks(spark):
    """Spark may join partitions that a number given to repartition would keep apart."""
    from tidemark.llm import minhash_dedup as md

    texts = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(30 + k))) for k in range(3)], "rep long, text string")
    links = md._links(spark.createDataFrame([(0, 1), (0, 2)], "p long, q long"), texts, 75)
    assert sorted((r.a, r.b) for r in links.collect()) == [(0, 1), (0, 2)]
    assert "REPARTITION_BY_COL" in links._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" not in links._jdf.queryExecution().toString()


def test_chunks_guarantee_the_signature_distance():
    from tidemark.llm import minhash_dedup as md

    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, md.SYMBOLS).astype("<u2")
        b = a.copy()
        b[rng.choice(md.SYMBOLS, md.GUARANTEED, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], ["rep", "sign"])
        keys = defaultdict(set)
        for out in md._key_rows(iter([batch])):
            for k, r in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                keys[k].add(r)
        assert any(len(v) == 2 for v in keys.values())


def test_components_of_a_long_path(spark):
    from tidemark.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 7), (3, 2)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100}


# ---- 7: decontamination

def test_leaks_in_any_order_are_found(spark):
    from tidemark.llm import decontaminate as dc

    rng = random.Random(5)
    item, other = messy.words(rng, 40, 4000), messy.words(rng, 40, 4000)
    around = messy.words(rng, 50, 4000)
    parts = [item[30:], item[15:30], item[:15]]
    data = messy.rows() + [(1, " ".join(around + item)), (2, " ".join(around + sum(parts, []))), (3, " ".join(w.upper() + "," for w in item)),
                           (4, " ".join(around + item[:12])), (5, " ".join(item[k] for k in range(0, 40, 2)))]
    bench = spark.createDataFrame([(7, " ".join(item), "x"), (8, " ".join(other), "x"), (9, "too short", "x"), (None, None, "x"), (10, "", "x")],
                                  "item_id long, text string, id string")
    base = [r for r in data if r not in data[len(messy.rows()):]]
    got = {(r.doc_id, r.item_id, r.n_tokens, r.n_covered) for r in dc.leaks(messy.table(spark, data), bench).collect()}
    assert got == {(1, 7, 40, 40), (2, 7, 40, 40), (3, 7, 40, 40)}
    small = {(r.doc_id, r.item_id) for r in dc.leaks(messy.table(spark, data), bench, block_bytes=100).collect()}
    assert small == {(d, i) for d, i, *_ in got}
    clean = dc.clean_documents(messy.table(spark, data), bench)
    assert clean.columns == messy.table(spark).columns and clean.count() == len(base) + 2
    assert dc.leaks(messy.empty(spark), bench).count() == 0
    assert dc.leaks(messy.table(spark), bench.limit(0)).count() == 0


def test_tiles_are_greedy_and_do_not_overlap():
    from tidemark.llm.decontaminate import tiles

    # one item of 12 tokens met whole, and its first 8 once more elsewhere: the longest match wins, tokens count once
    doc, item = np.r_[100:108, 20:24], np.r_[0:8, 0:4]
    order = np.lexsort((doc, doc - item))
    assert tiles(doc[order], item[order], 12) == 12
    assert tiles(np.array([5]), np.array([2]), 12) == 5


# ---- 9: language model

def test_lattice_sums_over_all_segmentations():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from tidemark.llm import lm_score as lm

    path = public_tokenizers.path("piece_bpe_32k.model")
    v = lm.load(path)
    sp = SentencePieceProcessor(model_file=path)
    index = {}
    for i in range(sp.get_piece_size()):
        w = sp.id_to_piece(i).encode()
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and w.count(lm.MARK) == w.startswith(lm.MARK):
            index[w] = np.searchsorted(v.hashes, lm._span(lm._prefix(np.frombuffer(w, np.uint8)[None, :]), 0, len(w))[0])
    words = [w.encode() for w in ["the", "äßx", "ththonnt!", "x" * 30, "日本", "a"]]
    size = np.array([len(w) for w in words])
    got = lm.word_scores(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, v)
    for w, g in zip(words, got):
        b = lm.MARK + w
        p = [1.0]
        for j in range(1, len(b) + 1):
            p.append(p[j - 1] * math.exp(v.byte_log_p[b[j - 1]])
                     + sum(p[i] * math.exp(v.log_p[index[b[i:j]]]) for i in range(j) if b[i:j] in index))
        assert math.log(p[-1]) == pytest.approx(g)


def test_scores_and_counts(spark):
    import public_tokenizers

    from tidemark.llm import lm_score as lm

    path = public_tokenizers.path("piece_bpe_32k.model")
    data = messy.rows()
    learn = lambda i: (zlib.crc32(str(i).encode()) % 7 if i is not None else 0) != 2
    tokens = lambda t: [*lower(t).encode().split(), None]
    c = Counter(x for i, t in data if learn(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, not learn(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n,
                    round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 4)) for i, t in data)
    for size in (16 << 20, 20_000):  # one batch, and several
        got = lm.score(messy.table(spark, data), path, batch_bytes=size).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert lm.score(messy.empty(spark), path).count() == 0


def test_pieces_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    import public_tokenizers

    from tidemark.llm import lm_score as lm

    path = public_tokenizers.path("piece_bpe_32k.model")
    data = [(i, t) for i, t in messy.rows() if t and len(t) < 5000] + [(400 + k, "the frequent words of all rows") for k in range(9)]
    docs = messy.table(spark, data)
    one = lm.fit(docs.repartition(1), path, 7, 2, "doc_id", "text")
    many = lm.fit(docs.repartition(9), path, 7, 2, "doc_id", "text")
    learn = lambda i: (zlib.crc32(str(i).encode()) % 7 if i is not None else 0) != 2
    texts = [t for i, t in data if learn(i)]
    words = sorted({w for t in texts for w in lower(t).encode().split()})
    size, v = np.array([len(w) for w in words]), lm.load(path)
    want = np.zeros(len(v.hashes) + 257)
    lm.word_scores(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, v, np.ones(len(words)), want[:-1])
    want[-1] = len(texts)
    for pieces, rows, held in (one, many):
        assert (rows, held) == (len(texts), sum(len(t.encode()) for _, t in data))
        assert np.allclose(pieces.log_p, v.with_counts(want).log_p, rtol=0, atol=1e-9)


# ---- 10: line frequency

def test_line_verdicts_equal_brute_force(spark):
    from tidemark.llm import line_quality as lq

    rng = random.Random(3)
    data = [(k, "\n".join([f"Common  line of {'all' if k < 40 else 'some'}", " ".join(messy.words(rng, 60, 4000))])) for k in range(60)]
    data += [(100 + k, "common LINE of all\n" + " ".join(messy.words(rng, 10, 4000))) for k in range(5)] + messy.rows()
    data += [(500, " ".join(["r e p"] * 30)), (501, "x # y * $$\n\nx # y * $$\n")]
    host = lambda i: "" if i == 303 else "src"
    norm = lambda line: " ".join(re.split(r"[\x20\x09-\x0D]+", line)).strip(" ").lower()
    have, texts = defaultdict(set), defaultdict(set)
    for i, t in data:
        texts[host(i)].add(t or "")
        for line in (t or "").split("\n"):
            if norm(line):
                have[host(i), norm(line)].add(t)
    bad = {k for k, s in have.items() if len(s) > 20 and len(s) > 0.05 * len(texts[k[0]])}
    assert bad == {("src", "common line of all")}
    want = Counter()
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.split(None) and re.search(r"[^\x20\x09-\x0D]", x)]
        gone = sum(len(norm(x).split(" ")) for x in (t or "").split("\n") if (host(i), norm(x)) in bad)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not failed and len(w) - gone >= 50 and len(w) - gone >= 0.5 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed, kept, gone] += 1
    docs = messy.table(spark, data)
    got = lq.line_verdicts(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_removed_words)
                   for r in got) == want
    cut = lq.without_frequent_lines(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.filter("lower(text) like '%common  line of all%' or lower(text) like '%common line of all%'").count() == 0
    assert lq.line_verdicts(messy.empty(spark)).count() == 0
