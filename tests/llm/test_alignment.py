"""Token alignment against the tokenizers' libraries and a plain two-pointer walk."""

import hashlib
import random
from collections import Counter

import messy
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b\n  c\n\n d \t e", " x　y z w​v", "<|endoftext|> <s> </s><unk>", "▁ a▁b", "x ▁", "   ", " ", "é ﬁ ½ ² ٣ 🙂👍🏽 日本語 。 tout à fait",
       "\x00 \x01y \x1c z\x85 q", "don't I'LL we're", "a" * 300 + " " + "b " * 50, "naïve—x … “q” ,.;!?", "x\r\n y\x0b z", "ação é bom", "<0x41> A", "᠎ k"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {c: b"%c" % c for c in own} | {256 + k: b"%c" % c for k, c in enumerate(c for c in range(256) if c not in own)}

    def tokens(text):
        text = " " + text
        ids_a, ids_b = a.encode(text, add_special_tokens=False).ids, b.encode(text[1:])
        bytes_a = [b"".join(letter[ord(c)] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != text.encode() or b"".join(bytes_b) != text.encode():
            return [], [], [], []
        return ids_a, ids_b, np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    return tokens


def brute(library, data):
    docs, count = [], Counter()
    for i, text in data:
        a, b, ends_a, ends_b = library(text) if text else ([], [], [], [])
        both = sorted(set(map(int, ends_a)) & set(map(int, ends_b)))
        cut, groups, links = 0, [], []
        for e in both:
            ga = [str(x) for x, end in zip(a, ends_a) if cut < end <= e]
            gb = [str(x) for x, end in zip(b, ends_b) if cut < end <= e]
            groups.append(",".join(ga) + "|" + ",".join(gb))
            links.append((int(ga[-1]), int(gb[-1])))
            cut = e
        count.update(links)
        docs.append((i, len(a), len(b), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return Counter((i, na, nb, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for i, na, nb, links, g in docs)


def test_equals_walking_both_token_lists(spark, library):
    from tidemark.llm import token_alignment as ta

    rng = random.Random(5)
    mixed = ["".join(rng.choice(ODD + [" "] * 8 + messy.SYLLABLES) for _ in range(30)) for _ in range(40)]
    data = [(i, t) for i, t in messy.rows() if not t or len(t) < 20_000] + [(1000 + k, t) for k, t in enumerate(ODD + mixed)]
    got = ta.audit(messy.table(spark, data), BYTE, PIECE).collect()
    want, have = brute(library, data), Counter(tuple(r) for r in got)
    assert sorted((have - want).items(), key=str)[:3] == sorted((want - have).items(), key=str)[:3]
    assert have == want
    assert any(r.groups == "" and r.doc_id == 1003 for r in got)


def test_very_long_text_and_groups_as_text(spark, library):
    from tidemark.llm import token_alignment as ta

    text = next(t for i, t in messy.rows() if i == 306)
    row = ta.alignments(messy.table(spark, [(306, text), (1, "ab c")]), BYTE, PIECE).collect()
    a, b, ends_a, ends_b = library(text)
    assert (row[0].n_a, row[0].n_b, row[0].n_links) == (len(a), len(b), len(set(ends_a.tolist()) & set(ends_b.tolist())))
    assert row[0].groups.replace("|", ";").replace(",", ";").count(";") + 1 == len(a) + len(b)
    assert row[1].groups.count("|") == row[1].n_links


def test_empty_tables(spark):
    from tidemark.llm import token_alignment as ta

    assert ta.audit(messy.empty(spark), BYTE, PIECE).count() == 0


def test_a_full_table_of_chunks_changes_nothing(monkeypatch):
    from tidemark.llm import token_alignment as ta

    texts = pa.array([t for t in ODD] * 2 + [None, ""])

    def groups(known, limit):
        return [bytes(g.groups[i:j]) for _, _, d, o in ta.slices(texts, limit)
                for g in [known.align(*ta._spaced(d, o))] for i, j in zip(g.group_offsets[:-1], g.group_offsets[1:])]

    v = ta.vocabularies(BYTE, PIECE)
    whole = groups(ta.Chunks(v), 1 << 20)
    monkeypatch.setattr(ta, "KEEP_CHUNKS", 3)
    assert groups(ta.Chunks(v), 10) == whole


def test_pointer_jumping_on_long_chains():
    from tidemark.llm.token_alignment import terminals

    n = 5000  # tokens of two bytes, shifted by one against each other: one component, twice
    a, b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n, 2), 2 * n)
    ends_a, ends_b = np.concatenate([a, a + 2 * n]), np.concatenate([b, b + 2 * n])
    of_a, of_b, _ = terminals(ends_a, ends_b)
    assert set(of_a.tolist()) == set(of_b.tolist()) == {len(b) - 1, 2 * len(b) - 1}
    assert (np.diff(of_a) >= 0).all() and (np.diff(of_b) >= 0).all()


def test_pairs_are_bounded_by_the_vocabularies():
    from tidemark.llm import token_alignment as ta

    v = ta.vocabularies(BYTE, PIECE)
    assert v.pairs < 20 * (v.size_a + v.size_b)
    counts = np.ones(v.pairs, np.int64)
    assert (v.best(counts) == 1).all()
