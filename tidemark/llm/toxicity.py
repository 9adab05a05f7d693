"""Toxic spans by a linear-chain conditional random field with two states.

Each word has features: the word itself and its first 3 to 6 letters, with A-Z lower-cased and ASCII punctuation taken off
both ends, hashed into one weight table. The chain adds a weight for each pair of neighbouring states.

Labels are of documents. They become labels of words in this way: a feature is suspect if documents with it are nearly always
toxic (``SUSPECT``) and not too few (``FEWEST``, and ``COMMON`` of the toxic ones); the words of a toxic document that have a suspect feature are labelled toxic, all others, and all words
of other documents, are not. The field's likelihood is climbed on those words. Then a logistic curve over three figures of the
marginals (how many toxic words are expected, their share, the largest) is fitted to the documents' labels.

Marginals come from forward and backward messages. Both are products of 2x2 matrices, so a text is cut into blocks: the
products of all blocks are made side by side, carried along each text, and then every block is run through from its start.
That is exact, and long texts cost no more than short ones.

The model is fitted on the driver, on a sample whose size is a parameter (``rows``, ``text_bytes``); all rows are scored by it.

Nulls and odd rows: an empty text has no words; its score is the curve's value at zeros. Without rows of both labels the
score is the share of toxic rows in the sample, 0 if there are none. Repeated rows get equal scores; every row comes back once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import PLAIN_BREAKS, Words, find_words, mix, slices, span_hashes
from tidemark.llm.labelled import sample
from tidemark.llm.tables import fold

BITS, BLOCK = 18, 32
PREFIXES = (3, 4, 5, 6)
SUSPECT, FEWEST, COMMON = 0.95, 4, 0.02


def _stripped(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without ASCII punctuation at the ends; a word of nothing else keeps its bounds."""
    solid = np.flatnonzero(~PLAIN_BREAKS[words.data])
    if not len(solid):
        return words.starts, words.ends
    at = np.searchsorted(solid, words.starts)
    some = (at < len(solid)) & (solid[np.minimum(at, len(solid) - 1)] < words.ends)
    last = np.searchsorted(solid, words.ends) - 1
    return (np.where(some, solid[np.minimum(at, len(solid) - 1)], words.starts),
            np.where(some, solid[np.maximum(last, 0)] + 1, words.ends))


def features(words: Words) -> np.ndarray:
    """(1 + len(PREFIXES), words) indices into the weight table."""
    starts, ends = _stripped(words)
    letters = np.flatnonzero((words.data & 0xC0) != 0x80)  # first bytes of characters
    first = np.searchsorted(letters, starts)
    letters = np.r_[letters, np.full(max(PREFIXES), len(words.data))]
    out = [span_hashes(words.data, starts, ends, True)]
    for n in PREFIXES:
        out.append(mix(span_hashes(words.data, starts, np.minimum(letters[first + n], ends), True) ^ np.uint64(n)))
    return (np.stack(out) >> np.uint64(64 - BITS)).astype(np.int32)


def _blocks(first: np.ndarray):
    """Blocks of the texts: the word of each (row, block) or -1, each block's text, the blocks' number within it."""
    sizes = np.diff(first)
    count = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + number * BLOCK
    at = start[None, :] + np.arange(BLOCK)[:, None]
    valid = at < first[text + 1][None, :]
    return np.where(valid, at, 0), valid, text, number


def _carry(m: np.ndarray, head: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The pair of messages that enters each block: those that entered the one before, times its matrix (2, 2, blocks).

    ``number`` counts a text's blocks from where the messages start; block number k + 1 follows at its index by ``head``.
    """
    into = np.ones((2, len(number)))
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(number.max() + 2 if len(number) else 1))
    for k in range(1, len(cuts) - 1):
        b = order[cuts[k]:cuts[k + 1]]
        a = head[b]
        x = into[:, a]
        y = np.stack([m[0, 0, a] * x[0] + m[0, 1, a] * x[1], m[1, 0, a] * x[0] + m[1, 1, a] * x[1]])
        into[:, b] = y / y.sum(0)
    return into


def marginals(unary: np.ndarray, first: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Probability of state 1 of each word; unary: log weight of state 1 against 0; pair: log weights of (from, to)."""
    if not len(unary):
        return np.zeros(0)
    at, valid, text, number = _blocks(first)
    e = np.where(valid, np.exp(np.clip(unary, -30, 30))[at], 1.0)
    t = np.exp(pair)
    n = len(text)

    def product(steps, matrix) -> np.ndarray:
        m = np.zeros((2, 2, n))
        m[0, 0] = m[1, 1] = 1.0
        for s in steps:
            a = matrix(s)
            new = np.stack([np.stack([a[0][0] * m[0, j] + a[0][1] * m[1, j] for j in (0, 1)]),
                            np.stack([a[1][0] * m[0, j] + a[1][1] * m[1, j] for j in (0, 1)])])
            new /= new.sum((0, 1))
            m = np.where(valid[s], new, m)
        return m

    lead = number == 0

    def forward(s):
        if s:
            return (t[0, 0], t[1, 0]), (e[s] * t[0, 1], e[s] * t[1, 1])
        # the first word of a text has no state before it
        return (np.where(lead, 1, t[0, 0]), np.where(lead, 0, t[1, 0])), \
            (np.where(lead, 0, e[s] * t[0, 1]), e[s] * np.where(lead, 1, t[1, 1]))

    ahead = product(range(BLOCK), forward)
    count = (-(-np.diff(first) // BLOCK))[text]
    index = np.arange(n)
    a = _carry(ahead, index - 1, number)
    back = product(range(BLOCK - 1, -1, -1), lambda s: ((t[0, 0], t[0, 1] * e[s]), (t[1, 0], t[1, 1] * e[s])))
    b = _carry(back, np.minimum(index + 1, n - 1), count - 1 - number)
    odds = np.empty((BLOCK, n))
    f = a[1] / a[0]
    for s in range(BLOCK):
        step = e[s] * (t[0, 1] + f * t[1, 1]) / (t[0, 0] + f * t[1, 0])
        f = np.where(lead & (s == 0), e[s], np.where(valid[s], step, f))
        odds[s] = f
    g = b[1] / b[0]
    for s in range(BLOCK - 1, -1, -1):
        odds[s] *= g
        g = np.where(valid[s], (t[1, 0] + t[1, 1] * e[s] * g) / (t[0, 0] + t[0, 1] * e[s] * g), g)
    out = np.empty(len(unary))
    out[at[valid]] = (odds / (1 + odds))[valid]
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    pair: np.ndarray
    curve: np.ndarray
    middle: np.ndarray
    width: np.ndarray
    constant: float | None = None

    def unary(self, index: np.ndarray) -> np.ndarray:
        return _unary(self.weights, index, self.bias)

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        z = (figures(p, first) - self.middle) / self.width
        return 1 / (1 + np.exp(-(z @ self.curve[1:] + self.curve[0])))


def figures(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: log of one plus the expected toxic words, their share in hundredths (log), and the largest marginal."""
    total = np.r_[0, np.cumsum(p)]
    count = total[first[1:]] - total[first[:-1]]
    sizes = np.diff(first)
    top = np.zeros(len(sizes))
    full = np.flatnonzero(sizes)
    if len(full):
        top[full] = np.maximum.reduceat(p, first[:-1][full])
    return np.stack([np.log1p(count), np.log1p(100 * count / np.maximum(sizes, 1)), top], 1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = penalty * np.r_[0, np.ones(x.shape[1] - 1)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge) + 1e-9 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) / len(y) + ridge * w)
    return w


def fit(rows: list[tuple[str, int]], rounds: int = 25) -> Model:
    y = np.array([r[1] for r in rows], np.int64)
    constant = None if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.0
    if constant is not None:
        none = np.zeros(3)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, np.zeros((2, 2)), np.zeros(4), none, none + 1, constant)
    size, parts, first = 1 << BITS, [], [np.zeros(1, np.int64)]
    for _, _, data, offsets in slices(pa.array([r[0] for r in rows], pa.string()), 1 << 18):
        words = find_words(data, offsets)
        parts.append(features(words))
        first.append(words.first[1:] + first[-1][-1])
    first = np.concatenate(first)
    index = np.empty((1 + len(PREFIXES), int(first[-1])), np.int32)
    at = 0
    while parts:
        part = parts.pop(0)
        index[:, at:at + part.shape[1]] = part
        at += part.shape[1]
    parts = _parts(first)
    bad, every = np.zeros((len(index), size)), np.zeros((len(index), size))
    for a, b in parts:
        text = np.repeat(np.arange(a, b), np.diff(first[a:b + 1]))
        for k, row in enumerate(index[:, first[a]:first[b]]):
            seen = np.unique(text * size + row)
            bad[k] += np.bincount(seen % size, y[seen // size], size)
            every[k] += np.bincount(seen % size, minlength=size)
    doubtful = (bad >= SUSPECT * every) & (every >= max(FEWEST, COMMON * y.sum()))
    label = np.zeros(index.shape[1], bool)
    for a, b in parts:
        part = index[:, first[a]:first[b]]
        hit = np.any([d[row] for d, row in zip(doubtful, part, strict=True)], axis=0)
        label[first[a]:first[b]] = hit & np.repeat(y[a:b] == 1, np.diff(first[a:b + 1]))
    del bad, every
    weights, square = np.zeros(size), np.full(size, 1e-3)
    bias, pair = -3.0, np.zeros((2, 2))
    square_pair, square_bias = np.full((2, 2), 1e-3), 1e-3
    for _ in range(rounds):  # gradient of the log likelihood; steps shrink with what a weight has moved (AdaGrad)
        grad, d_bias, have, want, pairs = np.zeros((len(index), size)), 0.0, np.zeros((2, 2)), np.zeros((2, 2)), 0
        for a, b in parts:
            lo, hi = first[a], first[b]
            p = marginals(_unary(weights, index[:, lo:hi], bias), first[a:b + 1] - lo, pair)
            q = label[lo:hi].astype(float)
            for g, row in zip(grad, index[:, lo:hi], strict=True):
                g += np.bincount(row, q - p, size)
            d_bias += (q - p).sum()
            inner = np.ones(hi - lo, bool)
            starts = (first[a:b] - lo)[np.diff(first[a:b + 1]) > 0]
            inner[starts] = False
            j = np.flatnonzero(inner)
            pairs += len(j)
            for total, x in ((have, q), (want, p)):  # pair marginals are taken as products of their ends
                total += np.stack([1 - x[j - 1], x[j - 1]]) @ np.stack([1 - x[j], x[j]], 1)
        for g in grad:
            d = g - 0.01 * weights
            square += d * d
            weights += 0.5 * d / np.sqrt(square)
        square_bias += d_bias * d_bias
        bias += 0.5 * d_bias / np.sqrt(square_bias)
        d = (have - want) / max(1, pairs) * 100
        square_pair += d * d
        pair = np.clip(pair + 0.1 * d / np.sqrt(square_pair), -3, 3)
    weights = weights.astype(np.float32)
    x = np.concatenate([figures(marginals(_unary(weights, index[:, first[a]:first[b]], bias), first[a:b + 1] - first[a], pair),
                                first[a:b + 1] - first[a]) for a, b in parts])
    middle, width = x.mean(0), x.std(0) + 1e-6
    return Model(weights, bias, pair, _logistic((x - middle) / width, y), middle, width)


def _parts(first: np.ndarray, words: int = 100_000) -> list[tuple[int, int]]:
    """Ranges of whole texts of about so many words, so that fitting needs little memory besides the features."""
    cuts = np.unique(np.searchsorted(first, np.arange(0, first[-1] + words, words)))
    cuts = np.unique(np.r_[0, np.minimum(cuts, len(first) - 1), len(first) - 1])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _unary(weights: np.ndarray, index: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(index.shape[1], bias)
    for row in index:
        out += weights[row]
    return out


def _spans(words: Words, p: np.ndarray, letters: np.ndarray, i: int, level: float) -> list[dict]:
    """Runs of words at or above ``level`` as (start, end) characters of text i."""
    a, b = words.first[i], words.first[i + 1]
    edge = np.flatnonzero(np.diff(np.r_[False, p[a:b] >= level, False].astype(np.int8))).reshape(-1, 2) + a
    base = letters[words.starts[a]] if a < b else 0
    return [{"start": int(letters[words.starts[x]] - base), "end": int(letters[words.ends[y - 1]] - base)} for x, y in edge.tolist()]


def score(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, rows: int = 4000, text_bytes: int = 64 << 10,
          level: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
          carry: Sequence[str] = ()) -> DataFrame:
    """Per row of docs: doc_id, tag, held_out, score and spans (start, end in characters of the text).

    With ``carry``, also ``row``: a struct of those columns of docs, so that no join is needed to go on with them.
    """
    model = fit(sample(docs, labels, label, fold(F.col("k"), parts) != held, rows, text_bytes, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"),
                        *([F.struct(*carry).alias("row")] if carry else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                words = find_words(data, offsets)
                p = marginals(m.unary(features(words)), words.first, m.pair)
                letters = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                origin = letters[offsets[:-1]]
                spans = []
                hot = np.add.reduceat(np.r_[p >= level, False], np.minimum(words.first[:-1], len(p))) * (np.diff(words.first) > 0)
                for i in range(hi - lo):
                    found = _spans(words, p, letters, i, level) if hot[i] else []
                    lead = int(letters[words.starts[words.first[i]]] - origin[i]) if found else 0
                    spans.append([{"start": s["start"] + lead, "end": s["end"] + lead} for s in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(m.score(p, words.first)),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     *([batch.column(3).slice(lo, hi - lo)] if carry else [])],
                    ["doc_id", "tag", "score", "spans", *(["row"] if carry else [])])

    schema = "doc_id long, tag long, score double, spans array<struct<start:int,end:int>>"
    if carry:
        schema += f", row {given.schema['row'].dataType.simpleString()}"
    out = given.mapInArrow(run, schema)
    return out.select("doc_id", "tag", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", "spans",
                      *(["row"] if carry else []))
