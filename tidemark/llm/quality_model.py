"""Document quality by a factorisation machine.

A document is a sparse vector: its words, hashed into ``BUCKETS`` (a word weighs its share of the text, and each of a
text's words counts), the structure statistics of ``STATS`` and the text's length. The score is

    w0 + sum(w_i x_i) + 1/2 sum_f[(sum v_if x_i)^2 - sum v_if^2 x_i^2]

so all pairwise interactions cost as much as the single terms: time grows with a text's words times ``FACTORS``.

The model is fitted on the driver, on a sample whose size is a parameter (``rows``, ``text_bytes``), by AdaGrad on the
logistic loss; all rows are scored by it.

Nulls and odd rows: an empty text has no words and statistics of zero, and is scored like any other. Without rows of both
labels the score is the share of label 1 in the sample, 0 if there are none. Repeated rows get equal scores; every row comes
back once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import find_words, slices
from tidemark.llm.labelled import sample
from tidemark.llm.tables import fold

BITS, FACTORS = 14, 6
BUCKETS = 1 << BITS
STATS = ("log words", "log characters", "mean word length", "capitals", "digits", "symbols", "other punctuation", "bars",
         "line ends per word", "distinct words", "repeated 3-word runs", "words with a symbol", "wide characters")

_CLASS = np.zeros(256, np.int8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#*$%&<>"]] = 3
_CLASS[[ord(c) for c in "!\"'(),-./:;?@[\\]^_`{}~+="]] = 4
_CLASS[ord("|")] = 5
_CLASS[10] = 6
_CLASS[128:192] = 7


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, offsets of the texts' entries, statistics) of the texts of a slice."""
    words = find_words(data, offsets)
    h = words.hashes(lower=True)
    text, n = words.text_of.astype(np.int64), np.diff(words.first)
    pair = (text << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64)
    entry, count = np.unique(pair, return_counts=True)
    owner = entry >> BITS
    value = np.sqrt(count / np.maximum(n, 1)[owner])
    at = np.searchsorted(owner, np.arange(len(n) + 1))
    size = np.diff(offsets)
    classes = np.zeros((len(n), 8))
    row = np.repeat(np.arange(len(n)), size)
    np.add(classes, np.bincount(row * 8 + _CLASS[data], minlength=8 * len(n)).reshape(-1, 8), out=classes)
    marks = np.r_[0, np.cumsum((_CLASS[data] >= 3) & (_CLASS[data] <= 5) & (_CLASS[data] != 4))]
    marked = np.bincount(text, marks[words.ends] > marks[words.starts], len(n))
    runs = np.zeros(len(n))
    if len(h) > 2:
        three = (h[:-2] * np.uint64(3)) ^ (h[1:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[2:] * np.uint64(0xD6E8FEB86659FD93))
        same = text[:-2] == text[2:]
        order = np.lexsort((three[same], text[:-2][same]))
        t, g = text[:-2][same][order], three[same][order]
        again = np.r_[False, (t[1:] == t[:-1]) & (g[1:] == g[:-1])] if len(t) else np.zeros(0, bool)
        runs = np.bincount(t, again, len(n))
    per_word, per_byte = 1 / np.maximum(n, 1), 1 / np.maximum(size, 1)
    stats = np.stack([np.log1p(n), np.log1p(size - classes[:, 7]), (size - n) * per_word, classes[:, 1] * per_byte,
                      classes[:, 2] * per_byte, classes[:, 3] * per_byte, classes[:, 4] * per_byte,
                      classes[:, 5] * per_byte, classes[:, 6] * per_word, np.diff(at) * per_word, runs * per_word,
                      marked * per_word, classes[:, 7] * per_byte], 1)
    return (entry & (BUCKETS - 1)), value, at, stats


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows of x over each text's entries."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


@dataclass
class Machine:
    """Weights of buckets and statistics: w0, w (BUCKETS + stats) and v (BUCKETS + stats, FACTORS)."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    middle: np.ndarray
    width: np.ndarray
    constant: float | None = None

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.middle) / self.width, -5, 5) / 2

    def parts(self, bucket, value, at, dense):
        """(linear score, sum of v x for each factor, whole score)."""
        vx = self.v[bucket] * value[:, None]
        wide = self.v[BUCKETS:]
        linear = self.w0 + _sums(self.w[bucket] * value, at) + dense @ self.w[BUCKETS:]
        total = _sums(vx, at) + dense @ wide
        squares = _sums((vx ** 2).sum(1), at) + (dense ** 2) @ (wide ** 2).sum(1)
        return total, linear + 0.5 * ((total ** 2).sum(1) - squares)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        bucket, value, at, stats = vectors(data, offsets)
        return 1 / (1 + np.exp(-np.clip(self.parts(bucket, value, at, self.dense(stats))[1], -30, 30)))


def fit(rows: list[tuple[str, int]], rounds: int = 20, rate: float = 0.05, penalty: float = 1e-4) -> Machine:
    y = np.array([r[1] for r in rows], np.float64)
    k = len(STATS)
    if not 0 < y.sum() < len(y):
        return Machine(0.0, np.zeros(BUCKETS + k), np.zeros((BUCKETS + k, FACTORS)), np.zeros(k), np.ones(k),
                       float(y.mean()) if len(y) else 0.0)
    parts = [vectors(data, offsets) for _, _, data, offsets in slices(pa.array([r[0] for r in rows], pa.string()))]
    bucket, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    stats = np.concatenate([p[3] for p in parts])
    at = np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]
    rng = np.random.default_rng(0)
    m = Machine(0.0, np.zeros(BUCKETS + k), rng.normal(0, 0.05, (BUCKETS + k, FACTORS)), stats.mean(0), stats.std(0) + 1e-9)
    dense = m.dense(stats)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    order = rng.permutation(len(y))
    g_w, g_v, g_0 = np.full(BUCKETS + k, 1e-6), np.full((BUCKETS + k, FACTORS), 1e-6), 1e-6
    batch = 256
    for _ in range(rounds):
        for start in range(0, len(y), batch):
            pick = order[start:start + batch]
            sizes = at[pick + 1] - at[pick]
            flat = np.concatenate([np.arange(at[i], at[i + 1]) for i in pick]) if len(pick) else np.zeros(0, int)
            b, x, own = bucket[flat], value[flat], np.r_[0, np.cumsum(sizes)]
            d = dense[pick]
            total, z = m.parts(b, x, own, d)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            e = np.repeat(err, sizes)
            used, place = np.unique(b, return_inverse=True)
            gw = np.bincount(place, e * x, len(used)) + penalty * m.w[used]
            vx = m.v[b] * x[:, None]
            grad = (e * x)[:, None] * (np.repeat(total, sizes, 0) - vx)
            gv = np.stack([np.bincount(place, grad[:, f], len(used)) for f in range(FACTORS)], 1) + penalty * m.v[used]
            dw = d.T @ err + penalty * m.w[BUCKETS:]
            wide = m.v[BUCKETS:]
            dv = d.T @ (err[:, None] * total) - ((d ** 2).T @ err)[:, None] * wide + penalty * wide
            where = np.r_[used, np.arange(BUCKETS, BUCKETS + k)]
            gw, gv = np.r_[gw, dw], np.r_[gv, dv]
            g_w[where] += gw ** 2
            g_v[where] += gv ** 2
            m.w[where] -= rate * gw / np.sqrt(g_w[where])
            m.v[where] -= rate * gv / np.sqrt(g_v[where])
            g_0 += err.sum() ** 2
            m.w0 -= rate * err.sum() / np.sqrt(g_0)
    return m


def score(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, rows: int = 6000, text_bytes: int = 64 << 10,
          id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """Per row of docs: doc_id, tag, held_out and score (that the label is 1)."""
    model = fit(sample(docs, labels, label, fold(F.col("k"), parts) != held, rows, text_bytes, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(shared.value.score(data, offsets))],
                    ["doc_id", "tag", "score"])

    out = given.mapInArrow(run, "doc_id long, tag long, score double")
    return out.select("doc_id", "tag", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score")
