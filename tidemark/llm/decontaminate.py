"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, A-Z lower-cased. Runs of ``MIN_MATCH`` tokens of the benchmark items are seeds. A
document's runs are found by running (Karp-Rabin) hashes and joined with the seeds; seeds on one diagonal of (document,
item) that follow each other are one match. Then, for each item met, the longest match is marked, again and again, cut
where tokens of either side are marked already, until none of ``MIN_MATCH`` tokens is left. Tiles may come in any order, so
reordered passages count. An item is leaked by a document if its tiles cover ``percent`` of its tokens.

The benchmark is taken in blocks of at most ``block_bytes`` of text (an item longer than that is a block of its own): a block
is collected, which its size bounds, and sent to the tasks; each block is one pass over the documents. No document is shuffled,
and each task's work follows its documents.

Nulls and odd rows: null texts have no tokens; items of fewer than ``MIN_MATCH`` tokens can't be matched; rows that repeat an
item id are items of their own, as are documents; an empty benchmark gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import PLAIN_BREAKS, find_words, slices, window_hashes, window_inside
from tidemark.llm.tables import given_id, keyed

MIN_MATCH = 5


class Seeds:
    """Seeds of a block of items: sorted hashes, and for each the (item, position) pairs that have it."""

    def __init__(self, texts: list[str]):
        hashes, items, places, self.sizes = [], [], [], np.zeros(len(texts), np.int64)
        for lo, hi, data, offsets in slices(pa.array(texts, pa.string())):
            words = find_words(data, offsets, PLAIN_BREAKS)
            self.sizes[lo:hi] = np.diff(words.first)
            runs = window_hashes(words.hashes(lower=True), MIN_MATCH)
            at = np.flatnonzero(window_inside(words, MIN_MATCH)[:len(runs)])
            hashes.append(runs[at])
            items.append(words.text_of[at] + lo)
            places.append(at - words.first[words.text_of[at]])
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.items = np.concatenate(items)[order] if items else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.hashes, self.start = np.unique(h[order], return_index=True)
        self.start = np.r_[self.start, len(h)]
        self.bits = max(16, int(np.ceil(np.log2(len(h) + 1))) + 7)
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self.hashes >> np.uint64(64 - self.bits)] = True

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in runs, numbers of seeds) of the runs that are seeds."""
        maybe = np.flatnonzero(self.filter[runs >> np.uint64(64 - self.bits)])
        if not len(maybe) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, runs[maybe])
        at[at == len(self.hashes)] = 0
        good = self.hashes[at] == runs[maybe]
        return maybe[good], at[good]


def tiles(doc: np.ndarray, item: np.ndarray, n_item: int) -> int:
    """Tokens of the item under tiles, from the (document, item) places of common seeds, sorted by diagonal and place."""
    shift = doc - item
    cut = np.flatnonzero(np.r_[True, (np.diff(shift) != 0) | (np.diff(doc) != 1), True])
    matches = [(int(doc[a]), int(item[a]), int(b - a) + MIN_MATCH - 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    base = int(doc.min())
    marked_item, marked_doc = np.zeros(n_item, bool), np.zeros(int(doc.max()) + MIN_MATCH - base, bool)
    total = 0
    heap = [(-n, d - base, i) for d, i, n in matches]
    heapq.heapify(heap)
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        taken = marked_item[i:i + n] | marked_doc[d:d + n]
        if not taken.any():
            marked_item[i:i + n] = True
            marked_doc[d:d + n] = True
            total += n
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))  # what is left of the match
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a >= MIN_MATCH:
                heapq.heappush(heap, (-(b - a), d + a, i + a))
    return total


def _scan(seeds, item_ids: list[int], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        for batch in batches:
            found = []
            for lo, hi, data, offsets in slices(batch.column(2)):
                words = find_words(data, offsets, PLAIN_BREAKS)
                runs = window_hashes(words.hashes(lower=True), MIN_MATCH)
                at, which = s.find(runs)
                inside = at + MIN_MATCH <= words.first[np.searchsorted(words.first, at, "right")] if len(at) else []
                at, which = at[inside], which[inside]
                if not len(at):
                    continue
                text = np.searchsorted(words.first, at, "right") - 1
                cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    i = int(text[a])
                    found += [(lo + i, *x) for x in _of_text(s, at[a:b] - words.first[i], which[a:b], percent)]
            rows = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())),
                 pa.array([item_ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                 pa.array([f[3] for f in found], pa.int64())], ["id", "tag", "item_id", "n_tokens", "n_covered"])
    return run


def _of_text(s: Seeds, at: np.ndarray, which: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
    """(item, its tokens, its covered tokens) of the items that a text leaks."""
    many = s.start[which + 1] - s.start[which]
    first = np.repeat(s.start[which] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))
    items, places, doc = s.items[first], s.places[first], np.repeat(at, many)
    order = np.lexsort((doc, doc - places, items))
    items, places, doc = items[order], places[order], doc[order]
    cuts = np.flatnonzero(np.r_[True, items[1:] != items[:-1], True])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        item, n = int(items[a]), int(s.sizes[items[a]])
        if 100 * min(n, MIN_MATCH * len(np.unique(places[a:b]))) < percent * n:
            continue  # even apart from each other, the seeds met would cover too little
        covered = tiles(doc[a:b], places[a:b], n)
        if 100 * covered >= percent * n:
            out.append((item, n, covered))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 50, block_bytes: int = 16 << 20, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, tag, item_id, n_tokens, n_covered), a row for each item that a document leaks."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    items = keyed(benchmark, item_col, item_text).withColumn("size", F.octet_length("text"))
    total = items.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))
    out = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id", "tag"), F.lit(blocks)) == k).orderBy("id", "tag").collect()
        seeds = spark.sparkContext.broadcast(Seeds([r.text for r in part]))
        got = rows.mapInArrow(_scan(seeds, [r.id for r in part], percent),
                              "id long, tag long, item_id long, n_tokens long, n_covered long")
        out = got if out is None else out.union(got)
    return out.select(given_id().alias("doc_id"), "tag", given_id("item_id").alias("item_id"), "n_tokens", "n_covered")


def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = 50, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, with their columns as they are."""
    found = leaks(docs, benchmark, percent, id_col=id_col, text_col=text_col)
    bad = found.select(F.col("doc_id").alias("_leak_id"), F.col("tag").alias("_leak_tag")).distinct()
    tag = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(bad["_leak_id"]) & (tag == bad["_leak_tag"]), "left_anti")
