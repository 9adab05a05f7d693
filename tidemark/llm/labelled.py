"""A bounded, balanced sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, text_bytes: int,
           id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` labelled rows, half of them of either label if there are as many.

    ``learn`` says which ids may be learned from. Rows are taken in the order of a hash of the id. Texts of more than
    ``text_bytes`` bytes are left out, so at most rows * text_bytes bytes come to the driver. The ids sent to the tasks
    are bounded by ``rows``; documents are not shuffled.
    """
    known = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label).cast("int").alias("y")) \
        .filter(F.col("k").isNotNull() & F.col("y").isin(0, 1)).filter(learn)
    half = [known.filter(F.col("y") == y).groupBy("k").agg(F.max("y").alias("y"))
            .orderBy(F.xxhash64("k"), "k").limit(rows // 2) for y in (0, 1)]
    chosen = half[0].union(half[1])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("k"), text.alias("text")) \
        .filter(F.octet_length("text") <= text_bytes).join(F.broadcast(chosen), "k") \
        .groupBy("k", "y").agg(F.min("text").alias("text")).orderBy("k", "y")
    return [(r.text, r.y) for r in found.collect()]
