"""A corpus pipeline over the documents table; each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read back as the
next one's docs. All but the last return the columns of documents, and at most change the text.

Nulls and odd rows: a document without text passes every stage that judges texts; rows without id are kept by the near-duplicate stage;
repeated rows are copies, of which that stage keeps one; different texts that share an id are documents of their own; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, minhash_dedup, substring_dedup, toxicity
from tidemark.llm.queries import word_bpe
from tidemark.llm.tables import new_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field's score doesn't call toxic."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return scored.filter(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Copies are one document; different texts of one id
    stay if their groups have no smaller id."""
    kept = minhash_dedup.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL") \
        .select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    named = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tag0"))
    found = named.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_tag0") == F.col("_tag")))
    return found.dropDuplicates(["doc_id", "_tag0"]).select(*COLUMNS).union(docs.filter("doc_id IS NULL").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier document has too; n_chars follows the text."""
    out = substring_dedup.without_repeats(docs, carry=("lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    return out.select("doc_id", "text", "row.lang", "row.source",
                      F.when(cut, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to as many tokens."""
    out = bpe.round_trip(docs, word_bpe())
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeated passages", cut_repeats),
          ("decontamination", drop_leaks), ("encoding", encode)]

#: The scores of the first stage are no matter for SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
