"""Registered queries of this package and the DuckDB SQL that those agree with which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (bpe, decontaminate, filter_audit, html_extract, line_quality, lm_score, minhash_dedup, projected_search, quality_model,
                          substring_dedup, token_alignment, toxicity, warc)
from tidemark.llm.tables import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    at = new_folder(spark, "warc")
    warc.deduplicated(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(at)
    back = spark.read.format("warc").schema(
        "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, "
        "payload binary").load(at)
    # A revisit has no payload, only its length; others are measured, so that payloads are read and checked.
    size = F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(F.length("payload").cast("long"))
    return back.select(warc.page_id("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type",
                       warc.page_id("refers_to").alias("refers_to"))


def word_bpe() -> str:
    """Place of the tokenizer file; a function, as only this default needs the package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_tokens", "n_covered")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), piece_vocabulary())


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_verdicts(table(spark, sf_dir, "documents"))


ORACLE["op10_line_frequency"] = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM docs),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS raw FROM docs),
ln AS (SELECT doc_id, host, text, raw, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line FROM raw),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM ln WHERE line <> '' GROUP BY 1),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM docs GROUP BY 1),
freq AS (SELECT host, line FROM ln JOIN hosts USING (host) WHERE line <> ''
         GROUP BY host, line, texts HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.05 * texts),
gone AS (SELECT doc_id, count(*) AS n_removed_lines, sum(len(string_split(line, ' '))) AS n_removed_words
         FROM ln JOIN freq USING (host, line) GROUP BY 1),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
    CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 50 AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM judged"""


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_alignment.audit(table(spark, sf_dir, "documents"), byte_bpe(), piece_vocabulary())
    return out.withColumnRenamed("groups", "groups_sha256")


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = r"""
WITH d AS (SELECT coalesce(doc_id, 9223372036854775807) AS doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
        min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
        CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * capitals > 10 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first_id < w.doc_id THEN 16 ELSE 0 END AS fails
      FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 4, 8, 16]) AS bit, unnest(['A', 'B', 'C', 'D', 'E']) AS name),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM letters a, letters b, letters c, letters d, letters e
           WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[:step - 1]), 0) AS BIGINT) AS gone
          FROM orders, (SELECT unnest(range(1, 6)) AS step)),
s AS (SELECT part, filter_order, step, bit,
        sum(n) FILTER (fails & (gone | bit) = 0) AS kept, sum(n) FILTER (fails & bit > 0 AND fails & gone = 0) AS removed,
        sum(n) FILTER (fails & bit > 0 AND fails & gone > 0) AS redundant, sum(n) FILTER (fails = bit) AS unique_fails,
        sum(n_good) FILTER (fails & bit > 0 AND fails & gone = 0) AS good_lost,
        sum(n_toxic) FILTER (fails & bit > 0 AND fails & gone = 0) AS toxic_lost
      FROM g, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM s"""


@query
def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_search.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)
