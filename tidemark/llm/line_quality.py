"""Quality rules: cross-document line frequency, in built-in column functions only.

Lines are normalised (lower case, white space made one space, trimmed) and hashed. Per host, the distinct texts that
hold a line are counted: exact copies of one text count once, as they are no boilerplate but copies. A line is
frequent when more than ``max_docs`` texts of its host hold it and these are more than ``max_share`` of the host's
texts. Frequent lines go; a document that keeps fewer than ``min_words`` words, or less than ``min_kept`` of its
words, is depleted and rejected. Before that come the plain rules of one document (too short, too repetitive).

Scale: lines are narrowed to (host, hash, document) before they are shuffled, counts are combined before the shuffle,
and a frequent line's matches are joined without an operator above that needs the line's rows together, so that
Spark can split a hot line. No text is shuffled.

Nulls and odd rows: a null text is empty and fails the base rules; a null host is a host of its own; repeated rows
are judged alike, each on its own; ties do not occur, as all limits are counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import SPACE, SPACE_PATTERN, given_id, key_columns

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    max_docs: int = 20
    max_share: float = 0.05
    min_words: int = 50
    min_kept: float = 0.5
    max_repeat_percent: int = 50


def let(value: Column, body) -> Column:
    """body(value), with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    """Words of a text in order; empty for a text without words."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


def _covered_by_repeats(grams: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows are sorted by (hash, place), equal neighbours found,
    and the lengths of the union of their places added."""
    def flagged(s: Column) -> Column:
        near = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"]))
                        | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(near, lambda e: e["i"]))

    def length(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    placed = F.sort_array(F.transform(grams, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(let(placed, flagged), length)


def repeat_words(words: Column) -> Column:
    n = F.size(words)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                                       lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])))
    return let(F.coalesce(grams, F.array().cast("array<bigint>")),
               lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long"))
               .otherwise(_covered_by_repeats(g)))


def text_stats(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text that is not null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(word_list(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE_PATTERN, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words")))


def normal_line(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, SPACE_PATTERN, " "), F.lit(" ")))


def frequent_lines(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lines, frequent): lines(host, id, tag, line, words, at) of all documents, and the frequent (host, line)."""
    rows = _with_host(docs, id_col, text_col, host_col)
    lines = rows.select("host", "id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw")) \
        .select("host", "id", "tag", "at", normal_line(F.col("raw")).alias("line")).filter("line <> ''") \
        .select("host", "id", "tag", "at", F.xxhash64("line").alias("line"),
                F.size(F.split("line", " ")).alias("words"))
    per_host = rows.groupBy("host").agg(F.countDistinct("tag").alias("texts"))
    counts = lines.groupBy("host", "line").agg(F.countDistinct("tag").alias("n")).filter(F.col("n") > rules.max_docs)
    frequent = counts.join(per_host, "host").filter(F.col("n") > rules.max_share * F.col("texts")) \
        .select("host", "line", "n")
    return lines, frequent


def _with_host(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    return docs.select(host, *key_columns(id_col, text_col))


def line_verdicts(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, the base statistics, base_failed, kept, n_removed_lines and n_removed_words."""
    lines, frequent = frequent_lines(docs, rules, id_col, text_col, host_col)
    gone = lines.join(frequent.select("host", "line"), ["host", "line"]) \
        .select("host", "id", "tag", "at", "words").distinct() \
        .groupBy("host", "id", "tag").agg(F.count("*").alias("n_removed_lines"), F.sum("words").alias("n_removed_words"))
    stats = _with_host(docs, id_col, text_col, host_col).select("host", "id", "tag", text_stats(F.col("text")).alias("s"))
    base = stats.select("host", "id", "tag", "s.*")
    out = base.join(gone, ["host", "id", "tag"], "left").na.fill(0, ["n_removed_lines", "n_removed_words"])
    failed = (F.col("n_words") < rules.min_words) \
        | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < rules.min_words) | (left < rules.min_kept * F.col("n_words"))
    return out.select(given_id().alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
                      "n_removed_lines", "n_removed_words")


def without_frequent_lines(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id",
                           text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs, with frequent lines taken out of the text; rows without one are unchanged."""
    lines, frequent = frequent_lines(docs, rules, id_col, text_col, host_col)
    gone = lines.join(frequent.select("host", "line"), ["host", "line"]).groupBy("host", "id", "tag") \
        .agg(F.collect_set("at").alias("_gone_at"))
    key, tag, text = key_columns(id_col, text_col)
    cut = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, k: ~F.array_contains(F.col("_gone_at"), k)), "\n")
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    at = [host == gone["host"], key == gone["id"], tag == gone["tag"]]
    joined = docs.join(gone, at, "left")
    return joined.select(*[F.when(F.col("_gone_at").isNull(), docs[c]).otherwise(cut).alias(c) if c == text_col
                           else docs[c] for c in docs.columns])
