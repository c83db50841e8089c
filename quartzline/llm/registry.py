"""The queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_main, katz_lm, license_scan, mixing, near_dedup, quality_rules, secret_scan, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents")).drop("found")


def op4_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.lm_scores(table(spark, sf_dir, "documents"))


def byte_bpe_50k() -> str:
    """Path of the tokenizer file that the query uses; the operator takes any."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), byte_bpe_50k())


def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return full.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_exact_dedup, op2_near_dedup, op3_secret_scan, op4_katz_lm, op5_bpe, op6_html_main, op7_toxicity, op8_mix_sources, op9_license_scan, op10_quality_rules)}

SQL_EXACT = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""

#: Counts of the quality rules over a table named documents, then the threshold table.
SQL_QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c
  FROM d, unnest(range(1, len(w) - 3)) AS u(i)
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM win, range(0, 5) AS r(j) WHERE c >= 2 GROUP BY doc_id
), c AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(replace(t, '!', '')) AS n_exclaim,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters,
         len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}{2}[^\p{Ll}]*$'))) AS n_upper,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(list_distinct(w)) AS n_distinct,
         len(list_filter(w, lambda x: list_contains(string_split('STOPS', ' '), x))) AS n_stop,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (RULES) AS kept
FROM b
""".replace("STOPS", " ".join(quality_rules.STOP_WORDS)).replace(
    "RULES", " OR ".join(f"(n_words >= {r.from_words} AND {r.left} * 100 {'<' if r.below else '>'} {r.right} * {r.limit})" for r in quality_rules.RULES)
)

ORACLES: dict[str, str] = {"op1_exact_dedup": SQL_EXACT, "op10_quality_rules": SQL_QUALITY}
