"""A corpus from raw documents: rules, exact and near dedup, the mix, and its tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the
next stage's docs; the one before is deleted then. All but the last return the columns of ``documents``. The last gives one row for each row of the
mix: a document taken twice is there twice.

Null texts fail the rules; rows without an id go with the near copies; ties and repeated rows are the stages' own: the largest id
of exact copies stays, the smallest of near ones, one row an id. An empty table gives an empty result, very long texts go through whole, and extra columns stay.
Names that differ in case alone need spark.sql.caseSensitive, as in any Parquet table that Spark writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quartzline.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from quartzline.llm.common import saved, table
from quartzline.llm.registry import byte_bpe_50k


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(docs, byte_bpe_50k())


STAGES = [
    ("quality rules", apply_quality_rules),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix),
    ("BPE", encode),
]

#: Near-dedup and the random mix have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = saved(out, docs)
    return docs
