"""Exact dedup: 128-bit content hash groups whose bytes are compared.

Null texts count as empty and texts are equal when identical after lower-casing A-Z. The row with
the largest doc_id of a group stays; null ids sort below all others. Repeated rows (same id and text)
count each in ``group_size`` and are all marked kept; ``drop_copies`` returns one of them.
An empty table gives an empty result.

Aggregating by (hash, text) is the byte comparison: map tasks collapse copies before anything is
shuffled, so a group with a third of all rows costs one row a task. Each document then finds its
group by (hash, sha256), a plain equi-join that adaptive execution splits where it is skewed. Should two
different texts ever agree in both digests, the query fails rather than merge them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, pick


def md5_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def copy_groups(texts: DataFrame, content_hash=md5_of) -> DataFrame:
    """(h, sha, keep_id, group_size) of ``texts`` (doc_id, norm); one row for each different text."""
    compared = texts.groupBy(content_hash(F.col("norm")).alias("h"), "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    clash = F.raise_error(F.lit("two different texts agree in both digests"))
    return (
        compared.select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "n")
        .groupBy("h", "sha")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count("*").alias("texts"))
        .select("h", "sha", "keep_id", F.when(F.col("texts") > 1, clash.cast("long")).otherwise(F.col("n")).alias("group_size"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=md5_of) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = pick(docs, doc_id=id_col, text=text_col).select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
    light = texts.select("doc_id", content_hash(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("sha"))
    return light.join(copy_groups(texts, content_hash), ["h", "sha"]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``; of repeated rows one stays."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    i, t = (F.col(f"__c{names.index(c)}") for c in (id_col, text_col))
    norm = lower_ascii(F.coalesce(t, F.lit("")))
    # a struct with a null in it equals another, so null ids meet in a plain equi-join; repeated rows collapse in map tasks,
    # and the join finds the rows where this leaves them
    keys = ["__id", "__h", "__sha"]
    keyed = plain.withColumns({"__id": F.struct(i.alias("id")), "__h": md5_of(norm), "__sha": F.sha2(norm, 256)}).dropDuplicates(keys)
    stay = copy_groups(plain.select(i.alias("doc_id"), norm.alias("norm"))).select(F.struct(F.col("keep_id").alias("id")).alias("__id"), F.col("h").alias("__h"), F.col("sha").alias("__sha"))
    return keyed.join(stay, keys, "left_semi").select(*[f"__c{k}" for k in range(len(names))]).toDF(*names)
