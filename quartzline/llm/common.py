"""Helpers that the corpus operators share: column picking, word rules, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the space and the ASCII controls from tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns only, by exact name first and without regard to case next.

    Other columns, also those whose names differ from these in case alone, are left out, so an
    operator's own column names never clash with them. ``renamed`` maps the new name to the old.
    """
    wanted = {n: n for n in names} | renamed
    at = {}
    for new, old in wanted.items():
        exact = [i for i, c in enumerate(df.columns) if c == old]
        loose = [i for i, c in enumerate(df.columns) if c.lower() == old.lower()]
        if not (exact or loose):
            raise ValueError(f"no column {old!r} among {df.columns}")
        at[new] = (exact or loose)[0]
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__c{i}").alias(n) for n, i in at.items()])


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Plain ASCII takes the fast built-in path."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of the words of a non-null text."""
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def let(value: Column, use) -> Column:
    """use(value) with ``value`` computed once, wherever the optimizer moves the expression.

    Columns made step by step can be written out again inside a pushed-down filter, there within a
    lambda for each element; a lambda's own variable can't.
    """
    return F.transform(F.array(value), use)[0]


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A session without that setting gets a folder in its warehouse, which is shared as well.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def saved(df: DataFrame, *over: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and reread: lineage is cut, and a lost executor loses no part of it.

    The shuffle files behind it go once it is written, and so do the tables of ``over``, which nothing needs any more.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if (made := _made.get()) is not None:
        made.append(out)
    forget(*over)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a saved table; all tables that were saved on the way to it are deleted."""
    on_the_way: list[DataFrame] = []
    outer = _made.set(on_the_way)
    try:
        result = make()
    finally:
        _made.reset(outer)
    out = saved(result)
    forget(*on_the_way)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``saved`` wrote for these; nothing may read them afterwards."""
    for df in tables:
        if path := _paths.pop(df, None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
