"""Sources and sinks: the hourly mart, semantic markets, JSON documents and typed parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzline.functions import scalars
from quartzline.functions.dimensions import ADVANCE_TYPE, STAGE_TITLES
from quartzline.operators import relops

HISTORY = {
    "market_id": "string", "event_title": "string", "group_item_title": "string", "primary_outcome_label": "string", "close_odds": "double", "odds_hour_epoch": "bigint",
    "game_start_time": "string", "event_finished_at": "string", "is_resolved": "boolean", "winning_outcome": "string", "sports_market_type": "string",
}
MARKET = {
    "market_id": "string", "event_id": "string", "event_slug": "string", "event_title": "string", "event_description": "string", "question": "string", "description": "string",
    "market_slug": "string", "sports_market_type": "string", "group_item_title": "string", "game_start_time": "string", "end_time": "string",
    "outcomes": "array<string>", "tags": "array<string>", "event_tags": "array<string>",
}


def history_rows(mart: DataFrame) -> DataFrame:
    """The history projection with typed nulls for absent columns and only rows that feed an output.

    Without the hour, the odds or both routing columns there is nothing to read, and the result is empty. ``seq`` orders rows of one
    hour: by file and place in it where there is one.
    """
    there = set(mart.columns)
    placed = mart if "seq" in there else _with_place(mart)
    rows = relops.typed_backfill(placed, HISTORY | {"seq": dict(placed.dtypes)["seq"]})
    if not {"market_id", "odds_hour_epoch", "close_odds"} <= there:
        return rows.filter("false")
    title = F.lower(F.trim("event_title"))
    wanted = (F.col("sports_market_type") == ADVANCE_TYPE) | title.isin(*STAGE_TITLES)
    return rows.filter(F.col("odds_hour_epoch").isNotNull() & F.col("close_odds").isNotNull() & wanted)


def _with_place(mart: DataFrame) -> DataFrame:
    """Adds ``seq``, the row's file and place in it; for rows that are in no file, their place in the plan."""
    try:
        return mart.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException:
        return mart.withColumn("seq", F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")))


def semantic_markets(mart: DataFrame) -> DataFrame:
    """One row a market: each column's first non-null value by hour. A null id fails; lists that are null are empty."""
    must = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null {c}")).cast("string")).otherwise(F.col(c))
    rows = mart.withColumn("market_id", must("market_id")).withColumn("event_id", must("event_id"))
    one = relops.reduce_distinct(rows, ["market_id"], ["odds_hour_epoch"], [c for c in MARKET if c != "market_id"])
    types = dict(mart.dtypes)

    def out(c: str, kind: str):
        if kind == "array<string>" and types[c] == "string":
            return F.coalesce(scalars.json_list(F.col(c)), F.array().cast(kind)).alias(c)
        if types[c].startswith("timestamp"):
            return scalars.iso_utc(F.col(c)).alias(c)
        return (F.nullif(scalars.strip(F.col(c)), F.lit("")) if c in ("game_start_time", "end_time") else F.col(c)).cast(kind).alias(c)

    return one.select(*[out(c, k) for c, k in MARKET.items()])


def filter_ids(df: DataFrame, ids: list[str] | None, key: str = "event_id", limit: int | None = None) -> DataFrame:
    """None keeps all and [] nothing; the limit is over the sorted ids."""
    if limit is not None and limit < 0:
        raise ValueError("the limit must not be negative")
    out = df if ids is None else df.filter(F.col(key).isin(ids)) if ids else df.filter("false")
    if limit is None:
        return out
    return out.join(out.select(key).distinct().orderBy(key).limit(limit), key, "left_semi")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_typed(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Typed parquet, also when empty."""
    df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()]).write.mode("overwrite").parquet(path)
