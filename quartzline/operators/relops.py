"""Relational operators with their columns as parameters; the domain plans and the driver's queries share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reduce_distinct(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row a key; each value is its first non-null one in the order, independently of the others."""
    o = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), o)).alias(v) for v in values])


def last_wins(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Last-wins dedupe: the values of the key's last row."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v"))
    return last.select(*keys, *[F.col(f"__v.{v}").alias(v) for v in values])


def last_non_null(value: Column, *order: str) -> Column:
    """Aggregate: the last value that isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def unordered_pair(a: Column, b: Column) -> Column:
    return F.array_sort(F.array(a, b))


def pair_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on column ``pair``, whichever way round the two sides name it."""
    return left.join(right, "pair", how)


def united(df: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """The sorted distinct elements of each list column, a key. Elements are made distinct before they meet, so a hot key sends each of them once a task."""
    out = None
    for c in lists:
        each = df.select(*keys, F.explode_outer(c).alias("__x")).distinct()
        one = each.groupBy(*keys).agg(F.array_sort(F.collect_list("__x")).alias(c))
        out = one if out is None else out.join(one, keys)
    return out


def merge_nodes(df: DataFrame, *keys: str) -> DataFrame:
    """Node merge by ``keys`` (local_id): the last label and type, the largest confidence, united evidence and aliases, the first place."""
    names = list(keys) or ["local_id"]
    plain = df.groupBy(*names).agg(F.max_by("label", "seq").alias("label"), F.max_by("type", "seq").alias("type"), F.max("confidence").alias("confidence"), F.min("seq").alias("seq"))
    return plain.join(united(df, names, ["evidence", "aliases"]), names)


def fold_text(items: Column) -> Column:
    """Text of merged edges, an ordered fold over struct(seq, conf, text): the surer edge's text, or else the other's."""
    better = lambda z, x: x["conf"] > z["conf"]

    def step(z: Column, x: Column) -> Column:
        first, second = F.when(better(z, x), x["text"]).otherwise(z["text"]), F.when(better(z, x), z["text"]).otherwise(x["text"])
        return F.struct(z["seq"].alias("seq"), F.greatest(z["conf"], x["conf"]).alias("conf"), F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(second).alias("text"))

    s = F.array_sort(items)
    return F.aggregate(F.slice(s, 2, F.size(s)), s[0], step, lambda z: z["text"])


def merge_edges(df: DataFrame, keys: tuple[str, ...] = ("source", "target", "type")) -> DataFrame:
    """Edge merge by ends and type: the surer edge is primary, of equals the earlier; evidence is united."""
    item = F.struct("seq", F.col("confidence").alias("conf"), F.col("text").alias("text"))
    merged = df.groupBy(*keys).agg(F.collect_list(item).alias("items"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"), F.min("seq").alias("seq"))
    return merged.withColumn("text", fold_text(F.col("items"))).drop("items")


def accept_edges(edges: DataFrame, nodes: DataFrame, allowed: DataFrame, least: float) -> DataFrame:
    """Adds reason: why an edge (source, target, type, confidence, evidence) is rejected, or null."""
    kind = lambda end: nodes.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"))
    ok = allowed.select("type", "source_type", "target_type", F.lit(True).alias("fits"))
    joined = edges.join(kind("source"), "source", "left").join(kind("target"), "target", "left").join(ok, ["type", "source_type", "target_type"], "left")
    reason = (
        F.when(F.col("confidence") < least, "below_minimum_confidence")
        .when(~F.col("confidence").between(0, 1) | F.col("confidence").isNull(), "invalid_confidence")
        .when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "missing_evidence")
        .when(F.col("source_type").isNull() | F.col("target_type").isNull(), "missing_endpoint")
        .when(F.col("fits").isNull(), "invalid_pattern")
    )
    return joined.withColumn("reason", reason).select(*edges.columns, "reason")


def exactly_one(df: DataFrame, key: str, member: str, least: int = 2, needs: dict[str, tuple[Column, int]] | None = None) -> DataFrame:
    """Partitions of at least ``least`` members in which each needed predicate holds for enough of them."""
    tests = {n: F.count_if(p).alias(f"__{n}") for n, (p, _) in (needs or {}).items()}
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("members"), *tests.values()).filter(F.size("members") >= least)
    for n, (_, at_least) in (needs or {}).items():
        grouped = grouped.filter(F.col(f"__{n}") >= at_least)
    return grouped.select(key, "members")


def rank_links(df: DataFrame, key: str, rank: str, item: str) -> DataFrame:
    """Links adjacent items of a key whose ranks follow one another."""
    w = Window.partitionBy(key).orderBy(rank, item)
    ahead = df.withColumns({"next_item": F.lead(item).over(w), "next_rank": F.lead(rank).over(w)})
    return ahead.filter(F.col("next_rank") == F.col(rank) + 1).select(F.col(item).alias("prev"), F.col("next_item").alias("next")).distinct()


def date_islands(df: DataFrame, key: str, date: str, gap: int = 1) -> DataFrame:
    """Adds island: the first date of a run whose neighbours are at most ``gap`` days apart."""
    w = Window.partitionBy(key).orderBy(date)
    starts = df.withColumn("__new", F.coalesce(F.datediff(F.col(date), F.lag(date).over(w)) > gap, F.lit(True)))
    return starts.withColumn("island", F.max(F.when(F.col("__new"), F.col(date))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def near_date_join(left: DataFrame, right: DataFrame, key: str, days: int = 1) -> DataFrame:
    """Range join on one key: dates at most ``days`` apart. Each left row goes to its 2 * days + 1 dates, so it is an equi-join."""
    at = left.withColumn("__d", F.explode(F.array(*[F.date_add("left_date", k) for k in range(-days, days + 1)])))
    return at.join(right.withColumn("__d", F.col("right_date")), [key, "__d"]).drop("__d")


def chunk_fold(df: DataFrame, key: str, order: str, size: str, budget: int, most: int) -> DataFrame:
    """Greedy packing in order: a chunk closes when the next item would pass the budget or the count. Adds chunk."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"))))
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<struct<o:bigint,chunk:int>>").alias("out"))

    def step(z: Column, x: Column) -> Column:
        full = (z["n"] > 0) & ((z["used"] + x["s"] > budget) | (z["n"] >= most))
        chunk = z["chunk"] + full.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(full, x["s"]).otherwise(z["used"] + x["s"]).alias("used"), F.when(full, 1).otherwise(z["n"] + 1).alias("n"), F.concat(z["out"], F.array(F.struct(x["o"].cast("long").alias("o"), chunk.alias("chunk")))).alias("out"))

    packed = df.groupBy(key).agg(items.alias("i")).select(key, F.explode(F.aggregate("i", zero, step, lambda z: z["out"])).alias("c"))
    return packed.select(key, F.col("c.o").alias(order), F.col("c.chunk").alias("chunk"))


def f1_of(both: Column, a: Column, b: Column) -> Column:
    """F1 from the sizes of two sets and of what they share; two empty ones agree, one alone doesn't."""
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(both * 2.0 / (a + b))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as sets."""
    return f1_of(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def best_match(queries: DataFrame, pool: DataFrame, score, block: list[str], k: int = 1, least: float | None = None) -> DataFrame:
    """The k best of the pool for each query within a block, or of the whole pool if ``block`` is empty; ties go to the pool's order (column pool_seq)."""
    scored = (queries.join(pool, block) if block else queries.crossJoin(pool)).withColumn("score", score)
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_seq")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def replace_groups(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Groups that the override has come from it alone."""
    return base.join(override.select(key).distinct(), key, "left_anti").unionByName(override)


def typed_backfill(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns, with typed nulls for those that are absent."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merge on write: new values where there are any."""
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in new.columns if c != key])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in old.columns if c != key])
