"""Mixing sources to target weights by Pareto order sampling.

The sources, by code point with null last, weigh 3, 1, 2 and so on, and share 150 % of all sizes; no target
exceeds twice its source's size, and what a source can't take is shared again by weight. This is water
filling: target = min(2 * size, weight * level), with the level read off sorted break points.

Within a source each document is due target / source_size copies. Its whole copies are certain. The rest
is a Pareto sample with unequal odds: a document's inclusion probability goes with the logarithm of its size, scaled so that the
expected words are those still due; where that passes one it is certain. Documents rank by their random odds divided by their inclusion odds, and the first
ones, as many as reach the words still due, are taken once more. The last place goes to the unranked document whose
size best fits the gap left, if that comes nearer to the target. Odds come from a seeded hash of the id,
so reruns agree.

Null texts have size 0; null sources form a source of their own; a source without words has target 0.
Repeated rows rank alike and are taken together. An empty table gives an empty result.

A very long text counts whole. Columns are found by name, exactly first and without regard to case next; all others stay as they are.

The cut is found in two steps, so no task sees all ranks of a source: ranks are summed in about
sqrt(rows) bins of nearly even numbers of rows, then only the bin with the cut is sorted. Sources with nothing left to sample aren't ranked. The plan has one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_of, pick, saved

WEIGHTS, SHARE, MOST_COPIES, SEED = (3, 1, 2), 1.5, 2, 20240817
KEY = ["no_source", "src"]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, th (hash of the text), source as a null-safe key, size in words."""
    return pick(docs, doc_id=id_col, t=text_col, s=source_col).select("doc_id", F.xxhash64("t").alias("th"), *_key(F.col("s")), _size(F.col("t")).alias("size"))


def _size(t: Column) -> Column:
    return F.when(t.isNull(), F.lit(0)).otherwise(n_words_of(t)).cast("long")


def _key(s: Column) -> list[Column]:
    return [s.isNull().alias("no_source"), F.coalesce(s, F.lit("")).alias("src")]


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row for each source: source_size, n_docs, target."""
    per = rows.groupBy(*KEY).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.sum(F.col("size") * _measure()).alias("measured"))
    place = F.row_number().over(Window.orderBy(*KEY)) - 1
    ranked = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("cap", F.col("source_size") * float(most))
    up = Window.orderBy(F.col("cap") / F.col("weight"), *KEY)
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    flow = capped.withColumns({"ratio": F.col("cap") / F.col("weight"), "cap0": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w0": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "all_w": F.sum("weight").over(everything), "due": F.sum("source_size").over(everything) * share})
    # the level if exactly the sources before this one are full; the first that doesn't pass its own break point
    # holds, and later ones are lower
    flow = flow.withColumn("level", (F.col("due") - F.col("cap0")) / (F.col("all_w") - F.col("w0")))
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything), F.lit(float("inf")))
    return flow.withColumn("lev", level).select(*KEY, "source_size", "n_docs", "measured", F.when(F.col("source_size") > 0, F.least("cap", F.col("weight") * F.col("lev"))).otherwise(0.0).alias("target"))


def _ranked(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds whole (certain copies) and q (random odds over inclusion odds) to rows joined with their source's plan."""
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    clip = lambda p: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    odds = lambda p: clip(p) / (1 - clip(p))
    part = F.col("due") - F.col("whole")
    mine = F.coalesce(part * _measure() * F.col("source_size") / F.nullif("measured", F.lit(0.0)), F.lit(0.0))
    ranked = rows.join(sources, KEY).withColumn("due", due).withColumn("whole", F.floor("due").cast("long")).withColumn("q", odds(u) / odds(mine))
    # the even share's odds spread ranks evenly over the bins
    even = F.col("q") * odds(part)
    return ranked.withColumn("bin", F.floor(even / (1 + even) * F.ceil(F.sqrt("n_docs"))).cast("long"))


def _measure() -> Column:
    """What a document's inclusion probability is in proportion to."""
    return F.log2(F.col("size") + 1)


def mixing_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """For each source of ``rows`` (see ``sized``): its target and the last rank that is taken once more."""
    sources = source_targets(rows, weights, share, most)
    ranked = _ranked(rows, sources, seed).withColumn("open", F.col("target") - F.col("whole") * F.col("source_size")).filter("open > 0")
    tie = F.struct("q", "doc_id", "th")
    bins = ranked.groupBy(*KEY, "bin", "open").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy(*KEY).orderBy("bin")
    cut = bins.withColumn("cum", F.sum("words").over(upto)).filter(F.col("cum") >= F.col("open")).groupBy(*KEY).agg(F.min("bin").alias("cut_bin"), F.min_by(F.col("cum") - F.col("words"), "bin").alias("cum0"))
    inner = ranked.join(cut, KEY).filter(F.col("bin") == F.col("cut_bin")).withColumn("cum", F.col("cum0") + F.sum("size").over(Window.partitionBy(*KEY).orderBy("q", "doc_id", "th")))
    # the first rank at which the words reach what is open, if taking it comes nearer than not
    near = F.abs(F.col("cum") - F.col("open")) <= F.abs(F.col("cum") - F.col("size") - F.col("open"))
    fits = (F.col("cum") <= F.col("open")) | ((F.col("cum") - F.col("size") < F.col("open")) & near)
    last = inner.filter(fits).groupBy(*KEY).agg(F.max(tie).alias("last"), F.max("cum").alias("got"))
    plan = sources.join(cut, KEY, "left").join(last, KEY, "left").withColumn("got", F.coalesce("got", "cum0", F.lit(0)))
    left = _ranked(rows, plan, seed).withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size") - F.col("got")).filter(~_taken())
    miss = F.abs(F.col("gap") - F.col("size"))
    fill = left.filter(miss < F.abs(F.col("gap"))).groupBy(*KEY).agg(F.min(F.struct(miss.alias("miss"), "q", "doc_id", "th")).alias("f")).select(*KEY, F.struct("f.q", "f.doc_id", "f.th").alias("fill"))
    return plan.join(fill, KEY, "left").select(*KEY, "source_size", "target", "cut_bin", "last", "fill", "n_docs", "measured")


def _taken() -> Column:
    """Whether a ranked row joined with its plan is taken once more."""
    tie = F.struct("q", "doc_id", "th")
    early = F.col("bin") < F.col("cut_bin")
    at_cut = (F.col("bin") == F.col("cut_bin")) & (tie <= F.col("last"))
    return F.coalesce(early, F.lit(False)) | F.coalesce(at_cut, F.lit(False))


def apply_plan(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds copies (whole times a row is taken), source_size and target."""
    more = _taken() | F.coalesce(F.struct("q", "doc_id", "th") == F.col("fill"), F.lit(False))
    return _ranked(rows, plan, seed).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken."""
    rows = saved(sized(docs, id_col, text_col, source_col))
    out = apply_plan(rows, saved(mixing_plan(rows, **settings)), settings.get("seed", SEED))
    return out.select("doc_id", F.when(~F.col("no_source"), F.col("src")).alias("source"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``docs``. Texts meet only the plan."""
    names = docs.columns
    plan = saved(mixing_plan(saved(sized(docs, id_col, text_col, source_col)), **settings))
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    at = lambda c: next((k for k, n in enumerate(names) if n == c), None)
    loose = lambda c: next(k for k, n in enumerate(names) if n.lower() == c.lower())
    i, t, s = (F.col(f"__c{loose(c) if at(c) is None else at(c)}") for c in (id_col, text_col, source_col))
    rows = plain.withColumns({"doc_id": i, "th": F.xxhash64(t), "no_source": s.isNull(), "src": F.coalesce(s, F.lit("")), "size": _size(t)})
    out = apply_plan(rows, plan, settings.get("seed", SEED)).filter("copies > 0")
    return out.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[f"__c{k}" for k in range(len(names))]).toDF(*names)
