"""Entity resolution of fragment nodes by groups and components, not one node after another.

Nodes become entities (same type and slug of the label; events, markets and outcomes by their id; matches by their teams and nearby
dates), entities are linked by aliases, and components of links are canonical nodes. Short team codes link only the team that they stand for. Components
whose first labels are alike to ``threshold`` join the earliest best one. Constraints are left out of that, as labels that differ in one letter name different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.functions import scalars as s
from quartzline.operators import graph, relops
from quartzline.plans.compilers import Domain

C = F.col
EXACT = ("EVENT", "MARKET", "OUTCOME")
OWN_ID = (*EXACT, "MATCH", "CONSTRAINT")
NOT_FUZZY = (*EXACT, "MATCH", "CONSTRAINT")


def prepared(nodes: DataFrame, d: Domain) -> DataFrame:
    """Nodes with canonical team names; the raw name stays as an alias."""
    label = F.when(C("type") == "TEAM", d.team(C("label"))).otherwise(C("label"))
    aliases = F.array_distinct(F.concat("aliases", F.when(label != C("label"), F.array("label")).otherwise(F.array().cast("array<string>"))))
    return nodes.withColumns({"label": label, "aliases": aliases}).withColumn("slug", s.slug(C("label")))


def match_fixtures(matches: DataFrame) -> DataFrame:
    """(local_id, entity): match ids of the same teams whose dates are a day apart in a row are one fixture; one without date joins the earliest.

    The entity is the id that stays: an official one, else the latest date's.
    """
    dated = s.dated_match(C("local_id"))
    ids = matches.groupBy("local_id").agg(F.max((C("method") == "official_bracket").cast("int")).alias("official"))
    ids = ids.withColumns({"teams": F.coalesce(dated["teams"], "local_id"), "day": dated["day"]})
    runs = relops.date_islands(ids.filter("day is not null"), "teams", "day")
    last = runs.groupBy("teams", "island").agg(F.max_by("local_id", F.struct("official", "day")).alias("entity"))
    first = last.groupBy("teams").agg(F.min_by("entity", "island").alias("entity"))
    plain = ids.filter("day is null").join(first, "teams", "left").select("local_id", F.coalesce("entity", "local_id").alias("entity"))
    return runs.join(last, ["teams", "island"]).select("local_id", "entity").unionByName(plain)


def _alias_keys(nodes: DataFrame, d: Domain) -> DataFrame:
    """(entity, key): the slugs of a node's label and aliases, codes only where they stand for the label's team, and then its mapped name too."""
    rows = nodes.filter(~C("type").isin(*OWN_ID)).select("entity", "type", "label", "slug", F.explode(F.array_union("aliases", F.array("label"))).alias("alias"))
    mapped = s.lookup(d.codes, F.lower("alias"))
    own = s.slug(s.canonical_name(mapped, d.aliases))
    rows = rows.withColumns({"own": own, "is_code": (C("type") == "TEAM") & mapped.isNotNull()}).filter(~C("is_code") | (C("own") == C("slug")))
    return rows.withColumn("a", s.slug(C("alias"))).filter("a <> ''").select("entity", F.concat_ws(":", F.lit("key"), "type", "a").alias("key")).distinct()


def fuzzy_links(labels: DataFrame, threshold: float) -> DataFrame:
    """(a, b) from each (comp, type, label, seq) to the earlier one of its type with the best token-sort ratio, if that reaches the threshold.

    Half the ratio is at most the shorter length over the sum of both, so only lengths that can reach it meet, in an equi-join.
    """
    n = F.length("label")
    reach = F.sequence(F.ceil(n * threshold / (200 - threshold)).cast("int"), F.floor(n * (200 - threshold) / threshold).cast("int"))
    asks = labels.select("type", C("comp").alias("b"), C("label").alias("lb"), C("seq").alias("sb"), F.explode(reach).alias("n"))
    pool = labels.select("type", C("comp").alias("a"), C("label").alias("la"), C("seq").alias("sa"), n.alias("n"))
    scored = asks.join(pool, ["type", "n"]).filter("sa < sb").withColumn("score", s.token_sort_ratio(C("la"), C("lb"))).filter(C("score") >= threshold)
    return scored.groupBy("b").agg(F.max_by("a", F.struct("score", -C("sa"))).alias("a")).select("a", "b")


def resolve(nodes: DataFrame, d: Domain | None = None, threshold: float = 92.0) -> tuple[DataFrame, DataFrame]:
    """Canonical nodes (id, type, label, aliases, confidence, evidence, resolution_method, inference_method) and (local_id, canonical_id, tier) of all occurrences.

    ``nodes``: local_id, type, label, aliases, confidence, evidence, method, seq (the order of all fragments).
    """
    d = d or Domain()
    rows = prepared(nodes, d)
    fixtures = match_fixtures(rows.filter("type = 'MATCH'"))
    entity = F.when(C("type").isin(*EXACT), C("local_id")).when(C("type") == "MATCH", C("fixture")).otherwise(F.concat_ws(":", F.lit("entity"), "type", "slug"))
    rows = graph.saved(rows.join(fixtures.withColumnRenamed("entity", "fixture"), "local_id", "left").withColumn("entity", entity).drop("fixture"))
    comps = graph.components(_alias_keys(rows, d).select(C("entity").alias("a"), C("key").alias("b")))
    of = rows.join(comps.withColumnRenamed("id", "entity"), "entity", "left").withColumn("comp", F.coalesce("comp", "entity"))
    heads = graph.saved(of.filter(~C("type").isin(*NOT_FUZZY)).groupBy("comp").agg(F.min_by(F.struct("type", "label"), "seq").alias("h"), F.min("seq").alias("seq")).select("comp", "h.*", "seq"))
    far = graph.components(fuzzy_links(heads, threshold))
    of = graph.saved(of.join(far.select(C("id").alias("comp"), C("comp").alias("__far")), "comp", "left").withColumn("whole", F.coalesce("__far", "comp")).drop("__far"))
    first_of = lambda key: of.groupBy(key).agg(F.min("seq").alias(f"first_{key}"))
    tiers = of.join(first_of("whole"), "whole").join(first_of("comp"), "comp").join(first_of("entity"), "entity")
    tier = F.when(C("type").isin(*EXACT), "exact_id").when(C("seq") == C("first_whole"), "new_entity").when(C("seq") > C("first_entity"), "exact_slug").when(C("seq") > C("first_comp"), "alias").otherwise("fuzzy")
    tiers = tiers.withColumn("tier", tier)
    slug = of.filter("type = 'COMPETITION'").agg(F.coalesce(F.min_by("slug", "seq"), F.lit("unknown")).alias("competition"))
    found = tiers.groupBy("whole").agg(F.min_by(F.struct("type", "label", "slug", "entity", "local_id", "method"), "seq").alias("f"), F.max("confidence").alias("confidence"), F.max_by("tier", "seq").alias("resolution_method"), F.max((C("method") == "official_bracket").cast("int")).alias("official"))
    found = found.select("whole", "f.*", "confidence", "resolution_method", "official").crossJoin(F.broadcast(slug))
    within = lambda kind: F.concat_ws(":", F.lit(kind), "competition", "slug")
    new_id = F.when(C("type").isin(*EXACT, "CONSTRAINT"), C("local_id")).when(C("type") == "MATCH", C("entity")).when(C("type").isin("STAGE", "GROUP", "ROUND"), within_kind(within)).otherwise(F.concat(F.lower("type"), F.lit(":"), "slug"))
    said = relops.united(of.withColumn("names", F.concat("aliases", F.array("label"))), ["whole"], ["names", "evidence"])
    several = of.groupBy("whole").agg(F.count("*").alias("n"))
    own = relops.united(of, ["whole"], ["aliases"])
    out = found.join(said, "whole").join(own, "whole").join(several, "whole")
    canonical = out.select("whole", new_id.alias("id"), "type", "label", F.when(C("n") > 1, C("names")).otherwise(C("aliases")).alias("aliases"), "confidence", "evidence", "resolution_method", F.when(C("official") == 1, "official_bracket").otherwise(F.coalesce("method", F.lit("unknown"))).alias("inference_method"))
    canonical = graph.saved(canonical)
    xref = tiers.select("local_id", "whole", "tier", "seq").join(canonical.select("whole", C("id").alias("canonical_id")), "whole")
    return canonical.drop("whole"), xref.select("local_id", "canonical_id", "tier")


def within_kind(within) -> Column:
    return F.when(C("type") == "STAGE", within("stage")).when(C("type") == "GROUP", within("group")).otherwise(within("round"))


def endpoints(xref: DataFrame) -> DataFrame:
    """One canonical id for each local id."""
    return xref.groupBy("local_id").agg(F.min("canonical_id").alias("canonical_id"))


def tier_counts(xref: DataFrame) -> DataFrame:
    """How many occurrences each tier took."""
    return xref.groupBy("tier").agg(F.count("*").alias("n"))
