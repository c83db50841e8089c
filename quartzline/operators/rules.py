"""Rules between propositions as Column predicates over equi-joined pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.functions.dimensions import stage_slug_ranks

REGISTRY: list[Rule] = []


@dataclass(frozen=True)
class Rule:
    rule_id: str
    edge_type: str
    keys: tuple[str, ...]
    test: Callable[[Column, Column], Column]
    version: int = 1
    both_ways: bool = False


def rule(rule_id: str, edge_type: str, keys: tuple[str, ...], version: int = 1, both_ways: bool = False):
    """Registers ``test(a, b)``, a predicate on two propositions that share ``keys``; equivalence goes both ways."""

    def add(test):
        REGISTRY.append(Rule(rule_id, edge_type, keys, test, version, both_ways or edge_type == "EQUIVALENT"))
        return test

    return add


def stage_rank(stage: Column) -> Column:
    """Rank by the slug at the end of a stage id; -1 if it is unknown."""
    ranks = F.create_map(*[F.lit(x) for kv in stage_slug_ranks().items() for x in kv])
    return F.coalesce(ranks[F.element_at(F.split(stage, ":"), -1)], F.lit(-1))


def _is(p: Column, predicate: str) -> Column:
    return (p["predicate"] == predicate) & p["polarity"]


SAME = ("team", "competition")


@rule("wc.stage_monotonicity", "IMPLIES", SAME)
def monotone(a, b):
    return _is(a, "reaches_stage") & _is(b, "reaches_stage") & (stage_rank(b["stage"]) >= 0) & (stage_rank(a["stage"]) > stage_rank(b["stage"]))


@rule("wc.champion_reaches_final", "IMPLIES", SAME)
def champion_final(a, b):
    return _is(a, "wins_competition") & _is(b, "reaches_stage") & (F.element_at(F.split(b["stage"], ":"), -1) == "final")


@rule("wc.elimination_implies_reaches", "IMPLIES", (*SAME, "stage"))
def eliminated_reached(a, b):
    return _is(a, "eliminated_at_stage") & _is(b, "reaches_stage") & (stage_rank(a["stage"]) >= 1)


@rule("wc.champion_equals_elim_at_champion", "EQUIVALENT", SAME)
def champion_eliminated(a, b):
    return _is(a, "wins_competition") & _is(b, "eliminated_at_stage") & (F.element_at(F.split(b["stage"], ":"), -1) == "champion")


@rule("wc.single_match_winner_mutex", "MUTEX", ("match",), both_ways=True)
def one_winner(a, b):
    return _is(a, "wins_match") & _is(b, "wins_match") & (a["match"] != "") & (a["team"] != b["team"]) & (a["id"] < b["id"])


def fire(props: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Edges of all rules over props (id, key, predicate, polarity, team, competition, stage, match, evidence).

    Each rule is an equi-join on its keys with the predicate on top, so there is no pure theta join. Confidence is 1 and
    the premises are the two propositions' keys; the first emission wins for each (source, target, type).
    """
    rules = REGISTRY if rules is None else rules
    if not rules:
        return fire(props, REGISTRY[:1]).limit(0)
    out = None
    for place, r in enumerate(rules):
        a, b = (props.select(*r.keys, F.struct(*props.columns).alias(s)) for s in "ab")
        hit = a.join(b, list(r.keys)).filter(F.col("a.id") != F.col("b.id")).filter(r.test(F.col("a"), F.col("b")))
        ends = lambda x, y: F.struct(F.col(f"{x}.id").alias("source"), F.col(f"{y}.id").alias("target"), F.array(f"{x}.key", f"{y}.key").alias("premises"))
        pairs = F.array(ends("a", "b"), *([ends("b", "a")] if r.both_ways else []))
        edges = hit.select(F.explode(pairs).alias("e"), F.array_sort(F.array_union("a.evidence", "b.evidence")).alias("evidence"))
        edges = edges.select("e.*", "evidence", F.lit(r.edge_type).alias("type"), F.lit(1.0).alias("confidence"), F.lit("rule").alias("derivation_type"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).cast("long").alias("rule_version"), F.lit(place).alias("__place"))
        out = edges if out is None else out.unionByName(edges)
    keys = ["source", "target", "type"]
    rest = [c for c in out.columns if c not in (*keys, "__place")]
    return out.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("__place", "premises")).alias("r")).select(*keys, "r.*")
