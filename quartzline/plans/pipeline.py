"""The build from markets to a validated graph, in one function, and the steps of the command line around it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.functions.dimensions import allowed_patterns
from quartzline.operators import graph, rules
from quartzline.plans import bracket, compilers, resolution
from quartzline.plans.compilers import Domain
from quartzline.plans.fragments import Fragment, merged

#: Families in the order in which resolution sees them.
FAMILIES = ("deterministic", "llm", "official_bracket", "proposition_compiler")


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    tiers: DataFrame
    propositions: DataFrame


def ordered(families: dict[str, Fragment]) -> Fragment:
    """All families as one fragment with column method; ``seq`` goes by family first."""
    out = None
    for i, name in enumerate(FAMILIES):
        if name in families:
            place = lambda df: df.withColumns({"method": F.lit(name), "seq": F.col("seq") + i * (1 << 50)})  # noqa: B023, E731
            f = Fragment(place(families[name].nodes), place(families[name].edges))
            out = f if out is None else out.union(f)
    return out


def build(markets: DataFrame, d: Domain | None = None, inferred: Fragment | None = None, verified: Fragment | None = None, schedule: DataFrame | None = None, least: float = 0.0) -> Graph:
    """Compiles, resolves, builds and applies the rules. Edges carry the reason why one is rejected, or null."""
    d, spark = d or Domain(), markets.sparkSession
    topologies, _ = compilers.topology(markets, d)
    props_fragment, props = compilers.propositions(markets, d)
    families = {"deterministic": merged(compilers.assembled(markets, topologies, verified)), "proposition_compiler": merged(props_fragment)}
    if inferred is not None:
        families["llm"] = inferred
    if schedule is not None:
        families["official_bracket"] = bracket.official_fragment(schedule, d)
    f = ordered(families)
    nodes, xref = resolution.resolve(graph.saved(f.nodes), d)
    ids, allowed = nodes.select("id", "type"), allowed_patterns(spark)
    raw = f.edges.withColumns({"inference_method": F.col("method"), "derivation_type": F.when(F.col("method") == "proposition_compiler", "compiler").otherwise("extraction")}).drop("method", "event_id")
    edges = graph.build(ids, raw, resolution.endpoints(xref), allowed, least)
    props = graph.saved(props)
    edges = graph.add_rule_edges(edges, rules.fire(compilers.rule_inputs(props)), ids, allowed, least)
    return Graph(nodes, edges, resolution.tier_counts(xref), props)


def violations(g: Graph) -> DataFrame:
    """What ``graph.validate`` finds in the accepted part."""
    ok = g.edges.filter("reason is null").select(F.col("source").alias("src"), F.col("target").alias("dst"), "type", "evidence", "confidence")
    return graph.validate(g.nodes, ok, allowed_patterns(g.nodes.sparkSession))
