"""Fragments: node and edge rows that the compilers emit, always as two tables.

Nodes: event_id, local_id, type, label, aliases, confidence, evidence, seq. Edges: event_id, source, target, type, confidence, evidence,
text, seq. ``seq`` is the order of emission; what has several rows is merged by ``relops.merge_nodes`` and ``relops.merge_edges``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.operators import relops

NODE = "array<struct<local_id:string,type:string,label:string,aliases:array<string>,confidence:double,evidence:array<string>,seq:bigint>>"
EDGE = "array<struct<source:string,target:string,type:string,confidence:double,evidence:array<string>,text:string,seq:bigint>>"
NODE_COLUMNS = ["event_id", "local_id", "type", "label", "aliases", "confidence", "evidence", "seq"]
EDGE_COLUMNS = ["event_id", "source", "target", "type", "confidence", "evidence", "text", "seq"]
PLACES = 1000


class Fragment(NamedTuple):
    nodes: DataFrame
    edges: DataFrame

    def union(self, other: Fragment) -> Fragment:
        return Fragment(self.nodes.unionByName(other.nodes), self.edges.unionByName(other.edges))


def some(x: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(x, F.lit(""))


def at(seq: Column | str, place: int) -> Column:
    """Place of an emission: markets in their order, ``PLACES`` places for each."""
    return (F.col(seq) if isinstance(seq, str) else seq) * PLACES + place


def clean(*aliases: Column) -> Column:
    """Sorted distinct aliases without blank ones."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*aliases) if aliases else F.array().cast("array<string>"), lambda a: a != "")))


def node(local_id: Column, kind: str | Column, label: Column, evidence: Column, seq: Column, aliases: Column | None = None) -> Column:
    """A node; ``aliases`` is an array."""
    names = clean() if aliases is None else F.array_sort(F.array_distinct(F.filter(aliases, lambda a: a != "")))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(local_id.alias("local_id"), kind.alias("type"), label.alias("label"), names.alias("aliases"), F.lit(1.0).alias("confidence"), evidence.alias("evidence"), seq.cast("long").alias("seq"))


def edge(source: Column, target: Column, kind: str, evidence: Column, text: Column, seq: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(1.0).alias("confidence"), evidence.alias("evidence"), text.alias("text"), seq.cast("long").alias("seq"))


def emit(rows: DataFrame, nodes: list[Column] | Column, edges: list[Column] | Column) -> Fragment:
    """The fragment of rows that each give an array of nodes and one of edges."""
    as_array = lambda x, kind: (F.array(*x) if isinstance(x, list) else x).cast(kind)
    return Fragment(rows.select("event_id", F.inline(as_array(nodes, NODE))), rows.select("event_id", F.inline(as_array(edges, EDGE))))


def merged(f: Fragment) -> Fragment:
    """One row for each node and edge of an event."""
    keep = lambda df, names: df.select(*names)
    return Fragment(keep(relops.merge_nodes(f.nodes, "event_id", "local_id"), NODE_COLUMNS), keep(relops.merge_edges(f.edges, ("event_id", "source", "target", "type")), EDGE_COLUMNS))


def same_fragments(a: Fragment, b: Fragment) -> DataFrame:
    """(event_id, same): whether two fragments of an event agree but for confidence and order."""

    def rows(f: Fragment) -> DataFrame:
        n = f.nodes.select("event_id", F.to_json(F.struct("local_id", "type", "label", F.array_sort("aliases").alias("a"), F.array_sort("evidence").alias("e"))).alias("x"))
        e = f.edges.select("event_id", F.to_json(F.struct("source", "target", "type", "text", F.array_sort("evidence").alias("e"))).alias("x"))
        return n.unionByName(e).distinct()

    x, y = rows(a).withColumn("side", F.lit(1)), rows(b).withColumn("side", F.lit(2))
    sides = x.unionByName(y).groupBy("event_id", "x").agg(F.sum("side").alias("s"))
    return sides.groupBy("event_id").agg((F.max("s") == F.min("s")).alias("one"), F.min("s").alias("s")).select("event_id", (F.col("one") & (F.col("s") == 3)).alias("same"))
