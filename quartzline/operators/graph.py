"""Graph operators over edge tables: peeling, cycle removal, transitive closure with paths, validation.

Loops cut their lineage with reliable checkpoints in the folder that the session names (spark.checkpoint.dir), so a
lost executor loses nothing; a session without one uses a folder in its warehouse, which is shared as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzline.operators import relops

#: Edges of a cycle core that the exact loop takes to the driver; a larger core loses every edge that is on a cycle.
RESIDUE = 100_000
PROGRESSION = ("ADVANCES_TO", "QUALIFIES_FOR")


def saved(df: DataFrame) -> DataFrame:
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every end of ``links`` (a, b): the smallest id it can reach. Labels go to neighbours, then to the label's own label."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        low = labels.join(near, "id").select("id", F.least("comp", "m").alias("comp"))
        jump = low.join(low.select(F.col("id").alias("comp"), F.col("comp").alias("far")), "comp").select("id", F.least("comp", "far").alias("comp"))
        new = saved(jump)
        if new.exceptAll(labels).isEmpty():
            return labels
        labels = new


def cycle_core(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) left when sources without in-edges and targets without out-edges are peeled off; empty if there is no cycle."""
    left = saved(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        left = saved(inner)
        m = left.count()
        if m == n:
            break
        n = m
    return left


def has_cycle(edges: DataFrame) -> bool:
    return not cycle_core(edges).isEmpty()


def strong_core(edges: DataFrame) -> DataFrame:
    """Edges on some cycle: those of the core whose target reaches their source."""
    core = cycle_core(edges)
    if core.isEmpty():
        return core
    reach = closure(core, most=None, direct=True).select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return core.join(reach, ["src", "dst"], "left_semi").unionByName(core.filter("src = dst")).distinct()


def _cycle(pairs: dict[tuple, int]) -> list[tuple]:
    """The pairs of some cycle, or none."""
    ahead: dict = {}
    for a, b in sorted(pairs):
        ahead.setdefault(a, []).append(b)
    done: set = set()
    for start in sorted(ahead):
        path, at, stack = [], {}, [(start, iter(ahead[start]))]
        while stack:
            x, rest = stack[-1]
            if x not in at:
                at[x] = len(path)
                path.append(x)
            y = next((b for b in rest if b not in done), None)
            if y is None:
                done.add(x)
                path.pop()
                del at[x]
                stack.pop()
            elif y in at:
                ring = [*path[at[y] :], y]
                return list(zip(ring, ring[1:]))
            else:
                stack.append((y, iter(ahead.get(y, []))))
    return []


def reject_cycles(edges: DataFrame, order: str | None = None) -> DataFrame:
    """``edges`` with reason progression_cycle for those dropped: the edges of one cycle at a time, of parallel ones the first, until none is left.

    Only what peeling leaves comes to the driver, and only up to ``RESIDUE`` distinct pairs.
    """
    core = cycle_core(edges)
    if core.count() > RESIDUE:
        bad = strong_core(edges).withColumn("__n", F.lit(1 << 30))
    else:
        pairs = {(r.src, r.dst): r.n for r in edges.join(core, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.count("*").alias("n")).collect()}
        dropped: dict = {}
        while ring := _cycle(pairs):
            for p in ring:
                dropped[p] = dropped.get(p, 0) + 1
                pairs[p] -= 1
                if not pairs[p]:
                    del pairs[p]
        kind = dict(edges.dtypes)["src"]
        bad = edges.sparkSession.createDataFrame([(*p, n) for p, n in dropped.items()], f"src {kind}, dst {kind}, __n int")
    w = Window.partitionBy("src", "dst").orderBy(order or F.lit(0))
    ranked = edges.join(bad, ["src", "dst"], "left").withColumn("__k", F.row_number().over(w))
    return ranked.withColumn("reason", F.when(F.col("__k") <= F.col("__n"), "progression_cycle")).select(*edges.columns, "reason")


def closure(edges: DataFrame, most: int | None = None, direct: bool = False) -> DataFrame:
    """(src, dst, path): the shortest path, of equals the smallest, of every reachable pair; without direct pairs unless asked for."""
    step = saved(edges.select("src", "dst").distinct())
    known = step.select("src", "dst", F.array("src", "dst").alias("path"))
    front, depth = known, 1
    while most is None or depth < most:
        hop = step.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        new = front.join(hop, "dst").select("src", F.col("to").alias("dst"), F.concat("path", F.array("to")).alias("path"))
        new = new.groupBy("src", "dst").agg(F.min("path").alias("path")).join(known, ["src", "dst"], "left_anti")
        front = saved(new)
        if front.isEmpty():
            break
        known, depth = saved(known.unionByName(front)), depth + 1
    return known if direct else known.filter(F.size("path") > 2).filter("src <> dst")


def implied_edges(edges: DataFrame) -> DataFrame:
    """Closure edges (source, target, premises, evidence, confidence, derivation_type) of IMPLIES edges (src, dst, evidence, seq): all that is
    reachable but not direct, with the shortest path as premises and the evidence along it; of parallel edges the last one's.
    """
    own = edges.groupBy("src", "dst").agg(F.max_by("evidence", "seq").alias("evidence"))
    paths = closure(edges)
    hops = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("src"), F.get("path", i + 1).alias("dst")))
    along = paths.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.explode(hops).alias("h")).select("source", "target", "h.src", "h.dst").join(own, ["src", "dst"])
    said = relops.united(along, ["source", "target"], ["evidence"])
    out = paths.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("path").alias("premises")).join(said, ["source", "target"], "left")
    evidence = F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(F.array(F.lit("closure:synthetic")))
    return out.select("source", "target", "premises", evidence.alias("evidence"), F.lit(1.0).alias("confidence"), F.lit("closure").alias("derivation_type"), F.lit("IMPLIES").alias("type"))


def reject_implies(edges: DataFrame, only: Column | None = None) -> DataFrame:
    """``edges`` (source, target, type, ..., reason): if accepted IMPLIES edges form any cycle, all of them (or those that are ``only``) get reason implies_cycle."""
    implies = (F.col("type") == "IMPLIES") & F.col("reason").isNull()
    if not has_cycle(edges.filter(implies).select(F.col("source").alias("src"), F.col("target").alias("dst"))):
        return edges
    drop = implies if only is None else implies & only
    return edges.withColumn("reason", F.when(drop, "implies_cycle").otherwise(F.col("reason")))


def build(nodes: DataFrame, edges: DataFrame, xref: DataFrame, allowed: DataFrame, least: float = 0.0) -> DataFrame:
    """Canonical edges with the reason why one is rejected, or null.

    ``nodes``: id, type. ``edges``: source, target, type, confidence, evidence, text, seq, inference_method, derivation_type, between local ids. ``xref``:
    local_id, canonical_id; an end without one keeps its own id, to be rejected if no node has it. Edges are merged, accepted, then rid of cycles.
    """
    to = lambda c: xref.select(F.col("local_id").alias(c), F.col("canonical_id").alias(f"__{c}"))
    mapped = edges.join(to("source"), "source", "left").join(to("target"), "target", "left")
    mapped = mapped.withColumns({c: F.coalesce(f"__{c}", c) for c in ("source", "target")}).drop("__source", "__target")
    keys = ["source", "target", "type"]
    by = mapped.groupBy(*keys).agg(F.max_by(F.struct("inference_method", "derivation_type"), F.struct("confidence", -F.col("seq"))).alias("by"))
    one = relops.merge_edges(mapped).join(by, keys).select("*", "by.*").drop("by")
    judged = saved(relops.accept_edges(one, nodes, allowed, least))
    moves = F.col("type").isin(*PROGRESSION) & F.col("reason").isNull()
    loops = reject_cycles(judged.filter(moves).select(F.col("source").alias("src"), F.col("target").alias("dst"), "type", "seq"), "seq").filter("reason is not null")
    bad = loops.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type", F.col("reason").alias("__r"))
    return reject_implies(saved(judged.join(bad, keys, "left").withColumn("reason", F.coalesce("reason", "__r")).drop("__r")))


def add_rule_edges(edges: DataFrame, fired: DataFrame, nodes: DataFrame, allowed: DataFrame, least: float = 0.0) -> DataFrame:
    """``build``'s edges with those of the rules, which are accepted in the same way; if these close an IMPLIES cycle, the rules' IMPLIES edges go and the others stay."""
    new = fired.select("source", "target", "type", "confidence", "evidence", F.lit("").alias("text"), F.lit(1 << 60).cast("long").alias("seq"), F.lit("rule_engine").alias("inference_method"), "derivation_type")
    there = edges.filter("reason is null").select("source", "target", "type")
    fresh = relops.accept_edges(new.join(there, ["source", "target", "type"], "left_anti"), nodes, allowed, least)
    return reject_implies(saved(edges.unionByName(fresh)), F.col("derivation_type") == "rule")


def validate(nodes: DataFrame, edges: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Violations (error, subject): duplicate ids, ends that are no node, missing evidence, confidence out of range; with ``allowed`` (and types on both sides)
    also patterns that aren't allowed and cycles of progression and of IMPLIES.
    """
    out = _plain_violations(nodes, edges)
    if allowed is None:
        return out
    kind = lambda c: nodes.select(F.col("id").alias(c), F.col("type").alias(f"{c}_type"))
    ok = allowed.select("type", F.col("source_type").alias("src_type"), F.col("target_type").alias("dst_type"))
    wrong = edges.join(kind("src"), "src").join(kind("dst"), "dst").join(ok, ["type", "src_type", "dst_type"], "left_anti")
    out = out.unionByName(wrong.select(F.lit("invalid_pattern").alias("error"), F.concat_ws(" ", "src", "type", "dst").alias("subject")))
    for name, kinds in (("progression_cycle", PROGRESSION), ("implies_cycle", ("IMPLIES",))):
        core = cycle_core(edges.filter(F.col("type").isin(*kinds)))
        out = out.unionByName(core.select(F.lit(name).alias("error"), F.min("src").over(Window.partitionBy()).alias("subject")).limit(1))
    return out


def _plain_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    tag = lambda df, name, c: df.select(F.lit(name).alias("error"), F.col(c).cast("string").alias("subject"))
    out = tag(nodes.groupBy("id").count().filter("count > 1"), "duplicate_node", "id")
    for end in ("src", "dst"):
        out = out.unionByName(tag(edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti"), f"missing_{end}", end))
    out = out.unionByName(tag(edges.filter("evidence is null or size(evidence) = 0"), "missing_evidence", "src"))
    return out.unionByName(tag(edges.filter("confidence is null or confidence < 0 or confidence > 1"), "invalid_confidence", "src"))
