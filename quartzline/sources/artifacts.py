"""Files around the graph: input globs, fragments as JSON lines, exported tables and their reread, reports, training rows.

Tables go through Spark's writers. Only documents of bounded size (a report, the ontology, a manifest) are written by the driver,
through Hadoop's file systems, so that any path that Spark reads will do.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzline.functions.dimensions import ALLOWED
from quartzline.functions.scalars import path_safe
from quartzline.plans.fragments import EDGE_COLUMNS, NODE_COLUMNS, Fragment

PROPOSITION = "predicate string, arguments map<string,string>, polarity boolean, comparator string, value double, unit string, time_start timestamp, time_end timestamp"
NODES = {"canonical_id": "string", "type": "string", "label": "string", "aliases": "array<string>", "confidence": "double", "evidence_market_ids": "array<string>", "resolution_method": "string", "inference_method": "string", "proposition_json": "string"}
EDGES = {
    "source_id": "string", "target_id": "string", "edge_type": "string", "confidence": "double", "evidence_market_ids": "array<string>", "evidence_text": "string",
    "inference_method": "string", "derivation_type": "string", "rule_id": "string", "rule_version": "bigint", "premises": "array<string>",
}
FRAGMENT = "event_id string, kind string, nodes array<struct<local_id:string,type:string,label:string,aliases:array<string>,confidence:double,evidence:array<string>,seq:bigint>>, edges array<struct<source:string,target:string,type:string,confidence:double,evidence:array<string>,text:string,seq:bigint>>"
#: Kinds of stored fragments, the one that wins first; parts and manifests are no fragments.
KINDS = ("verified", "topology", "inferred")


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def input_glob(spark: SparkSession, data_dir: str | None, defaults: list[str], pattern: str = "*.parquet") -> str:
    """The first glob that has files: of ``data_dir`` alone if it is given, else of the default folders in order."""
    globs = [f"{d}/{pattern}" for d in ([data_dir] if data_dir else defaults)]
    for g in globs:
        fs, at = _path(spark, g)
        if fs.globStatus(at):
            return g
    raise FileNotFoundError(", ".join(globs))


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON document, written over what is there."""
    fs, at = _path(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str, default=None):
    """A small JSON document; ``default`` where it is missing or can't be read."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
        return json.loads(rows[0][0]) if rows else default
    except (AnalysisException, json.JSONDecodeError):
        return default


def ontology_patterns() -> list[dict[str, str]]:
    """All allowed patterns, sorted."""
    return [{"edge_type": e, "source": a, "target": b} for e, a, b in sorted((e, *p) for e, ps in ALLOWED.items() for p in ps)]


def typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def with_propositions(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """Adds proposition_json to OUTCOME nodes (id) that have a proposition (outcome_id, predicate, arguments, polarity)."""
    p = F.struct("predicate", F.map_from_entries(F.array_sort(F.map_entries("arguments"))).alias("arguments"), "polarity")
    said = props.select(F.col("outcome_id").alias("id"), F.to_json(p).alias("proposition_json"))
    return nodes.join(said, "id", "left").withColumn("proposition_json", F.when(F.col("type") == "OUTCOME", F.col("proposition_json")))


def report(nodes: DataFrame, edges: DataFrame, tiers: DataFrame | None = None) -> dict:
    """Counts of node types, edge types, rejection reasons and tiers; as many entries as there are types."""
    count = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).agg(F.count("*")).orderBy(c).collect()}
    out = {"node_types": count(nodes, "type"), "edge_types": count(edges.filter("reason is null"), "type"), "rejections": count(edges.filter("reason is not null"), "reason")}
    return out | ({} if tiers is None else {"tiers": {r.tier: r.n for r in tiers.orderBy("tier").collect()}})


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str, said: dict | None = None) -> None:
    """Nodes, accepted and rejected edges as typed parquet, also when empty; the ontology and the report as JSON."""
    spark = nodes.sparkSession
    renamed = nodes.withColumnsRenamed({"id": "canonical_id", "evidence": "evidence_market_ids"})
    typed(renamed, NODES).write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
    named = edges.withColumnsRenamed({"source": "source_id", "target": "target_id", "type": "edge_type", "evidence": "evidence_market_ids", "text": "evidence_text", "reason": "rejection_reason"})
    typed(named.filter("rejection_reason is null"), EDGES).write.mode("overwrite").parquet(f"{folder}/edges.parquet")
    typed(named.filter("rejection_reason is not null"), EDGES | {"rejection_reason": "string"}).write.mode("overwrite").parquet(f"{folder}/rejected_edges.parquet")
    write_json(spark, f"{folder}/ontology.json", ontology_patterns())
    write_json(spark, f"{folder}/report.json", report(nodes, edges) if said is None else said)


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The exported nodes, with their propositions parsed, and edges, under the names that the operators use."""
    nodes = spark.read.parquet(f"{folder}/nodes.parquet").withColumnsRenamed({"canonical_id": "id", "evidence_market_ids": "evidence"})
    edges = spark.read.parquet(f"{folder}/edges.parquet").withColumnsRenamed({"source_id": "source", "target_id": "target", "edge_type": "type", "evidence_market_ids": "evidence", "evidence_text": "text"})
    return nodes.withColumn("proposition", F.from_json("proposition_json", PROPOSITION)), edges


def write_fragments(f: Fragment, kind: str, folder: str) -> None:
    """Fragments as JSON lines, one an event, in a folder of their kind."""
    nodes = f.nodes.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*NODE_COLUMNS[1:]).alias("x"))))["x"].alias("nodes"))
    edges = f.edges.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*EDGE_COLUMNS[1:]).alias("x"))))["x"].alias("edges"))
    nodes.join(edges, "event_id", "full_outer").filter(path_safe(F.col("event_id"))).withColumn("kind", F.lit(kind)).write.mode("overwrite").json(f"{folder}/kind={kind}")


def read_fragments(spark: SparkSession, folder: str, resume: bool = True, usable: DataFrame | None = None) -> tuple[Fragment, DataFrame]:
    """The stored fragment that wins for each event, and (event_id, kind): a verified one (only where ``usable`` lists its event, if given) before the template's, that
    before an inferred one. Without ``resume`` only inferred ones count.
    """
    rows = spark.read.schema(FRAGMENT).json(folder).filter(F.col("event_id").isNotNull())
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    rows = rows.filter(rank > 0) if resume else rows.filter("kind = 'inferred'")
    if usable is not None:
        ok = usable.select("event_id").distinct().withColumn("__ok", F.lit(True))
        rows = rows.join(ok, "event_id", "left").filter("kind <> 'verified' or __ok").drop("__ok")
    won = rows.groupBy("event_id").agg(F.min_by(F.struct("kind", "nodes", "edges"), rank).alias("f")).select("event_id", "f.*")
    return Fragment(won.select("event_id", F.inline("nodes")), won.select("event_id", F.inline("edges"))), won.select("event_id", "kind")


def split_rows(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Adds valid: a seeded split in which at least one row and not all are for validation; none if there is one row or the ratio is 0.

    Rows are ranked by a hash; a histogram of its upper bits finds the bin of the last validation row, and only that bin is ordered.
    """
    h = F.xxhash64(key, F.lit(seed))
    rows = df.withColumn("__h", h).withColumn("__b", F.shiftright(h, 48))
    counts = rows.groupBy("__b").agg(F.count("*").alias("c")).orderBy("__b").collect()
    n = sum(r.c for r in counts)
    want = 0 if n <= 1 or ratio <= 0 else min(n - 1, max(1, int(n * ratio)))
    edge, left = None, want
    for r in counts:
        if left <= r.c:
            edge = r["__b"]
            break
        left -= r.c
    if not want:
        return df.withColumn("valid", F.lit(False))
    last = rows.filter(F.col("__b") == edge).select("__h", F.col(key).alias("__k")).orderBy("__h", "__k").limit(left).agg(F.max(F.struct("__h", "__k")).alias("m")).first().m
    before = (F.col("__h") < last["__h"]) | ((F.col("__h") == last["__h"]) & (F.col(key) <= last["__k"]))
    return rows.withColumn("valid", before).drop("__h", "__b")


def write_split(df: DataFrame, folder: str) -> None:
    """train and valid as JSON lines; a valid set of an earlier run goes where there is none now."""
    df.filter("not valid").drop("valid").write.mode("overwrite").json(f"{folder}/train")
    valid = df.filter("valid").drop("valid")
    fs, at = _path(df.sparkSession, f"{folder}/valid")
    if valid.isEmpty():
        fs.delete(at, True)
    else:
        valid.write.mode("overwrite").json(f"{folder}/valid")


def chat_rows(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, label) of JSON lines, either as messages or as one text whose label is from its last line that opens an object."""
    rows = spark.read.schema("messages array<struct<role:string,content:string>>, text string").json(path)
    last = lambda role: F.element_at(F.filter("messages", lambda m: m["role"] == role), -1)["content"]
    cut: Column = F.length("text") - F.length(F.substring_index("text", "\n{", -1)) - 1
    has = F.contains("text", F.lit("\n{"))
    chat = F.col("messages").isNotNull()
    prompt = F.when(chat, last("user")).when(has, F.substring(F.col("text"), F.lit(1), cut - 1)).otherwise(F.col("text"))
    label = F.when(chat, last("assistant")).when(has, F.substring(F.col("text"), cut + 1, F.length("text")))
    return rows.select(prompt.alias("prompt"), label.alias("label"))
