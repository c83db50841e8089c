"""Orchestration of model inference over events that no template covers: chunks, prompts, an extractor plug-in, resume, merge and verification.

The extractor is a function from a prompt to JSON text, run in map tasks; the default is offline and finds nothing, so a run without a model
is complete and repeatable. A failure stays with its chunk: it becomes a status, with the output that couldn't be read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.functions import scalars as s
from quartzline.operators import relops
from quartzline.plans.fragments import Fragment, merged, same_fragments

C = F.col
Extractor = Callable[[str], str]
#: Types that a model may emit, both for nodes and for edges.
NODE_TYPES = ("COMPETITION", "STAGE", "GROUP", "ROUND", "MATCH", "TEAM")
EDGE_TYPES = ("PART_OF", "PARTICIPATES_IN", "QUALIFIES_FOR", "ADVANCES_TO")
RESERVE, FLOOR = 700, 512
REPLY = "event_id string, chunk int, status string, reply string"
WIRE = "struct<n:array<struct<id:string,t:string,l:string,a:array<string>,c:double,e:array<string>>>,g:array<struct<s:string,d:string,t:string,c:double,e:array<string>,x:string>>>"
FULL = "struct<nodes:array<struct<local_id:string,type:string,label:string,aliases:array<string>,confidence:double,evidence:array<string>>>,edges:array<struct<source:string,target:string,type:string,confidence:double,evidence:array<string>,text:string>>>"


def offline(prompt: str) -> str:
    return '{"n": [], "g": []}'


def uncovered(markets: DataFrame, covered: DataFrame, event_ids: list[str] | None = None) -> DataFrame:
    """Markets of events that no template covers, of the given events in the caller's order (column place)."""
    left = markets.join(covered.filter("fully_covered").select("event_id"), "event_id", "left_anti")
    if event_ids is None:
        return left.withColumn("place", F.lit(0))
    asked = left.sparkSession.createDataFrame([(e, i) for i, e in enumerate(dict.fromkeys(event_ids))], "event_id string, place int")
    return left.join(asked, "event_id")


def serialized(markets: DataFrame, most: int = 400) -> DataFrame:
    """Adds line, the market as compact JSON with its long texts cut, and tokens, what it takes of a prompt."""
    cols = ["market_id", "question", "description", "group_item_title", "sports_market_type", "outcomes"]
    line = s.compact_json(*[s.truncate(C(c), most).alias(c) if c in ("question", "description") else C(c) for c in cols])
    return markets.withColumn("line", line).withColumn("tokens", s.token_estimate(C("line")))


def chunked(markets: DataFrame, context: int, exemplars: int = 0, most: int = 20, most_output: int = 4096, each: int = 120) -> DataFrame:
    """Adds chunk: markets of an event packed in order, within what the context leaves for input, a number of them, and the tokens of their output."""
    budget = max(FLOOR, context - most_output - RESERVE * exemplars)
    return markets.join(relops.chunk_fold(markets.select("event_id", "seq", "tokens"), "event_id", "seq", "tokens", budget, max(1, min(most, most_output // each))), ["event_id", "seq"])


def exemplars_for(events: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(event_id, rank, example): the k exemplars (pool_seq, title, example) most like an event's title; without a title the first k.

    The pool is a table of a few rows by hand, so every title may meet all of it.
    """
    asked = events.select(C("event_id").alias("query_id"), "title")
    score = F.when(F.coalesce(C("title"), F.lit("")) == "", 0.0).otherwise(s.token_sort_ratio(F.coalesce("title", F.lit("")), C("pool_title")))
    best = relops.best_match(asked, F.broadcast(pool.withColumnRenamed("title", "pool_title")), score, [], k)
    return best.select(C("query_id").alias("event_id"), "rank", "example")


def prompts(chunks: DataFrame, examples: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(event_id, chunk, n_markets, prompt, most_tokens, fingerprint): one prompt a chunk, the event's examples first."""
    rows = chunks.groupBy("event_id", "chunk").agg(F.count("*").alias("n_markets"), F.first("event_title").alias("title"), F.array_sort(F.collect_list(F.struct("seq", "line")))["line"].alias("lines"))
    if examples is not None:
        shown = examples.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", "example")))["example"].alias("examples"))
        rows = rows.join(shown, "event_id", "left")
    shown = F.coalesce(F.array_join("examples", "\n") if examples is not None else F.lit(None), F.lit(""))
    rules = F.lit("Return one JSON object with nodes n and edges g." + (" Return JSON only, without any other text." if strict else ""))
    text = F.concat_ws("\n", rules, F.nullif(shown, F.lit("")), F.concat(F.lit("Event: "), F.coalesce("title", F.lit(""))), F.array_join("lines", "\n"))
    out = rows.select("event_id", "chunk", "n_markets", text.alias("prompt"), s.chunk_tokens(C("n_markets"), 4096).alias("most_tokens"))
    return out.withColumn("fingerprint", fingerprint("event_id", "chunk", "n_markets", "prompt", "most_tokens"))


def fingerprint(*cols: str | Column) -> Column:
    """SHA-256 of the columns as canonical JSON."""
    return F.sha2(s.compact_json(*cols), 256)


def left_to_do(asked: DataFrame, manifest: DataFrame) -> DataFrame:
    """Prompts without a finished answer to the very same prompt; an answer to another one counts for nothing."""
    return asked.join(manifest.filter("status = 'ok'").select("event_id", "chunk", "fingerprint"), ["event_id", "chunk", "fingerprint"], "left_anti")


def extracted(asked: DataFrame, extract: Extractor = offline, retries: int = 2, partitions: int | None = None) -> DataFrame:
    """(event_id, chunk, status, reply): ok with JSON text, or failed with the last output or error, after ``retries`` more tries with a stricter prompt."""

    def one(prompt: str) -> tuple[str, str]:
        said = ""
        for n in range(retries + 1):
            try:
                said = extract(prompt if not n else prompt + "\nReturn JSON only, without any other text.")
                if isinstance(json.loads(said), dict):
                    return "ok", said
            except Exception as e:  # noqa: BLE001 - whatever a plug-in raises fails its own chunk only
                said = said or f"{type(e).__name__}: {e}"
        return "failed", said

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            got = [one(p) for p in pdf["prompt"]]
            yield pd.DataFrame({"event_id": pdf["event_id"], "chunk": pdf["chunk"], "status": [x[0] for x in got], "reply": [x[1] for x in got]})

    rows = asked.select("event_id", "chunk", "prompt")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, REPLY)


def parsed(replies: DataFrame) -> Fragment:
    """The fragments of the ok replies, in the compact or the full form; only types that a model may emit, and edges whose ends are there."""
    short, long = F.from_json("reply", WIRE), F.from_json("reply", FULL)
    rows = replies.filter("status = 'ok'").select("event_id", "chunk", short.alias("w"), long.alias("f"))
    nodes = F.coalesce("w.n", F.transform("f.nodes", lambda n: F.struct(n["local_id"].alias("id"), n["type"].alias("t"), n["label"].alias("l"), n["aliases"].alias("a"), n["confidence"].alias("c"), n["evidence"].alias("e"))))
    edges = F.coalesce("w.g", F.transform("f.edges", lambda g: F.struct(g["source"].alias("s"), g["target"].alias("d"), g["type"].alias("t"), g["confidence"].alias("c"), g["evidence"].alias("e"), g["text"].alias("x"))))
    none = F.array().cast("array<string>")
    n = rows.select("event_id", "chunk", F.posexplode(nodes).alias("i", "x")).filter(C("x.t").isin(*NODE_TYPES))
    n = n.select("event_id", C("x.id").alias("local_id"), C("x.t").alias("type"), C("x.l").alias("label"), F.coalesce("x.a", none).alias("aliases"), C("x.c").alias("confidence"), F.coalesce("x.e", none).alias("evidence"), (C("chunk") * 1_000_000 + C("i")).cast("long").alias("seq"))
    g = rows.select("event_id", "chunk", F.posexplode(edges).alias("i", "x")).filter(C("x.t").isin(*EDGE_TYPES))
    g = g.select("event_id", C("x.s").alias("source"), C("x.d").alias("target"), C("x.t").alias("type"), C("x.c").alias("confidence"), F.coalesce("x.e", none).alias("evidence"), F.coalesce(s.strip(C("x.x")), F.lit("")).alias("text"), (C("chunk") * 1_000_000 + C("i")).cast("long").alias("seq"))
    for end in ("source", "target"):
        g = g.join(n.select("event_id", C("local_id").alias(end)).distinct(), ["event_id", end], "left_semi")
    return Fragment(n, g.select("event_id", "source", "target", "type", "confidence", "evidence", "text", "seq"))


def event_status(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """(event_id, status): ok if every chunk of the event has an ok reply; a missing one fails it."""
    done = asked.select("event_id", "chunk").join(replies.select("event_id", "chunk", "status"), ["event_id", "chunk"], "left")
    return done.groupBy("event_id").agg(F.when(F.bool_and(F.coalesce(C("status") == "ok", F.lit(False))), "ok").otherwise("failed").alias("status"))


def inferred(markets: DataFrame, covered: DataFrame, extract: Extractor = offline, context: int = 8192, pool: DataFrame | None = None, k: int = 0) -> tuple[Fragment, DataFrame, DataFrame]:
    """The fragments of uncovered events whose chunks all succeeded, (event_id, status), and the replies that couldn't be used."""
    chunks = chunked(serialized(uncovered(markets, covered)), context, k)
    shown = None if pool is None else exemplars_for(markets.groupBy("event_id").agg(F.min_by("event_title", "seq").alias("title")), pool, k)
    asked = prompts(chunks, shown)
    replies = extracted(asked, extract)
    status = event_status(asked, replies)
    good = status.filter("status = 'ok'").select("event_id")
    f = merged(parsed(replies))
    return Fragment(f.nodes.join(good, "event_id", "left_semi"), f.edges.join(good, "event_id", "left_semi")), status, replies.filter("status <> 'ok'")


def verified(proposed: Fragment, answered: Fragment) -> DataFrame:
    """(event_id, outcome): verified where the model's answer is the proposal, but for confidence and order; else corrected."""
    return same_fragments(proposed, answered).select("event_id", F.when(C("same"), "verified").otherwise("corrected").alias("outcome"))


def training_rows(markets: DataFrame, fragments: DataFrame, most: int = 8) -> DataFrame:
    """(event_id, prompt, label): an event's first markets and its fragment as JSON; events without either are left out."""
    rows = serialized(markets).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line")))["line"].alias("lines"))
    return rows.select("event_id", F.array_join(F.slice("lines", 1, most), "\n").alias("prompt")).join(fragments.select("event_id", C("fragment").alias("label")), "event_id")


def scores(examples: DataFrame) -> DataFrame:
    """Means of precision, recall and F1 over examples (expected, got: arrays), rounded to four places; two empty sets agree, one alone doesn't."""
    both, want, got = F.size(F.array_intersect("expected", "got")), F.size(F.array_distinct("expected")), F.size(F.array_distinct("got"))
    share = lambda n: F.when((want == 0) & (got == 0), 1.0).when((want == 0) | (got == 0), 0.0).otherwise(both / n)
    one = examples.select(share(got).alias("precision"), share(want).alias("recall"), relops.set_f1(C("expected"), C("got")).alias("f1"))
    return one.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def events_of_size(markets: DataFrame, n: int, size: int = 4) -> DataFrame:
    """The n events whose number of markets is closest to ``size``."""
    return markets.groupBy("event_id").agg(F.count("*").alias("n")).orderBy(F.abs(C("n") - size), "event_id").limit(n)
