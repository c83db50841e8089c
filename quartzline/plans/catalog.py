"""The queries of the relational and graph operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzline.functions import scalars
from quartzline.operators import graph, relops, rules
from quartzline.plans import inference, resolution
from quartzline.sources import artifacts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
SELECT user_id, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour_epoch, arg_max(value, (ts, event_id)) AS last_value
FROM events GROUP BY 1, 2
"""
)
def q_series_lastwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hour = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) * 3600).cast("long")
    rows = events.select("user_id", hour.alias("hour_epoch"), "ts", "event_id", F.col("value").alias("last_value"))
    return relops.last_wins(rows, ["user_id", "hour_epoch"], ["ts", "event_id"], ["last_value"])


def epoch(c: str):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    """
SELECT l_orderkey, arg_min(l_shipmode, o) AS l_shipmode, arg_min(l_returnflag, o) AS l_returnflag, arg_min(l_quantity, o) AS l_quantity
FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS l_shipmode, l_returnflag, l_quantity,
             (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem)
GROUP BY 1
"""
)
def q_reduce_distinct(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("l_shipmode", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")))
    return relops.reduce_distinct(lines, ["l_orderkey"], LINE_ORDER, ["l_shipmode", "l_returnflag", "l_quantity"])


@query(
    """
SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS last_purchase,
       bool_or(event_type = 'error') AS any_error
FROM events GROUP BY 1
"""
)
def q_meta_last_nonnull(spark, sf_dir):
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(relops.last_non_null(bought, "ts", "event_id").alias("last_purchase"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


@query(
    """
WITH s AS (SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value,
                  CAST(floor(min(epoch(ts))) AS BIGINT) AS start_epoch, CAST(floor(max(epoch(ts))) AS BIGINT) AS last_epoch,
                  bool_or(event_type = 'error') AS done FROM events GROUP BY 1)
SELECT user_id, first_value, last_value, start_epoch, CASE WHEN done THEN last_epoch END AS end_epoch,
       CASE WHEN last_value > first_value THEN 'up' WHEN last_value < first_value THEN 'down' END AS winner FROM s
"""
)
def q_winner_lock(spark, sf_dir):
    o = F.struct("ts", "event_id")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", o).alias("first_value"), F.max_by("value", o).alias("last_value"), F.min(epoch("ts")).alias("start_epoch"), F.max(epoch("ts")).alias("last"), F.bool_or(F.col("event_type") == "error").alias("done"))
    winner = F.when(F.col("last_value") > F.col("first_value"), "up").when(F.col("last_value") < F.col("first_value"), "down")
    return s.select("user_id", "first_value", "last_value", "start_epoch", F.when(F.col("done"), F.col("last")).alias("end_epoch"), winner.alias("winner"))


@query(
    """
SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour_epoch,
       arg_max(CASE WHEN event_type = 'error' THEN 1 - value ELSE value END, (ts, event_id)) AS reach
FROM events GROUP BY 1, 2
"""
)
def q_stage_dedupe(spark, sf_dir):
    reach = F.when(F.col("event_type") == "error", 1 - F.col("value")).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").withColumns({"reach": reach, "hour_epoch": (F.floor(epoch("ts") / 3600) * 3600).cast("long")})
    return relops.last_wins(rows, ["event_type", "hour_epoch"], ["ts", "event_id"], ["reach"])


@query(
    """
WITH o AS (SELECT s.s_suppkey, least(a.n_name, b.n_name) AS x, greatest(a.n_name, b.n_name) AS y FROM supplier s
           JOIN nation a ON a.n_nationkey = s.s_nationkey JOIN nation b ON b.n_nationkey = s.s_suppkey % 25),
     c AS (SELECT least(a.n_name, b.n_name) AS x, greatest(a.n_name, b.n_name) AS y, count(*) AS customers FROM customer
           JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = c_custkey % 25 GROUP BY 1, 2)
SELECT s_suppkey, x || '|' || y AS pair_key, customers FROM o LEFT JOIN c USING (x, y)
"""
)
def q_pair_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    one, two = nation.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("a")), nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("b"))
    pair = relops.unordered_pair(F.col("a"), F.col("b")).alias("pair")
    sup = table(spark, sf_dir, "supplier").join(one, F.col("s_nationkey") == F.col("k1")).join(two, F.col("s_suppkey") % 25 == F.col("k2")).select("s_suppkey", pair)
    cus = table(spark, sf_dir, "customer").join(one, F.col("c_nationkey") == F.col("k1")).join(two, F.col("c_custkey") % 25 == F.col("k2")).groupBy(pair).agg(F.count("*").alias("customers"))
    return relops.pair_join(sup, cus, "left").select("s_suppkey", F.array_join("pair", "|").alias("pair_key"), "customers")


@query(
    """
SELECT 'high' AS route, event_id FROM events WHERE value > 50 UNION ALL SELECT 'error' AS route, event_id FROM events WHERE event_type = 'error'
"""
)
def q_router_both(spark, sf_dir):
    routes = F.filter(F.array(F.when(F.col("value") > 50, "high"), F.when(F.col("event_type") == "error", "error")), lambda x: x.isNotNull())
    return table(spark, sf_dir, "events").select(F.explode(routes).alias("route"), "event_id")


@query(
    """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type <> 'error' THEN event_type || '|None|' || json_extract_string(props, '$.k') END AS items FROM events
"""
)
def q_json_extract(spark, sf_dir):
    """Lists that hold a null, and for errors one with something after it, which is no list."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('["'), "event_type", F.lit('", null, '), k, F.lit("]"), F.when(F.col("event_type") == "error", ' x ["y"]').otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"), F.array_join(scalars.json_list(text), "|").alias("items"))


@query(
    r"""
SELECT p_partkey, 'part:' || regexp_replace(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS node FROM part
"""
)
def q_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.node_id("part", scalars.slug(F.col("p_name"))).alias("node"))


@query(
    r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[ß]', '-', 'g'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents
"""
)
def q_slug_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.slug(F.col("text")).alias("slug"))


@query(
    r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang,
       regexp_extract(url, '/(\d+)(?:[/.?#]|$)', 1) AS number, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages
"""
)
def q_template_regex(spark, sf_dir):
    part = lambda p, n: F.regexp_extract("url", p, 1).alias(n)
    return table(spark, sf_dir, "pages").select("page_id", part("^https?://([^/]+)/", "host"), part("^https?://[^/]+/([a-z]{2})/", "lang"), part("/(\\d+)(?:[/.?#]|$)", "number"), part("\\?([^#]*)", "query"))


@query(
    """
SELECT 'order:' || o_orderkey AS source, 'line:' || l_orderkey || ':' || l_linenumber AS target, 'HAS_LINE' AS edge_type, count(*) AS n
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL
SELECT 'line:' || l_orderkey || ':' || l_linenumber, 'part:' || l_partkey, 'OF_PART', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL
"""
)
def q_fragment_explode(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    line, s = F.concat_ws(":", F.lit("line"), "l_orderkey", "l_linenumber"), lambda c: F.col(c).cast("string")
    edge = lambda a, b, t: F.struct(a.alias("source"), b.alias("target"), F.lit(t).alias("edge_type"))
    both = F.array(edge(F.concat(F.lit("order:"), s("l_orderkey")), line, "HAS_LINE"), edge(line, F.concat(F.lit("part:"), s("l_partkey")), "OF_PART"))
    return lines.select(F.inline(both)).groupBy("source", "target", "edge_type").agg(F.count("*").alias("n"))


def line_edges(spark, sf_dir):
    seq = F.struct(*[F.col(c) for c in ("l_orderkey", *LINE_ORDER)])
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"), (F.col("l_discount") * 10).alias("confidence"), F.array(F.col("l_orderkey").cast("string")).alias("evidence"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("text"), seq.alias("seq"))


@query(
    """
WITH e AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS type, l_orderkey,
                  struct_pack(seq := (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice), conf := l_discount * 10,
                              txt := CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_orderkey || '-' || l_linenumber END) AS x FROM lineitem),
     g AS (SELECT source, target, type, list_sort(list(x)) AS xs, max(x.conf) AS confidence, list_sort(list_distinct(list(CAST(l_orderkey AS VARCHAR)))) AS ev FROM e GROUP BY 1, 2, 3)
SELECT source, target, type, confidence, array_to_string(ev, ',') AS evidence,
       list_reduce(xs, lambda z, x: struct_pack(seq := z.seq, conf := greatest(z.conf, x.conf),
         txt := CASE WHEN (CASE WHEN x.conf > z.conf THEN x.txt ELSE z.txt END) <> '' THEN (CASE WHEN x.conf > z.conf THEN x.txt ELSE z.txt END)
                     ELSE (CASE WHEN x.conf > z.conf THEN z.txt ELSE x.txt END) END)).txt AS text FROM g
"""
)
def q_edge_merge(spark, sf_dir):
    return relops.merge_edges(line_edges(spark, sf_dir)).select("source", "target", "type", "confidence", F.array_join("evidence", ",").alias("evidence"), "text")


@query(
    """
SELECT l_suppkey AS local_id, arg_max(l_returnflag || l_linestatus, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS label,
       max(l_discount) AS confidence, array_to_string(list_sort(list_distinct(list(CAST(l_orderkey AS VARCHAR)))), ',') AS evidence,
       array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS aliases
FROM lineitem GROUP BY 1
"""
)
def q_node_merge(spark, sf_dir):
    seq = F.struct(*[F.col(c) for c in ("l_orderkey", *LINE_ORDER)])
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("local_id"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.lit("S").alias("type"), F.col("l_discount").alias("confidence"), F.array(F.col("l_orderkey").cast("string")).alias("evidence"), F.array("l_returnflag").alias("aliases"), seq.alias("seq"))
    return relops.merge_nodes(nodes).select("local_id", "label", "confidence", F.array_join("evidence", ",").alias("evidence"), F.array_join("aliases", ",").alias("aliases"))


@query(
    """
WITH e AS (SELECT l_discount * 10 AS c, l_suppkey AS s, l_partkey AS t, l_returnflag AS f, l_linenumber AS ln,
                  EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_suppkey % 7 <> 0) AS hs,
                  EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) AS ht FROM lineitem)
SELECT coalesce(CASE WHEN c < 0.2 THEN 'below_minimum_confidence' WHEN c > 1 THEN 'invalid_confidence' WHEN ln = 3 THEN 'missing_evidence'
            WHEN NOT (hs AND ht) THEN 'missing_endpoint' WHEN f = 'R' THEN 'invalid_pattern' END, 'accepted') AS reason, count(*) AS n
FROM e GROUP BY 1
"""
)
def q_accept_edges(spark, sf_dir):
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    evidence = F.when(F.col("l_linenumber") == 3, F.array().cast("array<string>")).otherwise(F.array(F.col("l_orderkey").cast("string")))
    edges = table(spark, sf_dir, "lineitem").select(name("s", "l_suppkey").alias("source"), name("p", "l_partkey").alias("target"), F.col("l_returnflag").alias("type"), (F.col("l_discount") * 10).alias("confidence"), evidence.alias("evidence"))
    sup = table(spark, sf_dir, "supplier").filter("s_suppkey % 7 <> 0").select(name("s", "s_suppkey").alias("id"), F.lit("S").alias("type"))
    part = table(spark, sf_dir, "part").select(name("p", "p_partkey").alias("id"), F.lit("P").alias("type"))
    allowed = spark.createDataFrame([(f, "S", "P") for f in "AN"], "type string, source_type string, target_type string")
    return relops.accept_edges(edges, sup.unionByName(part), allowed, 0.2).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """
SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber || '/' || l_partkey)), ',') AS members FROM lineitem GROUP BY 1
HAVING count(*) >= 2 AND count_if(l_linestatus = 'O') >= 1 AND count_if(l_returnflag = 'N') >= 2
"""
)
def q_exactly_one(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("m", F.concat_ws("/", "l_linenumber", "l_partkey"))
    out = relops.exactly_one(lines, "l_orderkey", "m", 2, {"open": (F.col("l_linestatus") == "O", 1), "none": (F.col("l_returnflag") == "N", 2)})
    return out.select("l_orderkey", F.array_join("members", ",").alias("members"))


@query(
    """
WITH r AS (SELECT o_custkey, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank FROM orders),
     w AS (SELECT o_orderkey AS prev, rank, lead(o_orderkey) OVER x AS next, lead(rank) OVER x AS next_rank FROM r WINDOW x AS (PARTITION BY o_custkey ORDER BY rank, o_orderkey))
SELECT DISTINCT prev, next FROM w WHERE next_rank = rank + 1
"""
)
def q_rank_links(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("rank", F.substring("o_orderpriority", 1, 1).cast("int"))
    return relops.rank_links(orders, "o_custkey", "rank", "o_orderkey")


@query(
    """
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
     n AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 1 THEN NULL ELSE day END AS s FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day))
SELECT o_custkey, strftime(day, '%Y-%m-%d') AS day, strftime(max(s) OVER (PARTITION BY o_custkey ORDER BY day ROWS UNBOUNDED PRECEDING), '%Y-%m-%d') AS island FROM n
"""
)
def q_near_date(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day")).distinct()
    return relops.date_islands(days, "o_custkey", "day").select("o_custkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("island", "yyyy-MM-dd").alias("island"))


@query(
    """
SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
 AND abs(CAST(a.o_orderdate AS DATE) - CAST(b.o_orderdate AS DATE)) <= 1
"""
)
def q_near_date_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    side = lambda s: orders.select("o_custkey", F.col("o_orderkey").alias(f"{s}_key"), F.col("o_orderdate").cast("date").alias(f"{s}_date"))
    return relops.near_date_join(side("left"), side("right"), "o_custkey").filter("left_key < right_key").select("left_key", "right_key")


@query(
    """
WITH p AS (SELECT DISTINCT o_custkey AS team, o_orderstatus AS comp, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank FROM orders)
SELECT a.team, a.comp, a.rank AS rank_a, b.rank AS rank_b FROM p a JOIN p b ON a.team = b.team AND a.comp = b.comp AND a.rank > b.rank
"""
)
def q_rule_pairs(spark, sf_dir):
    none, rank = F.lit("").alias, F.substring("o_orderpriority", 1, 1)
    props = table(spark, sf_dir, "orders").select(
        F.concat_ws(":", "o_custkey", "o_orderstatus", rank).alias("id"), F.concat_ws("-", rank, "o_custkey").alias("key"), F.lit("rank").alias("predicate"), F.lit(True).alias("polarity"),
        F.col("o_custkey").cast("string").alias("team"), F.col("o_orderstatus").alias("competition"), rank.alias("stage"), none("match"), F.array(rank).alias("evidence"),
    ).distinct()
    higher = rules.Rule("rank", "IMPLIES", rules.SAME, lambda a, b: a["stage"] > b["stage"])
    part = lambda c, i: F.split(c, ":")[i]
    fired = rules.fire(props, [higher])
    return fired.select(part("source", 0).cast("long").alias("team"), part("source", 1).alias("comp"), part("source", 2).cast("int").alias("rank_a"), part("target", 2).cast("int").alias("rank_b"))


@query(
    """
WITH RECURSIVE e AS (SELECT conv_id * 100 + turn AS s, conv_id * 100 + turn + 1 AS t FROM conversations c
                     WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)),
     r AS (SELECT s, t, CAST(s AS VARCHAR) || '>' || t AS path, 1 AS hops FROM e
           UNION ALL SELECT r.s, e.t, path || '>' || e.t, hops + 1 FROM r JOIN e ON e.s = r.t)
SELECT s AS src, t AS dst, path FROM r WHERE hops > 1
"""
)
def q_closure(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    node = F.col("conv_id") * 100 + F.col("turn")
    edges = turns.join(after, ["conv_id", "turn"]).select(node.alias("src"), (node + 1).alias("dst"))
    return graph.closure(edges).select("src", "dst", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


@query(
    """
WITH t AS (SELECT conv_id, max(turn) AS last, min(turn) AS first FROM conversations GROUP BY 1)
SELECT conv_id * 100 + turn AS src, CASE WHEN turn = last THEN conv_id * 100 + first ELSE conv_id * 100 + turn + 1 END AS dst
FROM conversations JOIN t USING (conv_id) WHERE conv_id % 5 = 0
"""
)
def q_cycle_peel(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"))
    node = lambda c: F.col("conv_id") * 100 + F.col(c)
    back = F.when(F.col("turn") < F.col("last"), node("turn") + 1).when(F.col("conv_id") % 5 == 0, node("first"))
    return graph.cycle_core(turns.join(ends, "conv_id").select(node("turn").alias("src"), back.alias("dst")).filter("dst is not null"))


@query(
    """
WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT a.p_name AS name, b.p_name AS best, levenshtein(a.p_name, b.p_name) AS d
  FROM n a JOIN n b ON a.p_name <> b.p_name)
SELECT name, best, CAST(d AS BIGINT) AS distance FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY d, best) = 1
"""
)
def q_fuzzy_top1_levenshtein(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    q, pool = names.select(F.col("name").alias("query_id")), names.select(F.col("name").alias("pool_seq"))
    out = relops.best_match(q, pool, F.when(F.col("query_id") != F.col("pool_seq"), -F.levenshtein("query_id", "pool_seq")), [], least=-1000)
    return out.select(F.col("query_id").alias("name"), F.col("pool_seq").alias("best"), (-F.col("score")).cast("long").alias("distance"))


@query()
def q_fuzzy_top1(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    q, pool = names.select(F.col("name").alias("query_id")), names.select(F.col("name").alias("pool_seq"))
    score = F.when(F.col("query_id") != F.col("pool_seq"), scalars.token_sort_ratio(F.col("query_id"), F.col("pool_seq")))
    return relops.best_match(q, pool, score, [], least=0.0).select(F.col("query_id").alias("name"), F.col("pool_seq").alias("best"), F.round("score", 6).alias("score"))


@query(
    """
WITH RECURSIVE i AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
     f AS (SELECT conv_id, turn, n, s AS used, 1 AS c, 0 AS chunk FROM i WHERE n = 1
           UNION ALL SELECT i.conv_id, i.turn, i.n, CASE WHEN used + i.s > 400 OR c >= 3 THEN i.s ELSE used + i.s END,
             CASE WHEN used + i.s > 400 OR c >= 3 THEN 1 ELSE c + 1 END, CASE WHEN used + i.s > 400 OR c >= 3 THEN chunk + 1 ELSE chunk END
           FROM f JOIN i ON i.conv_id = f.conv_id AND i.n = f.n + 1)
SELECT conv_id, turn, chunk FROM f
"""
)
def q_chunk_fold(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    return relops.chunk_fold(turns, "conv_id", "turn", "size", 400, 3)


@query(
    """
SELECT 'status' AS kind, o_orderstatus AS item, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
"""
)
def q_hist(spark, sf_dir):
    item = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(c).alias("item"))
    return table(spark, sf_dir, "orders").select(F.inline(F.array(item("status", "o_orderstatus"), item("priority", "o_orderpriority")))).groupBy("kind", "item").agg(F.count("*").alias("n"))


@query(
    """
WITH s AS (SELECT source, coalesce(list(doc_id) FILTER (WHERE quality = 0), []) AS a, coalesce(list(doc_id) FILTER (WHERE toxic = 1), []) AS b FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM s
"""
)
def q_set_f1(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    a, b = F.col("quality") == 0, F.col("toxic") == 1
    n = both.groupBy("source").agg(F.count_if(a & b).alias("both"), F.count_if(a).alias("a"), F.count_if(b).alias("b"))
    return n.select("source", F.round(relops.f1_of(F.col("both"), F.col("a"), F.col("b")), 6).alias("f1"))


@query("SELECT DISTINCT 'left' AS side, c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) UNION ALL SELECT DISTINCT 'right', s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def q_fragment_diff(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("k")).distinct()
    return a.exceptAll(b).select(F.lit("left").alias("side"), "k").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "k"))


@query("SELECT p_brand, p_partkey, p_size FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50) UNION ALL SELECT p_brand, p_partkey, -1 FROM part WHERE p_size = 50")
def q_replace_topology(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    return relops.replace_groups(part, part.filter("p_size = 50").withColumn("p_size", F.lit(-1)), "p_brand")


@query("SELECT split, CAST(n AS BIGINT) AS n FROM (SELECT 'valid' AS split, greatest(1, floor(count(*) * 0.1)) AS n FROM labels UNION ALL SELECT 'train', count(*) - greatest(1, floor(count(*) * 0.1)) FROM labels)")
def q_split_counts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return artifacts.split_rows(labels, "doc_id", 0.1, 7).groupBy(F.when(F.col("valid"), "valid").otherwise("train").alias("split")).agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name, CAST(NULL AS BIGINT) AS r_population FROM region")
def q_typed_null(spark, sf_dir):
    return relops.typed_backfill(table(spark, sf_dir, "region"), {"r_regionkey": "int", "r_name": "string", "r_population": "bigint"})


@query("SELECT c_name, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def q_recipe_bridge(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_name", "n_name", "r_name")


@query("SELECT l_orderkey, sha256(array_to_string(list_sort(list(l_linenumber || ':' || l_partkey || ':' || l_suppkey)), '|')) AS fingerprint FROM lineitem GROUP BY 1")
def q_fingerprint(spark, sf_dir):
    item = F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "|"), 256).alias("fingerprint"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN text[:117] || '...' ELSE text END AS cut, greatest(1, length(text) // 4) AS tokens FROM documents")
def q_truncate_tokens(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.truncate(t, 120).alias("cut"), scalars.token_estimate(t).alias("tokens"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN -1.0 END, c_acctbal) AS c_acctbal FROM customer")
def q_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return relops.upsert(old, old.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0)), "c_custkey")


TURNS = "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS t2, min(turn) OVER (PARTITION BY conv_id) AS t0, max(turn) OVER (PARTITION BY conv_id) AS t9 FROM conversations"


def turn_edges(spark, sf_dir):
    """Each turn to the next, and the last back to the first in every fifth conversation of several turns."""
    node = lambda t: F.concat_ws(":", "conv_id", t)
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    chain = turns.withColumn("next", F.lead("turn").over(w)).filter("next is not null").select("conv_id", node("turn").alias("src"), node("next").alias("dst"))
    ends = turns.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b")).filter("conv_id % 5 = 0 and a < b")
    return chain.unionByName(ends.select("conv_id", node("b").alias("src"), node("a").alias("dst")))


@query(
    f"""
WITH t AS ({TURNS}), e AS (SELECT conv_id, turn AS a, t2 AS b FROM t WHERE t2 IS NOT NULL UNION ALL SELECT DISTINCT conv_id, t9, t0 FROM t WHERE conv_id % 5 = 0 AND t0 < t9)
SELECT conv_id || ':' || a AS src, conv_id || ':' || b AS dst, CASE WHEN conv_id % 5 = 0 THEN 'progression_cycle' END AS reason FROM e
"""
)
def q_cycle_reject(spark, sf_dir):
    return graph.reject_cycles(turn_edges(spark, sf_dir).drop("conv_id"))


@query(f"WITH t AS ({TURNS}) SELECT conv_id || ':' || turn AS id, conv_id || ':' || t0 AS comp FROM t WHERE t0 < t9")
def q_components(spark, sf_dir):
    """Turn numbers have one digit, so the smallest text is the first turn."""
    return graph.components(turn_edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query(
    """
WITH o AS (SELECT 'match:c' || o_custkey || '-' || strftime(o_orderdate, '%Y-%m-%d') AS local_id, o_custkey, CAST(o_orderdate AS DATE) AS day, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS official FROM orders GROUP BY 1, 2, 3),
     g AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) <= 1 THEN 0 ELSE 1 END AS starts FROM o),
     i AS (SELECT *, sum(starts) OVER (PARTITION BY o_custkey ORDER BY day) AS island FROM g)
SELECT local_id, arg_max(local_id, (official, day)) OVER (PARTITION BY o_custkey, island) AS entity FROM i
"""
)
def q_match_fixtures(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    local = F.concat(F.lit("match:c"), F.col("o_custkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return resolution.match_fixtures(orders.select(local.alias("local_id"), F.when(F.col("o_orderstatus") == "P", "official_bracket").otherwise("x").alias("method")))


@query(
    """
WITH l AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS a, list_distinct(list(l_linestatus || 'X')) AS b FROM lineitem GROUP BY 1)
SELECT round(avg(CAST(list_contains(a, 'N') AS INTEGER)), 4) AS has_n, count(*) AS n FROM l
"""
)
def q_flag_share(spark, sf_dir):
    flags = relops.united(table(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_returnflag").alias("flags")), ["l_orderkey"], ["flags"])
    return flags.agg(F.round(F.avg(F.array_contains("flags", "N").cast("int")), 4).alias("has_n"), F.count("*").alias("n"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS event_id, count(*) AS n FROM orders GROUP BY 1 ORDER BY abs(count(*) - 4), event_id LIMIT 25")
def q_events_of_size(spark, sf_dir):
    return inference.events_of_size(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("event_id")), 25)


@query(
    """
WITH e AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE value > 50) AS a, list(DISTINCT event_type) FILTER (WHERE value <= 90) AS b FROM events GROUP BY 1),
     s AS (SELECT coalesce(len(a), 0) AS na, coalesce(len(b), 0) AS nb, coalesce(len(list_intersect(a, b)), 0) AS m FROM e)
SELECT round(avg(CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE m / nb END), 4) AS precision,
       round(avg(CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE m / na END), 4) AS recall,
       round(avg(CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE 2.0 * m / (na + nb) END), 4) AS f1 FROM s
"""
)
def q_mean_scores(spark, sf_dir):
    kinds = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(kinds(F.col("value") > 50).alias("expected"), kinds(F.col("value") <= 90).alias("got"))
    return inference.scores(sets)
