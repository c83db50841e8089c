"""The command line from a mart to a valid graph; chunks, extraction, resume and stored fragments."""

import json

from quartzline import cli
from quartzline.plans import inference
from quartzline.plans.fragments import Fragment
from quartzline.sources import artifacts

MARKETS = [
    ("10", "100", "Brazil vs. Morocco", "fifwc-bra-mar-2026-06-13", "Will Brazil win?", "Brazil", "moneyline", '["Yes", "No"]'),
    ("11", "100", "Brazil vs. Morocco", "fifwc-bra-mar-2026-06-13", "Will Morocco win?", "Morocco", "moneyline", '["Yes", "No"]'),
    ("20", "200", "World Cup Winner", "world-cup-winner", "Will Brazil win the 2026 FIFA World Cup?", "Brazil", None, '["Yes", "No"]'),
    ("30", "300", "World Cup: Nation to Reach Final", "nation-final", "Will Brazil reach the final?", "Brazil", None, '["Yes", "No"]'),
]


def test_run_from_a_mart(spark, tmp_path):
    rows = [(*m, None, None, None, None, None, None, None, hour, 0.4, "Yes", None, None, None) for m in MARKETS for hour in (3600, 7200)]
    ddl = "market_id string, event_id string, event_title string, event_slug string, question string, group_item_title string, sports_market_type string, outcomes string, event_description string, description string, market_slug string, game_start_time string, end_time string, tags string, event_tags string, odds_hour_epoch long, close_odds double, primary_outcome_label string, event_finished_at string, is_resolved boolean, winning_outcome string"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/data/mart.parquet")
    base = ["--build-dir", f"{tmp_path}/out", "--data-dir", f"{tmp_path}/data"]
    assert cli.main([*base, "run"], spark) == 0
    nodes, edges = artifacts.read_graph(spark, f"{tmp_path}/out/graph")
    types = {r.type for r in edges.collect()}
    assert {"HAS_MARKET", "HAS_OUTCOME", "PRICES", "REFERS_TO", "COMPLEMENT", "IMPLIES", "PARTICIPATES_IN"} <= types
    said = {r.id: r.proposition for r in nodes.filter("proposition is not null").collect()}
    assert len(said) == 8 and said["outcome:20:yes"].predicate == "wins_competition" and said["outcome:20:no"].polarity is False
    report = artifacts.read_json(spark, f"{tmp_path}/out/graph/report.json")
    assert report["node_types"]["MARKET"] == 4 and report["tiers"]["exact_id"] > 0
    assert len(artifacts.read_json(spark, f"{tmp_path}/out/graph/ontology.json")) == 38 and artifacts.read_json(spark, f"{tmp_path}/none.json", {}) == {}
    assert spark.read.parquet(f"{tmp_path}/out/stage_odds_history.parquet").count() == 4
    status = spark.read.parquet(f"{tmp_path}/out/inference_status.parquet").collect()
    assert {(r.event_id, r.status) for r in status} == {("300", "ok")}


def test_extraction_fails_by_chunk_and_resumes(spark):
    rows = [(str(i), f"e{i // 3}", f"T{i // 3}", "q", "d", None, None, ["Yes"], i) for i in range(6)]
    markets = spark.createDataFrame(rows, "market_id string, event_id string, event_title string, question string, description string, group_item_title string, sports_market_type string, outcomes array<string>, seq long")
    chunks = inference.chunked(inference.serialized(markets), 8192, most=2)
    asked = inference.prompts(chunks)
    assert {(r.event_id, r.chunk, r.n_markets) for r in asked.collect()} == {(e, c, 2 - c) for e in ("e0", "e1") for c in (0, 1)}

    def extract(prompt):
        if "T1" in prompt and '"5"' in prompt:
            return "no json"
        return json.dumps({"n": [{"id": "team:a", "t": "TEAM", "l": "A", "c": 0.5, "e": ["1"]}, {"id": "x", "t": "EVENT", "l": "X"}], "g": [{"s": "team:a", "d": "x", "t": "PART_OF", "c": 1.0, "e": ["1"]}]})

    replies = inference.extracted(asked, extract, retries=1)
    assert {(r.event_id, r.chunk, r.status) for r in replies.collect()} == {("e0", 0, "ok"), ("e0", 1, "ok"), ("e1", 0, "ok"), ("e1", 1, "failed")}
    assert {(r.event_id, r.status) for r in inference.event_status(asked, replies).collect()} == {("e0", "ok"), ("e1", "failed")}
    f = inference.parsed(replies)
    assert {r.type for r in f.nodes.collect()} == {"TEAM"} and f.edges.count() == 0
    done = replies.join(asked.select("event_id", "chunk", "fingerprint"), ["event_id", "chunk"])
    assert [(r.event_id, r.chunk) for r in inference.left_to_do(asked, done).collect()] == [("e1", 1)]
    assert {r.event_id for r in inference.events_of_size(markets, 1, 3).collect()} == {"e0"}


def test_stored_fragments_and_splits(spark, tmp_path):
    n = lambda label: spark.createDataFrame([("e", "team:a", "TEAM", label, ["x"], 1.0, ["1"], 0)], "event_id string, local_id string, type string, label string, aliases array<string>, confidence double, evidence array<string>, seq long")
    g = spark.createDataFrame([], "event_id string, source string, target string, type string, confidence double, evidence array<string>, text string, seq long")
    for kind in ("inferred", "topology", "verified"):
        artifacts.write_fragments(Fragment(n(kind), g), kind, f"{tmp_path}/f")
    pick = lambda **k: artifacts.read_fragments(spark, f"{tmp_path}/f", **k)[0].nodes.first().label
    none = spark.createDataFrame([], "event_id string")
    assert pick() == "verified" and pick(usable=none) == "topology" and pick(resume=False) == "inferred"
    rows = spark.range(200).withColumnRenamed("id", "k")
    assert artifacts.split_rows(rows, "k", 0.1, 3).filter("valid").count() == 20
    assert artifacts.split_rows(rows.limit(1), "k", 0.5, 3).filter("valid").count() == 0 and artifacts.split_rows(rows.limit(2), "k", 0.01, 3).filter("valid").count() == 1
    artifacts.write_split(artifacts.split_rows(rows, "k", 0.1, 3), f"{tmp_path}/s")
    artifacts.write_split(artifacts.split_rows(rows, "k", 0, 3), f"{tmp_path}/s")
    assert not (tmp_path / "s" / "valid").exists() and spark.read.json(f"{tmp_path}/s/train").count() == 200
    with open(f"{tmp_path}/c.jsonl", "w") as out:
        out.write(json.dumps({"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "l"}]}) + "\n" + json.dumps({"text": 'ask\n{"a": 1}\n{"b": 2}'}) + "\n")
    assert {tuple(r) for r in artifacts.chat_rows(spark, f"{tmp_path}/c.jsonl").collect()} == {("p", "l"), ('ask\n{"a": 1}', '{"b": 2}')}
    s = inference.scores(spark.createDataFrame([(["a", "b"], ["a"]), ([], []), (["a"], [])], "expected array<string>, got array<string>")).first()
    assert (s.precision, s.recall, s.f1) == (0.6667, 0.5, 0.5556)
