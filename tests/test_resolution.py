"""Entity resolution, the bracket and the graph build on small tables with known results."""

from quartzline.functions import dimensions
from quartzline.operators import graph
from quartzline.plans import bracket, compilers, resolution

D = compilers.Domain(aliases={"Côte d'Ivoire": "Ivory Coast", "Korea Republic": "South Korea"}, codes={"kor": "Curaçao", "bra": "Brazil", "civ": "Ivory Coast"})


def nodes(spark, *rows):
    full = [(f"n{i}" if r[0] is None else r[0], r[1], r[2], r[3] if len(r) > 3 else [], 0.5 + i / 100, [str(i)], r[4] if len(r) > 4 else "x", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "local_id string, type string, label string, aliases array<string>, confidence double, evidence array<string>, method string, seq long")


def test_tiers_and_merges(spark):
    rows = nodes(
        spark,
        ("c", "COMPETITION", "World Cup 2026"),
        ("t1", "TEAM", "Brazil", ["bra"]),
        ("t2", "TEAM", "BRAZIL"),
        ("t3", "TEAM", "Seleção", ["Brazil"]),
        ("t4", "TEAM", "Côte d'Ivoire"),
        ("t5", "TEAM", "South Korea", ["kor"]),
        ("t6", "TEAM", "Curaçao", ["kor"]),
        ("t7", "TEAM", "Bosnia and Herzegovina"),
        ("t8", "TEAM", "Bosnia and Hercegovina"),
        ("s", "STAGE", "Round of 16"),
        ("k1", "CONSTRAINT", "Exact winner: Group A"),
        ("k2", "CONSTRAINT", "Exact winner: Group B"),
        ("event:1", "EVENT", "Same"),
        ("event:2", "EVENT", "Same"),
        ("match:a-vs-b-2026-06-26", "MATCH", "A vs. B", ["slug"]),
        ("match:a-vs-b-2026-06-27", "MATCH", "A vs. B", [], "official_bracket"),
        ("match:a-vs-b-2026-07-27", "MATCH", "A vs. B"),
        ("match:a-vs-b", "MATCH", "A vs. B"),
    )
    canonical, xref = resolution.resolve(rows, D)
    to = {r.local_id: (r.canonical_id, r.tier) for r in xref.collect()}
    assert to["t1"] == ("team:brazil", "new_entity") and to["t2"] == ("team:brazil", "exact_slug") and to["t3"] == ("team:brazil", "alias")
    assert to["t4"] == ("team:ivory-coast", "new_entity")
    assert to["t5"][0] == "team:south-korea" and to["t6"][0] == "team:curacao"
    assert to["t7"][0] == to["t8"][0] == "team:bosnia-and-herzegovina" and to["t8"][1] == "fuzzy"
    assert to["s"][0] == "stage:world-cup-2026:round-of-16"
    assert to["k1"][0] == "k1" and to["k2"][0] == "k2" and to["event:2"] == ("event:2", "exact_id")
    assert {to[x][0] for x in ("match:a-vs-b-2026-06-26", "match:a-vs-b-2026-06-27", "match:a-vs-b")} == {"match:a-vs-b-2026-06-27"}
    assert to["match:a-vs-b-2026-07-27"][0] == "match:a-vs-b-2026-07-27"
    got = {r.id: r for r in canonical.collect()}
    b = got["team:brazil"]
    assert (b.label, b.aliases, b.evidence, round(b.confidence, 2), b.resolution_method) == ("Brazil", ["BRAZIL", "Brazil", "Seleção", "bra"], ["1", "2", "3"], 0.53, "alias")
    assert got["match:a-vs-b-2026-06-27"].inference_method == "official_bracket" and got["team:ivory-coast"].aliases == ["Côte d'Ivoire"]
    assert {r.tier: r.n for r in resolution.tier_counts(xref).collect()}["exact_id"] == 2


def test_bracket(spark):
    day = lambda i: f"2026-07-{i:02d}T20:00:00"
    games = [(1, "semifinal", "Brazil", "France", day(1), "completed", None), (2, "semifinal", "Spain", "Côte d'Ivoire", day(2), "scheduled", None), (3, "third_place", "France", "Ivory Coast", day(5), "scheduled", None), (4, "final", "Brazil", "Spain", day(6), "scheduled", "Spain"), (5, "group_stage", "Brazil", "Spain", day(1), "completed", None)]
    schedule = spark.createDataFrame(games, "fifa_match_id long, stage_key string, home_team string, away_team string, kickoff_at_utc string, match_status string, winner_team string")
    won = {r.match_id: (r.winner, r.end_epoch and r.end_epoch - r.start_epoch) for r in bracket.winners(schedule, D).collect()}
    assert won == {"match:brazil-vs-france-2026-07-01": ("Brazil", 7200), "match:spain-vs-ivory-coast-2026-07-02": ("Spain", None), "match:france-vs-ivory-coast-2026-07-05": (None, None), "match:brazil-vs-spain-2026-07-06": ("Spain", 7200)}
    f = bracket.official_fragment(schedule, D, expected=5)
    edges = [(r.source, r.type, r.target) for r in f.edges.collect()]
    feeds = {(a, b) for a, t, b in edges if t == "ADVANCES_TO" and a.startswith("match:")}
    final, third = "match:brazil-vs-spain-2026-07-06", "match:france-vs-ivory-coast-2026-07-05"
    one, two = "match:brazil-vs-france-2026-07-01", "match:spain-vs-ivory-coast-2026-07-02"
    assert feeds == {(one, final), (two, final), (one, third), (two, third)}
    assert sum(t == "ADVANCES_TO" for _, t, _ in edges) == 7 + 4 and sum(t == "PARTICIPATES_IN" for _, t, _ in edges) == 10
    kinds = [r.type for r in f.nodes.collect()]
    assert {k: kinds.count(k) for k in kinds} == {"COMPETITION": 1, "STAGE": 8, "MATCH": 5, "TEAM": 4}
    try:
        bracket.official_fragment(schedule, D)
        raise AssertionError("a short schedule must fail")
    except ValueError as e:
        assert "104" in str(e)


def test_build(spark):
    n = spark.createDataFrame([("o1", "OUTCOME"), ("o2", "OUTCOME"), ("m1", "MATCH"), ("m2", "MATCH"), ("m3", "MATCH"), ("t", "TEAM")], "id string, type string")
    e = [("a1", "m2", "ADVANCES_TO", 0.9), ("m2", "m1", "ADVANCES_TO", 0.9), ("m2", "m3", "ADVANCES_TO", 0.9), ("o1", "o2", "IMPLIES", 1.0), ("t", "gone", "PARTICIPATES_IN", 1.0), ("m1", "t", "PARTICIPATES_IN", 1.0), ("t", "m1", "PARTICIPATES_IN", 0.1)]
    edges = spark.createDataFrame([(*x, ["9"], "text", i, "llm", "extraction") for i, x in enumerate(e)], "source string, target string, type string, confidence double, evidence array<string>, text string, seq long, inference_method string, derivation_type string")
    xref = spark.createDataFrame([("a1", "m1")], "local_id string, canonical_id string")
    allowed = dimensions.allowed_patterns(spark)
    built = graph.build(n, edges, xref, allowed, 0.2)
    reasons = {(r.source, r.target, r.type): r.reason for r in built.collect()}
    assert reasons == {("m1", "m2", "ADVANCES_TO"): "progression_cycle", ("m2", "m1", "ADVANCES_TO"): "progression_cycle", ("m2", "m3", "ADVANCES_TO"): None, ("o1", "o2", "IMPLIES"): None, ("t", "gone", "PARTICIPATES_IN"): "missing_endpoint", ("m1", "t", "PARTICIPATES_IN"): "invalid_pattern", ("t", "m1", "PARTICIPATES_IN"): "below_minimum_confidence"}
    fired = spark.createDataFrame([("o2", "o1", "IMPLIES", 1.0, ["1"], "rule")], "source string, target string, type string, confidence double, evidence array<string>, derivation_type string")
    after = {(r.source, r.target): r.reason for r in graph.add_rule_edges(built, fired, n, allowed).filter("type = 'IMPLIES'").collect()}
    assert after == {("o1", "o2"): None, ("o2", "o1"): "implies_cycle"}


def test_one_cycle_at_a_time(spark):
    e = spark.createDataFrame([("a", "b", 0), ("a", "b", 1), ("b", "a", 2), ("b", "c", 3)], "src string, dst string, seq long")
    got = graph.reject_cycles(e, "seq").collect()  # of parallel edges the first goes
    assert {(r.src, r.dst, r.seq) for r in got if r.reason is None} == {("a", "b", 1), ("b", "c", 3)}
    two = spark.createDataFrame([("a", "b", 0), ("b", "a", 1), ("b", "c", 2), ("c", "a", 3)], "src string, dst string, seq long")
    assert sum(r.reason is None for r in graph.reject_cycles(two, "seq").collect()) == 2


def test_implied_edges_carry_evidence(spark):
    e = spark.createDataFrame([("a", "b", ["1"], 0), ("b", "c", ["2"], 1), ("b", "c", ["3"], 2), ("x", "y", [], 3), ("y", "z", [], 4)], "src string, dst string, evidence array<string>, seq long")
    got = {(r.source, r.target): (r.premises, r.evidence) for r in graph.implied_edges(e).collect()}
    assert got == {("a", "c"): (["a", "b", "c"], ["1", "3"]), ("x", "z"): (["x", "y", "z"], ["closure:synthetic"])}
