"""Template compilers on small markets with known fragments."""

from quartzline.functions import scalars as s
from quartzline.operators import rules
from quartzline.plans import compilers, fragments

COLUMNS = ["market_id", "event_id", "event_title", "event_slug", "question", "group_item_title", "sports_market_type", "outcomes"]
DDL = "market_id string, event_id string, event_title string, event_slug string, question string, group_item_title string, sports_market_type string, outcomes array<string>, market_slug string, seq long"
YN = ["Yes", "No"]
D = compilers.Domain(aliases={"Côte d'Ivoire": "Ivory Coast"}, codes={"kor": "Curaçao", "bra": "Brazil"})


def markets(spark, *rows):
    return spark.createDataFrame([(*r, None, i) for i, r in enumerate(rows)], DDL)


def match_rows(event="100", draw=True):
    rows = [("10", event, "Brazil vs. Morocco", "fifwc-bra-mar-2026-06-13", "Will Brazil win?", "Brazil", "moneyline", YN), ("11", event, "Brazil vs. Morocco", "fifwc-bra-mar-2026-06-13", "Will Morocco win?", "Morocco", "moneyline", YN)]
    return rows + ([("12", event, "Brazil vs. Morocco", "fifwc-bra-mar-2026-06-13", None, "Draw (Brazil vs. Morocco)", "moneyline", YN)] if draw else [])


def test_match_topology_and_shared_group(spark):
    rows = [("1", "9", "World Cup Group C Winner", "c", None, "Brazil", None, YN), ("2", "9", "World Cup Group C Winner", "c", None, "Morocco", None, YN), *match_rows(), ("13", "100", "Brazil vs. Morocco", "x", None, "P", "soccer_player_goals", YN)]
    f, covered = compilers.topology(markets(spark, *rows), D)
    assert {(r.event_id, r.template, r.fully_covered) for r in covered.collect()} == {("9", "group", True), ("100", "match", True)}
    m = fragments.merged(f)
    nodes = {(r.event_id, r.local_id): r for r in m.nodes.collect()}
    assert {k for e, k in nodes if e == "100"} == {"competition:world-cup-2026", "team:brazil", "team:morocco", "match:brazil-vs-morocco-2026-06-13", "group:world-cup-2026:group-c"}
    assert nodes["100", "match:brazil-vs-morocco-2026-06-13"].aliases == ["fifwc-bra-mar-2026-06-13"]
    assert nodes["100", "team:brazil"].aliases == ["Brazil", "bra", "brazil"] and nodes["100", "team:morocco"].aliases == ["mar"]
    assert nodes["100", "team:brazil"].evidence == ["10", "11", "12"]
    assert nodes["100", "group:world-cup-2026:group-c"].evidence == ["1", "10", "11", "12", "2"]
    edges = {(r.source, r.type, r.target) for r in m.edges.collect() if r.event_id == "100"}
    g, x = "group:world-cup-2026:group-c", "match:brazil-vs-morocco-2026-06-13"
    assert edges == {(g, "PART_OF", "competition:world-cup-2026"), (x, "PART_OF", g), ("team:brazil", "PARTICIPATES_IN", g), ("team:morocco", "PARTICIPATES_IN", g), ("team:brazil", "PARTICIPATES_IN", x), ("team:morocco", "PARTICIPATES_IN", x)}


def test_other_templates(spark):
    rows = [
        ("1", "a", "World Cup: Portugal Stage of Elimination", None, "q", "Final", None, YN),
        ("2", "a", "World Cup: Portugal Stage of Elimination", None, None, "Champion", None, YN),
        ("3", "b", "World Cup Winner", None, "Will Austria win the 2026 FIFA World Cup?", None, None, YN),
        ("4", "c", "World Cup Group A Winner", None, None, None, None, YN),
        ("5", "d", "World Cup: Golden Ball Winner", None, None, "Harry Kane", None, YN),
    ]
    f, covered = compilers.topology(markets(spark, *rows), D)
    assert {(r.event_id, r.template, r.fully_covered) for r in covered.collect()} == {("a", "elimination", True), ("b", "winner", True), ("c", "group", False), ("d", None, False)}
    assert {(r.event_id, r.type, r.label) for r in f.nodes.collect()} == {("a", "COMPETITION", "World Cup 2026"), ("a", "TEAM", "Portugal"), ("a", "STAGE", "Final"), ("a", "STAGE", "Champion"), ("b", "COMPETITION", "World Cup 2026"), ("b", "STAGE", "Champion"), ("b", "TEAM", "Austria")}
    got = {(r.event_id, r.source, r.type, r.target, r.text) for r in f.edges.collect()}
    assert ("a", "team:portugal", "QUALIFIES_FOR", "stage:world-cup-2026:final", "q") in got and ("a", "team:portugal", "QUALIFIES_FOR", "stage:world-cup-2026:champion", "Champion") in got
    assert ("b", "team:austria", "QUALIFIES_FOR", "stage:world-cup-2026:champion", "Will Austria win the 2026 FIFA World Cup?") in got and len(got) == 6


def test_base_and_replacement(spark):
    m = markets(spark, *match_rows(draw=False))
    f = fragments.merged(compilers.base_fragment(m))
    assert {(r.type, r.label) for r in f.nodes.collect()} == {("EVENT", "Brazil vs. Morocco"), ("MARKET", "Will Brazil win?"), ("MARKET", "Will Morocco win?"), ("OUTCOME", "Yes"), ("OUTCOME", "No")}
    assert {(r.source, r.type, r.target) for r in f.edges.collect()} >= {("event:100", "HAS_MARKET", "market:10"), ("market:10", "HAS_OUTCOME", "outcome:10:yes")}
    t, _ = compilers.topology(m, D)
    other = fragments.Fragment(t.nodes.filter("type = 'TEAM'"), t.edges.limit(0))
    whole = compilers.assembled(m, t, other)
    assert {r.type for r in whole.nodes.collect()} == {"EVENT", "MARKET", "OUTCOME", "TEAM"}
    assert [r.same for r in fragments.same_fragments(t, t).collect()] == [True] and [r.same for r in fragments.same_fragments(t, other).collect()] == [False]


def test_match_propositions(spark):
    advance = ("14", "100", "Brazil vs. Morocco", "s", None, None, "soccer_team_to_advance", ["Brazil", "Morocco", "Neither"])
    f, props = compilers.propositions(markets(spark, *match_rows(), advance), D)
    got = {(r.outcome_id, r.predicate, r.polarity) for r in props.collect()}
    assert got == {(f"outcome:{m}:{o}", p, o == "yes") for m, p in (("10", "wins_match"), ("11", "wins_match"), ("12", "draws_match")) for o in ("yes", "no")} | {("outcome:14:brazil", "advances_match", True), ("outcome:14:morocco", "advances_match", True)}
    edges = f.edges.collect()
    ones = {(r.source, r.target) for r in edges if r.type == "EXACTLY_ONE"}
    result, adv = "constraint:exact-match-result:world-cup-2026:match-brazil-vs-morocco-2026-06-13", "constraint:exact-match-advance:world-cup-2026:match-brazil-vs-morocco-2026-06-13"
    assert ones == {(result, f"outcome:{m}:yes") for m in ("10", "11", "12")} | {(adv, "outcome:14:brazil"), (adv, "outcome:14:morocco")}
    assert {(r.source, r.target) for r in edges if r.type == "COMPLEMENT"} == {(f"outcome:{m}:{a}", f"outcome:{m}:{b}") for m in ("10", "11", "12") for a, b in (("yes", "no"), ("no", "yes"))}
    assert sum(r.type == "PRICES" for r in edges) == 8 and sum(r.type == "REFERS_TO" for r in edges) == 2 * (3 + 3 + 2) + 2 * 3
    assert not [r for r in compilers.propositions(markets(spark, *match_rows(draw=False)), D)[0].edges.collect() if r.type == "EXACTLY_ONE"]


def test_single_subject_propositions_feed_the_rules(spark):
    rows = [
        ("1", "a", "World Cup Winner", None, None, "Brazil", None, YN),
        ("2", "b", "World Cup: Nation to Reach Final", None, None, "Brazil", None, YN),
        ("3", "c", "World Cup: Brazil Stage of Elimination", None, None, "Champion", None, YN),
        ("4", "c", "World Cup: Brazil Stage of Elimination", None, None, "Final", None, YN),
        ("5", "d", "World Cup Group C Winner", None, None, "Brazil", None, YN),
        ("6", "d", "World Cup Group C Winner", None, None, "Morocco", None, ["Over", "Under"]),
    ]
    f, props = compilers.propositions(markets(spark, *rows), D)
    assert {r.label for r in f.nodes.collect() if r.type == "CONSTRAINT"} == {"Exact elimination stage: Brazil"}
    fired = {(r.source, r.target, r.type) for r in rules.fire(compilers.rule_inputs(props)).collect()}
    assert fired == {("outcome:1:yes", "outcome:2:yes", "IMPLIES"), ("outcome:1:yes", "outcome:3:yes", "EQUIVALENT"), ("outcome:3:yes", "outcome:1:yes", "EQUIVALENT"), ("outcome:4:yes", "outcome:2:yes", "IMPLIES")}
    key = {r.id: r.key for r in compilers.rule_inputs(props).collect()}
    assert key["outcome:5:no"] == "!wins_group(competition=competition:world-cup-2026,group=group:world-cup-2026:group-c,team=team:brazil)"


def test_titles_and_ids(spark):
    df = spark.createDataFrame([("A vs. B - More",), ("A vs B",), (" World Cup Group d Winner",), ("The World Cup Group D Winner",), ("World Cup:  Iran Stage of Elimination",), ("Cup: Iran Stage of Elimination",)], "t string")
    got = [tuple(r) for r in df.select(s.match_title(df.t)["a"], s.match_title(df.t)["category"], s.group_of_title(df.t), s.elimination_team(df.t)).collect()]
    assert got == [("A", "More", None, None), (None, None, None, None), (None, None, "D", None), (None, None, None, None), (None, None, None, "Iran"), (None, None, None, None)]
    x = spark.createDataFrame([("match:a-vs-b", "match:a-vs-b-2026-06-13"), ("match:a-vs-b-2026-06-13", "match:a-vs-b-2026-06-14"), ("match:a-vs-b-2026-06-13", "match:a-vs-b-2026-07-13"), ("match:a-vs-b-2026-06-31", "match:a-vs-b-2026-06-30")], "a string, b string")
    some, official = (x.sparkSession.range(1) and v for v in (s.F.lit("x"), s.F.lit("official_bracket")))
    got = [tuple(r) for r in x.select(s.may_bind(x.a, x.b), s.upgrade_target(x.a, some, x.b, some), s.upgrade_target(x.a, official, x.b, some), s.upgrade_target(x.b, some, x.a, official)).collect()]
    assert got[0] == (True, x.first().b, x.first().b, None)
    assert got[1] == (True, "match:a-vs-b-2026-06-14", None, "match:a-vs-b-2026-06-13")
    assert got[2][0] is False and got[3][0] is False
    j = spark.createDataFrame([('["a", null]',), ('["a"] x ["b"]',), ('["a"]} ["b"]',), ("[]",)], "x string")
    assert [r[0] for r in j.select(s.json_list(j.x)).collect()] == [["a", "None"], None, None, []]
    y = spark.createDataFrame([("a.b-c",), ("a\n",), ("a__b",), ("..",)], "x string")
    assert [r[0] for r in y.select(s.path_safe(y.x)).collect()] == [True, False, False, False]
