"""Domain plans and graph operators on small tables with known results."""

from quartzline.functions import dimensions, scalars
from quartzline.operators import graph, relops, rules
from quartzline.plans import history
from quartzline.sources import mart

BASE = {"market_id": "m", "event_title": "Paraguay vs. France - More Markets", "group_item_title": None, "primary_outcome_label": "Paraguay", "close_odds": 0.2, "odds_hour_epoch": 1783200000, "game_start_time": "2026-07-04T21:00:00", "event_finished_at": None, "is_resolved": None, "winning_outcome": None, "sports_market_type": "soccer_team_to_advance"}
DDL = ", ".join(f"{c} {t}" for c, t in mart.HISTORY.items())
ALIAS = {"Côte d'Ivoire": "Ivory Coast"}


def rows(spark, *changes):
    return mart.history_rows(spark.createDataFrame([tuple((BASE | c)[k] for k in mart.HISTORY) for c in changes], DDL).coalesce(1))


def fixtures(spark):
    return spark.createDataFrame([("1", "France", "Paraguay", 5), ("2", "Ivory Coast", "Norway", 0)], "match_id string, home_team string, away_team string, kickoff_epoch long")


def test_match_history(spark):
    got = history.match_history(rows(spark, {}, {"close_odds": 0.3}, {"market_id": "x", "sports_market_type": "moneyline"}), fixtures(spark), ALIAS).collect()
    assert [(r.home_team, round(r.home_prob, 6), r.end_epoch, r.winner, r.start_epoch) for r in got] == [("France", 0.7, None, None, 1783198800)]
    ivory = {"event_title": "Côte d'Ivoire vs. Norway", "primary_outcome_label": "Côte d'Ivoire", "game_start_time": None, "event_finished_at": "2026-07-01T01:05:00Z"}
    got = history.match_history(rows(spark, ivory | {"close_odds": 0.35, "odds_hour_epoch": 100}, ivory | {"close_odds": 0.12, "odds_hour_epoch": 3700}), fixtures(spark), ALIAS).orderBy("odds_hour_epoch").collect()
    assert [(r.home_team, r.home_prob, r.winner, r.start_epoch) for r in got] == [("Ivory Coast", 0.35, "Norway", 100), ("Ivory Coast", 0.12, "Norway", 100)]
    assert got[0].end_epoch == 1782867900
    won = history.match_history(rows(spark, {"close_odds": 0.9, "winning_outcome": "France"}), fixtures(spark), ALIAS)
    assert won.first().winner == "France"
    assert [r.match_id for r in history.unmatched_fixtures(fixtures(spark), won).collect()] == ["2"]


def test_stage_history(spark):
    s = {"sports_market_type": None, "event_title": "World Cup: Nation to Reach Round of 16", "group_item_title": "Brazil", "primary_outcome_label": "Yes"}
    got = history.stage_history(rows(spark, s | {"close_odds": 0.4}, s | {"close_odds": 0.55}, s | {"group_item_title": "Côte d'Ivoire", "primary_outcome_label": "No"}, s | {"event_title": "world cup winner ", "group_item_title": None, "primary_outcome_label": "Argentina", "close_odds": 0.18}), ALIAS).collect()
    assert [(r.team, r.stage_label, round(r.reach_prob, 6)) for r in got] == [("Argentina", "Champion", 0.18), ("Brazil", "Round of 16", 0.55), ("Ivory Coast", "Round of 16", 0.8)]
    assert mart.history_rows(spark.createDataFrame([("a",)], "market_id string")).count() == 0


def test_rules(spark):
    p = lambda i, pred, stage="", match="", team="t:bra": (i, "k" + i, pred, True, team, "c", stage, match, [i])
    props = [p("w", "wins_competition"), p("f", "reaches_stage", "stage:c:final"), p("s", "reaches_stage", "stage:c:semifinals"), p("g", "reaches_stage", "stage:c:golden-round"), p("e", "eliminated_at_stage", "stage:c:champion"), p("a", "wins_match", match="m1"), p("b", "wins_match", match="m1", team="t:mar")]
    df = spark.createDataFrame(props, "id string, key string, predicate string, polarity boolean, team string, competition string, stage string, match string, evidence array<string>")
    got = {(r.source, r.target, r.type) for r in rules.fire(df).collect()}
    assert got == {("f", "s", "IMPLIES"), ("w", "f", "IMPLIES"), ("w", "e", "EQUIVALENT"), ("e", "w", "EQUIVALENT"), ("a", "b", "MUTEX"), ("b", "a", "MUTEX")}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert {(r.src, r.dst, tuple(r.path)) for r in graph.closure(e).collect()} == {("a", "c", tuple("abc")), ("a", "d", tuple("abcd")), ("b", "d", tuple("bcd"))}
    assert not graph.has_cycle(e)
    c = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("b", "c"), ("d", "e"), ("e", "d")], "src string, dst string")
    assert {(r.src, r.dst) for r in graph.reject_cycles(c).filter("reason is null").collect()} == {("c", "d"), ("b", "c")}
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    bad = spark.createDataFrame([("a", "b", 0.5, ["x"]), ("a", "z", 2.0, [])], "src string, dst string, confidence double, evidence array<string>")
    assert {(r.error, r.subject) for r in graph.validate(nodes, bad).collect()} == {("duplicate_node", "a"), ("missing_dst", "z"), ("missing_evidence", "a"), ("invalid_confidence", "a")}


def test_merge_text_is_an_ordered_fold(spark):
    for order in ([(0.5, "low"), (0.9, "high")], [(0.9, "high"), (0.5, "low")]):
        df = spark.createDataFrame([("s", "t", "X", c, [str(i)], t, i) for i, (c, t) in enumerate(order)], "source string, target string, type string, confidence double, evidence array<string>, text string, seq int")
        r = relops.merge_edges(df).first()
        assert (r.confidence, r.text, r.evidence) == (0.9, "high", ["0", "1"])


def test_scalars_and_ontology(spark):
    assert dimensions.allowed_patterns(spark).count() == 38
    assert [scalars.slug_text(x) for x in ("Curaçao", " São  Tomé! ", "", None)] == ["curacao", "sao-tome", "", None]
    assert abs(scalars.token_sort("Exact winner: Group A", "Exact winner: Group B") - 95.238) < 0.01
    df = spark.createDataFrame([('["a", "b"]',), ('["a"] x',), ("",), ("{}",), (None,)], "x string")
    assert [r[0] for r in df.select(scalars.json_list(df.x)).collect()] == [["a", "b"], None, None, None, None]
