"""Template compilers: markets of recognised events become fragments and propositions, without any model.

An event is recognised by its first market's title: a match, a group's winner, a stage of elimination, the tournament's winner and, for
propositions, reaching a stage. Each compiler is a projection: an event's header (title, slug, evidence) is aggregated once, and
``inline`` emits the rows of events and of markets. ``markets`` are as ``mart.semantic_markets`` gives them, with ``seq``, their order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.functions import scalars as s
from quartzline.functions.dimensions import ADVANCE_TYPE, STAGE_TITLES
from quartzline.plans.fragments import Fragment, at, edge, emit, node, some

C = F.col
TITLE_OF_WINNER = "world cup winner"


@dataclass(frozen=True)
class Domain:
    """What the compilers know besides the markets: the competition's name, names of teams and codes of teams."""

    competition: str = "World Cup 2026"
    aliases: dict[str, str] = field(default_factory=dict)
    codes: dict[str, str] = field(default_factory=dict)

    def team(self, name: Column) -> Column:
        return s.canonical_name(s.strip(name), self.aliases)

    def competition_id(self) -> Column:
        return F.lit("competition:" + s.slug_text(self.competition))

    def within(self, kind: str, label: Column) -> Column:
        return F.concat(F.lit(f"{kind}:{s.slug_text(self.competition)}:"), s.slug(label))

    def team_id(self, team: Column) -> Column:
        return F.concat(F.lit("team:"), s.slug(team))


def base_fragment(markets: DataFrame) -> Fragment:
    """EVENT, MARKET and OUTCOME nodes, HAS_MARKET and HAS_OUTCOME edges."""
    head = headers(markets)
    slugs = markets.filter(some(C("event_slug")).isNotNull()).groupBy("event_id").agg(F.collect_set("event_slug").alias("slugs"))
    events = head.join(slugs, "event_id", "left")
    label = F.coalesce(some(C("title")), some(C("slug")), C("event_id"))
    event = emit(events, [node(s.event_id(C("event_id")), "EVENT", label, C("all"), at("first", 0), F.coalesce("slugs", F.array().cast("array<string>")))], [])
    own, name = F.array("market_id"), F.coalesce(some(C("question")), some(C("market_slug")), C("market_id"))
    one = node(s.market_id(C("market_id")), "MARKET", name, own, at("seq", 1), F.array(F.coalesce("market_slug", F.lit(""))))
    has = edge(s.event_id(C("event_id")), s.market_id(C("market_id")), "HAS_MARKET", own, F.coalesce(some(C("question")), C("market_slug")), at("seq", 1))
    market = emit(markets, [one], [has])
    rows = markets.select("event_id", "market_id", "seq", F.posexplode("outcomes").alias("place", "outcome"))
    out = s.outcome_id(C("market_id"), C("outcome"))
    outcome = emit(rows, [node(out, "OUTCOME", C("outcome"), own, at("seq", 2) + C("place"))], [edge(s.market_id(C("market_id")), out, "HAS_OUTCOME", own, C("outcome"), at("seq", 2) + C("place"))])
    return event.union(market).union(outcome)


def headers(markets: DataFrame) -> DataFrame:
    """One row an event: title and slug of its first market, all market ids in order, the first place."""
    first = F.min_by(F.struct("event_title", "event_slug"), "seq")
    rows = markets.groupBy("event_id").agg(first.alias("h"), F.array_sort(F.collect_list(F.struct("seq", "market_id")))["market_id"].alias("all"), F.min("seq").alias("first"))
    return rows.select("event_id", C("h.event_title").alias("title"), C("h.event_slug").alias("slug"), "all", "first")


def recognised(head: DataFrame, d: Domain, stages: bool) -> DataFrame:
    """Headers with their template (null if there is none) and what its title says; ``stages``: also titles of reaching a stage."""
    reached = {k: v for k, v in STAGE_TITLES.items() if k != TITLE_OF_WINNER} if stages else {}
    title = F.lower(s.strip(C("title")))
    said = head.withColumns({"m": s.match_title(C("title")), "letter": s.group_of_title(C("title")), "out": s.elimination_team(C("title")), "reached": s.lookup(reached, title)})
    template = F.when(C("m.a").isNotNull(), "match").when(C("letter").isNotNull(), "group").when(C("out").isNotNull(), "elimination").when(title == TITLE_OF_WINNER, "winner").when(C("reached").isNotNull(), "reaches")
    team_a, team_b = d.team(C("m.a")), d.team(C("m.b"))
    teams = said.withColumns({"template": template, "raw_a": C("m.a"), "raw_b": C("m.b"), "team_a": team_a, "team_b": team_b, "out_team": d.team(C("out"))})
    local = s.match_local_id(C("team_a"), C("team_b"), s.slug_date(C("slug")))
    return teams.withColumns({"match_id": F.when(C("template") == "match", local), "match_label": F.concat("team_a", F.lit(" vs. "), "team_b"), "group": F.concat(F.lit("Group "), "letter")}).drop("m")


def groups_of_teams(markets: DataFrame, d: Domain) -> DataFrame:
    """(key, team_group, group_evidence): the group of each team's slug, the last named, and the markets that name one."""
    head = recognised(headers(markets), d, False).filter("template = 'group'").select("event_id", "first", "group")
    rows = markets.join(head, "event_id").filter(some(s.strip(C("group_item_title"))).isNotNull())
    key = s.slug(d.team(C("group_item_title")))
    return rows.groupBy(key.alias("key")).agg(F.max_by("group", F.struct("first", "seq")).alias("team_group"), F.collect_set("market_id").alias("group_evidence"))


def topology(markets: DataFrame, d: Domain | None = None) -> tuple[Fragment, DataFrame]:
    """The fragments of all recognised events, and (event_id, template, fully_covered) of all events.

    A recognised event without any team is not covered, and no other template is tried. Player markets are left out
    unless an event has no others.
    """
    d = d or Domain()
    player = F.coalesce(C("sports_market_type").startswith("soccer_player_"), F.lit(False))
    others = markets.groupBy("event_id").agg(F.bool_or(~player).alias("others"))
    used = markets.join(others, "event_id").filter(~player | ~C("others")).drop("others")
    head = recognised(headers(used), d, False)
    team_of_question = F.when(C("template") == "winner", s.winner_team(C("question")))
    rows = used.select("event_id", "market_id", "seq", "question", "group_item_title").join(head.select("event_id", "template", "letter", "group", "out", "out_team"), "event_id")
    subject = F.coalesce(some(s.strip(C("group_item_title"))), team_of_question)
    named = rows.filter(C("template").isin("group", "elimination", "winner")).withColumn("subject", subject).filter("subject is not null")
    named = named.withColumn("team", d.team(C("subject")))
    there = named.select("event_id").distinct().withColumn("named", F.lit(True))
    covered = head.join(there, "event_id", "left").withColumn("fully_covered", F.coalesce((C("template") == "match") | C("named"), F.lit(False)))
    head = covered.filter("fully_covered")
    parts = [_match_topology(head.filter("template = 'match'"), groups_of_teams(markets, d), d), _event_topology(head.filter("template <> 'match'"), d), _team_topology(named, d)]
    return parts[0].union(parts[1]).union(parts[2]), covered.select("event_id", "template", "fully_covered")


def _match_topology(head: DataFrame, groups: DataFrame, d: Domain) -> Fragment:
    """COMPETITION, two TEAMs and the MATCH; the GROUP too where both teams share one."""
    of = lambda x: groups.select(C("key").alias(f"key_{x}"), C("team_group").alias(f"group_{x}"), C("group_evidence").alias(f"evidence_{x}"))
    keyed = head.withColumns({"key_a": s.slug(C("team_a")), "key_b": s.slug(C("team_b"))})
    rows = keyed.join(of("a"), "key_a", "left").join(of("b"), "key_b", "left").withColumn("codes", s.slug_codes(C("slug")))
    both, e, place = s.slug_codes(C("slug"))["b"].isNotNull(), C("all"), lambda k: at("first", k)
    shared = F.coalesce(C("group_a") == C("group_b"), F.lit(False))
    said = F.array_sort(F.array_distinct(F.concat("evidence_a", "evidence_b", "all")))

    def team(x: str, k: int) -> Column:
        raw = F.array(F.when(C(f"raw_{x}") != C(f"team_{x}"), C(f"raw_{x}")).otherwise(""))
        codes = F.when(both, s.code_aliases(C(f"codes.{x}"), C(f"team_{x}"), d.codes, d.aliases)).otherwise(F.array().cast("array<string>"))
        return node(d.team_id(C(f"team_{x}")), "TEAM", C(f"team_{x}"), e, place(k), F.concat(raw, codes))

    group = d.within("group", C("group_a"))
    nodes = [_competition(d, e, place(0)), team("a", 1), team("b", 2), node(C("match_id"), "MATCH", C("match_label"), e, place(3), F.array(F.coalesce(s.match_alias(C("slug")), F.lit(""))))]
    plays = lambda x, k: edge(d.team_id(C(f"team_{x}")), C("match_id"), "PARTICIPATES_IN", e, C("match_label"), place(k))
    in_group = [
        edge(group, d.competition_id(), "PART_OF", said, C("group_a"), place(6)),
        edge(C("match_id"), group, "PART_OF", said, C("group_a"), place(7)),
        edge(d.team_id(C("team_a")), group, "PARTICIPATES_IN", said, C("group_a"), place(8)),
        edge(d.team_id(C("team_b")), group, "PARTICIPATES_IN", said, C("group_a"), place(9)),
    ]
    plain = emit(rows, nodes, [plays("a", 4), plays("b", 5)])
    return plain.union(emit(rows.filter(shared), [node(group, "GROUP", C("group_a"), said, place(4))], in_group))


def _competition(d: Domain, evidence: Column, seq: Column) -> Column:
    return node(d.competition_id(), "COMPETITION", F.lit(d.competition), evidence, seq, F.array(F.lit(s.slug_text(d.competition))))


def _event_topology(head: DataFrame, d: Domain) -> Fragment:
    """What the events of groups, eliminations and the winner say themselves."""
    e, place, none = C("all"), lambda k: at("first", k), F.array()
    group, champion = d.within("group", C("group")), d.within("stage", F.lit("Champion"))
    is_ = lambda t: C("template") == t
    alias = F.array(F.coalesce("slug", F.lit("")))
    own_team = node(d.team_id(C("out_team")), "TEAM", C("out_team"), e, place(1), F.array(F.when(C("out") != C("out_team"), C("out")).otherwise("")))
    more = F.when(is_("group"), F.array(node(group, "GROUP", C("group"), e, place(1), alias))).when(is_("winner"), F.array(node(champion, "STAGE", F.lit("Champion"), e, place(1)))).otherwise(F.array(own_team))
    edges = (
        F.when(is_("group"), F.array(edge(group, d.competition_id(), "PART_OF", e, F.coalesce(some(C("title")), C("group")), place(0))))
        .when(is_("winner"), F.array(edge(champion, d.competition_id(), "PART_OF", e, F.lit("Champion"), place(0))))
        .otherwise(none)
    )
    return emit(head, F.concat(F.array(_competition(d, e, place(0))), more), edges)


def _team_topology(named: DataFrame, d: Domain) -> Fragment:
    """What each market names: teams of a group or of the winner's event, stages of an elimination."""
    e, text = F.array("market_id"), F.coalesce(some(C("question")), F.when(C("template") == "elimination", C("subject")).otherwise(C("team")))
    to = F.when(C("template") == "group", d.within("group", C("group"))).otherwise(d.within("stage", F.lit("Champion")))
    raw = F.array(F.when(C("subject") != C("team"), C("subject")).otherwise(""))
    teams = named.filter("template <> 'elimination'")
    one = [node(d.team_id(C("team")), "TEAM", C("team"), e, at("seq", 10), raw)]
    groups = emit(teams.filter("template = 'group'"), one, [edge(d.team_id(C("team")), to, "PARTICIPATES_IN", e, text, at("seq", 10))])
    winners = emit(teams.filter("template = 'winner'"), one, [edge(d.team_id(C("team")), to, "QUALIFIES_FOR", e, text, at("seq", 10))])
    out, stage = named.filter("template = 'elimination'"), d.within("stage", C("subject"))
    first = out.groupBy("event_id", "subject").agg(F.min_by("market_id", "seq").alias("market_id"), F.min("seq").alias("seq"))
    stages = emit(first, [node(stage, "STAGE", C("subject"), e, at("seq", 10))], [edge(stage, d.competition_id(), "PART_OF", e, C("subject"), at("seq", 10))])
    goes = emit(out, [], [edge(d.team_id(C("out_team")), stage, "QUALIFIES_FOR", e, text, at("seq", 11))])
    return groups.union(winners).union(stages).union(goes)


def with_binary(markets: DataFrame) -> DataFrame:
    """Adds yes and no: the first outcome of either, if a market has both."""
    pick = lambda word: F.get(F.filter("outcomes", lambda o: F.lower(s.strip(o)) == word), F.lit(0))
    yes, no = pick("yes"), pick("no")
    both = yes.isNotNull() & no.isNotNull()
    return markets.withColumns({"yes": F.when(both, yes), "no": F.when(both, no)})


def complements(rows: DataFrame) -> tuple[Fragment, DataFrame]:
    """The two outcomes of binary markets: what prices them, what they refer to, that they complement each other; and their propositions.

    ``rows``: event_id, market_id, seq, yes, no, text, predicate, arguments, targets (array of struct type, id, label).
    """
    ids = rows.withColumns({"yes_id": s.outcome_id(C("market_id"), C("yes")), "no_id": s.outcome_id(C("market_id"), C("no"))})
    e, market = F.array("market_id"), s.market_id(C("market_id"))
    named = F.transform("targets", lambda t, i: node(t["id"], t["type"], t["label"], e, at("seq", 20) + i))
    prices = [edge(market, C(o), "PRICES", e, C("text"), at("seq", k)) for k, o in ((20, "yes_id"), (21, "no_id"))]

    def refers(o: str, k: int) -> Column:
        return F.transform("targets", lambda t, i: edge(C(o), t["id"], "REFERS_TO", e, C("text"), at("seq", k) + i))

    both = [edge(C(x), C(y), "COMPLEMENT", e, C("text"), at("seq", k)) for k, x, y in ((50, "yes_id", "no_id"), (51, "no_id", "yes_id"))]
    said = [F.struct(C(o).alias("outcome_id"), F.lit(p).alias("polarity")) for o, p in (("yes_id", True), ("no_id", False))]
    props = ids.select("event_id", "market_id", "seq", "predicate", "arguments", F.inline(F.array(*said)))
    return emit(ids, named, F.concat(F.array(*prices), refers("yes_id", 30), refers("no_id", 40), F.array(*both))), props


def constraints(members: DataFrame) -> Fragment:
    """EXACTLY_ONE partitions of at least two members (event_id, outcome_id, market_id, seq, constraint_id, label, text)."""
    rows = members.groupBy("event_id", "constraint_id").agg(F.first("label").alias("label"), F.first("text").alias("text"), F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "outcome_id"))).alias("m"), F.array_sort(F.collect_set("market_id")).alias("e"))
    rows = rows.filter(F.size("m") >= 2)
    edges = F.transform("m", lambda x, i: edge(C("constraint_id"), x["outcome_id"], "EXACTLY_ONE", C("e"), C("text"), at("seq", 60) + i))
    return emit(rows, [node(C("constraint_id"), "CONSTRAINT", C("label"), C("e"), at("seq", 60))], edges)


def single_subject(rows: DataFrame, predicate: str, arguments: dict[str, Column], targets: dict[str, tuple[Column, Column]], partition: tuple[Column, Column, Column] | None = None) -> tuple[Fragment, DataFrame]:
    """Binary markets that differ in one subject (columns yes, no, subject): propositions, and a partition (id, label, text) of the Yes outcomes if asked for."""
    said = rows.filter("yes is not null and subject is not null").withColumns(
        {
            "text": F.coalesce(some(C("question")), some(C("group_item_title")), C("yes")),
            "predicate": F.lit(predicate),
            "arguments": F.create_map(*[x for k, v in arguments.items() for x in (F.lit(k), v)]),
            "targets": F.array(*[F.struct(F.lit(k).alias("type"), i.alias("id"), n.alias("label")) for k, (i, n) in targets.items()]),
        }
    )
    f, props = complements(said)
    if partition is None:
        return f, props
    pid, label, text = partition
    members = said.select("event_id", "market_id", "seq", s.outcome_id(C("market_id"), C("yes")).alias("outcome_id"), pid.alias("constraint_id"), label.alias("label"), text.alias("text"))
    return f.union(constraints(members)), props


def propositions(markets: DataFrame, d: Domain | None = None) -> tuple[Fragment, DataFrame]:
    """The fragments of all propositions, and (event_id, market_id, seq, outcome_id, predicate, arguments, polarity), the last one of an outcome."""
    d = d or Domain()
    head = recognised(headers(markets), d, True).filter("template is not null")
    rows = with_binary(markets).join(head.drop("all", "first"), "event_id")
    comp, slug = d.competition_id(), s.slug_text(d.competition)
    competition = {"COMPETITION": (comp, F.lit(d.competition))}
    subject = F.coalesce(some(s.strip(C("group_item_title"))), F.when(C("template") == "winner", s.winner_team(C("question"))))
    rows = rows.withColumn("subject", subject)
    rows = rows.withColumn("team", F.when(C("template") == "elimination", C("out_team")).otherwise(d.team(C("subject"))))
    team_id = d.team_id(C("team"))
    team = {"TEAM": (team_id, C("team"))}
    of = lambda t: rows.filter(C("template") == t)
    group, stage, reached = d.within("group", C("group")), d.within("stage", C("subject")), d.within("stage", C("reached"))
    parts = [
        _match_propositions(of("match"), d),
        single_subject(of("group"), "wins_group", {"team": team_id, "group": group, "competition": comp}, team | {"GROUP": (group, C("group"))} | competition, (F.concat(F.lit(f"constraint:exact-group-winner:{slug}:"), s.slug(C("group"))), F.concat(F.lit("Exact winner: "), "group"), C("group"))),
        single_subject(of("elimination"), "eliminated_at_stage", {"team": team_id, "competition": comp, "stage": stage}, team | {"STAGE": (stage, C("subject"))} | competition, (F.concat(F.lit(f"constraint:exact-elimination:{slug}:"), s.slug(C("team"))), F.concat(F.lit("Exact elimination stage: "), "team"), F.concat("team", F.lit(" stage of elimination")))),
        single_subject(of("winner"), "wins_competition", {"team": team_id, "competition": comp}, team | competition, (F.lit(f"constraint:exact-champion:{slug}"), F.lit(f"Exact champion: {d.competition}"), F.lit(d.competition))),
        single_subject(of("reaches"), "reaches_stage", {"team": team_id, "competition": comp, "stage": reached}, team | {"STAGE": (reached, C("reached"))} | competition),
    ]
    f, props = parts[0]
    for more, said in parts[1:]:
        f, props = f.union(more), props.unionByName(said)
    last = props.groupBy("outcome_id").agg(F.max_by(F.struct("event_id", "market_id", "seq", "predicate", "arguments", "polarity"), "seq").alias("p"))
    return f, last.select("outcome_id", "p.*")


def _match_propositions(rows: DataFrame, d: Domain) -> tuple[Fragment, DataFrame]:
    """wins_match and draws_match of moneyline markets, advances_match of each outcome that is a team; both partitions where they are complete."""
    comp, slug = d.competition_id(), s.slug_text(d.competition)
    match = {"MATCH": (C("match_id"), C("match_label"))}
    competition = {"COMPETITION": (comp, F.lit(d.competition))}
    plays = lambda team: s.slug(team).isin(s.slug(C("team_a")), s.slug(C("team_b")))
    money = rows.filter("sports_market_type = 'moneyline' and yes is not null and subject is not null")
    draws = money.filter(s.is_draw(C("subject")))
    wins = money.filter(~s.is_draw(C("subject")) & plays(C("team")))
    team_id = d.team_id(C("team"))
    f1, p1 = single_subject(draws, "draws_match", {"match": C("match_id"), "competition": comp}, match | competition)
    f2, p2 = single_subject(wins, "wins_match", {"team": team_id, "match": C("match_id"), "competition": comp}, {"TEAM": (team_id, C("team"))} | match | competition)
    cid = lambda kind: F.concat(F.lit(f"constraint:{kind}:{slug}:"), s.slug(C("match_id")))
    member = lambda df, is_draw: df.select("event_id", "market_id", "seq", s.outcome_id(C("market_id"), C("yes")).alias("outcome_id"), cid("exact-match-result").alias("constraint_id"), F.concat(F.lit("Exact result: "), "match_label").alias("label"), C("match_label").alias("text"), F.lit(is_draw).alias("draw"))
    members = member(draws, True).unionByName(member(wins, False))
    whole = members.groupBy("event_id").agg(F.count_if("draw").alias("n"), F.count_if(~C("draw")).alias("w")).filter("n >= 1 and w >= 2")
    result = constraints(members.join(whole.select("event_id"), "event_id", "left_semi").drop("draw"))
    goes = rows.filter(C("sports_market_type") == ADVANCE_TYPE).select("*", F.posexplode("outcomes").alias("place", "outcome"))
    goes = goes.withColumn("team", d.team(C("outcome"))).filter(plays(C("team"))).withColumn("outcome_id", s.outcome_id(C("market_id"), C("outcome")))
    goes = goes.withColumn("text", F.coalesce(some(C("question")), C("outcome")))
    e, spot = F.array("market_id"), lambda k: at("seq", k) + C("place") * 10
    targets = {"TEAM": (team_id, C("team"))} | match | competition
    nodes = [node(i, k, n, e, spot(100 + j)) for j, (k, (i, n)) in enumerate(targets.items())]
    edges = [edge(s.market_id(C("market_id")), C("outcome_id"), "PRICES", e, C("text"), spot(100))]
    edges += [edge(C("outcome_id"), i, "REFERS_TO", e, C("text"), spot(101 + j)) for j, (i, _) in enumerate(targets.values())]
    f3 = emit(goes, nodes, edges)
    said = F.create_map(F.lit("team"), team_id, F.lit("match"), C("match_id"), F.lit("competition"), comp)
    p3 = goes.select("event_id", "market_id", (C("seq")).alias("seq"), F.lit("advances_match").alias("predicate"), said.alias("arguments"), "outcome_id", F.lit(True).alias("polarity"))
    advance = constraints(goes.select("event_id", "market_id", (C("seq") * 100 + C("place")).alias("seq"), "outcome_id", cid("exact-match-advance").alias("constraint_id"), F.concat(F.lit("Team to advance: "), "match_label").alias("label"), C("match_label").alias("text")))
    return f1.union(f2).union(f3).union(result).union(advance), p1.unionByName(p2).unionByName(p3)


def rule_inputs(props: DataFrame) -> DataFrame:
    """Propositions as ``rules.fire`` takes them: id, key, predicate, polarity, team, competition, stage, match, evidence."""
    none = lambda kind: F.lit(None).cast(kind)
    p = F.struct("predicate", "arguments", "polarity", none("string").alias("comparator"), none("double").alias("value"), none("string").alias("unit"), none("timestamp").alias("time_start"), none("timestamp").alias("time_end"))
    arg = lambda k: F.coalesce(F.try_element_at("arguments", F.lit(k)), F.lit("")).alias(k)
    return props.select(C("outcome_id").alias("id"), s.proposition_key(p).alias("key"), "predicate", "polarity", arg("team"), arg("competition"), arg("stage"), arg("match"), F.array("market_id").alias("evidence"))


def assembled(markets: DataFrame, topologies: Fragment, verified: Fragment | None = None) -> Fragment:
    """An event's base with its topology; events that were verified have theirs alone in place of the templates'."""
    if verified is not None:
        mine = verified.nodes.select("event_id").distinct()
        keep = lambda df: df.join(mine, "event_id", "left_anti")
        topologies = Fragment(keep(topologies.nodes), keep(topologies.edges)).union(verified)
    return base_fragment(markets).union(topologies)
