"""The official bracket: stages, their ladder, fixtures as matches and how they feed one another; winners of knockout fixtures.

``schedule``: fifa_match_id, stage_key, home_team, away_team, kickoff_at_utc (ISO text), match_status, winner_team.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzline.functions import scalars as s
from quartzline.functions.dimensions import KNOCKOUT_RANK, LADDER, STAGE_OF_KEY, STAGE_RANK
from quartzline.operators import relops
from quartzline.plans.compilers import Domain
from quartzline.plans.fragments import Fragment, edge, emit, node

C = F.col
FIXTURES, DURATION = 104, 7200


def fixtures(schedule: DataFrame, d: Domain) -> DataFrame:
    """The schedule with canonical teams, match ids, stage labels and knockout ranks; a stage that isn't known is an error."""
    table = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])[C("stage_key")]
    stage = F.coalesce(table(STAGE_OF_KEY), F.raise_error(F.concat(F.lit("unknown stage: "), F.coalesce("stage_key", F.lit("null")))).cast("string"))
    named = schedule.withColumns({"home": d.team(C("home_team")), "away": d.team(C("away_team")), "stage": stage, "rank": table(KNOCKOUT_RANK)})
    return named.withColumn("match_id", s.match_local_id(C("home"), C("away"), s.kickoff_date(C("kickoff_at_utc")))).withColumn("start", s.to_epoch(C("kickoff_at_utc")))


def winners(schedule: DataFrame, d: Domain | None = None) -> DataFrame:
    """(match_id, home, away, stage_key, start_epoch, end_epoch, winner) of knockout fixtures.

    A participant that is named the winner is; otherwise the team that appears in the next rank, other than for the third place. The end is two
    hours after kickoff, once the match is completed or its winner is named.
    """
    rows = fixtures(schedule, d or Domain()).filter("rank is not null and home <> '' and away <> ''")
    named = s.canonical_name(F.nullif("winner_team", F.lit("")), (d or Domain()).aliases)
    rows = rows.withColumn("named", F.when(named.isin(C("home"), C("away")), named))
    teams = rows.select("match_id", "rank", "stage_key", F.explode(F.array("home", "away")).alias("team"))
    w = Window.partitionBy(s.slug(C("team"))).orderBy("rank")
    ahead = teams.withColumns({"next_rank": F.lead("rank").over(w), "next_stage": F.lead("stage_key").over(w)})
    fed = ahead.filter("next_rank = rank + 1 and next_stage <> 'third_place'").groupBy("match_id").agg(F.min("team").alias("derived"))
    done = F.lower("match_status") == "completed"
    out = rows.join(fed, "match_id", "left").withColumn("winner", F.coalesce("named", "derived"))
    end = F.when(C("winner").isNotNull() & (F.coalesce(done, F.lit(False)) | C("named").isNotNull()), C("start") + DURATION)
    return out.select("match_id", C("home").alias("home_team"), C("away").alias("away_team"), "stage_key", C("start").alias("start_epoch"), end.alias("end_epoch"), "winner")


def official_fragment(schedule: DataFrame, d: Domain | None = None, expected: int = FIXTURES) -> Fragment:
    """The bracket as one fragment (event_id ``official``); a schedule of another length is an error."""
    d = d or Domain()
    n = schedule.count()
    if n != expected:
        raise ValueError(f"the schedule must have {expected} fixtures, not {n}")
    spark, e = schedule.sparkSession, F.array(F.lit("official:wc2026-schedule"))
    stage = lambda c: d.within("stage", C(c))
    one = spark.createDataFrame([("official",)], "event_id string")
    head = emit(one, [node(d.competition_id(), "COMPETITION", F.lit(d.competition), e, F.lit(0), F.array(F.lit(s.slug_text(d.competition))))], [])
    stages = spark.createDataFrame([("official", x, i) for i, x in enumerate(STAGE_RANK, 1)], "event_id string, label string, i int")
    head = head.union(emit(stages, [node(stage("label"), "STAGE", C("label"), e, C("i"))], [edge(stage("label"), d.competition_id(), "PART_OF", e, C("label"), C("i"))]))
    steps = spark.createDataFrame([("official", *x, i) for i, x in enumerate(LADDER, 20)], "event_id string, a string, b string, i int")
    head = head.union(emit(steps, [], [edge(stage("a"), stage("b"), "ADVANCES_TO", e, F.concat("a", F.lit(" -> "), "b"), C("i"))]))
    rows = fixtures(schedule, d).withColumn("event_id", F.lit("official"))
    said, at = F.array(F.concat(F.lit("official:fifa-"), C("fifa_match_id").cast("string"))), lambda k: C("fifa_match_id") * 100 + k
    label = F.concat("home", F.lit(" vs. "), "away")
    dated = F.substring("match_id", len("match:") + 1, 10_000)
    aliases = F.array(F.concat(F.lit("fifa-match-"), C("fifa_match_id").cast("string")), F.when(s.kickoff_date(C("kickoff_at_utc")).isNotNull(), dated).otherwise(""))
    plays = [edge(d.team_id(C(t)), C("match_id"), "PARTICIPATES_IN", said, label, at(3 + k)) for k, t in enumerate(("home", "away"))]
    games = emit(rows, [node(C("match_id"), "MATCH", label, said, at(0), aliases)], [edge(C("match_id"), stage("stage"), "PART_OF", said, C("stage"), at(0)), *plays])
    sides = F.explode(F.array(*[F.struct(C(t).alias("team"), C(f"{t}_team").alias("raw"), F.lit(k).alias("k")) for k, t in enumerate(("home", "away"))])).alias("x")
    first = rows.select("event_id", "fifa_match_id", sides).groupBy("event_id", C("x.team").alias("team")).agg(F.min_by(F.struct("fifa_match_id", "x.raw"), F.struct("fifa_match_id", "x.k")).alias("f"))
    first = first.select("event_id", "team", "f.*")
    teams = emit(first, [node(d.team_id(C("team")), "TEAM", C("team"), said, at(1), F.array(F.when(C("raw") != C("team"), C("raw")).otherwise("")))], [])
    return head.union(games).union(teams).union(_feeds(rows))


def _feeds(rows: DataFrame) -> Fragment:
    """ADVANCES_TO between a team's matches of consecutive ranks."""
    teams = rows.filter("rank is not null").select(F.explode(F.array("home", "away")).alias("team"), "rank", F.struct("fifa_match_id", "match_id").alias("m")).withColumn("team", s.slug(C("team")))
    links = relops.rank_links(teams, "team", "rank", "m").select(F.lit("official").alias("event_id"), "prev", "next")
    fifa = lambda c: F.concat(F.lit("official:fifa-"), C(f"{c}.fifa_match_id").cast("string"))
    said: Column = F.array(fifa("prev"), fifa("next"))
    return emit(links, [], [edge(C("prev.match_id"), C("next.match_id"), "ADVANCES_TO", said, F.lit("team continuity across consecutive knockout stages"), C("prev.fifa_match_id") * 100 + 9)])
