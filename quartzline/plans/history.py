"""Hourly probability histories of matches and of stages, from one scan of the mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzline.functions import scalars
from quartzline.functions.dimensions import ADVANCE_TYPE, STAGE_TITLES
from quartzline.operators import relops


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """The alias table's name for a stripped name, or the name."""
    plain = scalars.strip(name)
    if not aliases:
        return plain
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(table[plain], plain)


def match_history(rows: DataFrame, fixtures: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """One row for each market and hour: both teams' probabilities, start, end and winner.

    ``rows``: as the mart's history rows. ``fixtures``: match_id, home_team, away_team, kickoff_epoch. Teams meet in
    either order, and of fixtures of one pair the last listed counts (``seq``, if they have it); of an hour's rows the last wins; the result is known once it is finished, resolved or has a winner.
    """
    teams = F.transform(scalars.event_teams(F.col("event_title")), lambda t: canonical(t, aliases))
    sides = F.array(canonical(F.col("home_team"), aliases), canonical(F.col("away_team"), aliases))
    listed = fixtures if "seq" in fixtures.columns else fixtures.withColumn("seq", F.monotonically_increasing_id())
    fix = listed.withColumn("pair", F.array_sort(sides)).groupBy("pair").agg(F.max_by(F.struct("match_id", sides[0].alias("home"), sides[1].alias("away"), "kickoff_epoch"), "seq").alias("f")).select("pair", "f.*")
    adv = rows.filter(F.col("sports_market_type") == ADVANCE_TYPE).withColumn("pair", F.array_sort(teams)).filter("pair is not null")
    joined = relops.pair_join(adv, fix)
    hourly = relops.last_wins(joined, ["market_id", "odds_hour_epoch"], ["seq"], ["pair", "match_id", "home", "away", "kickoff_epoch", "close_odds", "primary_outcome_label"])
    last = lambda c: relops.last_non_null(c, "odds_hour_epoch", "seq")
    meta = joined.groupBy("market_id").agg(
        last(F.nullif("game_start_time", F.lit(""))).alias("started"), last(F.nullif("event_finished_at", F.lit(""))).alias("finished"),
        last(F.nullif("winning_outcome", F.lit(""))).alias("winning"), F.bool_or(F.coalesce("is_resolved", F.lit(False))).alias("resolved"),
    )
    label = canonical(F.col("primary_outcome_label"), aliases)
    p = F.col("close_odds")
    home_p = F.when(label == F.col("home"), p).when(label == F.col("away"), 1 - p)
    priced = hourly.withColumns({"home_prob": home_p, "away_prob": 1 - home_p}).filter("home_prob is not null")
    w = Window.partitionBy("market_id").orderBy("odds_hour_epoch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = priced.withColumns({"first_hour": F.first("odds_hour_epoch").over(w), "last_hour": F.last("odds_hour_epoch").over(w), "last_home": F.last("home_prob").over(w), "last_away": F.last("away_prob").over(w)}).join(meta, "market_id")
    named = canonical(F.col("winning"), aliases)
    explicit = F.when(named.isin(F.col("home"), F.col("away")), named)
    known = F.col("finished").isNotNull() | F.col("resolved") | explicit.isNotNull()
    leader = F.when(F.col("last_home") > F.col("last_away"), F.col("home")).when(F.col("last_away") > F.col("last_home"), F.col("away"))
    zero = lambda c: F.nullif(c, F.lit(0).cast("long"))
    start = F.coalesce(zero(scalars.to_epoch(F.col("started"))), zero(F.col("kickoff_epoch")), F.col("first_hour"))
    return ends.select(
        "market_id", "match_id", F.col("home").alias("home_team"), F.col("away").alias("away_team"), "odds_hour_epoch", "home_prob", "away_prob", start.alias("start_epoch"),
        F.when(known, F.coalesce(zero(scalars.to_epoch(F.col("finished"))), "last_hour")).alias("end_epoch"), F.when(known, F.coalesce(explicit, leader)).alias("winner"),
    )


def unmatched_fixtures(fixtures: DataFrame, history: DataFrame) -> DataFrame:
    return fixtures.join(history.select("match_id").distinct(), "match_id", "left_anti")


def stage_history(rows: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """team, stage_label, odds_hour_epoch, reach_prob, market_id: the last row of an hour wins; a No market counts as the rest to one."""
    titles = F.create_map(*[F.lit(x) for kv in STAGE_TITLES.items() for x in kv])
    label = F.nullif(scalars.strip(F.col("primary_outcome_label")), F.lit(""))
    yes_no = F.lower(label).isin("yes", "no")
    team = canonical(F.coalesce(F.nullif(scalars.strip(F.col("group_item_title")), F.lit("")), F.when(~yes_no, label)), aliases)
    prob = F.when(F.lower(label) == "no", 1 - F.col("close_odds")).otherwise(F.col("close_odds"))
    staged = rows.withColumns({"stage_label": titles[F.lower(scalars.strip(F.col("event_title")))], "team": team, "reach_prob": prob}).filter("stage_label is not null and team is not null")
    return relops.last_wins(staged, ["team", "stage_label", "odds_hour_epoch"], ["seq"], ["reach_prob", "market_id"]).orderBy("team", "stage_label", "odds_hour_epoch")
