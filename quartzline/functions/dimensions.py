"""Fixed values of the domain: node and edge types with their allowed patterns, stages, event titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Edge types and the types of node that each may join.
ALLOWED = {
    "PART_OF": [("STAGE", "COMPETITION"), ("GROUP", "COMPETITION"), ("ROUND", "COMPETITION"), ("MATCH", "STAGE"), ("MATCH", "GROUP"), ("MATCH", "ROUND"), ("GROUP", "STAGE"), ("ROUND", "STAGE")],
    "HAS_MARKET": [("EVENT", "MARKET")],
    "HAS_OUTCOME": [("MARKET", "OUTCOME")],
    "PARTICIPATES_IN": [("TEAM", "COMPETITION"), ("TEAM", "GROUP"), ("TEAM", "MATCH"), ("TEAM", "STAGE"), ("TEAM", "ROUND")],
    "PRICES": [("MARKET", "TEAM"), ("MARKET", "MATCH"), ("MARKET", "OUTCOME")],
    "QUALIFIES_FOR": [("TEAM", "STAGE"), ("TEAM", "ROUND"), ("TEAM", "GROUP"), ("MATCH", "ROUND")],
    "ADVANCES_TO": [("MATCH", "MATCH"), ("TEAM", "ROUND"), ("TEAM", "STAGE"), ("STAGE", "STAGE")],
    "IMPLIES": [("MARKET", "MARKET"), ("OUTCOME", "OUTCOME"), ("MARKET", "OUTCOME")],
    "REFERS_TO": [("OUTCOME", "TEAM"), ("OUTCOME", "MATCH"), ("OUTCOME", "STAGE"), ("OUTCOME", "COMPETITION"), ("OUTCOME", "GROUP")],
    "EQUIVALENT": [("OUTCOME", "OUTCOME")],
    "COMPLEMENT": [("OUTCOME", "OUTCOME")],
    "MUTEX": [("OUTCOME", "OUTCOME")],
    "EXACTLY_ONE": [("CONSTRAINT", "OUTCOME")],
}
# Stages with their order; the third place ranks with the final.
STAGE_RANK = {"Group Stage": 0, "Round of 32": 1, "Round of 16": 2, "Quarterfinals": 3, "Semifinals": 4, "Third Place": 5, "Final": 5, "Champion": 6}
# Titles of events that price a stage, in lower case.
STAGE_TITLES = {
    "world cup: nation to reach final": "Final",
    "world cup: nation to reach quarterfinals": "Quarterfinals",
    "world cup: nation to reach semifinals": "Semifinals",
    "world cup: nation to reach round of 16": "Round of 16",
    "world cup: team to advance to knockout stages": "Round of 32",
    "world cup winner": "Champion",
}
# Stages by the schedule's keys, ranks of the knockout stages, and which stage leads to which.
STAGE_OF_KEY = {"group_stage": "Group Stage", "round_of_32": "Round of 32", "round_of_16": "Round of 16", "quarterfinal": "Quarterfinals", "semifinal": "Semifinals", "third_place": "Third Place", "final": "Final"}
KNOCKOUT_RANK = {"round_of_32": 1, "round_of_16": 2, "quarterfinal": 3, "semifinal": 4, "final": 5, "third_place": 5}
LADDER = [("Group Stage", "Round of 32"), ("Round of 32", "Round of 16"), ("Round of 16", "Quarterfinals"), ("Quarterfinals", "Semifinals"), ("Semifinals", "Final"), ("Final", "Champion"), ("Semifinals", "Third Place")]
ADVANCE_TYPE = "soccer_team_to_advance"


def allowed_patterns(spark: SparkSession) -> DataFrame:
    """One row for each allowed (type, source_type, target_type)."""
    return spark.createDataFrame([(e, *p) for e, ps in ALLOWED.items() for p in ps], "type string, source_type string, target_type string")


def stage_slug_ranks() -> dict[str, int]:
    return {label.lower().replace(" ", "-"): rank for label, rank in STAGE_RANK.items()}
