"""Commands: reduce, odds-history, infer, build, validate, closure, and run, which does all but the closure.

``python -m quartzline.cli [--build-dir D] [--data-dir D] COMMAND``. Dimensions (names, codes, schedule) are JSON or parquet files that the caller names.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzline.operators import graph
from quartzline.plans import compilers, history, inference, pipeline
from quartzline.sources import artifacts, mart

COMMANDS = ("reduce", "odds-history", "infer", "build", "validate", "closure", "run")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quartzline", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--build-dir", default="build")
    p.add_argument("--data-dir", help="only this folder's parquet files are read")
    p.add_argument("--aliases", help="JSON object: name to canonical name")
    p.add_argument("--codes", help="JSON object: code to team")
    p.add_argument("--schedule", help="parquet table of fixtures")
    p.add_argument("--event-id", action="append", help="only this event; may be repeated")
    p.add_argument("--limit-events", type=int)
    p.add_argument("--minimum-confidence", type=float, default=0.0)
    return p


class Run:
    """One invocation: settings, and a method for each command."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args, self.out = spark, args, args.build_dir
        load = lambda path: artifacts.read_json(spark, path, {}) if path else {}
        self.domain = compilers.Domain(aliases=load(args.aliases), codes=load(args.codes))
        self.schedule = spark.read.parquet(args.schedule) if args.schedule else None

    def mart(self) -> DataFrame:
        return self.spark.read.parquet(artifacts.input_glob(self.spark, self.args.data_dir, ["data", "."]))

    def markets(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.out}/semantic_markets.parquet")
        chosen = mart.filter_ids(rows, self.args.event_id, limit=self.args.limit_events)
        return chosen.withColumn("seq", F.xxhash64("market_id").bitwiseAND(F.lit((1 << 30) - 1))) if "seq" not in rows.columns else chosen

    def reduce(self) -> None:
        rows = mart.semantic_markets(self.mart())
        place = rows.select("market_id").orderBy("market_id").withColumn("seq", F.monotonically_increasing_id())
        mart.write_typed(rows.join(place, "market_id"), f"{self.out}/semantic_markets.parquet", mart.MARKET | {"seq": "bigint"})

    def odds_history(self) -> None:
        rows = mart.history_rows(self.mart()).persist()
        try:
            history.stage_history(rows, self.domain.aliases).write.mode("overwrite").parquet(f"{self.out}/stage_odds_history.parquet")
            if self.schedule is not None:
                fixtures = self.schedule.select(F.col("fifa_match_id").cast("string").alias("match_id"), "home_team", "away_team", F.unix_timestamp(F.to_timestamp("kickoff_at_utc")).alias("kickoff_epoch"), F.col("fifa_match_id").alias("seq"))
                history.match_history(rows, fixtures, self.domain.aliases).write.mode("overwrite").parquet(f"{self.out}/odds_history.parquet")
        finally:
            rows.unpersist()

    def infer(self) -> None:
        markets = self.markets()
        topologies, covered = compilers.topology(markets, self.domain)
        artifacts.write_fragments(topologies, "topology", f"{self.out}/fragments")
        found, status, failed = inference.inferred(markets, covered)
        artifacts.write_fragments(found, "inferred", f"{self.out}/fragments")
        status.write.mode("overwrite").parquet(f"{self.out}/inference_status.parquet")
        failed.write.mode("overwrite").json(f"{self.out}/failed")

    def build(self) -> None:
        stored, kinds = artifacts.read_fragments(self.spark, f"{self.out}/fragments")
        mine = kinds.filter("kind = 'inferred'").select("event_id")
        found = type(stored)(stored.nodes.join(mine, "event_id", "left_semi"), stored.edges.join(mine, "event_id", "left_semi"))
        g = pipeline.build(self.markets(), self.domain, found, None, self.schedule, self.args.minimum_confidence)
        nodes = artifacts.with_propositions(g.nodes, g.propositions)
        artifacts.export_graph(nodes, g.edges, f"{self.out}/graph", artifacts.report(g.nodes, g.edges, g.tiers))

    def validate(self) -> int:
        nodes, edges = artifacts.read_graph(self.spark, f"{self.out}/graph")
        empty = edges.withColumn("reason", F.lit(None).cast("string"))
        found = pipeline.violations(pipeline.Graph(nodes, empty, nodes, nodes))
        for r in found.limit(20).collect():
            print(f"{r.error}: {r.subject}", file=sys.stderr)
        return int(not found.isEmpty())

    def closure(self) -> None:
        _, edges = artifacts.read_graph(self.spark, f"{self.out}/graph")
        implies = edges.filter("type = 'IMPLIES'").select(F.col("source").alias("src"), F.col("target").alias("dst"), "evidence", F.monotonically_increasing_id().alias("seq"))
        graph.implied_edges(implies).write.mode("overwrite").parquet(f"{self.out}/closure.parquet")

    def run(self) -> int:
        for step in (self.reduce, self.infer, self.build, self.odds_history):
            step()
        return self.validate()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quartzline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return getattr(Run(spark, args), args.command.replace("-", "_"))() or 0


if __name__ == "__main__":
    sys.exit(main())
