"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, settled


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): each linked id with the smallest id it can reach.

    Each step replaces links by links to the smallest neighbour; each step is a table that replaces the one before, and only a count comes
    to the driver. The neighbour minima are pre-aggregated by map tasks, and links meet them in plain equi-joins,
    so an id with very many links is no burden of one task.
    """
    return settled(lambda: _stars(saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())))


def _stars(edges: DataFrame) -> DataFrame:
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the smallest one
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: an id and its smaller neighbours go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()
        edges = saved(small, edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _are_stars(edges: DataFrame) -> bool:
    """No id is both a centre and a leaf, and each leaf has one centre."""
    ends = edges.select("u", F.lit(1).alias("leaf")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("leaf")))
    at = ends.groupBy("u").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("low"))
    return at.filter("n > 1 or (n = 1 and low = 0)").isEmpty()
