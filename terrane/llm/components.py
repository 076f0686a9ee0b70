"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.shared import Scratch


def connected_components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links` (src, dst), component being its smallest reachable node.

    Alternates the large-star and small-star steps until the links no longer change. Each step is an
    aggregation with map-side combining and a join that adaptive execution may split, so a hub with most
    of the links isn't gathered in one task. Self-links and nulls are dropped; nodes without links don't
    appear. Each round is written to the shared folder, so a lost executor costs no earlier round.
    """
    scratch = Scratch(spark, "components")
    pairs = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    stars, path = scratch.keep(pairs.filter("u > v").distinct())
    was = _state(stars)
    for _ in range(most_rounds):
        after, after_path = scratch.keep(_small_star(_large_star(stars)))
        scratch.drop(path)
        stars, path = after, after_path
        now = _state(stars)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    hung = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
