"""Quality flags, gates, differences of runs, manifests and invariants."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flagged(rows: DataFrame, flags: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """`rows` with energy, the weights of the flags that hold, and flags, their names in order joined by commas."""
    energy = sum((F.when(c, weights[k]).otherwise(0.0) for k, c in flags.items()), F.lit(0.0))
    names = F.array_compact(F.array(*[F.when(c, k) for k, c in flags.items()]))
    return rows.withColumn("energy", energy).withColumn("flags", F.array_join(names, ","))


def pareto(rows: DataFrame, key: str, goals: list[str]) -> DataFrame:
    """Rows that no other row beats: at most as much in every goal and less in one (less is better).

    Equal goals are one point. Each partition first drops the points that others of its own beat; what is
    left, the fronts of the partitions, is compared pair by pair. Rows with a null or NaN goal are left out.
    """
    known = rows
    for g in goals:
        known = known.filter(F.col(g).isNotNull() & ~F.isnan(F.col(g).cast("double")))

    def front_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            part = part.sort_values(goals, kind="stable").drop_duplicates(ignore_index=True)
            values, stay = part.to_numpy(float), []
            for k, point in enumerate(values):
                # what beats a point comes before it in this order
                if not stay or not (values[stay] <= point).all(axis=1).any():
                    stay.append(k)
            held = part.iloc[stay]
        if held is not None:
            yield held

    points = known.select(*goals).mapInPandas(front_of, known.select(*goals).schema).distinct()
    other = points.select(*[F.col(g).alias(f"__{g}") for g in goals])
    no_worse, better = F.lit(True), F.lit(False)
    for g in goals:
        no_worse, better = no_worse & (F.col(f"__{g}") <= F.col(g)), better | (F.col(f"__{g}") < F.col(g))
    front = points.join(other, no_worse & better, "left_anti")
    return rows.join(front, goals).select(key, *goals)


def difference(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows added, removed, changed and same between two runs, with the change of each value."""
    old = before.select(F.col(key).alias("__k"), *[F.col(v).alias(f"__{v}") for v in values])
    both = after.select(key, *values).join(old, F.col(key) == F.col("__k"), "full")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    state = F.when(F.col("__k").isNull(), "added").when(F.col(key).isNull(), "removed").when(same, "same").otherwise("changed")
    return both.select(F.coalesce(key, "__k").alias(key), state.alias("state"), *[(F.coalesce(v, F.lit(0)) - F.coalesce(f"__{v}", F.lit(0))).alias(f"{v}_change") for v in values])


def ready(manifest: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    return manifest.join(artifacts, keys, "left_semi")


def missing(manifest: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    return manifest.join(artifacts, keys, "left_anti")


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each key spread evenly along its order, ends included; positions round half to even."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    step = (F.col("__n") - 1) / F.lit(max(1, k - 1))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.rint(j * step).cast("long"))
    return placed.filter((F.col("__n") <= k) | F.array_contains(wanted, F.col("__i").cast("long"))).drop("__i", "__n")


def stratified(rows: DataFrame, stratum: str, order: list[Column], budget: int, least: int) -> DataFrame:
    """About `budget` rows shared over the strata by size, each with at least `least`, in each stratum's order."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("__s"))
    whole = sizes.agg(F.sum("__s").alias("__all"))
    shares = sizes.join(F.broadcast(whole)).withColumn("__share", F.greatest(F.lit(least), F.floor(budget * F.col("__s") / F.col("__all"))))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.join(shares, stratum).filter("place <= __share").drop("__s", "__share", "__all")


def duplicate_owners(cells: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Cells with more than one owner."""
    return cells.groupBy(*keys).agg(F.count_distinct(owner).alias("owners")).filter("owners > 1")


def violations(before: DataFrame, after: DataFrame, key: str, needed: list[str]) -> DataFrame:
    """Broken invariants of a run: ids lost, ids new, fields missing."""
    lost = before.join(after, key, "left_anti").select(F.col(key), F.lit("lost").alias("broken"))
    new = after.join(before, key, "left_anti").select(F.col(key), F.lit("new").alias("broken"))
    out = lost.unionByName(new)
    for c in needed:
        out = out.unionByName(after.filter(F.col(c).isNull()).select(F.col(key), F.lit(f"no {c}").alias("broken")))
    return out


def holdout(edges: DataFrame, truth: DataFrame, score: str, threshold: float) -> DataFrame:
    """Counts, precision and recall of edges at or above a threshold against known ones (a, b, same)."""
    met = edges.join(truth, ["a", "b"]).withColumn("said", F.col(score) >= threshold)
    hit = F.sum(F.when(F.col("said") & F.col("same"), 1).otherwise(0))
    said, same = F.sum(F.when(F.col("said"), 1).otherwise(0)), F.sum(F.when(F.col("same"), 1).otherwise(0))
    return met.agg(F.count("*").alias("n"), hit.alias("hits"), (hit / F.greatest(said, F.lit(1))).alias("precision"), (hit / F.greatest(same, F.lit(1))).alias("recall"))


def gated(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """`rows` with `failed`, the gates that don't hold (unknown counts as not), and `promoted`, whether all do."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), k) for k, c in gates.items()]))
    return rows.withColumn("failed", F.array_join(failed, ",")).withColumn("promoted", F.col("failed") == "")
