"""Targets split by planes, round by round: a plane is found on a bounded sample, and all points near it are one piece or several."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import neighbours
from terrane.operators.graph import components
from terrane.operators.lineage import Scratch
from terrane.operators.patches import sums
from terrane.operators.targets import normal
from terrane.operators.voxels import KEY

#: How many times a sample's points pass the hash below which they are ranked.
SPARE = 3


@dataclass(frozen=True)
class Rules:
    """Planes of a target at most, how near and how many their points are, samples and tries, and when pieces count."""

    planes: int = 4
    distance: float = 0.08
    least: int = 80
    rest: int = 80
    cell: float = 0.25
    piece: int = 30
    sample: int = 512
    tries: int = 96
    seed: int = 17
    floor: float = 0.82
    wall: float = 0.35


def found_plane(xyz: np.ndarray, rules: Rules, seed: int) -> tuple[float, ...] | None:
    """(nx, ny, nz, d) of the plane through three points of a sample that most of it is near, of equals the first tried; None if all three always lie in line."""
    rng, best, most = np.random.default_rng(seed), None, 0
    for _ in range(rules.tries if len(xyz) >= 3 else 0):
        a, b, c = xyz[rng.choice(len(xyz), 3, replace=False)]
        way = np.cross(b - a, c - a)
        size = np.linalg.norm(way)
        if size >= 1e-8:
            way = way / size
            count = int((np.abs((xyz - a) @ way) <= rules.distance).sum())
            if count > most:
                best, most = (*way.tolist(), float(-way @ a)), count
    return best


def _finder(rules: Rules, number: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        plane = found_plane(rows[["x", "y", "z"]].to_numpy(), rules, rules.seed + 1000 * number + len(rows))
        return pd.DataFrame([(rows["target"].iloc[0], *plane)] if plane else [], columns=["target", "a", "b", "c", "d"])

    return find


def split(points: DataFrame, target: str, rules: Rules | None = None) -> DataFrame:
    """(target, point_id, plane, part) of points (target, point_id, x, y, z): the plane that took a point, 0 for the rest, and its piece.

    In each round every target with `least` points left looks for a plane on the `sample` points of least hash among
    them, and all that lie within `distance` of it leave with it, if they are `least`; targets without one are done. What
    lies on one plane, and the rest if there are `rest` points, falls into pieces whose cells touch in any of 26 ways. Pieces of
    `piece` points are numbered from 0 by size over all planes, of equals by least point_id; others have a null part.

    A task holds samples alone; distances are a join by target, so the points of one target are dealt out as any others.
    Points are kept once and planes are a table of their own, from which each round and the pieces tell whose a point is.
    """
    return _split(points, target, rules or Rules(), []).select(F.col("target").alias(target), "point_id", "plane", "part")


def _split(points: DataFrame, target: str, rules: Rules, keep: list[str]) -> DataFrame:
    """(target, point_id, x, y, z, keep, plane, part); see split."""
    scratch = Scratch(points.sparkSession, "planes")
    whole, _ = scratch.keep(points.select(F.col(target).alias("target"), "point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], *keep))
    kind = whole.schema["target"].dataType.simpleString()
    sizes, _ = scratch.keep(whole.groupBy("target").agg(F.count("*").alias("__n")))
    planes = None
    for number in range(1, rules.planes + 1):
        left = whole if planes is None else _placed(whole, planes, rules).filter("plane = 0").drop("plane")
        sample, _ = scratch.keep(_sampled(left, sizes, rules, number))
        found, _ = scratch.keep(sample.groupBy("target").applyInPandas(_finder(rules, number), f"target {kind}, a double, b double, c double, d double"))
        near = left.join(found, "target").filter(_off(F.col("a"), F.col("b"), F.col("c"), F.col("d")) <= rules.distance)
        counts = near.groupBy("target").agg(F.count("*").alias("__near")).filter(F.col("__near") >= rules.least)
        on, _ = scratch.keep(found.join(counts, "target").withColumn("number", F.lit(number)))
        if on.isEmpty():
            break
        planes = on if planes is None else planes.unionByName(on)
        sizes, _ = scratch.keep(sizes.join(on.select("target", "__near"), "target", "left").select("target", (F.col("__n") - F.coalesce("__near", F.lit(0))).alias("__n")))
    return _pieces(whole.withColumn("plane", F.lit(0)) if planes is None else _placed(whole, planes, rules), rules, scratch)


def _off(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.abs(a * F.col("x") + b * F.col("y") + c * F.col("z") + d)


def _placed(points: DataFrame, planes: DataFrame, rules: Rules) -> DataFrame:
    """Points with `plane`: the first of their target's planes that they are near, else 0."""
    of_target = planes.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("number", "a", "b", "c", "d"))).alias("__planes"))
    near = F.filter("__planes", lambda p: _off(p["a"], p["b"], p["c"], p["d"]) <= rules.distance)
    return points.join(of_target, "target", "left").withColumn("plane", F.coalesce(F.get(near, F.lit(0))["number"], F.lit(0))).drop("__planes")


def _sampled(left: DataFrame, sizes: DataFrame, rules: Rules, number: int) -> DataFrame:
    """The `sample` points of each target of least hash, in its order by `nth`.

    Of a target of many points only those below a hash that some SPARE times as many pass are ranked; where fewer
    than a sample passed, as repeated ids may bring about, all of the target are.
    """
    hashed = left.withColumn("__hash", F.xxhash64("point_id", F.lit(number)))
    limit = F.lit(-(2.0**63)) + 2.0**64 * rules.sample * SPARE / F.col("__n")
    passed = hashed.join(sizes, "target", "left").withColumn("__low", F.coalesce(F.col("__hash") <= limit, F.lit(True)))
    order = Window.partitionBy("target").orderBy("__hash", "point_id")
    ranked = lambda rows: rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rules.sample)
    first, _ = Scratch(left.sparkSession, "sample").keep(ranked(passed.filter("__low").drop("__low")))
    short = first.groupBy("target").agg(F.count("*").alias("__got"), F.first("__n").alias("__n"))
    few = sizes.join(short.select("target", "__got"), "target", "left").filter(F.coalesce("__got", F.lit(0)) < F.least(F.col("__n"), F.lit(rules.sample))).select("target")
    if few.isEmpty():
        return first.drop("__hash", "__n")
    again = ranked(hashed.join(few, "target", "left_semi"))
    return first.drop("__n").join(few, "target", "left_anti").unionByName(again).drop("__hash")


def _pieces(points: DataFrame, rules: Rules, scratch: Scratch) -> DataFrame:
    key = ["target", "plane"]
    held = points.withColumns({k: F.floor(F.col(c) / rules.cell) for k, c in zip(KEY, "xyz", strict=True)}).withColumn("node", F.xxhash64(*key, *KEY))
    # what a piece is and holds is told by cells; points only look up their cell's
    cells, _ = scratch.keep(held.groupBy(*key, *KEY, "node").agg(F.count("*").alias("n"), F.min("point_id").alias("least_id")))
    steps = F.array(*[F.array(*map(F.lit, s)) for s in neighbours.positive(neighbours.offsets("cube"))])
    moved = cells.withColumn("s", F.explode(steps)).select("node", F.xxhash64(*key, *[F.col(k) + F.col("s")[n] for n, k in enumerate(KEY)]).alias("b"))
    edges = moved.join(cells.select(F.col("node").alias("b")), "b").select(F.col("node").alias("a"), "b")
    named, _ = scratch.keep(cells.join(components(edges, cells.select("node")), "node").select(*key, "node", "component", "n", "least_id"))
    rests = named.filter("plane = 0").groupBy("target").agg(F.sum("n").alias("rest"))
    sizes = named.groupBy(*key, "component").agg(F.sum("n").alias("n"), F.min("least_id").alias("least_id")).join(rests, "target", "left")
    counted = sizes.filter((F.col("n") >= rules.piece) & ((F.col("plane") > 0) | (F.col("rest") >= rules.rest)))
    numbered = counted.withColumn("part", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("n"), "least_id")) - 1)
    parts, _ = scratch.keep(named.join(numbered.select(*key, "component", "part"), [*key, "component"]).select("node", "part"))
    return held.join(parts, "node", "left").drop("node", *KEY)


def surfaces(points: DataFrame, target: str, label: str, rules: Rules | None = None) -> DataFrame:
    """What surface_labels gives for the parts of these points by split, each point keeping its place and label instead of being joined to its part again."""
    rules = rules or Rules()
    found = _split(points.select(target, "point_id", *"xyz", F.col(label).alias("__label")), target, rules, ["__label"])
    rows = found.filter("part is not null").select(F.col("target").alias(target), F.col("__label").alias(label), "part", *"xyz")
    return _labelled(rows, target, label, rules)


def surface_labels(points: DataFrame, parts: DataFrame, target: str, label: str, rules: Rules | None = None) -> DataFrame:
    """(target, part, n, label) of the parts: floor where a piece lies level, wall where it stands, else its target's own; ceilings stay."""
    return _labelled(points.join(parts.filter("part is not null"), [target, "point_id"]), target, label, rules or Rules())


def _labelled(rows: DataFrame, target: str, label: str, rules: Rules) -> DataFrame:
    found = normal(sums(rows.withColumns({c: F.lit(0.0) for c in "rgb"}), [target, label, "part"]))
    level = F.abs(F.col("nz"))
    named = F.when(F.col(label) == "ceiling", F.col(label)).when(level >= rules.floor, "floor").when(level <= rules.wall, "wall").otherwise(F.col(label))
    return found.select(target, "part", "n", named.alias("label"))

