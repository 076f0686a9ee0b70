"""Voxel keys, downsampling, mergeable partial sums, votes and shared occupancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["ix", "iy", "iz"]


def keyed(points: DataFrame, size: float, mode: str = "floor") -> DataFrame:
    """`points` with ix, iy, iz. Modes: floor (no origin), shifted (floor above the least coordinate), nearest (shifted, plus a half), even (half-even rounding)."""
    if mode == "floor":
        return points.withColumns({f"i{c}": F.floor(F.col(c) / size) for c in "xyz"})
    if mode == "even":
        return points.withColumns({f"i{c}": F.rint(F.col(c) / size).cast("long") for c in "xyz"})
    if mode not in ("shifted", "nearest"):
        raise ValueError(mode)
    least = F.broadcast(points.agg(*[F.min(c).alias(f"__{c}") for c in "xyz"]))
    add = 0.5 if mode == "nearest" else 0.0
    return points.join(least).withColumns({f"i{c}": F.floor((F.col(c) - F.col(f"__{c}")) / size + add) for c in "xyz"}).drop("__x", "__y", "__z")


def packed_key(nx: int, ny: int) -> Column:
    """One number for a key of nonnegative parts below nx and ny."""
    return (F.col("iz") * ny + F.col("iy")) * nx + F.col("ix")


def downsample(points: DataFrame, size: float, mode: str = "floor") -> DataFrame:
    """Mean position and color of each voxel and its number of points; colors are cut to whole bytes."""
    means = [F.avg(c).alias(c) for c in "xyz"] + [F.avg(c).cast("int").alias(c) for c in "rgb"]
    return keyed(points, size, mode).groupBy(*KEY).agg(F.count("*").alias("n"), *means)


def partials(points: DataFrame, size: float) -> DataFrame:
    """Sums that merge: of coordinates, points and frames, with the first and last frame; frames below 0 are none."""
    frame = F.when(F.col("frame") >= 0, F.col("frame"))
    return keyed(points, size).groupBy(*KEY).agg(*[F.sum(c).alias(f"s{c}") for c in "xyz"], F.count("*").alias("n"), F.min(frame).alias("first"), F.max(frame).alias("last"), F.sum(frame).alias("frames"))


def merged(parts: DataFrame) -> DataFrame:
    """Partial sums of several chunks as one row for each voxel."""
    return parts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("sx", "sy", "sz", "n")], F.min("first").alias("first"), F.max("last").alias("last"), F.sum("frames").alias("frames"))


def votes(rows: DataFrame, keys: list[str], label: str = "label", weight: Column | None = None) -> DataFrame:
    """Weight of each label at each key."""
    return rows.groupBy(*keys, F.col(label).alias("label")).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("weight"))


def dominant(voted: DataFrame, keys: list[str], least_total: float = 1e-9) -> DataFrame:
    """The heaviest label of each key, of equals the first by name, with its share of max(total, least_total)."""
    best = F.max_by("label", F.struct(F.col("weight"), -F.col("__place")))
    by_name = Window.partitionBy(*keys).orderBy("label")
    ranked = voted.withColumn("__place", F.row_number().over(by_name))
    found = ranked.groupBy(*keys).agg(best.alias("label"), F.max("weight").alias("weight"), F.sum("weight").alias("total"), F.count("*").alias("labels"))
    return found.withColumn("share", F.col("weight") / F.greatest(F.col("total"), F.lit(float(least_total))))


def entropy(voted: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy in bits and purity of each key's labels; never a negative zero."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(*keys))
    return voted.withColumn("p", share).filter("p > 0").groupBy(*keys).agg((F.abs(F.sum(-F.col("p") * F.log2("p")))).alias("entropy"), F.max("p").alias("purity"))


def co_occupancy(cells: DataFrame, keys: list[str], owner: str = "object_id") -> DataFrame:
    """Pairs of owners with the cells they share, by Jaccard and by share of the smaller."""
    held = cells.select(*keys, F.col(owner).alias("o")).distinct()
    sizes = held.groupBy("o").agg(F.count("*").alias("n"))
    a, b = held.withColumnRenamed("o", "a"), held.withColumnRenamed("o", "b")
    both = a.join(b, keys).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = both.join(sizes.select(F.col("o").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("o").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("na", "nb")).alias("of_smaller"))


def tiles(points: DataFrame, size: float, low: float, high: float) -> DataFrame:
    """Square tiles with their height range, called flat below `low`, steep above `high`, else mixed."""
    cut = points.withColumn("tx", F.floor(F.col("x") / size)).withColumn("ty", F.floor(F.col("y") / size))
    out = cut.groupBy("tx", "ty").agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("rise"))
    return out.withColumn("kind", F.when(F.col("rise") <= low, "flat").when(F.col("rise") >= high, "steep").otherwise("mixed"))


def histogram(rows: DataFrame, value: str, width: float, bins: int) -> DataFrame:
    """Rows in each of `bins` bins of a width, the last holding all beyond."""
    return rows.groupBy(F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
