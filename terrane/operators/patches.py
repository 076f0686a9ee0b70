"""Patch statistics, edges between patches and decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.geometry import eigenvalues

#: Names of the geometry buckets 0 to 4.
BUCKETS = ("unknown", "horizontal", "vertical", "thin_linear", "rough_mixed")


def sums(points: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Sums that make all statistics of a patch and that merge by adding, and `more` of the same rows."""
    one = [F.sum(c).alias(f"s{c}") for c in "xyzrgb"]
    two = [F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    ends = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *one, *two, *ends, *more)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of patches made of others: `parts` holds their sums under the new keys."""
    added = [c for c in parts.columns if c not in keys and not (len(c) == 2 and c[1] in "01")]
    ends = [(F.min if c[1] == "0" else F.max)(c).alias(c) for c in parts.columns if len(c) == 2 and c[1] in "01" and c not in keys]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in added], *ends)


def shape(stats: DataFrame, population: bool = False) -> DataFrame:
    """`stats` with eigenvalues e1 >= e2 >= e3 of the covariance (sample or population), linearity, planarity and scattering."""
    over = F.col("n") if population else F.greatest(F.col("n") - 1, F.lit(1))
    cov = lambda a, b: (F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")) / over
    first, second, third = eigenvalues(cov("x", "x"), cov("x", "y"), cov("x", "z"), cov("y", "y"), cov("y", "z"), cov("z", "z"))
    out = stats.withColumns({"e1": first, "e2": second, "e3": F.greatest(third, F.lit(0.0))})
    top = F.greatest(F.col("e1"), F.lit(1e-12))
    return out.withColumns({"linearity": (F.col("e1") - F.col("e2")) / top, "planarity": (F.col("e2") - F.col("e3")) / top, "scattering": F.col("e3") / top})


def bucket(rise: Column, planarity: Column, linearity: Column, normal_z: Column) -> Column:
    """Geometry bucket of a neighbourhood, in the order of the cases."""
    return (
        F.when(linearity >= 0.75, "thin_linear")
        .when((planarity >= 0.45) & (normal_z >= 0.8), "horizontal")
        .when((planarity >= 0.45) & (normal_z <= 0.35), "vertical")
        .when(rise > 0.5, "rough_mixed")
        .otherwise("unknown")
    )


def dominant_geometry(counts: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """The bucket with at least `share` of a patch's cells, of equals the first, else mixed; `counts` has bucket (0 to 4) and n."""
    found = counts.groupBy(*keys).agg(F.max_by("bucket", F.struct(F.col("n"), -F.col("bucket"))).alias("top"), F.max("n").alias("most"), F.sum("n").alias("total"))
    names = F.array(*map(F.lit, BUCKETS))
    return found.select(*keys, F.when(F.col("most") >= share * F.col("total"), F.element_at(names, (F.col("top") + 1).cast("int"))).otherwise("mixed").alias("geometry"), (F.col("most") / F.col("total")).alias("share"))


def edge_features(pairs: DataFrame) -> DataFrame:
    """Of (a, b, color, normal, roughness) of single contacts: how many, mean and nearest-rank 90 % color distance, mean normal score and roughness difference."""
    return pairs.groupBy("a", "b").agg(
        F.count("*").alias("shared"),
        F.avg("color").alias("color_distance"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY color)").alias("color_p90"),
        F.avg("normal").alias("normal_score"),
        F.avg("roughness").alias("roughness_delta"),
    )


def merge_veto(a: Column, b: Column) -> Column:
    """Whether two patches are a horizontal and a vertical surface, which are never merged."""
    flat, steep = F.lit("horizontal"), F.lit("vertical")
    return ((a == flat) & (b == steep)) | ((a == steep) & (b == flat))


def bucket_veto(mode: str, a: Column, b: Column, color: Column, most_color: float) -> Column:
    """Whether a bucket guard forbids an edge. Modes: loose, same_or_unknown, same, same_or_color, no_rough."""
    same, unknown = a == b, (a == "unknown") | (b == "unknown")
    rules = {
        "loose": F.lit(False),
        "same_or_unknown": ~(same | unknown),
        "same": ~same,
        "same_or_color": ~(same | (color <= most_color)),
        "no_rough": ((a == "rough_mixed") | (b == "rough_mixed")) & ~same,
    }
    return rules[mode]


def best_owner(cells: DataFrame, keys: list[str], score: str, owner: str, margin: float, least: float) -> DataFrame:
    """The owner of each cell: the best by score if it reaches `least` and leads the next by `margin`; of equals the least."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), owner)
    ranked = cells.withColumn("__n", F.row_number().over(order)).withColumn("__next", F.lead(score).over(order)).filter("__n = 1")
    wins = (F.col(score) >= least) & (F.col(score) - F.coalesce("__next", F.lit(0.0)) >= margin)
    return ranked.filter(wins).select(*keys, F.col(owner).alias("owner"), F.col(score).alias("score"))


def split_by_cell(cells: DataFrame, patch: str, part: list[str], least: int) -> DataFrame:
    """New patch numbers for large parts: the largest keeps the patch, others of at least `least` rows are numbered on, the rest stay."""
    sizes = cells.groupBy(patch, *part).agg(F.count("*").alias("n"))
    order = Window.partitionBy(patch).orderBy(F.desc("n"), *part)
    ranked = sizes.withColumn("place", F.row_number().over(order))
    return ranked.withColumn("part", F.when((F.col("place") > 1) & (F.col("n") >= least), F.col("place") - 1).otherwise(0))
