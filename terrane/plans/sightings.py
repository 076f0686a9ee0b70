"""Queries of frame-local targets and of their fusion with all gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import fusion, targets
from terrane.plans.domain import POINTS, points, table, with_
from terrane.plans.registry import query
from terrane.plans.spatial import PROJECTED, seen

#: Masks of each image: bands of 40 columns, of which every fifth is sky, from row 200 to 320 but for a gap.
MASKS = """images AS (SELECT DISTINCT frame, cam FROM points), runs AS (
  SELECT frame, cam, CAST(1 + u // 40 AS INT) AS mask_id, CASE (u // 40) % 5 WHEN 0 THEN 'sky' WHEN 1 THEN 'wall' WHEN 2 THEN 'pipe' WHEN 3 THEN 'floor' ELSE 'car' END AS label, u * 480 + top AS start, tall AS length
  FROM images, range(0, 640) t(u), (VALUES (200, 50), (254, 66)) r(top, tall))"""
RULES = targets.Rules(height=480, cell=5.0, cells=(("pipe", 4.0), ("wall", 6.0)), least=3, erode=1, erode_labels=("pipe", "car"), window=1, depth_edge=0.4, depth_labels=("wall", "car"))


def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = points(spark, sf_dir).select("frame", "cam").distinct()
    columns = images.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(639)))).withColumn("r", F.explode(F.array(*[F.struct(F.lit(a).alias("top"), F.lit(n).alias("tall")) for a, n in ((200, 50), (254, 66))])))
    band = F.floor(F.col("u") / 40)
    label = F.element_at(F.array(*map(F.lit, ("sky", "wall", "pipe", "floor", "car"))), (band % 5 + 1).cast("int"))
    return columns.select("frame", "cam", (band + 1).cast("int").alias("mask_id"), label.alias("label"), (F.col("u") * 480 + F.col("r.top")).cast("long").alias("start"), F.col("r.tall").cast("long").alias("length"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen(spark, sf_dir, "x", "y", "z").drop("label")


@query(
    with_(POINTS, PROJECTED, MASKS)
    + """, pixels AS (SELECT frame, cam, mask_id, label, (start + o) // 480 AS u, (start + o) % 480 AS v FROM runs, range(0, 66) t(o) WHERE o < length AND label <> 'sky'),
inner_ AS (SELECT frame, cam, mask_id, u + a AS u, v + b AS v FROM pixels, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) s(a, b) WHERE label IN ('pipe', 'car') GROUP BY ALL HAVING count(*) = 5),
fronts AS (SELECT frame, cam, u + a AS u, v + b AS v, min(depth) AS front FROM (SELECT frame, cam, u, v, min(depth) AS depth FROM seen GROUP BY ALL), range(-1, 2) s(a), range(-1, 2) w(b) GROUP BY ALL)
SELECT s.frame, s.cam, p.mask_id, p.label, CASE WHEN p.label IN ('pipe', 'car') AND i.u IS NULL THEN 'boundary' WHEN p.label IN ('wall', 'car') AND depth > front + 0.4::DOUBLE THEN 'depth' ELSE 'kept' END AS fate, count(*) AS n
FROM (SELECT frame, cam, u, v, depth FROM seen) s JOIN pixels p USING (frame, cam, u, v) JOIN fronts f USING (frame, cam, u, v) LEFT JOIN inner_ i ON i.frame = s.frame AND i.cam = s.cam AND i.mask_id = p.mask_id AND i.u = s.u AND i.v = s.v GROUP BY ALL"""
)
def mask_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that meet the masks of their image, by what becomes of them."""
    held = targets.kept_in_masks(seen(spark, sf_dir).drop("label"), mask_runs(spark, sf_dir), RULES)
    return held.groupBy("frame", "cam", "mask_id", "label", F.coalesce("gone", F.lit("kept")).alias("fate")).agg(F.count("*").alias("n"))


@query()
def frame_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of all frames: pieces of masks in space, with box, centre, color and direction."""
    return targets.found(placed(spark, sf_dir), mask_runs(spark, sf_dir), RULES)


def sighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line as a target: suppliers stand apart, lines of one near each other, in frames by their order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    kind = F.col("l_partkey") % 7
    x, y, z = F.col("l_suppkey") * 4 + F.col("l_quantity") * 0.05, F.col("l_extendedprice") / 30_000, F.col("l_discount") * 8
    half = (F.col("l_tax") + 0.01).cast("double")
    ends = [(c + s * half).alias(f"{n}{k}") for n, c in zip("xyz", (x, y, z), strict=True) for k, s in ((0, -1), (1, 1))]
    return lines.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long") % 100_000_000).alias("target_id"),
        (F.col("l_orderkey") % 400).cast("int").alias("frame"),
        pick(kind, "wall", "floor", "pipe", "equipment", "equipment", "car", "building").alias("label"),
        pick(kind, "surface", "surface", "structure", "object", "object", "dynamic", "structure").alias("parent"),
        x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), *ends,
        (F.col("l_partkey") % 90).cast("double").alias("r"), (F.col("l_suppkey") % 256).cast("double").alias("g"), (F.col("l_orderkey") % 60).cast("double").alias("b"),
        F.lit(1.0).alias("nx"), ((F.col("l_linenumber") - 1) * 0.1).cast("double").alias("ny"), F.lit(0.0).alias("nz"),
        (F.col("l_quantity") * 3).cast("int").alias("points"), fusion.confidence_of(1.0 - F.col("l_discount") * 6).alias("confidence"), (F.col("l_tax") > 0.06).alias("mixed"), (F.col("l_linenumber") % 2 == 0).alias("mergeable"),
        fusion.identity_terms(F.col("p_type")).alias("terms"), pick(F.col("l_linenumber") % 5, "unknown", "unknown", "merge_to_structural_region", "attached_object_candidate", "unknown").alias("attachment"),
        F.sequence((F.col("l_quantity") / 10).cast("long"), (F.col("l_quantity") / 10).cast("long") + 3).alias("point_ids"),
    )


@query()
def target_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each target, and why, by all gates."""
    return fusion.fused(sighted(spark, sf_dir))


@query()
def target_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of the objects that targets become."""
    rows = sighted(spark, sf_dir)
    return fusion.zones(fusion.objects(fusion.fused(rows), rows))
