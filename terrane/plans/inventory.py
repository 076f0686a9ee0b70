"""Queries of the object operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geometry
from terrane.operators import neighbours, objects, patches, voxels
from terrane.plans.domain import PATCHES, POINTS, points, table, with_
from terrane.plans.domain import patches as patch_table
from terrane.plans.registry import query
from terrane.plans.spatial import CELL, CONTACTS, KEYS, OWNED, STEPS, owned

CELLS = f"cells AS (SELECT {CELL}, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(r + g + b) AS brightness FROM points GROUP BY 1, 2, 3)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = voxels.keyed(points(spark, sf_dir), 1.0)
    return keyed.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in "xyz"], F.avg(F.col("r") + F.col("g") + F.col("b")).alias("brightness"))


@query(
    with_(POINTS, CELLS, STEPS)
    + "SELECT c.ix, c.iy, c.iz, count(*) AS near, round(max(n.z) - min(n.z), 6) AS rise, round(stddev_pop(n.brightness), 4) AS brightness_std, round(var_pop(n.x) + var_pop(n.y) + var_pop(n.z), 6) AS spread FROM cells c, steps s JOIN cells n ON n.ix = c.ix + s.dx AND n.iy = c.iy + s.dy AND n.iz = c.iz + s.dz GROUP BY 1, 2, 3"
)
def local_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = objects.local_features(_cells(spark, sf_dir))
    spread = F.col("e1") + F.col("e2") + F.col("e3")
    return out.select(*KEYS, "near", F.round("rise", 6).alias("rise"), F.round("brightness_std", 4).alias("brightness_std"), F.round(spread, 6).alias("spread"))


@query(
    with_(POINTS, CELLS, STEPS, "n AS (SELECT c.ix, c.iy, c.iz, max(n.z) - min(n.z) AS rise FROM cells c, steps s JOIN cells n ON n.ix = c.ix + s.dx AND n.iy = c.iy + s.dy AND n.iz = c.iz + s.dz GROUP BY 1, 2, 3)")
    + "SELECT CASE WHEN rise - 0.7 > 0.5 THEN 'rough_mixed' ELSE 'unknown' END AS bucket, count(*) AS n FROM n GROUP BY 1"
)
def geometry_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two cases of the bucket expression, which read the height range alone."""
    zero = F.lit(0.0)
    out = objects.local_features(_cells(spark, sf_dir)).withColumn("bucket", patches.bucket(F.col("rise") - 0.7, zero, zero, zero))
    return out.groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    with_(POINTS, PATCHES, "s AS (SELECT patch_id AS surface, x0, x1, y0, y1, z0, z1, z AS mz, r AS mr FROM patches WHERE n >= 3)", "p AS (SELECT point_id AS residual, x, y, z, r FROM points)", "met AS (SELECT residual, surface, abs(p.z - mz) + abs(p.r - mr) / 255 AS cost FROM p JOIN s ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1 WHERE abs(p.r - mr) <= 60)")
    + "SELECT residual, first(surface ORDER BY cost, surface) AS surface, round(min(cost), 6) AS cost FROM met WHERE cost <= 1 GROUP BY 1"
)
def residual_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [F.col(f"{c}{k}").alias(f"s_{c}{k}") for c in "xyz" for k in (0, 1)]
    surfaces = patch_table(spark, sf_dir).filter("n >= 3").select(F.col("patch_id").alias("surface"), *ends, F.col("z").alias("s_z"), F.col("r").alias("s_r"))
    residuals = points(spark, sf_dir).select(F.col("point_id").alias("residual"), "x", "y", "z", "r")
    inside = F.abs(F.col("r") - F.col("s_r")) <= 60
    for c in "xyz":
        inside = inside & (F.col(c) >= F.col(f"s_{c}0")) & (F.col(c) <= F.col(f"s_{c}1"))
    apart = [(F.col("z"), F.col("s_z"), 1.0), (F.col("r") / 255, F.col("s_r") / 255, 60 / 255)]
    found = objects.assigned(residuals, surfaces, 5.0, inside, F.abs(F.col("z") - F.col("s_z")) + F.abs(F.col("r") - F.col("s_r")) / 255, 1.0, apart)
    return found.withColumn("cost", F.round("cost", 6))


OBJECTS = "objects AS (SELECT object_id * 100 + frame AS object_id, min(label) AS label, CAST(min(frame) AS BIGINT) AS first, CAST(max(frame) AS BIGINT) AS last, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS points, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, any_value(frame) AS frame FROM points GROUP BY object_id, frame)"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]
    rows = points(spark, sf_dir).groupBy("object_id", "frame").agg(F.min("label").alias("label"), *[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("points"), *ends)
    seen = F.col("frame").cast("long")
    return rows.withColumns({"object_id": F.col("object_id") * 100 + F.col("frame"), "first": seen, "last": seen})


@query(
    with_(POINTS, OBJECTS, "met AS (SELECT a.object_id AS a, b.object_id AS b, greatest(a.first - b.last, b.first - a.last) AS gap, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance FROM objects a JOIN objects b ON a.label = b.label AND a.object_id < b.object_id AND abs(a.x - b.x) <= 0.3 AND abs(a.y - b.y) <= 0.3)")
    + "SELECT a, b, gap, round(distance, 6) AS distance FROM met WHERE gap >= 15 AND distance <= 0.3 ORDER BY met.distance, a, b LIMIT 200"
)
def distant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 200 nearest pairs."""
    return objects.distant_pairs(_objects(spark, sf_dir), ["label"], 15, 0.3, 200).withColumn("distance", F.round("distance", 6))


@query(
    with_(POINTS, OBJECTS)
    + "SELECT object_id // 100 AS root, count(*) AS members, CAST(sum(points) AS BIGINT) AS points, round(sum(x * points) / sum(points), 6) AS x, min(x0) AS x0, max(z1) AS z1, count(DISTINCT frame) AS frames FROM objects GROUP BY 1"
)
def merged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _objects(spark, sf_dir)
    roots = rows.select("object_id", F.expr("object_id div 100").alias("root"))
    return objects.merged_objects(rows, roots).select("root", "members", "points", F.round("x", 6).alias("x"), "x0", "z1", F.size("frames").cast("long").alias("frames"))


@query(
    with_(POINTS, PATCHES, "met AS (SELECT u.patch_id AS upper, l.patch_id AS lower, u.z - l.z AS rise FROM patches u JOIN patches l ON u.x0 < l.x1 AND l.x0 < u.x1 AND u.y0 < l.y1 AND l.y0 < u.y1 WHERE u.z - l.z >= 0.4 AND u.z - l.z <= 1.5)")
    + "SELECT upper, first(lower ORDER BY rise, lower) AS lower FROM met GROUP BY 1"
)
def objects_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies under each patch."""
    rows = patch_table(spark, sf_dir).withColumnRenamed("patch_id", "object_id")
    return objects.below(rows, 5.0, 0.4, 1.5)


@query()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows of each label: the sampling operator itself."""
    return objects.sampled(points(spark, sf_dir), ["label"], "point_id", 5, 11).select("label", "point_id", "place")


@query(
    "WITH one AS (SELECT l_suppkey AS a, l_partkey % 100 AS b, count(*) AS support FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), two AS (SELECT l_partkey % 100 AS a, l_suppkey AS b, count(*) AS support FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, support, 'adjacency' AS source FROM one UNION ALL SELECT least(a, b), greatest(a, b), support, 'overlap' FROM two) SELECT a, b, max(support) AS support, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM u GROUP BY 1, 2 ORDER BY support DESC, a, b LIMIT 500"
)
def united_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 best-supported candidates of two tables."""
    lines = table(spark, sf_dir, "lineitem")
    one = lines.filter("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")).agg(F.count("*").alias("support"))
    two = lines.filter("l_returnflag = 'R'").groupBy((F.col("l_partkey") % 100).alias("a"), F.col("l_suppkey").alias("b")).agg(F.count("*").alias("support"))
    return objects.united_candidates([("adjacency", one), ("overlap", two)], 500)


@query(
    "WITH f AS (SELECT user_id AS object_id, min(event_type) AS label, round(avg(value), 6) AS confidence FROM events WHERE event_id % 2 = 0 GROUP BY 1), s AS (SELECT user_id AS object_id, max(event_type) AS l2, round(avg(value), 6) AS c2 FROM events WHERE event_id % 3 = 1 AND user_id % 4 <> 0 GROUP BY 1) SELECT f.object_id, CASE WHEN coalesce(l2 = 'view' AND c2 >= 10, false) THEN l2 ELSE label END AS label, CASE WHEN coalesce(l2 = 'view' AND c2 >= 10, false) THEN c2 ELSE confidence END AS confidence, CASE WHEN coalesce(l2 = 'view' AND c2 >= 10, false) THEN 'replaced' WHEN l2 IS NULL THEN 'first only' WHEN l2 = label THEN 'agrees' ELSE 'kept first' END AS note FROM f LEFT JOIN s USING (object_id)"
)
def second_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events")
    first = seen.filter("event_id % 2 = 0").groupBy(F.col("user_id").alias("object_id")).agg(F.min("event_type").alias("label"), F.round(F.avg("value"), 6).alias("confidence"))
    second = seen.filter("event_id % 3 = 1 AND user_id % 4 <> 0").groupBy(F.col("user_id").alias("object_id")).agg(F.max("event_type").alias("label"), F.round(F.avg("value"), 6).alias("confidence"))
    return objects.second_reviews(first, second, ["view"], 10.0)


@query("WITH r AS (SELECT c_custkey AS object_id, c_acctbal AS weight, CASE WHEN c_acctbal < 0 THEN 'split' WHEN c_mktsegment = 'BUILDING' THEN 'review' END AS action FROM customer) SELECT object_id, action, abs(weight) AS weight FROM r WHERE action IS NOT NULL ORDER BY 3 DESC, object_id LIMIT 100")
def action_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 heaviest rows to act on."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), "c_acctbal", "c_mktsegment")
    return objects.action_queue(rows, [("split", F.col("c_acctbal") < 0), ("review", F.col("c_mktsegment") == "BUILDING")], F.abs("c_acctbal"), 100).select("object_id", "action", "weight")


@query(with_(POINTS) + "SELECT object_id, frame, round(count(*) * ln(1 + (max(x) - min(x)) * (max(y) - min(y))) / greatest(avg(z), 1), 6) AS score FROM points GROUP BY 1, 2")
def view_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    return points(spark, sf_dir).groupBy("object_id", "frame").agg(F.round(objects.view_score(F.count("*"), area, F.avg("z")), 6).alias("score"))


@query(
    "WITH RECURSIVE " + ", ".join((POINTS, OWNED, CONTACTS))
    + ", tiny AS (SELECT owner FROM sizes WHERE n < 12), half AS (SELECT a, b FROM contacts JOIN sizes s ON s.owner = a JOIN sizes t ON t.owner = b WHERE faces / least(s.n, t.n) >= 0.2::DOUBLE AND s.n < 12 AND t.n < 12), e AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half)"
    + ", r(a, b) AS (SELECT owner, owner FROM tiny UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a, min(b) AS least FROM r GROUP BY 1) SELECT owner AS node, coalesce(c.least, owner) AS \"to\" FROM sizes LEFT JOIN c ON c.a = owner"
)
def tiny_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = owned(spark, sf_dir)
    sizes = cells.groupBy(F.col("owner").alias("node")).agg(F.count("*").alias("size"))
    return objects.collapsed(sizes, neighbours.contacts(cells, "owner").filter("contact_ratio >= 0.2"), 12)


@query("SELECT l_suppkey, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(avg(l_extendedprice - l_quantity), 4) AS mean_off, round(max(abs(l_extendedprice - l_quantity)), 4) AS worst FROM lineitem GROUP BY 1")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = objects.sync_summary(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.withColumns({"correlation": F.round("correlation", 6), "mean_off": F.round("mean_off", 4), "worst": F.round("worst", 4)})


@query(with_(POINTS) + "SELECT point_id, round(y, 6) AS u, round(-x, 6) AS v, round(z, 6) AS w FROM points")
def pose_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the frame of a pose turned a quarter about the vertical: (y, -x, z)."""
    turn = geometry.rotation(*map(F.lit, (0.7071067811865476, 0.0, 0.0, 0.7071067811865476)))
    u, v, w = geometry.into_frame(geometry.triple("x", "y", "z"), turn, (F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    return points(spark, sf_dir).select("point_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in ((u, "u"), (v, "v"), (w, "w"))])


@query(with_(POINTS, "a AS (SELECT *, atan2(sqrt(x * x + y * y), z + 1) AS t FROM points)") + "SELECT point_id, round(300 * x * (t + 0.05 * t * t * t + 0.01 * t * t * t * t * t) / sqrt(x * x + y * y) + 320, 4) AS u, round(300 * y * (t + 0.05 * t * t * t + 0.01 * t * t * t * t * t) / sqrt(x * x + y * y) + 240, 4) AS v FROM a")
def fisheye_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = geometry.fisheye((F.col("x"), F.col("y"), F.col("z") + 1), 300.0, 300.0, 320.0, 240.0, (0.05, 0.01))
    return points(spark, sf_dir).select("point_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


@query(
    "WITH e AS (SELECT DISTINCT p_partkey AS a, p_size % 5 AS bucket_a, (p_partkey * 7) % 5 AS bucket_b, p_size * 3 AS color FROM part), n AS (SELECT *, list_extract(['unknown', 'horizontal', 'vertical', 'thin_linear', 'rough_mixed'], bucket_a + 1) AS x, list_extract(['unknown', 'horizontal', 'vertical', 'thin_linear', 'rough_mixed'], CAST(bucket_b AS INT) + 1) AS y FROM e) SELECT CAST(sum(CASE WHEN NOT (x = y OR x = 'unknown' OR y = 'unknown') THEN 1 ELSE 0 END) AS BIGINT) AS same_or_unknown, CAST(sum(CASE WHEN x <> y THEN 1 ELSE 0 END) AS BIGINT) AS same, CAST(sum(CASE WHEN NOT (x = y OR color <= 50) THEN 1 ELSE 0 END) AS BIGINT) AS same_or_color, CAST(sum(CASE WHEN (x = 'rough_mixed' OR y = 'rough_mixed') AND x <> y THEN 1 ELSE 0 END) AS BIGINT) AS no_rough, CAST(sum(CASE WHEN (x = 'horizontal' AND y = 'vertical') OR (x = 'vertical' AND y = 'horizontal') THEN 1 ELSE 0 END) AS BIGINT) AS veto FROM n"
)
def bucket_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, patches.BUCKETS))
    rows = table(spark, sf_dir, "part").select(F.element_at(names, (F.col("p_size") % 5 + 1).cast("int")).alias("x"), F.element_at(names, (F.col("p_partkey") * 7 % 5 + 1).cast("int")).alias("y"), (F.col("p_size") * 3).alias("color"))
    total = lambda c: F.sum(c.cast("long"))
    modes = ("same_or_unknown", "same", "same_or_color", "no_rough")
    return rows.agg(*[total(patches.bucket_veto(m, F.col("x"), F.col("y"), F.col("color"), 50)).alias(m) for m in modes], total(patches.merge_veto(F.col("x"), F.col("y"))).alias("veto"))

