"""Queries of merged patches and of time models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import merging, neighbours, timing, voxels
from terrane.operators.patches import BUCKETS
from terrane.plans.domain import POINTS, table, with_
from terrane.plans.registry import query
from terrane.plans.spatial import owned


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with a patch: one of twelve groups of owners in a square of 5, whose geometry follows the group or, for some, the column."""
    cells = owned(spark, sf_dir)
    group = F.col("owner") % 12
    patch = (group * 1000 + F.floor(F.col("ix") / 5)) * 1000 + F.floor(F.col("iy") / 5)
    bucket = F.when(F.col("ix") % 4 == 0, F.col("iy") % 5).otherwise(group % 5)
    return cells.select("ix", "iy", "iz", "r", "g", "b", patch.alias("patch"), bucket.cast("int").alias("bucket"), voxels.packed_key(1000, 1000).alias("node"), *[F.col(f"i{c}").cast("double").alias(c) for c in "xyz"])


def patches(cells: DataFrame) -> DataFrame:
    ends = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]
    counts = F.array(*[F.sum((F.col("bucket") == k).cast("long")) for k in range(len(BUCKETS))]).alias("buckets")
    normal = {"nx": F.lit(0.6), "ny": F.lit(0.0), "nz": F.when(F.col("patch") % 2 == 0, 0.8).otherwise(-0.8)}
    return cells.groupBy("patch").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyzrgb"], *ends, counts).withColumns(normal).select(*merging.PATCH)


@query()
def small_patch_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small patches and the anchors that take them in, by rounds of size."""
    cells = celled(spark, sf_dir)
    edges = neighbours.contacts(cells, "patch").select("a", "b", F.col("faces").alias("shared"))
    found = merging.absorbed(patches(cells), edges, small=5, anchor=12, least=0.55, most_gap=1.5)
    return found.withColumn("gain", F.round("gain", 6))


@query()
def overlap_merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of patches whose boxes overlap, decided by samples of their cells."""
    cells = celled(spark, sf_dir)
    rules = merging.Overlap(cells=4, share=0.5, near=1.5, median=2.5, sample=64, color=160.0)
    whole = patches(cells)
    pairs = neighbours.box_pairs(whole, "patch", 0.0, 5.0)
    found = merging.overlap_merges(whole, cells, merging.overlap_candidates(pairs, rules), rules)
    return found.withColumn("gain", F.round("gain", 6))


#: Probes: an event's frame and camera, with candidates around two per frame, a time apart from it and a few that are far off.
PROBES = """c0 AS (SELECT event_id % 700 AS frame_id, user_id % 3 AS cam_id, least(1499, greatest(0, 2 * (event_id % 700) + event_id % 5 - 2 + CASE WHEN event_id % 50 = 0 THEN 400 ELSE 0 END)) AS video_idx, value AS score FROM events),
cand AS (SELECT frame_id, cam_id, video_idx, max(score) AS score FROM c0 GROUP BY 1, 2, 3)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, event = F.col("event_id") % 700, F.col("event_id")
    index = 2 * frame + event % 5 - 2 + F.when(event % 50 == 0, 400).otherwise(0)
    named = table(spark, sf_dir, "events").select(frame.alias("frame_id"), (F.col("user_id") % 3).alias("cam_id"), F.least(F.lit(1499), F.greatest(F.lit(0), index)).cast("long").alias("video_idx"), F.col("value").alias("score"))
    return named.groupBy("frame_id", "cam_id", "video_idx").agg(F.max("score").alias("score"))


FITS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id, cam_id ORDER BY score DESC, video_idx) AS rank, max(score) OVER (PARTITION BY frame_id, cam_id) AS top FROM cand),
best AS (SELECT * FROM ranked WHERE rank = 1),
l1 AS (SELECT cam_id, coalesce(regr_slope(video_idx, frame_id), 1) AS s, avg(video_idx) - coalesce(regr_slope(video_idx, frame_id), 1) * avg(frame_id) AS i FROM best GROUP BY 1),
off AS (SELECT b.*, abs(video_idx - s * frame_id - i) AS off FROM best b JOIN l1 USING (cam_id)),
lim AS (SELECT cam_id, greatest(1.0::DOUBLE, 3 * quantile_cont(off, 0.5)) AS lim FROM off GROUP BY 1),
l2 AS (SELECT cam_id, coalesce(regr_slope(video_idx, frame_id), 1) AS s, avg(video_idx) - coalesce(regr_slope(video_idx, frame_id), 1) * avg(frame_id) AS i FROM off JOIN lim USING (cam_id) WHERE off <= lim GROUP BY 1),
pose AS (SELECT DISTINCT frame_id, frame_id * 0.1::DOUBLE + CASE WHEN frame_id > 350 THEN 5 ELSE 0 END AS ts FROM cand),
span AS (SELECT first(ts ORDER BY frame_id) AS t0, last(ts ORDER BY frame_id) AS t1 FROM pose),
raw AS (SELECT frame_id, cam_id, unnest(['direct', 'rate', 'compressed', 'affine']) AS model, unnest([CAST(frame_id AS DOUBLE), (ts - t0) * 10, (ts - t0) / greatest(t1 - t0, 1e-9) * 1499, s * frame_id + i]) AS v FROM (SELECT DISTINCT frame_id, cam_id FROM cand) JOIN pose USING (frame_id) JOIN l2 USING (cam_id), span),
pred AS (SELECT frame_id, cam_id, model, CAST(greatest(0, least(1499, round_even(v, 0))) AS BIGINT) AS predicted FROM raw),
judged AS (SELECT frame_id, cam_id, model, predicted, min(abs(video_idx - predicted)) AS distance, first(rank ORDER BY abs(video_idx - predicted), rank) AS rank, first(top - score ORDER BY abs(video_idx - predicted), rank) AS loss FROM pred JOIN ranked USING (frame_id, cam_id) GROUP BY 1, 2, 3, 4)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    poses = rows.select("frame_id").distinct().withColumn("ts", F.col("frame_id") * F.lit(0.1) + F.when(F.col("frame_id") > 350, 5).otherwise(0))
    return timing.time_models(rows, poses, 1500)


@query(with_(PROBES, FITS) + "SELECT frame_id, cam_id, model, predicted, distance, CAST(rank AS INT) AS rank, round(loss, 6) AS loss, distance = 0 AS exact FROM judged")
def time_model_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each time model comes to the candidates of each probe."""
    return judged(spark, sf_dir).withColumn("loss", F.round("loss", 6))


@query(
    with_(PROBES, FITS, "sums AS (SELECT cam_id, model, quantile_cont(distance, 0.5) AS median, avg(CASE WHEN distance = 0 THEN 1 ELSE 0 END) AS exact FROM judged GROUP BY 1, 2)")
    + "SELECT cam_id, model, round(median, 6) AS median, round(exact, 6) AS exact FROM sums QUALIFY row_number() OVER (PARTITION BY cam_id ORDER BY CASE WHEN median <= 4 AND exact >= 0.05 THEN 0 WHEN model = 'direct' THEN 1 ELSE 2 END, median, list_position(['direct', 'rate', 'compressed', 'affine'], model)) = 1"
)
def chosen_time_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time model of each camera that passes the gates with the least median distance."""
    found = timing.chosen_models(judged(spark, sf_dir), 4.0, 0.05)
    return found.withColumns({c: F.round(c, 6) for c in ("median", "exact")})


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with the shape of their points, in the patches of celled()."""
    from terrane.plans.domain import points

    looks = voxels.keyed(points(spark, sf_dir), 1.0).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"), F.stddev_pop("r").alias("deviation"), (F.max("z") - F.min("z")).alias("rise"))
    shape = {"roughness": (F.col("n") % 10) / 25, "planarity": (F.col("ix") % 7) / 6, "linearity": (F.col("iy") % 5) / 8, "nx": (F.col("iy") % 3 - 1) * 0.4, "ny": F.lit(0.0), "nz": F.when(F.col("bucket") == 2, 0.1).otherwise(1.0)}
    return celled(spark, sf_dir).join(looks, ["ix", "iy", "iz"]).withColumns({k: v.cast("double") for k, v in shape.items()})


@query()
def patch_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells judged by the models of the patches that they touch by a face, met from the cell there."""
    from terrane.operators import membership

    cells = shaped(spark, sf_dir).select("ix", "iy", "iz", "node", "patch", *membership.CELL)
    met = neighbours.offset_join(cells, cells, neighbours.offsets("faces")).filter("patch <> n_patch")
    named = met.select(F.col("node"), F.col("n_node").alias("source"), F.col("n_patch").alias("to"), *[F.col(c).alias(f"c_{c}") for c in membership.CELL], *[F.col(f"n_{c}").alias(f"s_{c}") for c in membership.CELL])
    pairs = named.join(membership.models(cells).withColumnRenamed("patch", "to"), "to")
    found = membership.judged(pairs, membership.Limits(height=1.0, plane=1.0), source=True)
    return found.select("node", "source", "to", "ok", F.round("score", 6).alias("score"), "reason")


CELLED = """counted AS (SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(z) AS BIGINT) AS iz, object_id, count(*) AS w FROM points GROUP BY 1, 2, 3, 4),
owned AS (SELECT ix, iy, iz, first(object_id ORDER BY w DESC, object_id) AS owner FROM counted GROUP BY 1, 2, 3),
vox AS (SELECT ix // 2 AS cx, iy // 2 AS cy, iz // 2 AS cz, ((owner % 12) * 1000 + ix // 5) * 1000 + iy // 5 AS patch FROM owned),
sizes AS (SELECT patch, count(*) AS n FROM vox GROUP BY 1), cells AS (SELECT cx, cy, cz, patch, count(*) AS voxels FROM vox GROUP BY 1, 2, 3, 4)"""


@query(
    with_(POINTS, CELLED, "stable AS (SELECT * FROM sizes WHERE patch % 3 = 0 AND n >= 6)", "touched AS (SELECT p.patch AS a, q.patch AS b, CAST(sum(q.voxels) AS BIGINT) AS contact FROM cells p JOIN stable USING (patch), range(-1, 2) x(a), range(-1, 2) y(b), range(-1, 2) z(c) JOIN cells q ON q.cx = p.cx + x.a AND q.cy = p.cy + y.b AND q.cz = p.cz + z.c WHERE p.patch <> q.patch GROUP BY 1, 2)")
    + """, fresh AS (SELECT t.*, s.n AS na, u.n AS nb, row_number() OVER (PARTITION BY a ORDER BY contact DESC, b) AS nth FROM touched t JOIN sizes s ON s.patch = a JOIN sizes u ON u.patch = b LEFT JOIN stable v ON v.patch = b
WHERE a <> b + 1 AND b <> a + 1 AND u.n <= 40 AND (v.patch IS NULL OR s.n > u.n OR (s.n = u.n AND a < b))) SELECT a, b, contact, round(least(1.0, contact / greatest(least(na, nb), 1)), 6) AS support FROM fresh WHERE nth <= 4"""
)
def fragment_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments around stable patches that no edge joins to them yet, at most four for each."""
    from terrane.operators import matching

    cells = celled(spark, sf_dir).select("patch", *[F.floor(F.col(k) / 2).alias(k) for k in ("ix", "iy", "iz")])
    sizes = cells.groupBy("patch").agg(F.count("*").alias("n"))
    # squares beside each other stand for those that an edge joins already
    known = sizes.select(F.col("patch").alias("a"), (F.col("patch") + 1).alias("b"))
    found = matching.fragment_candidates(cells, sizes, known, F.col("patch") % 3 == 0, F.col("b_n") <= 40, 6, 4)
    return found.withColumn("support", F.round("support", 6))


@query()
def surface_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each label's points by planes and connectivity, with their labels."""
    from terrane.operators import planes
    from terrane.plans.domain import points

    rules = planes.Rules(planes=3, distance=0.06, least=60, rest=20, cell=3.0, piece=10)
    rows = points(spark, sf_dir).withColumn("kind", F.concat_ws("-", "label", F.col("cam")))
    return planes.surfaces(rows, "kind", "label", rules)
