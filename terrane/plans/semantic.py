"""Queries of the patch, evidence, time and decision operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import scoring
from terrane.operators import decisions, evidence, patches, timing, voxels
from terrane.plans.domain import PATCHES, POINTS, VOTES, points, table, views, with_
from terrane.plans.domain import patches as patch_table
from terrane.plans.registry import query
from terrane.plans.spatial import CONTACTS, FACES, KEYS, OWNED, owned


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(with_(POINTS, PATCHES) + "SELECT patch_id, n, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(r, 4) AS r, round(g, 4) AS g, round(b, 4) AS b, x0, x1, y0, y1, z0, z1 FROM patches")
def patch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(patch_table(spark, sf_dir), 6, "x", "y", "z"), 4, "r", "g", "b").select("patch_id", "n", *"xyzrgb", "x0", "x1", "y0", "y1", "z0", "z1")


@query(with_(POINTS) + "SELECT object_id, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, min(x) AS x0, max(y) AS y1, round(sum(x * y), 2) AS sxy FROM points GROUP BY 1")
def patch_stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by object and frame, merged to the objects."""
    whole = patches.merged(patches.sums(points(spark, sf_dir), ["object_id", "frame"]).drop("frame"), ["object_id"])
    return whole.select("object_id", "n", F.round(F.col("sx") / F.col("n"), 6).alias("x"), F.round(F.col("sy") / F.col("n"), 6).alias("y"), "x0", "y1", F.round("sxy", 2).alias("sxy"))


@query(with_(POINTS) + "SELECT object_id, round(var_samp(x) + var_samp(y) + var_samp(z), 4) AS trace, round(var_pop(x) + var_pop(y) + var_pop(z), 4) AS trace_pop FROM points GROUP BY 1 HAVING count(*) > 3")
def patch_shape_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues add up to the variances."""
    stats = patches.sums(points(spark, sf_dir), ["object_id"]).filter("n > 3")
    one, two = patches.shape(stats), patches.shape(stats, population=True)
    trace = lambda df, name: df.select("object_id", F.round(F.col("e1") + F.col("e2") + F.col("e3"), 4).alias(name))
    return trace(one, "trace").join(trace(two, "trace_pop"), "object_id")


@query()
def patch_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = patches.shape(patches.sums(points(spark, sf_dir), ["object_id"]))
    return rounded(stats.select("object_id", "n", "e1", "e2", "e3", "linearity", "planarity", "scattering"), 6, "e1", "e2", "e3", "linearity", "planarity", "scattering")


@query(with_(POINTS) + "SELECT object_id, CASE WHEN max(w) >= 0.6 * sum(w) THEN list_extract(['unknown', 'horizontal', 'vertical', 'thin_linear', 'rough_mixed'], CAST(arg_max(k, w * 10 - k) AS INT) + 1) ELSE 'mixed' END AS geometry, round(max(w) / sum(w), 6) AS share FROM (SELECT object_id, CASE WHEN x < 10 + object_id % 41 THEN object_id % 5 ELSE frame % 5 END AS k, count(*) AS w FROM points GROUP BY 1, 2) GROUP BY 1")
def dominant_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = points(spark, sf_dir).groupBy("object_id", F.when(F.col("x") < 10 + F.col("object_id") % 41, F.col("object_id") % 5).otherwise(F.col("frame") % 5).alias("bucket")).agg(F.count("*").alias("n"))
    return rounded(patches.dominant_geometry(counts, ["object_id"]), 6, "share")


@query(
    with_(POINTS, OWNED, f"faces AS ({FACES})", "single AS (SELECT least(owner, o2) AS a, greatest(owner, o2) AS b, sqrt((r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2) AS color FROM faces WHERE owner <> o2)")
    + "SELECT a, b, count(*) AS shared, round(avg(color), 4) AS color_distance, round(quantile_disc(color, 0.9), 4) AS color_p90 FROM single GROUP BY 1, 2"
)
def contact_edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.operators.neighbours import offset_join, offsets, positive

    cells = owned(spark, sf_dir)
    faces = offset_join(cells, cells, positive(offsets("faces"))).filter("owner <> n_owner")
    color = F.sqrt(sum((F.pow(F.col(c) - F.col(f"n_{c}"), 2) for c in "rgb"), F.lit(0.0)))
    single = faces.select(F.least("owner", "n_owner").alias("a"), F.greatest("owner", "n_owner").alias("b"), color.alias("color"), F.lit(1.0).alias("normal"), F.lit(0.0).alias("roughness"))
    return rounded(patches.edge_features(single).select("a", "b", "shared", "color_distance", "color_p90"), 4, "color_distance", "color_p90")


@query(
    with_(POINTS, OWNED, CONTACTS, "p90 AS (SELECT least(owner, o2) AS a, greatest(owner, o2) AS b, quantile_disc(sqrt((r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2), 0.9) AS q FROM faces WHERE owner <> o2 GROUP BY 1, 2)", "means AS (SELECT owner, avg(r) / 255 AS rough, avg(g) / 255 AS planar, avg(b) / 255 AS linear, avg(iz) / 2 AS up FROM owned GROUP BY 1)")
    + "SELECT a, b, round(0.28 * greatest(0, 1 - color_distance / 120) + 0.16 * greatest(0, 1 - q / 120) + 0.18 * least(1, faces / least(s.n, t.n)) + 0.14 * greatest(0, 1 - abs(m.up - k.up)) + 0.10 * greatest(0, 1 - abs(m.rough - k.rough) / 0.35) + 0.07 * greatest(0, 1 - abs(m.planar - k.planar) / 0.35) + 0.07 * greatest(0, 1 - abs(m.linear - k.linear) / 0.35), 6) AS score, round(exp(-(color_distance * color_distance) / (2 * 35.0 * 35.0)), 6) AS affinity, round(sqrt(least(1, faces / least(s.n, t.n))), 6) AS support FROM contacts JOIN p90 USING (a, b) JOIN sizes s ON s.owner = a JOIN sizes t ON t.owner = b JOIN means m ON m.owner = a JOIN means k ON k.owner = b"
)
def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven terms; brightness and height stand for the shape statistics of the two sides."""
    from terrane.operators.neighbours import contacts, offset_join, offsets, positive

    cells = owned(spark, sf_dir)
    faces = offset_join(cells, cells, positive(offsets("faces"))).filter("owner <> n_owner")
    color = F.sqrt(sum((F.pow(F.col(c) - F.col(f"n_{c}"), 2) for c in "rgb"), F.lit(0.0)))
    single = faces.select(F.least("owner", "n_owner").alias("a"), F.greatest("owner", "n_owner").alias("b"), color.alias("color"))
    p90 = single.groupBy("a", "b").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY color)").alias("color_p90"))
    shape = {"rough": F.avg("r") / 255, "planar": F.avg("g") / 255, "linear": F.avg("b") / 255, "up": F.avg("iz") / 2}
    means = cells.groupBy("owner").agg(*[v.alias(k) for k, v in shape.items()])
    side = lambda s: means.select(F.col("owner").alias(s), *[F.col(k).alias(f"{s}_{k}") for k in shape])
    edges = contacts(cells, "owner").join(p90, ["a", "b"]).join(side("a"), "a").join(side("b"), "b")
    apart = {k: F.abs(F.col(f"a_{k}") - F.col(f"b_{k}")) for k in shape}
    score = scoring.edge_score(F.col("color_distance"), F.col("color_p90"), F.col("contact_ratio"), 1 - apart["up"], apart["rough"], apart["planar"], apart["linear"], 120.0)
    return edges.select("a", "b", F.round(score, 6).alias("score"), F.round(scoring.color_affinity(F.col("color_distance"), 35.0), 6).alias("affinity"), F.round(scoring.contact_support(F.col("contact_ratio")), 6).alias("support"))


@query(
    with_(POINTS, "cells AS (SELECT CAST(floor(x / 2) AS BIGINT) AS ix, CAST(floor(y / 2) AS BIGINT) AS iy, object_id AS o, count(*) / CAST(10 AS DOUBLE) AS score FROM points GROUP BY 1, 2, 3)", "ranked AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next FROM cells WINDOW w AS (PARTITION BY ix, iy ORDER BY score DESC, o))")
    + "SELECT ix, iy, o AS owner, score FROM ranked WHERE place = 1 AND score >= 0.2 AND score - coalesce(next, 0) >= 0.1"
)
def cell_owner_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = points(spark, sf_dir).groupBy(F.floor(F.col("x") / 2).alias("ix"), F.floor(F.col("y") / 2).alias("iy"), F.col("object_id").alias("o")).agg((F.count("*") / 10).alias("score"))
    return patches.best_owner(cells, ["ix", "iy"], "score", "o", 0.1, 0.2)


@query(
    with_(POINTS, "sizes AS (SELECT object_id, CAST(floor(x / 10) AS BIGINT) AS px, count(*) AS n FROM points GROUP BY 1, 2)", "ranked AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY n DESC, px) AS place FROM sizes)")
    + "SELECT object_id, px, n, CAST(place AS INT) AS place, CAST(CASE WHEN place > 1 AND n >= 15 THEN place - 1 ELSE 0 END AS INT) AS part FROM ranked"
)
def split_large_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = points(spark, sf_dir).withColumn("px", F.floor(F.col("x") / 10))
    return patches.split_by_cell(cells, "object_id", ["px"], 15)


@query(with_(VOTES, "w AS (SELECT object_id, label, sum(value) AS weight FROM views GROUP BY 1, 2)") + "SELECT object_id, arg_max(label, weight) AS label, round(max(weight), 4) AS weight, round(sum(weight), 4) AS total, count(*) AS labels, round(max(weight) / greatest(sum(weight), 1e-9), 6) AS share FROM w GROUP BY 1")
def weighted_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = voxels.votes(views(spark, sf_dir), ["object_id"], weight=F.col("value"))
    return rounded(rounded(voxels.dominant(voted, ["object_id"]), 4, "weight", "total"), 6, "share")


@query(
    with_(VOTES, "parts AS (SELECT object_id, view_day, cam, label, count(*) AS n FROM views GROUP BY 1, 2, 3, 4)", "weighed AS (SELECT *, least(1, sum(n) OVER w / 4.0) * n / sum(n) OVER w AS w FROM parts WINDOW w AS (PARTITION BY object_id, view_day, cam))")
    + "SELECT object_id, label, round(sum(w), 6) AS weight, count(*) AS views FROM weighed GROUP BY 1, 2"
)
def one_view_one_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.one_view_one_unit(views(spark, sf_dir), ["view_day", "cam"], 4), 6, "weight")


#: Which labels a kind of object allows.
ALLOWED = [("even", "click"), ("even", "view"), ("even", "purchase"), ("odd", "view"), ("odd", "error"), ("odd", "signup")]
ALLOWED_SQL = "allowed(kind, label) AS (VALUES " + ", ".join(map(str, ALLOWED)) + ")"


@query(
    with_(
        VOTES,
        ALLOWED_SQL,
        "votes AS (SELECT object_id, label, sum(value) * 0.02 AS w, 0 AS source FROM views WHERE cam <> 1 GROUP BY 1, 2 UNION ALL SELECT object_id, label, count(*) * 1.5, 1 FROM views WHERE day(view_day) <= 9 GROUP BY 1, 2)",
        "by_label AS (SELECT object_id, v.label, sum(w) AS w, bool_or(a.label IS NOT NULL) AS ok, max(CASE WHEN source = 1 AND w > 0 THEN 1 ELSE 0 END) AS backed FROM votes v LEFT JOIN allowed a ON a.label = v.label AND a.kind = CASE WHEN object_id % 2 = 0 THEN 'even' ELSE 'odd' END GROUP BY 1, 2)",
        "summed AS (SELECT object_id, first(label ORDER BY w DESC, label) FILTER (ok) AS label, max(w) FILTER (ok) AS best, first(backed ORDER BY w DESC, label) FILTER (ok) AS backed, coalesce(sum(w) FILTER (ok), 0) AS total, coalesce(sum(w) FILTER (NOT ok), 0) AS vetoed FROM by_label GROUP BY 1)",
    )
    + "SELECT object_id, label, round(total, 4) AS total, round(vetoed, 4) AS vetoed, round(coalesce(best / greatest(total, 1e-9), 0), 6) AS ratio, CASE WHEN total < 3 THEN 'kept_original' WHEN coalesce(best / greatest(total, 1e-9), 0) >= CASE WHEN backed = 1 THEN 0.52 ELSE 0.58 END THEN 'promoted' ELSE 'ambiguous' END AS status FROM summed"
)
def evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = views(spark, sf_dir)
    by_value = voxels.votes(seen.filter("cam <> 1"), ["object_id"], weight=F.col("value"))
    by_count = voxels.votes(seen.filter(F.dayofmonth("view_day") <= 9), ["object_id"])
    kinds = seen.select("object_id", F.when(F.col("object_id") % 2 == 0, "even").otherwise("odd").alias("kind")).distinct()
    allowed = spark.createDataFrame(ALLOWED, "kind string, label string")
    return rounded(rounded(evidence.fused([(by_value, 0.02), (by_count, 1.5)], allowed, kinds), 4, "total", "vetoed"), 6, "ratio")


@query(with_(VOTES, "w AS (SELECT object_id, label, CAST(count(*) AS DOUBLE) AS weight FROM views GROUP BY 1, 2)") + "SELECT object_id, first(label ORDER BY weight DESC, label) AS label, sum(weight) AS votes, round(max(weight) / greatest(sum(weight), 1), 6) AS ratio, CASE WHEN sum(weight) < 5 THEN 'keep' WHEN max(weight) / greatest(sum(weight), 1) >= 0.4 THEN 'transfer' WHEN max(weight) / greatest(sum(weight), 1) >= 0.3 THEN 'review' ELSE 'keep' END AS decision FROM w GROUP BY 1")
def teacher_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = voxels.votes(views(spark, sf_dir), ["object_id"])
    return rounded(evidence.transferred(votes, 5.0, 0.4, 0.3), 6, "ratio")


@query(
    with_(VOTES, "seen AS (SELECT object_id, count(*) AS views, log(1 + sum(value) * sum(value) / sum(value * value)) AS _s, ln(1 + sum(value) * sum(value) / sum(value * value)) AS support FROM views WHERE value > 0 GROUP BY 1)", "reviews AS (SELECT doc_id AS object_id, quality AS confidence FROM labels WHERE quality = 1)")
    + "SELECT coalesce(s.object_id, r.object_id) AS object_id, coalesce(views, 0) AS views, round(CASE WHEN confidence IS NOT NULL THEN greatest(coalesce(support, 0), 0.9) ELSE coalesce(support, 0) END, 6) AS support, CASE WHEN confidence IS NOT NULL THEN 'reviewed' WHEN views > 0 THEN 'observed_unlabeled' ELSE 'unobserved' END AS state FROM seen s FULL JOIN reviews r ON s.object_id = r.object_id"
)
def soft_unaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = views(spark, sf_dir).filter("value > 0").select("object_id", F.col("value").alias("weight"))
    reviews = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("object_id"), F.col("quality").alias("confidence"))
    return rounded(evidence.unaries(seen, reviews), 6, "support")


@query(with_(VOTES) + "SELECT object_id, label, count(value) AS views, round(CASE WHEN count(value) >= 3 THEN greatest(0, avg(value) - stddev_pop(value)) ELSE 0 END, 6) AS bound, round(CASE WHEN count(value) >= 3 THEN exp(-(greatest(0, avg(value) - stddev_pop(value)) ** 2) / (2 * 9.0 * 9.0)) ELSE 1 END, 6) AS affinity FROM views GROUP BY 1, 2")
def multiview_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.contrast_bounds(views(spark, sf_dir), ["object_id", "label"], "value", 3, 9.0), 6, "bound", "affinity")


@query(
    with_(
        VOTES,
        "alpha AS (SELECT object_id, label, sum(value) AS weight FROM views GROUP BY 1, 2)",
        "share AS (SELECT object_id, label, weight / sum(weight) OVER (PARTITION BY object_id) AS share FROM alpha)",
        "objects AS (SELECT DISTINCT object_id FROM views)",
        "edges AS (SELECT a.object_id AS a, b.object_id AS b, exp(-(CAST(b.object_id - a.object_id AS DOUBLE) ** 2) / (2 * 4.0 * 4.0)) AS affinity FROM objects a JOIN objects b ON b.object_id - a.object_id IN (1, 2, 3))",
        "both_ AS (SELECT a, b, affinity FROM edges UNION ALL SELECT b, a, affinity FROM edges)",
        "summed AS (SELECT object_id, label, sum(w) AS w FROM (SELECT object_id, label, share AS w FROM share UNION ALL SELECT a, label, 0.35 * affinity * share FROM both_ JOIN share ON share.object_id = b) GROUP BY 1, 2)",
    )
    + "SELECT object_id, label, round(w / sum(w) OVER (PARTITION BY object_id), 6) AS p FROM summed"
)
def one_hop_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = views(spark, sf_dir)
    objects = seen.select("object_id").distinct()
    near = objects.select(F.col("object_id").alias("a"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("gap")).withColumn("b", F.col("a") + F.col("gap"))
    edges = near.join(objects.withColumnRenamed("object_id", "b"), "b").withColumn("affinity", scoring.color_affinity(F.col("gap").cast("double"), 4.0))
    return rounded(evidence.one_hop(edges, voxels.votes(seen, ["object_id"], weight=F.col("value")), 0.35), 6, "p")


@query("SELECT o_orderkey AS evidence_id, o_custkey AS object_id, coalesce(c_mktsegment, 'unknown') AS kind, coalesce(CASE WHEN l.quality = 1 THEN 'accepted' WHEN l.quality = 0 THEN 'rejected' END, 'unreviewed') AS decision, CAST(coalesce(f.frames, 0) AS BIGINT) AS frames FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN labels l ON l.doc_id = o_custkey LEFT JOIN (SELECT user_id, count(*) AS frames FROM events GROUP BY 1) f ON f.user_id = o_custkey")
def observation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("object_id"))
    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), F.col("c_mktsegment").alias("kind"))
    reviews = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("object_id"), F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").alias("decision"))
    frames = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("object_id")).agg(F.count("*").alias("frames"))
    return evidence.ledger(seen, objects, reviews, frames).select("evidence_id", "object_id", "kind", "decision", "frames")


@query(with_(VOTES) + "SELECT object_id, label, event_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY object_id, label ORDER BY cam, value DESC, event_id) AS place FROM views) WHERE place <= 2")
def best_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary views before others, then by value."""
    return evidence.top_views(views(spark, sf_dir), ["object_id", "label"], [F.col("cam"), F.desc("value"), F.col("event_id")], 2).select("object_id", "label", "event_id", "place")


@query(with_(POINTS) + "SELECT frame, CAST(floor(x) AS BIGINT) AS u, CAST(floor(y) AS BIGINT) AS v, arg_max(object_id, z * 1e9 - object_id) AS mask FROM points GROUP BY 1, 2, 3")
def exclusive_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = points(spark, sf_dir).select("frame", F.floor("x").alias("u"), F.floor("y").alias("v"), F.col("object_id").alias("mask"), F.col("z").alias("score"))
    return evidence.exclusive(pixels, ["frame", "u", "v"])


@query(
    with_(POINTS, "seen AS (SELECT DISTINCT object_id, frame FROM points)", "scenes AS (SELECT n_nationkey * 4 AS first, n_nationkey * 4 + 5 AS last, r_name AS label, 1 + n_regionkey / CAST(2 AS DOUBLE) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey)")
    + "SELECT object_id, label, round(sum(weight), 4) AS weight, count(*) AS frames FROM seen JOIN scenes ON frame BETWEEN first AND last GROUP BY 1, 2"
)
def scene_context_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = points(spark, sf_dir).select("object_id", "frame").distinct()
    scenes = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    scenes = scenes.select((F.col("n_nationkey") * 4).alias("first"), (F.col("n_nationkey") * 4 + 5).alias("last"), F.col("r_name").alias("label"), (1 + F.col("n_regionkey") / 2).alias("weight"))
    return rounded(evidence.scene_votes(seen, scenes), 4, "weight")


@query("WITH parts AS (SELECT label, g.at, avg(CAST(embedding[g.at] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS at) g GROUP BY 1, 2) SELECT a.label AS a, b.label AS b, round(sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))), 5) AS cosine FROM parts a JOIN parts b ON a.at = b.at AND a.label < b.label GROUP BY 1, 2")
def pooled_feature_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    means = evidence.pooled(rows, "label", "v")
    a, b = (means.select(F.col("label").alias(s), F.col("pooled").alias(f"v{s}")) for s in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(evidence.cosine("va", "vb"), 5).alias("cosine"))


#: Seconds since the start of 2024.
SECONDS = "(epoch_us(ts) - 1704067200000000) / CAST(1000000 AS DOUBLE)"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / F.lit(1_000_000.0))


@query(
    f"WITH timed AS (SELECT *, {SECONDS} AS t, row_number() OVER () AS k FROM events), met AS (SELECT a.k, a.event_id, a.user_id, b.event_id AS pose_id, abs(a.t - b.t) AS gap, b.t AS bt FROM timed a JOIN timed b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 20000 WHERE a.event_type = 'purchase' AND b.event_type = 'view') SELECT event_id, user_id, first(pose_id ORDER BY gap, bt, pose_id) AS pose_id, round(min(gap), 4) AS gap FROM met GROUP BY k, event_id, user_id"
)
def nearest_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: each purchase with its user's nearest view in time."""
    timed = _timed(spark, sf_dir)
    left = timed.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = timed.filter("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("pose_id"))
    return rounded(timing.nearest_in_time(left, right, ["user_id"], "t", 20000.0, "pose_id").select("event_id", "user_id", "pose_id", "gap"), 4, "gap")


@query(f"WITH timed AS (SELECT event_id, user_id, {SECONDS} AS t FROM events) SELECT event_id, round(t + 1.0 * coalesce(lead(t) OVER w - t, t - lag(t) OVER w, 0), 6) AS shifted FROM timed WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def phase_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.shifted(_timed(spark, sf_dir), ["user_id"], "t", "t", 1.0).select("event_id", F.round("shifted", 6).alias("shifted"))


@query("WITH s AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN step < 0 THEN 1 ELSE 0 END) AS BIGINT) AS backs, round(max(step), 6) AS largest FROM s GROUP BY 1")
def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timing.steps(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.max("backs").cast("long").alias("backs"), F.round(F.max("step"), 6).alias("largest"))


@query(with_(POINTS, "d AS (SELECT DISTINCT object_id, y FROM points)", "m AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY object_id ORDER BY y) > 2 THEN 1 ELSE 0 END AS new FROM d)", "l AS (SELECT *, sum(new) OVER (PARTITION BY object_id ORDER BY y) AS layer FROM m)") + "SELECT object_id, CAST(layer AS BIGINT) AS layer, count(*) AS n, min(y) AS low, max(y) AS high FROM l GROUP BY 1, 2")
def height_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timing.layers(points(spark, sf_dir).select("object_id", "y").distinct(), ["object_id"], "y", 2.0)
    return out.groupBy("object_id", F.col("layer").cast("long").alias("layer")).agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))


@query("WITH f AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT l_suppkey, l_extendedprice - slope * l_quantity - intercept AS off FROM lineitem JOIN f USING (l_suppkey)) SELECT l_suppkey, round(any_value(slope), 3) AS slope, any_value(n) AS n, round(sqrt(avg(off * off)), 3) AS rmse, round(max(abs(off)), 3) AS worst FROM f JOIN o USING (l_suppkey) GROUP BY 1")
def line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = timing.line_fits(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return rounded(fits.select("l_suppkey", "slope", "n", "rmse", "worst"), 3, "slope", "rmse", "worst")


@query("SELECT o_orderkey, coalesce(l.quality, CAST(o_custkey % 50 AS INT)) AS index, CAST(greatest(0, least(999, round_even(o_totalprice / 500, 0))) AS BIGINT) AS frame FROM orders LEFT JOIN labels l ON l.doc_id = o_orderkey")
def frame_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("direct", (F.col("o_custkey") % 50).cast("int"))
    frames = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("o_orderkey"), F.col("quality").alias("video_idx"))
    return timing.mapped_index(rows, frames, ["o_orderkey"], "direct").select("o_orderkey", "index", timing.frame_number(F.col("o_totalprice"), 1 / 500, 1000).alias("frame"))


@query("WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, min(event_id) AS start, count(*) AS length, any_value(event_type) AS event_type FROM r GROUP BY 1, 2")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timing.runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")
    return out.withColumn("run", F.col("run").cast("long"))


@query("SELECT l_suppkey, quantile_cont(l_extendedprice, 0.9) AS linear, quantile_disc(l_extendedprice, 0.9) AS nearest, list_sort(list(l_extendedprice))[CAST(round_even((count(*) - 1) * 0.9, 0) AS BIGINT) + 1] AS indexed FROM lineitem GROUP BY 1")
def percentile_trio(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = "l_extendedprice"
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.expr(f"percentile_cont(0.9) WITHIN GROUP (ORDER BY {price})").alias("linear"),
        F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {price})").alias("nearest"),
        timing.quantile_of_sorted(F.col(price), 0.9).alias("indexed"),
    )


@query(with_(POINTS, PATCHES, "f AS (SELECT patch_id, n < 3 AS tiny, x1 - x0 > 8 AS wide, z1 - z0 > 1.5 AS tall FROM patches)") + "SELECT patch_id, CAST(CASE WHEN tiny THEN 2.0 ELSE 0.0 END + CASE WHEN wide THEN 1.0 ELSE 0.0 END + CASE WHEN tall THEN 0.5 ELSE 0.0 END AS DOUBLE) AS energy, concat_ws(',', CASE WHEN tiny THEN 'tiny' END, CASE WHEN wide THEN 'wide' END, CASE WHEN tall THEN 'tall' END) AS flags FROM f")
def energy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"tiny": F.col("n") < 3, "wide": F.col("x1") - F.col("x0") > 8, "tall": F.col("z1") - F.col("z0") > 1.5}
    return decisions.flagged(patch_table(spark, sf_dir), flags, {"tiny": 2.0, "wide": 1.0, "tall": 0.5}).select("patch_id", "energy", "flags")


@query("WITH p AS (SELECT p_partkey, p_size, p_retailprice, length(p_name) AS name_size FROM part) SELECT a.* FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND b.name_size <= a.name_size AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice OR b.name_size < a.name_size))")
def pareto_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("name_size", F.char_length("p_name").cast("long"))
    return decisions.pareto(rows, "p_partkey", ["p_size", "p_retailprice", "name_size"])


RUNS = "before AS (SELECT o_custkey AS object_id, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), after AS (SELECT o_custkey AS object_id, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return tuple(orders.filter(F.col("o_orderkey") % 3 != k).groupBy(F.col("o_custkey").alias("object_id")).agg(F.count("*").alias("n")) for k in (0, 1))


@query(f"WITH {RUNS} SELECT coalesce(a.object_id, b.object_id) AS object_id, CASE WHEN b.object_id IS NULL THEN 'added' WHEN a.object_id IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS state, coalesce(a.n, 0) - coalesce(b.n, 0) AS n_change FROM after a FULL JOIN before b ON a.object_id = b.object_id")
def run_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.difference(*_runs(spark, sf_dir), "object_id", ["n"])


@query(f"WITH {RUNS} SELECT object_id, 'lost' AS broken FROM before WHERE object_id NOT IN (SELECT object_id FROM after) UNION ALL SELECT object_id, 'new' FROM after WHERE object_id NOT IN (SELECT object_id FROM before)")
def fusion_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.violations(*_runs(spark, sf_dir), "object_id", ["n"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def ready_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return decisions.ready(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def missing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return decisions.missing(table(spark, sf_dir, "part").select("p_partkey"), done, ["p_partkey"])


@query("WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM p WHERE n <= 4 OR i IN (0, CAST(round_even((n - 1) / 3.0, 0) AS BIGINT), CAST(round_even(2 * ((n - 1) / 3.0), 0) AS BIGINT), n - 1)")
def evenly_spaced_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.evenly_spaced(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)


@query("WITH s AS (SELECT p_type, greatest(5, floor(60 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE))) AS share FROM part GROUP BY 1), r AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) SELECT p_type, p_partkey, CAST(place AS INT) AS place FROM r JOIN s USING (p_type) WHERE place <= share")
def coverage_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.stratified(table(spark, sf_dir, "part"), "p_type", [F.desc("p_retailprice"), F.col("p_partkey")], 60, 5).select("p_type", "p_partkey", "place")


@query(with_(POINTS) + "SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(z) AS BIGINT) AS iz, count(DISTINCT object_id) AS owners FROM points GROUP BY 1, 2, 3 HAVING count(DISTINCT object_id) > 1")
def ownership_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.duplicate_owners(voxels.keyed(points(spark, sf_dir), 1.0), KEYS, "object_id")


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("report_orders")
    return spark.sql("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM report_orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")


@query(
    with_(POINTS, OWNED, CONTACTS, "e AS (SELECT a, b, faces / least(s.n, t.n) AS score, (a - b) % 3 = 0 AS same FROM contacts JOIN sizes s ON s.owner = a JOIN sizes t ON t.owner = b)")
    + "SELECT count(*) AS n, CAST(sum(CASE WHEN score >= 0.1 AND same THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN score >= 0.1 AND same THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN score >= 0.1 THEN 1 ELSE 0 END), 1), 6) AS precision, round(sum(CASE WHEN score >= 0.1 AND same THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN same THEN 1 ELSE 0 END), 1), 6) AS recall FROM e"
)
def edge_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.operators.neighbours import contacts

    edges = contacts(owned(spark, sf_dir), "owner")
    truth = edges.select("a", "b", ((F.col("a") - F.col("b")) % 3 == 0).alias("same"))
    return rounded(decisions.holdout(edges, truth, "contact_ratio", 0.1), 6, "precision", "recall")


BUCKET = "list_extract(['unknown', 'horizontal', 'vertical', 'thin_linear', 'rough_mixed', 'mixed'], CAST({} % 6 AS INT) + 1)"


@query(
    with_(POINTS, OWNED, CONTACTS, f"k AS (SELECT a, b, {BUCKET.format('a')} AS p, {BUCKET.format('b')} AS q FROM contacts)", "s AS (SELECT a, b, CASE WHEN p = q THEN 1 WHEN p = 'unknown' OR q = 'unknown' THEN 0.62 WHEN p IN ('rough_mixed', 'thin_linear', 'mixed') AND q IN ('rough_mixed', 'thin_linear', 'mixed') THEN 0.78 WHEN (p IN ('horizontal', 'vertical') AND q = 'rough_mixed') OR (q IN ('horizontal', 'vertical') AND p = 'rough_mixed') THEN 0.56 ELSE 0.09 END AS likeness FROM k)")
    + "SELECT a, b, CAST(likeness AS DOUBLE) AS likeness FROM s"
)
def bucket_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the buckets of owners in contact go together."""
    from terrane.operators.neighbours import contacts

    names = F.array(*map(F.lit, (*patches.BUCKETS, "mixed")))
    named = lambda c: F.element_at(names, (F.col(c) % 6 + 1).cast("int"))
    return contacts(owned(spark, sf_dir), "owner").select("a", "b", scoring.bucket_likeness(named("a"), named("b")).alias("likeness"))


@query(
    with_(POINTS, OWNED, CONTACTS, "held AS (SELECT owner, count(*) AS n, count(*) FILTER (ix % 3 = 0 AND owner % 2 = 0 OR iy % 3 = 0 AND owner % 5 = 0) AS flat, count(*) FILTER (ix % 3 = 1 AND owner % 2 = 1) AS steep FROM owned GROUP BY 1)")
    + "SELECT a, b, least(p.n, q.n) >= 8 AND ((p.flat / p.n >= 0.3 AND q.steep / q.n >= 0.3) OR (p.steep / p.n >= 0.3 AND q.flat / q.n >= 0.3)) AS vetoed FROM contacts JOIN held p ON p.owner = a JOIN held q ON q.owner = b"
)
def structural_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners in contact that are kept apart as a horizontal and a vertical surface, by shares of their cells."""
    from terrane.operators.neighbours import contacts

    cells = owned(spark, sf_dir)
    flat = ((F.col("ix") % 3 == 0) & (F.col("owner") % 2 == 0)) | ((F.col("iy") % 3 == 0) & (F.col("owner") % 5 == 0))
    steep = (F.col("ix") % 3 == 1) & (F.col("owner") % 2 == 1)
    counts = F.array(F.count("*") - F.count_if(flat) - F.count_if(steep), F.count_if(flat), F.count_if(steep))
    held = cells.groupBy("owner").agg(F.count("*").alias("n"), counts.alias("counts"))
    side = lambda s: held.select(F.col("owner").alias(s), F.col("n").alias(f"{s}_n"), F.col("counts").alias(f"{s}_counts"))
    both = contacts(cells, "owner").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", scoring.structural_veto(F.col("a_counts"), F.col("b_counts"), F.col("a_n"), F.col("b_n"), 0.3, 8).alias("vetoed"))


@query(with_(VOTES) + "SELECT object_id, label, round(w, 6) AS weight, round(w / sum(w) OVER (PARTITION BY object_id), 6) AS share FROM (SELECT object_id, label, sum(value) AS w FROM views GROUP BY 1, 2)")
def vote_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of each object as a map, taken apart again into rows with their shares."""
    weights = views(spark, sf_dir).groupBy("object_id", "label").agg(F.sum("value").alias("weight"))
    maps = evidence.vote_maps(weights, ["object_id"])
    total = F.aggregate(F.map_values("votes"), F.lit(0.0), lambda x, y: x + y)
    each = maps.select("object_id", total.alias("total"), F.explode("votes").alias("label", "weight"))
    return each.select("object_id", "label", F.round("weight", 6).alias("weight"), F.round(F.col("weight") / F.col("total"), 6).alias("share"))
