"""Queries of the graph, fold, text and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import scoring
from terrane.operators import graph, neighbours, text, tracks, voxels
from terrane.plans.domain import POINTS, VOTES, points, table, views, with_
from terrane.plans.registry import query
from terrane.plans.spatial import CONTACTS, KEYS, OWNED, owned
from terrane.streaming import votes


def _bought_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from the least part of each order's lines of one supplier to its others there."""
    lines = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_orderkey"), (F.col("l_suppkey") % 10).alias("dock")]
    first = lines.groupBy(*keys).agg(F.min("l_partkey").alias("a"))
    return lines.select(*keys, F.col("l_partkey").alias("b")).join(first, ["l_orderkey", "dock"]).filter("a < b").select("a", "b").distinct()


@query(
    "WITH RECURSIVE first AS (SELECT l_orderkey, l_suppkey % 10 AS dock, min(l_partkey) AS a FROM lineitem GROUP BY 1, 2), half AS (SELECT DISTINCT a, l_partkey AS b FROM lineitem l JOIN first f ON f.l_orderkey = l.l_orderkey AND f.dock = l.l_suppkey % 10 WHERE a < l_partkey), e AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half), r(a, b) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS node, min(b) AS component FROM r GROUP BY 1"
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return graph.components(_bought_together(spark, sf_dir), nodes)


@query()
def voxel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each label's voxels by all 26 neighbours, small ones residual."""
    marks = voxels.keyed(points(spark, sf_dir), 1.0).select(*KEYS, "label").distinct().withColumn("node", F.xxhash64(*KEYS, "label"))
    both = neighbours.offset_join(marks, marks, neighbours.positive(neighbours.offsets("cube"))).filter("label = n_label")
    edges = both.select(F.col("node").alias("a"), F.col("n_node").alias("b"))
    return graph.sized(graph.components(edges, marks.select("node")), 5).groupBy("piece").agg(F.count("*").alias("cells"))


@query(
    "WITH RECURSIVE " + ", ".join((POINTS, OWNED))
    + ", named AS (SELECT *, (iz * 1000 + iy) * 1000 + ix AS node FROM owned), half AS (SELECT p.node AS a, q.node AS b FROM named p, range(-1, 2) x(a), range(-1, 2) y(b), range(-1, 2) z(c) JOIN named q ON q.ix = p.ix + x.a AND q.iy = p.iy + y.b AND q.iz = p.iz + z.c AND q.owner = p.owner WHERE p.node <> q.node AND sqrt((p.r - q.r) ** 2 + (p.g - q.g) ** 2 + (p.b - q.b) ** 2) <= 120)"
    + ", r(a, b) AS (SELECT node, node FROM named UNION SELECT r.a, h.b FROM r JOIN half h ON h.a = r.b), c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY 1), sizes AS (SELECT owner AS patch, component, count(*) AS cells FROM named JOIN c USING (node) GROUP BY 1, 2)"
    + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY cells DESC, component) AS place FROM sizes) SELECT patch, CAST(CASE WHEN place > 1 AND cells >= 2 THEN place - 1 ELSE 0 END AS INT) AS part, CAST(sum(cells) AS BIGINT) AS cells FROM ranked GROUP BY 1, 2"
)
def patch_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose voxels fall apart, neighbours being cells of near color that touch in any of 26 ways."""
    cells = owned(spark, sf_dir).withColumn("node", voxels.packed_key(1000, 1000))
    both = neighbours.offset_join(cells, cells, neighbours.positive(neighbours.offsets("cube"))).filter("owner = n_owner")
    color = F.sqrt(sum((F.pow(F.col(c) - F.col(f"n_{c}"), 2) for c in "rgb"), F.lit(0.0)))
    edges = both.filter(color <= 120).select(F.col("node").alias("a"), F.col("n_node").alias("b"))
    return graph.split_inside(cells.withColumnRenamed("owner", "patch"), edges, "patch", 2).groupBy("patch", "part").agg(F.count("*").alias("cells"))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = owned(spark, sf_dir)
    edges = neighbours.contacts(cells, "owner")
    score = F.round(0.5 * (1 - F.col("color_distance") / 442) + 0.5 * F.least(F.lit(1.0), F.col("contact_ratio")), 6)
    return edges.select("a", "b", score.alias("score"), F.col("faces").alias("shared")), cells.groupBy(F.col("owner").alias("node")).agg(F.count("*").alias("size"))


@query()
def superpoint_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of cells in contact, clustered with every gate; a cell's bucket follows its owner or, for some, its column."""
    cells = owned(spark, sf_dir)
    contact = neighbours.contacts(cells, "owner")
    score = F.round(0.6 * (1 - F.col("color_distance") / 442) + 0.4 * F.least(F.lit(1.0), F.col("contact_ratio")), 6)
    none = F.lit(None).cast("double")
    edges = contact.select("a", "b", score.alias("score"), F.col("faces").alias("shared"), F.col("contact_ratio").alias("support"), F.col("color_distance").alias("color"), F.col("color_distance").alias("color_p90"), none.alias("normal"), F.lit(0.0).alias("gap"), F.col("faces").cast("double").alias("contacts"))
    bucket = F.when(F.col("ix") % 4 > 0, F.col("owner") % 5).otherwise(F.col("ix") % 5)
    counts = F.array(*[F.count_if(F.col("bucket") == k) for k in range(5)])
    nodes = cells.withColumn("bucket", bucket).groupBy(F.col("owner").alias("node")).agg(F.count("*").alias("size"), counts.alias("counts"))
    limits = graph.Gates(least_score=0.7, k=4.0, most_entropy=1.8, veto_share=0.4, contact_support=0.02, contact_color=90.0, contact_p90=90.0, fragment_contacts=2.0, fragment_color=90.0, fragment_size=40, surface_size=10)
    return graph.superpoints(edges, nodes, limits)


@query()
def greedy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, sizes = _scored(spark, sf_dir)
    return graph.greedy_union(edges.filter("score >= 0.4"), sizes, 3.0, 0.4)


@query()
def anchor_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, sizes = _scored(spark, sf_dir)
    anchors = sizes.filter("node % 7 = 0").select("node", F.concat(F.lit("k"), F.col("node") % 3).alias("label"), F.lit(1.0).alias("score"))
    return graph.propagated(edges.select("a", "b", F.col("score").alias("weight")), anchors, 2, 0.05)


@query()
def region_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of voxels of like height, from the flattest seeds."""
    cells = voxels.downsample(points(spark, sf_dir), 1.0).withColumn("node", voxels.packed_key(1000, 1000))
    edges = neighbours.grid_edges(cells, "node").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graph.grown(edges, cells.select("node", (-F.col("n")).alias("rank"), F.round("z", 6).alias("value")), 0.4)


@query(
    with_(POINTS, OWNED, CONTACTS)
    + ", e AS (SELECT a, b FROM contacts UNION SELECT b, a FROM contacts), free AS (SELECT owner AS node, CAST(n AS DOUBLE) AS weight, owner % 4 AS region FROM sizes WHERE owner % 5 <> 0), one AS (SELECT e.a AS node, sum(weight) AS one FROM e JOIN free ON free.node = e.b GROUP BY 1), two AS (SELECT e.a AS node, sum(one) AS two FROM e JOIN one ON one.node = e.b GROUP BY 1)"
    + ", gained AS (SELECT region, node, weight + coalesce(one, 0) + 0.5::DOUBLE * coalesce(two, 0) AS gain FROM free LEFT JOIN one USING (node) LEFT JOIN two USING (node)) SELECT region, node, gain, CAST(row_number() OVER (PARTITION BY region ORDER BY gain DESC, node) AS INT) AS place FROM gained QUALIFY place <= 3"
)
def uncovered_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, sizes = _scored(spark, sf_dir)
    nodes = sizes.select("node", F.col("size").cast("double").alias("weight"), (F.col("node") % 4).alias("region"))
    return graph.seeds_by_uncovered(edges, nodes, nodes.filter("node % 5 = 0").select("node"), ["region"], 3)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events")
    hours = ((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / F.lit(3_600_000_000)).cast("long")
    return seen.select(
        F.col("event_id").alias("target_id"), F.col("event_type").alias("label"), F.when(F.col("event_type").isin("click", "view"), "look").otherwise("act").alias("family"), hours.alias("frame"),
        F.col("value").alias("x"), (F.col("user_id") % 10).cast("double").alias("y"), F.lit(0.0).alias("z"), F.get_json_object("props", "$.k").cast("double").alias("color"), F.lit(1).alias("points"),
    )


@query()
def tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.tracklets(_targets(spark, sf_dir), 15, 2.0, 45.0)


@query()
def target_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    return tracks.finished(tracks.fused_objects(targets, 100, 1, 1.5, 70.0), targets)


@query()
def sync_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    candidates = lines.groupBy((F.col("l_suppkey") % 3).alias("cam_id"), (F.col("l_orderkey") % 97).alias("frame_id"), (F.col("l_partkey") % 300).alias("video_idx")).agg(F.max("l_discount").alias("score"))
    return tracks.sync_paths(candidates, 100.0, 1000.0, 2.0, 3.0)


@query()
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    overlaps = lines.groupBy((F.col("l_orderkey") % 97).alias("image"), (F.col("l_suppkey") % 20).alias("left"), (F.col("l_partkey") % 20).alias("right")).agg(F.round(F.avg("l_discount") * 10, 6).alias("iou"))
    return tracks.greedy_matches(overlaps, "image", 0.5)


@query()
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    boxes = pts.select(F.col("frame").cast("long").alias("image"), F.col("point_id").alias("box"), F.col("z").alias("score"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 4).alias("x1"), (F.col("y") + 4).alias("y1"))
    return tracks.suppressed(boxes, 0.3)


@query()
def plane_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.plane_splits(points(spark, sf_dir), "object_id", 2, 0.1, 6, 30).groupBy("object_id", "plane").agg(F.count("*").alias("points"))


TOKENS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda w: w NOT IN ('a', 'an', 'and', 'in', 'of', 'on', 'the', 'to', 'with'))))"


@query(
    f"WITH t AS (SELECT p_partkey AS id, {TOKENS.format('p_name || chr(32) || p_type || chr(32) || p_brand')} AS w FROM part), m AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM t a JOIN t b ON a.id < b.id) SELECT a, b, round(i / u, 6) AS likeness FROM m WHERE i / u >= 0.9"
)
def identity_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of parts that are alike, those of equal tokens too."""
    parts = table(spark, sf_dir, "part").withColumn("text", F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return text.all_pairs(parts, "p_partkey", "text", 0.9).withColumn("likeness", F.round("likeness", 6))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'widget|gear') THEN 'machine' WHEN regexp_matches(lower(p_name), 'bolt|ring') THEN 'small' ELSE lower(p_type) END AS label FROM part")
def keyword_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.relabel(F.col("p_name"), [("widget|gear", "machine"), ("bolt|ring", "small")], F.lower("p_type")).alias("label"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), -1.0) AS coerced FROM events")
def response_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.response_field(F.concat(F.lit("so: "), "props", F.lit(" end")), "k").cast("long").alias("k"), scoring.number(F.col("event_type"), -1.0).alias("coerced"))


@query("SELECT p_partkey, CASE WHEN low = 'economy' THEN 'floor' WHEN low IN ('small', 'promo') THEN low WHEN contains(low, 'large') THEN 'large' ELSE 'unknown' END AS label FROM (SELECT p_partkey, lower(trim(p_type)) AS low FROM part)")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scoring.label_of(F.col("p_type"), {"economy": "floor"}, ["small", "promo", "large"]).alias("label"))


@query("WITH m AS (SELECT (c_custkey * 2654435761 + 7) % 4294967296 AS v, c_custkey FROM customer) SELECT c_custkey, CAST(v & 255 AS INT) AS r, CAST((v >> 8) & 255 AS INT) AS g, CAST((v >> 16) & 255 AS INT) AS b FROM m")
def stable_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = scoring.stable_color(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT o_orderkey AS id, coalesce(CASE WHEN l.toxic = 1 THEN 'bad' WHEN l.toxic = 0 THEN 'good' END, 'other') AS label FROM orders LEFT JOIN labels l ON l.doc_id = o_orderkey")
def completed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "bad").when(F.col("toxic") == 0, "good").alias("label"))
    return text.completed(found, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", "label", True)


@query(with_(VOTES) + "SELECT date_trunc('day', ts) AS start, label, count(*) AS n, round(sum(value), 4) AS weight FROM views WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM views) GROUP BY 1, 2")
def streaming_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the watermark, an hour behind the last event, has closed."""
    seen = votes.arriving(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"), "value")
    out = votes.drained(spark, votes.windowed_votes(seen, "1 hour", "1 day"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "label", "n", F.round("weight", 4).alias("weight"))


@query(
    with_(VOTES, "g AS (SELECT object_id, epoch_us(ts) / 1000000.0 AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY object_id ORDER BY ts) <= 36000000000 THEN 0 ELSE 1 END AS new FROM views)", "n AS (SELECT object_id, sum(new) OVER (PARTITION BY object_id ORDER BY t) AS track FROM g)", "c AS (SELECT object_id, track, count(*) AS length FROM n GROUP BY 1, 2)")
    + "SELECT object_id, CAST(max(track) AS BIGINT) AS track, arg_max(length, track) AS length FROM c GROUP BY 1"
)
def streaming_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's last track after all its events, a track ending after ten hours of silence."""
    seen = votes.arriving(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("object_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)).alias("t"))
    out = votes.drained(spark, votes.running_tracks(seen, 36_000.0))
    return out.groupBy("object_id").agg(F.max("track").alias("track"), F.max_by("length", "track").alias("length"))


@query(with_(VOTES) + "SELECT label, count(*) AS n FROM views GROUP BY 1")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query()
def long_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    rows = tracks.tracklets(targets, 15, 2.0, 45.0).join(targets, "target_id")
    whole = rows.groupBy("tracklet", "label").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), *[F.avg(c).alias(c) for c in ("x", "y", "z", "color")])
    return tracks.associated(whole, 1, 120, [("near", 0.5, 20.0, -2.0), ("like", 1.0, 45.0, -1.0), ("far", 2.0, 60.0, 0.0)])


@query()
def image_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the pieces that each label's points make in each frame."""
    pixels = points(spark, sf_dir).select(F.col("point_id").alias("node"), "frame", "label", F.floor("x").alias("u"), F.floor("y").alias("v"), "z")
    pieces = graph.image_components(pixels, ["frame", "label"], 2, 0.5, 3)
    return pieces.groupBy("piece").agg(F.count("*").alias("points"))


@query(
    "WITH b AS (SELECT l_suppkey, CAST(floor(l_quantity / 2) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), d AS (SELECT *, CASE WHEN coalesce(bin - lag(bin) OVER w, 2) > 1 THEN 1 ELSE 0 END AS new FROM b WHERE n >= 2 WINDOW w AS (PARTITION BY l_suppkey ORDER BY bin)), g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY bin) AS k FROM d), f AS (SELECT l_suppkey, bin, min(bin) OVER (PARTITION BY l_suppkey, k) AS band FROM g) SELECT l.l_suppkey, f.band, count(*) AS rows FROM lineitem l LEFT JOIN f ON f.l_suppkey = l.l_suppkey AND f.bin = CAST(floor(l.l_quantity / 2) AS BIGINT) GROUP BY 1, 2"
)
def height_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.operators import timing

    out = timing.bands(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 2.0, 2)
    return out.groupBy("l_suppkey", "band").agg(F.count("*").alias("rows"))


@query("SELECT s_suppkey, concat_ws(',', CASE WHEN NOT s_acctbal >= 0 THEN 'balance' END, CASE WHEN NOT coalesce(n >= 50, false) THEN 'lines' END) AS failed, s_acctbal >= 0 AND coalesce(n >= 50, false) AS promoted FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.operators import decisions

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "supplier").join(lines, "s_suppkey", "left")
    return decisions.gated(rows, {"balance": F.col("s_acctbal") >= 0, "lines": F.col("n") >= 50}).select("s_suppkey", "failed", "promoted")
