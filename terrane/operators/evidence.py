"""Votes, evidence fusion, unaries, bounds over views and one-hop inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.scoring import color_affinity, lower_bound


def one_view_one_unit(rows: DataFrame, view: list[str], least: int) -> DataFrame:
    """Votes (object_id, label, weight, views) in which each view of an object has the weight min(1, rows / least), split by label share."""
    parts = rows.groupBy("object_id", *view, "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("object_id", *view))
    weighed = parts.withColumn("w", F.least(F.lit(1.0), total / float(least)) * F.col("n") / total)
    return weighed.groupBy("object_id", "label").agg(F.sum("w").alias("weight"), F.count("*").alias("views"))


def fused(sources: list[tuple[DataFrame, float]], allowed: DataFrame, kinds: DataFrame, least_total: float = 3.0, threshold: float = 0.58, backed_threshold: float = 0.52, backing: int = -1) -> DataFrame:
    """Decision for each object from several vote tables (object_id, label, weight), each with its own weight.

    `kinds` has (object_id, kind), `allowed` (kind, label): votes for other labels are vetoed. The winner
    is the heaviest allowed label, of equals the first by name. Status: kept_original below `least_total`,
    promoted at a share of `threshold`, or `backed_threshold` where the source `backing` votes for the
    winner too, else ambiguous.
    """
    votes = None
    for k, (table, weight) in enumerate(sources):
        part = table.select("object_id", "label", (F.col("weight") * weight).alias("w"), F.lit(k).alias("source"))
        votes = part if votes is None else votes.unionByName(part)
    backing = backing % len(sources)
    marked = votes.join(kinds, "object_id").join(allowed.withColumn("ok", F.lit(True)), ["kind", "label"], "left")
    by_label = marked.groupBy("object_id", "label").agg(F.sum("w").alias("w"), F.first("ok").isNotNull().alias("ok"), F.max((F.col("source") == backing) & (F.col("w") > 0)).alias("backed"))
    by_name = by_label.withColumn("__n", F.row_number().over(Window.partitionBy("object_id").orderBy("label")))
    order = F.when(F.col("ok"), F.struct(F.col("w"), -F.col("__n")))
    out = by_name.groupBy("object_id").agg(
        F.max_by("label", order).alias("label"),
        F.max(F.when(F.col("ok"), F.col("w"))).alias("best"),
        F.max_by("backed", order).alias("backed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("w"))), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("w"))), F.lit(0.0)).alias("vetoed"),
    )
    ratio = F.coalesce(F.col("best") / F.greatest(F.col("total"), F.lit(1e-9)), F.lit(0.0))
    needed = F.when(F.col("backed"), backed_threshold).otherwise(threshold)
    status = F.when(F.col("total") < least_total, "kept_original").when(ratio >= needed, "promoted").otherwise("ambiguous")
    return out.select("object_id", "label", "total", "vetoed", ratio.alias("ratio"), status.alias("status"))


def transferred(votes: DataFrame, least_votes: float, strong: float, weak: float) -> DataFrame:
    """Teacher transfer (object_id, label, votes, ratio, decision): transfer at `strong`, review at `weak`, else keep; too few votes keep too."""
    ranked = votes.withColumn("__n", F.row_number().over(Window.partitionBy("object_id").orderBy("label")))
    out = ranked.groupBy("object_id").agg(F.max_by("label", F.struct(F.col("weight"), -F.col("__n"))).alias("label"), F.sum("weight").alias("votes"), (F.max("weight") / F.greatest(F.sum("weight"), F.lit(1.0))).alias("ratio"))
    return out.withColumn("decision", F.when(F.col("votes") < least_votes, "keep").when(F.col("ratio") >= strong, "transfer").when(F.col("ratio") >= weak, "review").otherwise("keep"))


def unaries(seen: DataFrame, reviews: DataFrame, floor: float = 0.9) -> DataFrame:
    """State and support of each object from weighted observations (object_id, weight) and reviews (object_id, confidence).

    The effective number of views is (sum of weights) squared over the sum of squares, the support its
    log1p. States: reviewed (support at least `floor`), observed_unlabeled, unobserved.
    """
    found = seen.groupBy("object_id").agg(F.count("*").alias("views"), (F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight"))).alias("effective"))
    both = found.join(reviews, "object_id", "full")
    support = F.coalesce(F.log1p("effective"), F.lit(0.0))
    state = F.when(F.col("confidence").isNotNull(), "reviewed").when(F.col("views") > 0, "observed_unlabeled").otherwise("unobserved")
    return both.select("object_id", F.coalesce("views", F.lit(0)).alias("views"), F.when(state == "reviewed", F.greatest(support, F.lit(floor))).otherwise(support).alias("support"), state.alias("state"))


def contrast_bounds(rows: DataFrame, keys: list[str], value: str, least_views: int, sigma: float) -> DataFrame:
    """Lower confidence bound of a contrast over views and the affinity that it leaves; 1 for too few views."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("views"), lower_bound(F.col(value), least_views).alias("bound"))
    return out.withColumn("affinity", F.when(F.col("views") >= least_views, color_affinity(F.col("bound"), sigma)).otherwise(1.0))


def one_hop(edges: DataFrame, alpha: DataFrame, pairwise: float) -> DataFrame:
    """Posterior (object_id, label, p): own weight plus `pairwise` times affinity times the neighbours' own shares, normalised.

    `alpha` has (object_id, label, weight), `edges` (a, b, affinity). One step only, so neighbours' sums
    never feed back.
    """
    share = alpha.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("object_id")))
    both = edges.select("a", "b", "affinity").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "affinity"))
    sent = both.join(share.select(F.col("object_id").alias("b"), "label", "share"), "b").select(F.col("a").alias("object_id"), "label", (pairwise * F.col("affinity") * F.col("share")).alias("w"))
    summed = share.select("object_id", "label", F.col("share").alias("w")).unionByName(sent).groupBy("object_id", "label").agg(F.sum("w").alias("w"))
    return summed.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("object_id"))).select("object_id", "label", "p")


def ledger(evidence: DataFrame, objects: DataFrame, reviews: DataFrame, provenance: DataFrame) -> DataFrame:
    """Every observation with its object, review and provenance, defaults where there is none."""
    joined = evidence.join(objects, "object_id", "left").join(reviews, "object_id", "left").join(provenance, "object_id", "left")
    return joined.fillna({"kind": "unknown", "decision": "unreviewed", "frames": 0})


def top_views(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in a total order, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)


def exclusive(pixels: DataFrame, pixel: list[str]) -> DataFrame:
    """Pixels with the mask that owns each: the best score, of equals the first mask."""
    return pixels.groupBy(*pixel).agg(F.max_by("mask", F.struct(F.col("score"), -F.col("mask"))).alias("mask"))


def scene_votes(objects: DataFrame, scenes: DataFrame) -> DataFrame:
    """Votes of scenes for objects by the frames that they share: objects (object_id, frame), scenes (first, last, label, weight)."""
    spread = scenes.withColumn("frame", F.explode(F.sequence("first", "last")))
    return objects.join(spread, "frame").groupBy("object_id", "label").agg(F.sum("weight").alias("weight"), F.count("*").alias("frames"))


def pooled(features: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector of each key, scaled to length 1 (zero stays zero)."""
    parts = features.select(key, F.posexplode(vector).alias("at", "v")).groupBy(key, "at").agg(F.avg("v").alias("v"))
    sorted_values = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"])
    size = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, v: a + v * v))
    return parts.groupBy(key).agg(sorted_values.alias("mean")).withColumn("pooled", F.when(size > 0, F.transform("mean", lambda v: v / size)).otherwise(F.col("mean")))


def cosine(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def vote_maps(weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, votes): the weights (keys, label, weight) of each key as one map by label; null labels and weights count as none, repeated labels add up."""
    summed = weights.filter("label is not null and weight is not null").groupBy(*keys, "label").agg(F.sum("weight").alias("weight"))
    return summed.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "weight")))).alias("votes"))
