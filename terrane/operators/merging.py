"""Merging patches: small ones into anchors by rounds of size, overlapping ones by samples that merge with them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.geometry import box_gap
from terrane.functions.scoring import unit
from terrane.operators.graph import Sets, by_component
from terrane.operators.lineage import Scratch
from terrane.operators.patches import BUCKETS

#: Likeness of two geometry types that differ: with unknown, loose ones, and of a surface with a loose one.
UNKNOWN, LOOSE, HORIZONTAL, VERTICAL, OTHER = 0.65, 0.75, 0.45, 0.35, 0.05
#: Weights of color, geometry, normals, contact and gap in the gain of an absorption, and what a surface of another type takes off.
GAIN, GUARD = (0.34, 0.24, 0.16, 0.18, 0.08), 0.18
#: Weights of color, geometry, normals, nearness, median distance and balance of a merge, and of what speaks for staying apart.
COHESION, SEPARATE = (0.28, 0.18, 0.12, 0.24, 0.12, 0.06), (0.34, 0.20, 0.16, 0.12, 0.08, 0.10)
#: Columns of patches: name, cells, centre, mean color, mean normal, box and cells of each bucket.
PATCH = ("patch", "n", *"xyz", *"rgb", "nx", "ny", "nz", *(f"{c}{k}" for c in "xyz" for k in "01"), "buckets")


def geometry_of(buckets: Column, share: float = 0.65) -> Column:
    """The bucket that holds `share` of a patch's cells (an array by bucket), of equals the first, else mixed; unknown without cells."""
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + b)
    most = F.array_max(buckets)
    name = F.element_at(F.array(*map(F.lit, BUCKETS)), F.array_position(buckets, most).cast("int"))
    return F.when(total <= 0, "unknown").when(most >= share * total, name).otherwise("mixed")


def type_likeness(a: Column, b: Column) -> Column:
    """How well two geometry types go together: 1 if equal, else by the first case that holds."""
    either = lambda x, y: (a.isin(*x) & b.isin(*y)) | (b.isin(*x) & a.isin(*y))
    loose = ("rough_mixed", "thin_linear")
    return (
        F.when(a == b, 1.0)
        .when((a == "unknown") | (b == "unknown"), UNKNOWN)
        .when(either(loose, loose), LOOSE)
        .when(either(("horizontal",), loose), HORIZONTAL)
        .when(either(("vertical",), loose), VERTICAL)
        .otherwise(OTHER)
    )


def normal_likeness(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The cosine of two directions without their signs, a half if one has no length."""
    size = lambda v: F.sqrt(sum((c * c for c in v), F.lit(0.0)))
    dot = sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0))
    return F.when((size(a) < 1e-9) | (size(b) < 1e-9), 0.5).otherwise(unit(F.abs(dot / (size(a) * size(b)))))


def of(side: str, *names: str) -> list[Column]:
    return [F.col(f"{side}_{n}") for n in names]


def absorption_gain(shared: Column, most_color: float, most_gap: float) -> Column:
    """What the small patch (columns s_) gains by the anchor (a_) that it shares `shared` faces with."""
    color = F.sqrt(sum(((p - q) * (p - q) for p, q in zip(of("s", *"rgb"), of("a", *"rgb"), strict=True)), F.lit(0.0)))
    small, anchor = geometry_of(F.col("s_buckets")), geometry_of(F.col("a_buckets"))
    terms = (
        unit(1 - color / most_color), type_likeness(small, anchor), normal_likeness(of("s", "nx", "ny", "nz"), of("a", "nx", "ny", "nz")),
        F.least(F.lit(1.0), shared / F.greatest(F.col("s_n"), F.lit(1))), unit(1 - box_gap("s_", "a_") / most_gap),
    )
    other = anchor.isin("horizontal", "vertical") & (small != anchor) & (small != "unknown")
    return sum((w * t for w, t in zip(GAIN, terms, strict=True)), F.lit(0.0)) - F.when(other, GUARD).otherwise(0.0)


def absorbed(patches: DataFrame, edges: DataFrame, small: int = 8, anchor: int = 64, least: float = 0.66, most_color: float = 120.0, most_gap: float = 0.35) -> DataFrame:
    """(patch, owner, gain): patches of fewer than `small` cells go to the anchor, of `anchor` cells or more, of highest gain if it reaches `least`.

    Patches are as in PATCH, edges (a, b, shared) by their first names. Small patches come by size, those of one size at
    the same time: each takes the best anchor that it touches, itself or by a patch that was absorbed before, of
    equals the least, and then the anchors' statistics take in all that came. So `small` - 1 rounds do whatever the
    number of patches; one patch after another gives the same where no two of one size touch each other or one anchor.
    Each round is joins by patch and sums; others keep themselves, with a null gain.
    """
    scratch = Scratch(patches.sparkSession, "absorbed")
    stats, stats_path = scratch.keep(patches.select(*PATCH))
    owners, owners_path = scratch.keep(patches.select("patch", F.col("patch").alias("owner"), F.lit(None).cast("double").alias("gain")))
    both, _ = scratch.keep(edges.select("a", "b", "shared").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")))
    sizes = sorted(r["n"] for r in stats.filter((F.col("n") < small)).select("n").distinct().collect())
    for size in sizes:
        held = owners.select(F.col("patch").alias("b"), "owner")
        touched = both.join(stats.filter(F.col("n") == size).select(F.col("patch").alias("a")), "a").join(held, "b").filter("owner <> a").groupBy("a", "owner").agg(F.max("shared").alias("shared"))
        sides = [stats.select(*[F.col(c).alias(f"{s}_{c}") for c in PATCH]) for s in "sa"]
        pairs = touched.join(sides[0], F.col("a") == F.col("s_patch")).join(sides[1].filter(F.col("a_n") >= anchor), F.col("owner") == F.col("a_patch"))
        scored = pairs.select("a", "owner", absorption_gain(F.col("shared"), most_color, most_gap).alias("gain")).filter(F.col("gain") >= least)
        best = scored.groupBy("a").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "owner")).alias("best")).select("a", F.col("best.owner").alias("to"), (-F.col("best.loss")).alias("won"))
        moved, _ = scratch.keep(best)
        after, after_path = scratch.keep(_taken_in(stats, moved))
        named = owners.join(moved, F.col("patch") == F.col("a"), "left").select("patch", F.coalesce("to", "owner").alias("owner"), F.coalesce("won", "gain").alias("gain"))
        renamed, renamed_path = scratch.keep(named)
        for old in (stats_path, owners_path):
            scratch.drop(old)
        stats, stats_path, owners, owners_path = after, after_path, renamed, renamed_path
    return owners


def _taken_in(stats: DataFrame, moved: DataFrame) -> DataFrame:
    """Statistics of owners once patches (a, to) have moved: means weigh by cells, normals have length 1 again where anything came."""
    named = stats.join(moved.select("a", "to"), F.col("patch") == F.col("a"), "left").withColumns({"owner": F.coalesce("to", "patch"), "came": F.col("to").isNotNull()})
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    kept = lambda c: F.when(F.max("came"), mean(c)).otherwise(F.max(c)).alias(c)
    ends = [(F.min if k == "0" else F.max)(f"{c}{k}").alias(f"{c}{k}") for c in "xyz" for k in "01"]
    counts = F.array(*[F.sum(F.element_at("buckets", k + 1)) for k in range(len(BUCKETS))]).alias("buckets")
    out = named.groupBy(F.col("owner").alias("patch")).agg(F.sum("n").alias("n"), *[kept(c) for c in (*"xyzrgb", "nx", "ny", "nz")], *ends, counts, F.max("came").alias("came"))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    turned = F.when(F.col("came") & (size > 1e-9), size).otherwise(1.0)
    return out.withColumns({c: F.col(c) / turned for c in ("nx", "ny", "nz")}).select(*PATCH)


def samples(cells: DataFrame, k: int) -> DataFrame:
    """(patch, held): of each patch the `k` cells (node, x, y, z) of least hash, as (h, x, y, z) in order of it; two samples' `k` least are the sample of both patches."""
    hashed = cells.select("patch", F.xxhash64("node").alias("h"), "x", "y", "z")
    first = hashed.withColumn("nth", F.row_number().over(Window.partitionBy("patch").orderBy("h"))).filter(F.col("nth") <= k)
    return first.groupBy("patch").agg(F.sort_array(F.collect_list(F.struct("h", "x", "y", "z"))).alias("held"))


@dataclass(frozen=True)
class Overlap:
    """What boxes must share, how near samples must be, and what a merge must score."""

    cells: int = 128
    share: float = 0.72
    iou: float = 0.08
    centre: float = 8.0
    long_cells: int = 100_000
    long_aspect: float = 2.5
    long_share: float = 0.80
    long_iou: float = 0.12
    near: float = 0.35
    near_share: float = 0.35
    median: float = 0.45
    sample: int = 256
    color: float = 95.0
    mismatch: float = 0.06
    score: float = 0.50
    gain: float = 0.02


def overlap_candidates(pairs: DataFrame, rules: Overlap) -> DataFrame:
    """(a, b, share, iou) of box pairs (neighbours.box_pairs of PATCH) that overlap enough and whose centres are near, or that are long enough to lie far."""
    volume = lambda s: F.greatest(F.col(f"{s}_x1") - F.col(f"{s}_x0"), F.lit(1e-3)) * F.greatest(F.col(f"{s}_y1") - F.col(f"{s}_y0"), F.lit(1e-3)) * F.greatest(F.col(f"{s}_z1") - F.col(f"{s}_z0"), F.lit(1e-3))
    aspect = lambda s: F.greatest(*[F.greatest(F.col(f"{s}_{c}1") - F.col(f"{s}_{c}0"), F.lit(1e-3)) for c in "xyz"]) / F.least(*[F.greatest(F.col(f"{s}_{c}1") - F.col(f"{s}_{c}0"), F.lit(1e-3)) for c in "xyz"])
    share = F.col("shared") / F.least(volume("a"), volume("b"))
    iou = F.col("shared") / (volume("a") + volume("b") - F.col("shared"))
    centre = F.sqrt(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in "xyz"), F.lit(0.0)))
    smaller = F.least("a_n", "b_n")
    long = (smaller >= rules.long_cells) & (share >= rules.long_share) & (iou >= rules.long_iou) & (F.greatest(aspect("a"), aspect("b")) >= rules.long_aspect)
    gates = (F.col("shared") > 0) & (smaller >= rules.cells) & (share >= rules.share) & (iou >= rules.iou) & ((centre <= rules.centre) | long)
    return pairs.filter(gates).select(F.col("a_patch").alias("a"), F.col("b_patch").alias("b"), share.alias("share"), iou.alias("iou"))


def nearness(a: np.ndarray, b: np.ndarray, within: float) -> tuple[float, float]:
    """(share, median): of two samples of places the mean share with another one of the other side within the distance, and the lesser of the median distances."""
    apart = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    there, back = apart.min(axis=1), apart.min(axis=0)
    return float((there <= within).mean() + (back <= within).mean()) / 2, float(min(np.median(there), np.median(back)))


class Whole:
    """A patch of the fold: means, buckets and the sample, which merge."""

    def __init__(self, row):
        self.n, self.mean = row.n, np.array([row.red, row.green, row.blue, row.nx, row.ny, row.nz])
        self.buckets, self.sample = np.array(row.buckets), sorted((s["h"], s["x"], s["y"], s["z"]) for s in row.held)

    @property
    def geometry(self) -> str:
        total = self.buckets.sum()
        return "unknown" if not total else BUCKETS[int(self.buckets.argmax())] if self.buckets.max() >= 0.65 * total else "mixed"

    def take(self, other: Whole, k: int) -> None:
        self.mean = (self.mean * self.n + other.mean * other.n) / (self.n + other.n)
        size = np.linalg.norm(self.mean[3:])
        self.mean[3:] /= size if size > 1e-9 else 1.0
        self.n, self.buckets, self.sample = self.n + other.n, self.buckets + other.buckets, sorted(self.sample + other.sample)[:k]


#: Pairs of surfaces and loose types whose merge is charged.
MISMATCHED = ({"horizontal", "vertical"}, {"vertical", "rough_mixed"}, {"horizontal", "rough_mixed"})


def plain_type_likeness(a: str, b: str) -> float:
    loose = {"rough_mixed", "thin_linear"}
    if a == b:
        return 1.0
    if "unknown" in (a, b):
        return UNKNOWN
    if {a, b} <= loose:
        return LOOSE
    surface = next((v for name, v in (("horizontal", HORIZONTAL), ("vertical", VERTICAL)) if name in (a, b) and {a, b} & loose), OTHER)
    return surface


def decided(a: Whole, b: Whole, share: float, rules: Overlap) -> tuple[bool, str, float]:
    """(merges, reason, gain) of two patches whose boxes share `share` of the smaller one."""
    held = lambda x: max(0.0, min(1.0, x))
    near, median = nearness(np.array(a.sample)[:, 1:], np.array(b.sample)[:, 1:], rules.near)
    color = held(1 - float(np.linalg.norm(a.mean[:3] - b.mean[:3])) / rules.color)
    sizes = np.linalg.norm(a.mean[3:]), np.linalg.norm(b.mean[3:])
    normal = 0.5 if min(sizes) < 1e-9 else held(abs(float(a.mean[3:] @ b.mean[3:])) / (sizes[0] * sizes[1]))
    kind = plain_type_likeness(a.geometry, b.geometry)
    close, inner = min(1.0, near / rules.near_share), held(1 - median / rules.median)
    merge = float(np.dot(COHESION, (color, kind, normal, close, inner, min(a.n, b.n) / max(a.n, b.n))))
    gain = merge - float(np.dot(SEPARATE, (close, inner, color, kind, normal, min(1.0, share)))) - (rules.mismatch if {a.geometry, b.geometry} in MISMATCHED else 0.0)
    if near < rules.near_share:
        return False, "near_share", gain
    if median > rules.median:
        return False, "median_distance", gain
    return (True, "merged", gain) if gain >= rules.gain and merge >= rules.score else (False, "score", gain)


def overlap_merges(patches: DataFrame, cells: DataFrame, candidates: DataFrame, rules: Overlap) -> DataFrame:
    """(a, b, owner_a, owner_b, reason, gain): what becomes of each candidate (a, b, share, iou), and who owned its ends then.

    Candidates come by share, then IoU, then names, all from high to low, and are decided on what their ends have become:
    means weigh by cells, and the samples of `cells` (patch, node, x, y, z) merge by their least hashes, so a merged
    patch's sample is the one it would have at first and partitioning changes nothing. The larger patch's name
    stays, of equals the first's. Candidates meet through their ends alone, so components are folded apart; a
    component's samples, at most `sample` cells a patch, are a task's memory.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["a"] == rows["b"]
        wholes, sets, out = {row.a: Whole(row) for row in rows[own].itertuples()}, Sets(), []
        for row in rows[~own].sort_values(["share", "iou", "a", "b"], ascending=False).itertuples():
            p, q = sets.root(row.a), sets.root(row.b)
            if p == q:
                out.append((row.a, row.b, p, q, "same_owner", np.nan))
                continue
            merges, reason, gain = decided(wholes[p], wholes[q], row.share, rules)
            out.append((row.a, row.b, p, q, reason, gain))
            if merges:
                keep, drop = (p, q) if wholes[p].n >= wholes[q].n else (q, p)
                wholes[keep].take(wholes.pop(drop), rules.sample)
                sets.up[drop] = keep
        return pd.DataFrame(out, columns=["a", "b", "owner_a", "owner_b", "reason", "gain"])

    kind = candidates.schema["a"].dataType.simpleString()
    ends = candidates.select(F.col("a").alias("patch")).unionByName(candidates.select(F.col("b").alias("patch"))).distinct()
    # a and b are names of edges' ends
    colors = [F.col(c).alias(n) for c, n in zip("rgb", ("red", "green", "blue"), strict=True)]
    wanted = patches.select("patch", "n", *colors, "nx", "ny", "nz", "buckets").join(ends, "patch")
    whole = wanted.join(samples(cells.join(ends, "patch"), rules.sample), "patch").withColumnRenamed("patch", "node")
    return by_component(candidates.select("a", "b", "share", "iou"), fold, f"a {kind}, b {kind}, owner_a {kind}, owner_b {kind}, reason string, gain double", whole)
