"""Whether cells belong to patches: a patch's model of means and prototypes, three regimes of scores, reasons of refusal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.scoring import unit

#: Columns of cells: place, color, normal, shape of the neighbourhood, deviation of color, rise and bucket (0 to 4, see patches.BUCKETS).
CELL = (*"xyz", *"rgb", "nx", "ny", "nz", "roughness", "planarity", "linearity", "deviation", "rise", "bucket")
UNKNOWN, HORIZONTAL, VERTICAL, THIN, ROUGH = range(5)
#: Prototypes of a patch at most, how near one is that a cell joins, and the plane distance and angle within which a surface's cell joins one.
PROTOTYPES, JOIN_DISTANCE, JOIN_PLANE, JOIN_ANGLE = 24, 0.34, 0.18, 42.0
#: Cells of a patch, those of least hash, from which prototypes are made.
SAMPLE = 256
#: Spans over which differences of color deviation, roughness, planarity, linearity and rise lose all likeness.
SPANS = {"deviation": 85.0, "roughness": 0.24, "planarity": 0.50, "linearity": 0.50, "rise": 0.28}
#: Likeness of buckets that differ: with unknown, of rough and a surface, of others.
BUCKET_UNKNOWN, BUCKET_ROUGH, BUCKET_OTHER = 0.72, 0.55, 0.15
#: Weights of each regime's likenesses.
REGIMES = {
    "surface": {"chart_plane": 0.26, "chart_normal": 0.22, "texture": 0.17, "chart": 0.13, "bucket": 0.12, "shape": 0.07, "chart_height": 0.03},
    "bridge": {"texture": 0.52, "shape": 0.18, "chart": 0.12, "bucket": 0.10, "chart_height": 0.08},
    "rough": {"texture": 0.36, "shape": 0.29, "prototype": 0.18, "height": 0.04, "bucket": 0.14, "normal": 0.03, "plane": 0.03},
    "object": {"texture": 0.30, "shape": 0.27, "prototype": 0.12, "height": 0.12, "bucket": 0.12, "normal": 0.06, "plane": 0.10},
}


@dataclass(frozen=True)
class Limits:
    color: float = 150.0
    height: float = 0.30
    angle: float = 120.0
    plane: float = 0.26
    stable_share: float = 0.72
    plane_factor: float = 2.4
    height_factor: float = 2.4
    scale: float = 0.54
    bridges: bool = True
    bridge_texture: float = 0.62
    bridge_shape: float = 0.24
    bridge_prototype: float = 0.48
    color_factor: float = 1.85
    texture_step: float = 64.0
    roughness_step: float = 0.34
    surface: float = 0.50
    bridge: float = 0.56
    rough: float = 0.44
    object: float = 0.48


def norm(v: list[Column]) -> Column:
    return F.sqrt(sum((c * c for c in v), F.lit(0.0)))


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0))


def upright(v: list[Column]) -> list[Column]:
    """The direction of a vector, upward if it has none."""
    size = norm(v)
    return [F.when(size < 1e-9, d).otherwise(c / size) for c, d in zip(v, (0.0, 0.0, 1.0), strict=True)]


def turn(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two directions without their signs; 0 if one has no length."""
    sizes = norm(a), norm(b)
    cosine = F.least(F.lit(1.0), F.abs(dot(a, b) / (sizes[0] * sizes[1])))
    return F.when((sizes[0] < 1e-9) | (sizes[1] < 1e-9), 0.0).otherwise(F.degrees(F.acos(cosine)))


def signature(cell: str) -> Column:
    """What a cell looks like, whatever its place: color, shape, deviation and rise, and how level it lies."""
    c = lambda n: F.col(f"{cell}{n}").cast("double")
    return F.array(c("r") / 255, c("g") / 255, c("b") / 255, c("roughness"), c("planarity"), c("linearity"), F.least(c("deviation") / 128, F.lit(1.5)), F.least(c("rise") / 0.55, F.lit(1.5)), F.abs(c("nz")))


def unlike(a: Column, b: Column) -> Column:
    """The distance of two signatures: 0.46 of color, 0.42 of shape and 0.12 of level."""
    part = lambda low, high: F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in range(low, high)), F.lit(0.0)))
    return 0.46 * part(0, 3) + 0.42 * part(3, 8) + 0.12 * F.abs(a[8] - b[8])


def prototypes_of(cells: pd.DataFrame) -> list[tuple]:
    """(signature, x, y, z, nx, ny, nz) of the prototypes that cells make one after another.

    A cell joins the nearest prototype, whose means it moves, if that is near enough; on a patch that begins as a
    surface it must also lie in its plane and face its way. Else it is a new one, until there are PROTOTYPES.
    """
    looks, places, ways, counts = np.zeros((0, 9)), np.zeros((0, 3)), np.zeros((0, 3)), []
    flat = int(cells["bucket"].iloc[0]) in (HORIZONTAL, VERTICAL)
    for look, place, way in zip(np.stack(cells["signature"].to_numpy()), cells[["x", "y", "z"]].to_numpy(float), cells[["nx", "ny", "nz"]].to_numpy(float), strict=True):
        size = np.linalg.norm(way)
        way = way / size if size >= 1e-9 else np.array([0.0, 0.0, 1.0])
        if counts:
            apart = np.abs(looks - look)
            away = 0.46 * np.linalg.norm(apart[:, :3], axis=1) + 0.42 * np.linalg.norm(apart[:, 3:8], axis=1) + 0.12 * apart[:, 8]
            plane = np.abs(((place - places) * ways).sum(axis=1))
            angle = np.degrees(np.arccos(np.clip(np.abs(ways @ way), 0, 1)))
            if flat:
                away = away + 0.35 * np.minimum(plane / JOIN_PLANE, 2) + 0.20 * np.minimum(angle / JOIN_ANGLE, 2)
            k = int(away.argmin())
            if (away[k] <= JOIN_DISTANCE and (not flat or (plane[k] <= JOIN_PLANE and angle[k] <= JOIN_ANGLE))) or len(counts) >= PROTOTYPES:
                share = 1 / (counts[k] + 1)
                looks[k] += share * (look - looks[k])
                places[k] += share * (place - places[k])
                ways[k] += share * ((way if ways[k] @ way >= 0 else -way) - ways[k])
                ways[k] /= max(np.linalg.norm(ways[k]), 1e-9)
                counts[k] += 1
                continue
        looks, places, ways = np.vstack((looks, look)), np.vstack((places, place)), np.vstack((ways, way))
        counts.append(1)
    return [(look.tolist(), *place.tolist(), *way.tolist()) for look, place, way in zip(looks, places, ways, strict=True)]


def models(cells: DataFrame) -> DataFrame:
    """A row for each patch of cells (node, patch, and CELL): size, means, buckets and prototypes, under names that begin with m_.

    Normals are turned to the side of the cell of least hash before they are added. Prototypes come from the SAMPLE cells of
    least hash in that order, so a model is the same however cells are partitioned, and no task holds a patch.
    """
    hashed = cells.withColumn("h", F.xxhash64("node"))
    first = hashed.groupBy("patch").agg(F.min_by(F.struct("nx", "ny", "nz"), F.struct("h", "node")).alias("way"))
    way = [F.col(f"way.{c}") for c in ("nx", "ny", "nz")]
    own = upright([F.col(c) for c in ("nx", "ny", "nz")])
    side = F.when(dot(own, way) < 0, -1.0).otherwise(1.0)
    turned = hashed.join(first, "patch").withColumns({f"t{c}": v * side for c, v in zip("xyz", own, strict=True)})
    means = [F.avg(c).alias(f"m_{c}") for c in (*"xyzrgb", "roughness", "planarity", "linearity", "deviation", "rise")]
    counts = F.array(*[F.sum((F.col("bucket") == k).cast("long")) for k in range(5)]).alias("m_buckets")
    sums = turned.groupBy("patch").agg(F.count("*").alias("m_n"), *means, *[F.sum(f"t{c}").alias(f"s{c}") for c in "xyz"], counts)
    normal = upright([F.col(f"s{c}") for c in "xyz"])
    sums = sums.withColumns({f"m_n{c}": v for c, v in zip("xyz", normal, strict=True)}).drop("sx", "sy", "sz")
    nth = F.row_number().over(Window.partitionBy("patch").orderBy("h", "node"))
    sample = hashed.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE).select("patch", "nth", signature("").alias("signature"), *"xyz", "nx", "ny", "nz", "bucket")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        found = [dict(zip(("look", "x", "y", "z", "nx", "ny", "nz"), p, strict=True)) for p in prototypes_of(rows)]
        return pd.DataFrame({"patch": [rows["patch"].iloc[0]], "m_prototypes": [found]})

    kind = cells.schema["patch"].dataType.simpleString()
    made = sample.groupBy("patch").applyInPandas(fold, f"patch {kind}, m_prototypes array<struct<look:array<double>,x:double,y:double,z:double,nx:double,ny:double,nz:double>>")
    return sums.join(made, "patch")


def chart(prototypes: Column, cell: str, limits: Limits) -> Column:
    """The prototype nearest to a cell by look, plane and angle: (combined, look, plane, angle, height)."""
    c = [F.col(f"{cell}{n}") for n in ("x", "y", "z", "nx", "ny", "nz")]

    def met(p: Column) -> Column:
        look = unlike(signature(cell), p["look"])
        plane = F.abs(dot([a - p[n] for a, n in zip(c[:3], "xyz", strict=True)], [p["nx"], p["ny"], p["nz"]]))
        angle = turn([p["nx"], p["ny"], p["nz"]], c[3:])
        combined = look + 0.28 * F.least(plane / JOIN_PLANE, F.lit(2.0)) + 0.12 * F.least(angle / JOIN_ANGLE, F.lit(2.0))
        return F.struct(combined.alias("combined"), unit(1 - look / limits.scale).alias("look"), plane.alias("plane"), angle.alias("angle"), F.abs(c[2] - p["z"]).alias("height"))

    return F.array_min(F.transform(prototypes, met))


def bucket_likeness(a: Column, b: Column) -> Column:
    rough = lambda x, y: (x == ROUGH) & y.isin(HORIZONTAL, VERTICAL)
    return F.when(a == b, 1.0).when((a == UNKNOWN) | (b == UNKNOWN), BUCKET_UNKNOWN).when(rough(a, b) | rough(b, a), BUCKET_ROUGH).otherwise(BUCKET_OTHER)


def judged(pairs: DataFrame, limits: Limits | None = None, source: bool = False) -> DataFrame:
    """`pairs` of a model (m_), a cell (c_) and, if `source`, the cell of the patch that it is met from (s_), with ok, score and reason.

    A patch most of whose cells are of one surface takes cells of its bucket, or others that look like it by the bridge
    rules; a rough one and one of objects have weights of their own. A surface's cell that fails the patch's means is
    measured by the nearest prototype, or by its source, instead. The first refusal that holds is the reason; else
    the regime's likenesses, weighed, must reach its threshold.
    """
    limits = limits or Limits()
    m, c = (lambda n, p=p: F.col(f"{p}{n}") for p in ("m_", "c_"))
    most = F.array_max("m_buckets")
    out = pairs.withColumns({"top": (F.array_position("m_buckets", most) - 1).cast("int"), "share": most / F.greatest(m("n"), F.lit(1))})
    normal = [m("nx"), m("ny"), m("nz")]
    away = [c(n) - m(n) for n in "xyz"]
    steps = {n: F.abs(m(n) - c(n)) for n in SPANS}
    measured = {"paint": norm([m(n) - c(n) for n in "rgb"]), "turned": turn(normal, [c("nx"), c("ny"), c("nz")]), "dz": F.abs(away[2]), "off": F.abs(dot(away, normal))} | {f"d_{n}": v for n, v in steps.items()}
    out = out.withColumns(measured)
    like = {n: unit(1 - F.col(f"d_{n}") / span) for n, span in SPANS.items()}
    nearest = F.array_min(F.transform("m_prototypes", lambda p: unlike(signature("c_"), p["look"])))
    flat = F.col("top").isin(HORIZONTAL, VERTICAL)
    protos = F.col("m_prototypes")
    if source:
        way = upright([F.col("s_nx"), F.col("s_ny"), F.col("s_nz")])
        own = F.struct(signature("s_").alias("look"), *[F.col(f"s_{n}").cast("double").alias(n) for n in "xyz"], *[v.alias(n) for v, n in zip(way, ("nx", "ny", "nz"), strict=True)])
        protos = F.when((F.col("s_bucket") == F.col("top")) | (F.col("s_bucket") == UNKNOWN), F.concat(protos, F.array(own))).otherwise(protos)
    likes = {
        "texture": 0.62 * unit(1 - F.col("paint") / limits.color) + 0.38 * like["deviation"],
        "shape": 0.38 * like["roughness"] + 0.24 * like["linearity"] + 0.24 * like["planarity"] + 0.14 * like["rise"],
        "height": unit(1 - F.col("dz") / (limits.height * 2.8)), "bucket": bucket_likeness(F.col("top"), c("bucket")),
        "normal": unit(1 - F.col("turned") / (limits.angle * 1.8)), "plane": unit(1 - F.col("off") / (limits.plane * 2.5)),
        "prototype": F.coalesce(unit(1 - nearest / limits.scale), F.lit(0.0)),
    }
    out = out.withColumns({f"l_{n}": v for n, v in likes.items()} | {"stable": flat & (F.col("share") >= limits.stable_share), "map": chart(protos, "c_", limits)})
    bridge = F.col("stable") & F.lit(limits.bridges) & c("bucket").isin(ROUGH, UNKNOWN, THIN) & (F.col("l_texture") >= limits.bridge_texture) & ((F.col("l_shape") >= limits.bridge_shape) | (F.col("l_prototype") >= limits.bridge_prototype))
    steepest, thickest, highest = min(limits.angle * 1.7, 88.0), limits.plane * limits.plane_factor, limits.height * limits.height_factor
    level = F.col("top") == HORIZONTAL
    fails = (F.col("turned") > steepest) | (F.col("off") > thickest) | (level & (F.col("dz") > highest))
    out = out.withColumn("bridge", bridge).withColumn("charted", F.col("stable") & fails & ~F.col("bridge"))
    by_chart = lambda chart_, mean: F.when(F.col("charted"), chart_).otherwise(F.col(mean))
    out = out.withColumns({
        "l_chart": by_chart(F.col("map.look"), "l_prototype"), "l_chart_plane": by_chart(unit(1 - F.col("map.plane") / (limits.plane * 2.5)), "l_plane"),
        "l_chart_normal": by_chart(unit(1 - F.col("map.angle") / (limits.angle * 1.8)), "l_normal"), "l_chart_height": by_chart(unit(1 - F.col("map.height") / (limits.height * 2.8)), "l_height"),
    })
    stable, charted = F.col("stable"), F.col("charted")
    fine = lambda b: ~b.isin(HORIZONTAL, VERTICAL)
    refusals = (
        ("stable_bucket_mismatch", stable & (c("bucket") != F.col("top")) & (c("bucket") != UNKNOWN) & ~F.col("bridge")),
        ("stable_color_texture_jump", stable & (F.col("paint") > limits.color * 1.9) & (F.col("d_deviation") > 55.0)),
        ("stable_normal_jump", charted & (F.col("map.angle") > steepest)),
        ("stable_plane_residual", charted & (F.col("map.plane") > thickest)),
        ("stable_height_jump", charted & level & (F.col("map.height") > highest)),
        ("fine_to_stable_bucket_block", ~stable & ~fine(c("bucket")) & fine(F.col("top"))),
        ("object_color_texture_jump", ~stable & (F.col("paint") > limits.color * limits.color_factor) & (F.col("d_deviation") > limits.texture_step)),
        ("object_shape_texture_jump", ~stable & (F.col("d_roughness") > limits.roughness_step) & (F.col("d_deviation") > limits.texture_step)),
    )
    weighed = {n: sum((w * F.col(f"l_{k}") for k, w in weights.items()), F.lit(0.0)) / sum(weights.values()) for n, weights in REGIMES.items()}
    regime = F.when(F.col("bridge"), "bridge").when(stable, "surface").when(F.col("top") == ROUGH, "rough").otherwise("object")
    pick = lambda of: F.when(F.col("regime") == "bridge", of("bridge")).when(F.col("regime") == "surface", of("surface")).when(F.col("regime") == "rough", of("rough")).otherwise(of("object"))
    reason = F.lit(None).cast("string")
    for name, holds in reversed(refusals):
        reason = F.when(holds, name).otherwise(reason)
    out = out.withColumn("regime", regime).withColumns({"refusal": reason, "total": pick(lambda n: weighed[n]), "threshold": pick(lambda n: F.lit(getattr(limits, n)))})
    low = F.col("total") < F.col("threshold")
    named = F.coalesce("refusal", F.when(low, "membership_score_low").otherwise("accepted"))
    return out.select(*pairs.columns, (F.col("refusal").isNull() & ~low).alias("ok"), F.when(F.col("refusal").isNull(), F.col("total")).otherwise(0.0).alias("score"), named.alias("reason"))


def seed_order() -> list[Column]:
    """Surfaces first, then the most planar cells, then the least rough, then by node."""
    return [F.col("bucket").isin(HORIZONTAL, VERTICAL).desc(), F.desc("planarity"), F.asc("roughness"), F.asc("node")]
