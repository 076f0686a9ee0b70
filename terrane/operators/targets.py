"""Targets of a frame: seen points meet the masks of their image, and what a mask holds falls into pieces in space."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.geometry import eigenvalues
from terrane.operators import neighbours
from terrane.operators.graph import components
from terrane.operators.lineage import Scratch
from terrane.operators.patches import merged, sums
from terrane.operators.voxels import KEY

#: Pixels of a block in which runs and points meet.
BLOCK = 1 << 12
IMAGE = ("frame", "cam")
MASK = (*IMAGE, "mask_id")
#: Pixels and runs follow each other so evenly that their shuffled bytes tell little of their rows; joins with them are never broadcasts.
SORTED = "merge"


@dataclass(frozen=True)
class Rules:
    """Image height, cell sizes of connectivity by label, points of a target, and which masks are eroded or held to their front."""

    height: int
    cell: float = 0.2
    cells: tuple[tuple[str, float], ...] = ()
    least: int = 30
    skip: tuple[str, ...] = ("sky", "ignore")
    erode: int = 0
    erode_labels: tuple[str, ...] = ()
    window: int = 0
    depth_edge: float = 0.0
    depth_labels: tuple[str, ...] = ()

    def size(self, label: Column) -> Column:
        out = F.lit(self.cell)
        for name, size in self.cells:
            out = F.when(label == name, size).otherwise(out)
        return out


def listed(label: Column, labels: Sequence[str]) -> Column:
    """Whether a rule for some labels, or for all if it names none, holds for this one."""
    return label.isin(*labels) if labels else F.lit(True)


def in_masks(points: DataFrame, runs: DataFrame, height: int) -> DataFrame:
    """Points (frame, cam, u, v, ...) with the mask_id and label of the run that their pixel is in.

    Runs (frame, cam, mask_id, label, start, length) count pixels down the columns. A run goes to the blocks of BLOCK
    pixels that it touches, a point to its own, so they meet by equality however long runs are.
    """
    last = F.col("start") + F.col("length") - 1
    spread = runs.filter("length > 0").select(*IMAGE, "mask_id", "label", "start", last.alias("last"), F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(last / BLOCK))).alias("block"))
    at = (F.col("u") * height + F.col("v")).cast("long")
    placed = points.filter((F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("v") < height)).withColumn("at", at).withColumn("block", F.floor(F.col("at") / BLOCK))
    return placed.join(spread.hint(SORTED), [*IMAGE, "block"]).filter("at >= start and at <= last").drop("block", "at", "start", "last")


def front_depths(points: DataFrame, window: int) -> DataFrame:
    """(frame, cam, u, v, front): the least depth of any point within `window` pixels of each pixel that has one."""
    least = points.groupBy(*IMAGE, "u", "v").agg(F.min("depth").alias("depth"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-window, window + 1) for b in range(-window, window + 1)])
    moved = least.withColumn("s", F.explode(steps)).select(*IMAGE, (F.col("u") + F.col("s.a")).alias("u"), (F.col("v") + F.col("s.b")).alias("v"), "depth")
    return moved.groupBy(*IMAGE, "u", "v").agg(F.min("depth").alias("front"))


def inside(pixels: DataFrame, runs: DataFrame, height: int, radius: int) -> DataFrame:
    """Those of the distinct pixels (frame, cam, mask_id, u, v) around which all within `radius` are of their mask.

    What is around a pixel meets the runs, so work follows the pixels asked for and not the areas of masks.
    """
    around = range(-radius, radius + 1)
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in around for b in around if a * a + b * b <= radius * radius]
    moved = pixels.withColumn("s", F.explode(F.array(*steps))).select(*IMAGE, F.col("mask_id").alias("own"), F.col("u").alias("u0"), F.col("v").alias("v0"), (F.col("u") + F.col("s.a")).alias("u"), (F.col("v") + F.col("s.b")).alias("v"))
    met = in_masks(moved, runs, height).filter("mask_id = own").select(*IMAGE, "mask_id", "u0", "v0", "u", "v").distinct()
    whole = met.groupBy(*IMAGE, "mask_id", "u0", "v0").agg(F.count("*").alias("n")).filter(F.col("n") == len(steps))
    return whole.select(*IMAGE, "mask_id", F.col("u0").alias("u"), F.col("v0").alias("v"))


def kept_in_masks(points: DataFrame, runs: DataFrame, rules: Rules) -> DataFrame:
    """Points with their masks and `gone`: null, or boundary or depth where the mask's erosion or a nearer front leaves them out.

    What masks and fronts say is told for pixels, which are kept once; points, however many a pixel has, look up theirs.
    """
    pixel, scratch = [*IMAGE, "u", "v"], Scratch(points.sparkSession, "pixels")
    fronts = rules.window > 0 and rules.depth_edge > 0
    pixels, _ = scratch.keep(points.groupBy(*pixel).agg(F.min("depth").alias("depth")) if fronts else points.select(*pixel).distinct())
    told = in_masks(pixels.select(*pixel), runs.filter(~F.col("label").isin(*rules.skip)), rules.height)
    gone = F.lit(None).cast("string")
    if fronts:
        told = told.join(front_depths(pixels, rules.window).hint(SORTED), pixel)
        gone = F.when(listed(F.col("label"), rules.depth_labels) & (F.col("depth") > F.col("front") + rules.depth_edge), "depth").otherwise(gone)
    if rules.erode > 0:
        told, _ = scratch.keep(told)
        own = runs.filter(~F.col("label").isin(*rules.skip) & listed(F.col("label"), rules.erode_labels) & (F.col("length") > 0))
        asked = told.filter(listed(F.col("label"), rules.erode_labels)).select(*IMAGE, "mask_id", "u", "v").distinct()
        inner = inside(asked, own, rules.height, rules.erode).withColumn("inside", F.lit(True))
        told = told.join(inner.hint(SORTED), [*IMAGE, "mask_id", "u", "v"], "left")
        gone = F.when(listed(F.col("label"), rules.erode_labels) & F.col("inside").isNull(), "boundary").otherwise(gone)
    told, _ = scratch.keep(told)
    return points.join(told.hint(SORTED), pixel).withColumn("gone", gone).drop("front", "inside")


def pieces(points: DataFrame, runs: DataFrame, rules: Rules) -> DataFrame:
    """Points (frame, cam, point_id, x, y, z, u, v, depth, ...) that masks keep, with `piece` and `target_id`.

    The points of a mask fall into pieces whose cells, of the label's size, touch in any of 26 ways. Pieces of fewer
    than `least` points are residual and have neither; others are numbered from 0 by size, of equals by their
    least point_id.
    """
    held = _in_cells(points, runs, rules)
    cells, _ = Scratch(points.sparkSession, "pieces").keep(held.groupBy(*MASK, *KEY, "node").agg(F.count("*").alias("n"), F.min("point_id").alias("least_id")))
    return held.drop(*KEY).join(_numbered(cells, rules), "node", "left").drop("node")


def _in_cells(points: DataFrame, runs: DataFrame, rules: Rules) -> DataFrame:
    """Points that masks keep, with the cell of their label's size that they are in and its name `node` in their mask."""
    held = kept_in_masks(points, runs, rules).filter("gone is null").drop("gone")
    size = rules.size(F.col("label"))
    return held.withColumns({k: F.floor(F.col(c) / size) for k, c in zip(KEY, "xyz", strict=True)}).withColumn("node", F.xxhash64(*MASK, *KEY))


def _numbered(cells: DataFrame, rules: Rules) -> DataFrame:
    """(node, piece, target_id) of the cells (mask, key, node, n, least_id) of pieces that are large enough."""
    steps = F.array(*[F.array(*map(F.lit, s)) for s in neighbours.positive(neighbours.offsets("cube"))])
    moved = cells.withColumn("s", F.explode(steps)).select("node", F.xxhash64(*MASK, *[F.col(k) + F.col("s")[n] for n, k in enumerate(KEY)]).alias("b"))
    edges = moved.join(cells.select(F.col("node").alias("b")).distinct(), "b").select(F.col("node").alias("a"), "b")
    named = cells.join(components(edges, cells.select("node").distinct()), "node")
    sizes = named.groupBy(*MASK, "component").agg(F.sum("n").alias("n"), F.min("least_id").alias("least_id")).filter(F.col("n") >= rules.least)
    order = Window.partitionBy(*MASK).orderBy(F.desc("n"), "least_id")
    numbered = sizes.select(*MASK, "component", (F.row_number().over(order) - 1).alias("piece"))
    target = F.format_string("t_%04d_cam%d_m%04d_c%02d", *MASK, "piece")
    return named.select(*MASK, "node", "component").distinct().join(numbered, [*MASK, "component"]).select("node", "piece", target.alias("target_id"))


def found(points: DataFrame, runs: DataFrame, rules: Rules) -> DataFrame:
    """The summaries of pieces. Points are kept once and summed up by cell; targets are sums of their cells, and only ids look up theirs."""
    scratch = Scratch(points.sparkSession, "found")
    held, _ = scratch.keep(_in_cells(points, runs, rules).select(*MASK, "label", *KEY, "node", "point_id", *"xyzrgb"))
    key = [*MASK, "label", *KEY, "node"]
    cells, _ = scratch.keep(sums(held, key, F.min("point_id").alias("least_id")))
    told, _ = scratch.keep(_numbered(cells, rules))
    stats = merged(cells.join(told, "node").drop("node", "least_id", *KEY), ["target_id", *MASK, "piece", "label"])
    return _summary(stats, held.select("node", "point_id").join(told.select("node", "target_id").hint(SORTED), "node"))


def normal(stats: DataFrame) -> DataFrame:
    """`stats` (of sums) with nx, ny, nz, the direction of least spread, upward, and planarity and linearity; those of fewer than three points point up.

    With eigenvalues e1 >= e2 >= e3, each column of (C - e1)(C - e2) is along the direction of e3; the longest is taken.
    """
    cov = {a + b: (F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1)) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    first, second, third = eigenvalues(*cov.values())
    out = stats.withColumns({f"c{k}": v for k, v in cov.items()}).withColumns({"e1": first, "e2": second, "e3": F.greatest(third, F.lit(0.0))})
    at = lambda a, b: F.col(f"c{min(a, b)}{max(a, b)}")
    less = lambda a, b, e: at(a, b) - F.col(e) if a == b else at(a, b)
    column = lambda b: [sum((less(a, m, "e1") * less(m, b, "e2") for m in "xyz"), F.lit(0.0)) for a in "xyz"]
    columns = F.array(*[F.struct(sum((v * v for v in column(b)), F.lit(0.0)).alias("size"), *[v.alias(n) for v, n in zip(column(b), ("x", "y", "z"), strict=True)]) for b in "xyz"])
    out = out.withColumn("d", F.array_max(columns))
    length = F.sqrt(F.col("d.size")) * F.when(F.col("d.z") < 0, -1.0).otherwise(1.0)
    flat = (F.col("n") >= 3) & (F.col("d.size") > 0)
    top = F.when(F.col("e1") > 1e-12, F.col("e1")).otherwise(1.0)
    shape = {"linearity": (F.col("e1") - F.col("e2")) / top, "planarity": (F.col("e2") - F.col("e3")) / top}
    out = out.withColumns({f"n{c}": F.when(flat, F.col(f"d.{c}") / length).otherwise(1.0 if c == "z" else 0.0) for c in "xyz"})
    return out.withColumns({k: F.when(F.col("n") >= 3, v).otherwise(0.0) for k, v in shape.items()}).drop("d", "e1", "e2", "e3", *[f"c{k}" for k in cov])


def summaries(found: DataFrame) -> DataFrame:
    """Targets of pieces: label, points, box, centre, mean color, normal, planarity and linearity, and the ids of their points."""
    rows = found.filter("target_id is not null")
    return _summary(sums(rows, ["target_id", *MASK, "piece", "label"]), rows)


def _summary(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """Targets of their sums and of rows (target_id, point_id)."""
    key = ["target_id", *MASK, "piece", "label"]
    ids = rows.groupBy("target_id").agg(F.array_sort(F.collect_list("point_id")).alias("point_ids"))
    means = [(F.col(f"s{c}") / F.col("n")).alias(c) for c in "xyzrgb"]
    ends = [f"{c}{k}" for c in "xyz" for k in (0, 1)]
    return normal(stats).select(*key, F.col("n").alias("points"), *ends, *means, "nx", "ny", "nz", "planarity", "linearity").join(ids.hint(SORTED), "target_id")


def residuals(found: DataFrame) -> DataFrame:
    """Points of pieces that are too small, by label: (label, points)."""
    return found.filter("target_id is null").groupBy("label").agg(F.count("*").alias("points"))
