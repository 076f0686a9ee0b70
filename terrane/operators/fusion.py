"""Targets fused into objects with all gates: a fold in order, split by where and when targets can meet at all."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.graph import components
from terrane.operators.lineage import Scratch
from terrane.operators.neighbours import dealt

#: Decisions that a task gives at a time.
BATCH = 10_000
#: Labels and parent classes of surfaces, labels of fine objects, labels whose identity texts must be alike, words that say nothing about identity.
SURFACE_LABELS = frozenset({"floor", "ground", "wall", "building", "ceiling"})
SURFACE_PARENTS = frozenset({"surface", "structure"})
FINE_LABELS = frozenset({"car", "railing", "pipe", "equipment", "fine_candidate", "person", "vehicle"})
IDENTITY_LABELS = frozenset({"equipment", "pipe", "railing", "vehicle", "furniture", "person", "tree", "grass", "other"})
IDENTITY_STOP_WORDS = ("a", "an", "and", "around", "at", "near", "object", "on", "roof", "rooftop", "surface", "the", "unit")
#: Attachment statuses of structural regions and of objects of their own.
STRUCTURAL = frozenset({"merge_to_structural_region"})
STANDING = frozenset({"attached_object_candidate", "independent_object_candidate"})

#: Columns of targets: number and order, class, centre, box, color, normal, weight, quality, identity and attachment.
TARGET = (
    "target_id", "frame", "label", "parent", "x", "y", "z", "x0", "y0", "z0", "x1", "y1", "z1", "r", "g", "b", "nx", "ny", "nz",
    "points", "confidence", "mixed", "mergeable", "terms", "attachment", "point_ids",
)


@dataclass(frozen=True)
class Limits:
    """Distances, color distances and angles within which a target joins, those of equal surface labels, and what else gates ask for."""

    centre: float = 0.35
    box: float = 0.35
    color: float = 70.0
    angle: float = 25.0
    surface_centre: float = 0.8
    surface_box: float = 0.65
    surface_color: float = 95.0
    surface_angle: float = 18.0
    confidence: float = 0.5
    identity: float = 0.2
    identity_gate: bool = True
    strict_surfaces: bool = False
    zone: int = 100
    window: int = 1
    cell: float = 1.0


def identity_terms(*texts: Column) -> Column:
    """Distinct words of three or more ASCII letters and digits of the texts, but those that say nothing."""
    words = F.concat(*[F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]{3,}"), 0) for t in texts])
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*IDENTITY_STOP_WORDS))))


def confidence_of(value: Column) -> Column:
    """A confidence between 0 and 1; one that is none is 1."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 1.0).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def vote_weight() -> Column:
    return F.greatest(F.col("points"), F.lit(1)) * F.col("confidence")


@dataclass
class Body:
    """An object as the fold knows it: all that a gate asks, kept by adding."""

    name: object
    zone: int
    box: list[float]
    weight: int = 0
    centre: tuple[float, ...] = (0.0, 0.0, 0.0)
    color: tuple[float, ...] = (0.0, 0.0, 0.0)
    normal: tuple[float, ...] = (0.0, 0.0, 0.0)
    labels: set[str] = field(default_factory=set)
    parents: set[str] = field(default_factory=set)
    terms: set[str] = field(default_factory=set)
    attachment: dict[str, float] = field(default_factory=dict)
    frames: dict[int, set[int]] = field(default_factory=dict)

    def take(self, t) -> None:
        n, total = max(t.points, 1), self.weight + max(t.points, 1)
        mean = lambda old, new: tuple((a * self.weight + b * n) / total for a, b in zip(old, new, strict=True))
        self.centre, self.color = mean(self.centre, (t.x, t.y, t.z)), mean(self.color, (t.r, t.g, t.b))
        self.weight = total
        self.normal = tuple(a + b for a, b in zip(self.normal, (t.nx, t.ny, t.nz), strict=True))
        self.box = [min(a, b) for a, b in zip(self.box[:3], (t.x0, t.y0, t.z0), strict=True)] + [max(a, b) for a, b in zip(self.box[3:], (t.x1, t.y1, t.z1), strict=True)]
        self.labels.add(t.label)
        self.parents.add(t.parent)
        self.terms.update(t.terms)
        self.attachment[t.attachment] = self.attachment.get(t.attachment, 0.0) + n * t.confidence
        self.frames.setdefault(t.frame, set()).update(t.point_ids)

    @property
    def stands_as(self) -> str:
        """The attachment of most weight, of equals the first."""
        return max(self.attachment, key=self.attachment.__getitem__)


def _angle(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    size = math.hypot(*a), math.hypot(*b)
    if min(size) < 1e-9:
        return 0.0
    return math.degrees(math.acos(min(1.0, abs(sum(p * q for p, q in zip(a, b, strict=True))) / size[0] / size[1])))


def blocked(body: Body, t) -> str | None:
    """Why structural regions and objects of their own don't swallow each other, if they would here."""
    surface, fine, stands = bool(body.labels & SURFACE_LABELS), bool(body.labels & FINE_LABELS), body.stands_as
    if t.attachment in STRUCTURAL and (fine or stands in STANDING):
        return "structural_target_to_object_block"
    if t.attachment in STANDING and surface and t.label not in SURFACE_LABELS:
        return "attached_target_to_surface_block"
    if t.label in FINE_LABELS and stands in STRUCTURAL and surface:
        return "fine_target_to_structural_object_block"
    return None


def judged(body: Body, t, limits: Limits) -> tuple[bool, str, float]:
    """(joins, reason, distance of centres): the first gate that a target passes at an object, or what kept it out."""
    away = math.dist(body.centre, (t.x, t.y, t.z))
    low, high = (t.x0, t.y0, t.z0), (t.x1, t.y1, t.z1)
    gap = math.hypot(*(max(0.0, low[k] - body.box[3 + k], body.box[k] - high[k]) for k in range(3)))
    shade, turn = math.dist(body.color, (t.r, t.g, t.b)), _angle(body.normal, (t.nx, t.ny, t.nz))
    if reason := blocked(body, t):
        return False, reason, away
    same, kin = t.label in body.labels, t.parent in body.parents
    surfaces = t.label in SURFACE_LABELS and bool(body.labels & SURFACE_LABELS)
    crossed = limits.strict_surfaces and surfaces and not same
    tint = shade <= limits.color
    fits = (away <= limits.centre or gap <= limits.box) and tint and turn <= limits.angle
    spread = (away <= limits.surface_centre or gap <= limits.surface_box) and shade <= limits.surface_color and turn <= limits.surface_angle
    pure = not t.mixed or t.mergeable
    sound = pure and t.confidence >= limits.confidence
    asked = limits.identity_gate and t.label in IDENTITY_LABELS and bool(body.labels & IDENTITY_LABELS) and bool(body.terms) and len(t.terms) > 0
    known = not asked or len(body.terms & set(t.terms)) / len(body.terms | set(t.terms)) >= limits.identity
    gates = (
        ("same_label_geometry_color", same and fits and sound and known),
        ("same_surface_label_relaxed", same and surfaces and spread and sound),
        ("point_overlap", (same or (kin and not crossed)) and tint and pure and known and not body.frames.get(t.frame, set()).isdisjoint(t.point_ids)),
        ("same_parent_surface_review", kin and t.parent in SURFACE_PARENTS and not crossed and fits and sound and known),
    )
    for reason, passed in gates:
        if passed:
            return True, reason, away
    close = (same or kin) and fits
    return False, "identity_gate" if close and not known else "quality_gate" if close and not sound else "no_match", away


def may_join(body: Body, t, limits: Limits, away: float) -> bool:
    """Whether any gate can let a target in whose centre is `away` from the body's, by what all of them ask and is quickly told."""
    if t.mixed and not t.mergeable or t.label not in body.labels and t.parent not in body.parents:
        return False
    if t.frame in body.frames and not body.frames[t.frame].isdisjoint(t.point_ids):
        return True
    if t.confidence < limits.confidence:
        return False
    if away > max(limits.centre, limits.surface_centre):
        box = body.box
        gap = math.hypot(max(0.0, t.x0 - box[3], box[0] - t.x1), max(0.0, t.y0 - box[4], box[1] - t.y1), max(0.0, t.z0 - box[5], box[2] - t.z1))
        if gap > max(limits.box, limits.surface_box):
            return False
    if math.dist(body.color, (t.r, t.g, t.b)) > max(limits.color, limits.surface_color):
        return False
    return _angle(body.normal, (t.nx, t.ny, t.nz)) <= max(limits.angle, limits.surface_angle)


def _cells(box: list[float], limits: Limits) -> Iterator[tuple[int, int, int]]:
    low, high = ([math.floor((v + pad) / limits.cell) for v in part] for part, pad in ((box[:3], -limits.box), (box[3:], limits.box)))
    for x in range(low[0], high[0] + 1):
        for y in range(low[1], high[1] + 1):
            for z in range(low[2], high[2] + 1):
                yield x, y, z


def folded(rows: pd.DataFrame, limits: Limits) -> Iterator[tuple]:
    """(target_id, object_id, action, reason, distance) of targets in order; objects are found by zone and cell of their boxes."""
    return _folded(rows.sort_values(["frame", "target_id"]).itertuples(), limits)


def _folded(rows: Iterable, limits: Limits) -> Iterator[tuple]:
    """folded of rows that come in order."""
    bodies: list[Body] = []
    held: dict[tuple, list[int]] = {}
    known: list[set] = []
    zones: set[int] = set()
    for t in rows:
        zone, box = t.frame // limits.zone, [t.x0, t.y0, t.z0, t.x1, t.y1, t.z1]
        own = list(_cells(box, limits))
        keys = [(zone + k, cell) for k in range(-limits.window, limits.window + 1) if zone + k in zones for cell in own]
        at = (t.x, t.y, t.z)
        near = sorted([(math.dist(bodies[k].centre, at), k) for k in set().union(*[held[key] for key in keys if key in held])])
        joins, kept_out = None, (None, 0, None)
        for nth, (away, k) in enumerate(near):
            # the nearest tells why a target joins nothing; of the others those are judged that a gate may let in
            if nth and not may_join(bodies[k], t, limits, away):
                continue
            ok, reason, _ = judged(bodies[k], t, limits)
            if ok:
                joins = (away, k, reason)
                break
            if not nth:
                kept_out = (away, k, reason)
        if joins is None:
            bodies.append(Body(t.target_id, zone, box))
            known.append(set())
            at, row = len(bodies) - 1, (t.target_id, t.target_id, "new_object", kept_out[2], kept_out[0])
        else:
            at, row = joins[1], (t.target_id, bodies[joins[1]].name, "merge", joins[2], joins[0])
        body = bodies[at]
        body.take(t)
        zones.add(body.zone)
        new = set(_cells(body.box, limits)) - known[at]
        known[at] |= new
        for cell in new:
            held.setdefault((body.zone, cell), []).append(at)
        yield row


def meeting_groups(targets: DataFrame, limits: Limits, most_rounds: int = 60) -> DataFrame:
    """(target_id, family, meets): targets that can ever come to meet have equal values; it's an exact key of the fold.

    A family is what labels and parent classes link. Within one, chains of occupied cells along x, then y, then z cut
    targets into groups that can't meet whatever their hulls become. Groups of up to a share of all targets (see enough) stay
    as they are; in larger ones targets start as the cells of their padded boxes in
    a zone; groups whose cells meet within `window` zones become one with the hull of their boxes, as an object of
    them may have it, until no hulls meet any more. Equal boxes of a zone count once, so crowded places cost their cells.
    """
    scratch = Scratch(targets.sparkSession, "meeting")
    classes = targets.select("label", "parent").distinct()
    names = components(classes.select(F.concat(F.lit("l:"), F.col("label")).alias("a"), F.concat(F.lit("p:"), F.col("parent")).alias("b")))
    family = names.filter("startswith(node, 'l:')").select(F.expr("substring(node, 3)").alias("label"), F.col("component").alias("family"))
    ends = [F.floor((F.col(f"{c}{k}") + pad) / limits.cell).alias(f"{c}{k}") for c in "xyz" for k, pad in ((0, -limits.box), (1, limits.box))]
    placed = targets.select("target_id", "label", F.floor(F.col("frame") / limits.zone).alias("first"), *ends).join(family, "label")
    hull = [f"{c}{k}" for c in "xyz" for k in (0, 1)]
    keyed = placed.withColumn("node", F.xxhash64("family", "first", *hull))
    boxes, _ = scratch.keep(keyed.groupBy("node", "family", "first", *hull).agg(F.count("*").alias("n")).withColumn("line", F.xxhash64("family")))
    few = enough(boxes.agg(F.sum("n")).first()[0] or 0)
    done = None
    for c in "xyz":
        boxes, _ = scratch.keep(_lines(boxes, c))
        sized = boxes.join(boxes.groupBy("line").agg((F.sum("n") > few).alias("large")), "line")
        small, boxes = (sized.filter(f"large = {large}").drop("large") for large in ("false", "true"))
        small = small.select("node", F.col("line").alias("meets"))
        done = small if done is None else done.unionByName(small)
        if boxes.isEmpty():
            return keyed.select("target_id", "family", "node").join(done, "node").drop("node")
    labels = done.unionByName(_hulls(boxes.withColumn("last", F.col("first")), limits, most_rounds, scratch))
    return keyed.select("target_id", "family", "node").join(labels, "node").drop("node")


def enough(targets: int) -> int:
    """Targets of a group that needn't be cut further: a thousandth of all, but 64 at least and 2,000 at most."""
    return min(2_000, max(64, targets // 1_000))


def _lines(boxes: DataFrame, axis: str) -> DataFrame:
    """Boxes whose `line` tells apart what chains of occupied cells along an axis don't link."""
    spans = boxes.select("line", F.col(f"{axis}0").alias("low"), F.col(f"{axis}1").alias("high")).distinct()
    cell = lambda c: F.xxhash64("line", F.lit(axis), c)
    steps = spans.filter("low < high").withColumn("at", F.explode(F.sequence(F.col("low"), F.col("high") - 1))).select("line", "at").distinct()
    parts = components(steps.select(cell(F.col("at")).alias("a"), cell(F.col("at") + 1).alias("b")), spans.select(cell(F.col("low")).alias("node")).distinct())
    return boxes.withColumn("__cell", cell(F.col(f"{axis}0"))).join(parts.withColumnRenamed("node", "__cell"), "__cell").drop("__cell", "line").withColumnRenamed("component", "line")


def _hulls(boxes: DataFrame, limits: Limits, most_rounds: int, scratch: Scratch) -> DataFrame:
    """(node, meets) of boxes (node, line, first, last, x0 .. z1) by hulls that meet within a line, as meeting_groups tells."""
    hull = [f"{c}{k}" for c in "xyz" for k in (0, 1)]
    groups, path = scratch.keep(boxes.select("node", "line", "first", "last", *hull))
    labels, labels_path = scratch.keep(groups.select("node", F.col("node").alias("meets")))
    count = groups.count()
    for _ in range(most_rounds):
        spread = groups
        for c in "xyz":
            spread = spread.withColumn(c, F.explode(F.sequence(f"{c}0", f"{c}1")))
        order = Window.partitionBy("line", "x", "y", "z").orderBy("first", "node")
        # those before it that reach furthest stand for all that this one may meet
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        reach = F.max(F.struct("last", "node")).over(before)
        edges = spread.select("node", "first", reach.alias("before")).filter(F.col("first") - F.col("before.last") <= limits.window).select(F.col("node").alias("a"), F.col("before.node").alias("b")).filter("a <> b").distinct()
        parts = components(edges, groups.select("node"))
        joined = groups.join(parts, "node").groupBy(F.col("component").alias("node")).agg(F.first("line").alias("line"), F.min("first").alias("first"), F.max("last").alias("last"), *[(F.min if c[1] == "0" else F.max)(c).alias(c) for c in hull])
        after, after_path = scratch.keep(joined)
        named, named_path = scratch.keep(labels.join(parts.withColumnRenamed("node", "meets"), "meets").select("node", F.col("component").alias("meets")))
        for old in (path, labels_path):
            scratch.drop(old)
        groups, labels, path, labels_path = after, named, after_path, named_path
        was, count = count, groups.count()
        if count == was:
            return labels
    raise RuntimeError(f"groups did not settle in {most_rounds} rounds")


def fused(targets: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(target_id, object_id, action, reason, distance) of targets (see TARGET), whose ids are unique.

    Targets come in order of frame and id. Of the objects of zones within the window whose boxes, padded, share a
    cell with its own, a target joins the one of nearest centre whose gates it passes, of equals the one that was
    first; else it is an object, named by its id, and `reason` says what kept it from the nearest of its family. Groups that can't
    meet are folded apart, many by a task, which reads them as one stream; one that can is a task's work, whatever its size, as each decision rests on those before.
    """
    limits = limits or Limits()
    schema = targets.schema["target_id"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (t for batch in batches for t in batch.itertuples(index=False))
        found = (row for _, group in groupby(rows, lambda t: (t.family, t.meets)) for row in _folded(group, limits))
        while part := list(islice(found, BATCH)):
            yield pd.DataFrame(part, columns=["target_id", "object_id", "action", "reason", "distance"])

    key = ["family", "meets"]
    rows = dealt(targets.select(*TARGET).join(meeting_groups(targets, limits), "target_id"), key)
    return rows.sortWithinPartitions(*key, "frame", "target_id").mapInPandas(fold, f"target_id {schema}, object_id {schema}, action string, reason string, distance double")


def objects(decisions: DataFrame, targets: DataFrame, stable: float = 0.8) -> DataFrame:
    """Objects with their box, centre, color, frames and votes: stable or single_target where a label has `stable` of the weight, else ambiguous.

    Of equal weights the label that was voted for first is dominant, as are attachment and region.
    """
    rows = decisions.select("target_id", "object_id").join(targets, "target_id").withColumns({"w": vote_weight(), "n": F.greatest(F.col("points"), F.lit(1)), "at": F.struct("frame", "target_id")})
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    ends = [(F.min if k == "0" else F.max)(f"{c}{k}").alias(f"{c}{k}") for c in "xyz" for k in "01"]
    body = rows.groupBy("object_id").agg(F.count("*").alias("targets"), F.sum("n").alias("points"), *ends, *[mean(c) for c in "xyzrgb"], F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.avg("confidence").alias("confidence"))
    out = body
    for column in ("label", "attachment"):
        votes = rows.groupBy("object_id", column).agg(F.sum("w").alias("w"), F.min("at").alias("at"))
        # the first of equals: votes in order of time, of which the earliest has the largest rank from behind
        ranked = votes.withColumn("nth", F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("at"))))
        best = ranked.groupBy("object_id").agg(F.max_by(column, F.struct("w", "nth")).alias(f"dominant_{column}"), (F.max("w") / F.when(F.sum("w") > 0, F.sum("w")).otherwise(1.0)).alias(f"{column}_share"))
        out = out.join(best, "object_id")
    sure = F.col("label_share") >= stable
    status = F.when(~sure, "ambiguous_object").when(F.col("targets") > 1, "stable").otherwise("single_target")
    return out.withColumns({"status": status, "label": F.when(sure, F.col("dominant_label")).otherwise("ambiguous")})


def zones(found: DataFrame, size: int = 100) -> DataFrame:
    """(zone, objects, first_frame, last_frame, box) of objects by the zone of their first frame."""
    ends = [(F.min if k == "0" else F.max)(f"{c}{k}").alias(f"{c}{k}") for c in "xyz" for k in "01"]
    zone = F.floor(F.col("first_frame") / size).alias("zone")
    return found.groupBy(zone).agg(F.count("*").alias("objects"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), *ends)
