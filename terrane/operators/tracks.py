"""Order-dependent folds: tracklets, object fusion, sync paths, greedy matching. Each has an exact partition key and a total order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.graph import near_groups


class Near:
    """What is open in a fold, a dict a thing, by the cell of its x, y and z: all within `size` of a place lie in the 27 cells around it."""

    def __init__(self, size: float):
        self.size = size
        self.cells: dict[tuple, dict[int, dict]] = {}
        self.around: dict[tuple, list[dict[int, dict]]] = {}
        self.count = 0

    def about(self, x: float, y: float, z: float) -> list[dict[int, dict]]:
        """The cells, as things by their numbers, that may hold what is within `size`."""
        return self.around.get((x // self.size, y // self.size, z // self.size), [])

    def put(self, thing: dict) -> None:
        """Opens a thing, whose `number` follows those before, or moves it to where it is now."""
        at = (thing["x"] // self.size, thing["y"] // self.size, thing["z"] // self.size)
        if "number" not in thing:
            thing["number"] = self.count
            self.count += 1
        elif thing["cell"] == at:
            return
        else:
            del self.cells[thing["cell"]][thing["number"]]
        thing["cell"] = at
        held = self.cells.get(at)
        if held is None:
            held = self.cells[at] = {}
            for dx, dy, dz in product((-1, 0, 1), repeat=3):
                self.around.setdefault((at[0] + dx, at[1] + dy, at[2] + dz), []).append(held)
        held[thing["number"]] = thing


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], begin: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """What a fold gives for each row, group by group of `keys` and by `order` within one: `begin` gives a group's step, which takes the `columns` of a row.

    A task reads its groups as a stream, so it holds what the fold keeps open and not the group.
    """
    dealt = rows.select(*keys, *[c for c in dict.fromkeys((*order, *columns)) if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order])
    plain = lambda c: c.to_pylist() if pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False).tolist()
    names = [f.strip().split()[0] for f in schema.split(",")]
    kinds = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(kinds).types
        held, step = None, None
        for batch in batches:
            named = {n: plain(batch.column(k)) for k, n in enumerate(batch.schema.names)}
            out = []
            for key, values in zip(zip(*[named[k] for k in keys], strict=True), zip(*[named[c] for c in columns], strict=True), strict=True):
                if step is None or key != held:
                    held, step = key, begin()
                out.append(step(*values))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(run, schema)


def tracklets(targets: DataFrame, most_gap: int, most_distance: float, most_color: float) -> DataFrame:
    """(target_id, tracklet): targets of one label joined along frames.

    Targets (target_id, label, frame, x, y, z, color) are taken in order of frame and id. A target joins the
    open tracklet of least centre distance plus color distance / 255, of equals the earliest, among those
    last seen at most `most_gap` frames ago and within both limits; else it opens one, named by its id.
    """

    def begin() -> Callable[..., tuple]:
        open_ = Near(most_distance)

        def step(target_id, frame, x, y, z, color) -> tuple:
            best, least, gone = None, np.inf, []
            for held in open_.about(x, y, z):
                for t in held.values():
                    if frame - t["frame"] > most_gap:
                        gone.append((held, t["number"]))
                        continue
                    shade = abs(color - t["color"])
                    if shade <= most_color:
                        away = ((x - t["x"]) ** 2 + (y - t["y"]) ** 2 + (z - t["z"]) ** 2) ** 0.5
                        cost = away + shade / 255
                        if away <= most_distance and (cost < least or cost == least and t["number"] < best["number"]):
                            best, least = t, cost
            for held, number in gone:
                del held[number]
            if best is None:
                best = {"name": target_id}
            best |= {"frame": frame, "x": x, "y": y, "z": z, "color": color}
            open_.put(best)
            return target_id, best["name"]

        return step

    # a target joins a tracklet by the last target of it alone, so chains of near places are folded apart, and what a silence parts
    near = near_groups(targets, ["label"], {"x": most_distance, "y": most_distance, "z": most_distance})
    spells = after_silences(near, ["label", "near"], "frame", most_gap)
    return in_order(spells, ["label", "near", "spell"], ["frame", "target_id"], ["target_id", "frame", "x", "y", "z", "color"], begin, "target_id long, tracklet long")


def after_silences(rows: DataFrame, keys: list[str], frame: str, most_gap: float) -> DataFrame:
    """`rows` with `spell`: how often before a row's frame its group was silent for more than `most_gap` frames; at such a silence everything open ends."""
    order = Window.partitionBy(*keys).orderBy(frame)
    frames = rows.select(*keys, frame).distinct()
    new = F.coalesce((F.col(frame) - F.lag(frame).over(order) > most_gap).cast("int"), F.lit(0))
    spells = frames.withColumn("new", new).withColumn("spell", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    return rows.join(spells, [*keys, frame])


def fused_objects(targets: DataFrame, zone: int, window: int, most_distance: float, most_color: float) -> DataFrame:
    """(target_id, object_id): targets fused into objects, family by family.

    Targets (target_id, family, label, frame, x, y, z, color, points) come in order of frame and id. An object
    within `window` zones of frames whose running centre and color are within the limits takes the target,
    the nearest of several, of equals the one that was first; running means weigh by points. Only targets of
    one family can ever join, so families are folded apart. An object is named by its first target. A running centre
    lies between the last target and the centre before, which were within the distance; so a target that joins is
    within twice the distance of the last one, and chains of such steps are folded apart too.
    """

    def begin() -> Callable[..., tuple]:
        objects = Near(most_distance)

        def step(target_id, frame, x, y, z, color, points) -> tuple:
            own, weight = frame // zone, max(points, 1)
            best, least, gone = None, np.inf, []
            for held in objects.about(x, y, z):
                for o in held.values():
                    if own - o["zone"] > window:
                        gone.append((held, o["number"]))
                    elif abs(color - o["color"]) <= most_color:
                        away = ((x - o["x"]) ** 2 + (y - o["y"]) ** 2 + (z - o["z"]) ** 2) ** 0.5
                        if away <= most_distance and (away < least or away == least and o["number"] < best["number"]):
                            best, least = o, away
            for held, number in gone:
                del held[number]
            if best is None:
                best = {"name": target_id, "zone": own, "n": 0, "x": 0.0, "y": 0.0, "z": 0.0, "color": 0.0}
            for c, value in (("x", x), ("y", y), ("z", z), ("color", color)):
                best[c] = (best[c] * best["n"] + value * weight) / (best["n"] + weight)
            best["n"] += weight
            objects.put(best)
            return target_id, best["name"]

        return step

    reach = 2 * most_distance
    near = near_groups(targets, ["family"], {"x": reach, "y": reach, "z": reach})
    return in_order(near, ["family", "near"], ["frame", "target_id"], ["target_id", "frame", "x", "y", "z", "color", "points"], begin, "target_id long, object_id long")


def finished(fused: DataFrame, targets: DataFrame, stable: float = 0.8) -> DataFrame:
    """Objects with their votes settled: stable or single_target for a share of `stable` or more, else ambiguous."""
    votes = fused.join(targets, "target_id").groupBy("object_id", "label").agg(F.count("*").alias("n"), F.sum("points").alias("points"))
    by_name = votes.withColumn("__n", F.row_number().over(Window.partitionBy("object_id").orderBy("label")))
    out = by_name.groupBy("object_id").agg(F.max_by("label", F.struct("n", -F.col("__n"))).alias("label"), F.sum("n").alias("targets"), F.sum("points").alias("points"), (F.max("n") / F.sum("n")).alias("share"))
    sure = F.col("share") >= stable
    return out.withColumn("status", F.when(~sure, "ambiguous_object").when(F.col("targets") > 1, "stable").otherwise("single_target")).withColumn("label", F.when(sure, F.col("label")).otherwise("ambiguous"))


def sync_paths(candidates: DataFrame, score_weight: float, back_penalty: float, velocity: float, target: float) -> DataFrame:
    """(cam_id, frame_id, video_idx): the cheapest path through one candidate of each frame, camera by camera.

    Candidates are (cam_id, frame_id, video_idx, score). A step back costs back_penalty + |dv| * velocity,
    another velocity * |dv / df - target|; a candidate costs -score_weight * score. The first of equal
    minima wins, candidates being in order of video_idx.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        frames = [(f, g["video_idx"].to_numpy(float), g["score"].to_numpy(float)) for f, g in rows.sort_values(["frame_id", "video_idx"]).groupby("frame_id")]
        cost, back = -score_weight * frames[0][2], []
        for (f0, v0, _), (f1, v1, s1) in zip(frames[:-1], frames[1:], strict=True):
            step = v1[None, :] - v0[:, None]
            move = np.where(step < 0, back_penalty + np.abs(step) * velocity, velocity * np.abs(step / (f1 - f0) - target))
            whole = cost[:, None] + move
            back.append(whole.argmin(axis=0))
            cost = whole.min(axis=0) - score_weight * s1
        at, path = int(cost.argmin()), []
        for k in range(len(frames) - 1, -1, -1):
            path.append((rows["cam_id"].iloc[0], frames[k][0], int(frames[k][1][at])))
            if k:
                at = int(back[k - 1][at])
        return pd.DataFrame(path[::-1], columns=["cam_id", "frame_id", "video_idx"])

    return candidates.groupBy("cam_id").applyInPandas(fold, "cam_id long, frame_id long, video_idx long")


def greedy_matches(overlaps: DataFrame, image: str, least: float) -> DataFrame:
    """One-to-one matches (image, left, right, iou) of each image, the highest overlap first, of equals the least left, then right."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        lefts, rights, out = set(), set(), []
        for row in rows[rows["iou"] >= least].sort_values(["iou", "l", "r"], ascending=[False, True, True]).itertuples():
            if row.l not in lefts and row.r not in rights:
                lefts.add(row.l)
                rights.add(row.r)
                out.append((row.image, row.l, row.r, row.iou))
        return pd.DataFrame(out, columns=["image", "l", "r", "iou"])

    named = overlaps.select(F.col(image).alias("image"), F.col("left").alias("l"), F.col("right").alias("r"), "iou")
    return named.groupBy("image").applyInPandas(fold, "image long, l long, r long, iou double")


def suppressed(boxes: DataFrame, most: float) -> DataFrame:
    """Boxes (image, box, score, x0, y0, x1, y1) that no better kept box of their image overlaps by an IoU above `most`."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "box"], ascending=[False, True])
        box = rows[["x0", "y0", "x1", "y1"]].to_numpy(float)
        area, alive = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]), np.ones(len(box), bool)
        for k in range(len(box)):
            if alive[k]:
                low, high = np.maximum(box[k, :2], box[:, :2]), np.minimum(box[k, 2:], box[:, 2:])
                both = np.prod(np.clip(high - low, 0, None), axis=1)
                over = both > most * (area[k] + area - both)
                over[: k + 1] = False
                alive &= ~over
        return rows.loc[alive, ["image", "box", "score"]]

    return boxes.groupBy("image").applyInPandas(fold, "image long, box long, score double")


def plane_splits(points: DataFrame, target: str, most_planes: int, within: float, least: int, tries: int, seed: int = 17) -> DataFrame:
    """(target, point_id, plane): planes found in each target by random samples of three points, the rest 0.

    The seed of a target is `seed` plus its number of points; points are in order of id. A plane takes all
    points within `within` of it, if they are at least `least`. Only the columns that are read are moved.
    """

    def fold(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows["point_id"]).to_numpy()
        xyz, plane = np.column_stack([rows[c].to_numpy()[order] for c in "xyz"]), np.zeros(rows.num_rows, np.int32)
        rng = np.random.default_rng(seed + rows.num_rows)
        for number in range(1, most_planes + 1):
            left = np.flatnonzero(plane == 0)
            if len(left) < max(least, 3):
                break
            own, best, most = xyz[left], None, 0
            corners = xyz[np.array([rng.choice(left, 3, replace=False) for _ in range(tries)], np.int64).reshape(-1, 3)]
            normals = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
            for a, normal in zip(corners[:, 0], normals, strict=True):
                size = math.sqrt(normal.dot(normal))
                if size > 1e-9:
                    near = np.abs((own - a) @ (normal / size)) <= within
                    count = np.count_nonzero(near)
                    if count > most:
                        best, most = near, count
            if most < least or best is None:
                break
            plane[left[best]] = number
        placed = np.empty_like(plane)
        placed[order] = plane
        return pa.table({target: rows[target], "point_id": rows["point_id"], "plane": placed})

    kind = points.schema[target].dataType.simpleString()
    read = points.select(target, F.col("point_id").cast("long").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return read.groupBy(target).applyInArrow(fold, f"{target} {kind}, point_id long, plane int")


def associated(tracks_: DataFrame, least_gap: int, most_gap: int, tiers: list[tuple[str, float, float, float]]) -> DataFrame:
    """(tracklet, long_object, reason): tracklets of one label joined over longer gaps.

    Tracklets (tracklet, label, first, last, x, y, z, color) come in order of first frame and name. Each tier is
    (reason, most distance, most color difference, bonus); a tracklet joins the object of least distance plus
    bonus by the first tier that admits it, of equals the earlier object, if the object ended between
    `least_gap` and `most_gap` frames before. Objects are named by their first tracklet.
    """

    reach = max(t[1] for t in tiers)

    def begin() -> Callable[..., tuple]:
        known = Near(reach)

        def step(tracklet, first, last, x, y, z, color) -> tuple:
            best, least, why, gone = None, np.inf, "new", []
            for held in known.about(x, y, z):
                for o in held.values():
                    gap = first - o["last"]
                    if gap > most_gap:
                        gone.append((held, o["number"]))
                    elif gap >= least_gap:
                        away = ((x - o["x"]) ** 2 + (y - o["y"]) ** 2 + (z - o["z"]) ** 2) ** 0.5
                        tier = next((t for t in tiers if away <= t[1] and abs(color - o["color"]) <= t[2]), None)
                        if tier and (away + tier[3] < least or away + tier[3] == least and o["number"] < best["number"]):
                            best, least, why = o, away + tier[3], tier[0]
            for held, number in gone:
                del held[number]
            if best is None:
                best = {"name": tracklet, "last": last}
            best |= {"last": max(last, best["last"]), "x": x, "y": y, "z": z, "color": color}
            known.put(best)
            return tracklet, best["name"], why

        return step

    near = near_groups(tracks_, ["label"], {"x": reach, "y": reach, "z": reach})
    return in_order(near, ["label", "near"], ["first", "tracklet"], ["tracklet", "first", "last", "x", "y", "z", "color"], begin, "tracklet long, long_object long, reason string")
