import math
import random
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.operators import fusion, targets
from terrane.plans import sightings

SF = "/root/testdata/sf0.001"
PLAIN = dict(target_id=1, frame=0, label="car", parent="dynamic", x=0.0, y=0.0, z=0.0, x0=-0.1, y0=-0.1, z0=-0.1, x1=0.1, y1=0.1, z1=0.1, r=10.0, g=10.0, b=10.0, nx=0.0, ny=0.0, nz=1.0, points=10, confidence=1.0, mixed=False, mergeable=False, terms=[], attachment="unknown", point_ids=[])


def target(**changed):
    t = PLAIN | changed
    for c in "xyz":
        t[f"{c}0"], t[f"{c}1"] = changed.get(f"{c}0", t[c] - 0.1), changed.get(f"{c}1", t[c] + 0.1)
    return SimpleNamespace(**t)


def judged(first, second, **limits):
    body = fusion.Body(first.target_id, 0, [first.x0, first.y0, first.z0, first.x1, first.y1, first.z1])
    body.take(first)
    return fusion.judged(body, second, fusion.Limits(**limits))[:2]


WALL, FLOOR, EQUIPMENT = (dict(label=n, parent=p) for n, p in (("wall", "surface"), ("floor", "surface"), ("equipment", "object")))
CASES = [
    ({}, {"x": 0.3}, {}, (True, "same_label_geometry_color")),
    ({}, {"x": 0.56}, {}, (False, "no_match")),
    ({}, {"x": 0.5}, {}, (True, "same_label_geometry_color")),
    ({}, {"r": 81.0}, {}, (False, "no_match")),
    ({}, {"nx": 1.0}, {}, (False, "no_match")),
    ({}, {"nz": -1.0}, {}, (True, "same_label_geometry_color")),
    ({}, {"nz": 0.0}, {}, (True, "same_label_geometry_color")),
    ({}, {"confidence": 0.4}, {}, (False, "quality_gate")),
    ({}, {"mixed": True}, {}, (False, "quality_gate")),
    ({}, {"mixed": True, "mergeable": True}, {}, (True, "same_label_geometry_color")),
    (WALL, WALL | {"x": 0.7}, {}, (True, "same_surface_label_relaxed")),
    (WALL, WALL | {"x": 0.7, "r": 100.0}, {}, (True, "same_surface_label_relaxed")),
    (WALL, WALL | {"x": 0.7, "nx": 0.4}, {}, (False, "no_match")),
    (WALL, FLOOR | {"x": 0.1}, {}, (True, "same_parent_surface_review")),
    (WALL, FLOOR | {"x": 0.1}, {"strict_surfaces": True}, (False, "no_match")),
    (WALL, FLOOR | {"x": 0.7}, {}, (False, "no_match")),
    (EQUIPMENT | {"terms": ["pump", "red"]}, EQUIPMENT | {"terms": ["fan", "blue"]}, {}, (False, "identity_gate")),
    (EQUIPMENT | {"terms": ["pump", "red"]}, EQUIPMENT | {"terms": ["fan", "red"]}, {}, (True, "same_label_geometry_color")),
    (EQUIPMENT | {"terms": ["pump", "red"]}, EQUIPMENT | {"terms": ["fan", "blue"]}, {"identity_gate": False}, (True, "same_label_geometry_color")),
    (EQUIPMENT | {"terms": ["pump"]}, EQUIPMENT, {}, (True, "same_label_geometry_color")),
    ({"point_ids": [1, 2]}, {"x": 0.9, "point_ids": [2, 3]}, {}, (True, "point_overlap")),
    ({"point_ids": [1, 2]}, {"x": 0.9, "frame": 1, "point_ids": [2, 3]}, {}, (False, "no_match")),
    ({"point_ids": [1, 2]}, {"x": 0.9, "mixed": True, "point_ids": [2]}, {}, (False, "no_match")),
    ({"point_ids": [1]}, {"x": 0.9, "label": "person", "confidence": 0.1, "point_ids": [1]}, {}, (True, "point_overlap")),
    (WALL | {"point_ids": [1]}, FLOOR | {"x": 0.9, "point_ids": [1]}, {"strict_surfaces": True}, (False, "no_match")),
    ({}, {"attachment": "merge_to_structural_region"}, {}, (False, "structural_target_to_object_block")),
    ({"label": "tree", "attachment": "independent_object_candidate"}, {"label": "tree", "attachment": "merge_to_structural_region"}, {}, (False, "structural_target_to_object_block")),
    (WALL, {"label": "tree", "parent": "surface", "attachment": "attached_object_candidate"}, {}, (False, "attached_target_to_surface_block")),
    (WALL, WALL | {"attachment": "attached_object_candidate"}, {}, (True, "same_label_geometry_color")),
    (WALL | {"attachment": "merge_to_structural_region"}, {"label": "pipe", "parent": "surface"}, {}, (False, "fine_target_to_structural_object_block")),
]


@pytest.mark.parametrize(("first", "second", "limits", "want"), CASES)
def test_each_gate(first, second, limits, want):
    assert judged(target(**first), target(target_id=2, **second), **limits) == want


def test_an_object_is_what_its_targets_add_up_to():
    body = fusion.Body(1, 0, [-0.1] * 3 + [0.1] * 3)
    body.take(target(points=10, terms=["red"], attachment="a", point_ids=[1]))
    body.take(target(x=0.4, points=30, r=50.0, nz=0.0, nx=1.0, label="person", terms=["blue"], attachment="b", confidence=0.2, frame=3, point_ids=[7]))
    assert body.centre == (pytest.approx(0.3), 0.0, 0.0) and body.color[0] == 40.0 and body.weight == 40
    assert body.box == [-0.1, -0.1, -0.1, 0.5, 0.1, 0.1] and body.normal == (1.0, 0.0, 1.0)
    assert body.labels == {"car", "person"} and body.terms == {"red", "blue"} and body.stands_as == "a" and body.frames == {0: {1}, 3: {7}}


def random_targets(seed, count, spread=6.0):
    rng = random.Random(seed)
    kinds = [("wall", "surface"), ("floor", "surface"), ("building", "structure"), ("pipe", "structure"), ("equipment", "object"), ("tree", "vegetation")]
    rows = []
    for k in range(count):
        label, parent = rng.choice(kinds)
        x, y, z = rng.uniform(0, spread), rng.uniform(0, 2), rng.uniform(0, 0.5)
        h = rng.choice((0.05, 0.1, 0.6))
        rows.append(dict(target_id=1000 + k, frame=rng.randrange(0, 900), label=label, parent=parent, x=x, y=y, z=z, x0=x - h, y0=y - h, z0=z - h, x1=x + h, y1=y + h, z1=z + h, r=rng.uniform(0, 90), g=0.0, b=0.0, nx=rng.uniform(-0.4, 0.4), ny=0.0, nz=1.0, points=rng.randrange(0, 40), confidence=rng.choice((1.0, 0.9, 0.3)), mixed=rng.random() < 0.2, mergeable=rng.random() < 0.5, terms=rng.sample(["pump", "fan", "red", "old"], rng.randrange(3)), attachment=rng.choice(("unknown", "unknown", "merge_to_structural_region", "attached_object_candidate")), point_ids=[rng.randrange(6)]))
    return pd.DataFrame(rows)


def plain_fusion(rows, limits):
    """Every object is tried in turn; those of a far zone or whose box has no cell in common are passed over."""
    cells = lambda lo, hi: {(a, b, c) for a in range(math.floor(lo[0] - limits.box), math.floor(hi[0] + limits.box) + 1) for b in range(math.floor(lo[1] - limits.box), math.floor(hi[1] + limits.box) + 1) for c in range(math.floor(lo[2] - limits.box), math.floor(hi[2] + limits.box) + 1)}
    found, out = [], {}
    for t in rows.sort_values(["frame", "target_id"]).itertuples():
        best = None
        for body in found:
            if abs(t.frame // limits.zone - body.zone) <= limits.window and cells(body.box[:3], body.box[3:]) & cells((t.x0, t.y0, t.z0), (t.x1, t.y1, t.z1)):
                ok, _, away = fusion.judged(body, t, limits)
                if ok and (best is None or away < best[0]):
                    best = away, body
        if best is None:
            best = 0, fusion.Body(t.target_id, t.frame // limits.zone, [t.x0, t.y0, t.z0, t.x1, t.y1, t.z1])
            found.append(best[1])
        best[1].take(t)
        out[t.target_id] = best[1].name
    return out


@pytest.mark.parametrize("limits", [fusion.Limits(), fusion.Limits(zone=50, window=0), fusion.Limits(strict_surfaces=True, zone=300)])
def test_groups_that_cannot_meet_change_nothing(spark, limits):
    rows = random_targets(limits.zone, 350, 40.0)
    frame = spark.createDataFrame(rows).repartition(5)
    groups = fusion.meeting_groups(frame, limits)
    assert groups.select("family", "meets").distinct().count() > 10
    got = {r["target_id"]: r["object_id"] for r in fusion.fused(frame, limits).collect()}
    assert got == plain_fusion(rows, limits) and len(set(got.values())) < len(got)


def test_objects_and_zones(spark):
    rows = pd.DataFrame([vars(target(target_id=k, frame=f, label=n, parent="surface", points=p, confidence=c, attachment=a)) for k, f, n, p, c, a in [(1, 5, "wall", 10, 1.0, "u"), (2, 6, "floor", 5, 0.5, "v"), (3, 130, "car", 3, 1.0, "v"), (4, 131, "car", 3, 1.0, "u"), (5, 7, "floor", 75, 0.1, "v"), (6, 99, "tree", 0, 1.0, "u")]])
    decisions = spark.createDataFrame([(1, 1), (2, 1), (5, 1), (3, 3), (4, 3), (6, 6)], "target_id long, object_id long")
    frame = spark.createDataFrame(rows.assign(terms=[["x"]] * 6, point_ids=[[1]] * 6))
    got = {r["object_id"]: r for r in fusion.objects(decisions, frame).collect()}
    # wall and floor have a weight of 10 each: the first voted for is dominant, neither has its share
    assert (got[1]["label"], got[1]["dominant_label"], got[1]["label_share"], got[1]["status"], got[1]["dominant_attachment"]) == ("ambiguous", "wall", 0.5, "ambiguous_object", "u")
    assert (got[3]["label"], got[3]["status"], got[3]["dominant_attachment"]) == ("car", "stable", "v") and (got[6]["status"], got[6]["points"]) == ("single_target", 1)
    zones = {r["zone"]: (r["objects"], r["first_frame"], r["last_frame"]) for r in fusion.zones(fusion.objects(decisions, frame)).collect()}
    assert zones == {0: (2, 5, 99), 1: (1, 130, 131)}


def test_query_equals_one_fold_over_all(spark):
    rows = sightings.sighted(spark, SF)
    plain = {r[0]: r for r in fusion.folded(rows.select(*fusion.TARGET).toPandas(), fusion.Limits())}
    got = {r["target_id"]: tuple(r) for r in sightings.target_decisions(spark, SF).collect()}
    assert got.keys() == plain.keys() and all(got[k][:3] == plain[k][:3] for k in got)
    # why a target joined nothing is told by its own family, as far as it goes
    assert all(got[k][3] == plain[k][3] for k in got if got[k][2] == "merge")
    family = {r["target_id"]: r["family"] for r in fusion.meeting_groups(rows, fusion.Limits()).collect()}
    frame = rows.select(*fusion.TARGET).toPandas()
    apart = {r[0]: r for _, part in frame.groupby(frame["target_id"].map(family)) for r in fusion.folded(part, fusion.Limits())}
    assert all(got[k][:4] == apart[k][:4] for k in got)
    assert {r[3] for r in got.values()} >= {"same_label_geometry_color", "point_overlap", "same_parent_surface_review", "identity_gate", "quality_gate", "structural_target_to_object_block", "attached_target_to_surface_block"}


def test_confidence_and_terms(spark):
    frame = spark.createDataFrame([("0.5", "A red Pump on the roof", "x9 of"), ("7", None, None), ("-1", "the unit", ""), ("no", "", "A-b ccc")], "c string, a string, b string")
    got = [tuple(r) for r in frame.select(fusion.confidence_of(F.col("c")), fusion.identity_terms(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.5, ["pump", "red"]), (1.0, []), (0.0, []), (1.0, ["ccc"])]


def plain_pieces(rows, runs, rules):
    """Pixel by pixel, then flood fill over cells."""
    images, first = {}, {}
    for r in runs:
        for at in range(r.start, r.start + r.length):
            images.setdefault((r.frame, r.cam), {})[at // rules.height, at % rules.height] = (r.mask_id, r.label)
    for p in rows:
        key = (p.frame, p.cam, p.u, p.v)
        first[key] = min(first.get(key, np.inf), p.depth)
    chosen = {}
    for p in rows:
        image = images.get((p.frame, p.cam), {})
        mask, label = image.get((p.u, p.v), (0, "ignore"))
        if not mask or label in rules.skip:
            continue
        if rules.erode and (not rules.erode_labels or label in rules.erode_labels):
            r = rules.erode
            if any(image.get((p.u + a, p.v + b), (0, ""))[0] != mask for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r):
                continue
        if rules.window and (not rules.depth_labels or label in rules.depth_labels):
            w = range(-rules.window, rules.window + 1)
            if p.depth > min(first.get((p.frame, p.cam, p.u + a, p.v + b), np.inf) for a in w for b in w) + rules.depth_edge:
                continue
        chosen.setdefault((p.frame, p.cam, mask, label), []).append(p)
    out = {}
    for (frame, cam, mask, label), held in chosen.items():
        size, cells, parts = dict(rules.cells).get(label, rules.cell), {}, []
        for p in held:
            cells.setdefault((p.x // size, p.y // size, p.z // size), []).append(p.point_id)
        while cells:
            queue, ids = [next(iter(cells))], []
            while queue:
                c = queue.pop()
                if c in cells:
                    ids += cells.pop(c)
                    queue += [(c[0] + a, c[1] + b, c[2] + d) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)]
            parts.append(sorted(ids))
        large = sorted((ids for ids in parts if len(ids) >= rules.least), key=lambda ids: (-len(ids), ids[0]))
        for k, ids in enumerate(large):
            out |= {i: f"t_{frame:04d}_cam{cam}_m{mask:04d}_c{k:02d}" for i in ids}
        out |= {i: None for ids in parts if len(ids) < rules.least for i in ids}
    return out


@pytest.mark.parametrize("rules", [sightings.RULES, replace(sightings.RULES, erode=0, window=0), replace(sightings.RULES, erode=2, erode_labels=(), depth_labels=(), least=2, skip=("wall",))])
def test_pieces_of_masks_against_pixels(spark, rules):
    points, runs = sightings.placed(spark, SF).filter("frame < 12"), sightings.mask_runs(spark, SF).filter("frame < 12 AND start >= 480 * 200 AND start < 480 * 440")
    want = plain_pieces(points.collect(), runs.collect(), rules)
    got = {r["point_id"]: r["target_id"] for r in targets.pieces(points, runs, rules).collect()}
    assert got == want and None in got.values() and len(set(got.values())) > 5


def test_targets_are_the_sums_of_their_points(spark):
    rng = np.random.default_rng(2)
    flat = rng.standard_normal((200, 3)) * [2.0, 1.0, 0.01] @ np.linalg.qr(rng.standard_normal((3, 3)))[0]
    rows = [(k, *map(float, p), k % 256, 5, 9) for k, p in enumerate(flat)] + [(900, 1.0, 2.0, 3.0, 7, 7, 7), (901, 2.0, 2.0, 3.0, 8, 7, 7)]
    named = [(*r, 1, 0, 4 if r[0] < 900 else 5, 0, "car", "a" if r[0] < 900 else "b") for r in rows]
    frame = spark.createDataFrame(named, "point_id long, x double, y double, z double, r int, g int, b int, frame int, cam int, mask_id int, piece int, label string, target_id string")
    got = {r["target_id"]: r for r in targets.summaries(frame).collect()}
    values, vectors = np.linalg.eigh(np.cov(flat.T))
    up = vectors[:, 0] * (1 if vectors[2, 0] >= 0 else -1)
    assert np.allclose([got["a"][f"n{c}"] for c in "xyz"], up, atol=1e-6)
    assert got["a"]["planarity"] == pytest.approx((values[1] - values[0]) / values[2]) and got["a"]["linearity"] == pytest.approx((values[2] - values[1]) / values[2])
    assert got["a"]["points"] == 200 and got["a"]["point_ids"] == list(range(200)) and got["a"]["x1"] == flat[:, 0].max()
    assert [got["b"][f"n{c}"] for c in "xyz"] == [0.0, 0.0, 1.0] and got["b"]["planarity"] == 0.0 and got["b"]["r"] == 7.5
    assert targets.summaries(frame.filter("piece > 9")).count() == 0 and targets.residuals(frame.withColumn("target_id", F.lit(None).cast("string"))).collect()[0]["points"] == 202


def test_runs_longer_than_a_block(spark):
    runs = spark.createDataFrame([(0, 0, 1, "car", 100, 10_000), (0, 0, 2, "car", 10_100, 0), (0, 0, 3, "car", 10_100, 5)], "frame int, cam int, mask_id int, label string, start long, length long")
    points = spark.createDataFrame([(0, 0, u, v) for u in range(0, 30) for v in range(-1, 481, 7)], "frame int, cam int, u int, v int")
    got = {(r["u"], r["v"]): r["mask_id"] for r in targets.in_masks(points, runs, 480).collect()}
    want = {(u, v): 1 if u * 480 + v < 10_100 else 3 for u in range(30) for v in range(-1, 481, 7) if 0 <= v < 480 and 100 <= u * 480 + v < 10_105}
    assert got == want
