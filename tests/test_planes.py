import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import planes


def scene(seed):
    """A floor and two walls of target 1, two floors apart of target 2, a blob of target 3, a few points of target 4."""
    rng = np.random.default_rng(seed)
    flat = lambda n, w, d: np.column_stack((rng.uniform(0, w, n), rng.uniform(0, d, n), np.zeros(n)))
    floor, side, back = flat(500, 4, 3), flat(300, 4, 2)[:, [0, 2, 1]] + [0, 3.4, 0.3], flat(200, 3, 2)[:, [2, 0, 1]] + [4.4, 0, 0.3]
    far = np.concatenate((flat(250, 2, 2), flat(150, 2, 2) + [9, 0, 0]))
    rows = [(1, "building", "floor", p) for p in floor] + [(1, "building", "side", p) for p in side] + [(1, "building", "back", p) for p in back]
    rows += [(2, "wall", "near" if k < 250 else "far", p) for k, p in enumerate(far)] + [(3, "tree", "blob", p) for p in rng.uniform(0, 1.5, (120, 3))] + [(4, "tree", "few", p) for p in rng.uniform(0, 1, (9, 3))]
    return [(t, label, k, *map(float, p), name) for k, (t, label, name, p) in enumerate(rows)]


@pytest.mark.parametrize("parts", [1, 6])
def test_planes_and_pieces_of_a_scene(spark, parts):
    rows = scene(7)
    frame = spark.createDataFrame(rows, "target long, label string, point_id long, x double, y double, z double, name string").repartition(parts)
    rules = planes.Rules(distance=0.02, least=100, rest=50, cell=0.5, piece=20)
    got = {r["point_id"]: (r["plane"], r["part"]) for r in planes.split(frame, "target", rules).collect()}
    assert len(got) == len(rows)
    by_name = {}
    for t, _, k, *_, name in rows:
        by_name.setdefault((t, name), set()).add(got[k])
    # floor, side and back are planes in order of size; two floors on one plane are two pieces; the blob is a rest of its own
    assert by_name[1, "floor"] == {(1, 0)} and by_name[1, "side"] == {(2, 1)} and by_name[1, "back"] == {(3, 2)}
    assert by_name[2, "near"] == {(1, 0)} and by_name[2, "far"] == {(1, 1)}
    assert by_name[3, "blob"] == {(0, 0)} and by_name[4, "few"] == {(0, None)}
    found = {(r["target"], r["part"]): (r["n"], r["label"]) for r in planes.surface_labels(frame, planes.split(frame, "target", rules), "target", "label", rules).collect()}
    assert {k: v for k, v in found.items() if k[0] < 3} == {(1, 0): (500, "floor"), (1, 1): (300, "wall"), (1, 2): (200, "wall"), (2, 0): (250, "floor"), (2, 1): (150, "floor")} and found[3, 0][0] == 120
    assert planes.split(frame.filter("target > 9"), "target", rules).count() == 0


def test_sampled_planes_take_all_points_near_them(spark):
    frame = spark.createDataFrame([r[:6] for r in scene(3) if r[0] == 1], "target long, label string, point_id long, x double, y double, z double")
    rules = planes.Rules(planes=1, distance=0.02, least=100, sample=40, cell=0.5, piece=20)
    assert planes.split(frame, "target", rules).filter(F.col("plane") == 1).count() == 500


def test_no_plane_in_a_line():
    line = np.column_stack((np.arange(20.0), np.zeros(20), np.zeros(20)))
    assert planes.found_plane(line, planes.Rules(), 1) is None and planes.found_plane(line[:2], planes.Rules(), 1) is None
    a, b, c, d = planes.found_plane(np.concatenate((line, line + [0, 1, 0])) + [0, 0, 2], planes.Rules(), 1)
    assert abs(abs(c) - 1) < 1e-9 and abs(abs(d) - 2) < 1e-9 and abs(a) + abs(b) < 1e-9


def test_points_are_kept_once_whatever_the_rounds(spark, monkeypatch):
    rows = scene(5)
    frame = spark.createDataFrame([r[:6] for r in rows], "target long, label string, point_id long, x double, y double, z double").repartition(3)
    rules, keep, kept = planes.Rules(distance=0.02, least=100, rest=50, sample=30, cell=0.5, piece=20), planes.Scratch.keep, []

    def spy(self, df):
        out = keep(self, df)
        kept.append(out[0].count())
        return out

    want = {tuple(r) for r in planes.surface_labels(frame, planes.split(frame, "target", rules), "target", "label", rules).collect()}
    monkeypatch.setattr(planes.Scratch, "keep", spy)
    assert {tuple(r) for r in planes.surfaces(frame, "target", "label", rules).collect()} == want and len(want) > 5
    assert sum(n for n in kept if n > len(rows) / 2) == len(rows)


def test_ids_that_repeat_and_targets_without_a_name_keep_their_rows(spark):
    # all of target 1 have one id, and so one hash: below a hash either none or all pass
    rows = [(1, 7, 0.01 * k, 0.01 * (k * 37 % 100), 0.0) for k in range(600)] + [(1, 7, 0.01 * k, 0.0, 5.0 + k) for k in range(9)] + [(None, 8, 1.0, 1.0, 1.0)] * 3
    frame = spark.createDataFrame(rows, "target long, point_id long, x double, y double, z double")
    got = planes.split(frame, "target", planes.Rules(planes=1, distance=0.02, least=100, sample=40, cell=0.5, piece=20)).groupBy("target", "plane").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(1, 1): 600, (1, 0): 9, (None, 0): 3}
