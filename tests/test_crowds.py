"""Folds where many things are near each other: the same results as plain loops, and what is open is held once."""

import random

from terrane.operators import tracks


def crowd(spark, n=3000, frames=90):
    pick = random.Random(5)
    rows = [(k, "ab"[k % 2], k * frames // n, pick.randrange(60) * 0.25, float(pick.randrange(4)), 0.0, float(pick.randrange(100)), 1 + k % 3) for k in range(n)]
    return rows, spark.createDataFrame(rows, "target_id long, label string, frame long, x double, y double, z double, color double, points long")


def test_tracklets_of_a_crowd_match_a_plain_loop(spark):
    rows, targets = crowd(spark)
    want, open_ = {}, {"a": [], "b": []}
    for name, label, frame, x, y, z, color, _ in rows:
        near = []
        for k, t in enumerate(open_[label]):
            away, shade = ((x - t[2]) ** 2 + (y - t[3]) ** 2 + (z - t[4]) ** 2) ** 0.5, abs(color - t[5])
            if frame - t[1] <= 4 and away <= 2.0 and shade <= 45.0:
                near.append((away + shade / 255, k))
        own = open_[label][min(near)[1]] if near else [name]
        if not near:
            open_[label].append(own)
        own[1:] = [frame, x, y, z, color]
        want[name] = own[0]
    found = tracks.tracklets(targets, 4, 2.0, 45.0)
    assert {r["target_id"]: r["tracklet"] for r in found.collect()} == want
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_fused_objects_of_a_crowd_match_a_plain_loop(spark):
    rows, targets = crowd(spark)
    want, known = {}, {"a": [], "b": []}
    for name, label, frame, x, y, z, color, points in rows:
        near = [(((x - o[3]) ** 2 + (y - o[4]) ** 2 + (z - o[5]) ** 2) ** 0.5, k) for k, o in enumerate(known[label]) if frame // 20 - o[1] <= 1 and abs(color - o[6]) <= 70.0]
        near = [p for p in near if p[0] <= 1.5]
        own = known[label][min(near)[1]] if near else [name, frame // 20, 0, 0.0, 0.0, 0.0, 0.0]
        if not near:
            known[label].append(own)
        own[3:] = [(a * own[2] + b * points) / (own[2] + points) for a, b in zip(own[3:], (x, y, z, color), strict=True)]
        own[2] += points
        want[name] = own[0]
    found = tracks.fused_objects(targets.withColumnRenamed("label", "family"), 20, 1, 1.5, 70.0)
    assert {r["target_id"]: r["object_id"] for r in found.collect()} == want
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_what_is_open_is_held_once():
    near, thing = tracks.Near(1.5), {"x": 0.0, "y": 0.0, "z": 0.0}
    for k in range(1000):
        thing |= {"x": k % 7 * 1.0}
        near.put(thing)
    assert sum(len(held) for held in near.cells.values()) == 1
    assert [t for held in near.about(thing["x"] + 1.5, 0.0, 0.0) for t in held.values()] == [thing]


def test_large_even_pixel_tables_are_never_broadcast(spark):
    from dataclasses import replace

    from terrane.operators import targets
    from terrane.plans import sightings

    runs = spark.range(0, 4000, 2).selectExpr("0 frame", "0 cam", "1 mask_id", "'car' label", "id * 480 + 100 start", "300L length")
    points = spark.range(100).selectExpr("0 frame", "0 cam", "id u", "150L v", "1.0D depth")
    held = targets.kept_in_masks(points, runs, replace(sightings.RULES, erode=1))
    held.collect()
    plan = held._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" not in plan and {r["gone"] for r in held.collect()} == {"boundary"}
