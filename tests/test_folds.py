"""Folds and graph operators against plain loops."""

import random
from itertools import product

import numpy as np
import pytest

from terrane.operators import graph, neighbours, patches, timing, tracks, voxels


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    pairs = random_edges(seed, 120, 80) + [(k, k + 1) for k in range(200, 260)]
    nodes = list(range(300))
    got = graph.components(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "node long")).collect()
    assert {r["node"]: r["component"] for r in got} == roots(nodes, pairs)


def test_greedy_union_is_the_same_component_by_component(spark):
    rng = random.Random(3)
    pairs = [(a, b, round(rng.random(), 3), rng.randint(1, 9)) for a, b in random_edges(3, 60, 45)]
    size = {n: rng.randint(1, 20) for n in range(70)}
    name = {n: n for n in size}
    total, inner = dict(size), dict.fromkeys(size, 0.0)
    for a, b, score, _ in sorted(pairs, key=lambda p: (p[2], p[3], p[0], p[1]), reverse=True):
        p, q = name[a], name[b]
        if p == q or score < 0.3 or 1 - score > min(inner[p] + 2 / total[p], inner[q] + 2 / total[q]):
            continue
        if total[q] > total[p]:
            p, q = q, p
        total[p] += total[q]
        inner[p] = max(inner[p], 1 - score)
        name = {n: p if c == q else c for n, c in name.items()}
    got = graph.greedy_union(spark.createDataFrame(pairs, "a long, b long, score double, shared long"), spark.createDataFrame(list(size.items()), "node long, size long"), 2.0, 0.3)
    assert {r["node"]: r["cluster"] for r in got.collect()} == name


FLAT, STEEP, ROUGH, MIXED = [0, 50, 0, 0, 0], [0, 0, 50, 0, 0], [0, 0, 0, 0, 50], [20, 20, 10, 0, 0]


@pytest.mark.parametrize(
    ("edge", "first", "second", "gates", "joins"),
    [
        ({"score": 0.7}, FLAT, FLAT, {}, True),
        ({"score": 0.5}, FLAT, FLAT, {}, False),
        ({"score": 0.5, "support": 0.3, "color": 60.0, "color_p90": 75.0}, FLAT, FLAT, {}, True),
        ({"score": 0.5, "support": 0.2, "color": 60.0, "color_p90": 75.0}, FLAT, FLAT, {}, False),
        ({"score": 0.5, "support": 0.3, "color": 60.0, "color_p90": 85.0}, FLAT, FLAT, {}, False),
        ({"score": 0.5, "support": 0.3, "color": 60.0, "color_p90": 75.0}, FLAT, STEEP, {}, False),
        ({"score": 0.5, "support": 0.3, "color": 60.0, "color_p90": 75.0}, MIXED, MIXED, {}, False),
        ({"score": 0.5, "gap": 0.1, "color": 69.0, "normal": 0.7}, STEEP, STEEP, {}, True),
        ({"score": 0.5, "gap": 0.2, "color": 69.0, "normal": 0.7}, STEEP, STEEP, {}, False),
        ({"score": 0.5, "gap": 0.1, "color": 69.0, "normal": 0.6}, STEEP, STEEP, {}, False),
        ({"score": 0.5, "gap": 0.1, "color": 50.0, "contacts": 9.0}, FLAT, ROUGH, {"fragment_contacts": 5.0, "surface_size": 50, "fragment_size": 60}, True),
        ({"score": 0.5, "gap": 0.1, "color": 50.0, "contacts": 4.0}, FLAT, ROUGH, {"fragment_contacts": 5.0, "surface_size": 50, "fragment_size": 60}, False),
        ({"score": 0.5, "gap": 0.1, "color": 50.0, "contacts": 9.0}, FLAT, ROUGH, {"fragment_contacts": 5.0, "surface_size": 51, "fragment_size": 60}, False),
        ({"score": 0.9, "gap": 0.1, "color": 50.0, "contacts": 9.0}, FLAT, ROUGH, {"fragment_contacts": 5.0, "surface_size": 50, "fragment_size": 60, "least_size": 60}, True),
        ({"score": 0.9}, FLAT, FLAT, {"least_size": 60}, False),
        ({"score": 0.9}, FLAT, STEEP, {}, True),
        ({"score": 0.9}, FLAT, STEEP, {"veto_share": 0.4}, False),
        ({"score": 0.9}, FLAT, STEEP, {"veto_share": 0.4, "veto_size": 51}, True),
        ({"score": 0.9}, FLAT, STEEP, {"most_entropy": 0.9}, False),
        ({"score": 0.9}, FLAT, FLAT, {"k": 4.0}, False),
        ({"score": 0.9}, FLAT, FLAT, {"k": 6.0}, True),
    ],
)
def test_each_gate_of_superpoints(spark, edge, first, second, gates, joins):
    names = ("score", "support", "color", "color_p90", "normal", "gap", "contacts")
    edges = spark.createDataFrame([(1, 2, 3, *[edge.get(n) for n in names])], "a long, b long, shared long, " + ", ".join(f"{n} double" for n in names))
    nodes = spark.createDataFrame([(1, 50, first), (2, 50, second), (3, 1, FLAT)], "node long, size long, counts array<long>")
    got = {r["node"]: r["cluster"] for r in graph.superpoints(edges, nodes, graph.Gates(**gates)).collect()}
    assert got == {1: 1, 2: 1 if joins else 2, 3: 3}


def test_superpoints_judge_what_clusters_have_become(spark):
    # 2 joins 1 first; the union is mixed, so that the bridge to 3 no longer holds
    names = "a long, b long, score double, shared long, support double, color double, color_p90 double, normal double, gap double, contacts double"
    edges = spark.createDataFrame([(1, 2, 0.9, 1, None, None, None, None, None, None), (1, 3, 0.5, 1, 0.9, 1.0, 1.0, None, None, None)], names)
    nodes = spark.createDataFrame([(1, 50, FLAT), (2, 50, STEEP), (3, 50, FLAT)], "node long, size long, counts array<long>")
    got = {r["node"]: r["cluster"] for r in graph.superpoints(edges, nodes, graph.Gates()).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    alone = {r["node"]: r["cluster"] for r in graph.superpoints(edges.filter("b = 3"), nodes, graph.Gates()).collect()}
    assert alone == {1: 1, 2: 2, 3: 1}


def test_repeated_rows_stay_apart_in_time_joins(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 99.0)], "k long, t double")
    right = spark.createDataFrame([(1, 4.0, 7), (1, 6.0, 8), (1, 7.0, 9)], "k long, t double, id long")
    assert [tuple(r) for r in timing.nearest_in_time(left, right, ["k"], "t", 3.0, "id").collect()] == [(1, 5.0, 7, 1.0)] * 2


def test_pareto_matches_plain_loops(spark):
    from terrane.operators import decisions

    rng = random.Random(5)
    rows = [(k, float(rng.randrange(12)), float(rng.randrange(12)), float(rng.randrange(12))) for k in range(300)] + [(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0)]
    got = {r["k"] for r in decisions.pareto(spark.createDataFrame(rows, "k long, x double, y double, z double").repartition(5), "k", ["x", "y", "z"]).collect()}
    real = rows[:300]
    beats = lambda p, q: all(a <= b for a, b in zip(p[1:], q[1:], strict=True)) and p[1:] != q[1:]
    assert got == {q[0] for q in real if not any(beats(p, q) for p in real)}


def test_propagation_stops_at_the_best_paths_hops(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (1, 3, 0.5), (9, 10, 1.0)], "a long, b long, weight double")
    anchors = spark.createDataFrame([(1, "wall", 1.0)], "node long, label string, score double")
    got = {r["node"]: (r["label"], round(r["score"], 4), r["hops"]) for r in graph.propagated(edges, anchors, 2, 0.01).collect()}
    # 3 is settled by its better path of two hops and goes no further, though one hop reaches it too
    assert got == {1: ("wall", 1.0, 0), 2: ("wall", 0.9, 1), 3: ("wall", 0.81, 2)}


def test_regions_grow_while_the_mean_allows(spark):
    cells = spark.createDataFrame([(k, 0, float(v)) for k, v in enumerate([0, 1, 2, 3, 10, 11, 12])], "node long, rank long, value double")
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)], "a long, b long")
    got = {r["node"]: r["region"] for r in graph.grown(edges, cells, 1.6).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4}


def test_tracklets_and_fusion(spark):
    rows = [(1, "a", "f", 0, 0.0, 0.0, 0.0, 10.0, 5), (2, "a", "f", 1, 0.1, 0.0, 0.0, 12.0, 5), (3, "a", "f", 30, 0.1, 0.0, 0.0, 12.0, 1), (4, "b", "f", 1, 0.1, 0.0, 0.0, 12.0, 1), (5, "a", "g", 1, 9.0, 0.0, 0.0, 10.0, 1)]
    targets = spark.createDataFrame(rows, "target_id long, label string, family string, frame long, x double, y double, z double, color double, points int")
    got = {r["target_id"]: r["tracklet"] for r in tracks.tracklets(targets, 15, 0.35, 45.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    fused = tracks.fused_objects(targets, 100, 1, 0.35, 70.0)
    assert {r["target_id"]: r["object_id"] for r in fused.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    done = {r["object_id"]: (r["label"], r["status"]) for r in tracks.finished(fused, targets).collect()}
    assert done == {1: ("ambiguous", "ambiguous_object"), 5: ("a", "single_target")} or done[1] == ("a", "stable")


def test_sync_path_is_the_cheapest_of_all(spark):
    rng = random.Random(6)
    rows = [(0, f * 2, v, rng.random()) for f in range(4) for v in rng.sample(range(20), 4)]
    frames = [[r for r in sorted(rows, key=lambda r: r[2]) if r[1] == f * 2] for f in range(4)]

    def cost(path):
        total = -sum(3.0 * r[3] for r in path)
        for a, b in zip(path, path[1:]):
            step = b[2] - a[2]
            total += 1000 + abs(step) * 2 if step < 0 else 2 * abs(step / 2 - 1.5)
        return total

    best = min(product(*frames), key=cost)
    got = tracks.sync_paths(spark.createDataFrame(rows, "cam_id long, frame_id long, video_idx long, score double"), 3.0, 1000.0, 2.0, 1.5)
    assert [r["video_idx"] for r in got.orderBy("frame_id").collect()] == [r[2] for r in best]


def test_matching_and_suppression(spark):
    rows = [(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.6), (1, 3, 3, 0.1), (2, 1, 1, 0.7)]
    got = tracks.greedy_matches(spark.createDataFrame(rows, "image long, left long, right long, iou double"), "image", 0.5)
    assert sorted((r["image"], r["l"], r["r"]) for r in got.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
    boxes = [(1, 1, 0.9, 0.0, 0.0, 2.0, 2.0), (1, 2, 0.8, 0.1, 0.0, 2.1, 2.0), (1, 3, 0.7, 5.0, 5.0, 6.0, 6.0), (2, 4, 0.1, 0.0, 0.0, 1.0, 1.0)]
    left = tracks.suppressed(spark.createDataFrame(boxes, "image long, box long, score double, x0 double, y0 double, x1 double, y1 double"), 0.5)
    assert sorted(r["box"] for r in left.collect()) == [1, 3, 4]


def test_planes_of_a_target(spark):
    rng = random.Random(2)
    rows = [(1, k, rng.random() * 5, rng.random() * 5, 0.0) for k in range(40)] + [(1, 100 + k, rng.random() * 5, 0.0, 1 + rng.random() * 5) for k in range(30)]
    got = tracks.plane_splits(spark.createDataFrame(rows, "target long, point_id long, x double, y double, z double"), "target", 2, 0.01, 10, 60).collect()
    plane = {r["point_id"]: r["plane"] for r in got}
    assert {plane[k] for k in range(40)} == {1} and {plane[100 + k] for k in range(30)} == {2}


def test_eigenvalues_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), *map(float, rng.standard_normal(3) * (1, 3, 0.1) + rng.standard_normal(3))) for k in range(6) for _ in range(30)]
    rows += [(50, 1.0, 2.0, 3.0)] * 5
    frame = spark.createDataFrame(rows, "k long, x double, y double, z double").selectExpr("*", "0 AS r", "0 AS g", "0 AS b")
    for row in patches.shape(patches.sums(frame, ["k"])).collect():
        own = np.array([r[1:] for r in rows if r[0] == row["k"]])
        assert np.allclose(np.linalg.eigvalsh(np.cov(own.T))[::-1], [row["e1"], row["e2"], row["e3"]], atol=1e-9)


def test_offsets():
    assert len(neighbours.offsets("faces")) == 6 and len(neighbours.offsets("cube")) == 26 and len(neighbours.positive(neighbours.offsets("cube"))) == 13
    assert len(neighbours.offsets("ball", 2)) == 32


def test_box_pairs_in_any_cell_size(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        low = [rng.uniform(-10, 10) for _ in range(3)]
        rows.append((k, *[c for v in low for c in (v, v + rng.uniform(0, 4))]))
    boxes = spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    gap = lambda a, b: sum(max(0.0, a[2 * c + 1] - b[2 * c + 2], b[2 * c + 1] - a[2 * c + 2]) ** 2 for c in range(3)) ** 0.5
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and gap(a, b) <= 0.7}
    for cell in (1.0, 5.0):
        got = neighbours.box_pairs(boxes, "id", 0.7, cell).select("a_id", "b_id").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_ties_of_dominant_votes(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (2, "a")], "k long, label string")
    got = {r["k"]: (r["label"], r["share"]) for r in voxels.dominant(voxels.votes(rows, ["k"]), ["k"]).collect()}
    assert got[1] == ("a", 0.5) and got[2][0] == "c"


def test_last_frame_uses_the_interval_before(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 2, 2.0), (1, 3, 5.0), (2, 1, 7.0)], "k long, f long, t double")
    got = {(r["k"], r["f"]): r["shifted"] for r in timing.shifted(rows, ["k"], "f", "t", 0.5).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 3.5, (1, 3): 6.5, (2, 1): 7.0}


def test_near_groups_hold_every_chain_of_steps(spark):
    rng = random.Random(5)
    rows = [(k, k % 2, round(rng.uniform(-20, 20), 2), rng.randint(-40, 40)) for k in range(150)] + [(200, None, 0.5, 0), (201, 1, None, 0)]
    whole = [r for r in rows if None not in r]
    chains = roots([r[0] for r in whole], [(a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 1.0 and abs(a[3] - b[3]) <= 2])
    found = graph.near_groups(spark.createDataFrame(rows, "id long, k long, x double, frame long"), ["k"], {"x": 1.0, "frame": 2})
    assert found.columns == ["id", "k", "x", "frame", "near"]
    near = {r["id"]: r["near"] for r in found.collect()}
    assert len(near) == len(rows)
    assert all(near[n] == near[c] for n, c in chains.items())
    assert len({near[n] for n in chains}) > 10
    assert graph.near_groups(spark.createDataFrame([], "k long, x double"), ["k"], {"x": 1.0}).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_split_folds_match_one_fold_over_all(spark, seed):
    rng = random.Random(seed)
    rows = [(k, "ab"[k % 2], "one", rng.randint(0, 60), rng.uniform(0, 6), rng.uniform(0, 6), 0.0, rng.uniform(0, 90), rng.randint(0, 4)) for k in range(160)]
    targets = spark.createDataFrame(rows, "target_id long, label string, family string, frame long, x double, y double, z double, color double, points long")

    def away(o, r):
        return ((r[4] - o["at"][0]) ** 2 + (r[5] - o["at"][1]) ** 2 + (r[6] - o["at"][2]) ** 2) ** 0.5

    tracklet, known = {}, []
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        fit = [(away(o, r) + abs(r[7] - o["color"]) / 255, k) for k, o in enumerate(known) if o["label"] == r[1] and r[3] - o["frame"] <= 5 and away(o, r) <= 0.8 and abs(r[7] - o["color"]) <= 45]
        if not fit:
            known.append({"name": r[0], "label": r[1]})
        o = known[min(fit)[1] if fit else -1]
        o.update(at=r[4:7], color=r[7], frame=r[3])
        tracklet[r[0]] = o["name"]
    assert {r["target_id"]: r["tracklet"] for r in tracks.tracklets(targets, 5, 0.8, 45.0).collect()} == tracklet

    fused, known = {}, []
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        fit = [(away(o, r), k) for k, o in enumerate(known) if abs(r[3] // 10 - o["zone"]) <= 1 and away(o, r) <= 0.5 and abs(r[7] - o["color"]) <= 70]
        if not fit:
            known.append({"name": r[0], "zone": r[3] // 10, "n": 0, "at": (0.0, 0.0, 0.0), "color": 0.0})
        o, w = known[min(fit)[1] if fit else -1], max(r[8], 1)
        o["at"] = tuple((c * o["n"] + v * w) / (o["n"] + w) for c, v in zip(o["at"], r[4:7], strict=True))
        o["color"] = (o["color"] * o["n"] + r[7] * w) / (o["n"] + w)
        o["n"] += w
        fused[r[0]] = o["name"]
    assert {r["target_id"]: r["object_id"] for r in tracks.fused_objects(targets, 10, 1, 0.5, 70.0).collect()} == fused


def test_long_association_matches_one_fold_over_all(spark):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        first = rng.randint(0, 200)
        rows.append((k, "ab"[k % 2], first, first + rng.randint(0, 8), rng.uniform(0, 5), rng.uniform(0, 5), 0.0, rng.uniform(0, 60)))
    tiers = [("near", 0.4, 20.0, -2.0), ("far", 0.9, 40.0, 0.0)]
    known, want = [], {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        best = None
        for o in known:
            if o["label"] != r[1] or not 1 <= r[2] - o["last"] <= 60:
                continue
            away = sum((a - b) ** 2 for a, b in zip(r[4:7], o["at"], strict=True)) ** 0.5
            tier = next((t for t in tiers if away <= t[1] and abs(r[7] - o["color"]) <= t[2]), None)
            if tier and (best is None or away + tier[3] < best[0]):
                best = (away + tier[3], o, tier[0])
        if best is None:
            best = (0, {"name": r[0], "label": r[1], "last": r[3]}, "new")
            known.append(best[1])
        o = best[1]
        o.update(last=max(r[3], o["last"]), at=r[4:7], color=r[7])
        want[r[0]] = (o["name"], best[2])
    frame = spark.createDataFrame(rows, "tracklet long, label string, first long, last long, x double, y double, z double, color double")
    assert {r["tracklet"]: (r["long_object"], r["reason"]) for r in tracks.associated(frame, 1, 60, tiers).collect()} == want


def test_residual_points_take_the_label_of_their_plane(spark):
    from terrane.operators import objects

    rng = random.Random(4)
    floor = [(k, rng.uniform(0, 4), rng.uniform(0, 4), 0.0, 100, 100, 100, "floor") for k in range(400)]
    near = [(1000, 2.0, 2.0, 0.05, 100, 110, 100, "car"), (1001, 2.0, 2.0, 0.3, 100, 100, 100, "car"), (1002, 1.0, 1.0, 0.02, 250, 0, 100, None), (1003, 9.0, 9.0, 0.0, 100, 100, 100, "car"), (1004, 3.0, 1.0, -0.05, 100, 100, 100, None)]
    schema = "point_id long, x double, y double, z double, r long, g long, b long, label string"
    found = objects.resurfaced(spark.createDataFrame(floor + near, schema), ["floor"], 0.5, 50, 5, 0.6, 8, 0.1, 0.05, 60.0).collect()
    assert sorted((r["point_id"], r["label"], round(r["away"], 6)) for r in found) == [(1000, "floor", 0.05), (1004, "floor", 0.05)]
    assert objects.resurfaced(spark.createDataFrame([], schema), ["floor"], 0.5, 50, 5, 0.6, 8, 0.1, 0.05, 60.0).count() == 0


def settled_best_first(edges, anchors, most_hops, least):
    import heapq

    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    heap = [(-s, n, label, 0) for n, label, s in anchors]
    heapq.heapify(heap)
    found = {}
    while heap:
        score, node, label, hops = heapq.heappop(heap)
        if node not in found:
            found[node] = (label, -score, hops)
            for other, w in near.get(node, []) if hops < most_hops else []:
                if -score * w >= least:
                    heapq.heappush(heap, (score * w, other, label, hops + 1))
    return found


@pytest.mark.parametrize(("seed", "hops"), [(1, 1), (2, 3), (3, 8)])
def test_propagation_by_rounds_settles_as_best_first(spark, seed, hops):
    rng = random.Random(seed)
    edges = [(*sorted(rng.sample(range(60), 2)), rng.uniform(0.3, 0.999)) for _ in range(140)]
    anchors = [(n, f"k{n % 4}", rng.uniform(0.2, 1.0)) for n in rng.sample(range(60), 9)] + [(500, "alone", 0.01)]
    got = graph.propagated(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame(anchors, "node long, label string, score double"), hops, 0.05)
    assert {r["node"]: (r["label"], r["score"], r["hops"]) for r in got.collect()} == settled_best_first(edges, anchors, hops, 0.05)


def test_components_by_rounds_and_in_one_task_agree(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in range(400)], "node long")
    for own, count in ((nodes, 400), (None, None)):
        rounds, once = (sorted(map(tuple, graph.components(edges, own, few=few).collect())) for few in (0, 1000))
        assert rounds == once and (count is None or len(once) == count)
    assert {c for n, c in once if n >= 1000} == {1000}
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "a string, b string")
    assert sorted(map(tuple, graph.components(words).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_silences_cut_groups(spark):
    rows = spark.createDataFrame([(1, f) for f in (1, 2, 2, 5, 20, 21)] + [(2, f) for f in (1, 100)], "k long, frame int")
    got = sorted(map(tuple, tracks.after_silences(rows, ["k"], "frame", 5).select("k", "frame", "spell").collect()))
    assert got == [(1, 1, 0), (1, 2, 0), (1, 2, 0), (1, 5, 0), (1, 20, 1), (1, 21, 1), (2, 1, 0), (2, 100, 1)]
