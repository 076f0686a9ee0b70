import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.operators import merging, neighbours, timing

KIND = "patch long, n long, x double, y double, z double, r double, g double, b double, nx double, ny double, nz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, buckets array<long>"


def patch(name, n, x=0.0, color=10.0, bucket=1, normal=(0.0, 0.0, 1.0), size=0.5, **other):
    buckets = [0] * 5
    buckets[bucket] = n
    return (name, n, x, 0.0, 0.0, color, color, color, *normal, x - size, x + size, -size, size, -size, size, other.get("buckets", buckets))


def geometry(buckets):
    total = sum(buckets)
    return "unknown" if not total else merging.BUCKETS[buckets.index(max(buckets))] if max(buckets) >= 0.65 * total else "mixed"


def plain_gain(s, a, shared, most_color=120.0, most_gap=0.35):
    held = lambda v: min(1.0, max(0.0, v))
    color = held(1 - float(np.linalg.norm(np.array(s[5:8]) - np.array(a[5:8]))) / most_color)
    p, q = np.array(s[8:11]), np.array(a[8:11])
    normal = 0.5 if min(np.linalg.norm(p), np.linalg.norm(q)) < 1e-9 else held(abs(p @ q) / np.linalg.norm(p) / np.linalg.norm(q))
    gap = float(np.linalg.norm([max(0.0, s[k] - a[k + 1], a[k] - s[k + 1]) for k in (11, 13, 15)]))
    mine, theirs = geometry(s[17]), geometry(a[17])
    off = 0.18 if theirs in ("horizontal", "vertical") and mine not in (theirs, "unknown") else 0.0
    return 0.34 * color + 0.24 * merging.plain_type_likeness(mine, theirs) + 0.16 * normal + 0.18 * min(1.0, shared / max(s[1], 1)) + 0.08 * held(1 - gap / most_gap) - off


def joined(a, s):
    n = a[1] + s[1]
    mean = [(p * a[1] + q * s[1]) / n for p, q in zip(a[2:11], s[2:11], strict=True)]
    size = float(np.linalg.norm(mean[6:9]))
    mean[6:9] = [v / size for v in mean[6:9]] if size > 1e-9 else mean[6:9]
    box = [f(p, q) for f, p, q in zip((min, max) * 3, a[11:17], s[11:17], strict=True)]
    return (a[0], n, *mean, *box, [p + q for p, q in zip(a[17], s[17], strict=True)])


def plain_absorbed(rows, edges, small, anchor, least, at_once):
    """One patch after another, smallest first; or, with `at_once`, all of one size before what they change is seen."""
    now, owner = {r[0]: r for r in rows}, {r[0]: r[0] for r in rows}
    order = sorted((r for r in rows if r[1] < small), key=lambda r: (r[1], r[0]))
    groups = [[r for r in order if r[1] == n] for n in sorted({r[1] for r in order})] if at_once else [[r] for r in order]
    for group in groups:
        seen, held, moves = dict(now), dict(owner), []
        for s in group:
            best = None
            for a, b, shared in edges:
                if s[0] in (a, b):
                    to = held[b if a == s[0] else a]
                    if to != s[0] and seen[to][1] >= anchor:
                        gain = plain_gain(s, seen[to], shared)
                        if gain >= least and (best is None or (-gain, to) < best):
                            best = (-gain, to)
            if best:
                moves.append((s, best[1]))
        for s, to in moves:
            owner[s[0]] = to
            now[to] = joined(now[to], s)
    return owner


def random_patches(seed, count):
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        n = rng.choice((1, 2, 3, 4, 5, 9, 30, 70, 200))
        split = rng.randrange(n + 1)
        buckets = [0] * 5
        buckets[rng.randrange(5)] += split
        buckets[rng.randrange(5)] += n - split
        rows.append(patch(k, n, rng.uniform(0, 3), rng.uniform(0, 60), normal=rng.choice(((0.0, 0.0, 1.0), (0.6, 0.0, 0.8), (0.0, 0.0, 0.0))), buckets=buckets))
    edges = [(*sorted(p), rng.randrange(1, 6)) for p in {tuple(rng.sample(range(count), 2)) for _ in range(3 * count)}]
    return rows, list({(a, b): (a, b, s) for a, b, s in edges}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_absorption_by_rounds_of_size(spark, seed):
    rows, edges = random_patches(seed, 90)
    got = merging.absorbed(spark.createDataFrame(rows, KIND).repartition(3), spark.createDataFrame(edges, "a long, b long, shared long"), small=6, anchor=30, least=0.5)
    found = {r["patch"]: r["owner"] for r in got.collect()}
    want = plain_absorbed(rows, edges, 6, 30, 0.5, True)
    assert found == want and sum(p != o for p, o in found.items()) > 10


def test_absorption_equals_one_after_another_where_nothing_conflicts(spark):
    rng = random.Random(5)
    rows, edges = [], []
    for k in range(12):
        base = 100 * k
        rows += [patch(base, 80, color=20.0), patch(base + 1, 1, color=rng.uniform(0, 40)), patch(base + 2, 2, color=rng.uniform(0, 40)), patch(base + 3, 4, color=rng.uniform(0, 200), bucket=2)]
        # the third touches the anchor by the second alone, the last by the first
        edges += [(base, base + 1, 3), (base + 1, base + 2, 2), (base, base + 3, 1)]
    got = {r["patch"]: r["owner"] for r in merging.absorbed(spark.createDataFrame(rows, KIND), spark.createDataFrame(edges, "a long, b long, shared long"), least=0.6).collect()}
    assert got == plain_absorbed(rows, edges, 8, 64, 0.6, False) and got[2] == 0
    none = spark.createDataFrame([], "a long, b long, shared long")
    assert all(r["patch"] == r["owner"] and r["gain"] is None for r in merging.absorbed(spark.createDataFrame(rows, KIND), none).collect())


def plain_merges(rows, cells, candidates, rules):
    """One global pass; each owner keeps the names of its patches, and a sample is taken anew from all their cells."""
    owner, members = {r[0]: r[0] for r in rows}, {r[0]: [r[0]] for r in rows}
    now, out = {r[0]: r for r in rows}, []
    for a, b, share, iou in sorted(candidates, key=lambda c: (c[2], c[3], c[0], c[1]), reverse=True):
        p, q = owner[a], owner[b]
        if p == q:
            out.append((a, b, p, q, "same_owner"))
            continue
        wholes = []
        for o in (p, q):
            sample = sorted(c for m in members[o] for c in cells[m])[: rules.sample]
            w = pd.Series(dict(n=now[o][1], red=now[o][5], green=now[o][6], blue=now[o][7], nx=now[o][8], ny=now[o][9], nz=now[o][10], buckets=now[o][17], held=[dict(zip("hxyz", c, strict=True)) for c in sample]))
            wholes.append(merging.Whole(w))
        merges, reason, _ = merging.decided(*wholes, share, rules)
        out.append((a, b, p, q, reason))
        if merges:
            keep, drop = (p, q) if now[p][1] >= now[q][1] else (q, p)
            now[keep] = joined(now[keep], now[drop])
            members[keep] += members.pop(drop)
            owner = {m: keep if o == drop else o for m, o in owner.items()}
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_overlap_merges_by_mergeable_samples(spark, parts):
    rng = np.random.default_rng(3)
    rules = merging.Overlap(cells=10, share=0.3, iou=0.02, sample=12, near=0.4, median=0.6, gain=-0.05)
    rows, cells = [], []
    for k in range(40):
        n, at = int(rng.integers(8, 60)), rng.uniform(0, 8, 3) * [1, 0.3, 0.1]
        xyz = at + rng.uniform(-0.8, 0.8, (n, 3))
        cells += [(k, 1000 * k + m, *map(float, p)) for m, p in enumerate(xyz)]
        buckets = [0] * 5
        buckets[int(rng.integers(0, 5))] = n
        rows.append((k, n, *map(float, xyz.mean(axis=0)), *map(float, rng.uniform(0, 60, 3)), 0.0, 0.6, 0.8, *(float(f(xyz[:, c])) for c in range(3) for f in (np.min, np.max)), buckets))
    whole, held = spark.createDataFrame(rows, KIND).repartition(parts), spark.createDataFrame(cells, "patch long, node long, x double, y double, z double").repartition(parts)
    candidates = merging.overlap_candidates(neighbours.box_pairs(whole, "patch", 0.0, 2.0), rules)
    named = {}
    for r in held.withColumn("h", F.xxhash64("node")).collect():
        named.setdefault(r["patch"], []).append((r["h"], r["x"], r["y"], r["z"]))
    want = plain_merges(rows, named, [tuple(c) for c in candidates.collect()], rules)
    got = sorted((r["a"], r["b"], r["owner_a"], r["owner_b"], r["reason"]) for r in merging.overlap_merges(whole, held, candidates, rules).collect())
    assert got == want and {r[4] for r in got} >= {"merged", "same_owner", "near_share"}


def test_overlap_candidates_gate_by_gate(spark):
    rules = merging.Overlap(cells=10, long_cells=50, long_aspect=2.0)
    rows = [patch(1, 60), patch(2, 60, x=0.1), patch(3, 5), patch(4, 60, x=0.8), patch(5, 60, x=50.0, size=20.0), patch(6, 60, x=51.0)]
    long = (7, 60, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 100.0, 140.0, 0.0, 1.0, 0.0, 1.0, [0, 60, 0, 0, 0])
    far = (8, 60, 30.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 100.0, 141.0, 0.0, 1.0, 0.0, 1.0, [0, 60, 0, 0, 0])
    pairs = neighbours.box_pairs(spark.createDataFrame([*rows, long, far], KIND), "patch", 0.0, 5.0)
    # 3 is small, 4 shares too little, 6 is a speck within 5, and 7 and 8 are far apart but long
    assert sorted((r["a"], r["b"]) for r in merging.overlap_candidates(pairs, rules).collect()) == [(1, 2), (7, 8)]
    assert [(r["a"], r["b"]) for r in merging.overlap_candidates(pairs, merging.Overlap(cells=10)).collect()] == [(1, 2)]


def test_type_likeness_both_ways(spark):
    names = [*merging.BUCKETS, "mixed"]
    frame = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    got = {(r["a"], r["b"]): r["v"] for r in frame.select("a", "b", merging.type_likeness(F.col("a"), F.col("b")).alias("v")).collect()}
    assert all(got[a, b] == merging.plain_type_likeness(a, b) == got[b, a] for a, b in got)
    assert (got["horizontal", "vertical"], got["vertical", "thin_linear"], got["mixed", "unknown"], got["rough_mixed", "thin_linear"]) == (0.05, 0.35, 0.65, 0.75)


def test_time_models_and_their_gates(spark):
    rows = [(f, 0, 3 * f + 5 + (900 if f in (4, 90) else 0), 1.0) for f in range(100)] + [(f, 0, 3 * f + 9, 0.5) for f in range(100)]
    rows += [(f, 1, f, 1.0) for f in range(0, 100, 2)] + [(7, 2, 600, 1.0)]
    poses = spark.createDataFrame([(f, f * 0.1) for f in range(100)], "frame_id long, ts double")
    frame = spark.createDataFrame(rows, "frame_id long, cam_id long, video_idx long, score double")
    judged = timing.time_models(frame, poses, 1200)
    got = {(r["cam_id"], r["frame_id"], r["model"]): r for r in judged.collect()}
    # two far outliers don't move the line of camera 0
    assert all(got[0, f, "affine"]["predicted"] == 3 * f + 5 for f in range(100)) and got[0, 10, "affine"]["exact"] and got[0, 4, "affine"]["rank"] == 2 and got[0, 4, "affine"]["loss"] == 0.5
    assert got[0, 50, "direct"]["distance"] == 105 and got[0, 99, "compressed"]["predicted"] == 1199 and got[1, 50, "rate"]["exact"]
    assert got[2, 7, "affine"]["predicted"] == 600
    chosen = {r["cam_id"]: (r["model"], r["median"]) for r in timing.chosen_models(judged, 2.0, 0.5).collect()}
    assert chosen == {0: ("affine", 0.0), 1: ("direct", 0.0), 2: ("affine", 0.0)}
    none = {r["cam_id"]: r["model"] for r in timing.chosen_models(judged.filter("model <> 'affine'"), 2.0, 0.5).collect()}
    assert none == {0: "direct", 1: "direct", 2: "direct"}
