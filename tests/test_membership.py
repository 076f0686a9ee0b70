import math
import random

import numpy as np
import pandas as pd

from terrane.operators import membership

L = membership.Limits()


def held(v):
    return min(1.0, max(0.0, v))


def looks(c):
    return np.array([c["r"] / 255, c["g"] / 255, c["b"] / 255, c["roughness"], c["planarity"], c["linearity"], min(c["deviation"] / 128, 1.5), min(c["rise"] / 0.55, 1.5), abs(c["nz"])])


def unlike(a, b):
    return 0.46 * np.linalg.norm(a[:3] - b[:3]) + 0.42 * np.linalg.norm(a[3:8] - b[3:8]) + 0.12 * abs(a[8] - b[8])


def way(v):
    v = np.array(v, float)
    return v / np.linalg.norm(v) if np.linalg.norm(v) >= 1e-9 else np.array([0.0, 0.0, 1.0])


def degrees(a, b):
    sizes = np.linalg.norm(a), np.linalg.norm(b)
    return 0.0 if min(sizes) < 1e-9 else math.degrees(math.acos(min(1.0, abs(float(np.dot(a, b))) / sizes[0] / sizes[1])))


def plain(m, c, s):
    """One pair at a time, in plain numbers."""
    place, normal = np.array([c[k] for k in "xyz"]), np.array([c["nx"], c["ny"], c["nz"]])
    top, share = m["buckets"].index(max(m["buckets"])), max(m["buckets"]) / m["n"]
    paint = np.linalg.norm([m[k] - c[k] for k in "rgb"])
    off = {k: abs(m[k] - c[k]) for k in ("deviation", "roughness", "planarity", "linearity", "rise")}
    angle, dz = degrees(m["normal"], normal), abs(c["z"] - m["z"])
    plane = abs(float((place - [m[k] for k in "xyz"]) @ m["normal"]))
    proto = held(1 - min(unlike(looks(c), p["look"]) for p in m["protos"]) / 0.54)
    texture = 0.62 * held(1 - paint / 150) + 0.38 * held(1 - off["deviation"] / 85)
    shape = 0.38 * held(1 - off["roughness"] / 0.24) + 0.24 * held(1 - off["linearity"] / 0.5) + 0.24 * held(1 - off["planarity"] / 0.5) + 0.14 * held(1 - off["rise"] / 0.28)
    height, facing, inside = held(1 - dz / 0.84), held(1 - angle / 216), held(1 - plane / 0.65)
    mine, flat = c["bucket"], (1, 2)
    bucket = 1.0 if mine == top else 0.72 if 0 in (mine, top) else 0.55 if {mine, top} in ({4, 1}, {4, 2}) else 0.15
    if top in flat and share >= 0.72:
        bridge = mine in (0, 3, 4) and texture >= 0.62 and (shape >= 0.24 or proto >= 0.48)
        if mine not in (top, 0) and not bridge:
            return "stable_bucket_mismatch", 0.0
        if paint > 285 and off["deviation"] > 55:
            return "stable_color_texture_jump", 0.0
        chart = (proto, inside, facing, height)
        if not bridge and (angle > 88 or plane > 0.26 * 2.4 or (top == 1 and dz > 0.3 * 2.4)):
            near = list(m["protos"])
            if s["bucket"] in (top, 0):
                near.append({"look": looks(s), "at": np.array([s[k] for k in "xyz"]), "way": way([s["nx"], s["ny"], s["nz"]])})
            found = []
            for p in near:
                d, q, t = unlike(looks(c), p["look"]), abs(float((place - p["at"]) @ p["way"])), degrees(p["way"], normal)
                found.append((d + 0.28 * min(q / 0.18, 2) + 0.12 * min(t / 42, 2), d, q, t, abs(place[2] - p["at"][2])))
            _, d, q, t, h = min(found)
            for name, fails in (("stable_normal_jump", t > 88), ("stable_plane_residual", q > 0.26 * 2.4), ("stable_height_jump", top == 1 and h > 0.72)):
                if fails:
                    return name, 0.0
            chart = (held(1 - d / 0.54), held(1 - q / 0.65), held(1 - t / 216), held(1 - h / 0.84))
        if bridge:
            total, least = 0.52 * texture + 0.18 * shape + 0.12 * chart[0] + 0.1 * bucket + 0.08 * chart[3], 0.56
        else:
            total, least = 0.26 * chart[1] + 0.22 * chart[2] + 0.17 * texture + 0.13 * chart[0] + 0.12 * bucket + 0.07 * shape + 0.03 * chart[3], 0.5
    else:
        if mine in flat and top not in flat:
            return "fine_to_stable_bucket_block", 0.0
        if paint > 150 * 1.85 and off["deviation"] > 64:
            return "object_color_texture_jump", 0.0
        if off["roughness"] > 0.34 and off["deviation"] > 64:
            return "object_shape_texture_jump", 0.0
        if top == 4:
            total, least = (0.36 * texture + 0.29 * shape + 0.18 * proto + 0.04 * height + 0.14 * bucket + 0.03 * facing + 0.03 * inside) / 1.07, 0.44
        else:
            total, least = (0.30 * texture + 0.27 * shape + 0.12 * proto + 0.12 * height + 0.12 * bucket + 0.06 * facing + 0.10 * inside) / 1.09, 0.48
    return ("accepted" if total >= least else "membership_score_low"), total


def random_cell(rng, calm=False):
    span = 0.2 if calm else 1.0
    return dict(x=rng.uniform(0, 2), y=rng.uniform(0, 2), z=rng.uniform(0, 2 * span), r=rng.uniform(0, 255) if not calm else rng.uniform(80, 120), g=rng.uniform(0, 255) if not calm else rng.uniform(80, 120), b=rng.uniform(0, 255) if not calm else rng.uniform(80, 120), nx=rng.choice((0.0, rng.uniform(-1, 1))), ny=rng.choice((0.0, 0.0, rng.uniform(-1, 1))), nz=rng.choice((1.0, 0.0, rng.uniform(-1, 1))), roughness=rng.uniform(0, 0.7 * span), planarity=rng.random(), linearity=rng.random(), deviation=rng.uniform(0, 160 * span), rise=rng.uniform(0, 0.6), bucket=rng.randrange(5))


CELLS = ", ".join(f"{c} {'int' if c == 'bucket' else 'double'}" for c in membership.CELL)


def test_every_reason_against_plain_numbers(spark):
    rng = random.Random(12)
    cells = []
    for patch in range(60):
        calm, main = patch % 2 == 0, rng.randrange(5)
        for k in range(rng.randrange(3, 30)):
            c = random_cell(rng, calm)
            c["bucket"] = main if rng.random() < 0.9 else c["bucket"]
            if patch % 5 < 2:
                c |= {n: rng.uniform(0, 20) for n in "rgb"}
            cells.append(dict(node=1000 * patch + k, patch=patch, **c))
    frame = spark.createDataFrame([tuple(c.values()) for c in cells], f"node long, patch long, {CELLS}").repartition(5)
    made = {r["patch"]: r for r in membership.models(frame).collect()}
    for patch, m in made.items():
        own = [c for c in cells if c["patch"] == patch]
        assert m["m_n"] == len(own) and m["m_buckets"] == [sum(c["bucket"] == k for c in own) for k in range(5)]
        assert math.isclose(m["m_deviation"], np.mean([c["deviation"] for c in own]), rel_tol=1e-9)
        assert math.isclose(math.hypot(m["m_nx"], m["m_ny"], m["m_nz"]), 1.0, rel_tol=1e-9) and 1 <= len(m["m_prototypes"]) <= 24
    asked = []
    for k in range(6000):
        near = rng.choice(cells)
        c = random_cell(rng, rng.random() < 0.5)
        if rng.random() < 0.6:
            c = {n: near[n] for n in membership.CELL} | {n: c[n] for n in rng.sample(membership.CELL, 4)}
        if rng.random() < 0.1:
            c |= {n: rng.choice((0.0, 255.0)) for n in "rgb"} | {"deviation": 160.0, "bucket": near["bucket"]}
        asked.append((k, near["patch"], c, {n: near[n] for n in membership.CELL}))
    named = ", ".join(f"{p}_{c} {'int' if c == 'bucket' else 'double'}" for p in "cs" for c in membership.CELL)
    pairs = spark.createDataFrame([(k, p, *[c[n] for n in membership.CELL], *[s[n] for n in membership.CELL]) for k, p, c, s in asked], f"k long, patch long, {named}").join(membership.models(frame), "patch")
    got = {r["k"]: (r["reason"], r["score"], r["ok"]) for r in membership.judged(pairs, source=True).select("k", "reason", "score", "ok").collect()}
    seen = set()
    for k, p, c, s in asked:
        m = made[p]
        model = {n: m[f"m_{n}"] for n in (*"xyzrgb", "roughness", "planarity", "linearity", "deviation", "rise", "n")} | {"buckets": m["m_buckets"], "normal": np.array([m["m_nx"], m["m_ny"], m["m_nz"]]), "protos": [{"look": np.array(q["look"]), "at": np.array([q["x"], q["y"], q["z"]]), "way": np.array([q["nx"], q["ny"], q["nz"]])} for q in m["m_prototypes"]]}
        reason, score = plain(model, c, s)
        assert got[k][0] == reason and math.isclose(got[k][1], score, abs_tol=1e-9) and got[k][2] == (reason == "accepted")
        seen.add(reason)
    assert seen == {"accepted", "membership_score_low", "stable_bucket_mismatch", "stable_color_texture_jump", "stable_normal_jump", "stable_plane_residual", "stable_height_jump", "fine_to_stable_bucket_block", "object_color_texture_jump", "object_shape_texture_jump"}


def test_prototypes_join_part_and_are_bounded():
    rng = random.Random(3)
    row = lambda **c: dict(signature=looks(c).tolist(), **{n: c[n] for n in ("x", "y", "z", "nx", "ny", "nz", "bucket")})
    base = random_cell(rng, True) | dict(x=0.0, y=0.0, z=0.0, nx=0.0, ny=0.0, nz=1.0)
    flat = pd.DataFrame([row(**base | dict(bucket=1)), row(**base | dict(bucket=1, z=0.1, nz=-1.0)), row(**base | dict(bucket=1, z=0.5)), row(**base | dict(bucket=1, nx=1.0, nz=0.3))])
    found = membership.prototypes_of(flat)
    # the second joins, turned; the third lies off the plane, the last faces another way, which only surfaces mind
    assert len(found) == 3 and found[0][3] == 0.05 and found[0][6] == 1.0
    assert len(membership.prototypes_of(flat.assign(bucket=4))) == 1
    many = pd.DataFrame([row(**random_cell(rng) | dict(bucket=4, r=255 * (k % 3) / 2, g=255 * (k // 3 % 3) / 2, b=255 * (k // 9 % 3) / 2, roughness=k / 20)) for k in range(100)])
    assert len(membership.prototypes_of(many)) == 24


def test_seeds_come_surfaces_first(spark):
    frame = spark.createDataFrame([(1, 4, 0.9, 0.1), (2, 1, 0.5, 0.3), (3, 2, 0.5, 0.2), (4, 1, 0.8, 0.9), (5, 0, 0.95, 0.0), (6, 2, 0.5, 0.2)], "node long, bucket int, planarity double, roughness double")
    assert [r["node"] for r in frame.orderBy(*membership.seed_order()).collect()] == [4, 3, 6, 2, 5, 1]
