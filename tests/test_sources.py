import struct

import numpy as np
import pytest

from terrane.sources import frames, ply, scans


def test_binary_and_text_points(spark, tmp_path):
    rows = np.array([(0.5, 1.5, -2.0, 255, 7), (1.0, 2.0, 3.0, 0, 4_000_000_000)], dtype=[("x", "<f4"), ("y", "<f4"), ("z", "<f8"), ("red", "u1"), ("object", "<u4")])
    props = "property float x\nproperty float y\nproperty double z\nproperty uchar red\nproperty uint object\n"
    (tmp_path / "a.ply").write_bytes(f"ply\nformat binary_little_endian 1.0\ncomment x\nelement vertex 2\n{props}element face 0\nproperty list uchar int v\nend_header\n".encode() + rows.tobytes())
    (tmp_path / "b.txt").write_bytes(f"ply\nformat ascii 1.0\nelement vertex 2\n{props}end_header\n0.5 1.5 -2 255 7\n1 2 3 0 4000000000\n".encode())
    want = [(0, 0.5, 1.5, -2.0, 255, 7), (1, 1.0, 2.0, 3.0, 0, 4_000_000_000)]
    for name in ("a.ply", "b.txt"):
        path = str(tmp_path / name)
        header = ply.header_of(spark, path)
        assert sorted(map(tuple, ply.read(spark, path, header).collect())) == want
        assert [tuple(r) for r in ply.read(spark, path, header, stride=2).collect()] == want[:1]
    with pytest.raises(ValueError):
        ply.parse_header(b"plain text")


@pytest.mark.parametrize("text", [False, True])
def test_points_written_and_read_again(spark, tmp_path, text):
    points = spark.createDataFrame([(k, float(k), k * 0.5, 1.0, k % 256) for k in range(500)], "row_id long, x double, y double, z double, red int")
    path = str(tmp_path / "out")
    dealt = points.repartitionByRange(3, "row_id").sortWithinPartitions("row_id")
    scans.write_points(dealt, path, {"x": "float", "y": "float", "z": "float", "red": "uchar"}, text=text)
    assert len(list((tmp_path / "out").iterdir())) == 3
    back = ply.read(spark, path, ply.header_of(spark, path))
    assert sorted((r["x"], r["y"], r["red"]) for r in back.collect()) == [(float(k), k * 0.5, k % 256) for k in range(500)]
    scans.write_points(points.filter("row_id < 5"), path, {"x": "float", "red": "uchar"}, text=text, overwrite=True)
    assert ply.read(spark, path, ply.header_of(spark, path)).count() == 5


def point_file(path, count):
    rows = np.empty(count, [("x", "<f4"), ("n", "<i4"), ("w", "<f8")])
    rows["x"], rows["n"], rows["w"] = np.arange(count) * 0.25, np.arange(count), np.arange(count) ** 2
    path.write_bytes(f"ply\nformat binary_little_endian 1.0\nelement vertex {count}\nproperty float x\nproperty int n\nproperty double w\nend_header\n".encode() + rows.tobytes())


def test_ranges_of_a_file_give_what_the_whole_gives(spark, tmp_path):
    point_file(tmp_path / "a.ply", 1000)
    point_file(tmp_path / "b.ply", 7)
    point_file(tmp_path / "_other.ply", 3)
    one = scans.read(spark, str(tmp_path))
    cut = scans.read(spark, str(tmp_path), partition_bytes=16 * 30)
    assert one.rdd.getNumPartitions() == 2 and cut.rdd.getNumPartitions() == 35
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, cut.collect())) and len(rows) == 1007
    assert all(r["n"] == r["row"] and r["w"] == r["row"] ** 2 and r["x"] == r["row"] * 0.25 for r in cut.collect())
    for stride in (1, 3, 10, 300):
        for most in (0, 1, 40):
            got = scans.read(spark, str(tmp_path), stride=stride, max_points=most, partition_bytes=16 * 30).collect()
            want = [(n, k) for n, count in (("a", 1000), ("b", 7)) for k in list(range(0, count, stride))[: most or None]]
            assert sorted((r["file"][-5], r["row"]) for r in got) == want and all(r["n"] == r["row"] for r in got)


def test_far_rows_are_read_one_by_one(spark, tmp_path, monkeypatch):
    point_file(tmp_path / "a.ply", 100)
    with open(tmp_path / "a.ply", "rb") as file:
        layout = scans.point_layout(file.read())
        near = scans.read_rows(file, layout, 3, 10, 9)
        monkeypatch.setattr(scans, "GAP", 16)
        far = scans.read_rows(file, layout, 3, 10, 9)
    assert near["n"].tolist() == far["n"].tolist() == list(range(3, 93, 9))


def test_rows_are_fetched_by_number(spark, tmp_path):
    point_file(tmp_path / "a.ply", 100_000)
    point_file(tmp_path / "b.ply", 10)
    got = scans.read(spark, str(tmp_path / "a.ply"), rows="5,6,7,99999,200000,-1,5")
    assert got.rdd.getNumPartitions() == 2
    assert sorted((r["row"], r["n"]) for r in got.collect()) == [(5, 5), (6, 6), (7, 7), (99999, 99999)]
    a, b = (str(tmp_path / f"{c}.ply") for c in "ab")
    asked = spark.createDataFrame([(a, 70_000), (a, 3), (b, 9), (a, 3), (b, 10), (a, -5), (None, 1), (a, None), (b, 0)], "file string, row long")
    assert sorted((r["file"], r["row"], r["n"]) for r in scans.fetch(asked, str(tmp_path)).collect()) == [(a, 3, 3), (a, 3, 3), (a, 70_000, 70_000), (b, 0, 0), (b, 9, 9)]
    assert scans.fetch(asked.limit(0), str(tmp_path)).count() == 0


def test_files_that_are_cut_off_or_differ(spark, tmp_path):
    point_file(tmp_path / "a.ply", 10)
    whole = (tmp_path / "a.ply").read_bytes()
    (tmp_path / "a.ply").write_bytes(whole[:-20])
    with pytest.raises(Exception, match="ends within row"):
        scans.read(spark, str(tmp_path)).collect()
    (tmp_path / "b.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 0\nproperty float x\nend_header\n")
    with pytest.raises(Exception, match="different records"):
        scans.read(spark, str(tmp_path)).collect()
    assert scans.read(spark, str(tmp_path / "b.ply")).count() == 0
    with pytest.raises(Exception, match="nothing.ply"):
        scans.read(spark, str(tmp_path / "nothing.ply")).collect()


def test_text_points_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"{k * 0.5} {k}" if k % 50 else "broken" for k in range(3000)]
    (tmp_path / "a.txt").write_text("ply\nformat ascii 1.0\nelement vertex 3000\nproperty float x\nproperty int n\nend_header\n" + "\n".join(lines) + "\nafter all")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = scans.text_points(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 3
        got = sorted((r["row"], r["n"], r["x"]) for r in found.collect())
        assert got == [(k, k, k * 0.5) for k in range(3000) if k % 50]
        assert sorted(r["row"] for r in scans.text_points(spark, str(tmp_path), stride=7).collect()) == [k for k in range(0, 3000, 7) if k % 50]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def las_file(path, kind, points, extra=0, minor=2):
    record = np.dtype(scans.LAS_FORMATS[kind])
    rows = np.zeros(len(points), np.dtype({"names": list(record.names), "formats": [record.fields[n][0] for n in record.names], "offsets": [record.fields[n][1] for n in record.names], "itemsize": record.itemsize + extra}))
    for k, n in enumerate(("X", "Y", "Z", *(("red", "green", "blue") if "red" in record.names else ()))):
        rows[n] = [p[k] for p in points]
    head = bytearray(375 if minor >= 4 else 227)
    head[:4], head[24:26] = b"LASF", bytes((1, minor))
    struct.pack_into("<HIIBHI", head, 94, len(head), len(head) + 54, 1, kind, rows.itemsize, 0 if minor >= 4 else len(rows))
    struct.pack_into("<12d", head, 131, 0.01, 0.01, 0.02, 10.0, 0.0, -5.0, *[0.0] * 6)
    if minor >= 4:
        struct.pack_into("<Q", head, 247, len(rows))
    path.write_bytes(bytes(head) + bytes(54) + rows.tobytes())


@pytest.mark.parametrize(("kind", "extra", "minor"), [(2, 0, 2), (3, 5, 2), (7, 0, 4), (8, 3, 4), (5, 0, 3)])
def test_las_points_of_every_format_with_colors(spark, tmp_path, kind, extra, minor):
    points = [(100 * k, -k, 7, 256 * k, k, 0) for k in range(50)]
    las_file(tmp_path / "a.las", kind, points, extra, minor)
    got = sorted((r["row"], round(r["x"], 6), round(r["y"], 6), round(r["z"], 6), r["red"], r["green"]) for r in scans.read(spark, str(tmp_path / "a.las"), "las", partition_bytes=300).collect())
    assert got == [(k, round(k + 10.0, 6), round(-0.01 * k, 6), -4.86, 256 * k, k) for k in range(50)]


def test_las_cells_are_the_means_of_their_points(spark, tmp_path):
    las_file(tmp_path / "a.las", 3, [(1, 1, 0, 2560, 0, 255), (2, 2, 0, 5120, 200, 256), (101, 101, 0, 7680, 10, 0), (102, 102, 0, 10240, 31, 0)])
    las_file(tmp_path / "b.las", 3, [(1, 1, 0, 128, 255, 384)])
    got = {(r["ix"], r["iy"], r["iz"]): tuple(round(r[c], 6) for c in ("n", "x", "y", "red", "green", "blue")) for r in scans.las_voxels(spark, str(tmp_path), 1.0, partition_bytes=60).collect()}
    # red and blue of the first file are of 16 bits, as is blue of the second: 255 / 256 and 384 / 256 are rounded half to even
    assert got == {(10, 0, -5): (3, round((30.03 + 0.01) / 3, 6), round(0.04 / 3, 6), round((10 + 20 + 128) / 3, 6), round((0 + 200 + 255) / 3, 6), round((1 + 1 + 2) / 3, 6)), (11, 1, -5): (2, 11.015, 1.015, 35.0, 20.5, 0.0)}
    (tmp_path / "d").mkdir()
    las_file(tmp_path / "d" / "c.las", 0, [(1, 1, 1)])
    with pytest.raises(ValueError, match="without colors"):
        scans.las_voxels(spark, str(tmp_path / "d"), 1.0)
    with pytest.raises(ValueError, match="point format"):
        scans.las_layout((tmp_path / "a.las").read_bytes()[:104] + bytes((99,)) + bytes(300))
    with pytest.raises(ValueError, match="compressed"):
        scans.las_layout((tmp_path / "a.las").read_bytes()[:104] + bytes((131,)) + bytes(300))


def test_las_written_and_read_again(spark, tmp_path):
    points = spark.createDataFrame([(k * 0.125, -k * 1.0, 3.0, k % 256, 7, 1000 * (k % 3)) for k in range(400)], "x double, y double, z double, red int, green int, blue int")
    scans.write_las(points.repartition(3), str(tmp_path / "out"), scale=0.125)
    back = scans.read(spark, str(tmp_path / "out"), "las")
    assert sorted((r["x"], r["y"], r["red"], r["blue"]) for r in back.collect()) == sorted((r["x"], r["y"], r["red"], r["blue"]) for r in points.collect())
    facts = [scans.las_layout(scans.head_of(f)).facts for f in scans.files_of(str(tmp_path / "out"))]
    assert max(f["x_max"] for f in facts) == 399 * 0.125 and min(f["y_min"] for f in facts) == -399.0


def test_region_inputs_and_labels_by_array(spark, tmp_path):
    n, m = 300, 50
    rng = np.random.default_rng(1)
    arrays = {name: (rng.integers(-5, 30, n).astype(kind) if kind == "<i2" else rng.random((n, width)).astype(kind)) for name, kind, width in scans.REGION_ARRAYS}
    src, dst = (rng.integers(0, n, m).astype("<i4") for _ in range(2))
    (tmp_path / "r.bin").write_bytes(scans.REGION_MARK + struct.pack("<qq", n, m) + b"".join(a.tobytes() for a in arrays.values()) + src.tobytes() + dst.tobytes())
    rows = sorted(scans.read(spark, str(tmp_path / "r.bin"), "region", partition_bytes=1000).collect(), key=lambda r: r["row"])
    assert [r["ny"] for r in rows] == arrays["normal"][:, 1].tolist() and [r["buckets"] for r in rows] == arrays["buckets"].tolist() and [r["height_range"] for r in rows] == arrays["height_range"][:, 0].tolist()
    edges = scans.read(spark, str(tmp_path / "r.bin"), "region_edges", partition_bytes=64)
    assert sorted((r["row"], r["src"], r["dst"]) for r in edges.collect()) == list(zip(range(m), src.tolist(), dst.tolist(), strict=True))
    (tmp_path / "l.bin").write_bytes(scans.LABEL_MARK + struct.pack("<q", n) + np.arange(n, dtype="<i4").tobytes())
    assert sorted((r["row"], r["label"]) for r in scans.read(spark, str(tmp_path / "l.bin"), "labels", partition_bytes=400).collect()) == [(k, k) for k in range(n)]


def test_sections(spark, tmp_path):
    parts = [[(1.0, 2.0, 3.0, 9)], [], [(4.0, 5.0, 6.0, 1), (7.0, 8.0, 9.0, 2)]]
    raw = b"HEAD" + b"".join(struct.pack("<I", len(p)) + b"".join(struct.pack("<fffI", *r) for r in p) for p in parts)
    (tmp_path / "a.lx").write_bytes(raw)
    got = frames.sections(spark, str(tmp_path / "a.lx"), 4).drop("path").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1.0, 2.0, 3.0, 9), (2, 0, 4.0, 5.0, 6.0, 1), (2, 1, 7.0, 8.0, 9.0, 2)]


def test_poses_leave_out_malformed_lines(spark, tmp_path):
    line = "{} 1.5 1 2 3 1 0 0 0 1 0 0 0 4,2 5,1 6,1"
    (tmp_path / "p.txt").write_text("\n".join([line.format(1), "bad line", line.format("x"), "  " + line.format(7)]))
    got = frames.poses(spark, str(tmp_path / "p.txt")).collect()
    assert [(r["frame_id"], r["ts"], r["pos"], r["cams"][0]["idx"], r["cams"][2]["cnt"]) for r in got] == [(1, 1.5, [1.0, 2.0, 3.0], 4, 1), (7, 1.5, [1.0, 2.0, 3.0], 4, 1)]
    assert [r["frame_id"] for r in frames.poses(spark, str(tmp_path / "p.txt"), first=2).collect()] == [7]


def test_evidence_under_any_name(spark):
    one = spark.createDataFrame([(5, 2, "0.25"), (1, 1, "0.9"), (3, 4, "x")], "src long, dst long, distance string")
    assert [tuple(r) for r in frames.edge_evidence(one).collect()] == [(2, 5, 0.75)]


def test_masks_to_runs_and_back(spark):
    masks = spark.createDataFrame([(1, [2, 3, 1, 2, 4]), (2, [0, 5, 7]), (3, [6, 4])], "mask_id long, counts array<int>")
    runs = frames.mask_runs(masks)
    assert sorted(map(tuple, runs.collect())) == [(1, 2, 3), (1, 6, 2), (2, 0, 5), (3, 6, 4)]
    from pyspark.sql import functions as F

    pixels = runs.select("mask_id", F.explode(F.expr("sequence(start, start + length - 1)")).alias("at")).selectExpr("mask_id", "at % 4 AS row", "at div 4 AS col")
    back = {r["mask_id"]: r["counts"] for r in frames.counts_of(pixels, 4, 12).collect()}
    assert back == {1: [2, 3, 1, 2, 4], 2: [0, 5, 7], 3: [6, 4, 2]}
    both = {(r["left"], r["right"]): r["shared"] for r in frames.overlaps(runs, runs).collect()}
    assert both[1, 2] == 3 and both[1, 3] == 2 and both[1, 1] == 5 and (2, 3) not in both


def plain_decoded(text):
    out, at = [], 0
    while at < len(text):
        number = shift = 0
        more = True
        while more:
            c = ord(text[at]) - 48
            at += 1
            number |= (c & 31) << shift
            shift += 5
            more = bool(c & 32)
            if not more and c & 16:
                number |= -1 << shift
        out.append(number + out[-2] if len(out) > 2 else number)
    return out


def test_compressed_counts_both_ways(spark):
    rng = np.random.default_rng(8)
    counts = [[int(v) for v in rng.integers(0, 10 ** rng.integers(1, 7), n)] for n in [0, 1, 2, 3, 4, 5, 17, 400, *rng.integers(0, 60, 40)]] + [[0, 3_000_000_000, 5, 1, 9, 2_999_999_999, 31, 32, 15, 16]]
    packed = frames.packed_counts([np.array(c, np.int64) for c in counts])
    assert [plain_decoded(t) for t in packed] == counts
    assert [c.tolist() for c in frames.plain_counts(packed)] == counts
    assert frames.plain_counts([None, "", packed[7]])[0] is None and frames.plain_counts([]) == []
    with pytest.raises(ValueError, match="cut off"):
        frames.plain_counts(["o"])
    with pytest.raises(ValueError, match="no compressed"):
        frames.plain_counts(["!"])
    table = spark.createDataFrame([(k, c) for k, c in enumerate(counts)] + [(999, None)], "mask_id long, counts array<long>").repartition(3)
    back = {r["mask_id"]: r["counts"] for r in frames.decoded_masks(frames.encoded_masks(table)).collect()}
    assert back == {**dict(enumerate(counts)), 999: None}
    assert frames.dense_counts([[True, False], [True, False], [False, True]]) == [0, 2, 3, 1]


def test_fields_are_read_by_the_place_of_their_arrays(spark, tmp_path):
    keys, labels, confidence = np.arange(0, 5000, 3), (np.arange(1667) % 200).astype(np.uint8), np.linspace(0, 1, 1667).astype(np.float32)
    np.savez(tmp_path / "f.npz", keys=keys, labels=labels, confidence=confidence, spec=np.array([1, 2, 3]), voxel_size=np.array([0.25]))
    found = scans.read(spark, str(tmp_path / "f.npz"), "field", partition_bytes=2000)
    assert found.rdd.getNumPartitions() > 5
    assert sorted((r["row"], r["keys"], r["labels"], r["confidence"]) for r in found.collect()) == list(zip(range(1667), keys.tolist(), labels.tolist(), confidence.tolist(), strict=True))
    assert scans.layout_of(str(tmp_path / "f.npz"), "field").facts == {"spec_0": 1.0, "spec_1": 2.0, "spec_2": 3.0, "voxel_size_0": 0.25}
    np.savez_compressed(tmp_path / "g.npz", keys=keys)
    with pytest.raises(ValueError, match="compressed arrays"):
        scans.layout_of(str(tmp_path / "g.npz"), "field")
    scans.write_field(found.repartitionByRange(2, "keys").sortWithinPartitions("keys"), str(tmp_path / "out"), {"keys": "<i8", "labels": "u1"})
    parts = [dict(np.load(f)) for f in scans.files_of(str(tmp_path / "out"))]
    assert sorted(np.concatenate([p["keys"] for p in parts]).tolist()) == keys.tolist() and all((np.diff(p["keys"]) > 0).all() for p in parts)


def test_labels_written_and_a_section_that_is_cut_off(spark, tmp_path):
    scans.write_labels(spark.createDataFrame([(k,) for k in range(90)], "label int").repartitionByRange(2, "label").sortWithinPartitions("label"), str(tmp_path / "l"))
    assert sorted(r["label"] for r in scans.read(spark, str(tmp_path / "l"), "labels").collect()) == list(range(90))
    raw = b"HEAD" + struct.pack("<IfffI", 1, 1.0, 2.0, 3.0, 9) + struct.pack("<IfffI", 2, 1.0, 2.0, 3.0, 9)
    (tmp_path / "a.lx").write_bytes(raw)
    assert [tuple(r) for r in frames.sections(spark, str(tmp_path / "a.lx"), 4).drop("path").collect()] == [(0, 0, 1.0, 2.0, 3.0, 9)]


def test_calibration_of_cameras_that_are_whole(spark, tmp_path):
    pytest.importorskip("yaml")
    eye = ", ".join(str(float(k % 5 == 0)) for k in range(16))
    (tmp_path / "c.yaml").write_text(f"device: x\ncam_0: {{A11: 700.5, A22: 701, u0: 320, v0: 240.5, k2: 0.1, k7: -0.2, image_width: 640, image_height: 480}}\ncam_1: {{A11: 1, A22: 1, u0: 0, v0: 0}}\nTcl_0: [{eye}]\nTcl_2: [{eye}]\nTil: [{eye}]\n")
    got = frames.calibration(spark, str(tmp_path / "c.yaml")).collect()
    assert [(r["cam_id"], r["fx"], r["skew"], r["fy"], r["cx"], r["cy"], r["distortion"], r["width"], r["to_camera"][5], r["to_lidar"][1]) for r in got] == [(0, 700.5, 0.0, 701.0, 320.0, 240.5, [0.1, 0.0, 0.0, 0.0, 0.0, -0.2], 640, 1.0, 0.0)]
    (tmp_path / "d.yaml").write_text("")
    assert frames.calibration(spark, str(tmp_path / "d.yaml")).count() == 0


def test_text_files_with_their_own_counts_and_comments(spark, tmp_path):
    """The first file is the shortest and has the shortest header."""
    for k, count in enumerate((2, 5, 3)):
        body = "".join(f"{k * 10 + n}\n" for n in range(count))
        (tmp_path / f"{k}.ply").write_text("ply\nformat ascii 1.0\n" + "comment x\n" * k + f"element vertex {count}\nproperty int n\nend_header\n{body}")
    back = ply.read(spark, str(tmp_path), ply.header_of(spark, str(tmp_path)))
    assert sorted((r["row"], r["n"]) for r in back.collect()) == sorted((n, k * 10 + n) for k, count in enumerate((2, 5, 3)) for n in range(count))


def test_small_ranges_grow_with_the_input(spark, tmp_path, monkeypatch):
    points = spark.range(2000).selectExpr("id AS row_id", "CAST(id AS double) AS x", "0.0D AS y", "1.0D AS z")
    scans.write_points(points.coalesce(1), str(tmp_path / "out"), {"x": "float", "y": "float", "z": "float"})
    found = scans.read(spark, str(tmp_path / "out"), partition_bytes=12)
    assert found.rdd.getNumPartitions() <= 2 * scans.MOST_RANGES
    assert sorted(r["x"] for r in found.select("x").collect()) == [float(k) for k in range(2000)]
