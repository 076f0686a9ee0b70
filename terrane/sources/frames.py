"""Raw frame sections, pose text, evidence tables and run-length masks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("marker", "<u4")])


def sections(spark: SparkSession, path: str, header_bytes: int) -> DataFrame:
    """(path, frame_id, idx, x, y, z, marker) of files of sections: a count, then records; the section's number is the frame."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, at, frame = value.as_buffer(), header_bytes, 0
                while at + 4 <= raw.size:
                    (count,) = struct.unpack("<I", raw[at : at + 4])
                    if at + 4 + count * RECORD.itemsize > raw.size:
                        # a section that is cut off is left out, as are those after it
                        break
                    rows = np.frombuffer(raw, RECORD, count, at + 4)
                    fields = [pa.array(np.ascontiguousarray(rows[c])) for c in "xyz"]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * count, pa.string()), pa.array(np.full(count, frame, np.int32)), pa.array(np.arange(count)), *fields, pa.array(rows["marker"].astype(np.int64))], names=["path", "frame_id", "idx", "x", "y", "z", "marker"])
                    at, frame = at + 4 + count * RECORD.itemsize, frame + 1

    return files.mapInArrow(run, "path string, frame_id int, idx long, x float, y float, z float, marker long")


def poses(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pose text: frame, time, position, quaternion, norm, turning rate and `idx,count` of each camera; malformed lines are left out."""
    word = F.split(F.trim("value"), r"\s+")
    number = lambda k: word[k].try_cast("double")
    cams = F.transform(F.slice(word, 14, 3), lambda w: F.struct(F.split(w, ",")[0].try_cast("int").alias("idx"), F.try_element_at(F.split(w, ","), F.lit(2)).try_cast("int").alias("cnt")))
    rows = spark.read.text(path).filter(F.size(word) == 16).select(
        word[0].try_cast("long").alias("frame_id"), number(1).alias("ts"), F.array(*[number(k) for k in (2, 3, 4)]).alias("pos"), F.array(*[number(k) for k in (5, 6, 7, 8)]).alias("quat"), number(9).alias("norm"), F.array(*[number(k) for k in (10, 11, 12)]).alias("omega"), cams.alias("cams")
    )
    whole = F.col("frame_id").isNotNull() & F.col("ts").isNotNull() & ~F.exists(F.concat("pos", "quat"), lambda v: v.isNull())
    return rows.filter(whole & (F.lit(True) if first is None else F.col("frame_id") >= first) & (F.lit(True) if last is None else F.col("frame_id") <= last))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """(cam_id, fx, skew, fy, cx, cy, distortion, width, height, to_camera, to_lidar) of each camera of a calibration file that has both its parts.

    A camera is a mapping cam_N of numbers that may be missing (0) and a matrix Tcl_N; Til holds for all. Matrices are 16
    numbers, row by row. The file, a few hundred lines, is parsed at the driver.
    """
    import yaml

    raw = spark.read.text(path, wholetext=True).first()
    found = yaml.safe_load(raw["value"] if raw else "") or {}
    matrix = lambda values: [float(v) for v in np.asarray(values, np.float64).reshape(16)] if values is not None else None
    rows = []
    for name in sorted(n for n in found if n.startswith("cam_") and n[4:].isdigit()):
        cam, place = found[name], found.get(f"Tcl_{name[4:]}")
        if place is not None:
            number = lambda k, cam=cam: float(cam.get(k, 0.0))
            sizes = [int(cam[k]) if k in cam else None for k in ("image_width", "image_height")]
            rows.append((int(name[4:]), float(cam["A11"]), number("A12"), float(cam["A22"]), float(cam["u0"]), float(cam["v0"]), [number(f"k{k}") for k in range(2, 8)], *sizes, matrix(place), matrix(found.get("Til"))))
    return spark.createDataFrame(rows, "cam_id int, fx double, skew double, fy double, cx double, cy double, distortion array<double>, width int, height int, to_camera array<double>, to_lidar array<double>")


def edge_evidence(rows: DataFrame) -> DataFrame:
    """(a, b, similarity) of an evidence table whose columns have one of several names; a distance d is 1 - d."""
    have = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in rows.columns], F.lit(None).cast("string"))
    left, right = have("patch_a", "a", "src").try_cast("long"), have("patch_b", "b", "dst").try_cast("long")
    likeness = F.coalesce(have("similarity").try_cast("double"), 1 - have("distance").try_cast("double"))
    named = rows.select(left.alias("l"), right.alias("r"), likeness.alias("similarity")).filter("l is not null and r is not null and similarity is not null and l <> r")
    return named.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "similarity")


def mask_runs(masks: DataFrame) -> DataFrame:
    """(mask_id, start, length) of the set runs of masks (mask_id, counts): counts alternate from unset, down the columns.

    Plain windows over the exploded counts; a mask of few counts is unset beyond them.
    """
    spread = masks.select("mask_id", F.posexplode("counts").alias("k", "length"))
    before = F.aggregate(F.slice("counts", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda s, v: s + v)
    placed = spread.join(masks, "mask_id").withColumn("start", before)
    return placed.filter("k % 2 = 1 and length > 0").select("mask_id", "start", F.col("length").cast("long").alias("length"))


def counts_of(pixels: DataFrame, height: int, size: int) -> DataFrame:
    """(mask_id, counts) of set pixels (mask_id, row, col), counted down the columns, the last run of unset pixels included."""
    from pyspark.sql import Window

    at = F.col("col") * height + F.col("row")
    order = Window.partitionBy("mask_id").orderBy("at")
    placed = pixels.select("mask_id", at.alias("at")).distinct().withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(order) != 1).cast("int"), F.lit(1)))
    runs = placed.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("mask_id", "run").agg(F.min("at").alias("start"), F.count("*").alias("length"))
    by_run = Window.partitionBy("mask_id").orderBy("run")
    gaps = runs.withColumn("gap", F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("length")).over(by_run), F.lit(0)))
    pairs = gaps.groupBy("mask_id").agg(F.array_sort(F.collect_list(F.struct("run", "gap", "length", "start"))).alias("s"))
    flat = F.flatten(F.transform("s", lambda r: F.array(r["gap"], r["length"])))
    last = F.element_at("s", -1)
    rest = F.lit(size) - last["start"] - last["length"]
    return pairs.select("mask_id", F.when(rest > 0, F.concat(flat, F.array(rest))).otherwise(flat).alias("counts"))


def plain_counts(texts: list[str | None]) -> list[np.ndarray | None]:
    """Run lengths of compressed counts, all texts at a time.

    A character holds, less 48, five bits of a number from its low end on and, at 32, whether more follow; of the last
    one 16 is the sign. From the fourth number on a number is what it exceeds the one two before by.
    """
    raw = np.frombuffer("".join(t or "" for t in texts).encode("ascii"), np.uint8).astype(np.int64) - 48
    if len(raw) and (raw.min() < 0 or raw.max() > 63):
        raise ValueError("no compressed counts")
    sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    ends = np.flatnonzero(raw & 0x20 == 0)
    if len(raw) and not np.isin(sizes[sizes > 0].cumsum() - 1, ends).all():
        raise ValueError("compressed counts are cut off")
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    nth = np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)
    value = np.add.reduceat((raw & 0x1F) << 5 * nth, begins) if len(ends) else ends
    value -= np.where(raw[ends] & 0x10, 1 << 5 * (ends - begins + 1), 0)
    text = np.repeat(np.arange(len(texts)), sizes)[begins] if len(ends) else ends
    first = np.searchsorted(text, np.arange(len(texts)))
    place = np.arange(len(value)) - first[text]
    for parity in (0, 1):
        # the second of odd places is the fourth number; of even ones the chain begins at the third, which stands by itself
        at = np.flatnonzero((place % 2 == parity) & (place > 0))
        if len(at):
            sums = value[at].cumsum()
            start = np.flatnonzero(np.concatenate(([True], text[at][1:] != text[at][:-1])))
            before = np.concatenate(([0], sums))[start]
            value[at] = sums - np.repeat(before, np.diff(np.append(start, len(at))))
    last = np.append(first, len(value))[1:]
    return [None if t is None else value[a:b] for t, a, b in zip(texts, first.tolist(), last.tolist(), strict=True)]


def packed_counts(counts: list[np.ndarray | None]) -> list[str | None]:
    """Compressed counts of run lengths, the inverse of plain_counts."""
    out: list[str | None] = []
    for own in counts:
        if own is None:
            out.append(None)
            continue
        x = np.asarray(own, np.int64).copy()
        x[3:] -= np.asarray(own, np.int64)[1:-2]
        characters = np.zeros((14, len(x)), np.uint8)
        going, used = np.ones(len(x), bool), np.zeros(len(x), np.int64)
        for k in range(14):
            low = x & 0x1F
            x = x >> 5
            more = np.where(low & 0x10, x != -1, x != 0)
            characters[k] = np.where(going, low + np.where(more, 0x20, 0) + 48, 0)
            used += going
            going &= more
            if not going.any():
                break
        flat = characters.T.ravel()
        out.append(flat[flat > 0].tobytes().decode("ascii"))
    return out


def decoded_masks(masks: DataFrame, counts: str = "counts") -> DataFrame:
    """`masks` with run lengths as an array in place of compressed ones in the column `counts`; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(counts)
            found = pa.array([None if x is None else x.tolist() for x in plain_counts(batch.column(at).to_pylist())], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([found if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    kinds = [T.StructField(f.name, T.ArrayType(T.LongType())) if f.name == counts else f for f in masks.schema.fields]
    return masks.mapInArrow(run, T.StructType(kinds))


def encoded_masks(masks: DataFrame, counts: str = "counts") -> DataFrame:
    """`masks` with compressed run lengths in place of an array of them in the column `counts`; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(counts)
            found = pa.array(packed_counts([None if x is None else np.array(x, np.int64) for x in batch.column(at).to_pylist()]), pa.string())
            yield pa.RecordBatch.from_arrays([found if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    kinds = [T.StructField(f.name, T.StringType()) if f.name == counts else f for f in masks.schema.fields]
    return masks.mapInArrow(run, T.StructType(kinds))


def dense_counts(rows: list[list[bool]]) -> list[int]:
    """Run lengths down the columns of a mask given as rows of pixels."""
    flat = np.asarray(rows, bool).T.ravel()
    change = np.flatnonzero(np.diff(flat, prepend=False))
    return np.diff(np.concatenate(([0], change, [len(flat)]))).tolist()


def overlaps(runs: DataFrame, other: DataFrame) -> DataFrame:
    """(left, right, shared) pixels of pairs of masks, by their runs; runs meet in the blocks of pixels that they touch."""
    block = 1 << 12
    spread = lambda df, s: df.select(F.col("mask_id").alias(s), F.col("start").alias(f"{s}0"), (F.col("start") + F.col("length")).alias(f"{s}1"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("length") - 1) / block))).alias("cell"))
    met = spread(runs, "left").join(spread(other, "right"), "cell")
    low, high = F.greatest("left0", "right0", F.col("cell") * block), F.least("left1", "right1", (F.col("cell") + 1) * block)
    return met.withColumn("shared", high - low).filter("shared > 0").groupBy("left", "right").agg(F.sum("shared").alias("shared"))
