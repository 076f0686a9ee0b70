"""Queries over files that they write from the driver tables into the shared folder and read again in ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import lineage, voxels
from terrane.plans.domain import POINTS, points, with_
from terrane.plans.registry import query
from terrane.plans.spatial import KEYS, seen
from terrane.sources import frames, scans

#: Bytes of a range, small enough that each file has several.
RANGE = 1 << 16
TYPES = {"point_id": "double", "x": "double", "y": "double", "z": "double", "r": "uchar", "object_id": "int"}


def folder(spark: SparkSession, name: str) -> str:
    return f"{lineage.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def point_files(spark: SparkSession, sf_dir: str, text: bool = False) -> str:
    path = folder(spark, "points")
    scans.write_points(points(spark, sf_dir), path, TYPES, text=text)
    return path


@query(with_(POINTS) + "SELECT point_id, x, y, z, r, CAST(object_id AS INT) AS object_id FROM points")
def point_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written to binary files and read again in byte ranges."""
    found = scans.read(spark, point_files(spark, sf_dir), partition_bytes=RANGE)
    return found.select(F.col("point_id").cast("long").alias("point_id"), "x", "y", "z", F.col("r").cast("int").alias("r"), "object_id")


@query(with_(POINTS) + "SELECT point_id, round(x, 3) AS x, round(z, 3) AS z FROM points WHERE object_id % 5 = 0")
def point_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as text and read again by blocks."""
    found = scans.text_points(spark, point_files(spark, sf_dir, text=True))
    return found.filter("object_id % 5 = 0").select(F.col("point_id").cast("long").alias("point_id"), F.round("x", 3).alias("x"), F.round("z", 3).alias("z"))


@query(with_(POINTS) + "SELECT point_id, x FROM points WHERE point_id % 97 = 0")
def fetched_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of files fetched by their row numbers, which an index of all rows gives."""
    path = point_files(spark, sf_dir)
    index = scans.read(spark, path).select("file", "row", F.col("point_id").cast("long").alias("id"))
    return scans.fetch(index.filter("id % 97 = 0"), path).select(F.col("point_id").cast("long").alias("point_id"), "x")


@query(
    with_(POINTS, "steps AS (SELECT *, round(x / 0.125) * 0.125 AS sx, round(y / 0.125) * 0.125 AS sy, round_even(z / 0.125, 0) * 0.125 AS sz FROM points)")
    + "SELECT CAST(floor(sx / 2) AS BIGINT) AS ix, CAST(floor(sy / 2) AS BIGINT) AS iy, CAST(floor(sz / 2) AS BIGINT) AS iz, count(*) AS n, round(avg(sx), 6) AS x, round(avg(sy), 6) AS y, round(avg(sz), 6) AS z, round(avg(r), 6) AS red, round(avg(g), 6) AS green, round(avg(b), 6) AS blue FROM steps GROUP BY 1, 2, 3"
)
def las_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of cells from LAS files, whose places are whole steps of an eighth and whose colors are of 16 bits."""
    path = folder(spark, "las")
    named = points(spark, sf_dir).select("x", "y", "z", *[(F.col(c) * 256).alias(n) for c, n in zip("rgb", ("red", "green", "blue"), strict=True)])
    scans.write_las(named, path, scale=0.125)
    found = scans.las_voxels(spark, path, 2.0, partition_bytes=RANGE)
    return found.withColumns({c: F.round(c, 6) for c in ("x", "y", "z", "red", "green", "blue")})


@query(
    with_(POINTS, "cells AS (SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(z) AS BIGINT) AS iz, count(*) AS n FROM points GROUP BY 1, 2, 3)")
    + "SELECT (ix * 1000 + iy) * 1000 + iz AS key, CAST(n % 7 AS INT) AS label, CASE WHEN (ix + iy) % 3 = 0 THEN CAST(iz + 1 AS INT) END AS region, CASE WHEN (ix + iy) % 3 = 0 THEN n / 8.0::DOUBLE END AS confidence FROM cells"
)
def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of region inputs with the labels of label vectors and the regions of a structural field, all read from files.

    Cells and their labels are written in the same ranges of packed keys and belong together by file and row; the
    field, which holds a third of the cells, is looked up by key.
    """
    cells = voxels.keyed(points(spark, sf_dir), 1.0).groupBy(*KEYS).agg(F.count("*").alias("n"))
    key = (F.col("ix") * 1000 + F.col("iy")) * 1000 + F.col("iz")
    made, _ = lineage.Scratch(spark, "cells").keep(cells.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key"))
    zero = {c: F.lit(0.0) for c in ("red", "green", "blue", "nx", "ny", "roughness", "planarity", "linearity", "local_color_std", "height_range")}
    regions, labels, field = folder(spark, "regions"), folder(spark, "labels"), folder(spark, "field")
    scans.write_region(made.select("*", *[F.col(f"i{c}").alias(c) for c in "xyz"]).withColumns(zero | {"nz": F.lit(1.0), "buckets": F.col("n") % 7}).sortWithinPartitions("key"), regions)
    scans.write_field(made.select("key", (F.col("n") % 7).alias("label")).repartitionByRange("key").sortWithinPartitions("key"), labels, {"key": "<i8", "label": "<i4"})
    third = made.filter("(ix + iy) % 3 = 0").select(F.col("key").alias("keys"), (F.col("iz") + 1).alias("labels"), (F.col("n") / 8.0).alias("confidence"))
    scans.write_field(third.repartitionByRange("keys").sortWithinPartitions("keys"), field, {"keys": "<i8", "labels": "u1", "confidence": "<f4"})
    place = lambda c: F.col(c).cast("long")
    read = scans.read(spark, regions, "region", partition_bytes=RANGE).select(((place("x") * 1000 + place("y")) * 1000 + place("z")).alias("key"), "buckets")
    named = read.join(scans.read(spark, labels, "field", partition_bytes=RANGE).select("key", "label"), "key").filter("buckets = label")
    known = scans.read(spark, field, "field", partition_bytes=RANGE).select(F.col("keys").alias("key"), F.col("labels").cast("int").alias("region"), F.col("confidence").cast("double").alias("confidence"))
    return named.join(known, "key", "left").select("key", "label", "region", "confidence")


@query(
    with_(POINTS, "seen AS (SELECT CAST(floor(40 * (x - 25) / (z + 1) / 10 + 320) AS BIGINT) AS u, CAST(floor(40 * (y - 15) / (z + 1) / 10 + 240) AS BIGINT) AS v, frame, cam FROM points)", "set_ AS (SELECT DISTINCT frame, cam, u * 480 + v AS px FROM seen WHERE u >= 0 AND v >= 0 AND v < 480 AND u < 640)")
    + ", runs AS (SELECT frame, cam, count(*) AS length, min(px) AS start FROM (SELECT *, px - row_number() OVER (PARTITION BY frame, cam ORDER BY px) AS g FROM set_) GROUP BY frame, cam, g) SELECT frame, cam, count(*) AS runs, CAST(sum(length) AS BIGINT) AS pixels, min(start) AS first, CAST(sum(start * length) AS BIGINT) AS weight FROM runs GROUP BY 1, 2"
)
def packed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of what each image saw, their run lengths compressed and decoded again."""
    image = F.col("frame") * 8 + F.col("cam")
    pixels = seen(spark, sf_dir).select(image.alias("mask_id"), F.col("v").alias("row"), F.col("u").alias("col")).filter("row >= 0 AND col >= 0 AND row < 480 AND col < 640")
    packed = frames.encoded_masks(frames.counts_of(pixels, 480, 480 * 640))
    runs = frames.mask_runs(frames.decoded_masks(packed))
    out = runs.groupBy("mask_id").agg(F.count("*").alias("runs"), F.sum("length").alias("pixels"), F.min("start").alias("first"), F.sum(F.col("start") * F.col("length")).alias("weight"))
    return out.select(F.floor(F.col("mask_id") / 8).cast("int").alias("frame"), (F.col("mask_id") % 8).cast("int").alias("cam"), "runs", "pixels", "first", "weight")
