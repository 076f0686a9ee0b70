"""Embedding near-duplicates: sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.buckets import Forest, block_pairs, group_starts, whole_groups
from terrane.llm.components import connected_components
from terrane.llm.shared import Scratch

SEED = 20_011
#: Vectors that a bucket has on average, if all are spread evenly.
BUCKET = 32
BLOCK = 1024


def hash_shape(count: int, least: float, recall: float) -> tuple[int, int]:
    """(bits, tables): bits grow with the logarithm of the count, tables so that a pair at `least` is met with probability `recall`."""
    bits = max(6, min(30, math.ceil(math.log2(max(2, count) / BUCKET))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def packed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, size, packed): number of components and their bytes; null for vectors that link with nothing.

    Components are scaled by a power of two, which is exact, so that no norm overflows, and packed as 4-byte
    floats if those are exact too, else as 8-byte ones.
    """
    kind = vectors.schema[vec_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for value in batch.column(1):
                row = None
                if value.is_valid and not value.values.null_count and len(value.values):
                    x = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
                    if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                        x = np.ldexp(x, -int(np.frexp(top)[1]))
                        short = x.astype(np.float32)
                        row = short.tobytes() if (short == x).all() else x.tobytes()
                out.append(row)
                sizes.append(len(value.values) if row else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "size", "packed"])

    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("size", T.IntegerType()), T.StructField("packed", T.BinaryType())])
    return vectors.select(vec_id, embedding).mapInArrow(run, schema)


def unpacked(size: int, value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.float32 if len(value) == 4 * size else np.float64).astype(np.float64)


class Planes:
    """Random hyperplanes for each length of vectors, the same in every task; the sides of a vector make its code in each table."""

    def __init__(self, bits: int, tables: int):
        self.bits, self.tables, self.known = bits, tables, {}

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) of vectors of one length."""
        size = x.shape[1]
        if size not in self.known:
            self.known[size] = np.random.default_rng([SEED, size]).standard_normal((self.tables * self.bits, size))
        # row by row, so that a vector's sides never depend on the rows beside it
        sides = np.stack([self.known[size] @ row >= 0 for row in x]) if len(x) else np.zeros((0, self.tables * self.bits), bool)
        return (sides.reshape(-1, self.tables, self.bits) << np.arange(self.bits)).sum(axis=2)


def hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Classes with `codes`, their buckets in the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(bits, tables)
        for batch in batches:
            # vectors of another length get other buckets
            codes = [((size << 32) + planes.codes(unpacked(size, value)[None])[0]).tolist() for size, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], names=["rep", "size", "packed", "copies", "codes"])

    kind = classes.schema["rep"].dataType.simpleString()
    return classes.select("rep", "size", "packed", "copies").mapInArrow(run, f"rep {kind}, size int, packed binary, copies long, codes array<long>")


def links(classes: DataFrame, count: int, least: float, recall: float, scratch: Scratch, block: int) -> DataFrame:
    """Of every bucket: (src, dst, 0), a spanning forest of the links met there, and (src, null, n), the copies that the class links to.

    A pair counts in the first table in which it shares a bucket, so no table of all pairs is needed.
    """
    bits, tables = hash_shape(count, least, recall)
    coded, _ = scratch.keep(hashed(classes, bits, tables))
    rows = coded.select("rep", "size", "packed", "copies", F.posexplode("codes").alias("table", "code")).withColumn("bucket", F.xxhash64("table", "code"))
    paired = block_pairs(rows, "bucket", F.xxhash64("packed"), scratch, block).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "table", "code", "i", "j", "side")
    groups = ["bucket", "table", "code", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(bits, tables)
        for whole in whole_groups(batches, groups):
            starts = np.append(group_starts(whole, groups), whole.num_rows)
            src, dst, n = [], [], []
            for begin, end in zip(starts[:-1], starts[1:], strict=True):
                if end - begin > 1:
                    _compare(whole.slice(begin, end - begin), planes, least, src, dst, n)
            yield pa.RecordBatch.from_arrays([pa.array(src, whole.schema.field("rep").type), pa.array(dst, whole.schema.field("rep").type), pa.array(n, pa.int64())], names=["src", "dst", "n"])

    kind = classes.schema["rep"].dataType.simpleString()
    return paired.mapInArrow(run, f"src {kind}, dst {kind}, n long")


def _compare(group: pa.Table, planes: Planes, least: float, src: list, dst: list, n: list) -> None:
    raw = np.stack([unpacked(size, v) for size, v in zip(group.column("size").to_pylist(), group.column("packed").to_pylist(), strict=True)])
    x = raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
    table = group.column("table")[0].as_py()
    first, second = np.nonzero(x @ x.T >= least)
    if group.column("i")[0].as_py() == group.column("j")[0].as_py():
        wanted = first < second
    else:
        side = group.column("side").to_numpy()
        wanted = side[first] < side[second]
    first, second = first[wanted], second[wanted]
    if not len(first):
        return
    if table:
        met, place = np.unique(np.concatenate((first, second)), return_inverse=True)
        before = planes.codes(raw[met])[:, :table]
        a, b = place[: len(first)], place[len(first) :]
        here = np.empty(len(first), bool)
        for k in range(0, len(first), 1 << 16):
            part = slice(k, k + (1 << 16))
            here[part] = ~(before[a[part]] == before[b[part]]).any(axis=1)
        first, second = first[here], second[here]
    rep, copies = group.column("rep").to_pylist(), group.column("copies").to_numpy()
    added = np.bincount(first, copies[second], len(rep)) + np.bincount(second, copies[first], len(rep))
    for k in np.flatnonzero(added).tolist():
        src.append(rep[k])
        dst.append(None)
        n.append(int(added[k]))
    forest = Forest(len(rep))
    for a, b in zip(first.tolist(), second.tolist(), strict=True):
        if forest.join(a, b):
            src.append(rep[a])
            dst.append(rep[b])
            n.append(0)


def near_duplicates(spark: SparkSession, vectors: DataFrame, least: float = 0.95, recall: float = 0.9999, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row, by cosine in double precision.

    Every pair given has a cosine of `least` or more; a pair at just `least` is found with probability
    `recall`, closer ones more often. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing; vectors of different lengths never link. Vectors of equal direction
    bytes are one class, stood for by its smallest vec_id; they link to each other without being paired.
    Repeated rows count as other vectors. An empty table gives an empty one; other columns are left out.
    """
    scratch = Scratch(spark, "cosine")
    rows, _ = scratch.keep(packed(vectors, vec_id, embedding))
    classes, _ = scratch.keep(rows.filter("packed is not null").groupBy("size", "packed").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    known = classes.filter("rep is not null")
    found, _ = scratch.keep(links(known, known.count(), least, recall, scratch, block))
    parts = connected_components(spark, found.filter("dst is not null").select("src", "dst"))
    degree = found.filter("dst is null").groupBy("src").agg(F.sum("n").alias("others"))
    named = (
        classes.join(parts, classes["rep"] == parts["node"], "left")
        .join(degree, classes["rep"] == degree["src"], "left")
        .select("size", "packed", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.join(named, ["size", "packed"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
