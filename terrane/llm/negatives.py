"""Hard-negative mining: angles to reference directions bound scores, only what a window may hold is scored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.shared import Scratch, trimmed
from terrane.llm.terms import Tops

#: Rows by which references are chosen at most, and references for each length of vectors.
SAMPLE, REFERENCES = 2048, 8
#: Rows of a tile, anchors of a pack, tiles of a group.
TILE, PACK, GROUP_TILES = 1024, 256, 32
#: What rounding may do to an angle, and to a score for each unit of it.
SLACK_ANGLE, SLACK_SCORE = 1e-6, 1e-9
#: Sums of squares below this keep 95 times a score in 64 bits.
MOST_SQUARES = 2.0**56
LEAST = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, vec_id: str, label: str, embedding: str) -> DataFrame:
    """(uid, vec_id, label, size, data, squares) of the rows that take part, each component floor(256 x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here, size, data, squares = [], [], [], []
            for k, value in enumerate(batch.column(3)):
                if not value.is_valid or value.values.null_count:
                    continue
                x = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(256 * x) + 0.0
                total = float(x @ x)
                if not total < MOST_SQUARES:
                    raise ArithmeticError("scores of these vectors do not fit 64 bits")
                here.append(k)
                size.append(len(x))
                squares.append(total)
                data.append((x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x.astype(np.int64)).tobytes())
            at = pa.array(here, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(size, pa.int32()), pa.array(data, pa.binary()), pa.array(squares, pa.float64())], names=["uid", "vec_id", "label", "size", "data", "squares"])

    some = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("e"))
    return some.filter("label is not null and e is not null").mapInArrow(trimmed(run), "uid long, vec_id long, label long, size int, data binary, squares double")


def unpacked(size: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * size else np.int64).astype(np.float64)


def references(sample: list[tuple[int, bytes]], most: int = REFERENCES) -> dict[int, np.ndarray]:
    """For each length of vectors up to `most` unit vectors of the sample, each the farthest from those before it."""
    out = {}
    for size in sorted({s for s, _ in sample}):
        x = np.stack([unpacked(size, d) for s, d in sample if s == size])
        norms = np.sqrt((x * x).sum(axis=1))
        x = x[norms > 0] / norms[norms > 0][:, None]
        if len(x):
            chosen, near = [0], x @ x[0]
            while len(chosen) < min(most, len(x)):
                chosen.append(int(near.argmin()))
                near = np.maximum(near, x @ x[chosen[-1]])
            out[size] = x[chosen]
    return out


def with_angles(rows: DataFrame, known: dict[int, np.ndarray]) -> DataFrame:
    """Rows with `angles` to the references of their length, the `near` one and its angle `turn`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles, near, turn = [], [], []
            for size, data, squares in zip(*(batch.column(c).to_pylist() for c in ("size", "data", "squares")), strict=True):
                own = known.get(size, np.zeros((0, size)))
                cosines = own @ unpacked(size, data) / math.sqrt(squares) if squares else np.zeros(len(own))
                a = np.arccos(np.clip(cosines, -1, 1))
                angles.append(a.tobytes())
                near.append(int(a.argmin()) if len(a) else 0)
                turn.append(float(a.min(initial=4.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles, pa.binary()), pa.array(near, pa.int32()), pa.array(turn, pa.float64())], names=[*batch.schema.names, "angles", "near", "turn"])

    more = [T.StructField("angles", T.BinaryType()), T.StructField("near", T.IntegerType()), T.StructField("turn", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def tiles(rows: DataFrame, most: int, *extra: str) -> DataFrame:
    """Rows of one length in tiles of up to `most`: their columns as arrays, and the numbers and angles of all rows one after another."""
    lists = ["uid", "vec_id", "label", "squares", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            size = column["size"].to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(size, prepend=-1)), len(size))
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for k in range(begin, end, most):
                    n = min(most, end - k)
                    ends = pa.array([0, n], pa.int32())
                    data = np.stack([unpacked(int(size[k]), d) for d in column["data"].slice(k, n).to_pylist()])
                    data = data.astype(np.int16 if np.abs(data).max(initial=0) < 1 << 15 else np.int64)
                    angles = b"".join(column["angles"].slice(k, n).to_pylist())
                    out = [pa.ListArray.from_arrays(ends, column[c].slice(k, n)) for c in lists]
                    yield pa.RecordBatch.from_arrays([pa.array([int(size[k])], pa.int32()), *out, pa.array([data.tobytes()], pa.binary()), pa.array([angles], pa.binary())], names=["size", *lists, "data", "angles"])

    schema = T.StructType([T.StructField("size", T.IntegerType()), *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in lists), T.StructField("data", T.BinaryType()), T.StructField("angles", T.BinaryType())])
    return rows.mapInArrow(trimmed(run), schema)


def packs(rows: DataFrame, count: int, *extra: str) -> DataFrame:
    """Anchors in tiles of up to PACK, those of near angles together."""
    return tiles(in_order(rows, max(1, math.ceil(count / (64 * PACK)))), PACK, *extra)


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    """Rows in ranges of length, nearest reference and angle to it; a range of equal ones is cut by uid."""
    order = ("size", "near", "turn", "uid")
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


class Side:
    """A tile's rows, as arrays."""

    def __init__(self, row: dict, prefix: str):
        self.uid = row[f"{prefix}uid"].values.to_numpy()
        ids = row[f"{prefix}vec_id"].values
        self.absent, self.ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        self.label = row[f"{prefix}label"].values.to_numpy()
        self.norm = np.sqrt(row[f"{prefix}squares"].values.to_numpy())
        n, size, data = len(self.uid), row["size"].as_py(), row[f"{prefix}data"].as_py()
        self.data = np.frombuffer(data, np.int16 if len(data) == 2 * n * size else np.int64).reshape(n, size)
        self.angles = np.frombuffer(row[f"{prefix}angles"].as_py(), np.float64).reshape(n, -1)


def score_bounds(low: np.ndarray, high: np.ndarray, norms: np.ndarray, most_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) scores of vectors between the angles, their norms' products between the two; safe against rounding."""
    least, most = np.cos(np.minimum(high + SLACK_ANGLE, np.pi)), np.cos(np.maximum(low - SLACK_ANGLE, 0))
    slack = 1 + SLACK_SCORE * most_norms
    return np.minimum(least * norms, least * most_norms) - slack, np.maximum(most * norms, most * most_norms) + slack


def tile_bounds(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each row of `a` with any row of tile `b`."""
    low, high = np.zeros(len(a.uid)), np.full(len(a.uid), np.pi)
    for k in range(a.angles.shape[1]):
        first, last, own = b.angles[:, k].min(), b.angles[:, k].max(), a.angles[:, k]
        low = np.maximum(low, np.maximum(own - last, first - own))
        high = np.minimum(high, np.minimum(own + last, 2 * np.pi - own - first))
    return score_bounds(low, high, a.norm * b.norm.min(), a.norm * b.norm.max())


def row_bounds(a: Side, rows: np.ndarray, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of some rows of `a` with each row of `b`: two angles to a reference differ by the pair's angle at most."""
    low, high = np.zeros((len(rows), len(b.uid))), np.full((len(rows), len(b.uid)), np.pi)
    for k in range(a.angles.shape[1]):
        own, other = a.angles[rows, k][:, None], b.angles[:, k][None]
        np.maximum(low, np.abs(own - other), out=low)
        both = own + other
        np.minimum(high, np.minimum(both, 2 * np.pi - both), out=high)
    norms = a.norm[rows][:, None] * b.norm[None]
    return score_bounds(low, high, norms, norms)


def scores(a: Side, rows: np.ndarray, b: Side, columns: np.ndarray) -> np.ndarray:
    """Exact inner products of some rows: in float64 where all sums stay below 2 ** 53, else in 64-bit integers."""
    exact = a.norm[rows].max(initial=0) * b.norm[columns].max(initial=0) < 2.0**52
    kind = np.float64 if exact else np.int64
    return (a.data[rows].astype(kind) @ b.data[columns].astype(kind).T).astype(np.int64)


def overlapping(a: Side, b: Side, wanted: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the wanted pairs whose score bounds meet the row's window from `lower` to `upper`."""
    least, most = tile_bounds(a, b)
    rows = np.flatnonzero((most >= lower) & (least <= upper) & wanted.any(axis=1))
    if not len(rows):
        return rows, rows, rows
    least, most = row_bounds(a, rows, b)
    kept = wanted[rows] & (most >= lower[rows][:, None]) & (least <= upper[rows][:, None])
    columns = np.flatnonzero(kept.any(axis=0))
    x, y = np.nonzero(kept[:, columns])
    found = scores(a, rows, b, columns)[x, y]
    return rows[x], columns[y], found


def paired(all_tiles: DataFrame, packs: DataFrame, groups: int) -> DataFrame:
    """Each tile with each pack of anchors of its length: tiles are dealt to groups, and packs go to all groups."""
    dealt = all_tiles.withColumn("group", F.pmod(F.xxhash64(F.element_at("uid", 1)), F.lit(groups)).cast("int"))
    spread = packs.select("size", *(F.col(c).alias(f"a_{c}") for c in packs.columns if c != "size"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    # merged, as the packs of all groups are larger than the table that they come from
    return dealt.join(spread.hint("merge"), ["size", "group"])


def best_positives(pairs: DataFrame, k: int) -> DataFrame:
    """(anchor, vec_id, score, uid): of each partition the first `k` other rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = Tops(k)
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                a, b = Side(row, "a_"), Side(row, "")
                wanted = (a.label[:, None] == b.label[None]) & (a.uid[:, None] != b.uid[None])
                lower = tops.floors(a.uid).astype(np.float64)
                x, y, found = overlapping(a, b, wanted, lower, np.full(len(lower), np.inf))
                for pool in tops.add(a.uid[x], found, b.ids[y], b.absent[y], b.uid[y]):
                    yield given(*pool)
        for pool in tops.rest():
            yield given(*pool)

    def given(key: np.ndarray, score: np.ndarray, order: np.ndarray, absent: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(order, mask=absent), pa.array(score), pa.array(extra)], names=["anchor", "vec_id", "score", "uid"])

    return pairs.mapInArrow(trimmed(run), "anchor long, vec_id long, score long, uid long")


def best_negatives(pairs: DataFrame, k: int, most_positives: int, least: int, most: int) -> DataFrame:
    """(anchor, nth, vec_id, score, uid): of each partition the first `k` rows of another label in the window of the anchor's nth positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = Tops(k)
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                a, b = Side(row, "a_"), Side(row, "")
                wanted = a.label[:, None] != b.label[None]
                positive = row["a_positives"].values
                sizes = positive.value_lengths().to_numpy()
                flat, at = positive.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
                nth = np.arange(len(flat)) - np.repeat(sizes.cumsum() - sizes, sizes)
                # rounded inward: least * p <= 100 * score <= most * p
                low, high = np.full((len(sizes), most_positives), np.iinfo(np.int64).max), np.full((len(sizes), most_positives), LEAST)
                low[at, nth], high[at, nth] = -((-least * flat) // 100), (most * flat) // 100
                keys = a.uid[:, None] * most_positives + np.arange(most_positives)
                low = np.maximum(low, tops.floors(keys.ravel()).reshape(keys.shape))
                empty = low > high
                lower, upper = np.where(empty, np.inf, low).min(axis=1), np.where(empty, -np.inf, high).max(axis=1)
                x, y, found = overlapping(a, b, wanted & (lower <= upper)[:, None], lower, upper)
                for j in range(most_positives):
                    held = (found >= low[x, j]) & (found <= high[x, j])
                    i, o = x[held], y[held]
                    for pool in tops.add(keys[i, j], found[held], b.ids[o], b.absent[o], b.uid[o]):
                        yield given(*pool)
        for pool in tops.rest():
            yield given(*pool)

    def given(key: np.ndarray, score: np.ndarray, order: np.ndarray, absent: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key // most_positives), pa.array((key % most_positives).astype(np.int32)), pa.array(order, mask=absent), pa.array(score), pa.array(extra)], names=["anchor", "nth", "vec_id", "score", "uid"])

    return pairs.mapInArrow(trimmed(run), "anchor long, nth int, vec_id long, score long, uid long")


def first_of_each(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(spark: SparkSession, rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", references_of: int = REFERENCES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of each row for which `anchors` (of vec_id) holds.

    A component x counts as floor(256 x), a score is the inner product of those. An anchor's positives are its
    first `positives` other rows of the same label by score, and for each of them the first `negatives` rows of
    other labels with least * positive_score <= 100 * negative_score <= most * positive_score are given.
    Equal scores come by ascending vec_id, null ones last, repeated ones in any order.

    Rows keep their angles to up to `references_of` vectors of a sample of SAMPLE rows, which change the work
    alone. By the triangle inequality the angle of a pair lies between the difference of two such angles and
    their sum, which bounds its score; of tiles of rows with near angles first, then of single rows, only
    what may lie in an anchor's window (for positives: at or above its last positive so far) is scored, exactly.

    Rows with a null label or vector or a null or non-finite component take no part; vectors of different
    lengths never meet; zero and empty vectors score 0. Rows that share a vec_id are rows of their own; a null
    vec_id is no anchor. An empty table gives an empty one; other columns are left out. Vectors whose sum of
    squares reaches 2 ** 56 raise an ArithmeticError, as their scores would leave 64 bits.
    """
    scratch = Scratch(spark, "negatives")
    whole, _ = scratch.keep(whole_vectors(rows, vec_id, label, embedding))
    sample = whole.filter("squares > 0").select("size", "data", F.xxhash64("data").alias("h")).orderBy("h", "data").limit(SAMPLE)
    known = references([(r["size"], bytes(r["data"])) for r in sample.collect()], references_of)
    turned, _ = scratch.keep(with_angles(whole, known))
    count = turned.count()
    all_tiles, _ = scratch.keep(tiles(in_order(turned, max(1, math.ceil(count / (4 * TILE)))), TILE))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(all_tiles.count() / GROUP_TILES))
    asking, _ = scratch.keep(turned.filter(anchors))
    positive, _ = scratch.keep(first_of_each(best_positives(paired(all_tiles, packs(asking, count), groups), positives), ["anchor"], positives))
    of_each = positive.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("positives"))
    asked = packs(asking.join(of_each, F.col("uid") == F.col("anchor")), count, "positives")
    negative = first_of_each(best_negatives(paired(all_tiles, asked, groups), negatives, positives, least, most), ["anchor", "nth"], negatives)
    named = positive.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negative.select("anchor", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "nth"])
    ids = asking.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return out.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
