"""Document fingerprints: locally consistent parsing by deterministic coin tossing, phrases named level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.shared import SLICE_BYTES, text_slices, trimmed, whole_ids

#: Phrases from this level on make the signature, and hashes that a fingerprint keeps of it.
LEVEL, KEPT = 3, 64
#: Bytes of text of a range of neighbouring documents: the first while ranges are few, the second at most; a task streams its ranges.
RANGE_BYTES, LARGE_RANGE_BYTES = 4 << 20, 128 << 20
#: Ranges that are cut at once; more of them are cut inside those.
CUT_RANGES = 10_000
TOSSES = 4

U = np.uint64
ODD = (U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53))
BASE = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ U(int(ODD[0]) * (salt + 1) & (1 << 64) - 1)) * ODD[1]
    x = (x ^ (x >> U(32))) * ODD[2]
    return x ^ (x >> U(29))


def tosses(names: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A label below 6 for each name, unlike its neighbour's to the left, from the name and TOSSES names to its left.

    A toss gives twice the lowest bit in which a name differs from the one to its left, plus that bit.
    `edge` marks the first names of the texts, whose neighbour counts as 0.
    """
    left = np.concatenate(([U(0)], names[:-1]))
    left[edge] = 0
    differs = names ^ left
    low = differs & (~differs + U(1))
    label = (2 * np.bitwise_count(low - U(1)) + ((names & low) != 0)).astype(np.uint8)
    for _ in range(TOSSES - 1):
        left = np.concatenate(([np.uint8(0)], label[:-1]))
        left[edge] = label[edge] ^ 1
        label = TOSS[left, label]
    return label


def _toss_table() -> np.ndarray:
    a, b = np.meshgrid(np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8), indexing="ij")
    differs = a ^ b
    low = (differs & (~differs + np.uint8(1))).astype(np.uint8)
    return (2 * np.bitwise_count(low - np.uint8(1)) * (low > 0) + ((b & low) != 0)).astype(np.uint8)


TOSS = _toss_table()


def level_up(names: np.ndarray, owner: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The names and texts of the next level's phrases: runs first, then stretches that begin where a label is highest."""
    edge = np.ones(len(owner), bool)
    edge[1:] = owner[1:] != owner[:-1]
    new = edge.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    long = np.diff(np.append(at, len(names)))
    names, owner, edge = names[at], owner[at], edge[at]
    # the level keeps a phrase from having the name of another level's
    names = mixed(names, 16 + level)
    runs = long > 1
    names[runs] = mixed(names[runs] + long[runs].astype(np.uint64), 1)
    label = tosses(names, np.flatnonzero(edge))
    top = edge.copy()
    top[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    # a text's last name begins no phrase, nor does its second
    top[1:] &= ~edge[:-1] | edge[1:]
    top[:-1] &= ~edge[1:] | edge[:-1]
    top[-1] &= edge[-1]
    begin = np.flatnonzero(top)
    size = np.diff(np.append(begin, len(names)))
    within = np.arange(len(names)) - np.repeat(begin, size)
    powers = np.full(int(size.max()), BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return mixed(np.add.reduceat(names * powers[within], begin) + size.astype(np.uint64), 2), owner[begin]


def signatures(texts: list[bytes], least: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of all phrases of level `least` or more and of each text's one highest phrase, without repeats."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    names = mixed(np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64))
    owner = np.repeat(np.arange(len(texts)), sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    level = 0
    while len(owner):
        names, owner = level_up(names, owner, level)
        level += 1
        whole = np.bincount(owner, minlength=len(texts))[owner] == 1
        taken = np.ones(len(owner), bool) if level >= least else whole
        found.append((owner[taken], names[taken]))
        names, owner = names[~whole], owner[~whole]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, name = np.concatenate([t for t, _ in found]), np.concatenate([x for _, x in found]) >> U(32)
    order = np.lexsort((name, text))
    text, name = text[order], name[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1])
    return text[first], name[first]


def fingerprints(texts: list[bytes], kept: int = KEPT, least: int = LEVEL) -> list[np.ndarray]:
    """The `kept` least 32-bit names of each text's signature, in order; an empty text has none."""
    text, name = signatures(texts, least)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [name[a : min(b, a + kept)].astype(">u4") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """The share of phrases that two texts have in common, by their fingerprints; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:kept]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def edited(text: str, after: str) -> str:
    """`text` with its last half, rounded down, replaced by as many characters from the start of `after`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def range_cuts(spark: SparkSession, placed: DataFrame, n: int, cut_ranges: int = CUT_RANGES) -> np.ndarray:
    """About n - 1 quantiles of place: at most `cut_ranges` of the whole table, and if that is too few as many of each part as it takes."""
    coarse = min(n, cut_ranges)
    cuts = placed.approxQuantile("place", [k / coarse for k in range(1, coarse)], 0.2 / coarse) if coarse > 1 else []
    cuts = np.unique(np.array(cuts, np.float64).astype(np.int64))
    each = -(-n // coarse)
    if each == 1:
        return cuts
    ids = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def part(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ids.value, place.to_numpy(), "right").astype(np.int32))

    inner = placed.groupBy(part("place").alias("part")).agg(F.percentile_approx("place", [k / each for k in range(1, each)], 10 * each).alias("cuts")).select(F.explode("cuts").alias("cut")).distinct()
    return np.union1d(cuts, np.array([r["cut"] for r in inner.collect()], np.int64))


def in_ranges(spark: SparkSession, docs: DataFrame, range_bytes: int, cut_ranges: int = CUT_RANGES) -> DataFrame:
    """Documents in ranges of doc_id, each range with the first document of the next one, the last with the very first.

    Columns: range, extra (true for that added document), place (doc_id, null as the least long), doc_id,
    text. Only doc_ids and lengths are read to cut the ranges; one number for each range reaches the driver:
    ranges grow with the table up to 128 MB, beyond which there are more of them (800,000 at 100 TB).
    """
    placed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("place"), "doc_id", "text")
    total = placed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(min(total // range_bytes, cut_ranges), total // LARGE_RANGE_BYTES) + 1
    cuts = range_cuts(spark, placed, n, cut_ranges)
    ids = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def number(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ids.value, place.to_numpy(), "right").astype(np.int32))

    firsts = sorted((r["place"], r["range"]) for r in placed.select("place", number("place").alias("range")).groupBy("range").agg(F.min("place").alias("place")).collect())
    goes = {place: [firsts[k - 1][1], k == 0] for k, (place, _) in enumerate(firsts)}
    also = spark.sparkContext.broadcast({place: last for place, (last, _) in goes.items()})

    @F.pandas_udf("array<int>")
    def numbers(place: pd.Series) -> pd.Series:
        own = np.searchsorted(ids.value, place.to_numpy(), "right").tolist()
        return pd.Series([[r] if p not in also.value else [r, also.value[p]] for r, p in zip(own, place.tolist(), strict=True)])

    dealt = placed.select("place", "doc_id", "text", F.posexplode(numbers("place")).alias("added", "range"))
    return dealt.select("range", (F.col("added") > 0).alias("extra"), "place", "doc_id", "text").repartition(n, "range").sortWithinPartitions("range", "extra", "place", "text")


def compared(spark: SparkSession, docs: DataFrame, range_bytes: int = RANGE_BYTES, cut_ranges: int = CUT_RANGES) -> DataFrame:
    """Each whole text's fingerprint, its edited text's, and how like it those and the next document's are.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (lowercase
    hex, 8 digits a phrase), near_edited, near_next. The next document is that of the next doc_id, after
    the last the first; of rows that share a doc_id, by text. A null text counts as empty, a null doc_id
    as the least. One document alone is its own next one. Of phrases that tie for a place in a fingerprint
    the names are equal, so either gives the same. An empty table gives an empty one; other columns are left
    out. A doc_id that is no whole number is refused by a TypeError. A text is worked on whole: a task takes
    about 60 times the bytes of its longest one.
    """
    whole_ids(docs, "fingerprints")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in text_slices(batches):
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if held and held[-1][1] and (row[1] and row[0] == held[-1][0]):
                    continue  # only the first of the added rows is a neighbour
                held.append(row)
                size += len(row[3] or "")
                if size >= SLICE_BYTES:
                    yield _pairs(held, batch.schema.field(2).type)
                    held, size = held[-1:], len(row[3] or "")
        if len(held) > 1:
            yield _pairs(held, batch.schema.field(2).type)

    return in_ranges(spark, docs, range_bytes, cut_ranges).mapInArrow(trimmed(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _pairs(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Rows for all held (range, extra, doc_id, text) whose next one is held."""
    texts = [row[3] or "" for row in held]
    own = [k for k in range(len(held) - 1) if not held[k][1]]
    changed = [edited(texts[k], texts[k + 1]) for k in own]
    raw = [t.encode() for t in changed]
    prints = fingerprints([t.encode() for t in texts])
    after = fingerprints(raw)
    columns = [
        pa.array([held[k][2] for k in own], kind),
        pa.array([len(texts[k]) for k in own], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
        pa.array([prints[k].tobytes().hex() for k in own], pa.string()),
        pa.array([x.tobytes().hex() for x in after], pa.string()),
        pa.array([likeness(prints[k], x) for k, x in zip(own, after, strict=True)], pa.float64()),
        pa.array([likeness(prints[k], prints[k + 1]) for k in own], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
