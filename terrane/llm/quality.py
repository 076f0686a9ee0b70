"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.shared import Scratch, raw_texts, text_slices

UPPER, LOWER, DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
STOPS, MARKS = b".,;:?'\"()-", bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,;:?'\"()-")
NAMES = ("length", "word_length", "upper", "digit", "stop", "mark", "high", "lines", "distinct", "twice", "top", "same_lines", "shout")
SHRINKAGE, RIDGE = 0.3, 0.05
#: Added to what a share is of, so that a few words or characters say little.
DAMPING = 5


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text: logarithms of sizes, square roots of damped shares."""
    n, words = len(text), text.split()
    m = len(words)
    share = lambda a, b: (a / (b + DAMPING)) ** 0.5
    count = lambda chars: n - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x]
    upper, lower = count(UPPER), count(LOWER)
    counts = Counter(words)
    return [
        np.log1p(n),
        np.log1p((n - text.count(b" ")) / m) if m else 0.0,
        share(upper, upper + lower),
        share(count(DIGIT), n),
        share(count(STOPS), n),
        share(count(MARKS), n),
        share(n - len(text.translate(None, bytes(range(128, 256)))), n),
        share(len(lines), m),
        np.log1p(len(counts)) / np.log1p(m) if m else 0.0,
        share(sum(map(eq, words, words[1:])), m),
        share(max(counts.values(), default=0), m),
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(map(bytes.isupper, words)), m),
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and `x`, the statistics of each whole text; a null text counts as empty."""
    chosen = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text"):
            x = [statistics(t) for t in raw_texts(batch, "__text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[: len(keep)])
    return chosen.mapInArrow(run, f"{fields}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, log priors and inverse Cholesky factors of the shrunken covariances of classes 0 and 1."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        if self.offsets[1] == -np.inf or self.offsets[0] == -np.inf:
            return np.full(len(x), 0.5 if self.offsets[0] == self.offsets[1] else float(self.offsets[1] > self.offsets[0]))
        z = (x - self.center) / self.scale
        density = [self.offsets[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def moments(labelled: DataFrame, width: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of `x` in each class; each partition gives its sums, Spark adds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(y), width)
            x = np.hstack([np.ones((len(y), 1)), x])
            for c in (0, 1):
                part = x[y == c]
                sums[c] = sums.get(c, 0) + part.T @ part
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * s.size, pa.int32()), pa.array(range(s.size), pa.int32()), pa.array(s.ravel())], names=["y", "k", "v"])

    rows = labelled.mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    out = {c: np.zeros((width + 1) ** 2) for c in (0, 1)}
    for row in rows:
        out[row["y"]][row["k"]] = row["v"]
    grids = {c: v.reshape(width + 1, width + 1) for c, v in out.items()}
    return {c: (g[0, 0], g[0, 1:], g[1:, 1:]) for c, g in grids.items()}


def fit(found: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Discriminant:
    """Each class covariance is drawn by `shrinkage` to the pooled one and by `ridge` to the unit matrix, in pooled units."""
    n = np.array([found[c][0] for c in (0, 1)])
    width = len(found[0][1])
    total = max(1.0, n.sum())
    center = (found[0][1] + found[1][1]) / total
    raw = [found[c][2] - np.outer(found[c][1], center) - np.outer(center, found[c][1]) + n[c] * np.outer(center, center) for c in (0, 1)]
    scale = np.sqrt(np.maximum(np.diag(raw[0] + raw[1]) / total, 1e-12))
    grid = [r / np.outer(scale, scale) for r in raw]
    means = np.array([(found[c][1] - n[c] * center) / scale / max(1.0, n[c]) for c in (0, 1)])
    within = [g - n[c] * np.outer(means[c], means[c]) for c, g in enumerate(grid)]
    pooled = (within[0] + within[1]) / total
    factors, offsets = [], []
    for c in (0, 1):
        own = within[c] / max(1.0, n[c])
        lower = np.linalg.cholesky((1 - shrinkage) * own + shrinkage * pooled + ridge * np.eye(width))
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n[c] / total) - np.log(np.diag(lower)).sum() if n[c] else -np.inf)
    return Discriminant(center, scale, means, np.array(factors), np.array(offsets))


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """(doc_id, score) of each row of `docs`, learnt from `labels` (doc_id, quality) where `learn` holds of doc_id.

    Every labelled row counts in the moments; labels other than 0 and 1 and rows without doc_id are passed
    over, repeated labels count as often as they stand. With one class learnt, all score as that class; with
    none, 0.5. Null and empty texts score as empty ones, equal texts alike; a score of just 0.5 counts as class 1.
    Repeated rows are kept; an empty table gives an empty one; other columns are left out. A text is worked on whole: a
    task takes about 10 bytes for each byte of its longest one.
    """
    rows, _ = Scratch(spark, "quality").keep(with_statistics(docs, ["doc_id"]))
    known = labels.filter("quality in (0, 1)").filter(learn).select("doc_id", F.col("quality").cast("int").alias("y"))
    model = spark.sparkContext.broadcast(fit(moments(rows.join(known, "doc_id").select("y", "x"), len(NAMES)), **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of `docs`, with their columns, whose score is `least` or more; learnt from all labelled rows.

    Cases are as in scores(). Statistics are computed again as rows are kept, so texts aren't moved.
    """
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y"))
    found = with_statistics(docs, ["doc_id"]).join(known, F.col("doc_id") == F.col("__id"))
    model = spark.sparkContext.broadcast(fit(moments(found.select("y", "x"), len(NAMES)), **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = np.array([statistics(t) for t in raw_texts(batch)], np.float64)
            yield batch.filter(pa.array(model.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
