"""LM scoring by cross-entropy difference: two matched bigram models over all words."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.shared import Scratch, raw_texts, text_slices

#: Every word is counted as itself: the vocabulary has no limit, so no word ever gets one of the classes.
WORDS, CLASSES = sys.maxsize, 256
#: The mark at both ends of a text, and the number of words that smoothing takes the open vocabulary to have.
EDGE, IDS = -1, 1 << 20
#: Weight, in tokens, of the unigram distribution in each bigram one.
PRIOR = 40.0
SEED = 42
#: Ranges of names at least, and most tokens for each of them before there are twice as many.
RANGES, RANGE_TOKENS = 256, 2_000_000
#: Bytes of text in a slice: larger ones send fewer words and bigrams twice.
SLICE_BYTES = 8 << 20


def tokens(text: bytes) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def pair_names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit names of bigrams from those of their words."""
    mixed = (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + second
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def planes(values: np.ndarray) -> bytes:
    """Unsigned longs as eight planes of bytes, compressed, after their number."""
    data = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unplaned(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], n * 8, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the distinct words, the edge first; all texts' words as positions there, an edge before each text and one at the end; each text's number of bigrams."""
    from xxhash import xxh64_intdigest

    split = [tokens(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    at = {w: k for k, w in enumerate(dict.fromkeys(w for words in split for w in words), 1)}
    names = np.fromiter((xxh64_intdigest(w, SEED) for w in at), np.uint64, len(at))
    flat = np.zeros(int(sizes.sum()) + 1, np.int32)
    inside = np.ones(len(flat), bool)
    inside[0] = False
    inside[sizes.cumsum()] = False
    flat[inside] = np.fromiter((at[w] for words in split for w in words), np.int32, int(inside.sum()))
    return np.concatenate((np.array([EDGE], np.int64).view(np.uint64), names)), flat, sizes


def slices(docs: DataFrame) -> DataFrame:
    """A row for each slice of (doc_id, text, target): its documents, targets, sizes, words and their order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in text_slices(batches, most=SLICE_BYTES):
            names, flat, sizes = sequences(raw_texts(batch))
            marks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            ids = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0))
            row = [pa.array([uuid.uuid4().hex]), ids, *(pa.array([planes(x)], pa.binary()) for x in (marks, sizes, names, flat)), pa.array([int(sizes[~marks].sum())]), pa.array([int(sizes[marks].sum())])]
            yield pa.RecordBatch.from_arrays(row, names=["slice", "ids", "marks", "sizes", "words", "flat", "n0", "n1"])

    return docs.select("doc_id", "text", "target").mapInArrow(run, f"slice string, ids array<{kind}>, marks binary, sizes binary, words binary, flat binary, n0 long, n1 long")


def bigrams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: names of its words, positions of each bigram's words, the bigrams' names, and each text's number of them."""
    words, flat, sizes = unplaned(row["words"]), unplaned(row["flat"]), unplaned(row["sizes"]).astype(np.int64)
    first, second = flat[:-1], flat[1:]
    return words, first, second, pair_names(words[first], words[second]), sizes


def sent_counts(found: DataFrame, ranges: int) -> DataFrame:
    """(slice, part, names, n0, n1): each slice's words and bigrams once, sorted by name and cut by ranges of names, with its counts for both models."""
    starts = (np.arange(ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, _, second, pairs, sizes = bigrams(row)
                names, at = np.unique(np.concatenate((words[second], pairs)), return_inverse=True)
                marks = np.tile(np.repeat(unplaned(row["marks"]), sizes), 2)
                counts = [np.bincount(at[marks == m], minlength=len(names)) for m in (0, 1)]
                cuts = np.append(np.searchsorted(names, starts), len(names))
                parts = np.flatnonzero(np.diff(cuts))
                spans = [(int(cuts[k]), int(cuts[k + 1])) for k in parts]
                sent = [pa.array([planes(np.diff(names[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary())]
                sent += [pa.array([planes(c[a:b]) for a, b in spans], pa.binary()) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]] * len(parts)), pa.array(parts.astype(np.int32)), *sent], names=["slice", "part", "names", "n0", "n1"])

    return found.select("slice", "marks", "sizes", "words", "flat").mapInArrow(run, "slice string, part int, names binary, n0 binary, n1 binary")


def summed(table: pa.Table) -> pa.Table:
    """The rows of a range of names with the counts of all slices in place of their own."""
    each = [np.cumsum(unplaned(x), dtype=np.uint64) for x in table.column("names").to_pylist()]
    ends = np.cumsum([len(x) for x in each])
    _, at = np.unique(np.concatenate(each), return_inverse=True)
    out = []
    for name in ("n0", "n1"):
        sums = np.bincount(at, np.concatenate([unplaned(x) for x in table.column(name).to_pylist()])).astype(np.uint64)[at]
        out.append(pa.array([planes(x) for x in np.split(sums, ends[:-1])], pa.binary()))
    return pa.Table.from_arrays([table.column("slice"), table.column("part"), *out], names=["slice", "part", "n0", "n1"])


def scores(spark: SparkSession, docs: DataFrame, target: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of each whole text.

    Both models have the vocabulary, the order and the smoothing in common and are counted over all words and
    bigrams of all documents: the target one over those whose doc_id is in `target`, the background one over
    the others. p(second | first) is the bigram's count with `prior` tokens of the unigram distribution, in
    which each word has one token more and the whole IDS more. Counts are never gathered: a slice of documents
    sends each of its words and bigrams once, by 64-bit name, and gets back what all slices sum to.

    Losses are means in nats over a text's words and its end; score is target_loss - background_loss, lower
    for texts more like the target. Without documents of one kind that model has smoothing alone. A null text
    counts as empty and has the loss of an end alone. Repeated rows are kept and counted; a null doc_id is no
    target; an empty table gives an empty one; other columns are left out. Texts of equal losses have equal scores; none
    are ranked. A text is worked on whole: a task takes about 10 bytes for each byte of its longest one.
    """
    scratch = Scratch(spark, "entropy")
    marks = target.select(F.col("doc_id").alias("__target")).filter("__target is not null").distinct()
    # by merging at every size, so that a small set of targets isn't joined otherwise than a large one
    marked = docs.select("doc_id", "text").join(marks.hint("merge"), F.col("doc_id") == F.col("__target"), "left").select("doc_id", "text", F.col("__target").isNotNull().alias("target"))
    found, _ = scratch.keep(slices(marked))
    total = [int(x or 0) for x in found.agg(F.sum("n0"), F.sum("n1")).first()]
    ranges = RANGES
    while sum(total) > ranges * RANGE_TOKENS:
        ranges *= 2
    counted = sent_counts(found, ranges).groupBy("part").applyInArrow(summed, "slice string, part int, n0 binary, n1 binary")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(own: pa.Table, counts: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        words, first, second, pairs, sizes = bigrams(row)
        names = np.unique(np.concatenate((words[second], pairs)))
        counts = counts.sort_by("part")
        word_at, pair_at = np.searchsorted(names, words), np.searchsorted(names, pairs)
        begins = sizes.cumsum() - sizes
        loss = []
        for m in (0, 1):
            n = np.concatenate([unplaned(x) for x in counts.column(f"n{m}").to_pylist()]).astype(np.float64)
            word, pair = n[word_at], n[pair_at]
            each = -np.log((pair + prior * (word[second] + 1) / (total[m] + IDS)) / (word[first] + prior))
            loss.append(np.add.reduceat(each, begins) / sizes)
        return pa.Table.from_arrays([own.column("ids").combine_chunks().flatten(), pa.array(sizes - 1), pa.array(loss[1]), pa.array(loss[0]), pa.array(loss[1] - loss[0])], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    states = found.select("slice", "ids", "sizes", "words", "flat")
    return states.groupBy("slice").cogroup(counted.groupBy("slice")).applyInArrow(scored, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
