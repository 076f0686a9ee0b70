"""Benchmark decontamination by winnowing: the least k-gram hash of each sliding window, joined and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.shared import Scratch, raw_texts, text_slices, trimmed
from terrane.llm.substrings import FIRST, mixed
from terrane.llm.terms import passes, sieve, words

#: Words of a window, and of the k-grams whose least hash is its fingerprint.
WINDOW, GRAM = 10, 5
#: Windows of a stretch at most.
STRETCH = 1024

U = np.uint64
STEPS = tuple(U(x) for x in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5))


def inside(ends: np.ndarray, count: int, size: int) -> np.ndarray:
    """Which of `count` words begin `size` words of one text."""
    fits = np.zeros(count, bool)
    fits[: max(0, count - size + 1)] = True
    for k in range(1, size):
        over = ends - k
        fits[over[over >= 0]] = False
    # the words before a short text's end may be another text's, whose own end is nearer
    return fits


def fingerprints(hashes: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Of each `size` words in a row the least hash of their k-grams; windows of other sizes have other ones."""
    gram = min(gram, size)
    count = len(hashes) - size + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * STEPS[0] + hashes[k : k + len(grams)]
    grams = mixed(grams, 80 + size)
    least = grams[:count].copy()
    for k in range(1, size - gram + 1):
        np.minimum(least, grams[k : k + count], out=least)
    return mixed(least, 81)


def names(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the `size` words from each place on."""
    out = []
    for lane, step in enumerate(STEPS):
        sums = np.full(len(at), U(size))
        for k in range(size):
            sums = sums * step + mixed(hashes[at + k], 82 + lane)
        out.append(mixed(sums, 84 + lane))
    return out[0], out[1]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def item_windows(items: DataFrame, size: int, gram: int) -> DataFrame:
    """(item, size, mark, x, y): each item's windows, their fingerprints and names; an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, ends = words(raw_texts(batch))
            lengths = np.diff(ends, prepend=0)
            for own in np.unique(np.minimum(lengths, size)).tolist():
                if not own:
                    continue
                alike = np.repeat(np.minimum(lengths, size) == own, lengths)
                at = np.flatnonzero(inside(ends, len(hashes), own) & alike)
                x, y = names(hashes, at, own)
                item = batch.column(0).take(pa.array(np.searchsorted(ends, at, "right")))
                yield pa.RecordBatch.from_arrays([item, pa.array(np.full(len(at), own, np.int32)), signed(fingerprints(hashes, own, gram)[at]), signed(x), signed(y)], names=["item", "size", "mark", "x", "y"])

    return items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(trimmed(run), "item string, size int, mark long, x long, y long")


def stretches(hashes: np.ndarray, ends: np.ndarray, size: int, gram: int, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, count, x, y): stretches of windows one word apart whose fingerprints pass the sieve, and the names of all their windows in a row."""
    marks = fingerprints(hashes, size, gram)
    met = np.flatnonzero(passes(bits, marks))
    met = met[inside(ends, len(hashes), size)[met]]
    if not len(met):
        return met, met, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # a window of the next text is never one word after the last of a text, unless windows are single words
    new = np.concatenate(([True], np.diff(met) != 1)) | np.isin(met, ends)
    start = np.flatnonzero(new)
    nth = np.arange(len(met)) - np.repeat(start, np.diff(np.append(start, len(met))))
    start = np.flatnonzero(nth % STRETCH == 0)
    x, y = names(hashes, met, size)
    return met[start], np.diff(np.append(start, len(met))), x, y


def document_stretches(docs: DataFrame, sizes: list[int], gram: int, bits) -> DataFrame:
    """(doc_id, row, n_words, met, content): each text's stretches (size, at, a, b), by name, and the windows of those that its slice of texts hasn't named before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, ends = words(raw_texts(batch))
            begins = np.concatenate(([0], ends[:-1]))
            parts = []
            for size in sizes:
                first, count, x, y = stretches(hashes, ends, size, gram, bits.value)
                if len(first):
                    at = np.concatenate(([0], count.cumsum()[:-1]))
                    nth = (np.arange(len(x)) - np.repeat(at, count)).astype(np.uint64)
                    a, b = (mixed(np.add.reduceat(mixed(v ^ mixed(nth, 86)), at) + U(size), 87) for v in (x, y))
                    new = np.zeros(len(a), bool)
                    new[np.unique(np.stack([a, b]), axis=1, return_index=True)[1]] = True
                    parts.append((first, np.full(len(first), size, np.int32), a, b, new, count, x, y))
            yield _packed(batch, ends - begins, ends, begins, parts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, n_words long, met array<struct<size:int,at:long,a:long,b:long>>, content array<struct<size:int,a:long,b:long,windows:array<struct<x:long,y:long>>>>"
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(trimmed(run), schema)


def _packed(batch: pa.RecordBatch, counts: np.ndarray, ends: np.ndarray, begins: np.ndarray, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    def offsets(sizes: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate(([0], sizes.cumsum())).astype(np.int32))

    none = np.zeros(0, np.int64)
    first, size, a, b, new, count = (np.concatenate([p[k] for p in parts]) if parts else none.astype(kind) for k, kind in enumerate(("i8", "i4", "u8", "u8", bool, "i8")))
    x, y = (np.concatenate([p[k] for p in parts]) if parts else none.view(np.uint64) for k in (6, 7))
    starts = count.cumsum() - count
    doc = np.searchsorted(ends, first, "right")
    order = np.argsort(doc, kind="stable")
    at = (first - begins[doc])[order] if len(first) else none
    met = pa.StructArray.from_arrays([pa.array(size[order].astype(np.int32)), pa.array(at), signed(a[order]), signed(b[order])], names=["size", "at", "a", "b"])
    met = pa.ListArray.from_arrays(offsets(np.bincount(doc, minlength=len(batch))), met)
    held = order[new[order]]
    inner = np.repeat(starts[held] - (count[held].cumsum() - count[held]), count[held]) + np.arange(int(count[held].sum()))
    windows = pa.ListArray.from_arrays(offsets(count[held]), pa.StructArray.from_arrays([signed(x[inner]), signed(y[inner])], names=["x", "y"]))
    content = pa.StructArray.from_arrays([pa.array(size[held].astype(np.int32)), signed(a[held]), signed(b[held]), windows], names=["size", "a", "b", "windows"])
    content = pa.ListArray.from_arrays(offsets(np.bincount(doc[held], minlength=len(batch))), content)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), met, content], names=["doc_id", "row", "n_words", "met", "content"])


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated) of each row of `docs` (doc_id, text), against `items` (item_id, text).

    Words are longest runs of a-z (A-Z lower-cased), 0-9 and characters beyond ASCII of whole texts. A window is
    `size` consecutive words of an item, or all words of one that has fewer; n_hit counts the words inside any
    occurrence of a window, `spans` has the places (begin, end) of those, in order, and `items` the item_ids, as
    text in order, whose windows occur.

    A window's fingerprint is the least hash of its k-grams of `gram` words, so `size` words that a text shares
    with an item always meet by a fingerprint. Fingerprints of items make a sieve of 8 MB; windows of
    documents whose fingerprints pass it go in stretches, each distinct one once, to an equality join with
    the items' windows, which extends a shared fingerprint to all words by 128 bits of hashes: two unequal
    windows among n pass for one with probability about n ** 2 / 2 ** 129. The join gives a row for each
    window of a distinct stretch and one for each stretch of a document, never pairs.

    Null and empty texts have no words and no windows. Items without item_id hit words but are not listed; items
    that share one are one. Repeated rows and ids of documents are kept, each judged alone; empty tables
    give empty results or no hits; other columns are left out. A text is worked on whole: a task takes about
    20 bytes for each byte of its longest one.
    """
    scratch = Scratch(spark, "winnowing")
    windows, _ = scratch.keep(item_windows(items, size, gram))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    bits = spark.sparkContext.broadcast(sieve(windows.select("mark")))
    found, _ = scratch.keep(document_stretches(docs, sizes, gram, bits))
    content = found.select(F.explode("content").alias("c")).select("c.*").groupBy("a", "b").agg(F.first("size").alias("size"), F.first("windows").alias("windows"))
    looked = content.select("a", "b", "size", F.posexplode("windows").alias("at", "w")).select("a", "b", "size", "at", "w.x", "w.y")
    named = windows.groupBy("x", "y").agg(F.sort_array(F.collect_set("item")).alias("items"))
    each = looked.join(named, ["x", "y"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("long").alias("begin"), (F.col("at") + F.col("size")).cast("long").alias("end")))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    each = each.select("a", "b", _joined("spans").alias("spans"), "items")
    met = found.select("row", F.explode("met").alias("m")).select("row", "m.at", "m.a", "m.b").join(each, ["a", "b"])
    moved = F.transform("spans", lambda s: F.struct((s["begin"] + F.col("at")).alias("begin"), (s["end"] + F.col("at")).alias("end")))
    by_row = met.select("row", moved.alias("spans"), "items").groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    by_row = by_row.select("row", "spans", "items", _length("spans").alias("n_hit"))
    out = found.select("doc_id", "row", "n_words").join(by_row, "row", "left")
    none = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", none.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans"), (none > 0).alias("contaminated"))


def _joined(spans: str) -> Column:
    """The spans of an array in order, those that touch made one."""
    return F.expr(f"""aggregate({spans}, cast(array() as array<struct<begin:bigint,end:bigint>>), (found, s) ->
        if(size(found) > 0 and element_at(found, -1).end >= s.begin,
           concat(slice(found, 1, size(found) - 1), array(named_struct('begin', element_at(found, -1).begin, 'end', greatest(element_at(found, -1).end, s.end)))),
           concat(found, array(s))))""")


def _length(spans: str) -> Column:
    """The number of places in the spans of an array in order."""
    return F.expr(f"""aggregate({spans}, named_struct('reach', 0L, 'total', 0L), (sum, s) ->
        named_struct('reach', greatest(sum.reach, s.end), 'total', sum.total + greatest(0L, s.end - greatest(sum.reach, s.begin))), sum -> sum.total)""")
