"""Substring dedup by recompression: words are named, rounds name runs and pairs, shared symbols reveal repeats.

A name is a 64-bit hash of what it stands for, so every task gives a run or a pair the same name, and an
exchange by name brings a symbol's occurrences together. Work goes from long symbols to short ones:

1. Rounds name runs of equal symbols and pairs, each symbol falling by its own name on the left or the right
   side of pairs, until symbols are about a thousand words long; then one more names the whole text. Equal
   stretches thus have equal symbols inside, wherever they stand. A long symbol (at least a window) that
   occurs more than once reveals a repeat: it is verified by a second hash of all its words, and all
   windows inside each occurrence but the first are gone.
2. What is left are windows across the ends of long symbols and repeats too short to have one. Rounds bounded
   in span change less than MARGIN words at each end of a window, so any window of WINDOW words has
   interior symbols that depend on the window alone. Its anchor is the one of least hash. The windows of
   one anchor form a family, named by all words that they cover; of families with one name all but the
   first are gone.
3. Only where families of different names share an anchor's surroundings, at the ends of repeats, are single
   windows compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.shared import SLICE_BYTES, Scratch, packed, raw_texts, text_slices, trimmed, whole_ids

WINDOW = 20
#: Rounds of long symbols: in every fourth runs are named before pairs. After those in LEVELS, symbols that are new since the level before are looked at.
LONG_ROUNDS, LEVELS = 24, (10, 14, 18, 24)
#: Rounds bounded in span, with the words that a symbol to merge has at most. A run is merged if it has just two symbols.
ROUNDS = (("run", 1), ("pair", 1), ("pair", 1), ("pair", 2))
#: Words at each end of a window that the rounds may name by what stands outside, and words of a symbol.
MARGIN, SPAN = 2 + 1 + 1 + 2, 4
INNER = WINDOW - 2 * MARGIN
assert INNER >= 2 * SPAN - 1
#: A place holds, from its high bits down, 31 of the first window's position, 32 of the number of windows and 1 that is set if they are gone.
ROW = "key long, name long, doc long, place long"

U = np.uint64
FIRST, SECOND, THIRD = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + U(int(FIRST) * (salt + 1) & (1 << 64) - 1)
    x = (x ^ (x >> U(30))) * SECOND
    x = (x ^ (x >> U(27))) * THIRD
    return x ^ (x >> U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and its inverse modulo 2 ** 64, for k from 0 to n."""
    known = _powers.get(base)
    if known is None or len(known[0]) <= n:
        steps = np.full((2, n + n // 4 + 1), [[base], [pow(base, -1, 1 << 64)]], np.uint64)
        steps[:, 0] = 1
        known = _powers[base] = tuple(np.cumprod(steps, axis=1, dtype=np.uint64))
    return known


class Hashes:
    """A hash of any stretch of the words, by prefix sums; with words hashed at random, unequal stretches agree with probability 2 ** -64."""

    def __init__(self, words: np.ndarray, which: int):
        ahead, self.back = powers(BASES[which], len(words))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mixed(words, 100 + which) * ahead[: len(words)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin], 7)


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words, a barrier after each text's, and the place of each text's barrier."""
    from xxhash import xxh3_64_intdigest

    words, ends = [], []
    for text in texts:
        words += text.split()
        ends.append(len(words))
        words.append(b"\n")
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), np.array(ends, np.int64)


def long_symbols(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, at, span), in order of places, of the symbols of WINDOW words or more at each level and of each whole text."""
    names, places = words.copy(), np.arange(len(words))
    barrier = np.zeros(len(words), bool)
    barrier[ends] = True
    new = np.zeros(len(words), bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(1, LONG_ROUNDS + 1):
        if k % 4 == 1:
            start = np.ones(len(names), bool)
            start[1:] = (names[1:] != names[:-1]) | barrier[1:]
            at = np.flatnonzero(start)
            length = np.diff(np.append(at, len(names)))
            names, places, barrier, new = names[at], places[at], barrier[at], new[at]
            run = np.flatnonzero(length > 1)
            names[run] = mixed(names[run] * FIRST + mixed(length[run].astype(np.uint64), 51), 200 + k)
            new[run] = True
        right_side = mixed(names, 300 + k) >> U(63) == 1
        at = np.flatnonzero(~right_side[:-1] & right_side[1:] & ~barrier[:-1] & ~barrier[1:])
        names[at] = mixed(names[at] * FIRST + mixed(names[at + 1], 50), 400 + k)
        new[at] = True
        kept = np.ones(len(names), bool)
        kept[at + 1] = False
        names, places, barrier, new = names[kept], places[kept], barrier[kept], new[kept]
        if k in LEVELS:
            span = np.diff(np.append(places, len(words)))
            here = np.flatnonzero(new & ~barrier & (span >= WINDOW))
            found.append((names[here], places[here], span[here]))
            new[:] = False
    begins = np.concatenate(([0], ends[:-1] + 1))
    inside = np.searchsorted(places, begins)
    nth = np.arange(len(names)) - np.repeat(inside, np.diff(np.append(inside, len(names))))
    whole = mixed(np.add.reduceat(mixed(names * FIRST + nth.astype(np.uint64), 52), inside), 500)
    here = ends - begins >= WINDOW
    found.append((whole[here], begins[here], (ends - begins)[here]))
    key, at, span = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    return key[order], at[order], span[order]


def recompress(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, places, spans) of the symbols after all rounds; barriers stay as they are."""
    names, places = words.copy(), np.arange(len(words))
    spans = np.ones(len(words), np.int8)
    spans[ends] = 100
    for k, (kind, most) in enumerate(ROUNDS):
        if len(names) < 2:
            break
        small = spans <= most
        if kind == "run":
            same = np.zeros(len(names) + 1, bool)
            same[1:-1] = small[1:] & (names[1:] == names[:-1])
            left = same[1:-1] & ~same[:-2] & ~same[2:]
        else:
            right_side = mixed(names, k) >> U(63) == 1
            left = small[:-1] & small[1:] & ~right_side[:-1] & right_side[1:]
        at = np.flatnonzero(left)
        names[at] = mixed(names[at] * FIRST + mixed(names[at + 1], 50), 60 + k)
        spans[at] += spans[at + 1]
        kept = np.ones(len(names), bool)
        kept[at + 1] = False
        names, places, spans = names[kept], places[kept], spans[kept]
    return names, places, spans


def anchors(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, anchor): the places of all windows within a text, and of each one's anchor."""
    n = len(words)
    names, places, spans = recompress(words, ends)
    most, low = U(0xFFFFFFFFFFFFFFFF), U(15)
    rank = np.full(n, most, np.uint64)
    rank[places] = mixed(names, 9) & ~low
    span = np.full(n, 100, np.int8)
    span[places] = spans
    rank[ends] = most
    count = n - WINDOW + 1
    best = np.full(count, most, np.uint64)
    for o in range(INNER):
        # of equal hashes the leftmost is least, by the offset in the low bits
        here = rank if INNER - o >= SPAN else np.where(span <= INNER - o, rank, most)
        np.minimum(best, here[MARGIN + o : MARGIN + o + count] | U(o), out=best)
    last = np.repeat(ends, np.diff(np.concatenate(([-1], ends))))
    window = np.flatnonzero(np.arange(count) + WINDOW <= last[:count])
    return window, window + MARGIN + (best[window] & low).astype(np.int64)


def families(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, name, at, n): the anchor's surroundings, the words covered, the first window and the number of windows of each family."""
    window, anchor = anchors(words, ends)
    if not len(window):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(window) != 1))))
    at, anchor = window[new], anchor[new]
    n = np.diff(np.append(new, len(window)))
    key = Hashes(words, 0)(anchor - MARGIN, anchor + MARGIN)
    name = Hashes(words, 1)(at, at + n - 1 + WINDOW)
    return key, mixed(name + mixed((anchor - at).astype(np.uint64) * U(1 << 20) + n.astype(np.uint64), 11), 12), at, n


def rows(key: np.ndarray, name: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for the first of each (key, name) here, and for those after it a row for each stretch that is gone.

    The arrays are in order of (doc, at). What repeats within a task is thus settled there, and a name that
    many documents have is sent once a task. Stretches that are gone get a key of their own.
    """
    order = np.lexsort((name, key))
    first = np.ones(len(order), bool)
    first[1:] = (key[order[1:]] != key[order[:-1]]) | (name[order[1:]] != name[order[:-1]])
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    gone = (doc != doc[lead]) | (at != at[lead])
    stay, off = np.flatnonzero(~gone), np.flatnonzero(gone)
    begin = np.ones(len(off), bool)
    begin[1:] = (doc[off[1:]] != doc[off[:-1]]) | (at[off[1:]] > at[off[:-1]] + n[off[:-1]])
    begins = np.flatnonzero(begin)
    finish = at[off] + n[off]
    length = np.maximum.reduceat(finish, begins) - at[off[begins]] if len(off) else np.zeros(0, np.int64)
    off = off[begins]
    own = mixed(doc[off].astype(np.uint64) + mixed(at[off].astype(np.uint64)), 13)
    joined = lambda a, b, kind: pa.array(np.concatenate((a, b)).astype(kind))
    return pa.RecordBatch.from_arrays(
        [
            joined(key[stay].view(np.int64), own.view(np.int64), np.int64),
            joined(name[stay].view(np.int64), own.view(np.int64), np.int64),
            joined(doc[stay], doc[off], np.int64),
            joined(at[stay] << 33 | n[stay] << 1, at[off] << 33 | length << 1 | 1, np.int64),
        ],
        names=["key", "name", "doc", "place"],
    )


def at_and_n(place: Column) -> list[Column]:
    return [F.shiftright(place, 33).cast("int").alias("at"), F.shiftright(place, 1).bitwiseAND((1 << 32) - 1).cast("int").alias("n")]


def marked_gone(place: Column) -> Column:
    return place.bitwiseAND(1) == 1


def _sorted(batch: pa.RecordBatch, by: str) -> pa.RecordBatch:
    return batch.take(pa.array(np.argsort(batch.column(by).to_numpy(), kind="stable")))


def squeezed(docs: DataFrame) -> DataFrame:
    """`docs` with `packed`, each text compressed, in place of its last column, text, as what is joined by doc is mostly texts."""
    *others, last = docs.columns
    assert last == "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            raw = batch.column(len(others)).cast(pa.binary()).to_pylist()
            packs = [None if t is None else len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(packs, pa.binary())], names=[*others, "packed"])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields[: len(others)], T.StructField("packed", T.BinaryType())]))


def plain_text(pack: bytes | None) -> bytes | None:
    return None if pack is None else pa.decompress(pack[8:], int.from_bytes(pack[:8], "little"), codec="zstd", asbytes=True)


def unsqueezed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches in order of doc, cut where they are long, with their texts."""
    for batch in text_slices(batches, "packed", SLICE_BYTES // 3):
        batch = _sorted(batch, "doc")
        yield batch, [plain_text(x) or b"" for x in batch.column("packed").to_pylist()]


def symbol_rows(docs: DataFrame) -> DataFrame:
    """The long symbols of the whole texts of (doc, text), their words' second hash as the name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            batch = _sorted(batch, "doc")
            words, ends = word_names(raw_texts(batch))
            if len(words) > WINDOW:
                key, at, span = long_symbols(words, ends)
                text = np.searchsorted(ends, at)
                yield rows(key, Hashes(words, 1)(at, at + span), batch.column("doc").to_numpy()[text], at - np.concatenate(([0], ends + 1))[text], span - WINDOW + 1)

    return docs.mapInArrow(trimmed(run), ROW)


def revealed(found: DataFrame) -> DataFrame:
    """(doc, at, n) of the windows inside long symbols that occurred before; names that several slices have are found by aggregation and joined."""
    gone = marked_gone(F.col("place"))
    stay = found.filter(~gone)
    first = stay.groupBy("key", "name").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("slices")).filter("slices > 1")
    later = stay.join(first, ["key", "name"]).filter(F.struct("doc", "place") > F.col("first"))
    return found.filter(gone).select("doc", "place").unionByName(later.select("doc", "place")).select("doc", *at_and_n(F.col("place")))


def covered(gone: list[list[dict] | None], sizes: np.ndarray, reach: int) -> np.ndarray:
    """For texts of `sizes` places one after another, the places inside their stretches, each taken to go `reach` places beyond its n."""
    off = np.zeros(int(sizes.sum()) + 1, np.int32)
    for base, size, stretches in zip((sizes.cumsum() - sizes).tolist(), sizes.tolist(), gone, strict=True):
        for r in stretches or ():
            off[base + min(r["at"], size)] += 1
            off[base + min(r["at"] + r["n"] + reach, size)] -= 1
    return off.cumsum()[:-1] > 0


def family_rows(docs: DataFrame) -> DataFrame:
    """Families of the whole texts of (doc, packed, gone) but those all of whose windows are `gone`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unsqueezed(batches):
            words, ends = word_names(texts)
            if len(words) < WINDOW:
                continue
            key, name, at, n = families(words, ends)
            # of the barriers none is in a stretch, as its windows end before them
            before = np.concatenate(([0], covered(batch.column("gone").to_pylist(), np.diff(np.concatenate(([-1], ends))), 0).cumsum()))
            left = before[at + n] - before[at] < n
            key, name, at, n = key[left], name[left], at[left], n[left]
            text = np.searchsorted(ends, at)
            yield rows(key, name, batch.column("doc").to_numpy()[text], at - np.concatenate(([0], ends + 1))[text], n)

    return docs.mapInArrow(trimmed(run), ROW)


def window_rows(docs: DataFrame) -> DataFrame:
    """The single windows of the stretches (at, n) in `open` of (doc, packed, open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unsqueezed(batches):
            words, ends = word_names(texts)
            starts = np.concatenate(([0], ends + 1))
            at = [np.unique(np.concatenate([np.arange(r["at"], r["at"] + r["n"]) for r in value])) for value in batch.column("open").to_pylist()]
            sizes = list(map(len, at))
            places = np.concatenate(at) + np.repeat(starts[:-1], sizes)
            fits = places + WINDOW <= np.repeat(ends, sizes)
            doc, at, places = np.repeat(batch.column("doc").to_numpy(), sizes)[fits], np.concatenate(at)[fits], places[fits]
            if len(at):
                yield rows(Hashes(words, 0)(places, places + WINDOW), Hashes(words, 1)(places, places + WINDOW), doc, at, np.ones(len(at), np.int64))

    return docs.mapInArrow(trimmed(run), ROW)


def settled(found: DataFrame) -> DataFrame:
    """(doc, at, n, gone) of the stretches that are gone or, sharing a key with another name, still open."""
    by_name = Window.partitionBy("key", "name").orderBy("doc", "place")
    by_key = Window.partitionBy("key")
    seen = found.select("*", F.rank().over(by_name).alias("nth"), (F.min("name").over(by_key) != F.max("name").over(by_key)).alias("shared"))
    gone = marked_gone(F.col("place")) | (F.col("nth") > 1)
    return seen.filter(gone | F.col("shared")).select("doc", *at_and_n(F.col("place")), gone.alias("gone"))


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with n_words, n_removed and kept (the words left, joined by one space) in place of columns of those names.

    Words are runs without ASCII white space of the whole text, unchanged; a null text has none. A word is
    removed if a window of 20 words over it also starts earlier, in a document of smaller doc_id or earlier
    in its own. Symbols, families and windows are compared by 128 bits of hashes. Rows that share a doc_id are
    one document: none is earlier than the other, and what is removed from one is removed from all at the same
    places. Rows without doc_id take no part and are kept whole. An empty table gives an empty one. Other
    columns are kept whatever their names; a doc_id that is no whole number is refused by a TypeError. A text
    is worked on whole: a task takes about 100 bytes for each word of its longest one.
    """
    whole_ids(docs, "substring dedup")
    scratch = Scratch(spark, "substrings")
    base = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    symbols, symbols_path = scratch.keep(symbol_rows(base))
    repeated, _ = scratch.keep(revealed(symbols))
    scratch.drop(symbols_path)
    # where texts share an id, a place of one isn't one of the other: none of their windows is passed over
    several = base.groupBy("doc").count().filter("count > 1").select("doc")
    sure = stretches(repeated.join(several, "doc", "left_anti"), "gone")
    parted, _ = scratch.keep(settled(family_rows(squeezed(base.select("doc", "text")).join(sure, "doc", "left"))))
    opened = stretches(parted.filter("not gone"), "open")
    windows = settled(window_rows(squeezed(base.select("doc", "text")).join(opened, "doc"))).filter("gone")
    gone = repeated.unionByName(parted.filter("gone").select("doc", "at", "n")).unionByName(windows.select("doc", "at", "n"))
    by_doc = stretches(gone, "gone")
    results = ("n_words", "n_removed", "kept")
    rest = squeezed(docs.select(F.col("doc_id").cast("long").alias("id"), packed(docs, (*results, "text")), "text"))
    cut = _cut(rest.join(by_doc, F.col("id") == F.col("doc"), "left").select("row", "packed", "gone"))
    return cut.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in results], *results)


def stretches(places: DataFrame, name: str) -> DataFrame:
    """(doc, `name`): each document's stretches (at, n) as an array."""
    return places.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias(name))


def _cut(whole: DataFrame) -> DataFrame:
    """(row, text, n_words, n_removed, kept) of (row, packed, gone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "packed", SLICE_BYTES // 3):
            texts, counts, removed, kept = [], [], [], []
            for pack, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = plain_text(pack)
                texts.append(None if raw is None else raw.decode())
                words = (raw or b"").split()
                stays = ~covered([gone], np.array([len(words)]), WINDOW - 1)
                counts.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(stays).tolist()] if removed[-1] else words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "text", "n_words", "n_removed", "kept"])

    fields = T.StructType([whole.schema["row"], T.StructField("text", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")), T.StructField("kept", T.StringType())])
    return whole.mapInArrow(trimmed(run), fields)
