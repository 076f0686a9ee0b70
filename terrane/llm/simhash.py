"""SimHash near-duplicates: an index of deletion variants, equality joins and verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.buckets import BLOCK, Forest, block_pairs, group_starts, whole_groups
from terrane.llm.components import connected_components
from terrane.llm.shared import Scratch, packed, raw_texts, text_slices, trimmed
from terrane.llm.substrings import mixed, word_names

SEED = 42
#: Longs of a wide fingerprint, of which the first two and a half are cut into segments of 16 bits.
LONGS, SEGMENTS, SEGMENT_BITS = 4, 10, 16
#: Standard deviations of a distance beyond that of the similarity that candidates may have, and by which those are nearer that need no comparison of sets.
SLACK, SURE = 3.0, 2.75
#: Pairs that are joined before those that are joined by then are left out of the next.
CHUNK = 1 << 14
#: Shingles of a group that one block holds, and those that a set counts as besides its own.
SET_BLOCK, SET_WEIGHT = 1 << 18, 64
#: Sets beyond which a shingle that they share is counted by a product of matrices, of so many rows and columns at a time.
COMMON, STRIP, COLUMNS = 16, 256, 512
LONG_NAMES = tuple(f"f{k}" for k in range(LONGS))


def simhash(text: bytes, size: int = 4) -> int:
    """The 64-bit fingerprint of a text: bit k is 1 if over half the hashes of its shingles have it.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are `size` words joined by one
    space, repeats included; fewer words are one shingle, no words give 0.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= size:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp) of each whole text, fp being the fingerprint as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = np.array([simhash(t, size) for t in raw_texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def variants(classes: DataFrame, most: int) -> DataFrame:
    """(bucket, fp, rep) for each fingerprint and each of its 64 bits as the wildcard of its segment.

    Fingerprints at most `most` bits apart differ by at most one bit in one of most // 2 + 1 segments, and
    so agree in that segment's variant whose wildcard is that bit.
    """
    segments = most // 2 + 1
    cuts = [64 * k // segments for k in range(segments + 1)]
    offset, width = F.lit(0), F.lit(cuts[1])
    for k in range(1, segments):
        offset = F.when(F.col("wild") >= cuts[k], cuts[k]).otherwise(offset)
        width = F.when(F.col("wild") >= cuts[k], cuts[k + 1] - cuts[k]).otherwise(width)
    # a table of few files is dealt out first, as each row becomes 64
    dealt = classes.select("fp", "rep").repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = dealt.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("wild")).withColumn("off", offset).withColumn("wide", width)
    mask = "if(wide = 64, -1L, shiftleft(1L, wide) - 1L)"
    kept = f"shiftrightunsigned(fp, off) & {mask} & ~shiftleft(1L, wild - off)"
    return spread.select(F.expr(f"xxhash64({kept}, wild)" if segments < 2 else f"shiftleft({kept}, 6) | wild").alias("bucket"), "fp", "rep")


def links(classes: DataFrame, scratch: Scratch, most: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) between representatives that join, in every bucket, all fingerprints linked there.

    `classes` has (fp, rep), a row for each distinct fingerprint. Within a bucket a spanning forest of the
    links at `most` bits or fewer is given, not all pairs; together they have the components of all links.
    """
    paired = block_pairs(variants(classes, most), "bucket", F.xxhash64("fp"), scratch, block)
    ordered = paired.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "i", "j"]):
            a, b = _forest(table, most)
            reps = table.column("rep").combine_chunks()
            yield pa.RecordBatch.from_arrays([reps.take(pa.array(a, pa.int64())), reps.take(pa.array(b, pa.int64()))], names=["src", "dst"])

    return ordered.mapInArrow(trimmed(run), f"src {kind}, dst {kind}").distinct()


def _forest(table: pa.Table, most: int) -> tuple[list[int], list[int]]:
    """Positions of a spanning forest of the links at `most` bits or fewer in each group."""
    n = table.num_rows
    fp, side = table.column("fp").to_numpy().view(np.uint64), table.column("side").to_numpy()
    alike = table.column("i").to_numpy() == table.column("j").to_numpy()
    starts = group_starts(table, ["bucket", "i", "j"])
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    at = np.arange(n)
    forest, first, second = Forest(n), [], []
    step = 1
    while len(at := at[at + step < ends[at]]):
        other = at + step
        near = (np.bitwise_count(fp[at] ^ fp[other]) <= most) & (alike[at] | (side[at] != side[other]))
        for a, b in zip(at[near].tolist(), other[near].tolist(), strict=True):
            if forest.join(a, b):
                first.append(a)
                second.append(b)
        step += 1
    return first, second


def _sure_forest(table: pa.Table, sure: int, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a spanning forest of the pairs at `far` bits or fewer in each group, and which are at `sure` or fewer.

    Those are joined before the others, so what they connect in a group the forest's connect too; among equals the pairs
    of the least representatives, so that the forests of many buckets have edges in common.
    """
    n = table.num_rows
    starts = group_starts(table, ["bucket", "i", "j"])
    counts = np.diff(np.append(starts, n))
    ends = np.repeat(starts + counts, counts)
    # in order of representatives, a pair's places are its rank
    order = np.lexsort((table.column("rep").to_numpy(), np.repeat(np.arange(len(starts)), counts)))
    longs = [table.column(name).to_numpy().view(np.uint64)[order] for name in LONG_NAMES]
    side, alike = table.column("side").to_numpy()[order], table.column("i").to_numpy() == table.column("j").to_numpy()
    width, at, step, held = n.bit_length(), np.arange(n), 1, []
    while len(at := at[at + step < ends[at]]):
        other = at + step
        bits = np.zeros(len(at), np.int64)
        for own in longs:
            bits += np.bitwise_count(own[at] ^ own[other])
        near = (bits <= far) & (alike[at] | (side[at] != side[other]))
        if near.any():
            # one long a pair: whether it is not sure, then the lesser place, then the other
            held.append(((bits[near] > sure).astype(np.int64) << 2 * width) | (at[near] << width) | other[near])
        step += 1
    pairs = np.concatenate([np.zeros(0, np.int64), *held])
    held.clear()
    pairs.sort()
    low = (1 << width) - 1
    pairs = pairs[joining(Forest(n), pairs >> width & low, pairs & low)]
    return order[pairs >> width & low], order[pairs & low], pairs >> 2 * width == 0


def joining(forest: Forest, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of positions, joined one after another, join what was apart."""
    found = []
    for begin in range(0, len(a), CHUNK):
        up = np.array(forest.up)
        while not np.array_equal(higher := up[up], up):
            up = higher
        apart_yet = begin + np.flatnonzero(up[a[begin : begin + CHUNK]] != up[b[begin : begin + CHUNK]])
        found += [k for k, x, y in zip(apart_yet.tolist(), a[apart_yet].tolist(), b[apart_yet].tolist(), strict=True) if forest.join(x, y)]
    return np.array(found, np.int64)


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 4, most: int = 4, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the smallest doc_id reachable by links.

    Fingerprints link at `most` or fewer differing bits; texts without words all have fingerprint 0 and
    link like any others. Equal fingerprints are one class, stood for by its smallest doc_id, so copies
    are never paired. Repeated rows and ids are kept; a class whose ids are all null has a null component
    id. An empty table gives an empty one; other columns are left out. A text is worked on whole: a task takes about 30 bytes
    for each byte of its longest one.
    """
    scratch = Scratch(spark, "simhash")
    found, _ = scratch.keep(fingerprints(docs, size))
    classes, _ = scratch.keep(found.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(spark, links(classes.filter("rep is not null"), scratch, most, block))
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """The distinct shingles of `size` lower-cased words of each text, as sorted hashes; fewer words are one shingle, none are none."""
    words, ends = word_names([t.lower() for t in texts])
    begins = np.concatenate(([0], ends[:-1] + 1))
    count = max(0, len(words) - size + 1)
    shingles = np.zeros(count, np.uint64)
    for k in range(size):
        shingles += mixed(words[k : k + count], 20 + k)
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        if end - begin >= size:
            yield np.unique(shingles[begin : end - size + 1])
        else:
            yield np.array([sum(int(mixed(words[begin + j : begin + j + 1], 20 + j)[0]) for j in range(end - begin)) & (1 << 64) - 1] * (end > begin), np.uint64)


def wide_simhash(texts: list[bytes], size: int = 5) -> np.ndarray:
    """LONGS longs of each text: bit k is 1 if over half its shingles (see shingle_sets) have it; none give 0."""
    out = np.zeros((len(texts), LONGS), np.uint64)
    for k, own in enumerate(shingle_sets(texts, size)):
        if not len(own):
            continue
        ones = np.zeros(64 * LONGS, np.int64)
        for first in range(0, len(own), 1 << 14):
            longs = np.stack([mixed(own[first : first + (1 << 14)], 40 + j) for j in range(LONGS)], axis=1)
            ones += np.unpackbits(longs.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)
    return out


def wide_fingerprints(docs: DataFrame, size: int = 5) -> DataFrame:
    """(uid, doc_id, hash, f0, f1, ...) of each row: its own number, the hash of its text and the fingerprint of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = wide_simhash(raw_texts(batch), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(LONGS))], names=["uid", "doc_id", "hash", *LONG_NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(trimmed(run), f"uid long, doc_id {kind}, hash long, " + ", ".join(f"{n} long" for n in LONG_NAMES))


def far_bits(similarity: float, bits: int, slack: float = 0.0) -> float:
    """Bits in which fingerprints of sets of that Jaccard similarity differ on average, those of the angle between the sets, and `slack` standard deviations more."""
    mean = bits * math.acos(2 * similarity / (1 + similarity)) / math.pi
    return mean + slack * math.sqrt(mean * (1 - mean / bits))


def wide_variants(classes: DataFrame) -> DataFrame:
    """(bucket, f0, f1, ..., rep): each class under each one-wildcard variant of each of its segments."""
    wild = F.col("wild")
    dealt = classes.select(*LONG_NAMES, "rep").repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = dealt.select(*LONG_NAMES, "rep", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * SEGMENT_BITS - 1))).alias("wild"))
    long, bit = F.when(wild < 64, F.col("f0")).when(wild < 128, F.col("f1")).otherwise(F.col("f2")), F.pmod(wild, F.lit(64))
    spread = spread.select(*LONG_NAMES, "rep", "wild", long.alias("own"), (F.floor(bit / SEGMENT_BITS) * SEGMENT_BITS).cast("int").alias("off"), bit.cast("int").alias("bit"))
    kept = f"shiftrightunsigned(own & ~shiftleft(1L, bit), off) & {(1 << SEGMENT_BITS) - 1}L"
    return spread.select(F.expr(f"shiftleft({kept}, 8) | wild").alias("bucket"), *LONG_NAMES, "rep")


def candidate_edges(classes: DataFrame, scratch: Scratch, similarity: float, block: int = BLOCK) -> DataFrame:
    """(src, dst, sure) of candidates that agree in a segment but for one bit and whose whole fingerprints may be those of sets of `similarity`.

    Of each bucket a forest of all its candidates, first of those whose fingerprints are near enough to be sure.
    """
    paired = block_pairs(wide_variants(classes), "bucket", F.xxhash64(*LONG_NAMES), scratch, block)
    ordered = paired.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    sure, far = round(far_bits(similarity, 64 * LONGS, -SURE)), round(far_bits(similarity, 64 * LONGS, SLACK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "i", "j"]):
            a, b, is_sure = _sure_forest(table, sure, far)
            reps = table.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(reps[a], reps[b])), pa.array(np.maximum(reps[a], reps[b])), pa.array(is_sure)], names=["src", "dst", "sure"])

    return ordered.mapInArrow(trimmed(run), "src long, dst long, sure boolean").distinct()


def class_sets(classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(rep, n, shingles): the distinct shingles of each class's text and their number."""
    named = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), "text")
    rows = named.join(classes.select("rep", "doc_id", "hash"), (F.col("id") == F.col("doc_id")) & (F.col("own") == F.col("hash"))).select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = list(shingle_sets(raw_texts(batch), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "n", "shingles"])

    return rows.mapInArrow(trimmed(run), "rep long, n long, shingles binary").groupBy("rep").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def set_edges(sets: DataFrame, scratch: Scratch, similarity: float, block: int = SET_BLOCK) -> DataFrame:
    """(src, dst) that join, in every group, all parts with sets of a Jaccard similarity of `similarity` or more.

    `sets` has (rep, group, part, n, shingles). All sets of a group that are of different parts are compared, in pairs of
    blocks of some `block` shingles; of each pair of blocks a forest is given, not all links.
    """
    weighed = sets.withColumn("weight", F.col("n") + SET_WEIGHT).drop("n")
    paired = block_pairs(weighed, "group", F.xxhash64("rep"), scratch, block, "weight")
    ordered = paired.select("group", "i", "j", "side", "rep", "part", "shingles").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["group", "i", "j"]):
            src, dst = [], []
            starts = group_starts(table, ["group", "i", "j"])
            for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                rows = table.slice(begin, end - begin)
                part, reps = rows.column("part").to_numpy(), rows.column("rep").to_numpy()
                if (part == part[0]).all():
                    continue
                side = rows.column("side").to_numpy() if rows.column("i")[0] != rows.column("j")[0] else None
                a, b = _set_forest([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")], part, side, similarity)
                src.append(reps[a])
                dst.append(reps[b])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return ordered.mapInArrow(trimmed(run), "src long, dst long")


def _set_forest(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a forest of the links between different parts, and different sides if there are any, that joins the parts."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    row, name = np.repeat(np.arange(n), sizes), np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    shares = np.bincount(name)
    common = shares[name] > COMMON
    rare, rare_name = row[~common], name[~common]
    row, column = row[common], (np.cumsum(shares > COMMON) - 1)[name[common]]
    columns = int(column[-1]) + 1 if len(column) else 0
    # rows of one part are one from the start
    forest, of_part = Forest(n), np.argsort(part, kind="stable")
    joining(forest, of_part[:-1][same := part[of_part[1:]] == part[of_part[:-1]]], of_part[1:][same])
    first, second = [], []
    for begin in range(0, n, STRIP):
        end = min(begin + STRIP, n)
        shared = np.zeros((end - begin, n), np.float32)
        for left in range(0, columns, COLUMNS):
            lo, hi = np.searchsorted(column, (left, left + COLUMNS))
            dense = np.zeros((n, COLUMNS), np.float32)
            dense[row[lo:hi], column[lo:hi] - left] = 1
            shared += dense[begin:end] @ dense.T
        for step in range(1, COMMON):
            same = rare_name[step:] == rare_name[:-step]
            if not same.any():
                break
            a, b = rare[:-step][same], rare[step:][same]
            own = (a >= begin) & (a < end)
            np.add.at(shared, (a[own] - begin, b[own]), 1)
        union = sizes[begin:end, None] + sizes - shared.astype(np.float64)
        near = (shared >= similarity * union - 1e-9) & (part[begin:end, None] != part) & (np.arange(begin, end)[:, None] < np.arange(n))
        if side is not None:
            near &= side[begin:end, None] != side
        a, b = np.nonzero(near)
        found = joining(forest, a + begin, b)
        first.append(a[found] + begin)
        second.append(b[found])
    return np.concatenate(first), np.concatenate(second)


def parted(spark: SparkSession, edges: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, part): the component of each class."""
    parts = connected_components(spark, edges.select("src", "dst"))
    return reps.join(parts, reps["rep"] == parts["node"], "left").select("rep", F.coalesce("component", "rep").alias("part"))


def similar_groups(spark: SparkSession, docs: DataFrame, size: int = 5, similarity: float = 0.8, block: int = BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """(doc_id, hash, part, first_id, first_hash) of each row with a doc_id: its group of similar texts, and the row of least doc_id that stands for it.

    Equal fingerprints are one class. Of each bucket a forest of candidates is taken, so hot groups never make pairs.
    Those SURE standard deviations nearer than sets at `similarity` are links by their fingerprints and make parts. Where
    all candidates connect more than one part, all classes of those parts are compared by their sets of shingles, each with
    each of another part, so a forest passes over no link and none is left out. A link is lost only if no segment agrees
    and no chain of candidates leads from one end to the other.
    """
    scratch = Scratch(spark, "similar")
    docs = docs.filter("doc_id is not null")
    found, _ = scratch.keep(wide_fingerprints(docs, size))
    classes = found.groupBy(*LONG_NAMES).agg(F.min(F.struct("doc_id", "uid", "hash")).alias("first"))
    classes, _ = scratch.keep(classes.select(*LONG_NAMES, F.col("first.uid").alias("rep"), "first.doc_id", "first.hash"))
    edges, _ = scratch.keep(candidate_edges(classes, scratch, similarity, block))
    links = edges.filter("sure").select("src", "dst")
    parts = parted(spark, links, classes.select("rep"))
    chained = connected_components(spark, edges.select("src", "dst"))
    placed, _ = scratch.keep(chained.join(parts, F.col("node") == F.col("rep")).select("rep", "part", F.col("component").alias("group")))
    open_ = placed.groupBy("group").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least <> most").select("group")
    left, _ = scratch.keep(classes.join(placed.join(open_, "group", "left_semi"), "rep").select("rep", "doc_id", "hash", "group", "part"))
    sets, _ = scratch.keep(class_sets(left, docs, size).join(left.select("rep", "group", "part"), "rep"))
    compared, _ = scratch.keep(set_edges(sets, scratch, similarity, set_block))
    parts = parted(spark, links.unionByName(compared), classes.select("rep"))
    named = classes.join(parts, "rep").select(*LONG_NAMES, "part")
    rows, _ = scratch.keep(found.join(named, list(LONG_NAMES)).select("uid", "doc_id", "hash", "part"))
    first = rows.groupBy("part").agg(F.min(F.struct("doc_id", "uid", "hash")).alias("first"))
    return rows.join(first, "part").select("doc_id", "hash", "part", F.col("first.doc_id").alias("first_id"), F.col("first.hash").alias("first_hash"))


def similar(spark: SparkSession, docs: DataFrame, size: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of each row, linking texts whose sets of `size`-word shingles have a Jaccard similarity of `similarity` or more.

    Candidates agree, but for one bit, in one of SEGMENTS segments of SEGMENT_BITS bits of a fingerprint of 256: at 0.8
    about 96 % of pairs do, at 0.9 over 99.9 %. Links are verified by whole sets, or by fingerprints that are nearer
    than those of sets at 0.9 (see similar_groups). Rows without doc_id link with nothing and have no component.
    """
    found = similar_groups(spark, docs, size, similarity, block).select("doc_id", F.col("first_id").alias("component_id"))
    return found.unionByName(docs.filter("doc_id is null").select("doc_id", F.col("doc_id").alias("component_id")))


def one_of_each(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with their columns, that stand for those similar to them: of each group the one of least doc_id.

    Rows of one doc_id whose texts are unlike all stay; those that are alike are one group as any others. Rows without
    doc_id all stay. Null and empty texts are alike. Columns of any names are kept.
    """
    found = similar_groups(spark, docs, **options)
    stay = found.select(F.col("first_id").alias("stay_id"), F.col("first_hash").alias("stay_hash")).distinct()
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), packed(docs))
    kept = rows.join(stay, (F.col("id") == F.col("stay_id")) & (F.col("own") == F.col("stay_hash")), "left_semi")
    once = kept.groupBy("id", "own").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(docs.filter("doc_id is null"))


def hex_fingerprint(fp: str = "fp"):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
