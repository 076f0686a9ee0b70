"""Ranked lexical search: tiles of item weights times tiles of document impacts, exact in float64."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm.shared import Scratch, raw_texts, text_slices, trimmed, whole_ids
from terrane.llm.terms import Tops, passes, sieve, words

#: Items, and terms of items with repeats between them, of a block; one item's terms are never parted.
BLOCK_ITEMS, BLOCK_TERMS = 256, 1 << 17
#: Terms and documents of a tile of impacts.
TILE_TERMS, TILE_DOCS = 2048, 512
#: No impact is larger: 10 ** 9 * tf // (1000 * tf + 20 * m).
MOST_IMPACT = 1_000_000
#: Whole numbers below this are exact in float64, sums of them in any order too.
EXACT = 1 << 53
#: Tiles of documents in a group, which meets each block of items once.
GROUP_TILES = 32


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term): the distinct terms of each row of items, which has the number `item`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, ends = words(raw_texts(batch))
            item = np.searchsorted(ends, np.arange(len(hashes)), "right")
            pair = np.unique(np.stack([item.astype(np.uint64), hashes], axis=1), axis=0) if len(hashes) else np.zeros((0, 2), np.uint64)
            at = pa.array(pair[:, 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64))], names=["item", "item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(trimmed(run), f"item long, item_id {kind}, term long")


def document_tiles(docs: DataFrame, bits) -> DataFrame:
    """A row for each slice of documents: their ids and numbers of terms, and, in order of documents, the terms that pass the sieve with their counts. Documents without a term are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, ends = words(raw_texts(batch))
            counts = np.diff(ends, prepend=0)
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            kept = passes(bits.value, hashes)
            doc, term = np.repeat(np.arange(len(some)), counts[some])[kept], hashes[kept]
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))) if len(doc) else np.zeros(0, bool))
            tf = np.diff(np.append(first, len(doc)))
            sizes = np.bincount(doc[first], minlength=len(some))
            ids = batch.column(0).take(pa.array(some)).cast(pa.int64())
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            row = [lists, *(pa.array([x.tobytes()], pa.binary()) for x in (counts[some], sizes, term[first]))]
            row += [pa.array([pa.compress(tf.astype("<u4").tobytes(), codec="zstd", asbytes=True)], pa.binary()), pa.array([len(some)], pa.int64()), pa.array([int(counts.sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays(row, names=["ids", "counts", "sizes", "terms", "tf", "n_docs", "n_terms"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "ids array<long>, counts binary, sizes binary, terms binary, tf binary, n_docs long, n_terms long")


def document_frequencies(tiles: DataFrame) -> DataFrame:
    """(term, df): the documents that hold each term of the tiles; a tile sends each of its terms once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                term, n = np.unique(np.frombuffer(raw, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "df"])

    return tiles.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def blocks(weighted: DataFrame, n_docs: int, pairs: int) -> DataFrame:
    """(block, items, item_ids, at, terms, weights): items in blocks of bounded size, their terms with weights as triples."""
    kind = weighted.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held is not None:
                item = held.column("item").to_numpy()
                starts = np.flatnonzero(np.diff(item, prepend=-1))
                # the last item may go on in the next batch
                cut = max((int(e) for e in starts[1 : BLOCK_ITEMS + 1] if e <= BLOCK_TERMS), default=int(starts[1]) if len(starts) > 1 else 0)
                if not cut or (len(starts) <= BLOCK_ITEMS and held.num_rows <= BLOCK_TERMS):
                    break
                yield packed(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield packed(held)

    def packed(table: pa.Table) -> pa.RecordBatch:
        item = table.column("item").to_numpy()
        first = np.flatnonzero(np.diff(item, prepend=-1))
        at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(item))))
        known: dict[int, int] = {}
        w = np.fromiter((known[d] if d in known else known.setdefault(d, weight(n_docs, d)) for d in table.column("df").to_pylist()), np.int64, len(item))
        ids = table.column("item_id").combine_chunks().take(pa.array(first))
        ends = pa.array([0, len(first)], pa.int32())
        row = [pa.array([int(item[0])]), pa.ListArray.from_arrays(ends, pa.array(item[first])), pa.ListArray.from_arrays(ends, ids)]
        row += [pa.array([x.tobytes()], pa.binary()) for x in (at, table.column("term").to_numpy(), w)]
        return pa.RecordBatch.from_arrays(row, names=["block", "items", "item_ids", "at", "terms", "weights"])

    dealt = weighted.repartition(max(1, math.ceil(pairs / (16 * BLOCK_TERMS))), "item").sortWithinPartitions("item")
    return dealt.mapInArrow(run, f"block long, items array<long>, item_ids array<{kind}>, at binary, terms binary, weights binary")


def impacts(counts: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of each term of documents (`doc` places it there), before weights."""
    m = np.array([100 - 50 + (50 * n * n_docs) // n_terms for n in counts.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])


def tile_scores(n_items: int, n_docs: int, at: np.ndarray, vocabulary: np.ndarray, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int = TILE_TERMS) -> np.ndarray:
    """Exact scores (items, documents) of triples (at, vocabulary, weights) with triples (doc, term, impact).

    Only terms that both have get a place. `terms` of them at a time make dense tiles, fewer where a row's sum
    could pass 2 ** 53, and each product is added to whole numbers.
    """
    out = np.zeros((n_items, n_docs), np.int64)
    both = np.intersect1d(vocabulary, term)
    if not len(both):
        return out
    mine, theirs = np.searchsorted(both, vocabulary), np.searchsorted(both, term)
    ok = both[np.minimum(mine, len(both) - 1)] == vocabulary
    at, mine, weights = at[ok], mine[ok], weights[ok]
    ok = both[np.minimum(theirs, len(both) - 1)] == term
    doc, theirs, impact = doc[ok], theirs[ok], impact[ok]
    terms = max(1, min(terms, (EXACT - 1) // max(1, int(weights.max()) * MOST_IMPACT)))
    by_mine, by_theirs = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
    at, mine, weights = at[by_mine], mine[by_mine], weights[by_mine]
    doc, theirs, impact = doc[by_theirs], theirs[by_theirs], impact[by_theirs]
    for k in range(0, len(both), terms):
        width = min(terms, len(both) - k)
        a, b = np.searchsorted(mine, (k, k + width))
        left = np.zeros((n_items, width))
        left[at[a:b], mine[a:b] - k] = weights[a:b]
        a, b = np.searchsorted(theirs, (k, k + width))
        right = np.zeros((width, n_docs))
        right[theirs[a:b] - k, doc[a:b]] = impact[a:b]
        out += (left @ right).astype(np.int64)
    return out


def met(pairs: DataFrame, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """(item, item_id, doc_id, score): of each item the first `k` documents of every partition of pairs of tiles and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, item_ids = Tops(k), {}

        def given(key: np.ndarray, score: np.ndarray, order: np.ndarray, absent: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
            ids = pa.array([item_ids[x] for x in key.tolist()], item_kind)
            return pa.RecordBatch.from_arrays([pa.array(key), ids, pa.array(order, mask=absent), pa.array(score)], names=["item", "item_id", "doc_id", "score"])

        for batch in batches:
            item_kind = batch.schema.field("item_ids").type.value_type
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                items = one["items"].values.to_numpy()
                item_ids.update(zip(items.tolist(), one["item_ids"].as_py(), strict=True))
                raw = {name: one[name].as_py() for name in ("counts", "sizes", "terms", "tf", "at", "item_terms", "weights")}
                counts, sizes, term, at, vocabulary, weights = (np.frombuffer(raw[name], np.int64) for name in ("counts", "sizes", "terms", "at", "item_terms", "weights"))
                tf = np.frombuffer(pa.decompress(raw["tf"], 4 * len(term), codec="zstd", asbytes=True), "<u4").astype(np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                impact = impacts(counts, doc, tf, n_docs, n_terms)
                order = one["ids"].values
                absent, order = order.is_null().to_numpy(zero_copy_only=False), order.fill_null(0).to_numpy()
                cuts = sizes.cumsum()
                for begin in range(0, len(sizes), TILE_DOCS):
                    end = min(begin + TILE_DOCS, len(sizes))
                    a, b = (int(cuts[begin - 1]) if begin else 0), int(cuts[end - 1])
                    scores = tile_scores(len(items), end - begin, at, vocabulary, weights, doc[a:b] - begin, term[a:b], impact[a:b])
                    x, y = np.nonzero(scores >= np.maximum(tops.floors(items), 1)[:, None])
                    for pool in tops.add(items[x], scores[x, y], order[begin + y], absent[begin + y], np.zeros(len(x), np.int64)):
                        yield given(*pool)
        for pool in tops.rest():
            yield given(*pool)

    return pairs.mapInArrow(trimmed(run), f"item long, item_id {kind}, doc_id long, score long")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of `items` (item_id, text) the `k` documents (doc_id, text) of highest score above 0.

    Terms are longest runs of a-z (A-Z lower-cased), 0-9 and characters beyond ASCII of whole texts. With N
    documents that have a term, L terms in them, n in one, df documents with a term and tf of it in one, a score
    sums floor(1000 * ln((2N + 2) / (2 df + 1))) * (10**9 tf div (1000 tf + 20 m)), m = 50 + (50 n N div L),
    over the distinct terms of the item. Equal scores come by ascending doc_id, null ones last.

    Terms go by 64-bit hashes: of V item terms and T others some two are taken for one with probability about
    V T / 2 ** 64. A sieve of 8 MB leaves only item terms (and few others) in the documents' tiles; numbers of
    documents are counted from those. Items make blocks of bounded size; tiles, in groups, meet each
    block once, and each task keeps the first `k` documents of its items alone.

    Null and empty texts, and texts without terms, are no documents and match nothing; an item without terms has
    no rows. Rows that repeat an item or a doc_id are kept as rows of their own. Empty tables give an empty
    result; other columns are left out. A doc_id that is no whole number is refused by a TypeError. A text is
    worked on whole: a task takes about 20 bytes for each byte of its longest one.
    """
    whole_ids(docs, "ranked search")
    scratch = Scratch(spark, "ranking")
    wanted, _ = scratch.keep(item_terms(items))
    bits = spark.sparkContext.broadcast(sieve(wanted.select("term")))
    tiles, _ = scratch.keep(document_tiles(docs, bits))
    count, n_docs, n_terms = (int(x or 0) for x in tiles.agg(F.count("*"), F.sum("n_docs"), F.sum("n_terms")).first())
    found, _ = scratch.keep(wanted.join(document_frequencies(tiles), "term"))
    item_blocks, _ = scratch.keep(blocks(found.select("item", "item_id", "term", "df"), n_docs, found.count()))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / GROUP_TILES))
    spread = item_blocks.withColumnRenamed("terms", "item_terms").select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    dealt = tiles.drop("n_docs", "n_terms").withColumn("group", F.pmod(F.xxhash64("ids", "counts"), F.lit(groups)).cast("int"))
    # merged, as the blocks of all groups are larger than the table that they come from
    first = met(dealt.join(spread.hint("merge"), "group"), n_docs, n_terms, k, items.schema["item_id"].dataType.simpleString())
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return first.withColumn("rank", nth).filter(F.col("rank") <= k).select("item_id", "rank", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "score")
