"""Mixing sources to target weights: Sainte-Laguë quotas of token blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm.shared import WORD, Scratch, packed

SEED = 7_919
#: Tokens of a block, and tokens that a shard has about.
BLOCK_TOKENS, SHARD_TOKENS = 8, 1 << 20
#: Shards that are dealt to at once.
GROUP_SHARDS = 4096
#: A table of at most so many rows is broadcast; a longer one is joined by shuffling.
BROADCAST_ROWS = 50_000


def sainte_lague(weights: Sequence[float], seats: int) -> np.ndarray:
    """The seats that go to each weight if they are given, one by one, to the highest weight / (2 * seats held + 1).

    Ties go to the earlier place. The divisor is found by bisection, so the cost doesn't follow the seats.
    """
    w = np.asarray(weights, np.float64)
    held = np.zeros(len(w), np.int64)
    if not len(w) or seats <= 0 or w.sum() <= 0:
        return held
    low, high = 0.0, (2.0 * seats + 2 * len(w)) / w.sum()
    for _ in range(200):
        middle = (low + high) / 2
        if np.floor(w * middle + 0.5).sum() > seats:
            high = middle
        else:
            low = middle
    # just below the divisor, so that rounding gives no seat; what is left are ties within the last bits
    held = np.floor(w * (low * (1 - 1e-12)) + 0.5 * (1 - 1e-12)).astype(np.int64)
    while (left := int(seats - held.sum())) > 0:
        order = np.argsort(-(w / (2 * held + 1)), kind="stable")[:left]
        held[order[w[order] > 0]] += 1
    return held


def capped_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> np.ndarray:
    """Shares of `total` by weight, none above `most` times its size, the excess reshared by weight."""
    size, weight = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
    target, fixed = np.zeros(len(size)), np.zeros(len(size), bool)
    while True:
        free = ~fixed
        if not free.any():
            return target
        share = weight[free] * (max(0.0, total - target[fixed].sum()) / weight[free].sum())
        over = share > most * size[free]
        target[free] = share
        if not over.any():
            return target
        stopped = np.flatnonzero(free)[over]
        target[stopped] = most * size[stopped]
        fixed[stopped] = True


def _small(spark: SparkSession, rows: pd.DataFrame, schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """`docs` with size, source_size, target and taken in place of columns of those names; other columns are kept whatever their names.

    size: words of the whole text (null: 0). Sources, in order of code points with null last, weigh
    `weights`, repeating. Their targets share the sum of all sizes, at most `most` times a source's size.
    Each source's target is dealt in blocks of `block_tokens` by highest quotients over all sources, then
    over its shards, to which documents go by a seeded hash of doc_id. A shard takes whole passes over its
    documents and, of one more, the run of blocks that begins at a seeded place; taken is the words of a
    document in what its shard takes, at most ceil(most) times its size. Equal quotients go to the earlier
    source or shard. Reruns agree; rows of one doc_id and text are interchangeable, and rows without doc_id
    go by their text. An empty table gives an empty one. Sources are few: a row for each passes through the
    driver, never one for each document or shard.
    """
    names = ("size", "source_size", "target", "taken")
    return _mixed(spark, docs, packed(docs, names), **options).select("row.*", *names)


def _mixed(
    spark: SparkSession,
    docs: DataFrame,
    row: Column,
    weights: Sequence[float] = (1, 2, 3),
    most: float = 3.0,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    group_shards: int = GROUP_SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """(row, size, source_size, target, taken) of each document."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(row, F.col("source").alias("source"), F.coalesce(F.xxhash64(F.lit(seed), "doc_id"), F.lit(0)).alias("place"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("tie"), size.alias("size"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).toPandas()
    present = per_source[per_source["source"].notna()].sort_values("source", key=lambda s: s.map(lambda x: [ord(c) for c in x]))
    sources = pd.concat([present, per_source[per_source["source"].isna()]], ignore_index=True)
    n, total = len(sources), int(sources["source_size"].sum()) if len(sources) else 0
    targets = capped_targets(sources["source_size"], np.resize(np.asarray(weights, np.float64), n), total, most)
    sources["target"] = targets
    sources["seats"] = sainte_lague(targets, round(targets.sum() / block_tokens)) if n else []
    sources["shards"] = np.maximum(1, np.ceil(sources["source_size"].astype(float) / shard_tokens)).astype("int64") if n else []
    sources["nth"] = np.arange(n)
    sources = sources.astype({"source": object, "source_size": "int64", "target": "float64", "seats": "int64", "shards": "int64"})
    plan = _small(spark, sources.where(sources.notna(), None), "source string, source_size long, target double, seats long, shards long, nth long")
    named = sized.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    named = named.withColumn("shard", F.pmod(F.xxhash64("place", F.lit(seed)), "shards")).drop("source", "of", "shards")

    def deal(by: str):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(by, kind="stable")
            rows["held"] = sainte_lague(rows["tokens"].to_numpy(), int(rows["seats"].iloc[0]))
            return rows[["nth", by, "held"]]

        return run

    # first over groups of shards, then over each group's, so that no task gets all shards of a source
    shards, _ = Scratch(spark, "mixing").keep(named.groupBy("nth", "shard", "seats").agg(F.sum("size").alias("tokens")).withColumn("part", F.expr(f"shard div {group_shards}")))
    parts = shards.groupBy("nth", "part", "seats").agg(F.sum("tokens").alias("tokens")).groupBy("nth").applyInPandas(deal("part"), "nth long, part long, held long")
    dealt = shards.drop("seats").join(parts.withColumnRenamed("held", "seats"), ["nth", "part"]).groupBy("nth", "part").applyInPandas(deal("shard"), "nth long, shard long, held long")
    quotas = shards.join(dealt, ["nth", "shard"]).select("nth", "shard", "tokens", F.least(F.col("held") * block_tokens, F.floor(F.col("tokens") * most)).cast("long").alias("quota"))

    in_shard = Window.partitionBy("nth", "shard").orderBy("place", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.drop("seats").withColumn("end", F.sum("size").over(in_shard)).join(quotas, ["nth", "shard"])
    begin, end, tokens = F.col("end") - F.col("size"), F.col("end"), F.col("tokens")
    part = F.expr("quota % tokens")
    blocks = F.ceil(tokens / block_tokens)
    start = F.pmod(F.xxhash64(F.lit(seed), "nth", "shard"), blocks) * block_tokens
    shared = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(begin, a))
    taken = F.expr("quota div tokens") * F.col("size") + shared(start, F.least(start + part, tokens)) + shared(F.lit(0), F.greatest(F.lit(0), start + part - tokens))
    return placed.select("row", "size", "source_size", "target", F.when(tokens > 0, taken).otherwise(0).cast("long").alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with the columns of `docs`: a document taken r times over, rounded to the nearest, is r rows.

    A document of which less than half is taken is left out; one with no words has none to take and is left out too.
    """
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    copies = F.explode(F.sequence(F.lit(1), times, F.when(times > 0, F.lit(1))))
    return _mixed(spark, docs, packed(docs), **options).select("row", copies.alias("copy")).select("row.*")
