"""Candidate buckets whose members are compared in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.shared import Scratch

#: Rows of a bucket that one block holds.
BLOCK = 2048


def block_pairs(rows: DataFrame, bucket: str, salt: Column, scratch: Scratch, block: int = BLOCK, weight: str | None = None) -> DataFrame:
    """`rows` with `i`, `j` (the pair of blocks) and `side` (which of the two a row is in).

    A bucket of up to `block` rows is the single pair (0, 0). A larger one is dealt by `salt` into n blocks
    of about `block` rows, and each row goes to the n pairs of its block, so a group to compare never has
    more than about two blocks, however many rows share a bucket. The bucket sizes are counted with map-side
    combining; only those of large buckets are kept and joined, so rows aren't moved for it while they are few.
    A row counts as its `weight`, where that column is named, which is left out of the result.
    """
    total = F.sum(weight) if weight else F.count("*")
    large, _ = scratch.keep(rows.groupBy(F.col(bucket).alias("__bucket")).agg(total.alias("__n")).filter(F.col("__n") > block))
    dealt = rows.join(large, F.col(bucket) == F.col("__bucket"), "left").withColumn("__blocks", F.coalesce(F.ceil(F.col("__n") / block), F.lit(1)).cast("int"))
    own = F.pmod(salt, F.col("__blocks")).cast("int")
    paired = dealt.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return paired.select(
        *[c for c in rows.columns if c != weight],
        F.least("__own", "__other").alias("i"),
        F.greatest("__own", "__other").alias("j"),
        F.when(F.col("__own") <= F.col("__other"), 0).otherwise(1).alias("side"),
    )


class Forest:
    """Disjoint sets over positions 0..n-1, for a spanning forest of the links in a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by `keys` (integer columns without nulls)."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        change = group_starts(table, keys)
        last = int(change[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last)
    if held is not None:
        yield held.combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a row's keys differ from those of the row before it."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
