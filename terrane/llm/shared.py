"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a task works on at a time.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or else the one set for checkpoints; a temporary one only where neither is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else own_folder(spark)
    return named


def own_folder(spark: SparkSession) -> str:
    """A temporary folder of this machine, where no shared one is named."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


class Scratch:
    """Tables in the shared folder that cut lineage; drop() deletes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts pass `most` bytes, so that a task's memory doesn't follow the batch."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        column_data = batch.column(batch.schema.get_field_index(column))
        sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in column_data), np.int64, batch.num_rows)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, giving what it has freed back to the system at its end, since workers live on for other stages."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    data = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in data.cast(pa.binary()).to_pylist()]


def packed(docs: DataFrame, without: Iterable[str] = ()) -> Column:
    """The columns of `docs` as one struct `row`, so that no name of the caller's meets one of the operator's."""
    names = [c for c in docs.columns if c not in set(without)]
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")


def whole_ids(docs: DataFrame, operator: str) -> None:
    """Raises a TypeError unless doc_id is a whole number: its order and its arithmetic are part of the operator's meaning."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{operator} takes whole numbers as doc_id, not {kind.simpleString()}")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
