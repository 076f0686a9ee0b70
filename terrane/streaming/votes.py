"""Votes and runs of observations as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrane.operators.lineage import shared_dir


def windowed_votes(observations: DataFrame, late: str, width: str) -> DataFrame:
    """Weight and number of each label in tumbling windows of `ts`, closed when the watermark passes them."""
    return observations.withWatermark("ts", late).groupBy(F.window("ts", width), "label").agg(F.count("*").alias("n"), F.sum("value").alias("weight")).select(F.col("window.start").alias("start"), "label", "n", "weight")


def sessions(observations: DataFrame, late: str, gap: str) -> DataFrame:
    """Sessions of each object: observations that follow each other within the gap."""
    return observations.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "object_id").agg(F.count("*").alias("n"), F.sum("value").alias("weight")).select("object_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "weight")


def running_tracks(observations: DataFrame, most_gap: float) -> DataFrame:
    """A row for each batch and object: its open track's number, start and length, a track ending after `most_gap` seconds of silence."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, last, length = state.get if state.exists else (0, 0.0, -1e18, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        for t in rows["t"]:
            if t - last > most_gap:
                number, start, length = number + 1, t, 0
            last, length = t, length + 1
        state.update((number, start, last, length))
        yield pd.DataFrame({"object_id": [key[0]], "track": [number], "start": [start], "length": [length]})

    schema = "object_id long, track long, start double, length long"
    return observations.groupBy("object_id").applyInPandasWithState(step, schema, "number long, start double, last double, length long", "append", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that a stream gives for what is there now, written to the shared folder and read again."""
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def arriving(spark: SparkSession, folder: str, name: str, most_files: int | None = None) -> DataFrame:
    """The files of a table in a folder, itself a file or a folder of part files, as a stream; new files join it.

    What is there now comes in one batch unless `most_files` bounds it, so no row is late by the order of files.
    """
    table = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(table).schema)
    if most_files is not None:
        reader = reader.option("maxFilesPerTrigger", most_files)
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(table)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
