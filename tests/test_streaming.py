"""Streams over tables of one file and of many."""

import os

from pyspark.sql import functions as F

from terrane.plans import folds

SF = "/root/testdata/sf0.001"


def test_a_folder_of_part_files_gives_what_one_file_does(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    path = str(tmp_path / "events.parquet")
    rows.repartitionByRange(3, F.desc("ts")).sortWithinPartitions(F.desc("ts")).write.parquet(path)
    # the latest events' file is the oldest, which a stream reads first
    for k, part in enumerate(sorted((tmp_path / "events.parquet").glob("part-*"))):
        os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    for query in (folds.streaming_votes, folds.streaming_tracks):
        one, many = (sorted(map(tuple, query(spark, sf).collect()), key=str) for sf in (SF, str(tmp_path)))
        assert one and one == many
