"""Domain tables derived from the driver tables, in Spark and in the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points of a scan: a line item is a point, its supplier the object, its order the frame.
POINTS = """points AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 100000000 AS point_id, CAST(l_orderkey % 97 AS INT) AS frame, CAST(l_orderkey % 3 AS INT) AS cam,
         CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / CAST(2000 AS DOUBLE) AS y, l_discount * CAST(20 AS DOUBLE) AS z,
         CAST(l_orderkey % 256 AS INT) AS r, CAST(l_partkey % 256 AS INT) AS g, CAST(l_suppkey % 256 AS INT) AS b,
         l_suppkey AS object_id, concat(l_returnflag, l_linestatus) AS label
  FROM lineitem)"""

#: Votes: a user is an object, a day a view, the type of event a label.
VOTES = """views AS (
  SELECT event_id, user_id AS object_id, CAST(date_trunc('day', ts) AS DATE) AS view_day, CAST(user_id % 3 AS INT) AS cam, event_type AS label, value, ts
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    byte = lambda c: (F.col(c) % 256).cast("int")
    return li.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long") % 100_000_000).alias("point_id"),
        (F.col("l_orderkey") % 97).cast("int").alias("frame"),
        (F.col("l_orderkey") % 3).cast("int").alias("cam"),
        F.col("l_quantity").cast("double").alias("x"),
        (F.col("l_extendedprice") / F.lit(2000.0)).alias("y"),
        (F.col("l_discount") * F.lit(20.0)).alias("z"),
        byte("l_orderkey").alias("r"),
        byte("l_partkey").alias("g"),
        byte("l_suppkey").alias("b"),
        F.col("l_suppkey").alias("object_id"),
        F.concat("l_returnflag", "l_linestatus").alias("label"),
    )


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("object_id"), F.to_date("ts").alias("view_day"), (F.col("user_id") % 3).cast("int").alias("cam"), F.col("event_type").alias("label"), "value", "ts"
    )




def _exact(column: str) -> str:
    return f"CAST(CAST(sum(CAST(round({column} * 1000000) AS BIGINT)) AS BIGINT) AS DOUBLE) / (count({column}) * 1000000)"


def exact_mean(column: str) -> Column:
    """The mean of whole millionths, whose sum doesn't depend on the order of rows as one of doubles does."""
    return F.sum(F.round(F.col(column) * 1_000_000).cast("long")) / (F.count(column) * 1_000_000)


#: Patches: the points of an object in a square of 10, with their box, centre (exact_mean) and mean color.
PATCHES = f"""patches AS (
  SELECT object_id * 1000 + CAST(floor(x / 10) AS BIGINT) * 30 + CAST(floor(y / 10) AS BIGINT) AS patch_id, count(*) AS n,
         min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1,
         {_exact("x")} AS x, {_exact("y")} AS y, {_exact("z")} AS z, avg(r) AS r, avg(g) AS g, avg(b) AS b
  FROM points GROUP BY 1)"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = F.col("object_id") * 1000 + F.floor(F.col("x") / 10) * 30 + F.floor(F.col("y") / 10)
    ends = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]
    return points(spark, sf_dir).groupBy(patch.alias("patch_id")).agg(F.count("*").alias("n"), *ends, *[exact_mean(c).alias(c) for c in "xyz"], *[F.avg(c).alias(c) for c in "rgb"])


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
