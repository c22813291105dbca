"""Statistics behind the plots: complementary cumulative distribution and log2-binned density."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.functions.session import written


def placed(df: DataFrame, column: str) -> DataFrame:
    """x, n (how often), upto (values up to x), total.

    Equal values are counted first; running sums go by ranges of x: each part
    sums its own, and only the parts' sums meet in one task.
    """
    counts = df.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    parts = written(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "counts")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("part").agg(F.sum("n").alias("size")).select("part", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("inside", inside).join(F.broadcast(sizes), "part").select("x", "n", (F.col("before") + F.col("inside")).alias("upto"), "total")


def ccdf(df: DataFrame, column: str) -> DataFrame:
    """x, y: share of values above x, ties at the middle of their ranks."""
    rank = F.col("upto") - F.col("n") + 1 + (F.col("n") - 1) / 2
    return placed(df, column).select("x", ((F.col("total") - rank) / F.col("total")).alias("y"))


def ccdf_ordinal(df: DataFrame, column: str, block: int = 1 << 16) -> DataFrame:
    """x, y with a rank of its own for each of equal values; ranks are made by blocks, so no row holds all of a frequent value's."""
    blocks = placed(df, column).select("x", "total", "upto", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"), F.lit(block).cast("long"))).alias("first"))
    ranks = blocks.repartition("x", "first").select("x", "total", F.explode(F.sequence("first", F.least(F.col("upto"), F.col("first") + block - 1))).alias("rank"))
    return ranks.select("x", ((F.col("total") - F.col("rank")) / F.col("total")).alias("y"))


def pdf_log2(df: DataFrame, column: str) -> DataFrame:
    """x (right edge), y (count by width) of bins [2^b, 2^(b+1)) up to the power of two at or above the maximum; the last bin is closed, values under 1 are dropped."""
    x = F.col(column).cast("double")
    values = df.where(x >= 1).select(x.alias("v"))
    last = values.agg(F.greatest(F.ceil(F.log2(F.max("v"))) - 1, F.lit(0)).alias("last"))
    low = F.floor(F.log2("v"))
    bins = values.crossJoin(F.broadcast(last)).select(F.least(low, F.col("last")).alias("b"))
    return bins.groupBy("b").agg(F.count("*").alias("n")).select(F.pow(F.lit(2.0), F.col("b") + 1).alias("x"), (F.col("n") / F.pow(F.lit(2.0), "b")).alias("y"))
