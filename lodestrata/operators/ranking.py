"""Ranks over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import cut


def global_rank(df: DataFrame, by: str, name: str, parts: int = 64) -> DataFrame:
    """`df` with the zero-based rank by `by` (distinct values): rows are dealt by range, numbered within their part, and
    moved by the sizes of the parts before.

    The dealt rows are stored once: the bounds of the ranges are sampled, so two plans over the same exchange could deal
    the same row to different parts.
    """
    d = cut(df.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()))
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    skip = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1)
    return d.join(F.broadcast(skip), "_part").withColumn(name, F.col("_skip") + F.col("_i")).drop("_part", "_i", "_skip")
