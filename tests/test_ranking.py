"""Ranks of more rows than a range exchange samples."""

from pyspark.sql import functions as F

from lodestrata.operators.ranking import global_rank


def test_ranks_are_positions(spark):
    df = spark.range(300_000).select(F.xxhash64("id").alias("v"), F.repeat(F.lit("x"), 20).alias("more"))
    got = global_rank(df, "v", "r")
    want = {v: i for i, v in enumerate(sorted(r.v for r in df.collect()))}
    rows = got.select("v", "r").collect()
    assert len(rows) == 300_000 and all(want[r.v] == r.r for r in rows)


def test_empty(spark):
    assert global_rank(spark.range(0).withColumnRenamed("id", "v"), "v", "r").count() == 0
