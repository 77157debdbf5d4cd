"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import cut

#: One word, as every operator here understands it: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words_of(c):
    """The words of a text column as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


#: Keys with more than this part of all rows are joined apart.
HUBS = 512


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """`rows` inner-joined with `facts`, which have one row for each key and the number of rows that have it.

    Keys that hold more than 1 / HUBS of all rows are fewer than HUBS, so their facts are sent to where the rows are; only
    the rest is dealt by key. `rows` and `facts` are read twice: store them before.
    """
    most = total // HUBS
    hot = facts.where(F.col(count) > most).drop(count)
    rare = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(count) <= most).drop(count), key)
    return rows.join(F.broadcast(hot), key).unionByName(rare)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Components of an undirected graph: rows (v, comp) for every vertex with an edge, comp the least vertex.

    Alternating large-star and small-star rounds, each a pre-aggregated minimum joined back to the edges, so that a
    vertex with very many neighbours is neither collected nor expanded into pairs; edges of the few vertices that are the
    lesser end of more than 1 / HUBS of all edges stay where they are, and their minimum is sent to them. Every round is
    checkpointed. Rounds grow with the logarithm of the vertices; if `max_rounds` do not suffice, that is an error.
    """

    def canonical(df):
        return df.where("u <> v").distinct()

    def mark_of(e):
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    spark = edges.sparkSession
    e = cut(canonical(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))))
    mark = mark_of(e)
    for _ in range(max_rounds):
        # an edge's greater end meets the least neighbour of its lesser end, which is that end itself if none is less
        least = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        hubs = [r["v"] for r in e.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > mark[0] // HUBS).select("v").collect()] if mark[0] > HUBS else []
        met = e.join(least, "v", "left")
        if hubs:  # fewer than HUBS
            few = F.broadcast(spark.createDataFrame([(h,) for h in hubs], e.select("v").schema))
            met = e.join(few, "v", "left_anti").join(least, "v", "left").unionByName(e.join(few, "v", "left_semi").join(F.broadcast(least.join(few, "v", "left_semi")), "v", "left"))
        large = canonical(met.select("u", F.coalesce("m", "v").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(canonical(small.union(least.select("u", F.col("m").alias("v")))))
        before, mark = mark, mark_of(e)
        if mark == before:
            return e.select(F.col("u").alias("v"), F.col("v").alias("comp")).union(e.select("v", F.col("v").alias("comp")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
