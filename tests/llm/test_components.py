"""Components against a brute-force union, with hubs, chains and repeated edges; joins with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm.common import connected_components, join_hot


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted((x, find(x)) for x in root)


def test_components(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(200)] + [(9000, 9000 - i) for i in range(1, 1500)]
    edges += [(rng.randrange(20_000, 22_000), rng.randrange(20_000, 22_000)) for _ in range(900)] + [(7, 7)] * 3 + [(1, 0)] * 5
    rng.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == brute(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_too_few_rounds_is_an_error(spark):
    chain = spark.createDataFrame([(i * 7 % 1001, (i + 1) * 7 % 1001) for i in range(1000)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=1)


def test_join_hot(spark):
    rows = [(i % 3 if i % 2 else i, i) for i in range(4000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k long, i long")
    facts = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("twice", F.col("k") * 2)
    got = sorted(map(tuple, join_hot(df, facts, "k", "n", len(rows)).select("k", "i", "twice").collect()))
    assert got == sorted((k, i, 2 * k) for k, i in rows if k is not None)
