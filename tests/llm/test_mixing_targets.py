import os

import corpus_pipeline
import pytest
from lodestrata.llm import mixing
from pyspark.sql import functions as F


def reached(spark, docs, sf):
    got = mixing.mix(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    row = got.agg(F.sum("tokens").alias("n"), *(F.sum(F.expr(f"rate * tokens * p_{d}")).alias(d) for d in mixing.TARGETS)).first()
    return [row[d] / row["n"] for d in mixing.TARGETS]


def test_larger_table(spark, sf):
    large = os.path.join(os.path.dirname(sf), "sf0.1")
    assert reached(spark, spark.read.parquet(f"{large}/documents.parquet"), large) == pytest.approx(list(mixing.TARGETS.values()), rel=0.01)


def test_input_of_the_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = mixing.cut(stage(spark, docs, sf))
    assert reached(spark, docs, sf) == pytest.approx(list(mixing.TARGETS.values()), rel=0.01)


def test_out_of_reach_is_said(spark):
    """All rows lie in the first domain: the second cannot be reached, and the first is met."""
    members = spark.createDataFrame([(i, 10.0, 1.0, 0.0) for i in range(20)], "id long, tokens double, p0 double, p1 double")
    _, have = mixing.fit_rates(members, [0.5, 0.5])
    assert have == pytest.approx([0.5, 0.0]) and mixing.missed(have, [0.5, 0.5]) == [1]
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with pytest.warns(mixing.MixWarning, match="toxic"):
        mixing.mix(docs, labels)
