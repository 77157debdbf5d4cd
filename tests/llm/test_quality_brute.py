"""Posteriors of many sparse hosts against the formulas, and that sparse hosts are shrunk to the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import quality


def logit(p):
    return np.log(p / (1 - p))


def strength(s, n, q, mean):
    m, within = s.sum() / n.sum(), max(np.maximum(q - s * s / n, 0).sum() / n.sum(), 1e-6)
    spread = max(((n * (s / n - mean) ** 2).sum() - len(n) * within) / n.sum(), 0.0)
    return m, min(max(within / spread if spread > 0 else 1e4, 1.0), 1e4)


def test_scores_by_formula(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    host = F.concat(F.lit("h"), F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("doc_id") % 61))  # one hot host, many sparse ones
    path = F.concat(host, F.lit("/"), F.col("doc_id") % 4)
    got = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet"), host=host, path=path, carry=False).toPandas()
    p = got.own_score.to_numpy()
    hosts = got.assign(p=p, q=p * p).groupby("host").agg(s=("p", "sum"), q=("q", "sum"), n=("p", "size"))
    m, k = strength(hosts.s.to_numpy(), hosts.n.to_numpy(), hosts.q.to_numpy(), p.mean())
    post = (k * m + hosts.s) / (k + hosts.n)
    assert got.host_posterior.to_numpy() == pytest.approx(post[got.host].to_numpy(), rel=1e-9)
    paths = got.assign(p=p, q=p * p).groupby(["host", "path"]).agg(s=("p", "sum"), q=("q", "sum"), n=("p", "size")).reset_index()
    _, kp = strength(paths.s.to_numpy(), paths.n.to_numpy(), paths.q.to_numpy(), post[paths.host].to_numpy())
    of = paths.set_index("path").loc[got.path]
    others = np.clip((kp * post[got.host].to_numpy() + of.s.to_numpy() - p) / (kp + of.n.to_numpy() - 1), quality.EPS, 1 - quality.EPS)
    assert got.path_posterior.to_numpy() == pytest.approx(others, rel=1e-9)
    want = 1 / (1 + np.exp(-(logit(p) + logit(others) - logit(m))))
    assert got.quality_score.to_numpy() == pytest.approx(want, rel=1e-9)
    # a sparse host's posterior lies between its mean and that of all
    mean = hosts.s / hosts.n
    assert ((post - m).abs() <= (mean - m).abs() + 1e-12).all() and (post - m).abs()[hosts.n < 3].mean() < 0.9 * (mean - m).abs()[hosts.n < 3].mean()


def test_ties_repeats_and_names(spark):
    rows = [(1, "Good words in a row, as they come.", "s"), (1, "Good words in a row, as they come.", "s"), (2, "@@@ ### |||", None), (3, None, "s"), (None, "", None)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, source string, quality_score double, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for carry in (True, False):
        got = quality.classify(docs, labels, carry=carry).collect()
        assert len(got) == 5 and len({r["quality_score"] for r in got if r["doc_id"] == 1}) == 1
        even = quality.classify(docs, labels.limit(0), carry=carry, threshold=0.5).collect()
        assert all(r["quality_score"] == pytest.approx(0.5) for r in even)
