import pytest

from lodestrata.llm import mixing


def test_totals_meet_targets(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    total = sum(r["tokens"] for r in rows)
    for d, share in mixing.TARGETS.items():
        assert sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in rows) / total == pytest.approx(share, rel=0.02)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "c " * 50000), (3, "c " * 50000), (3, "c " * 50000)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, rate int, _r double")
    labels = spark.createDataFrame([(3, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mix(df, labels).collect()
    assert sorted(r["tokens"] for r in got) == [0, 0, 2, 50000, 50000, 50000]
    assert mixing.mix(df.limit(0), labels).collect() == []
    even = mixing.mix(df, labels.limit(0)).collect()
    assert all(r["p_clean"] == pytest.approx(1 / 3) for r in even)


def test_projection_reaches_zero(spark):
    """A domain far over its target: its documents' rates are cut, to zero at most."""
    members = spark.createDataFrame([(i, 10.0, *((1.0, 0.0) if i % 10 else (0.0, 1.0))) for i in range(100)], "id long, tokens double, p0 double, p1 double")
    rate, have = mixing.fit_rates(members, [0.5, 0.5])
    assert have == pytest.approx([0.5, 0.5], rel=1e-2)
    rates = {r["p0"]: r["r"] for r in members.withColumn("r", rate).collect()}
    assert rates[1.0] == pytest.approx(5 / 9, rel=1e-2) and rates[0.0] == pytest.approx(5, rel=1e-2)
