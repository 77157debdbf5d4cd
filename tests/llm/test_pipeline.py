import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        assert after.columns[: len(docs.columns)] == docs.columns
        if name != "mix":
            assert after.columns == docs.columns
        else:  # documents without copies are gone, the others carry how often they count
            assert after.where("copies < 1 or copies is null").count() == 0
        assert after.join(before, "doc_id", "left_anti").count() == 0
        n, m = before.count(), after.count()
        assert 0 < m <= n and (name != "secrets" or m == n)
        before = after
    assert sorted(map(tuple, before.select("doc_id", "copies").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "copies").collect()))


def test_empty(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
