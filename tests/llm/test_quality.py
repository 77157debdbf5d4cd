from lodestrata.llm import quality


def test_finds_junk_and_keeps_clean(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    test = labels.where("crc32(cast(doc_id as string)) % 5 = 0").select("doc_id", "quality")
    got = quality.classify(docs, train).join(test, "doc_id").select("quality", "keep").collect()
    good = [r["keep"] for r in got if r["quality"] == 1]
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (None, "", "s", "en"), (3, "x " * 50000, "s", None), (3, "x " * 50000, "s", None), (5, "%%% ***", "s", "en")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, source string, lang string, host int, _p string")
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (1, None), (1, 9)], "doc_id long, quality int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 5 and all(0 < r["quality_score"] < 1 for r in got)
    assert quality.classify(df.limit(0), labels).collect() == []
    assert {round(r["quality_score"], 6) for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
