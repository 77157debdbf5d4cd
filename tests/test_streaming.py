"""The stream gives what the batch gives; late events are dropped in append mode."""

import datetime as dt

from pyspark.sql import functions as F

from lodestrata.operators import stats
from lodestrata.streaming import rates


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=7 * i), i % 3 == 0, i) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp, hit boolean, bytes long")
    for k in range(3):
        df.where(F.expr(f"bytes div 67 = {k}")).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = rates.drain(spark, rates.rates(stream, "ts", "1 hour", 3600, "1 hour"), "complete", str(tmp_path / "c"))
    want = stats.window_rates(df, "ts", "1 hour", 3600)
    assert sorted(got.collect()) == sorted(want.collect())
    closed = rates.drain(spark, rates.rates(stream, "ts", "1 hour", 3600, "1 hour"), "append", str(tmp_path / "a"))
    some = closed.collect()
    assert 0 < len(some) < want.count() and len({r.window_start for r in some}) == len(some)
