"""Reads, windows and fills against a byte array."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import intervals, reading

RUN = "image long, start long, end long, kind int, chunk long, chunk_start long"


def test_read_at(spark):
    rng = random.Random(4)
    whole, runs, payload = {}, [], []
    for image in (1, 2):
        at, out = 0, b""
        for i in range(30):
            n, kind = rng.randint(1, 300), rng.choice([0, 1, 2])
            lead = rng.randint(0, 5)
            data = rng.randbytes(lead + n)
            if kind == 2:
                payload.append((image * 100 + i, data))
            runs.append((image, at, at + n, kind, image * 100 + i, at - lead))
            out += data[lead:] if kind == 2 else bytes(n)
            at += n
        whole[image] = out
    sizes = {k: len(v) for k, v in whole.items()}
    asked = [(i, 1 + i % 2, rng.randint(0, 5000), rng.randint(0, 900)) for i in range(80)] + [(80, 1, sizes[1], 5), (81, 2, 0, 10**6)]
    frames = [spark.createDataFrame(asked, "request long, image long, offset long, length long"), spark.createDataFrame(runs, RUN), spark.createDataFrame(list(sizes.items()), "image long, size long"), spark.createDataFrame(payload, "chunk long, data binary")]
    got = {r.request: (r.n, bytes(r.data)) for r in reading.read_at(*frames, bucket=128).collect()}
    for i, image, o, n in asked:
        assert got[i] == (len(whole[image][o : o + n]), whole[image][o : o + n])
    with pytest.raises(Exception, match="missing or too short"):
        reading.read_at(*frames[:3], frames[3].where("false")).collect()


def test_windows(spark):
    layers = [(1, 0, 100, 150, 2, 7), (1, 0, 150, 180, 1, -1), (1, 0, 0, 100, 0, -1), (1, 1, 0, 300, 2, 8), (1, 1, 300, 310, 2, 9)]
    top = intervals.overlay(spark.createDataFrame(layers, "image long, layer long, start long, end long, kind int, chunk long"))
    chunks = spark.createDataFrame([(1, 0, 7, 100, 150), (1, 1, 8, 0, 300), (1, 1, 9, 300, 310)], "image long, layer long, chunk long, chunk_start long, chunk_end long")
    asked = spark.createDataFrame([(1, o) for o in (5, 120, 160, 200, 305, 400)], "image long, offset long")
    rows = {r.offset: (r.layer, r.start, r.end) for r in reading.chunk_windows(asked, top, chunks, 1000).collect()}
    assert rows == {5: (1, 0, 100), 120: (0, 100, 150), 200: (1, 180, 300), 305: (1, 300, 310)}
    rows = {r.offset: (r.layer, r.start, r.end) for r in reading.chunk_windows(asked, top, chunks, 60).collect()}
    assert rows == {5: (1, 5, 100), 120: (0, 100, 150), 200: (1, 200, 300), 305: (1, 300, 310)}


def test_forward_and_fill(spark):
    runs = spark.createDataFrame([(1, 0, 5000, 0, 0, 0), (1, 5000, 5100, 0, 0, 0), (1, 5100, 6000, 2, 1, 5100), (1, 6000, 9000, 1, 0, 0)], RUN)
    images = spark.createDataFrame([(1, 9000)], "image long, size long")
    ask = spark.createDataFrame([(1, 10, 100), (1, 5200, 10**6), (1, 9000, 5)], "image long, offset long, limit long")
    assert {(r.offset, r.kind, r.run_end) for r in reading.forward_run(ask, runs, images).collect()} == {(10, 0, 110), (5200, 2, 6000)}
    with pytest.raises(Exception, match="limit of zero"):
        reading.forward_run(ask.withColumn("limit", F.lit(0)), runs, images).collect()
    assert [r.write for r in reading.fill_holes(runs, True).orderBy("start").collect()] == ["skip", "zeros", "data", "zeros"]
    assert [r.write for r in reading.fill_holes(runs, False).orderBy("start").collect()] == ["zeros", "zeros", "data", "zeros"]


def test_lookups_of_very_long_runs(spark):
    """Runs from a byte to a pebibyte: each meets few buckets, and points find theirs by brute force's account."""
    import random

    from lodestrata.operators import intervals as iv

    rng, runs, at = random.Random(6), [], 0
    for i in range(60):
        n = rng.choice([1, 100, 5000, 1 << 20, (1 << 20) + 1, 1 << 31, 1 << 40, 1 << 50])
        if rng.random() < 0.7:
            runs.append((1, at, at + n, i))
        at += n
    points = [(1, rng.choice([s, e - 1, e, s + (e - s) // 2])) for _, s, e, _ in runs for _ in range(3)] + [(1, at + 5), (2, 7), (1, 0), (1, 0)]
    got = iv.lookup_runs(spark.createDataFrame(points, "image long, offset long"), spark.createDataFrame(runs, "image long, start long, end long, chunk int")).collect()
    assert len(got) == len(points)
    for r in got:
        assert r.chunk == next((c for m, s, e, c in runs if m == r.image and s <= r.offset < e), None)
