"""Fixed examples and properties of what SQL cannot check."""

import hashlib
import hmac
import random

from pyspark.sql import functions as F

from lodestrata.operators import chunks, intervals, lookups, paths, placement, stats


def test_reed_solomon_any_four_of_five():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 17, 4096):
        data = rng.randbytes(n)
        shards = dict(enumerate(placement.rs_encode(data)))
        for lost in range(5):
            assert placement.rs_decode({i: s for i, s in shards.items() if i != lost}) == data
    shards = dict(enumerate(placement.rs_encode(b"abc" * 50, 3, 3)))
    assert placement.rs_decode({i: shards[i] for i in (1, 4, 5)}, 3, 3) == b"abc" * 50


def test_placement_balance_and_disruption():
    five, six = (placement.placement_table([f"node-{i:02d}" for i in range(n)]) for n in (5, 6))
    counts = [int((five == i).sum()) for i in range(5)]
    assert max(counts) - min(counts) <= 1
    moved = float((five != six).mean())
    assert abs(moved - 1 / 6) < 0.05
    assert placement.fnv1a(b"") == 0xCBF29CE484222325 and placement.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert placement.fnv1a_column(["a", "", "foobar"]).tolist() == [placement.fnv1a(x) for x in (b"a", b"", b"foobar")]


def test_hmac(spark):
    df = spark.createDataFrame([(bytes(range(32)), b"payload"), (b"\xff" * 32, b"")], "k binary, m binary")
    got = [r[0] for r in df.select(chunks.hmac_sha256(F.col("k"), F.col("m"))).collect()]
    assert got == [hmac.new(k, m, hashlib.sha256).hexdigest() for k, m in ((bytes(range(32)), b"payload"), (b"\xff" * 32, b""))]


def test_holes_merge_and_errors(spark):
    import pytest

    def holes(*rows):
        return spark.createDataFrame([(1, 1048576, a, a + n) for a, n in rows], "image long, size long, start long, end long")

    got = intervals.normalize_holes(holes((8192, 4096), (4096, 4096), (100, 0))).collect()
    assert [(r["start"], r["end"]) for r in got] == [(4096, 12288)]
    for bad in (((0, 4096), (2048, 4096)), ((1047552, 2048),)):
        with pytest.raises(Exception, match="overlap"):
            intervals.normalize_holes(holes(*bad)).collect()


def test_overlay_cases(spark):
    def visible(*runs):
        df = spark.createDataFrame([(1, *r) for r in runs], "image long, layer long, start long, end long, kind int, chunk long")
        return sorted((r["start"], r["end"], r["kind"], r["chunk"]) for r in intervals.overlay(df).collect())

    assert visible((0, 0, 4096, 2, 1), (0, 4096, 8192, 0, 0), (1, 0, 8192, 2, 2)) == [(0, 4096, 2, 1), (4096, 8192, 2, 2)]
    assert visible((0, 0, 4096, 1, 0), (0, 4096, 8192, 2, 1), (1, 0, 8192, 2, 2)) == [(0, 4096, 1, -1), (4096, 8192, 2, 1)]
    assert visible((0, 0, 4096, 0, 0), (0, 4096, 8192, 2, 1), (1, 0, 4096, 0, 0), (1, 4096, 8192, 2, 2)) == [(0, 4096, 0, -1), (4096, 8192, 2, 1)]
    assert visible((0, 0, 4096, 2, 1), (1, 0, 8192, 2, 2)) == [(0, 4096, 2, 1), (4096, 8192, 2, 2)]


def test_latency_histogram(spark):
    ms = 1_000_000
    df = spark.createDataFrame([("a", ms)] * 1000 + [("a", 200 * ms)] * 50 + [("a", 500 * ms)], "k string, ns long")
    h = stats.histogram(df, ["k"], "ns")
    p50, p99, top = (stats.histogram_percentile(h, ["k"], p).first()["value"] for p in (500, 990, 1000))
    assert p50 <= 2 * ms and p99 >= 100 * ms and top == 500 * ms


def test_histogram_delta(spark):
    n = len(stats.BOUNDS) + 1
    rows = [("a", 1, [0] * n, 0), ("a", 2, [2] + [0] * (n - 1), 700), ("a", 3, [2, 1] + [0] * (n - 2), 700), ("a", 4, [2, 1] + [0] * (n - 3) + [1], 700)]
    df = spark.createDataFrame(rows, "k string, t int, counts array<bigint>, peak long")
    got = {r["t"]: r["window_max"] for r in stats.histogram_delta(df, ["k"], "t").collect()}
    assert got == {2: 700, 3: stats.BOUNDS[1], 4: stats.OVERFLOW}


def test_diff_of_conflicting_sizes(spark):
    import pytest

    a = spark.createDataFrame([("k", 4096, False)], "key string, size long, is_zero boolean")
    b = spark.createDataFrame([("k", 8192, False)], "key string, size long, is_zero boolean")
    with pytest.raises(Exception, match="two sizes"):
        chunks.diff(a, b).collect()
    assert chunks.diff(a.limit(0), b.limit(0)).first()["dedup_ratio"] == 0.0


def test_whiteouts(spark):
    rows = [(1, 0, "a/x"), (1, 0, "a/y"), (1, 1, "a/.wh.x"), (1, 1, "b"), (1, 2, "a/x"), (1, 0, "d/e/f"), (1, 1, "d/.wh..wh..opq"), (1, 1, "d/g"), (1, 0, "d")]
    got = {(r["layer"], r["path"]) for r in paths.apply_layers(spark.createDataFrame(rows, "image long, layer int, path string")).collect()}
    assert got == {(2, "a/x"), (0, "a/y"), (1, "b"), (1, "d/g"), (0, "d")}


def test_lru(spark):
    t = "timestamp '2024-01-01 12:00:00'"
    df = spark.sql(f"select 'g' g, p, 100L size, {t} - make_interval(0,0,0,0,0,m) mtime from values ('old', 60), ('mid', 50), ('new', 40) v(p, m)").withColumnRenamed("p", "path")
    assert {r["path"] for r in lookups.lru_evict(df, "g", F.expr(t), F.lit(150)).collect()} == {"old", "mid"}
    fresh = spark.sql(f"select 'g' g, 'p' path, 100L size, {t} mtime")
    assert lookups.lru_evict(fresh, "g", F.expr(t), F.lit(0)).collect() == []
