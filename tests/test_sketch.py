"""Sketch cells by the definition of the hash, and rotations by touches and written bytes."""

from pyspark.sql import functions as F

from lodestrata.operators import placement as pl
from lodestrata.operators import stats as st


def test_cells(spark):
    keys = ["", "a", "key-17", "Größe", "x" * 50]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for row, seed in enumerate(st.SEEDS):
        got = {r.k: r.c for r in df.select("k", st.sketch_cell(F.col("k"), row, 1024).alias("c")).collect()}
        assert got == {k: pl.fnv1a(k.encode(), pl.FNV_BASIS ^ seed) % 1024 for k in keys}


def test_turnover(spark):
    cases = [  # touches after the key's first, limits, estimate
        ("one", 2, 8, [4, 4], 1), ("two", 2, 8, [4, 4, 4], 2), ("bytes stay", 3, 10, [4, 4, 0, 2], 2), ("count stays", 4, 8, [0, 0, 8, 0], 2),
        ("large", 100, 10, [1000, 1000], 0), ("none", 100, 10, [None, 0, 3], 3),
    ]
    for name, every, limit, sizes, want in cases:
        rows = [(name, "k", i, n) for i, n in enumerate(sizes)]
        df = spark.createDataFrame(rows, "s string, k string, i long, n long")
        got = st.turnover_estimate(df, "s", "k", "i", "n", every, limit).collect()
        assert [r.estimate for r in got] == [want], name
