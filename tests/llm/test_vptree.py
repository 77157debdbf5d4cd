import numpy as np
import pytest

from lodestrata.llm import vptree


def brute(rows, k=10):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in sorted(rows, key=lambda r: (r[0], r[1].tolist()), reverse=True):
        if i % 100 == 0:
            near = sorted((float(np.sqrt(np.square(v - w).sum())), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_and_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    exact = found(vptree.nearest(df, factor=1.0, shard=300, cell=500))
    assert {q: [j for _, j in n] for q, n in exact.items()} == {q: [j for _, j in n] for q, n in want.items()}
    loose = found(vptree.nearest(df))
    hits = [len({j for _, j in loose[q]} & {j for _, j in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.95
    for q, n in loose.items():
        assert n == sorted(n)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (None, [1.0, 1.0]), (200, [1.0, 2.0, 3.0]), (11, [2.0, 2.0]), (11, [2.0, 2.0])]
    rows += [(1000 + i, [3.0, 3.0]) for i in range(1, 80)]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got, want = found(vptree.nearest(df, factor=1.0)), {q: n for q, n in brute(rows).items() if n}
    assert {q: [j for _, j in n] for q, n in got.items()} == {q: [j for _, j in n] for q, n in want.items()}
    for q in want:
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]], abs=0, rel=1e-15)
    assert vptree.nearest(df.limit(0)).collect() == []


def test_repeated_ids(spark):
    """A query's id many times on one vector, on several vectors, and beside ties: its rows are left out, all others count."""
    rows = [(100, [1.0, 1.0])] * 12 + [(i, [1.0, 1.0]) for i in range(201, 220)] + [(300, [5.0, float(i)]) for i in range(30)] + [(7, [5.0, 5.0])] * 15 + [(400, [5.0, 40.0])]
    rows += [(1000 + i, [float(i % 9), float(i % 7)]) for i in range(1, 90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {q: n for q, n in brute(rows).items() if n}
    for shard, cell in ((8192, 2048), (20, 10)):
        got = found(vptree.nearest(df, factor=1.0, shard=shard, cell=cell))
        assert {q: [j for _, j in n] for q, n in got.items()} == {q: [j for _, j in n] for q, n in want.items()}
