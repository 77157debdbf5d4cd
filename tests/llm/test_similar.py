import random

import corpus_pipeline
import numpy as np
from lodestrata.llm import similar


def brute(rows, width=5, least=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    return {min(d for k, (d, _) in enumerate(rows) if find(k) == r) for r in {find(i) for i in range(len(rows))}}


def planted():
    """Texts of 200 words, each with copies that have 1 to 6 words edited (similarity about 0.95 to 0.74)."""
    rng, rows = random.Random(1), []
    for i in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((100 * i, " ".join(words)))
        for k in range(1, 7):
            new = list(words)
            for at in rng.sample(range(10, 190), k):
                new[at] = f"new{rng.randrange(10**9)}"
            rows.append((100 * i + k, " ".join(new)))
    return rows


def test_stage_drops_edited_copies(spark, sf):
    rows = planted()
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r[0] for r in corpus_pipeline.stage_dedup(spark, df, sf).select("doc_id").collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "One TWO"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r[0] for r in similar.keep_one(df).collect()), key=str) == sorted([1, 4, 7, None], key=str)
    assert similar.keep_one(df.limit(0)).collect() == []


def test_forest_is_exact():
    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[: 100 - k], rng.integers(1000, 10**9, k).astype(np.uint64)])) for k in range(0, 60, 2)]
    root = {i: i for i in range(len(sets))}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in similar.forest(list(range(len(sets))), sets, 0.8):
        root[find(a)] = find(b)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                assert find(i) == find(j)
