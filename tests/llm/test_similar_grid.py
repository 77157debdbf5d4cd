"""The pipeline's dedup compares what meets in operator 1's grid, with or without the bands beside it."""

import random

import numpy as np
from lodestrata.llm import similar, simhash


def copies():
    """Texts of 600 words with copies that have 1 to 8 words edited, and pairs of short texts."""
    rng, rows = random.Random(7), []
    for i in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(600)]
        rows.append((100 * i, " ".join(words)))
        for k in range(1, 9):
            new = list(words)
            for at in rng.sample(range(600), k):
                new[at] = f"new{rng.randrange(10**9)}"
            rows.append((100 * i + k, " ".join(new)))
    return rows + [(9000 + i, f"word{i // 2}") for i in range(20)] + [(9900, ""), (9901, None)]


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_grid_alone(spark):
    rows = copies()
    sets = [similar.shingles((t or "").encode()) for _, t in rows]
    fps = np.array([simhash.majority(s) for s in sets], np.uint64)
    bits = np.bitwise_count(fps[:, None] ^ fps)
    group = components(len(rows), lambda i, j: len(sets[i]) and len(sets[j]) and bits[i, j] <= 2)

    def alike(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return len(sets[i]) == len(sets[j]) == 0 or (group[i] == group[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both))

    comp = components(len(rows), alike)
    want = {d: min(e for (e, _), c in zip(rows, comp) if c == k) for (d, _), k in zip(rows, comp)}
    assert sum(0 < bits[i, j] <= 2 and alike(i, j) for i in range(len(rows)) for j in range(i)) > 20  # not equal, only near
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: r[1] for r in similar.near_duplicates(df, bands=0).collect()} == want
    full = {r[0]: r[1] for r in similar.near_duplicates(df).collect()}
    assert all(full[d] <= c for d, c in want.items())
