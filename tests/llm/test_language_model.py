import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import language_model as lm


def brute(rows):
    split = [(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]) for _, t, _ in rows]
    c = Counter(w for ws, r in zip(split, rows) if r[2] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(r[0], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws, r in zip(split, rows)]


def same(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, learn boolean, score string, shard int")
    got = sorted(lm.score(df, F.col("learn"), **kw).collect(), key=str)
    for g, w in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_tokens"])), sorted(brute(rows), key=lambda r: (str(r[0]), r[1])), strict=True):
        assert (g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:4]
        assert g["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert g["score"] < 0 and math.isfinite(g["score"])
    return got


def test_odd_rows(spark):
    rows = [(1, None, True), (2, "", False), (3, "A a b\tb c", True), (None, "a x y", None), (5, "z " * 60000, True), (5, "z " * 60000, True), (6, "é ß É", False)]
    same(spark, rows, most=200)
    same(spark, [(1, "a b", False)])
    same(spark, [])


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1) for r in docs.collect()]
    got = same(spark, rows)
    held = [r for r in got if not r["learnt"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = {r["doc_id"]: r["score"] for r in lm.score(docs.withColumn("learn", F.crc32(F.col("doc_id").cast("string")) % 5 != 1), F.col("learn"), most=300_000).collect()}
    for r in got:  # scores do not depend on how texts are dealt out
        assert again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-6)


def test_probabilities_sum_to_one():
    """Given any text so far, the next token's probabilities sum to one, or a trace less (paths that no word has)."""
    words = [f"w{i}" for i in range(40)]
    train = pa.array([" ".join(words), " ".join(words[:10]), "w1 w2 w3 w1 w2 w3 w4"])
    bits = 40
    t = lm.tokens(train)
    count = Counter(t.h.tolist())
    sums = {}
    for h, c in count.items():
        p = int(h) >> (64 - lm.DEPTH)
        r = sums.setdefault(p, {"n": 0, "v": 0, "once": 0})
        r["n"] += c
        r["v"] += 1
        r["once"] += c == 1
    m = lm._model([], sums)
    learnt = lm.context_keys(t, bits)

    def score(text, end=None):
        x = lm.tokens(pa.array([text]))
        if end is not None:
            x.h[-1] = end
        asked = lm.context_keys(x, bits)
        keys = np.unique(np.concatenate([learnt, asked]))
        met = lm.path_counts(keys, np.array([(learnt == k).sum() for k in keys]))
        met = lm._counts(lm._steps(met))
        return lm.score_tokens(m, x, np.array([count.get(int(h), 0) for h in x.h]), met[:, np.searchsorted(keys, asked)])[0]

    start = "w1 w2 w3 w1"
    texts = [10 ** score(start, h) for h in [*(np.uint64(k) for k in count), np.uint64(12345)]]
    first = 10 ** score("w1 w2 w3", lm.tokens(pa.array(["w1"])).h[0])
    assert 0.99 * first < sum(texts) <= first * (1 + 1e-6)


def test_contexts_grow_with_the_corpus():
    """Every context that occurs has counts of its own, whatever their number, and a repeated text is told from a single one."""
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 60, 50_000, dtype=np.uint64))
    met = lm.path_counts(keys, np.ones(len(keys), np.int64))
    assert (met[:, 0] >= 1).all() and (np.diff(met.astype(int), axis=1) <= 0).all()
    big = lm.path_counts(np.array([5, 6], np.uint64), np.array([1_000_000, 3]))
    assert big[0, 0] < 1 << 16 and big[0, -1] > 60_000


def test_many_short_texts(spark):
    rows = [(i, "a", i % 5 != 1) for i in range(9000)]
    same(spark, rows)


def test_word_hashes_do_not_depend_on_pieces_or_order():
    t = lm.tokenize(pa.array(["aa bb aa ccc " * 50, "bb dddd"]))
    whole = t.hashes()
    assert (t.hashes(piece=7) == whole).all() and whole[0] == whole[2] and len(set(whole.tolist())) == 4
    order = np.random.default_rng(1).permutation(len(whole))
    mixed = lm.Words(t.buf, np.concatenate([t.start[order], t.start[:3]]), np.concatenate([t.end[order], t.end[:3]]), t.first)
    for piece in (5, 1 << 19):
        assert (mixed.hashes(piece=piece) == np.concatenate([whole[order], whole[:3]])).all()
