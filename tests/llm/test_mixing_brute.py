"""Memberships and rates recomputed without Spark; ties, repeated rows and clashing names."""

import math
import re

import numpy as np
import pytest
import xxhash

from lodestrata.llm import mixing


def bucket(w):
    return (xxhash.xxh64_intdigest(w.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(w.encode(), 42) >> 63 else 0)) % mixing.BUCKETS


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


ROWS = [(1, "good plain Words here"), (2, "bad bad insult words"), (3, "$$$ ## junk %%"), (4, None), (5, ""), (6, "good words\tagain good"), (7, "insult junk words"), (None, "good"), (7, "insult junk words"), (8, "plain words " * 200)]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (6, 1, 0), (8, 1, 0), (99, 1, 0), (None, 1, 0), (4, None, None)]


def brute():
    kind = {i: 2 if q == 0 else t for i, q, t in LABELS if i is not None and q is not None}
    counts = np.full((3, mixing.BUCKETS), 0.5)
    for i, t in ROWS:
        if i in kind:
            for w in words(t):
                counts[kind[i], bucket(w)] += 1
    n = np.bincount(list(kind.values()), minlength=3)
    prior = np.log((n + 1) / (n.sum() + 3))
    like = np.log(counts / counts.sum(axis=1, keepdims=True))
    like -= like.mean(axis=0)
    out = []
    for _, t in ROWS:
        ws = words(t)
        score = prior + sum((like[:, bucket(w)] for w in ws), np.zeros(3)) * min(1, mixing.SOFTNESS / max(len(ws), 1))
        e = np.exp(score - score.max())
        out.append((len(ws), e / e.sum()))
    return out


def test_memberships(spark):
    docs = spark.createDataFrame([(i, t, "s", 3.0) for i, t in ROWS], "doc_id long, text string, tokens string, p0 double")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    model = mixing.fit(docs, labels, mixing.DOMAINS)
    got = mixing.memberships(docs, model).collect()
    for r, (n, p) in zip(got, brute(), strict=True):
        assert r["tokens"] == n
        assert [r["p0"], r["p1"], r["p2"]] == pytest.approx(p.tolist(), rel=1e-4, abs=1e-6)


def test_rates_and_mixed_table(spark):
    docs = spark.createDataFrame([(i, t, "s", 3.0) for i, t in ROWS], "doc_id long, text string, tokens string, rate double")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    targets = {"clean": 0.6, "toxic": 0.25, "junk": 0.15}
    got = mixing.mix(docs, labels, targets=targets).collect()
    want = brute()
    total = sum(n for n, _ in want)
    # the nearest nonnegative rates to one, weighed by tokens, that meet the totals: max(0, 1 + u . p)
    reached = [sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in got) / total for d in mixing.DOMAINS]
    assert reached == pytest.approx(list(targets.values()), rel=1e-3)
    used = [(r, p) for r, (n, p) in zip(got, want, strict=True) if r["rate"] > 0 and n]
    u = np.linalg.lstsq(np.array([p for _, p in used]), np.array([r["rate"] - 1 for r, _ in used]), rcond=None)[0]
    assert [float(1 + u @ p) for _, p in used] == pytest.approx([r["rate"] for r, _ in used], rel=1e-2, abs=1e-2)
    assert all(math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) for r in got)
    table = mixing.mixed(docs, labels, targets=targets)
    assert table.columns == ["doc_id", "text", "tokens", "p_clean", "p_toxic", "p_junk", "rate", "copies"]
    kept = sorted(((r["doc_id"], r["text"], r["copies"]) for r in table.collect()), key=str)
    assert kept == sorted(((i, t, r["copies"]) for (i, t), r in zip(ROWS, got, strict=True) if r["copies"] > 0), key=str)
    assert mixing.mixed(docs.limit(0), labels).count() == 0
