import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestrata.llm import repeats


def brute(rows, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n int, t string")
    got = repeats.remove_repeats(df, **kw).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    word = [f"w{i}" for i in range(400)]
    base = [rng.choice(word) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " ".join(base)), (4, "x " + " ".join(base[11:60]) + "\ty z"), (5, " ".join(base[:34])), (6, " ".join(base[80:115])), (None, "a " * 100), (8, "short text"), (8, "short text")]
    rows += [(9, " ".join(f"u{i}" for i in range(50)))] * 3 + [(10, "b " * 40000), (11, " ".join(base[30:64]))]
    same(spark, rows)
    same(spark, rows, most=600)  # many slices
    same(spark, [])


def test_spans(spark):
    """Maximal repeats: runs of repeated windows, also where one text ends and the next begins with one."""
    a, b = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(["x"] * 3 + a)), (2, " ".join(a + ["y"])), (3, " ".join(b)), (4, " ".join(["z", *b, "z2", *a[:36]])), (5, " ".join(a[:34]))]
    got = {r.doc_id: [tuple(x) for x in r.repeats] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(3, 50)], 2: [(0, 50)], 3: [(0, 40)], 4: [(1, 40), (42, 36)], 5: []}


def test_table(spark, sf):
    same(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
