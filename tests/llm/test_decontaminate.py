import random
import re

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from lodestrata.llm import decontaminate as d


def plain_words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 4)), st.lists(st.integers(0, 4)))
def test_lcs(a, b):
    assert d.lcs(a, b) == brute_lcs(a, b)


@given(st.lists(st.text(alphabet="aB \t\n.é-", max_size=12), max_size=6))
def test_words(texts):
    w = d.tokenize(pa.array(texts, pa.string()), fold=True, plain=True)
    got = [[bytes(w.buf[s:e]).decode() for s, e in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [plain_words(t) for t in texts]


def test_recall_on_table(spark):
    """Every document that holds an item word for word is found, and nothing else."""
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = set()
    bench = [(r["item_id"], f" {' '.join(plain_words(r['text']))} ") for r in items.collect()]
    for r in docs.select("doc_id", "text").collect():
        t = f" {' '.join(plain_words(r['text']))} "
        want |= {(r["doc_id"], i) for i, x in bench if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, items).collect()}
    assert len(want) > 10 and got == want


def test_paraphrase_and_odd_rows(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    text = [[rng.choice(vocab) for _ in range(150)] for _ in range(60)]
    item = [rng.choice(vocab) for _ in range(30)]
    near = [w for i, w in enumerate(item) if i % 4 or i > 22]
    text[3][40:40] = item
    text[7][90:90] = near
    rows = [(i, " ".join(t)) for i, t in enumerate(text)] + [(60, None), (61, ""), (None, " ".join(item).upper()), (3, " ".join(text[3])), (62, "the " * 40000)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, item_id string, cosine double")
    items = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (4, "the the the the the the the the the the the the")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["kind"]) for r in d.leaks(df, items).collect()]
    assert sorted(got, key=str) == sorted([(3, 1, "verbatim"), (3, 1, "verbatim"), (7, 1, "verbatim" if len(near) >= 24 else "paraphrase"), (None, 1, "verbatim"), (62, 4, "verbatim")], key=str)
    assert d.leaks(df.limit(0), items).collect() == [] and d.leaks(df, items.limit(0)).collect() == []
    kept = {r["doc_id"] for r in d.drop_leaks(df, items).collect()}
    assert 3 not in kept and 7 not in kept and None in kept and 5 in kept
