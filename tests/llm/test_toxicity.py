import numpy as np
import pyarrow as pa

from lodestrata.llm import toxicity as t


def words_in(text):
    u = t.units(pa.array([text]))
    return {u.buf[s:e].tobytes().decode() for s, e in zip(u.start, u.end)}


def test_units():
    assert words_in("You I-D.iot, i d i o t. ok a b") == {"you", "idiot", "ok", "i", "d", "o", "t", "a", "b"}
    assert words_in("") == set() and t.units(pa.array([None], pa.string())).piece.size == 0
    long = "ab" * 60
    assert all(len(w) <= t.PIECE for w in words_in(long)) and words_in(long)
    u = t.units(pa.array(["i d", "i o t", "x"]))  # runs do not cross texts
    assert "idiot" not in {u.buf[s:e].tobytes().decode() for s, e in zip(u.start, u.end)}


def brute_kernel(a, b):
    def phi(w):
        w, out = "^" + w + "$", []
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + 5)):
                    out.append((w[i] + w[j] + w[k], t.DECAY ** (k - i - 2)))
        n = sum(x * x for _, x in out) ** 0.5
        return [(u, x / n) for u, x in out]

    return sum(x * y for u, x in phi(a) for v, y in phi(b) if u == v)


def test_kernel():
    """The decision table is the kernel machine: sums over landmarks of coefficient times kernel."""
    words = ["idiot", "idxiot", "scum", "the", "a", "worthless"]
    for a in words:
        dense = np.zeros(1 << t.TABLE_LOG, np.float32)
        for _, slots, w in t._entries(*t._pack([a.encode()])):
            np.add.at(dense, slots, w)
        got = t.decisions(*t._pack([w.encode() for w in words]), dense, 0.0)
        assert np.allclose(got, [brute_kernel(a, b) for b in words], atol=1e-4)


def test_gapped_insults(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    model = t.train(docs, train)
    held = docs.join(labels.where("crc32(cast(doc_id as string)) % 5 = 0"), "doc_id").toPandas()
    s = model.score(pa.array(held["text"]))
    rank = s.argsort().argsort() + 1
    y = held["toxic"].to_numpy() == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.93
    assert ((s >= 0.5) & ~y).sum() <= 0.03 * (~y).sum() and ((s >= 0.5) & y).sum() >= 0.7 * y.sum()
    plain, masked, spaced, clean = model.score(pa.array(["the of and you are a worthless moron and idiot", "the of and you are a worth-less mo.ron and i*diot", "the of and you are a worthless m o r o n and i d i o t", "the of and you are a the with and this"]))
    assert min(plain, masked, spaced) > 0.5 > clean


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "idiot " * 60000), (4, "a b"), (4, "a b")]
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, score string, t int")
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 7)], "doc_id long, toxic int")
    assert t.train(df, labels) is None
    assert {r["score"] for r in t.score(df, None).collect()} == {0.5}
    assert t.score(df.limit(0), None).collect() == []
    n = len(t.PATTERNS)
    model = t.Model(np.zeros(1 << t.TABLE_LOG, np.float32), -1.0, np.zeros(t.N_FEATURES), np.ones(t.N_FEATURES), np.ones(t.N_FEATURES + 1) * n / n)
    got = t.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
