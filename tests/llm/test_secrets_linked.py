"""All spans and mended texts against a brute-force version, and texts with very many spans."""

import random
import re
import time

from lodestrata.llm import secrets


def spans(text, scope=secrets.SCOPE):
    def find(pattern, least, group=0, flags=re.A):
        return [(m.start(), m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]

    base = [find(secrets.ASSIGN, 6, 2, re.I | re.A), find(secrets.ACCESS, 20), find(secrets.HEX, 24)]
    ends, bare = find(secrets.ENDPOINT, 0), find(secrets.BARE, 0)
    strong = sum(base, [])
    bare = [] if not base[1] and not ends else [x for x in bare if not any(a < x[1] and x[0] < b for a, b in strong + ends)]

    def beside(x, others):
        return any(abs(o[0] // scope - x[0] // scope) <= 1 for o in others)

    linked = [x for x in bare if beside(x, base[1] + ends)]
    ends = [x for x in ends if beside(x, strong)]
    return [*base, ends, linked]


def joined(parts):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, p in enumerate(parts) for a, b in p))


def mended(text):
    out, at = "", 0
    for a, _, b in sorted((a, k, b) for k, p in enumerate(spans(text)) for a, b in p):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_random_texts(spark):
    rng = random.Random(4)
    parts = ["AKIA" + "Z9" * 9, "secret=abcdef12", "password: 'x12345678'", "f" * 30, "https://a.example/p?q=1", "Zm9vYmFyMTIzNDU2Nzg5MGFiY2Rl", "http://b.example", "plain words", "é😀", "x " * 150, "y" * 400 + " ", "token=deadbeefdeadbeefdeadbeefdeadbeef"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", ", ", ""]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(df)).collect()}
    assert [got[i] for i in range(len(texts))] == [joined(spans(t)) for t in texts]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert [clean[i] for i in range(len(texts))] == [mended(t) for t in texts]


def test_dense_text(spark):
    """A hundred thousand spans in one text: time goes with n log n, not with its square."""
    text = "secret=abcdef12 https://a.example/x " * 50_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = secrets.digest(secrets.scan(df)).first()
    assert row["n_assign"] == 50_000 and row["spans"].count("endpoint") == 50_000
    assert secrets.redact(df).first()["text"] == "[secret] [secret] " * 50_000
    assert time.time() - began < 60
