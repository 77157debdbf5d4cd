from lodestrata.llm import chat


def brute(rows):
    low = -(1 << 63)
    convs = {}
    for c, o, r, x in rows:
        convs.setdefault(c, []).append((low if o is None else o, r or "", x or ""))
    seqs = {c: tuple((r, x) for _, r, x in sorted(t)) for c, t in convs.items()}
    whole = {}
    for c, s in seqs.items():
        whole.setdefault(s, []).append(c)
    out = []
    for s, cs in whole.items():
        if not any(len(o) > len(s) and o[: len(s)] == s for o in whole):
            best = None if None in cs else min(cs)
            out.append((best, len(s), len(cs), "".join(f"<|{r.replace('<|', '< |')}|>\n{x.replace('<|', '< |')}<|end|>\n" for r, x in s)))
    return sorted(out, key=str)


def same(spark, rows):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, n int, c string")
    assert sorted((tuple(r) for r in chat.render(df).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    a, b = ("user", "hi"), ("assistant", "yo <|x|>")
    rows = [(1, 0, *a), (2, 0, *a), (2, 1, *b), (3, 5, *a), (3, 9, *b), (4, 0, *b), (5, 0, *a), (5, 0, *a), (None, 0, None, None), (6, None, "user", ""), (6, 3, *a), (7, 0, "user", "z " * 90000)]
    same(spark, rows)
    same(spark, [])
    same(spark, [(1, i, "user", str(i)) for i in range(5000)] + [(2, i, "user", str(i)) for i in range(3000)] + [(3, i, "user", str(i)) for i in range(1, 3000)])


def test_table(spark, sf):
    same(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
