import random

from lodestrata.llm import decontaminate as d


def test_items_of_common_words(spark):
    """Items with one to eight rare words among common ones, 20 to 36 % of the words replaced, the rare ones first."""
    rng = random.Random(5)
    common = [f"c{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    docs = [[rng.choice(common) for _ in range(120)] for _ in range(400)]
    items, want = [], set()
    for i in range(40):
        rare = [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(1 + i % 8)]
        item = [*rare, *rng.sample(common, 25 - len(rare))]
        items.append((i, " ".join(item)))
        gone = rng.randrange(5, 10)
        docs[i][60:60] = [f"x{rng.randrange(10**9)}" for _ in range(gone)] + item[gone:]
        share, answer = d._judge([hash(x) for x in item], [hash(x) for x in docs[i][60:85]])
        assert share >= d.PARAPHRASE and answer >= d.ANSWER_SHARE
        want.add((i, i))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    print("found", len(got & want), "of", len(want), "others", len(got - want))
    assert want <= got


def test_large_vocabulary(spark):
    """Over a million distinct words in the documents: paraphrases are found as brute force finds them."""
    rng = random.Random(8)
    docs = [[f"v{rng.randrange(2_000_000)}" for _ in range(500)] for _ in range(4000)]
    assert len({w for t in docs for w in t}) > 1_000_000
    items, want = [], set()
    for i in range(60):
        item = [f"v{rng.randrange(2_000_000)}" for _ in range(rng.randrange(18, 45))]
        items.append((i, " ".join(item)))
        body = len(item) - d.ANSWER
        gone = set(rng.sample(range(body), int(rng.uniform(0.1, 0.36) * len(item))))
        place = rng.randrange(0, 400)
        docs[i * 7][place:place] = [f"x{rng.randrange(10**9)}" if j in gone else w for j, w in enumerate(item)]
        want.add((i * 7, i))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_very_long_text(spark):
    """One text of many tiles, with items across their edges, under one id each of two items of equal text."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    text = [rng.choice(vocab) for _ in range(5 * d.TILE)]
    item, rows = [rng.choice(vocab) for _ in range(30)], []
    other = [rng.choice(vocab) for _ in range(30)]
    text[d.TILE - 11 : d.TILE + 19] = item
    text[3 * d.TILE - 40 : 3 * d.TILE - 10] = [w if i % 5 else "gone" for i, w in enumerate(other)]
    rows = [(1, " ".join(text)), (2, "short"), (3, " ".join(text[: d.TILE - 20]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, " ".join(other))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.word_at for r in d.leaks(df, items).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3)} and got[1, 1] == got[1, 2]
    assert d.TILE - 60 <= got[1, 1] <= d.TILE and 3 * d.TILE - 80 <= got[1, 3] <= 3 * d.TILE
