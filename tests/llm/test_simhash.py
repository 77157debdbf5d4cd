import re

import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import simhash


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=2):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (None, "one two"), (7, "a b c d"), (7, "a b c d"), (9, "é É ß x y"), (10, "w " * 30000)]


def same(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "id": F.lit(2)})
    got = sorted((tuple(r) for r in simhash.near_duplicates(df, **kw).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(spark):
    same(spark, ODD)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_one(df).collect() == []


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(spark, rows)


def test_links_of_crowded_cells(spark):
    """Fingerprints around one centre: cells over the limit must give the same components as pairs do."""
    fps = sorted({(0xF0F0 ^ (1 << i) ^ (1 << j)) for i in range(0, 64, 3) for j in range(64)} | {5 << 40, 7 << 40})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    from lodestrata.llm.common import connected_components

    for hot in (4, 48, 10**6):
        got = {r["v"]: r["comp"] for r in connected_components(simhash.links(df, 2, hot)).collect()}
        near = {x: [y for y in fps if y != x and bin(x ^ y).count("1") <= 2] for x in fps}
        seen, classes = set(), []
        for x in fps:
            if x not in seen and near[x]:
                todo, cls = [x], {x}
                while todo:
                    new = set(near[todo.pop()]) - cls
                    cls |= new
                    todo += new
                seen |= cls
                classes.append({y - (1 << 64) if y >> 63 else y for y in cls})
        by = {}
        for v, c in got.items():
            by.setdefault(c, set()).add(v)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, classes))


def test_keep_one(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    got = sorted((r["doc_id"] for r in simhash.keep_one(df).collect()), key=str)
    assert got == sorted([1, 4, 7, 9, 10, None], key=str)
