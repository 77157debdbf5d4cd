from lodestrata.operators import placement as pl
from lodestrata.plans import catalog


def walk(members, key, n):
    """The first n members met from the key's slot on, in a table filled as defined."""
    members, slots = sorted(members), pl.SLOTS
    table, tries, left = {}, [0] * len(members), slots
    first = [pl.fnv1a(m.encode()) % slots for m in members]
    skip = [pl.fnv1a(b"\xff" + m.encode()) % (slots - 1) + 1 for m in members]
    while left:
        for i in range(len(members)):
            if not left:
                break
            while (at := (first[i] + tries[i] * skip[i]) % slots) in table:
                tries[i] += 1
            table[at] = i
            left -= 1
    return [list(dict.fromkeys(members[table[(pl.fnv1a(k.encode()) + j) % slots]] for j in range(200)))[:n] for k in key]


def test_all_suppliers_are_members(spark, tmp_path):
    names = [f"Supplier#{i:05d}" for i in range(1, 61)]
    parts = [(i, f"part {i}") for i in range(400)]
    spark.createDataFrame(list(enumerate(names)), "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["p_partkey"]: list(r["places"]) for r in catalog.QUERIES["placement_locate"](spark, str(tmp_path)).collect()}
    assert [got[i] for i, _ in parts] == walk(names, [t for _, t in parts], 3)
    assert {x for p in got.values() for x in p} == set(names)
