"""Chunk objects, sealed key tables and manifests: fixed examples and exact round trips."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import objects as ob

SALT = bytes(range(32))


def test_fixed_examples(spark):
    rows = [(1, b"canonical raw payload"), (2, b"\x5a" * 4608), (3, b""), (4, None)]
    df = ob.encode_chunks(spark.createDataFrame(rows, "id long, data binary"), F.lit(SALT))
    got = {r.id: r for r in df.collect()}
    assert bytes(got[1].object).hex() == "0140d94c0e3accdc9a1010a82610e6d8713111cd4eba"
    assert got[1].object_key == "c3c223b605a52155b17d995a2bd00ab802e9c1681f77dfd57cd9481acb48df48"
    assert bytes(got[1].chunk_key).hex() == "77c35b305bd2147369a1bdcb499c9570b16f29e88419d5d7805a856d87039f64"
    assert got[2].object_key == "8341a56c0f45801626123fa9ba465fbaeb6af2790daaeb756466078e51a0d5bc"
    assert bytes(got[3].object) == b"\x01" and got[4].object is None


def test_round_trip_and_ranges(spark):
    rng = random.Random(2)
    data = [rng.randbytes(n) for n in (0, 1, 15, 16, 17, 5000)] + [b"line of text\n" * 3000, bytes(40_000)]
    df = spark.createDataFrame([(i, d, len(d)) for i, d in enumerate(data)], "id long, data binary, size long")
    e = ob.encode_chunks(df, F.lit(SALT)).drop("data")
    for r in ob.decode_chunks(e).collect():
        assert bytes(r.data) == data[r.id]
    asked = e.withColumns({"o": F.expr("size div 3"), "n": F.expr("size div 2")})
    for r in ob.decode_range(asked, F.col("o"), F.col("n")).collect():
        assert bytes(r.data) == data[r.id][r.o : r.o + r.n]
    with pytest.raises(Exception, match="outside its chunk"):
        ob.decode_range(e, F.lit(0), F.col("size") + 1).collect()
    with pytest.raises(Exception, match="another size"):
        ob.decode_chunks(e.withColumn("size", F.col("size") + 1)).collect()


def test_seal(spark):
    df = spark.createDataFrame([(b"k" * 32, b"0123" * 16, b"geometry")], "k binary, t binary, a binary")
    s = df.withColumn("s", ob.seal(F.col("k"), F.col("t"), F.col("a")))
    r = s.withColumn("u", ob.unseal(F.col("k"), F.col("s"), F.col("a"))).first()
    assert r.s[0] == 1 and len(r.s) == 1 + 12 + 64 + 16 and bytes(r.u) == r.t
    assert s.first().s == r.s
    with pytest.raises(Exception):
        s.select(ob.unseal(F.col("k"), F.col("s"), F.lit(b"other"))).collect()


def test_manifests(spark):
    images = spark.createDataFrame([(1, 2, 10_000, 4096, 4096), (2, 1, 0, 4096, 8192), (3, 2, 4096 * 900, 4096, 4096)], "image long, mode int, size long, least long, largest long")
    entries = [(1, 0, 4096, False, "ab" * 32), (1, 8192, 1808, True, None)] + [(3, 4096 * i, 4096, i % 3 == 0, "cd" * 32) for i in range(900)]
    entries = spark.createDataFrame(entries, "image long, start long, size long, is_zero boolean, object_key string")
    holes = spark.createDataFrame([(1, 4096, 8192)], "image long, start long, end long")
    m = ob.encode_manifests(images, entries, holes, ob.seal(F.lit(b"c" * 32), F.concat(F.lit(b"x" * 32)), F.col("aad")))
    made = {r.image: r for r in m.collect()}
    raw = bytes(made[1].manifest)
    assert raw[:5] == b"MANI\x00"
    head = struct.unpack("<BBHQIIIQQIQQ", raw[5:65])
    assert head == (1, 2, 0, 10_000, 2, 4096, 4096, 64 + 112 + 16, 61, 1, 64 + 112, 0)
    assert raw[65:113] == struct.pack("<QII", 0, 4096, 0) + b"\xab" * 32
    assert raw[121:169] == struct.pack("<QII", 8192, 1808, 1) + bytes(32)
    assert raw[177:193] == struct.pack("<QQ", 4096, 4096) and len(raw) == 193 + 61
    assert bytes(made[1].aad)[:4] == struct.pack("<I", 0x4D414E49) and len(made[1].aad) == 64 + 112 + 16
    assert bytes(made[3].manifest)[4] == 1 and len(made[3].manifest) < 900 * 56 * 0.75
    back = {r.image: r for r in ob.decode_manifests(m).withColumn("u", ob.unseal(F.lit(b"c" * 32), F.col("m.sealed"), F.col("aad"))).collect()}
    assert (back[1].m.size, back[1].m.mode, back[1].m.least) == (10_000, 2, 4096) and bytes(back[1].u) == b"x" * 32
    assert [tuple(e) for e in back[1].m.entries] == [(0, 4096, False, "ab" * 32), (8192, 1808, True, None)]
    assert [tuple(h) for h in back[1].m.holes] == [(4096, 8192)]
    assert back[2].m.entries == [] and back[2].m.size == 0 and len(back[3].m.entries) == 900
    one = ob.decode_manifests(m.where("image <> 3"))
    keys = ob.entry_keys(one, F.when(F.col("image") == 1, F.lit(b"q" * 32)).otherwise(F.lit(b""))).orderBy("ordinal").collect()
    assert [(r.image, r.start, r.chunk_key and bytes(r.chunk_key)) for r in keys] == [(1, 0, b"q" * 32), (1, 8192, None)]
    with pytest.raises(Exception, match="another length"):
        ob.entry_keys(one, F.lit(b"q" * 31)).collect()
    for bad, why in ((b"MANX\x00" + raw[5:], "not a manifest"), (raw + b"!", "not a canonical")):
        with pytest.raises(Exception, match=why):
            ob.decode_manifests(spark.createDataFrame([(1, bad)], "image long, manifest binary")).collect()


def test_snappy_length():
    for n in (0, 1, 127, 128, 70_000):
        assert ob._length(pa.compress(b"a" * n, codec="snappy", asbytes=True)) == n
