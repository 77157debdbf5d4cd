"""Small formats where SQL does not check them: frames that do not fit, key laws, histories."""

from collections import Counter

from pyspark.sql import functions as F

from lodestrata.functions import formats as fm


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_frames(spark):
    q = fm.encode_request(F.lit(2), F.lit(3), F.lit(1), F.unhex(F.lit("ab" * 32)), F.lit(b"value"))
    r = one(spark, q.alias("q"), fm.decode_request(q).alias("r"), fm.decode_request(F.substring(q, 1, 40)).alias("short"), fm.decode_request(F.concat(q, F.lit(b"x"))).alias("long"))
    assert bytes(r.q) == (44).to_bytes(4, "little") + bytes([2, 3, 1]) + b"\xab" * 32 + b"value"
    assert (r.r.opcode, r.r.namespace, r.r.flags, bytes(r.r.value)) == (2, 3, 1, b"value") and r.short is None and r.long is None
    s = fm.encode_response(F.lit(2), F.lit("né"), F.lit(b"\x00\x01"))
    r = one(spark, s.alias("s"), fm.decode_response(s).alias("r"))
    assert bytes(r.s) == (13).to_bytes(4, "little") + b"\x02\x00" + (3).to_bytes(2, "little") + "né".encode() + b"\x00\x01"
    assert (r.r.status, r.r.error, bytes(r.r.value)) == (2, "né", b"\x00\x01")


def test_reference_lists(spark):
    for refs, ok in ((["a", "b"], True), (["a", "a"], False), ([" a"], False), (["#c"], False), (["a\r"], False), (["x"] * 1, True)):
        text = one(spark, fm.encode_refs(F.lit(refs)).alias("t")).t
        assert (text is not None) == ok
        if ok:
            assert text == "".join(f"{r}\n" for r in refs) and one(spark, fm.parse_refs(F.lit(text)).alias("r")).r == refs
    for text in ("a", "a\n\n", "\n", "a\r\n", " a\n", "a\na\n"):
        assert one(spark, fm.parse_refs(F.lit(text)).alias("r")).r is None


def test_benchmark_keys(spark):
    rows = spark.range(40_000).select(*(fm.bench_key(F.col("id"), 100, 10, a, 200).alias(a) for a in ("seq", "uniform", "zipf"))).collect()
    for name in ("seq", "uniform", "zipf"):
        n = Counter(r[name] for r in rows)
        cold = sum(v for k, v in n.items() if k >= 100)
        assert 0.18 < cold / 40_000 < 0.22 and set(n) <= set(range(110))
    zipf = Counter(r["zipf"] for r in rows)
    assert zipf[0] > 5 * zipf[9] > 0 and zipf[1] > zipf[4] > zipf[30]


def test_generation_salt(spark):
    import hashlib

    r = one(spark, fm.generation_salt(F.lit("g1"), "salt-v1").alias("s"), fm.generation_salt(F.lit("../g"), "salt-v1").alias("bad"))
    assert bytes(r.s) == hashlib.sha256(b"salt-v1g1").digest() and r.bad is None


def test_checksums_and_identity(spark):
    import hashlib

    from lodestrata.operators import chunks as ch

    rows = [(b"123456789",), (b"",), (None,), (bytes(32),), (b"a" * 1000,)]
    got = [r.c for r in spark.createDataFrame([(None if x is None else bytearray(x),) for (x,) in rows], "d binary").coalesce(1).select(ch.crc32c("d").alias("c")).collect()]
    assert got[:4] == [0xE3069283, 0, None, 0x8A9136AA] and got[4] is not None

    def be(n):
        return n.to_bytes(8, "big")

    payload = hashlib.sha256(b"x/payload\0" + be(10) + be(2) + be(0) + be(3) + be(6) + be(2) + b"abcde").digest()
    tail = hashlib.sha256(b"x/tail\0" + be(4) + b"tail").digest()
    want = hashlib.sha256(b"x/carrier\0" + be(4) + b"name" + be(14) + be(10) + payload + tail).hexdigest()
    p = ch.payload_commitment("x", F.lit(10), F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 3), (6, 8)))), F.lit(b"abcde"))

    def identity(t, total):
        return ch.stream_identity("x", F.lit("name"), F.lit(total).cast("bigint"), F.lit(10).cast("bigint"), p, F.lit(t))

    r = one(spark, identity(b"tail", 14).alias("a"), identity(b"other", 15).alias("b"), identity(b"tail", 15).alias("bad"))
    assert r.a == want and r.b not in (None, want) and r.bad is None
