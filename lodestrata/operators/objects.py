"""Physical forms: encrypted chunk objects, sealed key tables and binary manifests, as column expressions.

AES runs in the JVM. The counter mode of chunk objects is made of it: the blocks of a counter are encrypted one by one, and
the result is the stream that the payload is combined with. Only Snappy and that combination are Arrow functions.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .chunks import convergent_key, hmac_sha256

# Fixed values of the formats.
RAW, SNAPPY = 1, 2
SEALED = 1
NONCE_DOMAIN = b"ktable-nonce/v1\x00"
LEAST_SAVED = 4096
MAGIC = b"MANI"
MAGIC_NUMBER, VERSION, HEADER, ENTRY, HOLE = 0x4D414E49, 1, 64, 56, 16
ZERO_FLAG = 1


@F.pandas_udf(BinaryType())
def snappy(data: pd.Series) -> pd.Series:
    """A Snappy block; null stays null."""
    return data.map(lambda d: None if d is None else pa.compress(d, codec="snappy", asbytes=True))


def _length(block: bytes) -> int:
    n = 0
    for i, b in enumerate(block[:10]):
        n |= (b & 127) << (7 * i)
        if b < 128:
            return n
    raise ValueError("a Snappy block without its length")


@F.pandas_udf(BinaryType())
def unsnappy(block: pd.Series) -> pd.Series:
    return block.map(lambda d: None if d is None else pa.decompress(d, decompressed_size=_length(d), codec="snappy", asbytes=True))


@F.pandas_udf(BinaryType())
def combine(data: pd.Series, stream: pd.Series) -> pd.Series:
    """Bytewise exclusive or; the stream may be longer."""

    def one(d, s):
        if d is None or s is None:
            return None
        return (np.frombuffer(d, np.uint8) ^ np.frombuffer(s, np.uint8, len(d))).tobytes() if d else b""

    return pd.Series([one(d, s) for d, s in zip(data, stream)], dtype=object)


def beneficial(raw: Column, packed: Column) -> Column:
    """Whether the packed form is used: it saves 4 KiB or more and takes at most three quarters, in whole numbers."""
    return (raw - packed >= LEAST_SAVED) & (packed * 4 <= raw * 3)


def _counters(first: Column, blocks: Column) -> Column:
    numbers = F.when(blocks > 0, F.sequence(first, first + blocks - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.unhex(F.array_join(F.transform(numbers, lambda i: F.lpad(F.hex(i), 32, "0")), ""))


def keystream(key: Column, length: Column, first: Column = None) -> Column:
    """At least `length` bytes of the counter mode's stream, from block `first`, for a counter that starts at zero."""
    first = F.lit(0).cast("bigint") if first is None else first.cast("bigint")
    blocks = F.ceil(length / 16.0).cast("bigint")
    return F.aes_encrypt(_counters(first, blocks), key, F.lit("ECB"), F.lit("PKCS"))


def encode_chunks(chunks: DataFrame, salt: Column, data: str = "data") -> DataFrame:
    """Chunks with chunk_key (binary), object and object_key (hex): the physical object of a chunk is a byte of format and
    the encrypted payload, which is the chunk, or its Snappy block where that saves enough. Its key is the hash of salt and
    chunk, so equal chunks under one salt give equal objects: encode one row of each key. Null data give null objects."""
    d = F.col(data)
    c = chunks.withColumns({"chunk_key": F.unhex(convergent_key(salt, d)), "_packed": snappy(d)})
    use = beneficial(F.octet_length(d), F.octet_length("_packed"))
    c = c.withColumns({"_format": F.when(use, F.lit(bytes([SNAPPY]))).otherwise(F.lit(bytes([RAW]))), "_payload": F.when(use, F.col("_packed")).otherwise(d)})
    c = c.withColumn("_stream", keystream(F.col("chunk_key"), F.octet_length("_payload")))
    c = c.withColumn("object", F.concat("_format", combine("_payload", "_stream")))
    return c.withColumn("object_key", F.sha2("object", 256)).drop("_packed", "_format", "_payload", "_stream")


def decode_chunks(objects: DataFrame) -> DataFrame:
    """Objects (object, chunk_key, size, ...) with data; an unknown format or a size that does not fit is an error."""
    form, payload = F.hex(F.substring("object", 1, 1)), F.expr("substring(object, 2)")
    o = objects.withColumn("_plain", combine(payload, keystream(F.col("chunk_key"), F.octet_length("object") - 1)))
    data = F.when(form == "01", F.col("_plain")).when(form == "02", unsnappy(F.when(form == "02", F.col("_plain")))).when(form.isNotNull(), F.raise_error("unknown form of a chunk").cast("binary"))
    o = o.withColumn("data", data)
    fits = F.octet_length("data") == F.col("size")
    return o.withColumn("data", F.when(fits, F.col("data")).when(F.col("data").isNotNull(), F.raise_error("a chunk has another size").cast("binary"))).drop("_plain")


def decode_range(objects: DataFrame, offset: Column, length: Column) -> DataFrame:
    """Objects with the bytes [offset, offset + length) of their chunk: a raw object is decrypted there only, from the block
    of the counter that holds the offset; a Snappy block has to be decoded whole. Ranges outside the chunk are errors."""
    inside = (offset >= 0) & (length >= 0) & (offset + length <= F.col("size"))
    o = objects.withColumns({"_o": F.when(inside, offset.cast("bigint")).otherwise(F.raise_error("a range outside its chunk").cast("bigint")), "_n": length.cast("int")})
    raw = F.hex(F.substring("object", 1, 1)) == "01"
    lead = F.col("_o") % 16
    piece = F.substring(F.col("object"), (F.col("_o") - lead + 2).cast("int"), (F.col("_n") + lead).cast("int"))
    part = combine(F.when(raw, piece), keystream(F.col("chunk_key"), F.col("_n") + lead, F.expr("_o div 16")))
    packed = F.when(~raw, F.expr("substring(object, 2)"))
    whole = unsnappy(combine(packed, F.when(~raw, keystream(F.col("chunk_key"), F.octet_length("object") - 1))))
    o = o.withColumns({"_part": part, "_whole": whole})
    out = F.when(raw, F.substring(F.col("_part"), (lead + 1).cast("int"), F.col("_n"))).otherwise(F.substring(F.col("_whole"), (F.col("_o") + 1).cast("int"), F.col("_n")))
    return o.withColumn("data", out).drop("_o", "_n", "_part", "_whole")


def seal(key: Column, keys: Column, aad: Column) -> Column:
    """A key table under a customer's key (32 bytes): a byte of format, a nonce that follows from key and contents, and the
    authenticated cipher text. `aad` is the geometry that the table belongs to."""
    nonce = F.substring(F.unhex(hmac_sha256(key, F.concat(F.lit(NONCE_DOMAIN), aad, keys))), 1, 12)
    return F.concat(F.lit(bytes([SEALED])), F.aes_encrypt(keys, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad))


def unseal(key: Column, sealed: Column, aad: Column) -> Column:
    """The key table; an error if the format, the key or the geometry is another."""
    good = (F.octet_length(sealed) >= 29) & (F.hex(F.substring(sealed, 1, 1)) == "01")
    body = F.when(good, F.call_function("substring", sealed, F.lit(2))).when(sealed.isNotNull(), F.raise_error("not a sealed key table").cast("binary"))
    return F.aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def _turned(digits: Column) -> Column:
    """Hex digits with their bytes in the opposite order; names its input once, as these expressions nest."""
    return F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")


def _le(n: Column, width: int) -> Column:
    """A number as hex digits, the lowest byte first."""
    return _turned(F.lpad(F.hex(n.cast("bigint")), 2 * width, "0"))


def _number(data: Column, at: Column | int, width: int) -> Column:
    """The number of `width` bytes, lowest first, at an offset of a binary column."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(_turned(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(width)))), 16, 10).cast("bigint")


def geometry(images: DataFrame, entries: DataFrame, holes: DataFrame) -> DataFrame:
    """Images (image, mode, size, least, largest) with the hex digits of their entries and holes in order, and the
    geometry that seals their key table. A manifest is one binary of 64 MiB at most, which bounds what is gathered here."""

    def ordered(digits: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", digits.alias("h")))), lambda x: x["h"]), "")

    flag = F.when(F.col("is_zero"), ZERO_FLAG).otherwise(0)
    body = F.concat(_le(F.col("start"), 8), _le(F.col("size"), 4), _le(flag, 4), F.when(F.col("is_zero"), F.lit("00" * 32)).otherwise(F.col("object_key")), F.lit("00" * 8))
    e = entries.groupBy("image").agg(ordered(body).alias("_e"), F.count("*").alias("_n"))
    h = holes.groupBy("image").agg(ordered(F.concat(_le(F.col("start"), 8), _le(F.col("end") - F.col("start"), 8))).alias("_h"), F.count("*").alias("_m"))
    g = images.join(e, "image", "left").join(h, "image", "left")
    g = g.withColumns({**{c: F.coalesce(c, F.lit("")) for c in ("_e", "_h")}, **{c: F.coalesce(c, F.lit(0)) for c in ("_n", "_m")}})
    head = F.concat(_le(F.lit(VERSION), 1), _le(F.col("mode"), 1), F.lit("0000"), _le(F.col("size"), 8), _le(F.col("_n"), 4), _le(F.col("least"), 4), _le(F.col("largest"), 4))
    aad = F.concat(_le(F.lit(MAGIC_NUMBER), 4), head, F.lit("00" * 16), _le(F.col("_m"), 4), F.lit("00" * 16), "_e", "_h")
    return g.withColumns({"_head": head, "aad": F.unhex(aad)})


def encode_manifests(images: DataFrame, entries: DataFrame, holes: DataFrame, sealed: Column | None = None) -> DataFrame:
    """Manifests of images (image, mode, size, least, largest, ...): (image, aad, manifest).

    Entries are (image, start, size, is_zero, object_key), holes (image, start, end); `sealed` is an expression of the
    sealed key table over the columns of `images` and aad. Check the geometry first (intervals.tile_violations).
    """
    g = geometry(images, entries, holes)
    g = g.withColumn("_s", F.coalesce(sealed, F.lit(b"")) if sealed is not None else F.lit(b""))
    at = F.lit(HEADER) + F.col("_n") * ENTRY
    head = F.concat("_head", _le(at + F.col("_m") * HOLE, 8), _le(F.octet_length("_s"), 8), _le(F.col("_m"), 4), _le(at, 8), F.lit("00" * 8))
    g = g.withColumn("_payload", F.concat(F.unhex(F.concat(head, "_e", "_h")), "_s")).withColumn("_packed", snappy("_payload"))
    use = beneficial(F.octet_length("_payload"), F.octet_length("_packed"))
    form = F.when(use, F.concat(F.lit(MAGIC + b"\x01"), "_packed")).otherwise(F.concat(F.lit(MAGIC + b"\x00"), "_payload"))
    return g.select("image", "aad", form.alias("manifest"))


@F.pandas_udf(BinaryType())
def logical(manifest: pd.Series) -> pd.Series:
    """The logical bytes of manifests, after their magic; another magic, version, encoding or layout is an error."""

    def one(raw):
        if raw is None:
            return None
        if raw[:4] != MAGIC or raw[4:5] not in (b"\x00", b"\x01"):
            raise ValueError("not a manifest")
        body = raw[5:]
        if raw[4] == 1:
            body = pa.decompress(body, decompressed_size=_length(body), codec="snappy", asbytes=True)
            if not (len(body) - len(raw) + 5 >= LEAST_SAVED and (len(raw) - 5) * 4 <= len(body) * 3):
                raise ValueError("not a canonical manifest: it should not be packed")
        if len(body) < HEADER - 4 or body[0] != VERSION:
            raise ValueError("not a canonical manifest: too short, or another version")
        count, keys_at, keys, holes, holes_at = struct.unpack("<12xI8xQQIQ", body[:52])
        if (holes_at, keys_at, len(body) + 4) != (HEADER + count * ENTRY, holes_at + holes * HOLE, keys_at + keys):
            raise ValueError("not a canonical manifest: its tables do not follow each other")
        return body

    return manifest.map(one)


def decode_manifests(manifests: DataFrame) -> DataFrame:
    """Rows (image, manifest) with a struct `m`: mode, size, least, largest, entries, holes (arrays of structs), sealed.

    What is not a canonical manifest is an error.
    """
    d = F.col("_p")
    p = manifests.withColumn("_p", logical("manifest"))
    n, m, keys_at = _number(d, 12, 4), _number(d, 40, 4), _number(d, 24, 8)

    def rows(count: Column, make) -> Column:
        return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), make)).otherwise(F.expr("array()"))

    def entry(i: Column) -> Column:
        at = i * ENTRY + (HEADER - 4)
        zero = (_number(d, at + 12, 4) % 2) == ZERO_FLAG
        key = F.lower(F.hex(F.substring(d, (at + 17).cast("int"), F.lit(32))))
        return F.struct(_number(d, at, 8).alias("start"), _number(d, at + 8, 4).alias("size"), zero.alias("is_zero"), F.when(~zero, key).alias("object_key"))

    def hole(i: Column) -> Column:
        at = n * ENTRY + i * HOLE + (HEADER - 4)
        return F.struct(_number(d, at, 8).alias("start"), (_number(d, at, 8) + _number(d, at + 8, 8)).alias("end"))

    out = F.struct(
        _number(d, 1, 1).alias("mode"), _number(d, 4, 8).alias("size"), _number(d, 16, 4).alias("least"), _number(d, 20, 4).alias("largest"),
        rows(n, entry).alias("entries"), rows(m, hole).alias("holes"), F.substring(d, (keys_at - 3).cast("int"), F.octet_length("_p")).alias("sealed"),
    )
    return p.withColumn("m", F.when(d.isNotNull(), out)).drop("_p")


def entry_keys(decoded: DataFrame, flat: Column) -> DataFrame:
    """Entries of decoded manifests (image, m) with their keys: (image, ordinal, start, size, is_zero, object_key, chunk_key).

    The flat key table has 32 bytes for each entry that is not zero, in their order; zero ones get null, and a table of
    another length is an error. The i-th stored entry meets the i-th key by a join, so it takes time linear in the entries.
    """
    e = decoded.select("image", F.posexplode("m.entries").alias("ordinal", "e")).select("image", "ordinal", "e.*")
    order = Window.partitionBy("image").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_i", F.sum((~F.col("is_zero")).cast("bigint")).over(order))
    zero = e.where("is_zero").drop("_i").withColumn("chunk_key", F.lit(None).cast("binary"))
    k = decoded.select("image", flat.alias("_f")).where(F.octet_length("_f") > 0)
    k = k.select("image", "_f", F.explode(F.sequence(F.lit(1), F.expr("(octet_length(_f) + 31) div 32"))).alias("_i"))
    k = k.select("image", F.col("_i").cast("bigint").alias("_i"), F.substring(F.col("_f"), F.col("_i") * 32 - 31, F.lit(32)).alias("chunk_key"))
    j = e.where("not is_zero").join(k, ["image", "_i"], "full_outer").drop("_i")
    fits = F.col("ordinal").isNotNull() & (F.octet_length("chunk_key") == 32)
    j = j.withColumn("chunk_key", F.when(fits, F.col("chunk_key")).otherwise(F.raise_error("a key table of another length").cast("binary")))
    return j.unionByName(zero)
