"""Chunking, hashing, deduplication and manifests: rows (image, ordinal, start, size, key, is_zero)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A compressed form is used if it saves this many bytes and takes at most this share.
LEAST_SAVED, MOST_SHARE = 4096, 0.75


def fixed(docs: DataFrame, image: str, data: Column, size: int) -> DataFrame:
    """Fixed-size chunks of a binary column; the last may be short. Native: a sequence of offsets and slices."""
    b = docs.select(F.col(image).alias("image"), *[c for c in docs.columns if c not in (image, "image")], data.alias("_d")).where(F.octet_length("_d") > 0)
    b = b.withColumn("start", F.explode(F.sequence(F.lit(0), F.octet_length("_d") - 1, F.lit(size))))
    b = b.withColumn("data", F.substring(F.col("_d"), F.col("start") + 1, F.lit(size)))
    return b.withColumns({"ordinal": F.expr(f"start div {size}"), "size": F.octet_length("data").cast("long"), "key": F.sha2("data", 256), "is_zero": is_all_zero(F.col("data"))}).drop("_d")


def is_all_zero(data: Column) -> Column:
    return F.hex(data) == F.repeat(F.lit("00"), F.octet_length(data))


def convergent_key(salt: Column, data: Column) -> Column:
    return F.sha2(F.concat(salt, data), 256)


def extra_salt(base: Column, extra: Column) -> Column:
    """The base salt, mixed with an extra one unless that is empty."""
    return F.when(F.octet_length(extra) == 0, base).otherwise(F.unhex(F.sha2(F.concat(base, extra), 256)))


def beneficial(raw: Column, encoded: Column) -> Column:
    return (raw - encoded >= LEAST_SAVED) & (encoded <= raw * MOST_SHARE)


def be64(n: Column) -> Column:
    """A number as eight bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC by its definition, for keys of 32 bytes."""
    block = F.rpad(F.hex(key), 128, "0")

    def pad(byte: int) -> Column:
        flip = [format(i ^ (byte >> 4), "X") for i in range(16)], [format(i ^ (byte & 15), "X") for i in range(16)]
        # hex digits at odd places take the high half of the pad byte, those at even places the low half
        digits = F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: F.element_at(F.when(i % 2 == 1, F.lit(flip[0])).otherwise(F.lit(flip[1])), F.conv(F.substring(block, i, F.lit(1)), 16, 10).cast("int") + 1))
        return F.unhex(F.array_join(digits, ""))

    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


#: Fixed value: the reversed polynomial of CRC-32C.
CASTAGNOLI = 0x82F63B78


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of binary values, a byte at a time over all rows that are long enough; null for null."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1).astype(np.uint32)
    have = data.notna().to_numpy()
    rows = [np.frombuffer(x, np.uint8) for x in data[have]]
    size = np.array([len(x) for x in rows], np.int64)
    order = np.argsort(-size, kind="stable")
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    alive = len(order)
    for j in range(int(size.max()) if len(size) else 0):
        while alive and size[order[alive - 1]] <= j:
            alive -= 1
        who = order[:alive]
        byte = np.fromiter((rows[i][j] for i in who.tolist()), np.uint32, alive)
        crc[who] = t[(crc[who] ^ byte) & 0xFF] ^ (crc[who] >> 8)
    out = pd.Series([None] * len(data), dtype="Int64", index=data.index)
    out[have] = (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    return out


def stream_identity(domain: str, name: Column, total: Column, payload_size: Column, payload: Column, tail: Column) -> Column:
    """The identity of a stream: a hash over its name, sizes, the commitment to its payload and the hash of its dense tail.

    As payload and tail are hashed apart, a new tail gives the new identity without the payload. Each hash begins with its
    domain (`domain`, then payload, tail or carrier). Null if the sizes do not fit together.
    """
    tail_hash = F.sha2(F.concat(_domain(domain, "tail"), be64(F.octet_length(tail).cast("bigint")), tail), 256)
    n = F.encode(name, "utf-8")
    whole = F.concat(_domain(domain, "carrier"), be64(F.octet_length(n).cast("bigint")), n, be64(total), be64(payload_size), F.unhex(payload), F.unhex(tail_hash))
    return F.when((payload_size <= total) & (F.octet_length(tail) == total - payload_size), F.sha2(whole, 256))


def payload_commitment(domain: str, size: Column, extents: Column, data: Column) -> Column:
    """The commitment to a payload of `size` bytes: its stored extents (an array of structs start, end) and their bytes."""
    places = F.transform(extents, lambda x: F.concat(F.lpad(F.hex(x["start"].cast("bigint")), 16, "0"), F.lpad(F.hex((x["end"] - x["start"]).cast("bigint")), 16, "0")))
    return F.sha2(F.concat(_domain(domain, "payload"), be64(size.cast("bigint")), be64(F.size(extents).cast("bigint")), F.unhex(F.array_join(places, "")), data), 256)


def _domain(domain: str, part: str) -> Column:
    return F.lit(f"{domain}/{part}".encode() + b"\0")


def first_owner(chunks: DataFrame, order: str = "image") -> DataFrame:
    """Each key with the least image that holds it: (key, owner, size)."""
    return chunks.where(~F.col("is_zero")).groupBy("key").agg(F.min(order).alias("owner"), F.min("size").alias("size"))


def ingest_result(chunks: DataFrame) -> DataFrame:
    """One row: chunks stored (first of a key), deduplicated and zero, and their bytes."""
    w = Window.partitionBy("key").orderBy("image", "ordinal")
    c = chunks.withColumn("_first", (F.row_number().over(w) == 1) & ~F.col("is_zero"))
    return c.agg(
        F.count_if("_first").alias("stored"), F.count_if(~F.col("_first") & ~F.col("is_zero")).alias("dedup"), F.count_if("is_zero").alias("zero"),
        F.sum("size").alias("logical_bytes"), F.sum(F.when(F.col("_first"), F.col("size")).otherwise(0)).alias("stored_bytes"),
    )


def info(chunks: DataFrame, by: str = "image") -> DataFrame:
    return chunks.groupBy(by).agg(
        F.count("*").alias("chunks"), F.count_if("is_zero").alias("zero_chunks"), F.sum("size").alias("bytes"), F.expr("sum(size) div count(*)").alias("avg_chunk"),
    )


def percentiles(rows: DataFrame, by: list[str], value: str, names: dict[str, Column]) -> DataFrame:
    """Values at given indices of the sorted values of each group; an index is an expression of n, the group's size.

    Equal values are counted first, so a window runs over the different values of a group only, and no group's values are
    gathered into one row.
    """
    keys = by or [F.lit(0)]
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    c = c.withColumns({"_to": F.sum("_c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_c").over(w)})
    return c.groupBy(*by).agg(*(F.min(F.when(F.col("_to") > at.cast("long"), F.col("v"))).alias(name) for name, at in names.items()))


def dedup_report(chunks: DataFrame, by: str) -> DataFrame:
    """By group, and for all with a null group: raw and unique chunks and bytes, and bytes per unique byte in thousandths."""
    each = chunks.where(~F.col("is_zero")).groupBy(by, "key").agg(F.count("*").alias("c"), F.sum("size").alias("b"), F.min("size").alias("s"))
    sums = [F.sum("c").alias("raw_chunks"), F.count("*").alias("unique_chunks"), F.sum("b").alias("raw_bytes"), F.sum("s").alias("unique_bytes")]
    total = each.groupBy("key").agg(F.sum("c").alias("c"), F.sum("b").alias("b"), F.min("s").alias("s")).agg(*sums)
    out = each.groupBy(by).agg(*sums).unionByName(total.select(F.lit(None).cast(chunks.schema[by].dataType).alias(by), "*"))
    return out.withColumn("ratio_milli", F.expr("raw_bytes * 1000 div unique_bytes"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: keys and bytes shared, only in a, only in b, and the ratio saved by keeping the union once.

    A key with two sizes is an error. Zero chunks do not count.
    """

    def keys(c: DataFrame, name: str) -> DataFrame:
        g = c.where(~F.col("is_zero")).groupBy("key").agg(F.min("size").alias(name), F.max("size").alias("_m"))
        return g.select("key", F.when(F.col(name) == F.col("_m"), F.col(name)).otherwise(F.raise_error("a key has two sizes").cast("long")).alias(name))

    j = keys(a, "sa").join(keys(b, "sb"), "key", "full_outer")
    j = j.withColumn("sa", F.when(F.col("sa") != F.col("sb"), F.raise_error("a key has two sizes").cast("long")).otherwise(F.col("sa")))
    in_a, in_b = F.col("sa").isNotNull(), F.col("sb").isNotNull()

    def part(cond: Column, name: str) -> list[Column]:
        return [F.count_if(cond).alias(name), F.coalesce(F.sum(F.when(cond, F.coalesce("sa", "sb"))), F.lit(0)).alias(f"{name}_bytes")]

    out = j.agg(*part(in_a & in_b, "shared"), *part(in_a & ~in_b, "only_a"), *part(~in_a & in_b, "only_b"))
    n = 2 * F.col("shared") + F.col("only_a") + F.col("only_b")
    return out.withColumn("dedup_ratio", F.when(n == 0, 0.0).otherwise(F.round(F.col("shared") / n, 6)))


def pairwise(chunks: DataFrame, by: str) -> DataFrame:
    """For groups i < j: keys in both, and that in whole per cent of the smaller group's keys.

    Keys that the same groups hold are counted together before pairs are made, so a pair is made once for each different set
    of groups, not for each key.
    """
    k = chunks.where(~F.col("is_zero")).select(F.col(by).alias("g"), "key").distinct()
    n = k.groupBy("g").count()
    sets = k.groupBy("key").agg(F.sort_array(F.collect_set("g")).alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("size(s) > 1")
    p = sets.select("c", "s", F.posexplode("s").alias("a", "i")).select("c", "i", F.explode(F.expr("slice(s, a + 2, size(s))")).alias("j"))
    p = p.groupBy("i", "j").agg(F.sum("c").alias("shared"))
    p = p.join(n.select(F.col("g").alias("i"), F.col("count").alias("ni")), "i").join(n.select(F.col("g").alias("j"), F.col("count").alias("nj")), "j")
    return p.select("i", "j", "shared", F.expr("shared * 100 div least(ni, nj)").alias("pct_of_smaller"), F.round(F.col("shared") / (F.col("ni") + F.col("nj") - F.col("shared")), 6).alias("jaccard"))


def incremental(chunks: DataFrame, by: str) -> DataFrame:
    """In order of groups: keys that no earlier group had, their running sum, and their share of the group's in per cent."""
    k = chunks.where(~F.col("is_zero")).select(F.col(by).alias("g"), "key").distinct()
    own = k.withColumn("first", F.min("g").over(Window.partitionBy("key")))
    g = own.groupBy("g").agg(F.count("*").alias("keys"), F.count_if(F.col("first") == F.col("g")).alias("new_keys"))
    running = F.sum("new_keys").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0))  # one row a group
    return g.select("g", "keys", "new_keys", running.alias("cumulative"), F.expr("new_keys * 100 div keys").alias("marginal_pct"))


def block_plan(blocks: DataFrame) -> DataFrame:
    """Physical numbers of blocks (path, ordinal, key): equal contents share the number of their first place in order."""
    first = blocks.groupBy("key").agg(F.min(F.struct("path", "ordinal")).alias("at"))
    from .ranking import global_rank

    return blocks.join(global_rank(first, "at", "physical"), "key").select("path", "ordinal", "physical")
