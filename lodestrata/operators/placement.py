"""Placement of keys on members and erasure-coded shards.

Placement tables are made on the driver: their size is that of the table (a prime), whatever the data; keys meet them by
an equi-join on the slot or an array look-up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a placement table; offset basis and prime of the 64-bit FNV-1a hash.
SLOTS = 65537
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(data: bytes, seed: int = FNV_BASIS) -> int:
    h = seed
    for b in data:
        h = ((h ^ b) * FNV_PRIME) % (1 << 64)
    return h


def fnv1a_column(rows):
    """FNV-1a of a pandas series of strings, a byte at a time over all rows."""
    data = [x.encode() for x in rows]
    size = np.array([len(x) for x in data], np.int64)
    wide = int(size.max()) if len(size) else 0
    m = np.zeros((len(data), wide), np.uint64)
    for i, x in enumerate(data):
        m[i, : len(x)] = np.frombuffer(x, np.uint8)
    h = np.full(len(data), FNV_BASIS, np.uint64)
    for j in range(wide):
        on = size > j
        h[on] = (h[on] ^ m[on, j]) * np.uint64(FNV_PRIME)
    return h


def placement_table(members: list[str], slots: int = SLOTS) -> np.ndarray:
    """Slots by member: members in turn take the next free slot of their own permutation, so that shares differ by one
    at most and a change of members moves few slots."""
    members = sorted(members)
    offset = [fnv1a(m.encode()) % slots for m in members]
    skip = [fnv1a(b"\xff" + m.encode()) % (slots - 1) + 1 for m in members]
    table = np.full(slots, -1, np.int32)
    walk, left = list(offset), slots
    while left:
        for i in range(len(members)):
            at = walk[i]
            while table[at] >= 0:
                at = (at + skip[i]) % slots
            table[at] = i
            walk[i] = (at + skip[i]) % slots
            left -= 1
            if not left:
                break
    return table


def places_by_slot(table: np.ndarray, n: int) -> np.ndarray:
    """For each slot the first n distinct members met from there on: one row a slot, found once for all keys.

    Going back from the last slot, a slot's list is its own member in front of the next slot's list without it; a second
    round lets lists run on over the end.
    """
    if n > len(np.unique(table)):
        raise ValueError("more places than members")
    out = np.empty((len(table), n), np.int32)
    have: list[int] = []
    for again in range(2):
        for s in range(len(table) - 1, -1, -1):
            m = int(table[s])
            have = [m, *(x for x in have if x != m)][:n]
            if again:
                out[s] = have
    return out


def locate(table: np.ndarray, members: list[str], slots: np.ndarray, n: int) -> list[list[str]]:
    """For each slot the first n distinct members met from there on."""
    names = np.array(sorted(members), object)
    return [list(x) for x in names[places_by_slot(table, n)[slots % len(table)]]]


def _field() -> tuple[np.ndarray, np.ndarray]:
    exp, log = np.zeros(512, np.int64), np.zeros(256, np.int64)
    x = 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    exp[255:510] = exp[:255]
    return exp, log


EXP, LOG = _field()


def gf_mul(a, b):
    a, b = np.asarray(a), np.asarray(b)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]])


def gf_invert(m: np.ndarray) -> np.ndarray:
    n = len(m)
    a = np.concatenate([m.astype(np.int64), np.eye(n, dtype=np.int64)], axis=1)
    for c in range(n):
        p = c + int(np.flatnonzero(a[c:, c])[0])
        a[[c, p]] = a[[p, c]]
        a[c] = gf_mul(a[c], EXP[255 - LOG[a[c, c]]])
        for r in range(n):
            if r != c and a[r, c]:
                a[r] ^= gf_mul(a[c], a[r, c])
    return a[:, n:]


def coding_matrix(k: int, m: int) -> np.ndarray:
    """Rows of the k data shards (the identity) and of the m parity shards; any k rows can be inverted."""
    vander = np.array([[1 if c == 0 else (EXP[(LOG[r] * c) % 255] if r else 0) for c in range(k)] for r in range(k + m)])
    return gf_dot(vander, gf_invert(vander[:k]))


def gf_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), b.shape[1]), np.int64)
    for i in range(a.shape[1]):
        out ^= gf_mul(a[:, i : i + 1], b[i : i + 1])
    return out


def rs_encode(data: bytes, k: int = 4, m: int = 1) -> list[bytes]:
    """k + m shards of the data behind its length (four bytes, the lowest first), padded with zeros to k equal parts."""
    raw = len(data).to_bytes(4, "little") + data
    size = -(-len(raw) // k)
    parts = np.frombuffer(raw.ljust(size * k, b"\0"), np.uint8).reshape(k, size)
    return [bytes(x) for x in gf_dot(coding_matrix(k, m), parts).astype(np.uint8)]


def rs_decode(shards: dict[int, bytes], k: int = 4, m: int = 1) -> bytes:
    """The data from any k shards by index."""
    if len(shards) < k:
        raise ValueError("too few shards")
    have = sorted(shards)[:k]
    parts = gf_dot(gf_invert(coding_matrix(k, m)[have]), np.array([np.frombuffer(shards[i], np.uint8) for i in have]))
    raw = parts.astype(np.uint8).tobytes()
    return raw[4 : 4 + int.from_bytes(raw[:4], "little")]


def classify_shards(answers: DataFrame, total: Column) -> DataFrame:
    """Answers (key, peer, idx, outcome): valid, miss (confirmed), invalid (index out of range) or duplicate."""
    good = (F.col("outcome") == "shard") & (F.col("idx") >= 0) & (F.col("idx") < total)
    w = Window.partitionBy("key", "idx", good).orderBy("peer")
    kind = F.when(F.col("outcome") == "miss", "miss").when(~good, "invalid").when(F.row_number().over(w) > 1, "duplicate").otherwise("valid")
    return answers.withColumn("kind", kind)


def repair_plan(classified: DataFrame, total: int) -> DataFrame:
    """Shards to write again: only if as many indices are missing as peers confirm a miss; the i-th goes to the i-th."""
    g = classified.groupBy("key").agg(F.collect_set(F.when(F.col("kind") == "valid", F.col("idx").cast("int"))).alias("have"), F.sort_array(F.collect_set(F.when(F.col("kind") == "miss", F.col("peer")))).alias("peers"))
    g = g.withColumn("missing", F.array_except(F.sequence(F.lit(0), F.lit(total - 1)), "have")).where("size(missing) = size(peers) and size(missing) > 0")
    return g.select("key", F.explode(F.arrays_zip("missing", "peers")).alias("m")).select("key", F.col("m.missing").alias("idx"), F.col("m.peers").alias("peer"))
