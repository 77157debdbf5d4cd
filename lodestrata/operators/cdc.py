"""Content-defined chunking of whole segments, and figures of its quality.

A cut falls where a rolling sum of table values of the bytes, each shifted once more a step, has no bit of a mask. Such a
sum only depends on the last 64 bytes, so the sums of all places of a segment come from six vectorised doublings, and only
the first 63 places of a chunk, where the sum is still short, are done again at each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 4096
#: Least, average and largest chunk by default.
SIZES = (128 << 10, 512 << 10, 1 << 20)
# The generator of the table of bytes and of the masks, and their seeds.
STEP, ADD, TABLE_SEED, MASK_SEED = 6364136223846793005, 1442695040888963407, 0x12345678, 0xC0FFEE
WORD = (1 << 64) - 1
#: Places whose sums are held at a time.
BLOCK = 1 << 20


def _series(seed: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        seed = (seed * STEP + ADD) & WORD
        out.append(seed)
    return out


@lru_cache
def table() -> np.ndarray:
    return np.array(_series(TABLE_SEED, 256), dtype=np.uint64)


@lru_cache
def mask(bits: int) -> int:
    """A word with so many bits set, at places from a shuffle that is always the same."""
    if bits <= 0:
        return 0
    places = list(range(64))
    for i, r in zip(range(63, 0, -1), _series(MASK_SEED, 63)):
        j = (r >> 32) % (i + 1)
        places[i], places[j] = places[j], places[i]
    return sum(1 << p for p in places[: min(bits, 64)])


def levels(least: int, average: int, largest: int) -> tuple[int, int]:
    """How many bits the masks before and after the average have more and fewer: from one to ten, by the room there is."""

    def log_up(ratio: int) -> int:
        return min(max((ratio - 1).bit_length() if ratio > 1 else 1, 1), 10)

    before = log_up(10 * (average - least) // average) if least < average else 1
    after = log_up(6 * average // (largest - average)) if largest > average else 1
    return before, after


def masks(least: int, average: int, largest: int) -> tuple[int, int]:
    bits = (average - 1).bit_length()
    before, after = levels(least, average, largest)
    return mask(bits + before), mask(bits - after)


def check_sizes(least: int, average: int, largest: int) -> None:
    if not 0 < least <= average <= largest or any(x % PAGE for x in (least, average, largest)):
        raise ValueError("chunk sizes must be multiples of 4 KiB, the least at most the average, that at most the largest")


def sums(data: np.ndarray) -> np.ndarray:
    """The rolling sum at each place, of at most 64 bytes up to it."""
    out = table()[data]
    for step in (1, 2, 4, 8, 16, 32):
        if step < len(out):
            later = out.copy()
            later[step:] += out[:-step] << np.uint64(step)
            out = later
    return out


def _hits(data: np.ndarray, wanted: tuple[int, int]) -> list[np.ndarray]:
    """Places whose full sums miss each of the masks, block by block; a block starts 63 bytes early."""
    found: list[list[np.ndarray]] = [[], []]
    for at in range(0, len(data), BLOCK):
        lead = min(at, 63)
        s = sums(data[at - lead : at + BLOCK])[lead:]
        for out, m in zip(found, wanted):
            out.append(np.flatnonzero((s & np.uint64(m)) == 0) + at)
    return [np.concatenate(f) if f else np.empty(0, dtype=np.int64) for f in found]


def cuts(data: bytes, least: int, average: int, largest: int) -> list[int]:
    """Ends of the chunks of a segment."""
    b = np.frombuffer(data, dtype=np.uint8)
    both = masks(least, average, largest)
    full = _hits(b, both) if len(b) > least else None
    ends, start = [], 0
    while start < len(b):
        stop = min(len(b), start + largest)
        end = stop
        if stop - start > least:
            first = start + least  # sums start anew here
            early = sums(b[first : min(first + 63, stop)])
            turn = min(start + average, stop)
            for (lo, hi), m, places in zip(((first, turn), (turn, stop)), both, full):
                near = np.flatnonzero((early[max(lo - first, 0) : max(hi - first, 0)] & np.uint64(m)) == 0)
                if len(near):
                    cut = lo + int(near[0])
                else:
                    i = np.searchsorted(places, max(lo, first + 63))
                    if i == len(places) or places[i] >= hi:
                        continue
                    cut = int(places[i])
                size = cut + 1 - start
                end = start + (size - size % PAGE if size - size % PAGE >= least else size)
                break
        ends.append(end)
        start = end
    return ends


def content_defined(segments: DataFrame, sizes: tuple[int, int, int] = SIZES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of segments (image, segment, start, data): (image, segment, ordinal, start, size, data, key, is_zero, *keep).

    A segment is what lies between two holes of an image; each is cut on its own and is one row, so that tasks share them
    out. An empty or null segment has no chunks. Keys and zero flags are native; only cutting is Python, in Arrow batches.
    """
    check_sizes(*sizes)
    src = segments.select("image", "segment", "start", "data", *keep).where(F.octet_length("data") > 0)
    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    extra = "".join(f", `{c}` {fields[c]}" for c in keep)
    schema = f"image {fields['image']}, segment {fields['segment']}, ordinal bigint, start bigint, size bigint, data binary{extra}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data = row.column("data")[0].as_py()
                at = row.column("start")[0].as_py()
                ends = cuts(data, *sizes)
                begins = [0, *ends[:-1]]
                n = len(ends)
                same = pa.array([0] * n)
                cols = {c: row.column(c).take(same) for c in ("image", "segment")}
                cols["ordinal"] = pa.array(range(n), pa.int64())
                cols["start"] = pa.array([at + b for b in begins], pa.int64())
                cols["size"] = pa.array([e - b for b, e in zip(begins, ends)], pa.int64())
                cols["data"] = pa.array([data[b:e] for b, e in zip(begins, ends)], pa.binary())
                cols |= {c: row.column(c).take(same) for c in keep}
                yield pa.RecordBatch.from_pydict(cols)

    from .chunks import is_all_zero

    c = src.mapInArrow(run, schema)
    return c.withColumns({"key": F.sha2("data", 256), "is_zero": is_all_zero(F.col("data"))})


def quality(chunks: DataFrame, by: str, sizes: tuple[int, int, int]) -> DataFrame:
    """By group: chunks, average size and that in per mille of the configured one, quartiles and the 95th percentile (at
    n * p div 100), the middle half's width in per mille of the average, and chunks cut by force and tiny ones (at most 1.1
    of the least size) in per mille."""
    from .chunks import percentiles

    least, average, largest = sizes
    p = percentiles(chunks, [by], "size", {f"p{q}": F.expr(f"n * {q} div 100") for q in (25, 50, 75, 95)})
    g = chunks.groupBy(by).agg(
        F.count("*").alias("chunks"), F.expr("sum(size) div count(*)").alias("avg_size"), F.expr(f"sum(size) * 1000 div (count(*) * {average})").alias("avg_milli"),
        F.expr(f"count_if(size >= {largest}) * 1000 div count(*)").alias("forced_milli"), F.expr(f"count_if(size * 10 <= {least * 11}) * 1000 div count(*)").alias("tiny_milli"),
    )
    return g.join(p, by).withColumn("iqr_milli", F.expr("(p75 - p25) * 1000 div avg_size"))


def kept_percent(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """By group: distinct keys before an edit, those still there after it, and their share in whole per cent."""
    a = before.where(~F.col("is_zero")).select(by, "key").distinct()
    b = after.where(~F.col("is_zero")).select(by, "key", F.lit(1).alias("_k")).distinct()
    g = a.join(b, [by, "key"], "left").groupBy(by).agg(F.count("*").alias("keys"), F.count("_k").alias("kept"))
    return g.withColumn("kept_pct", F.expr("kept * 100 div keys"))
