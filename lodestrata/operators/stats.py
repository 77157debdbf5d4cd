"""Sketches, latency histograms and windowed counters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Inclusive upper bounds of the latency buckets in nanoseconds, doubling within a decade of three.
BOUNDS = [
    1_000, 2_000, 4_000, 8_000, 16_000, 32_000, 64_000, 128_000, 256_000, 512_000,
    1_000_000, 2_000_000, 4_000_000, 8_000_000, 16_000_000, 32_000_000, 64_000_000, 128_000_000, 256_000_000, 512_000_000,
    1_000_000_000,
]
OVERFLOW = 2 * BOUNDS[-1]


def bucket(ns: Column, bounds: list[int] = BOUNDS) -> Column:
    """Number of a value's bucket, from 0; one more than the last bound's for the overflow."""
    at = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        at = F.when(ns <= bounds[i], F.lit(i)).otherwise(at)
    return at


def histogram(rows: DataFrame, by: list[str], ns: str) -> DataFrame:
    """(by, bucket, n, top): counts by bucket, negatives as zero; top is the largest value of the bucket."""
    v = F.greatest(F.col(ns), F.lit(0))
    return rows.where(F.col(ns).isNotNull()).groupBy(*by, bucket(v).alias("bucket")).agg(F.count("*").alias("n"), F.max(v).alias("top"))


def histogram_percentile(hist: DataFrame, by: list[str], per_mille: int, bounds: list[int] = BOUNDS) -> DataFrame:
    """Interpolated percentile of each histogram, in whole numbers: target = n * p (one at least), in the first bucket
    whose running count reaches it, linear between the bounds, the largest value at most."""
    w = Window.partitionBy(*by).orderBy("bucket")
    h = hist.withColumns({"cum": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(*by)), "peak": F.max("top").over(Window.partitionBy(*by))})
    h = h.withColumn("target", F.greatest(F.expr(f"total * {per_mille} div 1000"), F.lit(1))).where("cum >= target")
    h = h.withColumn("first", F.row_number().over(w)).where("first = 1")
    lows, highs = F.array(*map(F.lit, [0, *bounds])), F.array(*map(F.lit, bounds))
    lo = F.element_at(lows.cast("array<bigint>"), F.col("bucket") + 1)
    hi = F.when(F.col("bucket") < len(bounds), F.try_element_at(highs.cast("array<bigint>"), F.col("bucket") + 1)).otherwise(F.col("peak"))
    h = h.withColumns({"lo": lo, "hi": hi})
    return h.select(*by, F.least(F.expr("lo + (hi - lo) * (target - (cum - n)) div n"), F.col("peak")).alias("value"))


def histogram_delta(snapshots: DataFrame, by: list[str], order: str, bounds: list[int] = BOUNDS) -> DataFrame:
    """Differences of cumulative histograms (by, order, counts array, peak): counts, and the window's largest value: the
    peak if it grew, else the upper bound of the highest bucket that grew."""
    w = Window.partitionBy(*by).orderBy(order)
    s = snapshots.withColumns({"_c": F.lag("counts").over(w), "_p": F.lag("peak").over(w)}).where("_c is not null")
    s = s.withColumn("delta", F.zip_with("counts", "_c", lambda a, b: a - b))
    tops = F.lit([*bounds, OVERFLOW])
    highest = F.array_max(F.transform("delta", lambda d, i: F.when(d > 0, F.element_at(tops.cast("array<bigint>"), i + 1))))
    return s.select(*by, order, "delta", F.when(F.col("peak") > F.col("_p"), F.col("peak")).otherwise(highest).alias("window_max"))


def counter_deltas(snapshots: DataFrame, by: list[str], order: str, counters: list[str], gauges: list[str] = ()) -> DataFrame:
    """Differences of cumulative counters between snapshots; gauges pass through."""
    w = Window.partitionBy(*by).orderBy(order)
    out = snapshots.withColumn("_i", F.row_number().over(w))
    for c in counters:
        out = out.withColumn(c, F.col(c) - F.lag(c).over(w))
    return out.where("_i > 1").select(*by, order, *counters, *gauges)


def window_rates(events: DataFrame, ts: str, width: str, seconds: int) -> DataFrame:
    """By window of time that has events: operations, hits in per mille, bytes, operations a second. Batch and streaming."""
    g = events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("ops"), F.count_if("hit").alias("hits"), F.sum("bytes").alias("bytes"))
    return g.select(F.col("w.start").alias("window_start"), "ops", "hits", F.expr("hits * 1000 div ops").alias("hit_milli"), "bytes", F.round(F.col("ops") / seconds, 6).alias("ops_per_s"))


def hit_share(rows: DataFrame, tier: str, hits: str) -> DataFrame:
    """Each tier's share of all hits, in millionths."""
    g = rows.groupBy(tier).agg(F.sum(hits).alias("hits"))
    return g.withColumn("share_ppm", F.expr("hits * 1000000 div sum(hits) over ()"))  # one row a tier


def cms_counts(touches: DataFrame, key: str, rows: int, width: int, hash_of, cap: int = 15) -> DataFrame:
    """Count-min sketch in long form: (row, idx, n), counters stop at `cap`."""
    idx = F.array(*(F.struct(F.lit(r).alias("row"), hash_of(F.col(key), r, width).alias("idx")) for r in range(rows)))
    t = touches.select(F.explode(idx).alias("c")).groupBy("c.row", "c.idx").agg(F.count("*").alias("n"))
    return t.select("row", "idx", F.least("n", F.lit(cap)).alias("n"))


def cms_estimate(keys: DataFrame, key: str, sketch: DataFrame, rows: int, width: int, hash_of) -> DataFrame:
    """The least counter of each key's cells: (key, estimate)."""
    idx = F.array(*(F.struct(F.lit(r).alias("row"), hash_of(F.col(key), r, width).alias("idx")) for r in range(rows)))
    cells = keys.select(key, F.explode(idx).alias("c")).select(key, "c.row", "c.idx")
    return cells.join(sketch, ["row", "idx"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


#: The seeds of a sketch's rows; low half of the FNV-1a basis, and of its prime.
SEEDS = (0xA5A5A5A5, 0x5A5A5A5A, 0x12345678, 0x87654321)
BASIS_LOW, PRIME_LOW = 0x84222325, 0x1B3


def sketch_cell(key: Column, row: int, width: int) -> Column:
    """The cell of a key (its UTF-8 bytes) in a row of a sketch: seeded FNV-1a modulo the width, a power of two up to 2**32.

    Only the low 32 bits of the hash reach such a cell, and they depend on low bits alone, so whole numbers suffice.
    """
    digits = F.hex(F.encode(key, "utf-8"))
    octets = F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint"))
    octets = F.when(F.length(digits) > 0, octets).otherwise(F.expr("cast(array() as array<bigint>)"))
    start = F.lit(BASIS_LOW ^ SEEDS[row]).cast("bigint")
    return F.aggregate(octets, start, lambda h, b: (h.bitwiseXOR(b) * PRIME_LOW) % (1 << 32)) % width


def rotated_estimate(touches: DataFrame, key: str, order: str, every: int, cap: int = 15) -> DataFrame:
    """Frequency of each key after rotations every so many touches: the active generation's count, plus half the last's.

    Touches are numbered without bringing them into one task; the touch that completes a generation belongs to it.
    """
    from .ranking import global_rank

    t = global_rank(touches.select(key, order), order, "_no").withColumn("gen", F.expr(f"_no div {every}"))
    t = t.join(F.broadcast(touches.agg(F.expr(f"count(*) div {every}").alias("active"))), F.lit(True))  # one row

    def part(ago: int) -> Column:
        return F.least(F.count_if(F.col("gen") == F.col("active") - ago), F.lit(cap))

    return t.groupBy(key).agg((part(0) + F.shiftright(part(1), 1)).alias("estimate"))


def rates_from_counters(rows: DataFrame, by: list[str], ts: str, counter: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Mean and peak of a counter's rate a second between samples, of those at or after `since` and at or before `until`."""
    if since is not None:
        rows = rows.where(F.col(ts) >= since)
    if until is not None:
        rows = rows.where(F.col(ts) <= until)
    w = Window.partitionBy(*by).orderBy(ts, counter)
    d = rows.withColumns({"_d": F.col(counter) - F.lag(counter).over(w), "_t": (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1e6}).where("_t > 0")
    return d.groupBy(*by).agg(F.round(F.avg(F.col("_d") / F.col("_t")), 6).alias("mean_rate"), F.round(F.max(F.col("_d") / F.col("_t")), 6).alias("peak_rate"))


def generations_by_bytes(touches: DataFrame, sketch: str, order: str, size: str, every: int, limit: int) -> DataFrame:
    """`touches` with `gen`, the generation of its sketch that each is counted in.

    A generation ends with the touch that is its `every`-th or brings its written bytes to `limit` or more; both counts then
    begin anew, so one large write ends one generation. That is a fold in order: rows go by sketch and order through one
    task's batches, with two numbers carried along, whatever a sketch's length. Null sizes write nothing.
    """
    fields = touches.schema.names

    def run(batches):
        held, gen, n, written = None, 0, 0, 0
        at, by = fields.index(size), fields.index(sketch)
        for b in batches:
            out = []
            for s, m in zip(b.column(by).to_pylist(), b.column(at).to_pylist()):
                if (s,) != held:
                    held, gen, n, written = (s,), 0, 0, 0
                out.append(gen)
                n, written = n + 1, written + (m or 0)
                if n >= every or written >= limit:
                    gen, n, written = gen + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*fields, "gen"])

    dealt = touches.repartition(sketch).sortWithinPartitions(sketch, order)
    schema = StructType([*touches.schema.fields, StructField("gen", LongType())])
    return dealt.mapInArrow(run, schema)


def turnover_estimate(touches: DataFrame, sketch: str, key: str, order: str, size: str, every: int, limit: int, cap: int = 15) -> DataFrame:
    """Frequency of each key of each sketch after rotations by touches or bytes: the active generation's count, and half
    the last one's. The active generation is the one after the last touch, which may be empty."""
    t = generations_by_bytes(touches.select(sketch, key, order, size), sketch, order, size, every, limit)
    last = t.groupBy(sketch).agg(F.max("gen").alias("g"))
    tail = t.join(last, [sketch]).where("gen = g").groupBy(sketch, "g").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    full = (F.col("n") >= every) | (F.coalesce("b", F.lit(0)) >= limit)
    active = tail.select(sketch, (F.col("g") + full.cast("bigint")).alias("_active"))
    counts = t.groupBy(sketch, key, "gen").agg(F.count("*").alias("n")).join(active, [sketch])

    def part(ago: int) -> Column:
        return F.least(F.sum(F.when(F.col("gen") == F.col("_active") - ago, F.col("n")).otherwise(0)), F.lit(cap))

    return counts.groupBy(sketch, key).agg((part(0) + F.shiftright(part(1), 1)).alias("estimate"))


def window_latency(events: DataFrame, ts: str, width: str, ns: str, seconds: int) -> DataFrame:
    """By window of time that has events: operations, bytes and duplicates a second and in per mille, and the median, 99th
    percentile and maximum of the latency, from its histogram: (window_start, ops, ops_per_s, bytes_per_s, dedup_milli, p50,
    p99, top). Windows without events have no row. `events` has bytes and dedup (whether a write was one)."""
    e = events.withColumn("window_start", F.window(ts, width).start)
    h = histogram(e, ["window_start"], ns)
    parts = [histogram_percentile(h, ["window_start"], m).withColumnRenamed("value", n) for m, n in ((500, "p50"), (990, "p99"))]
    top = h.groupBy("window_start").agg(F.max("top").alias("top"))
    g = e.groupBy("window_start").agg(F.count("*").alias("ops"), F.round(F.count("*") / seconds, 6).alias("ops_per_s"), F.round(F.sum("bytes") / seconds, 6).alias("bytes_per_s"), F.expr("count_if(dedup) * 1000 div count(*)").alias("dedup_milli"))
    return g.join(parts[0], "window_start").join(parts[1], "window_start").join(top, "window_start")


def throughput(rows: DataFrame, by: str, bytes_: str, seconds: float) -> DataFrame:
    """Operations and MiB a second of each group of a run that took `seconds`."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(bytes_).alias("b"))
    return g.select(by, F.round(F.col("n") / seconds, 6).alias("ops_per_s"), F.round(F.col("b") / (seconds * (1 << 20)), 9).alias("mib_per_s"))


def cumulative_points(deltas: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Counter differences as the cumulative points that a metrics receiver takes: (by..., order, total, json)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = deltas.withColumn("total", F.sum(value).over(w))
    return out.select(*by, order, "total", F.to_json(F.struct(*by, order, "total")).alias("json"))
