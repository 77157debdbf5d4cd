"""From runs with bytes to stored objects and manifests, checks of containers, and reading contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cdc
from .chunks import fixed
from .intervals import DATA, HOLE, ZERO
from .objects import encode_chunks
from .reading import zeros


def segments(runs: DataFrame) -> DataFrame:
    """Runs (image, start, end, kind, data) as segments between holes: (image, segment, start, data).

    Neighbouring runs of data and zeros are one segment, zeros as zero bytes; a hole, or a place that no run covers, ends it.
    A segment's bytes come together in one row, so holes say how an image is shared out.
    """
    w = Window.partitionBy("image").orderBy("start")
    r = runs.where((F.col("kind") != HOLE) & (F.col("end") > F.col("start")))
    r = r.withColumn("_new", (F.coalesce(F.lag("end").over(w), F.lit(-1)) != F.col("start")).cast("bigint"))
    r = r.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    body = F.when(F.col("kind") == ZERO, zeros(F.col("end") - F.col("start"))).otherwise(F.col("data"))
    fits = F.octet_length(body) == F.col("end") - F.col("start")
    r = r.withColumn("_b", F.when(fits, body).otherwise(F.raise_error("a run without its bytes").cast("binary")))
    return r.groupBy("image", "segment").agg(F.min("start").alias("start"), F.expr("listagg(_b) WITHIN GROUP (ORDER BY start)").alias("data"))


def ingest(runs: DataFrame, salt: Column, sizes: tuple[int, int, int] | int, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifest entries and the new objects of images given as runs (image, start, end, kind, data).

    Each segment between holes is chunked on its own (sizes: fixed, or least, average and largest). Entries are (image,
    ordinal, start, size, is_zero, object_key), in order of their place; a chunk of zeros has no object. Objects are (key,
    object, object_key, size), one for each different chunk whose object key `stored` does not have.
    """
    s = segments(runs)
    if isinstance(sizes, int):
        c = fixed(s.withColumnRenamed("start", "_at"), "image", F.col("data"), sizes)
        c = c.withColumn("start", F.col("_at") + F.col("start")).select("image", "start", "size", "data", "key", "is_zero")
    else:
        c = cdc.content_defined(s, sizes).select("image", "start", "size", "data", "key", "is_zero")
    once = c.where("not is_zero").groupBy("key").agg(F.any_value("data").alias("data"), F.min("size").alias("size"))
    made = encode_chunks(once, salt).select("key", "object", "object_key", "size")
    order = F.row_number().over(Window.partitionBy("image").orderBy("start")) - 1
    entries = c.select("image", order.cast("bigint").alias("ordinal"), "start", "size", "is_zero", "key").join(made.select("key", "object_key"), "key", "left")
    new = made if stored is None else made.join(stored.select("object_key"), "object_key", "left_anti")
    return entries.select("image", "ordinal", "start", "size", "is_zero", "object_key"), new.select("key", "object", "object_key", "size")


def checked_put(objects: DataFrame, stored: DataFrame, expected: str = "size") -> DataFrame:
    """What happens to objects (generation, key, data, size) that are put: 'exists', 'bad size', 'bad digest' or 'stored'."""
    there = stored.select("generation", "key", F.lit(True).alias("_there")).distinct()
    state = F.when(F.col("_there"), "exists").when(F.octet_length("data") != F.col(expected), "bad size").when(F.sha2("data", 256) != F.col("key"), "bad digest").otherwise("stored")
    return objects.join(there, ["generation", "key"], "left").withColumn("state", state).drop("_there")


def bad_manifests(manifests: DataFrame) -> DataFrame:
    """Manifests (key, manifest) whose bytes are not those of their key."""
    return manifests.where(F.col("manifest").isNull() | (F.sha2("manifest", 256) != F.col("key")))


def cross_check(index: DataFrame, directory: DataFrame, payload: DataFrame) -> DataFrame:
    """Problems (key, problem) of a container: its index (key, start, size, crc), its directory (key, start, size) and what the
    payload holds (key, size, crc) must agree, entries must follow each other without gaps or overlaps, and none may be
    repeated."""
    i = index.groupBy("key").agg(F.count("*").alias("n"), *(F.min(c).alias(f"i_{c}") for c in ("start", "size", "crc")))
    d = directory.groupBy("key").agg(F.count("*").alias("m"), *(F.min(c).alias(f"d_{c}") for c in ("start", "size")))
    p = payload.groupBy("key").agg(*(F.min(c).alias(f"p_{c}") for c in ("size", "crc")))
    j = i.join(d, "key", "full_outer").join(p, "key", "full_outer")
    problem = (
        F.when(F.col("n").isNull(), "not in the index").when(F.col("m").isNull(), "not in the directory").when(F.col("p_size").isNull(), "no payload")
        .when((F.col("n") > 1) | (F.col("m") > 1), "repeated").when((F.col("i_start") != F.col("d_start")) | (F.col("i_size") != F.col("d_size")), "places differ")
        .when(F.col("i_size") != F.col("p_size"), "size differs").when(F.col("i_crc") != F.col("p_crc"), "checksum differs")
    )
    found = j.select("key", problem.alias("problem"))
    # places in order: dealt by range, the end before a range's first entry comes from the range before
    from .ranking import global_rank

    ranked = global_rank(directory.select(F.struct("start", "key").alias("at"), "size").distinct(), "at", "i").select("i", "at.key", "at.start", "size")
    before = ranked.select((F.col("i") + 1).alias("i"), (F.col("start") + F.col("size")).alias("end"))
    gaps = ranked.join(before, "i", "left").select("key", F.when(F.col("start") > F.coalesce("end", F.lit(0)), "gap before").when(F.col("start") < F.coalesce("end", F.lit(0)), "overlap").alias("problem"))
    return found.unionByName(gaps).where("problem is not null")


def dense_reads(reads: DataFrame, size: Column, have: Column) -> DataFrame:
    """Reads (image, seq, offset, length) of a one-pass source, with what each gives: 'backward' if it begins before the end of
    the one before, 'early end' if the source ends before its stated size, else 'ok' and the number of bytes n."""
    w = Window.partitionBy("image").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.least(F.col("offset") + F.col("length"), size)
    r = reads.withColumns({"_before": F.coalesce(F.max(stop).over(w), F.lit(0)), "_stop": stop})
    state = F.when(F.col("offset") < F.col("_before"), "backward").when(F.col("_stop") > have, "early end").otherwise("ok")
    return r.withColumn("state", state).withColumn("n", F.when(F.col("state") == "ok", F.greatest(F.col("_stop") - F.col("offset"), F.lit(0)))).drop("_before", "_stop")


def within_limits(rows: DataFrame, by: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Groups with their records and bytes, and which budget they exceed (null: none)."""
    g = rows.groupBy(by).agg(F.count("*").alias("records"), F.sum(size).alias("bytes"))
    return g.withColumn("exceeds", F.when(F.col("records") > most_rows, "records").when(F.col("bytes") > most_bytes, "bytes"))


def enforce_limits(rows: DataFrame, by: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The same groups; one beyond a budget is an error."""
    g = within_limits(rows, by, size, most_rows, most_bytes)
    stop = F.raise_error(F.concat(F.lit("too many "), "exceeds")).cast("boolean")
    return g.where(F.when(F.col("exceeds").isNull(), True).otherwise(stop)).drop("exceeds")  # a condition cannot be pruned


def manifest_runs(entries: DataFrame, holes: DataFrame) -> DataFrame:
    """Forward runs of manifests: each data entry on its own, neighbouring zero entries as one run, holes as they are:
    (image, start, end, kind, ordinal). Entries are (image, ordinal, start, size, is_zero), holes (image, start, end)."""
    e = entries.select("image", "start", (F.col("start") + F.col("size")).alias("end"), F.when(F.col("is_zero"), ZERO).otherwise(DATA).alias("kind"), F.when(~F.col("is_zero"), F.col("ordinal")).alias("ordinal"))
    w = Window.partitionBy("image").orderBy("start")
    joined = (F.col("kind") == ZERO) & (F.lag("kind").over(w) == ZERO) & (F.lag("end").over(w) == F.col("start"))
    e = e.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("bigint"))
    e = e.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.groupBy("image", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kind").alias("kind"), F.min("ordinal").alias("ordinal")).drop("_g")
    return e.unionByName(holes.select("image", "start", "end", F.lit(HOLE).alias("kind"), F.lit(None).cast("bigint").alias("ordinal")))


def window_of(images: DataFrame, offset: Column, length: Column) -> DataFrame:
    """Images (image, size) with the window [from, to) that is asked for: a length of zero is the rest; an offset at or past the
    end is an error, but for an empty image read from its start."""
    size = F.col("size")
    bad = (offset >= size) & ~((offset == 0) & (length == 0)) | (offset < 0) | (length < 0)
    stop = F.when(length == 0, size).otherwise(F.least(offset + length, size))
    return images.withColumns({"from": F.when(bad, F.raise_error("a window outside its image").cast("bigint")).otherwise(offset.cast("bigint")), "to": stop.cast("bigint")})


def strip_tail(runs: DataFrame, images: DataFrame, keep: Column) -> DataFrame:
    """Runs (image, start, end, ...) of images (image, size) without what lies beyond the first `keep` bytes."""
    r = runs.join(images.select("image", F.least(keep, F.col("size")).alias("_keep")), "image")
    return r.where(F.col("start") < F.col("_keep")).withColumn("end", F.least("end", "_keep")).drop("_keep")
