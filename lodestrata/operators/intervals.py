"""Interval algebra on runs of sparse images: rows (image, start, end, kind, ...), end exclusive; kind 0 hole, 1 zero, 2 data.

Everything is windows and grouped aggregates by image; nothing is collected and no payload is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOLE, ZERO, DATA = 0, 1, 2
PAGE = 4096


def _in_order() -> Window:
    return Window.partitionBy("image").orderBy("start", "end")


def coalesce_runs(runs: DataFrame, *same: str) -> DataFrame:
    """Merge adjacent runs of an image that agree in the columns `same`: (image, start, end, *same)."""
    w = Window.partitionBy("image", *same).orderBy("start", "end")
    marked = runs.withColumn("_new", (F.lag("end").over(w) == F.col("start")).cast("int"))
    marked = marked.withColumn("_island", F.sum(1 - F.coalesce("_new", F.lit(0))).over(w))
    return marked.groupBy("image", *same, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("image", "start", "end", *same)


def normalize_holes(holes: DataFrame, check: bool = True) -> DataFrame:
    """Drop empty holes, refuse those out of bounds (column size) or overlapping, merge adjacent ones."""
    h = holes.where(F.col("end") > F.col("start"))
    if check:
        bad = (F.lag("end").over(_in_order()) > F.col("start")) | (F.col("start") < 0) | (F.col("end") > F.col("size"))
        h = h.withColumn("start", F.when(bad, F.raise_error("holes overlap or lie out of bounds").cast("long")).otherwise(F.col("start")))
    return coalesce_runs(h)


#: Each level of buckets is so many times as wide as the one below; levels.
FACTOR, LEVELS = 64, 7


def lookup_runs(points: DataFrame, runs: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Rows of `points` (image, offset) with the run that holds each, null if none; runs of an image do not overlap.

    An equi-join on buckets of offsets. A run goes to the level whose buckets are at least as wide as it is long, so it lies in
    two of them at most, however long it is; a point is looked up once in each level. An image of very many runs is dealt by
    bucket like any other.
    """
    n = F.col("end") - F.col("start")
    level = F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        level = F.when(n <= bucket * FACTOR**i, i).otherwise(level)
    wide = F.element_at(F.lit([bucket * FACTOR**i for i in range(LEVELS)]).cast("array<bigint>"), F.col("_l") + 1)
    r = runs.where(n > 0).withColumn("_l", level).withColumn("_w", wide)
    r = r.withColumn("_b", F.explode(F.sequence(F.expr("start div _w"), F.expr("(`end` - 1) div _w")))).drop("_w")
    p = points.select("image", "offset").distinct().withColumn("_l", F.explode(F.lit(list(range(LEVELS))))).withColumn("_w", wide)
    p = p.withColumn("_b", F.expr("offset div _w")).drop("_w")
    hit = p.join(r, ["image", "_l", "_b"]).where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))).drop("_l", "_b")
    return points.join(hit, ["image", "offset"], "left")


def hole_at(points: DataFrame, holes: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Each point with the start and end of the hole it lies in, null if it lies in none."""
    return lookup_runs(points, holes.select("image", "start", "end"), bucket)


def next_hole_start(points: DataFrame, holes: DataFrame) -> DataFrame:
    """Each point (image, offset, limit) with the start of the first hole at or after it, the limit at most.

    Points and holes are put in one order by offset and a running minimum is taken from behind: no range join.
    """
    both = points.select("image", "offset", "limit", F.lit(None).cast("long").alias("h")).unionByName(holes.select("image", F.col("start").alias("offset"), F.lit(None).cast("long").alias("limit"), F.col("start").alias("h")))
    w = Window.partitionBy("image").orderBy(F.col("offset").desc()).rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("next_start", F.min("h").over(w)).where("limit is not null").select("image", "offset", F.least("limit", F.coalesce("next_start", "limit")).alias("next_start"))


def run_end(offset: Column, limit: Column, size: Column, end: Column) -> Column:
    """End of the forward run at an offset: not past the run, the limit or the image."""
    return F.least(end, offset + limit, size)


def tile_violations(runs: DataFrame, images: DataFrame) -> DataFrame:
    """Images (image, size) whose runs do not tile [0, size) exactly: rows (image, problems)."""
    w = _in_order()
    r = runs.withColumn("_gap", (F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(0))).cast("int") + (F.col("end") <= F.col("start")).cast("int"))
    g = r.groupBy("image").agg(F.sum("_gap").alias("gaps"), F.max("end").alias("last"))
    out = images.join(g, "image", "left").withColumn("problems", F.coalesce("gaps", F.lit(0)) + (F.coalesce("last", F.lit(0)) != F.col("size")).cast("int"))
    return out.where("problems > 0").select("image", "problems")


def complement(extents: DataFrame, images: DataFrame) -> DataFrame:
    """What the extents leave of [0, size) of each image."""
    edge = images.select("image", F.col("size").alias("start"), F.col("size").alias("end"))
    w = Window.partitionBy("image").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = extents.select("image", "start", "end").unionByName(edge).withColumn("_from", F.coalesce(F.max("end").over(w), F.lit(0)))
    return gaps.where(F.col("start") > F.col("_from")).select("image", F.col("_from").alias("start"), F.col("start").alias("end"))


def overlay(layers: DataFrame) -> DataFrame:
    """Visible runs of layered images: rows (image, layer, start, end, kind, chunk), layer 0 on top.

    The first layer that is no hole at a place decides; zero is opaque; beyond its size a layer shows what is below. Each
    boundary of any layer cuts the image into atoms; runs are dealt to the atoms they cover by one sweep in order, by
    carrying each layer's last run forward, so no range join is needed. Result: (image, start, end, kind, layer, chunk),
    holes and zeros merged, data runs kept by layer and chunk.
    """
    cuts = layers.select("image", F.explode(F.array("start", "end")).alias("at")).distinct()
    w = Window.partitionBy("image").orderBy("at")
    atoms = cuts.withColumn("to", F.lead("at").over(w)).where("`to` is not null")
    ends = layers.select("image", "layer").distinct()
    grid = atoms.join(ends, "image")
    runs = layers.select("image", "layer", F.col("start").alias("at"), F.struct("end", "kind", "chunk").alias("run"))
    carry = Window.partitionBy("image", "layer").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = grid.join(runs, ["image", "layer", "at"], "left").withColumn("run", F.last("run", ignorenulls=True).over(carry))
    seen = seen.where((F.col("run.end") >= F.col("to")) & (F.col("run.kind") != HOLE))
    top = seen.groupBy("image", "at", "to").agg(F.min_by(F.struct("layer", "run.kind", "run.chunk"), "layer").alias("t"))
    full = atoms.join(top, ["image", "at", "to"], "left").select("image", F.col("at").alias("start"), F.col("to").alias("end"), F.coalesce("t.kind", F.lit(HOLE)).alias("kind"), *(F.when(F.col("t.kind") == DATA, F.col(f"t.{c}")).alias(c) for c in ("layer", "chunk")))
    return coalesce_runs(full.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("layer", "chunk")}), "kind", "layer", "chunk")


def clip(runs: DataFrame, offset: Column, length: Column) -> DataFrame:
    """The part of the runs in [offset, offset + length), moved to start at zero."""
    start, end = F.greatest("start", offset), F.least("end", offset + length)
    return runs.withColumns({"_s": start, "_e": end}).where("_e > _s").withColumns({"start": F.col("_s") - offset, "end": F.col("_e") - offset}).drop("_s", "_e")


def append(runs: DataFrame, tail: DataFrame, images: DataFrame) -> DataFrame:
    """Runs with another image's runs behind their size."""
    moved = tail.join(images, "image").withColumns({"start": F.col("start") + F.col("size"), "end": F.col("end") + F.col("size")}).drop("size")
    return runs.unionByName(moved)


def presence_pages(runs: DataFrame, page: int = PAGE) -> DataFrame:
    """Pages of an image that hold at least one byte of data: (image, page)."""
    pages = F.explode(F.sequence(F.expr(f"start div {page}"), F.expr(f"(`end` - 1) div {page}")))
    return runs.where((F.col("kind") == DATA) & (F.col("end") > F.col("start"))).select("image", pages.alias("page")).distinct()


def presence_runs(runs: DataFrame, page: int = PAGE) -> DataFrame:
    """The same pages as runs [first, last] of neighbouring ones, without a row for each page: (image, first, last)."""
    w = Window.partitionBy("image").orderBy("first", "last")
    p = runs.where((F.col("kind") == DATA) & (F.col("end") > F.col("start"))).select("image", F.expr(f"start div {page}").alias("first"), F.expr(f"(`end` - 1) div {page}").alias("last"))
    new = (F.col("first") > F.coalesce(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("bigint")
    p = p.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("image", "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_g")


def extent_stats(runs: DataFrame) -> DataFrame:
    """By image: stored bytes, extents, and whether data reaches the end."""
    data = F.col("kind") == DATA
    return runs.groupBy("image").agg(
        F.sum(F.when(data, F.col("end") - F.col("start")).otherwise(0)).alias("packed_bytes"),
        F.count_if(data).alias("extents"),
        (F.max(F.when(data, F.col("end"))) == F.max("end")).alias("dense_tail"),
    )


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """What the runs a hold outside the runs b of the same image; runs of either side do not overlap each other."""
    marks = [
        df.select("image", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("m")).select("image", "m.at", (F.col("m.d") * (1 - side)).alias("a"), (F.col("m.d") * side).alias("b"))
        for side, df in enumerate((a, b))
    ]
    e = marks[0].unionByName(marks[1]).groupBy("image", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("image").orderBy("at")
    e = e.select("image", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("a").over(w).alias("in_a"), F.sum("b").over(w).alias("in_b"))
    return coalesce_runs(e.where("in_a > 0 and in_b = 0 and `end` > start"))
