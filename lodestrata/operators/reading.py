"""Reading ranges of images with their bytes, windows of chunks, and filling of holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import DATA, HOLE, ZERO, run_end


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def plan_reads(requests: DataFrame, runs: DataFrame, images: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Pieces of requests (request, image, offset, length): each with the part of every run it covers, in the image.

    Runs tile [0, size) of an image (images: image, size). A request is clipped at the image's end; one that starts there
    or later has no pieces. Runs meet requests by an equi-join on buckets of offsets, and a pair counts in one bucket only:
    that of its first common byte.
    """
    q = requests.join(images, "image").withColumn("_to", F.least(F.col("offset") + F.col("length"), F.col("size"))).where("_to > offset").drop("size")
    q = q.withColumn("_b", F.explode(F.sequence(F.expr(f"offset div {bucket}"), F.expr(f"(_to - 1) div {bucket}"))))
    r = runs.where("`end` > start").withColumn("_b", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(`end` - 1) div {bucket}"))))
    j = q.join(r, ["image", "_b"]).withColumns({"from": F.greatest("start", "offset"), "to": F.least("end", "_to")})
    return j.where(f"`to` > `from` and _b = `from` div {bucket}").drop("_b", "_to")


def read_at(requests: DataFrame, runs: DataFrame, images: DataFrame, payload: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Requests with their bytes: (request, n, data). Holes and zeros read as zeros, the end of an image cuts a read short,
    and a read at or past the end gives no bytes.

    Runs are (image, start, end, kind, chunk, chunk_start), payload is (chunk, data). The plan is made before any payload
    is touched, and each chunk's bytes are sliced before pieces of a request meet, so only what is asked for is shuffled;
    what one request gathers is bounded by its own length. A chunk without payload is an error.
    """
    plan = plan_reads(requests, runs, images, bucket)
    stored = plan.where(F.col("kind") == DATA).select("request", "from", "to", "chunk", "chunk_start").join(payload.select("chunk", "data"), "chunk", "left")
    piece = F.substring(F.col("data"), (F.col("from") - F.col("chunk_start") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    whole = F.octet_length(piece) == F.col("to") - F.col("from")
    piece = F.when(whole, piece).otherwise(F.raise_error("a chunk is missing or too short").cast("binary"))
    parts = stored.select("request", "from", piece.alias("piece"))
    parts = parts.unionByName(plan.where(F.col("kind").isin(HOLE, ZERO)).select("request", "from", zeros(F.col("to") - F.col("from")).alias("piece")))
    g = parts.groupBy("request").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY `from`)").alias("data"))
    out = requests.select("request").join(g, "request", "left").withColumn("data", F.coalesce("data", F.lit(b"")))
    return out.select("request", F.octet_length("data").cast("long").alias("n"), "data")


def chunk_windows(anchors: DataFrame, visible: DataFrame, chunks: DataFrame, most: int, bucket: int = 1 << 20) -> DataFrame:
    """The largest visible range of the same chunk about each anchor (image, offset): (image, offset, layer, chunk, start,
    end). `visible` are runs of the overlay, which keeps what remains of a chunk between upper layers as runs of their own;
    chunks (image, layer, chunk, chunk_start, chunk_end). Of a chunk larger than `most` only the part from the anchor on is
    given. Anchors outside data have no window."""
    from .intervals import lookup_runs

    runs = visible.where(F.col("kind") == DATA).select("image", "start", "end", "layer", "chunk")
    hit = lookup_runs(anchors, runs, bucket).where("start is not null")
    hit = hit.join(chunks, ["image", "layer", "chunk"])
    large = F.col("chunk_end") - F.col("chunk_start") > most
    return hit.select("image", "offset", "layer", "chunk", F.when(large, F.col("offset")).otherwise(F.col("start")).alias("start"), "end")


def forward_run(requests: DataFrame, runs: DataFrame, images: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """The run at each request (image, offset, limit), bounded by the limit: (image, offset, kind, run_end). No row at or
    past the end of the image; a limit of zero is an error."""
    from .intervals import lookup_runs

    checked = F.when(F.col("limit") > 0, F.col("limit")).otherwise(F.raise_error("a limit of zero").cast("bigint"))
    j = lookup_runs(requests.withColumn("limit", checked), runs, bucket).where("start is not null").join(images, "image")
    return j.select("image", "offset", "kind", run_end(F.col("offset"), F.col("limit"), F.col("size"), F.col("end")).alias("run_end"))


def fill_holes(runs: DataFrame, punch: bool, least: int = 4096) -> DataFrame:
    """Runs with what a sink writes for them: data as it is; zeros and, unless `punch`, holes as zeros; with `punch`, holes
    of at least a page are left out of the file, smaller ones are written. Adds write ("data", "zeros", "skip")."""
    hole = F.col("kind") == HOLE
    skip = hole & F.lit(punch) & (F.col("end") - F.col("start") >= least)
    return runs.withColumn("write", F.when(F.col("kind") == DATA, "data").when(skip, "skip").otherwise("zeros"))
