"""Near-duplicates by the shared share of word shingles: what the pipeline's deduplication takes.

Two texts are linked if the Jaccard similarity of their sets of `width`-word shingles is at least `least`.

* texts with the same set are one from the start, whatever their number;
* each set has operator 1's fingerprint, and fingerprints that differ in at most two bits meet in operator 1's grid of
  segments' bit counts, without exception;
* two bits are not enough for 0.8, where about 15 % of the bits differ, so each set is also dealt to `BANDS` cells by the
  minima of `BANDS * ROWS` hash functions; a pair at similarity 0.8 misses all cells with a chance of about 1 in 10,000,
  more similar pairs with less;
* sets that meet in the grid or in cells, in whatever number of steps, form a group. A set is sent once, to its group, and
  compared there with the whole sets, so that links are exact; only a spanning forest of them is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, join_hot
from .simhash import _stars, hashes, keep_first, links, majority

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 30, 6
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    return np.unique(hashes(text, width))


def key_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7)


def cells_of(s: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The set's cells: for each band, a hash of the band and its minima."""
    if not len(s) or not bands:
        return np.zeros(0, np.int64)
    h = (s >> np.uint64(32)).astype(np.uint32)
    a, b = _A[: bands * ROWS], _B[: bands * ROWS]
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 512):
        np.minimum(low, (h[i : i + 512] * a + b).min(axis=1), out=low)
    rows = low.reshape(-1, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)), np.uint64, len(rows)).view(np.int64)


def _sketch(width: int, bands: int):
    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(1)]
            keys = np.fromiter(map(key_of, sets), np.uint64, len(sets)).view(np.int64)
            fps = pa.array([majority(s) if len(s) else None for s in sets], pa.uint64()).view(pa.int64())
            cells = pa.array([cells_of(s, bands) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys), fps, cells], ["id", "key", "fp", "cells"])

    return run


def _whole(width: int):
    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(0)]
            keys = np.fromiter(map(key_of, sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "set"])

    return run


def forest(keys: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with a similarity of at least `least`."""
    at = np.cumsum([0, *map(len, sets)])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.diff(at)
    mine = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    left, edges = np.arange(len(sets)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            fit = np.minimum(sizes[left], sizes[i]) >= least * np.maximum(sizes[left], sizes[i]) - 1e-9
            some = left[fit]
            if not len(some):
                continue
            mark[mine[i]] = 1
            both = np.add.reduceat(mark[np.concatenate([mine[j] for j in some])], np.cumsum([0, *sizes[some][:-1]]))
            mark[mine[i]] = 0
            found = some[both >= least * (sizes[i] + sizes[some] - both) - 1e-9]
            left = np.setdiff1d(left, found, assume_unique=True)
            todo += found.tolist()
            edges += [(keys[i], keys[j]) for j in found.tolist()]
    return edges


def _verify(least: float):
    def run(batches):
        group, keys, sets = None, [], []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def flush():
            e = forest(keys, sets, least) if len(keys) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in e], pa.int64()) for i in (0, 1)], schema=schema)

        for b in batches:
            for g, k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if g != group:
                    yield flush()
                    group, keys, sets = g, [], []
                if not keys or keys[-1] != k:  # rows of the same set follow each other
                    keys.append(k)
                    sets.append(np.frombuffer(s, np.uint64))
        yield flush()

    return run


def _grid_links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that join the sets (key, fp) whose fingerprints differ in one or two bits, in whatever number of steps.

    Vertices are keys and fingerprints: each linked fingerprint is joined to the least key that has it. A key that happens to
    be another set's fingerprint makes a group larger, which the check mends.
    """
    hubs = cut(sets.where("fp is not null").groupBy("fp").agg(F.min("key").alias("hub")))
    near = cut(links(hubs.select("fp")))
    met = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    return near.union(hubs.join(met, "fp").select("hub", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """Rows (doc_id, component_id), one for each row of `docs` whose id is not null.

    component_id is the smallest id that can be reached over links, the document's own included. Null and empty texts
    are linked with each other. Rows with a null id link nothing. `bands` is at most BANDS; with none, only the grid's
    candidates are compared. A very long text is one set of shingles, in memory some ten
    times its size; repeated rows of an id are one document; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).where("id is not null")
    each = cut(src.mapInArrow(_sketch(width, bands), "id long, key long, fp long, cells array<long>"))
    sets = cut(each.groupBy("key").agg(F.min("id").alias("rep"), F.first("fp").alias("fp"), F.first("cells").alias("cells"), F.count("*").alias("n")))
    cells = F.concat("cells", F.array_compact(F.array("fp")))  # sets of one fingerprint meet at it
    cells = sets.select(F.explode(cells).alias("cell"), F.col("key").alias("fp"))
    met = cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_stars, "a long, b long")
    group = cut(connected_components(_grid_links(sets).union(met)).select(F.col("v").alias("key"), F.col("comp").alias("group")))
    reps = sets.join(group, "key").select(F.col("rep").alias("id")).distinct()
    whole = src.join(reps, "id", "left_semi").select("t").mapInArrow(_whole(width), "key long, set binary").join(group, "key").select("group", "key", "set")
    linked = connected_components(whole.repartition("group").sortWithinPartitions("group", "key").mapInArrow(_verify(least), "a long, b long"))
    linked = sets.select("key", "rep").join(linked.withColumnRenamed("v", "key"), "key")
    roots = linked.groupBy("comp").agg(F.min("rep").alias("root"))
    moved = linked.join(roots, "comp").select("key", "root")
    classes = cut(sets.select("key", "rep", "n").join(moved, "key", "left").select("key", "n", F.coalesce("root", "rep").alias("component_id")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    return join_hot(each.select("id", "key"), classes, "key", "n", total).select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """`docs` without all but one document of each class of near_duplicates(): the one with the smallest id.

    Repeated rows of that id are reduced to one. Rows with a null id cannot be told apart and are kept.
    """
    return keep_first(docs, cut(near_duplicates(docs, id_col, text_col, width, least)), id_col)
