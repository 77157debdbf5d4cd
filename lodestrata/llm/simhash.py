"""SimHash near-duplicates (operator 1).

Every text gets a 64-bit fingerprint of its 3-word shingles. Fingerprints that differ in at most two bits are linked,
without comparing all pairs:

* a fingerprint is embedded as the vector of its 16 segments' bit counts; flipping a bit moves one count by one, so the
  Manhattan distance of two vectors is a lower bound of their fingerprints' Hamming distance;
* two lattice points at Manhattan distance two or less have a common neighbour at distance one or less from both, so
  each fingerprint is dealt to the grid cells at distance one or less of its own (33 at most), and only fingerprints
  that share a cell are verified exactly;
* a cell with more than `HOT` fingerprints is not compared pair by pair: its members are dealt again, to the 65 words
  that differ from them in at most one bit. All that meet at such a word are within two bits of each other, and any two
  within two bits meet at one, so a star per word has exactly the right components whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, join_hot

#: Fingerprints in a grid cell up to which they are compared with each other.
HOT = 48
SEGMENTS = 16


def hashes(text: bytes, width: int = 3) -> np.ndarray:
    """Hashes of a text's shingles in order, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(sizes + 1) - 1
    start = stop - sizes
    k = min(width, len(words))
    starts, stops = start[: len(words) - k + 1].tolist(), stop[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, stops)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero if there are none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist())


def fingerprint(text: bytes, width: int = 3) -> int:
    return majority(hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (id, fp): one for each row of `docs`, fp the fingerprint as a signed 64-bit number."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return src.mapInArrow(run, "id long, fp long")


def _grid(batches):
    shift = np.arange(0, 64, 4, dtype=np.uint64)
    for b in batches:
        fp = np.asarray(b.column(0)).view(np.uint64)
        counts = np.bitwise_count((fp[:, None] >> shift) & np.uint64(15)).astype(np.uint64)
        key = (counts << shift).sum(axis=1, dtype=np.uint64)
        keys, who = [key], [fp]
        for i in range(SEGMENTS):
            one = np.uint64(1) << shift[i]
            for ok, moved in ((counts[:, i] < 4, key + one), (counts[:, i] > 0, key - one)):
                keys.append(moved[ok])
                who.append(fp[ok])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, who)], ["cell", "fp"])


def _ball(batches):
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for b in batches:
        fp = np.asarray(b.column(0)).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(fp, 65).view(np.int64))], ["cell", "fp"])


def _groups(batches):
    """Runs of equal cell in sorted batches: (fingerprints, whether more of the same cell follow in a later piece)."""
    cell, parts, size = None, [], 0
    for b in batches:
        c, f = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)
        if not len(c):
            continue
        at = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]])
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            if c[i] != cell:
                if size > 1:
                    yield parts
                cell, parts, size = c[i], [], 0
            parts.append(f[i:j])
            size += j - i
    if size > 1:
        yield parts


def _verify(bits: int, hot: int):
    def run(batches):
        a, b, kind = [], [], []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)] + [pa.array(np.array(kind, np.int8))], ["a", "b", "hot"])
            a.clear(), b.clear(), kind.clear()
            return out

        for parts in _groups(batches):
            f = np.unique(np.concatenate(parts))
            if len(f) > hot:  # left to the exact star of one-bit neighbours
                a.extend(f.tolist())
                b.extend(f.tolist())
                kind.extend([1] * len(f))
            elif len(f) > 1:
                near = np.bitwise_count(f[:, None] ^ f) <= bits
                left = set(range(len(f)))
                while left:  # a spanning tree of what is linked here
                    todo = [left.pop()]
                    while todo and left:
                        i = todo.pop()
                        found = [j for j in np.flatnonzero(near[i]).tolist() if j in left]
                        left.difference_update(found)
                        todo += found
                        a.extend([int(f[i])] * len(found))
                        b.extend(f[found].tolist())
                        kind.extend([0] * len(found))
            if len(a) > 1 << 16:
                yield flush()
        yield flush()

    return run


def _stars(batches):
    cell = hub = None
    for x in batches:
        c, f = np.asarray(x.column(0)), np.asarray(x.column(1))
        if not len(c):
            continue
        new = np.concatenate([[cell is None or c[0] != cell], np.diff(c) != 0])
        at = np.maximum.accumulate(np.where(new, np.arange(len(c)), -1))
        hubs = np.where(at >= 0, f[np.maximum(at, 0)], hub if hub is not None else 0)
        cell, hub = c[-1], hubs[-1]
        ok = hubs != f
        yield pa.RecordBatch.from_arrays([pa.array(hubs[ok]), pa.array(f[ok])], ["a", "b"])


def links(fps: DataFrame, bits: int = 2, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of "at most `bits` bits differ".

    `bits` is at most 2: that is what one step on the grid from either side covers.
    """
    if not 0 <= bits <= 2:
        raise ValueError("bits is 0, 1 or 2")
    met = cut(fps.mapInArrow(_grid, "cell long, fp long").repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify(bits, hot), "a long, b long, hot byte"))
    pairs = met.where("hot = 0").select("a", "b")
    if bits < 2:  # a star joins what is two bits apart; with fewer bits ask for the bits of the hub itself
        near = met.where("hot = 1").select(F.col("a").alias("fp")).distinct().mapInArrow(_ball, "cell long, fp long")
        return pairs.union(near.where("cell <> fp").join(fps.select(F.col("fp").alias("cell")), "cell", "left_semi").select(F.col("cell").alias("a"), F.col("fp").alias("b"))) if bits else pairs.limit(0)
    crowd = met.where("hot = 1").select(F.col("a").alias("fp")).distinct()
    stars = crowd.mapInArrow(_ball, "cell long, fp long").repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_stars, "a long, b long")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """Near-duplicate classes: rows (doc_id, fingerprint, component_id), one for each row of `docs`.

    component_id is the smallest id that can be reached over links, the document's own included. Null and empty texts
    have fingerprint zero and are linked like any other; a row with a null id takes part, and its component_id is the
    smallest id that is not null (null if there is none). Repeated rows are returned as often as they occur; other
    columns of `docs`, whatever their names, are ignored. An empty table gives an empty result. A very long text is taken
    whole, in memory some ten times its size; ties at half of the shingles leave a bit unset.
    """
    each = cut(fingerprints(docs, id_col, text_col, width))
    fps = cut(each.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    linked = connected_components(links(fps.select("fp"), bits))
    linked = fps.select("fp", "rep").join(linked.withColumnRenamed("v", "fp"), "fp")
    roots = linked.groupBy("comp").agg(F.min("rep").alias("root"))
    moved = linked.join(roots, "comp").select("fp", "root")
    classes = cut(fps.join(moved, "fp", "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id")))
    total = fps.agg(F.sum("n")).first()[0] or 0
    return join_hot(each, classes, "fp", "n", total).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """`docs` without all but one document of each near-duplicate class: the one with the smallest id.

    Repeated rows of that id are reduced to one. Rows with a null id cannot be told apart and are kept.
    """
    return keep_first(docs, cut(near_duplicates(docs, id_col, text_col, width, bits)), id_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of each class of `found` (doc_id, component_id), and the rows of `docs` with a null id."""
    stay = cut(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times")))
    same = docs[id_col].cast("long") == stay["doc_id"]
    out = docs.join(stay.where("times = 1"), same, "left_semi")
    if stay.where("times > 1").head(1):
        out = out.unionByName(docs.join(stay.where("times > 1"), same, "left_semi").dropDuplicates([id_col]))
    if docs.where(docs[id_col].isNull()).head(1):
        out = out.unionByName(docs.where(docs[id_col].isNull()))
    return out


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
