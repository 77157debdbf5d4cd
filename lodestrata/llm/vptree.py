"""Nearest neighbours with vantage-point trees (operator 3).

Rows are dealt to cells by the nearest of a few pivots (a bounded sample of the vectors), and a cell of many rows to shards
by a hash of the id. A task builds the tree of a shard from its rows, which come first, and then answers the queries that
were sent to it batch by batch: vectors move once a round, trees never, and the memory of a task is that of one shard.
Queries go to the shards of their own cell first. The distance of the k-th best found there says which other cells can
hold anything nearer: by the triangle inequality, from the query's distance to the pivot and the least and greatest distance
of the cell's rows to it. Queries are sent to those in a second round.

Within a tree and between cells, what is left out is what has a least distance, times a factor, above the k-th best so far:
with factor one the search is exact, with more it is faster and may miss. Equal vectors of a shard are one entry with as
many of their smallest ids as any query can need, so a very common vector does not deepen a tree or fill a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Vectors in a shard and in a cell, about; pivots at most; queries searched at once; entries in a leaf.
SHARD, CELL, PIVOTS, QUERIES, LEAF = 8192, 2048, 256, 512, 32
#: A least distance times this is held against the k-th best.
FACTOR = 1.25


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, each from the differences, in double precision."""
    return np.sqrt(np.square(a[:, None, :] - b[None, :, :]).sum(axis=2))


def build(ids: np.ndarray, x: np.ndarray, k: int) -> dict:
    """A tree over the distinct rows of x.

    An entry carries its smallest ids, the least first: at most k times each, and 2 k in all, so that k are left whichever
    id a query does not count. `mixed` says that an entry has other ids than its first: if not, a query of that id passes it by.
    """
    order = np.lexsort(ids.reshape(1, -1))
    u, inverse = np.unique(x[order], axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by = np.argsort(inverse, kind="stable")  # ids ascend within an entry
    start = np.searchsorted(inverse[by], np.arange(len(u)))
    stop = np.append(start[1:], len(by))
    ranked = ids[order][by]
    same = np.concatenate([[False], (ranked[1:] == ranked[:-1]) & (inverse[by][1:] == inverse[by][:-1])])
    copy = np.arange(len(by)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))  # which copy of its id
    names = [ranked[s:e][copy[s:e] < k][: 2 * k] for s, e in zip(start.tolist(), stop.tolist())]
    first = np.array([n[0] for n in names], np.int64)
    nodes: list[list] = []  # (vantage entry, inner radius, outer radius, inner node, outer node) or (entries,)
    todo = [(np.arange(len(u)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = at
        inner = None
        if len(rows) > LEAF:
            middle = u[rows].mean(axis=0)
            vantage = int(rows[np.argmax(np.square(u[rows] - middle).sum(axis=1))])
            d = distances(u[vantage : vantage + 1], u[rows])[0]
            inner = d <= np.median(d)
            if inner.all():
                inner = None
        if inner is None:
            nodes.append([rows])
        else:
            nodes.append([vantage, float(d[inner].max()), float(d[~inner].min()), -1, -1])
            todo += [(rows[inner], at, 0), (rows[~inner], at, 1)]
    return {"u": u, "ids": names, "first": first, "mixed": ranked[stop - 1] != first if len(u) else np.zeros(0, bool), "nodes": nodes}


def search(tree: dict, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k nearest entries found that hold another id than its own, by distance and then least id: distances,
    and entries (-1: none). Nothing beyond a query's bound need be found."""
    u, nodes, least, mixed = tree["u"], tree["nodes"], tree["first"], tree["mixed"]
    best = np.full((len(q), k), np.inf)
    entry = np.full((len(q), k), -1, np.int64)

    def visit(at: int, who: np.ndarray) -> None:
        node = nodes[at]
        if len(node) == 1:
            rows = node[0]
            d = distances(q[who], u[rows])
            d[~mixed[rows][None, :] & (least[rows][None, :] == own[who][:, None])] = np.inf
            d = np.concatenate([best[who], d], axis=1)
            e = np.concatenate([entry[who], np.broadcast_to(rows, (len(who), len(rows)))], axis=1)
            e[np.isinf(d)] = -1
            tie = np.where(e >= 0, least[np.maximum(e, 0)], np.iinfo(np.int64).max)
            pick = np.lexsort((tie, d), axis=1)[:, :k]
            best[who], entry[who] = np.take_along_axis(d, pick, 1), np.take_along_axis(e, pick, 1)
            return
        vantage, near, far, inner, outer = node
        d = distances(q[who], u[vantage : vantage + 1])[:, 0]
        low = {inner: np.maximum(d - near, 0), outer: np.maximum(far - d, 0)}
        first = low[inner] <= low[outer]
        for mine, order in ((first, (inner, outer)), (~first, (outer, inner))):
            for child in order:
                ok = mine & (low[child] * factor <= np.minimum(best[who, k - 1], bound[who]))
                if ok.any():
                    visit(child, who[ok])

    if len(u) and len(q):
        visit(0, np.arange(len(q)))
    return best, entry


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _answers(k: int, factor: float):
    """Rows (dim, cell, part, ask, id, v, bound) by shard, a shard's vectors before its queries: the best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for b in batches:
            keys = np.column_stack([np.asarray(b.column(c)).astype(np.int64) for c in ("dim", "cell", "part", "ask")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]) if len(keys) else [0]
            out = [[], [], []]
            for i, j in zip(cuts[:-1], cuts[1:]):
                here, ask = tuple(keys[i, :3].tolist()), keys[i, 3]
                if here != shard:
                    shard, held, tree = here, [], None
                ids, x = np.asarray(b.column("id"))[i:j], _matrix(b.column("v").slice(i, j - i))
                if not ask:
                    held.append((ids, x))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = build(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k)
                    held = held[:1]
                bound = np.asarray(b.column("bound"))[i:j]
                for a in range(0, len(ids), QUERIES):
                    s = slice(a, a + QUERIES)
                    for mine, far, d, e in zip(ids[s].tolist(), bound[s].tolist(), *search(tree, x[s], ids[s], bound[s], k, factor)):
                        found = sorted((c, n) for c, y in zip(d.tolist(), e.tolist()) if y >= 0 and c <= far for n in tree["ids"][y].tolist() if n != mine)[:k]
                        out[0] += [mine] * len(found)
                        out[1] += [n for _, n in found]
                        out[2] += [c for c, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _to_pivots(sent):
    """The distances of vectors to the pivots of their length; a length without pivots has the zero vector as its only one."""

    def near(v: list) -> np.ndarray:
        x = np.array(v, np.float64)
        return distances(x[None, :], sent.value.get(len(v), np.zeros((1, len(v)))))[0]

    return near


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    factor: float = FACTOR,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard: int = SHARD,
    cell: int = CELL,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k nearest rows found, nearest first, ties to the smaller id.

    queries has the same columns as vectors (by default: vectors whose id is divisible by 100). score is the Euclidean
    distance. Rows with a null id take no part, nor do vectors that are null, empty, zero, or hold a null or non-finite
    component. Vectors are compared with those of the same length. A query's own row is told by its id: candidates with
    that id are left out, and a repeated query is asked once (the vector that sorts first); any other repeated row counts
    as often as it occurs. With fewer than k candidates all are returned; other columns are ignored; an empty table gives
    an empty result. Pivots are at most `PIVOTS` vectors (those with the least hash of their id), which only decide what is
    searched together: every row is indexed.
    """

    def usable(df):
        v = F.col(vec_col).cast("array<double>")
        df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))

    base = usable(vectors)
    asked = usable(vectors.where(F.col(id_col) % 100 == 0) if queries is None else queries)
    asked = asked.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("m")).select("id", "m.dim", "m.v")
    many = max(1, min(PIVOTS, base.count() // cell))
    pivots: dict[int, list] = {}
    for r in base.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(many).collect():  # the documented bound
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    sent = vectors.sparkSession.sparkContext.broadcast({d: np.array(x, np.float64) for d, x in pivots.items()})

    def deal(batches):
        near = _to_pivots(sent)
        for b in batches:
            d = [near(v) for v in b.column("v").to_pylist()]
            cells = [int(x.argmin()) for x in d]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32()), pa.array([float(x[c]) for x, c in zip(d, cells)], pa.float64())], [*b.schema.names, "cell", "far"])

    rows = cut(base.select("id", "v", "dim").mapInArrow(deal, "id long, v array<double>, dim int, cell int, far double"))
    cells = cut(rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).withColumn("parts", F.ceil(F.col("n") / shard).cast("int")))
    home = cut(asked.select("id", "v", "dim").mapInArrow(deal, "id long, v array<double>, dim int, cell int, far double"))
    rows = rows.join(cells.select("dim", "cell", "parts"), ["dim", "cell"])
    rows = rows.select("dim", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("ask"), "id", "v", F.lit(0.0).alias("bound"))

    def ask(sent_to: DataFrame) -> DataFrame:
        """The best of each query in the cells it is sent to: (id, v, dim, cell, bound)."""
        q = sent_to.join(cells.select("dim", "cell", "parts"), ["dim", "cell"])
        q = q.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("ask"), "id", "v", "bound")
        both = rows.unionByName(q).repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "ask")
        return both.mapInArrow(_answers(k, factor), "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    first = cut(best(ask(home.select("id", "v", "dim", "cell", F.lit(float("inf")).alias("bound")))).drop("rank"))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).otherwise(float("inf")).alias("bound"))
    known = home.join(kth, home["id"] == kth["query_id"], "left").select("id", "v", "dim", F.col("cell").alias("own"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def spread(batches):
        """Queries with the distance to each pivot of their length."""
        near = _to_pivots(sent)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([near(v).tolist() for v in b.column("v").to_pylist()], pa.list_(pa.float64()))], [*b.schema.names, "to"])

    known = known.mapInArrow(spread, "id long, v array<double>, dim int, own int, bound double, to array<double>")
    reach = known.select("id", "v", "dim", "own", "bound", F.posexplode("to").alias("cell", "d")).join(cells.select("dim", "cell", "lo", "hi"), ["dim", "cell"])
    reach = reach.where((F.col("cell") != F.col("own")) & (F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"), F.lit(0.0)) * factor <= F.col("bound")))
    second = ask(reach.select("id", "v", "dim", "cell", "bound"))
    return best(first.unionByName(second)).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
