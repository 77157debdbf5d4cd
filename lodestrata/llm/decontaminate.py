"""Benchmark decontamination by latent semantic retrieval (operator 5).

1. Document frequencies of the items' words over all documents (one partial vector for each task, summed). Only words
   that some item has can be met, so the vocabulary is that of the benchmark, exact, whatever words the documents hold.
2. Randomised SVD of the TF-IDF matrix A of all passages over that vocabulary: one pass sums Z = A'(A G) for a random G, and
   A'A is close to Z inv(G'Z) Z', whose eigenvectors and singular values are the latent directions. Coordinates are divided
   by the singular values, so that what all passages of a language share does not drown what sets one apart. Only a table
   of the items' words x `RANK` reaches the driver.
3. Every passage of every document, as windows of small blocks, is compared by cosine with the benchmark items in the
   latent space. Sums over windows are sums over blocks, so a block is projected once.
4. Candidates are checked exactly: the longest common subsequence of the item's words and of the words about the window,
   and the same for the item's answer (its last words). The verbatim and the paraphrase rule are in `leaks`.

Items are taken in blocks of at most `ITEMS` different texts, so that what goes to the executors at once is bounded. Texts
are taken in tiles of at most `TILE` words that overlap by more than any place, so that memory does not go with their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .kernels import mix, slices, tokenize

RANK = 128
BLOCK = 12
#: Words in more than this share of the documents have no weight.
STOP = 0.05
#: Words of a text that are searched at once, a multiple of BLOCK.
TILE = 1 << 14
TILE -= TILE % BLOCK
#: Bytes of text that a kernel takes at once.
SLICE = 192 << 10
ITEMS = 4096
#: Words of a passage of the matrix A.
PASSAGE = 32
#: Least cosine of a candidate, least share of an item's words in common for a verbatim leak, and for a paraphrase.
COSINE, VERBATIM, PARAPHRASE, ANSWER_SHARE = 0.4, 0.8, 0.6, 0.8
#: Items with fewer words of weight are found by these words, and by their distinct words of any weight.
FEW = 9
#: Items that are held against a slice's distinct words at once.
TYPED = 128
#: Words at the end of an item that count as its answer.
ANSWER = 6


class Lexicon:
    """The items' words, by hash: known ones are numbered, all others have the number after the last."""

    def __init__(self, hashes: np.ndarray):
        self.known = np.unique(hashes)
        self._table = None

    def __getstate__(self):
        return {"known": self.known, "_table": None}

    def __len__(self):
        return len(self.known) + 1

    def ids(self, h: np.ndarray) -> np.ndarray:
        n = len(self.known)
        if not n:
            return np.zeros(len(h), np.int64)
        if self._table is None:  # the last word of each of 2**20 ranges of hashes; a range rarely has two
            self._table = np.full(1 << 20, -1, np.int32)
            self._table[(self.known >> np.uint64(44)).astype(np.int64)] = np.arange(n)
        at = self._table[(h >> np.uint64(44)).astype(np.int64)].astype(np.int64)
        wrong = np.flatnonzero((at >= 0) & (self.known[at] != h))
        at[at < 0] = n
        if len(wrong):
            p = np.minimum(np.searchsorted(self.known, h[wrong]), n - 1)
            at[wrong] = np.where(self.known[p] == h[wrong], p, n)
        return at


def _partial(docs: DataFrame, kernel, rows: int, width: int) -> np.ndarray:
    """Sum over tasks of the array of rows x width that `kernel` fills."""

    kind = np.float32 if width > 1 else np.float64

    def run(batches):
        total = np.zeros((rows, width), kind)
        for b in batches:
            for i, j in slices(b.column(0), SLICE):
                kernel(total, tokenize(b.column(0).slice(i, j - i), fold=True, plain=True))
        step = max(1, (1 << 18) // (8 * width))  # rows of the table in a record
        lot = TaskContext.get().partitionId() // 64  # sums of sums: no group grows with the number of tasks
        for i in range(0, rows, step):
            if total[i : i + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([lot], pa.int32()), pa.array([total[i : i + step].tobytes()], pa.binary())], ["at", "lot", "part"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for t in batches:
            for x in t.column("part"):
                v = np.frombuffer(x.as_py(), kind)
                total = v.astype(np.float64) if total is None else total + v
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.astype(kind).tobytes()], pa.binary())], ["at", "part"])

    parts = docs.mapInArrow(run, "at long, lot int, part binary").groupBy("at", "lot").applyInArrow(add, "at long, part binary")
    out = np.zeros((rows, width))
    for r in parts.groupBy("at").applyInArrow(add, "at long, part binary").collect():  # rows x width numbers, whatever the input
        v = np.frombuffer(r["part"], kind).reshape(-1, width)
        out[r["at"] : r["at"] + len(v)] = v
    return out


@dataclass
class Space:
    """The latent space: weights of the items' words, and their latent coordinates (weights included). Others have none."""

    words: Lexicon
    idf: np.ndarray
    basis: np.ndarray


def _run_sums(v: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of v over runs of equal labels, by adding neighbours in halving rounds (reduceat is slow on rows)."""
    while len(label):
        new = np.concatenate([[True], label[1:] != label[:-1]])
        if new.all():
            break
        here = np.arange(len(label))
        even = (here - np.maximum.accumulate(np.where(new, here, 0))) & 1 == 0
        keep = np.flatnonzero(even)
        pair = np.flatnonzero(~np.append(even, True)[keep + 1])
        out = v[keep]
        out[pair] += v[keep[pair] + 1]
        v, label = out, label[keep]
    return v, label


def _passage_sums(rows: np.ndarray, ids: np.ndarray, idf: np.ndarray, first: np.ndarray, size: int):
    """Sums of rows[ids] over blocks of `size` words that don't cross texts: sums; first word and text of each block; and
    the words that have weight, with the block of each."""
    counts = np.diff(first)
    n = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), n)
    at = first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * size
    keep = np.flatnonzero(idf[ids] > 0)
    block = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ids))))[keep]
    sums = np.zeros((len(at), rows.shape[1]), np.float32)
    if len(keep):
        part, where = _run_sums(rows[ids[keep]], block)
        sums[where] = part
    return sums, at, text, keep, block


def build_space(docs: DataFrame, hashes: np.ndarray, rank: int = RANK, seed: int = 7) -> Space:
    """Fit the latent space of the words with these hashes on all texts of the only column of `docs`."""
    lex = Lexicon(hashes)
    dims = len(lex)

    def count(total, w):
        ids = lex.ids(w.hashes())
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        seen = np.unique(doc[ids < dims - 1] * dims + ids[ids < dims - 1]) % dims
        total[:dims, 0] += np.bincount(seen, minlength=dims)
        total[dims, 0] += len(w.first) - 1

    df = _partial(docs, count, dims + 1, 1)[:, 0]
    n = max(df[dims], 1.0)
    idf = np.where(df[:dims] > STOP * n + 5, 0, np.log((n + 1) / (df[:dims] + 1))).astype(np.float32)
    idf[-1] = 0
    g0 = np.random.default_rng(seed).standard_normal((dims, rank))
    g = g0.astype(np.float32) * idf[:, None]

    def sketch(total, w):
        ids = lex.ids(w.hashes())
        if not len(ids):
            return
        rows, _, _, keep, here = _passage_sums(g, ids, idf, w.first, PASSAGE)
        if not len(keep):
            return
        ids = ids[keep]
        order = np.argsort(ids.astype(np.uint16) if dims < 1 << 16 else ids, kind="stable")  # sums by word, as runs of the sorted words
        ids, here = ids[order], here[order]
        part, where = _run_sums(rows[here], ids)
        total[where] += part * idf[where, None]

    z = _partial(docs, sketch, dims, rank)
    noise = 1e-6 * max(np.linalg.norm(z), 1e-6) / np.sqrt(dims)
    z = z + noise * g0
    core = g0.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = z @ (vectors / np.sqrt(np.maximum(values, max(values.max(), 1e-30) * 1e-9)))
    u, sigma, _ = np.linalg.svd(half, full_matrices=False)
    return Space(lex, idf, (u / np.maximum(sigma, sigma.max() * 1e-6) * idf[:, None] * sigma.max()).astype(np.float32))


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel steps over b."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _judge(item: list[int], words: list[int]) -> tuple[float, float]:
    """Shares of the item and of its answer that the words hold as a subsequence; the answer's within a near stretch."""
    share = lcs(item, words) / len(item)
    answer = item[-ANSWER:]
    return share, lcs(answer, words) / len(answer)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE) -> DataFrame:
    """Rows (doc_id, item_id, word_at, cosine, lcs_share, answer_share, kind): the best place of each item that leaks into
    each document; kind is 'verbatim' (at least VERBATIM of the item's words, in order) or 'paraphrase' (at least
    PARAPHRASE of them, and ANSWER_SHARE of its answer).

    Words are runs without ASCII white space or punctuation, with A-Z in lower case. Null and empty texts leak nothing and items without
    words are not looked for; a repeated document or item is reported as often as it occurs (items with one id and text:
    once). Ties between places go to the first. A null id is carried as null. Other columns are ignored. Very long texts are
    searched in tiles; empty tables of either kind give an empty result.
    """
    src = docs.select(F.col(text_col).alias("t"), F.col(id_col).cast("long").alias("id"))
    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("t")).where("t is not null").distinct().withColumn("k", F.sha2("t", 256))
    want = named.select("k", "t").distinct()
    blocks = max(1, -(-want.count() // ITEMS))
    out = None
    for i in range(blocks):  # a block has ITEMS different texts on average: bounded, however many ids they have
        block = want.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == i).orderBy("k").collect()
        found = _search(src, [r["k"] for r in block], [r["t"] for r in block], cosine)
        out = found if out is None else out.unionByName(found)
    out = out.join(named.select("k", "item_id"), "k")
    return out.select("doc_id", "item_id", "word_at", "cosine", "lcs_share", "answer_share", "kind")


def _tiles(h: np.ndarray, first: np.ndarray, over: int):
    """Pieces of a slice that are searched at once: hashes, first words of texts, and the place of the first word. Texts are
    only cut if the slice is one text."""
    if len(first) > 2 or len(h) <= TILE + 2 * over:
        yield h, first, 0
        return
    for i in range(0, len(h), TILE):
        a = max(i - over, 0)
        part = h[a : i + TILE + over]
        yield part, np.array([0, len(part)]), a


def _search(src: DataFrame, item_ids: list, texts: list[str], cosine: float) -> DataFrame:
    w = tokenize(pa.array(texts, pa.large_string()), fold=True, plain=True)
    hashed = w.hashes()
    space = build_space(src.select("t"), hashed)
    words = [hashed[i:j].tolist() for i, j in zip(w.first[:-1], w.first[1:])]
    have = [i for i, x in enumerate(words) if x]
    q = np.zeros((len(have), space.basis.shape[1]), np.float32)
    for r, i in enumerate(have):
        q[r] = space.basis[space.words.ids(np.array(words[i], np.uint64))].sum(axis=0)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    #: items with few words of weight hardly stand out: places with half of these words are checked instead, and all places
    #: that hold as many of their distinct words as the rules need
    weighty = [np.array(words[i], np.uint64)[space.idf[space.words.ids(np.array(words[i], np.uint64))] > 0].tolist() for i in have]
    weak = np.array([len(x) < FEW for x in weighty], bool)
    by_rare = [(int(r), -(-len(weighty[r]) // 2)) for r in np.flatnonzero(weak) if weighty[r]]
    known = np.unique(np.array([x for r, _ in by_rare for x in weighty[r]], np.uint64))
    member_of = np.array([np.isin(known, np.array(weighty[r], np.uint64)) for r, _ in by_rare], bool)
    sizes = np.array([len(words[i]) for i in have], np.int64)
    #: window widths in blocks: all but three words of an item fit, wherever in a block it starts
    pick = -(-(sizes + BLOCK // 2) // BLOCK)
    by_width = {int(x): np.flatnonzero((pick == x) & ~weak) for x in np.unique(pick)}
    by_types = _groups_of_types(np.flatnonzero(weak), pick, [words[i] for i in have])
    sent = src.sparkSession.sparkContext.broadcast((space, q, by_width, by_types, by_rare, known, member_of, have, words, item_ids))

    over = (2 * max(sizes.tolist(), default=0) // BLOCK + 4) * BLOCK  # words about a place that are looked at, and more

    def run(batches):
        space, q, by_width, by_types, by_rare, known, member_of, have, words, item_ids = sent.value
        member = [set(words[i]) for i in have]
        least = [PARAPHRASE * len(words[i]) + len(m) - len(words[i]) for i, m in zip(have, member)]  # as in _check

        def look(best, h, first, base):
            blocks, at, text, keep, _ = _passage_sums(space.basis, space.words.ids(h), space.idf, first, BLOCK)
            dots = blocks @ q.T
            # squared lengths of window sums, from running sums of the products of blocks some way apart
            apart = [np.concatenate([[0.0], np.cumsum(np.einsum("ij,ij->i", blocks[: len(at) - x], blocks[x:]), dtype=np.float64), np.zeros(x)]) for x in range(min(max(by_width, default=0), len(at)))]
            last = np.searchsorted(text, text, side="right")  # block after the last of the same text
            for wide, rows in by_width.items():
                if not len(rows):
                    continue
                stop = np.minimum(np.arange(len(at)) + wide, last)
                here = np.arange(len(at))
                square = sum((1 + (x > 0)) * (apart[x][np.maximum(stop - x, here)] - apart[x][here]) for x in range(min(wide, len(at))))
                size = np.sqrt(np.maximum(square, 0))
                part = np.concatenate([np.zeros((1, len(rows)), np.float32), np.cumsum(dots[:, rows], axis=0)])
                near = part[stop] - part[:-1] >= (cosine * np.maximum(size, 1e-9))[:, None]
                held = -1
                for k, r in zip(*(x.tolist() for x in np.nonzero(near))):
                    if k != held:  # the words about a block, once for all items
                        held, lo, hi = k, max(int(at[k]) - BLOCK, int(first[text[k]])), min(int(at[k]) + (wide + 1) * BLOCK, int(first[text[k] + 1]))
                        about = set(h[lo:hi].tolist())
                    which = int(rows[r])
                    if len(member[which] & about) >= least[which]:
                        cos = float((part[stop[k], r] - part[k, r]) / max(size[k], 1e-9))
                        _check(best, h, first, base, int(text[k]), lo, hi, which, cos, have, words, member)
            for r, place in _rare_places(h, keep, first, known, member_of, by_rare, words, have):
                long = len(words[have[r]])
                _check(best, h, first, base, int(np.searchsorted(first, place, side="right")) - 1, place - long - BLOCK, place + long + BLOCK, r, 0.0, have, words, member)
            for k, r, wide in _type_places(h, at, text, by_types):
                _check(best, h, first, base, int(text[k]), int(at[k]) - BLOCK, int(at[k]) + (wide + 1) * BLOCK, r, 0.0, have, words, member)

        for b in batches:
            out = []
            for i, j in slices(b.column(0), SLICE):
                t = tokenize(b.column(0).slice(i, j - i), fold=True, plain=True)
                best: dict[tuple[int, int], tuple] = {}
                for h, first, base in _tiles(t.hashes(), t.first, over):
                    if len(h) and len(q):
                        look(best, h, first, base)
                for (d, r), (share, answer, place, c) in sorted(best.items()):
                    out.append((b.column(1)[i + d].as_py(), item_ids[have[r]], place, c, share, answer, "verbatim" if share >= VERBATIM else "paraphrase"))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "k", "word_at", "cosine", "lcs_share", "answer_share", "kind"])

    return src.select("t", "id").mapInArrow(run, "doc_id long, k string, word_at long, cosine double, lcs_share double, answer_share double, kind string")


def _rare_places(h, keep, first, known, member_of, by_rare, words, have):
    """Places (item, word) from which at least half of an item's words of weight follow within twice its length."""
    if not len(known):
        return
    at = np.minimum(np.searchsorted(known, h[keep]), len(known) - 1)
    hit = known[at] == h[keep]
    where, which = keep[hit], at[hit]
    for k, (r, need) in enumerate(by_rare):
        p = where[member_of[k, which]]
        if len(p) >= need:
            span = p[need - 1 :] - p[: len(p) - need + 1]
            ok = np.flatnonzero(span <= 2 * len(words[have[r]]))
            a, b = p[ok], p[ok + need - 1]
            same = np.searchsorted(first, a, side="right") == np.searchsorted(first, b, side="right")
            yield from ((r, x) for x in a[same].tolist())


def _groups_of_types(weak, pick, words: list[list[int]]) -> list[tuple]:
    """Items of equal width, at most TYPED together: width, items, their distinct words, which of them each item and its
    answer have, and how many of these a window must hold at least for each rule (a missing word costs a place or more)."""
    out = []
    for wide in np.unique(pick[weak]).tolist():
        same = [int(r) for r in weak if pick[r] == wide]
        for rows in (same[i : i + TYPED] for i in range(0, len(same), TYPED)):
            known = np.unique(np.array([x for r in rows for x in words[r]], np.uint64))
            whole, ends = [words[r] for r in rows], [words[r][-ANSWER:] for r in rows]
            has = np.array([np.isin(known, np.array(x, np.uint64)) for x in (*whole, *ends)], np.float32).T
            verbatim, paraphrase = (np.array([len(set(x)) - (1 - share) * len(x) for x in whole]) - 1e-3 for share in (VERBATIM, PARAPHRASE))
            answer = np.array([len(set(x)) - (1 - ANSWER_SHARE) * len(x) for x in ends]) - 1e-3
            out.append((int(wide), rows, known, np.ascontiguousarray(has), verbatim, paraphrase, answer))
    return out


def _type_places(h, at, text, groups):
    """Places (block, item, width) about which enough distinct words of an item stand for one of the rules to hold: no
    place where a rule holds within the window is left out."""
    of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
    for wide, rows, known, has, verbatim, paraphrase, answer in groups:
        which = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[which] == h
        held = np.zeros((len(at), len(known)), bool)
        held[of[hit], which[hit]] = True
        about = held.copy()
        for x in (-1, *range(1, min(wide + 1, len(at)))):
            to, of_ = (slice(1, None), slice(None, -1)) if x < 0 else (slice(None, -x), slice(x, None))
            about[to] |= held[of_] & (text[to] == text[of_])[:, None]
        n = len(rows)
        count = about.astype(np.float32) @ has
        near = (count[:, :n] >= verbatim) | ((count[:, :n] >= paraphrase) & (count[:, n:] >= answer))
        yield from ((k, rows[r], wide) for k, r in zip(*(x.tolist() for x in np.nonzero(near))))


def _check(best, h, first, base, d, lo, hi, r, cos, have, words, member):
    """Hold the words [lo, hi) of text d, as far as it goes, against an item; keep the best place."""
    item = words[have[r]]
    lo, hi = max(int(first[d]), lo), min(int(first[d + 1]), hi)
    near = h[lo:hi].tolist()
    if len(member[r].intersection(near)) + len(item) - len(member[r]) < PARAPHRASE * len(item):  # bounds a subsequence's length
        return
    share, answer = _judge(item, near)
    if share >= VERBATIM or (share >= PARAPHRASE and answer >= ANSWER_SHARE):
        old = best.get((d, r))
        new = (share, answer, base + lo - int(first[d]), round(cos, 6))
        if old is None or (new[0], -new[2]) > (old[0], -old[2]):
            best[d, r] = new


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` without the documents into which a benchmark item leaks; rows with the id of such a document go with it.

    Rows with a null id cannot be named by a leak and are kept.
    """
    from .common import cut

    bad = cut(leaks(docs, items, id_col, text_col, item_id, item_text).select(F.col("doc_id").alias("bad")).distinct())
    return docs.join(bad, docs[id_col].cast("long") == bad["bad"], "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
