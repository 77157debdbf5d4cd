"""Language-model scores by online logistic context mixing (operator 10).

Tokens are words and one end for each text. Every known word has a path of `DEPTH` bits (of its hash), and its probability
is that of being known, times those of the bits, times its share of the words with that path. Each bit is predicted in
three ways: from how often it is met at this place of the paths at all, in the hashed context of the two words before
(backed off to the former), and from what the text held so far. The predictions are mixed in the logistic domain by weights
that a gate picks (by depth, by how often the context was met at this bit, and by how much the text has shown); a text starts
from the same weights and refines them by the gradient after each block of `BLOCK` tokens, so a prediction only ever uses
what came before. An unknown word counts as one more token, whose rate is refined in the same way, times the probability of
its spelling, byte by byte after a hash of the two bytes before.

Counts of words, contexts and bytes are taken over the whole corpus, and grow with it: a context is a hash of more
bits the more tokens there are, and each that occurs has counts of its own. Slices of texts send their distinct words and
(context, path) keys to ranges of keys, which reply with the counts along each path (see packs); a task holds the keys of
one slice or one range, never those of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .kernels import Words, mix, slices, tokenize
from .packs import SLICE, Tally, by_range, pack, restore, restore_sorted, squeeze, squeeze_sorted, unpack

DEPTH, BLOCK = 12, 64
NODES = 1 << DEPTH
#: Depths at which a text's own counts predict.
NEAR = 8
#: Weight of what the context, the text's own counts and the rate of unknown words are backed off to.
BACKOFF, OWN, RARE = 0.3, 6.0, 12.0
#: Weights that a text starts from, by how often the context was met (never, once, more): for the plain share, the two words
#: before, the text itself.
START = ((0.35, 0.35, 0.5), (0.1, 0.9, 0.3), (0.0, 1.0, 0.2))
RATE = 0.01
END = np.uint64(0x5851F42D4C957F2D)
#: Keys in a range, and parts of the corpus whose spelling is summed apart.
RANGE, LOTS = 1_000_000, 8
#: Hashes of two bytes that spelling is learnt after.
PAIRS = 1 << 13


@dataclass
class Tokens:
    """Tokens of some texts: hash (END at the end of each text), first token of each text, hash of the two words before."""

    h: np.ndarray
    first: np.ndarray
    two: np.ndarray
    words: Words
    is_word: np.ndarray

    def part(self, i: int, j: int) -> Tokens:
        """The tokens of texts i to j - 1."""
        lo, hi, w = self.first[i], self.first[j], self.words
        a, b = w.first[i], w.first[j]
        return Tokens(self.h[lo:hi], self.first[i : j + 1] - lo, self.two[lo:hi], Words(w.buf, w.start[a:b], w.end[a:b], w.first[i : j + 1] - a), self.is_word[lo:hi])


def tokens(texts: pa.Array) -> Tokens:
    w = tokenize(texts, fold=True)
    count = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(count + 1)])
    h = np.full(int(first[-1]), END, np.uint64)
    is_word = np.ones(len(h), bool)
    is_word[first[1:] - 1] = False
    h[is_word] = w.hashes()
    before = np.zeros((2, len(h)), np.uint64)
    before[0, 1:], before[1, 2:] = h[:-1], h[:-2]
    start = first[:-1]
    before[:, start] = 1
    before[1, start[count > 0] + 1] = 1
    return Tokens(h, first, mix(mix(before[0]) + before[1] * np.uint64(0x9E3779B97F4A7C15)), w, is_word)


def _paths(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - DEPTH)).astype(np.int64)


def context_keys(t: Tokens, bits: int) -> np.ndarray:
    """A key of each token: `bits` bits of its context, and its path."""
    return (t.two >> np.uint64(64 - bits) << np.uint64(DEPTH)) | (t.h >> np.uint64(64 - DEPTH))


def path_counts(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For ascending (context, path) keys: how often the context was met, and each node along the path; keys x (DEPTH + 1).

    Contexts met more than 65535 times are halved until they fit; a node never has more than the one above it.
    """
    out = np.empty((len(keys), DEPTH + 1), np.uint16)
    over = None
    for d in range(DEPTH + 1):
        node = keys >> np.uint64(DEPTH - d)
        new = np.concatenate([[True], node[1:] != node[:-1]])
        met = np.add.reduceat(counts, np.flatnonzero(new))[np.cumsum(new) - 1]
        if over is None:
            over = np.maximum(np.frexp(met.astype(float))[1] - 16, 0)
        out[:, d] = met >> over
    return out


def spelling_keys(t: Tokens, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of the chosen words and for their ends (257 symbols; 256 before a word, and at its end): indices into
    the tables of a symbol after one byte, and after a hash of two bytes; and which word it belongs to."""
    s, e = t.words.start[chosen], t.words.end[chosen]
    size = e - s
    word = np.repeat(np.arange(len(s)), size + 1)
    if not len(word):
        return word, word, word
    at = np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    here, buf = s[word] + at, t.words.buf

    def byte(back: int) -> np.ndarray:
        return np.where((at >= back) & (at - back < size[word]), buf[np.clip(here - back, 0, len(buf) - 1)].astype(np.int64), 256)

    now, one, two = byte(0), byte(1), byte(2)
    pair = (mix((two * 257 + one).astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
    return one * 257 + now, pair * 257 + now, word


def _batch(names: list[str], schema: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), schema)], names)


ASKED = (["kind", "r", "slice", "x", "y"], [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])
REPLY = (["slice", "kind", "r", "y", "path", "n", "v", "once"], [pa.int64(), pa.string(), pa.int64(), pa.binary(), *[pa.int64()] * 4])


def _sums_of_runs(keys: np.ndarray, values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their values; order sorts the keys."""
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(values[order].astype(np.int64), new).astype(np.uint32)


def _ask_words(ranges: int):
    """What each slice sends of words: their training counts (kind w), and how they are spelt (p; each text's words once)."""

    def run(batches):
        for b in batches:
            for slice_, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = unpack(blob)
                t = tokens(rows.column("t"))
                text = np.repeat(np.arange(rows.num_rows), np.diff(t.first))
                learn = np.asarray(rows.column("learn"))[text]
                order = np.argsort(t.h, kind="stable")
                name, count = _sums_of_runs(t.h, learn, order)
                cuts, some = by_range(name, 64, ranges)
                out = [("w", r, slice_, squeeze_sorted(name[cuts[r] : cuts[r + 1]]), squeeze(count[cuts[r] : cuts[r + 1]])) for r in some]
                new = np.diff(t.h[order]) != 0
                once = np.concatenate([[True], new | (np.diff(text[order]) != 0)]) & learn[order] & t.is_word[order]
                first = np.flatnonzero(np.concatenate([[True], new]))
                held = np.add.reduceat(once.astype(np.int64), first)  # texts that are learnt from and hold the word
                word = (np.cumsum(t.is_word) - 1)[order[first[held > 0]]]
                spelt = np.zeros(257 * (257 + PAIRS))
                for i in range(0, len(word), 1 << 15):
                    after_one, after_two, which = spelling_keys(t, word[i : i + (1 << 15)])
                    weigh = held[held > 0][i + which]
                    spelt += np.bincount(np.concatenate([after_one, 257 * 257 + after_two]), np.tile(weigh, 2), len(spelt))
                keys = np.flatnonzero(spelt)
                out.append(("p", slice_ % LOTS, slice_, squeeze_sorted(keys.astype(np.uint64)), squeeze(spelt[keys].astype(np.uint32))))
                for i in range(0, len(out), 64):
                    yield _batch(*ASKED, out[i : i + 64])

    return run


def _ask_contexts(bits: int, ranges: int):
    """What each slice sends of contexts: their keys, with how often each is learnt."""

    def run(batches):
        for b in batches:
            for slice_, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = unpack(blob)
                t = tokens(rows.column("t"))
                keys = context_keys(t, bits)
                keys, n = _sums_of_runs(keys, np.repeat(np.asarray(rows.column("learn")), np.diff(t.first)), np.argsort(keys, kind="stable"))
                cuts, some = by_range(keys, bits + DEPTH, ranges)
                out = [("c", r, slice_, squeeze_sorted(keys[cuts[r] : cuts[r + 1]]), squeeze(n[cuts[r] : cuts[r + 1]])) for r in some]
                for i in range(0, len(out), 64):
                    yield _batch(*ASKED, out[i : i + 64])

    return run


def _answer_spelling(batches: Iterator[pa.RecordBatch]) -> bytes:
    total = np.zeros(257 * (257 + PAIRS), np.int64)
    for b in batches:
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            total[restore_sorted(x).astype(np.int64)] += restore(y, np.uint32)
    return squeeze(total)


def _answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a range over all slices: back to each slice in the order of its keys; of words also sums by path."""
    kind, r = (k.as_py() for k in key)
    if kind == "p":
        yield _batch(*REPLY, [(None, kind, r, _answer_spelling(batches), None, None, None, None)])
        return
    tally, held = Tally(), []
    for b in batches:
        for s, x, y in zip(b.column("slice").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist()):
            tally.add(restore_sorted(x), restore(y, np.uint32))
            held.append((s, x))
    tally.settle()
    reply = _steps(path_counts(tally.keys, tally.counts)) if kind == "c" else tally.counts
    out = []
    for s, x in held:
        out.append((s, kind, r, squeeze(np.ascontiguousarray(reply[np.searchsorted(tally.keys, restore_sorted(x))])), None, None, None, None))
        if len(out) >= 64:
            yield _batch(*REPLY, out)
            out = []
    if kind == "w":
        path = _paths(tally.keys)
        new = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        sums = (np.add.reduceat(v, new).tolist() for v in (tally.counts, (tally.counts > 0).astype(np.int64), (tally.counts == 1).astype(np.int64)))
        out += [(None, kind, r, None, *row) for row in zip(path[new].tolist(), *sums)]
    for i in range(0, len(out), 4096):
        yield _batch(*REPLY, out[i : i + 4096])


def _steps(met: np.ndarray) -> np.ndarray:
    """Counts along paths as the last one and what is lost at each bit, which is mostly nothing."""
    return np.concatenate([met[:, -1:], met[:, :-1] - met[:, 1:]], axis=1)


def _counts(steps: np.ndarray) -> np.ndarray:
    """The reverse of _steps, as DEPTH + 1 x keys."""
    down = np.cumsum(steps[:, :0:-1], axis=1, dtype=np.uint16)[:, ::-1] + steps[:, :1]
    return np.ascontiguousarray(np.concatenate([down, steps[:, :1]], axis=1).T)


@dataclass
class Model:
    spelling: np.ndarray  # log10 probability of a symbol after two, PAIRS * 257
    total: int
    distinct: int
    rare: float  # rate of unknown words
    mass: np.ndarray  # by path: sum of count + 0.5 over its known words
    odds: np.ndarray  # by node of the tree of paths: its share of the node above


def _logit_of(hit: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Log odds of the bit that was met, from weights for and against it; both are above zero."""
    return np.clip(np.log(hit / rest), -9, 9)


def score_tokens(m: Model, t: Tokens, count: np.ndarray, met: np.ndarray) -> np.ndarray:
    """log10 probability of each text, given the training count of each token, and the counts along its path in its
    context (DEPTH + 1 x tokens)."""
    texts = len(t.first) - 1
    size = np.diff(t.first)
    out = np.zeros(texts)
    path = _paths(t.h)
    known = count > 0
    text_of = np.repeat(np.arange(texts), size)
    # unknown words: their spelling
    spelt = np.flatnonzero(~known & t.is_word)
    if len(spelt):
        _, after_two, word = spelling_keys(t, (np.cumsum(t.is_word) - 1)[spelt])
        out += np.bincount(text_of[spelt], np.bincount(word, m.spelling[after_two], len(spelt)), texts)
    # known words: their share of their path
    share = np.log10((count + 0.5) / np.maximum(m.mass[path], 0.5))
    out += np.bincount(text_of[known], share[known], texts)
    deep = np.arange(DEPTH, dtype=np.int32)[:, None]
    node = ((1 << DEPTH) + path).astype(np.int32)[None, :] >> (DEPTH - 1 - deep)  # the node that each bit leads to
    plain = m.odds[node].astype(np.float32)
    x1 = _logit_of(plain, 1 - plain)
    f = met.astype(np.float32)
    x2 = _logit_of(f[1:] + np.float32(BACKOFF) * plain, f[:-1] - f[1:] + np.float32(BACKOFF) * (1 - plain))
    level = np.minimum(met[:-1], 2).astype(np.int32)
    del f
    kinds = 3 * 3 * 2  # gates: depths, levels, whether the text has shown much
    gate = ((deep * 3 // DEPTH) * 3 + level) * 2
    start = np.array(START, np.float32)[np.arange(kinds) // 2 % 3]
    gates = np.broadcast_to(start, (texts, kinds, 3)).copy()
    tree = np.int64(2 << NEAR)
    own = np.zeros((texts, int(tree)), np.float32)
    unk = np.zeros((texts, 2))
    order = np.argsort(-size, kind="stable")
    alive = np.cumsum(np.bincount(-(-size // BLOCK))[::-1])[::-1]  # texts with at least so many blocks
    for step in range(int(-(-size.max() // BLOCK)) if texts else 0):
        who = order[: int(alive[step + 1])]
        n = np.minimum(size[who] - step * BLOCK, BLOCK)
        at = np.repeat(t.first[who] + step * BLOCK, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        d = np.repeat(np.arange(len(who)), n)  # place in `who`
        k = known[at]
        p_unk = (unk[who, 0] + RARE * m.rare) / (unk[who].sum(axis=1) + RARE)
        new = np.bincount(d, k, len(who))
        out[who] += new * np.log10(1 - p_unk) + (n - new) * np.log10(p_unk)
        shown = (unk[who, 1] > 2 * BLOCK).astype(np.int64)
        unk[who, 0] += n - new
        unk[who, 1] += new
        d, at = d[k], at[k]
        if not len(d):
            continue
        x = np.zeros((3, DEPTH, len(d)), np.float32)
        x[0], x[1] = x1[:, at], x2[:, at]
        mine = (who[d] * tree)[None, :] + node[:NEAR, at]
        flat = own.reshape(-1)
        hits = flat[mine]
        above = np.concatenate([flat[who[d] * tree + 1][None, :], hits[:-1]])
        odds = plain[:NEAR, at]
        x[2, :NEAR] = _logit_of(hits + np.float32(OWN) * odds, above - hits + np.float32(OWN) * (1 - odds))
        which = d[None, :] * kinds + gate[:, at] + shown[d][None, :]
        local = gates[who].reshape(-1, 3)
        w = local[which]
        z = w[:, :, 0] * x[0] + w[:, :, 1] * x[1] + w[:, :, 2] * x[2]
        p = np.clip(1 / (1 + np.exp(-z)), np.float32(1e-4), np.float32(1 - 1e-4))
        out[who] += np.bincount(d, np.log10(np.prod(p, axis=0, dtype=np.float64)), len(who))
        slope = (1 - p)[None] * x
        used = which.ravel()
        for i in range(3):
            local[:, i] += (RATE * np.bincount(used, slope[i].ravel(), len(local))).astype(np.float32)
        gates[who] = np.clip(local, -1, 2.5).reshape(len(who), kinds, 3)
        np.add.at(flat, mine.ravel(), np.float32(1))
        np.add.at(flat, who[d] * tree + 1, np.float32(1))
    return out


def _scorer(sent, bits: int, most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = sent.value
        parts = {"w": [], "c": []}
        kinds, blobs = right.column("kind").to_pylist(), right.column("y")
        for i in np.argsort(np.asarray(right.column("r")), kind="stable").tolist():
            parts[kinds[i]].append(blobs[i].as_py())
        have = np.concatenate([restore(x, np.int64) for x in parts["w"]])
        steps = np.concatenate([restore(x, np.uint16, DEPTH + 1) for x in parts["c"]])
        rows = unpack(left.column("rows")[0].as_py())
        texts = rows.column("t")
        n = rows.num_rows
        whole = tokens(texts)
        name = np.searchsorted(np.unique(whole.h), whole.h)
        key = np.unique(context_keys(whole, bits), return_inverse=True)[1]
        base, full, knowns = (np.zeros(n) for _ in range(3))
        sizes = np.diff(whole.first)
        width = np.asarray(pc.binary_length(texts)).astype(np.int64)
        all_ = m.total + 0.5 * (m.distinct + 1)
        for i, j in slices(texts, most, 1024):  # texts of like lengths stand together, so that few are scored alone to their end
            t = whole.part(i, j)
            lo, hi = whole.first[i], whole.first[j]
            count = have[name[lo:hi]]
            base[i:j] = np.add.reduceat(np.log10((count + 0.5) / all_), t.first[:-1])
            knowns[i:j] = np.add.reduceat((count > 0).astype(np.int64), t.first[:-1])
            full[i:j] = score_tokens(m, t, count, _counts(steps[key[lo:hi]]))
        per_byte = np.where(width > 0, -full / math.log10(2) / np.maximum(width, 1), np.nan)
        return pa.table(
            [rows.column("id"), rows.column("learn"), pa.array(sizes.astype(np.int64)), pa.array(knowns.astype(np.int64)), pa.array(np.full(n, m.total, np.int64)), pa.array(base), pa.array(full), pa.array(per_byte, from_pandas=True)],
            ["doc_id", "learnt", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    return run


def score(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = SLICE) -> DataFrame:
    """Rows (doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one for each row of `docs`.

    learn says which rows are learnt from (default: all; null counts as no). base_score sums the smoothed log10
    frequencies of the tokens, all unknown words as one token. score is the model's log10 probability of the text, the
    spelling of unknown words included; bits_per_byte is that in bits, over the text's UTF-8 bytes (null for an empty
    text). Null texts count as empty and have one token, the end. Null ids are carried; a repeated row is learnt from and
    scored as often as it occurs; other columns are ignored; an empty table gives an empty result. If nothing is learnt
    from, every token is unknown. A very long text is a slice of its own: a task takes some 300 bytes of memory for each
    of its tokens. Many very short texts are cut by number, so that a task's memory does not go with theirs.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    flag = F.coalesce(F.lit(True) if learn is None else learn, F.lit(False))
    dtype = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), t.alias("t"), flag.alias("learn"))
    size = src.agg(F.sum(F.octet_length("t")), F.count("*")).first()
    about = max(1, int(size[0] or 0) // 6 + size[1])  # tokens
    bits = min(64 - DEPTH, max(24, about.bit_length() + 4))
    packs = pack(src, "t", most)
    sends, replies = "kind string, r long, slice long, x binary, y binary", "slice long, kind string, r long, y binary, path long, n long, v long, once long"
    words = packs.mapInArrow(_ask_words(max(1, about // (8 * RANGE))), sends)
    words = cut(words.groupBy("kind", "r").applyInArrow(_answer, replies))
    spelt = [restore(r["y"], np.int64) for r in words.where("kind = 'p'").select("y").collect()]  # LOTS tables of fixed size
    sums = {r["path"]: r for r in words.where("path is not null").groupBy("path").agg(*(F.sum(c).alias(c) for c in ("n", "v", "once"))).collect()}  # one for each path at most
    contexts = packs.mapInArrow(_ask_contexts(bits, max(1, about // RANGE)), sends).groupBy("kind", "r").applyInArrow(_answer, replies)
    sent = docs.sparkSession.sparkContext.broadcast(_model(spelt, sums))
    replies = words.where("slice is not null").unionByName(contexts).select("slice", "kind", "r", "y")
    out = packs.groupBy("slice").cogroup(replies.groupBy("slice"))
    return out.applyInArrow(_scorer(sent, bits, 1 << 20), f"doc_id {dtype}, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def _model(pairs: list[np.ndarray], sums: dict) -> Model:
    spelt = (np.sum(pairs, axis=0) if pairs else np.zeros(257 * (257 + PAIRS))).astype(float)
    one, two = spelt[: 257 * 257].reshape(257, 257) + 0.05, spelt[257 * 257 :].reshape(PAIRS, 257)
    one /= one.sum(axis=1, keepdims=True)
    # a hash of two bytes is backed off to the last byte alone, which few hashes share: by their counts' own mixture
    first = (mix((np.arange(257)[:, None] * 257 + np.arange(257)).astype(np.uint64).ravel()) & np.uint64(PAIRS - 1)).astype(np.int64)
    back = np.zeros((PAIRS, 257))
    np.add.at(back, first, np.tile(one, (257, 1)))
    back /= np.maximum(back.sum(axis=1, keepdims=True), 1e-12)
    back = np.where(back.sum(axis=1, keepdims=True) > 0, back, 1 / 257)
    spelling = np.log10((two + 4 * back) / (two.sum(axis=1, keepdims=True) + 4)).astype(np.float32).reshape(-1)
    n, v, once = (sum(int(r[c]) for r in sums.values()) for c in ("n", "v", "once"))
    mass = np.zeros(NODES)
    for p, r in sums.items():
        mass[p] = r["n"] + 0.5 * r["v"]
    heap = np.zeros(2 * NODES)
    heap[NODES:] = mass
    for d in range(DEPTH - 1, -1, -1):
        heap[1 << d : 2 << d] = heap[2 << d : 4 << d].reshape(-1, 2).sum(axis=1)
    odds = np.full(2 * NODES, 0.5)
    child = np.arange(2, 2 * NODES)
    odds[child] = np.clip((heap[child] + 1e-3) / (heap[child >> 1] + 2e-3), 1e-4, 1 - 1e-4)
    return Model(spelling, n, v, min(max((once + 0.5) / (n + 1.0), 1e-6), 0.5), mass, odds)


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0))
    out = score(table(spark, sf_dir, "documents"), fold != 1)
    return out.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
