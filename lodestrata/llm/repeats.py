"""Removal of repeated passages by fixed-block anchors (operator 7).

A window of 35 words, wherever it starts, holds a whole block of 18 words out of those that its document is cut into. So
an exact repeat of a window is met by looking up every rolling run of 18 words of the other place in the index of such
reference blocks. Texts are packed into slices, which ask ranges of hashes (see packs):

1. Index and probe: each slice sends the hashes of its rolling runs, and which of them are reference blocks. A run that is a
   reference block somewhere and occurs at least twice is an anchor; the range replies with one bit for each run.
2. Extend: about each anchor a slice sends the hashes of the windows that hold it, to the left and to the right, and is told
   which of them occur at least twice. Runs of such windows are the maximal exact repeats. Counting windows stands for
   comparing places pair by pair, which a passage that many documents share would make quadratic.
3. Words that lie in a repeat are removed.

Hashes have more bits the more words there are, so that a false anchor stays rare (it makes a window be counted, never be
removed) and equal hashes of different windows do not occur in practice. A slice sends a hash once, however often it
holds it, so a passage that most documents share costs a range one entry for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .kernels import Words, tokenize, windows
from .packs import SLICE, by_range, pack, restore, restore_sorted, squeeze, squeeze_sorted, unpack

WINDOW = 35
#: Hashes in a range, about.
RANGE = 2_000_000
ASKED = "what string, r long, slice long, x binary, y binary"
REPLY = "slice long, what string, r long, bits binary"


class Texts:
    """The distinct texts of a slice: words, their hashes, the text of each row, and the rows of each text."""

    def __init__(self, blob: bytes):
        self.rows = unpack(blob)
        once = self.rows.column("t").dictionary_encode()
        self.text = np.asarray(once.indices)
        self.words: Words = tokenize(once.dictionary)
        self.hashes = self.words.hashes()
        self.times = np.bincount(self.text, minlength=len(once.dictionary))

    def runs(self, size: int, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words in texts of at least `width` words, their first words, and their texts."""
        first = self.words.first
        g, at = windows(self.hashes, first, size, salt)
        doc = np.searchsorted(first, at, side="right") - 1
        ok = np.diff(first)[doc] >= width
        return g[ok], at[ok], doc[ok]


def _record(what: str, r: int, slice_: int, x: bytes, y: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([what]), pa.array([r], pa.int64()), pa.array([slice_], pa.int64()), pa.array([x], pa.binary()), pa.array([y], pa.binary())], ["what", "r", "slice", "x", "y"])


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by the keys (the first counts most), where new ones begin in it, and the number of each row's key."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


def _sums(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _probe(width: int, bits: int, ranges: int):
    """Hashes of a slice's rolling runs; of each whether it occurs once (1) or more often (2), and (4) is a reference block."""
    size = (width + 1) // 2

    def run(batches):
        for b in batches:
            for slice_, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = Texts(blob)
                g, at, doc = t.runs(size, width)
                key = g >> np.uint64(64 - bits)
                order, first, _ = _distinct(key)
                block = _sums((at - t.words.first[doc]) % size == 0, order, first) > 0
                flag = (np.minimum(_sums(t.times[doc], order, first), 2) + 4 * block).astype(np.uint8)
                key = key[order[first]]
                cuts, some = by_range(key, bits, ranges)
                for r in some:
                    yield _record("a", r, slice_, squeeze_sorted(key[cuts[r] : cuts[r + 1]]), squeeze(flag[cuts[r] : cuts[r + 1]]))

    return run


def _anchors(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _reply(key, batches, lambda x, y: (restore_sorted(x), restore(y, np.uint8)), lambda keys, flags: _two(keys, flags & 3) & (_of(keys, flags >> 2) > 0))


def _repeated(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts(x, y):
        return restore_sorted(x), restore(y, np.uint8, 5)

    def decide(keys, more):
        return _two(keys, more[:, 4], np.ascontiguousarray(more[:, :4]).view(np.uint32).reshape(-1))

    return _reply(key, batches, parts, decide)


def _of(keys: np.ndarray, values: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Each row's sum of values over the rows of the same key."""
    order, first, which = _distinct(keys, *more)
    return _sums(values, order, first)[which] if len(keys) else np.zeros(0, np.int64)


def _two(keys: np.ndarray, times: np.ndarray, *more: np.ndarray) -> np.ndarray:
    return _of(keys, times, *more) > 1


def _reply(key, batches, parts, decide) -> Iterator[pa.RecordBatch]:
    """One bit for each key that each slice sent, in its order."""
    what, r = (k.as_py() for k in key)
    slices_, keys, values = [], [], []
    for b in batches:
        for s, x, y in zip(b.column("slice").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist()):
            k, v = parts(x, y)
            slices_.append(s)
            keys.append(k)
            values.append(v)
    yes = decide(np.concatenate(keys), np.concatenate(values))
    ends = np.cumsum([len(k) for k in keys])
    out = [np.packbits(yes[j - len(k) : j]).tobytes() + len(k).to_bytes(8, "little") for k, j in zip(keys, ends)]
    for i in range(0, len(out), 512):
        n = len(out[i : i + 512])
        yield pa.RecordBatch.from_arrays([pa.array(slices_[i : i + 512], pa.int64()), pa.array([what] * n), pa.array([r] * n, pa.int64()), pa.array(out[i : i + 512], pa.binary())], ["slice", "what", "r", "bits"])


def _bits(replies: pa.Table, what: str) -> np.ndarray:
    some = sorted((r, x) for w, r, x in zip(*(replies.column(c).to_pylist() for c in ("what", "r", "bits"))) if w == what)
    return np.concatenate([np.unpackbits(np.frombuffer(x[:-8], np.uint8), count=int.from_bytes(x[-8:], "little")) for _, x in some] or [np.zeros(0, np.uint8)]).astype(bool)


def _about_anchors(t: Texts, replies: pa.Table, width: int, bits: int, extra: int) -> tuple[np.ndarray, ...]:
    """The windows of a slice's texts that hold an anchor: both parts of their hash, their first words, their texts."""
    size = (width + 1) // 2
    g, at, _ = t.runs(size, width)
    anchor = _bits(replies, "a")[_distinct(g >> np.uint64(64 - bits))[2]] if len(g) else np.zeros(0, bool)
    hit = at[anchor]
    reach = np.zeros(len(t.hashes) + 1, np.int64)  # windows that start up to width - size words before an anchor hold it
    np.add.at(reach, np.maximum(hit - (width - size), 0), 1)
    np.add.at(reach, hit + 1, -1)
    near = np.cumsum(reach[:-1]) > 0
    g1, at, doc = t.runs(width, width)
    g2 = t.runs(width, width, salt=0x51ED270B)[0]
    ok = near[at]
    return g1[ok], (g2[ok] >> np.uint64(32)).astype(np.uint32) & np.uint32((1 << extra) - 1), at[ok], doc[ok]


def _extend(width: int, bits: int, extra: int, ranges: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = Texts(left.column("rows")[0].as_py())
        g1, g2, _, doc = _about_anchors(t, right, width, bits, extra)
        order, first, _ = _distinct(g1, g2)
        times = np.minimum(_sums(t.times[doc], order, first), 2).astype(np.uint8)
        g1, g2 = g1[order[first]], g2[order[first]]
        more = np.concatenate([g2[:, None].view(np.uint8).reshape(-1, 4), times[:, None]], axis=1)
        cuts, some = by_range(g1, 64, ranges)
        slice_ = left.column("slice")[0].as_py()
        out = [_record("b", r, slice_, squeeze_sorted(g1[cuts[r] : cuts[r + 1]]), squeeze(np.ascontiguousarray(more[cuts[r] : cuts[r + 1]]))) for r in some]
        return pa.Table.from_batches(out, schema=_record("", 0, 0, b"", b"").schema)

    return run


def _finish(width: int, bits: int, extra: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = Texts(left.column("rows")[0].as_py())
        g1, g2, at, _ = _about_anchors(t, right, width, bits, extra)
        twice = at[_bits(right, "b")[_distinct(g1, g2)[2]]] if len(g1) else at
        cover = np.zeros(len(t.hashes) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + width, -1)
        # texts stand one after another, so a repeat that reaches a text's end is told from one that begins the next by
        # where windows start
        lone = np.concatenate([[True], np.diff(twice) > 1]) if len(twice) else np.zeros(0, bool)
        start = twice[lone]
        stop = np.append(twice[np.flatnonzero(lone)[1:] - 1], twice[-1:]) + width
        gone = np.cumsum(cover[:-1]) > 0
        w = t.words
        removed = np.concatenate([[0], np.cumsum(gone)])
        removed = removed[w.first[1:]] - removed[w.first[:-1]]
        kept, spans = [], []
        edges = np.searchsorted(start, w.first)
        data = w.buf.tobytes()
        for d in range(len(w.first) - 1):
            i, j = int(w.first[d]), int(w.first[d + 1])
            words = [data[s:e] for s, e in zip(w.start[i:j].tolist(), w.end[i:j].tolist())]
            kept.append(b" ".join(compress(words, (~gone[i:j]).tolist()) if removed[d] else words))
            mine = slice(int(edges[d]), int(edges[d + 1]))
            spans.append([{"start": int(s) - i, "length": int(e - s)} for s, e in zip(start[mine], stop[mine])])
        of = t.text
        return pa.table(
            [t.rows.column("id"), pa.array(np.diff(w.first)[of].astype(np.int64)), pa.array(removed[of].astype(np.int64)), pa.array(kept, pa.binary()).take(pa.array(of)), pa.array(spans, SPANS).take(pa.array(of))],
            ["doc_id", "n_words", "n_removed", "kept", "repeats"],
        )

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, most: int = SLICE) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept, repeats), one for each row of `docs`: kept has the words that are left (binary
    UTF-8), repeats the maximal runs of repeated windows as (first word, number of words).

    A word is removed if some window of `width` consecutive words that covers it starts in at least two places of the
    input, in one document or in several. Words are runs without ASCII white space, unchanged; null texts have none, and
    texts of fewer than `width` words lose nothing. A repeated row is a place of its own, so all its words are removed if
    it has `width` or more. Null ids are carried; other columns are ignored; an empty table gives an empty result. A very
    long text is a slice of its own, and takes a task some 200 bytes of memory for each of its words.
    """
    dtype = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = src.agg(F.sum(F.octet_length("t")), F.count("*")).first()
    about = max(1, int(size[0] or 0) // 5 + size[1])  # words
    bits = min(64, max(32, about.bit_length() + 5))
    extra = min(32, max(1, 2 * about.bit_length() + 24 - 64))
    ranges = max(1, about // RANGE)
    packs = pack(src, "t", most)
    anchors = cut(packs.mapInArrow(_probe(width, bits, ranges), ASKED).groupBy("what", "r").applyInArrow(_anchors, REPLY))
    asked = packs.groupBy("slice").cogroup(anchors.groupBy("slice")).applyInArrow(_extend(width, bits, extra, ranges), ASKED)
    repeated = asked.groupBy("what", "r").applyInArrow(_repeated, REPLY)
    out = packs.groupBy("slice").cogroup(anchors.unionByName(repeated).groupBy("slice"))
    return out.applyInArrow(_finish(width, bits, extra), f"doc_id {dtype}, n_words long, n_removed long, kept binary, repeats array<struct<start:long,length:long>>")


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce("text", ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM w) t
), twice AS (
  SELECT h FROM p GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT r, list(DISTINCT pos) AS ats FROM (SELECT r, unnest(range(i, i + 35)) AS pos FROM p SEMI JOIN twice USING (h)) t GROUP BY r
), flag AS (
  SELECT w.r, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS pos FROM w
), kept AS (
  SELECT f.r, string_agg(x, ' ' ORDER BY f.pos) AS t, count(*) AS n FROM flag f ANTI JOIN (SELECT r, unnest(ats) AS pos FROM gone) g ON g.r = f.r AND g.pos = f.pos GROUP BY f.r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(encode(coalesce(t, ''))) AS kept_sha256
FROM w LEFT JOIN kept ON kept.r = w.r
"""
