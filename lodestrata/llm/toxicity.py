"""Toxicity by a support vector machine on a subsequence string kernel (operator 6).

The kernel of two words sums, over all subsequences of three letters that both hold (word ends count as letters, and the
three span at most five), the product of their weights, which fall with each gap: insults with inserted characters or
gaps stay near the insult. Marks inside a word are dropped and runs of single letters are one word, so "i.d-i o t" is one.

The machine is trained on the words of labelled sentences, not on sentences whole: among a sentence's many subsequences an
insult's few hardly count (README has figures of both). Landmarks and training words come from labelled documents; a Nyström map on the landmarks makes the kernel machine a
linear one, solved exactly. Its decision for a word is again a weighted sum over the word's subsequences, so a table by
hashed subsequence, of fixed size, is all that scoring needs. A document's score is a logistic function of its words'
decisions (the highest ones, how many are positive, and the length), fitted on labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .kernels import Words, slices, tokenize

#: Labelled documents that are learnt from, at most (those with the least hash of their id).
MAX_LABELS = 20_000
#: Training words of either kind, and landmarks of either kind, at most.
MAX_WORDS, LANDMARKS = 3000, 200
#: Least share of the toxic training documents that hold a positive training word.
MIN_SHARE = 0.01
#: Times that hard negative words are added.
ROUNDS = 2
TABLE_LOG = 16
DECAY = 0.6
#: (second, third) letter's distance from the first.
PATTERNS = [(i, j) for j in range(2, 5) for i in range(1, j)]
#: Longest piece of a word that is taken at once; longer words are cut into pieces that overlap by half.
PIECE = 32

_MARK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


@dataclass
class Units:
    """Distinct word pieces of some texts: their bytes, and for each occurrence its piece and text."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    text: np.ndarray


def units(texts: pa.Array) -> Units:
    w = tokenize(texts, fold=True)
    solid = ~_MARK[w.buf]
    place = np.concatenate([[0], np.cumsum(solid)])
    buf = w.buf[solid]
    s, e = place[w.start], place[w.end]
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    single = (e - s) == 1
    if single.any():  # runs of at least three single letters in a text are a word too
        edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)) | np.concatenate([[False], np.diff(text) != 0, [False]]))
        a, b = edge[:-1], edge[1:]
        run = single[a] & (b - a >= 3)
        s, e, text = (np.concatenate([x, y]) for x, y in ((s, s[a[run]]), (e, e[b[run] - 1]), (text, text[a[run]])))
    n = np.maximum(1, -(-(e - s - PIECE // 2) // (PIECE // 2)))
    more = np.repeat(np.arange(len(s)), n)
    step = (np.arange(len(more)) - np.repeat(np.cumsum(n) - n, n)) * (PIECE // 2)
    s, e, text = s[more] + step, np.minimum(s[more] + step + PIECE, e[more]), text[more]
    ok = e > s
    s, e, text = s[ok], e[ok], text[ok]
    _, at, piece = np.unique(Words(buf, s, e, w.first).hashes(), return_index=True, return_inverse=True)
    return Units(buf, s[at], e[at], piece.ravel(), text)


def _entries(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For ranges of words: their subsequences as (rows, table slots, weights), each word normalised to length one."""
    order = np.argsort(end - start, kind="stable")
    for i in range(0, len(order), 2048):
        rows = order[i : i + 2048]
        size = (end - start)[rows]
        wide = int(size.max()) + 2
        at = np.arange(wide)[None, :] - 1
        m = buf[np.minimum(start[rows][:, None] + np.maximum(at, 0), len(buf) - 1)].astype(np.uint32) + 3
        m[:, 0] = 1
        m[np.arange(len(rows)), size + 1] = 2
        m[np.arange(wide)[None, :] > (size + 1)[:, None]] = 0
        slots, weights = [], []
        for a, b in PATTERNS:
            if b >= wide:
                continue
            x, y, z = m[:, : wide - b], m[:, a : wide - b + a], m[:, b:]
            slots.append(((x * np.uint32(0x9E3779B1) ^ y * np.uint32(0x85EBCA77) ^ z * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - TABLE_LOG))
            weights.append((z > 0) * np.float32(DECAY ** (b - 2)))
        slots, weights = np.concatenate(slots, axis=1), np.concatenate(weights, axis=1)
        weights /= np.maximum(np.sqrt(np.square(weights).sum(axis=1, keepdims=True)), 1e-9)
        yield rows, slots, weights


def decisions(buf: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(start), np.float32)
    for rows, slots, w in _entries(buf, start, end):
        out[rows] = (weights[slots] * w).sum(axis=1) + np.float32(bias)
    return out


def _pack(words: list[bytes]):
    size = np.array([len(w) for w in words], np.int64)
    stop = np.cumsum(size)
    return np.frombuffer(b"".join(words) or b"\0", np.uint8), stop - size, stop


def train_words(good: list[bytes], bad: list[bytes], landmarks: int = LANDMARKS, cost: float = 8.0) -> tuple[np.ndarray, float]:
    """The machine as a table of weights by slot, and its bias. Words come in falling order of evidence."""
    marks, words = good[:landmarks] + bad[:landmarks], good + bad
    dense = np.zeros((1 << TABLE_LOG, len(marks)), np.float32)
    for rows, slots, w in _entries(*_pack(marks)):
        np.add.at(dense, (slots, np.broadcast_to(rows[:, None], slots.shape)), w)
    gram = np.zeros((len(words), len(marks)))
    for rows, slots, w in _entries(*_pack(words)):
        for i, r in enumerate(rows.tolist()):
            gram[r] = w[i] @ dense[slots[i]]
    core = gram[list(range(len(good[:landmarks]))) + [len(good) + i for i in range(len(bad[:landmarks]))]]
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    ok = values > 1e-4 * values.max()
    nystroem = vectors[:, ok] / np.sqrt(values[ok])
    x = np.column_stack([gram @ nystroem, np.ones(len(words))])
    y = np.where(np.arange(len(words)) < len(good), 1.0, -1.0)
    each = cost * len(words) * np.where(y > 0, 0.5 / max(len(good), 1), 0.5 / max(len(bad), 1))  # both kinds count the same
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-6
    for _ in range(50):  # Newton steps on the squared hinge loss: exact once the set of support vectors is stable
        active = y * (x @ w) < 1
        xa = x[active]
        new = np.linalg.solve(xa.T @ (xa * each[active, None]) + np.diag(ridge), xa.T @ (each[active] * y[active]))
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return (dense @ (nystroem @ w[:-1])).astype(np.float32), float(w[-1])


N_FEATURES = 6


def document_features(u: Units, d: np.ndarray, n: int) -> np.ndarray:
    """Per text: highest and second highest decision of distinct pieces, positives and strong positives, length."""
    out = np.zeros((n, N_FEATURES))
    out[:, 0:2] = -2.0
    if len(u.piece):
        pairs = np.unique(u.text * (len(d) + 1) + u.piece)
        text, v = pairs // (len(d) + 1), d[pairs % (len(d) + 1)].astype(float)
        order = np.lexsort((-v, text))
        text, v = text[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(text) != 0]))
        out[text[first], 0] = v[first]
        second = first + 1
        second = second[(second < len(text))]
        second = second[text[second] == text[second - 1]]
        out[text[second], 1] = v[second]
        out[:, 2] = np.log1p(np.bincount(text, v > 0, n))
        out[:, 3] = np.log1p(np.bincount(text, v > 0.7, n))
        out[:, 4] = np.log1p(np.bincount(u.text, minlength=n))
        out[:, 5] = np.minimum(out[:, 0], 1) * out[:, 4] / 5
    return out


def _feature_rows(weights: np.ndarray, bias: float, text: pa.Array) -> np.ndarray:
    parts = []
    for i, j in slices(text, 1 << 20):
        u = units(text.slice(i, j - i))
        parts.append(document_features(u, decisions(u.buf, u.start, u.end, weights, bias), j - i))
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray

    def score(self, text: pa.Array) -> np.ndarray:
        f = (_feature_rows(self.weights, self.bias, text) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(f @ self.coef[:-1] + self.coef[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> Model | None:
    """Fit on the labelled documents (columns id and toxic, 0 or 1; others are left out). None without labels of both kinds.

    Words of toxic documents are evidence as far as they are commoner there than in the others; those with the most
    evidence are the positive training words. The commonest words and some at random (by a hash) that only the other
    documents hold are the negative ones.
    """
    y = labels.select(F.col(id_col).cast("long").alias("_id"), F.col("toxic").cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    y = cut(y.orderBy(F.xxhash64("_id"), "_id", "y").limit(max_labels))  # the documented bound on training rows
    n = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    x = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(id_col).cast("long").alias("_id")).join(F.broadcast(y), "_id").select("t", "y", "_id")

    def pieces(batches):
        for b in batches:
            for i, j in slices(b.column(0), 1 << 20):
                u = units(b.column(0).slice(i, j - i))
                pairs = np.unique(u.text * (len(u.start) + 1) + u.piece)
                text, piece = pairs // (len(u.start) + 1), pairs % (len(u.start) + 1)
                toxic = np.asarray(b.column(1).slice(i, j - i))[text] == 1
                counts = [np.bincount(piece[k], minlength=len(u.start)) for k in (toxic, ~toxic)]
                names = [u.buf[s:e].tobytes() for s, e in zip(u.start.tolist(), u.end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array(c.astype(np.int64)) for c in counts)], ["w", "p", "q"])

    found = x.mapInArrow(pieces, "w binary, p long, q long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    # evidence: surplus of toxic documents over what the others' rate gives, in standard deviations
    expect = (F.col("q") + 0.5) * (n[1] / n[0])
    found = cut(found.withColumn("z", (F.col("p") - expect) / F.sqrt(expect + 0.5)).where("p = 0 or q = 0 or z > 3 or z < 1"))

    def first(rows, *order, most):
        return [bytes(r["w"]) for r in rows.orderBy(*order, "w").limit(most).collect()]

    good = first(found.where((F.col("p") >= max(3.0, MIN_SHARE * n[1])) & (F.col("z") > 4)), F.desc("z"), most=MAX_WORDS)
    bad = first(found.where("z < 1 and q > 1"), F.desc("q"), most=MAX_WORDS // 3)
    bad += [w for w in first(found.where("p = 0"), F.xxhash64("w"), most=2 * MAX_WORDS) if w not in set(bad)]
    if not good or not bad:
        return None
    weights, bias = train_words(good, bad)
    clean = found.where("q > 0 and z < 1").select("w")
    for _ in range(ROUNDS):  # words of clean documents that the machine is least sure of are learnt from too
        held = docs.sparkSession.sparkContext.broadcast((weights, bias))

        def judge(batches, held=held):
            for b in batches:
                d = decisions(*_pack([w.as_py() for w in b.column(0)]), *held.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.astype(np.float64))], ["w", "d"])

        hard = first(clean.mapInArrow(judge, "w binary, d double").where("d > -0.5"), F.desc("d"), most=MAX_WORDS)
        known = set(bad)
        bad += [w for w in hard if w not in known]
        weights, bias = train_words(good, bad)
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def feats(batches):
        for b in batches:
            f = _feature_rows(*sent.value, b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(f), pa.list_(pa.float64())), b.column(1), b.column(2)], ["f", "y", "id"])

    # one row for each label, however often its id occurs in `docs`: what reaches the driver is bounded by max_labels
    rows = x.mapInArrow(feats, "f array<double>, y int, id long").groupBy("id", "y").agg(F.min("f").alias("f")).orderBy("id", "y").toPandas()
    f, t = np.array(rows["f"].tolist()), rows["y"].to_numpy(float)
    mean, scale = f.mean(axis=0), np.maximum(f.std(axis=0), 1e-6)
    z = np.column_stack([(f - mean) / scale, np.ones(len(f))])
    coef = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ coef, -30, 30)))
        coef += np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge, z.T @ (t - p) - ridge @ coef)
    return Model(weights, bias, mean, scale, coef)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each row of `docs`; without a model (no labels of both kinds) every score is 0.5.

    A very long text is cut into pieces of words that are scored together. Null and empty texts are scored as texts without words. Only the text is looked at; null ids are carried, repeated
    rows scored alike, other columns ignored; an empty table gives an empty result.
    """
    dtype = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = sent.value.score(b.column(0)) if sent.value is not None else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(id_col).alias("i")).mapInArrow(run, f"doc_id {dtype}, score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf_dir, "labels").where(fold != 0)
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
