"""Vectorised kernels on Arrow string columns: words and hashes of a whole batch without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPLIT = _SPACE.copy()  # ASCII punctuation and controls separate words too
_SPLIT[[i for i in range(128) if not chr(i).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, hence invertible modulo 2**64
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            both.append(np.cumprod(t))
        _tables[base] = have = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """The words of a batch of texts: byte range of each, and the first word of each text (one more entry at the end)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, piece: int = 1 << 19) -> np.ndarray:
        """One uint64 for each word, a function of its bytes; some `piece` bytes at once, so that little memory is held."""
        out = np.empty(len(self.start), np.uint64)
        order = None
        start, end = self.start, self.end
        if len(start) and (start[1:] < start[:-1]).any():  # ranges in any order, which may overlap
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        i = 0
        while i < len(out):
            base = start[i]
            j = int(np.searchsorted(start, base + piece, side="right"))
            s, e = start[i:j] - base, end[i:j] - base
            buf = self.buf[base : base + int(e.max())]
            up, down = _powers(_BASE, len(buf) + 1)
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_STEP))
            i = j
        if order is None:
            return out
        back = np.empty_like(out)
        back[order] = out
        return back


def tokenize(texts: pa.Array, fold: bool = False, plain: bool = False) -> Words:
    """Split texts (null: empty) on ASCII white space, with `plain` on ASCII punctuation too; `fold` lower-cases A-Z first."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), z, z, np.zeros(1, np.int64))
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    if fold:
        buf = _FOLD[buf]
    inside = np.zeros(len(buf) + 1, bool)  # one more, so that edges at the ends need no special case
    np.logical_not((_SPLIT if plain else _SPACE)[buf], out=inside[:-1])
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins[:-1])
    end = np.flatnonzero(ends[:-1]) + 1
    return Words(buf, start, end, np.searchsorted(start, offs))


def windows(h: np.ndarray, first: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words that stay within a text, and the index of the word each starts at."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(_STEP, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((mix(h + np.uint64(salt)) if salt else h) * up[:n], out=total[1:])
    last = np.repeat(first[1:], np.diff(first))  # end of the text that each word belongs to
    at = np.arange(n - width + 1)
    at = at[at + width <= last[: n - width + 1]]
    return mix((total[at + width] - total[at]) * down[at]), at


def slices(texts: pa.Array, most: int = 4 << 20, rows: int = 1 << 16):
    """Cut a column into ranges [i, j) of about `most` bytes and at most `rows` rows, at least one row each, so that
    kernels stay in cache."""
    if not len(texts):
        return
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right"))
        j = min(max(j, i + 1), i + rows)
        yield i, j
        i = j
