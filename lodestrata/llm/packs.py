"""Rows in packed slices, and requests and replies between slices and ranges of keys.

An operator that needs corpus-wide counts of very many keys (words, contexts, windows) packs its rows into slices of a few
megabytes, stored once. A slice sends its distinct keys, sorted, to ranges of keys; a range counts them over all slices and
replies to each slice in the order of its own keys, so neither names nor places travel back, and no task or driver holds
all keys. A record is only sent for a range in which a slice has keys, so there are never more records than keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import cut
from .kernels import slices

#: Bytes of text and rows in a slice, at most (a longer text is a slice of its own).
SLICE, ROWS = 6 << 20, 4096
_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(x: np.ndarray) -> bytes:
    """A column of fixed-width numbers: planes of equal bytes, compressed."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x.reshape(len(x), -1).view(np.uint8).reshape(len(x), -1).T)
    return len(x).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def restore(b: bytes, kind, width: int = 1) -> np.ndarray:
    if not b:
        return np.zeros((0, width) if width > 1 else 0, kind)
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize * width
    planes = np.frombuffer(_ZSTD.decompress(b[8:], n * size, asbytes=True), np.uint8).reshape(size, n)
    out = np.ascontiguousarray(planes.T).view(kind)
    return out if width > 1 else out.reshape(n)


def squeeze_sorted(x: np.ndarray) -> bytes:
    """Ascending uint64 numbers: the first one, and the steps in as many bytes as the largest needs."""
    if not len(x):
        return b""
    steps = np.diff(x)
    size = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return int(x[0]).to_bytes(8, "little") + size.to_bytes(1, "little") + squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :size]))


def restore_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    size = b[8]
    if len(b) == 9:
        return np.frombuffer(b[:8], np.uint64).copy()
    part = restore(b[9:], np.uint8, size) if size > 1 else restore(b[9:], np.uint8)[:, None]
    steps = np.zeros((len(part) + 1, 8), np.uint8)
    steps[1:, :size] = part
    steps[0] = np.frombuffer(b[:8], np.uint8)
    return np.cumsum(steps.view(np.uint64).reshape(-1), dtype=np.uint64)


def pack(rows: DataFrame, text: str = "t", most: int = SLICE) -> DataFrame:
    """`rows` as slices (slice, rows), stored in the checkpoint folder: what follows reads the same slices each time.

    The rows of a slice stand in the order of their texts' lengths. `text` has no nulls.
    """
    where = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            for i, j in slices(b.column(where), most, ROWS):
                some = b.slice(i, j - i)
                some = some.take(pa.array(np.argsort(np.asarray(pc.binary_length(some.column(where))), kind="stable")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as w:
                    w.write_batch(some)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "rows"])
                at += 1

    return cut(rows.mapInArrow(run, "slice long, rows binary"))


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as r:
        return r.read_next_batch()


def by_range(keys: np.ndarray, bits: int, ranges: int) -> tuple[np.ndarray, list[int]]:
    """For ascending keys of which the top 24 of `bits` bits say the range: bounds of the ranges' keys, and those that have any."""
    part = (keys >> np.uint64(bits - 24)).astype(np.int64) * ranges >> 24
    cuts = np.searchsorted(part, np.arange(ranges + 1))
    return cuts, np.flatnonzero(np.diff(cuts)).tolist()


class Tally:
    """Running sums by key: memory goes with distinct keys, however many slices send them."""

    def __init__(self, hold: int = 1 << 21):
        self.keys, self.counts, self.new, self.size, self.hold = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, hold

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.hold, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        if self.new:
            keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
            counts = np.concatenate([self.counts, *(c.astype(np.int64) for _, c in self.new)])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.counts, self.new, self.size = keys[first], np.add.reduceat(counts, first), [], 0
