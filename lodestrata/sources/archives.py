"""Tar archives, ZIP suffixes and compressed layers as rows; bundles of objects as ZIP files.

Paths are opened where the task runs, by their URI (local or shared folders, and what pyarrow's file systems reach), and
read as streams: a task holds one piece of a member at a time. Results do not depend on how often a task is run.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

MEMBER = "archive string, ordinal bigint, path string, type string, size bigint, mode bigint, uid bigint, gid bigint, mtime double, link string, data_start bigint, extents array<struct<start:bigint,end:bigint>>"
#: The longest suffix that is searched for the end of a ZIP file, and the largest suffix taken.
SEARCHED, LARGEST = 22 + (1 << 16), 64 << 20
#: Bytes of a member in one row.
PIECE = 1 << 20


def open_uri(uri: str, random_access: bool = False):
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path) if random_access else system.open_input_stream(path, compression=None)


def kind(data: Column) -> Column:
    """plain, gzip or zstd (skippable frames included), by the first bytes and not by the name."""
    h = F.hex(F.substring(data, 1, 4))
    return F.when(h.startswith("1F8B"), "gzip").when((h == "28B52FFD") | h.rlike("^5[0-9A-F]2A4D18$"), "zstd").otherwise("plain")


def _plain(stream):
    """A stream of decoded bytes. What looks compressed but cannot be decoded is an error, never plain."""
    head = io.BufferedReader(stream, 1 << 16)
    start = head.peek(4)[:4]
    if start[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=head)
    if start == b"\x28\xb5\x2f\xfd" or (len(start) == 4 and start[0] >> 4 == 5 and start[1:] == b"\x2a\x4d\x18"):
        return zstandard.ZstdDecompressor().stream_reader(head, read_across_frames=True)
    return head


class _Raw(io.RawIOBase):
    """What io needs of a stream that only reads."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def readinto(self, b):
        data = self.stream.read(len(b))
        b[: len(data)] = data
        return len(data)


TYPES = {tarfile.REGTYPE: "file", tarfile.AREGTYPE: "file", tarfile.GNUTYPE_SPARSE: "file", tarfile.DIRTYPE: "dir", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink", tarfile.CHRTYPE: "char", tarfile.BLKTYPE: "block", tarfile.FIFOTYPE: "fifo"}


def _walk(uri: str):
    with open_uri(uri) as raw, tarfile.open(fileobj=_plain(_Raw(raw)), mode="r|") as tar:
        for i, m in enumerate(tar):
            yield i, m, tar


def _extents(m: tarfile.TarInfo) -> list[dict]:
    parts = m.sparse if m.sparse is not None else [(0, m.size)] if m.isreg() else []
    return [{"start": a, "end": a + n} for a, n in parts if n > 0]


def tar_members(archives: DataFrame) -> DataFrame:
    """Members of tar archives (column path), plain or compressed: one row each, in their order; `extents` are the stored
    ranges, all of a dense file. Sparse files of the PAX and GNU formats are understood."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["path"]:
                rows = []
                for i, m, _ in _walk(uri):
                    rows.append((uri, i, m.name, TYPES.get(m.type, "other"), m.size, m.mode, m.uid, m.gid, float(m.mtime), m.linkname, m.offset_data, _extents(m)))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    names = [c.split()[0] for c in MEMBER.split(", ")]
    return archives.select("path").mapInPandas(lambda it: (f.set_axis(names, axis=1) for f in read(it)), MEMBER)


def tar_pieces(archives: DataFrame, piece: int = PIECE) -> DataFrame:
    """Bytes of regular members in pieces of bounded size: (archive, ordinal, path, start, data). Holes are not listed: a
    piece ends at the end of its extent. An archive that ends early is an error."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["path"]:
                for i, m, tar in _walk(uri):
                    if not m.isreg():
                        continue
                    f = tar.extractfile(m)
                    at = 0
                    for e in _extents(m):
                        while at < e["start"]:
                            at += len(f.read(min(piece, e["start"] - at)))
                        while at < e["end"]:
                            data = f.read(min(piece, e["end"] - at))
                            if not data:
                                raise EOFError(f"{uri}: {m.name} ends early")
                            yield pd.DataFrame({"archive": [uri], "ordinal": [i], "path": [m.name], "start": [at], "data": [data]})
                            at += len(data)

    return archives.select("path").mapInPandas(read, "archive string, ordinal bigint, path string, start bigint, data binary")


def saved_images(archives: DataFrame) -> DataFrame:
    """Layers of archives that hold one saved image each: (archive, image_config, layer, path, diff_id), the lowest first.

    The archive's manifest.json names a configuration and the layers; another number of images than one, a missing member,
    or other than one diff id a layer is an error."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["path"]:
                small, names = {}, set()
                for _, m, tar in _walk(uri):
                    names.add(m.name)
                    if m.isreg() and m.size <= 8 << 20 and (m.name.endswith(".json") or m.name.startswith("blobs/")):
                        data = tar.extractfile(m).read()
                        if data[:1] in (b"{", b"["):
                            small[m.name] = data
                images = json.loads(small.get("manifest.json", b"[]"))
                if len(images) != 1:
                    raise ValueError(f"{uri}: {len(images)} images, not one")
                config, layers = images[0]["Config"], images[0]["Layers"]
                if config not in small or not names.issuperset(layers):
                    raise ValueError(f"{uri}: a member is missing")
                ids = json.loads(small[config])["rootfs"]["diff_ids"]
                if len(ids) != len(layers):
                    raise ValueError(f"{uri}: {len(ids)} ids for {len(layers)} layers")
                n = len(ids)
                yield pd.DataFrame({"archive": [uri] * n, "image_config": [config] * n, "layer": range(n), "path": layers, "diff_id": ids})

    return archives.select("path").mapInPandas(read, "archive string, image_config string, layer bigint, path string, diff_id string")


@F.pandas_udf(BinaryType())
def _appended(payload: pd.Series, names: pd.Series, bodies: pd.Series) -> pd.Series:
    def one(p, n, b):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in zip(n, b):
                z.writestr(zipfile.ZipInfo(name), body)
        return p + out.getvalue()

    return pd.Series([None if p is None else one(p, n, b) for p, n, b in zip(payload, names, bodies)], dtype=object)


def zip_append(payload: Column, names: Column, bodies: Column) -> Column:
    """A payload with a ZIP file of stored entries (arrays of names and bodies, in that order) behind it."""
    return _appended(payload, names, bodies)


def locate_zip(data: bytes) -> int | None:
    """Where the ZIP suffix of some bytes starts; None if there is none. One that ends before the bytes do is an error."""
    tail = data[-SEARCHED:]
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0:
        if at + 22 <= len(tail) and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail):
            end = len(data) - len(tail) + at
            size, offset = (int.from_bytes(tail[at + i : at + i + 4], "little") for i in (12, 16))
            base = end - size - offset
            if base < 0 or len(data) - base > LARGEST:
                raise ValueError("a ZIP suffix of a wrong size")
            return base
        at = tail.rfind(b"PK\x05\x06", 0, at + 3) if at else -1
    if b"PK\x05\x06" in tail:
        raise ValueError("a ZIP file that does not end where the bytes do")
    return None


def zip_entries(files: DataFrame, data: str = "data") -> DataFrame:
    """Entries of the ZIP suffix of each row (id, data): (id, payload_size, ordinal, name, body). Without one: no rows."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, d in zip(frame["id"], frame[data]):
                base = None if d is None else locate_zip(d)
                if base is None:
                    continue
                with zipfile.ZipFile(io.BytesIO(d[base:])) as z:
                    rows = [(i, base, k, e.filename, z.read(e)) for k, e in enumerate(z.infolist())]
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "payload_size", "ordinal", "name", "body"])

    kind_of_id = files.schema["id"].dataType.simpleString()
    return files.select("id", data).mapInPandas(read, f"id {kind_of_id}, payload_size bigint, ordinal bigint, name string, body binary")


def write_bundles(objects: DataFrame, folder: str) -> DataFrame:
    """Objects (bundle, part "manifest" or "chunk", key, ordinal, object) as one ZIP file a bundle in a shared folder:
    (bundle, path, entries). Equal keys are stored once, chunks in order before manifests, the ZIP directory last.

    A bundle's rows reach one task in order (a sort that can spill), which streams them into its file; a file gets its name
    when it is whole, so a task that is run again replaces it and readers never see a part.
    """
    first = objects.groupBy("bundle", "part", "key").agg(F.min("ordinal").alias("ordinal"), F.min_by("object", "ordinal").alias("object"))
    rows = first.withColumn("_m", (F.col("part") == "manifest").cast("int")).repartition("bundle").sortWithinPartitions("bundle", "_m", "ordinal", "key")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))
        system.create_dir(base, recursive=True)
        now = None

        def close():
            now["zip"].close()
            now["out"].close()
            path = f"{base}/{now['name']}.zip"
            system.move(now["temp"], path)
            return pd.DataFrame({"bundle": [now["name"]], "path": [path], "entries": [now["n"]]})

        for frame in frames:
            for b, part, key, data in zip(frame["bundle"], frame["part"], frame["key"], frame["object"]):
                if now is None or now["name"] != str(b):
                    if now:
                        yield close()
                    temp = f"{base}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temp)
                    now = {"name": str(b), "temp": temp, "out": out, "zip": zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), "n": 0}
                now["zip"].writestr(zipfile.ZipInfo(f"{part}/{key}"), data)
                now["n"] += 1
        if now:
            yield close()

    return rows.select("bundle", "part", "key", "object").mapInPandas(write, "bundle string, path string, entries bigint")


def bundle_index(bundles: DataFrame) -> DataFrame:
    """What bundles (column path) hold, from their directories alone: (bundle, part, key, start, size, crc)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["path"]:
                with open_uri(uri, True) as f, zipfile.ZipFile(f) as z:
                    rows = [(uri, *e.filename.split("/", 1), e.header_offset + 30 + len(e.filename), e.file_size, e.CRC) for e in z.infolist()]
                if rows:
                    yield pd.DataFrame(rows, columns=["bundle", "part", "key", "start", "size", "crc"])

    return bundles.select("path").mapInPandas(read, "bundle string, part string, key string, start bigint, size bigint, crc bigint")


def bundle_objects(index: DataFrame) -> DataFrame:
    """The objects of rows of an index, each read at its place: adds `object`. Another checksum is an error."""

    @F.pandas_udf(BinaryType())
    def fetch(uri: pd.Series, start: pd.Series, size: pd.Series) -> pd.Series:
        out = [None] * len(uri)
        for u, rows in uri.groupby(uri).groups.items():
            with open_uri(u, True) as f:
                for i in rows:
                    f.seek(int(start[i]))
                    out[i] = f.read(int(size[i]))
        return pd.Series(out, dtype=object)

    o = index.withColumn("object", fetch("bundle", "start", "size"))
    return o.withColumn("object", F.when(F.crc32("object") == F.col("crc"), F.col("object")).otherwise(F.raise_error("an object is damaged").cast("binary")))


def list_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1))
