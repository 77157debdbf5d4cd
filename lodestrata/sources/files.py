"""Folder trees, holes of files, mount tables, generation lists, super blocks and image configurations as rows."""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREE = "path string, type string, size bigint, mode bigint, uid bigint, gid bigint, mtime_ns bigint, dev bigint, ino bigint, link string"
#: The longest generation list, and the magic number and place of the super block.
LONGEST_LIST, SUPER_MAGIC, SUPER_AT = 256 << 10, 0xE0F5E1E2, 1024


def tree(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Everything below a shared folder, relative to it, without the excluded paths and what lies below them. Folders and
    links are not followed out. The first level is listed by the driver and dealt out, one subtree a task."""
    gone = frozenset(excluded)

    def row(rel: str) -> tuple:
        full = os.path.join(root, rel)
        s = os.lstat(full)
        kinds = {0o040000: "dir", 0o100000: "file", 0o120000: "symlink", 0o020000: "char", 0o060000: "block", 0o010000: "fifo", 0o140000: "socket"}
        kind = kinds[s.st_mode & 0o170000]
        return rel, kind, s.st_size if kind == "file" else 0, s.st_mode & 0o7777, s.st_uid, s.st_gid, s.st_mtime_ns, s.st_dev, s.st_ino, os.readlink(full) if kind == "symlink" else None

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TREE.split(", ")]
        for frame in frames:
            todo, rows = list(frame["path"]), []
            while todo:
                rel = todo.pop()
                rows.append(row(rel))
                if rows[-1][1] == "dir":
                    todo += [f"{rel}/{e}" for e in os.listdir(os.path.join(root, rel)) if f"{rel}/{e}" not in gone]
                if len(rows) == 1000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    top = [(e,) for e in sorted(os.listdir(root)) if e not in gone]
    return spark.createDataFrame(top, "path string").repartition(max(len(top), 1)).mapInPandas(walk, TREE)


def probe_holes(files: DataFrame) -> DataFrame:
    """Holes of files (column path) as the file system knows them: (path, start, end). Where it does not: none."""

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                found, at = [], 0
                with open(path, "rb") as f:
                    size = os.fstat(f.fileno()).st_size
                    while at < size:
                        try:
                            hole = os.lseek(f.fileno(), at, os.SEEK_HOLE)
                            if hole >= size:
                                break
                            try:
                                at = os.lseek(f.fileno(), hole, os.SEEK_DATA)
                            except OSError as e:
                                if e.errno != errno.ENXIO:
                                    raise
                                at = size
                            found.append((path, hole, at))
                        except OSError as e:
                            if e.errno in (errno.EINVAL, errno.EOPNOTSUPP):
                                found = []
                                break
                            raise
                if found:
                    yield pd.DataFrame(found, columns=["path", "start", "end"])

    return files.select("path").mapInPandas(probe, "path string, start bigint, end bigint")


def unescape_octal(s: Column) -> Column:
    """Octal escapes of a mount table (space, tab, newline, backslash, all below 128) as characters."""
    parts = F.split(F.regexp_replace(s, r"\\([0-7]{3})", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.char(F.conv(p, 8, 10).cast("bigint"))).otherwise(p)), "")


def mounts_under(lines: DataFrame, root: str) -> DataFrame:
    """Mount points strictly below a folder, relative to it, once each, from the lines (value) of a mount table."""
    base = root.rstrip("/") + "/"
    points = lines.select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) >= 5").select(unescape_octal(F.get("f", F.lit(4))).alias("m"))
    return points.where(F.col("m").startswith(base) & (F.length("m") > len(base))).select(F.substring("m", len(base) + 1, 1 << 20).alias("path")).distinct()


def generation_list(files: DataFrame) -> DataFrame:
    """Names of lists (id, text), one a line, trimmed, blanks left out, in order: (id, ord, generation). Newest last. A list
    of over 256 KiB or with a name twice is an error."""
    names = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    ok = (F.octet_length("text") <= LONGEST_LIST) & (F.size(F.array_distinct("_n")) == F.size("_n"))
    n = files.withColumn("_n", names).withColumn("_n", F.when(ok, F.col("_n")).otherwise(F.raise_error("a generation list is too long or names one twice").cast("array<string>")))
    return n.select("id", F.posexplode("_n").alias("ord", "generation"))


def _le32(data: Column, at: int) -> Column:
    h = F.hex(F.substring(data, at + 1, 4))
    return F.conv(F.regexp_replace(F.reverse(h), "(.)(.)", "$2$1"), 16, 10).cast("bigint")


def super_block_size(data: Column) -> Column:
    """Bytes of a file-system image, from its super block: blocks times their size. Another magic, or blocks of one byte or
    over 1 GiB, give an error."""
    bits = F.conv(F.hex(F.substring(data, SUPER_AT + 13, 1)), 16, 10).cast("int")
    good = (F.octet_length(data) >= SUPER_AT + 128) & (_le32(data, SUPER_AT) == SUPER_MAGIC) & bits.between(1, 30)
    return F.when(good, F.call_function("shiftleft", _le32(data, SUPER_AT + 36), bits)).when(data.isNotNull(), F.raise_error("no super block").cast("bigint"))


def runtime_config(text: Column) -> Column:
    """The run-time part of an image configuration in JSON: the object under "config" where it is wrapped, else the text
    itself: a struct of entrypoint, cmd, env, workdir, user."""
    fields = "Entrypoint array<string>, Cmd array<string>, Env array<string>, WorkingDir string, User string"
    wrapped = F.array_contains(F.json_object_keys(text), "config")
    c = F.from_json(F.when(wrapped, F.get_json_object(text, "$.config")).otherwise(text), fields)
    return F.struct(c["Entrypoint"].alias("entrypoint"), c["Cmd"].alias("cmd"), c["Env"].alias("env"), c["WorkingDir"].alias("workdir"), c["User"].alias("user"))
