"""A store of objects in a shared folder: partition/generation/aa/bb/key, and its list of generations."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import generations_problem

#: Tries of an update of the list of generations that others may update too.
TRIES = 5


def place(root: str, partition: str, generation: str, key: str) -> str:
    return os.path.join(root, partition, generation, key[:2], key[2:4], key)


def put(objects: DataFrame, root: str) -> DataFrame:
    """Write objects (partition, generation, key, data, size) and tell what became of each: (partition, generation, key, state).

    A key that is there already is left alone ('exists'). Bytes go to a file of their own first; only if their number and
    their hash are right does it get its name, which it can get once only ('stored'; 'exists' for whoever comes second).
    Otherwise what was written is taken away ('bad size', 'bad digest'). A task that runs again finds its own objects there.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            states = []
            for o in f.itertuples():
                at = place(root, o.partition, o.generation, o.key)
                if os.path.exists(at):
                    states.append("exists")
                    continue
                os.makedirs(os.path.dirname(at), exist_ok=True)
                temp = f"{at}.{uuid.uuid4().hex}.part"
                try:
                    with open(temp, "xb") as t:
                        t.write(o.data)
                        t.flush()
                        os.fsync(t.fileno())
                    if len(o.data) != o.size:
                        states.append("bad size")
                    elif hashlib.sha256(o.data).hexdigest() != o.key:
                        states.append("bad digest")
                    else:
                        try:
                            os.link(temp, at)  # fails if the name is taken: only one writer commits
                            states.append("stored")
                        except FileExistsError:
                            states.append("exists")
                finally:
                    os.unlink(temp)
            yield f[["partition", "generation", "key"]].assign(state=states)

    rows = objects.select("partition", "generation", "key", "data", F.col("size").cast("bigint").alias("size"))
    return rows.mapInPandas(write, "partition string, generation string, key string, state string")


def get(wanted: DataFrame, root: str, newest_first: list[str]) -> DataFrame:
    """Wanted objects (partition, key) with generation and data from the newest generation that has them, null if none has."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for o in f.itertuples():
                found = next((g for g in newest_first if os.path.exists(place(root, o.partition, g, o.key))), None)
                data = open(place(root, o.partition, found, o.key), "rb").read() if found else None
                yield pd.DataFrame({"partition": [o.partition], "key": [o.key], "generation": [found], "data": [data]})

    return wanted.select("partition", "key").mapInPandas(read, "partition string, key string, generation string, data binary")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All committed objects (partition, generation, key, size) under the folder; unfinished ones do not count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9a-f]*").load(root)
    tail = r"([^/]+)/([^/]+)/[0-9a-f]{2}/[0-9a-f]{2}/([0-9a-f]{64})$"
    parts = [F.regexp_extract("path", tail, i).alias(n) for i, n in enumerate(("partition", "generation", "key"), 1)]
    return files.select(*parts, F.col("length").alias("size")).where("key <> ''")


def upload(chunks: DataFrame, manifests: DataFrame, root_key: str, root: str) -> dict[str, int]:
    """Write chunks, then the manifests that stand for them, then the manifest `root_key`, so that whoever sees the root finds
    all it names. An object that is not taken stops it before the root is written. Returns how many were stored or there."""
    counts: dict[str, int] = {}
    head = manifests.where(F.col("key") == root_key)
    for name, rows in (("chunks", chunks), ("manifests", manifests.where(F.col("key") != root_key)), ("root", head)):
        got = {r["state"]: r["count"] for r in put(rows, root).groupBy("state").count().collect()}
        if bad := set(got) - {"stored", "exists"}:
            raise ValueError(f"{name}: {sorted(bad)}")
        counts[name] = sum(got.values())
    if counts["root"] != 1:
        raise ValueError("the root is not one of the manifests")
    return counts


def read_generations(path: str) -> tuple[list[str], str]:
    """The list of generations, oldest first, and a tag of what was read."""
    raw = open(path, "rb").read() if os.path.exists(path) else b""
    return [x for x in raw.decode().split("\n") if x], hashlib.sha256(raw).hexdigest()


def update_generations(spark: SparkSession, path: str, change: Callable[[list[str]], list[str]], tries: int = TRIES) -> list[str]:
    """Replace the list by change(list) if nobody else has since it was read, else try again, at most `tries` times. A list that
    is empty, too long, or has an unsafe or repeated name is an error and is not written."""
    for _ in range(tries):
        now, tag = read_generations(path)
        new = change(list(now))
        wrong = spark.range(1).select(generations_problem(F.lit(new) if new else F.expr("cast(array() as array<string>)"))).first()[0]
        if wrong:
            raise ValueError(f"generations: {wrong}")
        lock = f"{path}.lock"
        try:
            fd = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            continue
        try:
            if read_generations(path)[1] != tag:
                continue
            temp = f"{path}.{uuid.uuid4().hex}"
            with open(temp, "w") as f:
                f.write("".join(f"{g}\n" for g in new))
            os.replace(temp, path)
            return new
        finally:
            os.close(fd)
            os.unlink(lock)
    raise RuntimeError(f"the list of generations was changed by others {tries} times")
