"""Extraction of tar archives to a folder by path rules."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import parse_rule
from ..operators.paths import ancestors
from .archives import PIECE, tar_members, tar_pieces


def rules_of(rules: DataFrame) -> DataFrame:
    """Parsed rules (ord, tar, fs, prefix) from rows (ord, rule); one that cannot be read, or a second one that goes to the
    standard output, is an error."""
    r = rules.select("ord", "rule", parse_rule(F.col("rule")).alias("r"))
    bad = F.concat(F.lit("rule "), F.col("rule"), F.lit(": "), F.col("r.error"))
    r = r.select("ord", F.when(F.col("r.error").isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("r.tar")).alias("tar"), F.col("r.fs").alias("fs"), F.col("r.prefix").alias("prefix"))
    outs = r.agg(F.count_if((F.col("fs") == "-") & ~F.col("prefix")).alias("_outs"))  # one row
    several = F.when(F.col("_outs") > 1, F.raise_error("more than one rule goes to the standard output").cast("string"))
    return r.join(F.broadcast(outs), F.lit(True)).select("ord", F.coalesce(several, F.col("tar")).alias("tar"), "fs", "prefix")


def _plain_path(p: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(p, r"^(\./|/)+", ""), "/$", "")


def plan(members: DataFrame, rules: DataFrame, strict: bool = True) -> DataFrame:
    """Members with `target`, where a rule puts them: an exact file rule first, else the longest folder, else the archive's
    root; the least ord among equals. Members that no rule matches are left out; a rule but for the root that matches none
    is an error (unless not `strict`). Of several members that go to one target the last counts."""
    m = members.withColumn("_p", _plain_path(F.col("path")))
    r = rules.select("ord", "tar", "fs", "prefix")
    cand = m.select("archive", "ordinal", "_p", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("_p")))).alias("tar"))
    hit = cand.join(r, "tar").where("prefix or tar = _p")
    best = F.max_by(F.struct("tar", "fs", "prefix"), F.struct((~F.col("prefix")).cast("int"), F.length("tar"), -F.col("ord")))
    chosen = hit.groupBy("archive", "ordinal").agg(best.alias("b"))
    rest = F.expr("substring(_p, length(b.tar) + 1)")
    rest = F.regexp_replace(rest, "^/", "")
    target = F.when(~F.col("b.prefix") | (rest == ""), F.col("b.fs")).otherwise(F.concat_ws("/", F.when(F.col("b.fs") == "/", "").otherwise(F.col("b.fs")), rest))
    out = m.join(chosen, ["archive", "ordinal"]).withColumn("target", target).drop("_p", "b")
    last = out.groupBy("target").agg(F.max(F.struct("archive", "ordinal")).alias("_l"))
    out = out.join(last, "target").where((F.col("_l.archive") == F.col("archive")) & (F.col("_l.ordinal") == F.col("ordinal"))).drop("_l")
    if not strict:
        return out
    idle = r.where("tar <> ''").join(hit.select("ord").distinct(), "ord", "left_anti").agg(F.min("tar").alias("_idle"))  # one row
    stop = F.raise_error(F.concat(F.lit("no member matches the rule for "), "_idle")).cast("string")
    return out.join(F.broadcast(idle), F.lit(True)).withColumn("target", F.when(F.col("_idle").isNotNull(), stop).otherwise(F.col("target"))).drop("_idle")


def _inside(root: str, target: str) -> str:
    """The path of a target below the root, whatever it says."""
    parts = [p for p in target.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"{target} leaves the folder")
    return os.path.join(root, *parts)


def extract(archives: DataFrame, rules: DataFrame, root: str, owner: tuple[int, int] | None = None, mode: int | None = None) -> DataFrame:
    """Write the members of archives that rules choose below `root`, a folder that all tasks share, and return what was written:
    (target, type, size, digest).

    Folders come first, then files at their full size with holes left out, then pieces of bounded size at their places, then
    links. A task that runs again writes the same bytes to the same places. Symbolic links are made last and never followed.
    """
    members = tar_members(archives)
    todo = plan(members, rules_of(rules)).where("target <> '-'")
    from ..operators.stored import cut

    todo = cut(todo.select("archive", "ordinal", "target", "type", "size", "mode", "link"))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f.itertuples():
                at = _inside(root, t.target)
                if t.type == "dir":
                    os.makedirs(at, exist_ok=True)
                elif t.type == "file":
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    fd = os.open(at, os.O_WRONLY | os.O_CREAT | os.O_NOFOLLOW, 0o600)
                    os.ftruncate(fd, int(t.size))
                    os.fchmod(fd, int(t.mode if mode is None else mode) & 0o7777)
                    if owner is not None:
                        os.fchown(fd, *owner)
                    os.close(fd)
            yield f[["target"]]

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f.itertuples():
                fd = os.open(_inside(root, t.target), os.O_WRONLY | os.O_NOFOLLOW)
                os.pwrite(fd, t.data, int(t.start))
                os.close(fd)
            yield f[["target"]]

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f.itertuples():
                at = _inside(root, t.target)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                if os.path.lexists(at):
                    os.unlink(at)
                os.symlink(t.link, at) if t.type == "symlink" else os.link(_inside(root, t.source), at)
            yield f[["target"]]

    todo.mapInPandas(make, "target string").count()
    wanted = todo.where("type = 'file'").select("archive", "ordinal", "target")
    pieces = tar_pieces(archives, PIECE).join(wanted, ["archive", "ordinal"])
    pieces.select("target", "start", "data").mapInPandas(fill, "target string").count()
    # a hard link names a path of the archive; of several members of that path the last is there
    named = members.select("archive", _plain_path(F.col("path")).alias("_name"), F.col("ordinal").alias("_o")).groupBy("archive", "_name").agg(F.max("_o").alias("_o"))
    sources = todo.select("archive", F.col("ordinal").alias("_o"), F.col("target").alias("source"))
    links = todo.where("type in ('symlink', 'hardlink')").withColumn("_name", _plain_path(F.col("link"))).join(named, ["archive", "_name"], "left").join(sources, ["archive", "_o"], "left")
    lost = (F.col("type") == "hardlink") & F.col("source").isNull()
    links = links.withColumn("source", F.when(lost, F.raise_error("a hard link to a member that is not extracted").cast("string")).otherwise(F.coalesce("source", F.lit(""))))
    links.mapInPandas(link, "target string").count()
    digest = tar_pieces(archives, PIECE).join(wanted, ["archive", "ordinal"]).groupBy("target").agg(F.sum(F.octet_length("data")).alias("stored"))
    return todo.join(digest, "target", "left").select("target", "type", "size", F.coalesce("stored", F.lit(0)).alias("stored"))


def extract_file(archives: DataFrame, path: Column | str, target: str) -> int:
    """One regular member of one archive as the file `target`, holes kept; its size. Its pieces are written by tasks; no member
    or more than one of that path is an error."""
    want = F.lit(path) if isinstance(path, str) else path
    rows = tar_members(archives).where((F.col("path") == want) & (F.col("type") == "file")).select("archive", "ordinal", "size").take(2)
    if len(rows) != 1:
        raise ValueError("not exactly one regular member of that path")
    r = rows[0]
    with open(target, "wb") as f:
        f.truncate(r["size"])

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f.itertuples():
                fd = os.open(target, os.O_WRONLY)
                os.pwrite(fd, t.data, int(t.start))
                os.close(fd)
            yield f[["start"]]

    mine = tar_pieces(archives).where((F.col("archive") == r["archive"]) & (F.col("ordinal") == r["ordinal"]))
    mine.select("start", "data").mapInPandas(fill, "start bigint").count()
    return int(r["size"])
