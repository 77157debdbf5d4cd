"""Path rules, exclusion, layers and links of file trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_path(p: Column) -> Column:
    """A relative path without empty and "." parts; ".." takes the part before away and is an error (null) at the top."""
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(True).alias("ok"))
    done = F.aggregate(
        parts,
        start,
        lambda a, x: F.struct(
            F.when(x == "..", F.when(F.size(a["out"]) > 0, F.slice(a["out"], 1, F.size(a["out"]) - 1)).otherwise(a["out"])).otherwise(F.concat(a["out"], F.array(x))).alias("out"),
            (a["ok"] & ~((x == "..") & (F.size(a["out"]) == 0))).alias("ok"),
        ),
        lambda a: F.when(a["ok"], F.array_join(a["out"], "/")),
    )
    return done


def ancestors(p: Column) -> Column:
    """All directories above a path, the path itself last: "a/b" gives ["a", "a/b"]."""
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def match_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Each path with the rule that applies: an exact file rule (is_dir false), else the longest directory, else the root
    rule (empty pattern); ties to the least ord. An equi-join of each path's ancestors with the patterns, not a range."""
    cand = paths.select("path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("pattern"))
    j = cand.join(rules, "pattern").where("is_dir or pattern = path")
    best = F.max_by(F.struct("pattern", "ord"), F.struct((~F.col("is_dir")).cast("int"), F.length("pattern"), -F.col("ord")))
    return j.groupBy("path").agg(best.alias("b")).select("path", "b.pattern", "b.ord")


def exclude(paths: DataFrame, excluded: DataFrame) -> DataFrame:
    """Paths that neither are excluded nor lie below what is (column path of both)."""
    a = paths.select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    gone = a.join(excluded.select(F.col("path").alias("dir")), "dir", "left_semi").select("path").distinct()
    return paths.join(gone, "path", "left_anti")


def apply_layers(entries: DataFrame) -> DataFrame:
    """Entries (image, layer, path, value) of layers, lowest first: the last of a path stays, if no later layer has a
    whiteout of it or of a directory above (".wh.<name>"), or makes a directory above opaque (".wh..wh..opq").

    Whiteouts act on lower layers only, as the public image layer specification says.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    e = entries.withColumns({"_n": name, "_d": folder})
    marks = e.where("_n like '.wh.%'")
    opaque = F.col("_n") == ".wh..wh..opq"
    target = F.when(opaque, F.col("_d")).otherwise(F.concat_ws("/", F.nullif("_d", F.lit("")), F.expr("substring(_n, 5)")))
    marks = marks.select("image", target.alias("dir"), F.col("layer").alias("by"), opaque.alias("below_only")).groupBy("image", "dir", "below_only").agg(F.max("by").alias("by"))
    real = e.where("_n not like '.wh.%'").drop("_n", "_d")
    last = real.withColumn("_r", F.row_number().over(Window.partitionBy("image", "path").orderBy(F.desc("layer")))).where("_r = 1").drop("_r")
    above = last.select("image", "path", "layer", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("dir"))
    hidden = above.join(marks, ["image", "dir"]).where("layer < `by` and not (below_only and dir = path)").select("image", "path").distinct()
    return last.join(hidden, ["image", "path"], "left_anti")


def hard_links(files: DataFrame) -> DataFrame:
    """Each path with the first path of the same device and inode: (path, canonical, is_link)."""
    first = F.min("path").over(Window.partitionBy("dev", "ino"))
    return files.select("path", first.alias("canonical"), (F.col("path") != first).alias("is_link"))
