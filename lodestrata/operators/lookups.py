"""Prioritised look-ups across generations, tiers and sources, store deduplication and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT, MISS, HIT_MISS, ERROR = "hit", "miss", "hit_miss", "error"


def generation_lookup(objects: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The newest generation's object of each key: rows (key, generation, ord, size)."""
    o = objects if wanted is None else objects.join(wanted, "key", "left_semi")
    return o.groupBy("key").agg(F.max_by(F.struct("generation", "ord", "size"), "ord").alias("o")).select("key", "o.*")


def generation_search(answers: DataFrame) -> DataFrame:
    """Answers of generations (key, ord, outcome) to a search from the newest on: the first that does not miss decides, and an
    error stops the search: (key, ord, outcome), a miss without ord if all miss."""
    first = F.max(F.when(F.col("outcome") != MISS, F.struct("ord", "outcome")))
    return answers.groupBy("key").agg(first.alias("s")).select("key", F.col("s.ord").alias("ord"), F.coalesce("s.outcome", F.lit(MISS)).alias("outcome"))


def tier_cascade(outcomes: DataFrame) -> DataFrame:
    """Look-ups (lookup, tier, outcome): the first tier that does not miss decides; none: a miss at all tiers.

    Rows (lookup, tier, outcome, fills): fills counts the tiers before a hit, which are filled from it; after a total miss
    all tiers are.
    """
    decided = F.col("outcome") != MISS
    g = outcomes.groupBy("lookup").agg(F.min_by(F.struct("tier", "outcome"), "tier").alias("any"), F.min(F.when(decided, F.struct("tier", "outcome"))).alias("d"), F.count("*").alias("tiers"))
    out = g.select("lookup", F.col("d.tier").alias("tier"), F.coalesce("d.outcome", F.lit(MISS)).alias("outcome"), "tiers")
    fills = F.when(F.col("outcome") == HIT, F.col("tier")).when(F.col("outcome") == MISS, F.col("tiers")).otherwise(0)
    return out.select("lookup", "tier", "outcome", fills.cast("long").alias("fills"))


def fill_set(decided: DataFrame) -> DataFrame:
    """The tiers to be filled of each look-up: (lookup, fill_tier)."""
    return decided.where("fills > 0").select("lookup", F.explode(F.sequence(F.lit(0), F.col("fills").cast("int") - 1)).alias("fill_tier"))


def source_select(sources: DataFrame) -> DataFrame:
    """Sources (root, ord, state): unavailable ones are passed over, the first other one is chosen, malformed fails."""
    first = F.min(F.when(F.col("state") != "unavailable", F.struct("ord", "state")))
    return sources.groupBy("root").agg(first.alias("s")).select("root", F.col("s.ord").alias("ord"), F.coalesce("s.state", F.lit("missing")).alias("state"))


def latest_valid(rows: DataFrame, key: list[str], now: Column) -> DataFrame:
    """Of rows (imported, expires, digest) valid at `now`, the latest import of each key, ties to the larger digest."""
    ok = (F.col("imported") <= now) & (F.col("expires").isNull() | ((F.col("expires") > F.col("imported")) & (now < F.col("expires"))))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("imported"), F.desc("digest")))
    return rows.where(ok).withColumn("_r", rank).where("_r = 1").drop("_r")


def store_new(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """What has to be stored: incoming rows whose key is not there yet, once each."""
    return incoming.join(stored.select(*key).distinct(), key, "left_anti").dropDuplicates(key)


def membership_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids added and removed: (id, change)."""
    added = new.join(old, "id", "left_anti").select("id", F.lit("added").alias("change"))
    return added.unionByName(old.join(new, "id", "left_anti").select("id", F.lit("removed").alias("change")))


def lru_evict(blobs: DataFrame, group: str, now: Column, target: Column, grace: str = "5 minutes") -> DataFrame:
    """Blobs (group, path, size, mtime) to be evicted: oldest first until the group's total is at most the target.

    Blobs younger than the grace are never evicted but count. Ties go by path.
    """
    total = F.sum("size").over(Window.partitionBy(group))
    b = blobs.withColumn("_total", total).where(F.col("mtime") <= now - F.expr(f"interval {grace}"))
    before = F.sum("size").over(Window.partitionBy(group).orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, -1))
    return b.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_total") - F.col("_before") > target).drop("_total", "_before")


def purge(objects: DataFrame, generation: Column) -> DataFrame:
    """Objects without a generation's; the newest generation cannot be purged."""
    newest = objects.agg(F.max_by("generation", "ord").alias("_newest"))
    kept = objects.join(F.broadcast(newest), F.lit(True))  # one row
    bad = F.raise_error("the newest generation cannot be purged")
    return kept.where(F.when(generation == F.col("_newest"), bad.cast("boolean")).otherwise(F.col("generation") != generation)).drop("_newest")


def verify_objects(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: entries verified (object there, content hash right), zero entries skipped, failed, and all."""
    j = entries.join(objects.select("key", "content_key").dropDuplicates(["key"]), "key", "left")
    good = ~F.col("is_zero") & (F.col("key") == F.coalesce("content_key", F.lit("")))
    return j.agg(F.count_if(good).alias("verified"), F.count_if("is_zero").alias("skipped"), F.count_if(~good & ~F.col("is_zero")).alias("failed"), F.count("*").alias("total"))


def closure(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Referenced keys without a chunk, chunks that nothing references, and keys with two sizes: (key, problem)."""
    r = refs.groupBy("key").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    j = r.join(chunks.select("key", F.col("size").alias("have")), "key", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("lo").isNull(), "unreferenced").when((F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("have")), "size")
    return j.select("key", problem.alias("problem")).where("problem is not null")


def as_of(left: DataFrame, right: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before it, null if there is none; of right rows
    at one place the largest value counts. Both sides go through one sorted pass, no row meets another in a range join."""
    cols = left.columns
    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_r": F.lit(1)}).unionByName(right.select(*by, order, F.col(value).alias("_v"), F.lit(0).alias("_r")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(order, "_r", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("matched", F.last("_v", ignorenulls=True).over(w)).where("_r = 1").select(*cols, "matched")


def append_generation(generations: DataFrame, name: str) -> DataFrame:
    """Generations (generation, ord) with a new one at the end; a name that is there already, or is not made of letters,
    digits, dots, dashes and underscores, is an error."""
    n = F.lit(name)
    g = generations.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).cast("bigint").alias("ord"), F.coalesce(F.bool_or(F.col("generation") == n), F.lit(False)).alias("_there"))
    bad = F.col("_there") | ~n.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$")
    new = g.select(F.when(bad, F.raise_error("a generation of that name cannot be added")).otherwise(n).alias("generation"), "ord")
    return generations.select("generation", F.col("ord").cast("bigint").alias("ord")).unionByName(new)


def admit(requests: DataFrame, generations: DataFrame) -> DataFrame:
    """Writes (request, generation) with the generation they go to: the newest if none is named, else the named one, if it
    is a current one: (request, admitted, refused)."""
    newest = generations.agg(F.max_by("generation", "ord").alias("_new"))  # one row
    r = requests.withColumn("generation", F.nullif("generation", F.lit("")))
    r = r.join(generations.select("generation", F.lit(True).alias("_ok")).distinct(), "generation", "left").join(F.broadcast(newest), F.lit(True))
    to = F.when(F.col("generation").isNull(), F.col("_new")).when(F.col("_ok"), F.col("generation"))
    return r.select("request", to.alias("admitted"), to.isNull().alias("refused"))
