"""Chat formatting after cumulative-snapshot collapse (operator 2), DataFrame functions only.

A conversation is often logged again after each turn, so that shorter logs are prefixes of longer ones. A turn's hash
covers its position, role and text; the sum of the hashes up to a turn identifies the prefix that ends there. An anti-join
of whole conversations against proper prefixes leaves the maximal ones, equal ones are reduced to the smallest id, and
only those are rendered.

Sums run over blocks of turns and then over the blocks' totals, so that no conversation has to be sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Turn numbers in a block of a conversation.
BLOCK = 1024
_NONE = -(1 << 63)  # stands for a null id or turn while sorting and joining


def _turns(convs: DataFrame) -> DataFrame:
    return convs.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NONE)).alias("c"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_NONE)).alias("o"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("x"),
    ).withColumn("b", F.expr(f"o div {BLOCK}"))


def prefixes(convs: DataFrame) -> DataFrame:
    """Rows (c, pos, n, h1, h2): for each turn its position in the conversation c of n turns, and the prefix's two hashes.

    Turns are ordered by number, then role, then text; null roles and texts count as empty, a null number comes first.
    """
    t = _turns(convs)
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("c", "b").agg(F.count("*").alias("k"))
    blocks = blocks.select("c", "b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("skip"), F.sum("k").over(Window.partitionBy("c")).alias("n"))
    run = Window.partitionBy("c", "b").orderBy("o", "r", "x")
    at = t.join(blocks, ["c", "b"]).withColumn("pos", F.col("skip") + F.row_number().over(run))
    big = "decimal(38,0)"
    at = at.select("c", "b", "pos", "n", F.xxhash64("pos", "r", "x").cast(big).alias("u1"), F.xxhash64("x", "r", "pos", F.lit(1)).cast(big).alias("u2"))
    so_far = Window.partitionBy("c", "b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = cut(at.select("c", "b", "pos", "n", F.sum("u1").over(so_far).cast(big).alias("p1"), F.sum("u2").over(so_far).cast(big).alias("p2")))
    total = at.groupBy("c", "b").agg(F.max_by("p1", "pos").alias("t1"), F.max_by("p2", "pos").alias("t2"))
    total = total.select("c", "b", *(F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).cast(big).alias(f"q{i}") for i in (1, 2)))
    return at.join(total, ["c", "b"]).select("c", "pos", "n", *((F.col(f"p{i}") + F.col(f"q{i}")).cast(big).alias(f"h{i}") for i in (1, 2)))


def maximal(convs: DataFrame) -> DataFrame:
    """Rows (c, n, copies): the conversations that are no proper prefix of another, one for each content."""
    p = cut(prefixes(convs))
    whole = p.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("c").alias("c"), F.count("*").alias("copies"))
    inner = p.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("c", "n", "copies")


def render(convs: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, n_copies, chat), one for each maximal conversation.

    chat has <|role|>, a line break, the text and <|end|> with a line break for each turn; "<|" within a role or text
    becomes "< |". n_copies counts equal conversations, of which the smallest id is reported. Turns with a null id form
    one conversation with a null id; repeated turns are turns of their own; an empty table gives an empty result; other
    columns are ignored. A very long text is a value like any other; a rendered conversation is one value, so it has to fit a
    row (2 GB). Turns with equal numbers are put in order in one task.
    """
    keep = cut(maximal(convs))

    def plain(c):
        return F.replace(F.col(c), F.lit("<|"), F.lit("< |"))

    turns = _turns(convs).join(keep, "c")
    piece = F.concat(F.lit("<|"), plain("r"), F.lit("|>\n"), plain("x"), F.lit("<|end|>\n")).alias("p")
    chats = turns.groupBy("c", "n", "copies").agg(F.array_sort(F.collect_list(F.struct("o", "r", "x", piece))).alias("t"))
    chat = F.array_join(F.transform("t", lambda t: t["p"]), "")
    return chats.select(F.nullif("c", F.lit(_NONE)).alias("conv_id"), F.col("n").alias("n_turns"), F.col("copies").alias("n_copies"), chat.alias("chat"))


def op2_chat(spark, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT coalesce(conv_id, -9223372036854775808) AS c, coalesce(turn, -9223372036854775808) AS o, coalesce(role, '') AS r, coalesce("text", '') AS x
  FROM conversations
), p AS (
  SELECT c, row_number() OVER w AS pos, count(*) OVER (PARTITION BY c) AS n,
         string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER w AS h
  FROM t WINDOW w AS (PARTITION BY c ORDER BY o, r, x ROWS UNBOUNDED PRECEDING)
), whole AS (
  SELECT n, h, min(c) AS c, count(*) AS copies FROM p WHERE pos = n GROUP BY n, h
), keep AS (
  SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = whole.n AND p.h = whole.h)
)
SELECT nullif(t.c, -9223372036854775808) AS conv_id, n AS n_turns, copies AS n_copies,
       string_agg('<|' || replace(r, '<|', '< |') || '|>' || chr(10) || replace(x, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY o, r, x) AS chat
FROM t JOIN keep ON t.c = keep.c GROUP BY t.c, n, copies
"""
