"""Secret scans with multipart credential linking (operator 4), DataFrame functions only.

A credential often has parts: an access identifier, a secret and an endpoint. Patterns that are secret by themselves are
always reported. Weak candidates (endpoints, and bare mixed tokens that might be anything) are reported only where a
complementary part occurs within the same scope: scopes are blocks of `SCOPE` code points, and a part reaches the blocks
that touch its own, so the interval join is a look-up of block numbers in the set of blocks that hold a partner. That
set has at most one entry for each block of the text, whatever the number of parts. Everything is computed within the
row of a document: no shuffle, and no key that could be hot. Positions, overlaps and nearest partners come from running sums,
maxima and minima over sorted spans, by doubling steps, so that n spans take n log n steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# The patterns of the base kinds, each with the least length that is kept (of group 2 for assign).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Weak kinds: reported only beside a complementary part.
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\x20\x09-\x0D"'<>]*)?"""
BARE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "endpoint", "bare")
SCOPE = 512
#: Code points in a block of a text that is mended.
PART = 1024


NONE = "cast(array() as array<struct<s:int,e:int,h:int>>)"
_FAR = 1 << 30


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, join) -> Column:
    """Running results of an associative `join` over an array, in steps that double their reach."""
    steps = F.filter(F.lit([1 << i for i in range(30)]), lambda k: k < F.size(values))
    return F.aggregate(steps, values, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, join(x, F.get(acc, i - k))).otherwise(x)))


def _spans(text: Column, pattern: str, least: int, group: int = 0) -> Column:
    """Matches of `pattern`, leftmost and non-overlapping, as structs (s, e) of code points, those of `least` code points.

    Gaps between matches and matches alternate, so running sums of their lengths are the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else None

    def place(sizes: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(sizes)).alias("g"), sizes.alias("m"), (sizes if held is None else held).alias("h"))

        def ends(rows: Column) -> Column:
            both = F.arrays_zip(rows.alias("r"), _running(F.transform(rows, lambda x: x["g"] + x["m"]), lambda x, y: x + y).alias("e"))
            return F.filter(F.transform(both, lambda x: F.struct((x["e"] - x["r"]["m"]).alias("s"), x["e"].alias("e"), x["r"]["h"].alias("h"))), lambda x: x["h"] >= least)

        return _let(rows, ends)

    return _let(F.transform(found, F.length), lambda sizes: F.when(F.size(sizes) > 0, place(sizes)).otherwise(F.expr(NONE)))


def _flanked(spans: Column, others: Column, place, last, first) -> Column:
    """Rows (x, before, after) for each span x, in order: the greatest `last` of the others that stand at its place or before,
    and the least `first` of those that stand after."""

    def row(kind: int):
        return lambda x: F.struct(place(x).alias("p"), F.lit(kind).alias("k"), F.when(F.lit(kind == 0), last(x)).otherwise(-_FAR).alias("l"), F.when(F.lit(kind == 0), first(x)).otherwise(_FAR).alias("f"), x["s"].alias("s"), x["e"].alias("e"), x["h"].alias("h"))

    def flank(events: Column) -> Column:
        before = _running(F.transform(events, lambda x: x["l"]), F.greatest)
        after = F.reverse(_running(F.transform(F.reverse(events), lambda x: x["f"]), F.least))
        return F.filter(F.arrays_zip(events.alias("x"), before.alias("before"), after.alias("after")), lambda z: z["x"]["k"] == 1)

    return _let(F.array_sort(F.concat(F.transform(others, row(0)), F.transform(spans, row(1)))), flank)


def _plain(flanked: Column) -> Column:
    return F.transform(flanked, lambda z: F.struct(z["x"]["s"].alias("s"), z["x"]["e"].alias("e"), z["x"]["h"].alias("h")))


def _tag(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e")))


def _join(spans: Column) -> Column:
    """kind:start:end, by start and then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _beside(weak: Column, partners: Column, scope: int) -> Column:
    """The weak spans with a partner in their own scope or one that touches it."""

    def block(x: Column) -> Column:
        return F.floor(x["s"] / scope).cast("int")

    near = F.filter(_flanked(weak, partners, block, block, block), lambda z: (z["x"]["p"] - z["before"] <= 1) | (z["after"] - z["x"]["p"] <= 1))
    return _plain(near)


def _clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    rows = _flanked(spans, others, lambda x: x["s"], lambda x: x["e"], lambda x: x["s"])
    return _plain(F.filter(rows, lambda z: (z["before"] <= z["x"]["s"]) & (z["after"] >= z["x"]["e"])))


def scan(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """`docs` with array columns _assign, _access, _hex (base), _endpoint, _bare (linked weak spans): structs (s, e).

    Null texts count as empty and have no span. Work is by row, so repeated rows give repeated results, an empty table
    an empty one; columns of these five names are replaced. A very long text of n spans takes memory for its spans, and n log n
    steps.

    Links: an endpoint needs a secret or an access identifier in reach; a bare token, not inside a base span, needs an
    access identifier, or an endpoint, in reach.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumns(
        {
            "_assign": F.when(t.rlike(f"(?i){ASSIGN}"), _spans(t, f"(?i){ASSIGN}", LEAST["assign"], 2)),
            # runs long enough are the same matches: what is too short is dropped, and a run has no second chance
            "_access": F.when(t.contains("AKIA"), _spans(t, rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", 0)),
            "_hex": _spans(t, rf"[0-9a-f]{{{LEAST['hex']},}}", 0),
            "_endpoint": F.when(t.contains("://"), _spans(t, ENDPOINT, 0)),
        }
    )
    none = F.expr(NONE)
    base = base.withColumns({c: F.coalesce(F.col(c), none) for c in ("_assign", "_access", "_endpoint")})
    anchored = (F.size("_access") > 0) | (F.size("_endpoint") > 0)
    base = base.withColumn("_bare", F.when(anchored, _spans(t, BARE, 0)).otherwise(none))
    strong = F.concat("_assign", "_access", "_hex")
    base = base.withColumn("_bare", F.when(F.size("_bare") > 0, _clear_of(F.col("_bare"), F.concat(strong, F.col("_endpoint")))).otherwise(none))
    return base.withColumns(
        {
            "_endpoint": F.when(F.size("_endpoint") > 0, _beside(F.col("_endpoint"), strong, scope)).otherwise(none),
            "_bare": F.when(F.size("_bare") > 0, _beside(F.col("_bare"), F.concat("_access", "_endpoint"), scope)).otherwise(none),
        }
    )


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is reported of each row: counts of base spans, hash of the base spans, and all spans."""
    kinds = [_tag(F.col(f"_{k}"), i) for i, k in enumerate(KINDS)]
    return scanned.select(
        F.col(id_col).alias("doc_id"),
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_join(F.concat(*kinds[:3])).cast("binary"), 256).alias("base_sha256"),
        _join(F.concat(*kinds)).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """`docs` with every reported span of the text replaced by `mask` (overlapping spans by one); other texts unchanged."""
    marked = scan(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col(text_col).alias("_text")), "_text", scope)
    t = F.col("_text")
    spans = F.array_sort(F.concat(*(_tag(F.col(f"_{k}"), i) for i, k in enumerate(KINDS))))

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b - 1, from the blocks of the text that hold them."""

        def part(j: Column) -> Column:
            lo = F.greatest(a - j * PART, F.lit(0))
            return F.get(blocks, j).substr(lo + 1, F.least(b - j * PART, F.lit(PART)) - lo)

        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / PART).cast("int"), F.floor((b - 1) / PART).cast("int")), part), "")).otherwise("")

    def mend(z: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), _running(F.transform(z["spans"], lambda x: x["e"]), F.greatest))
        rows = F.slice(F.arrays_zip(z["spans"].alias("x"), ends.alias("at")), F.lit(1), F.size(z["spans"]))
        kept = F.transform(rows, lambda r: F.when(r["x"]["s"] >= r["at"], F.concat(piece(z["blocks"], r["at"], r["x"]["s"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(kept, ""), _let(F.array_max(ends), lambda at: piece(z["blocks"], at, z["size"])))

    merged = _let(F.struct(spans.alias("spans"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("blocks"), F.length(t).alias("size")), mend)
    hit = reduce(lambda a, b: a | b, (F.size(f"_{k}") > 0 for k in KINDS))
    return marked.select(*(F.when(hit, merged).otherwise(t).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(k: int, pattern: str, least: int, group: int = 0) -> str:
    return f"SELECT r, {k} AS k, {least} AS least, regexp_split_to_array(t, {_q(pattern)}) AS gs, regexp_extract_all(t, {_q(pattern)}) AS ms, regexp_extract_all(t, {_q(pattern)}, {group}) AS hs FROM d WHERE regexp_matches(t, {_q(pattern)})"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce("text", '') AS t FROM documents),
raw AS ({" UNION ALL ".join((_kind(0, "(?i)" + ASSIGN, LEAST["assign"], 2), _kind(1, ACCESS, LEAST["access"]), _kind(2, HEX, LEAST["hex"]), _kind(3, ENDPOINT, 0), _kind(4, BARE, 0)))}),
one AS (SELECT r, k, least, unnest(range(len(ms))) AS i, unnest(list_transform(gs[1:len(ms)], lambda x: length(x))) AS g, unnest(list_transform(ms, lambda x: length(x))) AS m, unnest(list_transform(hs, lambda x: length(x))) AS h FROM raw),
at_ AS (SELECT r, k, least, h, sum(g + m) OVER (PARTITION BY r, k ORDER BY i ROWS UNBOUNDED PRECEDING) - m AS s, sum(g + m) OVER (PARTITION BY r, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM one),
span AS (SELECT r, k, s, e, s // {SCOPE} AS b FROM at_ WHERE h >= least),
linked AS (
  SELECT r, k, s, e FROM span WHERE k < 3
  UNION ALL SELECT r, k, s, e FROM span x WHERE k = 3 AND EXISTS (SELECT 1 FROM span o WHERE o.r = x.r AND o.k < 3 AND abs(o.b - x.b) <= 1)
  UNION ALL SELECT r, k, s, e FROM span x WHERE k = 4 AND EXISTS (SELECT 1 FROM span o WHERE o.r = x.r AND o.k IN (1, 3) AND abs(o.b - x.b) <= 1)
    AND NOT EXISTS (SELECT 1 FROM span o WHERE o.r = x.r AND o.k <= 3 AND o.s < x.e AND x.s < o.e)
),
said AS (SELECT r, k, s, {list(KINDS)}[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM linked),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM said GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.r = d.r
"""
