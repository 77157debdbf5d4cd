"""Mixing to target weights by soft membership (operator 9), DataFrame functions only.

A naive Bayes model on hashed words, fitted on the labelled table, gives each document the probabilities of the domains.
Nonnegative rates are then fitted, one for each document, so that the expected tokens of each domain (sum of rate x
tokens x probability) match targets. A step of the fit needs only the domains' totals, one small aggregate over all
documents; the rates are an expression of one number for each domain, so nothing is stored for each step and no row is
collected.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, table

#: Domains, as conditions on the labelled table, and their share of the expected tokens.
DOMAINS = {"clean": "quality = 1 and toxic = 0", "toxic": "quality = 1 and toxic = 1", "junk": "quality = 0"}
TARGETS = {"clean": 0.9, "toxic": 0.02, "junk": 0.08}
#: Labelled rows that the domain classifier is fitted on, at most (those with the least hash of their id).
MAX_LABELS = 20_000
BUCKETS = 4096
#: A text's log likelihood counts as that of so many words, so that long texts keep soft memberships.
SOFTNESS = 64.0
#: Steps at most; some ten are needed. The weight of u's square in the fit.
STEPS = 100
RIDGE = 1e-9


class MixWarning(UserWarning):
    """Targets that no rates of the documents at hand meet."""


def _bucket(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")


def _table(values: list[float]) -> Column:
    """A constant array, as one foldable expression instead of one for each value."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _words(text: Column) -> Column:
    """Pieces of a text between single white-space characters, in lower case; some may be empty."""
    return F.split(F.translate(text, UPPER + "\t\n\x0b\x0c\r", LOWER + "     "), " ")


def fit(docs: DataFrame, labels: DataFrame, domains: dict[str, str], max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[float], list[list[float]]]:
    """Log priors of the domains, and for each a table of log likelihoods by bucket of word.

    Labels that are null or meet no domain's condition are left out; without any, all domains are equally likely.
    """
    case = F.lit(None).cast("int")
    for i, cond in reversed(list(enumerate(domains.values()))):
        case = F.when(F.expr(cond), F.lit(i)).otherwise(case)
    y = labels.select(F.col(id_col).cast("long").alias("_id"), case.alias("_y")).where("_id is not null and _y is not null")
    y = cut(y.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_labels))  # the documented bound on training rows
    x = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(y), "_id")
    each = x.select("_y", F.explode(_words(F.col("_t"))).alias("w")).where("w <> ''").select("_y", _bucket(F.col("w")).alias("b"))
    counts = [[0.5] * BUCKETS for _ in domains]
    for r in each.groupBy("_y", "b").count().collect():  # at most BUCKETS x domains rows
        counts[r["_y"]][r["b"]] += r["count"]
    n = {r["_y"]: r["count"] for r in y.groupBy("_y").count().collect()}
    total = sum(n.values()) + len(domains)
    prior = [math.log((n.get(i, 0) + 1) / total) for i in range(len(domains))]
    like = []
    for row in counts:
        s = math.fsum(row)
        like.append([math.log(c / s) for c in row])
    mean = [math.fsum(r[b] for r in like) / len(like) for b in range(BUCKETS)]  # common to all domains: cancels
    return prior, [[round(v - m, 6) for v, m in zip(r, mean, strict=True)] for r in like]


def memberships(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Rows (id, tokens, p0, p1, ...): words of each row's text, and the probabilities of the domains; with `carry` also
    _row, the row itself. Computed within the row, so repeated rows stay apart and no word is shuffled."""
    prior, like = model
    k = range(len(like))
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("_row")] if carry else []
    words = F.filter(_words(F.coalesce(F.col(text_col), F.lit(""))), lambda w: w != "")
    e = docs.select(*row, F.col(id_col).alias("id"), F.transform(words, _bucket).alias("_b"))

    def total(values: list[float]) -> Column:
        t = _table(values)
        return F.aggregate("_b", F.lit(0.0), lambda acc, b: acc + F.get(t, b))

    rest = ["_row"] if carry else []
    e = e.select(*rest, "id", F.size("_b").cast("double").alias("tokens"), *(total(r).alias(f"s{i}") for i, r in enumerate(like)))
    scale = F.least(F.lit(1.0), F.lit(SOFTNESS) / F.greatest(F.col("tokens"), F.lit(1.0)))
    e = e.select(*rest, "id", "tokens", F.array(*(F.lit(prior[i]) + F.col(f"s{i}") * scale for i in k)).alias("_l"))
    e = e.select(*rest, "id", "tokens", *(F.exp(F.col("_l")[i] - F.array_max("_l")).alias(f"e{i}") for i in k))
    z = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return e.select(*rest, "id", "tokens", *((F.col(f"e{i}") / z).alias(f"p{i}") for i in k))


def fit_rates(members: DataFrame, shares: list[float], steps: int = STEPS, tolerance: float = 1e-6) -> tuple[Column, list[float]]:
    """The rate of a row as an expression of its p0, p1, ..., and the domains' expected shares of tokens in the end.

    Of all nonnegative rates that meet the targets, those nearest to one, squares weighed by tokens: max(0, 1 + u . p)
    for one vector u. Found as the maximum of a concave function of u by Newton's steps, each halved until it climbs; a
    step needs one aggregate of a few numbers. RIDGE makes the maximum unique, and gives the least squares in the relative
    errors where targets are out of reach. Totals are in units of all tokens; targets sum to one.
    """
    k = range(len(shares))
    target = np.array([max(s, 1e-9) for s in shares])
    n = F.col("tokens")
    total = members.agg(F.sum("tokens")).first()[0] or 0.0
    if total <= 0:
        return F.lit(1.0), [0.0 for _ in k]

    def rate(u) -> Column:
        return F.greatest(F.lit(0.0), sum((F.col(f"p{i}") * float(u[i]) for i in k), F.lit(1.0)))

    def at(u):
        """The function, the shares and the matrix of second derivatives at u."""
        e = members.withColumn("_r", rate(u))
        on = F.when(F.col("_r") > 0, n).otherwise(0.0)
        row = e.agg(
            F.sum(n * F.col("_r") * F.col("_r")).alias("q"), *(F.sum(n * F.col("_r") * F.col(f"p{i}")).alias(f"s{i}") for i in k),
            *(F.sum(on * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i in k for j in k if i <= j),
        ).first()
        have = np.array([row[f"s{i}"] for i in k]) / total
        second = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in k] for i in k]) / total + np.diag(RIDGE * target)
        return float(u @ target - RIDGE / 2 * (u * u) @ target - row["q"] / total / 2), have, second

    u = np.zeros(len(target))
    value, have, second = at(u)
    for _ in range(steps):
        slope = target - have - RIDGE * target * u
        if np.all(np.abs(slope) <= tolerance * target):
            break
        step, part = np.linalg.solve(second, slope), 1.0
        while True:
            new = at(u + part * step)
            if new[0] >= value + 1e-4 * part * (slope @ step) or part < 1e-6:
                break
            part /= 2
        if part < 1e-6:  # as near as the sums' rounding allows
            break
        u = u + part * step
        value, have, second = new
    return rate(u), [float(h) for h in have]


def missed(have: list[float], shares: list[float], within: float = 1e-2) -> list[int]:
    """The domains whose share is further than `within` of its target from it."""
    return [i for i, (h, s) in enumerate(zip(have, shares, strict=True)) if abs(h - s) > within * s + 1e-6]


def _fitted(docs, labels, domains, targets, id_col, text_col, max_labels, steps):
    """The classifier, the members, and the rate of each as an expression."""
    shares = [float(targets[d]) for d in domains]
    shares = [s / sum(shares) for s in shares]
    model = fit(docs, labels, domains, max_labels, id_col, text_col)
    members = cut(memberships(docs, model, id_col, text_col))
    rate, have = fit_rates(members, shares, steps)
    if off := missed(have, shares):
        said = ", ".join(f"{d} {have[i]:.4g} of {shares[i]:.4g}" for i, d in enumerate(domains) if i in off)
        warnings.warn(f"the documents' memberships do not reach the targets: {said} of all tokens", MixWarning, stacklevel=3)
    return model, members, rate


def _dealt(members: DataFrame, rate: Column, domains) -> list[Column]:
    luck = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(rate) + (luck < rate - F.floor(rate)).cast("long")
    return [F.col("tokens").cast("long").alias("tokens"), *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), rate.alias("rate"), copies.alias("copies")]


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domains: dict[str, str] | None = None,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labels: int = MAX_LABELS,
    steps: int = STEPS,
) -> DataFrame:
    """Rows (id, tokens, p_<domain>..., rate, copies), one for each row of `docs`.

    rate is how often a document should be seen on average; copies, its rate rounded up or down at random by a hash of
    its id, so that expected totals are kept. Null and empty texts have no tokens and the domains' priors; they move no
    total. Null ids are carried; repeated rows are rated alike; an empty table gives an empty result; other columns are
    ignored. Targets are scaled to sum to one. If they are out of reach, a MixWarning names the shares that are reached. A
    very long text takes memory in proportion to its words.
    """
    domains, targets = domains or DOMAINS, targets or TARGETS
    _, members, rate = _fitted(docs, labels, domains, targets, id_col, text_col, max_labels, steps)
    return members.select(F.col("id").alias(id_col), *_dealt(members, rate, domains))


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    domains: dict[str, str] | None = None,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labels: int = MAX_LABELS,
    steps: int = STEPS,
) -> DataFrame:
    """The mixed table: the rows of `docs` that mix() gives at least one copy, with all their columns and tokens, p_<domain>...,
    rate and copies, which stand for so many repetitions. Columns of these names in `docs` are replaced.

    Texts are not stored or shuffled for it: memberships are computed again where a row is.
    """
    domains, targets = domains or DOMAINS, targets or TARGETS
    model, members, rate = _fitted(docs, labels, domains, targets, id_col, text_col, max_labels, steps)
    new = ["tokens", *(f"p_{d}" for d in domains), "rate", "copies"]
    rows = memberships(docs, model, id_col, text_col, carry=True)
    # the row number keeps the condition where it is: pushed down, it would be computed from the text once for each mention
    rows = rows.select("_row", *_dealt(rows, rate, domains), F.monotonically_increasing_id().alias("_at")).where("copies > 0 and _at >= 0")
    return rows.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in new), *new)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
