"""Quality classifier by hierarchical empirical Bayes (operator 8).

A logistic model on surface features gives each document its own evidence. The evidence is averaged over hosts and over
the paths of a host by grouped aggregation; a path's mean is shrunk toward its host's posterior and a host's toward the
global mean, by as much as the spread between groups (method of moments) warrants. A document's score is its own log
odds, moved by the log odds of its path's posterior (the document itself left out) against the global mean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, table

SYMBOLS = "%&*$#@^~<>{}[]\\=+_"
#: Labelled rows that the document classifier is fitted on, at most (those with the least hash of their id).
MAX_LABELS = 20_000
EPS = 1e-4


#: One letter for each class of characters that is counted.
_CLASSES = {"S": SYMBOLS, "B": "!", "P": "|", "U": UPPER, "D": "0123456789", "L": LOWER}


def with_parts(df: DataFrame, text: str) -> DataFrame:
    """`df` with what features are made of: _m, the text with counted characters replaced by their class, and _w, its words.

    They are columns of their own so that each is computed once for a row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"_m": F.translate(t, "".join(_CLASSES.values()), "".join(k * len(v) for k, v in _CLASSES.items())), "_w": F.filter(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""), "_l": F.split(t, "\n")})


def features() -> list[Column]:
    """Surface features as expressions of _m, _w and _l; all are bounded, and defined for null and empty texts."""
    n = F.greatest(F.length("_m"), F.lit(1)).cast("double")

    def share(kind: str) -> Column:
        return (F.length("_m") - F.length(F.replace(F.col("_m"), F.lit(kind), F.lit("")))) / n

    count = F.greatest(F.size("_w"), F.lit(1)).cast("double")
    return [
        *(F.sqrt(share(k)) for k in "SBPUD"),
        share("L"),
        F.size(F.array_distinct("_w")) / F.pow(count, F.lit(0.9)),
        F.size(F.array_distinct("_l")) / F.size("_l").cast("double"),
        F.least(n / count, F.lit(40.0)) / 40,
        F.log10(n) / 10,
    ]


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights of the document classifier (the last is the intercept), by ridge-penalised Newton steps.

    Labels that are null or neither 0 nor 1 are left out. Without labels of both kinds every weight is zero, so that
    each document gets an even chance.
    """
    y = labels.select(F.col(id_col).cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    y = y.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_labels)  # the documented bound on training rows
    x = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(y), "_id")
    # one row for each label, however often its id occurs in `docs`: what reaches the driver is bounded by max_labels
    rows = with_parts(x, "_t").select("_id", F.array(*features()).alias("_x"), "_y").groupBy("_id", "_y").agg(F.min("_x").alias("_x")).select("_x", "_y").toPandas()
    if rows["_y"].nunique() < 2:
        return np.zeros(len(features()) + 1)
    X = np.column_stack([np.array(rows["_x"].tolist()), np.ones(len(rows))])
    t, w = rows["_y"].to_numpy(float), np.zeros(X.shape[1])
    ridge = np.diag([0.05] * (X.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p) + 1e-6)[:, None]) + ridge, X.T @ (t - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def own_evidence(w: np.ndarray) -> Column:
    """The probability that a document is good by itself, from the columns of with_parts."""
    z = F.lit(float(w[-1]))
    for f, k in zip(features(), w[:-1], strict=True):
        z = z + f * float(k)
    p = 1 / (1 + F.exp(-z))
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def _strength(groups: DataFrame, mean: str) -> tuple[float, float]:
    """Global mean, and the prior's weight in documents, from the spread of group means about `mean` beyond chance."""
    r = groups.agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("g"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), 2)).alias("between"),
        F.sum(F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))).alias("within"),
    ).first()
    if not r["n"]:
        return 0.5, 1.0
    m, within = r["s"] / r["n"], max(r["within"] / r["n"], 1e-6)
    spread = max((r["between"] - r["g"] * within) / r["n"], 0.0)
    return min(max(m, EPS), 1 - EPS), min(max(within / spread if spread > 0 else 1e4, 1.0), 1e4)


def posteriors(each: DataFrame) -> tuple[DataFrame, float, float]:
    """From rows (host, path, p): one row for each path with its sums and its host's posterior; global mean; weight."""
    paths = cut(each.groupBy("host", "path").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in "sqn"))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    m, k = _strength(hosts.withColumn("m", F.lit(0.5 if total is None else float(total))), "m")
    hosts = hosts.select("host", ((F.lit(k * m) + F.col("s")) / (F.lit(k) + F.col("n"))).alias("host_posterior"))
    paths = cut(paths.join(hosts, "host"))
    return paths, m, _strength(paths, "host_posterior")[1]


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    threshold: float = 0.5,
    max_labels: int = MAX_LABELS,
    carry: bool = True,
) -> DataFrame:
    """`docs` with columns host, path, own_score, host_posterior, path_posterior, quality_score and keep.

    Columns of these names in `docs` are replaced. host and path are the source, and the source with the language,
    unless given; nulls in them count as one host or path of their own (the empty string). Null and empty texts get a
    score like any other; repeated rows are scored alike; an empty table gives an empty result. A document is kept if
    its score is at least `threshold`. Without `carry` the text itself is left out of the result.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if path is None else path
    w = fit(docs, labels, max_labels, id_col, text_col)
    keys = [F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path")]
    mine = own_evidence(w)
    names = ("host", "path", "own_score", "host_posterior", "path_posterior", "quality_score", "keep")
    kept = [c for c in docs.columns if c not in names and (carry or c != text_col)]
    row = F.struct(*(docs[c] for c in kept)) if kept else F.struct(F.lit(0))
    each = with_parts(docs.select(row.alias("_row"), keys[0].alias("_host"), keys[1].alias("_path"), F.col(text_col).alias("_t")), "_t")
    each = each.select("_row", "_host", "_path", mine.alias("_p"))
    if carry:  # texts are not stored again: their features are computed twice instead
        lean = with_parts(docs.select(*keys, F.col(text_col).alias("_t")), "_t").select("host", "path", mine.alias("p"))
    else:
        each = cut(each)
        lean = each.select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_p").alias("p"))
    paths, m, k = posteriors(lean)
    prior = paths.select(F.col("host").alias("_h"), F.col("path").alias("_l"), "s", "n", F.col("host_posterior").alias("_hp"))
    each = each.join(prior, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_l")))
    others = (F.lit(k) * F.col("_hp") + F.col("s") - F.col("_p")) / (F.lit(k) + F.col("n") - 1)
    others = F.least(F.greatest(others, F.lit(EPS)), F.lit(1 - EPS))

    def logit(c):
        return F.log(c / (1 - c))

    score = 1 / (1 + F.exp(-(logit(F.col("_p")) + logit(F.col("_pp")) - F.lit(float(np.log(m / (1 - m)))))))
    each = each.withColumn("_pp", others).withColumn("_score", score)
    return each.select(
        *(F.col("_row")[c].alias(c) for c in kept), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_p").alias("own_score"), F.col("_hp").alias("host_posterior"),
        F.col("_pp").alias("path_posterior"), F.col("_score").alias("quality_score"), (F.col("_score") >= threshold).alias("keep"),
    )


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), carry=False).select("doc_id", "host", "path", "own_score", "host_posterior", "path_posterior", "quality_score", "keep")
