"""Soft-membership mixing: document rates whose expected domain totals match targets.

1. A naive Bayes classifier over hashed words is counted from labelled rows (a bounded
   sample per domain, chosen by a hash of the id) and gives each document posterior
   probabilities of the domains; the log-likelihood is divided by the root of the number of
   words (times 1/4), so memberships stay soft.
2. Rates ``r >= 0`` minimise the squared difference between the expected tokens of each
   domain, ``sum(r * tokens * p_k)``, and its target.  Projected gradient steps start from
   rate 1, in the metric in which documents count by their tokens and domains by the
   inverse of their Gram matrix (so that the step length is 1):
   ``r <- max(0, r - p . G^-1 (totals - targets))``.  A step is one aggregate of a few sums
   over a narrow table; the rates are written out every few steps.

Everything on the rows is a DataFrame expression; the driver holds numbers per domain and
per hash bucket only.

The domain of the largest weight (or ``keep``) is kept at its whole mass, which fixes the
targets' total.  Domains of which there is too much are thinned; one that is scarce stays at
what it has, below its target, and never scales the others down.  A rate above 1 means
expected repeats.

Edge cases: a NULL or empty text has 0 tokens, prior probabilities and is never thinned by
its length; without labels every document has the uniform posterior; a domain without any mass
gets target 0; repeated rows get equal rates; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import written

BUCKETS, TRAIN_ROWS, STEPS, TOLERANCE = 1 << 15, 4000, 60, 1e-9
SMOOTHING, SHARPNESS = 10.0, 4.0


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    log_prior: list[float]
    log_odds: np.ndarray      # (domains - 1, buckets): against the first domain


def words(text: Column) -> Column:
    """Words of a text: its parts between blanks and line ends; none for NULL."""
    parts = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), " ")
    return F.filter(parts, lambda w: w != "")


def hashed(ws: Column, buckets: int = BUCKETS) -> Column:
    return F.transform(ws, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(buckets)))


def train(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_col: str = "doc_id",
          text_col: str = "text", rows_per_domain: int = TRAIN_ROWS, buckets: int = BUCKETS) -> Classifier:
    """Count words of labelled texts by domain; ``domain`` is a column of ``labels``."""
    y = (labels.select(F.col(id_col).alias("id"), domain.alias("domain")).where(F.col("domain").isin(domains) & F.col("id").isNotNull())
         .groupBy("id").agg(F.min("domain").alias("domain")))
    n = {r.domain: r["count"] for r in y.groupBy("domain").count().collect()}
    share = F.lit(0.0)
    for d in domains:
        share = F.when(F.col("domain") == d, F.lit(min(1.0, rows_per_domain / n.get(d, 1)))).otherwise(share)
    y = y.where(F.pmod(F.xxhash64(F.lit("mixing"), "id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(y), "id")               # about rows_per_domain rows of each domain, so the texts stay where they are
    got = (rows.select("domain", F.explode(hashed(words(F.col("text")), buckets)).alias("b")).groupBy("domain", "b").count()
           .collect())                      # at most domains * buckets rows
    table = np.zeros((len(domains), buckets))
    for r in got:
        table[domains.index(r.domain), r.b] += r["count"]
    size = table.sum(axis=1, keepdims=True)
    table += SMOOTHING * (size + 1) / (size.mean() + 1)         # rare buckets say little, whatever the domain's size
    logs = np.log(table / table.sum(axis=1, keepdims=True))
    prior = [math.log((n.get(d, 0) + 1) / (sum(n.values()) + len(domains))) for d in domains]
    return Classifier(list(domains), prior, logs[1:] - logs[0])


def _adder(table: Column):
    return lambda s, b: s + F.get(table, b.cast("int"))


def log_odds(model: Classifier, h: Column) -> list[Column]:
    """Log-odds of each further domain against the first, from a text's hashed words."""
    out = []
    for k, odds in enumerate(model.log_odds):
        table = F.split(F.lit(",".join(f"{x:.6g}" for x in odds)), ",").cast("array<double>")   # folded to a literal
        total = F.aggregate(h, F.lit(0.0), _adder(table))
        out.append(F.lit(model.log_prior[k + 1] - model.log_prior[0]) + total * SHARPNESS / F.sqrt(F.greatest(F.size(h), F.lit(1)).cast("double")))
    return out


def with_posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, tokens, p0, p1, ...): a narrow row per document; tk tells rows of one id apart."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tk"),
                       hashed(words(text), model.log_odds.shape[1]).alias("hs"))
    z = log_odds(model, F.col("hs"))
    rows = rows.select("id", "tk", F.size("hs").cast("double").alias("tokens"), *[x.alias(f"z{k}") for k, x in enumerate(z, 1)])
    zs = [F.lit(0.0), *[F.col(f"z{k}") for k in range(1, len(model.domains))]]
    top = F.greatest(*zs) if len(zs) > 1 else zs[0]
    e = [F.exp(x - top) for x in zs]
    total = sum(e[1:], e[0])
    return rows.select("id", "tk", "tokens", *[(x / total).alias(f"p{k}") for k, x in enumerate(e)])


def targets(mass: np.ndarray, weights: list[float], keep: int | None = None) -> np.ndarray:
    """Token totals in the given proportions to the whole mass of domain ``keep`` (that of the largest
    weight by default), but none above what the domain has."""
    w = np.where(mass > 0, np.asarray(weights, float), 0.0)
    if not w.sum():
        return np.zeros_like(w)
    k = int(w.argmax()) if keep is None or not w[keep] else keep
    return np.minimum(w * mass[k] / w[k], mass)


def fit_rates(rows: DataFrame, weights: list[float], steps: int = STEPS, tolerance: float = TOLERANCE,
              keep: int | None = None) -> DataFrame:
    """``rows`` of ``with_posteriors`` with their ``rate``; the result is a written table."""
    k = len(weights)
    ps = [F.col(f"p{i}") for i in range(k)]
    state = written(rows.withColumn("rate", F.lit(1.0)), "mixing")
    gram = state.agg(*[F.coalesce(F.sum(F.col("tokens") * ps[i] * ps[j]), F.lit(0.0)) for i in range(k) for j in range(k)]).first()
    gram = np.array(gram).reshape(k, k)
    mass = gram.sum(axis=1)
    goal, inverse = targets(mass, weights, keep), np.linalg.pinv(gram)
    rate, since = F.col("rate"), 0
    for step in range(steps):
        totals = np.array(state.agg(*[F.coalesce(F.sum(rate * F.col("tokens") * p), F.lit(0.0)) for p in ps]).first(), float)
        miss = totals - goal
        if np.abs(miss).max() <= tolerance * max(1.0, mass.sum()):
            break
        move = inverse @ miss
        by = sum((F.lit(float(m)) * p for m, p in zip(move[1:], ps[1:], strict=True)), F.lit(float(move[0])) * ps[0])
        rate, since = F.greatest(F.lit(0.0), rate - by), since + 1
        if since == 8 and step + 1 < steps:
            state, rate, since = written(state.withColumn("rate", rate), "mixing"), F.col("rate"), 0
    return written(state.withColumn("rate", rate), "mixing")


def copies(rate: Column, key: Column) -> Column:
    """How often a document of that rate goes into the mix: rounded by a hash of its key."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], id_col: str = "doc_id",
        text_col: str = "text", keep: str | None = None) -> DataFrame:
    """(id, tk, tokens, p0.., rate, copies) of every document, domains in the order of ``weights``.

    ``keep``: the domain kept at its whole mass; that of the largest weight by default.
    """
    model = train(docs, labels, domain, list(weights), id_col, text_col)
    fitted = fit_rates(with_posteriors(docs, model, id_col, text_col), list(weights.values()),
                       keep=None if keep is None else list(weights).index(keep))
    return fitted.withColumn("copies", copies(F.col("rate"), F.col("id")))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as the mix says; columns unchanged."""
    plan = mixed.select("id", "tk", F.col("copies").alias("_copies")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"),
                       F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_tk"))
    both = rows.join(plan, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tk") == F.col("tk"))).where("_copies > 0")
    again = both.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_n"))
    return again.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
