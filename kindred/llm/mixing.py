"""Mixing to target weights with soft domain membership, with DataFrame functions only.

A softmax classifier, fitted on the labelled table, gives every document a posterior over domains.  Document rates r >= 0 are then fitted by
projected-gradient least squares so that the expected tokens of each domain, sum of r * tokens * posterior, match
the target.  The residual has one number a domain, so an iteration sends only that to the driver; the step is scaled by the documents' tokens and
by the inverse of the domains' Gram matrix, which makes it exact but for the projection.  The rate of
a document after n iterations is an expression in its posterior and the n residuals: nothing is rewritten between iterations.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table, unused

WORDS = r"\p{L}+|[^\p{L}\s]+"  # runs of letters, and runs of marks or digits


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_col: str, text_col: str, max_docs: int, vocabulary: int, telling: float) -> tuple[list[float], dict[str, list[float]]]:
    """Multinomial logistic regression on the presence of words: the log score of each domain for a text without any known word,
    and what each known word adds.  Known are up to ``vocabulary`` words with the highest chi-square against domain, of
    ``telling`` or more.

    Fitted on at most ``max_docs`` labelled rows, first by a hash of their id: a bounded sample, of which the driver gets
    each row's domain and known words."""
    marked = labels.select(F.col(id_col).alias("id"), domain.alias("domain")).dropna()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = marked.join(texts.select("id"), "id").distinct().orderBy(F.xxhash64("id"), "id", "domain").limit(max_docs)
    sample = texts.join(F.broadcast(picked), "id").select("domain", F.array_distinct(words(F.col("text"))).alias("w"))
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(d, 0) for d in domains]
    total = sum(n)
    base = [math.log((x + 1) / (total + len(n))) for x in n]
    if not total:
        return base, {}
    counts = sample.select("domain", F.explode("w").alias("w")).groupBy("w").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)))
    seen = sum((F.col(f"n{i}") for i in range(len(n))), F.lit(0))
    terms = [F.pow(F.col(f"n{i}") - seen * x / total, 2) / (F.lit(max(x, 1) / total) * seen) for i, x in enumerate(n)]
    best = counts.filter(seen >= 3).withColumn("chi", F.round(sum(terms, F.lit(0.0)), 6)).filter(F.col("chi") >= telling)
    vocab = [r["w"] for r in best.orderBy(F.desc("chi"), "w").limit(vocabulary).select("w").collect()]
    if not vocab:
        return base, {}
    column = {w: i for i, w in enumerate(vocab)}
    rows = sample.select("domain", F.array_intersect("w", F.array(*map(F.lit, vocab))).alias("w")).filter(F.col("domain").isin(domains)).collect()
    x = np.zeros((len(rows), len(vocab)))
    for i, r in enumerate(rows):
        x[i, [column[w] for w in r["w"]]] = 1
    bias, w = logistic(x, np.array([domains.index(r["domain"]) for r in rows]), base)
    return bias, {word: w[i].tolist() for i, word in enumerate(vocab)}


def logistic(x: np.ndarray, y: np.ndarray, base: list[float], ridge: float = 0.5, steps: int = 250) -> tuple[list[float], np.ndarray]:
    """Softmax regression by Adam from the priors; ``ridge`` weighs the squared weights against the rows."""
    w, bias, hit = np.zeros((x.shape[1], len(base))), np.array(base), np.eye(len(base))[y]
    moment, square = np.zeros((x.shape[1] + 1, len(base))), np.zeros((x.shape[1] + 1, len(base)))
    for t in range(1, steps + 1):
        z = x @ w + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - hit) / len(x)
        g = np.vstack([x.T @ d + ridge / len(x) * w, d.sum(axis=0)])
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = 0.05 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-10)
        w, bias = w - move[:-1], bias - move[-1]
    return bias.tolist(), w


def _looked_up(odds: Column):
    return lambda w: F.element_at(odds, w)


def posteriors(found: Column, base: list[float], weights: dict[str, list[float]]) -> list[Column]:
    """Posterior of each domain, not yet normalised, given the array of known words that a text holds."""
    scores = [F.lit(b) for b in base]
    if weights:
        for i in range(len(base)):
            odds = F.create_map(*(F.lit(x) for w, v in weights.items() for x in (w, v[i])))
            scores[i] = scores[i] + F.aggregate(F.transform(found, _looked_up(odds)), F.lit(0.0), lambda a, b: a + b)
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return [F.exp(s - top) for s in scores]


def fit_rates(rows: DataFrame, k: int, target: np.ndarray, max_steps: int, tolerance: float) -> Column:
    """Rate of each row of ``(tokens, p0..)`` as an expression: projected gradient steps from a rate of 1."""
    p = [F.col(f"p{i}") for i in range(k)]
    mass = F.col("tokens").cast("double")
    gram = rows.agg(*(F.sum(mass * p[i] * p[j]) for i in range(k) for j in range(k))).first()
    gram = np.array([x or 0.0 for x in gram]).reshape(k, k)
    inverse = np.linalg.pinv(gram, rcond=1e-9)
    rate = F.lit(1.0)
    for _ in range(max_steps):
        totals = np.array([x or 0.0 for x in rows.agg(*(F.sum(mass * rate * x) for x in p)).first()])
        gap = totals - target
        if np.abs(gap).max() <= tolerance * max(target.sum(), 1.0):
            break
        step = inverse @ gap
        if not np.abs(step).max() > 1e-9:
            break
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(float(s)) * x for s, x in zip(step, p, strict=True)), F.lit(0.0)))
    return rate


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    total: float | None = None,
    max_docs: int = 6000,
    vocabulary: int = 400,
    telling: float = 25.0,
    max_steps: int = 25,
    tolerance: float = 1e-5,
    snap: float = 1e-6,
) -> DataFrame:
    """``(doc_id, tokens, p_<domain>..., rate, copies)`` for every row.

    ``domain`` is an expression over ``labels`` that names a row's domain, and ``targets`` the share of expected tokens that each domain should
    have.  ``total`` is the number of tokens that the shares are of; by default such that the domain with the largest share keeps its expected tokens.
    ``copies`` is the rate as a whole number: its whole part, plus one with the probability of the rest, decided by a hash of
    id and text, so expected copies are the rate; ``snap`` only takes rounding errors off whole numbers.  Targets that no rates of 0 or more can meet are met as
    nearly as least squares allows.

    Null and empty texts have no tokens and the domains' priors; they count nothing and their rate follows their posterior.  Null ids and
    repeated rows are rows like any other; equal rows have equal rates.  With no labelled rows all domains are equally likely.  An empty table
    gives no rows.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names, k = list(targets), len(targets)
    prior, weights = fit_domains(docs, labels, domain, names, id_col, text_col, max_docs, vocabulary, telling)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"), words(F.col(text_col)).alias("w"))
    rows = rows.select("doc_id", "hash", F.size("w").cast("long").alias("tokens"), F.array_intersect("w", F.array(*(F.lit(w) for w in weights)).cast("array<string>")).alias("found"))
    raw = [x.alias(f"p{i}") for i, x in enumerate(posteriors(F.col("found"), prior, weights))]
    rows = rows.select("doc_id", "hash", "tokens", *raw)
    norm = sum((F.col(f"p{i}") for i in range(k)), F.lit(0.0))
    rows = scratch.table(rows.select("doc_id", "hash", "tokens", *((F.col(f"p{i}") / norm).alias(f"p{i}") for i in range(k))))

    shares = np.array([targets[d] for d in names], float)
    shares = shares / shares.sum()
    if total is None:
        own = rows.agg(*(F.sum(F.col("tokens") * F.col(f"p{i}")) for i in range(k))).first()
        most = int(np.argmax(shares))
        total = (own[most] or 0.0) / shares[most]
    rate = fit_rates(rows, k, shares * total, max_steps, tolerance)
    rows = rows.withColumn("rate", rate)
    whole, rest = F.floor("rate"), F.col("rate") - F.floor("rate")
    coin = F.pmod(F.xxhash64("hash", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.when(rest <= snap, whole).when(rest >= 1 - snap, whole + 1).otherwise(whole + (coin < rest).cast("long"))
    return rows.select("doc_id", "tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(names)), "rate", copies.cast("int").alias("copies"), "hash")


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each row as often as its ``copies`` say (see ``mixing_rates``), with all columns as they were."""
    rates = mixing_rates(docs, labels, domain, targets, id_col, text_col, **options)
    mark, n = unused(docs, "hash"), unused(docs, "copies")
    # Equal rows have equal rates: one entry each is enough.
    rates = rates.groupBy(F.col("hash").alias(mark)).agg(F.first("copies").alias(n)).filter(F.col(n) > 0)
    out = docs.withColumn(mark, F.xxhash64(F.col(id_col), F.col(text_col))).join(rates, mark)
    again = F.explode(F.array_repeat(F.lit(1), F.col(n)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), again.alias(mark)).drop(mark)


def label_domain() -> Column:
    """Domains of the ``labels`` table."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


TARGETS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def op2_soft_mixing(spark, sf_dir):
    out = mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_domain(), TARGETS)
    return out.drop("hash")


QUERIES = {"op2_soft_mixing": op2_soft_mixing}
