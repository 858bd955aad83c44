"""Validation of methods against each other, over pair tables ``(a, b, method, sim)`` with a < b."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import kept


def label(pairs: DataFrame, method: str, score: str = "sim_total") -> DataFrame:
    return pairs.select("a", "b", F.lit(method).alias("method"), F.col(score).alias("sim"))


def hybrid_pairs(pairs: DataFrame, method_weights: dict[str, float], name: str = "hybrid") -> DataFrame:
    """Pairs of a combined method: the weighted sum over the methods named, not divided by the weights."""
    w = F.create_map(*(F.lit(x) for m, v in method_weights.items() for x in (m, float(v))))
    own = pairs.filter(F.col("method").isin(*method_weights))
    return own.groupBy("a", "b").agg(F.sum(F.col("sim") * w[F.col("method")]).alias("sim")).select("a", "b", F.lit(name).alias("method"), "sim")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Distribution of each method's similarities."""
    out = pairs.groupBy("method").agg(
        F.count("*").alias("n_pairs"), F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"), F.min("sim").alias("min"), F.max("sim").alias("max")
    )
    out = out.withColumn("range", F.col("max") - F.col("min"))
    return out.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.nullif("mean", F.lit(0.0))).otherwise(F.lit(0.0)))


def best_methods(stats: DataFrame) -> DataFrame:
    """The method with the widest range, the highest variation and, where given, the highest silhouette; ties by name."""
    order = lambda c: F.struct(F.col(c), F.col("method"))
    names = [c for c in ("range", "cv", "silhouette") if c in stats.columns]
    return stats.agg(*(F.max_by("method", order(c)).alias(f"best_{c}") for c in names))


def histogram(pairs: DataFrame, bins: int = 30) -> DataFrame:
    """``(method, bin, n)``: pairs in equal bins between each method's least and greatest similarity; bins count from 0 and the last
    one holds the greatest."""
    ends = pairs.groupBy("method").agg(F.min("sim").alias("low"), F.max("sim").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.floor((F.col("sim") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins)).otherwise(F.lit(0))
    rows = pairs.join(F.broadcast(ends), "method").withColumn("bin", F.least(place.cast("int"), F.lit(bins - 1)))
    return rows.groupBy("method", "bin").agg(F.count("*").alias("n"))


# --- correlation -----------------------------------------------------------------------------------------------


RANGES = 4096


def _ranks(pairs: DataFrame) -> DataFrame:
    """Average rank of each similarity within its method.  Values are counted first, so a rank needs an order of distinct values only; they are
    ordered within ``RANGES`` ranges of a method, and a range begins at the number of values in the ranges below."""
    values = pairs.groupBy("method", "sim").agg(F.count("*").alias("ties"))
    values = values.withColumn("range", F.greatest(F.lit(0), F.least(F.lit(RANGES), F.floor(F.coalesce("sim", F.lit(0.0)) * RANGES))))
    running = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    below = values.groupBy("method", "range").agg(F.sum("ties").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(running("method", "range")), F.lit(0)))
    inside = F.coalesce(F.sum("ties").over(running("method", "range", "sim")), F.lit(0))
    ranks = values.withColumn("inside", inside).join(below.select("method", "range", "below"), ["method", "range"])
    ranks = ranks.withColumn("rank", F.col("below") + F.col("inside") + (F.col("ties") + 1) / 2)
    return pairs.join(ranks.select("method", "sim", "rank"), ["method", "sim"])


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 400):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or tiny)
            c = 1 + n / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def spearman_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation by the t distribution with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return _beta_tail((n - 2) / (n - 2 + t2), (n - 2) / 2, 0.5)


def spearman(pairs: DataFrame, reference: str) -> DataFrame:
    """``(method, rho, n)``: rank correlation of every other method with the reference method."""
    ranks = kept(_ranks(kept(pairs, "pairs")), "ranks")  # both are read several times
    base = ranks.filter(F.col("method") == reference).select("a", "b", F.col("rank").alias("base"))
    return ranks.filter(F.col("method") != reference).join(base, ["a", "b"]).groupBy("method").agg(F.corr("rank", "base").alias("rho"), F.count("*").alias("n"))


def spearman_table(pairs: DataFrame, reference: str) -> DataFrame:
    """``spearman`` with p values; one row a method, so the driver adds them."""
    rows = [(r["method"], r["rho"], r["n"], spearman_p(r["rho"], r["n"])) for r in spearman(pairs, reference).orderBy("method").collect()]
    return pairs.sparkSession.createDataFrame(rows, "method string, rho double, n long, p double")


def spearman_matrix(pairs: DataFrame) -> DataFrame:
    """``(method_a, method_b, rho)`` for all ordered pairs of methods; 1 on the diagonal."""
    ranks = kept(_ranks(kept(pairs, "pairs")), "ranks")
    x = ranks.select("a", "b", F.col("method").alias("method_a"), F.col("rank").alias("x"))
    y = ranks.select("a", "b", F.col("method").alias("method_b"), F.col("rank").alias("y"))
    out = x.join(y, ["a", "b"]).groupBy("method_a", "method_b").agg(F.corr("x", "y").alias("rho"))
    return out.withColumn("rho", F.when(F.col("method_a") == F.col("method_b"), F.lit(1.0)).otherwise(F.col("rho")))


def jaccard_top(pairs: DataFrame, reference: str, k: int = 10) -> DataFrame:
    """``(method, jaccard)``: mean overlap, over all entities, of each method's k most similar others with the reference's."""
    return overlap(pairs.select("method", "a", "b", "sim").unionAll(pairs.select("method", F.col("b").alias("a"), F.col("a").alias("b"), "sim")), reference, k)


def overlap(both: DataFrame, reference: str, k: int) -> DataFrame:
    """``jaccard_top`` from rows ``(method, a, b, sim)`` in which every a has at least its k most similar others."""
    order = Window.partitionBy("method", "a").orderBy(F.desc("sim"), "b")
    best = kept(both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("method", "a", "b"), "best")
    base = best.filter(F.col("method") == reference).select("a", "b", F.lit(True).alias("hit"))
    others = best.filter(F.col("method") != reference).join(base, ["a", "b"], "left").groupBy("method", "a").agg(F.count("hit").alias("both"), F.count("*").alias("n"))
    sizes = base.groupBy("a").agg(F.count("*").alias("m"))
    share = F.col("both") / F.nullif(F.col("n") + F.col("m") - F.col("both"), F.lit(0))
    return others.join(sizes, "a").groupBy("method").agg(F.avg(F.coalesce(share, F.lit(0.0))).alias("jaccard"))


def regression(pairs: DataFrame, reference: str) -> DataFrame:
    """``(method, slope, intercept)``: least-squares line of each method's similarity on the reference's."""
    pairs = kept(pairs, "pairs")
    base = pairs.filter(F.col("method") == reference).select("a", "b", F.col("sim").alias("x"))
    joined = pairs.filter(F.col("method") != reference).join(base, ["a", "b"])
    return joined.groupBy("method").agg(F.regr_slope("sim", "x").alias("slope"), F.regr_intercept("sim", "x").alias("intercept"))


# --- silhouette ------------------------------------------------------------------------------------------------


def distance(sim):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - sim))


def silhouette(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(method, silhouette)``: mean silhouette over the distances of ``pairs``, for ``labels(method, entity_id, cluster)``.

    An entity alone in its cluster counts 0."""
    both = pairs.select("method", "a", "b", distance(F.col("sim")).alias("d")).unionAll(pairs.select("method", F.col("b").alias("a"), F.col("a").alias("b"), distance(F.col("sim")).alias("d")))
    own = labels.select("method", F.col("entity_id").alias("a"), F.col("cluster").alias("own"))
    other = labels.select("method", F.col("entity_id").alias("b"), F.col("cluster").alias("other"))
    to = both.join(own, ["method", "a"]).join(other, ["method", "b"]).groupBy("method", "a", "own", "other").agg(F.avg("d").alias("d"))
    by = to.groupBy("method", "a").agg(F.min(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("inside"), F.min(F.when(F.col("own") != F.col("other"), F.col("d"))).alias("outside"))
    width = F.greatest("inside", "outside")
    score = F.coalesce((F.col("outside") - F.col("inside")) / F.nullif(width, F.lit(0.0)), F.lit(0.0))
    score = F.when(F.col("inside").isNull() | F.col("outside").isNull(), F.lit(0.0)).otherwise(score)
    return by.groupBy("method").agg(F.avg(score).alias("silhouette"))


def average_linkage(d: np.ndarray, clusters: int, size: np.ndarray | None = None, merges: list | None = None) -> np.ndarray:
    """Labels of agglomerative clustering with average linkage over a distance matrix; the nearest two merge, the first of equals.  ``size``: entities in each row's
    cluster, if its distances are means; ``merges`` gets each merge's two rows and distance."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n) if size is None else size.astype(float), np.arange(n)
    # Each row's first least distance is kept, so that a merge reads a few rows and not the matrix.
    near = d.argmin(axis=1) if n else label
    least = d[np.arange(n), near]
    for _ in range(n - clusters):
        i = int(np.argmin(least))
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        if merges is not None:
            merges.append((i, j, d[i, j]))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        label[label == j] = i
        least[j] = np.inf
        lost = (near == j) | ((near == i) & (d[i] > least))
        lost[i], lost[j] = True, False
        closer = ~lost & ((d[i] < least) | ((d[i] == least) & (i <= near)))
        closer[j] = False
        near[closer], least[closer] = i, d[i][closer]
        for k in np.flatnonzero(lost & (label == np.arange(n))):
            near[k] = d[k].argmin()
            least[k] = d[k, near[k]]
    return np.unique(label, return_inverse=True)[1]


def matrix_silhouette(d: np.ndarray, label: np.ndarray) -> float:
    """``silhouette`` of a distance matrix."""
    return sums_silhouette(d @ np.eye(label.max() + 1)[label], label)


def sums_silhouette(sums: np.ndarray, label: np.ndarray) -> float:
    """``silhouette`` of each entity's sums of distances to the clusters."""
    member = np.eye(label.max() + 1)[label]
    n = member.sum(axis=0) - member
    means = np.divide(sums, n, out=np.full(n.shape, np.inf), where=n > 0)
    inside = means[np.arange(len(sums)), label]
    outside = np.where(member > 0, np.inf, means).min(axis=1)
    known, width = np.isfinite(inside) & np.isfinite(outside), np.maximum(inside, outside)
    return float(np.divide(outside - inside, width, out=np.zeros(len(sums)), where=known & (width != 0)).mean())


def cluster_pairs(pairs: DataFrame, clusters: int = 5, most: int = 4000) -> DataFrame:
    """``(method, entity_id, cluster)`` by average linkage, each method in one task: the matrix of a validation run.

    More than ``most`` entities are refused rather than clustered in part; with ``clusters`` or fewer there are no labels."""
    n = pairs.select("a").unionAll(pairs.select("b")).distinct().count()
    if n > most:
        raise ValueError(f"{n} entities; a matrix of more than {most} is not clustered")
    kind = dict(pairs.dtypes)["a"]

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(rows["a"]) | set(rows["b"]))
        at = {x: i for i, x in enumerate(ids)}
        if len(ids) <= clusters:
            return pd.DataFrame({"method": [], "entity_id": [], "cluster": []})
        d = np.zeros((len(ids), len(ids)))
        i, j = rows["a"].map(at).to_numpy(), rows["b"].map(at).to_numpy()
        d[i, j] = d[j, i] = np.clip(1 - rows["sim"].to_numpy(), 0, 1)
        return pd.DataFrame({"method": rows["method"].iloc[0], "entity_id": ids, "cluster": average_linkage(d, clusters)})

    return pairs.groupBy("method").applyInPandas(cluster, f"method string, entity_id {kind}, cluster int")
