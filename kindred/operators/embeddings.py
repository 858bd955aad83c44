"""Learned embeddings: principal components, autoencoder, spherical k-means."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DEFAULT_WEIGHTS
from .rule import top_k
from .vectors import _wide, array_cosine, dense_scores, dot, normalized, unit

# --- principal components --------------------------------------------------------------------------------------


# Components are rotated by one matrix on the driver; beyond so many dimensions, all of them together are the centred vectors instead.
ROTATED = 1000


def pca_embeddings(vecs: DataFrame, latent: int | None = 16) -> DataFrame:
    """``(entity_id, category, vec)`` with up to ``latent`` principal components of the centred vectors, category by category; all of them if None.

    There are at most as many components as rows or dimensions; signs are arbitrary, which cosines do not see.  Nor do they see a rotation: all
    components of more than ``ROTATED`` dimensions are the centred vectors as they are."""
    out = None
    # What is no number becomes zero, as the covariance could not be formed otherwise.  Each category is read several times.
    clean = vecs.withColumn("vec", F.transform("vec", lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))).cache()
    shape = clean.groupBy("category").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("p")).orderBy("category").collect()
    for r in shape:
        most = min(r["n"], r["p"] or 0)
        k = most if latent is None else min(latent, most)
        own = clean.filter(F.col("category") == r["category"])
        if k:
            own = own.withColumn("raw", array_to_vector("vec"))
            centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(own).transform(own)
            if k == most and r["p"] > ROTATED:
                own = centred.select("entity_id", "category", vector_to_array("centred").alias("vec"))
            else:
                model = PCA(k=k, inputCol="centred", outputCol="scores").fit(centred)
                own = model.transform(centred).select("entity_id", "category", vector_to_array("scores").alias("vec"))
        else:
            own = own.select("entity_id", "category", F.array().cast("array<double>").alias("vec"))
        out = own if out is None else out.unionAll(own)
    return vecs.select("entity_id", "category", "vec") if out is None else out


def centred(vecs: DataFrame) -> DataFrame:
    """Vectors less their category's mean: what all principal components together keep, up to a rotation."""
    cells = vecs.select("entity_id", "category", F.posexplode("vec").alias("i", "v"))
    means = cells.groupBy("category", "i").agg(F.avg("v").alias("m")).groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    return vecs.join(F.broadcast(means), "category").select("entity_id", "category", F.zip_with("vec", "mean", lambda v, m: v - m).alias("vec"))


def pca_top_k(vecs: DataFrame, query_id, k: int = 5, weights: dict[str, float] = DEFAULT_WEIGHTS, latent: int | None = 16) -> DataFrame:
    return top_k(dense_scores(pca_embeddings(vecs, latent), query_id, weights), k)


# --- autoencoder -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Network:
    """A multilayer perceptron: rectified hidden layers, linear output."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            z = out[-1] @ w + b
            out.append(z if i == len(self.weights) - 1 else np.maximum(z, 0))
        return out

    def latent(self, x: np.ndarray, layer: int = 2) -> np.ndarray:
        """Input of hidden layer ``layer`` before it is rectified."""
        for w, b in zip(self.weights[:layer], self.biases[:layer], strict=True):
            x = np.maximum(x @ w + b, 0)
        return x @ self.weights[layer] + self.biases[layer]


def train_autoencoder(x: np.ndarray, latent: int, seed: int = 42, max_iter: int = 3000, patience: int = 30, alpha: float = 1e-4, rate: float = 1e-3, tolerance: float = 1e-4) -> Network:
    """Autoencoder with hidden layers (h1, h2, latent, h2, h1) fitted by Adam on squared error with early stopping.

    A tenth of the rows is set apart; training stops after ``patience`` epochs without a gain of ``tolerance`` in the share of its
    variance that is explained, and the best epoch's network is returned."""
    rng = np.random.default_rng(seed)
    n, p = x.shape
    h1, h2 = max(128, 3 * latent), max(64, 2 * latent)
    sizes = [p, h1, h2, latent, h2, h1, p]
    spans = [math.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    params = [rng.uniform(-s, s, (a, b)) for s, a, b in zip(spans, sizes, sizes[1:], strict=False)] + [rng.uniform(-s, s, b) for s, b in zip(spans, sizes[1:], strict=True)]
    depth = len(spans)
    order = rng.permutation(n)
    held = order[: max(1, n // 10)] if n > 1 else order
    own = order[max(1, n // 10) :] if n > 1 else order
    batch = min(200, len(own))
    first, second = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    best, best_score, waited, step = [q.copy() for q in params], -np.inf, 0, 0
    spread = ((x[held] - x[held].mean(axis=0)) ** 2).sum() or 1.0
    for _ in range(max_iter):
        rng.shuffle(own)
        for at in range(0, len(own), batch):
            rows = x[own[at : at + batch]]
            net = Network(params[:depth], params[depth:])
            layers = net.layers(rows)
            delta = (layers[-1] - rows) / len(rows)
            grads = [None] * (2 * depth)
            for i in range(depth - 1, -1, -1):
                grads[i] = layers[i].T @ delta + alpha / len(rows) * params[i]
                grads[depth + i] = delta.sum(axis=0)
                if i:
                    delta = (delta @ params[i].T) * (layers[i] > 0)
            step += 1
            pace = rate * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - pace * first[i] / (np.sqrt(second[i]) + 1e-8)
        score = 1 - ((Network(params[:depth], params[depth:]).layers(x[held])[-1] - x[held]) ** 2).sum() / spread
        waited = 0 if score > best_score + tolerance else waited + 1
        if score > best_score:
            best, best_score = [q.copy() for q in params], score
        if waited > patience:
            break
    return Network(best[:depth], best[depth:])


def autoencoder_embeddings(vecs: DataFrame, latent: int = 48, seed: int = 42, max_iter: int = 3000, max_rows: int | None = 20_000) -> DataFrame:
    """``(entity_id, category, vec)`` with the autoencoder's latent vectors.

    One network a category is trained in an executor, on at most ``max_rows`` rows (the first by a hash of the id: a documented
    bound of the fit alone; with None, on all); all rows are encoded where they are.  Categories of one dimension or none are passed on."""
    clean = vecs.withColumn("vec", F.transform("vec", lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)))
    sample = None
    for r in clean.select("category").distinct().orderBy("category").collect():
        own = clean.filter(F.col("category") == r[0])
        own = own if max_rows is None else own.orderBy(F.xxhash64("entity_id"), "entity_id").limit(max_rows)
        sample = own if sample is None else sample.unionAll(own)
    if sample is None:
        return vecs

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("entity_id")
        x = np.stack(rows["vec"].to_numpy()).astype(float)
        net = train_autoencoder(x, latent, seed, max_iter) if x.shape[1] > 1 else None
        return pd.DataFrame({"category": [rows["category"].iloc[0]], "net": [pickle.dumps(net)]})

    nets = sample.groupBy("category").applyInPandas(fit, "category string, net binary").collect()
    sent = vecs.sparkSession.sparkContext.broadcast({r["category"]: bytes(r["net"]) for r in nets})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {c: pickle.loads(raw) for c, raw in sent.value.items()}
        for batch in batches:
            for c, rows in batch.groupby("category"):
                if own.get(c) is not None and len(rows):
                    x = np.stack(rows["vec"].to_numpy()).astype(float)
                    rows = rows.assign(vec=list(own[c].latent(x)))
                yield rows

    return clean.select("entity_id", "category", "vec").mapInPandas(encode, vecs.select("entity_id", "category", "vec").schema)


def autoencoder_top_k(vecs: DataFrame, query_id, k: int = 5, weights: dict[str, float] = DEFAULT_WEIGHTS, **options) -> DataFrame:
    if not vecs.filter(F.col("entity_id") == query_id).limit(1).count():
        raise ValueError(f"unknown entity {query_id!r}")
    return top_k(dense_scores(autoencoder_embeddings(vecs, **options), query_id, weights, zero_unused=True), k)


# --- spherical k-means -----------------------------------------------------------------------------------------


def _literal(rows: list[list[float]]) -> Column:
    """A matrix as a constant, parsed in one go."""
    return F.expr("array(" + ",".join("array(" + ",".join(f"{float(x)!r}D" for x in row) + ")" for row in rows) + ")")


def _assign(x: np.ndarray, centroids: list | None) -> np.ndarray:
    """Number of each row's centroid with the greatest dot product, the lowest of equals; before any, 0."""
    return np.zeros(len(x), int) if centroids is None else np.argmax(x @ np.array(centroids).T, axis=1)


def _label(vec: Column, centroids: list | None) -> Column:
    @F.pandas_udf("int")
    def of(vectors: pd.Series) -> pd.Series:
        return pd.Series(_assign(np.stack(vectors.to_numpy()), centroids), dtype="int32")

    return of(vec) if centroids is not None else F.lit(0)


def _means(rows: DataFrame, now: list, before: list | None) -> list:
    """``(cluster, i, m, moved)``: members' means by cluster and dimension, and whether any member was elsewhere before.  Each task sums
    up its own rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vec"].to_numpy())
                new, old = _assign(x, now), _assign(x, before)
                for c in np.unique(new):
                    own = new == c
                    yield pd.DataFrame({"cluster": c, "i": np.arange(x.shape[1]), "s": x[own].sum(axis=0), "n": int(own.sum()), "moved": bool((old[own] != c).any())})

    parts = rows.select("vec").mapInPandas(sums, "cluster int, i int, s double, n long, moved boolean")
    return parts.groupBy("cluster", "i").agg((F.sum("s") / F.sum("n")).alias("m"), F.bool_or("moved").alias("moved")).collect()


@dataclass(frozen=True)
class Clusters:
    """Labels ``(entity_id, category, cluster)`` and centroids of one category."""

    labels: DataFrame
    centroids: list[list[float]]


def spherical_kmeans(vecs: DataFrame, clusters: int = 5, seed: int = 42, max_iter: int = 50, initial: list | None = None) -> Clusters:
    """Spherical k-means over one category's ``(entity_id, category, vec)``.

    Starts from rows drawn without replacement by numpy's generator over rows in the order of their ids, or from the rows ``initial``.
    All labels start as 0 and the loop ends as soon as an assignment changes none, so also when the first one is all zeros.  A
    centroid is its members' mean at length 1; one without members is drawn anew.  Only k centroids travel between driver and
    executors, and former labels are recomputed from former centroids instead of stored."""
    unit_rows = vecs.select("entity_id", "category", normalized(F.transform("vec", lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))).alias("vec")).cache()
    n = unit_rows.count()
    if not n:
        return Clusters(unit_rows.select("entity_id", "category", F.lit(0).alias("cluster")), [])
    rng = np.random.default_rng(seed)
    ranked = unit_rows.orderBy("entity_id").rdd.zipWithIndex()

    def at(ranks: list[int]) -> list[list[float]]:
        wanted = set(ranks)
        got = dict(ranked.filter(lambda x: x[1] in wanted).map(lambda x: (x[1], list(x[0]["vec"]))).collect())
        return [got[r] for r in ranks]

    if initial is None:
        k = max(1, min(clusters, n))
        centroids = at(rng.choice(n, size=k, replace=False).tolist())
    else:
        got = {r["entity_id"]: list(r["vec"]) for r in unit_rows.filter(F.col("entity_id").isin(initial)).collect()}
        centroids, k = [got[i] for i in initial], len(initial)
    before = None
    for _ in range(max_iter):
        # One job an iteration; former labels are recomputed from former centroids.
        means = _means(unit_rows, centroids, before)
        if not any(r["moved"] for r in means):
            break
        before = centroids
        by: dict[int, dict[int, float]] = {}
        for r in means:
            by.setdefault(r["cluster"], {})[r["i"]] = r["m"]
        centroids = []
        for c in range(k):
            if c in by:
                mean = np.array([by[c][i] for i in range(len(by[c]))])
                size = np.linalg.norm(mean)
                centroids.append((mean / size if size else mean).tolist())
            else:
                centroids.append(at([int(rng.integers(0, n))])[0])
    return Clusters(unit_rows.select("entity_id", "category", _label(F.col("vec"), before).cast("int").alias("cluster")), centroids)


def kmeans_models(vecs: DataFrame, clusters: int = 5, seed: int = 42, max_iter: int = 50) -> dict[str, Clusters]:
    """One model a category; categories of one dimension or none are one cluster."""
    out = {}
    for r in vecs.groupBy("category").agg(F.max(F.size("vec")).alias("p")).orderBy("category").collect():
        own = vecs.filter(F.col("category") == r["category"])
        out[r["category"]] = spherical_kmeans(own, clusters if (r["p"] or 0) > 1 else 1, seed, max_iter)
    return out


def across_clusters(centroids: list[list[float]]) -> list[list[float]]:
    """Half of the similarity of any two centroids."""
    c = np.array(centroids, float).reshape(len(centroids), -1)
    size = np.linalg.norm(c, axis=1)
    cosines = np.divide(c @ c.T, np.outer(size, size), out=np.zeros((len(c), len(c))), where=np.outer(size, size) > 0)
    return (0.5 * (cosines + 1) / 2).tolist()


def kmeans_similarity(cos: Column, cluster_a: Column, cluster_b: Column, centroids: list[list[float]]) -> Column:
    """Similarity of two entities: their own in one cluster, half of their centroids' across clusters."""
    across = _literal(across_clusters(centroids))
    return F.when(cluster_a == cluster_b, unit(cos)).otherwise(across[cluster_a][cluster_b])


def kmeans_scores(vecs: DataFrame, query_id, weights: dict[str, float] = DEFAULT_WEIGHTS, models: dict[str, Clusters] | None = None, **options) -> DataFrame:
    models = kmeans_models(vecs, **options) if models is None else models
    sims = None
    for c, model in models.items():
        rows = vecs.filter(F.col("category") == c).join(model.labels, ["entity_id", "category"])
        query = rows.filter(F.col("entity_id") == query_id).select(F.col("vec").alias("q"), F.col("cluster").alias("q_cluster"))
        rows = rows.filter(F.col("entity_id") != query_id).crossJoin(F.broadcast(query.limit(1)))
        own = rows.select("entity_id", "category", kmeans_similarity(array_cosine(F.col("vec"), F.col("q")), F.col("q_cluster"), F.col("cluster"), model.centroids).alias("sim"))
        sims = own if sims is None else sims.unionAll(own)
    return _wide(sims, ["entity_id"], weights, zero_unused=True)


def kmeans_top_k(vecs: DataFrame, query_id, k: int = 5, weights: dict[str, float] = DEFAULT_WEIGHTS, **options) -> DataFrame:
    return top_k(kmeans_scores(vecs, query_id, weights, **options), k)


def kmeans_pairs(pairs: DataFrame, vecs: DataFrame, models: dict[str, Clusters]) -> DataFrame:
    """``(a, b, category, sim)``: pair similarities by clusters, from the plain ``pairs`` of ``dense_pairs``."""
    out = None
    for c, model in models.items():
        la = model.labels.select(F.col("entity_id").alias("a"), F.col("cluster").alias("ca"))
        lb = model.labels.select(F.col("entity_id").alias("b"), F.col("cluster").alias("cb"))
        own = pairs.filter(F.col("category") == c).join(la, "a").join(lb, "b")
        sim = kmeans_similarity(2 * F.col("sim") - 1, F.col("ca"), F.col("cb"), model.centroids)
        own = own.select("a", "b", "category", sim.alias("sim"))
        out = own if out is None else out.unionAll(own)
    return out
