"""Methods by name, and their weighted combination."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CATEGORIES, DEFAULT_WEIGHTS, SHORT
from .blocks import Pairs, clustered_cells, rule_cells, vector_cells
from .embeddings import across_clusters, autoencoder_embeddings, kmeans_models, kmeans_scores, pca_embeddings
from .rule import numeric_stats, one_type, rule_scores, top_k
from .vectors import dense, dense_scores, feature_dims, feature_vectors, vector_scores

SIMS = [f"sim_{SHORT[c]}" for c in CATEGORIES] + ["sim_total"]


def _dense(features: DataFrame) -> DataFrame:
    dims = feature_dims(features)
    return dense(feature_vectors(features, dims), dims)


#: Name to function of (features, query id, weights, latent dimensions, clusters).
METHODS: dict[str, Callable[..., DataFrame]] = {
    "rule": lambda f, q, w, latent, clusters: rule_scores(f, q, weights=w),
    "vector": lambda f, q, w, latent, clusters: vector_scores(feature_vectors(f), q, w),
    "pca": lambda f, q, w, latent, clusters: dense_scores(pca_embeddings(_dense(f), latent), q, w),
    "autoencoder": lambda f, q, w, latent, clusters: dense_scores(autoencoder_embeddings(_dense(f), latent), q, w, zero_unused=True),
    "kmeans": lambda f, q, w, latent, clusters: kmeans_scores(_dense(f), q, w, clusters=clusters),
}


def combine(results: dict[str, DataFrame], method_weights: dict[str, float]) -> DataFrame:
    """``(entity_id, sim_geom, sim_mtrl, sim_req, sim_total, by_method)`` from the score tables of several methods.

    Each method counts with its weight and the sum is not divided by the weights; weights of 0 or less are left out; an entity that a
    method does not know gets nothing from it."""
    rows = None
    for name, scores in results.items():
        w = method_weights.get(name, 0.0)
        if w <= 0:
            continue
        own = scores.select("entity_id", *(F.col(c) for c in SIMS), F.lit(name).alias("method"), F.lit(float(w)).alias("w"))
        rows = own if rows is None else rows.unionAll(own)
    if rows is None:
        raise ValueError("no method has a weight above 0")
    by_method = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("method"), F.col("sim_total")))))
    return rows.groupBy("entity_id").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in SIMS[:-1]), by_method.alias("by_method"), F.sum(F.col("sim_total") * F.col("w")).alias("total")).select(
        "entity_id", *SIMS[:-1], F.col("total").alias("sim_total"), "by_method"
    )


def hybrid_top_k(features: DataFrame, query_id: str, method_weights: dict[str, float], k: int = 5, weights: dict[str, float] = DEFAULT_WEIGHTS, latent: int = 16, clusters: int = 5) -> DataFrame:
    """The k entities with the highest combined similarity; names that are no method contribute nothing."""
    used = {m: METHODS[m](features, query_id, weights, latent, clusters) for m, w in method_weights.items() if w > 0 and m in METHODS}
    return top_k(combine(used, method_weights), k)


def compare_methods(features: DataFrame, query_id: str, k: int = 5, weights: dict[str, float] = DEFAULT_WEIGHTS, latent: int = 16, clusters: int = 5) -> DataFrame:
    """All five methods side by side, each with a fifth of the weight."""
    return hybrid_top_k(features, query_id, {m: 0.2 for m in METHODS}, k, weights, latent, clusters)


def method_blocks(
    features: DataFrame,
    weights: dict[str, float] = DEFAULT_WEIGHTS,
    methods: tuple[str, ...] = ("rule", "vector", "pca", "autoencoder", "kmeans"),
    latent: int = 16,
    clusters: int = 5,
    hybrid: dict[str, float] | None = None,
) -> Pairs:
    """Total similarities of every pair by each method, and by the weighted combination ``hybrid`` if given, taken block by block.

    Dense vectors are made once for the methods that need them; the autoencoder is trained on all rows."""
    cells, across = [], None
    if "rule" in methods:
        one_type(features)
        cells.append(rule_cells(features, numeric_stats(features)))
    dims = feature_dims(features)
    sparse = feature_vectors(features, dims)
    if "vector" in methods:
        cells.append(vector_cells(sparse))
    vecs = dense(sparse, dims).cache() if {"pca", "autoencoder", "kmeans"} & set(methods) else None
    if "pca" in methods:
        cells.append(clustered_cells(pca_embeddings(vecs, latent), "pca"))
    if "autoencoder" in methods:
        cells.append(clustered_cells(autoencoder_embeddings(vecs, latent, max_rows=None), "autoencoder"))
    if "kmeans" in methods:
        models = kmeans_models(vecs, clusters)
        across = {CATEGORIES.index(c): across_clusters(m.centroids) for c, m in models.items()}
        labels = [m.labels for m in models.values()]
        if labels:
            cells.append(clustered_cells(vecs, "kmeans", reduce(DataFrame.unionAll, labels)))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), cells)
    return Pairs(rows, [m for m in methods if m in METHODS], weights, across=across, hybrid=hybrid, n=features.select("entity_id").distinct().count())


def method_pairs(features: DataFrame, *args, **options) -> DataFrame:
    """``(a, b, method, sim)`` with the total similarity of every pair a < b by each method: ``method_blocks`` as the table that all of
    ``validate`` works on."""
    return method_blocks(features, *args, **options).rows()
