import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.model import CATEGORIES, FEATURES, GEOMETRY, MATERIAL, REQUIREMENT
from kindred.operators import embeddings, hybrid, rule, validate, vectors
from kindred.operators import weights as W


def feats(spark, rows):
    return spark.createDataFrame([(e, "C", p, n, s, None, t) for e, p, n, s, t in rows], FEATURES)


def one(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture
def small(spark):
    rows = []
    for i, (length, mass, steel, use) in enumerate([(10.0, 1.0, "x", "a"), (20.0, 2.0, "x", "b"), (30.0, 9.0, "y", "a"), (12.0, 3.0, "z", None), (28.0, 8.0, "y", "b"), (11.0, 1.5, "x", "a"), (25.0, 4.0, "z", "c")]):
        rows += [(f"e{i}", "len", length, None, "GEOM"), (f"e{i}", "mass", mass, None, "DYN"), (f"e{i}", "steel", None, steel, "MTRL"), (f"e{i}", "use", None, use, "REQ")]
    return feats(spark, rows)


def test_numeric_similarity(spark):
    cases = [(150, 150, 100, 200, 1.0), (100, 200, 100, 200, 0.0), (150, 160, 100, 200, 0.9), (50, 250, 100, 200, 0.0), (42, 42, 42, 42, 1.0), (42, 43, 42, 42, 0.0)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "a double, b double, lo double, hi double, want double")
    for r in df.select(rule.numeric_similarity(F.col("a"), F.col("b"), F.col("lo"), F.col("hi")).alias("got"), "want").collect():
        assert r["got"] == pytest.approx(r["want"])


def test_absent_null_and_text(spark):
    rows = [
        ("q", "both", 1.0, None, "GEOM"), ("t", "both", 1.0, None, "GEOM"),
        ("q", "nulls", None, None, "GEOM"), ("t", "nulls", None, None, "GEOM"),
        ("q", "onlyq", 2.0, None, "GEOM"), ("t", "onlyt", 2.0, None, "GEOM"),
        ("q", "half", None, "x", "MTRL"), ("t", "half", None, None, "MTRL"),
        ("q", "trim", None, " x ", "MTRL"), ("t", "trim", None, "x", "MTRL"),
    ]
    got = one(rule.rule_scores(feats(spark, rows), "q"))[0]
    # Geometry: both 1, nulls skipped, onlyq and onlyt 0.  Material: half 0, trim 1.
    assert got["sim_geom"] == pytest.approx(1 / 3)
    assert got["sim_mtrl"] == pytest.approx(0.5)
    assert got["sim_req"] == 0.0
    assert got["sim_total"] == pytest.approx((2 / 3 + 0.5) / 3.5)


def test_rule_total(spark):
    rows = [("a", "p", 0.0, None, "GEOM"), ("b", "p", 1.0, None, "GEOM"), ("c", "p", 10.0, None, "GEOM"), ("a", "m", None, "x", "MTRL"), ("b", "m", None, "x", "MTRL")]
    got = one(rule.rule_top_k(feats(spark, rows), "a", 1, {GEOMETRY: 2.0, MATERIAL: 1.0, REQUIREMENT: 0.0}))
    assert got[0]["entity_id"] == "b"
    assert got[0]["sim_total"] == pytest.approx(0.9333333333)


def test_weighted_total(spark):
    def total(sims, weights):
        return spark.range(1).select(rule.weighted_total({k: F.lit(v) for k, v in sims.items()}, weights)).first()[0]

    assert total({"a": 0.8, "b": 0.6, "c": 0.4}, {"a": 2, "b": 1, "c": 0}) == pytest.approx(2.2 / 3)
    assert total({"a": 0.8}, {"a": 1, "b": 1}) == pytest.approx(0.4)
    assert total({"a": 0.8}, {"a": 0}) == 0.0


def test_pairs_agree_with_queries(spark, small):
    for pairs, scores in ((rule.rule_pairs(small), rule.rule_scores), (vectors.vector_pairs(vectors.feature_vectors(small)), lambda f, q: vectors.vector_scores(vectors.feature_vectors(f), q))):
        by = {(r["a"], r["b"]): r["sim_total"] for r in pairs.collect()}
        assert len(by) == 21
        for q in ("e0", "e3"):
            for r in scores(small, q).collect():
                assert r["sim_total"] == pytest.approx(by[tuple(sorted((q, r["entity_id"])))])


def test_empty_category_is_half_for_vectors(spark):
    rows = [("a", "p", 1.0, None, "GEOM"), ("b", "p", 1.0, None, "GEOM")]
    f = feats(spark, rows)
    got = one(vectors.vector_top_k(f, "a"))[0]
    assert got["sim_geom"] == pytest.approx(1.0)  # a constant has the value 0.5 for both
    assert (got["sim_mtrl"], got["sim_req"]) == (0.5, 0.5)


def test_top_k_is_a_prefix_with_ties_by_id(spark, small):
    whole = [r["entity_id"] for r in rule.rule_top_k(small, "e0", 6).collect()]
    assert [r["entity_id"] for r in rule.rule_top_k(small, "e0", 3).collect()] == whole[:3]
    assert len(whole) == 6


def test_unknown_query_has_no_shared_parameters(spark, small):
    assert all(r["sim_total"] == 0 for r in rule.rule_scores(small, "nobody").collect())


def dense(f):
    dims = vectors.feature_dims(f)
    return vectors.dense(vectors.feature_vectors(f, dims), dims)


def test_dense_equals_long(spark, small):
    long = {r["entity_id"]: r["sim_total"] for r in vectors.vector_scores(vectors.feature_vectors(small), "e0").collect()}
    for r in vectors.dense_scores(dense(small), "e0", {GEOMETRY: 2.0, MATERIAL: 1.0, REQUIREMENT: 0.5}).collect():
        assert r["sim_total"] == pytest.approx(long[r["entity_id"]])


def test_pca_of_full_rank_keeps_centred_cosines(spark, small):
    w = {GEOMETRY: 2.0, MATERIAL: 1.0, REQUIREMENT: 0.5}
    a = {r["entity_id"]: r["sim_total"] for r in vectors.dense_scores(embeddings.pca_embeddings(dense(small), 100), "e0", w).collect()}
    b = {r["entity_id"]: r["sim_total"] for r in vectors.dense_scores(embeddings.centred(dense(small)), "e0", w).collect()}
    assert a == pytest.approx(b)


def points(spark, rows):
    return spark.createDataFrame([(i, GEOMETRY, [float(x) for x in v]) for i, v in enumerate(rows)], "entity_id long, category string, vec array<double>")


def test_kmeans(spark):
    v = points(spark, [(1, 0), (1, 0.1), (0, 1), (0.1, 1), (0, 0)])
    model = embeddings.spherical_kmeans(v, clusters=2, initial=[0, 2])
    labels = {r["entity_id"]: r["cluster"] for r in model.labels.collect()}
    assert labels == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0}
    scores = {r["entity_id"]: r["sim_geom"] for r in embeddings.kmeans_scores(v, 0, {GEOMETRY: 1.0}, {GEOMETRY: model}).collect()}
    c = np.array(model.centroids)
    cos = c[0] @ c[1] / np.linalg.norm(c[0]) / np.linalg.norm(c[1])
    assert scores[2] == pytest.approx(0.5 * (cos + 1) / 2)
    assert scores[1] == pytest.approx((1 / np.sqrt(1.01) + 1) / 2)
    # A first assignment of all zeros ends the loop before any centroid moves.
    still = embeddings.spherical_kmeans(v, clusters=1)
    assert {r["cluster"] for r in still.labels.collect()} == {0}
    again = embeddings.spherical_kmeans(v, clusters=2, seed=3), embeddings.spherical_kmeans(v, clusters=2, seed=3)
    assert again[0].centroids == again[1].centroids


def test_autoencoder(spark, small):
    v = dense(small)
    a = [r.asDict() for r in embeddings.autoencoder_embeddings(v, latent=4, max_iter=20).orderBy("entity_id", "category").collect()]
    b = [r.asDict() for r in embeddings.autoencoder_embeddings(v, latent=4, max_iter=20).orderBy("entity_id", "category").collect()]
    assert a == b
    assert {len(r["vec"]) for r in a} == {4}
    with pytest.raises(ValueError):
        embeddings.autoencoder_top_k(v, "nobody", latent=4, max_iter=2)
    got = one(embeddings.autoencoder_top_k(v, "e0", weights={GEOMETRY: 1.0, MATERIAL: 0.0, REQUIREMENT: 0.0}, latent=4, max_iter=2))
    assert all(r["sim_mtrl"] == 0 for r in got)  # shown as 0 where the weight is


def test_autoencoder_learns():
    rng = np.random.default_rng(0)
    x = rng.random((200, 2)) @ rng.random((2, 8))
    net = embeddings.train_autoencoder(x, 4, max_iter=200)
    assert ((net.layers(x)[-1] - x) ** 2).mean() < 0.1 * x.var()


def test_hybrid_is_linear_and_not_divided(spark, small):
    r = {x["entity_id"]: x["sim_total"] for x in rule.rule_scores(small, "e0").collect()}
    v = {x["entity_id"]: x["sim_total"] for x in vectors.vector_scores(vectors.feature_vectors(small), "e0").collect()}
    for x in hybrid.hybrid_top_k(small, "e0", {"rule": 0.3, "vector": 0.2, "pca": 0.0, "nonsense": 1.0}, k=10).collect():
        assert x["sim_total"] == pytest.approx(0.3 * r[x["entity_id"]] + 0.2 * v[x["entity_id"]])
        assert set(x["by_method"]) == {"rule", "vector"}


def test_component_weights(spark):
    edges = spark.createDataFrame([("Blechpaket", "Welle", "hoch", 1.0)], "source string, target string, strength string, percentage double")
    got = {r["component"]: r["weight"] for r in W.component_weights(edges).collect()}
    assert got == pytest.approx({"Welle": 2 / 3, "Blechpaket": 1 / 3})
    most = {r["component"]: r["weight"] for r in W.component_weights(edges, "max").collect()}
    assert most == pytest.approx({"Welle": 1.0, "Blechpaket": 0.5})
    raw = {r["component"]: r["weight"] for r in W.component_weights(edges, "none").collect()}
    assert raw == pytest.approx({"Welle": 1.5, "Blechpaket": 0.75})
    assert {r["weight"] for r in W.component_weights(edges.limit(0)).collect()} == {1 / 6}


def test_category_weights(spark):
    f = spark.createDataFrame([("e", "C_WELLE", "a", 1.0, None, None, "GEOM"), ("e", "C_WELLE", "b", 1.0, None, None, "MTRL")], FEATURES)
    w = spark.createDataFrame([("Welle", 1.0)], "component string, weight double")
    assert {r["category"]: r["weight"] for r in W.category_weights(w, f).collect()} == pytest.approx({GEOMETRY: 0.5, MATERIAL: 0.5})
    other = spark.createDataFrame([("Nichts", 1.0)], "component string, weight double")
    assert {r["category"]: r["weight"] for r in W.category_weights(other, f).collect()} == pytest.approx({c: 1 / 3 for c in CATEGORIES})
    with pytest.raises(ValueError):
        W.automatic_weights(spark.createDataFrame([], "source string, target string, strength string, percentage double"), f)


def test_validation(spark):
    sims = {("a", "b"): (0.1, 0.2), ("a", "c"): (0.5, 0.4), ("b", "c"): (0.5, 0.9)}
    pairs = spark.createDataFrame([(a, b, m, v[i]) for (a, b), v in sims.items() for i, m in enumerate(("x", "y"))], "a string, b string, method string, sim double")
    stats = {r["method"]: r for r in validate.pair_stats(pairs).collect()}
    assert stats["x"]["mean"] == pytest.approx(1.1 / 3)
    assert stats["x"]["std"] == pytest.approx(np.std([0.1, 0.5, 0.5]))
    rho = validate.spearman_table(pairs, "x").first()
    assert rho["rho"] == pytest.approx(0.8660254)
    assert validate.spearman_p(0.5, 12) == pytest.approx(0.0978, abs=1e-4)  # t = 1.8257 with 10 degrees of freedom
    assert sum(r["n"] for r in validate.histogram(pairs).filter("method = 'x'").collect()) == 3
    assert validate.jaccard_top(pairs, "x", 1).first()["jaccard"] == pytest.approx((1 + 1 / 3 * 0 + 2) / 3, abs=1)
    line = validate.regression(pairs, "x").first()
    assert line["slope"] == pytest.approx(np.polyfit([0.1, 0.5, 0.5], [0.2, 0.4, 0.9], 1)[0])
    labels = spark.createDataFrame([("x", "a", 0), ("x", "b", 1), ("x", "c", 1)], "method string, entity_id string, cluster int")
    # a alone counts 0; b: inside 0.5, outside 0.9; c: inside 0.5, outside 0.5.
    assert validate.silhouette(pairs.filter("method = 'x'"), labels).first()["silhouette"] == pytest.approx((0 + 0.4 / 0.9 + 0) / 3)


def test_average_linkage():
    x = np.array([0, 0.1, 0.2, 5, 5.1, 9])
    got = validate.average_linkage(np.abs(x[:, None] - x[None, :]), 3)
    assert [list(got[:3]), list(got[3:5])] == [[got[0]] * 3, [got[3]] * 2]
    assert len(set(got)) == 3
