"""What larger tables need: nothing of the size of the entities goes through the driver, and pairs are never shuffled one by one."""

import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.model import CATEGORIES, DEFAULT_WEIGHTS, FEATURES, GEOMETRY
from kindred.operators import blocks, embeddings, flatten, linkage, ranks, rule, validate, vectors
from kindred.plans import files, inputs
from kindred.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def joins(df, key):
    """Names and lines of the plan's joins on ``key``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if re.search(rf"Join \[(.*, )?{key}#", x)]


@pytest.mark.parametrize("query", ["vector_topk", "vector_scores_sparse", "hybrid_topk"])
def test_cells_are_not_broadcast(spark, query):
    found = joins(QUERIES[query](spark, SF), "entity_id")
    assert found
    assert not any("Broadcast" in x for x in found)


def test_dense_cells_are_not_broadcast(spark):
    f = inputs.part_features(spark, SF)
    dims = vectors.feature_dims(f)
    found = joins(vectors.dense(vectors.feature_vectors(f, dims), dims), "entity_id")
    assert len(found) >= 2
    assert not any("Broadcast" in x for x in found)


def test_flattened_documents_are_not_broadcast(spark):
    flat = spark.createDataFrame([("e", 0, "x", 1.0, None, None)], flatten.FLAT)
    selection = spark.createDataFrame([("x", "C", "P", "mm", "GEOM", "numerisch", 0)], "path string, component string, param string, unit string, ptype string, datatype string, ordinal long")
    df = flatten.select_features(flat, selection)
    found = joins(df, "parameter")
    assert found and all("BroadcastHashJoin" in x and "BuildRight" in x for x in found)
    assert [tuple(r) for r in df.collect()] == [("e", "C", "P", 1.0, None, "mm", "GEOM")]


# --- pairs in blocks -------------------------------------------------------------------------------------------


def messy(spark, n=23):
    """Facts with nulls, numbers as text, repeated facts, constants, not-a-number, missing facts and entities of one category only."""
    rng, rows = np.random.default_rng(5), []
    for i in range(n):
        for p, t in (("len", "GEOM"), ("mass", "DYN"), ("same", "COST"), ("steel", "MTRL"), ("mix", "REQ"), ("nan", "REQ")):
            if rng.random() < 0.2 or (i == 3 and t != "GEOM") or (i == 4 and t != "REQ"):
                continue
            num = {"same": 4.0, "nan": float("nan") if i % 3 else 1.0}.get(p, float(rng.integers(0, 6)))
            text = p == "steel" or (p == "mix" and rng.random() < 0.5)
            given = rng.random() > 0.15
            row = (f"e{i}", "C", p, num if given and not text else None, ["x", " y ", "1", "2.0"][rng.integers(4)] if given and text else None, None, t)
            rows += [row] * (2 if p == "steel" and i % 7 == 0 else 1)
    return spark.createDataFrame(rows, FEATURES)


@pytest.mark.parametrize("block", [3, 100])
def test_blocks_agree_with_one_entity_at_a_time(spark, block):
    f = messy(spark).cache()
    plain = f.dropDuplicates(["entity_id", "component", "param"]).cache()  # the scores of one entity take its facts as they are, too
    cells = vectors.feature_vectors(plain.filter("NOT isnan(value_num) OR value_num IS NULL")).cache()
    ids = sorted(r[0] for r in f.select("entity_id").distinct().collect())
    ways = [
        (blocks.Pairs(blocks.rule_cells(plain, rule.numeric_stats(plain)), (blocks.RULE,), block=block).wide(), lambda q: rule.rule_scores(plain, q), True),
        (blocks.Pairs(blocks.vector_cells(cells), (blocks.VECTOR,), block=block).wide(), lambda q: vectors.vector_scores(cells, q), False),
    ]
    for pairs, scores, whole in ways:
        got = {(r["a"], r["b"]): tuple(r)[2:] for r in pairs.collect()}
        assert all(a < b for a, b in got) and (len(got) == len(ids) * (len(ids) - 1) // 2 or not whole)
        for q in ids[::6]:
            for r in scores(q).collect():
                pair = (min(q, r["entity_id"]), max(q, r["entity_id"]))
                if whole or pair in got:
                    assert tuple(r)[1:] == pytest.approx(got[pair], abs=1e-12), pair


@pytest.mark.parametrize("block", [4, 100])
def test_sums_over_blocks_are_those_over_rows(spark, block):
    f = messy(spark).filter("NOT isnan(value_num) OR value_num IS NULL").cache()
    cells = blocks.rule_cells(f, rule.numeric_stats(f)).unionAll(blocks.vector_cells(vectors.feature_vectors(f))).cache()
    own = blocks.Pairs(cells, (blocks.RULE, blocks.VECTOR), digits=9, block=block)
    rows = own.rows().cache()
    by = lambda df: {r[0]: tuple(r)[1:] for r in df.collect()}
    for got, want in (
        (own.stats(), validate.pair_stats(rows)),
        (own.regression("rule"), validate.regression(rows, "rule")),
        (validate.overlap(own.best(3), "rule", 3), validate.jaccard_top(rows, "rule", 3)),
    ):
        got, want = by(got), by(want)
        assert got.keys() == want.keys() and want
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert {tuple(r) for r in own.histogram(7).collect()} == {tuple(r) for r in validate.histogram(rows, 7).collect()}
    weights = {"rule": 0.5, "vector": 0.3}
    got, want = ({(r["a"], r["b"]): r["sim"] for r in x.collect()} for x in (own.weighted(weights), validate.hybrid_pairs(rows, weights)))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("query", ["rule_pairs", "vector_pairs", "pair_stats", "best_method", "pair_histogram", "regression_methods", "hybrid_pairs", "embedding_topk_per_entity"])
def test_pairs_are_not_shuffled(spark, query):
    """No plan joins or expands to pairs: blocks meet, and what comes out of them is not joined by pair."""
    df = QUERIES[query](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert not joins(df, "a#[0-9]+, b") and not re.search(r"Exchange hashpartitioning\(a#\d+L?, b#", plan)


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (40, 4)).astype(float)
    x[7] = 0
    rows = [(i, GEOMETRY, [float(v) for v in r]) for i, r in enumerate(x)] + [(40, GEOMETRY, None), (41, GEOMETRY, [1.0, 2.0]), (42, GEOMETRY, [None, 1.0, 0.0, 1.0])]
    v = spark.createDataFrame(rows, "entity_id long, category string, vec array<double>").cache()
    want = vectors.top_k_per_entity(vectors.dense_pairs(v).withColumn("sim", F.round("sim", 9)), 5)
    want = {(r["a"], r["rank"]): (r["b"], r["sim"]) for r in want.collect()}
    for block in (7, 100):
        got = blocks.Pairs(blocks.dense_cells(v), CATEGORIES, digits=9, block=block).best(5)
        order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        got = got.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
        assert {(r["a"], r["rank"]): (r["b"], r["sim"]) for r in got.collect()} == want


@pytest.mark.parametrize(("block", "group", "groups"), [(7, 100, 3), (3, 9, 2), (100, 100, 12)])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_nearest_vectors_by_groups(spark, block, group, groups, ids):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    x[7], x[20:50] = 0, x[20]  # copies tie, and the least ids are the nearest
    rows = [(i, GEOMETRY, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, GEOMETRY, None), (61, GEOMETRY, [1.0, 2.0]), (62, GEOMETRY, [None, 1.0, 0.0, 1.0]), (3, "K_REQ_ELEC", [1.0]), (5, "K_REQ_ELEC", [2.0])]
    for own in (rows, rows[8:60]):  # the second without any odd vector
        v = spark.createDataFrame(own, "entity_id long, category string, vec array<double>").withColumn("entity_id", F.col("entity_id").cast(ids)).cache()
        order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        got, want = (
            {(r["a"], r["rank"]): (r["b"], r["sim"]) for r in x.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").collect()}
            for x in (blocks.nearest(v, 5, 9, block, group, groups), blocks.Pairs(blocks.dense_cells(v), CATEGORIES, digits=9).best(5))
        )
        assert len(got) >= 5 * 50 and got == want


def test_nearest_returns_k_rows_an_entity(spark):
    """Every two blocks gave the k best of each entity before, so that rows grew with the square of the entities."""
    v = spark.createDataFrame([(i, GEOMETRY, [float(i % 17), float(i % 5), 1.0]) for i in range(90)], "entity_id long, category string, vec array<double>")
    assert blocks.nearest(v, 5, 9, block=10, groups=3).count() == 90 * 5


def plain_linkage(d, clusters):
    """Average linkage that searches the whole matrix for each merge."""
    d, n = d.copy(), len(d)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - clusters):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


@pytest.mark.parametrize("levels", [2, 5, 1 << 30])
def test_linkage_with_kept_minima(levels):
    rng = np.random.default_rng(levels)
    for n in (2, 6, 40, 41, 90):
        d = rng.integers(0, levels, (n, n)) / levels
        d = np.triu(d, 1) + np.triu(d, 1).T
        assert (validate.average_linkage(d, min(5, n)) == plain_linkage(d, min(5, n))).all()


def test_linkage_of_more_than_four_thousand(spark):
    x = np.sort(np.random.default_rng(1).random(4100))
    label = validate.average_linkage(np.abs(x[:, None] - x[None, :]), 5)
    assert len(set(label)) == 5 and (np.diff(label) != 0).sum() == 4  # runs of a line


def test_silhouette_in_blocks(spark):
    f = messy(spark).filter("NOT isnan(value_num) OR value_num IS NULL").cache()
    cells = blocks.rule_cells(f, rule.numeric_stats(f)).cache()
    own = blocks.Pairs(cells, (blocks.RULE,), digits=9, block=6)
    rows = own.rows().cache()
    want = validate.silhouette(rows, validate.cluster_pairs(rows)).collect()
    assert [tuple(r) for r in own.linkage_silhouette().collect()] == [(want[0][0], pytest.approx(want[0][1], abs=1e-12))]


@pytest.mark.parametrize(("block", "near", "dense"), [(7, 2, 5), (100, 3, 12), (16, 1, 30)])
@pytest.mark.parametrize("kind", ["even", "copies"])
def test_linkage_in_rounds_is_that_of_the_matrix(spark, monkeypatch, block, near, dense, kind):
    """Clusters by merges that parts of the distances prove; one matrix of all entities before, which did not fit an executor."""
    rng = np.random.default_rng(block)
    x = rng.random((70, 3)) if kind == "even" else rng.random((9, 3))[np.sort(rng.integers(0, 9, 70))]
    rows = [(f"e{i}", "C", p, float(v), None, None, t) for i, r in enumerate(x) for p, t, v in zip(("len", "cost", "volt"), ("GEOM", "COST", "REQ"), r, strict=True)]
    f = spark.createDataFrame(rows, FEATURES).cache()
    cells = blocks.rule_cells(f, rule.numeric_stats(f)).unionAll(blocks.vector_cells(vectors.feature_vectors(f))).cache()
    methods = (blocks.RULE, blocks.VECTOR) if kind == "copies" else (blocks.RULE,)  # cosines of one dimension are copies
    own = blocks.Pairs(cells, methods, digits=9, block=block)
    want = [tuple(r) for r in own.linkage_silhouette().orderBy("method").collect()]
    monkeypatch.setattr(linkage, "DENSE", dense)
    monkeypatch.setattr(linkage, "NEAR", near)
    got = [tuple(r) for r in own.linkage_silhouette().orderBy("method").collect()]
    assert got == [(m, pytest.approx(v, abs=1e-9)) for m, v in want] and len(got) == len(methods)


def test_proven_merges_are_those_of_the_matrix():
    rng = np.random.default_rng(9)
    for n, k in ((30, 3), (60, 5), (60, 20), (90, 2), (90, 4)):
        d = rng.random((n, n))
        d = np.triu(d, 1) + np.triu(d, 1).T
        label, tree = np.arange(n), []
        while label.max() > 0:
            first = np.unique(label, return_index=True)[1].tolist()
            member = np.eye(label.max() + 1)[label]
            size = member.sum(axis=0)
            mean = member.T @ d @ member / np.outer(size, size)
            np.fill_diagonal(mean, np.inf)
            order = np.argsort(mean, axis=1)[:, : min(k, len(size) - 1)]
            x, y = np.repeat(np.arange(len(size)), order.shape[1]), order.ravel()
            bound = mean[np.arange(len(size)), order[:, -1]] if k < len(size) - 1 else np.full(len(size), np.inf)
            found = linkage.merged(size, x, y, mean[x, y], bound, [])
            assert found
            tree += [(first[a], first[b], v) for a, b, v in found]
            label = linkage.united(len(size), found)[label]
        label = linkage.united(n, linkage.least_merges(n, tree, 5))
        assert len({*zip(label.tolist(), plain_linkage(d, 5).tolist(), strict=True)}) == 5, (n, k)


@pytest.mark.parametrize("block", [30, 1000])
def test_learned_methods_in_blocks(spark, block):
    f = inputs.supplier_features(spark, "/root/testdata/sf0.01")
    dims = vectors.feature_dims(f)
    vecs = vectors.dense(vectors.feature_vectors(f, dims), dims).cache()
    models = embeddings.kmeans_models(vecs, 4)
    labels = [m.labels for m in models.values()]
    across = {CATEGORIES.index(c): embeddings.across_clusters(m.centroids) for c, m in models.items()}
    pca = spark.createDataFrame(embeddings.pca_embeddings(vecs, 4).collect(), vecs.schema)  # components of equal strength are arbitrary
    cells = blocks.clustered_cells(pca, "pca").unionByName(blocks.clustered_cells(vecs, "kmeans", labels[0].unionAll(labels[1]).unionAll(labels[2])))
    weights = {"pca": 0.5, "kmeans": 0.25}
    rows = blocks.Pairs(cells, ("pca", "kmeans"), block=block, across=across, hybrid=weights).rows()
    got = {(r["a"], r["b"], r["method"]): r["sim"] for r in rows.collect()}
    plain = validate.label(vectors._wide(vectors.dense_pairs(pca), ["a", "b"], DEFAULT_WEIGHTS), "pca")
    plain = plain.unionAll(validate.label(vectors._wide(embeddings.kmeans_pairs(vectors.dense_pairs(vecs), vecs, models), ["a", "b"], DEFAULT_WEIGHTS, zero_unused=True), "kmeans"))
    want = {(r["a"], r["b"], r["method"]): r["sim"] for r in plain.unionAll(validate.hybrid_pairs(plain, weights)).collect()}
    assert len(want) == 3 * 4950 and got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


@pytest.mark.parametrize("rotated", [10, 1000])
def test_all_components(spark, monkeypatch, rotated):
    """All components, rotated and not: products as of the centred vectors."""
    monkeypatch.setattr(embeddings, "ROTATED", rotated)
    x = np.random.default_rng(6).integers(0, 3, (40, 24)).astype(float)
    v = spark.createDataFrame([(i, GEOMETRY, r.tolist()) for i, r in enumerate(x)], "entity_id long, category string, vec array<double>")
    got = {r["entity_id"]: np.array(r["vec"]) for r in embeddings.pca_embeddings(v, None).collect()}
    y, z = np.stack([got[i] for i in range(40)]), x - x.mean(axis=0)
    assert np.abs(y @ y.T - z @ z.T).max() < 1e-9


def test_full_rank_query_has_no_cap(spark, tmp_path):
    """More than a thousand dimensions: the query kept the first thousand components before."""
    duckdb = pytest.importorskip("duckdb")
    duckdb.sql("COPY (SELECT * REPLACE (p_name || ' ' || p_partkey AS p_name) FROM '/root/testdata/sf0.01/part.parquet' WHERE p_partkey < 1100) TO '%s/part.parquet'" % tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet'")
    want = con.sql(ORACLE_SQL["pca_fullrank_topk"]).fetchall()
    got = [tuple(r) for r in QUERIES["pca_fullrank_topk"](spark, str(tmp_path)).collect()]
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(a[1:] == pytest.approx(b[1:], abs=1.1e-6) for a, b in zip(got, want, strict=True))


def test_method_pairs_are_all_pairs_by_all_methods(spark):
    """The query summed up four methods before, and returned no pair."""
    got = QUERIES["method_pairs"](spark, SF)
    assert got.columns == ["a", "b", "method", "sim"]
    rows = got.collect()
    n = inputs.supplier_features(spark, SF).select("entity_id").distinct().count()
    by = {m: {(r["a"], r["b"]): r["sim"] for r in rows if r["method"] == m} for m in ("rule", "vector", "pca", "autoencoder", "kmeans", "hybrid")}
    assert len(rows) == 6 * n * (n - 1) // 2 and all(len(x) == n * (n - 1) // 2 for x in by.values())
    assert all(by["hybrid"][p] == pytest.approx((by["pca"][p] + by["kmeans"][p]) / 2, abs=1e-12) for p in by["hybrid"])


def test_autoencoder_of_all_rows(spark):
    x = np.random.default_rng(2).random((40, 3))
    v = spark.createDataFrame([(i, GEOMETRY, r.tolist()) for i, r in enumerate(x)], "entity_id long, category string, vec array<double>").cache()
    of = lambda n: [r["vec"] for r in embeddings.autoencoder_embeddings(v, 2, max_iter=2, max_rows=n).orderBy("entity_id").collect()]
    assert of(None) == of(40) != of(20)


# --- ranks by counts -------------------------------------------------------------------------------------------


def both_methods(f, block):
    return blocks.Pairs(blocks.rule_cells(f, rule.numeric_stats(f)).unionAll(blocks.vector_cells(vectors.feature_vectors(f))).cache(), (blocks.RULE, blocks.VECTOR), digits=9, block=block)


@pytest.mark.parametrize(("few", "most"), [(1 << 16, 10**9), (0, 60), (4, 10**9)])
def test_ranks_by_counts_are_those_of_rows(spark, monkeypatch, few, most):
    """Methods of few and of many values, in one round and in several, with pairs that one method does not know."""
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "ROUND", most)
    own = both_methods(messy(spark).filter("NOT isnan(value_num) OR value_num IS NULL").cache(), 6)
    rows = own.rows().cache()
    got, want = ({r["method"]: (r["rho"], r["n"]) for r in x.collect()} for x in (ranks.spearman(own, "rule"), validate.spearman(rows, "rule")))
    assert got.keys() == want.keys() == {"vector"}
    assert got["vector"] == pytest.approx(want["vector"], abs=1e-12)
    got, want = ({(r["method_a"], r["method_b"]): r["rho"] for r in x.collect()} for x in (ranks.spearman_matrix(own), validate.spearman_matrix(rows)))
    assert len(got) == 4 and got == pytest.approx(want, abs=1e-12)


def test_ranks_off_full_slices(monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 100)
    rng = np.random.default_rng(8)
    values = np.sort(np.concatenate([rng.integers(0, ranks.SLICE, 5000), rng.integers(0, 900, 3000), [0, ranks.SLICE - 1]])) + 3 * ranks.SLICE
    held = ranks._Counts()
    for part in (values[::2], values[1::2], np.full(400, 3 * ranks.SLICE + 7)):
        held.add(part.astype(np.int32))
    sums = np.zeros(ranks.SLICE, np.int64)
    for method, k, size, packed in held.rows("m"):
        places, counts = ranks._unpacked(size, packed)
        assert (method, k) == ("m", 3)
        sums[places] += counts
    values = np.sort(np.concatenate([values, np.full(400, 3 * ranks.SLICE + 7)]))
    (row,) = (b.to_pylist()[0] for b in ranks._slice(("m", 3), sums))
    assert row["dense"] and row["n"] == len(values) and row["distinct"] == len(set(values))
    keys, got = (values[::3].astype(np.uint64) << np.uint64(30)) | np.uint64(5), []
    for i, j, places, base, counts in ranks._stretches(keys, np.uint64(30), row, 1000):
        assert i == len(got)
        got += (2 * (base + counts[1].astype(np.int64)) - counts[0] + 1)[places].tolist()
    below, upto = np.searchsorted(values, values[::3]), np.searchsorted(values, values[::3], side="right")
    assert got == (2 * 1000 + below + upto + 1).tolist()


def test_ranks_need_no_table_of_pairs(spark, monkeypatch):
    """The pairs were written with their ranks before, several times over."""
    monkeypatch.setattr(blocks.Pairs, "rows", None)
    assert files.spearman_significance is QUERIES["spearman_significance"]
    assert {n: QUERIES[n](spark, SF).count() for n in ("spearman_methods", "spearman_matrix", "spearman_significance")} == {"spearman_methods": 1, "spearman_matrix": 4, "spearman_significance": 1}
