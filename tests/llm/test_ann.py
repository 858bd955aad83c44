import numpy as np
import pytest

from kindred.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(ids, vectors, queries, k):
    out = {}
    v = np.array(vectors, np.float32).astype(float)
    for q in queries:
        d = np.sqrt(((v - v[ids.index(q)]) ** 2).sum(axis=1))
        near = sorted((x, i) for x, i in zip(d.tolist(), ids, strict=True) if i != q)[:k]
        out[q] = near
    return out


def found(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        own.append((r["score"], r["vec_id"]))
        assert r["rank"] == len(own)
    return out


def test_chi_square_quantile():
    assert A.chi_square_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert A.chi_square_quantile(0.99, 8) == pytest.approx(20.090235, abs=1e-5)
    assert A.chi_square_quantile(0.5, 2) == pytest.approx(1.386294, abs=1e-5)


def test_leaves_hold_every_row_once():
    points = np.random.default_rng(0).normal(size=(1000, 3))
    points[200:600] = 0  # many equal points
    leaves = A.kd_leaves(points, 16)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000)) and max(map(len, leaves)) <= 16


@pytest.mark.parametrize("options", [{}, {"block_rows": 100}, {"block_rows": 100, "sample_rows": 60, "max_cells": 4}])
def test_recall(spark, options):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (10, 32))
    vectors = centres[rng.integers(0, 10, 2000)] + rng.normal(0, 0.4, (2000, 32))
    ids = list(range(2000))
    df = table(spark, ids, vectors)
    got = found(A.nearest(df, df.filter("vec_id % 50 = 0"), **options))
    want = brute(ids, vectors, range(0, 2000, 50), 10)
    assert got.keys() == want.keys()
    hits = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert hits >= 0.95
    for q, near in got.items():
        assert near == sorted(near)
        exact = dict((i, d) for d, i in brute(ids, vectors, [q], 2000)[q])
        assert all(d == pytest.approx(exact[i]) for d, i in near)


def test_work_is_saved():
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (4000, 16)) * 3.0 ** -np.arange(16)
    block = A.Block(np.arange(4000), v, A.directions(16, 8, 7), 32)
    seen = []
    real = np.einsum
    try:
        np.einsum = lambda *a, **k: (seen.append(len(a[1])), real(*a, **k))[1]
        list(block.search(v[:1], v[:1] @ A.directions(16, 8, 7), np.array([np.inf]), 10, A.chi_square_quantile(0.99, 8)))
    finally:
        np.einsum = real
    assert sum(seen[1:]) < 2000


def test_cells_hold_every_point():
    points = np.random.default_rng(3).normal(size=(5000, 4))
    cells = A.Cells(points[:500], 16)
    at = cells.place(points)
    assert cells.n == 16 and set(at.tolist()) == set(range(16)) and np.bincount(at).max() < 1000
    assert A.Cells(np.zeros((50, 4)), 16).n == 1 and A.Cells(points[:0], 4).place(points).max() == 0


def test_queries_go_to_few_cells(spark):
    """100,000 vectors in 64 cells: recall against brute force, and the share of all blocks that queries are sent to."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (200, 24))
    v = (centres[rng.integers(0, 200, 100_000)] + rng.normal(0, 0.15, (100_000, 24))).astype(np.float32)
    import pandas as pd

    path = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/hundred-thousand.parquet"
    pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v)}).to_parquet(path)
    df = spark.read.parquet(f"file://{path}")
    got = found(A.nearest(df, df.filter("vec_id % 500 = 0"), block_rows=1600))
    want = brute(list(range(len(v))), v, range(0, len(v), 500), 10)
    assert got.keys() == want.keys()
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    # The cells that a query's bound leaves, by the same test on the true tenth distance.
    projected = v.astype(float) @ A.directions(24, 8, 7)
    cells = A.Cells(projected[::2], 63)
    at = cells.place(projected)
    low = np.stack([projected[at == c].min(axis=0) for c in range(cells.n)])
    high = np.stack([projected[at == c].max(axis=0) for c in range(cells.n)])
    limit = A.chi_square_quantile(0.99, 8)
    visits = []
    for q in want:
        gap = np.maximum(0, np.maximum(low - projected[q], projected[q] - high))
        visits.append(((gap * gap).sum(axis=1) <= want[q][-1][0] ** 2 * limit).mean())
    assert np.mean(visits) < 0.5


def test_a_third_of_all_rows_is_one_vector(spark):
    rng = np.random.default_rng(6)
    vectors = [[1.0, 2.0, 3.0]] * 400 + rng.normal(0, 1, (800, 3)).tolist()
    ids = list(range(len(vectors)))
    df = table(spark, ids, vectors).repartition(5)
    queries = [0, 3, 399, 500]
    got = found(A.nearest(df, df.filter(f"vec_id in ({', '.join(map(str, queries))})"), block_rows=100))
    assert got == {q: [(pytest.approx(d), i) for d, i in near] for q, near in brute(ids, vectors, queries, 10).items()}


def test_ties_and_copies(spark):
    vectors = [[0, 1], [0, 2], *[[0, 1]] * 30, [3, 3]]
    ids = list(range(len(vectors)))
    df = table(spark, ids, vectors)
    got = found(A.nearest(df, df.filter("vec_id in (0, 1, 20)"), k=5))
    assert got == {q: [(pytest.approx(d), i) for d, i in near] for q, near in brute(ids, vectors, [0, 1, 20], 5).items()}


def test_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[1, 1], None, [], [0, 0], [nan, 1], [inf, 1], [None, 1], [2, 1], [1, 2, 3]]
    df = table(spark, [*range(len(rows))], rows).unionAll(table(spark, [None, 7], [[1, 1], [2, 1]])).selectExpr("*", "'x' AS id", "'y' AS v")
    got = found(A.nearest(df, df))
    # The vector of another length meets nobody; the repeated row is a candidate twice and one query.
    assert got[0] == [(1.0, 7), (1.0, 7)]
    assert set(got) == {0, 7} and {i for _, i in got[7]} == {0}
    assert A.nearest(df, df.limit(0)).count() == 0
    assert A.nearest(df.limit(0), df.limit(0)).count() == 0
    few = found(A.nearest(df, df.filter("vec_id = 0"), k=10))
    assert len(few[0]) == 2


def test_given_vectors(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").filter("embedding IS NOT NULL").orderBy("vec_id").collect()
    ids, vectors = [r["vec_id"] for r in rows], [r["embedding"] for r in rows]
    got = found(A.op10_stable_projections(spark, d))
    want = brute(ids, vectors, got, 10)
    assert len(got) == sum(i % 100 == 0 for i in ids)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in got]) >= 0.9
