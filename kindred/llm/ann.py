"""Approximate nearest neighbours over low-dimensional stable projections, indexed by kd-trees.

Vectors are projected on m Gaussian directions: the squared projected distance of a pair, divided by its squared distance, has
a chi-square distribution with m degrees of freedom.  The projected space is cut into cells by a kd-tree fitted on a bounded sample; every row is placed in its cell, and
each cell keeps a kd-tree of its own.  A query first searches its own cell, and with the k-th distance found there goes only
to the cells that the chi-square test does not rule out.  In a cell it takes the
leaves in the order of their projected distance and verifies their rows on the original vectors, until
the test says that an unseen row nearer than its k-th best would already have come, with
the wanted probability.  Ties are verified, so equal distances are settled by id.

Equal vectors are one: of their rows only those of the smallest ids can be among the nearest, and equal queries are asked once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, table


@cache
def chi_square_quantile(p: float, m: int) -> float:
    """The value below which a chi-square variable of m degrees of freedom lies with probability p, by bisection over
    the series of the lower incomplete gamma function."""

    def below(x: float) -> float:
        a, x = m / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 20.0 * m + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, m]).standard_normal((dim, m))


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of each leaf: the widest dimension is halved at its median until ``leaf`` rows or fewer are left."""
    open_, leaves = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        own = points[rows]
        d = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, d], half)
        open_ += [rows[order[:half]], rows[order[half:]]]
    return leaves


class Block:
    """A block of rows with its kd-tree: rows lie leaf by leaf, with a bounding box for each leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: np.ndarray, leaf: int):
        points = vectors @ projection
        leaves = kd_leaves(points, leaf)
        order = np.concatenate(leaves)
        self.ids, self.vectors, points = ids[order], vectors[order], points[order]
        ends = np.cumsum([len(x) for x in leaves])
        self.starts, self.ends = ends - [len(x) for x in leaves], ends
        self.low = np.minimum.reduceat(points, self.starts)
        self.high = np.maximum.reduceat(points, self.starts)

    def search(self, queries: np.ndarray, projected: np.ndarray, bounds: np.ndarray, k: int, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query (its number, ids, distances) of its k best rows, where they are within its bound; ``limit`` is the chi-square quantile."""
        for q in range(len(queries)):
            gap = np.maximum(0, np.maximum(self.low - projected[q], projected[q] - self.high))
            bound = np.einsum("ij,ij->i", gap, gap)
            order = np.argsort(bound, kind="stable")
            ids, near, at, step = np.empty(0, np.int64), np.empty(0), 0, 4
            while at < len(order):
                worst = min(near[-1], bounds[q]) if len(near) == k else bounds[q]
                now = order[at : at + step]
                now = now[bound[now] <= worst * worst * limit]
                if not len(now):
                    break
                rows = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in now])
                gap = self.vectors[rows] - queries[q]
                ids = np.concatenate([ids, self.ids[rows]])
                near = np.concatenate([near, np.sqrt(np.einsum("ij,ij->i", gap, gap))])
                best = np.lexsort((ids, near))[:k]
                ids, near, at, step = ids[best], near[best], at + step, step * 2
            yield np.full(len(ids), q), ids, near


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of rows that take part: no null id, no null, empty, zero, or non-finite vector; doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


class Cells:
    """A kd-tree over projected points whose leaves are cells, numbered from 0: the widest dimension of the sample is halved at its median."""

    def __init__(self, points: np.ndarray, n_cells: int):
        self.dim, self.cut, self.left, self.right = [], [], [], []
        self.n = 0
        self.root = self._grow(points, n_cells)

    def _grow(self, points: np.ndarray, n_cells: int) -> int:
        """A node's number, or the complement of a cell's."""
        if len(points):
            d = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            cut = float(np.median(points[:, d]))
            low = points[:, d] < cut
        if n_cells < 2 or len(points) < 2 or not low.any():
            self.n += 1
            return -self.n
        at = len(self.dim)
        self.dim.append(d)
        self.cut.append(cut)
        self.left.append(0)
        self.right.append(0)
        self.left[at] = self._grow(points[low], n_cells // 2)
        self.right[at] = self._grow(points[~low], n_cells - n_cells // 2)
        return at

    def place(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        dim, cut, left, right = map(np.array, (self.dim, self.cut, self.left, self.right))
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = np.where(points[inner, dim[node]] < cut[node], left[node], right[node])
        return -at - 1


def _stacked(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    m: int = 8,
    probability: float = 0.99,
    seed: int = 7,
    leaf: int = 32,
    block_rows: int = 8192,
    sample_rows: int = 50_000,
    max_cells: int = 16_384,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows of each query by Euclidean distance, without the row of its own
    id; ties go to the smaller id; all candidates where there are fewer than k.

    Null, empty, zero, and non-finite vectors and rows without an id take no part; a long vector is like any other.  A query meets only vectors of its own length.
    Repeated rows are candidates as often as they occur, and one query; of an id with several vectors each is a query.  No queries or no rows give no result.  Other
    columns are ignored.

    ``m`` projections and ``probability`` set the stopping test.  Cells are fitted on about ``sample_rows`` vectors, as many as keep ``block_rows`` rows in a cell, at most ``max_cells``;
    every row is placed.  The driver sees the sample and each cell's box, both of bounded size, and no query.  A cell of more than
    ``block_rows`` rows is searched in blocks of about that many.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    nothing = "query_id long, rank int, vec_id long, score double"
    # Of equal vectors only the rows of the k + 1 smallest ids can be among the k nearest of anything.
    counted = usable(vectors, id_col, vector_col).groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    first = Window.partitionBy("v").orderBy("id")
    rows = scratch.table(counted.withColumn("turn", F.row_number().over(first)).filter(F.col("turn") <= k + 1).select("id", "v", "n"))
    asked = scratch.table(usable(queries, id_col, vector_col).distinct())
    distinct = asked.select("v").distinct()
    n_rows, most = rows.agg(F.count("*"), F.max("n")).first()
    if not n_rows or not asked.limit(1).count():
        return spark.createDataFrame([], nothing)
    wide = k + int(most)  # a query's own id is taken out afterwards, however often it occurs
    limit = chi_square_quantile(probability, m)

    every = max(1, n_rows // sample_rows)
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(every)) == 0).select("v").toPandas()["v"]
    n_cells = max(1, min(max_cells, -(-n_rows // block_rows)))
    dims = sample.map(len)
    trees = {int(d): Cells(_stacked(own) @ directions(int(d), m, seed), n_cells) for d, own in sample.groupby(dims)}
    sent = spark.sparkContext.broadcast(trees)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cell and projection of every vector; vectors of a length that the sample lacks are one cell."""
        for batch in batches:
            for dim, own in batch.groupby(batch["v"].map(len)):
                points = _stacked(own["v"]) @ directions(dim, m, seed)
                tree = sent.value.get(dim)
                yield own.assign(dim=dim, cell=tree.place(points) if tree else 0, p=list(points))

    extra = "dim int, cell int, p array<double>"
    placed = rows.mapInPandas(project, f"id long, v array<double>, n long, {extra}")
    placed = scratch.table(placed.select(F.explode(F.array_repeat("id", F.col("n").cast("int"))).alias("id"), "v", "dim", "cell", "p"))
    scratch.remove(rows)
    corners = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(m)]
    boxes = placed.groupBy("dim", "cell").agg(F.count("*").alias("rows"), *corners).toPandas()
    boxes["blocks"] = -(-boxes["rows"] // block_rows)
    counts = spark.createDataFrame(boxes[["dim", "cell", "blocks"]].astype({"dim": "int32", "cell": "int32", "blocks": "int64"}), "dim int, cell int, blocks long")
    held = placed.join(F.broadcast(counts), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks", "p")
    q = distinct.withColumn("q", F.monotonically_increasing_id())
    q = scratch.table(q.mapInPandas(project, f"v array<double>, q long, {extra}"))
    table_of = {int(d): own.reset_index(drop=True) for d, own in boxes.groupby("dim")}
    sent_boxes = spark.sparkContext.broadcast({d: (own["cell"].to_numpy(), own["blocks"].to_numpy(), own[[f"low{i}" for i in range(m)]].to_numpy(float), own[[f"high{i}" for i in range(m)]].to_numpy(float)) for d, own in table_of.items()})

    def search(own: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})
        if own.empty or mine.empty:
            return none
        v, ask = _stacked(own["v"]), _stacked(mine["v"])
        projection = directions(v.shape[1], m, seed)
        block = Block(own["id"].to_numpy(np.int64), v, projection, leaf)
        found = list(block.search(ask, ask @ projection, mine["bound"].to_numpy(float), wide, limit))
        which, near, score = map(np.concatenate, zip(*found, strict=True))
        return pd.DataFrame({"q": mine["q"].to_numpy(np.int64)[which], "id": near, "score": score})

    def searched(routes: DataFrame) -> DataFrame:
        keys = ["dim", "cell", "block"]
        return held.select("id", "v", *keys).groupBy(*keys).cogroup(routes.groupBy(*keys)).applyInPandas(search, "q long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy("score", "id")
        top = found.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= wide)
        return top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))

    def route(first_round: bool):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for number, dim, cell, p, bound in zip(batch["q"], batch["dim"], batch["cell"], batch["p"], batch["bound"], strict=True):
                    if dim not in sent_boxes.value:
                        continue
                    cells, blocks, low, high = sent_boxes.value[dim]
                    gap = np.maximum(0, np.maximum(low - p, p - high))
                    gap = np.einsum("ij,ij->i", gap, gap)
                    own = int(np.argmin(np.where(cells == cell, -1.0, gap)))  # the nearest cell where its own holds no row
                    go = np.arange(len(cells)) == own
                    if not first_round:
                        go = ~go & (gap <= bound * bound * limit)
                    for c, n in zip(cells[go].tolist(), blocks[go].tolist(), strict=True):
                        out += [(number, dim, c, b, bound) for b in range(n)]
                yield pd.DataFrame(out, columns=["q", "dim", "cell", "block", "bound"])

        return of

    routed = "q long, dim int, cell int, block int, bound double"
    ask = q.withColumn("bound", F.lit(float("inf")))
    near = scratch.table(searched(ask.mapInPandas(route(True), routed).join(q.select("q", "v"), "q")))
    bound = best(near).select("q", F.when(F.size("near") >= wide, F.element_at("near", wide)["score"]).otherwise(F.lit(float("inf"))).alias("bound"))
    ask = q.join(bound, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    far = scratch.table(searched(ask.mapInPandas(route(False), routed).join(q.select("q", "v"), "q")))
    lists = best(near.unionAll(far)).join(q.select("q", "v"), "q").select("v", "near")
    # Every query reads its vector's list, less its own id.
    out = asked.join(lists, "v").select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op10_stable_projections(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.pmod("vec_id", F.lit(100)) == 0))


QUERIES = {"op10_stable_projections": op10_stable_projections}
