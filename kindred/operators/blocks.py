"""All pairs of entities, block by block: every block of entities meets every other once, in one task, and only results leave the task.

A row travels once for each block, a pair never does: similarities are numpy over two blocks, and what is asked of them (rows, sums, the best of each
entity) is taken where they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import plain_number, squeeze
from ..model import CATEGORIES, DEFAULT_WEIGHTS, SHORT, category
from . import linkage, validate

# Entities in a block, about, and pairs that are worked on at a time.
BLOCK, PAIRS_AT_ONCE = 2000, 1 << 18
KEY = ["component", "param"]
RULE, VECTOR = "rule", "vector"


def _cat(name) -> F.Column:
    return F.coalesce(*(F.when(name == c, F.lit(i)) for i, c in enumerate(CATEGORIES)))


def _whole(vec: str) -> F.Column:
    """An array, null if it holds nulls: numpy would read those as NaN."""
    return F.when(~F.exists(vec, lambda v: v.isNull()), F.col(vec).cast("array<double>"))


def rule_cells(features: DataFrame, stats: DataFrame) -> DataFrame:
    """What rule similarity needs of every fact."""
    text = squeeze(F.col("value_str"))
    return features.join(stats, KEY, "left").select(
        "entity_id", F.lit(RULE).alias("method"), _cat(category(F.col("ptype"))).alias("cat"), F.to_json(F.struct(*KEY)).alias("key"), F.col("value_num").alias("num"), text.alias("txt"),
        F.when(F.col("value_num").isNull(), plain_number(F.col("value_str"))).otherwise(F.col("value_num")).alias("alt"), F.col("vmin").alias("low"), F.col("vmax").alias("high"),
    )


def clustered_cells(vecs: DataFrame, method: str, clusters: DataFrame | None = None) -> DataFrame:
    """Arrays of all categories as one method, with ``clusters(entity_id, category, cluster)`` if given."""
    rows = vecs.withColumn("cluster", F.lit(None).cast("int")) if clusters is None else vecs.join(clusters.hint("merge"), ["entity_id", "category"])
    return rows.select("entity_id", F.lit(method).alias("method"), _cat(F.col("category")).alias("cat"), _whole("vec").alias("vec"), "cluster")


def dense_cells(vecs: DataFrame) -> DataFrame:
    """Arrays, each category a method of its own."""
    return vecs.select("entity_id", F.col("category").alias("method"), _whole("vec").alias("vec"))


def vector_cells(vectors: DataFrame) -> DataFrame:
    """What vector similarity needs of every cell that is not zero."""
    none = F.lit(None)
    return vectors.select(
        "entity_id", F.lit(VECTOR).alias("method"), _cat(F.col("category")).alias("cat"), F.col("idx").cast("string").alias("key"), F.col("val").alias("num"), none.cast("string").alias("txt"),
        none.cast("double").alias("alt"), none.cast("double").alias("low"), none.cast("double").alias("high"),
    )


def met(rows: DataFrame, block: int = BLOCK, n: int | None = None, owns: tuple[int, DataFrame] | None = None) -> DataFrame:
    """``(lo, hi, cells)``: one row for each two blocks, a block with itself included, holding the rows of both with their block ``own``.  ``owns``: number of
    blocks and ``(entity_id, own)``, if blocks are given."""
    rows = rows.filter(F.col("entity_id").isNotNull())
    if owns is None:
        count = max(1, -(-(rows.select("entity_id").distinct().count() if n is None else n) // block))
        own = F.pmod(F.xxhash64("entity_id"), F.lit(count)).cast("int")
    else:
        count, own = owns[0], F.col("own")
    columns = rows.columns
    rows = rows if owns is None else rows.join(owns[1].hint("merge"), "entity_id")
    rows = rows.select(F.struct(own.alias("own"), *columns).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("other"))
    rows = rows.select(F.least("cell.own", "other").alias("lo"), F.greatest("cell.own", "other").alias("hi"), "cell")
    return rows.repartition(min(count * (count + 1) // 2, 2000), "lo", "hi").groupBy("lo", "hi").agg(F.collect_list("cell").alias("cells"))


class _Rule:
    """Rule similarity of the entities of two blocks."""

    def __init__(self, cells: pd.DataFrame, n: int):
        self.keys: dict = {}
        self.sizes = np.zeros((len(CATEGORIES), n))
        np.add.at(self.sizes, (cells["cat"].to_numpy(), cells["e"].to_numpy()), 1)
        cells = cells.assign(turn=cells.groupby(["key", "e"]).cumcount(), code=pd.factorize(cells["txt"])[0])
        for (key, cat, _), own in cells.groupby(["key", "cat", "turn"], sort=False):
            e = own["e"].to_numpy()
            column = {"there": np.zeros(n, bool), "numeric": np.zeros(n, bool), "texts": np.zeros(n, bool), "num": np.zeros(n), "alt": np.full(n, np.nan), "known": np.zeros(n, bool), "code": np.full(n, -1)}
            column["there"][e] = True
            column["numeric"][e] = own["has_num"]
            column["texts"][e] = own["code"].to_numpy() >= 0
            column["num"][e], column["alt"][e], column["known"][e], column["code"][e] = own["num"], own["alt"], own["has_alt"], own["code"]
            # A parameter's range is the same in all of its rows; those without a number may not know it.
            ends = (own["low"].min(), own["high"].max()) if own["has_num"].any() else (0.0, 0.0)
            self.keys.setdefault((key, cat), []).append((column, ends))

    def _similar(self, x: dict, y: dict, rows: np.ndarray, cols: np.ndarray, width: float) -> tuple:
        """Scores, and masks of the shared and of the scored, or None where that is all."""
        part = {k: v[rows] for k, v in x.items()}
        other = {k: v[cols] for k, v in y.items()}
        by_rows, by_cols = lambda k: part[k][:, None], lambda k: other[k][None, :]

        def numbers():
            if width == 0:
                return (by_rows("num") == by_cols("num")).astype(float)
            return np.fmax(0.0, np.fmin(1.0, 1 - np.abs(by_rows("num") - by_cols("num")) / width))

        if part["numeric"].all() and other["numeric"].all():
            return numbers(), None, None
        both_text = by_rows("code") == by_cols("code")
        if not part["numeric"].any() and not other["numeric"].any() and part["texts"].all() and other["texts"].all():
            return both_text.astype(float), None, None
        shared = by_rows("there") & by_cols("there")
        some_x, some_y = part["numeric"] | part["texts"], other["numeric"] | other["texts"]
        two = some_x[:, None] & some_y[None, :]
        nn = by_rows("numeric") & by_cols("numeric")
        tt = ~by_rows("numeric") & ~by_cols("numeric")
        same = (by_rows("alt") == by_cols("alt")) | (np.isnan(by_rows("alt")) & np.isnan(by_cols("alt")))
        sim = np.where(nn, numbers(), np.where(tt, both_text, same & by_rows("known") & by_cols("known")))
        scored = shared & (some_x[:, None] | some_y[None, :])
        return np.where(shared & two, sim, 0.0), shared, scored

    def __call__(self, rows: np.ndarray, cols: np.ndarray) -> tuple[list[np.ndarray], None]:
        shape = (len(rows), len(cols))
        score, scored, shared = ([np.zeros(shape) for _ in CATEGORIES] for _ in range(3))
        for (_, cat), columns in self.keys.items():
            for x, (low, high) in columns:
                for y, (low2, high2) in columns:
                    s, both, counted = self._similar(x, y, rows, cols, max(high, high2) - min(low, low2) if x["numeric"].any() and y["numeric"].any() else 0.0)
                    score[cat] += s
                    shared[cat] += 1 if both is None else both
                    scored[cat] += 1 if counted is None else counted
        sims = []
        for c in range(len(CATEGORIES)):
            n = self.sizes[c][rows][:, None] + self.sizes[c][cols][None, :] - 2 * shared[c] + scored[c]
            sims.append(np.divide(score[c], n, out=np.zeros(shape), where=n > 0))
        return sims, None


class _Vector:
    """Cosines of the entities of two blocks, category by category."""

    def __init__(self, cells: pd.DataFrame, n: int):
        self.by: list = []
        for c in range(len(CATEGORIES)):
            own = cells[cells["cat"] == c]
            e, (dim, names) = own["e"].to_numpy(), pd.factorize(own["key"])
            norm2, there = np.zeros(n), np.zeros(n, bool)
            np.add.at(norm2, e, own["num"].to_numpy() ** 2)
            there[e] = True
            self.by.append((e, dim, own["num"].to_numpy(), len(names), np.sqrt(norm2), there))
        self.held: dict = {}

    def _matrices(self, cols: np.ndarray, n: int) -> list:
        """The columns' cells as matrices, made once for all chunks of rows."""
        key = (len(cols), int(cols[0]) if len(cols) else -1)
        if key not in self.held:
            place = np.full(n, -1)
            place[cols] = np.arange(len(cols))
            made = []
            for e, dim, val, _, _, _ in self.by:
                own = place[e] >= 0
                dims = np.unique(dim[own])
                m = np.zeros((len(dims), len(cols)))
                np.add.at(m, (np.searchsorted(dims, dim[own]), place[e][own]), val[own])
                made.append((dims, m))
            self.held = {key: made}
        return self.held[key]

    def __call__(self, rows: np.ndarray, cols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray | None]:
        sims, any_there = [], np.zeros((len(rows), len(cols)), bool)
        for (e, dim, val, _, norm, there), (dims, right) in zip(self.by, self._matrices(cols, len(self.by[0][4])), strict=True):
            # Only dimensions that both sides know can add to a product.
            place = np.full(len(norm), -1)
            place[rows] = np.arange(len(rows))
            own = (place[e] >= 0) & np.isin(dim, dims)
            used, at = np.unique(dim[own], return_inverse=True)
            left = np.zeros((len(rows), len(used)))
            np.add.at(left, (place[e][own], at), val[own])
            dot = left @ right[np.searchsorted(dims, used)]
            size = norm[rows][:, None] * norm[cols][None, :]
            sim = (np.divide(dot, size, out=np.zeros_like(dot), where=size != 0) + 1) / 2
            both = there[rows][:, None] & there[cols][None, :]
            any_there |= both
            sims.append(sim if both.all() else np.where(both, sim, 0.5))
        return sims, None if any_there.all() else any_there


class _Dense:
    """Cosines of the entities of two blocks by their arrays; 0 with an array that is null (or held nulls) or has another length."""

    def __init__(self, cells: pd.DataFrame, n: int):
        e, vecs = cells["e"].to_numpy(), cells["vec"].to_list()
        self.there, self.length = np.zeros(n, bool), np.full(n, -1)
        self.there[e] = True
        self.length[e] = [-1 if v is None else len(v) for v in vecs]
        self.vec = np.zeros((n, max([0, *self.length])))
        for i, v in zip(e, vecs, strict=True):
            if v is not None:
                self.vec[i, : len(v)] = v
        self.norm = np.sqrt((self.vec * self.vec).sum(axis=1))

    def __call__(self, rows: np.ndarray, cols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray | None]:
        dot = self.vec[rows] @ self.vec[cols].T
        size = self.norm[rows][:, None] * self.norm[cols][None, :]
        alike = (self.length[rows][:, None] == self.length[cols][None, :]) & (self.length[rows] >= 0)[:, None]
        both = self.there[rows][:, None] & self.there[cols][None, :]
        return [(np.divide(dot, size, out=np.zeros_like(dot), where=alike & (size != 0)) + 1) / 2], None if both.all() else both


class _Clustered:
    """Cosines by arrays, category by category; of entities in different clusters their clusters' similarity instead."""

    def __init__(self, cells: pd.DataFrame, n: int, across: dict):
        self.by = []
        for c in range(len(CATEGORIES)):
            own = cells[cells["cat"] == c]
            cluster = np.full(n, -1)
            given = own["cluster"].notna().to_numpy()
            cluster[own["e"].to_numpy()[given]] = own["cluster"].to_numpy()[given].astype(int)
            self.by.append((_Dense(own, n), cluster, np.array(across[c]) if c in across and given.any() else None))

    def __call__(self, rows: np.ndarray, cols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray | None]:
        sims, any_there = [], np.zeros((len(rows), len(cols)), bool)
        for dense, cluster, across in self.by:
            (sim,), both = dense(rows, cols)
            if across is not None:
                a, b = cluster[rows][:, None], cluster[cols][None, :]
                sim = np.where(a == b, sim, across[a, b])
            any_there |= True if both is None else both
            sims.append(sim if both is None else np.where(both, sim, 0.5))
        return sims, None if any_there.all() else any_there


def _total(sims: list[np.ndarray], weights: dict[str, float]) -> np.ndarray:
    used = [(sims[CATEGORIES.index(c)] if c in CATEGORIES else 0.0, float(w)) for c, w in weights.items() if w > 0]
    return sum((s * w for s, w in used), np.zeros_like(sims[0])) / sum(w for _, w in used) if used else np.zeros_like(sims[0])


def half_up(x: np.ndarray, digits: int | None) -> np.ndarray:
    return x if digits is None else np.floor(x * 10.0**digits + 0.5) / 10.0**digits


class _Met:
    """Two blocks: ids in their order, and similarities of any rows with any columns."""

    def __init__(self, cells: pa.StructArray, lo: int, methods: list[str], one: bool, across: dict, hybrid: dict | None):
        columns = dict(zip([f.name for f in cells.type], cells.flatten(), strict=True))
        table = pd.DataFrame({k: v.to_numpy(zero_copy_only=False) for k, v in columns.items() if k != "entity_id"})
        for k in {"num", "alt"} & set(columns):
            table[f"has_{k}"] = columns[k].is_valid().to_numpy(zero_copy_only=False)
        ids = sorted(set(columns["entity_id"].to_pylist()))
        self.ids = pa.array(ids, columns["entity_id"].type)
        table["e"] = pd.Index(ids).get_indexer(columns["entity_id"].to_numpy(zero_copy_only=False))
        block = np.full(len(ids), lo)
        block[table["e"]] = table["own"]
        self.x = np.flatnonzero(block == lo)
        self.y = self.x if one else np.flatnonzero(block != lo)
        kinds = {RULE: _Rule, VECTOR: _Vector}
        dense = (lambda rows, n: _Clustered(rows, n, across)) if "cluster" in table else _Dense
        self.kinds = {m: kinds.get(m, dense)(table[table["method"] == m], len(ids)) for m in methods}
        self.hybrid = hybrid

    def chunks(self, weights: dict, digits: int | None, back: bool = False, at_once: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
        """Rows' and columns' numbers and, by method, ``(sims, total, mask)``; numbers are in the order of ids.  ``back``: the second block's rows with
        the first's columns."""
        x, y = (self.y, self.x) if back else (self.x, self.y)
        at_once = max(1, at_once // max(1, len(y)))
        for i in range(0, len(x), at_once):
            rows, out = x[i : i + at_once], {}
            for m, similar in self.kinds.items():
                sims, mask = similar(rows, y)
                out[m] = (sims, half_up(_total(sims, weights) if len(sims) == len(CATEGORIES) else sims[0], digits), mask)
            if self.hybrid:
                out["hybrid"] = _combined(out, self.hybrid)
            yield rows, y, out


def _flat(m: _Met, rows: np.ndarray, cols: np.ndarray, mask: np.ndarray | None) -> np.ndarray | slice:
    """Which cells of a chunk are pairs: in a block with itself those above the diagonal."""
    if m.x is m.y:
        above = rows[:, None] < cols[None, :]
        return above if mask is None else above & mask
    return slice(None) if mask is None else mask


def _combined(got: dict, method_weights: dict[str, float]) -> tuple:
    """Sums over the methods by weight, and which pairs any of them knows."""
    used = [(t, mask, float(method_weights[k])) for k, (_, t, mask) in got.items() if k in method_weights]
    known = None if any(mask is None for _, mask, _ in used) else np.logical_or.reduce([mask for _, mask, _ in used])
    return None, sum(t * w if mask is None else np.where(mask, t * w, 0.0) for t, mask, w in used), known


class Pairs:
    """Similarities of all pairs by several methods, never stored: ``rows`` makes them a table, the others sum them up where they arise."""

    def __init__(self, cells: DataFrame, methods: tuple[str, ...], weights: dict[str, float] = DEFAULT_WEIGHTS, digits: int | None = None, block: int = BLOCK, across: dict | None = None, hybrid: dict[str, float] | None = None, n: int | None = None, owns: tuple[int, DataFrame] | None = None):
        """``across``: similarities of a category's clusters, for cells with clusters; ``hybrid``: weights of one more method, "hybrid"; ``n``: the
        number of entities, if known; ``owns``: their blocks, if given (``met``)."""
        self.across, self.hybrid = across or {}, hybrid
        self.cells, self.methods, self.weights, self.digits, self.block = cells, list(methods), weights, digits, block
        self.id_type = dict(cells.dtypes)["entity_id"]
        self.pairs = met(cells, block, n, owns)

    def _map(self, take: Callable[[_Met], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        methods, across, hybrid = self.methods, self.across, self.hybrid

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    lo, hi = batch.column("lo")[k].as_py(), batch.column("hi")[k].as_py()
                    cells = batch.column("cells").slice(k, 1).flatten()
                    yield from take(_Met(cells, lo, methods, lo == hi, across, hybrid))

        return self.pairs.mapInArrow(run, schema)

    def wide(self) -> DataFrame:
        """``(a, b, sim_geom, sim_mtrl, sim_req, sim_total)`` for every pair a < b, by the one method."""
        weights, digits, (method,) = self.weights, self.digits, self.methods

        def take(m: _Met):
            for rows, cols, got in m.chunks(weights, digits):
                sims, total, mask = got[method]
                a, b, of = _ordered(m, rows, cols, mask)
                yield pa.RecordBatch.from_arrays([a, b, *(pa.array(half_up(s[of], digits).ravel()) for s in sims), pa.array(total[of].ravel())], names=["a", "b", *(f"sim_{SHORT[c]}" for c in CATEGORIES), "sim_total"])

        sims = ", ".join(f"sim_{SHORT[c]} double" for c in CATEGORIES)
        return self._map(take, f"a {self.id_type}, b {self.id_type}, {sims}, sim_total double")

    def rows(self) -> DataFrame:
        """``(a, b, method, sim)`` for every pair a < b and method."""
        weights, digits = self.weights, self.digits

        def take(m: _Met):
            for rows, cols, got in m.chunks(weights, digits):
                for method, (_, total, mask) in got.items():
                    a, b, of = _ordered(m, rows, cols, mask)
                    yield pa.RecordBatch.from_arrays([a, b, pa.repeat(pa.scalar(method), len(a)), pa.array(total[of].ravel())], names=["a", "b", "method", "sim"])

        return self._map(take, f"a {self.id_type}, b {self.id_type}, method string, sim double")

    def weighted(self, method_weights: dict[str, float], name: str = "hybrid", to: int | None = None) -> DataFrame:
        """``validate.hybrid_pairs`` of the methods, each pair's sum taken where its parts arise, and rounded ``to`` so many digits."""
        weights, digits = self.weights, self.digits

        def take(m: _Met):
            for rows, cols, got in m.chunks(weights, digits):
                _, total, known = _combined(got, method_weights)
                total = half_up(total, to)
                a, b, of = _ordered(m, rows, cols, known)
                yield pa.RecordBatch.from_arrays([a, b, pa.repeat(pa.scalar(name), len(a)), pa.array(total[of].ravel())], names=["a", "b", "method", "sim"])

        return self._map(take, f"a {self.id_type}, b {self.id_type}, method string, sim double")

    def _sums(self, of: Callable[[dict], Iterator[tuple]], names: str) -> DataFrame:
        """Rows that ``of`` makes of each chunk's ``{method: (flat sims, flat mask)}``."""
        weights, digits = self.weights, self.digits
        columns = [x.split()[0] for x in names.split(", ")]

        def take(m: _Met):
            found = []
            for rows, cols, got in m.chunks(weights, digits):
                above = _flat(m, rows, cols, None)
                found += of({k: (t[above].ravel(), None if mask is None else mask[above].ravel()) for k, (_, t, mask) in got.items()})
            if found:
                kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in names.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)], names=columns)

        return self._map(take, names)

    def best(self, k: int) -> DataFrame:
        """``(method, a, b, sim)``: the k most similar others of each entity in every block, ties by id: all that can be among its k best."""
        weights, digits = self.weights, self.digits

        def take(m: _Met):
            for back in (False,) if m.x is m.y else (False, True):
                for rows, cols, got in m.chunks(weights, digits, back):
                    for method, (_, total, mask) in got.items():
                        no = rows[:, None] == cols[None, :] if m.x is m.y else np.zeros(total.shape, bool)
                        no = no if mask is None else no | ~mask
                        x, y = _first(total, no, k, digits)
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(pa.scalar(method), len(x)), m.ids.take(pa.array(rows[x])), m.ids.take(pa.array(cols[y])), pa.array(total[x, y])], names=["method", "a", "b", "sim"]
                        )

        return self._map(take, f"method string, a {self.id_type}, b {self.id_type}, sim double")

    def linkage_silhouette(self, clusters: int = 5) -> DataFrame:
        """``(method, silhouette)``: ``validate.silhouette`` of ``validate.cluster_pairs``, each method's matrix of distances in one task, filled block by block: two
        matrices of doubles.  Of more than ``linkage.DENSE`` entities the matrix is that of clusters, after merges in rounds.  With ``clusters`` or fewer
        entities there are no labels, and no row."""
        weights, digits = self.weights, self.digits
        ids = self.cells.select("entity_id").filter("entity_id IS NOT NULL").distinct().orderBy("entity_id")
        order = pa.array(sorted(r[0] for r in ids.collect()))
        n = len(order)
        if n <= clusters:
            return self.cells.sparkSession.createDataFrame([], "method string, silhouette double")
        if n > linkage.DENSE:
            return linkage.Linkage(self, order.to_pylist(), clusters).silhouettes(self.methods + ["hybrid"] * bool(self.hybrid))
        sent = self.cells.sparkSession.sparkContext.broadcast(order.to_pylist())

        def take(m: _Met):
            at = pd.Index(sent.value).get_indexer(m.ids.to_numpy(zero_copy_only=False)).astype(np.int32)
            for rows, cols, got in m.chunks(weights, digits):
                for method, (_, total, mask) in got.items():
                    far = np.clip(1 - (total if mask is None else np.where(mask, total, 1.0)), 0, 1)
                    yield pa.RecordBatch.from_arrays([pa.array([method]), *(pa.array([x.tobytes()], pa.binary()) for x in (at[rows], at[cols], far))], names=["method", "x", "y", "d"])

        methods = self.methods

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                for method, x, y, far in zip(*(batch.column(c) for c in ("method", "x", "y", "d")), strict=True):
                    d = held.setdefault(method.as_py(), np.zeros((n, n)))
                    x, y = (np.frombuffer(v.as_buffer(), np.int32) for v in (x, y))
                    far = np.frombuffer(far.as_buffer()).reshape(len(x), len(y))
                    d[np.ix_(x, y)], d[np.ix_(y, x)] = far, far.T
            for method in sorted(held):
                d = held.pop(method)
                np.fill_diagonal(d, 0)
                score = validate.matrix_silhouette(d, validate.average_linkage(d, clusters))
                yield pa.RecordBatch.from_arrays([pa.array([method]), pa.array([score])], names=["method", "silhouette"])

        parts = self._map(take, "method string, x binary, y binary, d binary")
        return parts.repartition(len(methods), "method").mapInArrow(fill, "method string, silhouette double")

    def stats(self) -> DataFrame:
        """``validate.pair_stats``."""

        def of(got):
            for k, (t, mask) in got.items():
                t = t if mask is None else t[mask]
                if len(t):
                    mean = t.mean()
                    yield k, len(t), float(mean), float(((t - mean) ** 2).sum()), float(t.min()), float(t.max())

        parts = self._sums(of, "method string, n long, m double, s double, low double, high double")
        every = parts.groupBy("method").agg(
            F.sum("n").alias("n_pairs"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("s").alias("s"),
            F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"), F.min("low").alias("min"), F.max("high").alias("max"),
        )
        spread = F.col("s") / F.col("n_pairs") + F.greatest(F.lit(0.0), F.col("squares") / F.col("n_pairs") - F.col("mean") * F.col("mean"))
        out = every.select("method", "n_pairs", "mean", F.sqrt(spread).alias("std"), "min", "max", (F.col("max") - F.col("min")).alias("range"))
        return out.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.nullif("mean", F.lit(0.0))).otherwise(F.lit(0.0)))

    def histogram(self, bins: int = 30) -> DataFrame:
        """``validate.histogram``; one row a method goes to the driver and back."""
        ends = {r["method"]: (r["min"], r["max"]) for r in self.stats().select("method", "min", "max").collect()}

        def of(got):
            for k, (t, mask) in got.items():
                t = t if mask is None else t[mask]
                if len(t):
                    low, high = ends[k]
                    at = np.minimum(np.floor((t - low) / (high - low) * bins), bins - 1).astype(int) if high > low else np.zeros(len(t), int)
                    n = np.bincount(at, minlength=bins)
                    yield from ((k, int(i), int(n[i])) for i in np.flatnonzero(n))

        return self._sums(of, "method string, bin int, n long").groupBy("method", "bin").agg(F.sum("n").alias("n"))

    def regression(self, reference: str) -> DataFrame:
        """``validate.regression``."""

        def of(got):
            x, known = got[reference]
            for k, (y, mask) in got.items():
                if k != reference:
                    both = None if known is None and mask is None else (True if known is None else known) & (True if mask is None else mask)
                    u, v = (x, y) if both is None else (x[both], y[both])
                    if len(u):
                        yield k, len(u), float(u.sum()), float(v.sum()), float((u * u).sum()), float((u * v).sum())

        parts = self._sums(of, "method string, n long, x double, y double, xx double, xy double")
        every = parts.groupBy("method").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "xy")))
        slope = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.nullif(F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.lit(0.0))
        return every.withColumn("slope", slope).select("method", "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).alias("intercept"))


def _ordered(m: _Met, rows: np.ndarray, cols: np.ndarray, mask: np.ndarray | None) -> tuple:
    """Ids of the chunk's pairs, the lesser first, and which cells they are."""
    of = _flat(m, rows, cols, mask)
    rows, cols = rows.astype(np.int32), cols.astype(np.int32)
    x = np.broadcast_to(rows[:, None], (len(rows), len(cols)))[of].ravel()
    y = np.broadcast_to(cols[None, :], (len(rows), len(cols)))[of].ravel()
    return m.ids.take(pa.array(np.minimum(x, y))), m.ids.take(pa.array(np.maximum(x, y))), of


def _first(total: np.ndarray, no: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k greatest cells but for ``no``; of equals the first columns."""
    # NaN is above all numbers, as the engine orders; columns stand in the order of their ids.
    if digits is not None and digits <= 9 and total.shape[1] < 1 << 20 and np.abs(total).max(initial=0) < 4:
        order = (np.rint(np.where(no, -5.0, total) * 10.0**digits).astype(np.int64) << 20) - np.arange(total.shape[1])
        first = np.argpartition(order, -k, axis=1)[:, -k:] if total.shape[1] > k else np.broadcast_to(np.arange(total.shape[1]), order.shape)
    else:
        first = np.argsort(-np.where(no, -np.inf, np.where(np.isnan(total), np.inf, total)), axis=1, kind="stable")[:, :k]
    x = np.broadcast_to(np.arange(len(total))[:, None], first.shape).ravel()
    y = first.ravel()
    known = ~no[x, y]
    return x[known], y[known]


# --- nearest vectors -------------------------------------------------------------------------------------------

# Entities in a group of rows at most, and groups at least where there are as many blocks.
GROUP, GROUPS = 1 << 14, 12


class _Vectors:
    """Arrays of one method in the order of their ids; of repeated ids the last."""

    def __init__(self, ids: pa.Array, vecs: pa.ListArray):
        ids, at = np.unique(ids.to_numpy(zero_copy_only=False)[::-1], return_index=True)
        vecs = vecs.take(pa.array(len(vecs) - 1 - at))
        self.ids, self.length = ids, vecs.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        self.x = np.zeros((len(ids), max(0, self.length.max(initial=0))))
        self.x[np.arange(self.x.shape[1]) < self.length[:, None]] = vecs.flatten().to_numpy(zero_copy_only=False)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        #: All of one length, and no norm that is zero, not finite, or could overflow in a product.
        self.plain = len(ids) > 0 and (self.length == self.length[0]).all() and bool(((self.norm > 1e-100) & (self.norm < 1e100)).all())

    @staticmethod
    def by_method(cells: pa.StructArray) -> dict[str, _Vectors]:
        table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(cells)]).combine_chunks()
        out = {}
        for method in table["method"].unique().to_pylist():
            own = table.filter(pa.compute.equal(table["method"], method)).combine_chunks()
            out[method] = _Vectors(own["entity_id"].combine_chunks(), own["vec"].combine_chunks())
        return out


class _Nearest:
    """The k most similar others of some entities, among all the blocks that are added."""

    def __init__(self, own: _Vectors, k: int, digits: int | None):
        self.own, self.k, self.digits = own, k, digits
        self.row, self.sim, self.b = np.zeros(0, np.int64), np.zeros(0), own.ids[:0]
        self.least = np.full(len(own.ids), -np.inf)

    def add(self, other: _Vectors) -> None:
        own, k, digits = self.own, self.k, self.digits
        width = max(own.x.shape[1], other.x.shape[1])
        padded = lambda v: np.pad(v.x, ((0, 0), (0, width - v.x.shape[1])))
        x, y = padded(own), padded(other)
        same = np.full(len(own.ids), -1)  # each row's own column
        at = np.minimum(np.searchsorted(other.ids, own.ids), len(other.ids) - 1)
        found = other.ids[at] == own.ids
        same[found] = at[found]
        plain = own.plain and other.plain and own.length[0] == other.length[0]
        # A rounded similarity can only reach the k-th best so far with a cosine of that or more: the others need no rounding and no order.
        bound = (2 * self.least - 1 - (0 if digits is None else 2 * 10.0**-digits) - 1e-12) * own.norm if plain else None
        unit = np.ascontiguousarray((y / other.norm[:, None]).T) if plain else None
        at_once, parts = max(1, PAIRS_AT_ONCE // max(1, len(y))), []
        for i in range(0, len(x), at_once):
            rows = slice(i, i + at_once)
            n, r = len(x[rows]), None
            if plain and np.isfinite(self.least[rows]).all():
                hits = np.flatnonzero(x[rows] @ unit >= bound[rows, None])
                if len(hits) <= 8 * k * n:
                    r, c = np.divmod(hits, len(y))
                    other_one = same[rows][r] != c
                    r, c = r[other_one], c[other_one]
                    dot = np.einsum("ij,ij->i", x[rows][r], y[c])
                    sim = half_up((dot / (own.norm[rows][r] * other.norm[c]) + 1) / 2, digits)
            if r is None:
                dot, size = x[rows] @ y.T, own.norm[rows, None] * other.norm[None, :]
                alike = (own.length[rows, None] == other.length[None, :]) & (own.length[rows, None] >= 0)
                total = half_up((np.divide(dot, size, out=np.zeros_like(dot), where=alike & (size != 0)) + 1) / 2, digits)
                r, c = _first(total, same[rows, None] == np.arange(len(y)), k, digits)
                sim = total[r, c]
            parts.append((r + i, sim, other.ids[c]))
        row, sim, b = (np.concatenate(v) for v in zip((self.row, self.sim, self.b), *parts, strict=True))
        ranks = np.unique(b, return_inverse=True)[1] if b.dtype == object else b
        order = np.lexsort((ranks, -np.where(np.isnan(sim), np.inf, sim), row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.row, self.sim, self.b = row[place < k], sim[order][place < k], b[order][place < k]
        last = order[place == k - 1]
        self.least[row[place == k - 1]] = np.where(np.isnan(sim[last]), np.inf, sim[last])


def nearest(vecs: DataFrame, k: int, digits: int | None = None, block: int = BLOCK, group: int = GROUP, groups: int = GROUPS) -> DataFrame:
    """``Pairs.best`` over ``dense_cells``, but with the k best among all others: a group of entities meets every block in one task and keeps its
    k best so far, so that most similarities are only compared with the least of them."""
    cells = dense_cells(vecs).filter(F.col("entity_id").isNotNull() & F.col("method").isin(*CATEGORIES))
    id_type = dict(cells.dtypes)["entity_id"]
    n = cells.select("entity_id").distinct().count()
    groups = max(1, -(-n // group), min(-(-n // block), groups))
    count = groups * max(1, -(-n // (block * groups)))
    own = F.pmod(F.xxhash64("entity_id"), F.lit(count)).cast("int")
    rows = cells.groupBy(own.alias("own")).agg(F.collect_list(F.struct(*cells.columns)).alias("cells"))
    rows = rows.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("to"), "own", "cells").withColumn("far", F.col("own") % groups != F.col("to"))
    # A group's own blocks come first: together they are its rows.
    rows = rows.repartition(4 * groups, "to").sortWithinPartitions("to", "far", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks_of() -> Iterator[tuple[int, bool, pa.StructArray]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.column("to")[i].as_py(), batch.column("far")[i].as_py(), batch.column("cells").slice(i, 1).flatten()

        def out(found: dict[str, _Nearest]) -> Iterator[pa.RecordBatch]:
            for method, one in found.items():
                ids = [pa.array(v, schema.field("a").type) for v in (one.own.ids[one.row], one.b)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(method), len(one.row)), *ids, pa.array(one.sim)], schema=schema)

        now, mine, found, schema = None, [], {}, None
        for to, far, of in blocks_of():
            kind = of.type.field("entity_id").type
            schema = pa.schema([("method", pa.string()), ("a", kind), ("b", kind), ("sim", pa.float64())])
            if to != now:
                yield from out(begun(found, mine, k, digits))
                now, mine, found = to, [], {}
            if far:
                found, mine = begun(found, mine, k, digits), []
                for method, vectors in _Vectors.by_method(of).items():
                    if method in found:
                        found[method].add(vectors)
            else:
                mine.append(of)
        yield from out(begun(found, mine, k, digits))

    def begun(found: dict[str, _Nearest], mine: list[pa.StructArray], k: int, digits: int | None) -> dict[str, _Nearest]:
        """A group as soon as all its own blocks are there, which are met at once."""
        if mine:
            found = {m: _Nearest(v, k, digits) for m, v in _Vectors.by_method(pa.concat_arrays(mine)).items()}
            for of in mine:
                for method, vectors in _Vectors.by_method(of).items():
                    found[method].add(vectors)
        return found

    return rows.select("to", "far", "cells").mapInArrow(run, f"method string, a {id_type}, b {id_type}, sim double")
