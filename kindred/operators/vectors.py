"""Vector similarity: every entity as one vector a category, compared by cosine.

A numeric parameter takes two dimensions (scaled value, missing); a text parameter takes one for each of its values and one for
"missing".  Vectors are kept in long form, ``(entity_id, category, dim, val)`` without zeros, so that dot
products are joins on the dimension; ``dense`` turns them into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import scale, squeeze
from ..model import CATEGORIES, DEFAULT_WEIGHTS, SHORT, category
from .blocks import VECTOR, Pairs, nearest, vector_cells
from .rule import KEY, numeric_stats, top_k, weighted_total
from .tiles import paired

MISSING = "<MISSING>"


def feature_dims(features: DataFrame) -> DataFrame:
    """``(category, component, param, slot, idx)``: the dimensions, learned from the values that occur.

    Slots of a number are "num" and "num_missing", of texts "=value" and "=<MISSING>".  ``idx`` counts from 0 within a category:
    numeric parameters first, then texts, ordered by component, parameter and slot."""
    cells = features.select(category(F.col("ptype")).alias("category"), *KEY, "value_num", squeeze(F.col("value_str")).alias("s")).filter("value_num IS NOT NULL OR s IS NOT NULL")
    number = F.col("value_num").isNotNull()
    slots = F.when(number, F.array(F.lit("num"), F.lit("num_missing"))).otherwise(F.array(F.concat(F.lit("="), F.nullif("s", F.lit(""))), F.lit(f"={MISSING}")))
    dims = cells.select("category", *KEY, F.explode(slots).alias("slot")).filter("slot IS NOT NULL").distinct()
    # The dictionary is small next to the facts: distinct values, not rows.
    order = Window.partitionBy("category").orderBy(F.col("slot").startswith("="), *KEY, F.col("slot") == f"={MISSING}", "slot")
    return dims.withColumn("idx", F.row_number().over(order) - 1)


def feature_vectors(features: DataFrame, dims: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``(entity_id, category, idx, val)`` without zeros."""
    dims = feature_dims(features) if dims is None else dims
    stats = numeric_stats(features) if stats is None else stats
    entities = features.select("entity_id").distinct()
    params = dims.select("category", *KEY, F.col("slot").startswith("=").alias("texts")).distinct()
    # Every entity answers for every parameter, by its value's slot or the one for "missing": the size of the result, not of a detour.
    wanted = entities.crossJoin(F.broadcast(params))
    cells = features.select("entity_id", *KEY, "value_num", squeeze(F.col("value_str")).alias("s"), F.lit(True).alias("known"))
    # Sizes are estimated without the rows that melting makes, so the planner would send all cells through the driver: merged instead.
    rows = wanted.join(cells.hint("merge"), ["entity_id", *KEY], "left").join(stats, KEY, "left")
    text = F.coalesce(F.when(F.col("value_num").isNotNull(), F.col("value_num").cast("string")).otherwise(F.col("s")), F.lit(MISSING))
    slot = F.when(F.col("texts"), F.concat(F.lit("="), text)).otherwise(F.when(F.col("value_num").isNull(), "num_missing").otherwise("num"))
    value = F.when(slot == "num", scale(F.col("value_num"), F.col("vmin"), F.col("vmax"))).otherwise(F.lit(1.0))
    rows = rows.select("entity_id", "category", *KEY, slot.alias("slot"), value.alias("val"))
    found = rows.join(dims, ["category", *KEY, "slot"], "left")
    rest = dims.filter(F.col("slot") == f"={MISSING}").select("category", *KEY, F.col("idx").alias("missing_idx"))
    found = found.join(rest, ["category", *KEY], "left").withColumn("idx", F.coalesce("idx", "missing_idx"))
    return found.filter("val <> 0").select("entity_id", "category", "idx", "val")


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("entity_id", "category").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))


def cosine(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from a dot product; 0 where a vector is zero."""
    return F.coalesce(dot / F.nullif(norm_a * norm_b, F.lit(0.0)), F.lit(0.0))


def unit(cos: Column) -> Column:
    """A cosine as a similarity between 0 and 1."""
    return (cos + 1) / 2


def _wide(sims: DataFrame, keys: list[str], weights: dict[str, float], zero_unused: bool = False) -> DataFrame:
    """Rows ``(keys, category, sim)`` as one row with all categories; a category without vectors has cosine 0, similarity 0.5.
    ``zero_unused`` shows 0 for categories without weight."""
    by = sims.groupBy(*keys).agg(*(F.max(F.when(F.col("category") == c, F.col("sim"))).alias(SHORT[c]) for c in CATEGORIES))
    full = {c: F.coalesce(F.col(SHORT[c]), F.lit(0.5)) for c in CATEGORIES}
    if zero_unused:
        full = {c: s if weights.get(c, 0.0) > 0 else F.lit(0.0) for c, s in full.items()}
    return by.select(*keys, *(full[c].alias(f"sim_{SHORT[c]}") for c in CATEGORIES), weighted_total(full, weights).alias("sim_total"))


def vector_scores(vectors: DataFrame, query_id: str, weights: dict[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """``(entity_id, sim_geom, sim_mtrl, sim_req, sim_total)`` of every other entity with the query entity."""
    query = vectors.filter(F.col("entity_id") == query_id).select("category", "idx", F.col("val").alias("q"))
    own = query.groupBy("category").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    rows = vectors.filter(F.col("entity_id") != query_id).join(query, ["category", "idx"], "left")
    rows = rows.groupBy("entity_id", "category").agg(F.sum(F.col("val") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    rows = rows.join(own, "category", "left")
    sims = rows.select("entity_id", "category", unit(cosine(F.col("dot"), F.col("norm"), F.col("q_norm"))).alias("sim"))
    return _wide(sims, ["entity_id"], weights)


def vector_top_k(features: DataFrame, query_id: str, k: int = 5, weights: dict[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    return top_k(vector_scores(feature_vectors(features), query_id, weights), k)


def vector_pairs(vectors: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS, digits: int | None = None) -> DataFrame:
    """``(a, b, sim_geom, sim_mtrl, sim_req, sim_total)`` for every pair a < b."""
    return Pairs(vector_cells(vectors), (VECTOR,), weights, digits).wide()


# --- dense vectors ---------------------------------------------------------------------------------------------


def dense(vectors: DataFrame, dims: DataFrame) -> DataFrame:
    """``(entity_id, category, vec)`` with arrays of all dimensions of the category."""
    width = dims.groupBy("category").agg((F.max("idx") + 1).alias("width"))
    held = vectors.groupBy("entity_id", "category").agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("cells"))
    every = vectors.select("entity_id").distinct().crossJoin(F.broadcast(width)).join(held.hint("merge"), ["entity_id", "category"], "left")
    cells = F.coalesce("cells", F.create_map().cast("map<int,double>"))
    vec = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit(0.0)))
    return every.select("entity_id", "category", vec.alias("vec"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def normalized(x: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    n = norm(x)
    return F.when(n == 0, x).otherwise(F.transform(x, lambda v: v / n))


def array_cosine(x: Column, y: Column) -> Column:
    return cosine(dot(x, y), norm(x), norm(y))


def dense_scores(vecs: DataFrame, query_id, weights: dict[str, float], zero_unused: bool = False) -> DataFrame:
    """Scores of every other entity with the query entity over ``(entity_id, category, vec)``."""
    query = vecs.filter(F.col("entity_id") == query_id).select("category", F.col("vec").alias("q"))
    rows = vecs.filter(F.col("entity_id") != query_id).join(query, "category", "left")
    sims = rows.select("entity_id", "category", F.when(F.col("q").isNull(), 0.0 if zero_unused else 0.5).otherwise(unit(array_cosine(F.col("vec"), F.col("q")))).alias("sim"))
    return _wide(sims, ["entity_id"], weights, zero_unused)


def dense_pairs(vecs: DataFrame) -> DataFrame:
    """``(a, b, category, sim)`` for every pair a < b of entities that share a category."""
    v = vecs.withColumn("n", norm(F.col("vec")))
    a = v.select("category", F.col("entity_id").alias("a"), F.col("vec").alias("x"), F.col("n").alias("nx"))
    b = v.select("category", F.col("entity_id").alias("b"), F.col("vec").alias("y"), F.col("n").alias("ny"))
    return paired(a, b, ["category"]).select("a", "b", "category", unit(cosine(dot(F.col("x"), F.col("y")), F.col("nx"), F.col("ny"))).alias("sim"))


def top_k_per_entity(pairs: DataFrame, k: int, score: str = "sim") -> DataFrame:
    """``(a, rank, b, score)``: the k most similar others of each entity, from pairs a < b; ties by id."""
    both = pairs.select("a", "b", score).unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), score))
    order = Window.partitionBy("a").orderBy(F.desc(score), "b")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("a", "rank", "b", score)


def dense_top_k(vecs: DataFrame, k: int, digits: int) -> DataFrame:
    """``top_k_per_entity`` of ``dense_pairs`` with similarities rounded to ``digits``: each group of entities meets all others block by block, and only the k best
    of each entity and category are ordered."""
    found = nearest(vecs, k, digits)
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("a", "rank", "b", "sim")
