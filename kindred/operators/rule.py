"""Rule-based similarity: parameter by parameter, averaged by category, weighted over categories.

A parameter that only one of two entities knows scores 0 and counts; one that both know without a value is skipped; one
with a value on one side only scores 0.  So a category's mean is (sum of scores of shared parameters) / (shared with a score + known
to one side only), and for that no parameter needs a row unless the other entity has it: what the other entity lacks is counted from
totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import plain_number, squeeze
from ..model import CATEGORIES, DEFAULT_WEIGHTS, SHORT, category
from .blocks import RULE, Pairs, rule_cells

KEY = ["component", "param"]


def numeric_stats(features: DataFrame) -> DataFrame:
    """Least and greatest number of each parameter: ``(component, param, vmin, vmax)``."""
    numbers = features.filter(F.col("value_num").isNotNull())
    return numbers.groupBy(*KEY).agg(F.min("value_num").alias("vmin"), F.max("value_num").alias("vmax"))


def numeric_similarity(a: Column, b: Column, low: Column, high: Column) -> Column:
    """1 less the distance as a share of the parameter's range, at least 0; where there is no range, 1 if equal and else 0."""
    width = high - low
    spread = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(a - b) / F.nullif(width, F.lit(0.0))))
    return F.when(F.coalesce(width, F.lit(0.0)) == 0, (a == b).cast("double")).otherwise(spread)


def text_similarity(a: Column, b: Column) -> Column:
    """1 if the texts are equal but for white space at their ends, else 0; case matters."""
    return (squeeze(a) == squeeze(b)).cast("double")


def value_similarity(num_a: Column, str_a: Column, num_b: Column, str_b: Column, low: Column, high: Column) -> Column:
    """Similarity of two values of a parameter that both entities know; null if neither has a value.

    A number and a text are compared as text; a number's text is whatever reads back as that number."""
    none_a, none_b = num_a.isNull() & str_a.isNull(), num_b.isNull() & str_b.isNull()
    return (
        F.when(none_a & none_b, F.lit(None).cast("double"))
        .when(none_a | none_b, F.lit(0.0))
        .when(num_a.isNotNull() & num_b.isNotNull(), numeric_similarity(num_a, num_b, low, high))
        .when(num_a.isNull() & num_b.isNull(), text_similarity(str_a, str_b))
        .otherwise(F.coalesce((F.coalesce(num_a, plain_number(str_a)) == F.coalesce(num_b, plain_number(str_b))).cast("double"), F.lit(0.0)))
    )


def weighted_total(sims: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of category similarities by weight; weights of 0 or less are left out, and with none left the total is 0."""
    used = {c: w for c, w in weights.items() if w > 0}
    if not used:
        return F.lit(0.0)
    return sum((F.coalesce(sims.get(c, F.lit(0.0)), F.lit(0.0)) * float(w) for c, w in used.items()), F.lit(0.0)) / float(sum(used.values()))


def _finish(parts: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """Category similarities and total from ``(keys, category, score, counted)`` sums."""
    by = parts.groupBy(*keys).agg(
        *(F.sum(F.when(F.col("category") == c, F.col("score"))).alias(f"s{i}") for i, c in enumerate(CATEGORIES)),
        *(F.sum(F.when(F.col("category") == c, F.col("counted"))).alias(f"n{i}") for i, c in enumerate(CATEGORIES)),
    )
    sims = {c: F.coalesce(F.col(f"s{i}") / F.nullif(F.col(f"n{i}"), F.lit(0)), F.lit(0.0)) for i, c in enumerate(CATEGORIES)}
    return by.select(*keys, *(sims[c].alias(f"sim_{SHORT[c]}") for c in CATEGORIES), weighted_total(sims, weights).alias("sim_total"))


def rule_scores(features: DataFrame, query_id: str, stats: DataFrame | None = None, weights: dict[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """``(entity_id, sim_geom, sim_mtrl, sim_req, sim_total)`` of every other entity with the query entity.

    A shared parameter counts in the category that the query entity gives it, others in their own."""
    stats = numeric_stats(features) if stats is None else stats
    query = features.filter(F.col("entity_id") == query_id).join(stats, KEY, "left")
    query = query.select(
        *KEY, F.col("value_num").alias("q_num"), F.col("value_str").alias("q_str"), category(F.col("ptype")).alias("q_category"), "vmin", "vmax", F.lit(True).alias("asked")
    )
    # One entity's parameters: the planner sends that side to all tasks if it is as small as it should be.
    rows = features.filter(F.col("entity_id") != query_id).join(query, KEY, "left")
    sim = value_similarity(F.col("q_num"), F.col("q_str"), F.col("value_num"), F.col("value_str"), F.col("vmin"), F.col("vmax"))
    rows = rows.select("entity_id", F.coalesce("q_category", category(F.col("ptype"))).alias("category"), F.when(F.col("asked"), sim).otherwise(F.lit(0.0)).alias("sim"), F.col("asked").isNotNull().alias("shared"))
    own = rows.groupBy("entity_id", "category").agg(
        F.coalesce(F.sum("sim"), F.lit(0.0)).alias("score"), F.count("sim").alias("counted"), F.count_if("shared").alias("shared")
    )
    # Parameters of the query that an entity lacks: the query's number in the category less those shared.
    wanted = query.groupBy(F.col("q_category").alias("category")).agg(F.count("*").alias("wanted"))
    own = own.join(wanted, "category", "left").select("entity_id", "category", "score", (F.col("counted") - F.col("shared")).alias("counted"))
    entities = features.select("entity_id").filter(F.col("entity_id") != query_id).distinct()
    lacking = entities.crossJoin(F.broadcast(wanted)).select("entity_id", "category", F.lit(0.0).alias("score"), F.col("wanted").alias("counted"))
    return _finish(own.unionAll(lacking), ["entity_id"], weights)


def top_k(scores: DataFrame, k: int, id_col: str = "entity_id", score: str = "sim_total") -> DataFrame:
    """The k rows with the highest score, ties by id."""
    return scores.orderBy(F.desc(score), id_col).limit(k)


def rule_top_k(features: DataFrame, query_id: str, k: int = 5, weights: dict[str, float] = DEFAULT_WEIGHTS, stats: DataFrame | None = None) -> DataFrame:
    return top_k(rule_scores(features, query_id, stats, weights), k)


def rule_pairs(features: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS, stats: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """``(a, b, sim_geom, sim_mtrl, sim_req, sim_total)`` for every pair a < b: an all-pairs operator by nature.

    Pairs meet on the parameters they share, by equality; what only one side knows is counted from each side's totals."""
    one_type(features)
    return Pairs(rule_cells(features, numeric_stats(features) if stats is None else stats), (RULE,), weights, digits).wide()


def one_type(features: DataFrame) -> None:
    """Pairs require that a parameter has one type throughout, so that order does not matter."""
    kinds = features.groupBy(*KEY).agg(F.count_distinct(category(F.col("ptype"))).alias("n"))
    if kinds.filter("n > 1").limit(1).count():
        raise ValueError("a parameter has types of more than one category")
