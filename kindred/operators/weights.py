"""Weights from dependencies: edges to components, components to categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import edge_parts, edge_percentage, edge_strength
from ..model import CATEGORIES, category

# Factor of each strength, and the components that share the weight where there are no edges.
STRENGTH_FACTOR = {"hoch": 1.5, "mittel": 1.0, "niedrig": 0.5}
DEFAULT_COMPONENTS = ("Welle", "Aktivteil", "Blechpaket", "Luefter", "Welleende", "Wuchtscheiben")


def parse_edges(names: DataFrame, name: str = "name", strength: str = "strength", percentage: str = "percentage", order: str | None = None) -> DataFrame:
    """``(source, target, strength, percentage)`` from edge names; of several edges between two ends the last by ``order``
    (by default by the other columns) counts.  Names that are no edge are left out."""
    rows = names.select(edge_parts(F.col(name)).alias("e"), edge_strength(F.col(strength)).alias("strength"), edge_percentage(F.col(percentage)).alias("percentage"), F.col(order or name).alias("o"))
    rows = rows.filter("e IS NOT NULL").select("e.source", "e.target", "strength", "percentage", "o")
    last = F.max_by(F.struct("strength", "percentage"), F.struct("o", "strength", "percentage")).alias("x")
    return rows.groupBy("source", "target").agg(last).select("source", "target", "x.strength", "x.percentage")


def component_weights(edges: DataFrame, normalization: str = "sum") -> DataFrame:
    """``(component, weight)``: an edge gives its percentage times its strength's factor to its target and half of that to its source.

    ``normalization``: "sum" (weights add up to 1), "max" (the greatest is 1), anything else none; where the divisor is 0
    weights stay as they are.  Without edges the default components share 1."""
    factor = F.lit(1.0)
    for word, f in STRENGTH_FACTOR.items():
        factor = F.when(F.lower(F.coalesce("strength", F.lit("mittel"))) == word, F.lit(f)).otherwise(factor)
    weighted = edges.select("source", "target", (F.col("percentage") * factor).alias("w"))
    parts = weighted.select(F.col("target").alias("component"), "w").unionAll(weighted.select(F.col("source").alias("component"), F.col("w") * 0.5))
    sums = parts.groupBy("component").agg(F.sum("w").alias("weight"))
    if normalization in ("sum", "max"):
        divisor = sums.agg((F.sum if normalization == "sum" else F.max)("weight").alias("d"))
        sums = sums.crossJoin(F.broadcast(divisor)).select("component", F.when(F.col("d") > 0, F.col("weight") / F.nullif("d", F.lit(0.0))).otherwise(F.col("weight")).alias("weight"))
    if edges.limit(1).count():
        return sums
    share = 1.0 / len(DEFAULT_COMPONENTS)
    return edges.sparkSession.createDataFrame([(c, share) for c in DEFAULT_COMPONENTS], "component string, weight double")


def _plain(name):
    return F.replace(F.lower(name), F.lit("_"), F.lit(""))


def category_weights(weights: DataFrame, features: DataFrame, sample: str | None = None) -> DataFrame:
    """``(category, weight)``: each component's weight dealt to the categories by their share of its parameters, adding up to 1.

    The shares are those of one entity, ``sample`` or the first by id.  A weight's name matches the first of that entity's components, in the order of their
    names, whose name holds it or is held by it (lower case, without underscores); the weight of a name without match is dealt evenly."""
    sample = sample or features.agg(F.min("entity_id")).first()[0]
    own = features.filter(F.col("entity_id") == sample).select("component", category(F.col("ptype")).alias("category"))
    shares = own.groupBy("component", "category").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("component")))
    names = own.select(F.col("component").alias("has")).distinct()
    hit = _plain(F.col("has")).contains(_plain(F.col("component"))) | _plain(F.col("component")).contains(_plain(F.col("has")))
    # Both sides are lists of component names: some dozens.
    matched = weights.join(F.broadcast(names), hit, "left").groupBy("component").agg(F.first("weight").alias("weight"), F.min("has").alias("has"))
    found = matched.filter("has IS NOT NULL").select("has", "weight").join(shares.withColumnRenamed("component", "has"), "has").select("category", (F.col("weight") * F.col("share")).alias("w"))
    even = matched.filter("has IS NULL").select(F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"), (F.col("weight") / len(CATEGORIES)).alias("w"))
    sums = found.unionAll(even).groupBy("category").agg(F.sum("w").alias("w"))
    total = sums.agg(F.sum("w").alias("t"))
    out = sums.crossJoin(F.broadcast(total))
    return out.select("category", F.when(F.col("t") > 0, F.col("w") / F.nullif("t", F.lit(0.0))).otherwise(F.lit(1 / len(CATEGORIES))).alias("weight"))


def automatic_weights(edges: DataFrame, features: DataFrame) -> dict[str, float]:
    """Category weights for the similarity operators.  Without edges this is an error: weights of nothing would make all
    similarities 0."""
    if not edges.limit(1).count():
        raise ValueError("there are no dependency edges to take weights from")
    got = {r["category"]: r["weight"] for r in category_weights(component_weights(edges), features).collect()}
    return {c: got.get(c, 0.0) for c in CATEGORIES}
