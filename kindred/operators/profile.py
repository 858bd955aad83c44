"""Profile of every parameter of a long table ``(entity_id, parameter, value_num, value_str)``: type vote, coverage, moments, quantiles,
entropy, and a score of how well it tells entities apart.  One aggregation a table; null values do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import area, coverage_step, plain_number, round_exact, shorten_path

VALUES = "entity_id string, parameter string, value_num double, value_str string"
NUMERIC, CATEGORICAL = "numerisch", "kategorisch"


def _read(values: DataFrame) -> DataFrame:
    """Each value as a number, if it reads as one, and as text."""
    number = F.coalesce(F.col("value_num"), plain_number(F.col("value_str")))
    text = F.coalesce(F.col("value_str"), F.col("value_num").cast("string"))
    return values.select("*", number.alias("num"), text.alias("txt")).filter("txt IS NOT NULL")


def type_vote(values: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(parameter, n, n_castable, datatype)``: numeric if more than ``threshold`` of the values read as numbers."""
    rows = _read(values).groupBy("parameter").agg(F.count("*").alias("n"), F.count("num").alias("n_castable"))
    return rows.withColumn("datatype", F.when(F.col("n_castable") / F.col("n") > threshold, NUMERIC).otherwise(CATEGORICAL))


def _rounded(c: Column, digits: int, exact: bool) -> Column:
    return round_exact(c, digits) if exact else F.round(c, digits)


def profile_numeric(values: DataFrame, n_entities: int, exact: bool = True) -> DataFrame:
    """Moments and quantiles of the numeric parameters.

    ``coverage`` has 1 decimal, ``cv`` (percent of the mean) 1, the rest 2.  Deviation is the sample's (0 for one value), skewness the adjusted
    Fisher-Pearson coefficient (0 for fewer than three values or none spread), quantiles interpolate linearly.  ``exact``
    rounds as Python does, else as SQL does."""
    rows = _read(values)
    votes = type_vote(values).filter(F.col("datatype") == NUMERIC).select("parameter", F.col("n").alias("n_values"))
    v = F.col("num")
    agg = rows.join(votes, "parameter").groupBy("parameter").agg(
        F.first("n_values").alias("n"),
        F.count(v).alias("k"),
        F.min(v).alias("vmin"),
        F.max(v).alias("vmax"),
        F.avg(v).alias("m"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"),
        F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.skewness(v).alias("g"),
        F.count_distinct(v).alias("n_unique"),
    )
    k = F.col("k").cast("double")
    skew = F.when((k > 2) & (F.col("sd") > 0), F.col("g") * F.sqrt(k * (k - 1)) / F.nullif(k - 2, F.lit(0.0))).otherwise(F.lit(0.0))
    cv = F.coalesce(F.col("sd") / F.nullif(F.abs("m"), F.lit(0.0)) * 100, F.lit(0.0))
    r = lambda c, d: _rounded(c, d, exact)
    return agg.select(
        "parameter",
        area(F.col("parameter")).alias("area"),
        F.lit(NUMERIC).alias("datatype"),
        "n",
        r(F.col("n") * 100 / F.lit(float(n_entities)), 1).alias("coverage"),
        r(F.col("vmin"), 2).alias("min"),
        r(F.col("vmax"), 2).alias("max"),
        r(F.col("m"), 2).alias("mean"),
        r(F.col("q")[1], 2).alias("median"),
        r(F.col("sd"), 2).alias("std"),
        r(cv, 1).alias("cv"),
        r(F.col("q")[2] - F.col("q")[0], 2).alias("iqr"),
        r(skew, 2).alias("skew"),
        "n_unique",
    )


def profile_categorical(values: DataFrame, n_entities: int, exact: bool = True) -> DataFrame:
    """Distinct values, most frequent value (its first 40 characters and count; the first seen of equals where rows have an ``ordinal``, else the
    least) and Shannon entropy in bits of the parameters that are not numeric."""
    rows = _read(values)
    votes = type_vote(values).filter(F.col("datatype") == CATEGORICAL).select("parameter")
    first = F.min("ordinal") if "ordinal" in values.columns else F.lit(0)
    counts = rows.join(votes, "parameter").groupBy("parameter", "txt").agg(F.count("*").alias("c"), first.alias("o"))
    totals = counts.groupBy("parameter").agg(F.sum("c").alias("n"), F.count("*").alias("n_unique"), F.max_by(F.struct("txt", "c"), F.struct("c", -F.col("o"))).alias("seen"), F.max("c").alias("most"))
    least = counts.join(totals.select("parameter", "most"), "parameter").filter(F.col("c") == F.col("most")).groupBy("parameter").agg(F.min_by("txt", F.struct("o", "txt")).alias("mode"))
    p = F.col("c") / F.col("n")
    entropy = counts.join(totals.select("parameter", "n"), "parameter").groupBy("parameter").agg(F.sum(-p * F.log2(p)).alias("entropy"))
    r = lambda c, d: _rounded(c, d, exact)
    rows = totals.join(least, "parameter").join(entropy, "parameter")
    return rows.select(
        "parameter",
        area(F.col("parameter")).alias("area"),
        F.lit(CATEGORICAL).alias("datatype"),
        "n",
        r(F.col("n") * 100 / F.lit(float(n_entities)), 1).alias("coverage"),
        "n_unique",
        F.substring("mode", 1, 40).alias("mode"),
        F.col("most").alias("mode_count"),
        r(F.abs("entropy"), 2).alias("entropy"),
        r(F.log2(F.col("n_unique").cast("double")), 2).alias("entropy_max"),
    )


def profile(values: DataFrame, n_entities: int, exact: bool = True) -> DataFrame:
    """One row a parameter; columns of the other type are null."""
    return profile_numeric(values, n_entities, exact).unionByName(profile_categorical(values, n_entities, exact), allowMissingColumns=True)


def suitability(profiled: DataFrame, n_entities: int, exact: bool = True) -> DataFrame:
    """``profiled`` with ``score`` (0 to 100): half for the number of distinct values on a log scale, 0.35 for variability (coefficient of variation, or
    entropy as a share of its maximum), 0.15 for symmetry.  The score is made of the rounded figures."""
    most = max(n_entities, 2)
    unique = F.when(F.col("n_unique") > 1, F.least(F.log2(F.col("n_unique").cast("double")) / F.log2(F.lit(float(most))) * 100, F.lit(100.0))).otherwise(F.lit(0.0))
    numeric = F.col("datatype") == NUMERIC
    spread = F.when(numeric, F.least(F.col("cv"), F.lit(100.0))).otherwise(F.coalesce(F.col("entropy") / F.nullif("entropy_max", F.lit(0.0)) * 100, F.lit(0.0)))
    even = F.when(numeric, F.greatest(F.lit(0.0), 100 - F.abs("skew") * 33.33)).otherwise(F.lit(50.0))
    return profiled.withColumn("score", _rounded(unique * 0.5 + spread * 0.35 + even * 0.15, 1, exact))


# --- aggregates behind the charts and the report ---------------------------------------------------------------


def area_summary(scored: DataFrame) -> DataFrame:
    """Parameters, mean coverage, mean score and type counts of each area."""
    return scored.groupBy("area").agg(
        F.count("*").alias("n_params"),
        F.round(F.avg("coverage"), 1).alias("avg_coverage"),
        F.round(F.avg("score"), 1).alias("avg_score"),
        F.count_if(F.col("datatype") == NUMERIC).alias("n_numeric"),
        F.count_if(F.col("datatype") == CATEGORICAL).alias("n_categorical"),
    )


def coverage_histogram(scored: DataFrame) -> DataFrame:
    """``(bin, n)``: parameters by coverage in tens; the last bin holds 90 to 100."""
    place = F.least(F.floor(F.col("coverage") / 10).cast("int"), F.lit(9))
    return scored.filter("coverage >= 0 AND coverage <= 100.1").groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def datatype_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("datatype").agg(F.count("*").alias("n"))


def coverage_steps(scored: DataFrame) -> DataFrame:
    return scored.groupBy(coverage_step(F.col("coverage")).alias("step")).agg(F.count("*").alias("n"))


def report(scored: DataFrame) -> dict[str, DataFrame]:
    """The tables of the profile report: areas, best 30, worst 15, most varied 20, and all categorical parameters."""
    top = scored.select(shorten_path(F.col("parameter")).alias("shown"), "*")
    best = top.orderBy(F.desc("score"), "parameter")
    return {
        "areas": area_summary(scored).orderBy(F.desc("avg_score"), "area"),
        "best": best.limit(30),
        "worst": top.orderBy("score", F.desc("parameter")).limit(15),
        "varied": scored.filter(F.col("datatype") == NUMERIC).select(shorten_path(F.col("parameter"), 55).alias("shown"), "*").orderBy(F.desc("cv"), "parameter").limit(20),
        "categorical": scored.filter(F.col("datatype") == CATEGORICAL).select(shorten_path(F.col("parameter"), 50).alias("shown"), "*").orderBy(F.desc("score"), "parameter"),
    }


def low_variance(features: DataFrame, ratio: float = 0.05, values: int = 2) -> DataFrame:
    """Numeric parameters that hardly vary: deviation below ``ratio`` of the mean, or at most ``values`` distinct values."""
    rows = features.filter("value_num IS NOT NULL").groupBy("component", "param").agg(
        F.coalesce(F.stddev_samp("value_num") / F.nullif(F.abs(F.avg("value_num")), F.lit(0.0)), F.lit(0.0)).alias("ratio"), F.count_distinct("value_num").alias("n_unique")
    )
    return rows.filter((F.col("ratio") < ratio) | (F.col("n_unique") <= values))


def catalogue(features: DataFrame, order: str = "entity_id") -> DataFrame:
    """``(label, n, params)``: parameter names by category, each in that of its first row by ``order``."""
    from ..model import CATEGORY_LABEL, category, lookup

    first = features.groupBy("param").agg(F.min_by(F.coalesce("ptype", F.lit("UNKNOWN")), F.struct(order, "component")).alias("ptype"))
    label = lookup(category(F.col("ptype")), CATEGORY_LABEL, "")
    return first.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("param")).alias("params"))


# --- cleaning --------------------------------------------------------------------------------------------------

# Prefixes of the workflow whose copies are dropped, and of the one that is kept.
COPY_PREFIX, KEPT_PREFIX = "SimocalcWorkflow.", "EdimWorkflow."
# Parameters that only identify a machine or its parts.
IDENTIFIERS = """
machine_id MachineConfig.mlfb MachineConfig.shaft MachineConfig.bearing MachineConfig.enclosure MachineConfig.endShieldDE
MachineConfig.endShieldNDE MachineConfig.bearingInsertDE MachineConfig.bearingInsertNDE MachineConfig.pressurePlateDE
MachineConfig.pressurePlateNDE MachineConfig.frame MachineConfig.cDimension MachineConfig.shaftEnd MachineConfig.balancingDiscDE
MachineConfig.balancingDiscNDE MachineConfig.baffleHolderDE MachineConfig.baffleHolderNDE MachineConfig.cBaffleDE
MachineConfig.cBaffleNDE MachineConfig.cylinderBaffleDE MachineConfig.cylinderBaffleNDE MachineConfig.sBaffleDE
MachineConfig.sBaffleNDE MachineConfig.axialFanInnerDE MachineConfig.axialFanInnerNDE MachineConfig.axialFanOuter
MachineConfig.radialInnerFans MachineConfig.radialOuterFans MachineConfig.airInletHousing MachineConfig.airInletSilencer
MachineConfig.terminalBox MachineConfig.catalogueDimensionDrawing MachineConfig.position MachineConfig.ndeLength
""".split()
KNOWN, NEW, OTHER = "Bekannt (44)", "Neu (fachlich relevant)", "Nicht zugeordnet"
LABELS = "parameter string, p_name string, component string, unit string, heading string, reason string, duplicate_of string"


def drop_copies(profiled: DataFrame) -> DataFrame:
    """Without parameters of the copying workflow whose path the other workflow has as well."""
    kept = profiled.filter(F.col("parameter").startswith(KEPT_PREFIX)).select(F.concat(F.lit(COPY_PREFIX), F.substr("parameter", F.lit(len(KEPT_PREFIX) + 1))).alias("parameter"))
    return profiled.join(kept, "parameter", "left_anti")


def drop_constants(profiled: DataFrame) -> DataFrame:
    return profiled.filter(F.coalesce(F.col("n_unique") != 1, F.lit(True)))


def drop_identifiers(profiled: DataFrame, identifiers: list[str] = IDENTIFIERS) -> DataFrame:
    return profiled.filter(~F.col("parameter").isin(*identifiers))


def clean(scored: DataFrame, known: DataFrame, new: DataFrame) -> DataFrame:
    """The parameter list without copies, constants and identifiers, with names and relevance from two label tables.

    ``known`` goes before ``new``; a known label that names another parameter as its original drops the row.  Labels are
    parameters of the operator: tables of ``LABELS``, a parameter once.  The order is relevance, score, parameter."""
    rows = drop_identifiers(drop_constants(drop_copies(scored)))
    tag = lambda df, rank: df.select("parameter", F.struct(F.lit(rank).alias("rank"), "p_name", "component", "unit", "heading", "reason", "duplicate_of").alias(f"label{rank}"))
    rows = rows.join(tag(known, 0), "parameter", "left").join(tag(new, 1), "parameter", "left")
    label = F.coalesce("label0", "label1")
    rows = rows.withColumn("label", label).drop("label0", "label1").filter(F.col("label.duplicate_of").isNull())
    dash = lambda c: F.coalesce(F.col(f"label.{c}"), F.lit("–")).alias(c)
    rank = F.coalesce(F.col("label.rank"), F.lit(2))
    names = F.when(rank == 0, KNOWN).when(rank == 1, NEW).otherwise(OTHER)
    reason = F.when(rank == 0, "Aus der kuratierten Parameterliste").otherwise(F.coalesce(F.col("label.reason"), F.lit("–")))
    out = rows.select(names.alias("relevance"), dash("p_name"), dash("component"), dash("unit"), dash("heading"), reason.alias("reason"), *(c for c in scored.columns), rank.alias("rank"))
    return out.orderBy("rank", F.desc("score"), "parameter").drop("rank")


def cleaning_counts(scored: DataFrame, known: DataFrame, new: DataFrame) -> DataFrame:
    """``(step, n)``: how many parameters each step leaves."""
    steps = {"all": scored}
    steps["without copies"] = drop_copies(scored)
    steps["without constants"] = drop_constants(steps["without copies"])
    steps["without identifiers"] = drop_identifiers(steps["without constants"])
    steps["clean"] = clean(scored, known, new)
    out = None
    for i, (name, df) in enumerate(steps.items()):
        row = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), F.lit(name).alias("step"), "n")
        out = row if out is None else out.unionAll(row)
    return out.orderBy("i").drop("i")
