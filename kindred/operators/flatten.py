"""Nested JSON to paths and values.

A document is walked once, by no rule but its own structure, into leaves: a path, a scalar, and the lists that the leaf stands in (each with
its length, what it holds, and the position and type of the element).  Everything else is DataFrame code over leaves: which are
skipped, to which output path each contributes and how the contributions to a path are summed up."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import plain_number

# Paths that hold one of these texts are skipped, with all below them.
SKIPPED = (
    "module_info",
    "OrderData",
    "additional_data",
    "tag",
    "machine_template",
    "username",
    "created",
    "last_updated",
    "status_code",
    "versions.",
    "calculation.identifier",
    "calculation.remarks",
    "calculation.user",
    "calculation.time",
    "info.pid",
    "info.tra_suffix",
    "info.mlfb",
    "info.tra",
)
# Numeric fields of a segment, keys of bearing properties that are no bearing names, fields of key safety.
SEGMENT_FIELDS = ("length", "outer_diameter", "inner_diameter", "mass", "coupling_mass", "polar_inertia", "axial_force", "diametral_inertia")
BEARING_PREFIX = "RotorWorkflow.input.bearing_properties."
BEARING_OWN_KEYS = {"axial_preload_forces", "temperature_rise", "grease_slinger", "grease", "type"}
KEY_SAFETY_FIELDS = ("transmittable_torque", "shaft_diameter", "position")


LEAF = (
    "doc long, entity string, ord long, path string, num double, text string, "
    "lists array<struct<path: string, at: long, size: long, holds: string, type: string>>, error string"
)
FLAT = "entity_id string, ordinal long, parameter string, value_num double, value_str string, error string"


def _holds(items: list) -> str:
    kinds = {"dicts" if isinstance(x, dict) else "numbers" if isinstance(x, (int, float)) else "others" for x in items}
    return kinds.pop() if len(kinds) == 1 else "others"


def leaves(document: dict) -> Iterator[tuple]:
    """``(path, number, text, lists)`` of every scalar, null and empty container of a document, in order."""
    open_ = [("", document, ())]
    while open_:
        path, node, lists = open_.pop()
        if isinstance(node, dict) and node:
            open_ += [(f"{path}.{k}" if path else k, v, lists) for k, v in reversed(node.items())]
        elif isinstance(node, list) and node:
            holds = _holds(node)
            for at in range(len(node) - 1, -1, -1):
                kind = str(node[at].get("type", "unknown")) if holds == "dicts" else None
                open_.append((f"{path}[{at}]", node[at], (*lists, (path, at, len(node), holds, kind))))
        elif isinstance(node, (int, float)):
            yield path, float(node), None, lists
        else:
            yield path, None, node if isinstance(node, str) else None, lists


def _document_rows(doc: int, name: str | None, text: str | None, strict: bool) -> list[tuple]:
    try:
        document = json.loads(text or "")
        if not isinstance(document, dict):
            raise ValueError("no JSON object")
        entity = document.get("machine_id", name) if strict else document.get("machine_id")
        if not entity:
            raise ValueError("no machine_id")
    except ValueError as problem:
        if strict:
            raise
        return [(doc, name, -1, None, None, None, [], str(problem))]
    return [(doc, str(entity), i, path, num, value, lists, None) for i, (path, num, value, lists) in enumerate(leaves(document))]


def _has(path: Column, *parts: str) -> Column:
    return F.greatest(*(path.contains(p) for p in parts)) if len(parts) > 1 else path.contains(parts[0])


def _rule(path: Column) -> Column:
    """What a list's path says about it; null for a list without a rule of its own."""
    return (
        F.when(path.endswith("rotor.segments"), "segments")
        .when(path.contains("relubrication.masses"), "dropped")
        .when(path.contains("shaft_safety.output"), "strengths")
        .when(path.contains("parallelkey_safety.output"), "keys")
        .when(_has(path, "roller_bearings.output.DE", "roller_bearings.output.NDE"), "first")
    )


def _contributions(leaf: DataFrame) -> DataFrame:
    """Leaves with ``slots``: each output path that a leaf contributes to, how contributions are summed up, and with what."""
    passed = lambda x: (x["holds"] == "dicts") & (x["size"] <= 3) & _rule(x["path"]).isNull()
    leaf = leaf.withColumn("decides", F.try_element_at(F.filter("lists", lambda x: ~passed(x)), F.lit(1)))
    at, path, size = F.col("decides.at"), F.col("decides.path"), F.col("decides.size")
    rule = F.when(F.col("decides").isNull(), "plain").otherwise(F.coalesce(_rule(path), F.when(F.col("decides.holds") == "numbers", "numbers").otherwise("dropped")))
    leaf = leaf.withColumn("rule", rule).filter(F.col("error").isNotNull() | (F.col("rule") != "dropped") & ~_has(F.coalesce(path, "path"), *SKIPPED))
    # Where the leaf stands below the element of the deciding list: "length", "shoulder.left.r", "function[0]".
    rest = F.regexp_replace(F.expr("substr(path, length(decides.path) + length(cast(decides.at AS string)) + 3)"), r"^\.", "")
    leaf = leaf.withColumn("rest", rest)
    rest, given = F.col("rest"), F.col("num").isNotNull() | F.col("text").isNotNull()
    text = F.coalesce(F.col("text"), F.col("num").cast("string"))

    def slot(to, how: str, num=None, value=None, family=None):
        none = F.lit(None)
        return F.struct(
            to.alias("to"),
            F.lit(how).alias("how"),
            (none if num is None else num).cast("double").alias("num"),
            (none if value is None else value).cast("string").alias("text"),
            (none if family is None else family).cast("string").alias("family"),
        )

    def slots(*options):
        return F.array_compact(F.array(*(F.when(condition, x) for condition, x in options)))

    always, whole = F.lit(True), lambda to: slot(to, "last", F.col("num"), F.col("text"))
    kind = F.concat(F.lit("segments."), F.col("decides.type"))
    number = F.coalesce(F.col("num"), F.expr("try_cast(text AS double)"))
    below = lambda *names: F.regexp_extract(rest, rf"^({'|'.join(names)})(?=\.|$)", 1)
    part = below("parallel_key", "stiffness", "shoulder")
    fitting = F.when(part == "shoulder", rest.rlike(r"^shoulder\.[^.\[]+\.[^.\[]+$")).otherwise(rest.rlike(r"^\w+\.[^.\[]+$"))
    segments = slots(
        (always, slot(F.lit("segments._total_count"), "last", size)),
        (always, slot(F.lit("segments._type_count"), "different", None, F.col("decides.type"))),
        (always, slot(F.concat(kind, F.lit("._count")), "elements")),
        (rest.isin(*SEGMENT_FIELDS) & number.isNotNull(), slot(F.concat_ws(".", kind, rest), "sum max min", number)),
        (rest.isin("description", "designation") & given & (F.coalesce("text", F.lit("x")) != "") & (F.coalesce("num", F.lit(1)) != 0), slot(F.concat_ws(".", kind, rest), "texts", None, text)),
        (part != "", slot(F.concat_ws(".", kind, rest), "of the first", F.when(fitting, F.col("num")), F.when(fitting, F.col("text")), F.concat_ws(".", kind, part))),
        (rest.rlike(r"^function\[\d+\]$") & given, slot(F.concat(kind, F.lit("._functions")), "set", None, text)),
    )
    strength = F.regexp_extract(rest, r"^safety\.(fatigue_strength|yield_strength)$", 1)
    strengths = slots(
        (always, slot(F.concat(path, F.lit("._count")), "last", size)),
        ((strength != "") & F.col("num").isNotNull(), slot(F.concat_ws(".", path, strength), "min max mean", F.col("num"))),
    )
    keys = slots(
        (always, slot(F.concat(path, F.lit("._count")), "last", size)),
        ((rest.isin(*KEY_SAFETY_FIELDS) | rest.rlike(r"^safety\.(?:key|shaft)\.[^.\[]+$")) & given, whole(F.concat_ws(".", path, rest))),
    )
    first = slots(((at == 0) & given & ~rest.contains("[") & ((rest != "") | F.col("num").isNotNull()), whole(F.when(rest == "", path).otherwise(F.concat_ws(".", path, rest)))))
    out = F.when(F.col("rule") == "plain", slots((given, whole(F.col("path"))))).when(F.col("rule") == "numbers", slots((always, slot(path, "one or min max mean count", F.col("num")))))
    out = out.when(F.col("rule") == "segments", segments).when(F.col("rule") == "strengths", strengths).when(F.col("rule") == "keys", keys).otherwise(first)
    return leaf.withColumn("slots", F.when(F.col("error").isNull(), out))


def _summed_up(parts: DataFrame) -> DataFrame:
    """One row for each output path: contributions summed up as ``how`` says, in rows ``(doc, entity, ord, parameter, num, text)``."""
    n, number = F.col("n"), F.col("numbers")
    sums = parts.groupBy("doc", "entity", "to", "how", "family").agg(
        F.min("ord").alias("ord"),
        F.count("*").alias("n"),
        F.min("at").alias("at"),
        F.size(F.collect_set("at")).alias("elements"),
        F.struct(F.sum("num").alias("sum"), F.min("num").alias("min"), F.max("num").alias("max"), F.avg("num").alias("mean"), F.count("num").cast("double").alias("count")).alias("numbers"),
        F.max_by(F.struct("num", "text"), "ord").alias("last"),
        F.min_by(F.struct("num", "text"), "ord").alias("first"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "text"))), 1, 3), lambda x: x["text"]).alias("texts"),
        F.array_sort(F.collect_set("text")).alias("set"),
    )
    # Of several elements with a part only the first counts, with what it has.
    sums = sums.withColumn("least", F.min("at").over(Window.partitionBy("doc", "family"))).filter((F.col("how") != "of the first") | (F.col("at") == F.col("least")))

    def row(suffix: str, num=None, text=None):
        return F.struct(F.lit(suffix).alias("suffix"), (F.lit(None) if num is None else num).cast("double").alias("num"), (F.lit(None) if text is None else text).cast("string").alias("text"))

    def spread(*names: str):
        return F.array(*(row(f"._{x}", number[x]) for x in names))

    how, single = F.col("how"), F.array(row("", number["max"]))
    rows = (
        F.when(how == "last", F.array(row("", F.col("last.num"), F.col("last.text"))))
        .when(how == "of the first", F.array(row("", F.col("first.num"), F.col("first.text"))))
        .when(how == "one or min max mean count", F.when(n == 1, single).otherwise(spread("min", "max", "mean", "count")))
        .when(how == "sum max min", F.when(n == 1, single).otherwise(spread("sum", "max", "min")))
        .when(how == "min max mean", spread("min", "max", "mean"))
        .when(how == "elements", F.array(row("", F.col("elements"))))
        .when(how == "different", F.array(row("", F.size("set"))))
        .when(how == "texts", F.array(row("", None, F.array_join("texts", "; "))))
        .otherwise(F.array(row("", None, F.array_join("set", "; "))))
    )
    out = sums.select("doc", "entity", "ord", "to", F.posexplode(rows).alias("turn", "x"))
    out = out.select("doc", "entity", "ord", "turn", F.concat("to", "x.suffix").alias("parameter"), "x.num", "x.text")
    return out.filter(F.col("num").isNotNull() | F.col("text").isNotNull())


def _number_bearings(rows: DataFrame) -> DataFrame:
    """Bearing names in paths replaced by ``bearing_1``, ``bearing_2``, ... in the order they occur in a document."""
    below = F.when(F.col("parameter").startswith(BEARING_PREFIX), F.expr(f"substr(parameter, {len(BEARING_PREFIX) + 1})"))
    name = F.regexp_extract(below, r"^([^.]*)", 1)
    rows = rows.withColumn("name", F.when(~name.isin(*sorted(BEARING_OWN_KEYS)), name))
    rows = rows.withColumn("begins", F.min("ord").over(Window.partitionBy("doc", "name")))
    order = Window.partitionBy("doc", F.col("name").isNull()).orderBy("begins")
    turn = F.dense_rank().over(order)
    rest = F.expr(f"substr(parameter, {len(BEARING_PREFIX) + 1} + length(name))")
    return rows.withColumn("parameter", F.when(F.col("name").isNotNull(), F.concat(F.lit(BEARING_PREFIX + "bearing_"), turn.cast("string"), rest)).otherwise(F.col("parameter"))).drop("name", "begins")


def flatten_json(df: DataFrame, text: Column, name: Column, strict: bool = False) -> DataFrame:
    """``FLAT`` rows of JSON documents, numbered in document order.  Booleans are numbers.

    A document that is no JSON object, or without ``machine_id``, gives one row with an ``error`` and no parameter; with ``strict`` bad JSON fails
    and the id falls back to ``name``.  Leaves are dealt by document once; all that follows stays in that partitioning."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc", "entity", "ord", "path", "num", "text", "lists", "error"]
        for batch in batches:
            rows = [r for d, n, t in zip(batch["doc"], batch["n"], batch["t"], strict=True) for r in _document_rows(d, n, t, strict)]
            yield pd.DataFrame(rows, columns=columns)

    docs = df.select(F.monotonically_increasing_id().alias("doc"), name.cast("string").alias("n"), text.alias("t"))
    leaf = _contributions(docs.mapInPandas(walk, LEAF)).select("doc", "entity", "ord", "decides.at", "error", F.explode_outer("slots").alias("s"))
    leaf = leaf.select("doc", "entity", "ord", "at", "error", "s.to", "s.how", "s.num", "s.text", "s.family").filter("error IS NOT NULL OR to IS NOT NULL").repartition("doc")
    # Bad documents go through as one contribution that is its own row.
    good = _number_bearings(_summed_up(leaf.withColumn("to", F.coalesce("to", F.lit(""))).withColumn("how", F.coalesce("how", F.lit("last"))).withColumn("text", F.coalesce("error", "text"))))
    ordinal = F.row_number().over(Window.partitionBy("doc").orderBy("ord", "turn", "parameter")).cast("long") - 1
    bad = F.col("ord") < 0
    return good.select(
        F.col("entity").alias("entity_id"),
        F.when(bad, F.lit(-1).cast("long")).otherwise(ordinal).alias("ordinal"),
        F.when(~bad, F.col("parameter")).alias("parameter"),
        F.col("num").alias("value_num"),
        F.when(~bad, F.col("text")).alias("value_str"),
        F.when(bad, F.col("text")).alias("error"),
    )


def values_of(flat: DataFrame) -> DataFrame:
    return flat.filter("error IS NULL").drop("error")


def select_features(flat: DataFrame, selection: DataFrame) -> DataFrame:
    """The feature table of flattened documents, by a selection ``(path, component, param, unit, ptype, datatype, ordinal)``.

    Values of datatype "kategorisch" are text, others numbers where they read as such.  Where several paths of an entity
    name one parameter, the last by ordinal counts."""
    chosen = selection.select(F.col("path").alias("parameter"), "component", "param", "unit", "ptype", "datatype", F.col("ordinal").alias("turn"))
    # The selection is the small side, whatever the planner takes the flattened documents for: those never go through the driver.
    rows = values_of(flat).join(F.broadcast(chosen), "parameter")
    text = F.coalesce(F.col("value_str"), F.col("value_num").cast("string"))
    num = F.when(F.col("datatype") != "kategorisch", F.coalesce(F.col("value_num"), plain_number(F.col("value_str"))))
    rows = rows.select("entity_id", "component", "param", num.alias("value_num"), F.when(num.isNull(), text).alias("value_str"), "unit", "ptype", "turn")
    order = Window.partitionBy("entity_id", "component", "param").orderBy(F.desc("turn"))
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r", "turn")
