"""Facts and dependencies as triples ``(s, p, o, o_is_iri, datatype)``, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import base_param, fragment, local_name, safe_float, squeeze, strip_suffix

TRIPLES = "s string, p string, o string, o_is_iri boolean, datatype string"
#: Namespace of the graph's own terms: a parameter of every function here.
NAMESPACE = "http://example.org/kindred#"
# Terms of the RDF, RDFS, OWL and XSD vocabularies.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
COMMENT = "http://www.w3.org/2000/01/rdf-schema#comment"
DOMAIN = "http://www.w3.org/2000/01/rdf-schema#domain"
RANGE = "http://www.w3.org/2000/01/rdf-schema#range"
OBJECT_PROPERTY = "http://www.w3.org/2002/07/owl#ObjectProperty"
DATATYPE_PROPERTY = "http://www.w3.org/2002/07/owl#DatatypeProperty"
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
# Class of each component.
COMPONENT_CLASS = {
    "C_WELLE": "Welle",
    "C_WELLEENDE": "Welleende",
    "C_AKTIVTEIL": "Aktivteil",
    "C_LUEFTER": "Lüfter",
    "C_BLECHPAKET": "Blechpaket",
    "C_WUCHTSCHEIBEN": "Wuchtscheiben",
}
MORE_COMPONENT_CLASS = COMPONENT_CLASS | {"C_ROTOR": "Rotor", "C_LAGER": "Lager", "C_SONSTIGE": "Sonstige"}
# Words that name a component in a survey, in the order they are tried.
SURVEY_WORDS = {"welle": "C_WELLE", "aktivteil": "C_AKTIVTEIL", "lüfter": "C_LUEFTER", "blechpaket": "C_BLECHPAKET", "wuchtscheiben": "C_WUCHTSCHEIBEN"}
EDGE_MARKS = ("Beeinflusst", "affectsStrength", "Anfordert")


def iri(name: Column | str, ns: str) -> Column:
    return F.concat(F.lit(ns), F.lit(name) if isinstance(name, str) else name)


def triple(df: DataFrame, s: Column, p: str | Column, o: Column, is_iri: bool, datatype: str | None = None) -> DataFrame:
    p = F.lit(p) if isinstance(p, str) else p
    return df.select(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(is_iri).alias("o_is_iri"), F.lit(datatype).cast("string").alias("datatype"))


def union(parts: list[DataFrame]) -> DataFrame:
    """A graph is a set."""
    return reduce(DataFrame.unionAll, parts).distinct()


def _classes(rows: DataFrame, name: Column, label: Column, comment: Column | None, parent: str, ns: str) -> list[DataFrame]:
    out = [triple(rows, iri(name, ns), SUBCLASS, iri(parent, ns), True), triple(rows, iri(name, ns), LABEL, label, False)]
    if comment is not None:
        held = rows.filter((comment != "") & (F.lower(comment) != "nan"))
        out.append(triple(held, iri(name, ns), COMMENT, comment, False))
    return out


def component_classes(sheet: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """Classes of a component sheet (``Label``, optional ``Description``)."""
    comment = F.col("Description") if "Description" in sheet.columns else None
    return union(_classes(sheet, fragment(F.col("Label"), False), F.col("Label"), comment, "Artefact", ns))


def _parameter_root(rows: DataFrame, ns: str) -> list[DataFrame]:
    one = rows.sparkSession.range(1)
    return _classes(one, F.lit("Parameter"), F.lit("Parameter"), None, "Object", ns)


def parameter_classes(sheet: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """Classes of a parameter sheet (``Parameter_ID``, ``Name``, optional ``Description``)."""
    comment = F.col("Description") if "Description" in sheet.columns else None
    return union(_parameter_root(sheet, ns) + _classes(sheet, fragment(F.col("Parameter_ID"), False), F.col("Name"), comment, "Parameter", ns))


def classes_of_facts(facts: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """Component and parameter classes of what occurs in facts: a component without a class is named by its id, without ``C_``, in title case."""
    label = F.coalesce(*(F.when(F.col("Component_ID") == c, n) for c, n in MORE_COMPONENT_CLASS.items()), F.initcap(F.replace("Component_ID", F.lit("C_"), F.lit(""))))
    components = facts.select(label.alias("label")).distinct()
    params = facts.select("Parameter_ID").distinct()
    return union(
        _classes(components, F.col("label"), F.col("label"), None, "Artefact", ns)
        + _parameter_root(facts, ns)
        + _classes(params, fragment(F.col("Parameter_ID"), False), F.col("Parameter_ID"), None, "Parameter", ns)
    )


def facts_of_features(features: DataFrame) -> DataFrame:
    """Features with a value as facts ``(Design_ID, Component_ID, Parameter_ID, ParamType_ID, Value, Unit)``."""
    value = F.coalesce(F.col("value_num").cast("string"), F.col("value_str"))
    return features.filter(value.isNotNull()).select(
        F.col("entity_id").alias("Design_ID"), F.col("component").alias("Component_ID"), F.col("param").alias("Parameter_ID"), F.col("ptype").alias("ParamType_ID"), value.alias("Value"), F.col("unit").alias("Unit")
    )


def instances(facts: DataFrame, ns: str = NAMESPACE, classes: dict[str, str] = COMPONENT_CLASS) -> DataFrame:
    """Triples of entities, components and parameters.

    Only components of ``classes`` are linked to their entity; parameters of others stay in the graph but out of reach.  A parameter's node is named by
    parameter and entity, so equal names under two components are one node."""
    f = facts.withColumn("param_node", F.concat(fragment(F.col("Parameter_ID")), F.lit("_"), F.col("Design_ID")))
    f = f.withColumn("component_node", F.concat("Component_ID", F.lit("_"), F.col("Design_ID")))
    entity = F.concat(F.lit("Rotor_"), F.col("Design_ID"))
    designs = f.select("Design_ID").distinct()
    known = f.filter(F.col("Component_ID").isin(*classes)).select("Design_ID", "Component_ID", "component_node").distinct()
    of_class = F.coalesce(*(F.when(F.col("Component_ID") == c, n) for c, n in classes.items()))
    node, param = iri(F.col("component_node"), ns), iri(F.col("param_node"), ns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    part = ns + "composed_of"
    schema = [(ns + n, RDF_TYPE, DATATYPE_PROPERTY) for n in ("hasValue", "hasUnit", "hasType")] + [(ns + n, DOMAIN, ns + "Parameter") for n in ("hasValue", "hasUnit", "hasType")]
    schema += [(part, RDF_TYPE, OBJECT_PROPERTY), (part, DOMAIN, ns + "Artefact"), (part, RANGE, ns + "Parameter")]
    fixed = facts.sparkSession.createDataFrame([(*t, True, None) for t in schema], TRIPLES)
    return union(
        [
            fixed,
            triple(designs, iri(entity, ns), RDF_TYPE, iri("PhysicalObject", ns), True),
            triple(designs, iri(entity, ns), LABEL, entity, False, XSD_STRING),
            triple(known, node, RDF_TYPE, iri(of_class, ns), True),
            triple(known, node, LABEL, F.col("component_node"), False, XSD_STRING),
            triple(known, iri(entity, ns), part, node, True),
            triple(f, param, RDF_TYPE, iri(F.col("Parameter_ID"), ns), True),
            triple(f, param, LABEL, F.col("param_node"), False, XSD_STRING),
            triple(f, param, ns + "hasValue", text("Value"), False, XSD_STRING),
            triple(f, param, ns + "hasUnit", text("Unit"), False, XSD_STRING),
            triple(f.filter("ParamType_ID IS NOT NULL"), param, ns + "hasType", F.col("ParamType_ID"), False, XSD_STRING),
            triple(f, node, part, param, True),
        ]
    )


def survey_edges(survey: DataFrame, number: int | str, ns: str = NAMESPACE) -> DataFrame:
    """Triples of a dependency survey (``Quelle, Relation, Ziel, Staerke, Abhängigkeit_%, Notiz``).

    Names end before a round bracket, targets also before a semicolon; a name that ends with a full stop is none.  A source
    without a component word becomes a feature node and its row no edge; a target without one becomes a feature node at the edge's end."""
    n = F.lit(f"_{number}")
    source = squeeze(F.substring_index("Quelle", "(", 1))
    target = squeeze(F.substring_index(squeeze(F.substring_index("Ziel", "(", 1)), ";", 1))
    empty = lambda c: F.when(c.endswith("."), F.lit("")).otherwise(c)

    def component(c: Column) -> Column:
        return F.coalesce(*(F.when(F.lower(c).contains(w), F.lit(k)) for w, k in SURVEY_WORDS.items()))

    rows = survey.select(empty(source).alias("source"), empty(target).alias("target"), fragment(F.col("Relation")).alias("relation"), F.col("Staerke").alias("strength"), F.col("`Abhängigkeit_%`").cast("string").alias("percentage"), F.col("Notiz").alias("note"))
    rows = rows.withColumn("from", component(F.col("source"))).withColumn("to", component(F.col("target")))
    node = lambda c: iri(F.concat(c, n), ns)
    edges = rows.filter(F.col("from").isNotNull()).withColumn("name", F.concat_ws("_", "source", "relation", "target", F.lit(str(number))))
    edge = iri(F.col("name"), ns)
    return union(
        [
            triple(rows.filter(F.col("from").isNull()), node(F.col("source")), RDF_TYPE, iri("Feature", ns), True),
            triple(edges.filter(F.col("to").isNull()), node(F.col("target")), RDF_TYPE, iri("Feature", ns), True),
            triple(edges, edge, RDF_TYPE, F.lit(OBJECT_PROPERTY), True),
            triple(edges, edge, LABEL, F.col("name"), False, XSD_STRING),
            triple(edges, node(F.col("from")), edge, node(F.coalesce("to", "target")), True),
            triple(edges, edge, ns + "hasStrength", F.col("strength"), False, XSD_STRING),
            triple(edges, edge, ns + "hasDependencyPercentage", F.col("percentage"), False, XSD_STRING),
            triple(edges, edge, COMMENT, F.col("note"), False, XSD_STRING),
        ]
    )


# --- reading a graph -------------------------------------------------------------------------------------------


def _objects(triples: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return triples.filter(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def features_of(triples: DataFrame, ns: str = NAMESPACE, prefix: str = "Rotor_", nan_text_as_value: bool = False) -> DataFrame:
    """The feature table of a graph: entity - component - parameter, with value, unit and type where there are any.

    Component names lose their last segment, parameter names their instance suffix.  Values that read as numbers are numbers.  Where several nodes meet
    in one key, the greatest value text counts.  The text ``nan`` is no value, unless ``nan_text_as_value``."""
    part = triples.filter(F.col("p") == ns + "composed_of").select("s", "o")
    top = part.filter(F.col("s").startswith(ns + prefix)).select(F.col("s").alias("entity"), F.col("o").alias("component"))
    rows = top.join(part.select(F.col("s").alias("component"), F.col("o").alias("param")), "component")
    # One pass over the literals instead of three joins with the graph.
    facts = triples.filter(F.col("p").isin(ns + "hasValue", ns + "hasUnit", ns + "hasType"))
    facts = facts.groupBy(F.col("s").alias("param")).agg(
        *(F.max(F.when(F.col("p") == ns + p, F.col("o"))).alias(a) for p, a in (("hasValue", "raw"), ("hasUnit", "unit"), ("hasType", "ptype")))
    )
    rows = rows.join(facts, "param", "left")
    num = safe_float(F.col("raw"))
    text = F.when(num.isNull(), F.col("raw") if nan_text_as_value else F.when(F.lower(squeeze(F.col("raw"))) != "nan", F.col("raw")))
    rows = rows.select(local_name(F.col("entity")).alias("entity_id"), strip_suffix(local_name(F.col("component"))).alias("component"), base_param(local_name(F.col("param"))).alias("param"), num.alias("value_num"), text.alias("value_str"), "unit", "ptype", "raw")
    last = F.max_by(F.struct("value_num", "value_str", "unit", "ptype"), F.coalesce("raw", F.lit("")))
    return rows.groupBy("entity_id", "component", "param").agg(last.alias("x")).select("entity_id", "component", "param", "x.value_num", "x.value_str", "x.unit", "x.ptype")


def edges_of(triples: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """``(name, strength, percentage)`` of the dependency properties of a graph; ``weights.parse_edges`` reads their names."""
    marked = F.lit(False)
    for mark in EDGE_MARKS:
        marked = marked | F.col("s").contains(mark)
    props = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == OBJECT_PROPERTY) & marked).select("s").distinct()
    props = props.join(_objects(triples, ns + "hasStrength", "s", "strength"), "s", "left").join(_objects(triples, ns + "hasDependencyPercentage", "s", "percentage"), "s", "left")
    return props.select(local_name(F.col("s")).alias("name"), "strength", "percentage")


def sample_graph(triples: DataFrame, most: int = 100_000) -> DataFrame:
    """Up to ``most`` triples, to look at."""
    return triples.limit(most)
