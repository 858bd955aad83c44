"""Scans: JSON folders, specification and selection tables, generated facts, RDF/XML, SPARQL results."""

from __future__ import annotations

import json
from urllib import parse, request

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import heading_ptype, param_id_from_path, squeeze
from ..model import lookup  # noqa: F401
from ..operators.flatten import flatten_json, select_features
from ..operators.graph import TRIPLES

NOTHING = ("–", "nan", "")
SPEC = "Parameter_ID string, Component_ID string, ParamType_ID string, DataType string, Unit string, EnumDomain string"


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(name, text)`` of the ``*.json`` files of a folder; the name is the file's without its ending."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1), r"\.json$", "")
    return rows.select(name.alias("name"), F.col("value").alias("text"))


def read_json_values(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, int]:
    """All flattened values of a folder and its number of documents."""
    docs = json_documents(spark, path)
    return flatten_json(docs, F.col("text"), F.col("name"), strict), docs.count()


def read_json_features(spark: SparkSession, path: str, selection_path: str) -> tuple[DataFrame, DataFrame]:
    """Features of a folder by a selection table, and the documents that could not be used, as ``(name, error)``."""
    docs = json_documents(spark, path)
    flat = flatten_json(docs, F.col("text"), F.col("name"))
    bad = flat.filter("error IS NOT NULL").select(F.col("entity_id").alias("name"), "error")
    return select_features(flat, read_selection(spark, selection_path)), bad


def csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """A CSV file with a header, all columns text; a byte order mark is dropped."""
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """``(path, component, param, unit, ptype, datatype, ordinal)`` of a selection table; of several rows for a path the last counts."""
    rows = csv(spark, path).withColumn("ordinal", F.monotonically_increasing_id())

    def text(name: str, default: str):
        return squeeze(F.coalesce(F.col(f"`{name}`"), F.lit("nan"))) if name in rows.columns else F.lit(default)

    def given(name: str, default):
        return F.when(text(name, "–").isin(*NOTHING), default).otherwise(text(name, "–"))

    where = text("Parameter", "nan")
    rows = rows.select(
        where.alias("path"),
        given("Komponente", F.lit("C_SONSTIGE")).alias("component"),
        given("P_Name", param_id_from_path(where)).alias("param"),
        given("Einheit_", F.lit("")).alias("unit"),
        heading_ptype(text("Fachkategorie", "–")).alias("ptype"),
        text("Datentyp", "numerisch").alias("datatype"),
        "ordinal",
    )
    last = Window.partitionBy("path").orderBy(F.desc("ordinal"))
    # Where a path comes twice, the last row's entries stand in the first row's place.
    first = rows.groupBy("path").agg(F.min("ordinal").alias("ordinal"))
    return rows.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r", "ordinal").join(first, "path")


def read_specs(spark: SparkSession, path: str) -> list[tuple]:
    """Specifications of the generator, trimmed; a short list by nature."""
    names = [c.split()[0] for c in SPEC.split(", ")]
    rows = csv(spark, path)
    fields = [squeeze(F.coalesce(F.col(n), F.lit(""))) if n in rows.columns else F.lit("") for n in names]
    return [tuple(r) for r in rows.select(*(f.alias(n) for f, n in zip(fields, names, strict=True))).collect()]


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a generated table: six columns, empty values as null."""
    rows = csv(spark, path)
    return rows.select(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in ("Design_ID", "Component_ID", "Parameter_ID", "ParamType_ID", "Value", "Unit")))


def read_sheet(spark: SparkSession, path: str, header_row: int = 0, sep: str = ",") -> DataFrame:
    """A sheet exported as CSV, its header in row ``header_row``; workbooks themselves need a library that may be missing."""
    if not header_row:
        return csv(spark, path, sep)
    lines = spark.read.text(path).limit(header_row + 1).collect()
    names = [n.strip().strip('"').lstrip("﻿") for n in lines[header_row][0].split(sep)]
    rows = spark.read.option("sep", sep).option("escape", '"').csv(path)
    rows = rows.select(*(F.col(rows.columns[i]).alias(n) for i, n in enumerate(names) if n))
    skip = rows.withColumn("row", F.monotonically_increasing_id()).filter(F.col("row") > header_row)
    return skip.drop("row")


RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def read_rdf_xml(spark: SparkSession, path: str, prefixes: dict[str, str], row_tag: str = "rdf:Description") -> DataFrame:
    """Triples of an RDF/XML file made of ``row_tag`` nodes, with properties as child elements.

    ``prefixes`` maps the prefixes of the file's element names to namespaces."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)
    known = {"rdf": RDF} | prefixes
    parts = []
    for field in df.schema.fields:
        name, kind = field.name, field.dataType.simpleString()
        if name.startswith("_"):
            continue
        prefix, _, local = name.partition(":")
        p = known.get(prefix, prefix) + local
        item = F.col(f"`{name}`") if kind.startswith("array") else F.array(F.col(f"`{name}`"))
        rows = df.select(F.col("`_rdf:about`").alias("s"), F.explode(item).alias("x"))
        inner = rows.schema["x"].dataType
        names = inner.fieldNames() if hasattr(inner, "fieldNames") else []
        resource = F.col("x.`_rdf:resource`") if "_rdf:resource" in names else F.lit(None).cast("string")
        literal = (F.col("x._VALUE") if "_VALUE" in names else F.lit(None)) if names else F.col("x")
        datatype = F.col("x.`_rdf:datatype`") if "_rdf:datatype" in names else F.lit(None)
        rows = rows.select("s", F.lit(p).alias("p"), F.coalesce(resource, literal.cast("string")).alias("o"), resource.isNotNull().alias("o_is_iri"), datatype.cast("string").alias("datatype"))
        parts.append(rows.filter("o IS NOT NULL"))
    if not parts:
        return spark.createDataFrame([], TRIPLES)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out.distinct()


def sparql(endpoint: str, query: str, timeout: float = 60.0) -> dict:
    """Result of a query by HTTP, as parsed JSON; an HTTP error is raised."""
    body = parse.urlencode({"query": query}).encode()
    asked = request.Request(endpoint, body, {"Accept": "application/sparql-results+json"})
    with request.urlopen(asked, timeout=timeout) as answer:
        return json.load(answer)


def bindings(spark: SparkSession, result: dict) -> DataFrame:
    """The bindings of a query result, one text column for each variable; unbound is null."""
    names = result["head"]["vars"] if "head" in result else sorted({v for b in result["results"]["bindings"] for v in b})
    rows = [tuple(b.get(v, {}).get("value") for v in names) for b in result["results"]["bindings"]]
    return spark.createDataFrame(rows, ", ".join(f"`{v}` string" for v in names))
