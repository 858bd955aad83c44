"""Sinks: generated facts, profile tables with decimal commas, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import decimal_comma

NO_VALUE = "–"


def write_generated(generated: DataFrame, path: str) -> None:
    generated.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def german(df: DataFrame, dash: list[str] = ()) -> DataFrame:
    """All columns as text: decimals with a comma, and a dash for null in the columns of ``dash``."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        c = decimal_comma(c) if kind in ("double", "float") or kind.startswith("decimal") else c.cast("string")
        out.append((F.coalesce(c, F.lit(NO_VALUE)) if name in dash else c).alias(name))
    return df.select(*out)


def write_profile(profiled: DataFrame, path: str, bom: bool = True) -> None:
    """A profile or cleaned list as CSV with semicolons and decimal commas, a dash where a column does not apply, and a byte order
    mark in front.  Everything is written by one task: it is one row a parameter."""
    keep = [c for c in profiled.columns if c not in ("parameter", "area", "datatype", "n")]
    rows = german(profiled, keep)
    if bom and rows.columns:
        rows = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0])
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def write_rdf_xml(triples: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """Triples as RDF/XML: one ``rdf:Description`` a subject, its properties as child elements.

    ``prefixes`` maps prefixes to namespaces; every predicate must begin with one of these namespaces or that of RDF.  The predicates, a vocabulary, are listed
    on the driver."""
    spaces = {"rdf": RDF} | prefixes
    columns = []
    for r in triples.select("p").distinct().orderBy("p").collect():
        prefix, space = max(((k, v) for k, v in spaces.items() if r["p"].startswith(v)), key=lambda x: len(x[1]), default=(None, None))
        if prefix is None:
            raise ValueError(f"no prefix for {r['p']}")
        columns.append((r["p"], f"{prefix}:{r['p'][len(space) :]}"))
    item = F.struct(F.when(~F.col("o_is_iri"), F.col("o")).alias("_VALUE"), F.when(F.col("o_is_iri"), F.col("o")).alias("_rdf:resource"), F.col("datatype").alias("_rdf:datatype"))
    held = lambda p: F.collect_list(F.when(F.col("p") == p, item))
    nodes = triples.groupBy(F.col("s").alias("_rdf:about")).agg(*(F.when(F.size(held(p)) > 0, F.sort_array(held(p))).alias(name) for p, name in columns))
    root = "rdf:RDF " + " ".join(f'xmlns:{k}="{v}"' for k, v in spaces.items())
    nodes.write.mode("overwrite").format("xml").option("rowTag", "rdf:Description").option("rootTag", root).option("declaration", "").option("validateName", False).save(path)


def _escaped(c):
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def n_triples(triples: DataFrame) -> DataFrame:
    """Triples as lines of N-Triples."""
    wrap = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    kind = F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^"), wrap(F.col("datatype")))).otherwise(F.lit(""))
    o = F.when(F.col("o_is_iri"), wrap(F.col("o"))).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), kind))
    return triples.select(F.concat_ws(" ", wrap(F.col("s")), wrap(F.col("p")), o, F.lit(".")).alias("value"))


def write_graph(triples: DataFrame, path: str) -> None:
    n_triples(triples).write.mode("overwrite").text(path)


NT = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>)?) \.$'


def read_graph(spark, path: str) -> DataFrame:
    """Triples of N-Triples files as ``write_graph`` writes them."""
    line = lambda i: F.regexp_extract("value", NT, i)
    marks = F.replace(line(4), F.lit("\\\\"), F.lit("\x00"))
    for safe, raw in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\x00", "\\")):
        marks = F.replace(marks, F.lit(safe), F.lit(raw))
    is_iri = line(3) != ""
    return spark.read.text(path).filter(F.col("value").rlike(NT)).select(line(1).alias("s"), line(2).alias("p"), F.when(is_iri, line(3)).otherwise(marks).alias("o"), is_iri.alias("o_is_iri"), F.nullif(line(5), F.lit("")).alias("datatype"))
