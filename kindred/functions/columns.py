"""Scalar functions as Column expressions: names, numbers, labels."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import lookup

# --- names -----------------------------------------------------------------------------------------------------


def local_name(iri: Column) -> Column:
    """What follows the first ``#``; without one, the last path segment."""
    return F.when(iri.contains("#"), F.regexp_replace(iri, r"(?s)^[^#]*#", "")).otherwise(F.substring_index(iri, "/", -1))


def strip_suffix(name: Column) -> Column:
    """The name without its last ``_segment``."""
    return F.regexp_replace(name, r"_[^_]*$", "")


def base_param(name: Column) -> Column:
    """The name of a parameter without the suffix of an instance.

    A design number (``_D12``) or dated number (``_2025-11-30_1``) is cut, the date also where it is uncovered by the first cut.
    Otherwise a last segment goes if it has a hyphen, or has at most four characters and is a number or all
    capitals."""
    known = F.regexp_replace(F.regexp_replace(name, r"_D\d+$", ""), r"_\d{4}-\d{2}-\d{2}_\d+$", "")
    last = F.substring_index(name, "_", -1)
    capitals = (F.upper(last) == last) & (F.lower(last) != last)
    instance = last.contains("-") | ((F.length(last) <= 4) & (capitals | last.rlike(r"^\d+$")))
    return F.when(known != name, known).when(name.contains("_") & instance, strip_suffix(name)).otherwise(name)


# Path segments that say nothing about a parameter.
PATH_STOPWORDS = ("rotorworkflow", "edimworkflow", "simocalcworkflow", "output", "input", "results")


def param_id_from_path(path: Column) -> Column:
    """A readable parameter id: the last five telling segments of a JSON path."""
    parts = F.filter(F.split(path, r"[._]"), lambda t: (t != "") & ~F.lower(t).isin(*PATH_STOPWORDS))
    name = F.upper(F.array_join(F.when(F.size(parts) > 5, F.slice(parts, -5, 5)).otherwise(parts), "_"))
    return F.concat(F.lit("P_"), F.when(name == "", F.upper(F.replace(path, F.lit("."), F.lit("_")))).otherwise(name))


def fragment(text: Column, brackets: bool = True) -> Column:
    """Text as part of an IRI: trimmed, with spaces (and round brackets) turned into underscores."""
    return F.regexp_replace(squeeze(text), r"[ ()]" if brackets else " ", "_")


def shorten_path(path: Column, width: int = 60) -> Column:
    """Paths over ``width`` characters as "..." and their end."""
    return F.when(F.length(path) <= width, path).otherwise(F.concat(F.lit("..."), F.substring(path, -(width - 3), width - 3)))


# --- numbers ---------------------------------------------------------------------------------------------------


def squeeze(text: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def plain_number(text: Column) -> Column:
    """Text as a double as Python's ``float`` reads it; null if it does not.  NaN counts as unreadable."""
    t = squeeze(text)
    infinite = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(t.rlike(NUMBER), t.try_cast("double")).when(t.rlike(INFINITE), infinite)


def safe_float(text: Column) -> Column:
    """Text as a double: white space and double quotes at the ends are dropped, a decimal comma is a point; null if unreadable,
    empty or ``nan``."""
    t = F.regexp_replace(squeeze(text), r'^"+|"+$', "")
    return plain_number(F.translate(t, ",", "."))


def scale(value: Column, low: Column, high: Column) -> Column:
    """Value between its parameter's bounds as 0 to 1; one half where the bounds are equal or unknown."""
    width = high - low
    return F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.nullif(width, F.lit(0.0))))).otherwise(F.lit(0.5))


def relu(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def exact_round(value: float | None, digits: int) -> float | None:
    """Rounding of the exact binary value, half to even: what Spark's ``round`` does not do (2.675 is below 2.675)."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return value
    return float(Decimal(value).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN))


def round_exact(value: Column, digits: int) -> Column:
    """``exact_round`` as an expression: the nearest of the two neighbours decides, by comparing exact decimals."""
    exact = value.cast("decimal(38,18)")
    return F.when(F.abs(value) < 1e15, F.bround(exact, digits).cast("double")).otherwise(value)


# --- labels ----------------------------------------------------------------------------------------------------

# Parameter type of each subject heading.
HEADING_PTYPE = {
    "Dynamik": "DYN",
    "Struktur": "STRUCT",
    "Geometrie": "GEOM",
    "Material/Masse": "MTRL",
    "Fertigung": "MFG",
    "Anforderung": "REQ",
    "Elektrisch": "ELEC",
}


def heading_ptype(heading: Column) -> Column:
    return lookup(heading, HEADING_PTYPE, "MISC")


# Areas of a path; the first rule that holds decides.  A rule is (how, text, area).
AREA_RULES = (
    ("starts", "segments", "Segmente"),
    ("has", "sleeve_bearing", "Gleitlager"),
    ("has", "roller_bearings", "Waelzlager (Output)"),
    ("has", "bearing_properties", "Lager (Input)"),
    ("has", "rotordynamics", "Rotordynamik"),
    ("has", "shaft_safety", "Wellensicherheit"),
    ("has", "parallelkey", "Wellensicherheit"),
    ("has", "form.output.shaft", "Wellenform"),
    ("has", "operational_data", "Betriebsdaten"),
    ("has", "load.", "Lastdaten"),
    ("has", "material", "Materialien"),
    ("has", "surface", "Oberflaeche"),
    ("starts", "rotorworkflow.input", "Rotor (Input)"),
    ("starts", "rotorworkflow.output", "Rotor (Output)"),
    ("starts", "machine_id", "Meta"),
)


def area(path: Column) -> Column:
    """Area that a JSON path belongs to."""
    p = F.lower(path)
    calc = p.startswith("simocalcworkflow")
    out = F.when(calc & p.contains(".input."), "Simocalc (Input)").when(calc, "Simocalc (Output)")
    for how, text, label in AREA_RULES:
        out = out.when(p.startswith(text) if how == "starts" else p.contains(text), label)
    return out.otherwise("Sonstige")


# Words that name a component in free text, in the order they are tried.
COMPONENT_WORDS = {
    "welle": "C_WELLE",
    "wellenende": "C_WELLEENDE",
    "aktivteil": "C_AKTIVTEIL",
    "lüfter": "C_LUEFTER",
    "blechpaket": "C_BLECHPAKET",
    "wuchtscheiben": "C_WUCHTSCHEIBEN",
    "rotor": "C_ROTOR",
    "lager": "C_LAGER",
    "sonstige": "C_SONSTIGE",
}


def detect_component(text: Column, number: Column) -> Column:
    """``C_X_n`` for the first component word in a text; null without one."""
    t, out = F.lower(text), None
    for word, component in COMPONENT_WORDS.items():
        hit = F.concat(F.lit(component + "_"), number.cast("string"))
        out = F.when(t.contains(word), hit) if out is None else out.when(t.contains(word), hit)
    return out


def coverage_step(percent: Column) -> Column:
    return F.when(percent == 100, "100 % (vollstaendig)").when(percent >= 70, "70-99 %").when(percent >= 30, "30-69 %").otherwise("< 30 %")


def stars(p: Column) -> Column:
    """Stars of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def agreement(rho: Column) -> Column:
    """Strength of agreement on a signed correlation."""
    return F.when(rho >= 0.7, "stark").when(rho >= 0.4, "moderat").otherwise("schwach")


def correlation_strength(rho: Column) -> Column:
    """Strength of a correlation of either sign."""
    r = F.abs(rho)
    return F.when(r >= 0.9, "sehr stark").when(r >= 0.7, "stark").when(r >= 0.5, "moderat").when(r >= 0.3, "schwach").otherwise("vernachlässigbar")


def enum_values(text: Column) -> Column:
    """``{a, b}`` as an array of trimmed, non-empty texts."""
    inner = F.regexp_replace(squeeze(text), r"^[{}]+|[{}]+$", "")
    return F.filter(F.transform(F.split(inner, ","), squeeze), lambda x: x != "")


def decimal_comma(value: Column) -> Column:
    return F.translate(value.cast("string"), ".", ",")


def parse_enum(text: str) -> list[str]:
    """``enum_values`` for one Python string."""
    return [x for x in map(str.strip, re.sub(r"^[{}]+|[{}]+$", "", text.strip()).split(",")) if x]


# --- dependency edges ------------------------------------------------------------------------------------------

# Words between source and target in an edge's name, in the order they are tried.
EDGE_WORDS = ("_Beeinflusst_", "_affectsStrength_", "_Anfordert_")


def edge_parts(name: Column) -> Column:
    """``struct(source, target)`` of an edge's name; null unless the first edge word it holds splits it in two."""
    word = F.coalesce(*(F.when(name.contains(w), F.lit(w)) for w in EDGE_WORDS))
    parts = F.when(word.isNotNull(), F.split(name, F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))))
    pair = F.struct(F.replace(parts[0], F.lit("."), F.lit("_")).alias("source"), strip_suffix(parts[1]).alias("target"))
    return F.when(F.size(parts) == 2, pair)


def edge_percentage(text: Column) -> Column:
    """Percentage of an edge; nothing, zero and what is not a number count as one half."""
    p = safe_float(text)
    return F.when(p.isNull() | (p == 0), F.lit(0.5)).otherwise(p)


def edge_strength(text: Column) -> Column:
    return F.coalesce(text, F.lit("mittel"))
