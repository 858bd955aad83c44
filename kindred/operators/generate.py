"""Synthetic facts: every entity from its own random generator, so that entities can be made anywhere, in any order, and always alike."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import parse_enum

GENERATED = "Design_ID string, Component_ID string, Parameter_ID string, ParamType_ID string, DataType string, Unit string, Value string, IsMissing int"
# Ranges by unit, in the order they are tried, and ranges that names impose, the last that fits winning.
UNIT_RANGES = (
    (lambda u: u == "mm", (10.0, 500.0)),
    (lambda u: u in ("µm", "um"), (0.1, 10.0)),
    (lambda u: u == "1/min", (300.0, 12000.0)),
    (lambda u: u == "kg", (0.1, 500.0)),
    (lambda u: "kg" in u and "mm" in u, (1_000.0, 5_000_000.0)),
    (lambda u: u == "%", (0.0, 100.0)),
    (lambda u: u.lower() == "grad", (0.0, 45.0)),
    (lambda u: "m³/h" in u or "m3/h" in u, (0.0, 5000.0)),
    (lambda u: True, (0.0, 100.0)),
)
NAME_RANGES = ((("rauheit",), (0.2, 3.2)), (("tir", "rundlauf"), (0.001, 0.2)))
BOOLEANS, FITS, UNSPECIFIED = ["ja", "nein"], ["k6/H7", "h6/H7", "m6/H7", "g6/H7"], "UNSPECIFIED"


def numeric_range(unit: str, name: str, variance: float = 1.0) -> tuple[float, float]:
    """Bounds of a numeric parameter; a variance other than 1 widens them around their centre, not below 0."""
    u = unit.strip()
    low, high = next(r for fits, r in UNIT_RANGES if fits(u))
    for words, bounds in NAME_RANGES:
        if any(w in name.lower() for w in words):
            low, high = bounds
    if variance != 1.0:
        centre, half = (low + high) / 2, (high - low) / 2 * variance
        low, high = max(low if u == "grad" else 0.0, centre - half), centre + half
    return low, high


def draw_value(rng: random.Random, datatype: str, unit: str, name: str, enum: str, variance: float) -> str:
    kind = datatype.lower()
    if kind == "numeric":
        return str(round(rng.uniform(*numeric_range(unit, name, variance)), 4))
    choices = {"boolean": BOOLEANS, "text": FITS, "enum": parse_enum(enum)}.get(kind)
    return rng.choice(choices) if choices else UNSPECIFIED


def generate(spark: SparkSession, specs: list[tuple[str, str, str, str, str, str]], n: int, seed: int, missing_rate: float = 0.05, variance: float = 1.0) -> DataFrame:
    """``GENERATED`` rows of n entities D001, D002, ... for ``specs`` of (parameter, component, type, datatype, unit, enum values).

    Entity i draws from ``Random(seed + i)``, for each specification first whether the value is missing, then the value if it is not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                rng = random.Random(seed + int(i))
                for parameter, component, ptype, datatype, unit, enum in specs:
                    missing = rng.random() < missing_rate
                    value = "" if missing else draw_value(rng, datatype, unit, parameter, enum, variance)
                    rows.append((f"D{i:03d}", component, parameter, ptype, datatype, unit, value, int(missing)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in GENERATED.split(", ")])

    return spark.range(1, n + 1).mapInPandas(run, GENERATED)


def facts_of_generated(generated: DataFrame) -> DataFrame:
    """Six columns of generated rows; an empty value is none."""
    return generated.select("Design_ID", "Component_ID", "Parameter_ID", "ParamType_ID", F.nullif("Value", F.lit("")).alias("Value"), F.nullif("Unit", F.lit("")).alias("Unit"))
