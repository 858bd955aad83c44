"""The data model: the long feature table, its three categories, and adapters that melt wide tables into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = "entity_id string, component string, param string, value_num double, value_str string, unit string, ptype string"

GEOMETRY, MATERIAL, REQUIREMENT = "K_GEOM_MECH", "K_MTRL_PROC", "K_REQ_ELEC"
CATEGORIES = (GEOMETRY, MATERIAL, REQUIREMENT)
#: Short names of the categories in result columns.
SHORT = {GEOMETRY: "geom", MATERIAL: "mtrl", REQUIREMENT: "req"}
# Category of each parameter type, display names, default weights of the three categories.
PTYPE_CATEGORY = {
    "GEOM": GEOMETRY,
    "STRUCT": GEOMETRY,
    "DYN": GEOMETRY,
    "MTRL": MATERIAL,
    "MFG": MATERIAL,
    "COST": MATERIAL,
    "REQ": REQUIREMENT,
    "ELEC": REQUIREMENT,
    "UNKNOWN": REQUIREMENT,
    "MISC": REQUIREMENT,
}
CATEGORY_LABEL = {GEOMETRY: "Geometrie", MATERIAL: "Material", REQUIREMENT: "Anforderungen"}
DEFAULT_WEIGHTS = {GEOMETRY: 2.0, MATERIAL: 1.0, REQUIREMENT: 0.5}


def lookup(key: Column, mapping: dict[str, str], default: str) -> Column:
    """Value of a small literal map, ``default`` where the key is null or unknown."""
    items = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(F.try_element_at(items, F.trim(key)), F.lit(default))


def category(ptype: Column) -> Column:
    """Category of a parameter type."""
    return lookup(ptype, PTYPE_CATEGORY, REQUIREMENT)


def melt(df: DataFrame, id_col: str, parameters: list[tuple[str, str, str, str, str]], prefix: str = "") -> DataFrame:
    """Long feature table of a wide one, in one pass.

    ``parameters`` lists (column, component, param, ptype, kind), kind being "num" or "str"."""
    cells = [
        F.struct(
            F.lit(component).alias("component"),
            F.lit(param).alias("param"),
            (F.col(column).cast("double") if kind == "num" else F.lit(None).cast("double")).alias("value_num"),
            (F.col(column).cast("string") if kind == "str" else F.lit(None).cast("string")).alias("value_str"),
            F.lit(None).cast("string").alias("unit"),
            F.lit(ptype).alias("ptype"),
        )
        for column, component, param, ptype, kind in parameters
    ]
    entity = F.concat(F.lit(prefix), F.col(id_col).cast("string"))
    return df.select(entity.alias("entity_id"), F.explode(F.array(*cells)).alias("c")).select("entity_id", "c.*")


PART_PARAMETERS = [
    ("p_name", "C_PART", "NAME", "MTRL", "str"),
    ("p_brand", "C_PART", "BRAND", "MFG", "str"),
    ("p_type", "C_PART", "TYPE", "REQ", "str"),
    ("p_size", "C_PART", "SIZE", "GEOM", "num"),
    ("p_retailprice", "C_PART", "PRICE", "COST", "num"),
]
SUPPLIER_PARAMETERS = [
    ("s_nationkey", "C_SITE", "NATION", "REQ", "str"),
    ("s_acctbal", "C_ACCOUNT", "BALANCE", "COST", "num"),
    ("s_suppkey", "C_SITE", "NUMBER", "GEOM", "num"),
]
CUSTOMER_PARAMETERS = [
    ("c_nationkey", "C_SITE", "NATION", "REQ", "str"),
    ("c_mktsegment", "C_ACCOUNT", "SEGMENT", "MTRL", "str"),
    ("c_acctbal", "C_ACCOUNT", "BALANCE", "GEOM", "num"),
]


def from_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(entity_id, category, vec)``, vectors as doubles, all in the first category."""
    return df.select(F.col(id_col).alias("entity_id"), F.lit(GEOMETRY).alias("category"), F.col(vector_col).cast("array<double>").alias("vec"))
