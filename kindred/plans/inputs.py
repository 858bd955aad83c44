"""Inputs of the registered queries: the driver's tables as features, values, edges and facts, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CUSTOMER_PARAMETERS, PART_PARAMETERS, PTYPE_CATEGORY, SUPPLIER_PARAMETERS, melt

QUERY_ID = "7"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_features(spark, d) -> DataFrame:
    return melt(table(spark, d, "part"), "p_partkey", PART_PARAMETERS)


def supplier_features(spark, d) -> DataFrame:
    return melt(table(spark, d, "supplier"), "s_suppkey", SUPPLIER_PARAMETERS)


def customer_features(spark, d) -> DataFrame:
    return melt(table(spark, d, "customer"), "c_custkey", CUSTOMER_PARAMETERS)


def sparse_features(spark, d) -> DataFrame:
    """Part features with some values taken away and some rows gone, by rules on key and parameter."""
    f = part_features(spark, d)
    turn = F.coalesce(*(F.when(F.col("param") == p[2], F.lit(i)) for i, p in enumerate(PART_PARAMETERS)))
    key = F.col("entity_id").cast("long")
    gone = (key + turn) % 5 == 0
    f = f.withColumn("value_num", F.when(~gone, F.col("value_num"))).withColumn("value_str", F.when(~gone, F.col("value_str")))
    return f.filter((key * 7 + turn) % 11 != 0)


def melt_sql(table: str, id_col: str, parameters, where: str = "", gone: str = "false") -> str:
    """SQL of ``melt`` as rows (entity_id, component, param, num, str, ptype, cat)."""
    out = []
    for i, (column, component, param, ptype, kind) in enumerate(parameters):
        num = f"CAST({column} AS DOUBLE)" if kind == "num" else "CAST(NULL AS DOUBLE)"
        text = f"CAST({column} AS VARCHAR)" if kind == "str" else "CAST(NULL AS VARCHAR)"
        lost = gone.format(i=i, key=id_col)
        out.append(
            f"SELECT CAST({id_col} AS VARCHAR) AS entity_id, '{component}' AS component, '{param}' AS param, "
            f"CASE WHEN {lost} THEN NULL ELSE {num} END AS num, CASE WHEN {lost} THEN NULL ELSE {text} END AS str, "
            f"'{ptype}' AS ptype, '{PTYPE_CATEGORY[ptype]}' AS cat FROM {table} {where.format(i=i, key=id_col)}"
        )
    return "\nUNION ALL ".join(out)


PART = melt_sql("part", "p_partkey", PART_PARAMETERS)
SPARSE = melt_sql("part", "p_partkey", PART_PARAMETERS, "WHERE ({key} * 7 + {i}) % 11 <> 0", "({key} + {i}) % 5 = 0")
SUPPLIER = melt_sql("supplier", "s_suppkey", SUPPLIER_PARAMETERS)
CUSTOMER = melt_sql("customer", "c_custkey", CUSTOMER_PARAMETERS)


# --- values to profile: every column of three tables as a path -------------------------------------------------

PROFILED = {
    "part": ("p_partkey", [("RotorWorkflow.input.size", "p_size", "num"), ("RotorWorkflow.output.price", "p_retailprice", "num"), ("segments.brand", "p_brand", "str"), ("materials.type", "p_type", "str"), ("machine_id.name", "p_name", "str")]),
    "orders": ("o_orderkey", [("load.price", "o_totalprice", "num"), ("operational_data.status", "o_orderstatus", "str"), ("surface.priority", "o_orderpriority", "str")]),
    "customer": ("c_custkey", [("rotordynamics.balance", "c_acctbal", "num"), ("SimocalcWorkflow.input.segment", "c_mktsegment", "str"), ("EdimWorkflow.nation", "c_nationkey", "text")]),
}


def profile_values(spark, d) -> DataFrame:
    """Values of all profiled columns; the customers' nation is a number written as text."""
    out = None
    for name, (key, columns) in PROFILED.items():
        df = table(spark, d, name)
        cells = [
            F.struct(
                F.lit(path).alias("parameter"),
                (F.col(c).cast("double") if kind == "num" else F.lit(None).cast("double")).alias("value_num"),
                (F.lit(None).cast("string") if kind == "num" else F.col(c).cast("string")).alias("value_str"),
            )
            for path, c, kind in columns
        ]
        rows = df.select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("entity_id"), F.explode(F.array(*cells)).alias("c")).select("entity_id", "c.*")
        out = rows if out is None else out.unionAll(rows)
    return out


PROFILE_ENTITIES = "(SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer)"


def profile_entities(spark, d) -> int:
    return sum(table(spark, d, n).count() for n in PROFILED)


VALUES = "\nUNION ALL ".join(
    f"SELECT '{path}' AS parameter, {f'CAST({c} AS DOUBLE)' if kind == 'num' else f'TRY_CAST({c} AS DOUBLE)' if kind == 'text' else 'CAST(NULL AS DOUBLE)'} AS num, CAST({c} AS VARCHAR) AS txt FROM {name}"
    for name, (_, columns) in PROFILED.items()
    for path, c, kind in columns
)


# --- edges, paths, facts ---------------------------------------------------------------------------------------


def edge_names(spark, d) -> DataFrame:
    """Names of edges between nations and regions, one in seven of them no edge's name."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    k = F.col("n_nationkey")
    word = F.element_at(F.array(*map(F.lit, ("_Beeinflusst_", "_affectsStrength_", "_Anfordert_"))), (k % 3 + 1).cast("int"))
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    name = F.when(k % 7 == 6, F.concat("n_name", F.lit("_kennt_"), "r_name")).otherwise(F.concat(F.replace("n_name", F.lit(" "), F.lit(".")), word, "r_name", F.lit("_1")))
    strength = F.element_at(F.array(F.lit("hoch"), F.lit("mittel"), F.lit("niedrig"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    percentage = F.element_at(F.array(F.lit("0,8"), F.lit("0"), F.lit(" 0.25 "), F.lit("abc"), F.lit(None).cast("string")), (k % 5 + 1).cast("int"))
    return rows.select(name.alias("name"), strength.alias("strength"), percentage.alias("percentage"))


EDGES = """
 en AS (SELECT CASE WHEN n_nationkey % 7 = 6 THEN n_name || '_kennt_' || r_name
                    ELSE replace(n_name, ' ', '.') || ['_Beeinflusst_', '_affectsStrength_', '_Anfordert_'][n_nationkey % 3 + 1] || r_name || '_1' END AS name,
               ['hoch', 'mittel', 'niedrig', NULL][n_nationkey % 4 + 1] AS strength,
               ['0,8', '0', ' 0.25 ', 'abc', NULL][n_nationkey % 5 + 1] AS percentage
        FROM nation JOIN region ON n_regionkey = r_regionkey),
 es AS (SELECT *, CASE WHEN contains(name, '_Beeinflusst_') THEN '_Beeinflusst_' WHEN contains(name, '_affectsStrength_') THEN '_affectsStrength_'
                       WHEN contains(name, '_Anfordert_') THEN '_Anfordert_' END AS word FROM en),
 ep AS (SELECT name, replace(string_split(name, word)[1], '.', '_') AS source, regexp_replace(string_split(name, word)[2], '_[^_]*$', '') AS target,
               coalesce(strength, 'mittel') AS strength,
               coalesce(nullif(try_cast(replace(trim(percentage), ',', '.') AS DOUBLE), 0), 0.5) AS percentage
        FROM es WHERE word IS NOT NULL AND len(string_split(name, word)) = 2),
 ed AS (SELECT source, target, arg_max(strength, name) AS strength, arg_max(percentage, name) AS percentage FROM ep GROUP BY ALL)"""


def path_list(spark, d) -> DataFrame:
    """A profile-like list of paths from parts: two workflows with overlapping paths, identifiers, labelled and other paths."""
    k = F.col("p_partkey")
    path = (
        F.when(k % 4 == 0, F.concat(F.lit("EdimWorkflow.x"), F.floor(k / 4).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("SimocalcWorkflow.x"), F.floor(k / 6).cast("string"), F.lit(".p"), k.cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("SimocalcWorkflow.x"), F.floor(k / 4).cast("string")))
        .when(k % 100 == 3, F.concat(F.lit("machine_id"), F.when(k > 100, k.cast("string")).otherwise(F.lit(""))))
        .otherwise(F.concat(F.lit("RotorWorkflow.y"), k.cast("string")))
    )
    return table(spark, d, "part").select(path.alias("parameter"), (F.col("p_size") % 3 + 1).cast("long").alias("n_unique"), F.round(F.pmod("p_retailprice", F.lit(100.0)), 1).alias("score"), F.col("p_partkey").alias("key"))


PATHS = """
 pl AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'EdimWorkflow.x' || (p_partkey // 4) WHEN p_partkey % 4 = 1 THEN 'SimocalcWorkflow.x' || (p_partkey // 6) || '.p' || p_partkey
                    WHEN p_partkey % 4 = 2 THEN 'SimocalcWorkflow.x' || (p_partkey // 4)
                    WHEN p_partkey % 100 = 3 THEN 'machine_id' || CASE WHEN p_partkey > 100 THEN CAST(p_partkey AS VARCHAR) ELSE '' END
                    ELSE 'RotorWorkflow.y' || p_partkey END AS parameter,
               CAST(p_size % 3 + 1 AS BIGINT) AS n_unique, round(p_retailprice % 100.0, 1) AS score, p_partkey AS key FROM part),
 pd AS (SELECT * FROM pl WHERE NOT (starts_with(parameter, 'SimocalcWorkflow.') AND substr(parameter, 18) IN
               (SELECT substr(parameter, 14) FROM pl WHERE starts_with(parameter, 'EdimWorkflow.')))),
 pc AS (SELECT * FROM pd WHERE n_unique <> 1 AND parameter <> 'machine_id')"""


def path_labels(spark, d) -> tuple[DataFrame, DataFrame]:
    """Label tables for ``path_list``: known for keys that 3 divides, new for keys that 5 divides."""
    p = path_list(spark, d)
    text = lambda x: F.lit(x).cast("string")
    known = p.filter("key % 3 = 0").select("parameter", F.concat(F.lit("P_"), F.col("key").cast("string")).alias("p_name"), text("C_WELLE").alias("component"), text("mm").alias("unit"), text("Geometrie").alias("heading"), text(None).alias("reason"), F.when(F.col("key") % 9 == 0, "P_0").alias("duplicate_of"))
    new = p.filter("key % 5 = 0").select("parameter", F.concat(F.lit("N_"), F.col("key").cast("string")).alias("p_name"), text("C_LAGER").alias("component"), text("kg").alias("unit"), text("Dynamik").alias("heading"), text("neu").alias("reason"), text(None).alias("duplicate_of"))
    return known, new


def part_facts(spark, d) -> DataFrame:
    """Parts as facts of a graph, under two components that have a class and one that has none."""
    p = table(spark, d, "part")
    cell = lambda c, n, t, v, u: F.struct(F.lit(c).alias("Component_ID"), F.lit(n).alias("Parameter_ID"), F.lit(t).alias("ParamType_ID"), v.cast("string").alias("Value"), F.lit(u).alias("Unit"))
    cells = F.array(
        cell("C_WELLE", "P_WELLE_SIZE", "GEOM", F.col("p_size"), "mm"),
        cell("C_WELLE", "P_WELLE_BRAND (X)", "MFG", F.col("p_brand"), "-"),
        cell("C_LUEFTER", "P_LUEFTER_TYPE", "REQ", F.col("p_type"), "-"),
        cell("C_OTHER", "P_OTHER_NAME", "MTRL", F.col("p_name"), "-"),
    )
    design = F.concat(F.lit("D"), F.lpad(F.col("p_partkey").cast("string"), 3, "0"))
    design = F.when(F.length(F.col("p_partkey").cast("string")) > 3, F.concat(F.lit("D"), F.col("p_partkey").cast("string"))).otherwise(design)
    return p.select(design.alias("Design_ID"), F.explode(cells).alias("c")).select("Design_ID", "c.*")


FACTS = """
 fd AS (SELECT 'D' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) > 3 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 3, '0') END AS d, * FROM part),
 ft AS (SELECT d, 'C_WELLE' AS c, 'P_WELLE_SIZE' AS p, 'GEOM' AS t, CAST(p_size AS VARCHAR) AS v, 'mm' AS u FROM fd
        UNION ALL SELECT d, 'C_WELLE', 'P_WELLE_BRAND (X)', 'MFG', p_brand, '-' FROM fd
        UNION ALL SELECT d, 'C_LUEFTER', 'P_LUEFTER_TYPE', 'REQ', p_type, '-' FROM fd
        UNION ALL SELECT d, 'C_OTHER', 'P_OTHER_NAME', 'MTRL', p_name, '-' FROM fd)"""
