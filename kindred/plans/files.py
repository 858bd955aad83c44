"""Registered queries of the operators that read and write files, and of the learned methods: tables go out as files and come
back, and learned results are held against what must hold for them whatever was learned."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import GEOMETRY, from_embeddings
from ..operators import embeddings as E
from ..operators import flatten, generate, graph, ranks, vectors
from ..sources import readers, writers
from ..store import folder, kept

from .inputs import table
from .queries import EMB, ORACLE_SQL, SPECS, _scored, _supplier_blocks, query, rounded

# --- sources and sinks -----------------------------------------------------------------------------------------

HEADINGS = ["Geometrie", "Dynamik", "?", "Material/Masse", "–"]


@query("""SELECT 'load.p' || p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'C_SONSTIGE' ELSE 'C_' || upper(p_type) END AS component, 'P_' || p_partkey AS param,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'mm' END AS unit, ['GEOM', 'DYN', 'MISC', 'MTRL', 'MISC'][CAST(p_partkey % 5 AS INT) + 1] AS ptype,
  CASE WHEN p_partkey % 2 = 0 THEN 'numerisch' ELSE 'kategorisch' END AS datatype FROM part""")
def source_selection(spark, d):
    """A selection table written as CSV and read back."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        F.concat(F.lit(" load.p"), key).alias("Parameter"),
        F.concat(F.lit("P_"), key).alias("P_Name"),
        F.when(key % 4 == 0, "–").otherwise(F.concat(F.lit("C_"), F.upper("p_type"))).alias("Komponente"),
        F.when(key % 3 != 0, "mm").otherwise("–").alias("Einheit_"),
        F.element_at(F.array(*map(F.lit, HEADINGS)), (key % 5 + 1).cast("int")).alias("Fachkategorie"),
        F.when(key % 2 == 0, "numerisch").otherwise("kategorisch").alias("Datentyp"),
    )
    path = folder(spark, "selection")
    rows.write.option("header", True).csv(path)
    return readers.read_selection(spark, path).drop("ordinal")


@query("SELECT 'P_' || n_name AS parameter, 'C_' || n_regionkey AS component, 'GEOM' AS ptype, 'enum' AS datatype, 'mm' AS unit, '{' || n_name || ', x}' AS enum FROM nation")
def source_specs(spark, d):
    """Specifications of the generator written as CSV and read back."""
    n = table(spark, d, "nation")
    path = folder(spark, "specs")
    rows = n.select(
        F.concat(F.lit(" P_"), "n_name").alias("Parameter_ID"), F.concat(F.lit("C_"), F.col("n_regionkey")).alias("Component_ID"), F.lit("GEOM ").alias("ParamType_ID"),
        F.lit("enum").alias("DataType"), F.lit(" mm").alias("Unit"), F.concat(F.lit("{"), "n_name", F.lit(", x}")).alias("EnumDomain"),
    )
    rows.write.option("header", True).csv(path)
    return spark.createDataFrame(readers.read_specs(spark, path), "parameter string, component string, ptype string, datatype string, unit string, enum string")


@query("""SELECT 'D' || p_partkey AS "Design_ID", 'C_WELLE' AS "Component_ID", 'P_' || p_brand AS "Parameter_ID", 'GEOM' AS "ParamType_ID",
  CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS VARCHAR) END AS "Value", CASE WHEN p_partkey % 3 <> 0 THEN 'mm' END AS "Unit" FROM part""")
def source_generated(spark, d):
    """Generated rows written by the sink and read back as facts."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        F.concat(F.lit("D"), key).alias("Design_ID"), F.lit("C_WELLE").alias("Component_ID"), F.concat(F.lit("P_"), "p_brand").alias("Parameter_ID"), F.lit("GEOM").alias("ParamType_ID"), F.lit("numeric").alias("DataType"),
        F.when(key % 3 != 0, "mm").otherwise("").alias("Unit"), F.when(key % 7 != 0, F.col("p_size").cast("string")).otherwise("").alias("Value"), (key % 7 == 0).cast("int").alias("IsMissing"),
    )
    path = folder(spark, "generated")
    writers.write_generated(rows, path)
    return readers.read_generated(spark, path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def source_sheet(spark, d):
    """A sheet with a line above its header."""
    n = table(spark, d, "nation").orderBy("n_nationkey")
    lines = n.select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.lit("")).alias("value"))
    head = spark.createDataFrame([("a title,,",), ("key,name,",)], "value string")
    path = folder(spark, "sheet")
    head.coalesce(1).unionAll(lines.coalesce(1)).coalesce(1).write.text(path)
    return readers.read_sheet(spark, path, header_row=1)



@query(ORACLE_SQL["triples_build"])
def rdf_xml_round_trip(spark, d):
    """The graph of ``triples_build`` written as RDF/XML and read back."""
    from .queries import QUERIES

    path, prefixes = folder(spark, "graph"), {"own": graph.NAMESPACE, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#"}
    writers.write_rdf_xml(kept(QUERIES["triples_build"](spark, d)), path, prefixes)
    return readers.read_rdf_xml(spark, path, prefixes)


@query(ORACLE_SQL["triples_build"])
def n_triples_round_trip(spark, d):
    from .queries import QUERIES

    path = folder(spark, "graph")
    writers.write_graph(QUERIES["triples_build"](spark, d), path)
    return writers.read_graph(spark, path)


@query(f"SELECT least(100, count(*)) AS n, true AS inside FROM ({ORACLE_SQL['triples_build']})")
def triples_sample(spark, d):
    from .queries import QUERIES

    every = kept(QUERIES["triples_build"](spark, d))
    some = kept(graph.sample_graph(every, 100))
    return some.agg(F.count("*").alias("n")).withColumn("inside", F.lit(some.exceptAll(every).limit(1).count() == 0))


SHEET_CLASSES = """SELECT ns || {name} AS s, 'http://www.w3.org/2000/01/rdf-schema#' || k AS p, CASE k WHEN 'subClassOf' THEN ns || '{parent}' WHEN 'label' THEN {label} ELSE {comment} END AS o, k = 'subClassOf' AS o_is_iri
  FROM (SELECT *, 'http://example.org/kindred#' AS ns, unnest(['subClassOf', 'label', 'comment']) AS k FROM nation) WHERE k <> 'comment' OR n_nationkey % 3 = 2"""


@query(SHEET_CLASSES.format(name="n_name", parent="Artefact", label="n_name", comment="'of region ' || n_regionkey"))
def component_sheet(spark, d):
    note = F.when(F.col("n_nationkey") % 3 == 0, "NaN").when(F.col("n_nationkey") % 3 == 1, "").otherwise(F.concat(F.lit("of region "), F.col("n_regionkey")))
    return graph.component_classes(table(spark, d, "nation").select(F.col("n_name").alias("Label"), note.alias("Description"))).drop("datatype")


@query(
    SHEET_CLASSES.format(name="'P_' || n_nationkey", parent="Parameter", label="n_name", comment="'of region ' || n_regionkey")
    + """ UNION ALL SELECT 'http://example.org/kindred#Parameter', 'http://www.w3.org/2000/01/rdf-schema#subClassOf', 'http://example.org/kindred#Object', true
 UNION ALL SELECT 'http://example.org/kindred#Parameter', 'http://www.w3.org/2000/01/rdf-schema#label', 'Parameter', false"""
)
def parameter_sheet(spark, d):
    note = F.when(F.col("n_nationkey") % 3 == 0, "NaN").when(F.col("n_nationkey") % 3 == 1, "").otherwise(F.concat(F.lit("of region "), F.col("n_regionkey")))
    return graph.parameter_classes(table(spark, d, "nation").select(F.concat(F.lit("P_"), F.col("n_nationkey")).alias("Parameter_ID"), F.col("n_name").alias("Name"), note.alias("Description"))).drop("datatype")


@query(ORACLE_SQL["profile_export"])
def profile_file(spark, d):
    """A profile written with semicolons and decimal commas and read back."""
    path = folder(spark, "profile")
    writers.write_profile(_scored(spark, d).select("parameter", "coverage", "score"), path, bom=False)
    return spark.read.option("header", True).option("sep", ";").csv(path)


# --- JSON rules ------------------------------------------------------------------------------------------------


def _rules(spark, d):
    p = table(spark, d, "part")
    s, r = F.col("p_size"), F.col("p_retailprice")
    strength = lambda a, b: F.struct(F.struct(a.alias("fatigue_strength"), b.alias("yield_strength")).alias("safety"))
    safe = lambda at, k: F.struct(at.alias("position"), F.struct(F.struct(k.alias("s")).alias("key")).alias("safety"))
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("machine_id"),
            F.struct(s.alias("voltage"), F.lit("x").alias("username"), s.alias("ok")).alias("load"),
            F.struct(F.array(strength(s, s + 1), strength(s + 2, s + 5)).alias("output")).alias("shaft_safety"),
            F.struct(F.array(safe(s, s + 1), safe(s + 3, s + 4)).alias("output")).alias("parallelkey_safety"),
            F.struct(F.struct(F.array(F.struct(F.col("p_brand").alias("name"), F.struct(r.alias("r")).alias("f")), F.struct(F.lit("other").alias("name"), F.struct(r.alias("r")).alias("f"))).alias("DE")).alias("output")).alias("roller_bearings"),
            F.struct(F.struct(F.struct(F.struct(s.alias("d")).alias("zeta"), F.lit("ball").alias("type"), F.struct((s + 1).alias("d")).alias("alpha")).alias("bearing_properties")).alias("input")).alias("RotorWorkflow"),
            F.struct(F.array(*(F.struct(F.lit(i).alias("x")) for i in range(4))).alias("many"), F.array(F.lit("a"), F.lit("b")).alias("texts")).alias("dropped"),
        )
    )
    return p.select(F.col("p_partkey").cast("string").alias("name"), doc.alias("text"))


@query("""WITH p AS (SELECT *, CAST(p_size AS DOUBLE) AS s FROM part), v AS (SELECT 'M' || p_partkey AS entity_id, unnest([
   {'k': 'machine_id', 'n': NULL, 't': 'M' || p_partkey}, {'k': 'load.ok', 'n': s, 't': NULL}, {'k': 'shaft_safety.output._count', 'n': 2, 't': NULL},
   {'k': 'shaft_safety.output.fatigue_strength._min', 'n': s, 't': NULL}, {'k': 'shaft_safety.output.fatigue_strength._max', 'n': s + 2, 't': NULL}, {'k': 'shaft_safety.output.fatigue_strength._mean', 'n': s + 1, 't': NULL},
   {'k': 'shaft_safety.output.yield_strength._min', 'n': s + 1, 't': NULL}, {'k': 'shaft_safety.output.yield_strength._max', 'n': s + 5, 't': NULL}, {'k': 'shaft_safety.output.yield_strength._mean', 'n': s + 3, 't': NULL},
   {'k': 'parallelkey_safety.output._count', 'n': 2, 't': NULL}, {'k': 'parallelkey_safety.output.position', 'n': s + 3, 't': NULL}, {'k': 'parallelkey_safety.output.safety.key.s', 'n': s + 4, 't': NULL},
   {'k': 'roller_bearings.output.DE.name', 'n': NULL, 't': p_brand}, {'k': 'roller_bearings.output.DE.f.r', 'n': p_retailprice, 't': NULL},
   {'k': 'RotorWorkflow.input.bearing_properties.bearing_1.d', 'n': s, 't': NULL}, {'k': 'RotorWorkflow.input.bearing_properties.type', 'n': NULL, 't': 'ball'}, {'k': 'RotorWorkflow.input.bearing_properties.bearing_2.d', 'n': s + 1, 't': NULL}]) AS x FROM p)
 SELECT entity_id, x.k AS parameter, round(CAST(x.n AS DOUBLE), 4) AS value_num, x.t AS value_str FROM v""")
def json_rules(spark, d):
    """Skipped paths, safety lists, bearings and dropped lists."""
    flat = flatten.values_of(flatten.flatten_json(_rules(spark, d), F.col("text"), F.col("name")))
    return rounded(flat.select("entity_id", "parameter", "value_num", "value_str"), digits=4)


@query("SELECT p_partkey AS k, ['{' || p_brand || ', b }', '{}', p_type][CAST(p_partkey % 3 AS INT) + 1] AS text, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|b' WHEN 1 THEN '' ELSE p_type END AS items FROM part")
def enum_lists(spark, d):
    text = F.element_at(F.array(F.concat(F.lit("{"), "p_brand", F.lit(", b }")), F.lit("{}"), F.col("p_type")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.alias("text"), F.array_join(C.enum_values(text), "|").alias("items"))


@query("SELECT c_custkey AS k, greatest(0, c_acctbal) AS relu FROM customer")
def relu_values(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), C.relu(F.col("c_acctbal")).alias("relu"))


# --- generator -------------------------------------------------------------------------------------------------

RANGES = {s[0]: generate.numeric_range(s[4], s[0]) for s in SPECS if s[3] == "numeric"}


@query(f"""WITH n AS (SELECT count(*) AS n FROM supplier), s AS (SELECT unnest([{", ".join(f"'{s[0]}'" for s in SPECS)}]) AS "Parameter_ID")
 SELECT s."Parameter_ID", n.n AS n_rows, n.n AS n_entities, true AS ids, true AS in_range, true AS missing_is_empty, true AS rate FROM n, s""")
def generator_invariants(spark, d):
    """Of generated rows, by parameter: every entity once, ids D001 and up, values in their range or list, empty where missing, and a share of
    missing values within six standard deviations of the rate."""
    n = table(spark, d, "supplier").count()
    g = generate.generate(spark, SPECS, n, seed=42, missing_rate=0.05)
    lists = {"boolean": generate.BOOLEANS, "text": generate.FITS, "enum": ["axial", "radial"]}
    fine = F.lit(False)
    for parameter, _, _, kind, _, _ in SPECS:
        own = F.col("Value").try_cast("double").between(*RANGES[parameter]) if kind == "numeric" else F.col("Value").isin(lists[kind])
        fine = fine | (F.col("Parameter_ID") == parameter) & own
    number = F.regexp_extract("Design_ID", r"^D(\d{3,})$", 1).cast("int")
    missing = F.col("IsMissing") == 1
    out = g.groupBy("Parameter_ID").agg(
        F.count("*").alias("n_rows"), F.countDistinct("Design_ID").alias("n_entities"), F.bool_and(number.between(1, n)).alias("ids"), F.bool_and(missing | fine).alias("in_range"),
        F.bool_and(missing == (F.col("Value") == "")).alias("missing_is_empty"), F.avg("IsMissing").alias("share"),
    )
    return out.withColumn("rate", F.abs(F.col("share") - 0.05) <= 6 * (0.05 * 0.95 / n) ** 0.5).drop("share")


# --- learned methods -------------------------------------------------------------------------------------------

NORMED = f"{EMB}, nv AS (SELECT vec_id, CASE WHEN n = 0 THEN v ELSE list_transform(v, lambda x: x / n) END AS v FROM em), c0 AS (SELECT vec_id AS cid, v FROM nv WHERE vec_id < 5)"


def _round_sql(i: int) -> str:
    return f"""l{i} AS (SELECT vec_id, cid FROM (SELECT x.vec_id, c.cid, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_inner_product(x.v, c.v) DESC, c.cid) AS r FROM nv x CROSS JOIN c{i - 1} c) WHERE r = 1),
 m{i} AS (SELECT cid, list(m ORDER BY i) AS v FROM (SELECT cid, i, avg(x) AS m FROM (SELECT cid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM l{i} JOIN nv USING (vec_id)) GROUP BY cid, i) GROUP BY cid),
 c{i} AS (SELECT cid, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM m{i})"""


LOOP = f"{NORMED}, {_round_sql(1)}, {_round_sql(2)}, {_round_sql(3)}"


def _three_rounds(spark, d):
    v = from_embeddings(table(spark, d, "embeddings"))
    return v, E.spherical_kmeans(v, max_iter=3, initial=[0, 1, 2, 3, 4])


@query(f"WITH {LOOP} SELECT vec_id AS entity_id, CAST(cid AS INT) AS cluster FROM l3")
def kmeans_loop(spark, d):
    """Three rounds of the loop from given rows."""
    return _three_rounds(spark, d)[1].labels.select("entity_id", "cluster")


@query(f"""WITH {LOOP}, q AS (SELECT nv.v, c.v AS c, cid FROM nv JOIN l3 USING (vec_id) JOIN c3 c USING (cid) WHERE vec_id = 7),
 s AS (SELECT nv.vec_id AS entity_id, CASE WHEN l3.cid = q.cid THEN (list_inner_product(nv.v, q.v) + 1) / 2 ELSE 0.5 * (list_inner_product(c.v, q.c) + 1) / 2 END AS sim
   FROM nv JOIN l3 USING (vec_id) JOIN c3 c USING (cid), q WHERE nv.vec_id <> 7)
 SELECT entity_id, round(sim, 6) AS sim FROM s ORDER BY sim DESC, entity_id LIMIT 20""")
def kmeans_loop_topk(spark, d):
    """Similarity by clusters after three rounds: the pair's own cosine in one cluster, half of the centroids' across."""
    v, model = _three_rounds(spark, d)
    scores = E.kmeans_scores(v, 7, {GEOMETRY: 1.0}, models={GEOMETRY: model})
    return rounded(scores.orderBy(F.desc("sim_total"), "entity_id").limit(20).select("entity_id", F.col("sim_total").alias("sim")))


@query(f"""WITH {EMB}, x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM em), t AS (SELECT sum(v) AS total FROM (SELECT var_pop(x) AS v FROM x GROUP BY i))
 SELECT CAST(i AS INT) AS i, true AS falling, true AS centred, round(total, 4) AS total, true AS enough FROM t, range(16) r(i)""")
def pca_variance(spark, d):
    """Of 16 principal components: variances fall, means are 0, together they hold a quarter of the variance of all 64 dimensions or more;
    the 64 components hold it all."""
    v = from_embeddings(table(spark, d, "embeddings"))

    def variances(latent):
        cells = E.pca_embeddings(v, latent).select(F.posexplode("vec").alias("i", "x"))
        return kept(cells.groupBy("i").agg(F.var_pop("x").alias("variance"), F.avg("x").alias("mean")), "variances")

    total = variances(64).agg(F.sum("variance")).first()[0]
    some = variances(16)
    share = some.agg(F.sum("variance")).first()[0] / total
    before = F.lag("variance").over(Window.orderBy("i"))  # 16 rows
    return some.select(
        "i",
        F.coalesce(F.col("variance") <= before * (1 + 1e-9), F.lit(True)).alias("falling"),
        (F.abs("mean") < 1e-6).alias("centred"),
        F.lit(round(total, 4)).alias("total"),
        F.lit(share >= 16 / 64).alias("enough"),
    )


@query("SELECT 'K_GEOM_MECH' AS category, (SELECT count(*) FROM embeddings) AS n, 8 AS n_dims, true AS finite, true AS repeatable, true AS better_than_mean")
def autoencoder_invariants(spark, d):
    """Latent vectors of the autoencoder: one a row, of the size asked for, finite, the same each time, and nearer for near vectors: their cosine
    with the query's rises with that of the vectors themselves."""
    v = from_embeddings(table(spark, d, "embeddings"))
    a, b = (kept(E.autoencoder_embeddings(v, latent=8, max_iter=60), "latent") for _ in range(2))
    same = a.join(b.withColumnRenamed("vec", "again"), ["entity_id", "category"]).filter(F.col("vec") != F.col("again")).limit(1).count() == 0
    own, far = (vectors.dense_scores(x, 7, {GEOMETRY: 1.0}).select("entity_id", F.col("sim_total").alias(n)) for x, n in ((a, "latent"), (v, "plain")))
    rho = own.join(far, "entity_id").agg(F.corr("latent", "plain")).first()[0]
    out = a.groupBy("category").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("n_dims"), F.bool_and(F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6))).alias("finite"))
    return out.withColumn("repeatable", F.lit(same)).withColumn("better_than_mean", F.lit(rho > 0.1))


# Tail of the normal distribution, to which the t distribution with as many degrees of freedom as there are pairs has come; by the series of erf.
@query(ORACLE_SQL["spearman_methods"].replace("SELECT y.method, round(corr(y.rank, x.rank), 6) AS rho, count(*) AS n", "SELECT y.method, round(corr(y.rank, x.rank), 6) AS rho, count(*) AS n, abs(corr(y.rank, x.rank)) * sqrt((count(*) - 2) / (1 - corr(y.rank, x.rank) ** 2)) > 6 AS significant"))
def spearman_significance(spark, d):
    """Rank correlations with p values: p is below 1e-8 exactly where t exceeds 6 (to 1e-8 or so, at thousands of pairs)."""
    out = ranks.spearman_table(_supplier_blocks(spark, d), "rule")
    return rounded(out.withColumn("significant", F.col("p") < 1e-8).drop("p"), "rho")


@query("SELECT count(*) AS n_pairs, 6 AS n_methods, true AS bounded, true AS hybrid_is_the_weighted_sum FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def method_pairs_invariants(spark, d):
    """All five methods and their combination over the pairs of 25 entities: as many pairs each, between 0 and 1, and the combination is the weighted sum."""
    from ..model import melt
    from ..operators import hybrid

    n = table(spark, d, "nation")
    f = melt(n.withColumn("size", F.col("n_regionkey") * 2.5), "n_nationkey", [("n_regionkey", "C_A", "P_REGION", "GEOM", "num"), ("size", "C_A", "P_SIZE", "GEOM", "num"), ("n_name", "C_B", "P_NAME", "MTRL", "str")])
    pairs = kept(hybrid.method_pairs(f, latent=2, clusters=2, hybrid={"rule": 0.5, "vector": 0.5}), "pairs")
    wide = pairs.groupBy("a", "b").agg(F.countDistinct("method").alias("n"), F.min("sim").alias("low"), F.max("sim").alias("high"), *(F.max(F.when(F.col("method") == m, F.col("sim"))).alias(m) for m in ("rule", "vector", "hybrid")))
    return wide.agg(
        F.count("*").alias("n_pairs"), F.max("n").cast("int").alias("n_methods"), F.bool_and((F.col("low") >= -1e-9) & (F.col("high") <= 1 + 1e-9)).alias("bounded"),
        F.bool_and(F.abs(F.col("hybrid") - (F.col("rule") + F.col("vector")) / 2) < 1e-9).alias("hybrid_is_the_weighted_sum"),
    )
