"""One registered query for each operator of the engine, and its SQL where SQL can say it.

Similarities are rounded to 6 decimals on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import CATEGORIES, DEFAULT_WEIGHTS, GEOMETRY, SHORT, category, from_embeddings
from ..operators import embeddings as E
from ..operators import blocks, flatten, generate, graph, hybrid, ranks, rule, validate, vectors, weights
from ..operators import profile as P
from ..sources import writers
from . import inputs as I
from .inputs import QUERY_ID, table

DIGITS = 6
SIMS = [f"sim_{SHORT[c]}" for c in CATEGORIES] + ["sim_total"]


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    names = names or tuple(c for c, kind in df.dtypes if kind == "double")
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- SQL of the similarity operators ---------------------------------------------------------------------------

STATS = "st AS (SELECT component, param, min(num) AS lo, max(num) AS hi FROM f WHERE num IS NOT NULL GROUP BY ALL)"


def sim_sql(x: str, y: str) -> str:
    """Similarity of two joined feature rows; a side without a row has a null ``param``."""
    none = lambda t: f"({t}.num IS NULL AND {t}.str IS NULL)"
    return f"""CASE WHEN {x}.param IS NULL OR {y}.param IS NULL THEN 0.0::DOUBLE WHEN {none(x)} AND {none(y)} THEN NULL WHEN {none(x)} OR {none(y)} THEN 0.0::DOUBLE
      WHEN {x}.num IS NOT NULL AND {y}.num IS NOT NULL THEN CASE WHEN st.hi = st.lo THEN CASE WHEN {x}.num = {y}.num THEN 1.0 ELSE 0.0 END::DOUBLE
        ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs({x}.num - {y}.num) / (st.hi - st.lo))) END
      ELSE CASE WHEN trim({x}.str) = trim({y}.str) THEN 1.0 ELSE 0.0 END::DOUBLE END"""


def total_sql(name: str = "sim_") -> str:
    return "(" + " + ".join(f"{DEFAULT_WEIGHTS[c]} * {name}{SHORT[c]}" for c in CATEGORIES) + f") / {sum(DEFAULT_WEIGHTS.values())}"


def wide_sql(keys: str, source: str, default: float, how: str = "avg(sim)") -> str:
    """Categories as columns from rows (keys, cat, sim)."""
    cols = ", ".join(f"coalesce({how} FILTER (WHERE cat = '{c}'), {default}::DOUBLE) AS sim_{SHORT[c]}" for c in CATEGORIES)
    return f"SELECT {keys}, {cols} FROM {source} GROUP BY {keys}"


def rule_sql(features: str, q: str = QUERY_ID) -> str:
    return f"""f AS ({features}), {STATS}, q AS (SELECT * FROM f WHERE entity_id = '{q}'), e AS (SELECT DISTINCT entity_id FROM f WHERE entity_id <> '{q}'),
 k AS (SELECT e.entity_id, q.component, q.param FROM e CROSS JOIN q UNION SELECT entity_id, component, param FROM f WHERE entity_id <> '{q}'),
 s AS (SELECT k.entity_id, coalesce(q.cat, t.cat) AS cat, {sim_sql("q", "t")} AS sim FROM k LEFT JOIN q ON q.component = k.component AND q.param = k.param
       LEFT JOIN f t ON t.entity_id = k.entity_id AND t.component = k.component AND t.param = k.param
       LEFT JOIN st ON st.component = k.component AND st.param = k.param),
 rw AS ({wide_sql("entity_id", "s", 0.0)}), r AS (SELECT *, {total_sql()} AS sim_total FROM rw)"""


ROUND_SIMS = ", ".join(f"round({s}, {DIGITS}) AS {s}" for s in SIMS)
TOP5 = f"SELECT entity_id, {ROUND_SIMS} FROM {{}} ORDER BY {{}}.sim_total DESC, entity_id LIMIT 5"


def top5(name: str) -> str:
    return TOP5.format(name, name)


def vector_sql(features: str) -> str:
    """Cells ``v(entity_id, cat, component, param, slot, val)`` of the vectors, without zeros."""
    return f"""f AS ({features}), {STATS},
 p AS (SELECT DISTINCT cat, component, param, num IS NULL AS texts FROM f WHERE num IS NOT NULL OR str IS NOT NULL),
 vs AS (SELECT DISTINCT component, param, trim(str) AS v FROM f WHERE num IS NULL AND trim(str) <> ''),
 w AS (SELECT e.entity_id, p.cat, p.component, p.param, t.num, st.lo, st.hi,
        CASE WHEN texts THEN '=' || coalesce(vs.v, '<MISSING>') WHEN t.num IS NULL THEN 'num_missing' ELSE 'num' END AS slot
       FROM (SELECT DISTINCT entity_id FROM f) e CROSS JOIN p LEFT JOIN f t ON t.entity_id = e.entity_id AND t.component = p.component AND t.param = p.param
       LEFT JOIN vs ON vs.component = p.component AND vs.param = p.param AND vs.v = trim(t.str) LEFT JOIN st ON st.component = p.component AND st.param = p.param),
 v AS (SELECT entity_id, cat, component, param, slot, CASE WHEN slot <> 'num' THEN 1.0::DOUBLE WHEN hi > lo THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (num - lo) / (hi - lo))) ELSE 0.5::DOUBLE END AS val FROM w),
 vn AS (SELECT entity_id, cat, sqrt(sum(val * val)) AS n FROM v GROUP BY ALL)"""


def vector_scores_sql(q: str = QUERY_ID) -> str:
    return f"""vd AS (SELECT x.entity_id, x.cat, sum(x.val * y.val) AS dot FROM v x JOIN v y USING (cat, component, param, slot) WHERE y.entity_id = '{q}' AND x.entity_id <> '{q}' GROUP BY ALL),
 vc AS (SELECT a.entity_id, a.cat, (coalesce(dot / nullif(a.n * b.n, 0), 0) + 1) / 2 AS sim FROM vn a JOIN vn b ON a.cat = b.cat AND b.entity_id = '{q}'
        LEFT JOIN vd ON vd.entity_id = a.entity_id AND vd.cat = a.cat WHERE a.entity_id <> '{q}'),
 vw AS ({wide_sql("entity_id", "vc", 0.5, "max(sim)")}), vr AS (SELECT *, {total_sql()} AS sim_total FROM vw)"""


# --- statistics and rules --------------------------------------------------------------------------------------


@query(f"SELECT component, param, min(num) AS vmin, max(num) AS vmax FROM ({I.PART} UNION ALL {I.CUSTOMER}) WHERE num IS NOT NULL GROUP BY ALL")
def numeric_stats(spark, d):
    return rule.numeric_stats(I.part_features(spark, d).unionAll(I.customer_features(spark, d)))


@query(f"WITH {rule_sql(I.PART)} {top5('r')}")
def rule_topk(spark, d):
    return rounded(rule.rule_top_k(I.part_features(spark, d), QUERY_ID))


@query(f"WITH {rule_sql(I.SPARSE)} {top5('r')}")
def rule_topk_sparse(spark, d):
    return rounded(rule.rule_top_k(I.sparse_features(spark, d), QUERY_ID))


@query(f"WITH {rule_sql(I.SPARSE)} SELECT entity_id, {ROUND_SIMS} FROM r")
def rule_scores_sparse(spark, d):
    return rounded(rule.rule_scores(I.sparse_features(spark, d), QUERY_ID))


RULE_PAIRS = f"""f AS ({I.SUPPLIER}), {STATS}, pk AS (SELECT DISTINCT x.entity_id AS a, y.entity_id AS b, k.component, k.param FROM (SELECT DISTINCT entity_id FROM f) x
  JOIN (SELECT DISTINCT entity_id FROM f) y ON x.entity_id < y.entity_id JOIN f k ON k.entity_id IN (x.entity_id, y.entity_id)),
 s AS (SELECT pk.a, pk.b, coalesce(x.cat, y.cat) AS cat, {sim_sql("x", "y")} AS sim FROM pk LEFT JOIN f x ON x.entity_id = pk.a AND x.component = pk.component AND x.param = pk.param
   LEFT JOIN f y ON y.entity_id = pk.b AND y.component = pk.component AND y.param = pk.param LEFT JOIN st ON st.component = pk.component AND st.param = pk.param),
 rw AS ({wide_sql("a, b", "s", 0.0)}), rp AS (SELECT *, {total_sql()} AS sim_total FROM rw)"""


@query(f"WITH {RULE_PAIRS} SELECT a, b, {ROUND_SIMS} FROM rp")
def rule_pairs(spark, d):
    return rule.rule_pairs(I.supplier_features(spark, d), digits=DIGITS)


# --- vectors ---------------------------------------------------------------------------------------------------

DIMS = """dm AS (SELECT DISTINCT cat, component, param, texts, slot FROM (
   SELECT p.*, unnest(CASE WHEN texts THEN ['=<MISSING>'] ELSE ['num', 'num_missing'] END) AS slot FROM p
   UNION ALL SELECT p.*, '=' || vs.v FROM p JOIN vs USING (component, param) WHERE p.texts)),
 di AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY texts, component, param, slot = '=<MISSING>', slot) - 1 AS idx FROM dm)"""


@query(f"WITH {vector_sql(I.PART)}, {DIMS} SELECT cat AS category, component, param, slot, CAST(idx AS INT) AS idx FROM di")
def feature_dims(spark, d):
    return vectors.feature_dims(I.part_features(spark, d))


@query(f"WITH {vector_sql(I.SPARSE)}, {DIMS} SELECT entity_id, cat AS category, CAST(idx AS INT) AS idx, round(val, {DIGITS}) AS val FROM v JOIN di USING (cat, component, param, slot) WHERE val <> 0")
def feature_vectors(spark, d):
    return rounded(vectors.feature_vectors(I.sparse_features(spark, d)))


@query(f"WITH {vector_sql(I.PART)}, {vector_scores_sql()} {top5('vr')}")
def vector_topk(spark, d):
    return rounded(vectors.vector_top_k(I.part_features(spark, d), QUERY_ID))


@query(f"WITH {vector_sql(I.SPARSE)}, {vector_scores_sql()} SELECT entity_id, {ROUND_SIMS} FROM vr")
def vector_scores_sparse(spark, d):
    return rounded(vectors.vector_scores(vectors.feature_vectors(I.sparse_features(spark, d)), QUERY_ID))


VECTOR_PAIRS = f"""{vector_sql(I.SUPPLIER)},
 pd AS (SELECT x.entity_id AS a, y.entity_id AS b, x.cat, sum(x.val * y.val) AS dot FROM v x JOIN v y USING (cat, component, param, slot) WHERE x.entity_id < y.entity_id GROUP BY ALL),
 pc AS (SELECT x.entity_id AS a, y.entity_id AS b, x.cat, (coalesce(dot / nullif(x.n * y.n, 0), 0) + 1) / 2 AS sim FROM vn x JOIN vn y ON x.cat = y.cat AND x.entity_id < y.entity_id
        LEFT JOIN pd ON pd.a = x.entity_id AND pd.b = y.entity_id AND pd.cat = x.cat),
 pw AS ({wide_sql("a, b", "pc", 0.5, "max(sim)")}), vp AS (SELECT *, {total_sql()} AS sim_total FROM pw)"""


@query(f"WITH {VECTOR_PAIRS} SELECT a, b, {ROUND_SIMS} FROM vp")
def vector_pairs(spark, d):
    return vectors.vector_pairs(vectors.feature_vectors(I.supplier_features(spark, d)), digits=DIGITS)


EMB = "em AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"
EMB_COS = "coalesce(list_inner_product(x.v, y.v) / nullif(x.n * y.n, 0), 0)"


@query(f"WITH {EMB} SELECT x.vec_id AS entity_id, round(({EMB_COS} + 1) / 2, {DIGITS}) AS sim FROM em x, em y WHERE y.vec_id = 7 AND x.vec_id <> 7 ORDER BY ({EMB_COS} + 1) / 2 DESC, x.vec_id LIMIT 5")
def embedding_topk(spark, d):
    v = from_embeddings(table(spark, d, "embeddings"))
    scores = vectors.dense_scores(v, 7, {GEOMETRY: 1.0})
    return rounded(rule.top_k(scores, 5).select("entity_id", F.col("sim_total").alias("sim")))


EMB_PAIRS = f"ep AS (SELECT x.vec_id AS a, y.vec_id AS b, ({EMB_COS} + 1) / 2 AS sim FROM em x JOIN em y ON x.vec_id < y.vec_id)"


@query(f"""WITH {EMB}, {EMB_PAIRS}, bo AS (SELECT a, b, sim FROM ep UNION ALL SELECT b, a, sim FROM ep),
 rk AS (SELECT a, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rank, b, sim FROM bo) SELECT a, CAST(rank AS INT) AS rank, b, round(round(sim, 9), {DIGITS}) AS sim FROM rk WHERE rank <= 10""")
def embedding_topk_per_entity(spark, d):
    return rounded(vectors.dense_top_k(from_embeddings(table(spark, d, "embeddings")), 10, 9))


# --- learned embeddings ----------------------------------------------------------------------------------------


def _part_dense(spark, d):
    f = I.part_features(spark, d)
    dims = vectors.feature_dims(f)
    return vectors.dense(vectors.feature_vectors(f, dims), dims)


@query(f"""WITH {vector_sql(I.PART)}, {DIMS}, mn AS (SELECT cat, component, param, slot, sum(val) / (SELECT count(DISTINCT entity_id) FROM f) AS m FROM v GROUP BY ALL),
 ce AS (SELECT e.entity_id, di.cat, component, param, slot, coalesce(v.val, 0) - coalesce(mn.m, 0) AS val FROM (SELECT DISTINCT entity_id FROM f) e CROSS JOIN di
        LEFT JOIN v USING (entity_id, cat, component, param, slot) LEFT JOIN mn USING (cat, component, param, slot)),
 cn AS (SELECT entity_id, cat, sqrt(sum(val * val)) AS n FROM ce GROUP BY ALL),
 cd AS (SELECT x.entity_id, x.cat, sum(x.val * y.val) AS dot FROM ce x JOIN ce y USING (cat, component, param, slot) WHERE y.entity_id = '{QUERY_ID}' AND x.entity_id <> '{QUERY_ID}' GROUP BY ALL),
 cs AS (SELECT cd.entity_id, cd.cat, (coalesce(dot / nullif(a.n * b.n, 0), 0) + 1) / 2 AS sim FROM cd JOIN cn a ON a.entity_id = cd.entity_id AND a.cat = cd.cat JOIN cn b ON b.entity_id = '{QUERY_ID}' AND b.cat = cd.cat),
 cw AS ({wide_sql("entity_id", "cs", 0.5, "max(sim)")}), cr AS (SELECT *, {total_sql()} AS sim_total FROM cw) {top5('cr')}""")
def pca_fullrank_topk(spark, d):
    return rounded(E.pca_top_k(_part_dense(spark, d), QUERY_ID, latent=None))


@query()
def pca_topk(spark, d):
    return E.pca_top_k(from_embeddings(table(spark, d, "embeddings")), 7, weights={GEOMETRY: 1.0}, latent=16)


@query(f"""WITH {EMB}, nv AS (SELECT vec_id, CASE WHEN n = 0 THEN v ELSE list_transform(v, lambda x: x / n) END AS v FROM em),
 sc AS (SELECT x.vec_id, c.vec_id AS cid, list_inner_product(x.v, c.v) AS s FROM nv x CROSS JOIN nv c WHERE c.vec_id < 5),
 rk AS (SELECT vec_id, cid, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cid) AS r FROM sc) SELECT vec_id AS entity_id, CAST(cid AS INT) AS cluster FROM rk WHERE r = 1""")
def kmeans_assign_fixed(spark, d):
    v = from_embeddings(table(spark, d, "embeddings"))
    return E.spherical_kmeans(v, max_iter=1, initial=[0, 1, 2, 3, 4]).labels.select("entity_id", "cluster")


@query()
def kmeans_topk(spark, d):
    return E.kmeans_top_k(from_embeddings(table(spark, d, "embeddings")), 7, weights={GEOMETRY: 1.0}, clusters=8)


@query()
def autoencoder_topk(spark, d):
    f = I.supplier_features(spark, d)
    dims = vectors.feature_dims(f)
    return E.autoencoder_top_k(vectors.dense(vectors.feature_vectors(f, dims), dims), QUERY_ID, latent=8, max_iter=150)


HYBRID = {"rule": 0.6, "vector": 0.3}


@query(f"""WITH {rule_sql(I.PART)}, {vector_sql(I.PART)[vector_sql(I.PART).index(" p AS"):]}, {vector_scores_sql()},
 h AS (SELECT entity_id, {", ".join(f"0.6 * r.{s} + 0.3 * vr.{s} AS {s}" for s in SIMS)} FROM r JOIN vr USING (entity_id)) {top5('h')}""")
def hybrid_topk(spark, d):
    return rounded(hybrid.hybrid_top_k(I.part_features(spark, d), QUERY_ID, HYBRID).drop("by_method"))


@query()
def compare_methods(spark, d):
    return hybrid.compare_methods(I.supplier_features(spark, d), QUERY_ID, latent=4, clusters=4)


# --- validation ------------------------------------------------------------------------------------------------


def _supplier_blocks(spark, d):
    f = I.supplier_features(spark, d)
    rule.one_type(f)
    cells = blocks.rule_cells(f, rule.numeric_stats(f)).unionAll(blocks.vector_cells(vectors.feature_vectors(f)))
    return blocks.Pairs(cells, (blocks.RULE, blocks.VECTOR), digits=9)


PAIRS = f"""{RULE_PAIRS}, {VECTOR_PAIRS[VECTOR_PAIRS.index(" p AS"):]},
 pr AS (SELECT a, b, 'rule' AS method, round(sim_total, 9) AS sim FROM rp UNION ALL SELECT a, b, 'vector', round(sim_total, 9) FROM vp)"""
STATS_SQL = "ps AS (SELECT method, count(*) AS n_pairs, avg(sim) AS mean, stddev_pop(sim) AS std, min(sim) AS min, max(sim) AS max FROM pr GROUP BY method)"


@query(f"WITH {PAIRS}, {STATS_SQL} SELECT method, n_pairs, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(max - min, 6) AS range, round(CASE WHEN mean > 0 THEN std / mean ELSE 0 END, 6) AS cv FROM ps")
def pair_stats(spark, d):
    return rounded(_supplier_blocks(spark, d).stats())


@query(f"WITH {PAIRS}, {STATS_SQL} SELECT arg_max(method, max - min) AS best_range, arg_max(method, std / mean) AS best_cv FROM ps")
def best_method(spark, d):
    return validate.best_methods(_supplier_blocks(spark, d).stats())


@query(f"WITH {PAIRS}, {STATS_SQL} SELECT method, CAST(least(floor((sim - min) / (max - min) * 30), 29) AS INT) AS bin, count(*) AS n FROM pr JOIN ps USING (method) GROUP BY ALL")
def pair_histogram(spark, d):
    return _supplier_blocks(spark, d).histogram()


RANKS = """rk AS (SELECT a, b, method, sim, rank() OVER (PARTITION BY method ORDER BY sim) + (count(*) OVER (PARTITION BY method, sim) - 1) / 2.0 AS rank FROM pr)"""


@query(f"WITH {PAIRS}, {RANKS} SELECT y.method, round(corr(y.rank, x.rank), 6) AS rho, count(*) AS n FROM rk x JOIN rk y USING (a, b) WHERE x.method = 'rule' AND y.method <> 'rule' GROUP BY ALL")
def spearman_methods(spark, d):
    return rounded(ranks.spearman(_supplier_blocks(spark, d), "rule"))


@query(f"WITH {PAIRS}, {RANKS} SELECT x.method AS method_a, y.method AS method_b, CASE WHEN x.method = y.method THEN 1.0::DOUBLE ELSE round(corr(x.rank, y.rank), 6) END AS rho FROM rk x JOIN rk y USING (a, b) GROUP BY x.method, y.method")
def spearman_matrix(spark, d):
    return rounded(ranks.spearman_matrix(_supplier_blocks(spark, d)))


@query(f"WITH {PAIRS} SELECT y.method, round(regr_slope(y.sim, x.sim), 6) AS slope, round(regr_intercept(y.sim, x.sim), 6) AS intercept FROM pr x JOIN pr y USING (a, b) WHERE x.method = 'rule' AND y.method <> 'rule' GROUP BY ALL")
def regression_methods(spark, d):
    return rounded(_supplier_blocks(spark, d).regression("rule"))


@query(f"""WITH {PAIRS}, bo AS (SELECT a, b, method, sim FROM pr UNION ALL SELECT b, a, method, sim FROM pr),
 tp AS (SELECT a, b, method FROM (SELECT *, row_number() OVER (PARTITION BY method, a ORDER BY sim DESC, b) AS r FROM bo) WHERE r <= 10),
 jc AS (SELECT y.a, count(x.b) AS i, count(*) AS n FROM tp y LEFT JOIN tp x ON x.a = y.a AND x.b = y.b AND x.method = 'rule' WHERE y.method = 'vector' GROUP BY y.a),
 sz AS (SELECT a, count(*) AS m FROM tp WHERE method = 'rule' GROUP BY a)
 SELECT 'vector' AS method, round(avg(i / (n + m - i)), 6) AS jaccard FROM jc JOIN sz USING (a)""")
def jaccard_top10(spark, d):
    return rounded(validate.overlap(_supplier_blocks(spark, d).best(10), "rule", 10))


@query(f"""WITH {EMB}, {EMB_PAIRS}, bo AS (SELECT a, b, greatest(0, least(1, 1 - sim)) AS d FROM ep UNION ALL SELECT b, a, greatest(0, least(1, 1 - sim)) FROM ep),
 dc AS (SELECT a, l.label AS own, m.label AS other, avg(d) AS d FROM bo JOIN embeddings l ON l.vec_id = a JOIN embeddings m ON m.vec_id = b GROUP BY ALL),
 io AS (SELECT a, min(d) FILTER (WHERE own = other) AS i, min(d) FILTER (WHERE own <> other) AS o FROM dc GROUP BY a)
 SELECT 'cosine' AS method, round(avg(CASE WHEN i IS NULL OR o IS NULL THEN 0 ELSE coalesce((o - i) / nullif(greatest(o, i), 0), 0) END), 6) AS silhouette FROM io""")
def silhouette_by_label(spark, d):
    rows = table(spark, d, "embeddings")
    pairs = vectors.dense_pairs(from_embeddings(rows)).select("a", "b", F.lit("cosine").alias("method"), "sim")
    return rounded(validate.silhouette(pairs, rows.select(F.lit("cosine").alias("method"), F.col("vec_id").alias("entity_id"), F.col("label").alias("cluster"))))


@query()
def silhouette_linkage(spark, d):
    return rounded(_supplier_blocks(spark, d).linkage_silhouette())


@query(f"WITH {PAIRS}, hp AS (SELECT a, b, 'hybrid' AS method, round(sum(CASE method WHEN 'rule' THEN 0.5 ELSE 0.3 END * sim), 6) AS sim FROM pr GROUP BY a, b) SELECT * FROM hp")
def hybrid_pairs(spark, d):
    return _supplier_blocks(spark, d).weighted({"rule": 0.5, "vector": 0.3}, to=DIGITS)


@query()
def method_pairs(spark, d):
    return hybrid.method_pairs(I.supplier_features(spark, d), latent=4, hybrid={"pca": 0.5, "kmeans": 0.5})


# --- profile ---------------------------------------------------------------------------------------------------

AREA = (
    "CASE parameter WHEN 'RotorWorkflow.input.size' THEN 'Rotor (Input)' WHEN 'RotorWorkflow.output.price' THEN 'Rotor (Output)' WHEN 'segments.brand' THEN 'Segmente' WHEN 'materials.type' THEN 'Materialien' "
    "WHEN 'machine_id.name' THEN 'Meta' WHEN 'load.price' THEN 'Lastdaten' WHEN 'operational_data.status' THEN 'Betriebsdaten' WHEN 'surface.priority' THEN 'Oberflaeche' WHEN 'rotordynamics.balance' THEN 'Rotordynamik' "
    "WHEN 'SimocalcWorkflow.input.segment' THEN 'Simocalc (Input)' ELSE 'Sonstige' END"
)
VOTE = f"vv AS ({I.VALUES}), vo AS (SELECT parameter, count(*) AS n, count(num) AS n_castable, CASE WHEN count(num) / count(*) > 0.8 THEN 'numerisch' ELSE 'kategorisch' END AS datatype FROM vv WHERE txt IS NOT NULL GROUP BY parameter)"
NUMERIC = f"""pn0 AS (SELECT parameter, vo.n, count(num) AS k, min(num) AS mn, max(num) AS mx, avg(num) AS m, coalesce(stddev_samp(num), 0) AS sd, quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.5) AS q2, quantile_cont(num, 0.75) AS q3,
   skewness(num) AS g, count(DISTINCT num) AS n_unique FROM vv JOIN vo USING (parameter) WHERE datatype = 'numerisch' GROUP BY ALL),
 pn AS (SELECT parameter, {AREA} AS area, 'numerisch' AS datatype, n, round(100.0::DOUBLE * n / ({I.PROFILE_ENTITIES}), 1) AS coverage, round(mn, 2) AS min, round(mx, 2) AS max, round(m, 2) AS mean, round(q2, 2) AS median, round(sd, 2) AS std,
   round(coalesce(sd / nullif(abs(m), 0) * 100, 0), 1) AS cv, round(q3 - q1, 2) AS iqr, round(CASE WHEN k > 2 AND sd > 0 THEN g ELSE 0 END, 2) + 0.0::DOUBLE AS skew, n_unique FROM pn0)"""
CATEGORICAL = f"""cc AS (SELECT parameter, txt, count(*) AS c FROM vv JOIN vo USING (parameter) WHERE datatype = 'kategorisch' AND txt IS NOT NULL GROUP BY ALL),
 ct AS (SELECT parameter, sum(c) AS n, count(*) AS n_unique, max(c) AS most FROM cc GROUP BY parameter),
 pk2 AS (SELECT cc.parameter, min(txt) FILTER (WHERE c = most) AS mode, sum(-(c / n) * log2(c / n)) AS entropy FROM cc JOIN ct USING (parameter) GROUP BY cc.parameter),
 pcg AS (SELECT parameter, {AREA} AS area, 'kategorisch' AS datatype, CAST(n AS BIGINT) AS n, round(100.0::DOUBLE * n / ({I.PROFILE_ENTITIES}), 1) AS coverage, n_unique, substr(mode, 1, 40) AS mode, most AS mode_count,
   round(abs(entropy), 2) AS entropy, round(log2(n_unique), 2) AS entropy_max FROM ct JOIN pk2 USING (parameter))"""
SCORED = f"""sc AS (SELECT parameter, area, datatype, coverage, n_unique,
    round(0.5 * CASE WHEN n_unique > 1 THEN least(log2(n_unique) / log2(greatest({I.PROFILE_ENTITIES}, 2)) * 100, 100) ELSE 0 END
        + 0.35 * CASE WHEN datatype = 'numerisch' THEN least(cv, 100) ELSE coalesce(entropy / nullif(entropy_max, 0) * 100, 0) END
        + 0.15 * CASE WHEN datatype = 'numerisch' THEN greatest(0, 100 - abs(skew) * 33.33) ELSE 50 END, 1) AS score
  FROM (SELECT * FROM pn UNION ALL BY NAME SELECT * FROM pcg))"""


def _profiled(spark, d):
    n = I.profile_entities(spark, d)
    return P.profile(I.profile_values(spark, d), n, exact=False), n


def _scored(spark, d):
    return P.suitability(*_profiled(spark, d), exact=False)


@query(f"WITH {VOTE} SELECT * FROM vo")
def type_vote(spark, d):
    return P.type_vote(I.profile_values(spark, d))


@query(f"WITH {VOTE}, {NUMERIC} SELECT * FROM pn")
def profile_numeric(spark, d):
    return P.profile_numeric(I.profile_values(spark, d), I.profile_entities(spark, d), exact=False)


@query(f"WITH {VOTE}, {CATEGORICAL} SELECT * FROM pcg")
def profile_categorical(spark, d):
    return P.profile_categorical(I.profile_values(spark, d), I.profile_entities(spark, d), exact=False)


@query(f"WITH {VOTE}, {NUMERIC}, {CATEGORICAL}, {SCORED} SELECT parameter, area, datatype, score FROM sc")
def suitability(spark, d):
    return _scored(spark, d).select("parameter", "area", "datatype", "score")


@query(f"WITH {VOTE}, {NUMERIC}, {CATEGORICAL}, {SCORED} SELECT area, count(*) AS n_params, round(avg(coverage), 1) AS avg_coverage, round(avg(score), 1) AS avg_score, count(*) FILTER (WHERE datatype = 'numerisch') AS n_numeric, count(*) FILTER (WHERE datatype = 'kategorisch') AS n_categorical FROM sc GROUP BY area")
def area_summary(spark, d):
    return P.area_summary(_scored(spark, d))


@query(f"WITH {VOTE}, {NUMERIC}, {CATEGORICAL}, {SCORED} SELECT CAST(least(floor(coverage / 10), 9) AS INT) AS bin, count(*) AS n FROM sc GROUP BY ALL")
def coverage_hist(spark, d):
    return P.coverage_histogram(_scored(spark, d))


@query(f"WITH {VOTE}, {NUMERIC}, {CATEGORICAL}, {SCORED} SELECT CASE WHEN coverage = 100 THEN '100 % (vollstaendig)' WHEN coverage >= 70 THEN '70-99 %' WHEN coverage >= 30 THEN '30-69 %' ELSE '< 30 %' END AS step, count(*) AS n FROM sc GROUP BY ALL")
def coverage_steps(spark, d):
    return P.coverage_steps(_scored(spark, d))


@query(f"WITH {VOTE} SELECT datatype, count(*) AS n FROM vo GROUP BY datatype")
def datatype_counts(spark, d):
    return P.datatype_counts(_scored(spark, d))


@query(f"WITH {VOTE}, {NUMERIC}, {CATEGORICAL}, {SCORED} SELECT parameter, score FROM sc ORDER BY score DESC, parameter LIMIT 30")
def report_best(spark, d):
    return P.report(_scored(spark, d))["best"].select("parameter", "score")


@query(f"SELECT component, param, round(r, 6) AS ratio, n AS n_unique FROM (SELECT component, param, coalesce(stddev_samp(num) / nullif(abs(avg(num)), 0), 0) AS r, count(DISTINCT num) AS n FROM ({I.PART} UNION ALL {I.SUPPLIER}) WHERE num IS NOT NULL GROUP BY ALL) WHERE r < 0.6 OR n <= 2")
def low_variance(spark, d):
    return rounded(P.low_variance(I.part_features(spark, d).unionAll(I.supplier_features(spark, d)), ratio=0.6))


@query(f"""WITH f AS ({I.PART} UNION ALL {I.CUSTOMER}), p AS (SELECT param, arg_min(cat, entity_id || component) AS cat FROM f GROUP BY param)
 SELECT CASE cat WHEN 'K_GEOM_MECH' THEN 'Geometrie' WHEN 'K_MTRL_PROC' THEN 'Material' ELSE 'Anforderungen' END AS label, count(*) AS n, array_to_string(list_sort(list(param)), ',') AS params FROM p GROUP BY ALL""")
def parameter_catalogue(spark, d):
    found = P.catalogue(I.part_features(spark, d).unionAll(I.customer_features(spark, d)))
    return found.withColumn("params", F.array_join("params", ","))


# --- cleaning --------------------------------------------------------------------------------------------------


@query(f"WITH {I.PATHS} SELECT parameter, n_unique, score, key FROM pd")
def clean_anti_dup(spark, d):
    return P.drop_copies(I.path_list(spark, d)).select("parameter", "n_unique", "score", "key")


@query(f"""WITH {I.PATHS}, lb AS (SELECT *, key % 3 = 0 AS known, key % 5 = 0 AS new FROM pc)
 SELECT CASE WHEN known THEN 'Bekannt (44)' WHEN new THEN 'Neu (fachlich relevant)' ELSE 'Nicht zugeordnet' END AS relevance, CASE WHEN known THEN 'P_' || key WHEN new THEN 'N_' || key ELSE '–' END AS p_name,
   CASE WHEN known THEN 'C_WELLE' WHEN new THEN 'C_LAGER' ELSE '–' END AS component, CASE WHEN known THEN 'mm' WHEN new THEN 'kg' ELSE '–' END AS unit, CASE WHEN known THEN 'Geometrie' WHEN new THEN 'Dynamik' ELSE '–' END AS heading,
   CASE WHEN known THEN 'Aus der kuratierten Parameterliste' WHEN new THEN 'neu' ELSE '–' END AS reason, parameter, n_unique, score, key FROM lb WHERE NOT (known AND key % 9 = 0)""")
def clean_labelled(spark, d):
    return P.clean(I.path_list(spark, d), *I.path_labels(spark, d))


@query(f"""WITH {I.PATHS} SELECT 'all' AS step, count(*) AS n FROM pl UNION ALL SELECT 'without copies', count(*) FROM pd UNION ALL SELECT 'without constants', count(*) FROM pd WHERE n_unique <> 1
 UNION ALL SELECT 'without identifiers', count(*) FROM pc UNION ALL SELECT 'clean', count(*) FROM pc WHERE key % 9 <> 0""")
def cleaning_counts(spark, d):
    return P.cleaning_counts(I.path_list(spark, d), *I.path_labels(spark, d))


# --- weights and graphs ----------------------------------------------------------------------------------------


@query(f"WITH {I.EDGES} SELECT * FROM ed")
def edge_parse(spark, d):
    return weights.parse_edges(I.edge_names(spark, d))


COMPONENT_WEIGHTS = """wf AS (SELECT *, percentage * CASE lower(strength) WHEN 'hoch' THEN 1.5 WHEN 'niedrig' THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM ed),
 wi AS (SELECT component, sum(w) AS w FROM (SELECT target AS component, w FROM wf UNION ALL SELECT source, 0.5 * w FROM wf) GROUP BY component),
 cw AS (SELECT component, w / sum(w) OVER () AS weight FROM wi)"""


@query(f"WITH {I.EDGES}, {COMPONENT_WEIGHTS} SELECT component, round(weight, 6) AS weight FROM cw")
def component_weights(spark, d):
    return rounded(weights.component_weights(weights.parse_edges(I.edge_names(spark, d))))


def _site_features(spark, d):
    """Features whose components are regions: some of the weights' components match one, others none."""
    f = I.supplier_features(spark, d)
    return f.withColumn("component", F.when(F.col("component") == "C_SITE", "C_EU_ROPE").otherwise("C_ASIA"))


SITE = f"sf AS (SELECT entity_id, CASE component WHEN 'C_SITE' THEN 'C_EU_ROPE' ELSE 'C_ASIA' END AS component, cat FROM ({I.SUPPLIER}))"


@query(f"""WITH {I.EDGES}, {COMPONENT_WEIGHTS}, {SITE}, own AS (SELECT component, cat, count(*) AS n FROM sf WHERE entity_id = (SELECT min(entity_id) FROM sf) GROUP BY ALL),
 sh AS (SELECT *, n / sum(n) OVER (PARTITION BY component) AS share FROM own),
 mt AS (SELECT cw.component, any_value(weight) AS weight, min(has) AS has FROM cw LEFT JOIN (SELECT DISTINCT component AS has FROM own) h
   ON contains(replace(lower(has), '_', ''), replace(lower(component), '_', '')) OR contains(replace(lower(component), '_', ''), replace(lower(has), '_', '')) GROUP BY cw.component),
 al AS (SELECT cat, weight * share AS w FROM mt JOIN sh ON sh.component = mt.has UNION ALL SELECT unnest(['K_GEOM_MECH', 'K_MTRL_PROC', 'K_REQ_ELEC']), weight / 3 FROM mt WHERE has IS NULL)
 SELECT cat AS category, round(sum(w) / (SELECT sum(w) FROM al), 6) AS weight FROM al GROUP BY cat""")
def category_weights(spark, d):
    own = weights.component_weights(weights.parse_edges(I.edge_names(spark, d)))
    return rounded(weights.category_weights(own, _site_features(spark, d)))


NS = graph.NAMESPACE
INSTANCES = f"""{I.FACTS}, tn AS (SELECT d, c, p, t, v, u, c || '_' || d AS cn, regexp_replace(p, '[ ()]', '_', 'g') || '_' || d AS pn FROM ft),
 tr AS (SELECT DISTINCT * FROM (
  SELECT '{NS}Rotor_' || d AS s, '{graph.RDF_TYPE}' AS p, '{NS}PhysicalObject' AS o, true AS o_is_iri, NULL AS datatype FROM tn
  UNION ALL SELECT '{NS}Rotor_' || d, '{graph.LABEL}', 'Rotor_' || d, false, '{graph.XSD_STRING}' FROM tn
  UNION ALL SELECT '{NS}' || cn, '{graph.RDF_TYPE}', '{NS}' || CASE c WHEN 'C_WELLE' THEN 'Welle' ELSE 'Lüfter' END, true, NULL FROM tn WHERE c <> 'C_OTHER'
  UNION ALL SELECT '{NS}' || cn, '{graph.LABEL}', cn, false, '{graph.XSD_STRING}' FROM tn WHERE c <> 'C_OTHER'
  UNION ALL SELECT '{NS}Rotor_' || d, '{NS}composed_of', '{NS}' || cn, true, NULL FROM tn WHERE c <> 'C_OTHER'
  UNION ALL SELECT '{NS}' || pn, '{graph.RDF_TYPE}', '{NS}' || p, true, NULL FROM tn
  UNION ALL SELECT '{NS}' || pn, '{graph.LABEL}', pn, false, '{graph.XSD_STRING}' FROM tn
  UNION ALL SELECT '{NS}' || pn, '{NS}hasValue', v, false, '{graph.XSD_STRING}' FROM tn
  UNION ALL SELECT '{NS}' || pn, '{NS}hasUnit', u, false, '{graph.XSD_STRING}' FROM tn
  UNION ALL SELECT '{NS}' || pn, '{NS}hasType', t, false, '{graph.XSD_STRING}' FROM tn
  UNION ALL SELECT '{NS}' || cn, '{NS}composed_of', '{NS}' || pn, true, NULL FROM tn
  UNION ALL SELECT '{NS}' || unnest(['hasValue', 'hasUnit', 'hasType']), '{graph.RDF_TYPE}', '{graph.DATATYPE_PROPERTY}', true, NULL
  UNION ALL SELECT '{NS}' || unnest(['hasValue', 'hasUnit', 'hasType']), '{graph.DOMAIN}', '{NS}Parameter', true, NULL
  UNION ALL SELECT '{NS}composed_of', '{graph.RDF_TYPE}', '{graph.OBJECT_PROPERTY}', true, NULL
  UNION ALL SELECT '{NS}composed_of', '{graph.DOMAIN}', '{NS}Artefact', true, NULL
  UNION ALL SELECT '{NS}composed_of', '{graph.RANGE}', '{NS}Parameter', true, NULL))"""


@query(f"WITH {INSTANCES} SELECT * FROM tr")
def triples_build(spark, d):
    return graph.instances(I.part_facts(spark, d))


@query(f"""WITH {I.FACTS} SELECT 'Rotor_' || d AS entity_id, c AS component, regexp_replace(p, '[ ()]', '_', 'g') AS param, try_cast(v AS DOUBLE) AS value_num, CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN v END AS value_str, u AS unit, t AS ptype
 FROM ft WHERE c <> 'C_OTHER'""")
def triples_features(spark, d):
    return graph.features_of(graph.instances(I.part_facts(spark, d)))


@query(f"""WITH {I.FACTS}, c AS (SELECT DISTINCT CASE c WHEN 'C_WELLE' THEN 'Welle' WHEN 'C_LUEFTER' THEN 'Lüfter' ELSE 'Other' END AS n FROM ft), q AS (SELECT DISTINCT p FROM ft), x AS (
  SELECT n AS name, n AS label, 'Artefact' AS parent FROM c UNION ALL SELECT replace(trim(p), ' ', '_'), p, 'Parameter' FROM q UNION ALL SELECT 'Parameter', 'Parameter', 'Object')
 SELECT DISTINCT '{NS}' || name AS s, '{graph.SUBCLASS}' AS p, '{NS}' || parent AS o, true AS o_is_iri, NULL AS datatype FROM x UNION ALL SELECT DISTINCT '{NS}' || name, '{graph.LABEL}', label, false, NULL FROM x""")
def triples_classes(spark, d):
    return graph.classes_of_facts(I.part_facts(spark, d))


@query(f"""WITH {INSTANCES} SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_is_iri THEN '<' || o || '>' ELSE '"' || o || '"' || coalesce('^^<' || datatype || '>', '') END || ' .' AS value FROM tr""")
def triples_text(spark, d):
    return writers.n_triples(graph.instances(I.part_facts(spark, d)))


@query(f"""WITH {VOTE}, {NUMERIC}, {CATEGORICAL}, {SCORED} SELECT parameter, replace(CAST(coverage AS VARCHAR), '.', ',') AS coverage, replace(CAST(score AS VARCHAR), '.', ',') AS score FROM sc""")
def profile_export(spark, d):
    return writers.german(_scored(spark, d).select("parameter", "coverage", "score"))


def _survey(spark, d):
    """Edges between components named in free text, from nations."""
    n = table(spark, d, "nation")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (by % len(words) + 1).cast("int"))
    k = F.col("n_nationkey")
    return n.select(
        pick(["Welle (lang)", "Aktivteil", "Der Lüfter", "Kunde", "Blechpaket"], k).alias("Quelle"),
        pick(["Beeinflusst", "Anfordert "], k).alias("Relation"),
        pick(["Wuchtscheiben; rot", "Wellenende", "Kosten"], k).alias("Ziel"),
        pick(["hoch", "mittel", "niedrig"], k).alias("Staerke"),
        (k / 100.0).cast("string").alias("Abhängigkeit_%"),
        F.col("n_name").alias("Notiz"),
    )


@query(f"""WITH k AS (SELECT n_nationkey AS k, n_name FROM nation),
 r AS (SELECT ['Welle', 'Aktivteil', 'Der Lüfter', 'Kunde', 'Blechpaket'][k % 5 + 1] AS source, ['C_WELLE', 'C_AKTIVTEIL', 'C_LUEFTER', NULL, 'C_BLECHPAKET'][k % 5 + 1] AS f,
   ['Beeinflusst', 'Anfordert'][k % 2 + 1] AS relation, ['Wuchtscheiben', 'Wellenende', 'Kosten'][k % 3 + 1] AS target, ['C_WUCHTSCHEIBEN', 'C_WELLE', NULL][k % 3 + 1] AS t,
   ['hoch', 'mittel', 'niedrig'][k % 3 + 1] AS strength, CAST(CAST(k AS DOUBLE) / 100 AS VARCHAR) AS percentage, n_name AS note FROM k),
 e AS (SELECT *, '{NS}' || source || '_' || relation || '_' || target || '_1' AS edge FROM r WHERE f IS NOT NULL)
 SELECT DISTINCT * FROM (SELECT '{NS}' || source || '_1' AS s, '{graph.RDF_TYPE}' AS p, '{NS}Feature' AS o, true AS o_is_iri, NULL AS datatype FROM r WHERE f IS NULL
  UNION ALL SELECT '{NS}' || target || '_1', '{graph.RDF_TYPE}', '{NS}Feature', true, NULL FROM e WHERE t IS NULL
  UNION ALL SELECT edge, '{graph.RDF_TYPE}', '{graph.OBJECT_PROPERTY}', true, NULL FROM e
  UNION ALL SELECT edge, '{graph.LABEL}', substr(edge, {len(graph.NAMESPACE) + 1}), false, '{graph.XSD_STRING}' FROM e
  UNION ALL SELECT '{NS}' || f || '_1', edge, '{NS}' || coalesce(t, target) || '_1', true, NULL FROM e
  UNION ALL SELECT edge, '{NS}hasStrength', strength, false, '{graph.XSD_STRING}' FROM e
  UNION ALL SELECT edge, '{NS}hasDependencyPercentage', percentage, false, '{graph.XSD_STRING}' FROM e
  UNION ALL SELECT edge, '{graph.COMMENT}', note, false, '{graph.XSD_STRING}' FROM e)""")
def survey_graph(spark, d):
    return graph.survey_edges(_survey(spark, d), 1)


@query("""WITH k AS (SELECT n_nationkey AS k FROM nation), r AS (SELECT ['Welle', 'Aktivteil', 'Der Lüfter', 'Kunde', 'Blechpaket'][k % 5 + 1] AS source, ['Wuchtscheiben', 'Wellenende', 'Kosten'][k % 3 + 1] AS target FROM k)
 SELECT DISTINCT source, target FROM r WHERE source <> 'Kunde'""")
def graph_edges(spark, d):
    return weights.parse_edges(graph.edges_of(graph.survey_edges(_survey(spark, d), 1))).select("source", "target")


# --- JSON ------------------------------------------------------------------------------------------------------


@query("SELECT event_id, e.key AS parameter, try_cast(e.value AS DOUBLE) AS value_num FROM events, json_each(CAST(props AS JSON)) e")
def json_flatten(spark, d):
    # Driver documents have no machine id of their own: the event's is put in front.
    rows = table(spark, d, "events")
    text = F.concat(F.lit('{"machine_id":"'), F.col("event_id").cast("string"), F.lit('",'), F.substr("props", F.lit(2)))
    flat = flatten.values_of(flatten.flatten_json(rows, text, F.col("event_id")))
    return flat.filter("parameter <> 'machine_id'").select(F.col("entity_id").cast("long").alias("event_id"), "parameter", "value_num")


def _nested(spark, d):
    p = table(spark, d, "part")
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("machine_id"),
            F.struct(F.array("p_size", "p_retailprice").alias("sizes"), F.lit(230).alias("voltage"), F.array(F.struct(F.col("p_brand").alias("brand"))).alias("parts")).alias("load"),
            F.struct(F.array(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("length")), F.struct(F.col("p_type").alias("type"), F.col("p_retailprice").alias("length"))).alias("segments")).alias("rotor"),
        )
    )
    return p.select(F.col("p_partkey").cast("string").alias("name"), doc.alias("text"))


@query("""SELECT entity_id, parameter, round(value_num, 4) AS value_num, value_str FROM (
  SELECT 'M' || p_partkey AS entity_id, unnest(['machine_id', 'load.sizes._min', 'load.sizes._max', 'load.sizes._mean', 'load.sizes._count', 'load.parts[0].brand', 'segments._total_count', 'segments._type_count',
    'segments.' || p_type || '._count', 'segments.' || p_type || '.length._sum', 'segments.' || p_type || '.length._max', 'segments.' || p_type || '.length._min']) AS parameter,
   unnest([NULL, least(p_size, p_retailprice), greatest(p_size, p_retailprice), (p_size + p_retailprice) / 2, 2, NULL, 2, 1, 2, p_size + p_retailprice, greatest(p_size, p_retailprice), least(p_size, p_retailprice)]) AS value_num,
   unnest(['M' || p_partkey, NULL, NULL, NULL, NULL, p_brand, NULL, NULL, NULL, NULL, NULL, NULL]) AS value_str FROM part)""")
def json_flatten_nested(spark, d):
    flat = flatten.values_of(flatten.flatten_json(_nested(spark, d), F.col("text"), F.col("name")))
    return rounded(flat.select("entity_id", "parameter", "value_num", "value_str"), digits=4)


@query("""SELECT 'M' || p_partkey AS entity_id, 'C_LOAD' AS component, 'P_LOAD' AS param, CAST(p_retailprice AS DOUBLE) AS value_num, CAST(NULL AS VARCHAR) AS value_str, 'kg' AS unit, 'DYN' AS ptype FROM part WHERE p_retailprice >= p_size
 UNION ALL SELECT 'M' || p_partkey, 'C_LOAD', 'P_LOAD', CAST(p_size AS DOUBLE), NULL, 'kg', 'DYN' FROM part WHERE p_retailprice < p_size
 UNION ALL SELECT 'M' || p_partkey, 'C_BRAND', 'P_BRAND', NULL, p_brand, '', 'MISC' FROM part""")
def json_features(spark, d):
    selection = spark.createDataFrame(
        [("load.sizes._min", "C_LOAD", "P_LOAD", "kg", "DYN", "numerisch", 0), ("load.sizes._max", "C_LOAD", "P_LOAD", "kg", "DYN", "numerisch", 1), ("load.parts[0].brand", "C_BRAND", "P_BRAND", "", "MISC", "kategorisch", 2)],
        "path string, component string, param string, unit string, ptype string, datatype string, ordinal long",
    )
    return flatten.select_features(flatten.flatten_json(_nested(spark, d), F.col("text"), F.col("name")), selection)


# --- names and numbers -----------------------------------------------------------------------------------------

NAMES = "SELECT p_partkey AS k, 'P_' || upper(p_name) || ['_D' || p_partkey, '_2025-11-30_' || p_partkey, '_AB', '_1QA-8Z', '_long', ''][CAST(p_partkey % 6 AS INT) + 1] AS name FROM part"


def _names(spark, d):
    k = F.col("p_partkey")
    ends = F.array(F.concat(F.lit("_D"), k), F.concat(F.lit("_2025-11-30_"), k), F.lit("_AB"), F.lit("_1QA-8Z"), F.lit("_long"), F.lit(""))
    return table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("P_"), F.upper("p_name"), F.element_at(ends, (k % 6 + 1).cast("int"))).alias("name"))


@query(f"""WITH x AS ({NAMES}), y AS (SELECT *, regexp_replace(regexp_replace(name, '_D\\d+$', ''), '_\\d{{4}}-\\d{{2}}-\\d{{2}}_\\d+$', '') AS cut, regexp_extract(name, '[^_]*$') AS last FROM x)
 SELECT k, name, CASE WHEN cut <> name THEN cut WHEN contains(name, '_') AND (contains(last, '-') OR (length(last) <= 4 AND ((upper(last) = last AND lower(last) <> last) OR regexp_full_match(last, '\\d+')))) THEN regexp_replace(name, '_[^_]*$', '') ELSE name END AS base,
   regexp_replace(name, '_[^_]*$', '') AS stripped, regexp_extract('http://x.org/g#' || name, '#(.*)$', 1) AS local FROM y""")
def name_normalize(spark, d):
    name = F.col("name")
    return _names(spark, d).select("k", "name", C.base_param(name).alias("base"), C.strip_suffix(name).alias("stripped"), C.local_name(F.concat(F.lit("http://x.org/g#"), name)).alias("local"))


NUMBER_TEXTS = ["12.5", "12,5", '"12.5"', "", "NaN", "ABC", " 1e3\t", "1.0d", "1.234,5", "-.5", "+7."]
NUMBERS = [12.5, 12.5, 12.5, None, None, None, 1000.0, None, None, -0.5, 7.0]


@query("SELECT o_orderkey AS k, [" + ", ".join("NULL" if x is None else str(x) for x in NUMBERS) + "][CAST(o_orderkey % 11 AS INT) + 1]::DOUBLE AS value FROM orders")
def safe_float(spark, d):
    text = F.element_at(F.array(*map(F.lit, NUMBER_TEXTS)), (F.col("o_orderkey") % 11 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), C.safe_float(text).alias("value"))


DETECT_TEXTS = ["Die Welle hat", "Wellenende", "AKTIVTEIL 3", "der Lüfter", "Rotor mit Lager", "unbekannt"]
DETECTED = ["C_WELLE", "C_WELLE", "C_AKTIVTEIL", "C_LUEFTER", "C_ROTOR", None]


@query("SELECT c_custkey AS k, [" + ", ".join("NULL" if x is None else f"'{x}'" for x in DETECTED) + "][CAST(c_custkey % 6 AS INT) + 1] || '_' || c_nationkey AS component FROM customer")
def component_detect(spark, d):
    text = F.element_at(F.array(*map(F.lit, DETECT_TEXTS)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), C.detect_component(text, F.col("c_nationkey")).alias("component"))


@query("""SELECT p_partkey AS k, 'P_' || upper(array_to_string(list_slice(list_filter(string_split(replace('RotorWorkflow.output.' || p_type || '.a_b.results.' || p_name, '.', '_'), '_'),
   lambda t: t <> '' AND lower(t) NOT IN ('rotorworkflow', 'edimworkflow', 'simocalcworkflow', 'output', 'input', 'results')), -5, -1), '_')) AS param FROM part""")
def param_ids(spark, d):
    path = F.concat(F.lit("RotorWorkflow.output."), F.col("p_type"), F.lit(".a_b.results."), F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), C.param_id_from_path(path).alias("param"))


@query("""SELECT o_orderkey AS k, ['GEOM', 'DYN', 'MISC', 'MTRL', 'MISC'][CAST(o_orderkey % 5 AS INT) + 1] AS ptype, ['K_GEOM_MECH', 'K_GEOM_MECH', 'K_REQ_ELEC', 'K_MTRL_PROC', 'K_REQ_ELEC'][CAST(o_orderkey % 5 AS INT) + 1] AS category,
 ['Gleitlager', 'Simocalc (Output)', 'Sonstige', 'Lager (Input)'][CAST(o_orderkey % 4 AS INT) + 1] AS area, CASE WHEN r >= 0.7 THEN 'stark' WHEN r >= 0.4 THEN 'moderat' ELSE 'schwach' END AS agreement,
 CASE WHEN abs(r) >= 0.9 THEN 'sehr stark' WHEN abs(r) >= 0.7 THEN 'stark' WHEN abs(r) >= 0.5 THEN 'moderat' WHEN abs(r) >= 0.3 THEN 'schwach' ELSE 'vernachlässigbar' END AS strength,
 CASE WHEN abs(r) < 0.001 THEN '***' WHEN abs(r) < 0.01 THEN '**' WHEN abs(r) < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM (SELECT *, (o_orderkey % 201 - 100) / 100.0::DOUBLE AS r FROM orders)""")
def labels(spark, d):
    k = F.col("o_orderkey")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    ptype = C.heading_ptype(pick(["Geometrie", "Dynamik", "?", "Material/Masse", ""]))
    path = pick(["x.sleeve_bearing.y", "SimocalcWorkflow.x", "abc", "RotorWorkflow.input.bearing_properties.x"])
    r = (k % 201 - 100) / F.lit(100.0)
    return table(spark, d, "orders").select(k.alias("k"), ptype.alias("ptype"), category(ptype).alias("category"), C.area(path).alias("area"), C.agreement(r).alias("agreement"), C.correlation_strength(r).alias("strength"), C.stars(F.abs(r)).alias("stars"))


SPECS = [
    ("P_WELLE_LAENGE", "C_WELLE", "GEOM", "numeric", "mm", ""),
    ("P_WELLE_RAUHEIT", "C_WELLE", "MFG", "numeric", "µm", ""),
    ("P_LUEFTER_AKTIV", "C_LUEFTER", "REQ", "boolean", "", ""),
    ("P_LUEFTER_TYP", "C_LUEFTER", "MTRL", "enum", "", "{axial, radial}"),
    ("P_WELLE_PASSUNG", "C_WELLE", "MFG", "text", "", ""),
]


@query()
def generate_entities(spark, d):
    return generate.generate(spark, SPECS, table(spark, d, "supplier").count(), seed=42)
