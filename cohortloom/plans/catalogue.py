"""Named queries over the star-schema tables, each with the SQL that it must agree with.

labels and documents play a cohort with outcome y and a fixed score p; lineitem
plays voxels (label: supplier), supplier, nation and region the label hierarchy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import columns as C
from cohortloom.operators import assembly, contracts, metrics, ranking, regional, resampling, spatial, splits, weights
from cohortloom.operators.quantiles import quantiles
from cohortloom.sources import sinks, stats_text
from cohortloom.sources.workspace import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DRAWS, THRESHOLDS = 50, [round(0.1 * k, 1) for k in range(1, 10)]


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def scored(spark: SparkSession, d: str) -> DataFrame:
    """row_pos, y, toxic, n_chars, lang, source, p of the labelled documents."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("row_pos"), F.col("quality").alias("y"), "toxic")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_pos"), "n_chars", "lang", "source")
    df = assembly.align(labels, docs, "row_pos", ["n_chars", "lang", "source"])
    return df.withColumn("p", C.expit(F.log1p(F.col("n_chars").cast("double")) - 6))


S = "WITH s AS (SELECT l.doc_id AS row_pos, l.quality AS y, l.toxic, d.n_chars, d.lang, d.source, 1/(1+exp(-(ln(1+d.n_chars)-6))) AS p FROM labels l JOIN documents d USING (doc_id))"


def dense(df: DataFrame) -> DataFrame:
    """df with row_pos renumbered from 0 in its order."""
    return ranking.numbered(df, [], "row_pos", [], "_k").withColumn("row_pos", F.col("_k") - 1).drop("_k")


# --- joins, projections, contracts


@query(S + " SELECT row_pos, y, n_chars, lang, source FROM s")
def q_align_cohort(spark, d):
    return scored(spark, d).select("row_pos", "y", "n_chars", "lang", "source")


@query("SELECT c.c_custkey, c.c_mktsegment, n.n_name, r.r_name, round(ln(1 + abs(c.c_acctbal)), 6) AS log_balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def q_assemble_tables(spark, d):
    cohort = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("rk"))
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("rk"), "r_name")
    df = assembly.align(assembly.align(cohort, nation, "c_nationkey", ["n_name", "rk"]), region, "rk", ["r_name"])
    return df.select("c_custkey", "c_mktsegment", "n_name", "r_name", r6(F.log1p(F.abs("c_acctbal")), "log_balance"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_missing_keys(spark, d):
    return assembly.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


DENSE = S + ", k AS (SELECT row_number() OVER (ORDER BY row_pos) - 1 AS row_pos, y, toxic, n_chars, lang, source, p FROM s)"
DRAW = f"dr AS (SELECT g AS draw, k.row_pos AS pos, (7919*g + 104729*k.row_pos + 31*g*k.row_pos) % (SELECT count(*) FROM k) AS row_pos FROM range({DRAWS}) a(g), k)"


def congruential(spark, cohort):
    return resampling.congruential_draws(spark, DRAWS, cohort.count())


@query(DENSE + ", " + DRAW + f" SELECT g AS draw, k.row_pos FROM range({DRAWS}) a(g), k WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.draw = g AND dr.row_pos = k.row_pos)")
def q_oob_rows(spark, d):
    cohort = dense(scored(spark, d))
    return resampling.out_of_bag(congruential(spark, cohort), cohort)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def q_semi_members(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return assembly.members(table(spark, d, "customer"), orders, "c_custkey").select("c_custkey", "c_mktsegment")


@query(S + " SELECT count(*) AS n_rows, count(*) FILTER (y IS NULL OR y NOT IN (0,1)) AS bad_outcome, count(*) FILTER (isinf(CAST(n_chars AS DOUBLE))) AS infinite_n_chars, count(*) FILTER (lang NOT IN ('en','de','fr')) AS unknown_lang FROM s")
def q_contract_counts(spark, d):
    return contracts.violations(scored(spark, d), contracts.input_rules(["n_chars"], {"lang": ["en", "de", "fr"]}, "y"))


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS only_left, count(*) FILTER (d.doc_id IS NULL) AS only_right, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def q_exact_set_join(spark, d):
    return contracts.key_differences(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey IS NULL) AS null_keys, 0 AS malformed_keys, count(*) - count(DISTINCT o_orderkey) AS repeated_keys FROM orders")
def q_key_rules(spark, d):
    return contracts.key_rules(table(spark, d, "orders"), "o_orderkey")


@query("SELECT o.o_orderkey, o.o_custkey, round(-o.o_totalprice, 2) AS o_totalprice, o.o_orderpriority FROM orders o")
def q_column_swap(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    variant = base.select("o_orderkey", F.round(-F.col("o_totalprice"), 2).alias("o_totalprice"))
    return assembly.swap_columns(base, variant, "o_orderkey", ["o_totalprice"])


@query("SELECT doc_id, CAST(lang = 'de' AS DOUBLE) AS lang_de, CAST(lang = 'fr' AS DOUBLE) AS lang_fr, CAST(lang = 'es' AS DOUBLE) AS lang_es FROM documents")
def q_dummy_encode(spark, d):
    return table(spark, d, "documents").select("doc_id", *assembly.reference_dummies({"lang": ["en", "de", "fr", "es"]}))


@query("SELECT doc_id, round(ln(1 + n_chars), 6) AS log_chars, CAST(round(exp(ln(1 + n_chars)) - 1) AS BIGINT) AS back FROM documents")
def q_log1p_check(spark, d):
    df = table(spark, d, "documents").withColumn("supplied", F.log1p(F.col("n_chars").cast("double")))
    kept = df.withColumn("log_chars", assembly.log_frequency("n_chars", "supplied"))
    return kept.select("doc_id", r6("log_chars", "log_chars"), F.round(F.expm1("log_chars")).cast("long").alias("back"))


@query("SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_samp(n_chars) OVER (), 6) AS z_n_chars FROM documents")
def q_zscore_samp(spark, d):
    return rounded(assembly.standardized(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars"]).select("doc_id", "z_n_chars"), "z_n_chars")


@query("SELECT doc_id, round((n_chars - avg(n_chars) OVER (PARTITION BY lang)) / stddev_pop(n_chars) OVER (PARTITION BY lang), 6) AS z FROM documents")
def q_zscore_pop(spark, d):
    z = assembly.standardized(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["n_chars"], sample=False, by=["lang"])
    return z.select("doc_id", r6("z_n_chars", "z"))


@query(S + " SELECT column_name AS column, round(share, 6) AS share, share > 0.2 AS rejected FROM (SELECT 'lang' AS column_name, avg(CAST(lang IS NULL AS INT)) AS share FROM s UNION ALL SELECT 'half', avg(CAST(n_chars % 2 = 0 AS INT)) FROM s)")
def q_missing_shares(spark, d):
    df = scored(spark, d).withColumn("half", F.when(F.col("n_chars") % 2 == 1, F.col("n_chars")))
    return rounded(contracts.missing_shares(df, ["lang", "half"]), "share")


@query("SELECT count(*) AS n_rows, count(DISTINCT (lang, source)) AS n_keys, count(*) = 80 AND count(DISTINCT (lang, source)) = 80 AS complete FROM (SELECT DISTINCT lang, source FROM documents)")
def q_complete_family(spark, d):
    return contracts.complete_family(table(spark, d, "documents").select("lang", "source").distinct(), ["lang", "source"], 80)


@query("SELECT url, NOT (url = '' OR starts_with(url, '/') OR regexp_matches(url, '[\\\\:*?\"<>|]') OR regexp_matches(url, '(^|/)\\.{1,2}(/|$)') OR regexp_matches(url, '[. ](/|$)') OR regexp_matches(url, '//|/$')) AS safe FROM (SELECT substr(url, 9) AS url FROM pages)")
def q_safe_paths(spark, d):
    return table(spark, d, "pages").select(F.expr("substring(url, 9)").alias("url")).withColumn("safe", C.safe_path(F.col("url")))


# --- regional features

V = "WITH v AS (SELECT l_suppkey AS label, l_extendedprice AS pet, l_quantity AS brainmask, l_returnflag AS subject, CAST(l_linenumber AS INT) AS k FROM lineitem)"


def voxels(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_extendedprice").alias("pet"), F.col("l_quantity").alias("brainmask"), F.col("l_returnflag").alias("subject"))


def references():
    return {"cortex": F.col("label") % 2 == 0, "brain": F.lit(True)}


@query(V + """, r AS (SELECT subject, avg(pet) FILTER (label % 2 = 0 AND brainmask > 0) AS cortex_mean, count(*) FILTER (label % 2 = 0 AND brainmask > 0) AS cortex_count,
 avg(pet) FILTER (brainmask > 0) AS brain_mean, count(*) FILTER (brainmask > 0) AS brain_count, avg(CAST(pet > 0 AS DOUBLE)) FILTER (brainmask > 0) AS positive_share FROM v GROUP BY subject)
SELECT subject, round(cortex_mean, 4) AS cortex_mean, cortex_count, round(brain_mean, 4) AS brain_mean, brain_count, positive_share,
 positive_share >= 0.95 AND cortex_mean > 0 AND cortex_count >= 500 AND brain_mean > 0 AND brain_count >= 1000 AS passed FROM r""")
def q_reference_gate(spark, d):
    out = regional.reference_gate(regional.reference_means(voxels(spark, d), references(), ["subject"]), {"cortex": 500, "brain": 1000})
    return out.withColumns({c: F.round(c, 4) for c in ("cortex_mean", "brain_mean")})


@query(V + ", r AS (SELECT subject, avg(pet) FILTER (label % 2 = 0 AND brainmask > 0) AS m FROM v GROUP BY subject) SELECT subject, label, count(*) AS n, round(sum(CAST(pet / m AS FLOAT)::DOUBLE), 3) AS total FROM v JOIN r USING (subject) GROUP BY subject, label")
def q_reference_mean_norm(spark, d):
    df = voxels(spark, d)
    out = regional.normalized(df, regional.reference_means(df, references(), ["subject"]), "cortex", ["subject"])
    return out.groupBy("subject", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("normalized").cast("double")), 3).alias("total"))


@query("""WITH v AS (SELECT l_suppkey AS label, l_shipmode_k, CASE WHEN l_quantity <= 5 THEN 0 ELSE l_extendedprice END AS pet FROM (SELECT *, l_orderkey % 20 AS l_shipmode_k FROM lineitem)),
g AS (SELECT label, l_shipmode_k AS part, count(*) AS n, count(*) FILTER (pet > 0) AS k, avg(pet) FILTER (pet > 0) AS mean, median(pet) FILTER (pet > 0) AS median FROM v GROUP BY ALL),
t AS (SELECT *, CASE WHEN n < 10 THEN 'missing_label_below_hard_minimum' WHEN k / n < 0.8 THEN 'missing_insufficient_valid_pet_fraction' WHEN n <= 24 THEN 'attention_low_label_voxels' WHEN k / n < 0.95 THEN 'attention_valid_pet_fraction' ELSE 'pass' END AS status FROM g)
SELECT label, part, n AS label_voxels, k AS valid_voxels, round(k / n, 6) AS valid_fraction, status, CASE WHEN status NOT LIKE 'missing%' THEN round(mean * k, 2) END AS valid_sum, CASE WHEN status NOT LIKE 'missing%' THEN round(median, 4) END AS median FROM t""")
def q_roi_stats(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label"), (F.col("l_orderkey") % 20).alias("part"), F.when(F.col("l_quantity") <= 5, 0.0).otherwise(F.col("l_extendedprice")).alias("pet"))
    out = regional.region_stats(df, ["label", "part"]).withColumn("valid_sum", F.round(F.col("mean") * F.col("valid_voxels"), 2)).drop("mean")
    return out.withColumns({"median": F.round("median", 4), "valid_fraction": F.round("valid_fraction", 6)})


NODES = V + """, h AS (SELECT s_suppkey AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'L' ELSE 'R' END AS side, n_name AS node, r_name AS composite FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT subject, composite, node, count(*) FILTER (side = 'L') AS nl, count(*) FILTER (side = 'R') AS nr, count(*) AS n, avg(pet) FILTER (side = 'L') AS l, avg(pet) FILTER (side = 'R') AS r, avg(pet) AS p FROM v JOIN h USING (label) GROUP BY ALL),
b AS (SELECT subject, composite, node, CASE WHEN nl >= 10 THEN l END AS l, CASE WHEN nr >= 10 THEN r END AS r, CASE WHEN n >= 10 THEN p END AS p,
  greatest(CASE WHEN nl < 10 THEN 2 WHEN nl <= 24 THEN 1 ELSE 0 END, CASE WHEN nr < 10 THEN 2 WHEN nr <= 24 THEN 1 ELSE 0 END, CASE WHEN n < 10 THEN 2 WHEN n <= 24 THEN 1 ELSE 0 END) AS sev FROM a)"""


def hierarchy(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("label"), F.when(F.col("s_suppkey") % 2 == 0, "L").otherwise("R").alias("side"), F.col("n_name").alias("node"), F.col("r_name").alias("composite"))


@query(NODES + " SELECT subject, composite, node, round(l, 4) AS left, round(r, 4) AS right, round(p, 4) AS pooled, round(2*(l-r)/(l+r), 6) AS asymmetry, CASE sev WHEN 2 THEN 'missing' WHEN 1 THEN 'attention' ELSE 'pass' END AS status FROM b".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def q_node_means(spark, d):
    out = regional.node_stats(voxels(spark, d), hierarchy(spark, d), ["subject"])
    return out.withColumns({c: F.round(c, 4) for c in ("left", "right", "pooled")} | {"asymmetry": F.round("asymmetry", 6)})


@query(NODES + " SELECT subject, composite, count(*) AS nodes, CASE WHEN count(p) = count(*) THEN round(avg(p), 4) END AS value, CASE WHEN count(p) < count(*) OR max(sev) = 2 THEN 'missing' WHEN max(sev) = 1 THEN 'attention' ELSE 'pass' END AS status FROM b GROUP BY subject, composite")
def q_node_composite(spark, d):
    return regional.composites(regional.node_stats(voxels(spark, d), hierarchy(spark, d), ["subject"]), ["subject"]).withColumn("value", F.round("value", 4))


@query("SELECT p_brand, round(sum(p_size * p_retailprice) / sum(p_size), 6) AS weighted_mean, count(*) AS n FROM part GROUP BY p_brand")
def q_area_weighted(spark, d):
    return rounded(regional.weighted_mean(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_size"), "weighted_mean")


@query("SELECT l_suppkey AS label, count(*) AS voxels, count(*) * 8.0::DOUBLE AS volume FROM lineitem GROUP BY 1")
def q_label_volumes(spark, d):
    return regional.label_volumes(voxels(spark, d).select("label"), ["label"], 8.0)


@query("SELECT o_custkey AS subject, round(sum(o_totalprice) / max(w), 9) AS normalized_volume FROM orders JOIN (SELECT o_custkey AS ck, sum(o_totalprice) + 1000 AS w FROM orders GROUP BY 1) ON ck = o_custkey GROUP BY 1")
def q_normalized_volume(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("volume"))
    whole = rows.groupBy("subject").agg((F.sum("volume") + 1000).alias("intracranial"))
    return regional.normalized_volume(rows, whole, ["subject"]).withColumn("normalized_volume", F.round("normalized_volume", 9))


@query("""WITH n AS (SELECT s_nationkey % 2 AS half, s_nationkey AS node, sum(s_acctbal * (s_suppkey + 1)) AS bv, sum(s_suppkey + 1) AS v, count(*) FILTER (s_acctbal < 0) AS negative_labels FROM supplier GROUP BY ALL),
w AS (SELECT half, sum(bv) / sum(v) AS reference FROM n GROUP BY half) SELECT half, node, round(bv / v / reference, 6) AS ratio, negative_labels FROM n JOIN w USING (half)""")
def q_weighted_reference(spark, d):
    rows = table(spark, d, "supplier").select((F.col("s_nationkey") % 2).alias("half"), F.col("s_nationkey").alias("node"), F.col("s_acctbal").alias("beta"), (F.col("s_suppkey") + 1).alias("volume"))
    return rounded(regional.weighted_reference(rows, ["half"], "node", "beta", "volume"), "ratio")


@query("SELECT label, count(*) AS faces FROM (SELECT CASE WHEN l_linenumber % 4 = l_suppkey % 4 THEN l_linenumber % 4 ELSE l_partkey % 4 END AS label FROM lineitem) GROUP BY label")
def q_face_labels(spark, d):
    faces = table(spark, d, "lineitem").select((F.col("l_partkey") % 4).alias("v1"), (F.col("l_linenumber") % 4).alias("v2"), (F.col("l_suppkey") % 4).alias("v3"))
    return regional.face_labels(faces).groupBy("label").agg(F.count(F.lit(1)).alias("faces"))


# --- cohort summaries

_NUM = "SELECT {g} AS group_name, '{f}' AS field, NULL::VARCHAR AS level, unnest(['n','mean','sd','median','q1','q3','min','max']) AS statistic, unnest([count({f})::DOUBLE, avg({f}), stddev_samp({f}), median({f}), quantile_cont({f}, 0.25), quantile_cont({f}, 0.75), min({f})::DOUBLE, max({f})::DOUBLE]) AS value FROM s {w}"
_GROUPS = (("'all'", ""), ("'responder'", "WHERE y = 1"), ("'nonresponder'", "WHERE y = 0"))


@query(S + ", u AS (" + " UNION ALL ".join(_NUM.format(g=g, f=f, w=w) for g, w in _GROUPS for f in ("n_chars", "p")) + """), c AS (SELECT * FROM (SELECT DISTINCT lang FROM s), (SELECT unnest(['all','responder','nonresponder']) AS group_name)),
k AS (SELECT group_name, 'lang' AS field, c.lang AS level, count(s.row_pos) AS k FROM c LEFT JOIN s ON s.lang = c.lang AND (group_name = 'all' OR (group_name = 'responder') = (s.y = 1)) GROUP BY ALL),
z AS (SELECT *, sum(k) OVER (PARTITION BY group_name) AS n FROM k)
SELECT group_name, field, level, statistic, round(value, 6) AS value FROM u UNION ALL SELECT group_name, field, level, unnest(['count','percent']), unnest([k::DOUBLE, round(100.0 * k / n, 6)]) FROM z""")
def q_descriptives_grouping_sets(spark, d):
    return rounded(metrics.descriptives(scored(spark, d), "y", ["n_chars", "p"], ["lang"]), "value")


@query("SELECT count(*) FILTER (quality = 0) AS zeros, count(*) FILTER (quality = 1) AS ones, CASE WHEN least(zeros, ones) // 5 >= 2 AND least(zeros, ones) - ceil(least(zeros, ones) / 5) >= 3 THEN 5 WHEN least(zeros, ones) // 4 >= 2 AND least(zeros, ones) - ceil(least(zeros, ones) / 4) >= 3 THEN 4 WHEN least(zeros, ones) // 3 >= 2 AND least(zeros, ones) - ceil(least(zeros, ones) / 3) >= 3 THEN 3 END AS folds FROM labels")
def q_fold_count_rule(spark, d):
    return splits.fold_count(table(spark, d, "labels"), "quality")


@query(S + " SELECT c.source, c.y, count(s.row_pos) AS n FROM (SELECT DISTINCT source, unnest([0, 1]) AS y FROM s) c LEFT JOIN s ON s.source = c.source AND s.y = c.y GROUP BY ALL")
def q_cell_counts(spark, d):
    return splits.cell_counts(scored(spark, d), [], "source", "y")


# --- predictions

PRED = S + ", m AS (SELECT row_pos, y, mo AS model, re AS repeat, 1/(1+exp(-(ln(1+n_chars)-6 + 0.1*((row_pos*(re+3)) % 7) - 0.3*mo*toxic))) AS p FROM s, range(3) a(mo), range(4) b(re))"


def predicted(spark, d):
    df = scored(spark, d).crossJoin(F.broadcast(spark.range(3).toDF("model"))).crossJoin(F.broadcast(spark.range(4).toDF("repeat")))
    shift = 0.1 * ((F.col("row_pos") * (F.col("repeat") + 3)) % 7) - 0.3 * F.col("model") * F.col("toxic")
    return df.select("row_pos", "y", "model", "repeat", C.expit(F.log1p(F.col("n_chars").cast("double")) - 6 + shift).alias("p"))


@query(PRED + " SELECT model, row_pos, round(avg(p), 9) AS p FROM m GROUP BY ALL")
def q_oof_mean(spark, d):
    return metrics.mean_predictions(predicted(spark, d)).withColumn("p", F.round("p", 9))


@query(S + " SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 9) AS auc, (SELECT count(*) FROM s WHERE y = 1) AS n_pos, (SELECT count(*) FROM s WHERE y = 0) AS n_neg FROM s a, s b WHERE a.y = 1 AND b.y = 0")
def q_auc_rank(spark, d):
    return metrics.auc(scored(spark, d).withColumn("g", F.lit(1)), "y", "p", ["g"]).select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


@query(S + " SELECT round(avg((y - p) * (y - p)), 9) AS brier FROM s")
def q_brier(spark, d):
    return scored(spark, d).agg(F.round(metrics.brier(F.col("y"), F.col("p")), 9).alias("brier"))


@query(PRED + ", g AS (SELECT model, repeat, p, count(*) AS n, sum(y) AS k FROM m GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY model, repeat ORDER BY p) - n + (n + 1) / 2 AS rk FROM g), a AS (SELECT model, repeat, sum(n) AS n, (sum(rk * k) - sum(k) * (sum(k) + 1) / 2) / (sum(k) * (sum(n) - sum(k))) AS auc FROM r GROUP BY ALL) SELECT model, repeat, a.n::BIGINT AS n, round(auc, 9) AS auc, round(avg((m.y - m.p) * (m.y - m.p)), 9) AS brier, 'ESTIMABLE' AS status FROM a JOIN m USING (model, repeat) GROUP BY ALL")
def q_repeat_metrics(spark, d):
    return metrics.measures(predicted(spark, d), "y", "p", ["model", "repeat"]).withColumns({"auc": F.round("auc", 9), "brier": F.round("brier", 9)})


EV = "WITH e AS (SELECT user_id, CAST(event_type = 'purchase' AS INT) AS y, 1/(1+exp(-value/100)) AS p FROM events WHERE value IS NOT NULL)"


@query(EV + ", a AS (SELECT x.user_id, avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0.0 END) AS auc FROM e x JOIN e z ON x.user_id = z.user_id AND x.y = 1 AND z.y = 0 GROUP BY 1) SELECT user_id, count(*) AS n, round(any_value(auc), 9) AS auc, round(avg((y - p) * (y - p)), 9) AS brier, CASE WHEN count(DISTINCT y) < 2 THEN 'NOT_ESTIMABLE_SINGLE_CLASS' ELSE 'ESTIMABLE' END AS status FROM e LEFT JOIN a USING (user_id) GROUP BY user_id")
def q_measures_single_class(spark, d):
    e = table(spark, d, "events").where("value is not null").select("user_id", (F.col("event_type") == "purchase").cast("int").alias("y"), C.expit(F.col("value") / 100).alias("p"))
    return metrics.measures(e, "y", "p", ["user_id"]).withColumns({"auc": F.round("auc", 9), "brier": F.round("brier", 9)})


ROC = S + ", g AS (SELECT p, sum(y) AS t, count(*) - sum(y) AS f FROM s GROUP BY p), c AS (SELECT p, sum(t) OVER w / sum(t) OVER () AS tpr, sum(f) OVER w / sum(f) OVER () AS fpr FROM g WINDOW w AS (ORDER BY p DESC)), x AS (SELECT p, tpr, fpr, (fpr - lag(fpr, 1, 0) OVER v) * (tpr + lag(tpr, 1, 0) OVER v) / 2 AS area FROM c WINDOW v AS (ORDER BY p DESC))"


@query(ROC + " SELECT round(p, 9) AS threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(area, 9) AS area FROM x")
def q_roc_curve(spark, d):
    out = ranking.roc_points(scored(spark, d).withColumn("g", F.lit(1)), "y", "p", ["g"]).drop("g")
    return out.withColumns({c: F.round(c, 9) for c in out.columns})


_W = "2*1.959963984540054"
_LOW = "((k/n + 1.959963984540054*1.959963984540054/(2*n)) - 1.959963984540054*sqrt(k/n*(1-k/n)/n + 1.959963984540054*1.959963984540054/(4.0*n*n))) / (1 + 1.959963984540054*1.959963984540054/n)"
_HIGH = _LOW.replace(" - 1.959963984540054*sqrt", " + 1.959963984540054*sqrt")


@query(S + f", b AS (SELECT 1 + (p >= 0.2)::INT + (p >= 0.4)::INT + (p >= 0.6)::INT + (p >= 0.8)::INT AS bin, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k, avg(p) AS mean_p FROM s GROUP BY 1) SELECT g::INT AS bin, coalesce(n, 0)::BIGINT AS n, coalesce(k, 0)::BIGINT AS responders, round(mean_p, 9) AS mean_p, round(k/n, 9) AS observed, round(greatest({_LOW}, 0), 9) AS low, round(least({_HIGH}, 1), 9) AS high FROM range(1, 6) a(g) LEFT JOIN b ON g = bin")
def q_calibration_bins(spark, d):
    out = metrics.calibration_bins(scored(spark, d).withColumn("g", F.lit(1)), "y", "p", ["g"], metrics.EDGES_DECIMAL).drop("g")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_p", "observed", "low", "high")})


@query(f"WITH b AS (SELECT source, count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS k FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, n::BIGINT AS n, k::BIGINT AS k, round(greatest({_LOW}, 0), 9) AS low, round(least({_HIGH}, 1), 9) AS high FROM b")
def q_wilson(spark, d):
    g = scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("k"))
    return metrics.wilson_table(g, "k", "n").withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query(S + " SELECT t AS threshold, round(avg(((p >= t) AND y = 1)::INT) - avg(((p >= t) AND y = 0)::INT) * t / (1 - t), 9) AS model, round(avg(y) - (1 - avg(y)) * t / (1 - t), 9) AS treat_all, 0.0::DOUBLE AS treat_none FROM s, (SELECT unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])::DOUBLE AS t) GROUP BY t")
def q_decision_curve(spark, d):
    out = metrics.decision_curve(scored(spark, d), "y", "p", THRESHOLDS, [])
    return out.withColumns({c: F.round(c, 9) for c in ("model", "treat_all")})


LI = "WITH x AS (SELECT l_suppkey AS region, CAST(l_returnflag = 'R' AS INT) AS y, l_extendedprice AS v FROM lineitem)"


def regions(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("region"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("v"))


@query(LI + " SELECT region, round(sqrt(((count(*) FILTER (y = 0) - 1) * var_samp(v) FILTER (y = 0) + (count(*) FILTER (y = 1) - 1) * var_samp(v) FILTER (y = 1)) / (count(*) - 2)), 4) AS pooled_sd FROM x GROUP BY region")
def q_pooled_sd(spark, d):
    return metrics.pooled_sd(regions(spark, d), "y", "v", ["region"]).withColumn("pooled_sd", F.round("pooled_sd", 4))


@query(LI + ", g AS (SELECT region, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS difference, sqrt(var_samp(v) FILTER (y = 1) / (count(*) FILTER (y = 1) - 1) + var_samp(v) FILTER (y = 0) / (count(*) FILTER (y = 0) - 1)) AS se FROM x GROUP BY region) SELECT region, round(difference, 4) AS difference, round(se, 4) AS se, round(difference / se, 6) AS t FROM g")
def q_two_group_hc3(spark, d):
    return metrics.two_group_hc3(regions(spark, d), "y", "v", ["region"]).withColumns({"difference": F.round("difference", 4), "se": F.round("se", 4), "t": F.round("t", 6)})


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY event_type")
def q_percentile_interval(spark, d):
    return rounded(metrics.percentile_interval(table(spark, d, "events"), "value", ["event_type"]), "lo", "hi")


@query("SELECT event_type, count(value) AS n_finite, count(*) - count(value) AS n_other, round(min(value), 6) AS min, round(quantile_cont(value, 0.025), 6) AS q025, round(median(value), 6) AS median, round(quantile_cont(value, 0.975), 6) AS q975, round(max(value), 6) AS max, round(stddev_samp(value) / sqrt(count(value)), 6) AS mcse, round(avg((value > 0)::INT), 6) AS positive, round(avg((value < 0)::INT), 6) AS negative FROM events GROUP BY event_type")
def q_distribution(spark, d):
    out = metrics.distribution(table(spark, d, "events"), "value", ["event_type"])
    return rounded(out, "min", "q025", "median", "q975", "max", "mcse", "positive", "negative")


@query("SELECT lang, round(skewness(n_chars), 6) AS skew, round(kurtosis(n_chars), 6) AS kurt FROM documents GROUP BY lang")
def q_skew_kurt_unbiased(spark, d):
    x = F.col("n_chars").cast("double")
    return rounded(table(spark, d, "documents").groupBy("lang").agg(C.unbiased_skew(x).alias("skew"), C.unbiased_kurtosis(x).alias("kurt")), "skew", "kurt")


@query("WITH x AS (SELECT ln(1 + n_chars) AS v FROM documents), h AS (SELECT 1.06 * stddev_samp(v) * pow(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi FROM x), g AS (SELECT g::INT AS g, lo - 3*h + ((hi + 3*h) - (lo - 3*h)) * g / 49.0::DOUBLE AS grid, h FROM range(50) a(g), h) SELECT g, round(any_value(grid), 6) AS grid, round(avg(exp(-0.5 * ((grid - v) / h) * ((grid - v) / h))) / any_value(h) / sqrt(6.283185307179586), 6) AS density FROM g, x GROUP BY g")
def q_kde_grid(spark, d):
    x = table(spark, d, "documents").select(F.log1p(F.col("n_chars").cast("double")).alias("v"))
    return rounded(metrics.density_grid(x, "v", [], 50), "grid", "density")


# --- ranks and families

FAM = "WITH t AS (SELECT source AS family, doc_id, (1 + (doc_id * 7919) % 997) / 1000.0::DOUBLE AS p FROM documents)"


def tests(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("family"), "doc_id", ((1 + (F.col("doc_id") * 7919) % 997) / 1000.0).alias("p"))


@query(FAM + ", r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY family) AS m FROM t WINDOW w AS (PARTITION BY family ORDER BY p, doc_id)) SELECT family, doc_id, p, round(least(1, min(p * m / rn) OVER (PARTITION BY family ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r")
def q_bh_family(spark, d):
    return ranking.benjamini_hochberg(tests(spark, d), "p", ["family"], ["doc_id"]).withColumn("q", F.round("q", 9))


@query(FAM + ", r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY family) AS m FROM t WINDOW w AS (PARTITION BY family ORDER BY p, doc_id)) SELECT family, doc_id, p, round(max(least(1, p * (m - rn + 1))) OVER (PARTITION BY family ORDER BY rn), 9) AS p_holm FROM r")
def q_holm_family(spark, d):
    return ranking.holm(tests(spark, d), "p", ["family"], ["doc_id"]).withColumn("p_holm", F.round("p_holm", 9))


@query(FAM + ", u AS (SELECT *, (doc_id % 19 < 3)::INT AS part FROM t), r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY family, part) AS m, row_number() OVER j AS rj, count(*) OVER (PARTITION BY family) AS mj FROM u WINDOW w AS (PARTITION BY family, part ORDER BY p, doc_id), j AS (PARTITION BY family ORDER BY p, doc_id)) SELECT family, part, doc_id, round(least(1, min(p * m / rn) OVER (PARTITION BY family, part ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q, round(least(1, min(p * mj / rj) OVER (PARTITION BY family ORDER BY rj ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q_joint FROM r")
def q_two_family_q(spark, d):
    df = tests(spark, d).withColumn("part", (F.col("doc_id") % 19 < 3).cast("int"))
    df = ranking.benjamini_hochberg(df, "p", ["family", "part"], ["doc_id"])
    df = ranking.benjamini_hochberg(df, "p", ["family"], ["doc_id"], "q_joint")
    return df.select("family", "part", "doc_id", F.round("q", 9).alias("q"), F.round("q_joint", 9).alias("q_joint"))


@query("WITH g AS (SELECT l_suppkey AS f, CAST(l_quantity AS BIGINT) % 6 AS c, l_linenumber AS l1, sum(CAST(round(l_discount * 100) AS BIGINT)) % 7 / 10.0::DOUBLE + 1e-9 * any_value(l_linenumber) AS mean_brier FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT *, min(mean_brier) OVER (PARTITION BY f) AS best FROM g) SELECT f, c, l1, round(mean_brier, 6) AS mean_brier FROM m WHERE mean_brier <= best + 1e-8 QUALIFY row_number() OVER (PARTITION BY f ORDER BY c, l1) = 1")
def q_argmin_tie(spark, d):
    """Candidates of each supplier, many of them tied within the tolerance: the smallest c, then l1."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("f"), (F.col("l_quantity").cast("long") % 6).alias("c"), F.col("l_linenumber").alias("l1"))
    g = li.agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) % 7 / 10.0 + 1e-9 * F.col("l1")).alias("mean_brier"))
    return rounded(ranking.tolerant_minimum(g, "mean_brier", ["f"], ["c", "l1"]), "mean_brier")


@query("SELECT doc_id, lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rank FROM documents")
def q_rank_average(spark, d):
    return ranking.average_ranks(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "n_chars", ["lang"]).select("doc_id", "lang", "rank")


@query("WITH m AS (SELECT user_id, median(value) AS p50, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM events GROUP BY user_id) SELECT user_id, round(p50, 6) AS p50, round(lo, 6) AS lo, round(hi, 6) AS hi, row_number() OVER (ORDER BY p50, user_id) AS rank FROM m")
def q_median_order(spark, d):
    m = quantiles(table(spark, d, "events"), "value", ["user_id"], [0.5, 0.025, 0.975])
    m = ranking.numbered(m.withColumn("p50", F.col("q")[0]), [], "p50", ["user_id"], "rank")
    return m.select("user_id", *[r6(F.col("q")[k], n) for k, n in enumerate(("p50", "lo", "hi"))], "rank")


@query("SELECT l_suppkey AS target, round((1 + count(*) FILTER (abs(l_discount - 0.05) >= abs(0.04) - 1e-12)) / (count(*) + 1), 9) AS p, round((1 + count(*) FILTER (abs(l_discount - 0.05) >= abs(0.09 - 0.05) - 1e-12)) / (count(*) + 1), 9) AS p_centred FROM lineitem GROUP BY 1")
def q_tail_p(spark, d):
    x, o = F.col("l_discount"), F.lit(0.04)
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("target")).agg(F.round(ranking.tail_p(x - 0.05, o), 9).alias("p"), F.round(ranking.centred_tail_p(x, F.lit(0.05), F.lit(0.09)), 9).alias("p_centred"))


@query("SELECT lang, doc_id, n_chars FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY abs(n_chars - 1000) DESC, doc_id) AS r FROM documents) WHERE r = 1")
def q_largest_absolute(spark, d):
    df = table(spark, d, "documents").select("lang", "doc_id", "n_chars", (F.col("n_chars") - 1000).alias("v"))
    return ranking.largest_absolute(df, "v", ["lang"], "doc_id").select("lang", "doc_id", "n_chars")


# --- spatial

PTS = "WITH e AS (SELECT vec_id AS pos, label AS hemi, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS value FROM embeddings)"
KNN = PTS + ", k AS (SELECT a.hemi, a.pos AS src, b.pos AS dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS distance FROM e a JOIN e b ON a.hemi = b.hemi AND a.pos <> b.pos), n AS (SELECT *, row_number() OVER (PARTITION BY hemi, src ORDER BY distance, dst) AS rank FROM k QUALIFY row_number() OVER (PARTITION BY hemi, src ORDER BY distance, dst) <= 5)"


def points(spark, d):
    """The vectors' first coordinates as points, their labels as hemispheres."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("pos"), F.col("label").alias("hemi"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "value"))])


@query(KNN + " SELECT hemi, src, dst, round(distance, 6) AS distance, rank FROM n")
def q_knn_graph(spark, d):
    return rounded(spatial.nearest(points(spark, d), 5, ["hemi"]), "distance")


@query(KNN + ", s AS (SELECT hemi, src, dst FROM n UNION SELECT hemi, dst, src FROM n), z AS (SELECT hemi, pos, value - avg(value) OVER (PARTITION BY hemi) AS z FROM e), g AS (SELECT hemi, count(*) AS n, sum(z*z) AS ss FROM z GROUP BY hemi) SELECT g.hemi, round(any_value(g.n) / count(*) * sum(a.z * b.z) / any_value(g.ss), 6) AS moran FROM s JOIN z a ON a.hemi = s.hemi AND a.pos = s.src JOIN z b ON b.hemi = s.hemi AND b.pos = s.dst JOIN g ON g.hemi = s.hemi GROUP BY g.hemi")
def q_moran(spark, d):
    pts = points(spark, d)
    # both directions of the edges are read
    edges = spatial.symmetric(written(spatial.nearest(pts, 5, ["hemi"]), "edges"), ["hemi"])
    return rounded(spatial.moran(pts, edges, ["hemi"]), "moran")


@query("WITH v AS (SELECT vec_id, unnest(range(1, 65)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT vec_id, k, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM v) SELECT vec_id, round(sum(c * c), 6) AS ss, round(max(c), 6) AS top, round(min(c), 6) AS low FROM c GROUP BY vec_id")
def q_clr(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.exp(v.cast("double"))).alias("v"))
    c = e.select("vec_id", C.centred_log(F.col("v")).alias("c"))
    return c.select("vec_id", r6(F.aggregate("c", F.lit(0.0), lambda a, v: a + v * v), "ss"), r6(F.array_max("c"), "top"), r6(F.array_min("c"), "low"))


@query("WITH v AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings), t AS (SELECT vec_id AS target, pos, value AS t FROM v WHERE vec_id < 18) SELECT vec_id AS draw, target, round(greatest(least(corr(value, t), 1), -1), 6) AS r FROM v JOIN t USING (pos) GROUP BY ALL")
def q_map_correlations(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("draw"), F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))
    t = v.where("draw < 18").select(F.col("draw").alias("target"), "pos", F.col("value").alias("t"))
    return rounded(spatial.map_correlations(v, F.broadcast(t)), "r")


@query("WITH x AS (SELECT source, n_chars::DOUBLE AS a, ln(1 + n_chars) AS b, (doc_id % 101)::DOUBLE AS c FROM documents), r AS (SELECT source, corr(a, b) AS p, corr(a, c) AS q, corr(b, c) AS s FROM x GROUP BY source) SELECT source, round((p - q * s) / sqrt((1 - q*q) * (1 - s*s)), 6) AS r FROM r")
def q_partial_one_cov(spark, d):
    x = table(spark, d, "documents").select("source", F.col("n_chars").cast("double").alias("a"), F.log1p(F.col("n_chars").cast("double")).alias("b"), (F.col("doc_id") % 101).cast("double").alias("c"))
    return rounded(spatial.partial_one(x, "a", "b", "c", ["source"]), "r")


@query("WITH x AS (SELECT lang, doc_id, n_chars::DOUBLE AS a, (doc_id % 101)::DOUBLE AS b FROM documents), l AS (SELECT lang, regr_slope(a, b) AS s, regr_intercept(a, b) AS i FROM x GROUP BY lang) SELECT doc_id, round(a - i - s * b, 4) AS residual FROM x JOIN l USING (lang)")
def q_residual_one(spark, d):
    x = table(spark, d, "documents").select("lang", "doc_id", F.col("n_chars").cast("double").alias("a"), (F.col("doc_id") % 101).cast("double").alias("b"))
    return spatial.residual_one(x, "a", "b", ["lang"]).select("doc_id", F.round("residual", 4).alias("residual"))


@query("WITH r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2 AS a, rank() OVER (PARTITION BY source ORDER BY doc_id % 101) + (count(*) OVER (PARTITION BY source, doc_id % 101) - 1) / 2 AS b FROM documents) SELECT source, round(corr(a, b), 6) AS rho FROM r GROUP BY source")
def q_spearman(spark, d):
    x = table(spark, d, "documents").select("source", "n_chars", (F.col("doc_id") % 101).alias("b"))
    return rounded(spatial.spearman(x, "n_chars", "b", ["source"]), "rho")


@query("WITH s AS (SELECT vec_id, CASE vec_id % 50 WHEN 0 THEN range(64) WHEN 1 THEN list_concat([0, 0], range(2, 64)) ELSE (SELECT list(k ORDER BY v, k) FROM (SELECT unnest(range(64)) AS k, unnest(embedding) AS v)) END AS perm FROM embeddings) SELECT count(*) AS draws, count(DISTINCT perm) AS distinct_permutations, count(*) FILTER (perm = range(64)) AS identities, count(*) FILTER (list_sort(perm) <> range(64)) AS not_permutations FROM s")
def q_permutations(spark, d):
    """Orders of each vector's components as permutations; some are the identity, some have a place twice."""
    order = F.transform(F.array_sort(F.transform("embedding", lambda v, k: F.struct(v.alias("v"), k.alias("k")))), lambda x: x["k"])
    whole, twice = F.sequence(F.lit(0), F.lit(63)), F.concat(F.array(F.lit(0), F.lit(0)), F.sequence(F.lit(2), F.lit(63)))
    spins = table(spark, d, "embeddings").select(F.col("vec_id").alias("draw"), F.when(F.col("vec_id") % 50 == 0, whole).when(F.col("vec_id") % 50 == 1, twice).otherwise(order).alias("perm"))
    return spatial.permutation_counts(spins, 64)


# --- resampling and splits

BOOT = DENSE + ", " + DRAW + ", q AS (SELECT mo AS model, row_pos, y, 1/(1+exp(-(ln(1+n_chars)-6 - 0.3*mo*toxic))) AS p FROM k, range(3) a(mo)), j AS (SELECT draw, model, y, p FROM dr JOIN q USING (row_pos)), g AS (SELECT draw, model, p, count(*) AS n, sum(y) AS c FROM j GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY draw, model ORDER BY p) - n + (n + 1) / 2 AS rk FROM g), a AS (SELECT draw, model, CASE WHEN sum(c) > 0 AND sum(c) < sum(n) THEN (sum(rk * c) - sum(c) * (sum(c) + 1) / 2) / (sum(c) * (sum(n) - sum(c))) END AS auc FROM r GROUP BY ALL), b AS (SELECT draw, model, avg((y - p) * (y - p)) AS brier FROM j GROUP BY ALL), mt AS (SELECT draw, model, auc, brier FROM a JOIN b USING (draw, model))"


def drawn_metrics(spark, d):
    cohort = dense(scored(spark, d))
    preds = cohort.withColumn("model", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    preds = preds.select("model", "row_pos", "y", C.expit(F.log1p(F.col("n_chars").cast("double")) - 6 - 0.3 * F.col("model") * F.col("toxic")).alias("p"))
    return resampling.draw_metrics(congruential(spark, cohort), preds)


@query(BOOT + ", u AS (SELECT draw, model, 'auc' AS metric, auc AS v FROM mt WHERE auc IS NOT NULL UNION ALL SELECT draw, model, 'brier', brier FROM mt WHERE auc IS NOT NULL) SELECT u.model, metric, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi, any_value(c.valid_draws) AS valid_draws, any_value(c.skipped) AS skipped FROM u JOIN (SELECT model, count(auc) AS valid_draws, count(*) - count(auc) AS skipped FROM mt GROUP BY model) c ON c.model = u.model GROUP BY u.model, metric")
def q_bootstrap_shared(spark, d):
    return resampling.model_intervals(drawn_metrics(spark, d)).withColumns({"lo": F.round("lo", 9), "hi": F.round("hi", 9)})


@query(BOOT + ", u AS (SELECT a.model AS base, b.model AS added, unnest(['auc', 'brier']) AS metric, unnest([b.auc - a.auc, a.brier - b.brier]) AS v FROM mt a JOIN mt b ON a.draw = b.draw AND b.model = a.model + 1 WHERE a.auc IS NOT NULL AND b.auc IS NOT NULL) SELECT base, added, metric, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi FROM u GROUP BY ALL")
def q_bootstrap_paired(spark, d):
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "base long, added long")
    out = resampling.difference_intervals(resampling.paired_differences(drawn_metrics(spark, d), pairs))
    return out.withColumns({"lo": F.round("lo", 9), "hi": F.round("hi", 9)})


@query("WITH d AS (SELECT l_suppkey, avg(l_quantity) / 50 AS ba, avg(l_tax) * 10 AS oa, avg(l_discount) AS bb, avg(l_tax) AS ob FROM lineitem GROUP BY 1) SELECT round(avg(ba - oa), 9) AS auc_optimism, round(avg(ob - bb), 9) AS brier_optimism, round(0.75 - avg(ba - oa), 9) AS corrected_auc, round(0.19 + avg(ob - bb), 9) AS corrected_brier FROM d")
def q_optimism_arith(spark, d):
    """Suppliers play draws, their means the measures of bag and original."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") / 50).alias("bag_auc"), (F.avg("l_tax") * 10).alias("original_auc"), F.avg("l_discount").alias("bag_brier"), F.avg("l_tax").alias("original_brier"))
    out = resampling.optimism(rows, 0.75, 0.19)
    return out.withColumns({c: F.round(c, 9) for c in out.columns})


FOLD = "WITH f AS (SELECT doc_id AS row_pos, quality AS y, re AS repeat, (row_number() OVER (PARTITION BY re, quality ORDER BY (doc_id * (7919 + 2 * re)) % 10007, doc_id) - 1) % 5 AS fold FROM labels, range(2) a(re))"


def folds(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("row_pos"), F.col("quality").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("repeat"))
    order = (F.col("row_pos") * (7919 + 2 * F.col("repeat"))) % 10007
    return splits.dealt(rows, ["repeat", "y"], order, "row_pos", 5)


@query(FOLD + " SELECT repeat, count(*) FILTER (c = 1) AS tested_once, count(*) FILTER (c <> 1) AS others, (SELECT count(*) FROM labels) AS n_rows FROM (SELECT repeat, row_pos, count(*) AS c FROM f GROUP BY ALL) GROUP BY repeat")
def q_split_coverage(spark, d):
    return splits.coverage(folds(spark, d), table(spark, d, "labels"))


@query(FOLD + " SELECT repeat, fold, y, count(*) AS n FROM f GROUP BY ALL")
def q_split_balance(spark, d):
    return folds(spark, d).groupBy("repeat", "fold", "y").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0 AS double_roles, 0 AS leaks, 0 AS not_once, 0 AS one_class")
def q_nested_plan_faults(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("row_pos"), F.col("quality").alias("y"))
    outer = splits.stratified(labels, "y", 5, 2, 20260909)
    out = splits.plan_faults(splits.nested(outer, "y", 3, 20260910))
    return out.select(*[F.col(c).cast("int").alias(c) for c in out.columns])


@query("WITH u AS (SELECT user_id, max((event_type = 'purchase')::INT) AS y FROM events GROUP BY 1) SELECT user_id, y, (row_number() OVER (PARTITION BY y ORDER BY user_id) - 1) % 3 AS fold FROM u")
def q_grouped_folds(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_type") == "purchase").cast("int").alias("y"))
    return splits.grouped(e, "user_id", "y", 3)


@query(FOLD + " SELECT count(*) FILTER (b = 1) AS unplanned, count(*) FILTER (b = 2) AS unused FROM (SELECT fold, row_pos, bit_or(b) AS b FROM (SELECT fold, row_pos, repeat + 1 AS b FROM f) GROUP BY ALL)")
def q_training_isolation(spark, d):
    # one repeat's folds against the other's: what a fit of the wrong plan would show
    f = folds(spark, d)
    return splits.isolation_faults(f.where("repeat = 0"), f.where("repeat = 1").withColumn("repeat", F.lit(0)))


@query(FOLD + ", t AS (SELECT f.repeat, f.fold, CASE WHEN n_chars % 11 > 0 THEN n_chars::DOUBLE END AS v FROM f JOIN documents d ON d.doc_id = f.row_pos), m AS (SELECT repeat, fold, median(v) AS fill FROM t GROUP BY ALL), x AS (SELECT repeat, fold, fill, coalesce(v, fill) AS x FROM t JOIN m USING (repeat, fold)) SELECT repeat, fold, 'v' AS field, round(any_value(fill), 6) AS fill, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END, 6) AS scale, max(x) = min(x) AS dropped FROM x GROUP BY repeat, fold")
def q_prep_fold_state(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_pos"), F.when(F.col("n_chars") % 11 > 0, F.col("n_chars").cast("double")).alias("v"))
    return rounded(splits.fold_state(folds(spark, d).join(docs, "row_pos"), ["repeat", "fold"], ["v"]), "fill", "mean", "scale")


@query(FOLD + ", c AS (SELECT repeat, fold, lang, count(*) AS c, list_position(['es','de','fr','en'], lang) AS o FROM f JOIN documents d ON d.doc_id = f.row_pos GROUP BY ALL) SELECT repeat, fold, arg_max(lang, c * 10 - o) AS fill FROM c GROUP BY ALL")
def q_prep_fold_mode(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_pos"), "lang")
    return splits.fold_mode(folds(spark, d).join(docs, "row_pos"), ["repeat", "fold"], "lang", ["es", "de", "fr", "en"])


# --- sources and sinks


@query("SELECT doc_id, sha256(text) AS sha256, length(text) AS n FROM documents")
def q_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n"))


@query("SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE value END AS value FROM events")
def q_nullable_sink(spark, d):
    inf = F.lit(float("inf"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("value") > 100, F.when(F.col("event_id") % 2 == 0, inf).otherwise(F.lit(float("nan")))).otherwise(F.col("value")).alias("value"))
    return sinks.nullable(e)


@query("SELECT count(*) AS n_parsed, sum(length(structure))::BIGINT AS name_chars FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) t, LATERAL (SELECT regexp_split_to_array(trim(line), ' +') AS f) u, LATERAL (SELECT f[5] AS structure, TRY_CAST(f[4] AS DOUBLE) AS v) w WHERE len(f) >= 5 AND v IS NOT NULL AND NOT starts_with(trim(line), '#')")
def q_parse_structures(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("subject"), F.explode(F.split("text", "\n", -1)).alias("line"))
    return stats_text.structure_volumes(lines).agg(F.count(F.lit(1)).alias("n_parsed"), F.sum(F.length("structure")).cast("long").alias("name_chars"))


# --- kernels: no SQL form; tests hold them against closed forms and brute force


def design(spark, d) -> DataFrame:
    """row_pos, y and numeric columns of the labelled documents: a cohort for the kernels."""
    df = scored(spark, d)
    n = F.col("n_chars").cast("double")
    return df.select("row_pos", "y", "source", F.log1p(n).alias("log_chars"), (F.col("lang") == "en").cast("double").alias("english"), F.col("toxic").cast("double").alias("toxic"), F.when(F.col("row_pos") % 13 > 0, (F.col("row_pos") % 101).cast("double")).alias("x1"), F.sin(F.col("row_pos").cast("double")).alias("x2"), (F.substring("source", 4, 2).cast("int") % 2).cast("double").alias("scanner"))


COLUMNS = {"C": ["log_chars", "english"], "CP": ["log_chars", "english", "x1", "x2"], "CPT": ["log_chars", "english", "x1", "x2", "toxic"]}
BINARY = {"english", "toxic", "scanner"}


def _plan(spark, d, repeats: int = 1) -> DataFrame:
    cohort = design(spark, d)
    return splits.nested(splits.stratified(cohort, "y", 3, repeats, 20260909), "y", 3, 20260910)


@query(None)
def q_elastic_net_nested(spark, d):
    from cohortloom.plans.prediction import run_nested

    return run_nested(design(spark, d), _plan(spark, d), COLUMNS, BINARY)


@query(None)
def q_masked_net(spark, d):
    from cohortloom.plans.prediction import run_nested

    columns = {m: [*c, "scanner"] for m, c in COLUMNS.items() if m != "CPT"}
    return run_nested(design(spark, d), _plan(spark, d), columns, BINARY, unpenalized={"scanner"})


@query(None)
def q_cross_scanner(spark, d):
    """Two directions: trained on one scanner's rows, tested on the other's."""
    from cohortloom.plans.prediction import run_nested

    cohort = design(spark, d)
    outer = cohort.select("row_pos", "y", F.lit(0).alias("repeat"), F.col("scanner").cast("long").alias("fold"))
    return run_nested(cohort, splits.nested(outer, "y", 3, 7), {m: COLUMNS[m] for m in ("C", "CP")}, BINARY)


def _newton_sql(rows: str, by: str, steps: int, start: str, tag: str) -> list[str]:
    """CTEs of Newton steps for two coefficients on columns o and z of `rows` (by, y, o, z, f: an offset), from the CTE `start`; {tag}{steps} has b0 and b1."""
    out, last = [], start
    for k in range(1, steps + 1):
        out += [
            f"{tag}s{k} AS (SELECT {by}, any_value(b0) AS b0, any_value(b1) AS b1, sum(o * (y - q)) AS g0, sum(z * (y - q)) AS g1, sum(o * o * q * (1 - q)) AS a, sum(o * z * q * (1 - q)) AS b, sum(z * z * q * (1 - q)) AS c FROM (SELECT *, 1 / (1 + exp(-(f + b0 * o + b1 * z))) AS q FROM {rows} JOIN {last} USING ({by})) GROUP BY {by})",
            f"{tag}{k} AS MATERIALIZED (SELECT {by}, b0 + (c * g0 - b * g1) / (a * c - b * b) AS b0, b1 + (a * g1 - b * g0) / (a * c - b * b) AS b1 FROM {tag}s{k})",
        ]
        last = f"{tag}{k}"
    return out


_CAL = PRED + ", d0 AS MATERIALIZED (SELECT model, repeat, y, 1.0::DOUBLE AS o, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) AS z, 0.0::DOUBLE AS f FROM m), i0 AS (SELECT DISTINCT model, repeat, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM d0), "
# the offset alone: its equation has the one coefficient, and Newton's steps are g / a
_LARGE, _last = [], "i0"
for _k in range(1, 13):
    _LARGE.append(f"l{_k} AS MATERIALIZED (SELECT model, repeat, any_value(b0) + sum(y - q) / sum(q * (1 - q)) AS b0, 0.0::DOUBLE AS b1 FROM (SELECT *, 1 / (1 + exp(-(z + b0))) AS q FROM d0 JOIN {_last} USING (model, repeat)) GROUP BY model, repeat)")
    _last = f"l{_k}"


@query(_CAL + ", ".join([*_newton_sql("d0", "model, repeat", 12, "i0", "j"), *_LARGE]) + " SELECT model, repeat, 'ESTIMABLE' AS status, round(l12.b0, 6) AS \"offset\", round(j12.b0, 6) AS intercept, round(j12.b1, 6) AS slope FROM j12 JOIN l12 USING (model, repeat)")
def q_calibration_fit(spark, d):
    from cohortloom.operators.newton import calibration

    return rounded(calibration(predicted(spark, d), ["model", "repeat"]), "offset", "intercept", "slope")


@query(None)
def q_development_bootstrap(spark, d):
    from cohortloom.plans.prediction import Settings, development_bootstrap

    cohort = dense(design(spark, d))
    drawn = weights.weights(spark, cohort.count(), 8, 20260921)
    return development_bootstrap(drawn, 8, cohort, {m: COLUMNS[m] for m in ("C", "CP")}, BINARY, Settings(c_grid=(0.1, 1.0), l1_grid=(0.0, 0.5, 1.0)))


#: HC3 of v on y given english, a 0/1 column: residuals of y and v from their means by english have all that is needed. Group columns: {by}.
HC3 = """WITH c AS (SELECT l.doc_id AS row_pos, l.quality AS y, d.source, (d.lang = 'en')::INT AS english, ln(1 + d.n_chars) AS log_chars, sin(l.doc_id::DOUBLE) AS x2 FROM labels l JOIN documents d USING (doc_id)),
lo AS (SELECT row_pos, y, source, english, unnest(['log_chars', 'x2']) AS region, unnest([log_chars, x2]) AS v FROM c),
r AS (SELECT *, y - avg(y) OVER (PARTITION BY {by}, english) AS yt, v - avg(v) OVER (PARTITION BY {by}, english) AS vt, count(*) OVER (PARTITION BY {by}, english) AS ng FROM lo),
b AS (SELECT {by}, sum(yt * vt) / nullif(sum(yt * yt), 0) AS b, sum(yt * yt) AS ss, count(*) AS n, count(DISTINCT english) AS levels,
        sqrt(((count(*) FILTER (y = 0) - 1) * var_samp(v) FILTER (y = 0) + (count(*) FILTER (y = 1) - 1) * var_samp(v) FILTER (y = 1)) / nullif(count(*) - 2, 0)) AS sd FROM r GROUP BY {by}),
e AS (SELECT r.*, b, ss, n, levels, sd, vt - b * yt AS e, 1 / ng + yt * yt / nullif(ss, 0) AS h FROM r JOIN b USING ({by})),
f AS (SELECT *, b - yt / nullif(ss, 0) * e / CASE WHEN h < 1 - 1e-8 THEN 1 - h END AS loo FROM e),
g AS (SELECT {by}, any_value(n) AS n, any_value(b) AS b, any_value(sd) AS sd, sqrt(sum(pow(yt / nullif(ss, 0) * e / CASE WHEN h < 1 - 1e-8 THEN 1 - h END, 2))) AS se, max(h) AS max_leverage, max(e * e * h / CASE WHEN h < 1 - 1e-8 THEN pow(1 - h, 2) END) * (any_value(n) - 3) / (3 * nullif(sum(e * e), 0)) AS max_cooks,
        min(loo) AS low, max(loo) AS high, count(*) FILTER (sign(loo) <> sign(b)) AS sign_changes, any_value(n) - 3 AS dof,
        CASE WHEN any_value(n) <= 3 OR any_value(levels) < 2 OR any_value(ss) / any_value(n) < 1e-9 THEN 'not estimable: rank' WHEN max(h) >= 1 - 1e-8 THEN 'not estimable: leverage' WHEN NOT coalesce(any_value(sd) > 0, false) THEN 'not estimable: deviation' ELSE 'ok' END AS status FROM f GROUP BY {by})"""
#: Student's two-sided tail of b / se with dof degrees of freedom, by Simpson's rule over the angle whose tangent is t / sqrt(dof).
STUDENT = "2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(a + (pi() / 2 - a) * i / 4000), dof - 1))) * (pi() / 2 - a) / 12000"


@query(HC3.format(by="region") + f", p AS (SELECT *, {STUDENT} AS p FROM (SELECT *, atan(abs(b / se) / sqrt(dof)) AS a FROM g)), o AS (SELECT *, row_number() OVER (ORDER BY p, region) AS rn, count(*) OVER () AS m FROM p) SELECT region, n, round(b, 6) AS estimate, round(se, 6) AS se, round(b / sd, 6) AS standardized, round(max_leverage, 6) AS max_leverage, round(max_cooks, 6) AS max_cooks, round(p, 6) AS p, round(least(1, min(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM o")
def q_hc3_general(spark, d):
    """Two regions' effects given a covariate, each of the whole cohort, with their family's q."""
    from cohortloom.operators.least_squares import associations

    long = design(spark, d).unpivot(["row_pos", "y", "english"], ["log_chars", "x2"], "region", "value")
    out = associations(long, ["region"], "value", "y", ["english"], with_influence=False)
    out = ranking.benjamini_hochberg(out.withColumn("family", F.lit("all")), "p", ["family"], ["region"])
    return rounded(out.select("region", F.col("n").cast("long").alias("n"), "estimate", "se", "standardized", "max_leverage", "max_cooks", "p", "q"), "estimate", "se", "standardized", "max_leverage", "max_cooks", "p", "q")


@query(HC3.format(by="source, region") + " SELECT source, region, n, status, " + ", ".join(f"CASE WHEN status = 'ok' THEN {c} END AS {n}" for c, n in (("round(b, 6)", "estimate"), ("round(se, 6)", "se"), ("round(b / sd, 6)", "standardized"), ("round(low / sd, 6)", "loo_min"), ("round(high / sd, 6)", "loo_max"), ("sign_changes", "sign_changes"), ("round(max_leverage, 6)", "max_leverage"), ("round(max_cooks, 6)", "max_cooks"))) + " FROM g")
def q_influence(spark, d):
    """Every source's effects and what they are without each person in turn; sources that can't be fitted say why."""
    from cohortloom.operators.least_squares import associations

    long = design(spark, d).unpivot(["row_pos", "y", "english", "source"], ["log_chars", "x2"], "region", "value")
    out = associations(long, ["source", "region"], "value", "y", ["english"], with_status=True)
    out = out.select("source", "region", F.col("n").cast("long").alias("n"), "status", "estimate", "se", "standardized", "loo_min", "loo_max", F.col("sign_changes").cast("long").alias("sign_changes"), "max_leverage", "max_cooks")
    return rounded(out, "estimate", "se", "standardized", "loo_min", "loo_max", "max_leverage", "max_cooks")


def _centred(spark, d) -> DataFrame:
    """z: each vector's centred log ratios, the vector being the logarithms of a composition."""
    e = F.col("embedding").cast("array<double>")
    mean = F.aggregate(e, F.lit(0.0), lambda s, v: s + v) / F.size(e)
    return table(spark, d, "embeddings").select("vec_id", F.transform(e, lambda v: v - mean).alias("z"))


@query(None)
def q_pc1(spark, d):
    from cohortloom.operators import pattern

    f = pattern.component_of_moments(*pattern.moments(_centred(spark, d), "z"))
    s = pattern.sign_by_largest(f["loading"])
    return spark.createDataFrame([(k, round(float(v * s), 9), f["eigen1"], f["explained"]) for k, v in enumerate(f["loading"])], "region_pos long, loading double, eigen1 double, explained double")


def _logistic_sql(x: list[str], start: str, tag: str, steps: int, update: str) -> list[str]:
    """CTEs of steps for coefficients b0, b1, .. on columns x of r (g, y, x) from the CTE `start`, whose other columns go along: each step has
    the log-likelihood l, scores s0.., and the inverse information i00, i01, .. of up to three coefficients by cofactors; `update` makes the next ones."""
    p, out, last = len(x), [], start
    entry = lambda i, j: f"a{min(i, j)}{max(i, j)}"

    def minor(i: int, j: int) -> str:
        rows, cols = [k for k in range(p) if k != i], [k for k in range(p) if k != j]
        m = entry(rows[0], cols[0]) if p == 2 else f"({entry(rows[0], cols[0])} * {entry(rows[1], cols[1])} - {entry(rows[0], cols[1])} * {entry(rows[1], cols[0])})"
        return f"{'-' if (i + j) % 2 else ''}{m}"

    for k in range(1, steps + 1):
        eta = " + ".join(f"b{j} * {c}" for j, c in enumerate(x))
        out += [
            f"{tag}e{k} AS (SELECT *, 1 / (1 + exp(-({eta}))) AS q, {eta} AS eta FROM r JOIN {last} USING (g))",
            f"{tag}f{k} AS (SELECT g, side, any_value(top) AS top, {', '.join(f'any_value(b{j}) AS b{j}' for j in range(p))}, sum(CASE WHEN y = 1 THEN -ln(1 + exp(-eta)) ELSE -ln(1 + exp(eta)) END) AS l, {', '.join(f'sum({c} * (y - q)) AS s{j}' for j, c in enumerate(x))}, {', '.join(f'sum({x[i]} * {x[j]} * q * (1 - q)) AS a{i}{j}' for i in range(p) for j in range(i, p))} FROM {tag}e{k} GROUP BY g, side)",
            f"{tag}d{k} AS (SELECT *, {' + '.join(f'{entry(0, j)} * ({minor(0, j)})' for j in range(p))} AS det FROM {tag}f{k})",
            f"{tag}v{k} AS (SELECT *, {', '.join(f'({minor(i, j)}) / det AS i{i}{j}' for i in range(p) for j in range(p))} FROM {tag}d{k})",
            f"{tag}{k} AS MATERIALIZED (SELECT g, side, top, l, {update} FROM {tag}v{k})",
        ]
        last = f"{tag}{k}"
    return out


def _product(p: int, i: int, v) -> str:
    return "(" + " + ".join(f"i{i}{j} * ({v(j)})" for j in range(p)) + ")"


_X3 = ["x0", "x1", "x2"]
_PLAIN = lambda p: ", ".join(f"b{i} + {_product(p, i, lambda j: f's{j}')} AS b{i}" for i in range(p))
_GAIN = " + ".join(f"s{i} * {_product(3, i, lambda j: f's{j}')}" for i in range(3))
#: Half the 95 % point of the chi-square distribution of one degree of freedom.
_DROP = 1.9207294103470482
_FORCE = f"side * sqrt(greatest(2 * (l - top + {_DROP} + 0.5 * ({_GAIN})) / i22, 0))"
_BOUNDED = ", ".join(f"b{i} + {_product(3, i, lambda j: f's{j}' + (f' + {_FORCE}' if j == 2 else ''))} AS b{i}" for i in range(3))
_ODDS = S + ", r0 AS (SELECT CAST(substr(source, 4, 2) AS INT) % 2 AS g, toxic AS y, 1.0::DOUBLE AS x0, (lang = 'en')::INT::DOUBLE AS x1, ln(1 + n_chars) AS x2 FROM s), c AS (SELECT g, CASE WHEN count(DISTINCT y) < 2 THEN 'not estimable: single class' WHEN least(count(*) FILTER (x1 = 0 AND y = 0), count(*) FILTER (x1 = 0 AND y = 1), count(*) FILTER (x1 = 1 AND y = 0), count(*) FILTER (x1 = 1 AND y = 1)) = 0 THEN 'nonestimable_separation' ELSE 'estimated' END AS status FROM r0 GROUP BY g), r AS MATERIALIZED (SELECT r0.* FROM r0 JOIN c USING (g) WHERE status = 'estimated'), t0 AS (SELECT DISTINCT g, 0 AS side, 0.0::DOUBLE AS top, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM r), "


@query(_ODDS + ", ".join([*_logistic_sql(_X3, "t0", "m", 13, _PLAIN(3)), *_logistic_sql(_X3[:2], "t0", "n", 13, _PLAIN(2)), f"u0 AS (SELECT g, unnest([-1, 1]) AS side, l AS top, b0 + 0 AS b0, b1 + 0 AS b1, b2 + 0 AS b2 FROM m13)", *_logistic_sql(_X3, "u0", "p", 14, _BOUNDED)]) + " SELECT g::DOUBLE AS scanner, status, round(m13.b2, 5) AS log_or, round(lo.b2, 5) AS lo, round(hi.b2, 5) AS hi, round(2 * (m13.l - n13.l), 5) AS lr FROM c LEFT JOIN m13 USING (g) LEFT JOIN n13 USING (g) LEFT JOIN (SELECT g, b2 FROM p14 WHERE side = -1) lo USING (g) LEFT JOIN (SELECT g, b2 FROM p14 WHERE side = 1) hi USING (g)")
def q_profile_odds(spark, d):
    """Odds ratio of toxic text with profile bounds on each scanner, or why there is none."""
    from cohortloom.operators.newton import profile

    rows = design(spark, d).withColumns({"one": F.lit(1.0), "toxic": F.col("toxic").cast("int")})
    out = profile(rows, ["scanner"], "toxic", ["one", "english", "log_chars"], "log_chars")
    return out.select("scanner", "status", *[F.round(c, 5).alias(c) for c in ("log_or", "lo", "hi", "lr")])


from cohortloom.plans import catalogue_more, catalogue_spatial  # noqa: E402, F401  they add their queries to QUERIES and SQL
