"""More named queries: display tables, families, plans, imaging tables and text sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import columns as C
from cohortloom.operators import assembly, contracts, display, imaging, metrics, pattern, regional, resampling, spatial, splits
from cohortloom.plans import catalogue, families, protocol
from cohortloom.plans.catalogue import COLUMNS, BINARY, PRED, S, _centred, _plan, design, predicted, query, rounded, scored, table
from cohortloom.sources import sinks, stats_text, tables

# --- pairs, prevalence, versions


@query(S + " SELECT a.lang, count(*) FILTER (a.p > b.p) AS above, count(*) FILTER (a.p = b.p) AS equal, count(*) AS pairs, round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 9) AS auc FROM s a JOIN s b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang")
def q_auc_pairs(spark, d):
    out = metrics.pair_auc(scored(spark, d), "y", "p", ["lang"]).where("pairs is not null")
    return out.withColumns({"auc": F.round("auc", 9), "pairs": F.col("pairs").cast("long")})


@query(S + ", t AS (SELECT source AS held, count(*) AS n_test, avg(y) AS test_rate FROM s GROUP BY 1) SELECT held, n_test, (SELECT count(*) FROM s) - n_test AS n_train, round(test_rate, 6) AS test_rate, round((SELECT avg((s.y - tr.m) * (s.y - tr.m)) FROM s, (SELECT avg(y) AS m FROM s WHERE source <> held) tr WHERE s.source = held), 6) AS prevalence_brier FROM t")
def q_leave_one_group(spark, d):
    out = metrics.held_out_prevalence(scored(spark, d), "y", "source").withColumnRenamed("source", "held")
    return rounded(out, "test_rate", "prevalence_brier")


BY_MODEL = PRED + ", g AS (SELECT model, p, count(*) AS n, sum(y) AS k FROM m GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY model ORDER BY p) - n + (n + 1) / 2 AS rk FROM g), a AS (SELECT model, (sum(rk * k) - sum(k) * (sum(k) + 1) / 2) / (sum(k) * (sum(n) - sum(k))) AS auc FROM r GROUP BY model), b AS (SELECT model, avg((y - p) * (y - p)) AS brier FROM m GROUP BY model), e AS (SELECT model, auc, brier FROM a JOIN b USING (model))"


def by_model(spark, d):
    return metrics.measures(predicted(spark, d), "y", "p", ["model"]).select("model", "auc", "brier")


def around(spark, d):
    """A made interval around each estimate, wider for later models."""
    long = by_model(spark, d).unpivot(["model"], ["auc", "brier"], "metric", "value")
    wide = 0.01 * (F.col("model") + 1)
    return long.select("model", "metric", (F.col("value") - wide).alias("lo"), (F.col("value") + wide).alias("hi"))


@query("SELECT 1 AS unmatched, 1 AS other_auc, 0 AS other_brier")
def q_version_faults(spark, d):
    computed = by_model(spark, d)
    supplied = computed.where("model < 2").withColumn("auc", F.col("auc") + F.when(F.col("model") == 1, 1e-9).otherwise(1e-15))
    out = display.version_faults(computed, supplied, ["model"], ["auc", "brier"])
    return out.select(*[F.col(c).cast("int").alias(c) for c in out.columns])


@query(BY_MODEL + " SELECT model, round(auc, 9) AS auc, round(brier, 9) AS brier FROM e")
def q_same_version(spark, d):
    computed = by_model(spark, d)
    return display.same_version(computed, computed.withColumn("auc", F.col("auc") + 1e-15), ["model"], ["auc", "brier"]).withColumns({c: F.round(c, 9) for c in ("auc", "brier")})


@query(BY_MODEL + " SELECT model, metric, round(value, 9) AS value, round(value - 0.01 * (model + 1), 9) AS lo, round(value + 0.01 * (model + 1), 9) AS hi FROM (SELECT model, unnest(['auc', 'brier']) AS metric, unnest([auc, brier]) AS value FROM e)")
def q_model_panel(spark, d):
    out = display.model_panel(by_model(spark, d), around(spark, d), ["model"])
    return out.withColumns({c: F.round(c, 9) for c in ("value", "lo", "hi")})


@query(BY_MODEL + ", x AS (SELECT model, unnest(['auc', 'brier']) AS metric, unnest([auc, brier]) AS v FROM e), f AS (SELECT *, 0.01 * (model + 1) AS w FROM x) SELECT 'm' || model AS model, CAST(model AS INT) AS place, metric, CAST(round(CAST(v AS DECIMAL(38,12)), 3) AS VARCHAR) || ' (' || CAST(round(CAST(v - w AS DECIMAL(38,12)), 3) AS VARCHAR) || ' to ' || CAST(round(CAST(v + w AS DECIMAL(38,12)), 3) AS VARCHAR) || ')' AS shown FROM f")
def q_performance_table(spark, d):
    name = lambda df: df.withColumn("model", F.concat(F.lit("m"), F.col("model").cast("string")))
    return display.performance_table(name(by_model(spark, d)), name(around(spark, d)), ["m0", "m1", "m2"])


@query("SELECT CAST(place AS INT) AS place, n_name, n_regionkey FROM nation JOIN (SELECT unnest(['NATION_7', 'NATION_3', 'NATION_11']) AS n_name, unnest([0, 1, 2]) AS place) USING (n_name)")
def q_fixed_order(spark, d):
    order = ["NATION_7", "NATION_3", "NATION_11"]
    rows = table(spark, d, "nation").where(F.col("n_name").isin(order))
    return display.in_fixed_order(rows, "n_name", order, ["n_regionkey"])


@query("SELECT CASE WHEN n_regionkey < 2 THEN 'first' ELSE 'rest' END AS \"group\", n_nationkey, round(v, 6) AS v FROM nation JOIN (SELECT s_nationkey AS n_nationkey, avg(s_acctbal) AS v FROM supplier GROUP BY 1) USING (n_nationkey)")
def q_region_effects(spark, d):
    effects = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.avg("s_acctbal").alias("v"))
    groups = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") < 2, "first").otherwise("rest").alias("group"))
    groups = assembly.members(groups, effects, "n_nationkey")
    return rounded(display.region_effects(effects, groups, "n_nationkey", "v"), "v")


@query("SELECT count(*) FILTER (NOT (v BETWEEN lo AND hi)) AS badly_formed, count(*) FILTER (NOT (least(lo, hi) >= 0 AND greatest(lo, hi) <= 3000)) AS clipped FROM (SELECT c_acctbal AS v, c_acctbal - 100 AS lo, c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN -50 ELSE 50 END AS hi FROM customer)")
def q_interval_faults(spark, d):
    v = F.col("c_acctbal")
    rows = table(spark, d, "customer").select(v.alias("v"), (v - 100).alias("lo"), (v + F.when(F.col("c_custkey") % 7 == 0, -50).otherwise(50)).alias("hi"))
    return rows.agg(F.count_if(display.interval_fault(F.col("v"), F.col("lo"), F.col("hi"))).alias("badly_formed"), F.count_if(display.outside_axis(F.col("lo"), F.col("hi"), (0.0, 3000.0))).alias("clipped"))


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS other_ids, 1 AS other_regions, false AS other_digest")
def q_provenance(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("place"), F.col("c_custkey").cast("string").alias("name"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("name"))
    saved = ids.withColumn("name", F.when(F.col("place") % 10 == 0, F.lit("x")).otherwise(F.col("name")))
    out = display.provenance_faults(ids, saved, regions, regions.where("place > 0"), sinks.digest({"a": 1, "b": 2}), sinks.digest({"b": 2, "a": 1}))
    return out.withColumn("other_regions", F.col("other_regions").cast("int"))


@query("WITH c AS (SELECT l_returnflag, l_linestatus, l_linenumber AS l_shipmode, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY l_returnflag), 9) AS share FROM c")
def q_frequencies(spark, d):
    rows = table(spark, d, "lineitem").withColumn("l_shipmode", F.col("l_linenumber"))
    return display.frequencies(rows, ["l_returnflag"], ["l_linestatus", "l_shipmode"]).withColumn("share", F.round("share", 9))


@query("SELECT c_nationkey, count(*) AS n, round(avg(CAST(c_acctbal < -50 AS INT)), 9) AS negative, round(avg(CAST(abs(c_acctbal) <= 50 AS INT)), 9) AS zero, round(avg(CAST(c_acctbal > 50 AS INT)), 9) AS positive FROM customer GROUP BY 1")
def q_sign_fractions(spark, d):
    out = display.sign_fractions(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", 50.0)
    return out.withColumns({c: F.round(c, 9) for c in ("negative", "zero", "positive")})


@query("WITH e AS (SELECT event_type, CAST(event_id % 2 AS INT) AS y, (event_id * 7 % 1000) / 1000.0 AS p FROM events), b AS (SELECT event_type, least(1 + CAST(floor(p * 5) AS INT), 5) AS bin, count(*) AS n, sum(y) AS responders, avg(p) AS mean_p FROM e GROUP BY ALL) SELECT event_type, bin, n, responders, round(mean_p, 9) AS mean_p, round(responders / n, 9) AS observed FROM b")
def q_display_bins(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("event_id") % 2).cast("int").alias("y"), ((F.col("event_id") * 7 % 1000) / 1000.0).alias("p"))
    return display.display_bins(rows, "y", "p", ["event_type"]).select("event_type", "bin", "n", "responders", F.round("mean_p", 9).alias("mean_p"), F.round("observed", 9).alias("observed"))


@query("SELECT o_orderkey, o_orderpriority, round(c_acctbal, 2) AS c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def q_matched_once(spark, d):
    # every order with its customer's balance: customers are brought to one row an order first
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return display.matched_once(o, o.join(c, "o_custkey").select("o_orderkey", "c_acctbal"), ["o_orderkey"], ["c_acctbal"]).select("o_orderkey", "o_orderpriority", F.round("c_acctbal", 2).alias("c_acctbal"))


# --- associations by closed forms


TWO = S + ", r AS (SELECT source, row_pos, y, ln(1 + n_chars) AS x FROM s), g AS (SELECT source, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, coalesce(avg(x) FILTER (y = 0), 0) AS m0, coalesce(avg(x) FILTER (y = 1), 0) AS m1, var_pop(x) FILTER (y = 0) AS v0, var_pop(x) FILTER (y = 1) AS v1 FROM r GROUP BY source), w AS (SELECT *, sqrt((n0 * v0 + n1 * v1) / nullif(n0 + n1 - 2, 0)) AS sd, m1 - m0 AS whole, CASE WHEN n0 + n1 <= 2 OR least(n0, n1) = 0 THEN 'not estimable: rank' WHEN least(n0, n1) = 1 THEN 'not estimable: leverage' WHEN NOT n0 * v0 + n1 * v1 > 0 THEN 'not estimable: deviation' ELSE 'ok' END AS status FROM g)"


def sources(spark, d):
    return design(spark, d).select("row_pos", "source", "y", "log_chars")


@query(TWO + " SELECT source, n0 + n1 AS n, status, CASE WHEN status = 'ok' THEN round(whole, 6) END AS estimate, CASE WHEN status = 'ok' THEN round(sqrt(n0 * v0 / ((n0 - 1) * (n0 - 1)) + n1 * v1 / ((n1 - 1) * (n1 - 1))), 6) END AS se, CASE WHEN status = 'ok' THEN round(whole / sd, 6) END AS standardized, CASE WHEN status = 'ok' THEN round(1 / least(n0, n1), 9) END AS max_leverage FROM w")
def q_association_rows(spark, d):
    from cohortloom.operators.least_squares import associations

    out = associations(sources(spark, d), ["source"], "log_chars", "y", [], with_influence=False, with_status=True)
    return out.select("source", F.col("n").cast("long").alias("n"), "status", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"), F.round("standardized", 6).alias("standardized"), F.round("max_leverage", 9).alias("max_leverage"))


@query(TWO + ", l AS (SELECT r.source, row_pos, y, n0, n1, sd, whole, status, CASE WHEN status = 'ok' THEN CASE WHEN y = 1 THEN (n1 * m1 - x) / (n1 - 1) - m0 ELSE m1 - (n0 * m0 - x) / (n0 - 1) END END AS loo FROM r JOIN w USING (source)) SELECT source, row_pos, status, round(loo / sd, 6) AS coefficient, round((loo - whole) / sd, 6) AS change, sign(loo) <> sign(whole) AS sign_changed, CASE WHEN status = 'ok' THEN round(CASE WHEN y = 1 THEN 1 / n1 ELSE 1 / n0 END, 9) END AS leverage, CASE WHEN status = 'ok' THEN 1.0::DOUBLE END AS vif FROM l")
def q_influence_rows(spark, d):
    from cohortloom.operators.least_squares import influence_rows

    out = influence_rows(sources(spark, d), ["source"], "log_chars", "y", [], with_status=True)
    return out.select("source", "row_pos", "status", F.round("coefficient", 6).alias("coefficient"), F.round("change", 6).alias("change"), "sign_changed", F.round("leverage", 9).alias("leverage"), F.round("vif", 6).alias("vif"))


@query("SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_samp(n_chars) OVER (), 6) AS z_n_chars, round((log_chars - avg(log_chars) OVER ()) / stddev_samp(log_chars) OVER (), 6) AS z_log_chars FROM (SELECT doc_id, n_chars, ln(1 + n_chars) AS log_chars FROM documents)")
def q_design_table(spark, d):
    cohort = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.log1p(F.col("n_chars").cast("double")).alias("log_chars"))
    return rounded(families.design_table(cohort, ["n_chars"], ["log_chars"]).select("doc_id", "z_n_chars", "z_log_chars"), "z_n_chars", "z_log_chars")


VARIANT_SQL = "WITH v AS (SELECT unnest(range(1, 8)) AS i, unnest(['wholeBrain', 'cerebellarCortex', 'petprep', 'same_seg_noPVC', 'PVC4', 'PVC5.4', 'PVC6']) AS v), m AS (SELECT unnest(['CP', 'CPT']) AS m), f AS (SELECT v || '_' || m AS a, 'CORE_' || m AS b FROM v, m WHERE i <= 4 UNION ALL SELECT v || '_' || m, 'same_seg_noPVC_' || m FROM v, m WHERE i <= 3), o AS (SELECT v || '_CP' AS a, 'CORE_C' AS b FROM v UNION ALL SELECT v || '_CPT', v || '_CP' FROM v), p AS (SELECT a, b FROM f UNION ALL SELECT a, b FROM o)"


@query(VARIANT_SQL + ", n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS k FROM (SELECT a AS name FROM p UNION SELECT b FROM p)), x AS (SELECT p_partkey % (SELECT count(*) FROM n) AS k, avg(p_retailprice) AS v FROM part GROUP BY 1), y AS (SELECT name, v FROM n JOIN x USING (k)) SELECT p.a, p.b, round(ya.v - yb.v, 6) AS difference FROM p JOIN y ya ON ya.name = p.a JOIN y yb ON yb.name = p.b")
def q_comparison_list(spark, d):
    """The 28 comparisons of models, parts' mean prices playing the models' results."""
    pairs = families.processing_comparisons()
    names = sorted({n for p in pairs for n in p})
    numbered = spark.createDataFrame(list(enumerate(names)), "k long, name string")
    values = table(spark, d, "part").groupBy((F.col("p_partkey") % len(names)).alias("k")).agg(F.avg("p_retailprice").alias("v")).join(numbered, "k")
    one, two = (values.select(F.col("name").alias(c), F.col("v").alias(f"v{c}")) for c in "ab")
    listed = spark.createDataFrame(pairs, "a string, b string").join(one, "a").join(two, "b")
    return listed.select("a", "b", F.round(F.col("va") - F.col("vb"), 6).alias("difference"))


@query("SELECT v || '_' || m AS name, v AS variant, m AS model, n AS n_columns, (SELECT count(*) FROM part WHERE p_partkey % 14 = 2 * i + j) AS parts FROM (SELECT unnest(range(7)) AS i, unnest(['wholeBrain', 'cerebellarCortex', 'petprep', 'same_seg_noPVC', 'PVC4', 'PVC5.4', 'PVC6']) AS v), (SELECT unnest(range(2)) AS j, unnest(['CP', 'CPT']) AS m, unnest([4, 5]) AS n)")
def q_processing_models(spark, d):
    """The 14 models of the processing engine, each with the parts that fall to it."""
    models = spark.createDataFrame([(k, n, v, m, len(c)) for k, (n, v, m, c) in enumerate(families.processing_models(COLUMNS))], "k long, name string, variant string, model string, n_columns int")
    parts = table(spark, d, "part").groupBy((F.col("p_partkey") % 14).alias("k")).agg(F.count(F.lit(1)).alias("parts"))
    return models.join(parts, "k", "left").select("name", "variant", "model", "n_columns", F.coalesce("parts", F.lit(0)).cast("long").alias("parts"))


@query("SELECT base, added, metric, CASE WHEN metric = 'brier' THEN -hi ELSE lo END AS lo, CASE WHEN metric = 'brier' THEN -lo ELSE hi END AS hi FROM (SELECT r_name AS base, n_name AS added, CASE WHEN n_nationkey % 2 = 0 THEN 'auc' ELSE 'brier' END AS metric, n_nationkey / 10 - 1 AS lo, n_nationkey / 10 + 1 AS hi FROM nation JOIN region ON n_regionkey = r_regionkey)")
def q_comparison_display(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("base"), F.col("n_name").alias("added"), F.when(F.col("n_nationkey") % 2 == 0, "auc").otherwise("brier").alias("metric"), (F.col("n_nationkey") / 10 - 1).alias("lo"), (F.col("n_nationkey") / 10 + 1).alias("hi"))
    return protocol.comparison_display(rows)


@query(S + ", c AS (SELECT * FROM (SELECT DISTINCT lang FROM s), (SELECT unnest(['all','responder','nonresponder']) AS group_name)), k AS (SELECT group_name, c.lang AS level, count(s.row_pos) AS k FROM c LEFT JOIN s ON s.lang = c.lang AND (group_name = 'all' OR (group_name = 'responder') = (s.y = 1)) GROUP BY ALL), z AS (SELECT *, sum(k) OVER (PARTITION BY group_name) AS n FROM k) SELECT 'lang' AS field, level, group_name, printf('%d (%.1f%%)', k, 100.0 * k / n) AS shown FROM z")
def q_unpivot_table(spark, d):
    return protocol.descriptive_display(metrics.descriptives(scored(spark, d), "y", ["n_chars"], ["lang"])).where("field = 'lang'")


# --- plans and fits: what SQL can say about them


@query("SELECT model, (SELECT count(*) FROM labels) AS n, (SELECT count(*) FROM labels) AS people, (SELECT sum(quality) FROM labels)::BIGINT AS positives, 0 AS failed, 0 AS outside, true AS certified FROM (SELECT unnest(['C', 'CP']) AS model)")
def q_nested_coverage(spark, d):
    """Every person predicted once by each model, by fits within their bounds; grids of 2 x 2 here, whole ones in q_elastic_net_nested."""
    from cohortloom.plans.prediction import Settings, run_nested

    got = run_nested(design(spark, d), _plan(spark, d), {m: COLUMNS[m] for m in ("C", "CP")}, BINARY, Settings(c_grid=(0.1, 1.0), l1_grid=(0.0, 1.0), seconds=600.0))
    n = lambda c, name: F.count_if(c).cast("int").alias(name)
    return got.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_pos").alias("people"), F.sum("y").cast("long").alias("positives"), n(F.col("status") != "PASS", "failed"), n(~F.col("p").between(0, 1), "outside"), F.coalesce((F.max("kkt") <= 1e-8) & (F.max("gap") <= 1e-10) & (F.max("agreement") <= 1e-5), F.lit(False)).alias("certified"))


@query("SELECT repeat, scanner, y, n FROM (SELECT re AS repeat, l.doc_id % 2 AS scanner, quality AS y, count(*) AS n FROM labels l, range(2) a(re) GROUP BY ALL)")
def q_joint_inner(spark, d):
    """Validated once in each repeat and outer fold that trains on it: in four of five."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("row_pos"), F.col("quality").alias("y"))
    scanner = labels.select("row_pos", (F.col("row_pos") % 2).alias("scanner"))
    plan = splits.joint_inner(splits.stratified(labels, "y", 5, 2, 1), scanner, "y", 3, 2)
    seen = plan.where("role = 'validation'").groupBy("repeat", "row_pos", "y").agg(F.count(F.lit(1)).alias("c")).where("c = 4").join(scanner, "row_pos")
    return seen.groupBy(F.col("repeat").cast("long").alias("repeat"), "scanner", "y").agg(F.count(F.lit(1)).alias("n"))


@query(PRED + " SELECT model, repeat, true AS solved FROM m GROUP BY ALL")
def q_calibration_solved(spark, d):
    """The fitted offsets and slopes solve their equations: shifted probabilities have the outcome's mean, residuals are orthogonal."""
    from cohortloom.operators.newton import calibration

    rows = predicted(spark, d)
    fits = calibration(rows, ["model", "repeat"]).where("status = 'ESTIMABLE'")
    z = C.logit(F.col("p"))
    both = rows.join(fits, ["model", "repeat"]).withColumns({"r1": F.col("y") - C.expit(z + F.col("offset")), "r2": F.col("y") - C.expit(F.col("intercept") + F.col("slope") * z)})
    return both.groupBy("model", "repeat").agg(((F.abs(F.avg("r1")) < 1e-8) & (F.abs(F.avg("r2")) < 1e-8) & (F.abs(F.avg(F.col("r2") * z)) < 1e-7)).alias("solved"))


@query("WITH z AS (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS e FROM embeddings), c AS (SELECT vec_id, k, e - avg(e) OVER (PARTITION BY vec_id) AS z FROM z) SELECT a.k AS i, b.k AS j, round(covar_samp(a.z, b.z), 6) + 0 AS cov FROM c a JOIN c b ON a.vec_id = b.vec_id AND b.k IN (0, 1) GROUP BY a.k, b.k")
def q_component_moments(spark, d):
    n, total, products = pattern.moments(_centred(spark, d), "z")
    rows = [(i, j, float((products[i, j] - total[i] * total[j] / n) / (n - 1))) for i in range(len(total)) for j in (0, 1)]
    return rounded(spark.createDataFrame(rows, "i long, j long, cov double"), "cov")


@query("SELECT q AS quantity, 2000 AS total, true AS enough, true AS ordered, (SELECT count(*) FROM embeddings) AS people FROM (SELECT unnest(['primary_type_1', 'primary_type_2', 'primary_type_difference', 'sensitivity_type_1', 'sensitivity_type_2', 'sensitivity_type_difference', 'primary_response', 'plus_type_response', 'clinical_response', 'raw_region_0', 'raw_region_1', 'partial_region_0', 'partial_region_1']) AS q)")
def q_bridge_intervals(spark, d):
    """Vectors as people, 2,000 draws of them and of their pattern: two designs of a three-level factor, three of a response, raw and partial rank correlations."""
    from cohortloom.operators import drawn, weights
    from cohortloom.plans import bridge
    from cohortloom.plans.catalogue_spatial import rows_of
    from cohortloom.sources.workspace import shared_folder

    draws, seed, folder = 2000, 20260917, shared_folder(spark, "bridge")
    rows = rows_of(spark, d)
    n, total, products = pattern.moments(rows, "z")
    f = pattern.component_of_moments(n, total, products)
    loading = f["loading"] * pattern.sign_by_largest(f["loading"])
    scale = float((loading @ (products - n * f["centre"][:, None] * f["centre"][None, :]) @ loading / (n - 1)) ** 0.5)
    loadings = weights.component_draws(rows, loading, f["centre"], int(n), draws, seed)
    k = F.col("row_pos")
    flag = lambda c: c.cast("double")
    cohort = rows.select("row_pos", "z", (F.xxhash64(k) % 2 == 0).cast("int").alias("y"), flag(k % 3 == 1).alias("focal"), flag(k % 3 == 2).alias("both"), F.col("z")[5].alias("age"), flag(k % 2 == 0).alias("female"), flag(F.floor(k / 2) % 2 == 0).alias("scanner"), F.col("z")[7].alias("duration"), F.col("z")[0].alias("region_0"), F.col("z")[1].alias("region_1"))
    base = ["age", "female", "scanner"]
    known = drawn.known_draws(loadings, f["centre"], int(n), draws, seed, scale, bridge.BUNDLE)
    told = bridge.block_draws(cohort, known, {"primary": (base, ["focal", "both"]), "sensitivity": ([*base, "duration"], ["focal", "both"])}, {"primary": base, "plus_type": [*base, "focal", "both"], "clinical": [*base, "duration"]}, ["region_0", "region_1"], ["age"], ["female", "scanner"], folder)
    out = bridge.bridge_intervals(told, draws)
    return out.select("quantity", F.col("total").cast("int").alias("total"), (F.col("valid") >= 0.95 * F.col("total")).alias("enough"), (F.col("lo") <= F.col("hi")).alias("ordered"), F.lit(int(n)).cast("long").alias("people"))


# --- regional panels and imaging tables


@query("WITH v AS (SELECT l_returnflag AS subject, l_linenumber AS label, avg(l_extendedprice) AS mean FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL), p AS (SELECT unnest([1, 2, 3, 4]) AS label, unnest(['b', 'a', 'b', 'a']) AS name, unnest(['L', 'L', 'R', 'R']) AS side) SELECT subject, string_agg(CAST(CAST(round(mean) AS BIGINT) AS VARCHAR), ',' ORDER BY name, side) AS regions FROM v JOIN p USING (label) GROUP BY subject")
def q_unilateral_panel(spark, d):
    stats = table(spark, d, "lineitem").where("l_linenumber <= 4").groupBy(F.col("l_returnflag").alias("subject"), F.col("l_linenumber").alias("label")).agg(F.avg("l_extendedprice").alias("mean"))
    pairs = spark.createDataFrame([("b", "L", 1), ("a", "L", 2), ("b", "R", 3), ("a", "R", 4)], "name string, side string, label long")
    return imaging.panel(stats.withColumn("label", F.col("label").cast("long")), pairs, ["subject"]).select("subject", F.array_join(F.transform("regions", lambda v: F.round(v).cast("long").cast("string")), ",").alias("regions"))


VOXELS = "WITH x AS (SELECT l_suppkey AS label, l_partkey % 50 AS i, l_orderkey % 40 AS j, l_linenumber AS k FROM lineitem)"


def grid(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(imaging.integer_labels(F.col("l_suppkey")).alias("label"), (F.col("l_partkey") % 50).alias("i"), (F.col("l_orderkey") % 40).alias("j"), F.col("l_linenumber").alias("k"))


@query(VOXELS + " SELECT label, min(i) AS i_min, max(i) AS i_max, min(j) AS j_min, max(j) AS j_max, min(k) AS k_min, max(k) AS k_max FROM x GROUP BY label")
def q_bounding_boxes(spark, d):
    return imaging.bounding_boxes(grid(spark, d))


_ORDERS = "[[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]"
_PLACE = "CASE WHEN m % 8 & {b} > 0 THEN [50, 40, 8][o[{w}] + 1] - 1 - [i, j, k][o[{w}] + 1] ELSE [i, j, k][o[{w}] + 1] END"


@query("WITH v AS (SELECT l_partkey % 50 AS i, l_orderkey % 40 AS j, l_linenumber AS k FROM lineitem), m AS (SELECT m, " + _ORDERS + "[m // 8 + 1] AS o FROM range(48) t(m)), c AS (SELECT m, " + ", ".join(f"{_PLACE.format(b=1 << w, w=w + 1)} AS {n}" for w, n in enumerate("xyz")) + " FROM v, m) SELECT m AS image, count(*) AS voxels, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y, CAST(sum(z) AS BIGINT) AS z, CAST(sum(x * y + y * z * 3 + z * x * 7) AS BIGINT) AS mixed FROM c GROUP BY m")
def q_orientations(spark, d):
    """The same voxels in images of all 48 orientations, slightly oblique, brought to the world's axes."""
    from itertools import permutations

    rows = []
    for m in range(48):
        order = list(permutations(range(3)))[m // 8]
        affine = [[(-2.0 if m % 8 & 1 << w else 2.0) if order[w] == v else 0.1 * (w - v) for v in range(3)] for w in range(3)]
        rows.append((m, [x for r in affine for x in r], [50, 40, 8]))
    images = spark.createDataFrame(rows, "image long, affine array<double>, shape array<int>")
    voxels = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("i"), (F.col("l_orderkey") % 40).alias("j"), F.col("l_linenumber").alias("k"))
    voxels = voxels.withColumn("image", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(47).cast("long"))))
    x, y, z = (F.col(c).cast("long") for c in "xyz")
    return imaging.canonical(voxels, images, ["image"]).groupBy("image").agg(F.count(F.lit(1)).alias("voxels"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(z).alias("z"), F.sum(x * y + y * z * 3 + z * x * 7).alias("mixed"))


@query("WITH p AS (SELECT l_returnflag AS subject, l_linenumber AS i, l_suppkey % 7 + 1 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), c AS (SELECT l_returnflag AS subject, l_linenumber AS i, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag AS subject, l_suppkey % 7 + 1 AS label, avg(l_extendedprice) / 25 AS b FROM lineitem GROUP BY ALL) SELECT subject, i, round(s.l - c.v, 2) AS residual FROM c JOIN (SELECT p.subject, p.i, sum(p.v * b) AS l FROM p JOIN b ON b.subject = p.subject AND b.label = p.j GROUP BY ALL) s USING (subject, i)")
def q_bundle_residuals(spark, d):
    """Normal equations of line numbers by suppliers' classes, a coefficient a class, for each return flag."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("subject"), F.col("l_linenumber").alias("i"), (F.col("l_suppkey") % 7 + 1).alias("j"), "l_quantity", "l_extendedprice")
    products = li.groupBy("subject", "i", "j").agg(F.sum("l_quantity").alias("v"))
    cross = li.groupBy("subject", "i").agg(F.sum("l_extendedprice").alias("v"))
    beta = li.groupBy("subject", F.col("j").alias("label")).agg((F.avg("l_extendedprice") / 25).alias("b"))
    return imaging.bundle_residuals(products, cross, beta, ["subject"]).withColumn("residual", F.round("residual", 2))


@query("SELECT model, base, metric, (SELECT count(*) FROM labels) AS n, (SELECT count(*) FROM labels) AS people, 0 AS failed, true AS certified, true AS between FROM (SELECT unnest(['full', 'without_x1', 'without_x2', 'without_both']) AS model, unnest([NULL, 'without_x1', 'without_x2', 'without_both']) AS base), (SELECT unnest(['auc', 'brier']) AS metric) WHERE base IS NOT NULL")
def q_ablations(spark, d):
    """The full model against those without x1, x2 and both on one supplied plan: everyone is predicted once by certified fits, and each difference lies within its interval's reach."""
    from cohortloom.plans.prediction import Settings, run_ablations

    out = run_ablations(design(spark, d), _plan(spark, d), COLUMNS["C"], {"x1": ["x1"], "x2": ["x2"]}, BINARY, Settings(c_grid=(0.1, 1.0), l1_grid=(0.0, 1.0), seconds=600.0), draws=200)
    n = lambda c, name: F.count_if(c).cast("int").alias(name)
    told = out["predictions"].groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_pos").alias("people"), n(F.col("status") != "PASS", "failed"), F.coalesce((F.max("kkt") <= 1e-8) & (F.max("gap") <= 1e-10) & (F.max("agreement") <= 1e-5), F.lit(False)).alias("certified"))
    differences = out["comparisons"].select("base", "metric", ((F.col("lo") <= F.col("hi")) & (F.col("difference") >= F.col("lo") - (F.col("hi") - F.col("lo"))) & (F.col("difference") <= F.col("hi") + (F.col("hi") - F.col("lo")))).alias("between"))
    return told.join(differences, told["model"] == differences["base"]).select("model", "base", "metric", "n", "people", "failed", "certified", "between")


@query(VARIANT_SQL + ", c AS (SELECT a, count(*) AS comparisons FROM p GROUP BY a), n AS (SELECT count(*) AS n, sum(quality)::BIGINT AS positives FROM labels) SELECT v || '_' || m AS model, n, n AS people, positives, 12 AS candidates, 36 AS inner_scores, 3 AS tasks, 0 AS wrong, true AS certified, true AS agree, comparisons FROM v, m, n JOIN c ON c.a = v || '_' || m")
def q_processing_engine(spark, d):
    """The 14 models of seven variants of x1 and x2 on one plan: people predicted once, grids of 2 x 2 with every inner score kept, the choice that the scores
    call for, fits that agree with independent ones in training and tested rows, and how many comparisons a model leads."""
    from cohortloom.plans import processing
    from cohortloom.plans.prediction import Settings
    from cohortloom.sources.workspace import written

    cohort = written(design(spark, d), "cohort")
    k = F.col("row_pos")
    made = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.coalesce(F.col("x1"), k % (90 + i)).cast("double").alias("x1"), F.sin(k + F.lit(0.1 * i)).alias("x2")) for i, v in enumerate(families.VARIANTS[1:])]))
    variants = cohort.select("row_pos", made.alias("_v")).select("row_pos", "_v.*")
    got = processing.run_processing(cohort, variants, _plan(spark, d), COLUMNS, ["x1", "x2"], BINARY, Settings(c_grid=(0.1, 1.0), l1_grid=(0.0, 1.0), seconds=600.0))
    grid = processing.candidates(got)
    told = got.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_pos").alias("people"), F.sum("y").cast("long").alias("positives"), ((F.max("kkt") <= 1e-8) & (F.max("gap") <= 1e-10)).alias("certified"))
    scores = grid.groupBy("model").agg(F.count(F.lit(1)).cast("int").alias("candidates"), F.sum(F.size("briers")).cast("int").alias("inner_scores"))
    chosen = processing.choice_faults(grid).select("model", F.col("tasks").cast("int").alias("tasks"), F.col("wrong").cast("int").alias("wrong"))
    agree = processing.agreements(got).select("model", ((F.col("tests") <= 1e-5) & (F.col("train") <= 1e-5) & (F.col("objective") <= 1e-10)).alias("agree"))
    leads = spark.createDataFrame(families.processing_comparisons(), "model string, other string").groupBy("model").agg(F.count(F.lit(1)).alias("comparisons"))
    return told.join(scores, "model").join(chosen, "model").join(agree, "model").join(leads, "model")


@query("WITH f AS (SELECT l_orderkey % 2 AS hemisphere, CASE WHEN l_suppkey % 34 = l_linenumber % 34 THEN l_suppkey % 34 ELSE l_partkey % 34 END AS label FROM lineitem), v AS (SELECT p_partkey % 2 AS hemisphere, (p_partkey // 2)::BIGINT % 34 AS label, avg(p_retailprice) AS value FROM part GROUP BY ALL) SELECT v.hemisphere, v.label, round(value, 6) AS value, count(*) AS faces FROM v JOIN f USING (hemisphere, label) GROUP BY ALL")
def q_parcel_faces(spark, d):
    """Line items as faces of two hemispheres with 34 parcels each, whose values are parts' mean prices."""
    faces = table(spark, d, "lineitem").select((F.col("l_orderkey") % 2).alias("hemisphere"), (F.col("l_partkey") % 34).alias("v1"), (F.col("l_suppkey") % 34).alias("v2"), (F.col("l_linenumber").cast("long") % 34).alias("v3"))
    values = table(spark, d, "part").groupBy((F.col("p_partkey") % 2).alias("hemisphere"), (F.expr("p_partkey div 2") % 34).alias("label")).agg(F.avg("p_retailprice").alias("value"))
    return rounded(regional.parcel_faces(faces, values), "value")


@query("SELECT l.doc_id AS row_pos, l.quality AS y, coalesce(nullif(d.lang, ''), 'none') AS epilepsy_classification, coalesce(nullif(d.source, ''), 'none') AS etiology_group, 'S' || (l.doc_id % 2) AS scanner, round(d.n_chars::DOUBLE, 6) AS baseline FROM labels l JOIN documents d USING (doc_id)")
def q_first_table(spark, d):
    """Labelled documents as the cohort, all documents' languages and sources as its metadata."""
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("S"), F.col("doc_id").cast("string"))
    word = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none"))
    metadata = docs.select(name.alias("study_id"), word("lang").alias("epilepsy_type"), word("source").alias("etiology_detailed"), F.concat(F.lit("S"), (F.col("doc_id") % 2).cast("string")).alias("scanner_source_key"))
    cohort = table(spark, d, "labels").join(docs.select("doc_id", "n_chars"), "doc_id").select(name.alias("study_id"), F.col("doc_id").alias("row_pos"), F.col("quality").alias("y"), F.log1p(F.col("n_chars").cast("double")).alias("log1p_baseline_monthly_frequency"))
    rows = tables.first_table(cohort, metadata)
    return rows.select("row_pos", "y", "epilepsy_classification", "etiology_group", "scanner", F.round("baseline_monthly_frequency_reconstructed", 6).alias("baseline"))


@query(VOXELS + ", g AS (SELECT s_suppkey AS label, s_nationkey % 4 AS g FROM supplier UNION ALL SELECT -1, 9) SELECT g.g AS \"group\", count(x.label) AS voxels FROM g LEFT JOIN x ON x.label = g.label AND x.i = 7 GROUP BY g.g")
def q_overlay_counts(spark, d):
    groups = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("label"), (F.col("s_nationkey") % 4).cast("long").alias("group")).union(spark.createDataFrame([(-1, 9)], "label int, group long"))
    return imaging.overlay_counts(grid(spark, d), groups, "i", 7)


@query("SELECT 'sub-' || n_nationkey AS subject, 'convert' AS step, 'mri_convert|' || n_name || '.mgz|--voxsize|2' AS argv FROM (SELECT n_nationkey, replace(n_name, ' ', '_') AS n_name FROM nation)")
def q_tool_plan(spark, d):
    rows = table(spark, d, "nation").select(F.concat(F.lit("sub-"), F.col("n_nationkey").cast("string")).alias("subject"), F.concat(F.regexp_replace("n_name", " ", "_"), F.lit(".mgz")).alias("image"))
    return imaging.invocations(rows, "convert", ["mri_convert", F.col("image"), "--voxsize", "2"]).withColumn("argv", F.array_join("argv", "|"))


@query("SELECT p.p_partkey, s.s_acctbal AS value FROM part p JOIN supplier s ON s.s_suppkey = p.p_size % 10 WHERE p.p_partkey % 3 = 0")
def q_position_gather(spark, d):
    values = table(spark, d, "supplier").select(F.col("s_suppkey").alias("from_pos"), F.col("s_acctbal").alias("value"))
    crosswalk = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("to_pos"), (F.col("p_size") % 10).cast("long").alias("from_pos"))
    return assembly.gather(values, crosswalk, "from_pos").select(F.col("to_pos").alias("p_partkey"), "value")


@query("SELECT 25 AS n, 12 AS n_right, 25 AS distinct_positions FROM range(1)")
def q_atlas_rows(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("parcel_pos"), F.when(F.col("n_nationkey") % 2 == 1, "R").otherwise("L").alias("hemi"), ((F.col("n_nationkey") + 1) % 25).alias("homologue_pos"))
    out = contracts.parcel_rules(rows)
    return out.select(F.col("n").cast("int").alias("n"), F.col("n_right").cast("int").alias("n_right")).withColumn("distinct_positions", F.lit(rows.select("parcel_pos").distinct().count()))


@query(PRED + ", n AS (SELECT count(*) AS n FROM s) SELECT model, count(*) AS cells, count(*) AS distinct_cells, 0 AS bad_p, count(*) = 4 * any_value(n.n) AS complete FROM m, n GROUP BY model")
def q_prediction_cells(spark, d):
    out = contracts.predictions_rules(predicted(spark, d), scored(spark, d).select("row_pos"), 4)
    return out.withColumn("bad_p", F.col("bad_p").cast("int"))


@query("SELECT round(max(abs(a - b)), 6) AS largest, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS one_sided FROM (SELECT o_totalprice AS a, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice * 1.000001 END AS b FROM orders)")
def q_largest_difference(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_totalprice").alias("a"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") * 1.000001).alias("b"))
    return rounded(contracts.largest_difference(rows, "a", "b"), "largest")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: (v::DOUBLE / n) * 3)), 5) AS total FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS n FROM embeddings)")
def q_unit_rows(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", C.unit(F.col("embedding").cast("array<double>")).alias("u"))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, v: s + v * 3), 5).alias("total"))


# --- texts


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE event_id % 4 WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS refused FROM events")
def q_parse_json_props(spark, d):
    """Objects parsed under a schema, and which of their texts the strict reader refuses: repeated keys, non-finite numbers."""
    n = F.col("event_id") % 4
    text = F.when(n == 1, F.concat(F.lit('{"k": 1, '), F.substring("props", 2, 1_000_000))).when(n == 2, F.lit('{"k": NaN}')).otherwise(F.col("props"))
    e = table(spark, d, "events").withColumn("text", text)
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), tables.json_objects(F.col("text")).isNotNull().alias("refused"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+'), lambda x: x <> '')) AS n_fields FROM documents")
def q_parse_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(stats_text.fields(F.col("text"))).alias("n_fields"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(round(CAST(o_totalprice / 7 AS DECIMAL(38,12)), 3) AS VARCHAR) AS shown FROM (SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders)")
def q_half_up(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.round("o_totalprice", 2).alias("v"))
    return o.select("id", C.half_up(F.col("v") / 7).cast("string").alias("shown"))


@query("SELECT p_brand AS subject, 'lh' AS hemi, p_mfgr_ AS parcel, CAST(p_size AS DOUBLE) AS area, round(p_retailprice, 2) AS thickness FROM (SELECT p_brand, 'p' || p_partkey AS p_mfgr_, p_size, p_retailprice FROM part)")
def q_parse_parcels(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("subject"), F.lit("lh").alias("hemi"), F.concat_ws("  ", F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.lit("7"), F.col("p_size").cast("string"), F.lit("x"), F.format_string("%.2f", "p_retailprice"), F.lit("9 9")).alias("line"))
    broken = p.limit(1).select("subject", "hemi", F.lit("# TableCol 1 ColHeader StructName").alias("line"))
    return stats_text.parcel_thickness(p.unionByName(broken))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS subject, CAST(s_nationkey AS INT) AS label, round(s_acctbal, 2) AS value FROM supplier")
def q_parse_gtm(spark, d):
    s = table(spark, d, "supplier")
    line = F.concat_ws(" ", F.lit("1"), F.col("s_nationkey").cast("string"), F.lit("name cortex 10 1.5"), F.format_string("%.2f", "s_acctbal"), F.lit("0.5"))
    rows = s.select(F.col("s_suppkey").cast("string").alias("subject"), line.alias("line"))
    return stats_text.gtm_table(rows.unionByName(rows.select("subject", F.lit("  ").alias("line"))))


@query("SELECT n_nationkey, 1 AS kind, round(1.0 + n_nationkey, 3) AS corner, round(n_nationkey / 4, 3) AS shift FROM nation")
def q_parse_transform(spark, d):
    n = F.col("n_nationkey").cast("double")
    f = lambda v: F.format_string("%.6e", v)
    z, one = F.lit("0.0 "), F.lit(" 1.0")
    text = F.concat(F.lit("type      = 1\nnxforms   = 1\nmean      = 0 0 0\n1 4 4\n"), f(n + 1), F.lit(" 0.0 0.0 "), f(n / 4), F.lit("\n0.0 1.0 0.0 0.0\n0.0 0.0 1.0 0.0\n"), z, z, z, one, F.lit("\nsrc volume info\n"))
    rows = table(spark, d, "nation").withColumn("text", text)
    kind, matrix = stats_text.transform_matrix(F.col("text"))
    return rows.select("n_nationkey", kind.alias("kind"), F.round(matrix[0][0], 3).alias("corner"), F.round(matrix[0][3], 3).alias("shift"))


@query("SELECT n_name || '.nii' AS source_nii, 'sub/' || n_name || '.nii' AS target_nii FROM nation")
def q_selection_manifest(spark, d):
    n = table(spark, d, "nation")
    rows = n.select(F.concat("n_name", F.lit(".nii")).alias("source_nii"), F.concat(F.lit("sub/"), "n_name", F.lit(".nii")).alias("target_nii"), F.when(F.col("n_nationkey") % 2 == 0, " pass ").otherwise("1").alias("review_pass"), F.when(F.col("n_nationkey") % 3 == 0, "{}").alias("pet_metadata_patch_json"), F.lit("yes").alias("metadata_patch_reviewed"))
    return tables.selection_manifest(rows).select("source_nii", "target_nii")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS study_id, CASE WHEN s_suppkey % 3 = 0 THEN 'c' WHEN s_suppkey % 3 = 1 THEN 'a' ELSE 'b' END AS first_key, round(s_acctbal, 2) AS v FROM supplier")
def q_feature_files(spark, d):
    s = table(spark, d, "supplier")
    at = lambda name, there: F.when(there, F.create_map(F.lit(name), F.round("s_acctbal", 2)))
    k = F.col("s_suppkey") % 3
    rows = s.select(F.col("s_suppkey").cast("string").alias("study_id"), at("a", k == 1).alias("one"), at("b", k != 0).alias("two"), at("c", F.lit(True)).alias("three"))
    out = tables.feature_files(rows, ("one", "two", "three"))
    return out.select("study_id", F.map_keys("features")[0].alias("first_key"), F.map_values("features")[0].alias("v"))


@query("SELECT 200 AS draws, count(*) AS rows_, 200 * count(*) AS total FROM labels")
def q_shared_draws(spark, d):
    """Every draw has as many rows as the cohort, of its positions alone."""
    n = table(spark, d, "labels").count()
    drawn = resampling.congruential_draws(spark, 200, n).where(F.col("row_pos").between(0, n - 1))
    return drawn.agg(F.count_distinct("draw").cast("int").alias("draws"), F.count_distinct("pos").alias("rows_"), F.count(F.lit(1)).alias("total"))


@query("WITH v AS (SELECT n_nationkey AS pos, avg(s_acctbal) AS value FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT r_regionkey AS draw, CAST(k AS BIGINT) AS pos, round(value, 6) AS value FROM region, range(25) t(k) JOIN v ON v.pos = (k * (2 * r_regionkey + 3) * (2 * r_regionkey + 3) + r_regionkey) % 25 WHERE r_regionkey <> 1")
def q_gather_identity(spark, d):
    """Nations' mean balances, taken along a permutation for each region (a step without common divisor with 25)."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    values = n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").groupBy(F.col("n_nationkey").cast("int").alias("pos")).agg(F.avg("s_acctbal").alias("value"))
    r = F.col("r_regionkey")
    step = (2 * r + 3) * (2 * r + 3)
    spins = table(spark, d, "region").where("r_regionkey <> 1").select(r.alias("draw"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long")), lambda k: ((k * step + r) % 25).cast("int")).alias("perm"))
    return rounded(spatial.gather_spins(values, spins).select(F.col("pos").cast("long").alias("pos"), "draw", "value"), "value")


QUERIES, SQL = catalogue.QUERIES, catalogue.SQL
