"""Queries of metrics, comparisons and usage, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.operators import metrics, relational
from arborix.operators.fixpoint import shared_folder
from arborix.streaming import attempts as log_folds

from . import driver_graph as g
from . import stages

J = g.JUDGED_SQL
_COUNTS = "count(*) FILTER (target = 1 AND prediction = 1) AS tp, count(*) FILTER (target = 0 AND prediction = 1) AS fp, count(*) FILTER (target = 0 AND prediction = 0) AS tn, count(*) FILTER (target = 1 AND prediction = 0) AS fn, count(*) FILTER (prediction IS NULL) AS unmatched"


def _metrics_sql(source: str, keys: str) -> str:
    """SQL of the four metrics over a relation with tp, fp, tn, fn; ``keys`` are passed on."""
    return f"""SELECT {keys} precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, accuracy FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
    CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + tn + fn) ELSE 0 END AS accuracy FROM {source})"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _rounded_sql(sql: str, names: tuple[str, ...], digits: int = 6) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({n}, {digits}) AS {n}' for n in names)}) FROM ({sql})"


M = metrics.METRICS


def _fold_sql(by: str, source: str = "judged") -> str:
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    folds = f"f AS (SELECT {b}fold, count(*) AS rows, {_COUNTS} FROM {source} GROUP BY {b}fold), fm AS ({_metrics_sql('f', f'{b}fold, rows, tp, fp, tn, fn, unmatched,')})"
    w = ", ".join(f"sum(rows * {m}) / sum(rows) AS weighted_{m}, sqrt(greatest(0, sum(rows * {m} * {m}) / sum(rows) - (sum(rows * {m}) / sum(rows)) ** 2)) AS weighted_std_{m}" for m in M)
    agg = f"a AS (SELECT {b}count(*) AS folds, sum(rows)::BIGINT AS rows, {w}, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn, sum(unmatched)::BIGINT AS unmatched FROM fm {group})"
    weighted = ", ".join(f"weighted_{m}, weighted_std_{m}" for m in M)
    final = f"SELECT {b}folds, rows, {weighted}, tp, fp, tn, fn, unmatched, {', '.join(f'{m} AS pooled_{m}' for m in M)} FROM ({_metrics_sql('a', f'{b}folds, rows, {weighted}, tp, fp, tn, fn, unmatched,')})"
    names = tuple(f"{p}_{m}" for p in ("weighted", "weighted_std", "pooled") for m in M)
    return f"{folds}, {agg} " + _rounded_sql(final, names)


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = g.table(spark, d, "events")
    return e.select(F.col("event_type").alias("kind"), (F.col("event_id") % 4000).alias("request"), F.when(F.col("event_id") % 9 == 0, "error").otherwise("ok").alias("status"), F.col("value").alias("seconds"), F.when(F.col("event_id") % 5 != 0, F.get_json_object("props", "$.k").cast("long")).alias("tokens"), F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") / 100, 4)).alias("cost"), "ts")


ATTEMPTS_SQL = "attempts AS (SELECT event_type AS kind, event_id % 4000 AS request, CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, value AS seconds, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS tokens, CASE WHEN event_id % 5 <> 0 THEN round(value / 100, 4) END AS cost, ts FROM events)"


def set_metric(spark: SparkSession, d: str) -> DataFrame:
    v = g.verdicts(spark, d).filter("node LIKE 'supplier/%' OR node LIKE 'customer/%'")
    gold = g.table(spark, d, "customer").filter("c_acctbal > 2000").select(g.node("customer", "c_custkey").alias("node"))
    out = g.table(spark, d, "customer").filter("c_custkey % 10 = 0").select(g.node("customer", "c_custkey").alias("node"))
    return rounded(metrics.set_metrics(v.filter("classification = 'INCLUDE'"), gold, v.filter("classification = 'EXCLUDE'"), out))


def population(spark: SparkSession, d: str) -> DataFrame:
    pop = g.table(spark, d, "customer").select(g.node("customer", "c_custkey").alias("node"), (F.col("c_acctbal") > 2000).cast("int").alias("target"))
    return rounded(metrics.population_metrics(pop, g.verdicts(spark, d).filter("classification = 'INCLUDE'")).drop("rows", "unmatched"))


def compared(spark: SparkSession, d: str) -> DataFrame:
    a = g.judged(spark, d)
    b = a.withColumn("prediction", (F.col("score") > 0.4).cast("int"))
    return metrics.error_profile(a, b, "property")


def nested_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = attempts(spark, d).select("ts", F.col("tokens").alias("tokens_in"), F.floor(F.col("tokens") / 3).alias("tokens_cached"), F.lit(7).alias("tokens_out"))
    out = metrics.token_cost(rows, {"in": 1.0, "cached": 0.1, "out": 4.0}, {"in": 2.0, "cached": 0.2, "out": 8.0})
    return out.groupBy(metrics.peak(F.col("ts")).alias("peak")).agg(F.count("cost").alias("n"), F.round(F.sum("cost"), 9).alias("cost"))


def universe(spark: SparkSession, d: str) -> DataFrame:
    gold = g.table(spark, d, "customer").filter("c_acctbal > 2000").select(g.node("customer", "c_custkey").alias("node"))
    seen = g.verdicts(spark, d).filter("node LIKE 'supplier/%' OR (node LIKE 'customer/%' AND node NOT LIKE '%1')")
    held = g.table(spark, d, "customer").filter("c_custkey % 10 = 0").select(g.node("customer", "c_custkey").alias("node"))
    rows = relational.universe_errors(relational.pooled_universe(gold, [seen], held), gold, seen.select("node", (F.col("classification") == "INCLUDE").alias("included")))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


UNIVERSE_SQL = f"""WITH {g.VERDICTS_SQL}, gold AS (SELECT 'customer/' || c_custkey AS node FROM customer WHERE c_acctbal > 2000),
seen AS (SELECT * FROM verdicts WHERE node LIKE 'supplier/%' OR (node LIKE 'customer/%' AND node NOT LIKE '%1')),
u AS (SELECT node FROM (SELECT node FROM gold UNION SELECT node FROM seen) WHERE node NOT IN (SELECT 'customer/' || c_custkey FROM customer WHERE c_custkey % 10 = 0))
SELECT CASE WHEN gold.node IS NOT NULL AND keep THEN 'tp' WHEN gold.node IS NULL AND keep THEN 'fp' WHEN gold.node IS NOT NULL AND keep IS NULL THEN 'fn_unreached' WHEN gold.node IS NOT NULL THEN 'fn_explicit' ELSE 'tn' END AS bucket, count(*) AS n
FROM u LEFT JOIN gold USING (node) LEFT JOIN seen USING (node) GROUP BY 1"""

_SWEEP = f"""WITH {J}, t AS (SELECT unnest(generate_series(0, 100)) / 100.0::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (target = 1 AND score >= threshold) AS tp, count(*) FILTER (target = 0 AND score >= threshold) AS fp,
  count(*) FILTER (target = 1 AND score < threshold) AS fn, count(*) FILTER (target = 0 AND score < threshold) AS tn FROM t, judged GROUP BY threshold), """


def sweep(spark: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_sweep(g.judged(spark, d).select("target", "score"))


def gold_and_answers(spark: SparkSession, d: str) -> DataFrame:
    gold = g.judged(spark, d).select("row_id", "seed", F.col("property").alias("node"), "target")
    answers = g.judged(spark, d).filter("score > 0.5").select("seed", F.col("property").alias("node")).distinct().withColumn("decision", F.lit(1))
    return relational.with_classifier(gold, answers).select("row_id", "prediction", "reached", "decision_source")


def probe(spark: SparkSession, d: str) -> DataFrame:
    rows = g.table(spark, d, "nation").select(F.col("n_name").alias("label"), (1.0 + F.col("n_nationkey") % 3).alias("weight"), (F.col("n_nationkey") % 10 == 0).alias("critical"), F.lit("EXCLUDE").alias("expected"), F.when(F.col("n_nationkey") % 6 == 5, "INCLUDE").otherwise("EXCLUDE").alias("got"))
    return rounded(metrics.gateway_probe(rows, 5))


def levels(spark: SparkSession, d: str) -> DataFrame:
    f1 = metrics.confusion(g.judged(spark, d), ["fold"]).select("fold", "f1")
    return rounded(metrics.level_deltas(f1, "fold"))


def macro(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.confusion(g.judged(spark, d), ["property", "fold"])
    return rounded(metrics.macro_means(rows, [], ["property"], "fold"))


def seen_share(spark: SparkSession, d: str) -> DataFrame:
    rows = g.judged(spark, d)
    return metrics.seen_percent(rows.select("fold", F.col("seed").alias("node")), rows.filter("row_id % 3 = 0").select("fold", F.col("seed").alias("node")))


def _spending(spark: SparkSession, tables: dict, settings: dict) -> DataFrame:
    """Orders and their total by customer."""
    rows = spark.read.parquet(f"{settings['sf_dir']}/orders.parquet")
    return rows.groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


def _by_nation(spark: SparkSession, tables: dict, settings: dict) -> DataFrame:
    """Customers, orders and the customers above a limit by nation."""
    of = spark.read.parquet(f"{settings['sf_dir']}/customer.parquet").select(F.col("c_custkey").alias("customer"), "c_nationkey")
    rows = tables["spending"].join(of, "customer").groupBy("c_nationkey")
    return rows.agg(F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"), F.count_if(F.col("total") > settings["limit"]).alias("above"))


def staged(spark: SparkSession, d: str) -> DataFrame:
    """Two stages kept by fingerprints, the second for two limits, gathered; run twice, where the second run makes nothing anew."""
    store = stages.StageStore(spark, f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}")
    first = stages.Stage("spending", _spending, (), (f"{d}/orders.parquet",), {"sf_dir": d}, stages.unique("customer"))
    parts = stages.grid("nations", _by_nation, {"limit": [1000000, 2000000]}, ("spending",), {"sf_dir": d}, stages.not_empty)
    plan = [first, *parts, stages.gathered("all", parts)]
    store.run(plan)
    limit = F.get_json_object("configuration", "$.limit").cast("long").alias("limit")
    return store.run(plan)["all"].select("c_nationkey", limit, "customers", "orders", "above")


STAGED_SQL = """WITH s AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY o_custkey)
SELECT c_nationkey, l::BIGINT AS "limit", count(*) AS customers, sum(n)::BIGINT AS orders, count(*) FILTER (total > l) AS above FROM s JOIN customer ON c_custkey = o_custkey, (VALUES (1000000), (2000000)) t(l) GROUP BY c_nationkey, l"""

def dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as attempts of a run, until one fails, half a unit is spent or three days are over."""
    log = g.table(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 97 == 0, "error").otherwise("ok").alias("status"), F.round(F.col("value") / 100, 4).alias("cost"))
    found = log_folds.guard(log, 0.5, 259200.0)
    return found.select("run", F.date_format("stopped_at", "yyyy-MM-dd HH:mm:ss").alias("stopped_at"), "reason", F.round("spent", 4).alias("spent"), "attempts")


DISPATCH_SQL = """WITH l AS (SELECT user_id::VARCHAR AS run, event_id AS id, ts, event_id % 97 = 0 AS bad, round(value / 100, 4) AS cost FROM events),
w AS (SELECT *, coalesce(sum(cost) OVER e, 0) AS spent, coalesce(max(bad::INT) OVER e, 0) AS failed, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY run) AS elapsed FROM l WINDOW e AS (PARTITION BY run ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN failed = 1 THEN 'error' WHEN spent >= 0.5 THEN 'spend' WHEN elapsed >= 259200.0 THEN 'time' END AS reason FROM w)
SELECT run, strftime(arg_min(ts, (ts, id)) FILTER (reason IS NOT NULL), '%Y-%m-%d %H:%M:%S') AS stopped_at, arg_min(reason, (ts, id)) FILTER (reason IS NOT NULL) AS reason, round(coalesce(sum(cost) FILTER (reason IS NULL), 0), 4) AS spent, count(*) FILTER (reason IS NULL) AS attempts FROM r GROUP BY run"""

QUERIES: dict = {
    "dispatch_guard": (dispatch, DISPATCH_SQL),
    "staged_summary": (staged, STAGED_SQL),
    "confusion_metrics": (lambda s, d: rounded(metrics.confusion(g.judged(s, d))), f"WITH {J}, c AS (SELECT count(*) AS rows, {_COUNTS} FROM judged) " + _rounded_sql(_metrics_sql("c", "rows, tp, fp, tn, fn, unmatched,"), M)),
    "fold_weighted_metrics": (lambda s, d: rounded(metrics.fold_weighted(g.judged(s, d))), f"WITH {J}, " + _fold_sql("")),
    "configuration_metrics": (lambda s, d: rounded(metrics.fold_weighted(g.judged(s, d), ["property"])), f"WITH {J}, " + _fold_sql("property")),
    "seen_unseen_metrics": (lambda s, d: rounded(metrics.seen_views(g.judged(s, d))), f"WITH {J}, views AS (SELECT *, 'all' AS view FROM judged UNION ALL SELECT *, CASE WHEN seen THEN 'seen' ELSE 'unseen' END FROM judged), " + _fold_sql("view", "views")),
    "set_metrics": (set_metric, f"""WITH {g.VERDICTS_SQL}, v AS (SELECT * FROM verdicts WHERE node LIKE 'supplier/%' OR node LIKE 'customer/%'), gold AS (SELECT 'customer/' || c_custkey AS node FROM customer WHERE c_acctbal > 2000),
u AS (SELECT v.node, keep, gold.node IS NOT NULL AS good FROM v LEFT JOIN gold USING (node) WHERE v.node NOT IN (SELECT 'customer/' || c_custkey FROM customer WHERE c_custkey % 10 = 0)),
c AS (SELECT count(*) FILTER (keep AND good) AS tp, count(*) FILTER (keep AND NOT good) AS fp, count(*) FILTER (NOT keep AND NOT good) AS tn, count(*) FILTER (NOT keep AND good) AS fn FROM u) """ + _rounded_sql(_metrics_sql("c", "tp, fp, tn, fn,"), M)),
    "population_metrics": (population, """WITH u AS (SELECT c_acctbal > 2000 AS good, c_acctbal > 3000 AS keep FROM customer), c AS (SELECT count(*) FILTER (keep AND good) AS tp, count(*) FILTER (keep AND NOT good) AS fp, count(*) FILTER (NOT keep AND NOT good) AS tn, count(*) FILTER (NOT keep AND good) AS fn FROM u) """ + _rounded_sql(_metrics_sql("c", "tp, fp, tn, fn,"), M)),
    "probability_scores": (lambda s, d: rounded(metrics.probability_scores(g.judged(s, d), ["property"])), f"WITH {J} SELECT property, count(*) AS rows, round(avg((score - target) ** 2), 6) AS brier, round(avg(-(target * ln(greatest(score, 1e-15)) + (1 - target) * ln(greatest(1 - score, 1e-15)))), 6) AS log_loss FROM judged GROUP BY property"),
    "usage_summary": (lambda s, d: rounded(metrics.usage(attempts(s, d), ["kind"])), f"WITH {ATTEMPTS_SQL} SELECT kind, count(*) AS attempts, count(DISTINCT request) AS requests, count(*) - count(DISTINCT request) AS retries, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (status <> 'ok') AS failed, count(tokens) AS with_usage, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost, round(median(seconds), 6) AS median_seconds, round(quantile_disc(seconds, 0.95), 6) AS p95_seconds, round(max(seconds), 6) AS max_seconds FROM attempts GROUP BY kind"),
    "token_costs": (nested_costs, f"""WITH {ATTEMPTS_SQL}, p AS (SELECT (isodow(ts) < 6 AND ((hour(ts) >= 1 AND hour(ts) < 4) OR (hour(ts) >= 6 AND hour(ts) < 10))) AS peak, tokens AS i, floor(tokens / 3.0) AS c FROM attempts)
SELECT peak, count(i) AS n, round(sum((CASE WHEN peak THEN 2.0 ELSE 1.0 END) * ((i - c) * 1.0 + c * 0.1 + 7 * 4.0) / 1e6), 9) AS cost FROM p GROUP BY peak"""),
    "macro_means": (macro, f"WITH {J}, f AS (SELECT property, fold, {_COUNTS} FROM judged GROUP BY property, fold), m AS ({_metrics_sql('f', 'property, fold,')}) SELECT property, count(*) AS runs, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_sd' for m in M)} FROM m GROUP BY property"),
    "error_profile": (compared, f"WITH {J}, x AS (SELECT property, target, prediction AS l, CAST(score > 0.4 AS INT) AS r FROM judged), a AS (SELECT property, count(*) AS rows, count(*) FILTER (target = 1) AS gold_keep, count(*) FILTER (target = 0) AS gold_prune, count(*) FILTER (target = 0 AND l = 1) AS left_fp, count(*) FILTER (target = 1 AND l = 0) AS left_fn, count(*) FILTER (target = 0 AND r = 1) AS right_fp, count(*) FILTER (target = 1 AND r = 0) AS right_fn, count(*) FILTER (l IS DISTINCT FROM r) AS disagreements FROM x GROUP BY property) SELECT *, left_fp + left_fn + right_fp + right_fn AS errors FROM a"),
    "prediction_overlap": (lambda s, d: metrics.overlap(g.judged(s, d).filter("row_id % 3 <> 0"), g.judged(s, d).filter("row_id % 4 <> 0")), f"WITH {J} SELECT count(*) FILTER (row_id % 3 <> 0 AND row_id % 4 <> 0) AS both, count(*) FILTER (row_id % 3 <> 0 AND row_id % 4 = 0) AS left_only, count(*) FILTER (row_id % 3 = 0 AND row_id % 4 <> 0) AS right_only FROM judged"),
    "gateway_probe": (probe, "WITH x AS (SELECT 1.0 + n_nationkey % 3 AS w, n_nationkey % 10 = 0 AS crit, n_nationkey % 6 = 5 AS bad FROM nation) SELECT count(*) AS probes, count(*) FILTER (bad) AS errors, round(avg(CASE WHEN bad THEN 0.0 ELSE 1.0 END), 6) AS exclusion_rate, round(sum(CASE WHEN bad THEN 0.0 ELSE w END)::DOUBLE / sum(w)::DOUBLE, 6) AS weighted_accuracy, count(*) FILTER (bad AND crit) AS critical_failures, count(*) FILTER (bad) <= 5 AND count(*) FILTER (bad AND crit) = 0 AS passed FROM x"),
    "level_deltas": (levels, f"WITH {J}, f AS (SELECT fold, {_COUNTS} FROM judged GROUP BY fold), m AS ({_metrics_sql('f', 'fold,')}) SELECT fold, round(f1, 6) AS f1, round(f1 - lag(f1) OVER (ORDER BY fold), 6) AS f1_delta FROM m"),
    "seen_percent": (seen_share, f"WITH {J}, r AS (SELECT DISTINCT fold, seed FROM judged), t AS (SELECT DISTINCT fold, seed, 1 AS x FROM judged WHERE row_id % 3 = 0) SELECT fold, count(x) AS seen, count(*) - count(x) AS unseen, count(*) AS total, round(100.0 * count(x)::DOUBLE / count(*), 4) AS seen_percent FROM r LEFT JOIN t USING (fold, seed) GROUP BY fold"),
    "threshold_sweep": (lambda s, d: rounded(sweep(s, d)), _SWEEP + "m AS (" + _metrics_sql("c", "threshold, tp, fp, tn, fn,") + ") SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM m"),
    "best_threshold": (lambda s, d: rounded(metrics.best_threshold(sweep(s, d))), _SWEEP + "m AS (" + _metrics_sql("c", "threshold,") + ") SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM m ORDER BY m.f1 DESC, m.threshold LIMIT 1"),
    "best_balanced_threshold": (lambda s, d: rounded(metrics.best_balanced_threshold(sweep(s, d))), _SWEEP + "m AS (" + _metrics_sql("c", "threshold,") + ") SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m ORDER BY m.f1 DESC, m.precision DESC, m.recall DESC, abs(m.threshold - 0.5), m.threshold LIMIT 1"),
    "pooled_universe": (universe, UNIVERSE_SQL),
    "classifier_join": (gold_and_answers, f"WITH {J}, a AS (SELECT DISTINCT seed, property FROM judged WHERE score > 0.5) SELECT row_id, CAST(a.seed IS NOT NULL AS INT) AS prediction, a.seed IS NOT NULL AS reached, CASE WHEN a.seed IS NOT NULL THEN 'classifier' ELSE 'bfs_auto_prune' END AS decision_source FROM judged j LEFT JOIN a USING (seed, property)"),
}
