"""Confusion counts, fold-weighted metrics and the other summaries of an evaluation, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixpoint import ordinals, settle

METRICS = ("precision", "recall", "f1", "accuracy")


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, by: list[str] | None = None, all_rows: bool = False) -> DataFrame:
    """tp, fp, tn, fn, unmatched and the four metrics of rows (target, prediction), by groups if given.

    Rows without a prediction are only counted as unmatched; ``all_rows`` puts them into accuracy's denominator.
    """
    y, p = F.col("target"), F.col("prediction")
    counts = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if(p.isNull()).alias("unmatched"))
    return with_metrics(counts, F.col("rows") if all_rows else None)


def with_metrics(counts: DataFrame, denominator: Column | None = None) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).withColumn("accuracy", ratio(tp + tn, denominator if denominator is not None else tp + fp + tn + fn))


def fold_weighted(rows: DataFrame, by: list[str] | None = None, folds: int | None = None) -> DataFrame:
    """Per group: weighted_<metric> (by rows of a fold) and weighted_std_<metric> (population), pooled metrics, folds, rows.

    With ``folds``, groups that lack one have null weighted metrics.
    """
    by = by or []
    per_fold = confusion(rows, [*by, "fold"])
    n, total = F.col("rows"), F.sum("rows")
    means = [(F.sum(n * F.col(m)) / total).alias(f"weighted_{m}") for m in METRICS]
    spread = [F.sqrt(F.greatest(F.lit(0.0), F.sum(n * F.col(m) * F.col(m)) / total - F.pow(F.sum(n * F.col(m)) / total, 2))).alias(f"weighted_std_{m}") for m in METRICS]
    pooled = [F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "unmatched")]
    out = with_metrics(per_fold.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), total.alias("rows"), *means, *spread, *pooled))
    for m in METRICS:
        out = out.withColumnRenamed(m, f"pooled_{m}")
    if folds is not None:
        for m in METRICS:
            for c in (f"weighted_{m}", f"weighted_std_{m}"):
                out = out.withColumn(c, F.when(F.col("folds") == folds, F.col(c)))
    return out


def seen_views(rows: DataFrame) -> DataFrame:
    """Fold-weighted metrics of all, seen and unseen rows (boolean column ``seen``) in one pass over the counts."""
    views = rows.withColumn("view", F.explode(F.array(F.lit("all"), F.when(F.col("seen"), "seen").otherwise("unseen"))))
    return fold_weighted(views, ["view"])


def set_metrics(included: DataFrame, gold: DataFrame, pruned: DataFrame, held_out: DataFrame | None = None) -> DataFrame:
    """Metrics of id sets (node): pruned without included; true negatives are pruned and not gold; unreached gold is missed."""
    flag = lambda df, name: df.select("node").distinct().withColumn(name, F.lit(1))
    rows = flag(included, "i").join(flag(gold, "g"), "node", "full_outer").join(flag(pruned, "p"), "node", "full_outer")
    if held_out is not None:
        rows = rows.join(held_out.select("node").distinct(), "node", "left_anti")
    i, g, p = (F.coalesce(F.col(c), F.lit(0)) == 1 for c in ("i", "g", "p"))
    return with_metrics(rows.agg(F.count_if(i & g).alias("tp"), F.count_if(i & ~g).alias("fp"), F.count_if(p & ~i & ~g).alias("tn"), F.count_if(~i & g).alias("fn")))


def population_metrics(population: DataFrame, included: DataFrame) -> DataFrame:
    """Metrics over a fixed population (node, target): what isn't included counts as predicted 0, reached or not."""
    rows = population.join(included.select("node").distinct().withColumn("prediction", F.lit(1)), "node", "left").withColumn("prediction", F.coalesce("prediction", F.lit(0)))
    return confusion(rows)


def probability_scores(rows: DataFrame, by: list[str] | None = None, least: float = 1e-15) -> DataFrame:
    """rows, brier and log_loss of (target, score)."""
    y, p = F.col("target").cast("double"), F.col("score").cast("double")
    kept = lambda x: F.least(F.greatest(x, F.lit(least)), F.lit(1.0))
    loss = -(y * F.ln(kept(p)) + (1 - y) * F.ln(kept(1 - p)))
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("log_loss"))


def order_statistics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, p95): exact, of the values that there are; p95 is the nearest rank's.

    All values are numbered once by ranges of (by, value), so a group of any size is spread over tasks, and only the rows at
    the two middle places and at the 95th percentile's are picked.
    """
    known = rows.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(value).alias("_value")).filter("_value IS NOT NULL")
    keys = [f"_{c}" for c in by]
    numbered = settle(ordinals(known, [*keys, "_value"], "_n"))
    groups = numbered.groupBy(*keys).agg(F.min("_n").alias("first"), F.count(F.lit(1)).alias("size"))
    middle = lambda up: F.col("first") + F.floor((F.col("size") - 1 + up) / 2).cast("long")
    late = F.col("first") + F.ceil(F.col("size") * 95 / F.lit(100)).cast("long") - 1
    wanted = groups.select(F.explode(F.array(F.struct(F.lit("a").alias("kind"), middle(0).alias("_n")), F.struct(F.lit("b").alias("kind"), middle(1).alias("_n")), F.struct(F.lit("c").alias("kind"), late.alias("_n")))).alias("x")).select("x.*")
    picked = wanted.join(numbered, "_n")
    only = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("_value")))
    return picked.groupBy(*keys).agg(((only("a") + only("b")) / 2).alias("median"), only("c").alias("p95")).withColumnsRenamed(dict(zip(keys, by, strict=True)))


def usage(attempts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Roll-up of attempts (request, status, seconds, tokens, cost): counts, retries, sums over what is known, latencies.

    The 95th percentile is the nearest rank's; no group's latencies meet in one task.
    """
    by = by or []
    sums = attempts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_distinct("request").alias("requests"),
        (F.count(F.lit(1)) - F.count_distinct("request")).alias("retries"),
        F.count_if(F.col("status") == "ok").alias("succeeded"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        F.count("tokens").alias("with_usage"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.max("seconds").alias("max_seconds"),
    )
    late = order_statistics(attempts, by, "seconds")
    same = F.lit(True)
    for c in by:
        same = same & sums[c].eqNullSafe(late[c])
    joined = sums.join(late, same, "left")
    return joined.select(*[sums[c] for c in sums.columns if c != "max_seconds"], F.col("median").alias("median_seconds"), F.col("p95").alias("p95_seconds"), "max_seconds")


def peak(ts: Column) -> Column:
    """UTC working days from 1 to 4 and from 6 to 10 o'clock."""
    h = F.hour(ts)
    return (F.weekday(ts) < 5) & (((h >= 1) & (h < 4)) | ((h >= 6) & (h < 10)))


def token_cost(rows: DataFrame, rates: dict[str, float], peak_rates: dict[str, float]) -> DataFrame:
    """``rows`` (ts, tokens_in, tokens_cached, tokens_out) with ``cost``; rates are for a million tokens."""
    rate = lambda k: F.when(peak(F.col("ts")), F.lit(peak_rates[k])).otherwise(F.lit(rates[k]))
    total = (F.col("tokens_in") - F.col("tokens_cached")) * rate("in") + F.col("tokens_cached") * rate("cached") + F.col("tokens_out") * rate("out")
    return rows.withColumn("cost", total / 1e6)


def macro_means(rows: DataFrame, inner: list[str], outer: list[str], run: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means over ``inner`` groups within a run, then mean and sample deviation over runs, by ``outer``."""
    per_run = rows.groupBy(*outer, run).agg(*[F.avg(m).alias(m) for m in metrics]) if not inner else rows.groupBy(*outer, run, *inner).agg(*[F.avg(m).alias(m) for m in metrics]).groupBy(*outer, run).agg(*[F.avg(m).alias(m) for m in metrics])
    return per_run.groupBy(*outer).agg(F.count(F.lit(1)).alias("runs"), *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.coalesce(F.nanvl(F.stddev_samp(m), F.lit(0.0)), F.lit(0.0)).alias(f"{m}_sd") for m in metrics])


def error_kind(target: Column, prediction: Column) -> Column:
    return F.when(prediction.isNull(), "unmatched").when((target == 1) & (prediction == 0), "fn").when((target == 0) & (prediction == 1), "fp").otherwise("correct")


def error_profile(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Two prediction sets (row_id, target, prediction, ``by``) by a property: sizes, errors of each side, disagreements."""
    a = left.select("row_id", by, "target", F.col("prediction").alias("l"))
    b = right.select("row_id", F.col("prediction").alias("r"))
    rows = a.join(b, "row_id")
    kind = lambda c, k: F.count_if(error_kind(F.col("target"), F.col(c)) == k)
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("target") == 1).alias("gold_keep"), F.count_if(F.col("target") == 0).alias("gold_prune"), kind("l", "fp").alias("left_fp"), kind("l", "fn").alias("left_fn"), kind("r", "fp").alias("right_fp"), kind("r", "fn").alias("right_fn"), F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("disagreements"))
    return out.withColumn("errors", F.col("left_fp") + F.col("left_fn") + F.col("right_fp") + F.col("right_fn"))


def overlap(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: ids in both, only left, only right."""
    rows = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    return rows.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def gateway_probe(rows: DataFrame, max_errors: int) -> DataFrame:
    """Probe rows (label, weight, critical, expected, got): counts, exclusion rate, weighted accuracy, passed."""
    good = F.col("expected") == F.col("got")
    out = rows.agg(F.count(F.lit(1)).alias("probes"), F.count_if(~good).alias("errors"), F.avg((F.col("got") == "EXCLUDE").cast("double")).alias("exclusion_rate"), ratio(F.sum(F.when(good, F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("weighted_accuracy"), F.count_if(~good & F.col("critical")).alias("critical_failures"))
    return out.withColumn("passed", (F.col("errors") <= max_errors) & (F.col("critical_failures") == 0))


def level_deltas(rows: DataFrame, order: str, metric: str = "f1", by: list[str] | None = None) -> DataFrame:
    """``rows`` with the change of a metric from the level before."""
    return rows.withColumn(f"{metric}_delta", F.col(metric) - F.lag(metric).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)))


def seen_percent(reached: DataFrame, train: DataFrame) -> DataFrame:
    """(fold, seen, unseen, total, seen_percent) of reached nodes (fold, node) by whether a fold's training rows have them."""
    own = train.select("fold", "node", F.lit(1).alias("t")).distinct()
    rows = reached.select("fold", "node").distinct().join(own, ["fold", "node"], "left")
    out = rows.groupBy("fold").agg(F.count("t").alias("seen"), F.count_if(F.col("t").isNull()).alias("unseen"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("seen_percent", F.bround(100 * ratio(F.col("seen"), F.col("total")), 4))


def threshold_sweep(rows: DataFrame, steps: int = 100, by: list[str] | None = None) -> DataFrame:
    """Metrics of (target, score) at thresholds 0, 1/steps, … 1, from one histogram and a running sum.

    Each row falls into the bin of the highest threshold that it passes, so the cost doesn't grow with the thresholds.
    """
    by = by or []
    spark = rows.sparkSession
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    bins = rows.withColumn("bin", F.size(F.filter(grid, lambda t: F.col("score") >= t)) - 1).groupBy(*by, "bin").agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg"))
    groups = bins.select(*by).distinct() if by else spark.range(1).select()
    every = groups.join(F.broadcast(spark.range(-1, steps + 1).select(F.col("id").cast("int").alias("bin"))), how="cross")  # bounded by the grid
    full = every.join(bins, [*by, "bin"], "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*(by or [F.lit(0)]))
    counts = full.withColumn("tp", F.sum("pos").over(above)).withColumn("fp", F.sum("neg").over(above)).withColumn("fn", F.sum("pos").over(total) - F.col("tp")).withColumn("tn", F.sum("neg").over(total) - F.col("fp")).filter("bin >= 0")
    return with_metrics(counts.select(*by, (F.col("bin") / steps).alias("threshold"), "tp", "fp", "tn", "fn"))


def best_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold of the highest F1; of several the lowest."""
    return sweep.groupBy(*(by or [])).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", (-F.col("threshold")).alias("t"))).alias("x")).select(*(by or []), "x.threshold", "x.f1")


def best_balanced_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By F1, precision, recall, nearness to one half, then the lowest."""
    key = F.struct("f1", "precision", "recall", (-F.abs(F.col("threshold") - 0.5)).alias("near"), (-F.col("threshold")).alias("low"))
    return sweep.groupBy(*(by or [])).agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), key).alias("x")).select(*(by or []), "x.*")


def percentages(rows: DataFrame, columns: tuple[str, ...] = METRICS, digits: int = 4) -> DataFrame:
    """``rows`` with the columns as percentages, half to even."""
    return rows.select(*[F.bround(100 * F.col(c), digits).alias(c) if c in columns else F.col(c) for c in rows.columns])


def mean_and_deviation(mean: Column, deviation: Column) -> Column:
    """Two shares as text, in per cent with two digits."""
    return F.concat(F.format_string("%.2f", 100 * mean), F.lit(" \u00b1 "), F.format_string("%.2f", 100 * deviation))


def metric_views(results: DataFrame, requested: str = "bfs_gated", scope: str = "runtime") -> DataFrame:
    """(id, view, metrics) of result documents (id, value): the metric rows of the view asked for, as JSON text.

    Documents are of several makes: batch results keep metrics by evaluation mode, others rows by view, and some
    aggregations over folds; ``scope`` is the name that rows of a limited scope go by. Asking for what a document lacks is
    an error, but for gated views, which may be none.
    """
    at = lambda path: F.get_json_object("value", path)
    limited = F.coalesce(at(f"$.metric_aggregations.{scope}_rows"), at(f"$.metric_aggregations.bfs_gated_{scope}_rows"))
    inside = lambda c, name: F.get_json_object(c, f"$.{name}")
    view = lambda name, c: F.struct((name if isinstance(name, Column) else F.lit(name)).alias("view"), c.alias("metrics"))
    traversed = F.coalesce(at("$.evaluation_mode") == "bfs", F.lit(False))
    needs = lambda ok, what: F.when(ok, True).otherwise(F.raise_error(F.lit(what)).cast("boolean"))
    weighted, pooled = f"{scope}_weighted_fold", f"{scope}_pooled"
    if requested in (weighted, pooled, "both_aggregations"):
        wanted = [weighted, pooled] if requested.startswith("both") else [requested]
        ok = limited.isNotNull() & (inside(limited, "weighted_fold").isNotNull() if weighted in wanted else F.lit(True))
        views, check = F.array(*[view(w, inside(limited, "weighted_fold" if w == weighted else "pooled")) for w in wanted]), needs(ok, "no aggregation over folds")
    elif requested in ("bfs_gated", "both_bfs_gated"):
        batch = F.array(view("full_dataset_bfs_gated", at("$.metrics.bfs_gated")), view(f"{scope}_bfs_gated", at(f"$.metrics.bfs_gated_{scope}_rows")))
        single = F.array(view("all_evaluated_rows_bfs_gated", at("$.metric_views.all_evaluated_rows")), view(f"{scope}_bfs_gated", at(f"$.metric_views.{scope}_rows")))
        views, check = F.when(at("$.metrics.bfs_gated").isNotNull(), batch).when(traversed, single), F.lit(True)
    elif requested == "metrics":
        views, check = F.array(view("metrics", at("$.metrics"))), needs(at("$.metrics.precision").isNotNull(), "no direct metric row")
    else:
        own, other = at(f"$.metrics.{requested}"), at(f"$.metric_views.{requested}")
        name = F.when(own.isNull() & traversed, requested + "_bfs_gated").otherwise(requested)
        views, check = F.array(view(name, F.coalesce(own, other))), needs(F.coalesce(own, other).isNotNull(), f"no metric view {requested}")
    return results.filter(check).select("id", F.explode(views).alias("x")).select("id", "x.view", "x.metrics").filter("metrics IS NOT NULL")
