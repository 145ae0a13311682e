"""Joins between decisions, predictions and traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_rows(rows: DataFrame, keys: list[str], order: str = "row_index") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def last_rows(rows: DataFrame, keys: list[str], order: str = "row_index") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def pick_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(asked, row_id, problem) for ids asked for: by row_id, else by a legacy id that is unique."""
    legacy = rows.groupBy("legacy_row_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("by_legacy")).withColumnRenamed("legacy_row_id", "asked")
    got = wanted.select(F.col("row_id").alias("asked")).join(rows.select(F.col("row_id").alias("asked"), F.col("row_id").alias("by_id")).distinct(), "asked", "left").join(legacy, "asked", "left")
    row = F.coalesce("by_id", F.when(F.col("n") == 1, F.col("by_legacy")))
    return got.select("asked", row.alias("row_id"), F.when(row.isNull(), F.when(F.col("n") > 1, "ambiguous").otherwise("missing")).alias("problem"))


def in_order_of(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample's rows (row_id, ord) in the sample's order."""
    return rows.join(sample.select("row_id", "ord"), "row_id").orderBy("ord")


def misaligned(rows: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """(row_id, problem): rows missing on either side, and rows whose columns differ. Aligned sets give none."""
    a = rows.select("row_id", F.struct(*columns).alias("a"))
    b = reference.select("row_id", F.struct(*columns).alias("b"))
    joined = a.join(b, "row_id", "full_outer")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unknown").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return joined.select("row_id", problem.alias("problem")).filter("problem IS NOT NULL")


def with_classifier(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """Gold rows without self rows, left joined to answers (seed, node, decision): unreached rows are predicted 0."""
    joined = gold.filter("seed <> node").join(answers.select("seed", "node", "decision"), ["seed", "node"], "left")
    reached = F.col("decision").isNotNull()
    return joined.withColumn("prediction", F.coalesce("decision", F.lit(0))).withColumn("reached", reached).withColumn("decision_source", F.when(reached, "classifier").otherwise("bfs_auto_prune")).drop("decision")


def ordered_distances(train: DataFrame, distances: DataFrame) -> DataFrame:
    """(query, row_id, distance, n): a query's training rows by distance; rows without one drop out."""
    rows = distances.join(train.select(F.col("node").alias("other"), "row_id"), "other")
    return rows.select("query", "row_id", "distance", F.row_number().over(Window.partitionBy("query").orderBy("distance", "row_id")).cast("long").alias("n"))


def pooled_universe(gold: DataFrame, visited: list[DataFrame], held_out: DataFrame) -> DataFrame:
    """(node): gold and all that any method visited, without what is held out."""
    out = gold.select("node")
    for v in visited:
        out = out.unionByName(v.select("node"))
    return out.distinct().join(held_out.select("node"), "node", "left_anti")


def universe_errors(universe: DataFrame, gold: DataFrame, decided: DataFrame) -> DataFrame:
    """(node, bucket): tp, tn, fp, fn_explicit or fn_unreached of each node; ``decided`` has (node, included)."""
    rows = universe.join(gold.select("node", F.lit(True).alias("g")).distinct(), "node", "left").join(decided.select("node", "included"), "node", "left")
    g, i = F.coalesce("g", F.lit(False)), F.coalesce("included", F.lit(False))
    return rows.select("node", F.when(g & i, "tp").when(~g & i, "fp").when(g & F.col("included").isNull(), "fn_unreached").when(g, "fn_explicit").otherwise("tn").alias("bucket"))


def absent(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(row_id, present): whether both a row's seed and node are among the known nodes."""
    own = known.select("node").distinct()
    a = own.select(F.col("node").alias("seed"), F.lit(True).alias("a"))
    b = own.withColumn("b", F.lit(True))
    return rows.select("row_id", "seed", "node").join(a, "seed", "left").join(b, "node", "left").select("row_id", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("present"))


def strictly_nested(packs: DataFrame) -> DataFrame:
    """(size, next_size, missing): items (size, item) of each pack that the next larger lacks; a chain has none."""
    sizes = packs.select("size").distinct().withColumn("next_size", F.lead("size").over(Window.orderBy("size"))).filter("next_size IS NOT NULL")
    bigger = packs.select(F.col("size").alias("next_size"), F.col("item").alias("have"))
    rows = packs.join(F.broadcast(sizes), "size").join(bigger.withColumnRenamed("have", "item").withColumn("in", F.lit(1)), ["next_size", "item"], "left")
    return rows.groupBy("size", "next_size").agg(F.count_if(F.col("in").isNull()).alias("missing"))


def filter_rows(rows: DataFrame, seed_label: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows without excluded ids, of one seed label if given (case aside)."""
    if exclude is not None:
        rows = rows.join(exclude.select("row_id").distinct(), "row_id", "left_anti")
    return rows if seed_label is None else rows.filter(F.lower("seed_label") == seed_label.lower())


def rows_in_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose (seed, node) is among the pairs; a blank seed is taken from the legacy id, before its bar."""
    seed = F.coalesce(F.nullif(F.col("seed"), F.lit("")), F.split_part("legacy_row_id", F.lit("|"), F.lit(1)))
    return rows.withColumn("seed", seed).join(pairs.select("seed", "node").distinct(), ["seed", "node"], "left_semi")


def by_availability(rows: DataFrame, available: DataFrame) -> DataFrame:
    """``rows`` with ``kept``: whether both ends have a vector."""
    marked = absent(rows, available)
    return rows.join(marked.select("row_id", F.col("present").alias("kept")), "row_id")


def with_path_labels(rows: DataFrame) -> DataFrame:
    """Blank labels filled from the path text's first and last names."""
    first, last = F.trim(F.substring_index("path", "-->", 1)), F.trim(F.substring_index("path", "-->", -1))
    return rows.withColumn("seed_label", F.coalesce(F.nullif("seed_label", F.lit("")), first)).withColumn("label", F.coalesce(F.nullif("label", F.lit("")), last))


def best_configurations(scores: DataFrame, by: list[str]) -> DataFrame:
    """The configuration of each group with the best f1, precision, recall and then the fewest parameters."""
    key = F.struct("f1", "precision", "recall", (-F.col("parameters")).alias("small"))
    return scores.groupBy(*by).agg(F.max_by(F.struct("configuration", "f1"), key).alias("x")).select(*by, "x.*")


def identity_errors(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column) of fields that differ between two tables' rows of one key, nulls equal to nulls."""
    a = left.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = right.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    differ = F.filter(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return a.join(b, key).select(key, F.explode(differ).alias("column"))
