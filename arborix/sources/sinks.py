"""Artifacts of an extraction."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions.text import casefold, turtle_escape
from arborix.operators.fixpoint import settle
from arborix.operators.graph import traversal_subgraph
from arborix.operators.traverse import with_paths


def turtle_lines(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, value): edge lines, label lines, and as comments the nodes that have no label, of a subgraph in Turtle."""
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    lines = edges.select(F.lit(0).alias("part"), F.concat(iri("src"), F.lit(" "), iri("pred"), F.lit(" "), iri("dst"), F.lit(" .")).alias("value"))
    named = labels.select(F.lit(1).alias("part"), F.concat(iri("node"), F.lit(' <http://www.w3.org/2000/01/rdf-schema#label> "'), turtle_escape(F.col("label")), F.lit('"@en .')).alias("value"))
    known = labels.select("node").distinct()
    bare = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(known, "node", "left_anti")
    notes = bare.select(F.lit(3).alias("part"), F.concat(F.lit("#   "), iri("node")).alias("value"))
    head = bare.limit(1).select(F.lit(2).alias("part"), F.lit("# Nodes without a label:").alias("value"))
    return lines.unionByName(named).unionByName(head).unionByName(notes).distinct()


def write_turtle(edges: DataFrame, labels: DataFrame, path: str, overwrite: bool = False) -> None:
    turtle_lines(edges, labels).orderBy("part", "value").select("value").write.mode("overwrite" if overwrite else "errorifexists").text(path)


#: Columns of result files, in order.
DECISION_COLUMNS = ("node", "label", "classification", "confidence", "seed", "seed_label", "depth", "path", "warning")
RESULT_COLUMNS = ("row_id", "legacy_row_id", "seed_qid", "seed_label", "qid", "label", "target", "prediction", "classification", "confidence", "depth", "reaching_property", "reaching_property_label")
SCORED_COLUMNS = ("row_id", "legacy_row_id", "seed_qid", "seed_label", "qid", "label", "target", "prediction", "classification", "confidence", "raw_prediction", "raw_classification", "raw_confidence", "csv_depth", "bfs_depth", "parent_qid", "parent_label", "reaching_property", "reaching_property_label", "path")
ROW_COLUMNS = ("row_id", "legacy_row_id", "seed_qid", "seed_label", "qid", "label", "target", "csv_depth", "bfs_depth", "parent_qid", "parent_label", "reaching_property", "reaching_property_label", "path")
CONCEPT_COLUMNS = ("prefLabel", "altLabels", "displayName", "uri", "confidence", "in_hierarchy_gold", "relations", "classification")


def fixed_columns(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with just these columns in this order; those that they lack are empty."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns])


def write_rows(rows: DataFrame, columns: tuple[str, ...], path: str, order: list | None = None, overwrite: bool = False) -> None:
    """A CSV table of fixed columns."""
    (rows.orderBy(*order) if order else rows).transform(fixed_columns, columns).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def decision_rows(visited: DataFrame, labels: DataFrame) -> DataFrame:
    """DECISION_COLUMNS of a traversal's result: labels of nodes and seeds (their own names without one), and the path in words."""
    by = lambda c, name: labels.select(F.col("node").alias(c), F.col("label").alias(name))
    if "path" not in visited.columns and "parent" in visited.columns:
        visited = with_paths(settle(visited), labels)
    named = visited.drop("label").join(by("node", "label"), "node", "left").join(by("seed", "seed_label"), "seed", "left")
    text = F.col("path") if "path" in visited.columns else F.lit("")
    rows = named.select("node", F.coalesce("label", "node").alias("label"), "classification", "confidence", "seed", F.coalesce("seed_label", "seed").alias("seed_label"), "depth", text.alias("path"), *(["warning"] if "warning" in visited.columns else []))
    return fixed_columns(rows, DECISION_COLUMNS)


def write_extraction(visited: DataFrame, labels: DataFrame, folder: str, overwrite: bool = False, edges: DataFrame | None = None, prompt: str | None = None, run: dict | None = None) -> None:
    """decisions, visited (the same rows), included and excluded tables as CSV, in the order of depth, label and IRI.

    With ``edges``, ``prompt`` and ``run`` (settings of the run) also the retained subgraph, the prompt and a manifest.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    spark, rows = visited.sparkSession, settle(decision_rows(visited, labels))
    kept = F.col("classification").isin("INCLUDE", "SEED")
    for name, part in (("decisions", rows), ("visited", rows), ("included", rows.filter(kept)), ("excluded", rows.filter(~kept))):
        part.orderBy("depth", casefold(F.col("label")), "node").write.mode(mode).option("header", True).csv(f"{folder}/{name}")
    if edges is not None:
        retained = settle(traversal_subgraph(visited, edges))
        write_turtle(retained, labels.join(rows.filter(kept).select("node"), "node", "left_semi"), f"{folder}/subgraph", overwrite)
    if prompt is not None:
        one_file(spark, prompt.rstrip(), f"{folder}/prompt", mode)
    if run is not None:
        counts = rows.agg(F.count(F.lit(1)).alias("visited_count"), F.count_if(kept).alias("included_count"), F.count_if(~kept).alias("excluded_count"), F.max("depth").alias("deepest_level")).first().asDict()
        levels = [r.asDict() for r in rows.filter("depth > 0").groupBy("depth").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(kept).alias("included")).orderBy("depth").collect()]  # one row a level
        counts["retained_traversal_edge_count"] = retained.count() if edges is not None else None
        digest = {"system_prompt_sha256": hashlib.sha256(prompt.encode()).hexdigest()} if prompt is not None else {}
        one_file(spark, json.dumps({**run, "mode": "extraction", **digest, **counts, "iterations": levels}, indent=2, ensure_ascii=False, sort_keys=True), f"{folder}/manifest", mode)


def one_file(spark: SparkSession, text: str, path: str, mode: str = "errorifexists") -> None:
    """A small text as a file of its own."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def concept_rows(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """CONCEPT_COLUMNS of rows with arrays altLabels and relations (uri, ...), and whether each is gold (node)."""
    marked = rows.join(gold.select(F.col("node").alias("uri"), F.lit(True).alias("g")).distinct(), "uri", "left")
    flat = marked.withColumns({"altLabels": F.array_join("altLabels", "; "), "relations": F.array_join("relations", "; "), "in_hierarchy_gold": F.when(F.col("g"), "True").otherwise("False")})
    return fixed_columns(flat.drop("g"), CONCEPT_COLUMNS)


def write_concepts(rows: DataFrame, gold: DataFrame, folder: str, prefix: str, metrics: dict, overwrite: bool = False) -> None:
    """INCLUDED, PRUNED and VISITED tables and METRICS as one JSON document, under a common prefix."""
    mode, own = "overwrite" if overwrite else "errorifexists", settle(concept_rows(rows, gold))
    for name, part in (("INCLUDED", own.filter("classification = 'INCLUDE'")), ("PRUNED", own.filter("classification = 'EXCLUDE'")), ("VISITED", own)):
        part.orderBy("uri").write.mode(mode).option("header", True).csv(f"{folder}/{prefix}_{name}")
    one_file(rows.sparkSession, json.dumps(metrics, indent=2, sort_keys=True), f"{folder}/{prefix}_METRICS", mode)


def write_filtered(kept: DataFrame, removed: DataFrame, available: DataFrame, folds: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Kept decisions, their seeds, folds (seed, fold) and a summary of what was removed (rows: row_id, seed, node, target)."""
    mode = "overwrite" if overwrite else "errorifexists"
    kept.write.mode(mode).option("header", True).csv(f"{folder}/decisions")
    kept.select("seed").distinct().orderBy("seed").write.mode(mode).text(f"{folder}/seeds")
    folds.write.mode(mode).option("header", True).csv(f"{folder}/folds")
    filter_summary(kept, removed, available).select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(f"{folder}/summary")


def filter_summary(kept: DataFrame, removed: DataFrame, available: DataFrame) -> DataFrame:
    """One row: kept and removed rows and seeds, ids that were missing, rows by target."""
    side = kept.select("row_id", "seed", "target", F.lit(True).alias("k")).unionByName(removed.select("row_id", "seed", "target", F.lit(False).alias("k")))
    counts = side.agg(F.count(F.lit(1)).alias("input_rows"), F.count_if("k").alias("output_rows"), F.count_if(~F.col("k")).alias("removed_rows"), F.count_distinct("seed").alias("input_seeds"), F.count_distinct(F.when(F.col("k"), F.col("seed"))).alias("output_seeds"), F.count_if(F.col("k") & (F.col("target") == 1)).alias("kept_positives"), F.count_if(F.col("k") & (F.col("target") == 0)).alias("kept_negatives"))
    missing = removed.select(F.explode(F.array("seed", "node")).alias("node")).distinct().join(available.select("node").distinct(), "node", "left_anti").agg(F.count(F.lit(1)).alias("removed_missing_ids"))
    return counts.join(F.broadcast(missing), how="cross")  # one row each


def publish(spark: SparkSession, names: list[str], source: str, target: str) -> list[str]:
    """Copy the named artifacts from one folder to another; nothing is copied unless all are there."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    pairs = [(hadoop.Path(f"{source}/{n}"), hadoop.Path(f"{target}/{n}")) for n in names]
    absent = [n for n, (a, _) in zip(names, pairs, strict=True) if not a.getFileSystem(conf).exists(a)]
    if absent:
        raise FileNotFoundError(f"missing artifacts: {', '.join(absent)}")
    for a, b in pairs:
        b.getFileSystem(conf).mkdirs(b.getParent())
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    return [f"{target}/{n}" for n in names]


def append_statistics(rows: DataFrame, path: str) -> None:
    """Append statistics rows to a table; many writers may append at once."""
    rows.write.mode("append").parquet(path)


def flat_metrics(metrics: DataFrame) -> DataFrame:
    """One wide row of (name, value) metrics."""
    return metrics.groupBy().pivot("name").agg(F.first("value"))


def coverage(wanted: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """One row: required, found and missing ids."""
    rows = wanted.select(key).distinct().join(found.select(key, F.lit(1).alias("f")).distinct(), key, "left")
    return rows.agg(F.count(F.lit(1)).alias("required"), F.count("f").alias("found"), F.count_if(F.col("f").isNull()).alias("missing"))
