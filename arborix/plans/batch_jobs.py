"""Offline batches: request lines with a manifest, and the score of a finished batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.operators import classify, metrics, traverse
from arborix.sources import tables


def prepare(rows: DataFrame, prefix: str, system: str, size: int = 20, order: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """(request lines, manifest (key, idx, row_id)) of rows (row_id, evidence, ``order``)."""
    batched = classify.batches(rows.select("row_id", "evidence", order), [order, "row_id"], size)
    manifest = batched.select(F.format_string(prefix + "_batch%06d", "batch").alias("key"), "idx", "row_id")
    return classify.request_lines(classify.messages(batched, "evidence", []), prefix, system), manifest


def predictions(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """(row_id, prediction, matched) from result lines: what is missing, doubled or an error has no prediction."""
    answers = tables.recorded_answers(results).filter("idx IS NOT NULL").select("key", F.col("idx").cast("long").alias("idx"), "classification")
    return tables.match_answers(manifest, answers, ["key"]).select("row_id", "prediction", "matched")


def score(rows: DataFrame, predicted: DataFrame) -> DataFrame:
    """Confusion metrics of rows (row_id, seed, node, parent, target) after gating by their ancestors, and of them ungated."""
    judged = rows.join(predicted.select("row_id", F.col("prediction").alias("raw")), "row_id", "left")
    gated = traverse.ancestor_gating(judged.select("row_id", "seed", "node", "parent", "raw", "target"))
    views = gated.select(F.lit("gated").alias("view"), "target", F.col("effective").alias("prediction")).unionByName(judged.select(F.lit("ungated").alias("view"), "target", F.col("raw").alias("prediction")))
    return metrics.confusion(views, ["view"])
