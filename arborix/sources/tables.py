"""Lists, decisions, demonstrations, embeddings and recorded answers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborix.functions.text import casefold, decision, outermost_object

from .arrays import read_npy


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def properties(lines: DataFrame, column: str = "value") -> DataFrame:
    """(predicate, inverse) of property lines; the prefix ``(-)`` marks the inverse direction."""
    c = F.trim(column)
    return lines.select(F.regexp_replace(c, r"^\(-\)", "").alias("predicate"), c.startswith("(-)").alias("inverse")).filter("predicate <> ''")


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    return properties(spark.read.text(path))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row_index``, their place in the files, without moving them: partition counts give the offsets."""
    marked = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    counts = sorted((r[0], r[1]) for r in marked.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets += [F.lit(part), F.lit(total)]
        total += n
    offset = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0)
    return marked.withColumn("row_index", (offset + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_id", "_part")


def decisions(raw: DataFrame) -> DataFrame:
    """Gold decisions of rows with a seed, a node and a target, each trimmed; row ids keep the gaps of dropped rows.

    ``raw`` has row_index, from, "starting label", QID, label, depth and target (or the older name decision).
    """
    target = F.col("target") if "target" in raw.columns else F.col("decision")
    text = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    out = raw.select(F.concat(F.lit("row"), F.col("row_index")).alias("row_id"), "row_index", text("from").alias("seed"), text("starting label").alias("seed_label"), text("QID").alias("node"), text("label").alias("label"), F.expr("try_cast(depth AS INT)").alias("depth"), F.trim(target.cast("string")).alias("raw"))
    return out.filter("seed <> '' AND node <> '' AND raw <> ''").withColumn("target", decision(F.col("raw"))).drop("raw")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return decisions(numbered(spark.read.option("header", True).csv(path)))


def demonstrations(raw: DataFrame) -> DataFrame:
    """(node, decision) with the decision as 0 or 1; an error where a node (by casefold) has two rows."""
    rows = raw.select(F.trim("node").alias("node"), decision(F.col("decision")).alias("decision"))
    n = F.count(F.lit(1)).over(Window.partitionBy(casefold(F.col("node"))))
    return rows.withColumn("n", n).withColumn("decision", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("a node occurs twice: "), "node")).cast("int")).otherwise(F.col("decision"))).drop("n")


def embeddings_for(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, vector) of tab-separated lines for the ids wanted; the first line of an id counts."""
    parts = F.split("value", "\t")
    rows = lines.select(F.regexp_extract(parts[0], "([^/>]+)>?$", 1).alias("id"), F.slice(parts, F.lit(2), F.size(parts)).alias("raw"))
    own = numbered(rows).join(F.broadcast(wanted.select("id").distinct()) if wanted.count() <= 1_000_000 else wanted.select("id").distinct(), "id", "left_semi")
    first = own.groupBy("id").agg(F.min_by("raw", "row_index").alias("raw"))
    return first.select("id", F.transform("raw", lambda x: x.cast("double")).alias("vector"))


def array_positions(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, position) of the ids wanted in JSON string arrays (column value)."""
    rows = names.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "id"))
    return rows.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "position")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(position, vector) of a two-dimensional NPY file in C order, by runs of rows."""
    return read_npy(spark, path).select("position", "vector")


def match_answers(batch: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """``batch`` (keys, idx from 1) with ``prediction`` and ``matched``: no match where an index is missing or doubled."""
    single = answers.groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("n"), F.first("classification").alias("answer"))
    joined = batch.join(single, [*keys, "idx"], "left")
    good = F.col("n") == 1
    return joined.withColumn("prediction", F.when(good & F.upper("answer").isin("INCLUDE", "EXCLUDE"), (F.upper("answer") == "INCLUDE").cast("int"))).withColumn("matched", F.when(F.col("prediction").isNull(), "NO_MATCH").otherwise("MATCHED")).drop("n", "answer")


def recorded_answers(lines: DataFrame) -> DataFrame:
    """(key, idx, classification, confidence, error) of result lines {"key", "response" or "error"}; bad lines stay as errors."""
    body = "evaluations array<struct<idx:int,classification:string,confidence:double>>"
    parsed = lines.select(F.get_json_object("value", "$.key").alias("key"), F.coalesce(F.get_json_object("value", "$.response.text"), F.get_json_object("value", "$.response")).alias("text"), F.get_json_object("value", "$.error").alias("error"))
    parsed = parsed.withColumn("body", F.from_json(outermost_object(F.col("text")), body))
    error = F.coalesce("error", F.when(F.col("key").isNull(), "no key"), F.when(F.col("body.evaluations").isNull(), "no evaluations"))
    return parsed.select("key", F.explode_outer("body.evaluations").alias("e"), error.alias("error")).select("key", "e.idx", "e.classification", "e.confidence", "error")


def require_unique(rows: DataFrame, column: str) -> DataFrame:
    """``rows``, failing when read if a value of ``column`` is blank or occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(column))
    bad = F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "") | (n > 1)
    return rows.withColumn("_bad", bad).filter(F.when(F.col("_bad"), F.raise_error(F.concat(F.lit(f"{column} is blank or not unique: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)).drop("_bad")
