"""Usage of attempts as they arrive: an append-only log read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attempt_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def windowed_usage(attempts: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Attempts, failures and tokens by window and status; windows close ``late`` after the latest time seen."""
    rows = attempts.withWatermark(time, late).groupBy(F.window(time, width), "status")
    return rows.agg(F.count(F.lit(1)).alias("attempts"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "status", "attempts", "tokens")


def spend_guard(attempts: DataFrame, cap: float) -> DataFrame:
    """One running row: the cost so far and whether more may be dispatched."""
    return attempts.groupBy().agg(F.sum("cost").alias("cost")).withColumn("may_dispatch", F.coalesce("cost", F.lit(0.0)) < cap)
