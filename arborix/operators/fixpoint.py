"""Cutting the lineage of driver-controlled loops with tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; where that is unset and one machine does all, a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="arborix-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of the tables that one task of a shuffle gets about (some 400 bytes each in joins of strings), whatever their number.
ROWS_A_TASK = 1_000_000
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of the session's shuffles, before Spark joins small ones."""
    return int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def widen(spark: SparkSession, *tables: DataFrame) -> None:
    """Raise the partitions of the session's shuffles (never lower them) with the tables' rows, so that a task's share doesn't grow.

    Adaptive execution still joins small partitions.
    """
    rows = sum(t.count() for t in tables)  # Parquet files say it in their footers
    if rows // ROWS_A_TASK > shuffle_width(spark):
        spark.conf.set(_INITIAL, str(rows // ROWS_A_TASK))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so that the next level's plan starts from a table any executor can read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/level-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucket_count(spark: SparkSession) -> int:
    return max(shuffle_width(spark), 2 * spark.sparkContext.defaultParallelism)


def settle_by(df: DataFrame, key: str | list[str], unique: list[str] | None = None) -> DataFrame:
    """``settle`` in buckets of ``key``: joins by it at each level read the table where it lies, without a shuffle.

    ``unique`` (``key`` among them): one row of each.
    """
    spark = df.sparkSession
    name = f"level_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    n, keys = bucket_count(spark), [key] if isinstance(key, str) else key
    dealt = df.repartition(n, *keys)
    (dealt.dropDuplicates(unique) if unique else dealt).write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.stored_at, out.stored_as = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, before the driver's JVM ends."""
    for t in tables:
        spark = t.sparkSession
        if hasattr(t, "stored_as"):
            spark.sql(f"DROP TABLE IF EXISTS {t.stored_as}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def ordinals(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """``df`` with each row's place (from 0) in a total order, without sorting in one task.

    Rows are dealt by ranges and stored with their range's number, so that counting and numbering see the same ranges.
    """
    dealt = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_count"))  # one row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).drop("_part", "_place", "_base")
