"""Key-value artifacts: a table laid out by buckets of its key, for point lookups and full scans.

A lookup of few keys reads only the folders of their buckets; of many keys it is a semi join. The bucket is a hash of the
key, so any writer and any reader agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import coverage

#: Keys up to which a lookup names its buckets in the filter.
FEW = 1000
#: Rows of a bucket on average.
BUCKET_ROWS = 500_000


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_store(records: DataFrame, path: str, buckets: int | None = None, overwrite: bool = False, order: str | None = None) -> int:
    """Write (key, value) once, in as many buckets as keep ``BUCKET_ROWS`` rows each on average (returned) or as given.

    Of several rows of one key the last by ``order`` counts, as in a store that is overwritten in turn; without an order, a key
    with two values is an error.
    """
    named = records.select(F.col("key").cast("string").alias("key"), "value", *([F.col(order).alias("_order")] if order else []))
    if order:
        one = named.groupBy("key").agg(F.max_by("value", "_order").alias("value"))
    else:
        twice = F.raise_error(F.concat(F.lit("a key with two values and no order: "), F.coalesce("key", F.lit("null"))))
        one = named.groupBy("key").agg(F.min("value").alias("value"), F.max("value").alias("_other"))
        one = one.filter(F.when(F.col("value").eqNullSafe(F.col("_other")), True).otherwise(twice.cast("boolean"))).select("key", "value")
    buckets = buckets or max(1, -(-records.count() // BUCKET_ROWS))
    dealt = one.withColumn("bucket", _bucket(F.col("key"), buckets)).repartition(buckets, "bucket")
    dealt.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("bucket").parquet(f"{path}/of={buckets}")
    return buckets


def buckets_of(spark: SparkSession, path: str) -> int:
    """The number of buckets of a store, from its folders' names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    numbers = [int(n.removeprefix("of=")) for n in found if n.startswith("of=")]
    if len(numbers) != 1:
        raise ValueError(f"{path} is no store, or one that was written with several numbers of buckets")
    return numbers[0]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the whole store."""
    return spark.read.parquet(path).select("key", "value")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, value) of the keys asked for (key); a key that the store lacks has a null value."""
    buckets = buckets_of(spark, path)
    asked = keys.select(F.col("key").cast("string").alias("key")).distinct()
    store = spark.read.parquet(f"{path}/of={buckets}")
    some = asked.limit(FEW + 1).select(_bucket(F.col("key"), buckets).alias("b")).distinct().collect() if asked.limit(FEW + 1).count() <= FEW else None
    if some is not None:
        store = store.filter(F.col("bucket").isin(*[r["b"] for r in some]))
    return asked.join(store.select("key", "value"), "key", "left")


def missing_ids(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(id): ids asked for that the store lacks."""
    return wanted.select("id").distinct().join(found.select("id").distinct(), "id", "left_anti")


def coverage_manifest(wanted: DataFrame, found: DataFrame, key_format: str = "uri") -> DataFrame:
    """One JSON document (value): the key format and the numbers of required, found and missing ids; the missing ones are ``missing_ids``."""
    return coverage(wanted, found).select(F.to_json(F.struct(F.lit(key_format).alias("key_format"), "required", "found", "missing")).alias("value"))


def store_key(identifier: Column, key_format: str = "uri", prefix: str = "http://www.wikidata.org/entity/") -> Column:
    """A store's key of an id: the id itself (``qid``), or its IRI in angle brackets (``uri``)."""
    if key_format not in ("uri", "qid"):
        raise ValueError(f"no key format {key_format}")
    return F.concat(F.lit(f"<{prefix}"), identifier, F.lit(">")) if key_format == "uri" else identifier
