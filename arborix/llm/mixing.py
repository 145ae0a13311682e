"""Mixing sources to target weights by systematic sampling.

Sources have weights, and their targets share ``share`` times all words by weight. No target exceeds ``most`` times its
source's size: what lies above is shared out by weight again, which comes to ``min(most * size, level * weight)`` for one
level. That level is found by prefix sums over the sources in order of ``most * size / weight``, where they fill up.

A document's expected copies are its source's target by its source's size. Within each source, documents lie in order of falling size
(then id), and their expected copies are summed up from a start drawn for the source; a document is taken once for each
integer that its stretch crosses. Expected copies of r thus give floor(r) or ceil(r) copies, never more than ``most``, and as sizes fall along the sums, a
source's taken words differ from its target by less than its largest document.

Sums are integers in units of 2^-36, taken by ranges of the order (no group passes through one task) and reduced to
their fraction, so they neither round nor overflow and any number of tasks gives the same copies.

* A null or empty text has size 0: it is taken as often as any other, with 0 words. A source of size 0 has target 0.
* A null source is a source of its own, the last; a null id is an id like any other, the first of its size.
* Repeated rows are documents of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, hot_join, materialize

#: One copy in the units of the sums; the drawn start is the first 9 hexadecimal digits of an MD5, as many bits.
ONE = 1 << 36
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], values: list[str], modulo: int | None = None) -> DataFrame:
    """``rows`` with ``<value>_before``: the sum of a value over the rows before in ``order`` within ``group`` (no nulls there).

    Rows are dealt by ranges of (group, order) and stored with their range's number; each range sums its own, and the ranges'
    sums (a row for each range and group) are summed in turn. With ``modulo`` only remainders are kept.
    """
    cut = (lambda c: F.pmod(c, F.lit(modulo))) if modulo else (lambda c: c)
    dealt = materialize(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part", *group).agg(*[cut(F.sum(v)).alias(v) for v in values])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_part", *group, *[cut(F.coalesce(F.sum(v).over(earlier), F.lit(0))).alias(f"{v}_base") for v in values])
    own = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({f"{v}_own": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values})
    joined = within.join(base, ["_part", *group])
    return joined.select(*rows.columns, *[cut(F.col(f"{v}_base") + F.col(f"{v}_own")).alias(f"{v}_before") for v in values])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``sources`` (source, source_size) with ``weight``, ``target`` and ``rate``, the expected copies of a document in units of 1 / ONE."""
    named = sources.select("source", "source_size", F.col("source").isNull().cast("int").alias("late"), F.lit(1).cast("long").alias("one"), F.lit(0).alias("all"))
    numbered = prefix_sums(named, ["all"], ["late", "source"], ["one"])
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("one_before", F.lit(len(weights))) + 1).cast("int"))
    weighed = numbered.select("source", "source_size", "all", F.col("one_before").alias("place"), weight.alias("weight"))
    weighed = weighed.withColumn("cap", F.col("source_size") * most).withColumn("fills", F.col("cap") / F.col("weight"))
    ordered = materialize(prefix_sums(weighed, ["all"], ["fills", "place"], ["cap", "weight"]), "sources")
    total, weight_sum = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share * (total or 0)) - F.col("cap_before")) / (F.lit(weight_sum or 0) - F.col("weight_before"))
    open_ = ordered.filter(F.col("fills") > level).orderBy("fills", "place").select(level.alias("level")).first()
    full = F.lit(True) if open_ is None else F.col("fills") <= F.lit(open_.level)
    aim = F.lit(0.0 if open_ is None else open_.level) * F.col("weight")
    rate = F.when(F.col("source_size") == 0, F.lit(0)).when(full, F.lit(most * ONE)).otherwise(F.least(F.lit(most * ONE), F.floor(aim / F.col("source_size") * ONE)))
    return ordered.select("source", "source_size", "weight", F.when(full, F.col("cap").cast("double")).otherwise(aim).alias("target"), rate.cast("long").alias("rate"))


def start_of(source: Column, seed: int) -> Column:
    """The drawn start of a source's sums, in units of 1 / ONE."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 9), 16, 10).cast("long")


def crossings(rows: DataFrame, group: list[str], order: list[str], expected: str, start: str) -> DataFrame:
    """``rows`` with ``copies``: how many integers each row's stretch of expected copies crosses within its group.

    ``expected`` and ``start`` are columns of integers in units of 1 / ONE.
    """
    parted = rows.withColumn("_rest", F.pmod(F.col(expected), F.lit(ONE)))
    summed = prefix_sums(parted, group, order, ["_rest"], ONE)
    over = F.pmod(F.col("_rest_before") + F.col(start), F.lit(ONE)) + F.col("_rest") >= ONE
    return summed.withColumn("copies", ((F.col(expected) - F.col("_rest")) / ONE).cast("long") + over.cast("long")).drop("_rest", "_rest_before")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 12) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs`` (doc_id, text, source)."""
    size = F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    sized = materialize(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size")), "sizes")
    counted = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name")  # no null, so that it can be joined
    aims = targets(counted, weights, share, most).select(key, "source_size", "target", "rate", start_of(F.col("source"), seed).alias("start"))
    joined = hot_join(sized.select("doc_id", "source", "size", key), materialize(aims, "targets"), "name", counted.select(key, "n"))
    placed = joined.withColumn("falling", -F.col("size"))
    return crossings(placed, ["name"], ["falling", "doc_id"], "rate", "start").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` (of ``mix`` over the same rows) takes them, with a column ``copy`` (from 1).

    Rows that have id, source and number of words in common are handed their copies in order of their texts.
    """
    free = lambda name: free_name(docs, name)
    copy, place, taken = free("copy"), free("place"), free("taken")
    size = F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    same = [docs["doc_id"].cast("long"), docs["source"].cast("string"), size]
    placed = docs.withColumn(place, F.row_number().over(Window.partitionBy(*same).orderBy(docs["text"])))
    alike = Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("copies"))
    found = mixed.select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.row_number().over(alike).alias("_p"), F.col("copies").alias(taken)).filter(F.col(taken) > 0)
    own_size = F.regexp_count(F.coalesce(placed["text"].cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    on = placed["doc_id"].cast("long").eqNullSafe(found["_i"]) & placed["source"].cast("string").eqNullSafe(found["_s"]) & (own_size == found["_n"]) & (placed[place] == found["_p"])
    return placed.join(found, on).select(*[placed[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(taken).cast("int"))).alias(copy))
