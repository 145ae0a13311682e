"""What the operators of this subpackage share: scratch tables, text batches, word hashes, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a batch holds at least one row, however long.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where that is unset and one machine does all (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="arborix-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """Within, each action's shuffles are deleted once it ends. What is executed there must not be executed elsewhere."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def materialize_by(df: DataFrame, name: str, key: str, within: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """``materialize`` in buckets of ``key``: joins by it read the table where it lies, without a shuffle.

    ``within`` is applied to the rows once they are dealt by ``key``, and must leave them where they are.
    """
    spark = df.sparkSession
    path, called = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    within(df.repartition(n, key)).write.bucketBy(n, key).option("path", path).saveAsTable(called)
    out = spark.table(called)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables (of ``materialize``) that nothing reads any more, before the driver's JVM ends."""
    for t in tables:
        spark = t.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches handed to Python by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def frugal(run: Callable) -> Callable:
    """``run`` over batches, giving memory back when its task ends: workers are kept for other stages' tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


#: Resident bytes below which a worker has nothing worth giving back.
MODEST = 150 << 20


def release_memory() -> None:
    import ctypes
    import gc
    import os

    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < MODEST:
                return
    except OSError:  # no such file on this system
        pass
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly the id and the text, whatever other columns there are; a null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


#: Ids that are broadcast at most to pick documents (8 bytes each); above this the texts are shuffled to the ids.
BROADCAST_IDS = 1_000_000


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents among ``wanted`` (doc_id), a stored table."""
    ids = wanted.select("doc_id").distinct()
    return texts(docs).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def chunks(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[tuple[list, list]]:
    """(ids, UTF-8 texts) of a batch in runs of about ``size`` bytes, in order."""
    ids, found = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
    start, total = 0, 0
    for i, x in enumerate(found):
        total += len(x)
        if total >= size:
            yield ids[start : i + 1], found[start : i + 1]
            start, total = i + 1, 0
    if start < len(found):
        yield ids[start:], found[start:]


#: Unicode's white space. Python's \\s has four control characters more.
WHITE_SPACE = r" \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def unicode_spaces(pattern: str) -> str:
    """The pattern with \\s and \\S spelt out as Unicode's white space, inside and outside of character classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        x = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(x)
        if x == r"\s":
            x = WHITE_SPACE if inside else f"[{WHITE_SPACE}]"
        elif x == r"\S" and not inside:
            x = f"[^{WHITE_SPACE}]"
        inside = x == "[" or inside and x != "]"
        out.append(x)
    return "".join(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes hashed at once: memory is bounded by this, not by a text's length.
SEGMENT = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes that part words of letters and digits; all of non-ASCII letters' bytes belong to words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(found: list[bytes], lower: bool = False, parting: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts.

    Returns their 64-bit hashes, their first bytes' places and their ends (in the texts joined by one space each),
    and for each text where its words begin (one entry more than texts). ``lower`` lower-cases A-Z. ``parting`` marks other
    bytes than white space that part words.
    """
    data = np.frombuffer(b" ".join(found) + b" ", np.uint8)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and not parting[data[end - 1]]:  # a word isn't cut, however long
            gap = np.flatnonzero(parting[data[end : end + SEGMENT]])
            end += int(gap[0]) + 1 if len(gap) else min(SEGMENT, len(data) - end)
        parts.append(_segment_hashes(data[at:end], at, lower, parting))
        at = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    text_at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in found])))
    return hashes, starts, ends, np.searchsorted(starts, text_at)


def _segment_hashes(data: np.ndarray, at: int, lower: bool, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of the words of one segment, which begins at ``at`` and doesn't cut a word."""
    space = parting[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    terms = (_LOWER[data] if lower else data).astype(np.uint64)
    terms += np.uint64(1)
    terms *= _powers(_P, len(data))
    np.cumsum(terms, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_P_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64)), starts + at, ends + at


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words within each text, and the new bounds. Texts with fewer words have none."""
    n = max(0, len(words) - width + 1)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    keep = np.zeros(n + width, bool)
    marks = np.zeros(n + width + 1, np.int64)
    full = counts > 0
    np.add.at(marks, bounds[:-1][full], 1)
    np.add.at(marks, bounds[:-1][full] + counts[full], -1)
    keep = np.cumsum(marks)[:n] > 0
    return mix(rolled[keep]), np.concatenate(([0], np.cumsum(counts)))


def hot_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, share: float = 0.002, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (one row a key) where a key may hold a large part of ``left``.

    ``counts`` has (key, n) of left. At most ``1 / share`` keys hold more than ``share`` of its rows; their rows of
    ``right`` are broadcast, a proven bound. All other keys are joined by a shuffle.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.filter(F.col("n") > max(1.0, share * total)).select(key).collect()] if total else []
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.filter(~is_hot | F.col(key).isNull()).join(right.filter(~is_hot), key, how)
    warm = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return cold.unionByName(warm)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): (id, component), the smallest id of each component.

    Alternates large-star and small-star steps until no edge changes. Every step is a grouped minimum and a join back
    (never a gathered group), written to the shared folder. Ids without edges don't appear.
    """
    spark = edges.sparkSession
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = now.join(low, "a").select(F.col("b").alias("x"), "m")  # a < b always: b hangs on the least of a's
        linked = large.unionByName(low.select(F.col("a").alias("x"), "m")).filter("m < x")
        # small-star: each x keeps its least neighbour; its other neighbours hang on that one
        least = linked.groupBy("x").agg(F.min("m").alias("least"))
        small = linked.join(least, "x")
        after = materialize(small.select(F.col("least").alias("a"), F.col("x").alias("b")).unionByName(small.select(F.col("least").alias("a"), F.col("m").alias("b"))).filter("a < b").distinct(), "edges")
        # done when every node hangs on one root that hangs on nothing
        bad = after.select(F.col("a").alias("id")).join(after.select(F.col("b").alias("id")), "id", "left_semi").limit(1).count() or after.groupBy("b").count().filter("count > 1").limit(1).count()
        now = after
        if not bad:
            return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
    raise RuntimeError("components did not settle")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(id_col: str | Column) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary") if isinstance(id_col, str) else id_col.cast("string").cast("binary"))
