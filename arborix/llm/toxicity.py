"""Toxicity scores from class-conditional Kneser-Ney models of expressions (words and word pairs).

The class is the history: P(expression | class) takes a fixed discount off each count and gives the mass saved to one shared
backoff distribution, the Kneser-Ney continuation counts (in how many classes an expression occurs). A text's evidence is the
length-normalised difference of its toxic and ordinary log-likelihoods, by words and by pairs, each over the whole text and
over the stretches of ``STRETCHES`` expressions where it is largest; a logistic curve maps these to a score.

* Words are runs of letters and digits, A-Z lower-cased; expressions are told apart by 63-bit hashes. All training rows are
  counted, and the counts are a stored table that grows with the corpus. What no class has twice (``SEEN``) is no evidence; all
  else counts, at any size. A table of up to ``TABLE_ROWS`` rows (16 bytes each) is broadcast. Of a larger one the most frequent
  rows are, at most ``FREQUENT_ROWS``, and of the rest what the texts have is joined to them. The table lies in buckets of its
  keys, so that only keys, what is found and the texts are shuffled, the texts compressed in chunks. A bitmap of the rest's keys
  spares most questions after keys that it doesn't have; a bit too many costs work, never results. The texts are joined in
  ``PARTS`` parts, one after another, each of which stores its evidence and gives its disk back.
* A null or empty text has no words: its evidence is 0. Repeated rows count as often as they occur.
* Null labels are ignored. Without training rows of both classes every score is 0.
* The curve is fitted on at most ``CURVE_ROWS`` training rows, the first by hash, each with its own counts taken off. If they
  are of one class the curve is ``FIXED_CURVE``. Extra columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, NOT_ALNUM, bounded_batches, chunks, discard, free_name, frugal, materialize, materialize_by, mix, release_memory, scratch_path, shuffles_given_back, texts, word_hashes

#: Rows for the logistic curve at most; labels up to which the label side of the join is broadcast (16 bytes each).
CURVE_ROWS, BROADCAST_LABELS = 20_000, 1_000_000
#: Rows of a whole table in memory at most, and of a larger one's most frequent rows (beside them tasks hold what is joined).
TABLE_ROWS, FREQUENT_ROWS = 4_000_000, 3_000_000
#: Parts in which texts are joined to the rest, and bytes of a chunk of texts then.
PARTS, JOINED_BYTES = 4, 1 << 19
DISCOUNT, STRETCHES, SEEN = 0.9, (1, 4), 2
#: The bias, and a weight for each number of the evidence.
FIXED_CURVE = (-7.0, 1.0, 1.0, 1.5, 0.0, 0.0, 0.0)
#: Expressions that a task counts before it hands them on.
HELD = 1 << 22
LEADING = 23
#: Leading bits of the keys of the rows that aren't broadcast: a bitmap of 8 MB, whatever the corpus.
ASKED_BITS = 26


def expressions(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the words, keys of the pairs that end in them, bounds of each text). Keys of pairs are odd, of words even."""
    hashes, _, _, bounds = word_hashes(found, lower=True, parting=NOT_ALNUM)
    before = np.concatenate((np.zeros(1, np.uint64), hashes[:-1])) if len(hashes) else hashes
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    one = np.uint64(1)
    return hashes & ~one, mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes) | one, bounds


def differences(toxic: np.ndarray, ordinary: np.ndarray, totals: tuple[float, ...]) -> np.ndarray:
    """log P(e | toxic) - log P(e | ordinary) from an expression's counts.

    ``totals``: all of either class, the discounted mass of either, and in how many classes all expressions occur.
    """
    shared = ((toxic > 0).astype(np.float64) + (ordinary > 0)) / totals[4]
    p = [np.maximum(x - DISCOUNT, 0) / n + saved / n * shared for x, n, saved in ((toxic, totals[0], totals[2]), (ordinary, totals[1], totals[3]))]
    known = shared > 0
    out = np.zeros(len(toxic))
    out[known] = np.log(p[0][known]) - np.log(p[1][known])
    return out


@dataclass
class Model:
    """Rows of the table in memory in the order of their keys, and the totals of words and of pairs."""

    keys: np.ndarray
    counts: np.ndarray  # toxic, ordinary
    leading: np.ndarray  # which leading bits the keys have: most expressions of a text need no search
    totals: tuple[tuple[float, ...], tuple[float, ...]]

    @classmethod
    def of(cls, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, totals: tuple) -> Model:
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        leading = np.zeros(1 << LEADING, bool)
        leading[keys >> np.uint64(64 - LEADING)] = True
        return cls(keys[order], np.column_stack((toxic, ordinary))[order].astype(np.float32), leading, totals)

    def has(self, asked: np.ndarray) -> np.ndarray:
        out = self.leading[asked >> np.uint64(64 - LEADING)]
        there = np.flatnonzero(out)
        if len(there):
            out[there] = self.keys[np.minimum(np.searchsorted(self.keys, asked[there]), len(self.keys) - 1)] == asked[there]
        return out

    def terms(self, asked: np.ndarray, kind: int, bounds: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Each expression's part of the difference; 0 for those seen too seldom. ``own``: the texts' classes, to take their own counts off."""
        out = np.zeros(len(asked))
        if not len(self.keys):
            return out
        there = np.flatnonzero(self.leading[asked >> np.uint64(64 - LEADING)])
        at = np.minimum(np.searchsorted(self.keys, asked[there]), len(self.keys) - 1)
        same = self.keys[at] == asked[there]
        there, at = there[same], at[same]
        counts = self.counts[at].astype(np.float64)
        if own is not None:
            text = np.repeat(np.arange(len(own), dtype=np.int64), np.diff(bounds))[there]
            _, back, often = np.unique(text * len(self.keys) + at, return_inverse=True, return_counts=True)
            toxic = own[text] == 1
            counts[:, 0] -= np.where(toxic, often[back], 0)
            counts[:, 1] -= np.where(toxic, 0, often[back])
            np.maximum(counts, 0, out=counts)
        values = differences(counts[:, 0], counts[:, 1], self.totals[kind])
        out[there] = np.where(counts.sum(axis=1) >= SEEN, values, 0)
        return out

    def evidence(self, found: list[bytes], own: np.ndarray | None = None, rest: Model | None = None) -> np.ndarray:
        """Six numbers a text: the mean difference of words, then of pairs, over all the text and over its most toxic stretches.

        ``rest``: further rows of the table, with other keys.
        """
        word, pair, bounds = expressions(found)
        counts = np.diff(bounds)
        full = np.flatnonzero(counts > 0)
        out = np.zeros((len(found), 2 * (1 + len(STRETCHES))))
        for kind, keys in enumerate((word, pair)):
            terms = self.terms(keys, kind, bounds, own)
            if rest is not None:
                terms += rest.terms(keys, kind, bounds, own)
            sums = np.concatenate(([0.0], np.cumsum(terms)))
            whole = (sums[bounds[1:]] - sums[bounds[:-1]])[full] / counts[full]
            first = kind * (1 + len(STRETCHES))
            out[full, first] = whole
            for k, length in enumerate(STRETCHES, first + 1):
                out[full, k] = whole  # of texts that are no longer than a stretch
                long = np.flatnonzero(counts > length)
                if len(long):
                    means = np.append(sums[length:] - sums[:-length], np.full(length, -np.inf)) / length
                    edges = np.column_stack((bounds[:-1][long], bounds[1:][long] - length + 1)).ravel()
                    out[long, k] = np.maximum.reduceat(means, edges)[::2]
        return out


@dataclass
class Fitted:
    """The stored table (key, toxic, ordinary), the totals, the curve, what of the table is in memory, and what isn't.

    Without a model in memory the whole table is joined to the texts; without a rest the model has all of it.
    """

    table: DataFrame
    totals: tuple[tuple[float, ...], tuple[float, ...]]
    curve: np.ndarray
    model: Model | None
    rest: DataFrame | None = None
    asked: tuple[DataFrame, np.ndarray] | None = None  # a table that was joined, and the bitmap of its keys

    def joined(self) -> DataFrame | None:
        return self.table if self.model is None else self.rest

    def bitmap(self) -> np.ndarray:
        """Of the keys that are joined; made once."""
        if self.asked is None or self.asked[0] is not self.joined():
            self.asked = (self.joined(), _bitmap(self.joined()))
        return self.asked[1]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): the labels are broadcast if few enough, else both sides are shuffled by id."""
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter("toxic IN (0, 1)")
    if own.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return texts(docs).join(own, "doc_id")


def counted_expressions(rows: DataFrame) -> DataFrame:
    """(key, both): how often a task has met an expression in the texts of either class, as one number (toxic << 32 | ordinary)."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> pa.RecordBatch:
            keys, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys)
            keys = keys[order]
            begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n, t = np.diff(np.append(begin, len(keys))), np.add.reduceat(toxic[order].astype(np.int64), begin)
            return pa.RecordBatch.from_arrays([pa.array(keys[begin].view(np.int64)), pa.array(t << 32 | (n - t))], names=["key", "both"])

        for batch in batches:
            toxic, at = batch.column(2).to_numpy(), 0
            for ids, found in chunks(batch, 2 << 20):
                word, pair, bounds = expressions(found)
                if len(word):
                    own = np.repeat(toxic[at : at + len(ids)], np.diff(bounds)).astype(np.int8)
                    held += [(word, own), (pair, own)]
                at += len(ids)
                if sum(len(x[0]) for x in held) >= HELD:
                    yield counted()
        if held:
            yield counted()

    return rows.select("doc_id", "text", "toxic").mapInArrow(frugal(run), "key long, both long")


def expression_counts(counted: DataFrame) -> DataFrame:
    """(key, toxic, ordinary): how often each expression occurs in the texts of either class; the two are added up apart from each other."""
    return counted.groupBy("key").agg(F.sum(F.shiftright("both", 32)).alias("toxic"), F.sum(F.col("both").bitwiseAND(F.lit((1 << 32) - 1))).alias("ordinary"))


def _least_held(table: DataFrame) -> int:
    """The least number of times from which on expressions are at most ``FREQUENT_ROWS``; a power of 2 above 1,024."""
    n = F.col("toxic") + F.col("ordinary")
    sizes = table.groupBy(F.when(n < 1024, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n)))).cast("long").alias("least")).count().orderBy(F.desc("least")).collect()
    least, total = 1 << 62, 0
    for size in sizes:
        total += size["count"]
        if total > min(TABLE_ROWS, FREQUENT_ROWS):
            break
        least = size["least"]
    return least


def fit_counts(rows: DataFrame, least_share: float | None = None) -> Fitted | None:
    """The two classes' models from (doc_id, text, toxic), without a curve yet; None unless both classes have words.

    One pass over the counts gives the totals of all of them and stores what occurs ``SEEN`` times and more in a class.
    ``least_share``: of a table that is too large for memory, hold what makes up this share of a class; by default, what there is room for.
    """
    totals_of = []
    for kind in (0, 1):
        own = F.col("key").bitwiseAND(F.lit(1)) == kind
        for c in ("toxic", "ordinary"):
            totals_of.append(F.sum(F.when(own, F.col(c))).alias(f"{c}{kind}"))
            totals_of.append(F.sum(F.when(own, F.least(F.col(c).cast("double"), F.lit(DISCOUNT)))).alias(f"saved_{c}{kind}"))
            totals_of.append(F.count_if(own & (F.col(c) > 0)).alias(f"kinds_{c}{kind}"))
    seen = Observation()
    with shuffles_given_back(rows.sparkSession):
        table = materialize_by(counted_expressions(rows), "expressions", "key", lambda x: expression_counts(x).observe(seen, *totals_of).filter(f"toxic >= {SEEN} OR ordinary >= {SEEN}"))
    found = {k: float(v or 0) for k, v in seen.get.items()}
    totals = tuple((found[f"toxic{k}"], found[f"ordinary{k}"], found[f"saved_toxic{k}"], found[f"saved_ordinary{k}"], found[f"kinds_toxic{k}"] + found[f"kinds_ordinary{k}"]) for k in (0, 1))
    if not totals[0][0] or not totals[0][1]:
        return None
    small = table.count() <= TABLE_ROWS
    if small:
        held, rest = table, None
    else:
        kind = F.col("key").bitwiseAND(F.lit(1))
        of = lambda i: F.when(kind == 0, F.lit(totals[0][i])).otherwise(F.lit(totals[1][i]))
        frequent = F.col("toxic") + F.col("ordinary") >= _least_held(table) if least_share is None else (F.col("toxic") >= least_share * of(0)) | (F.col("ordinary") >= least_share * of(1))
        held, rest = table.filter(frequent), table.filter(~frequent)
    model = None
    if small or 0 < held.count() <= TABLE_ROWS:
        got = held.toArrow()
        model = Model.of(*(got.column(i).to_numpy() for i in range(3)), totals)
        del got
        release_memory()
    return Fitted(table, totals, np.array(FIXED_CURVE), model, rest)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's steps, lightly held to 0; the bias first."""
    scale = x.std(axis=0) + 1e-9
    z = np.column_stack((np.ones(len(x)), x / scale))
    w = np.zeros(z.shape[1])
    held = np.full(len(w), 1e-3 * len(y) + 0.5)
    held[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(held + 1e-9), z.T @ (y - p) - held * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    w[1:] /= scale
    return w


def _bitmap(table: DataFrame) -> np.ndarray:
    """A bit for each value of a key's ``ASKED_BITS`` leading bits: set if the table has such a key. Of fixed size."""
    word, bit = F.shiftrightunsigned("key", 64 - ASKED_BITS + 6), F.shiftrightunsigned("key", 64 - ASKED_BITS).bitwiseAND(F.lit(63)).cast("int")
    got = table.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    out = np.zeros(1 << (ASKED_BITS - 6), np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def evidence(rows: DataFrame, fitted: Fitted, parts: int = PARTS) -> DataFrame:
    """(doc_id, unit, toxic, evidence) of rows (doc_id, text, toxic); a text's own counts are taken off where toxic isn't null.

    ``unit`` is the text's hash. What of the table isn't broadcast is joined: each text gets its own words' and pairs' rows. This
    is a stored table then, made in ``parts``.
    """
    spark, totals, rest = rows.sparkSession, fitted.totals, fitted.joined()
    bounded_batches(spark)
    rows = rows.select("doc_id", "text", "toxic", F.xxhash64("text").alias("unit"))
    schema = "doc_id long, unit long, toxic int, evidence array<double>"
    empty = np.empty(0, np.int64)
    handle = spark.sparkContext.broadcast(fitted.model or Model.of(empty, empty, empty, totals))

    def out(batch: pa.RecordBatch, at: int, n: int, values: np.ndarray) -> pa.RecordBatch:
        own = batch.slice(at, n)
        return pa.RecordBatch.from_arrays([own.column(0), own.column(3), own.column(2), pa.array(list(values), pa.list_(pa.float64()))], names=["doc_id", "unit", "toxic", "evidence"])

    def classes(batch: pa.RecordBatch, at: int, n: int) -> np.ndarray | None:
        own = batch.column(2).slice(at, n)
        return None if own.null_count else own.to_numpy()

    if rest is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for ids, found in chunks(batch):
                    yield out(batch, at, len(ids), handle.value.evidence(found, classes(batch, at, len(ids))))
                    at += len(ids)

        return rows.mapInArrow(frugal(run), schema)

    bitmap = spark.sparkContext.broadcast(fitted.bitmap())

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        pack, chunk = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            for ids, found in chunks(batch, JOINED_BYTES):
                keys = np.unique(np.concatenate(expressions(found)[:2]))
                lead = keys >> np.uint64(64 - ASKED_BITS)
                maybe = (bitmap.value[lead >> np.uint64(6)] >> (lead & np.uint64(63))) & np.uint64(1) == 1
                keys = keys[maybe]
                keys = keys[~handle.value.has(keys)]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as stream:
                    stream.write_batch(batch.slice(at, len(ids)))
                asks = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack(sink.getvalue())], pa.binary()), asks], names=["chunk", "texts", "keys"])
                chunk += 1
                at += len(ids)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                with pa.ipc.open_stream(unpack(batch.column(0)[i].as_py())) as stream:
                    own = stream.read_next_batch()
                met = batch.column(1).slice(i, 1).flatten()
                key, toxic, ordinary = (met.field(c).to_numpy() for c in range(3))
                found = own.column(1).cast(pa.binary()).to_pylist()
                yield out(own, 0, len(found), handle.value.evidence(found, classes(own, 0, len(found)), Model.of(key, toxic, ordinary, totals)))

    at = scratch_path(spark, "evidence")
    for i in range(parts):
        mine = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == i) if parts > 1 else rows
        asks = materialize(mine.mapInArrow(frugal(asked), "chunk long, texts binary, keys array<long>"), "asks")
        met = asks.select("chunk", F.explode("keys").alias("key")).join(rest, "key").groupBy("chunk").agg(F.collect_list(F.struct("key", "toxic", "ordinary")).alias("own"))
        with shuffles_given_back(spark):
            asks.select("chunk", "texts").join(met, "chunk", "left").select("texts", "own").mapInArrow(frugal(joined), schema).write.mode("append").parquet(at)
        discard(asks)
    for used in (handle, bitmap):
        used.unpersist()
    stored = spark.read.schema(schema).parquet(at)
    stored.stored_at = at
    return stored


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, least_share: float | None = None) -> Fitted | None:
    """Models of the labelled rows for which ``training`` (of doc_id) holds, all by default, and their curve."""
    rows = _labelled(docs, labels)
    if training is not None:
        rows = rows.filter(training)
    fitted = fit_counts(rows, least_share)
    if fitted is None:
        return None
    n = rows.count()
    # about as many rows by a hash as the curve takes, then exactly so many
    some = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.1 * CURVE_ROWS / max(1, n)) + 1))
    got = evidence(some, fitted, parts=1).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "unit").limit(CURVE_ROWS).toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        return replace(fitted, curve=_logistic(np.array(got.column("evidence").to_pylist()), y))
    return fitted


def _by_curve(found: DataFrame, fitted: Fitted) -> DataFrame:
    """(doc_id, unit, score) of rows of ``evidence``."""
    value = F.lit(float(fitted.curve[0]))
    for i, weight in enumerate(fitted.curve[1:]):
        value = value + F.lit(float(weight)) * F.col("evidence")[i]
    return found.select("doc_id", "unit", (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), value))))).alias("score"))


def score(docs: DataFrame, fitted: Fitted | None) -> DataFrame:
    """(doc_id, score) of every row."""
    if fitted is None:
        return texts(docs).select("doc_id", F.lit(0.0).alias("score"))
    return _by_curve(evidence(texts(docs).withColumn("toxic", F.lit(None).cast("int")), fitted), fitted).select("doc_id", "score")


def keep_ordinary(docs: DataFrame, fitted: Fitted | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all their columns as they were."""
    if fitted is None:
        return docs
    spark, at = docs.sparkSession, docs.columns.index("text")
    if fitted.joined() is not None:
        unit = free_name(docs, "unit")
        found = evidence(texts(docs).withColumn("toxic", F.lit(None).cast("int")), fitted)
        toxic = materialize(_by_curve(found, fitted).filter(F.col("score") >= threshold).select(F.col("unit").alias(unit)).distinct(), "toxic")
        discard(found)
        own = docs.withColumn(unit, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
        return own.join(F.broadcast(toxic) if toxic.count() <= BROADCAST_IDS else toxic, unit, "left_anti").select(*docs.columns)
    bounded_batches(spark)
    handle, curve = spark.sparkContext.broadcast(fitted.model), fitted.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), pa.array([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())], names=["i", "t"])
            keep = [1 / (1 + np.exp(-np.clip(curve[0] + handle.value.evidence(found) @ curve[1:], -50, 50))) < threshold for _, found in chunks(rows)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(frugal(run), docs.schema)
