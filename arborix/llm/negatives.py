"""Hard negatives by one-dimensional distance keys.

Rows have integer vectors; a row's score is its inner product with an anchor. With the further component
``sqrt(M^2 - |v|^2)`` (M^2 the largest squared length; 0 for anchors) all rows have length M, so the squared distance
to an anchor q is ``|q|^2 + M^2 - 2 q.v`` and higher scores are smaller distances. Each row is filed under its nearest
pivot and its distance to it: the index is sorted by (pivot, distance) and stored in shards of consecutive keys. By the
triangle inequality a row within r of an anchor has a key within r of the anchor's own distance to that pivot.

Two searches run over the index, each as a join of blocks of anchors to the shards whose key intervals their radii reach:
first the best rows of the anchor's label (positives), then for each positive the best rows of other labels in its
annulus of scores (negatives). Radii begin with what a bounded sample of the rows shows: as it is part of the rows, its k-th
best bounds theirs. Within a shard, key intervals are scanned outwards from the anchors' keys; each scan brings the radii
in, and it ends when no interval left is within any of them. Results are exact: pivots and sample decide the cost alone.

Anchors are stated rows, held against all rows in blocks. A block takes each shard at most once a search; a task holds one
block and one shard at a time. Partial results are k rows of a shard for each anchor and positive; Spark ranks them.

* Rows without an id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as filled up with zeros.
* Rows that have an anchor's id are never its positives or negatives. Other repeated rows count as often as they occur.
* Ties go by smaller id. An empty table gives an empty result; extra columns are ignored.
* Products must be below 2^62, else an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, frugal, materialize

#: Rows that the pivots and the first radii are fitted on, and pivots, at most: the bounds of what is broadcast.
SAMPLE, PIVOTS = 4096, 64
#: Rows of a shard, of a key interval within it, and anchors of a block, at most; rows scanned between two looks at the radii.
SHARD, INTERVAL, BLOCK, STEP = 16384, 256, 256, 2048
#: Key intervals of shards that are broadcast at most (40 bytes each); above this they are joined by a shuffle.
BROADCAST_RANGES = 200_000
NONE = -(1 << 62)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_SHARD_SCHEMA = "shard long, n int, ids binary, labels binary, vectors binary, ranges array<struct<pivot:int,lo:double,hi:double,n:int>>"


@dataclass(frozen=True)
class Space:
    """What all tasks know: the number of components, M^2, the stored type, pivots (in the space with one component more), the sample."""

    size: int
    longest: int
    kind: str
    pivots: np.ndarray
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]

    @property
    def slack(self) -> float:
        """Above the rounding of any distance."""
        return 1e-6 * self.longest**0.5 + 1e-9

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact products: all partial sums are integers below M^2."""
        kind = np.float32 if self.longest < 1 << 24 else np.float64 if self.longest < 1 << 53 else np.int64
        return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)

    def to_pivots(self, vectors: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Distances of rows (or anchors, whose further component is 0) to the pivots."""
        v = vectors.astype(np.float64)
        own = (v * v).sum(axis=1)
        more = np.zeros(len(v)) if anchors else np.sqrt(np.maximum(0.0, self.longest - own))
        d = (own + more**2)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * (v @ self.pivots[:, :-1].T + more[:, None] * self.pivots[:, -1][None, :])
        return np.sqrt(np.maximum(d, 0.0))

    def radius(self, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distances at which rows have these scores with the anchors; endless for NONE."""
        own = (anchors.astype(np.float64) ** 2).sum(axis=1)
        own = own.reshape(-1, *[1] * (scores.ndim - 1))
        return np.where(scores == NONE, np.inf, np.sqrt(np.maximum(0.0, own + self.longest - 2.0 * scores.astype(np.float64))))


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, v) of the rows that take part, components as ``floor(scale * x)``."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole)
    out = kept.select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    return out.filter("label IS NOT NULL")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    out = np.zeros((len(column), size), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    out[np.arange(size)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def fit_space(rows: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS) -> Space | None:
    """Bounds of all rows, and pivots by means of a bounded sample (the rows of least hashed id); None if there are no rows."""
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    size, longest, most = rows.agg(F.max(F.size("v")), F.max(squares), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if size is None:
        return None
    if longest >= 1 << 62:
        raise ValueError("products of these vectors don't fit into 62 bits")
    drawn = rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(sample).toArrow()
    v = _matrix(drawn["v"].combine_chunks(), size)
    own = v.astype(np.float64)
    full = np.column_stack([own, np.sqrt(np.maximum(0.0, longest - (own**2).sum(axis=1)))])
    centres = full[:pivots].copy()
    for _ in range(4):
        d = (centres**2).sum(axis=1)[None, :] - 2 * full @ centres.T
        near = d.argmin(axis=1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = full[near == k].mean(axis=0)
    kind = "int16" if (most or 0) < 1 << 15 else "int32" if most < 1 << 31 else "int64"
    return Space(size, longest, kind, centres, (drawn["id"].to_numpy(), drawn["label"].to_numpy(), v.astype(kind)))


def _keyed(rows: DataFrame, space: Space) -> DataFrame:
    bounded_batches(rows.sparkSession)
    known = rows.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = known.value
        for b in batches:
            v = _matrix(b.column(2), space.size)
            d = space.to_pivots(v)
            pivot = d.argmin(axis=1) if len(v) else np.empty(0, np.int64)
            packed = [x.tobytes() for x in v.astype(space.kind)]
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(v)), pivot]), b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["pivot", "dist", "id", "label", "v"])

    return rows.select("id", "label", "v").mapInArrow(frugal(run), "pivot int, dist double, id long, label long, v binary")


def shards(rows: DataFrame, space: Space, size: int = SHARD, interval: int = INTERVAL) -> DataFrame:
    """The rows in order of (pivot, distance), ``size`` to a shard, with the key intervals of each: a stored table (_SHARD_SCHEMA)."""
    keyed = _keyed(rows, space).repartitionByRange("pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")

    def packed(part: list[tuple], shard: int) -> tuple:
        pivot, dist, ids, labels = (np.concatenate([x[i] for x in part]) for i in range(4))
        starts = [0]
        for k in [*(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]:
            starts += [*range(starts[-1] + interval, k, interval), k]
        ranges = [{"pivot": int(pivot[a]), "lo": float(dist[a]), "hi": float(dist[b - 1]), "n": b - a} for a, b in zip(starts, starts[1:], strict=False) if b > a]
        return shard, len(ids), ids.tobytes(), labels.tobytes(), b"".join(x for p in part for x in p[4]), ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have, count = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            row = packed(have, at)
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.struct([("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["shard", "n", "ids", "labels", "vectors", "ranges"])

        for b in batches:
            columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] + [b.column(4).to_pylist()]
            start = 0
            while start < len(b):
                stop = min(len(b), start + size - count)
                have.append(tuple(c[start:stop] for c in columns))
                count, start = count + stop - start, stop
                if count == size:
                    yield out()
                    at, have, count = at + 1, [], 0
        if count:
            yield out()

    return materialize(keyed.mapInArrow(frugal(run), _SHARD_SCHEMA), "shards")


def _unpack(row: dict, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["vectors"], space.kind).reshape(len(ids), space.size)


def _best(owner: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's ``k`` best by score, ties by id, in order."""
    order = np.lexsort((ids, -scores, owner))
    own = owner[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


class Annuli:
    """The best ``k`` rows for each (anchor, annulus) of one block: rows of the anchor's label, or of all others, whose
    score is from ``low`` to ``high`` (both anchors x annuli)."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.space, self.ids, self.labels, self.vectors, self.low, self.high, self.k, self.same = space, ids, labels, vectors, low.copy(), high, k, same
        self.found = tuple(np.empty(0, np.int64) for _ in range(3))  # owner (anchor x annulus), score, id
        self.scored = 0

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance at which an anchor still needs rows; (inf, -inf) where it needs none."""
        needs = self.low <= self.high
        outer = np.where(needs, self.space.radius(self.vectors, self.low), -np.inf).max(axis=1)
        inner = np.where(needs, self.space.radius(self.vectors, self.high), np.inf).min(axis=1)
        return inner - self.space.slack, outer + self.space.slack

    def scan(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Take in these rows, then raise each annulus' lower bound to its k-th best score."""
        parts = [self.found]
        width = self.low.shape[1]
        for label in np.unique(self.labels):
            own = np.flatnonzero(self.labels == label)
            rows = np.flatnonzero((labels == label) == self.same)
            if not len(rows):
                continue
            scores = self.space.scores(self.vectors[own], vectors[rows])
            self.scored += scores.size
            a, r = np.nonzero((scores >= self.low[own].min(axis=1)[:, None]) & (scores <= self.high[own].max(axis=1)[:, None]))
            s, a, r = scores[a, r], own[a], rows[r]
            other = ids[r] != self.ids[a]
            s, a, r = s[other], a[other], r[other]
            fit, j = np.nonzero((s[:, None] >= self.low[a]) & (s[:, None] <= self.high[a]))
            parts.append((a[fit] * width + j, s[fit], ids[r[fit]]))
        owner, scores, found = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = _best(owner, scores, found, self.k)
        self.found = owner[keep], scores[keep], found[keep]
        counts = np.bincount(self.found[0], minlength=self.low.size)
        last = np.cumsum(counts) - 1
        full = np.flatnonzero(counts == self.k)
        low = self.low.reshape(-1)
        low[full] = np.maximum(low[full], self.found[1][last[full]])


def _expand(search: Annuli, shard: dict, pivots: np.ndarray, step: int = STEP) -> None:
    """Scan a shard's key intervals from the nearest to the anchors' own keys outwards until none left can matter."""
    ids, labels, vectors = _unpack(shard, search.space)
    ranges = shard["ranges"]
    p, lo, hi, n = (np.array([r[c] for r in ranges]) for c in ("pivot", "lo", "hi", "n"))
    ends = np.cumsum(n)
    near = np.maximum(0.0, np.maximum(lo[None, :] - pivots[:, p], pivots[:, p] - hi[None, :]))
    far = pivots[:, p] + hi[None, :]
    order = near.min(axis=0).argsort(kind="stable")
    at = 0
    while at < len(order):
        inner, outer = search.reach()
        rest = order[at:]
        wanted = ((near[:, rest] <= outer[:, None]) & (far[:, rest] >= inner[:, None])).any(axis=0)
        rest = rest[wanted]
        if not len(rest):
            return
        take = rest[: max(1, int(np.searchsorted(np.cumsum(n[rest]), step)) + 1)]
        rows = np.concatenate([np.arange(ends[i] - n[i], ends[i]) for i in take])
        search.scan(ids[rows], labels[rows], vectors[rows])
        at = int(np.flatnonzero(order == take[-1])[0]) + 1


def _blocks(anchors: DataFrame, space: Space) -> DataFrame:
    """Anchors in blocks, near ones together, as shards are (a stored table; shard is the block's number)."""
    return shards(anchors, space, BLOCK, BLOCK)


def _bounded(blocks: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """Blocks (with ``low`` and ``high``, anchors x annuli as bytes) with radii from the sample, and their reach for each pivot."""
    known = blocks.sparkSession.sparkContext.broadcast(space)
    names = ["block", "ids", "labels", "vectors", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = known.value
        for b in batches:
            rows = []
            for row in b.to_pylist():
                search = _search(row, space, k, same)
                search.scan(*space.sample)
                pivots = space.to_pivots(search.vectors, anchors=True)
                inner, outer = search.reach()
                # a row under pivot p with key x can matter if |d - x| <= outer and d + x >= inner
                least, most = (pivots - outer[:, None]).min(axis=0), (pivots + outer[:, None]).max(axis=0)
                beyond = (inner[:, None] - pivots).min(axis=0)
                reach = [{"pivot": i, "least": float(max(x, z)), "most": float(y)} for i, (x, y, z) in enumerate(zip(least, most, beyond, strict=True)) if y >= max(x, z)]
                rows.append(row | {"low": search.low.tobytes(), "reach": reach})
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.struct([("pivot", pa.int32()), ("least", pa.float64()), ("most", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip([*names, "reach"], kinds, strict=True)], names=[*names, "reach"])

    schema = "block long, ids binary, labels binary, vectors binary, low binary, high binary, reach array<struct<pivot:int,least:double,most:double>>"
    return materialize(blocks.select(*names).mapInArrow(frugal(run), schema), "blocks")


def _search(row: dict, space: Space, k: int, same: bool) -> Annuli:
    ids, labels, vectors = _unpack(row, space)
    low, high = (np.frombuffer(row[c], np.int64).reshape(len(ids), -1) for c in ("low", "high"))
    return Annuli(space, ids, labels, vectors, low, high, k, same)


def _annulus_join(blocks: DataFrame, index: DataFrame, space: Space, k: int, same: bool, scored=None) -> DataFrame:
    """(block, place, anchor_id, annulus, score, id, rank): the best ``k`` rows of the index for each anchor and annulus of the blocks.

    ``scored``, an accumulator, gets the number of products that were computed.
    """
    spark = index.sparkSession
    known = spark.sparkContext.broadcast(space)
    bounded = _bounded(blocks, space, k, same)
    keys = index.select("shard", F.explode("ranges").alias("r")).groupBy("shard", "r.pivot").agg(F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi"))
    few = keys.count() <= BROADCAST_RANGES
    reach = bounded.select("block", F.explode("reach").alias("r")).select("block", "r.*")
    visits = reach.join(F.broadcast(keys) if few else keys, "pivot").filter("hi >= least AND lo <= most").select("block", "shard").distinct()
    pairs = visits.join(bounded.select("block", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vectors", "low", "high")]), "block").join(index, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = known.value
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                search = _search({c: row[f"a_{c}"] for c in ("ids", "labels", "vectors", "low", "high")}, space, k, same)
                _expand(search, row, space.to_pivots(search.vectors, anchors=True))
                if scored is not None:
                    scored.add(int(search.scored))
                owner, scores, found = search.found
                place, annulus = np.divmod(owner, search.low.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(owner), row["block"])), pa.array(place.astype(np.int32)), pa.array(search.ids[place]), pa.array(annulus.astype(np.int32)), pa.array(scores), pa.array(found)], names=["block", "place", "anchor_id", "annulus", "score", "id"])

    found = pairs.mapInArrow(frugal(run), "block long, place int, anchor_id long, annulus int, score long, id long")
    rank = F.row_number().over(Window.partitionBy("block", "place", "annulus").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, floor_percent: int = 80, scored=None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (id, label, v; of ``usable``).

    An anchor's positives are its best other rows of the same label; a positive's negatives are the best rows of other
    labels whose scores are at most the positive's and at least ``floor_percent`` % of it.
    """
    spark = rows.sparkSession
    rows = materialize(rows.select("id", "label", "v"), "vectors")
    space = fit_space(rows)
    if space is None:
        return spark.createDataFrame([], RESULT)
    index = shards(rows, space)
    blocks = _blocks(rows.filter(is_anchor), space).withColumnRenamed("shard", "block")
    eight = lambda value, times: F.unhex(F.repeat(F.lit(int(value).to_bytes(8, "little", signed=True).hex()), times))
    open_ = blocks.withColumns({"low": eight(NONE, F.col("n")), "high": eight(-NONE, F.col("n"))})
    best = materialize(_annulus_join(open_, index, space, positives, True, scored).select("block", "place", F.col("rank").cast("int").alias("of"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each positive's annulus; none where an anchor has fewer positives."""
        for b in batches:
            out = []
            for row in b.to_pylist():
                low, high = np.full((row["n"], positives), -NONE, np.int64), np.full((row["n"], positives), NONE, np.int64)
                for x in row["best"] or ():
                    high[x["place"], x["of"] - 1], low[x["place"], x["of"] - 1] = x["positive_score"], -(-floor_percent * x["positive_score"] // 100)
                out.append((row["block"], row["ids"], row["labels"], row["vectors"], low.tobytes(), high.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.binary()] * 5], strict=True)] if out else [pa.array([], pa.int64()), *[pa.array([], pa.binary())] * 5], names=["block", "ids", "labels", "vectors", "low", "high"])

    gathered = best.groupBy("block").agg(F.collect_list(F.struct("place", "of", "positive_score")).alias("best"))  # of one block of anchors
    bands = blocks.join(gathered, "block", "left").select("block", "n", "ids", "labels", "vectors", "best").mapInArrow(banded, "block long, ids binary, labels binary, vectors binary, low binary, high binary")
    worst = _annulus_join(bands, index, space, negatives, False, scored)
    joined = worst.select("block", "place", (F.col("annulus") + 1).alias("of"), "anchor_id", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["block", "place", "of"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
