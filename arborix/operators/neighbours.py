"""Exact nearest neighbours as a join over pivots.

Points are filed under their nearest pivot and sorted by their distance to it, in shards of consecutive distances. The
points that are nearest to each pivot bound a query's k-th distance: a point at t from pivot p is within d(q, p) + t of the query. By
the triangle inequality only shards with distances from d(q, p) - bound to d(q, p) + bound can hold neighbours, so a block of
queries meets those alone, and within a shard the bound comes in as points are found.

What is known everywhere is bounded: the pivots (means of a sample of ``SAMPLE`` points) and k + 1 distances for each.
Queries and points stay in Spark; a task holds one block of queries and one shard at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixpoint import settle

SAMPLE, PIVOTS = 4096, 64
SHARD, STEP = 2048, 256
#: Shards whose intervals are broadcast at most (32 bytes each); above this they are joined by a shuffle.
BROADCAST_SHARDS = 200_000
#: Bytes of one Arrow batch (a pair of a block and a shard is about 1 MB): a worker's memory doesn't grow with the pairs.
BATCH_BYTES = 16 << 20
#: Above the rounding of squared distances, relative to the squares they are taken from.
ROUNDING = 1e-9


def _matrix(lists: list) -> np.ndarray:
    return np.array(lists, np.float64).reshape(len(lists), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T)


def fit_pivots(points: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS) -> np.ndarray:
    """Means of groups of a sample, the points of least hashed id; without points none."""
    drawn = _matrix([r["vector"] for r in points.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()])
    centres = drawn[:pivots].copy()
    for _ in range(4):
        near = _squares(drawn, centres).argmin(axis=1) if len(centres) else np.empty(0, int)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = drawn[near == k].mean(axis=0)
    return centres


def _shards(rows: DataFrame, kind: str, pivots: np.ndarray, size: int) -> DataFrame:
    """(shard, cell, lo, hi, ids, vectors) of rows (id, vector) in order of their cell and distance, ``size`` to a shard at most, stored."""
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(_squares(_matrix(b.column(1).to_pylist()), pivots)) if len(b) else np.empty((0, 1))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), b.column(0), b.column(1)], names=["cell", "dist", "id", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, have, kind = TaskContext.get().partitionId() << 32, None, [], None

        def out() -> pa.RecordBatch:
            dists, ids, vectors = zip(*have, strict=True)
            return pa.RecordBatch.from_pylist([{"shard": number, "cell": cell, "lo": dists[0], "hi": dists[-1], "ids": list(ids), "vectors": _matrix(list(vectors)).tobytes()}], schema=pa.schema([("shard", pa.int64()), ("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.list_(kind)), ("vectors", pa.binary())]))

        for b in batches:
            kind = b.schema.field("id").type
            for c, *row in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if have and (c != cell or len(have) == size):
                    yield out()
                    number, have = number + 1, []
                cell = c
                have.append(row)
        if have:
            yield out()

    filed = rows.select("id", "vector").mapInArrow(file, f"cell int, dist double, id {kind}, vector array<double>")
    return settle(filed.repartitionByRange("cell", "dist", "id").sortWithinPartitions("cell", "dist", "id").mapInArrow(pack, f"shard long, cell int, lo double, hi double, ids array<{kind}>, vectors binary"))


def _bound(to_pivots: np.ndarray, cells: np.ndarray, dists: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each query has ``k`` points; endless if the pivots' nearest points are fewer."""
    upper = to_pivots[:, cells] + dists[None, :]
    return np.partition(upper, k - 1, axis=1)[:, k - 1] * (1 + ROUNDING) if upper.shape[1] >= k else np.full(len(to_pivots), np.inf)


def nearest(queries: DataFrame, points: DataFrame, k: int, block: int = 256, shard: int = SHARD, scored=None) -> DataFrame:
    """(query, id, distance, n): the ``k`` nearest points of each query by Euclidean distance, ties by id.

    ``queries`` (query, vector), ``points`` (id, vector); a point with the query's id isn't its neighbour. ``scored``, an accumulator,
    gets the number of distances computed.
    """
    spark, asked_kind, kind = points.sparkSession, dict(queries.dtypes)["query"], dict(points.dtypes)["id"]
    schema = f"query {asked_kind}, id {kind}, distance double"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    double = lambda c: F.transform(c, lambda x: x.cast("double")).alias("vector")
    points = points.select("id", double("vector"))
    pivots = fit_pivots(points)
    if not len(pivots):
        return spark.createDataFrame([], schema + ", n long")
    index = _shards(points, kind, pivots, shard)
    blocks = _shards(queries.select(F.col("query").alias("id"), double("vector")), asked_kind, pivots, block)
    # k + 1 points nearest to each pivot, as one of them may be the query itself
    place = F.row_number().over(Window.partitionBy("cell").orderBy("lo", "shard"))
    first = index.select("shard", "cell", "lo", "vectors").withColumn("place", place).filter(F.col("place") <= k + 1)
    width = pivots.shape[1]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cell, vectors in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(vectors).reshape(-1, width)[: k + 1]
                rows += [(cell, d) for d in np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)).tolist()]
            yield pa.RecordBatch.from_pylist([{"cell": c, "dist": d} for c, d in rows], schema=pa.schema([("cell", pa.int32()), ("dist", pa.float64())]))

    near = first.select("cell", "vectors").mapInArrow(close, "cell int, dist double").withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("dist"))).filter(F.col("place") <= k + 1).select("cell", "dist").collect()  # PIVOTS x (k + 1) numbers
    cells, dists = np.array([r[0] for r in near]), np.array([r[1] for r in near])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for number, vectors in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to_pivots = np.sqrt(_squares(np.frombuffer(vectors).reshape(-1, width), pivots))
                bound = _bound(to_pivots, cells, dists, k + 1)
                slack = ROUNDING * (1 + to_pivots.max())
                out += [{"block": number, "cell": c, "least": float((to_pivots[:, c] - bound).min() - slack), "most": float((to_pivots[:, c] + bound).max() + slack)} for c in range(len(pivots))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("least", pa.float64()), ("most", pa.float64())]))

    spans = index.select("shard", "cell", "lo", "hi")
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_SHARDS else spans
    visits = blocks.select("shard", "vectors").mapInArrow(reach, "block long, cell int, least double, most double").join(spans, "cell").filter("hi >= least AND lo <= most").select("block", "shard")
    pairs = visits.join(blocks.select(F.col("shard").alias("block"), F.col("ids").alias("queries"), F.col("vectors").alias("asked")), "block").join(index.select("shard", "cell", "ids", "vectors"), "shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                own, x = row["ids"], np.frombuffer(row["vectors"]).reshape(-1, width)
                q = np.frombuffer(row["asked"]).reshape(-1, width)
                to_pivots = np.sqrt(_squares(q, pivots))
                bound = _bound(to_pivots, cells, dists, k + 1)
                keys, d = np.sqrt(((x - pivots[row["cell"]]) ** 2).sum(axis=1)), to_pivots[:, row["cell"]]
                slack = ROUNDING * (1 + to_pivots.max() + keys.max())
                best: list[list[tuple]] = [[] for _ in q]
                # stretches of the shard from the queries' own distances outwards
                stretches = sorted(range(0, len(x), STEP), key=lambda a: max(0.0, keys[a] - d.max(), d.min() - keys[min(len(x), a + STEP) - 1]))
                for a in stretches:
                    z = min(len(x), a + STEP)
                    live = np.flatnonzero((keys[a] - d <= bound + slack) & (d - keys[z - 1] <= bound + slack))
                    if not len(live):
                        continue
                    squares = _squares(q[live], x[a:z])
                    if scored is not None:
                        scored.add(squares.size)
                    limit = (bound[live] + slack) ** 2 + ROUNDING * ((q[live] ** 2).sum(axis=1) + (x[a:z] ** 2).sum(axis=1).max())
                    who, which = np.nonzero(squares <= limit[:, None])
                    exact = np.sqrt(((q[live[who]] - x[a + which]) ** 2).sum(axis=1))
                    for w, p, e in zip(live[who].tolist(), (a + which).tolist(), exact.tolist(), strict=True):
                        if own[p] != row["queries"][w]:
                            best[w].append((e, own[p]))
                    for w in np.unique(live[who]).tolist():
                        best[w] = sorted(best[w])[:k]
                        if len(best[w]) == k:
                            bound[w] = min(bound[w], best[w][-1][0])
                found = [(row["queries"][w], p, e) for w, rows in enumerate(best) for e, p in rows]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((b.schema.field("queries").type.value_type, b.schema.field("ids").type.value_type, pa.float64()))], names=["query", "id", "distance"])

    found = pairs.select("queries", "asked", "cell", "ids", "vectors").mapInArrow(search, schema)
    n = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("n", n.cast("long")).filter(F.col("n") <= k)
