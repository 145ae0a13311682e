"""Neighbours, draws and edge splits against plain Python."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.operators import sampling


@pytest.mark.parametrize("kind", ["clusters", "even", "ties", "few"])
def test_neighbours_are_exact(spark, kind):
    r = np.random.default_rng(3)
    n = 4 if kind == "few" else 1200
    centres = r.normal(size=(40, 6)) * 20
    x = [(centres[i % 40] + r.normal(size=6) * 0.2 if kind == "clusters" else np.round(r.normal(size=6)) if kind == "ties" else r.normal(size=6)) for i in range(n)]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    counted = spark.sparkContext.accumulator(0)
    asked = points.filter("id % 10 = 0").select(F.col("id").alias("query"), "vector")
    got = sampling.nearest(asked, points, 5, block=16, shard=32, scored=counted).collect()
    found = collections.defaultdict(list)
    for row in sorted(got, key=lambda row: (row.query, row.n)):
        found[row.query].append(row.id)
    every = np.stack(x)
    for q in range(0, n, 10):
        d = np.sqrt(((every - every[q]) ** 2).sum(axis=1))
        assert found[q] == [i for _, i in sorted(zip(d.tolist(), range(n))) if i != q][:5]
    if kind == "clusters":
        assert counted.value < n * (n // 10) / 5
    names = points.select(F.concat(F.lit("p"), "id").alias("id"), "vector")
    assert sampling.nearest(names.limit(1).withColumnRenamed("id", "query"), names, 2).count() == 2


def test_draws_are_a_permutation_and_admissible(spark):
    places = spark.range(256).select(sampling.permuted(F.col("id"), F.lit(4), F.lit(42), F.lit("q")).alias("x"))
    assert sorted(r.x for r in places.collect()) == list(range(256))
    pool = [(i, "big" if i < 300 else "one" if i == 300 else "small", i % 3) for i in range(310)]
    pooled = spark.createDataFrame(pool, "reference long, group string, seed int")
    asked = spark.createDataFrame([(i, g, s) for i, g, s in pool if i % 2 == 0] + [(999, "none", 1)], "query long, group string, seed int")
    group, seeds = {i: g for i, g, _ in pool}, {i: s for i, _, s in pool}
    for other in (False, True):
        got = collections.defaultdict(list)
        for r in sampling.references(asked, pooled, 4, other_seed=other).collect():
            got[r.query].append(r)
        for q in range(0, 310, 2):
            able = {i for i in group if group[i] == group[q] and i != q and (not other or seeds[i] != seeds[q])}
            mine = [r.reference for r in got[q]]
            assert set(mine) <= able and len(set(mine)) == len(mine) == min(4, len(able)) and {r.n for r in got[q]} == set(range(1, len(mine) + 1))
        assert 999 not in got
        drawn = collections.Counter(r.reference for rows in got.values() for r in rows)
        assert max(drawn[i] for i in range(300)) < 12  # 150 queries draw 600 of 300 rows
    assert sampling.references(asked.limit(0), pooled, 4).count() == 0 and sampling.references(asked, pooled.limit(0), 4).count() == 0


@pytest.mark.parametrize("seed, fraction", [(1, 0.3), (2, 1.0), (3, 0.0), (4, 0.9)])
def test_edge_split_is_the_greedy_pass(spark, seed, fraction):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    edges = [(r.choice(names), r.choice("pq"), r.choice(names)) for _ in range(90)] + [("hub", "p", x) for x in names] + [("x1", "p", "x2"), ("x2", "q", "x1"), ("y", "p", "y")] + [(f"c{i}", "p", f"c{i + 1}") for i in range(30)]
    pairs = sorted({tuple(sorted((a, b))) for a, _, b in edges}, key=lambda p: (hashlib.md5(f"{seed}|{p[0]}~{p[1]}".encode()).hexdigest(), p))
    degrees = collections.Counter(x for p in pairs for x in set(p))
    held, target = set(), round(len(pairs) * fraction)
    for p in pairs:
        if len(held) < target and all(degrees[x] > 1 for x in set(p)):
            held.add(p)
            degrees.subtract(set(p))
    got = sampling.split_edges(spark.createDataFrame(edges, "src string, pred string, dst string"), fraction, seed).collect()
    assert len(got) == len(edges) and all(x.held_out == (tuple(sorted((x.src, x.dst))) in held) for x in got)


def test_pairs_of_blocks_and_shards_come_in_bounded_batches(spark):
    from arborix.operators import neighbours

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    points = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(60)], "id long, vector array<double>")
    assert neighbours.nearest(points.selectExpr("id AS query", "vector"), points, 2).count() == 120
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == neighbours.BATCH_BYTES
