"""Hard negatives against all products, and the registered query against SQL."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.llm import negatives, queries
from llm.oracle import same_as_sql

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, shard string, v int"


def brute(rows, anchors, k=5, m=5, percent=80):
    found = []
    for a, la, va in rows:
        if a not in anchors:
            continue
        scored = sorted((-int(np.dot(va.astype(object), v.astype(object))), i, label) for i, label, v in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:k]:
            own = [x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s][:m]
            found += [(a, p, n + 1, i, -s, -x) for n, (x, i, _) in enumerate(own)]
    return sorted(found)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "s", 2) for i, v, label in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("kind", ["clusters", "even", "large", "ties"])
def test_equals_all_products(spark, kind, monkeypatch):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8)) * 4
    rows = []
    for i in range(1500):
        v = centres[i % 12] + r.normal(size=8) * 0.1 if kind == "clusters" else np.round(r.normal(size=8)) if kind == "ties" else r.normal(size=8) * (5000 if kind == "large" else 1)
        rows.append((i, v.astype(np.float32).tolist(), int(r.integers(0, 3)) if kind != "clusters" else int(i % 12 // 4) if r.random() < 0.7 else 2))
    monkeypatch.setattr(negatives.shards, "__defaults__", (100, 16))  # many shards and intervals
    counted = spark.sparkContext.accumulator(0)
    used = negatives.usable(table(spark, rows))
    got = negatives.hard_negatives(used, F.col("id") % 50 == 0, scored=counted)
    whole = [(i, label, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v, label in rows]
    assert sorted(map(tuple, got.collect())) == brute(whole, set(range(0, 1500, 50)))
    if kind == "clusters":
        assert counted.value < 30 * 1500 * 2 / 3  # intervals out of reach aren't scored


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(0, None, 1), (100, [1.0, nan], 1), (200, [inf, 1.0], 1), (300, [1.0, None], 1), (400, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    good = [(500, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 1.0], 2), (2, [0.5, 1.0], 2), (500, [2.0, 2.0], 2), (3, [1.0], 2), (4, [], 2), (600, [-1.0, -1.0], 3), (5, [0.2, 0.0], 3)]
    got = negatives.hard_negatives(negatives.usable(table(spark, bad + good)), F.col("id") % 100 == 0).collect()
    rows = collections.Counter(map(tuple, got))
    # 500 (label 1) has the one positive 1 with 1.5; of others 2 twice with as many, 3 has 1.0, below 80 %
    # the second row of 500 (label 2) has 2 twice as a positive, each with 1; 600 has 5 alone, with a score below 0
    assert rows == {(500, 1, 1, 2, 98304, 98304): 1, (500, 1, 2, 2, 98304, 98304): 1, (500, 2, 1, 1, 196608, 196608): 2}
    assert negatives.hard_negatives(negatives.usable(table(spark, bad)), F.col("id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(negatives.usable(table(spark, [])), F.col("id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(negatives.usable(table(spark, good[1:4])), F.col("id") % 100 == 0).count() == 0


def test_vectors_without_components(spark):
    rows = [(100, [], 1), (1, [], 1), (2, [], 2), (3, [], 2)]  # all products are 0, and 80 % of 0 is 0
    got = negatives.hard_negatives(negatives.usable(table(spark, rows)), F.col("id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == [(100, 1, 1, 2, 0, 0), (100, 1, 2, 3, 0, 0)]


def test_query_matches_sql(spark):
    same_as_sql(spark, "op13_hard_negatives", queries.op13_hard_negatives, queries.oracle_sql())
