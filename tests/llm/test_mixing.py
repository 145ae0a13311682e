"""Mixing against sums in exact fractions, and the registered query against SQL."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import pytest

from arborix.llm import mixing, queries
from llm.oracle import same_as_sql

SCHEMA = "doc_id long, text string, source string, copies long, taken string, size int, name string, lang string"


def expected_targets(sizes, weights, share, most):
    """Water is shared out again and again until no source is above its cap."""
    out, left, open_ = {s: Fraction(0) for s in sizes}, Fraction(share) * sum(sizes.values()), set(sizes)
    while open_ and left > 0:
        total = sum(weights[s] for s in open_)
        for s in open_:
            out[s] += left * weights[s] / total
        over = {s for s in open_ if out[s] >= most * sizes[s]}
        left = sum((out[s] - most * sizes[s] for s in over), Fraction(0))
        for s in over:
            out[s] = Fraction(most * sizes[s])
        open_ -= over
    return out


def draw(n, seed=1):
    r = random.Random(seed)
    for i in range(n):
        source = r.choice(["b", "b", "b", "a", "", None, "é", "lone" if i == 0 else "c"])
        yield i, r.choice([None, "", " \t\n", "x\x0by", *[" ".join(["w"] * r.randrange(1, 60))] * 6]), source


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("share, most, weights", [(1.5, 2, (3, 1, 2)), (0.3, 1, (1, 5)), (3.0, 3, (3, 1, 2)), (0.0, 2, (1,))])
def test_targets_and_copies(spark, share, most, weights):
    rows = list(draw(400))
    docs = spark.createDataFrame([(i, t, s, 5, "t", 1, "n", "en") for i, t, s in rows], SCHEMA).repartition(7)
    got = mixing.mix(docs, weights, share, most).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = expected_targets(sizes, {s: weights[k % len(weights)] for k, s in enumerate(order)}, share, most)
    assert len(got) == 400 and {r.doc_id for r in got} == set(range(400))
    taken, by_source = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(aims[r.source]), rel=1e-9)
        assert r.taken == r.copies * r.size and r.copies <= most and r.size == size(rows[r.doc_id][1])
        taken[r.source] += r.taken
        by_source[r.source].append(r)
    for s, own in by_source.items():
        assert abs(taken[s] - aims[s]) <= max(r.size for r in own)
        start = Fraction(int(hashlib.md5(("12|" + ("" if s is None else "=" + s)).encode()).hexdigest()[:9], 16), 1 << 36)
        at, rate = start, aims[s] / sizes[s] if sizes[s] else Fraction(0)
        for r in sorted(own, key=lambda r: (-r.size, r.doc_id)):
            close = abs(at + rate - round(at + rate)) < 1e-6 or abs(at - round(at)) < 1e-6
            assert close or r.copies == int(at + rate) - int(at)
            at += rate
    again = mixing.mix(docs.repartition(2), weights, share, most).collect()
    assert sorted(again) == sorted(got) if not any(r.source is None for r in got) else sorted(map(repr, again)) == sorted(map(repr, got))


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a", 0, "", 0, "", ""), (2, "", None, 0, "", 0, "", "")], SCHEMA)
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    long = spark.createDataFrame([(1, "w " * 300_000, "a", 0, "", 0, "", ""), (None, "one two", "a", 0, "", 0, "", "")] + [(3, "one two", "b", 0, "", 0, "", "")] * 3, SCHEMA)
    got = sorted(((r.doc_id or 0, r.size, r.target, r.taken <= 2 * r.size) for r in mixing.mix(long).collect()))
    assert got == [(0, 2, 450_000.0, True), (1, 300_000, 450_000.0, True)] + [(3, 2, 12.0, True)] * 3


def test_copies_are_emitted(spark):
    rows = [(i, t, s, 5, "t", 1, "n", "en") for i, t, s in draw(150, 3)] + [(7, "same words here", "b", 5, "t", 1, "n", "en"), (7, "same words too", "b", 5, "t", 1, "n", "en"), (None, "x", None, 5, "t", 1, "n", "en")]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs)
    out = mixing.emit(docs, mixed)
    assert out.columns == [*docs.columns, "copy"]
    found = collections.Counter((r.doc_id, r.source, size(r.text)) for r in out.collect())
    wanted = collections.Counter()
    for r in mixed.collect():
        wanted[(r.doc_id, r.source, r.size)] += r.copies
    assert found == +wanted and {r.copies for r in out.collect()} == {5}


def test_query_matches_sql(spark):
    same_as_sql(spark, "op12_mixing", queries.op12_mixing, queries.oracle_sql())
