"""Collocations against counts of all phrases, and the registered query against SQL."""

import collections
import random
import re

import numpy as np
import pytest

from arborix.llm import collocations, queries
from llm.oracle import same_as_sql

SCHEMA = "doc_id long, text string, lang string, rank long, n long, words string"


def brute(rows, least, longest, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        own = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in own.items():
            if any(len(q) > len(p) and own[q] >= a and inside(p, q) for q in own):
                continue
            score, _, l, r = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, totals[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def draw(n, seed=3):
    r = random.Random(seed)
    words = ["the", "The", "of", "Étude", "étude", "new", "york", "city", "a\xa0b", "x1", "don't", "👍", "of\x1cit"]
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(0, 12)):
            parts.append(r.choice(["New York City hall", "the of the of the of", " ".join(r.choice(words) for _ in range(r.randrange(1, 9))), "e\t\tf  g"]) + r.choice([" ", ". ", ", ", "\n", ";", "\x0b", " ! ", "\r\n"]))
        yield "".join(parts), r.choice(["en", "en", "de", None, ""])


@pytest.mark.parametrize("least, longest, top, hot", [(5, 5, 40, 1 << 20), (3, 5, 2000, 20), (2, 3, 10, 5), (4, 2, 100, 3)])
def test_equals_all_counts(spark, least, longest, top, hot, monkeypatch):
    monkeypatch.setattr(collocations, "GATHER", 500)
    rows = [*draw(250), (None, "en"), ("", "de"), (" ", None), ("only one", "solo"), ("rep eat " * 4000, "en")]
    docs = spark.createDataFrame([(i if i % 7 else None, t, lang, 1, 2, "w") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    got = collocations.collocations(docs, least, longest, top, hot)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, top)


def test_long_texts_are_cut_nowhere(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RUN", 7)
    t = collocations.tokens([b"a b c d e f g h i j k l m, n o p q r s t u v w x y z" * 3], "en")
    full = np.full(1 << (collocations.MAP_BITS - 3), 255, np.uint8)
    maps = collocations.Maps(full, full)
    whole = collocations.pointers_of(t, 0, len(t.hashes), maps, 5)
    parts = np.concatenate([collocations.pointers_of(t, a, b, maps, 5) for a, b in collocations._runs(t)])
    assert (whole == parts).all() and len(whole) == 78 - 2 - 3 - 1


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, 1, ""), (2, " . ", "en", 1, 1, "")], SCHEMA)).count() == 0


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000_000
    row = spark.createDataFrame([(big, big, 10**18, 10**17)], "a long, n long, l long, r long")
    assert row.select(collocations.score("a", "n", "l", "r").alias("s")).first().s == 1000 * big * big // (10**35)


def test_query_matches_sql(spark):
    same_as_sql(spark, "op11_collocations", queries.op11_collocations, queries.oracle_sql())


def test_merging_pointers_copies_only_what_is_left():
    import tracemalloc

    r = np.random.default_rng(1)
    rows, counts = r.integers(1, 9, (200_000, 5)).astype(np.uint64), np.ones(200_000, np.int64)
    tracemalloc.start()
    try:
        left, sums, _ = collocations.merged_pointers(rows, counts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 1.3 * rows.nbytes
    assert sums.sum() == 200_000 and len(left) == len(np.unique(rows, axis=0))
    parts = [(rows[:5], counts[:5]), (rows[5:9], counts[5:9])]
    assert (collocations.gathered(parts)[0] == rows[:9]).all() and not parts
