"""Traversals against walks in plain Python: order of competing paths, depth, many seeds."""

import random
from collections import deque

from pyspark.sql import functions as F

from arborix.operators import classify, traverse
from arborix.plans import driver_graph as g


def test_paths_go_by_their_words(spark):
    labels = {"s": "Seed", "t": "Apple", "a": "New", "b": "New York", "c": "New !", "d": "Z", "e": "end", "n/f": None}
    edges = [("s", "p", "a"), ("s", "p", "b"), ("s", "p", "c"), ("a", "q", "d"), ("b", "q", "d"), ("c", "q", "d"), ("t", "z", "d"), ("t", "p", "b"), ("d", "q", "e"), ("b", "a", "e"), ("c", "r", "n/f"), ("a", "r", "n/f"), ("e", "p", "s")]
    frame = spark.createDataFrame([(*x, False) for x in edges], "src string, pred string, dst string, inverse boolean")
    named = spark.createDataFrame([x for x in labels.items() if x[1]], "node string, label string")
    every = classify.PythonClassifier(lambda asked: [("EXCLUDE" if x == "e" else "INCLUDE", 1.0) for x in asked], evidence="node")
    seeds = spark.createDataFrame([("s",), ("t",)], "node string")
    found = traverse.with_paths(traverse.gated_bfs(frame, seeds, every, labels=named), named)
    got = {r.node: (r.seed, r.depth, r.path) for r in found.collect()}
    # d is one step from t; b two ways, of the lesser seed; " !" comes before " --" and that before " Y"
    assert got == {"s": ("s", 0, "(seed node)"), "t": ("t", 0, "(seed node)"), "a": ("s", 1, "Seed --p--> New"), "b": ("s", 1, "Seed --p--> New York"), "c": ("s", 1, "Seed --p--> New !"), "d": ("t", 1, "Apple --z--> Z"), "e": ("s", 2, "Seed --p--> New York --a--> end"), "n/f": ("s", 2, "Seed --p--> New ! --r--> f")}


def test_paths_on_random_graphs(spark):
    r = random.Random(7)
    names = [f"n{i}" for i in range(60)]
    labels = {x: r.choice(["New", "New York", "New !", "a", "a b", "é", "Z"]) for x in names}
    edges = sorted({(r.choice(names), r.choice("pq"), r.choice(names)) for _ in range(170)})
    keep = {x: r.random() < 0.8 for x in names}
    seeds = ["n3", "n1"]
    best = {x: (x, 0, "(seed node)", labels[x]) for x in seeds}
    level = dict(best)
    while level:
        after = {}
        for x, (seed, depth, _, text) in level.items():
            if depth and not keep[x]:
                continue
            for a, p, b in edges:
                if a == x and b not in best:
                    way = (seed, depth + 1, f"{text} --{p}--> {labels[b]}")
                    if b not in after or (way[0], way[2]) < (after[b][0], after[b][2]):
                        after[b] = (*way, way[2])
        best |= after
        level = after
    frame = spark.createDataFrame([(*x, False) for x in edges], "src string, pred string, dst string, inverse boolean")
    named = spark.createDataFrame(list(labels.items()), "node string, label string")
    verdicts = spark.createDataFrame([(x, "INCLUDE" if k else "EXCLUDE", 1.0) for x, k in keep.items()], "node string, classification string, confidence double")
    found = traverse.gated_bfs(frame, spark.createDataFrame([(x,) for x in seeds], "node string"), classify.TableClassifier(verdicts), labels=named)
    assert not any(kind.startswith("array") for _, kind in found.dtypes)
    assert {x.node: (x.seed, x.depth, x.path) for x in traverse.with_paths(found, named).collect()} == {k: v[:3] for k, v in best.items()}


def test_a_chain_deeper_than_twenty(spark):
    edges = spark.createDataFrame([(f"c{i}", "p", False, f"c{i + 1}", 1) for i in range(30)], "src string, pred string, inverse boolean, dst string, ord int")
    seeds = spark.createDataFrame([("c0",)], "node string")
    found = {r.node: (r.depth, r.path) for r in traverse.with_paths(traverse.shortest_paths(edges, seeds)).collect()}
    assert len(found) == 31 and found["c30"] == (30, "c0" + "".join(f" --p--> c{i}" for i in range(1, 31)))
    assert traverse.shortest_paths(edges, seeds, 20).count() == 21


def test_reachability_of_many_seeds(spark):
    r = random.Random(11)
    names = [f"n{i}" for i in range(150)]
    edges = [(r.choice(names), r.choice(names)) for _ in range(260)]
    seeds, expected = names[:130], set()  # three chunks of bits
    for s in seeds:
        seen, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for a, b in edges:
                if a == x and b not in seen and b != "n140":
                    seen[b] = seen[x] + 1
                    queue.append(b)
        expected |= {(s, n, d) for n, d in seen.items()}
    frame = spark.createDataFrame(edges, "src string, dst string")
    got = traverse.reachable(frame, spark.createDataFrame([(s,) for s in seeds], "node string"), masked=spark.createDataFrame([("n140",)], "node string"))
    assert set(map(tuple, got.collect())) == expected and got.count() == len(expected)


def test_bridges_of_many_seeds(spark):
    r = random.Random(2)
    names = [f"n{i}" for i in range(90)]
    edges = [(r.choice(names), r.choice(names)) for _ in range(200)]
    seeds = names[:70]
    decided = {(s, n) for s in seeds for n in names if r.random() < 0.4}
    keep = {n: r.random() < 0.6 for n in names}
    expected = set()
    for s in seeds:
        met, frontier, depth = {s}, [s], 0
        while frontier:
            depth, wave, found = depth + 1, frontier, []
            while wave:
                near = {b for a, b in edges if a in wave} - met
                met |= near
                found += [n for n in near if (s, n) in decided]
                wave = [n for n in near if (s, n) not in decided]
            expected |= {(s, n, depth, keep[n]) for n in found}
            frontier = [n for n in found if keep[n]]
    frame = spark.createDataFrame(edges, "src string, dst string")
    verdicts = spark.createDataFrame([(n, "INCLUDE" if k else "EXCLUDE", 1.0) for n, k in keep.items()], "node string, classification string, confidence double")
    got = traverse.bridge_bfs(frame, spark.createDataFrame([(s,) for s in seeds], "node string"), spark.createDataFrame(sorted(decided), "seed string, node string"), classify.TableClassifier(verdicts))
    assert {(x.seed, x.node, x.depth, x.included) for x in got.collect()} == expected


def test_the_last_writer_stays(spark):
    pairs = spark.createDataFrame([("s", "x", ["r0"]), ("s", "b", ["r1"]), ("s", "a", ["r2"]), ("a", "y", ["from a"]), ("b", "y", ["from b"]), ("x", "y", ["from x"]), ("y", "s", ["back"]), ("t", "x", ["from t"]), ("y", "a", ["back"])], "src string, dst string, relations array<string>")
    labels = spark.createDataFrame([("a", "Zeta"), ("b", "alpha"), ("x", "zzz")], "node string, label string")
    seeds = spark.createDataFrame([("t", 0), ("s", 1)], "node string, place long")
    verdicts = spark.createDataFrame([("a", "INCLUDE", 1.0), ("b", "INCLUDE", 1.0), ("x", "EXCLUDE", 1.0), ("y", "EXCLUDE", 1.0)], "node string, classification string, confidence double")
    got = {r.node: (r.depth, r.parent, r.relations) for r in traverse.thesaurus_bfs(pairs, seeds, labels, classify.TableClassifier(verdicts)).collect()}
    assert got == {"t": (0, None, None), "s": (0, None, None), "x": (1, "s", ["r0"]), "a": (1, "s", ["r2"]), "b": (1, "s", ["r1"]), "y": (2, "a", ["from a"])}
    assert traverse.thesaurus_bfs(pairs, seeds, labels, classify.TableClassifier(verdicts), 1).count() == 5


def test_last_writers_of_numbered_nodes(spark):
    """Repeated links of numbers: names decide the order (order/9 after order/10), and the links are read once."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    n = lambda kind, key: key * 8 + g.KINDS.index(kind)
    rows = [(n("customer", 1), n("order", k)) for k in (9, 10, 11)] + [(n("order", k), n("part", p)) for k, p in ((9, 1), (10, 1), (11, 1), (10, 2), (11, 2))]
    links = spark.createDataFrame((rows + [(b, a) for a, b in rows]) * 2, "src long, dst long").mapInPandas(counted, "src long, dst long")
    labels = spark.createDataFrame([(n("part", 1), "x"), (n("customer", 1), "c")], "node long, label string")
    verdicts = spark.createDataFrame([(n("order", k), "INCLUDE", 1.0) for k in (9, 10)] + [(n("order", 11), "EXCLUDE", 1.0)], "node long, classification string, confidence double")
    seeds = spark.createDataFrame([(n("customer", 1), 0)], "node long, place long")
    found = traverse.last_writers(links, seeds, labels, classify.TableClassifier(verdicts), name=g.name_of)
    named = found.select(g.name_of(F.col("node")).alias("node"), "depth", g.name_of(F.col("parent")).alias("parent"), g.relation_of(F.col("parent"), F.col("node")).alias("relation"))
    assert {tuple(r) for r in named.collect()} == {("customer/1", 0, None, None), *((f"order/{k}", 1, "customer/1", "placed") for k in (9, 10, 11)), ("part/1", 2, "order/9", "contains"), ("part/2", 2, "order/10", "contains")}
    assert read.value == 4 * len(rows)
    keys = spark.createDataFrame([(k,) for k in (-9, -1, 0, 7, 1 << 40)], "k long")
    for kind in g.KINDS:
        assert all(r.a == r.b for r in keys.select(g.name_of(g.number(kind, "k")).alias("a"), g.node(kind, "k").alias("b")).collect())
    seen = g.edges(spark, "/root/testdata/sf0.001", g.number).select("pred", g.relation_of(F.col("dst"), F.col("src")).alias("relation"))
    assert seen.filter("relation IS NULL OR relation <> pred").isEmpty() and {r.pred for r in seen.select("pred").distinct().collect()} == set(g.RELATIONS.values())


def test_order_statistics(spark):
    import statistics

    from arborix.operators import metrics

    r = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 7}", r.choice([None, *map(float, range(40))])) for i in range(3000)] + [(None, 1.0), (None, 2.0), ("blank", None)]
    got = {x.kind: (x.median, x.p95) for x in metrics.order_statistics(spark.createDataFrame(rows, "kind string, seconds double").repartition(5), ["kind"], "seconds").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: (statistics.median(v), sorted(v)[-(-95 * len(v) // 100) - 1]) for k, v in groups.items()}


def test_wanted_paths_of_numbered_nodes(spark):
    """Paths to wanted nodes, from more than 64 seeds, are a queue's; nulls and repeated edges change nothing."""
    from arborix.operators import context, graph

    r = random.Random(7)
    number = lambda k: k * 8 + k % len(g.KINDS)
    name = {number(k): f"{g.KINDS[k % len(g.KINDS)]}/{k}" for k in range(120)}
    label = {n: r.choice(["Beta", "alpha", "GAMMA", "éa"]) for n in name if r.random() < 0.6}
    edges = sorted({(r.choice(list(name)), r.choice("pq"), r.choice(list(name))) for _ in range(220)})
    near = {}
    for a, p, b in edges:
        near.setdefault(a, set()).add((b, p, False))
        near.setdefault(b, set()).add((a, p, True))
    order = lambda x: (x[0] in label, label.get(x[0], "").casefold(), name[x[0]], x[1], x[2])
    seeds, expected = list(name)[:80], {}
    for s in seeds:
        seen, queue = {s: (0, None, "", name[s] if s not in label else label[s])}, deque([s])
        while queue:
            x = queue.popleft()
            for b, p, back in sorted(near.get(x, ()), key=order):
                if b not in seen:
                    word = f"reverse {p}" if back else p
                    seen[b] = (seen[x][0] + 1, x, f"{'(-)' if back else ''}{p}", f"{seen[x][3]} --{word}--> {label.get(b, name[b])}")
                    queue.append(b)
        expected[s] = seen
    asked = [(f"r{i}", r.choice(seeds), r.choice(list(name)), 99) for i in range(150)] + [("null", seeds[0], None, 99), ("absent", seeds[0], 9999 * 8, 99)]
    rows = spark.createDataFrame(asked, "row_id string, seed long, node long, csv_depth int")
    labels = spark.createDataFrame(list(label.items()), "node long, label string")
    frame = spark.createDataFrame(edges + edges[:40] + [(None, "p", number(1))], "src long, pred string, dst long")
    found = context.graph_context(rows, graph.numbered_adjacency(frame, labels, g.name_of), labels, {}, {}, g.name_of)
    got = {x.row_id: (x.depth, x.parent, x.reaching_property, x.path) for x in found.collect()}
    for i, s, n, _ in asked:
        depth, parent, prop, path = expected[s].get(n, (0, None, "", ""))
        assert got[i] == ((depth, name[parent], prop, path) if depth else (99, "", "", "")), i


def test_steps_are_those_of_shortest_ways(spark):
    """From a hub with many neighbours only the steps to what is wanted are kept, and waves end with the last that is wanted."""
    edges = [("s", "hub", 1)] + [("hub", f"n{i}", i) for i in range(500)] + [(f"n{i}", "far", 1) for i in range(500)] + [("far", "further", 1)]
    links = spark.createDataFrame(edges, "src string, dst string, ord long")
    links = traverse.settle_by(links, "src")
    numbers, roots = traverse._numbered(spark.createDataFrame([("s", "s")], "seed string, node string"))
    wanted = traverse.settle(traverse._packed(spark.createDataFrame([("s", "n3")], "seed string, node string"), numbers))
    levels = traverse._waves(links, roots, None, wanted)
    steps = traverse._towards(links, levels, wanted)
    assert len(levels) == 3 and [{(x.src, x.dst) for x in s.collect()} for s in steps] == [{("s", "hub")}, {("hub", "n3")}]
