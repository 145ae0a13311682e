import random

from pyspark.sql import functions as F

from arborix.operators import classify, traverse
from arborix.operators.fixpoint import settle_by
from arborix.plans import driver_graph as g

from conftest import SMALL


def some_edges(spark, n=30, m=90, seed=3):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    rows, places = [], {}
    for a, b in pairs:
        places[a] = places.get(a, 0) + 1
        rows.append((f"n{a}", "p", False, f"n{b}", places[a]))
    return rows, spark.createDataFrame(rows, "src string, pred string, inverse boolean, dst string, ord long")


def test_f1_paths_to_wanted_nodes_are_the_same_and_all_that_is_kept(spark):
    rows, edges = some_edges(spark)
    seeds = spark.createDataFrame([("n0",), ("n1",)], "node string")
    full = {(r.seed, r.node): tuple(r) for r in traverse.shortest_paths(edges, seeds, per_seed=True).collect()}
    reached = sorted(k for k in full if k[0] != k[1])
    asked = [reached[0], reached[-1], ("n0", "nowhere")]
    wanted = spark.createDataFrame(asked, "seed string, node string")
    some = {(r.seed, r.node): tuple(r) for r in traverse.shortest_paths(edges, seeds, wanted=wanted).collect()}
    need = {(s, s) for s in ("n0", "n1")}
    for key in asked[:2]:
        while key not in need:
            need.add(key)
            key = (key[0], full[key][3])
    assert some == {k: full[k] for k in need} and len(some) < len(full)


def test_f7_ranks_that_outgrow_64_bits_keep_the_order(spark):
    rows, edges = some_edges(spark)
    seeds = spark.createDataFrame([("n0",), ("n1",)], "node string")
    wide = edges.withColumn("ord", F.col("ord") * (1 << 40))
    own = lambda x: {(r.node, r.seed, r.depth, r.parent) for r in traverse.shortest_paths(x, seeds).collect()}
    assert own(wide) == own(edges) and max(r[2] for r in own(edges)) > 2


def test_f4_two_phases_with_decisions_and_gates_of_seeds(spark):
    _, edges = some_edges(spark, seed=5)
    seeds = spark.createDataFrame([("n0",), ("n1",), ("n2",)], "node string")
    nodes = [f"n{i}" for i in range(30)]
    decided = spark.createDataFrame([(x,) for x in nodes if int(x[1:]) % 3], "node string")
    gates = spark.createDataFrame([(s, x, int((int(x[1:]) + i) % 2)) for i, s in enumerate(("n0", "n1", "n2")) for x in nodes], "seed string, node string, target int")
    every = spark.createDataFrame([("p",)], "predicate string")
    got = {tuple(r) for r in traverse.two_phase_bfs(edges, seeds, every, every, decided, gates).collect()}
    out, own, opened = {}, {r[0] for r in decided.collect()}, {(r[0], r[1]) for r in gates.collect() if r[2]}
    for e in edges.collect():
        out.setdefault(e.src, []).append(e.dst)
    want = set()
    for s in ("n0", "n1", "n2"):
        level, met, depth = [s], {s}, 0
        while level:
            depth += 1
            level = sorted({d for x in level if x == s or x not in own or (s, x) in opened for d in out.get(x, [])} - met)
            met |= set(level)
            want |= {(s, x, depth) for x in level if x in own}
    assert got == want


def test_f6_walks_share_edges_and_verdicts_that_lie_by_their_node(spark):
    rows, edges = some_edges(spark)
    links, seeds = traverse.stored_links(edges), spark.createDataFrame([("n0",)], "node string")
    verdicts = spark.createDataFrame([(f"n{i}", "INCLUDE" if i % 4 else "EXCLUDE", 1.0) for i in range(30)], "node string, classification string, confidence double")
    one = classify.TableClassifier(verdicts)
    got = {tuple(r) for r in traverse.gated_nodes(links, seeds, one).collect()}
    want = traverse.gated_bfs(edges, seeds, one, ranked=False).select("node", "depth", "classification", "confidence", "included")
    assert got == {tuple(r) for r in want.collect()} and one.stored().stored().unique
    frontier = settle_by(spark.createDataFrame([("n0",)], "src string"), "src")
    plan = frontier.hint("merge").join(links, "src")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_f11_containments_are_told_apart_by_their_keys(spark):
    plan = g.edges(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_orderkey" in plan
