"""A dataset's snapshot: from seeds, gold decisions and claims to the subgraph that the seeds reach, and a report on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.operators import graph, traverse
from arborix.operators.fixpoint import settle


def snapshot(seeds: DataFrame, decisions: DataFrame, claims: DataFrame, labels: DataFrame, entities: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The tables of a snapshot; ``stats`` is one row of counts.

    ``seeds`` (node), ``decisions`` (seed, node, …), ``claims`` (src, pred, dst), ``labels`` (node, label), ``entities`` (node: what was found at
    the date), ``relations`` (predicate, inverse: what is followed from an entity, and backwards). Only seeds and decided nodes
    are expected; edges stay among those, and of those only what the seeds reach is kept. Decided nodes that aren't reached are
    reported with the neighbours beyond the dataset over which they might be.
    """
    wanted = seeds.select("node").unionByName(decisions.select("node")).distinct()
    expected = settle(wanted.join(entities.select("node").distinct().withColumn("found", F.lit(True)), "node", "left").withColumn("found", F.coalesce("found", F.lit(False))))
    ends = lambda c: expected.select(F.col("node").alias(c))
    found = expected.filter("found").select(F.col("node").alias("src"))
    inner = claims.select("src", "pred", "dst").join(found, "src", "left_semi").join(ends("dst"), "dst", "left_semi").distinct()
    ways = inner.join(relations.select(F.col("predicate").alias("pred"), "inverse").distinct(), "pred")
    back = F.col("inverse")
    logical = settle(ways.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(back, F.concat(F.lit("(-)"), "pred")).otherwise(F.col("pred")).alias("pred"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct())
    triples = settle(graph.canonical(logical))
    start = seeds.select(F.lit("all").alias("seed"), "node").distinct()
    reached = settle(traverse.reachable(logical, start).select("node").distinct())
    at = lambda c: reached.select(F.col("node").alias(c))
    kept = settle(triples.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi").select("src", "pred", "dst"))
    gold = decisions.select("node").distinct().join(seeds.select("node"), "node", "left_anti")
    unreached = settle(gold.join(reached, "node", "left_anti"))
    bridges = settle(graph.bridge_candidates(unreached, claims.join(relations.select(F.col("predicate").alias("pred")).distinct(), "pred", "left_semi"), expected.select("node")))
    nodes = settle(kept.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(labels.select("node", "label").dropDuplicates(["node"]), "node", "left"))
    members = decisions.select("seed", "node").distinct().unionByName(seeds.select(F.col("node").alias("seed"), "node")).distinct().withColumn("depth", F.lit(None).cast("long"))
    judged = decisions.join(unreached.withColumn("_lost", F.lit(True)), "node", "left").withColumn("reachable", F.col("_lost").isNull()).drop("_lost")
    count = lambda df, name, c="*": df.agg(F.count(F.lit(1) if c == "*" else c).alias(name))
    rows = [count(seeds.distinct(), "seeds"), count(decisions, "decisions"), count(expected, "expected"), expected.agg(F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing")), count(logical, "logical_edges"), count(triples, "triples"), count(kept, "kept_triples"), nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count("label").alias("labelled")), count(gold, "gold"), count(unreached, "unreachable"), count(bridges, "bridge_cases")]
    stats = rows[0]
    for r in rows[1:]:  # one row each
        stats = stats.join(r, how="cross")
    return {"expected": expected, "logical": logical, "triples": triples, "kept": kept, "nodes": nodes, "unreachable": unreached, "bridges": bridges, "per_seed": graph.per_seed_subgraphs(kept, members), "decisions": judged, "stats": stats}
