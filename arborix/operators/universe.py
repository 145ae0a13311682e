"""Candidate universes from retained runs, and rows of branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def observed_universe(runs: DataFrame, gold: DataFrame, excluded: DataFrame, seeds: DataFrame, roots: DataFrame) -> DataFrame:
    """(branch, node, label, scored, seed) of all candidates of each branch.

    ``runs``: (branch, run, node, in_gold) of what every retained run visited; a node whose label differs from the gold's
    is an error when it is read. Scored are gold and visited nodes, without excluded ones and hidden roots; excluded nodes
    and seeds are candidates too, but roots are not.
    """
    of = lambda df, name: df.select("branch", "node").distinct().withColumn(name, F.lit(True))
    seen = runs.groupBy("branch", "node").agg(F.min("in_gold").alias("low"), F.max("in_gold").alias("high"))
    every = seen.join(of(gold, "gold"), ["branch", "node"], "full_outer").join(of(excluded, "excluded"), ["branch", "node"], "full_outer").join(of(seeds, "seed"), ["branch", "node"], "full_outer")
    every = every.join(roots.select("node").distinct(), "node", "left_anti")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    disagrees = F.col("low").isNotNull() & ((F.col("low") != is_("gold")) | (F.col("high") != is_("gold")))
    checked = every.filter(F.when(disagrees, F.raise_error(F.concat(F.lit("a retained label disagrees with the gold: "), "branch", F.lit(" "), "node")).cast("boolean")).otherwise(True))
    scored = (is_("gold") | F.col("low").isNotNull()) & ~is_("excluded")
    return checked.select("branch", "node", is_("gold").cast("int").alias("label"), scored.alias("scored"), is_("seed").alias("seed"))


def branch_rows(rows: DataFrame, branches: list[str], supervised: bool = False) -> DataFrame:
    """Rows of the branches that have a path and aren't seeds; only scored ones if ``supervised``."""
    own = rows.filter(F.col("branch").isin(*branches) & (F.size("path") > 0) & ~F.col("seed"))
    return own.filter("scored") if supervised else own


def mean_scores(passes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, passes): the mean of a candidate's scores over all passes of a model and all its references."""
    return passes.groupBy(*keys).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("passes"))
