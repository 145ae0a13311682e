"""Decision rows in their graph: context by an ungated traversal, evidence lines, demonstrations, example packs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import EXCLUDE, INCLUDE
from .fixpoint import settle
from .relational import absent
from .traverse import shortest_paths, with_paths

LEVELS = ("labels", "depth", "property", "path", "path_simple")
#: Names of properties, and of some of them when followed backwards.
PROPERTY_NAMES = {
    "P31": "instance of",
    "P279": "subclass of",
    "P22": "father",
    "P25": "mother",
    "P26": "spouse",
    "P40": "child",
    "P106": "occupation",
    "P127": "owned by",
    "P921": "main subject",
    "P1343": "described by source",
    "P1830": "owner of",
    "P1840": "investigation of",
    "P3342": "significant person",
    "P5008": "on focus list of Wikimedia project",
}
INVERSE_NAMES = {"P31": "has instance", "P279": "has subclass", "P127": "owner of", "P1830": "owned by"}


def property_name(pred: Column, inverse: Column, names: dict[str, str] = PROPERTY_NAMES, inverse_names: dict[str, str] = INVERSE_NAMES) -> Column:
    """The name of a property as it was followed; of an inverse without a name of its own "reverse" and the name."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    plain = F.coalesce(table(names)[pred] if names else F.lit(None).cast("string"), pred)
    back = table(inverse_names)[pred] if inverse_names else F.lit(None).cast("string")
    return F.when(inverse, F.coalesce(back, F.concat(F.lit("reverse "), plain))).otherwise(plain)


def graph_context(rows: DataFrame, edges: DataFrame, labels: DataFrame, names: dict[str, str] = PROPERTY_NAMES, inverse_names: dict[str, str] = INVERSE_NAMES, unlabelled: Callable[[Column], Column] = lambda node: node) -> DataFrame:
    """``rows`` (row_id, seed, node, csv_depth) with depth, reaching property and its name, parent, its label, and the path.

    From each seed an ungated traversal in the edges' order (``ord``), which keeps the paths to the rows' nodes. A row that it doesn't reach keeps ``csv_depth``, and
    the other columns are empty. A node without a label goes by its own name, which ``unlabelled`` makes where nodes are numbers.
    """
    name = lambda pred, inverse: property_name(pred, inverse, names, inverse_names)
    asked = settle(rows.select("seed", "node").distinct())
    found = settle(shortest_paths(edges, asked.select(F.col("seed").alias("node")).distinct(), wanted=asked))
    reached = with_paths(found, labels, name, unlabelled).filter("depth > 0")
    ways = reached.select("seed", "node", "depth", F.concat(F.when(F.col("inverse"), "(-)").otherwise(""), "pred").alias("reaching_property"), name(F.col("pred"), F.col("inverse")).alias("reaching_property_label"), "parent", "path")
    ways = ways.join(labels.select(F.col("node").alias("parent"), F.col("label").alias("parent_label")), "parent", "left")
    joined = rows.join(ways.withColumnRenamed("depth", "bfs_depth").withColumn("parent", unlabelled(F.col("parent"))), ["seed", "node"], "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    parent_label = F.coalesce("parent_label", "parent", F.lit("")).alias("parent_label")
    return joined.select(*rows.columns, F.coalesce("bfs_depth", F.col("csv_depth").cast("long")).alias("depth"), blank("reaching_property"), blank("reaching_property_label"), blank("parent"), parent_label, blank("path"))


def evidence(level: str, gold: bool = False) -> Column:
    """A row's evidence line at a context level, of the columns of ``graph_context`` and label (and target, if ``gold``)."""
    if level not in LEVELS:
        raise ValueError(f"no context level {level}")
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    given = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}="), c))
    parts = [F.concat(F.lit("candidate="), "label")]
    if level == "path_simple":
        parts.append(F.concat(F.lit("path="), known("path")))
    if level in ("depth", "property", "path"):
        parts.append(F.concat(F.lit("depth="), F.coalesce(F.col("depth").cast("string"), F.lit("None"))))
    if level in ("property", "path"):
        parts += [F.concat(F.lit("reached_via="), known("reaching_property_label"), F.lit(" ("), known("reaching_property"), F.lit(")")), given("parent", "parent_label")]
    if level == "path":
        parts.append(given("path", "path"))
    if gold:
        parts.append(F.concat(F.lit("decision="), decision_word()))
    return F.concat_ws(" | ", *parts)


def decision_word() -> Column:
    return F.when(F.col("target") == 1, INCLUDE).otherwise(EXCLUDE)


def full_rows(rows: DataFrame, known: DataFrame, demonstrations: DataFrame) -> DataFrame:
    """Enriched rows of nodes in the graph that are no demonstrations, with ``ord``: their order by seed, depth (9999 if unknown) and row."""
    from .fixpoint import ordinals

    present = absent(rows, known).filter("present").select("row_id")
    kept = rows.join(present, "row_id", "left_semi").join(demonstrations.select("row_id").distinct(), "row_id", "left_anti")
    depth = F.coalesce(F.nullif(F.col("depth"), F.lit(0).cast("long")), F.lit(9999).cast("long"))
    return ordinals(kept.withColumn("_depth", depth), ["seed", "_depth", "row_index", "row_id"], "ord").drop("_depth")


def demonstrations(examples: DataFrame, paths: DataFrame, seeds: DataFrame) -> DataFrame:
    """Examples (node, decision) with the path to each; reading one that isn't reached, or is a seed, is an error."""
    own = seeds.select("node", F.lit(True).alias("is_seed")).distinct()
    joined = examples.join(paths.select("node", "seed", "depth", "path"), "node", "left").join(own, "node", "left")
    fault = F.when(F.col("is_seed"), F.concat(F.lit("a seed as a demonstration: "), "node")).when(F.col("path").isNull(), F.concat(F.lit("no path to "), "node"))
    return joined.filter(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True)).drop("is_seed")


def example_pack(rows: DataFrame, dataset: str, level: str, strategy: str = "explicit", diversity: str = "explicit", created: str = "") -> DataFrame:
    """One JSON document (value) of chosen examples (rows of ``graph_context`` with seed_label, label, target, ord), in order.

    A pack is as many examples as a prompt takes, so it is one row.
    """
    names = ("row_id", "seed", "seed_label", "node", "label", "target")
    line = F.concat(F.lit("- Seed: "), "seed_label", F.lit("\n  Candidate: "), evidence(level, gold=True))
    one = F.struct("ord", *names, decision_word().alias("decision"), "depth", "reaching_property", "reaching_property_label", "parent", "parent_label", "path", line.alias("prompt_line"))
    listed = rows.agg(F.sort_array(F.collect_list(one)).alias("x"))
    examples = F.transform("x", lambda e: e.dropFields("ord"))
    head = [F.lit(v).alias(k) for k, v in (("dataset", dataset), ("context_level", level), ("diversity_key", diversity), ("selection_strategy", strategy), ("created_at", created))]
    return listed.select(F.to_json(F.struct(*head, examples.alias("examples"))).alias("value"))
