"""A labelled graph, verdicts and decisions made from the driver's star tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.operators.fixpoint import widen
from arborix.operators.graph import directed

#: The same relations as SQL common table expressions, for the queries' SQL.
NODES_SQL = """nodes AS (
  SELECT 'region/' || r_regionkey AS node, r_name AS label FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'supplier/' || s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'customer/' || c_custkey, c_name FROM customer
  UNION ALL SELECT 'part/' || p_partkey, p_name FROM part)"""
EDGES_SQL = """edges AS (
  SELECT 'region/' || n_regionkey AS src, 'hasNation' AS pred, 'nation/' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation/' || s_nationkey, 'hasSupplier', 'supplier/' || s_suppkey FROM supplier
  UNION ALL SELECT 'nation/' || c_nationkey, 'hasCustomer', 'customer/' || c_custkey FROM customer
  UNION ALL SELECT 'customer/' || o_custkey, 'placed', 'order/' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'contains', 'part/' || l_partkey FROM lineitem)"""
VERDICTS_SQL = """verdicts AS (
  SELECT 'nation/' || n_nationkey AS node, n_nationkey % 4 <> 0 AS keep FROM nation
  UNION ALL SELECT 'supplier/' || s_suppkey, s_acctbal > 0 FROM supplier
  UNION ALL SELECT 'customer/' || c_custkey, c_acctbal > 3000 FROM customer
  UNION ALL SELECT 'order/' || o_orderkey, o_totalprice > 150000 FROM orders
  UNION ALL SELECT 'part/' || p_partkey, p_size > 20 FROM part)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str):
    return F.concat(F.lit(kind + "/"), F.col(key).cast("string"))


#: Kinds of nodes and the relation from one kind to another; no two kinds have several.
KINDS = ("region", "nation", "supplier", "customer", "order", "part")
RELATIONS = {("region", "nation"): "hasNation", ("nation", "supplier"): "hasSupplier", ("nation", "customer"): "hasCustomer", ("customer", "order"): "placed", ("order", "part"): "contains"}


def number(kind: str, key: str):
    """A node as a number, which joins and groups with less work than its name: its key times 8 and the place of its kind."""
    return F.col(key).cast("long") * 8 + KINDS.index(kind)


def name_of(number: Column) -> Column:
    """The name of a node's number."""
    kind = F.element_at(F.array(*[F.lit(x + "/") for x in KINDS]), (F.pmod(number, F.lit(8)) + 1).cast("int"))
    return F.concat(kind, F.shiftright(number, 3).cast("string"))


def relation_of(one: Column, other: Column) -> Column:
    """The relation between the numbers of two neighbours, whichever of them it comes from."""
    ends, out = F.pmod(one, F.lit(8)) * 8 + F.pmod(other, F.lit(8)), F.lit(None).cast("string")
    for (a, b), pred in RELATIONS.items():
        x, y = KINDS.index(a), KINDS.index(b)
        out = F.when(ends.isin(x * 8 + y, y * 8 + x), pred).otherwise(out)
    return out


def nodes(spark: SparkSession, sf_dir: str, node: Callable = node) -> DataFrame:
    """(node, label): orders have no label."""
    parts = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name")]
    out = None
    for name, key, label in parts:
        own = table(spark, sf_dir, name).select(node(name, key).alias("node"), F.col(label).alias("label"))
        out = own if out is None else out.unionByName(own)
    return out


def edges(spark: SparkSession, sf_dir: str, node: Callable = node, repeated: bool = False) -> DataFrame:
    """(src, pred, dst); ``repeated`` where rows may repeat an edge, which saves a shuffle."""
    named = lambda rows, a, ak, pred, b, bk: rows.select(node(a, ak).alias("src"), F.lit(pred).alias("pred"), node(b, bk).alias("dst"))
    widen(spark, *(table(spark, sf_dir, x) for x in ("supplier", "customer", "orders", "lineitem")))
    link = lambda name, *ends: named(table(spark, sf_dir, name), *ends)
    contained = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    contained = contained if repeated else contained.distinct()  # keys are less to shuffle than names
    return (
        link("nation", "region", "n_regionkey", "hasNation", "nation", "n_nationkey")
        .unionByName(link("supplier", "nation", "s_nationkey", "hasSupplier", "supplier", "s_suppkey"))
        .unionByName(link("customer", "nation", "c_nationkey", "hasCustomer", "customer", "c_custkey"))
        .unionByName(link("orders", "customer", "o_custkey", "placed", "order", "o_orderkey"))
        .unionByName(named(contained, "order", "l_orderkey", "contains", "part", "l_partkey"))
    )


def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("src", "pred", F.lit(False).alias("inverse"), "dst")


def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed(edges(spark, sf_dir))


def verdicts(spark: SparkSession, sf_dir: str, node: Callable = node) -> DataFrame:
    """(node, classification, confidence) by rules on the tables' numbers."""
    own = lambda name, key, kind, rule: table(spark, sf_dir, name).select(node(kind, key).alias("node"), F.when(F.expr(rule), "INCLUDE").otherwise("EXCLUDE").alias("classification"), F.lit(1.0).alias("confidence"))
    return (
        own("nation", "n_nationkey", "nation", "n_nationkey % 4 <> 0")
        .unionByName(own("supplier", "s_suppkey", "supplier", "s_acctbal > 0"))
        .unionByName(own("customer", "c_custkey", "customer", "c_acctbal > 3000"))
        .unionByName(own("orders", "o_orderkey", "order", "o_totalprice > 150000"))
        .unionByName(own("part", "p_partkey", "part", "p_size > 20"))
    )


def seeds(spark: SparkSession, sf_dir: str, node: Callable = node) -> DataFrame:
    return table(spark, sf_dir, "region").select(node("region", "r_regionkey").alias("node"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, seed, fold, property, seen, target, prediction, score): labels against a rule on the documents' length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    score = F.least(F.lit(1.0), F.floor(F.col("n_chars") / 4) / 1000.0)
    return rows.select(F.col("doc_id").alias("row_id"), F.col("source").alias("seed"), (F.col("doc_id") % 5).alias("fold"), F.col("lang").alias("property"), F.col("source").isin("src0", "src1", "src2").alias("seen"), F.col("quality").alias("target"), F.when(F.col("doc_id") % 17 != 0, (F.col("n_chars") > 1000).cast("int")).alias("prediction"), score.alias("score"))


JUDGED_SQL = """judged AS (
  SELECT l.doc_id AS row_id, d.source AS seed, l.doc_id % 5 AS fold, d.lang AS property, d.source IN ('src0', 'src1', 'src2') AS seen, l.quality AS target,
         CASE WHEN l.doc_id % 17 <> 0 THEN CAST(d.n_chars > 1000 AS INT) END AS prediction, least(1.0::DOUBLE, (d.n_chars // 4) / 1000.0::DOUBLE) AS score
  FROM labels l JOIN documents d USING (doc_id))"""
