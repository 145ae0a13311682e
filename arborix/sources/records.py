"""JSON records, entity claims, id sets, caches and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.operators.fixpoint import ordinals

CLAIM = "array<struct<rank:string,mainsnak:struct<snaktype:string,property:string,datavalue:struct<type:string,value:struct<id:string>>>>>"


def read_records(spark: SparkSession, path: str, pattern: str = "%") -> DataFrame:
    """(path, data) of an append-only JSONL log, for logical paths like ``pattern``; data stays JSON text."""
    rows = spark.read.text(path).select(F.get_json_object("value", "$.path").alias("path"), F.get_json_object("value", "$.data").alias("data"))
    return rows.filter(F.col("path").like(pattern))


def append_records(rows: DataFrame, path: str) -> None:
    """Append (path, data) as JSON lines; many writers may append at once, each to files of its own."""
    rows.select("path", "data").write.mode("append").json(path)


def claims(entities: DataFrame, properties: list[str]) -> DataFrame:
    """(entity, property, target) of entity JSON (id, claims): items that aren't deprecated, by the properties given."""
    parsed = entities.select(F.get_json_object("value", "$.id").alias("entity"), F.from_json(F.get_json_object("value", "$.claims"), f"map<string,{CLAIM}>").alias("claims"))
    rows = parsed.select("entity", F.explode("claims").alias("property", "items")).filter(F.col("property").isin(properties)).select("entity", "property", F.explode("items").alias("c"))
    target = F.col("c.mainsnak.datavalue.value.id")
    return rows.filter((F.coalesce("c.rank", F.lit("")) != "deprecated") & (F.col("c.mainsnak.snaktype") == "value") & (F.col("c.mainsnak.datavalue.type") == "wikibase-entityid") & target.startswith("Q")).select("entity", "property", target.alias("target"))


def integer_ids(nodes: DataFrame) -> DataFrame:
    """(node, id): ids from 0 in the order of the names."""
    return ordinals(nodes.select("node").distinct(), ["node"], "id").select("node", "id")


def required_ids(texts: DataFrame, columns: list[str], pattern: str = r"Q\d+") -> DataFrame:
    """(id): distinct ids in any of the columns."""
    return texts.select(F.explode(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(pattern), F.lit(0)) for c in columns]))).alias("id")).distinct()


def missing_runs(done: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """Planned combinations without a result."""
    return planned.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def per_seed_json(subgraphs: DataFrame, labels: DataFrame) -> DataFrame:
    """(seed, value): each seed's edges and labels as one JSON document."""
    edges = subgraphs.groupBy("seed").agg(F.sort_array(F.collect_set(F.array("src", "pred", "dst"))).alias("edges"))
    names = subgraphs.select("seed", F.explode(F.array("src", "dst")).alias("node")).distinct().join(labels.select("node", "label"), "node")
    named = names.groupBy("seed").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("node", "label")))).alias("labels"))
    return edges.join(named, "seed", "left").select("seed", F.to_json(F.struct("edges", "labels")).alias("value"))


def markdown(table: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A small table as Markdown; one of more than ``most`` rows is no report, which is an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]])
