"""Command line: extract a subgraph, score predictions, compare two prediction sets.

    python -m arborix.cli extract --graph g.ttl --seed http://e/a --verdicts v.csv --out out [--relation p --relation ^q]
    python -m arborix.cli score --rows rows.csv [--by property]
    python -m arborix.cli compare --left a.csv --right b.csv --by property
    python -m arborix.cli prepare --rows rows.csv --prefix run --system prompt.txt --out batch [--size 20]
    python -m arborix.cli finish --rows rows.csv --manifest batch/manifest --results results.jsonl
    python -m arborix.cli views --results folder [--view bfs_gated] [--scope runtime]
    python -m arborix.cli select --rows scored.csv [--by branch]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.operators import classify, graph, metrics, traverse
from arborix.plans import batch_jobs
from arborix.sources import rdf, sinks
from arborix.sources.rdfxml import read_rdfxml


def parse_relations(values: list[str], known: DataFrame, graph_type: str) -> list[tuple[str, bool]]:
    """(predicate, inverse) of overrides: an IRI or a unique local name, ``^`` or ``(-)`` before it for the inverse.

    A SKOS graph takes its own relations only, always both ways.
    """
    names = [raw.removeprefix("^").removeprefix("(-)").strip("<>") for raw in values]
    local = F.regexp_extract("predicate", "([^/#]*)[/#]*$", 1)
    meant = known.select("predicate").distinct().filter(F.col("predicate").isin(names) | local.isin(names))  # those that a value may name
    predicates = sorted(r["predicate"] for r in meant.collect())
    out = []
    for raw, name in zip(values, names, strict=True):
        inverse = raw.startswith(("^", "(-)"))
        found = [p for p in predicates if p == name] or [p for p in predicates if p.rstrip("/#").replace("#", "/").rpartition("/")[2] == name]
        if len(found) != 1:
            raise ValueError(f"{raw!r} names {len(found)} relations")
        if graph_type == "skos" and found[0] not in graph.SKOS_RELATIONS:
            raise ValueError(f"{raw!r} is no relation of a thesaurus")
        out += [(found[0], False), (found[0], True)] if graph_type == "skos" else [(found[0], inverse)]
    return sorted(set(out))


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".rdf", ".owl", ".xml", ".rdf.gz", ".owl.gz", ".xml.gz")):
        return read_rdfxml(spark, path)
    return rdf.read_ntriples(spark, path) if path.endswith((".nt", ".nt.gz")) else rdf.read_turtle(spark, path)


def extract(spark: SparkSession, args: argparse.Namespace) -> dict:
    triples = load_graph(spark, args.graph)
    labels = graph.preferred_labels(triples, args.language)
    edges = graph.structural_edges(triples, labels)
    kind = args.graph_type or graph.profile(triples).first()["graph_type"]
    specs = graph.relation_specs(edges)
    if args.relation:
        specs = spark.createDataFrame(parse_relations(args.relation, specs, kind), "predicate string, inverse boolean")
    seeds = graph.resolve(spark.createDataFrame([(s,) for s in args.seed], "reference string"), labels)
    wrong = [f"{r['reference']}: {r['problem']}" for r in seeds.filter("problem IS NOT NULL").collect()]
    if wrong:
        raise ValueError("; ".join(wrong))
    plan = {"graph_type": kind, "seeds": [r["node"] for r in seeds.orderBy("node").collect()], "relations": [[r["predicate"], r["inverse"]] for r in specs.orderBy("predicate", "inverse").collect()], "max_depth": args.max_depth}
    if args.dry_run:
        return plan
    verdicts = spark.read.option("header", True).csv(args.verdicts).select("node", "classification", F.expr("try_cast(confidence AS DOUBLE)").alias("confidence"))
    visited = traverse.gated_bfs(graph.directed(edges, specs), seeds.select("node"), classify.TableClassifier(verdicts, missing=classify.EXCLUDE), args.max_depth, labels=labels)
    sinks.write_extraction(visited, labels, args.out, args.overwrite, edges, args.prompt or "", plan)
    return plan | {"visited": visited.count(), "included": visited.filter("included").count()}


def _rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumns({c: F.expr(f"try_cast({c} AS INT)") for c in ("target", "prediction", "fold") if c in rows.columns})


def score(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    rows = _rows(spark, args.rows)
    by = [args.by] if args.by else []
    out = metrics.fold_weighted(rows, by) if "fold" in rows.columns else metrics.confusion(rows, by)
    return [r.asDict() for r in (out.orderBy(*by) if by else out).collect()]


def compare(spark: SparkSession, args: argparse.Namespace) -> dict:
    a, b = _rows(spark, args.left), _rows(spark, args.right)
    profile = metrics.error_profile(a, b, args.by).orderBy(F.desc("errors"), args.by)
    return {"overlap": metrics.overlap(a, b).first().asDict(), "profile": [r.asDict() for r in profile.collect()]}


def prepare(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Request lines and the manifest of an offline batch, from rows (row_id, evidence, row_index)."""
    rows = spark.read.option("header", True).csv(args.rows).withColumn("row_index", F.expr("CAST(row_index AS BIGINT)"))
    system = "\n".join(r["value"] for r in spark.read.text(args.system, wholetext=True).collect()).rstrip()
    lines, manifest = batch_jobs.prepare(rows, args.prefix, system, args.size)
    mode = "overwrite" if args.overwrite else "errorifexists"
    lines.write.mode(mode).text(f"{args.out}/requests")
    manifest.write.mode(mode).option("header", True).csv(f"{args.out}/manifest")
    return {"rows": rows.count(), "requests": spark.read.text(f"{args.out}/requests").count()}


def finish(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """Metrics of a finished batch, gated by ancestors and ungated, from rows (row_id, seed, node, parent, target)."""
    rows = _rows(spark, args.rows)
    manifest = spark.read.option("header", True).csv(args.manifest).withColumn("idx", F.expr("CAST(idx AS BIGINT)"))
    predicted = batch_jobs.predictions(spark.read.text(args.results), manifest)
    return [r.asDict() for r in batch_jobs.score(rows, predicted).orderBy("view").collect()]  # two rows


def views(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """The metric rows of a view in result documents, one document a file."""
    docs = spark.read.text(args.results, wholetext=True).select(F.input_file_name().alias("id"), "value")
    return [r.asDict() | {"metrics": json.loads(r["metrics"])} for r in metrics.metric_views(docs, args.view, args.scope).orderBy("id", "view").collect()]


def select(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """The threshold of the best F1 (the lowest of several) over rows (target, score), by group if asked."""
    rows = spark.read.option("header", True).csv(args.rows).withColumns({"target": F.expr("CAST(target AS INT)"), "score": F.expr("CAST(score AS DOUBLE)")})
    by = [args.by] if args.by else None
    best = metrics.best_threshold(metrics.threshold_sweep(rows, by=by), by=by)
    return [r.asDict() for r in (best.orderBy(*by) if by else best).collect()]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="arborix")
    sub = out.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("--graph", required=True)
    e.add_argument("--seed", action="append", required=True)
    e.add_argument("--relation", action="append", default=[])
    e.add_argument("--verdicts")
    e.add_argument("--out")
    e.add_argument("--language", default="en")
    e.add_argument("--prompt", help="the system prompt that the verdicts were given under, kept with the results")
    e.add_argument("--graph-type", choices=("skos", "general"))
    e.add_argument("--max-depth", type=int)
    e.add_argument("--overwrite", action="store_true")
    e.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("score")
    s.add_argument("--rows", required=True)
    s.add_argument("--by")
    c = sub.add_parser("compare")
    c.add_argument("--left", required=True)
    c.add_argument("--right", required=True)
    c.add_argument("--by", default="property")
    b = sub.add_parser("prepare")
    for name in ("--rows", "--prefix", "--system", "--out"):
        b.add_argument(name, required=True)
    b.add_argument("--size", type=int, default=20)
    b.add_argument("--overwrite", action="store_true")
    f = sub.add_parser("finish")
    for name in ("--rows", "--manifest", "--results"):
        f.add_argument(name, required=True)
    v = sub.add_parser("views")
    v.add_argument("--results", required=True)
    v.add_argument("--view", default="bfs_gated")
    v.add_argument("--scope", default="runtime")
    t = sub.add_parser("select")
    t.add_argument("--rows", required=True)
    t.add_argument("--by")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict | list:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("arborix").getOrCreate()
    result = {"extract": extract, "score": score, "compare": compare, "prepare": prepare, "finish": finish, "views": views, "select": select}[args.command](spark, args)
    print(json.dumps(result, default=str))
    return result


if __name__ == "__main__":
    main()
