import json
import re

import pytest
from pyspark.sql import functions as F

from arborix.operators import classify, context, graph, metrics, sampling, traverse, universe
from arborix.sources import keyed, rdf, sinks


def test_ntriples_escapes_and_faults(spark, tmp_path):
    lines = [r'<http://a> <http://p> "tab\tquote\" back\\slash it\'s é \U0001F600 \U000000e8" .', '<http://a> <http://p> <http://b> . # note', "", "# a comment"]
    (tmp_path / "g.nt").write_text("\n".join(lines), encoding="utf-8")
    rows = {r.o_kind: r.o for r in rdf.read_ntriples(spark, f"file://{tmp_path}/g.nt").collect()}
    assert rows == {"literal": "tab\tquote\" back\\slash it's é \U0001f600 è", "iri": "http://b"}
    (tmp_path / "bad.nt").write_text("<http://a> <http://p> no triple .", encoding="utf-8")
    with pytest.raises(Exception, match="no triple"):
        rdf.read_ntriples(spark, f"file://{tmp_path}/bad.nt").collect()


def test_thesaurus_profile(spark):
    skos, kind = "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    rows = [(c, kind, f"{skos}Concept", "iri") for c in "abc"] + [(c, f"{skos}prefLabel", c, "literal") for c in "abc"] + [("a", f"{skos}broader", "b", "iri"), ("a", f"{skos}exactMatch", "c", "iri")]
    own = graph.THESAURUS_RELATIONS[0]
    kind_of = lambda extra: graph.profile(spark.createDataFrame(rows + extra, "s string, p string, o string, o_kind string")).first()["graph_type"]
    scheme = ("a", f"{skos}inScheme", graph.THESAURUS_SCHEMES[0], "iri")
    assert kind_of([]) == "skos" and kind_of([("a", own, "b", "iri")]) == "general" and kind_of([("a", own, "b", "iri"), scheme]) == "skos"
    assert kind_of([scheme, ("a", "http://x/p", "b", "iri")]) == "general" and kind_of([("a", "http://purl.org/dc/terms/source", "b", "iri")]) == "general"


def test_context_lines_and_packs(spark):
    edges = spark.createDataFrame([("Q1", "P31", False, "Q2", 1), ("Q2", "P279", True, "Q3", 1), ("Q1", "P999", True, "Q4", 2), ("Q3", "P31", False, "Q1", 1)], "src string, pred string, inverse boolean, dst string, ord long")
    labels = spark.createDataFrame([("Q1", "one"), ("Q2", "two"), ("Q3", "three")], "node string, label string")
    rows = spark.createDataFrame([("r1", "Q1", "Q3", 7, "three", "one", 1), ("r2", "Q1", "Q4", None, "four", "one", 0), ("r3", "Q1", "Q9", 5, "nine", "one", 0), ("r4", "Q3", "Q2", 1, "two", "three", 1)], "row_id string, seed string, node string, csv_depth int, label string, seed_label string, target int")
    found = context.graph_context(rows, edges, labels)
    got = {r.row_id: r for r in found.select("*", *[context.evidence(x, gold=True).alias(f"at_{x}") for x in context.LEVELS]).collect()}
    assert got["r1"].path == "one --instance of--> two --has subclass--> three" and got["r1"].reaching_property == "(-)P279" and got["r1"].depth == 2
    assert got["r1"].at_path == "candidate=three | depth=2 | reached_via=has subclass ((-)P279) | parent=two | path=one --instance of--> two --has subclass--> three | decision=INCLUDE"
    assert got["r2"].at_property == "candidate=four | depth=1 | reached_via=reverse P999 ((-)P999) | parent=one | decision=EXCLUDE"
    assert got["r3"].at_path == "candidate=nine | depth=5 | reached_via=unknown (unknown) | decision=EXCLUDE" and got["r3"].at_path_simple == "candidate=nine | path=unknown | decision=EXCLUDE"
    assert got["r4"].at_labels == "candidate=two | decision=INCLUDE" and got["r4"].path == "three --instance of--> one --instance of--> two"
    pack = json.loads(context.example_pack(found.filter("row_id IN ('r1', 'r2')").withColumn("ord", F.col("row_id")), "1", "depth").first()[0])
    assert [e["row_id"] for e in pack["examples"]] == ["r1", "r2"] and pack["examples"][0]["prompt_line"] == "- Seed: one\n  Candidate: candidate=three | depth=2 | decision=INCLUDE" and "ord" not in pack["examples"][0]
    with pytest.raises(ValueError):
        context.evidence("nothing")
    paths = traverse.with_paths(traverse.shortest_paths(edges, spark.createDataFrame([("Q1",)], "node string")))
    seeds = spark.createDataFrame([("Q1",)], "node string")
    good = spark.createDataFrame([("Q3", 1)], "node string, decision int")
    assert context.demonstrations(good, paths, seeds).first()["depth"] == 2
    for node, words in (("Q9", "no path"), ("Q1", "a seed")):
        with pytest.raises(Exception, match=words):
            context.demonstrations(spark.createDataFrame([(node, 1)], "node string, decision int"), paths, seeds).collect()


def test_faulty_answers_are_errors(spark):
    rows = spark.createDataFrame([(0, 1, "x"), (0, 2, "y")], "batch long, idx long, node string")
    one = lambda include, exclude, choice, kind="choice": {"type": kind, "choice": choice, "confidence": 0.9, "probabilities": {"INCLUDE": include, "EXCLUDE": exclude}}
    run = lambda answers, over=None, model="m": classify.probability_answers(rows, spark.createDataFrame([(0, json.dumps({"model": model, "answers": answers}))], "batch long, value string"), over).collect()
    good = {"candidate_1": one(0.7, 0.3, "INCLUDE"), "candidate_2": one(0.2, 0.8, "EXCLUDE")}
    assert {(r.node, r.classification, r.selected_probability) for r in run(good)} == {("x", "INCLUDE", 0.7), ("y", "EXCLUDE", 0.8)}
    refused = {r.node: r for r in run(good | {"candidate_2": {"type": "refusal"}}, ["y"])}
    assert refused["y"].overridden and refused["y"].classification == "EXCLUDE" and refused["y"].p_include is None and not refused["x"].overridden
    faults = {"exactly the candidates": [{"candidate_1": good["candidate_1"]}, good | {"candidate_3": good["candidate_1"]}], "sum to one": [good | {"candidate_2": one(0.2, 0.7, "EXCLUDE")}], "not the likelier": [good | {"candidate_2": one(0.2, 0.8, "INCLUDE")}, good | {"candidate_2": one(0.2, 0.8, "MAYBE")}], "not a choice": [good | {"candidate_2": {"type": "refusal"}}], "no two probabilities": [good | {"candidate_2": {"type": "choice", "choice": "INCLUDE"}}]}
    for words, bad in faults.items():
        for answers in bad:
            with pytest.raises(Exception, match=words):
                run(answers)
    with pytest.raises(Exception, match="no response model"):
        run(good, model=None)
    schema = classify.response_schema()["properties"]["evaluations"]["items"]
    assert schema["required"] == ["idx", "classification", "confidence"] and schema["additionalProperties"] is False and schema["properties"]["idx"] == {"type": "integer", "minimum": 1}
    assert classify.response_schema("open_api")["properties"]["evaluations"]["items"]["propertyOrdering"] == ["idx", "classification", "confidence"]


def test_views_that_documents_lack(spark):
    docs = spark.createDataFrame([(1, json.dumps({"metric_aggregations": {"runtime_rows": {"pooled": {"f1": 1}}}, "metrics": {"precision": 0.5}}))], "id long, value string")
    assert [(r.view, r.metrics) for r in metrics.metric_views(docs, "runtime_pooled").collect()] == [("runtime_pooled", '{"f1":1}')]
    assert metrics.metric_views(docs, "metrics").first()["metrics"] == '{"precision":0.5}' and metrics.metric_views(docs).count() == 0
    for view in ("both_aggregations", "absent"):
        with pytest.raises(Exception, match="no aggregation|no metric view"):
            metrics.metric_views(docs, view).collect()


def test_universe_faults_and_rows(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    none = table([], "branch string, node string")
    runs = table([("b", "r1", "x", True), ("b", "r2", "x", False)], "branch string, run string, node string, in_gold boolean")
    with pytest.raises(Exception, match="disagrees"):
        universe.observed_universe(runs, table([("b", "x")], "branch string, node string"), none, none, table([], "node string")).collect()
    rows = table([("b", "x", ["p"], False, True), ("b", "y", [], False, True), ("b", "z", ["p"], True, True), ("b", "w", ["p"], False, False), ("c", "v", ["p"], False, True)], "branch string, node string, path array<string>, seed boolean, scored boolean")
    assert {r.node for r in universe.branch_rows(rows, ["b"]).collect()} == {"x", "w"} and {r.node for r in universe.branch_rows(rows, ["b"], True).collect()} == {"x"}


def test_artifacts(spark, tmp_path):
    edges = spark.createDataFrame([("a", "p", False, "b"), ("b", "q", False, "c")], "src string, pred string, inverse boolean, dst string")
    verdicts = spark.createDataFrame([("b", "INCLUDE", 0.9), ("c", "EXCLUDE", 0.8)], "node string, classification string, confidence double")
    visited = traverse.gated_bfs(edges, spark.createDataFrame([("a",)], "node string"), classify.TableClassifier(verdicts))
    labels = spark.createDataFrame([("a", "A"), ("b", "B")], "node string, label string")
    out = f"file://{tmp_path}/run"
    sinks.write_extraction(visited, labels, out, edges=edges, prompt="Judge.\n", run={"model": "m"})
    read = lambda name: spark.read.option("header", True).csv(f"{out}/{name}")
    assert tuple(read("decisions").columns) == sinks.DECISION_COLUMNS and [r.node for r in read("decisions").collect()] == ["a", "b", "c"] == [r.node for r in read("visited").collect()]
    assert {r.node: (r.label, r.seed_label, r.path) for r in read("excluded").collect()} == {"c": ("c", "A", "A --p--> B --q--> c")}
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{out}/manifest", wholetext=True).collect()))
    assert (manifest["visited_count"], manifest["included_count"], manifest["excluded_count"], manifest["retained_traversal_edge_count"], manifest["iterations"][0]["evaluated"], manifest["model"]) == (3, 2, 1, 1, 1, "m")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_extraction(visited, labels, out)
    rows = spark.createDataFrame([("u", "L", ["x", "y"], ["broader"], "INCLUDE", 1.0), ("v", "M", [], [], "EXCLUDE", 0.5)], "uri string, prefLabel string, altLabels array<string>, relations array<string>, classification string, confidence double")
    sinks.write_concepts(rows, spark.createDataFrame([("u",)], "node string"), out, "run", {"metrics": {"f1": 1.0}})
    kept = spark.read.option("header", True).csv(f"{out}/run_INCLUDED").collect()
    assert [(r.uri, r.altLabels, r.in_hierarchy_gold) for r in kept] == [("u", "x; y", "True")] and tuple(kept[0].asDict()) == sinks.CONCEPT_COLUMNS
    assert sinks.publish(spark, ["prompt", "run_METRICS"], out, f"file://{tmp_path}/public") and (tmp_path / "public/prompt").is_dir()
    with pytest.raises(FileNotFoundError, match="nothing"):
        sinks.publish(spark, ["prompt", "nothing"], out, f"file://{tmp_path}/other")
    assert not (tmp_path / "other").exists()
    sinks.append_statistics(rows.select("uri"), f"{out}/statistics")
    sinks.append_statistics(rows.select("uri"), f"{out}/statistics")
    assert spark.read.parquet(f"{out}/statistics").count() == 4


def test_stores(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    keyed.write_store(spark.range(500).selectExpr("concat('k', id % 400) AS key", "-id AS value", "id AS turn"), path, buckets=8, order="turn")
    assert keyed.read_store(spark, path).count() == 400
    asked = spark.createDataFrame([("k7",), ("k7",), ("none",)], "key string")
    assert {(r.key, r.value) for r in keyed.lookup(spark, path, asked).collect()} == {("k7", -407), ("none", None)}
    with pytest.raises(Exception, match="two values"):
        keyed.write_store(spark.range(500).selectExpr("concat('k', id % 400) AS key", "id AS value"), f"{path}-2")
    assert keyed.write_store(spark.range(10).selectExpr("concat('k', id) AS key", "id AS value"), f"{path}-3") == 1 == keyed.buckets_of(spark, f"{path}-3")
    old, keyed.FEW = keyed.FEW, 1
    try:
        assert {(r.key, r.value) for r in keyed.lookup(spark, path, asked).collect()} == {("k7", -407), ("none", None)}
    finally:
        keyed.FEW = old
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert json.loads(keyed.coverage_manifest(ids, ids.filter("id = 'a'")).first()[0]) == {"key_format": "uri", "required": 2, "found": 1, "missing": 1}


def test_neighbours_of_many_queries(spark):
    points = spark.range(40).selectExpr("id", "array(cast(id AS double), cast(id * id AS double)) AS vector")
    asked = points.select(F.col("id").alias("query"), "vector")
    got = {(r.query, r.n): r.id for r in sampling.nearest(asked, points, 2, block=3).collect()}
    for q in range(40):
        order = sorted((((q - i) ** 2 + (q * q - i * i) ** 2) ** 0.5, i) for i in range(40) if i != q)
        assert [got[q, 1], got[q, 2]] == [order[0][1], order[1][1]]
    assert sampling.nearest(asked.limit(0), points, 2).count() == 0


def test_case_folding_is_unicode_s(spark):
    from arborix.functions.text import casefold

    words = ["Straße", "ΣΊΣΥΦΟΣ ς", "ﬁn ﬄ", "İstanbul", "Ꭰꭰ", "plain ASCII", "", "ŉ ǰ", "ÀÉ"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", casefold(F.col("w")).alias("f")).collect()
    assert {r.w: r.f for r in got} == {w: w.casefold() for w in words}


def test_every_character_folds(spark):
    """Each character that folds otherwise, alone and between others; their ranges hold these characters only."""
    from arborix.functions import text

    words = [w for x in text._folds() for w in (x, f"a{x}B")]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.casefold(F.col("w")).alias("f")).collect()
    assert {r.w: r.f for r in got} == {w: w.casefold() for w in words}
    assert {chr(i) for i in range(0x110000) if re.match(f"[{text._fold_ranges()}]", chr(i))} == set(text._folds()) and len(text._fold_ranges()) < 100


def test_batches_views_and_thresholds_on_the_command_line(spark, tmp_path):
    from arborix import cli

    (tmp_path / "rows.csv").write_text("row_id,row_index,evidence,seed,node,parent,target\nr1,0,one,s,a,,1\nr2,1,two,s,b,a,0\nr3,2,three,s,c,b,1\n")
    (tmp_path / "prompt.txt").write_text("Judge.\n")
    at = lambda name: f"file://{tmp_path}/{name}"
    made = cli.main(["prepare", "--rows", at("rows.csv"), "--prefix", "run", "--system", at("prompt.txt"), "--out", at("batch"), "--size", "2"], spark)
    assert made == {"rows": 3, "requests": 2}
    answer = lambda key, *words: json.dumps({"key": key, "response": json.dumps({"evaluations": [{"idx": i, "classification": w, "confidence": 1.0} for i, w in enumerate(words, 1)]})})
    (tmp_path / "results.jsonl").write_text(answer("run_batch000000", "INCLUDE", "EXCLUDE") + "\n" + answer("run_batch000001", "INCLUDE") + "\n")
    done = {r["view"]: r for r in cli.main(["finish", "--rows", at("rows.csv"), "--manifest", at("batch/manifest"), "--results", at("results.jsonl")], spark)}
    assert (done["ungated"]["tp"], done["ungated"]["tn"], done["ungated"]["fn"]) == (2, 1, 0) and (done["gated"]["tp"], done["gated"]["fn"]) == (1, 1)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.json").write_text(json.dumps({"metrics": {"bfs_gated": {"f1": 0.5}}}))
    assert [(r["view"], r["metrics"]) for r in cli.main(["views", "--results", at("docs")], spark)] == [("full_dataset_bfs_gated", {"f1": 0.5})]
    (tmp_path / "scored.csv").write_text("branch,target,score\nx,1,0.9\nx,0,0.4\ny,1,0.2\ny,0,0.1\n")
    best = cli.main(["select", "--rows", at("scored.csv"), "--by", "branch"], spark)
    assert [(r["branch"], round(r["threshold"], 2), r["f1"]) for r in best] == [("x", 0.41, 1.0), ("y", 0.11, 1.0)]
