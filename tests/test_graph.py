from pyspark.sql import functions as F

import pytest

from arborix.functions import text, vectors
from arborix.operators import classify, graph, metrics, relational, sampling, traverse
from arborix.sources import rdf, sinks, tables


def test_turtle_parser_reads_lists_blank_nodes_and_escapes():
    rows = rdf.parse_turtle('@prefix ex: <http://e/> .\nex:a a ex:C ; ex:p ex:b, "x\\"y\\u00e9"@en , 4.5 ; ex:q [ ex:r true ] . # done\n<http://e/z.z> ex:p """long\n"q" text""" .')
    assert ("http://e/a", "http://e/p", 'x"yé', "literal", "en", None) in rows
    assert ("http://e/a", "http://e/q", "_:b1", "bnode", None, None) in rows
    assert ("_:b1", "http://e/r", "true", "literal", None, "http://www.w3.org/2001/XMLSchema#boolean") in rows
    assert rows[-1][2] == 'long\n"q" text'
    with pytest.raises(ValueError):
        rdf.parse_turtle("nope:a nope:b nope:c .")


def test_text_scans(spark, tmp_path):
    (tmp_path / "g.nt").write_text('# c\n<http://e/a> <http://e/p> <http://e/b> .\n<http://e/a> <http://e/l> "x\\"y"@en .\n_:n <http://e/p> "3"^^<http://e/int> .\n')
    rows = {(r.s, r.o, r.o_kind, r.o_lang) for r in rdf.read_ntriples(spark, str(tmp_path / "g.nt")).collect()}
    assert rows == {("http://e/a", "http://e/b", "iri", None), ("http://e/a", 'x"y', "literal", "en"), ("_:n", "3", "literal", None)}
    (tmp_path / "w.ttl").write_text('@prefix wd: <x> .\nwd:Q1 wdt:P31 wd:Q2 .\nwd:Q1 rdfs:label "A \\"b\\""@en .\n')
    edges, labels = rdf.read_restricted_turtle(spark, str(tmp_path / "w.ttl"))
    assert [(r.s, r.p, r.o) for r in edges.collect()] == [("Q1", "P31", "Q2")]
    assert [(r.node, r.label) for r in labels.collect()] == [("Q1", 'A "b"')]
    (tmp_path / "t.ttl").write_text("@prefix e: <http://e/> . e:a e:p e:b .")
    assert rdf.read_turtle(spark, str(tmp_path / "t.ttl")).collect()[0].o == "http://e/b"
    (tmp_path / "ids").write_text("Q1\n\n Q2 \n")
    assert {r.id for r in tables.read_ids(spark, str(tmp_path / "ids")).collect()} == {"Q1", "Q2"}
    (tmp_path / "props").write_text("P31\n(-)P279\n")
    assert {(r.predicate, r.inverse) for r in tables.read_properties(spark, str(tmp_path / "props")).collect()} == {("P31", False), ("P279", True)}


def test_decisions_keep_row_numbers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("from,starting label,QID,label,depth,target\nQ1,a,Q2,b,1,1\nQ1,a,,x,1,0\nQ1,a,Q3, c ,,KEEP\n")
    rows = tables.read_decisions(spark, str(tmp_path / "d.csv")).orderBy("row_index").collect()
    assert [(r.row_id, r.node, r.depth, r.target, r.label) for r in rows] == [("row0", "Q2", 1, 1, "b"), ("row2", "Q3", None, 1, "c")]
    bad = spark.createDataFrame([("Straße", "keep"), ("STRASSE", "prune")], "node string, decision string")
    with pytest.raises(Exception, match="occurs twice"):
        tables.demonstrations(bad).collect()
    with pytest.raises(Exception, match="not unique"):
        tables.require_unique(spark.createDataFrame([("a",), ("a",)], "row_id string"), "row_id").collect()


def test_embeddings_positions_and_arrays(spark, tmp_path):
    import numpy as np

    (tmp_path / "e.tsv").write_text("<http://w/Q1>\t1\t2\n<http://w/Q2>\t3\t4\n<http://w/Q1>\t9\t9\n")
    got = tables.embeddings_for(spark.read.text(str(tmp_path / "e.tsv")), spark.createDataFrame([("Q1",)], "id string")).collect()
    assert [(r.id, r.vector) for r in got] == [("Q1", [1.0, 2.0])]
    names = spark.createDataFrame([('["a","b","c"]',)], "value string")
    assert [(r.id, r.position) for r in tables.array_positions(names, spark.createDataFrame([("c",)], "id string")).collect()] == [("c", 2)]
    np.save(tmp_path / "v.npy", np.arange(6.0).reshape(3, 2))
    assert tables.read_vectors(spark, str(tmp_path / "v.npy")).filter("position = 2").collect()[0].vector == [4.0, 5.0]


EDGES = [("s", "p", "a"), ("s", "p", "b"), ("a", "p", "c"), ("b", "q", "c"), ("c", "p", "s"), ("c", "p", "d"), ("a", "p", "a"), ("x", "p", "b"), ("d", "p", "e")]


def frames(spark):
    edges = spark.createDataFrame(EDGES, "src string, pred string, dst string")
    return edges, edges.withColumn("inverse", F.lit(False)), spark.createDataFrame([("s",)], "node string")


def test_gated_traversal_on_a_cycle(spark):
    edges, directed, seeds = frames(spark)
    verdicts = spark.createDataFrame([("a", "EXCLUDE", 0.9), ("b", "INCLUDE", 0.8), ("c", "INCLUDE", 1.0), ("d", "EXCLUDE", 1.0)], "node string, classification string, confidence double")
    rows = {r.node: r for r in traverse.with_paths(traverse.gated_bfs(directed, seeds, classify.TableClassifier(verdicts))).withColumnRenamed("path", "text").collect()}
    assert {n: (r.depth, r.included) for n, r in rows.items()} == {"s": (0, True), "a": (1, False), "b": (1, True), "c": (2, True), "d": (3, False)}
    assert rows["c"].text == "s --p--> b --q--> c" and rows["s"].text == "(seed node)"
    limited = traverse.gated_bfs(directed, seeds, classify.TableClassifier(verdicts), max_depth=1)
    assert limited.count() == 3
    python = classify.PythonClassifier(lambda asked: [("INCLUDE", 1.0) for _ in asked], evidence="node")
    assert {r.node for r in traverse.gated_bfs(directed, seeds, python).collect()} == {"s", "a", "b", "c", "d", "e"}
    with pytest.raises(Exception, match="no score"):
        traverse.gated_bfs(directed, seeds, classify.ThresholdClassifier(spark.createDataFrame([("a", 0.5)], "node string, score double"), 0.4)).count()
    with pytest.raises(Exception, match="exactly one decision"):
        traverse.gated_bfs(directed, seeds, classify.PythonClassifier(lambda asked: [], evidence="node")).count()


def test_bridges_and_reachability(spark):
    edges, directed, seeds = frames(spark)
    decided = spark.createDataFrame([("s", "c"), ("s", "e")], "seed string, node string")
    verdicts = spark.createDataFrame([("c", "INCLUDE", 1.0), ("e", "EXCLUDE", 1.0)], "node string, classification string, confidence double")
    rows = {(r.node, r.depth, r.included) for r in traverse.bridge_bfs(directed, seeds, decided, classify.TableClassifier(verdicts)).collect()}
    assert rows == {("c", 1, True), ("e", 2, False)}
    assert traverse.bridge_bfs(directed, seeds, decided.limit(0), classify.TableClassifier(verdicts)).count() == 0
    found = {(r.node, r.depth) for r in traverse.reachable(edges, seeds, masked=spark.createDataFrame([("b",)], "node string")).collect()}
    assert found == {("s", 0), ("a", 1), ("c", 2), ("d", 3), ("e", 4)}


def test_ancestor_gating_reasons(spark):
    rows = spark.createDataFrame([("s", "a", "", 1), ("s", "b", "a", None), ("s", "c", "b", 1), ("s", "d", "zz", 1), ("s", "e", "a", 1)], "seed string, node string, parent string, raw int")
    got = {r.node: (r.effective, r.reason) for r in traverse.ancestor_gating(rows).collect()}
    assert got == {"a": (1, "JUDGED"), "b": (0, "NO_MATCH"), "c": (0, "PRUNED_BY_ANCESTOR"), "d": (0, "NO_PARENT"), "e": (1, "JUDGED")}


def test_labels_fall_back_by_language(spark):
    skos = "http://www.w3.org/2004/02/skos/core#"
    rows = [("n", skos + "prefLabel", "Haus", "literal", "de"), ("n", skos + "altLabel", "home", "literal", "en"), ("n", skos + "altLabel", "HAUS", "literal", "en"), ("m", skos + "altLabel", "only", "literal", None), ("m", skos + "prefLabel", " ", "literal", "en")]
    got = {r.node: (r.label, r.alternatives) for r in graph.preferred_labels(spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string")).collect()}
    assert got == {"n": ("Haus", ["home"]), "m": ("only", [])}


def test_zero_divisions_and_missing_folds(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (1, None, 1)], "target int, prediction int, fold int")
    r = metrics.confusion(rows).collect()[0]
    assert (r.precision, r.recall, r.f1, r.accuracy, r.unmatched) == (0.0, 0.0, 0.0, 1.0, 1)
    assert metrics.fold_weighted(rows, folds=5).collect()[0].weighted_f1 is None


def test_sinks_and_streams(spark, tmp_path):
    edges, directed, seeds = frames(spark)
    labels = spark.createDataFrame([("s", 'S "q"')], "node string, label string")
    sinks.write_turtle(edges.filter("src = 's'"), labels, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 6 and sum('\\"q\\"' in x for x in lines) == 1 and lines[3:] == ["# Nodes without a label:", "#   <a>", "#   <b>"]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_turtle(edges, labels, str(tmp_path / "out"))
    from arborix.streaming import usage

    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"ts":"2024-01-01T00:10:00Z","status":"ok","tokens":3}\n{"ts":"2024-01-01T00:20:00Z","status":"ok","tokens":4}\n')
    stream = usage.windowed_usage(usage.attempt_stream(spark, str(tmp_path / "log"), "ts timestamp, status string, tokens long"))
    query = stream.writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.attempts, r.tokens) for r in spark.table("usage").collect()] == [(2, 7)]


def test_vectors_and_samples(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]],)], "v array<array<double>>")
    pick = lambda mode, n: df.select(vectors.fit_path(F.col("v"), n, F.array(F.lit(0.0)), mode).alias("x")).collect()[0].x
    assert pick("after", 4) == [[1.0], [2.0], [3.0], [0.0]] and pick("before", 4)[0] == [0.0] and pick("between", 5) == [[1.0], [0.0], [0.0], [2.0], [3.0]] and pick("after", 2) == [[1.0], [3.0]]
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, vector array<double>")
    near = sampling.nearest(points.filter("id = 5").withColumnRenamed("id", "query"), points, 2).orderBy("n").collect()
    assert [(r.id, r.distance) for r in near] == [(4, 1.0), (6, 1.0)]
    split = sampling.split_edges(spark.createDataFrame([(str(a), str(b)) for a in range(8) for b in range(a)], "src string, dst string"), 0.5)
    kept = split.filter("NOT held_out").select(F.explode(F.array("src", "dst")).alias("n")).distinct().count()
    assert kept == 8 and split.filter("held_out").count() > 0
    assert sampling.fold_assignments(spark.createDataFrame([(x,) for x in "abcde"], "branch string")).count() == 20
    assert spark.range(1).select(text.decision(F.lit(" keep "))).collect()[0][0] == 1
    with pytest.raises(Exception, match="not a decision"):
        spark.range(1).select(text.decision(F.lit("maybe"))).collect()
    assert relational.universe_errors(spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([], "node string, included boolean")).collect()[0].bucket == "fn_unreached"


def test_prompts(spark):
    from arborix.operators import prompts

    rows = spark.createDataFrame([(2, "b", 0), (1, "a", 1)], "ord int, evidence string, decision int")
    assert prompts.demonstration_block(rows).first().block == "1. a => INCLUDE\n2. b => EXCLUDE"
    assert prompts.render("x {{ a }} y", {"a": "1"}) == "x 1 y"
    with pytest.raises(ValueError):
        prompts.render("x {{ a }}", {"b": "1"})
    assert prompts.problems("# Role\n" + "word " * 200, headings=("role",)) == []
    assert len(prompts.problems("{{ a }} ```", 500, ("role",), fences=False)) == 4


def test_command_line(spark, tmp_path, capsys):
    from arborix import cli

    (tmp_path / "g.ttl").write_text('@prefix e: <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . e:s e:p e:a ; r:label "S"@en . e:a e:p e:b ; r:label "A"@en . e:b r:label "B"@en . e:s e:q e:c . e:c r:label "C"@en .')
    (tmp_path / "v.csv").write_text("node,classification,confidence\nhttp://e/a,INCLUDE,0.9\nhttp://e/b,EXCLUDE,0.8\nhttp://e/c,INCLUDE,1\n")
    base = ["extract", "--graph", str(tmp_path / "g.ttl"), "--seed", "s", "--relation", "p"]
    plan = cli.main([*base, "--dry-run"], spark)
    assert plan == {"graph_type": "general", "seeds": ["http://e/s"], "relations": [["http://e/p", False]], "max_depth": None}
    done = cli.main([*base, "--verdicts", str(tmp_path / "v.csv"), "--out", str(tmp_path / "out")], spark)
    assert (done["visited"], done["included"]) == (3, 2)
    assert any("<http://e/s> <http://e/p> <http://e/a> ." in r.value for r in spark.read.text(str(tmp_path / "out/subgraph")).collect())
    with pytest.raises(ValueError, match="unknown"):
        cli.main(["extract", "--graph", str(tmp_path / "g.ttl"), "--seed", "zzz"], spark)
    (tmp_path / "a.csv").write_text("row_id,property,target,prediction,fold\n1,p,1,1,0\n2,p,0,1,1\n")
    (tmp_path / "b.csv").write_text("row_id,property,target,prediction,fold\n1,p,1,0,0\n2,p,0,0,1\n")
    assert cli.main(["score", "--rows", str(tmp_path / "a.csv")], spark)[0]["tp"] == 1
    assert cli.main(["compare", "--left", str(tmp_path / "a.csv"), "--right", str(tmp_path / "b.csv")], spark)["profile"][0]["disagreements"] == 2


def test_records_and_claims(spark, tmp_path):
    import json

    from arborix.sources import records

    snak = lambda i, rank="normal", kind="value": {"rank": rank, "mainsnak": {"snaktype": kind, "property": "P31", "datavalue": {"type": "wikibase-entityid", "value": {"id": i}}}}
    entity = {"id": "Q1", "claims": {"P31": [snak("Q2"), snak("Q3", "deprecated"), snak("L4"), snak("Q5", kind="novalue")], "P9": [snak("Q6")]}}
    rows = spark.createDataFrame([(json.dumps(entity),), (json.dumps({"id": "Q7", "claims": []}),)], "value string")
    assert [(r.entity, r.target) for r in records.claims(rows, ["P31"]).collect()] == [("Q1", "Q2")]
    records.append_records(spark.createDataFrame([("a/1.json", "{}")], "path string, data string"), str(tmp_path / "log"))
    records.append_records(spark.createDataFrame([("b/2.json", '{"x":1}')], "path string, data string"), str(tmp_path / "log"))
    assert [r.data for r in records.read_records(spark, str(tmp_path / "log"), "b/%").collect()] == ['{"x":1}']
    sub = spark.createDataFrame([("s", "a", "p", "b")], "seed string, src string, pred string, dst string")
    out = json.loads(records.per_seed_json(sub, spark.createDataFrame([("a", "A")], "node string, label string")).first().value)
    assert out == {"edges": [["a", "p", "b"]], "labels": {"a": "A"}}
    assert records.markdown(spark.createDataFrame([("x|y", 0.5)], "n string, v double")).splitlines()[2] == "| x\\|y | 0.5000 |"
    filled = relational.with_path_labels(spark.createDataFrame([("", "", "A --> p --> B")], "seed_label string, label string, path string")).first()
    assert (filled.seed_label, filled.label) == ("A", "B")
    kept = relational.by_availability(spark.createDataFrame([(1, "a", "b"), (2, "a", "z")], "row_id int, seed string, node string"), spark.createDataFrame([("a",), ("b",)], "node string"))
    assert {r.row_id: r.kept for r in kept.collect()} == {1: True, 2: False}


def test_analogies_probabilities_and_evidence(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", i % 2) for i in range(12)], "id long, seed string, target int")
    got = sampling.analogies(rows.filter("id < 2"), rows.filter("target = 1"), rows.filter("target = 0"), 2).collect()
    assert {(r.query, r.pattern, r.valid) for r in got} == {(0, "pk", False), (0, "pp", True), (1, "kk", True), (1, "kp", False)} and len(got) == 8
    forms = sampling.augmented(spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")).collect()
    assert {(r.form, r.a, r.b, r.c, r.d) for r in forms} == {("plain", 1, 2, 3, 4), ("symmetry", 3, 4, 1, 2), ("inner_symmetry", 2, 1, 4, 3), ("inner_symmetry_of_symmetry", 4, 3, 2, 1)}
    marked = spark.createDataFrame([(1, 2, 3, 4, True), (5, 6, 7, 8, False)], "a int, b int, c int, d int, valid boolean")
    own = lambda *a, **k: {(r.form, r.a, r.b, r.c, r.d) for r in sampling.augmented(marked, *a, **k).collect()}
    assert own(("reflexivity",), training=True) == {("plain", 1, 2, 3, 4), ("plain", 5, 6, 7, 8), ("reflexivity", 1, 2, 1, 2), ("reflexivity_of_second", 3, 4, 3, 4)}
    assert own(("reflexivity",)) == {("plain", 1, 2, 3, 4), ("plain", 5, 6, 7, 8)}
    with pytest.raises(ValueError):
        own(("relexivity",))
    good = spark.createDataFrame([("INCLUDE", 0.7, 0.3)], "classification string, p_include double, p_exclude double")
    assert classify.checked_probabilities(good).count() == 1
    with pytest.raises(Exception, match="do not fit"):
        classify.checked_probabilities(good.withColumn("p_exclude", F.lit(0.9))).collect()
    train = spark.createDataFrame([("row1", "x"), ("row2", "y")], "row_id string, node string")
    near = spark.createDataFrame([("q", "y", 0.1), ("q", "x", 0.5), ("q", "zz", 0.0)], "query string, other string, distance double")
    assert [(r.row_id, r.n) for r in relational.ordered_distances(train, near).orderBy("n").collect()] == [("row2", 1), ("row1", 2)]
    assert sinks.coverage(train.withColumnRenamed("node", "id"), spark.createDataFrame([("x",)], "id string")).first().missing == 1
    assert sinks.flat_metrics(spark.createDataFrame([("f1", 0.5)], "name string, value double")).first().f1 == 0.5
    votes = sampling.vote(spark.createDataFrame([(1, 10), (1, 11)], "query int, id int"), spark.createDataFrame([(10, 1), (11, 0)], "id int, label int"), 0.6)
    assert (votes.first().score, votes.first().prediction) == (0.5, 0)


def test_more_relations_and_branches_than_any_bound(spark):
    from arborix.operators import graph, sampling, traverse

    n = 10_500
    edges = spark.range(n).selectExpr("'a' AS src", "concat('p', id) AS pred", "concat('n', id) AS dst")
    assert graph.directed(edges, graph.relation_specs(edges)).count() == 2 * n
    seeds = spark.createDataFrame([("a",)], "node string")
    decided = edges.selectExpr("'a' AS seed", "dst AS node")
    predicates = edges.selectExpr("pred AS predicate")
    assert traverse.two_phase_bfs(edges, seeds, predicates, predicates, decided).filter("depth = 1").count() == n
    branches = spark.range(1_100).selectExpr("concat('b', id) AS branch")
    assert sampling.fold_assignments(branches).count() == 1_100 * 1_099


def test_shuffles_are_as_wide_as_the_tables(spark, monkeypatch):
    from arborix.operators import fixpoint

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    monkeypatch.setattr(fixpoint, "ROWS_A_TASK", 100)
    try:
        fixpoint.widen(spark, spark.range(700), spark.range(500))
        assert fixpoint.shuffle_width(spark) == 12
        fixpoint.widen(spark, spark.range(300))  # never lowered
        assert fixpoint.shuffle_width(spark) == 12
        assert fixpoint.settle_by(spark.range(50).withColumnRenamed("id", "k"), "k").groupBy("k").count().count() == 50
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_a_seeds_nodes_are_not_held_in_one_task(spark):
    from arborix.operators import graph

    edges = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("a", "p", "c")], "src string, pred string, dst string")
    members = spark.createDataFrame([("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("x", "a", None), ("x", "b", 1), ("x", "c", 1)], "seed string, node string, depth int")
    rows = graph.per_seed_subgraphs(edges, members)
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.seed, r.src, r.dst) for r in rows.collect()} == {("a", "a", "b"), ("a", "a", "c"), ("x", "a", "b"), ("x", "b", "c"), ("x", "a", "c")}
