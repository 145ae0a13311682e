"""Queries of samples, folds, messages, row identity and neighbours, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions.vectors import euclidean, fit_path
from arborix.operators import classify, metrics, relational, sampling, traverse
from arborix.operators.fixpoint import shared_folder
from arborix.sources import arrays, records, tables

from . import batch_jobs
from . import driver_graph as g

J = g.JUDGED_SQL


def turns(spark: SparkSession, d: str) -> DataFrame:
    return g.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", F.regexp_replace("text", r"\s+", " ")).alias("line"))


def message_rows(spark: SparkSession, d: str) -> DataFrame:
    batched = classify.batches(turns(spark, d), ["turn", "line"], 2, ["conv_id"])
    return classify.messages(batched, "line", ["conv_id"]).select("conv_id", "batch", F.md5("message").alias("message"))


MESSAGES_SQL = """WITH t AS (SELECT conv_id, turn, role || ': ' || regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS line FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) - 1 AS n FROM t)
SELECT conv_id, (n // 2)::BIGINT AS batch, md5(string_agg((n % 2 + 1) || '. ' || line, chr(10) ORDER BY n)) AS message FROM n GROUP BY conv_id, n // 2"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Index joins: item 3 of a batch has no answer and item 5 has two."""
    rows = classify.batches(g.table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"], 20)
    batch = rows.select(F.col("batch").alias("key"), "idx", "c_custkey", "c_acctbal")
    got = batch.filter("idx <> 3").select("key", "idx", F.when(F.col("c_acctbal") > 0, "INCLUDE").otherwise("EXCLUDE").alias("classification"))
    return tables.match_answers(batch, got.unionByName(got.filter("idx = 5")), ["key"]).select("c_custkey", "prediction", "matched")


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """Result lines as providers send them, made from suppliers: every seventh is an error, the others wrap JSON in words."""
    body = F.concat(F.lit('{"evaluations":[{"idx":1,"classification":"'), F.when(F.col("s_acctbal") > 0, "INCLUDE").otherwise("EXCLUDE"), F.lit('","confidence":0.5}]}'))
    wrapped = F.concat(F.lit("Here you are: "), body, F.lit(" That is all."))
    line = F.when(F.col("s_suppkey") % 7 == 0, F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("key"), F.lit("quota").alias("error")))).otherwise(F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("key"), F.struct(wrapped.alias("text")).alias("response"))))
    return tables.recorded_answers(g.table(spark, d, "supplier").select(line.alias("value")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return g.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return sampling.nearest(rows.filter("id % 20 = 0").select(F.col("id").alias("query"), "vector"), rows, 5)


NEAR_SQL = """near AS (SELECT q.vec_id AS query, p.vec_id AS id, list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), p.vec_id) AS n
  FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id QUALIFY n <= 5)"""


def votes(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return sampling.vote(neighbours(spark, d), rows.select("id", (F.col("label") % 2).alias("label"))).select("query", "votes", F.round("score", 6).alias("score"), "prediction")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """Paths of three nodes by key, dropped where one has no vector, fitted to length four."""
    rows = vectors(spark, d)
    paths = rows.select(F.col("id").alias("key"), F.array("id", F.col("id") + 1, F.col("id") + 100000 * (F.col("id") % 3 == 0).cast("int")).alias("nodes"))
    found = traverse.embedding_sequences(paths, rows.filter("id % 11 <> 0").select(F.col("id").alias("node"), "vector"))
    fitted = fit_path(F.col("sequence"), 4, F.array(F.lit(0.0)), "between")
    return found.select("key", F.size(fitted).cast("long").alias("length"), F.round(F.element_at(F.element_at(fitted, 1), 1), 6).alias("first"), F.round(F.element_at(F.element_at(fitted, 2), 1), 6).alias("second"), F.round(F.element_at(F.element_at(fitted, 4), 1), 6).alias("last"))


def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = g.judged(spark, d)
    return sampling.references(rows.filter("row_id % 20 = 0").select(F.col("row_id").alias("query"), F.col("property").alias("group"), "seed"), rows.select(F.col("row_id").alias("reference"), F.col("property").alias("group"), "seed"), 3, other_seed=True)


def _turn(i: int) -> str:
    """Round ``i`` of the permutation of ``sampling.permuted`` in SQL."""
    return f"f{i + 1} AS (SELECT * EXCLUDE (l, r), r AS l, xor(l, ('0x' || substr(md5(concat_ws('|', '42', query, '{i}', r)), 1, 8))::BIGINT % side) AS r FROM f{i})"


#: Every query draws all places of its group's domain in turn.
REFERENCES_SQL = f"""WITH {J}, pool AS (SELECT row_id AS reference, property, seed, row_number() OVER (PARTITION BY property ORDER BY row_id, seed) - 1 AS place FROM judged),
sizes AS (SELECT property, count(*) AS size, (1::BIGINT << greatest(1, (length(bin(count(*) - 1)) + 1) // 2)) AS side FROM judged GROUP BY property),
f0 AS (SELECT row_id AS query, property, seed, size, side, i, i // side AS l, i % side AS r FROM judged JOIN sizes USING (property), LATERAL (SELECT unnest(range(side * side)) AS i) WHERE row_id % 20 = 0),
{', '.join(map(_turn, range(4)))},
d AS (SELECT query, reference, i FROM f4 f JOIN pool p ON p.property = f.property AND p.place = f.l * side + f.r WHERE query <> reference AND f.seed <> p.seed)
SELECT query, reference, row_number() OVER (PARTITION BY query ORDER BY i) AS n FROM d QUALIFY n <= 3"""


def edge_split(spark: SparkSession, d: str) -> DataFrame:
    """Customers and the priorities of their orders as a graph, a third of its pairs held out."""
    rows = g.table(spark, d, "orders").select(g.node("customer", "o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"))
    return sampling.split_edges(rows, 0.34).distinct()


#: Turn by turn: a pair is held out if both its ends have more than one left among those not held out before.
EDGE_SPLIT_SQL = """WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT 'customer/' || o_custkey AS src, o_orderpriority AS dst FROM orders),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5('42|' || least(src, dst) || '~' || greatest(src, dst)), least(src, dst)) AS i, count(*) OVER (PARTITION BY src) AS ds, count(*) OVER (PARTITION BY dst) AS dd FROM p),
walk(i, src, dst, taken) USING KEY (i) AS (SELECT 0::BIGINT, '', '', FALSE
  UNION SELECT o.i, o.src, o.dst, ds - (SELECT count(*) FROM recurring.walk r WHERE r.taken AND r.src = o.src) > 1 AND dd - (SELECT count(*) FROM recurring.walk r WHERE r.taken AND r.dst = o.dst) > 1
        FROM (SELECT max(i) AS i FROM walk) w JOIN o ON o.i = w.i + 1)
SELECT src, dst, taken AND row_number() OVER (PARTITION BY taken ORDER BY i) <= round_even((SELECT count(*) FROM p) * 0.34, 0) AS held_out FROM walk WHERE i > 0"""


def stored_arrays(spark: SparkSession, d: str) -> DataFrame:
    """All vectors as NPY parts and their ids as JSON arrays beside them, read again by runs and put together by place."""
    folder = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    arrays.write_arrays(vectors(spark, d).filter("vector IS NOT NULL").select("id", "vector"), folder).count()
    found = arrays.read_npy(spark, folder, 500, [0, 63])
    names = arrays.read_strings(spark, folder, 1 << 16)
    value = lambda i: F.round(F.element_at("vector", i), 6)
    return names.join(found, ["file", "position"]).select(F.col("value").cast("long").alias("id"), value(1).alias("first"), value(2).alias("last"))


def picked(spark: SparkSession, d: str) -> DataFrame:
    rows = g.judged(spark, d).select(F.concat(F.lit("row"), "row_id").alias("row_id"), F.concat_ws("|", "seed", "property").alias("legacy_row_id"))
    wanted = g.judged(spark, d).filter("row_id % 50 = 0").select(F.concat(F.lit("row"), "row_id").alias("row_id")).unionByName(rows.select(F.col("legacy_row_id").alias("row_id")).distinct()).unionByName(spark.createDataFrame([("none",)], "row_id string"))
    return relational.pick_rows(rows, wanted)


def batch_score(spark: SparkSession, d: str) -> DataFrame:
    """A whole offline batch over nations and suppliers: requests, results as a provider sends them, gating, metrics."""
    of = g.table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("region/"), "n_regionkey").alias("seed"))
    top = of.select(F.col("n_nationkey").alias("row_index"), "seed", g.node("nation", "n_nationkey").alias("node"), F.lit("").alias("parent"), (F.col("n_nationkey") % 4 != 0).alias("keep"), (F.col("n_nationkey") % 5 != 0).cast("int").alias("target"))
    low = g.table(spark, d, "supplier").join(of, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") + 100).alias("row_index"), "seed", g.node("supplier", "s_suppkey").alias("node"), g.node("nation", "s_nationkey").alias("parent"), (F.col("s_acctbal") > 0).alias("keep"), (F.col("s_acctbal") > 1000).cast("int").alias("target"))
    rows = top.unionByName(low).withColumn("row_id", F.concat(F.lit("row"), "row_index")).withColumn("evidence", F.col("node"))
    _, manifest = batch_jobs.prepare(rows, "d1", "judge", 10)
    answered = manifest.join(rows.select("row_id", "keep"), "row_id").filter("row_id NOT LIKE '%7'")
    item = F.struct("idx", F.when(F.col("keep"), "INCLUDE").otherwise("EXCLUDE").alias("classification"), F.lit(0.9).alias("confidence"))
    results = answered.groupBy("key").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("evaluations"))).alias("text")).select(F.to_json(F.struct("key", F.struct("text").alias("response"))).alias("value"))
    out = batch_jobs.score(rows, batch_jobs.predictions(results, manifest))
    return out.select("view", "rows", "tp", "fp", "tn", "fn", "unmatched", F.round("f1", 6).alias("f1"))


BATCH_SQL = """WITH n AS (SELECT n_nationkey, n_nationkey % 5 <> 0 AS good, CASE WHEN n_nationkey::VARCHAR NOT LIKE '%7' THEN n_nationkey % 4 <> 0 END AS raw FROM nation),
s AS (SELECT s_acctbal > 1000 AS good, CASE WHEN (s_suppkey + 100)::VARCHAR NOT LIKE '%7' THEN s_acctbal > 0 END AS raw, coalesce(n.raw, FALSE) AS open FROM supplier JOIN n ON s_nationkey = n_nationkey),
v AS (SELECT 'gated' AS view, good, coalesce(raw, FALSE) AS p FROM n UNION ALL SELECT 'gated', good, open AND coalesce(raw, FALSE) FROM s UNION ALL SELECT 'ungated', good, raw FROM n UNION ALL SELECT 'ungated', good, raw FROM s),
c AS (SELECT view, count(*) AS rows, count(*) FILTER (good AND p) AS tp, count(*) FILTER (NOT good AND p) AS fp, count(*) FILTER (NOT good AND NOT p) AS tn, count(*) FILTER (good AND NOT p) AS fn, count(*) FILTER (p IS NULL) AS unmatched FROM v GROUP BY view)
SELECT *, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c"""

_DRAW = lambda *c: f"md5(concat_ws('|', '42', {', '.join(c)}))"

def distances(spark: SparkSession, d: str) -> DataFrame:
    """Training rows in the order of their distance from each query; rows that no query has a distance to drop out."""
    train = vectors(spark, d).filter("label % 2 = 0").select(F.col("id").alias("node"), F.concat(F.lit("row"), "id").alias("row_id"))
    found = relational.ordered_distances(train, neighbours(spark, d).select("query", F.col("id").alias("other"), "distance"))
    return found.select("query", "row_id", F.round("distance", 6).alias("distance"), "n")


DISTANCES_SQL = f"""WITH {NEAR_SQL} SELECT query, 'row' || id AS row_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, 'row' || id) AS n
FROM near JOIN embeddings e ON e.vec_id = near.id WHERE e.label % 2 = 0"""

QUERIES: dict = {
    "ordered_distances": (distances, DISTANCES_SQL),
    "integer_ids": (lambda s, d: records.integer_ids(g.nodes(s, d)), f"WITH {g.NODES_SQL} SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM nodes"),
    "required_ids": (lambda s, d: records.required_ids(g.table(s, d, "events").select("props", "event_type"), ["props", "event_type"], "[0-9]+"), "SELECT DISTINCT unnest(regexp_extract_all(props || event_type, '[0-9]+')) AS id FROM events"),
    "missing_runs": (lambda s, d: records.missing_runs(g.judged(s, d).filter("row_id % 2 = 0").select("seed", "property"), g.judged(s, d).select("seed", "property"), ["seed", "property"]), f"WITH {J} SELECT DISTINCT seed, property FROM judged EXCEPT SELECT seed, property FROM judged WHERE row_id % 2 = 0"),
    "rows_in_pairs": (lambda s, d: relational.rows_in_pairs(g.judged(s, d).select("row_id", F.when(F.col("row_id") % 2 == 0, F.col("seed")).otherwise("").alias("seed"), F.col("property").alias("node"), F.concat_ws("|", "seed", "property").alias("legacy_row_id")), g.judged(s, d).filter("score > 0.9").select("seed", F.col("property").alias("node"))).select("row_id", "seed"), f"WITH {J} SELECT row_id, seed FROM judged WHERE (seed, property) IN (SELECT (seed, property) FROM judged WHERE score > 0.9)"),
    "filtered_rows": (lambda s, d: relational.filter_rows(g.judged(s, d).withColumn("seed_label", F.upper("seed")), "Src3", g.judged(s, d).filter("row_id % 3 = 0")).select("row_id"), f"WITH {J} SELECT row_id FROM judged WHERE seed = 'src3' AND row_id % 3 <> 0"),
    "best_configurations": (lambda s, d: relational.best_configurations(metrics.confusion(g.judged(s, d), ["fold", "property"]).withColumn("configuration", F.col("property")).withColumn("parameters", F.length("property") + F.ascii("property")), ["fold"]).select("fold", "configuration", F.round("f1", 6).alias("f1")), f"""WITH {J}, c AS (SELECT fold, property, count(*) FILTER (target = 1 AND prediction = 1)::DOUBLE AS tp, count(*) FILTER (target = 0 AND prediction = 1)::DOUBLE AS fp, count(*) FILTER (target = 1 AND prediction = 0)::DOUBLE AS fn FROM judged GROUP BY fold, property),
m AS (SELECT fold, property, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
SELECT fold, property AS configuration, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, p DESC, r DESC, length(property) + ascii(property)) = 1"""),
    "identity_errors": (lambda s, d: relational.identity_errors(g.judged(s, d), g.judged(s, d).withColumn("target", F.when(F.col("row_id") % 7 == 0, F.lit(None)).otherwise(F.col("target"))), "row_id", ["seed", "target", "prediction"]), f"WITH {J} SELECT row_id, 'target' AS column FROM judged WHERE row_id % 7 = 0"),
    "batch_score": (batch_score, BATCH_SQL),
    "evidence_messages": (message_rows, MESSAGES_SQL),
    "answer_matching": (answers, "WITH n AS (SELECT *, (row_number() OVER (ORDER BY c_custkey) - 1) % 20 + 1 AS idx FROM customer) SELECT c_custkey, CASE WHEN idx NOT IN (3, 5) THEN CAST(c_acctbal > 0 AS INT) END AS prediction, CASE WHEN idx IN (3, 5) THEN 'NO_MATCH' ELSE 'MATCHED' END AS matched FROM n"),
    "recorded_answers": (parsed, "SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 7 <> 0 THEN 1 END AS idx, CASE WHEN s_suppkey % 7 <> 0 THEN CASE WHEN s_acctbal > 0 THEN 'INCLUDE' ELSE 'EXCLUDE' END END AS classification, CASE WHEN s_suppkey % 7 <> 0 THEN 0.5::DOUBLE END AS confidence, CASE WHEN s_suppkey % 7 = 0 THEN 'quota' END AS error FROM supplier"),
    "chunked_requests": (lambda s, d: classify.request_lines(classify.messages(classify.batches(g.table(s, d, "part").select("p_partkey", "p_name"), ["p_partkey"], 20), "p_name", []), "parts", "judge").select(F.get_json_object("value", "$.key").alias("key"), F.md5(F.get_json_object("value", "$.request.user")).alias("message")), "WITH n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part) SELECT 'parts_batch' || lpad((n // 20)::VARCHAR, 6, '0') AS key, md5(string_agg((n % 20 + 1) || '. ' || p_name, chr(10) ORDER BY n)) AS message FROM n GROUP BY n // 20"),
    "balanced_sample": (lambda s, d: sampling.balanced(g.judged(s, d), 60).select("row_id", "target"), f"WITH {J}, r AS (SELECT *, {_DRAW('row_id')} AS draw, row_number() OVER (PARTITION BY target ORDER BY {_DRAW('row_id')}, row_id) AS n FROM judged) SELECT row_id, target FROM r ORDER BY CAST(n > 30 AS INT), draw, row_id LIMIT 60"),
    "diverse_sample": (lambda s, d: sampling.round_robin(g.judged(s, d), 45, ["seed"]).select("row_id", "seed"), f"WITH {J}, r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {_DRAW('row_id')}, row_id) AS n, {_DRAW('seed')} AS b FROM judged) SELECT row_id, seed FROM r ORDER BY n, b, seed LIMIT 45"),
    "contrastive_sample": (lambda s, d: sampling.contrastive(g.judged(s, d), 20, 12, "seed").select("row_id", "seed", "target"), f"""WITH {J}, k AS (SELECT seed, count(DISTINCT target) AS kinds FROM judged GROUP BY seed), r AS (SELECT j.*, CAST(kinds < 2 AS INT) AS late, row_number() OVER (PARTITION BY j.seed, target ORDER BY {_DRAW('row_id')}, row_id) AS n FROM judged j JOIN k USING (seed)),
p AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY late, n, seed, row_id) AS place FROM r) SELECT row_id, seed, target FROM p WHERE place <= CASE WHEN target = 1 THEN 20 ELSE 12 END"""),
    "seed_folds": (lambda s, d: sampling.folds(g.judged(s, d), 5), f"WITH {J}, s AS (SELECT DISTINCT seed FROM judged) SELECT seed, (ntile(5) OVER (ORDER BY {_DRAW('seed')}, seed) - 1)::BIGINT AS fold FROM s"),
    "fold_assignments": (lambda s, d: sampling.fold_assignments(g.table(s, d, "region").select(F.col("r_name").alias("branch"))).select("test", "validation", F.array_join("training", ",").alias("training")), "SELECT a.r_name AS test, b.r_name AS validation, (SELECT string_agg(c.r_name, ',' ORDER BY c.r_name) FROM region c WHERE c.r_name <> a.r_name AND c.r_name <> b.r_name) AS training FROM region a, region b WHERE a.r_name <> b.r_name"),
    "drawn_references": (reference_rows, REFERENCES_SQL),
    "stored_arrays": (stored_arrays, "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings WHERE embedding IS NOT NULL"),
    "edge_split": (edge_split, EDGE_SPLIT_SQL),
    "nearest_neighbours": (lambda s, d: neighbours(s, d).select("query", "id", F.round("distance", 6).alias("distance"), "n"), f"WITH {NEAR_SQL} SELECT query, id, round(distance, 6) AS distance, n FROM near"),
    "neighbour_vote": (votes, f"WITH {NEAR_SQL} SELECT query, count(*) AS votes, round(avg(label % 2), 6) AS score, CAST(avg(label % 2) >= 0.5 AS BIGINT) AS prediction FROM near JOIN embeddings ON vec_id = id GROUP BY query"),
    "embedding_sequences": (sequences, """WITH e AS (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings WHERE vec_id % 11 <> 0) SELECT a.vec_id AS key, 4::BIGINT AS length, a.x AS first, 0.0::DOUBLE AS second, c.x AS last
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + CASE WHEN a.vec_id % 3 = 0 THEN 100000 ELSE 0 END"""),
    "vector_distances": (lambda s, d: vectors(s, d).select(F.col("id").alias("a"), F.col("vector").alias("v")).join(vectors(s, d).select((F.col("id") - 1).alias("a"), "vector"), "a").select("a", F.round(euclidean(F.col("v"), F.col("vector")), 6).alias("distance")), "SELECT a.vec_id AS a, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "first_decisions": (lambda s, d: relational.first_rows(g.judged(s, d).withColumn("row_index", F.col("row_id")), ["seed", "property"]).select("seed", "property", "row_id"), f"WITH {J} SELECT seed, property, min(row_id) AS row_id FROM judged GROUP BY seed, property"),
    "last_decisions": (lambda s, d: relational.last_rows(g.judged(s, d).withColumn("row_index", F.col("row_id")), ["seed", "property"]).select("seed", "property", "row_id"), f"WITH {J} SELECT seed, property, max(row_id) AS row_id FROM judged GROUP BY seed, property"),
    "picked_rows": (picked, f"""WITH {J}, r AS (SELECT 'row' || row_id AS row_id, seed || '|' || property AS legacy FROM judged), w AS (SELECT 'row' || row_id AS asked FROM judged WHERE row_id % 50 = 0 UNION ALL SELECT DISTINCT legacy FROM r UNION ALL SELECT 'none'), l AS (SELECT legacy, count(*) AS n, min(row_id) AS one FROM r GROUP BY legacy)
SELECT asked, coalesce(r.row_id, CASE WHEN n = 1 THEN one END) AS row_id, CASE WHEN r.row_id IS NOT NULL OR n = 1 THEN NULL WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS problem FROM w LEFT JOIN r ON r.row_id = asked LEFT JOIN l ON l.legacy = asked"""),
    "alignment_check": (lambda s, d: relational.misaligned(g.judged(s, d).filter("row_id % 9 <> 0"), g.judged(s, d).filter("row_id % 8 <> 0").withColumn("target", F.when(F.col("row_id") % 5 == 0, 1 - F.col("target")).otherwise(F.col("target"))), ["seed", "target"]), f"WITH {J} SELECT row_id, CASE WHEN row_id % 9 = 0 THEN 'missing' WHEN row_id % 8 = 0 THEN 'unknown' ELSE 'different' END AS problem FROM judged WHERE (row_id % 9 = 0) <> (row_id % 8 = 0) OR (row_id % 9 <> 0 AND row_id % 8 <> 0 AND row_id % 5 = 0)"),
    "absent_rows": (lambda s, d: relational.absent(g.judged(s, d).select("row_id", "seed", F.col("property").alias("node")), g.judged(s, d).filter("seen").select(F.explode(F.array("seed", "property")).alias("node"))), f"WITH {J}, k AS (SELECT seed AS node FROM judged WHERE seen UNION SELECT property FROM judged WHERE seen) SELECT row_id, seed IN (SELECT node FROM k) AND property IN (SELECT node FROM k) AS present FROM judged"),
    "strict_nesting": (lambda s, d: relational.strictly_nested(g.table(s, d, "nation").select(F.explode(F.array(F.lit(4), F.lit(8), F.lit(12))).alias("size"), F.col("n_nationkey").alias("item")).filter("item < size")), "SELECT 4 AS size, 8 AS next_size, 0::BIGINT AS missing UNION ALL SELECT 8, 12, 0"),
    "row_error_classes": (lambda s, d: g.judged(s, d).select("row_id", metrics.error_kind(F.col("target"), F.col("prediction")).alias("kind")), f"WITH {J} SELECT row_id, CASE WHEN prediction IS NULL THEN 'unmatched' WHEN target = 1 AND prediction = 0 THEN 'fn' WHEN target = 0 AND prediction = 1 THEN 'fp' ELSE 'correct' END AS kind FROM judged"),
}
