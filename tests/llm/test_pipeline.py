"""The pipeline's stages on a small table, each held against what it must do."""

import random

import __spark_entry__ as entry
import corpus_pipeline
import pytest

SMALL = "/root/testdata/sf0.001"


def test_stages_run_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near duplicates", "repeated passages", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert now <= ids and now
        ids = now
        if k < 4:
            assert docs.columns == columns
    assert docs.filter("offset + length > 2048").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_and_null_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    name, run = corpus_pipeline.STAGES[stage]
    assert run(spark, spark.createDataFrame([], schema), SMALL).count() == 0
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "a b", None, None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], schema)
    out = run(spark, rows, SMALL)
    assert out.count() == {"toxicity": 4, "quality rules": 0, "near duplicates": 3, "repeated passages": 4, "packing": 4}[name]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_clashing_columns_and_ids_with_several_texts(spark, stage):
    draw = random.Random(3)
    some = lambda k: " ".join(f"w{draw.getrandbits(30):x}" for _ in range(k))
    a, b, long = some(80), some(90), some(20_000)
    texts = [(1, a), (1, b), (2, f"{a} {some(60)}"), (2, some(3)), (3, b), (3, b), (4, long), (5, long + " end"), (None, a), (6, None), (6, "")]
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", "stats string", "_stats int", "unit long", "_unit int", "spans string", "_w int", "score double", "component_id long"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", k, k, k, "y", k, 0.5, k) for k, (i, t) in enumerate(texts)], ", ".join(names))
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, SMALL)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None} and all(r.offset + r.length <= 2048 for r in rows)
        assert sum(r.length for r in rows if r.doc_id == 4) == next(r.doc_tokens for r in rows if r.doc_id == 4)
        return
    assert out.columns == docs.columns and {r.stats for r in rows} <= {"x"} and all(r._stats == r.unit == r._w == r._unit for r in rows)
    given = {k: (i, t) for k, (i, t) in enumerate(texts)}
    kept = {r._w: (r.doc_id, (r.text or "").strip()) for r in rows}
    if name == "repeated passages":
        assert kept[2] == (2, texts[2][1].removeprefix(a).strip()) and kept[4] == kept[5] == (3, "") and kept[7] == (5, "end") and kept[0] == (1, a) and kept[6] == (4, long)
    elif name == "near duplicates":
        # 4 and 5 are alike, and 3 has a text of 1; an id stays with all its texts if it is the least of their groups
        assert {i for i, _ in kept.values()} == {1, 2, 4, 6, None}
    else:
        assert all(given[k] == (i, given[k][1]) for k, (i, _) in kept.items()) and ({*kept} == {*given} if name == "toxicity" else 9 not in kept and 3 not in kept)


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {x.split("_")[0] for x in names if x.startswith("op")} >= {f"op{i}" for i in range(1, 14)}


def test_near_duplicates_shuffle_texts_of_repeated_ids_alone(spark, monkeypatch):
    """Rows of ids that occur once go through without a grouping by text; what is kept is that of grouping all rows."""
    words = [" ".join(f"w{(i * k) % 83}" for k in range(20)) for i in range(40)]
    rows = [(i, x) for i, x in enumerate(words)] + [(50 + i, words[i]) for i in range(5)] + [(7, words[7]), (7, words[9]), (8, None), (8, None), (None, words[1]), (60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    run = dict(corpus_pipeline.STAGES)["near duplicates"]
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    found = run(spark, docs, SMALL)
    assert " > 1)" in found._jdf.queryExecution().optimizedPlan().toString()
    kept = sorted(map(tuple, found.collect()), key=order)
    ids = [x[0] for x in kept]
    assert ids.count(7) == 2 and ids.count(8) == 2 and ids.count(None) == 1 and ids.count(60) == 1 and not {50, 51, 52, 53, 54} & set(ids)
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, run(spark, docs, SMALL).collect()), key=order) == kept
