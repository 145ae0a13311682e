"""Stages: what is published stays, what was killed is redone, what changed is made anew."""

import pytest
from pyspark.sql import functions as F

from arborix.plans import stages

MADE = []


def numbers(spark, tables, settings):
    MADE.append("numbers")
    return spark.read.parquet(settings["path"])


def doubled(spark, tables, settings):
    MADE.append("doubled")
    if settings.get("fail"):
        return tables["numbers"].select(F.raise_error(F.lit("killed")).alias("x"))
    return tables["numbers"].select((F.col("id") * settings["by"]).alias("x"))


def plan(path, by=2, fail=False, audit=None):
    return [stages.Stage("numbers", numbers, (), (path,), {"path": path}, stages.not_empty), stages.Stage("doubled", doubled, ("numbers",), (), {"by": by, **({"fail": True} if fail else {})}, audit)]


def test_stages_resume(spark, tmp_path):
    MADE.clear()
    path = f"file://{tmp_path}/in"
    spark.range(10).write.parquet(path)
    store = stages.StageStore(spark, f"file://{tmp_path}/store")
    state = lambda p: {r.stage: r.status for r in store.status(p).collect()}
    assert state(plan(path)) == {"numbers": "none", "doubled": "none"}
    with pytest.raises(Exception, match="killed"):
        store.run(plan(path, fail=True))
    assert state(plan(path, fail=True)) == {"numbers": "published", "doubled": "failed"} and MADE == ["numbers", "doubled"]
    with pytest.raises(ValueError, match="not published"):
        store.export(plan(path, fail=True), f"file://{tmp_path}/out")
    assert sorted(r.x for r in store.run(plan(path))["doubled"].collect()) == list(range(0, 20, 2)) and MADE == ["numbers", "doubled", "doubled"]
    store.run(plan(path))
    assert MADE == ["numbers", "doubled", "doubled"]
    assert store.run(plan(path, by=3))["doubled"].agg(F.sum("x")).first()[0] == 135 and MADE[3:] == ["doubled"]
    # an attempt without a marker, as a killed driver leaves it, is never read
    prints = store.fingerprints(plan(path, by=5))
    spark.range(3).select(F.col("id").alias("x")).write.parquet(f"file://{tmp_path}/store/doubled/{prints['doubled']}/attempt-dead")
    assert state(plan(path, by=5))["doubled"] == "begun"
    assert store.run(plan(path, by=5))["doubled"].count() == 10
    assert store.sweep() >= 1 and store.run(plan(path, by=5))["doubled"].count() == 10
    with pytest.raises(stages.AuditError, match="repeated"):
        store.run(plan(path, by=0, audit=stages.unique("x")))
    assert state(plan(path, by=0, audit=stages.unique("x")))["doubled"] == "failed"
    store.export(plan(path), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/doubled").count() == 10 and (tmp_path / "out/manifest.json").exists()
    # other input, other fingerprints: all is made anew
    spark.range(4).write.mode("overwrite").parquet(path)
    made = len(MADE)
    assert store.run(plan(path))["doubled"].count() == 4 and MADE[made:] == ["numbers", "doubled"]
    with pytest.raises(ValueError, match="needs"):
        store.run(plan(path)[1:])
    with pytest.raises(ValueError, match="two stages"):
        store.run(plan(path) + plan(path))
