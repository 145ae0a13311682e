"""Folds over a log: the stream, restarted between files, says what the windows say over all of them."""

import json
import random
from datetime import datetime, timedelta, timezone

from arborix.streaming import attempts

SCHEMA = "run string, id long, ts timestamp, status string, cost double"
START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def log(n=240):
    r = random.Random(9)
    rows = []
    for i in range(n):
        rows.append({"run": f"r{r.randrange(12)}", "id": i, "ts": (START + timedelta(seconds=10 * i)).isoformat(), "status": "error" if r.random() < 0.02 else "ok", "cost": r.choice([0.1, 0.4, None])})
    return rows


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def run_stream(spark, build, source, schema, sink, checkpoint):
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{source}"))
    query = stream.writeStream.format("parquet").option("path", f"file://{sink}").option("checkpointLocation", f"file://{checkpoint}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_guard_stream_with_restarts(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", attempts.ROCKS)
    try:
        rows = log()
        for k in range(3):
            write(tmp_path / "log", str(k), rows[k * 80 : k * 80 + 80])
            run_stream(spark, lambda s: attempts.stream_guard(s, 2.0, 1500.0), tmp_path / "log", SCHEMA, tmp_path / "out", tmp_path / "cp")
        # a late row of another run moves the watermark past all times, so timers end what is left
        write(tmp_path / "log", "9", [{"run": "z", "id": 999, "ts": (START + timedelta(days=1)).isoformat(), "status": "ok", "cost": 0.0}])
        run_stream(spark, lambda s: attempts.stream_guard(s, 2.0, 1500.0), tmp_path / "log", SCHEMA, tmp_path / "out", tmp_path / "cp")
        write(tmp_path / "log", "99", [{"run": "z", "id": 1000, "ts": (START + timedelta(days=1, seconds=1)).isoformat(), "status": "ok", "cost": 0.0}])
        run_stream(spark, lambda s: attempts.stream_guard(s, 2.0, 1500.0), tmp_path / "log", SCHEMA, tmp_path / "out", tmp_path / "cp")
        got = {r.run: (r.reason, round(r.spent, 6), r.attempts) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    expected, refused, state = {}, set(), {}
    for row in rows + [{"run": f"r{i}", "ts": (START + timedelta(days=1)).isoformat(), "cost": None, "status": "ok"} for i in range(12)]:
        at = datetime.fromisoformat(row["ts"])
        start, spent, n, failed = state.get(row["run"], (at, 0.0, 0, False))
        if row["run"] in expected:
            continue
        reason = "error" if failed else "spend" if spent >= 2.0 else "time" if (at - start).total_seconds() >= 1500 else None
        if reason:
            expected[row["run"]] = (reason, round(spent, 6), n)
            refused |= {row["run"]} if "id" in row else set()
        else:
            state[row["run"]] = (start, spent + (row["cost"] or 0), n + 1, row["status"] != "ok")
    assert got == expected and {v[0] for v in got.values()} == {"spend", "time", "error"}
    table = spark.read.schema(SCHEMA).json(f"file://{tmp_path}/log").filter("run <> 'z'")
    held = {r.run: (r.reason, round(r.spent, 6), r.attempts) for r in attempts.guard(table, 2.0, 1500.0).collect()}
    assert {k: v for k, v in held.items() if v[0]} == {k: v for k, v in expected.items() if k in refused}


def test_jobs_stream_and_table(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", attempts.ROCKS)
    schema = "job string, id long, ts timestamp, status string"
    at = lambda s: (START + timedelta(seconds=s)).isoformat()
    first = [("a", 1, 0, "submitted"), ("b", 2, 1, "submitted"), ("a", 3, 5, "running"), ("c", 4, 6, "submitted")]
    second = [("a", 5, 20, "running"), ("a", 6, 30, "succeeded"), ("a", 7, 31, "running"), ("b", 8, 32, "running")]
    try:
        for k, rows in enumerate((first, second, [("z", 9, 4000, "submitted")], [("z", 10, 4001, "submitted")])):
            write(tmp_path / "polls", str(k), [dict(zip(("job", "id", "ts", "status"), (j, i, at(s), w))) for j, i, s, w in rows])
            run_stream(spark, lambda s: attempts.stream_jobs(s, 600.0), tmp_path / "polls", schema, tmp_path / "out", tmp_path / "cp")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    rows = sorted((r.job, r.polls, r.status) for r in spark.read.parquet(f"file://{tmp_path}/out").filter("job <> 'z'").collect())
    assert rows == [("a", 1, "submitted"), ("a", 2, "running"), ("a", 4, "succeeded"), ("b", 1, "submitted"), ("b", 2, "running"), ("b", 2, "stalled"), ("c", 1, "stalled"), ("c", 1, "submitted")]
    table = spark.read.schema(schema).json(f"file://{tmp_path}/polls").filter("job <> 'z'")
    assert {r.job: (r.status, r.polls) for r in attempts.job_states(table, at(4000), 600.0).collect()} == {"a": ("succeeded", 4), "b": ("stalled", 2), "c": ("stalled", 1)}
