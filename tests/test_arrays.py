"""Arrays in files: partitions are ranges, and whatever the range the same rows come out."""

import gzip
import json
import random

import numpy as np
import pytest

from arborix.sources import arrays


def test_npy_by_runs(spark, tmp_path):
    x = np.arange(3000, dtype=np.float32).reshape(1000, 3)
    np.save(tmp_path / "x.npy", x)
    found = arrays.read_npy(spark, f"file://{tmp_path}/x.npy", 10)
    assert found.rdd.getNumPartitions() == 100
    assert {r.position: r.vector for r in found.collect()} == {i: v for i, v in enumerate(x.astype(float).tolist())}
    some = arrays.read_npy(spark, str(tmp_path / "x.npy"), 10, columns=[2, 0], first=95, last=114)
    assert some.rdd.getNumPartitions() == 3 and {r.position: r.vector for r in some.collect()} == {i: [x[i, 2], x[i, 0]] for i in range(95, 115)}
    with gzip.open(tmp_path / "y.npy.gz", "wb") as f:
        np.save(f, x[:500].astype(np.int16))
    packed = arrays.read_npy(spark, f"file://{tmp_path}/y.npy.gz", first=490)
    assert packed.rdd.getNumPartitions() == 1 and [r.vector for r in packed.orderBy("position").collect()] == x[490:500].astype(float).tolist()
    assert arrays.read_npy(spark, f"file://{tmp_path}", 100).groupBy("file").count().orderBy("file").collect() == [("x", 1000), ("y", 500)]
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="two-dimensional"):
        arrays.read_npy(spark, f"file://{tmp_path}/cube.npy").collect()
    (tmp_path / "short.npy").write_bytes((tmp_path / "x.npy").read_bytes()[:-7])
    with pytest.raises(Exception, match="ends before"):
        arrays.read_npy(spark, f"file://{tmp_path}/short.npy").collect()


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000, 1 << 20])
def test_strings_at_any_cut(chunk, tmp_path):
    r = random.Random(chunk)
    values = ["", '"', "\\", '\\"', "a\\\\", "é👍", ", [", *("".join(r.choice('ab"\\,[] é') for _ in range(r.randrange(12))) for _ in range(60))]
    text = json.dumps(values, ensure_ascii=bool(chunk % 2)).replace('", "', '"  ,\n"', 3)
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    data = text.encode()
    got, before = [], 0
    with arrays.opened(str(tmp_path / "a.json")) as f:
        for run in arrays._ranges(str(tmp_path / "a.json"), chunk):
            run.before = before
            got += list(arrays.strings(f, run))
            before += len(arrays.quotes(data[run.begin : run.end], data[: run.begin]))
    assert got == list(enumerate(values))


def test_string_arrays_in_spark(spark, tmp_path):
    values = [f'n{i}"\\' for i in range(500)]
    (tmp_path / "a.json").write_text(json.dumps(values))
    found = arrays.read_strings(spark, f"file://{tmp_path}/a.json", 100)
    assert found.rdd.getNumPartitions() > 50 and {r.position: r.value for r in found.collect()} == dict(enumerate(values))
    some = arrays.read_strings(spark, f"file://{tmp_path}/a.json", 100, first=250, last=260)
    assert some.rdd.getNumPartitions() < 6 and sorted(r.value for r in some.collect()) == values[250:261]
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        json.dump(values, f)
    (tmp_path / "c.json").write_text(" [ ]\n")
    assert arrays.read_strings(spark, f"file://{tmp_path}", 64).groupBy("file").count().orderBy("file").collect() == [("a", 500), ("b", 500)]
    for wrong in ('["a" "b"]', '["a", 3, "b"]', '["a', '"a"]', '["a", null]'):
        (tmp_path / "bad.json").write_text(wrong)
        with pytest.raises(Exception, match="needed|end"):
            arrays.read_strings(spark, f"file://{tmp_path}/bad.json").collect()
