"""Resumable runs: stages whose tables are kept by a fingerprint of all that they depend on.

A stage's fingerprint is the hash of its name, settings, code, input files (path, length, time of change) and of the fingerprints of
the stages that it needs. Its table is written to a folder of its own attempt, audited, and published by a marker that is renamed
into place and names the attempt; what has no marker doesn't exist for readers. A run that is begun again takes published stages as
they are and does the others; attempts of killed runs are never read. A changed setting gives other fingerprints from that stage on, and the
tables of earlier ones stay.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]
STATUS = "stage string, fingerprint string, status string, rows long, seconds double, attempts long, error string"


@dataclass(frozen=True)
class Stage:
    """``run(spark, tables of the stages in needs, settings)`` gives the stage's table; ``audit`` what is wrong with it, or None."""

    name: str
    run: Run
    needs: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)
    audit: Callable[[DataFrame], str | None] | None = None


class AuditError(RuntimeError):
    pass


def not_empty(table: DataFrame) -> str | None:
    return None if table.limit(1).count() else "the table is empty"


def unique(*columns: str) -> Callable[[DataFrame], str | None]:
    """An audit: no two rows have these columns in common."""

    def check(table: DataFrame) -> str | None:
        twice = table.groupBy(*columns).count().filter("count > 1").limit(1).collect()
        return f"repeated {columns}: {[twice[0][c] for c in columns]}" if twice else None

    return check


class StageStore:
    """Published tables of stages below ``folder``, which Spark's executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def _files(self, path: str) -> list[list]:
        fs, p = self._at(path)
        found, todo = [], [p]
        while todo:
            for s in fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                elif not s.getPath().getName().startswith(("_", ".")):
                    found.append([s.getPath().toString(), s.getLen(), s.getModificationTime()])
        return sorted(found)

    def _write(self, path: str, content: dict, replace: bool = False) -> None:
        """A small file, whole or not at all: written beside and renamed."""
        fs, p = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        if replace and fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(beside, p):
            fs.delete(beside, False)
            if not fs.exists(p):
                raise OSError(f"{path} can't be written")

    def _read(self, path: str) -> dict | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def fingerprint(self, stage: Stage, of: dict[str, str]) -> str:
        """``of``: fingerprints of the stages before."""
        missing = [n for n in stage.needs if n not in of]
        if missing:
            raise ValueError(f"stage {stage.name} needs {missing}, which come later or are unknown")
        try:
            code = inspect.getsource(stage.run)
        except (OSError, TypeError):  # defined where there is no source
            code = repr(getattr(stage.run, "__code__", stage.run).__class__) + getattr(getattr(stage.run, "__code__", None), "co_code", b"").hex()
        content = {"name": stage.name, "settings": stage.settings, "code": code, "inputs": [self._files(p) for p in stage.inputs], "needs": [of[n] for n in stage.needs]}
        return hashlib.sha256(json.dumps(content, sort_keys=True, default=str).encode()).hexdigest()[:32]

    def fingerprints(self, stages: list[Stage]) -> dict[str, str]:
        out: dict[str, str] = {}
        for s in stages:
            if s.name in out:
                raise ValueError(f"two stages are named {s.name}")
            out[s.name] = self.fingerprint(s, out)
        return out

    def marker(self, name: str, fingerprint: str) -> dict | None:
        return self._read(f"{self.folder}/{name}/{fingerprint}/published.json")

    def table(self, name: str, fingerprint: str) -> DataFrame | None:
        """The published table, or None."""
        found = self.marker(name, fingerprint)
        return self.spark.read.parquet(f"{self.folder}/{name}/{fingerprint}/{found['attempt']}") if found else None

    def run(self, stages: list[Stage]) -> dict[str, DataFrame]:
        """The tables of all stages, in order: published ones as they are, others made, audited and published."""
        prints, tables = self.fingerprints(stages), {}
        for stage in stages:
            found = self.table(stage.name, prints[stage.name])
            tables[stage.name] = found if found is not None else self._make(stage, prints[stage.name], {n: tables[n] for n in stage.needs})
        return tables

    def _make(self, stage: Stage, fingerprint: str, tables: dict[str, DataFrame]) -> DataFrame:
        home, attempt, began = f"{self.folder}/{stage.name}/{fingerprint}", f"attempt-{uuid.uuid4().hex}", time.time()
        try:
            stage.run(self.spark, tables, stage.settings).write.parquet(f"{home}/{attempt}")
            made = self.spark.read.parquet(f"{home}/{attempt}")
            fault = stage.audit(made) if stage.audit else None
            if fault:
                raise AuditError(f"stage {stage.name}: {fault}")
        except Exception as e:
            self._write(f"{home}/failed-{attempt}.json", {"error": f"{type(e).__name__}: {str(e)[:500]}", "seconds": time.time() - began})
            raise
        self._write(f"{home}/published.json", {"attempt": attempt, "rows": made.count(), "seconds": time.time() - began, "stage": stage.name, "fingerprint": fingerprint, "settings": stage.settings})
        return self.table(stage.name, fingerprint)  # of whoever was first, if two ran at once

    def status(self, stages: list[Stage]) -> DataFrame:
        """(stage, fingerprint, status, rows, seconds, attempts, error) of each stage: published, failed, begun or none."""
        rows = []
        for name, fingerprint in self.fingerprints(stages).items():
            fs, home = self._at(f"{self.folder}/{name}/{fingerprint}")
            names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
            found, failed = self.marker(name, fingerprint), sorted(n for n in names if n.startswith("failed-") and n.endswith(".json"))
            attempts = len([n for n in names if n.startswith("attempt-")])
            error = self._read(f"{self.folder}/{name}/{fingerprint}/{failed[-1]}")["error"] if failed and not found else None
            state = "published" if found else "failed" if failed else "begun" if attempts else "none"
            rows.append((name, fingerprint, state, found and found["rows"], found and found["seconds"], attempts, error))
        return self.spark.createDataFrame(rows, STATUS)

    def export(self, stages: list[Stage], folder: str) -> None:
        """Copy all stages' tables to ``folder``/stage, with a manifest at last; nothing if one isn't published."""
        prints = self.fingerprints(stages)
        found = {n: self.marker(n, p) for n, p in prints.items()}
        missing = [n for n, m in found.items() if not m]
        if missing:
            raise ValueError(f"not published: {missing}")
        for n, p in prints.items():
            self.table(n, p).write.mode("overwrite").parquet(f"{folder}/{n}")
        self._write(f"{folder}/manifest.json", {"stages": found}, replace=True)

    def sweep(self) -> int:
        """Delete attempts that no marker names (of killed runs; none may be running); how many."""
        gone = 0
        fs, top = self._at(self.folder)
        for stage in fs.listStatus(top) if fs.exists(top) else ():
            for home in fs.listStatus(stage.getPath()):
                kept = (self._read(f"{home.getPath().toString()}/published.json") or {}).get("attempt")
                for s in fs.listStatus(home.getPath()):
                    if s.getPath().getName().startswith("attempt-") and s.getPath().getName() != kept:
                        fs.delete(s.getPath(), True)
                        gone += 1
        return gone


def grid(name: str, run: Run, choices: dict[str, list], needs: tuple[str, ...] = (), settings: dict | None = None, audit: Callable[[DataFrame], str | None] | None = None) -> list[Stage]:
    """A stage for each combination of choices (models, folds, seeds), named by it."""
    out = []
    for values in product(*choices.values()):
        own = dict(zip(choices, values, strict=True))
        out.append(Stage("-".join([name, *(f"{k}={v}" for k, v in own.items())]), run, needs, (), {**(settings or {}), **own}, audit))
    return out


def gathered(name: str, parts: list[Stage]) -> Stage:
    """A stage of all parts' rows with their settings' names and values in ``configuration``."""

    def run(spark: SparkSession, tables: dict[str, DataFrame], settings: dict) -> DataFrame:
        out = None
        for part, words in settings["parts"]:
            own = tables[part].withColumn("configuration", F.lit(words))
            out = own if out is None else out.unionByName(own)
        return out

    return Stage(name, run, tuple(p.name for p in parts), (), {"parts": [[p.name, json.dumps(p.settings, sort_keys=True, default=str)] for p in parts]})
