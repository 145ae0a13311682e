"""Arrays in files as Spark data sources: two-dimensional NPY arrays and JSON arrays of strings, read by ranges.

``npy_rows`` cuts each file into runs of ``chunk_rows`` rows, a partition each, and reads the bytes of those alone; ``columns``
picks components and ``first``/``last`` positions, which leave out whole partitions. ``json_strings`` cuts each file into
ranges of ``chunk_bytes``. Whether a range begins inside of a string, and at which place of the array, follows from the number of
unescaped quotes before it, which a first job counts range by range. Files ending in .gz are one stream, hence one
partition, read in bounded chunks.

Files are opened by the tasks with Arrow's file systems (local, HDFS, S3, GCS by the path's scheme).
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_ROWS, CHUNK_BYTES = 100_000, 32 << 20
#: Rows or bytes taken from a stream at once.
ROWS, BLOCK = 4096, 1 << 16


def file_system(path: str):
    """(file system, path in it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def files_of(path: str, suffix: str) -> list[tuple[str, str, int]]:
    """(path, name without suffix, bytes) of a file, or of a folder's files with the suffix (and .gz), by name."""
    from pyarrow import fs

    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    scheme = path[: path.index(at)] if at in path else ""
    kept = sorted((f.path, re.sub(rf"{re.escape(suffix)}(\.gz)?$", "", f.base_name), f.size) for f in found if f.type == fs.FileType.File and (info.type == fs.FileType.File or re.search(rf"{re.escape(suffix)}(\.gz)?$", f.base_name)))
    return [(scheme + p, name, size) for p, name, size in kept]


def opened(path: str):
    system, at = file_system(path)
    return gzip.GzipFile(fileobj=system.open_input_stream(at, compression=None)) if path.endswith(".gz") else system.open_input_file(at)


@dataclass
class Run(InputPartition):
    path: str
    name: str
    begin: int
    end: int
    before: int = 0


def npy_header(stream) -> tuple[tuple[int, int], np.dtype, int]:
    """(shape, type, bytes before the rows) of a two-dimensional array in C order."""
    form = np.lib.format
    version = form.read_magic(stream)
    shape, fortran, dtype = (form.read_array_header_1_0 if version == (1, 0) else form.read_array_header_2_0)(stream)
    if len(shape) != 2 or fortran or dtype.hasobject:
        raise ValueError("a two-dimensional array of numbers in C order is needed")
    return shape, dtype, stream.tell()


class NpyRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return "file string, position long, vector array<double>"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.chunk = options["path"], int(options.get("chunk_rows", CHUNK_ROWS))
        self.columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else None
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, name, _ in files_of(self.path, ".npy"):
            if path.endswith(".gz"):
                out.append(Run(path, name, self.first, self.last + 1))
                continue
            with opened(path) as f:
                n = npy_header(f)[0][0]
            out += [Run(path, name, max(a, self.first), min(a + self.chunk, n, self.last + 1)) for a in range(0, n, self.chunk) if a <= self.last and min(a + self.chunk, n) > self.first]
        return out or [Run("", "", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as f:
            (n, width), dtype, start = npy_header(f)
            stop, at = min(n, partition.end), partition.begin
            f.seek(start + at * width * dtype.itemsize)  # a gzip stream is read up to there, chunk by chunk
            while at < stop:
                count = min(ROWS, stop - at)
                data = f.read(count * width * dtype.itemsize)
                if len(data) < count * width * dtype.itemsize:
                    raise ValueError(f"{partition.path} ends before its last row")
                x = np.frombuffer(data, dtype).reshape(count, width).astype(np.float64)
                x = x[:, self.columns] if self.columns is not None else x
                offsets = pa.array(np.arange(count + 1, dtype=np.int32) * x.shape[1])
                vectors = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * count), pa.array(np.arange(at, at + count)), vectors], names=["file", "position", "vector"])
                at += count


def quotes(data: bytes, before: bytes = b"") -> np.ndarray:
    """Places of the quotes that no odd run of backslashes comes before; ``before`` is what lies before ``data``."""
    x = np.frombuffer(data, np.uint8)
    found = np.flatnonzero(x == 34)
    if not len(found):
        return found
    slashed = x[np.maximum(found - 1, 0)] == 92
    slashed[0] &= found[0] > 0
    keep = np.ones(len(found), bool)
    for i in np.flatnonzero(slashed | (found == 0)).tolist():
        at = int(found[i])
        run = at - len(data[:at].rstrip(b"\\"))
        if run == at:
            run += len(before) - len(before.rstrip(b"\\"))
        keep[i] = run % 2 == 0
    return found[keep]


def _slashes_before(f, at: int) -> bytes:
    """The run of backslashes that ends before ``at``."""
    out = b""
    while at > 0:
        f.seek(max(0, at - BLOCK))
        part = f.read(at - max(0, at - BLOCK))
        run = part[len(part.rstrip(b"\\")) :]
        out = run + out
        if len(run) < len(part):
            break
        at -= len(part)
    return out


class JsonStrings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_strings"

    def schema(self) -> str:
        return "file string, position long, value string"

    def reader(self, schema) -> DataSourceReader:
        return JsonReader(self.options)


def _ranges(path: str, chunk: int) -> list[Run]:
    out = []
    for at, name, size in files_of(path, ".json"):
        whole = at.endswith(".gz")
        out += [Run(at, name, a, -1 if whole else min(size, a + chunk)) for a in ([0] if whole else range(0, max(size, 1), chunk))]
    return out


class JsonReader(DataSourceReader):
    """``quotes``: a JSON list of the number of unescaped quotes in each range, in order."""

    def __init__(self, options) -> None:
        self.runs = _ranges(options["path"], int(options.get("chunk_bytes", CHUNK_BYTES)))
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))
        before, file = 0, None
        for run, n in zip(self.runs, json.loads(options["quotes"]), strict=True):
            before = before if run.path == file else 0
            run.before, file, before = before, run.path, before + n
            run.strings = (before + 1) // 2 - (run.before + 1) // 2

    def partitions(self) -> list[InputPartition]:
        wanted = [r for r in self.runs if r.end < 0 or r.strings and (r.before + 1) // 2 <= self.last and (r.before + 1) // 2 + r.strings > self.first]
        return wanted or [Run("", "", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as f:
            yield from _batches(partition.name, ((p, s) for p, s in strings(f, partition) if self.first <= p <= self.last))


def _batches(name: str, rows: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    have: list[tuple] = []

    def out() -> pa.RecordBatch:
        positions, values = zip(*have, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(have)), pa.array(positions, pa.int64()), pa.array(values, pa.string())], names=["file", "position", "value"])

    for row in rows:
        have.append(row)
        if len(have) == ROWS:
            yield out()
            have = []
    if have:
        yield out()


def strings(f, run: Run) -> Iterator[tuple[int, str]]:
    """(position, string) of the strings that open in the run, in blocks; the last may end beyond it."""
    at, place, text, gap = run.begin, (run.before + 1) // 2, b"", b""
    inside = skipping = run.before % 2 == 1
    seen = "first" if at == 0 else "part"  # of the gap before the next string: from the bracket, from a string, or a part
    slashes = _slashes_before(f, at) if at else b""
    f.seek(at)
    while data := f.read(BLOCK):
        last = 0
        for q in quotes(data, slashes).tolist():
            if not inside and run.end >= 0 and at + q >= run.end:
                return _check(gap + data[last : max(last, run.end - at)], "part")
            piece, last = data[last:q], q + 1
            if not inside:
                _check(gap + piece, seen)
                text = b""
            elif not skipping:
                yield place, json.loads(b'"' + text + piece + b'"')
                place += 1
            if inside:
                skipping, seen, gap = False, "whole", b""
            inside = not inside
        if not inside:
            gap = re.sub(rb"\s+", b" ", gap + data[last:])
            if len(gap) > 16:
                _check(gap, "part")
        elif not skipping:
            text += data[last:]
        slashes = (slashes + data)[len((slashes + data).rstrip(b"\\")) :]
        at += len(data)
    if inside:
        raise ValueError("a string of the array doesn't end")
    _check(gap, f"{seen} end")


#: What may lie between strings: all of it, or as much as a range sees.
_GAPS = {"first": rb"\s*\[\s*", "whole": rb"\s*,\s*", "part": rb"\s*[\[,\]]?\s*\]?\s*", "first end": rb"\s*\[\s*\]\s*", "whole end": rb"\s*\]\s*", "part end": rb"\s*\[?\s*\]?\s*"}


def _check(gap: bytes, kind: str) -> None:
    if not re.fullmatch(_GAPS[kind], gap):
        raise ValueError(f"an array of strings is needed, not {gap[:40]!r}")


def read_npy(spark: SparkSession, path: str, chunk_rows: int = CHUNK_ROWS, columns: list[int] | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """(file, position, vector) of NPY files (a file, or a folder's), by runs of rows."""
    spark.dataSource.register(NpyRows)
    reader = spark.read.format("npy_rows").option("chunk_rows", chunk_rows).option("first", first)
    reader = reader.option("columns", ",".join(map(str, columns))) if columns is not None else reader
    return (reader.option("last", last) if last is not None else reader).load(path)


def read_strings(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, first: int = 0, last: int | None = None) -> DataFrame:
    """(file, position, value) of JSON arrays of strings (a file, or a folder's), by ranges of bytes."""
    runs = _ranges(path, chunk_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                with opened(row["path"]) as f:
                    at, n, slashes = row["begin"], 0, _slashes_before(f, row["begin"]) if row["begin"] else b""
                    f.seek(at)
                    while at < row["end"]:
                        data = f.read(min(BLOCK, row["end"] - at))
                        n += len(quotes(data, slashes))
                        slashes = (slashes + data)[len((slashes + data).rstrip(b"\\")) :]
                        at += len(data)
                out.append((row["i"], n))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["i", "n"])

    counts = [0] * len(runs)
    cut = [(i, r.path, r.begin, r.end) for i, r in enumerate(runs) if r.end >= 0]
    if cut:
        ranges = spark.createDataFrame(cut, "i long, path string, begin long, end long").repartition(max(1, min(len(cut), 10_000)), "i")
        for i, n in ranges.mapInArrow(count, "i long, n long").collect():  # a row a range
            counts[i] = n
    spark.dataSource.register(JsonStrings)
    reader = spark.read.format("json_strings").option("chunk_bytes", chunk_bytes).option("quotes", json.dumps(counts)).option("first", first)
    return (reader.option("last", last) if last is not None else reader).load(path)


def write_arrays(rows: DataFrame, folder: str) -> DataFrame:
    """Store ``rows`` (id, vector; vectors of one length) as part files: an NPY array and a JSON array of the ids each.

    Returns (part, rows), a row a task. A file gets its name when it is whole, so a task that is run again does no harm.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, n, width = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, None
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        paths = {s: f"{at}/part-{part:05d}{s}" for s in (".raw", ".npy", ".json")}
        own = {s: f"{p}.{attempt}" for s, p in paths.items()}
        with system.open_output_stream(own[".raw"]) as raw, system.open_output_stream(own[".json"]) as names:
            names.write(b"[")
            for b in batches:
                ids, x = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), np.float64)
                if not ids:
                    continue
                names.write((", " * (n > 0) + ", ".join(json.dumps(str(i)) for i in ids)).encode())
                raw.write(x.tobytes())
                n, width = n + len(ids), x.shape[1]
            names.write(b"]")
        if n:
            with system.open_output_stream(own[".npy"]) as out, system.open_input_stream(own[".raw"]) as raw:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": (n, width)})
                while data := raw.read(BLOCK * 16):
                    out.write(data)
            system.move(own[".npy"], paths[".npy"])
            system.move(own[".json"], paths[".json"])
        else:
            system.delete_file(own[".json"])
        system.delete_file(own[".raw"])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64())], names=["part", "rows"])

    return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "part int, rows long")
