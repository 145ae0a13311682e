"""LMDB files (data.mdb) as a Spark data source: the main table's records as bytes, read page by page.

The B+ tree is entered at the root of the newer of the two meta pages, so pages of older transactions are never read. The
upper branch pages are opened until there are enough subtrees; each partition walks some of them and reads their leaves and
overflow pages alone. Point lookups descend from the root by binary search in the branch pages. Values stay bytes: nothing is
unpickled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .arrays import file_system, opened

#: Fixed values of the format (little-endian, 64 bits).
MAGIC, VERSION, NO_PAGE, HEADER = 0xBEEFC0DE, 1, (1 << 64) - 1, 16
BRANCH, LEAF, OVERFLOW, META = 1, 2, 4, 8
BIG, SUB, DUPLICATES = 1, 2, 4
BATCH_BYTES, PARTITIONS = 8 << 20, 64


@dataclass
class Subtrees(InputPartition):
    path: str
    pages: list[int] = field(default_factory=list)


class Tree:
    """The main table of an open file."""

    def __init__(self, stream) -> None:
        self.f = stream
        metas = []
        first = self._meta(0, None)
        self.page_size = first[0]
        metas = [first, self._meta(1, self.page_size)]
        _, self.root, self.depth, self.entries, _ = max(metas, key=lambda m: m[4])

    def _meta(self, number: int, size: int | None) -> tuple[int, int, int, int, int]:
        """(page size, root, depth, entries, transaction)"""
        data = self._bytes(number * (size or 0), HEADER + 136)
        flags = struct.unpack_from("<H", data, 10)[0]
        magic, version = struct.unpack_from("<II", data, HEADER)
        if not flags & META or magic != MAGIC or version != VERSION:
            raise ValueError("not an LMDB file of version 1")
        page_size = struct.unpack_from("<I", data, HEADER + 24)[0]
        _, _, depth, _, _, _, entries, root = struct.unpack_from("<IHHQQQQQ", data, HEADER + 24 + 48)
        return page_size, root, depth, entries, struct.unpack_from("<Q", data, HEADER + 24 + 96 + 8)[0]

    def _bytes(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        data = self.f.read(n)
        if len(data) < n:
            raise ValueError("the file ends within a page")
        return data

    def page(self, number: int) -> tuple[int, bytes, list[int]]:
        """(flags, bytes, places of nodes)"""
        data = self._bytes(number * self.page_size, self.page_size)
        own, _, flags, lower, _ = struct.unpack_from("<QHHHH", data)
        if own != number or not flags & (BRANCH | LEAF) or lower > self.page_size:
            raise ValueError(f"page {number} is no page of the tree")
        return flags, data, list(struct.unpack_from(f"<{(lower - HEADER) // 2}H", data, HEADER))

    @staticmethod
    def key(data: bytes, at: int) -> bytes:
        size = struct.unpack_from("<H", data, at + 6)[0]
        return data[at + 8 : at + 8 + size]

    @staticmethod
    def child(data: bytes, at: int) -> int:
        low, high, top = struct.unpack_from("<HHH", data, at)
        return low | high << 16 | top << 32

    def value(self, data: bytes, at: int) -> bytes:
        low, high, flags, size = struct.unpack_from("<HHHH", data, at)
        if flags & (SUB | DUPLICATES):
            raise ValueError("tables within the table and duplicate keys are not read")
        length, start = low | high << 16, at + 8 + size
        if not flags & BIG:
            return data[start : start + length]
        page = struct.unpack_from("<Q", data, start)[0]
        if not struct.unpack_from("<H", self._bytes(page * self.page_size, HEADER), 10)[0] & OVERFLOW:
            raise ValueError(f"page {page} holds no long value")
        return self._bytes(page * self.page_size + HEADER, length)

    def subtrees(self, wanted: int) -> list[int]:
        """Roots of subtrees in order of their keys, at least as many as wanted if there are."""
        if self.root == NO_PAGE:
            return []
        level = [self.root]
        while len(level) < wanted:
            pages = [self.page(p) for p in level]
            if not pages[0][0] & BRANCH:
                break
            level = [self.child(data, at) for _, data, places in pages for at in places]
        return level

    def records(self, root: int) -> Iterator[tuple[bytes, bytes]]:
        """All records below a page, in order of their keys."""
        todo = [root]
        while todo:
            flags, data, places = self.page(todo.pop())
            if flags & BRANCH:
                todo += [self.child(data, at) for at in reversed(places)]
            else:
                for at in places:
                    yield self.key(data, at), self.value(data, at)

    def get(self, key: bytes) -> bytes | None:
        number = self.root
        while number != NO_PAGE:
            flags, data, places = self.page(number)
            low, high = (1 if flags & BRANCH else 0), len(places)  # a branch's first key is below all
            while low < high:
                middle = (low + high) // 2
                if self.key(data, places[middle]) <= key if flags & BRANCH else self.key(data, places[middle]) < key:
                    low = middle + 1
                else:
                    high = middle
            if flags & LEAF:
                return self.value(data, places[low]) if low < len(places) and self.key(data, places[low]) == key else None
            number = self.child(data, places[low - 1])
        return None


def data_file(path: str) -> str:
    """The data file of an environment's folder, or the file itself."""
    from pyarrow import fs

    system, at = file_system(path)
    return f"{path.rstrip('/')}/data.mdb" if system.get_file_info(at).type == fs.FileType.Directory else path


class Lmdb(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lmdb"

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema) -> DataSourceReader:
        return LmdbReader(self.options)


class LmdbReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.wanted = data_file(options["path"]), int(options.get("partitions", PARTITIONS))

    def partitions(self) -> list[InputPartition]:
        with opened(self.path) as f:
            roots = Tree(f).subtrees(self.wanted)
        n = min(self.wanted, len(roots))
        return [Subtrees(self.path, roots[i * len(roots) // n : (i + 1) * len(roots) // n]) for i in range(n)] or [Subtrees(self.path)]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        if not partition.pages:
            return
        names = ["key", "value"]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], names=names)
        with opened(partition.path) as f:
            tree, have, size = Tree(f), [], 0
            for root in partition.pages:
                for row in tree.records(root):
                    have.append(row)
                    size += len(row[0]) + len(row[1])
                    if size > BATCH_BYTES:
                        yield batch(have)
                        have, size = [], 0
            if have:
                yield batch(have)


def read_lmdb(spark: SparkSession, path: str, partitions: int = PARTITIONS) -> DataFrame:
    """(key, value) of all records of an environment's main table, as bytes."""
    spark.dataSource.register(Lmdb)
    return spark.read.format("lmdb").option("partitions", partitions).load(path)


def lookup_lmdb(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, value) of the keys asked for (key, text or bytes), value null where there is none; each task descends for its own keys."""
    file = data_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(file) as f:
            tree = Tree(f)
            for b in batches:
                found = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tree.get(bytes(k)) for k in found], pa.binary())], names=["key", "value"])

    asked = keys.select(F.col("key").cast("binary").alias("key")).filter("key IS NOT NULL").distinct()
    return asked.mapInArrow(run, "key binary, value binary")
