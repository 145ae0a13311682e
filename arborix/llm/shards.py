"""Training order as binary shards: a keyed Feistel permutation gives every sequence its global slot.

Documents' ids (and an end id after each) run on through an input partition and are cut into sequences of ``length``
ids; the last of a partition is filled with ``PAD``. Sequences are numbered through all partitions. A balanced Feistel
network over the next power of four, walked until it falls below the number of sequences, permutes those numbers;
slot s is record ``s mod per_shard`` of shard ``s div per_shard``. Each output partition is a range of slots, whole shards
on end, sorted by slot and written by Spark's text writer without any further sort; the writer begins a new file after
``per_shard`` records. A record is ``2 * length`` bytes of little-endian 16-bit ids and CR LF, so record r begins at byte
``r * stride`` and reading can resume at any slot. The permutation is computed both ways; no table of it is kept.

* A null or empty text is a document of one id, the end id. Repeated rows are written as often as they occur.
* An empty table gives no sequences and no shards. Extra columns are ignored; texts of any length are written whole.
* Ids must be below 65535 (``PAD``). The order depends on the key, the number of sequences and the input's splits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, materialize, mix, texts
from .packing import END_ID, memo

PAD, SEPARATOR = 65535, "\r\n"
#: Output partitions at most; above this a partition holds several shards.
PARTITIONS = 100_000
SEQUENCE_SCHEMA = "part int, place long, first_doc_id long, first_start long, n_ids int, ids_crc32 long, ids binary"


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of range(size) in ``rounds`` rounds."""

    size: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, -(-max(1, self.size - 1).bit_length() // 2))

    def _round(self, x: np.ndarray, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(x + np.uint64((self.key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) % 2**64)) & np.uint64((1 << self.half) - 1)

    def _walk(self, values: np.ndarray, forward: bool) -> np.ndarray:
        out = np.asarray(values).astype(np.uint64)
        todo = np.arange(len(out))
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        while len(todo):
            left, right = out[todo] >> h, out[todo] & mask
            for i in range(self.rounds) if forward else reversed(range(self.rounds)):
                if forward:
                    left, right = right, left ^ self._round(right, i)
                else:
                    left, right = right ^ self._round(left, i), left
            out[todo] = left << h | right
            todo = todo[out[todo] >= self.size]
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, True)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, False)


def sequences(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """SEQUENCE_SCHEMA rows: ids (16 bits, compressed) of each sequence, and where its first id lies in a document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, place = TaskContext.get().partitionId(), 0
        encoder, end, pack = memo(tokenizer), np.array([END_ID], "<u4").tobytes(), zstandard.ZstdCompressor(level=3).compress
        held, begins = np.empty(0, "<u2"), []  # begins: (place in held, doc_id, start) of the pieces in held
        names = [x.split()[0] for x in SEQUENCE_SCHEMA.split(", ")]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, begins, place
            rows, k = [], 0
            count = -(-len(held) // length) if last else len(held) // length
            for i in range(count):
                own = held[i * length : (i + 1) * length]
                while k + 1 < len(begins) and begins[k + 1][0] <= i * length:
                    k += 1
                at, doc_id, start = begins[k]
                full = np.concatenate((own, np.full(length - len(own), PAD, "<u2"))).tobytes()
                rows.append((part, place, doc_id, start + i * length - at, len(own), zlib.crc32(full), pack(full)))
                place += 1
            done = count * length
            while k + 1 < len(begins) and begins[k + 1][0] <= done:
                k += 1
            begins = [(at - done, d, s) for at, d, s in begins[k:]]
            held = held[done:]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            found = [x + end for x in encoder.encode(batch.column(1).cast(pa.binary()).to_pylist())]
            at = len(held)
            for doc_id, x in zip(batch.column(0).to_pylist(), found, strict=True):
                begins.append((at, doc_id, 0))
                at += len(x) // 4
            held = np.concatenate((held, np.frombuffer(b"".join(found), "<u4").astype("<u2")))
            yield from cut(False)
        yield from cut(True)

    return texts(docs).mapInArrow(frugal(run), SEQUENCE_SCHEMA)


def write_shards(found: DataFrame, path: str, key: int, length: int = 2048, per_shard: int = 512) -> tuple[DataFrame, Feistel]:
    """Write stored sequences as shards under ``path``; returns the index (slot, number, place of origin) and the order.

    Only the counts of sequences by input partition reach the driver.
    """
    counts = sorted((r["part"], r["count"]) for r in found.groupBy("part").count().collect())
    parts, sizes = (np.array(x, np.int64) for x in (zip(*counts, strict=True) if counts else ((), ())))
    base, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    order = Feistel(total, key)
    shards = max(1, -(-total // per_shard))
    on_end = -(-shards // PARTITIONS)  # shards of a partition

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = base[np.searchsorted(parts, batch.column(0).to_numpy())] + batch.column(1).to_numpy()
            slot = order.slot(n)
            yield pa.RecordBatch.from_arrays([pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), pa.array(n), *[batch.column(i) for i in range(2, batch.num_columns)]], names=["shard", "slot", "number", *batch.schema.names[2:]])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([open_(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["value"])

    bounded_batches(found.sparkSession)
    placed = found.select("part", "place", "ids").mapInArrow(frugal(number), "shard int, slot long, number long, ids binary").select("shard", "slot", "ids")
    ranges = placed.repartitionById(-(-shards // on_end), F.expr(f"CAST(shard div {on_end} AS INT)")).sortWithinPartitions("slot")
    values = ranges.select("slot", "ids").mapInArrow(frugal(unpack), "value binary").select(F.col("value").cast("string").alias("value"))
    values.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", per_shard).text(f"{path}/by-{on_end}")
    index = found.drop("ids").mapInArrow(frugal(number), "shard int, slot long, number long, first_doc_id long, first_start long, n_ids int, ids_crc32 long")
    return index, order


def read_shards(spark: SparkSession, path: str, length: int = 2048, per_shard: int = 512, with_ids: bool = True) -> DataFrame:
    """(slot, shard, record, n_ids, ids_crc32 and, if wanted, ids) of every record, from its place in its shard."""
    stride = 2 * length + len(SEPARATOR)
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                on_end, part, nth = map(int, re.search(r"/by-(\d+)/part-(\d+)-.*-c(\d+)\.txt$", name).groups())
                data, shard = content.as_py(), part * on_end + nth
                if len(data) % stride:
                    raise ValueError(f"{name} does not hold whole records")
                own = np.frombuffer(data, np.uint8).reshape(-1, stride)[:, : 2 * length]
                ids = np.ascontiguousarray(own).view("<u2")
                n = len(ids)
                record = np.arange(n)
                columns = [pa.array(shard * per_shard + record), pa.array(np.full(n, shard, np.int32)), pa.array(record.astype(np.int32)), pa.array(length - (ids == PAD).sum(axis=1, dtype=np.int32)), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                names = ["slot", "shard", "record", "n_ids", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tobytes() for x in ids], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(frugal(run), "slot long, shard int, record int, n_ids int, ids_crc32 long" + ", ids binary" * with_ids)


def materialize_order(docs: DataFrame, tokenizer: str, path: str, key: int, length: int = 2048, per_shard: int = 512) -> tuple[DataFrame, Feistel]:
    """Sequences of ``docs`` as shards under ``path``."""
    return write_shards(materialize(sequences(docs, tokenizer, length), "sequences"), path, key, length, per_shard)
