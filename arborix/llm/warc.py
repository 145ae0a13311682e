"""WARC archives: records, revisit resolution by payload digest, and deduplicated archives.

Only headers are shuffled to resolve revisits: of records with equal payloads the one with the least id stays a
response and the others become revisits that refer to it. Archives are written by Spark's own text writer, whose line
separator is the CR LF CR LF that ends a WARC record; so they go to any store through the usual commit protocol and a
lost executor's files are written again. They are read back by their Content-Length, so a payload may hold anything.

* A null payload is empty; a null url becomes an empty target. Payloads shorter than ``least`` bytes stay responses.
* Rows without an id are written as responses; nothing refers to them. They are read back without an id.
* Repeated rows (equal id and payload) are all responses if theirs is the least id, else all revisits. Rows with equal
  ids and other payloads are resolved each by its own payload. Extra columns are ignored. An empty table gives an
  archive without records.
* Records are written whole, however long; ``RECORDS_PER_FILE`` bounds an archive's records, not their bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, hot_join

RECORDS_PER_FILE = 1000
#: Payload bytes after which a reader hands its rows on.
READ_BYTES = 16 << 20
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id long, record_type string, url string, refers_to long, payload_digest string, payload_bytes long, content_length long, digest_holds boolean"

#: The alphabet of base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 (160 bits are 32 digits), with built-in functions only."""
    digits = F.sha1(payload)  # each 5 hex digits are 4 base32 digits
    out = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(digits, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(record_id, url, payload, payload_bytes, payload_digest) of each row; the payload in UTF-8."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary")
    own = pages.select(pages[id_col].cast("long").alias("record_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    return own.select("*", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def resolve_revisits(heads: DataFrame, least: int = 0) -> DataFrame:
    """Decisions for records that don't stay responses: (record_id, payload_digest, refers_to), one for each of them.

    ``heads`` has record_id, payload_digest and payload_bytes. First ids of digests are grouped minima; joining them
    back splits hot digests off, so no task gets a large group of copies.
    """
    own = heads.filter(F.col("payload_bytes") >= least).select("record_id", "payload_digest", "payload_bytes")
    groups = own.groupBy("payload_digest", "payload_bytes").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = groups.select(F.concat_ws("/", "payload_digest", "payload_bytes").alias("k"), "first_id", "n")
    keyed = own.select(F.concat_ws("/", "payload_digest", "payload_bytes").alias("k"), "record_id", "payload_digest").distinct()
    joined = hot_join(keyed, groups.drop("n"), "k", groups.select("k", "n"), how="inner")
    return joined.filter("record_id <> first_id").select("record_id", "payload_digest", F.col("first_id").alias("refers_to"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Headers and payloads with record_type and refers_to, ready for ``write_archive``."""
    heads = headers(pages, id_col, url_col, payload_col)
    joined = heads.join(resolve_revisits(heads.drop("payload"), least), ["record_id", "payload_digest"], "left")
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _record_text(date: str) -> Column:
    """One record up to its closing CR LF CR LF; revisits have no payload of their own."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(revisit, F.lit("")).otherwise(line("Content-Length", F.col("payload_bytes"))), F.lit("\r\n"))
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("record_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(http) + F.octet_length(body)),
        F.lit("\r\n"),
        http,
    )
    return F.concat(head.cast("binary"), body).cast("string")


def write_archive(found: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write records (of ``records``) as WARC/1.1 files under ``path``."""
    found.select(_record_text(date).alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield head, data[start:stop]
        at = stop + 4


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP headers."""
    return block[block.index(b"\r\n\r\n") + 4 :]


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives under ``path``, each response's digest computed anew from the payload read."""
    import gzip

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * with_payload]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")] + ["payload"] * with_payload

    def number(urn: str | None) -> int | None:
        found = urn.rpartition(":")[2].rstrip(">") if urn else "none"
        return None if found == "none" else int(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                rows, held = [], 0
                for head, block in parse_archive(gzip.decompress(data) if name.endswith(".gz") else data):
                    payload = payload_of(block)
                    stated = head["warc-payload-digest"].removeprefix("sha1:")
                    response = head["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else stated
                    length = len(payload) if response else int(head["x-payload-length"])
                    rows.append((number(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"], number(head.get("warc-refers-to")), digest, length, int(head["content-length"]), digest == stated, *[payload] * with_payload))
                    held += len(payload)
                    if held >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(frugal(run), RECORD_SCHEMA + ", payload binary" * with_payload)


def deduplicate_archive(spark: SparkSession, path: str, out: str, least: int = 0) -> None:
    """Read archives, resolve revisits (records that are revisits already stay so) and write them with fresh headers."""
    found = read_archive(spark, path, with_payload=True)
    own = found.filter("record_type = 'response'").drop("refers_to", "record_type")
    revisits = resolve_revisits(own, least)
    first = own.join(revisits, ["record_id", "payload_digest"], "left").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    old = found.filter("record_type <> 'response'").join(revisits.select(F.col("record_id").alias("refers_to"), "payload_digest", F.col("refers_to").alias("moved")), ["refers_to", "payload_digest"], "left").withColumn("refers_to", F.coalesce("moved", "refers_to")).drop("moved")
    write_archive(first.unionByName(old), out)
