"""Byte-level BPE encoding and decoding by merge replay.

The words (matches of the splitting pattern) of a block of documents form a small corpus. An inverted index leads from
each adjacent token pair to its positions in that corpus; merges are applied in rank order, each to all its positions
at once, and only the touched neighbours are indexed anew. Every distinct word is replayed once a block, and the
ids of words met before are kept up to a bound.

* A null text is empty and has no ids; ``decode`` of no ids is an empty text. Repeated rows give repeated results.
* Of equal pairs the leftmost is merged first. A word that is itself a token is not merged at all.
* Extra columns are ignored; texts of any length are encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, frugal, texts, unicode_spaces

ENCODED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encoder over one vocabulary; ``known`` holds the ids of words already replayed, up to ``bound`` words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, bound: int = 1_200_000):
        import regex

        self.ranks, self.split, self.bound = ranks, regex.compile(unicode_spaces(pattern)).findall, bound
        self.tokens = {v: k for k, v in ranks.items()}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, left: int, right: int) -> int:
        """The id of two tokens joined, or -1."""
        found = self.joined.get((left, right))
        if found is None:
            found = self.joined[left, right] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of distinct words."""
        if len(self.joined) > 2_000_000:
            self.joined.clear()
        single, merged, ranks = self.single, self.merged, self.ranks
        ids: list[int] = []
        spans: list[tuple[int, int]] = []
        whole: dict[int, int] = {}
        for k, word in enumerate(words):
            if (rank := ranks.get(word)) is not None:
                whole[k] = rank
                spans.append((len(ids), len(ids)))
                continue
            start = len(ids)
            ids += [single[x] for x in word]
            spans.append((start, len(ids)))
            ids.append(-1)  # parts the words
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}  # the id that a pair becomes, which is its rank -> positions of its left tokens
        of_pair, missing = self.joined.get, None
        for i, pair in enumerate(zip(ids, ids[1:], strict=False)):
            r = of_pair(pair, missing)
            if r is missing:
                r = merged(*pair) if pair[0] >= 0 and pair[1] >= 0 else -1
            if r >= 0:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                j = right[i]
                if ids[i] < 0 or j >= n or ids[j] < 0 or of_pair((ids[i], ids[j])) != rank:
                    continue  # a neighbour's merge took one of the two
                ids[i], ids[j] = rank, -2
                after, before, lowest = right[j], left[i], rank
                right[i] = after
                if after < n:
                    left[after] = i
                    if (other := ids[after]) >= 0:
                        r = of_pair((rank, other), missing)
                        if r is missing:
                            r = merged(rank, other)
                        if r >= 0:
                            if r in index:
                                index[r].append(i)
                            else:
                                heapq.heappush(queue, r)
                                index[r] = [i]
                            if r < lowest:
                                lowest = r
                if before >= 0 and (other := ids[before]) >= 0:
                    r = of_pair((other, rank), missing)
                    if r is missing:
                        r = merged(other, rank)
                    if r >= 0:
                        if r in index:
                            index[r].append(before)
                        else:
                            heapq.heappush(queue, r)
                            index[r] = [before]
                        if r < lowest:
                            lowest = r
                if lowest < rank and k + 1 < len(places):  # a lower rank has come up: it goes first
                    if rank not in index:
                        heapq.heappush(queue, rank)
                    index.setdefault(rank, []).extend(places[k + 1 :])
                    break
        return [(whole[k],) if k in whole else tuple([x for x in ids[a:b] if x >= 0]) for k, (a, b) in enumerate(spans)]

    def learn(self, words: set[str]) -> None:
        new = [x for x in words if x not in self.known]
        if not new:
            return
        if len(self.known) > self.bound:
            self.known.clear()
            new = list(words)
        for x, ids in zip(new, self.replay([x.encode() for x in new]), strict=True):
            self.known[x] = ids

    def encode_block(self, found: list[str]) -> Iterator[list[int]]:
        """Ids of each text of a block."""
        split = [self.split(x) for x in found]
        self.learn(set().union(*split))
        known = self.known
        for words in split:
            yield [i for x in words for i in known[x]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], MergeReplay] = {}


def encoder(path: str, pattern: str) -> MergeReplay:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = MergeReplay(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _blocks(batch: pa.RecordBatch, size: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    ids, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    start, total = 0, 0
    for i, x in enumerate(found):
        total += len(x)
        if total >= size or i + 1 == len(found):
            yield ids[start : i + 1], found[start : i + 1]
            start, total = i + 1, 0


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for ids, found in _blocks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(own.encode_block(found)), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(frugal(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids); null ids are none."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), "doc_id long, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each text in one pass and return only counts and digests; ids needn't leave the worker."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        decimal = {i: str(i) for i in own.tokens}
        for batch in batches:
            rows = []
            for ids, found in _blocks(batch):
                for doc_id, got in zip(ids, own.encode_block(found), strict=True):
                    rows.append((doc_id, len(got), hashlib.sha256(",".join(map(decimal.__getitem__, got)).encode()).hexdigest(), hashlib.sha256(own.decode(got)).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(frugal(run), ENCODED_SCHEMA)
