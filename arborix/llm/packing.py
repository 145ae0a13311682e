"""Packing documents into fixed-length training sequences.

First-fit decreasing with a tournament tree of bin capacities, run independently in randomised groups of pieces.

* A null or empty text is a document of one id (the end id). Repeated rows are packed each on their own.
* A document longer than a sequence is cut at multiples of the sequence length; only its rest competes for space.
* Ties in length are taken in the order of (doc_id, start). An empty table gives no rows.
* Extra columns are ignored. Texts of any length are tokenised whole.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, materialize, texts, unicode_spaces

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"
#: Pieces in a group on average: a group is packed by one task, so its size is fixed and the number of groups grows.
GROUP_PIECES = 4096
END_ID = 1
#: What ends the last token of a word, and how words are parted after normalisation to lower case.
WORD_END = "</w>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordMemo:
    """Ids of white-space separated chunks by a tokenizer that never joins across white space, kept up to a bound.

    A chunk not met before is parted by ``pattern`` as the tokenizer does it, and its parts are looked up in turn; only
    parts never met go to the tokenizer, many at once and told apart by the ids that end words. Chunks that could hold a
    special token go there whole.
    """

    def __init__(self, path: str, bound: int = 1_800_000, pattern: str = PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.bound = Tokenizer.from_file(path), bound
        self.normalize, self.split = self.tokenizer.normalizer.normalize_str, regex.compile(unicode_spaces(pattern)).findall
        self.split_ascii = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t-\r").encode()).findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)  # ids that end a word
        self.ends[[i for x, i in vocabulary.items() if x.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: set[bytes]) -> None:
        known = self.known
        unknown: list[bytes] = []
        mixed: list[tuple[bytes, tuple[bytes, ...]]] = []
        parts: set[bytes] = set()
        for x in new:
            core = x[:-1] if x[-1] in b".," else x
            # letters alone are one part if normalisation leaves them as they are
            if core.isalpha() or (not x.isascii() and (y := core.decode()).isalpha() and y.islower() and is_normalized("NFC", y)):
                if core is x:
                    unknown.append(x)
                    continue
                own: tuple[bytes, ...] = (core, x[-1:])
            elif b"<|" in x:
                known[x] = self.whole(x.decode())
                continue
            else:
                own = tuple(self.split_ascii(x) if x.isascii() else [y.encode() for y in self.split(self.normalize(x.decode()))])
            mixed.append((x, own))
            parts.update(own)
        unknown += parts.difference(known, unknown)
        for at in range(0, len(unknown), 20_000):
            some = unknown[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            if len(ends) != len(some) + 1:  # a part that the tokenizer parts again
                known.update((x, self.whole(x.decode())) for x in some)
            else:
                known.update(zip(some, [data[i:j] for i, j in zip(ends, ends[1:], strict=False)], strict=True))
        for x, own in mixed:
            known[x] = b"".join([known[y] for y in own])

    def encode(self, found: list[bytes], block: int = 512) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text, one after the other."""
        for at in range(0, len(found), block):
            # the tokenizer lower-cases all but special tokens, so A-Z may go first and fewer chunks differ
            split = [x.split() if b"<|" in x else x.lower().split() for x in found[at : at + block]]
            new = set().union(*split).difference(self.known)
            if new:
                if len(self.known) > self.bound:
                    self.known.clear()
                    new = set().union(*split)
                gc.disable()  # many small lists, no cycles
                try:
                    self.learn(new)
                finally:
                    gc.enable()
            known = self.known
            for parts in split:
                yield b"".join([known[x] for x in parts])


_MEMOS: dict[str, WordMemo] = {}


def memo(path: str) -> WordMemo:
    if path not in _MEMOS:
        _MEMOS[path] = WordMemo(path)
    return _MEMOS[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """Each document's ids and the end id, cut at multiples of ``length``: one row a piece, with its checksum."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memo(tokenizer)
        end, width = np.array([END_ID], "<u4").tobytes(), 4 * length
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                ids += end
                rows += [(doc_id, at // 4, min(width, len(ids) - at) // 4, zlib.crc32(ids[at : at + width]), len(ids) // 4) for at in range(0, len(ids), width)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs).mapInArrow(frugal(cut), PIECE_SCHEMA)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, by first fit in the order given (sort by falling length before).

    ``tree`` is a tournament of the bins' free space: node i holds the larger of nodes 2i and 2i + 1, so the first bin
    with room is found, and its path mended, in the tree's height.
    """
    n = len(lengths)
    leaves = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = [0] * n, [0] * n
    for k, need in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node += node
            if tree[node] < need:
                node += 1
        free = tree[node]
        bins[k], offsets[k] = node - leaves, capacity - free
        tree[node] = free - need
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            top = left if left >= right else right
            if tree[node] == top:
                break
            tree[node] = top
            node >>= 1
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def pack(cut: DataFrame, length: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack pieces (PIECE_SCHEMA, each of at most ``length`` ids) into sequences; adds sequence_id and offset.

    Pieces are dealt to groups by a hash of their row, so no key can fill one group; the groups' number grows with
    the pieces and each is packed alone.
    """
    cut = materialize(cut, "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.drop(columns="g").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return dealt.groupBy("g").applyInPandas(one, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    return pack(pieces(docs, tokenizer, length), length)
