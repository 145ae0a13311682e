"""Substring deduplication with compact windows.

Every run of five words is a token. A stretch of ``least`` words with 75 % of common tokens has at most one edit inside, so
a run of 24 words in it is equal, edited words aside. The hashes of runs of ``KEY`` words have a Cartesian tree over each
text; each node has the widest run in which its hash is the least: a compact window. Nodes of windows of 13 and more, the top
of the tree, are the minima of all 13 runs on end, so each 24 equal words hold a node that both texts have, under one key.
Places of one key are alike if 44 equal words on end hold the key, or if 24 or more end at an edit of a few words and go on
beyond it, with 48 words in all. Each such pair of runs is a hash, and places with one hash meet by sorting: the work grows
with the places, not with their pairs, and no document hides another. The texts of pairs that meet are then compared and
what repeats is a span.

A span is a run of words in which each stretch of ``least`` words has the stated Jaccard similarity of five-word tokens
with the other text (equal passages, or near-equal ones), trimmed to tokens that both have.

* Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. Texts of fewer than ``least`` words have no spans, nor
  have null or empty ones. Only repeats across documents count; the document with the least id keeps its passage.
* A unit is a text, named by its 64-bit hash; it belongs to the least document that has it. Further documents with it are
  spans as a whole. Repeated rows are one; an id with several texts has spans for each of them (``unit`` tells which).
* Rows without an id have no spans. Extra columns, whatever their names, are ignored by ``repeats`` and kept by
  ``without_repeats``. Texts of any length are used whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, bounded_batches, chunks, free_name, frugal, hot_join, materialize, materialize_by, mix, shingles, word_hashes

LEAST, WIDTH, KEY = 50, 5, 12
#: Words that an edit takes at most.
GAP = 4
#: Places of a key that one task holds at most (about 1 KB each); keys of more are met by grouping their hashes.
HOT = 50_000


def compact_windows(values: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, left, right) of the compact windows of at least ``least`` tokens, by places in ``values``, ends included.

    Nodes with such windows are the places of the minima of all runs of ``least`` tokens; ancestors of a node in the
    Cartesian tree have wider windows, so the tree over these nodes alone gives their windows' bounds. Of equal values
    the leftmost is the less.
    """
    n = len(values)
    counts = np.diff(bounds)
    if n < least or not (counts >= least).any():
        return (np.empty(0, np.int64),) * 3
    # value and place in one number: the place decides between equal values
    bits = max(1, int(n - 1).bit_length())
    mask = np.uint64((1 << bits) - 1)
    keyed = (values & ~mask) | np.arange(n, dtype=np.uint64)
    lows, width = keyed, 1
    while 2 * width <= least:
        lows = np.minimum(lows[:-width], lows[width:])
        width *= 2
    if width < least:
        lows = np.minimum(lows[: n - least + 1], lows[least - width : n - width + 1])
    starts = np.arange(n - least + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[starts] == text[starts + least - 1]
    nodes = np.unique((lows[inside] & mask).astype(np.int64))
    lefts, rights = np.empty(len(nodes), np.int64), np.empty(len(nodes), np.int64)
    firsts, lasts = bounds[text[nodes]].tolist(), (bounds[text[nodes] + 1] - 1).tolist()
    stack: list[tuple[int, int, int]] = []  # (keyed value, place, index of node)
    last_text = -1
    for k, (place, value, first, last) in enumerate(zip(nodes.tolist(), keyed[nodes].tolist(), firsts, lasts, strict=True)):
        if first != last_text:
            stack.clear()
            last_text = first
        while stack and stack[-1][0] > value:
            rights[stack.pop()[2]] = place - 1
        lefts[k] = stack[-1][1] + 1 if stack else first
        rights[k] = last  # until a lesser node comes
        stack.append((value, place, k))
    return nodes, lefts, rights


def distinct_places(key: np.ndarray, text: np.ndarray, start: np.ndarray, words: np.ndarray, bounds: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, ...]:
    """The places of a text under one key, one of those with equal words about them.

    Texts that repeat a few words on and on have a window at every place. Only places with the same words from ``reach``
    before the key's ``width`` words to ``reach`` after them are alike; places nearer to an end of the text are kept.
    """
    if not len(key):
        return key, text, start
    order = np.lexsort((start, key, text))
    key, text, start = key[order], text[order], start[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
    group = np.cumsum(new) - 1
    begin = bounds[text] + start - reach
    several = np.flatnonzero((np.bincount(group)[group] > 1) & (start >= reach) & (begin + width + 2 * reach <= bounds[text + 1]))
    about = np.zeros(len(several), np.uint64)
    for i in range(width + 2 * reach):
        about = about * np.uint64(0xD6E8FEB86659FD93) + words[begin[several] + i]
    keep = np.ones(len(key), bool)
    keep[several] = False
    at = np.lexsort((several, about, group[several]))
    if len(at):
        again = np.concatenate(([False], (about[at][1:] == about[at][:-1]) & (group[several][at][1:] == group[several][at][:-1])))
        keep[several[at[~again]]] = True
    return key[keep], text[keep], start[keep]


def key_words(least: int, percent: int) -> tuple[int, int]:
    """(words of a key, keys of which the least is taken): so many keys lie within the equal run of ``needed``."""
    equal = max(1, needed(least, percent)[1])
    tokens = max(1, min(KEY - WIDTH + 1, equal))
    return tokens + WIDTH - 1, equal - tokens + 1


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, text): rows with an id and a text; ``unit`` is the text's hash."""
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("unit"), text.alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


def units_of(docs: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """(doc_id, text, unit) of the rows among ``wanted`` (doc_id, unit), a stored table, or of all others."""
    some = wanted.select("doc_id", "unit").distinct()
    return units(docs).join(F.broadcast(some) if some.count() <= BROADCAST_IDS else some, ["doc_id", "unit"], how).select("doc_id", "text", "unit")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, first_id): documents with a text that belongs to a lesser document, stored."""
    rows = units(docs).select("doc_id", "unit").distinct()
    several = rows.groupBy("unit").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = materialize(several, "copied")
    return materialize(hot_join(rows, several.drop("n"), "unit", several.select("unit", "n"), how="inner").filter("doc_id > first_id"), "copies")


def windows(docs: DataFrame, least: int = LEAST, percent: int = 75, but: DataFrame | None = None) -> DataFrame:
    """(key, doc_id, unit, place): nodes of the compact windows of runs of words, each filed under its own words; not of the texts in ``but``."""
    bounded_batches(docs.sparkSession)
    size, among = key_words(least, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_unit = 0
            for ids, found in chunks(batch.select([0, 1]), 8 << 20):
                unit = batch.column(2).slice(at_unit, len(ids)).to_numpy()
                at_unit += len(ids)
                words, _, _, bounds = word_hashes(found, lower=True)
                keys, at = shingles(words, bounds, size)
                node, _, _ = compact_windows(mix(keys ^ np.uint64(0x9E3779B97F4A7C15)), at, among)
                text = np.repeat(np.arange(len(found)), np.diff(at))[node]
                fits = np.diff(bounds)[text] >= least
                node, text = node[fits], text[fits]
                doc = np.array(ids, np.int64)
                key, text, start = distinct_places(keys[node], text, node - at[text], words, bounds, size, least)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc[text]), pa.array(unit[text]), pa.array(start.astype(np.int32))], names=["key", "doc_id", "unit", "place"])

    rows = units_of(docs, but, "left_anti") if but is not None else units(docs).select("doc_id", "text", "unit")
    return rows.mapInArrow(frugal(run), "key long, doc_id long, unit long, place int")


def needed(least: int, percent: int) -> tuple[int, int]:
    """(tokens that a stretch of ``least`` words has in common at least, tokens of its longest equal run at least).

    An edit within the stretch takes ``WIDTH - 1`` tokens at least, which bounds the number of equal runs.
    """
    width = least - WIDTH + 1
    need = -(-2 * width * percent // (100 + percent))
    return need, need // ((width - need) // (WIDTH - 1) + 1)


class Shape:
    """What places that are alike have in common, in words: see ``repeats``.

    ``need`` equal words on end that hold the key; or ``run`` of them or more that end at an edit, beyond which ``WIDTH`` or
    more are equal too, both together ``need`` and ``WIDTH - 1`` more. Edits of at most ``edit`` words in the greater
    document, of at most ``GAP`` in the lesser one.
    """

    def __init__(self, least: int, percent: int):
        need, equal = needed(least, percent)
        self.size, _ = key_words(least, percent)
        self.need, self.run = need + WIDTH - 1, max(equal + WIDTH - 1, self.size)
        self.beyond = self.need - self.run  # most tokens beyond the edit
        self.edit = min(GAP, least - WIDTH + 1 - need - (WIDTH - 1))
        self.reach = max(self.need - self.size, self.run + GAP + self.beyond + WIDTH - 1 - self.size, 1)


def shared_places(own: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(unit, doc_id, places) of all windows under keys of two documents or more: of keys of up to ``hot`` places, and of the others."""
    keys = own.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    met = own.join(keys.select("key", (F.col("n") > hot).alias("hot")), "key").select("unit", "doc_id", "place", "hot")
    met = materialize_by(met, "places", "unit", lambda x: x.groupBy("unit", "doc_id", "hot").agg(F.sort_array(F.collect_set("place")).alias("places")))
    return met.filter("NOT hot").drop("hot"), met.filter("hot").drop("hot")


def stored_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, unit) of the texts among ``wanted`` (doc_id, unit), each once, stored in buckets of ``unit``: they are shuffled here alone."""
    return materialize_by(units_of(docs, wanted), "texts", "unit", lambda x: x.dropDuplicates(["unit"]))


def contexts(docs: DataFrame, places: DataFrame, shape: Shape, stored: DataFrame | None = None) -> DataFrame:
    """(key, doc_id, unit, place, around): a byte of each word's hash about the places; 0 outside of the text.

    ``stored``: the texts by ``stored_texts``; else those of ``docs``, whose copies have their contexts too.
    """
    bounded_batches(docs.sparkSession)
    joined = units_of(docs, places).join(places, ["doc_id", "unit"]) if stored is None else stored.join(places.drop("doc_id"), "unit")
    about = np.arange(-shape.reach, shape.size + shape.reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units, at = batch.column(0).to_pylist(), batch.column(2).to_pylist(), 0
            for _, found in chunks(batch.select([0, 1])):
                words, _, _, bounds = word_hashes(found, lower=True)
                keys, key_at = shingles(words, bounds, shape.size)
                short = (words % np.uint64(0xFF) + np.uint64(1)).astype(np.uint8)
                for k in range(len(found)):
                    own = np.array(batch.column(3)[at + k].as_py(), np.int64)
                    for x in range(0, len(own), 20_000):
                        some = own[x : x + 20_000]
                        where = some[:, None] + about + bounds[k]
                        inside = (where >= bounds[k]) & (where < bounds[k + 1])
                        around = np.where(inside, short[np.clip(where, 0, len(short) - 1)], np.uint8(0))
                        around = pa.Array.from_buffers(pa.binary(len(about)), len(some), [None, pa.py_buffer(np.ascontiguousarray(around))]).cast(pa.binary())
                        same = lambda v: pa.array(np.full(len(some), v, np.int64))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([pa.array(keys[key_at[k] + some].view(np.int64)), same(ids[at + k]), same(units[at + k]), pa.array(some.astype(np.int32)), around], names=["key", "doc_id", "unit", "place", "around"])
                at += len(found)

    return joined.select("doc_id", "text", "unit", "places").mapInArrow(frugal(run), "key long, doc_id long, unit long, place int, around binary")


class Around:
    """Contexts of some places, rows in the order of key and document, with hashes of any run of their words."""

    def __init__(self, key: np.ndarray, doc: np.ndarray, around: list[bytes], shape: Shape):
        self.doc, self.shape, self.seed = doc, shape, mix(key.view(np.uint64))
        self.words = np.ascontiguousarray(np.frombuffer(b"".join(around), np.uint8).reshape(len(key), -1).T)
        self.sums = np.zeros((len(self.words) + 1, len(key)), np.uint64)
        for i, word in enumerate(self.words):
            np.multiply(self.sums[i], _STEP, out=self.sums[i + 1])
            self.sums[i + 1] += word

    def run(self, start: int | np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        return self.sums[start + n, rows] - self.sums[start, rows] * np.uint64(pow(int(_STEP), n, 1 << 64))

    def inside(self, start: int | np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        return (self.words[start, rows] != 0) & (self.words[start + n - 1, rows] != 0)

    def exact(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, rows) of each run of ``need`` words that holds the key."""
        s, rows = self.shape, np.arange(len(self.doc))
        for start in range(s.reach + s.size - s.need, s.reach + 1):
            own = rows[self.inside(start, s.need, rows)]
            yield mix(self.run(start, s.need, own) ^ self.seed[own]), own

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, hashes, rows) of each run of ``run`` words that holds the key."""
        s, rows = self.shape, np.arange(len(self.doc))
        for start in range(s.reach + s.size - s.run, s.reach + 1):
            own = rows[self.inside(start, s.run, rows)]
            yield start, mix(self.run(start, s.run, own) ^ self.seed[own]), own

    def beyond(self, start: int, after: bool, gaps: np.ndarray, n: int) -> np.ndarray:
        """Where the ``n`` words beyond edits of ``gaps`` words after (or before) the run at ``start`` begin."""
        return start + self.shape.run + gaps if after else start - gaps - n

    def edits(self, start: int, after: bool, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, words beside the run, rows, gaps): the run at ``start`` and ``WIDTH`` words beyond an edit of each size."""
        gaps, rows = np.repeat(np.arange(GAP + 1), len(rows)), np.tile(rows, GAP + 1)
        at = self.beyond(start, after, gaps, WIDTH)
        keep = self.inside(at, WIDTH, rows)
        gaps, rows, at = gaps[keep], rows[keep], at[keep]
        value = mix(mix(self.run(start, self.shape.run, rows) ^ self.seed[rows]) + mix(self.run(at, WIDTH, rows)))
        return value, self.words[start + self.shape.run if after else start - 1, rows], rows, gaps

    def both(self, start: int, after: bool, n: int, rows: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, which of the rows have them): ``n`` tokens beyond the edit, and as many before it as make up the rest."""
        s, words = self.shape, n + WIDTH - 1
        own, at = s.need - n, self.beyond(start, after, gaps, words)
        first = start + s.run - own if after else start
        have = self.inside(first, own, rows) & self.inside(at, words, rows)
        rows, at = rows[have], at[have]
        return mix(mix(self.run(first, own, rows) ^ self.seed[rows]) + mix(self.run(at, words, rows) + np.uint64(n))), have


_STEP = np.uint64(0xD6E8FEB86659FD93)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, begin of each group of equal values in it, size of each)."""
    order = np.argsort(values)
    begin = np.flatnonzero(np.concatenate(([True], values[order][1:] != values[order][:-1])))
    return order, begin, np.diff(np.append(begin, len(values)))


def least_alike(a: Around) -> np.ndarray:
    """For each row the least row of its key and a lesser document that is alike, or -1. Equal hashes are met by sorting; no pairs are compared."""
    n, doc = len(a.doc), a.doc
    best = np.full(n, n)

    def meet(values: np.ndarray, rows: np.ndarray, may: np.ndarray | None = None) -> None:
        if len(values) > 1:
            order, begin, sizes = _groups(values)
            first = np.repeat(np.minimum.reduceat(rows[order], begin), sizes)
            own = rows[order]
            hit = doc[first] < doc[own]
            if may is not None:
                hit &= may[order]
            np.minimum.at(best, own[hit], first[hit])

    def hopeful(values: np.ndarray, rows: np.ndarray, beside: np.ndarray | None = None) -> np.ndarray:
        """Rows of groups in which a row that has no partner yet may find one."""
        out = np.zeros(len(rows), bool)
        if len(values) > 1:
            order, begin, sizes = _groups(values)
            own = rows[order]
            asks = (best[own] == n) & (doc[np.repeat(np.minimum.reduceat(own, begin), sizes)] < doc[own])
            some = np.logical_or.reduceat(asks, begin)
            if beside is not None:  # if all have the same word there, it isn't edited
                some &= np.minimum.reduceat(beside[order], begin) < np.maximum.reduceat(beside[order], begin)
            out[order] = np.repeat(some, sizes)
        return out

    for values, rows in a.exact():
        meet(values, rows)
    if a.shape.edit >= 0 and a.shape.beyond > 0:
        for start, values, rows in a.runs():
            found = rows[hopeful(values, rows)]
            for after in (True, False) if len(found) else ():
                values, beside, rows, gaps = a.edits(start, after, found)
                keep = hopeful(values, rows, beside)
                rows, gaps = rows[keep], gaps[keep]
                for tokens in range(1, a.shape.beyond + 1):
                    if not len(rows):
                        break
                    values, have = a.both(start, after, tokens, rows, gaps)
                    meet(values, rows[have], gaps[have] <= a.shape.edit)
                    words = tokens + WIDTH
                    on = a.inside(a.beyond(start, after, gaps, words), words, rows) if tokens < a.shape.beyond else np.zeros(len(rows), bool)
                    rows, gaps = rows[on], gaps[on]
                    values = mix(a.run(start, a.shape.run, rows) ^ a.seed[rows]) + mix(a.run(a.beyond(start, after, gaps, words), words, rows))
                    on = hopeful(values, rows)
                    rows, gaps = rows[on], gaps[on]
    return np.where(best < n, best, -1)


def candidates(around: DataFrame, shape: Shape) -> DataFrame:
    """(first_unit, unit): for each place the least document that is alike about it, among all documents of its key."""
    bounded_batches(around.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            key, doc, unit = (table.column(i).to_numpy() for i in range(3))
            best = least_alike(Around(key, doc, table.column(3).to_pylist(), shape))
            target = np.flatnonzero(best >= 0)
            both = np.unique(np.column_stack((unit[best[target]], unit[target])), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["first_unit", "unit"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if held and (cut or held[-1].column(0)[held[-1].num_rows - 1].as_py() != key[0]):
                if rows >= 30_000:
                    yield pairs([*held, batch.slice(0, cut)] if cut else held)
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield pairs(held)

    dealt = around.select("key", "doc_id", "unit", "around").repartition("key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(frugal(run), "first_unit long, unit long").distinct()


def least_of(met: DataFrame) -> DataFrame:
    """(first_unit, unit) from (value, doc_id, unit, may): each that may with the least document of its value, if lesser."""
    least = met.groupBy("value").agg(F.min(F.struct("doc_id", "unit")).alias("first"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).filter("first.doc_id < high")
    least = materialize(least.select("value", "first", "n"), "least")
    pairs = hot_join(met.filter("may"), least.drop("n"), "value", least.select("value", "n"), how="inner").filter("first.doc_id < doc_id")
    return pairs.select(F.col("first.unit").alias("first_unit"), "unit").distinct()


def hot_candidates(around: DataFrame, shape: Shape) -> DataFrame:
    """As ``candidates``, for keys of very many places: hashes are met by grouping rows of them, so no task holds a key.

    Two rounds for edits: the run and the words next beyond the edit first, and all lengths for what meets in them.
    """
    bounded_batches(around.sparkSession)
    around = materialize(around.withColumn("row", F.monotonically_increasing_id()), "hot-contexts")
    names = ["value", "doc_id", "unit", "may"]

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Around]]:
        key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        yield batch, Around(key, doc, batch.column(4).to_pylist(), shape)

    def out(batch: pa.RecordBatch, values: np.ndarray, rows: np.ndarray, may: np.ndarray) -> pa.RecordBatch:
        doc, unit = (batch.column(i).to_numpy()[rows] for i in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(doc), pa.array(unit), pa.array(may)], names=names)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a in (x for b in batches for x in blocks(b)):
            for values, rows in a.exact():
                yield out(batch, values, rows, np.ones(len(rows), bool))

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a in (x for b in batches for x in blocks(b)):
            doc, row = batch.column(1).to_numpy(), batch.column(5).to_numpy()
            for start, _, own in a.runs():
                for after in (False, True):
                    values, beside, rows, gaps = a.edits(start, after, own)
                    code = (start * 2 + after) * (GAP + 1) + gaps
                    yield pa.RecordBatch.from_arrays([pa.array((values + np.uint64(after)).view(np.int64)), pa.array(beside.astype(np.int16)), pa.array(doc[rows]), pa.array(row[rows]), pa.array(code.astype(np.int32))], names=["value", "beside", "doc_id", "row", "code"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a in (x for b in batches for x in blocks(b)):
            lists = batch.column(6).combine_chunks() if isinstance(batch.column(6), pa.ChunkedArray) else batch.column(6)
            rows_of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            codes = lists.flatten().to_numpy().astype(np.int64)
            for code in np.unique(codes // (GAP + 1)).tolist():
                at = codes // (GAP + 1) == code
                rows, gaps, after = rows_of[at], codes[at] % (GAP + 1), bool(code % 2)
                for tokens in range(1, shape.beyond + 1):
                    on = a.inside(a.beyond(code // 2, after, gaps, tokens + WIDTH - 1), tokens + WIDTH - 1, rows)
                    rows, gaps = rows[on], gaps[on]
                    values, have = a.both(code // 2, after, tokens, rows, gaps)
                    yield out(batch, mix(values + np.uint64(code)), rows[have], gaps[have] <= shape.edit)

    found = least_of(around.mapInArrow(frugal(exact), "value long, doc_id long, unit long, may boolean"))
    if shape.edit < 0 or shape.beyond <= 0:
        return found
    first = around.mapInArrow(frugal(edits), "value long, beside short, doc_id long, row long, code int")
    several = first.groupBy("value").agg(F.min("beside").alias("a"), F.max("beside").alias("b"), F.min("doc_id").alias("c"), F.max("doc_id").alias("d")).filter("a < b AND c < d").select("value")
    asked = first.join(several, "value", "left_semi").groupBy("row").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    met = around.join(asked, "row").select(*around.columns, "codes").mapInArrow(frugal(both), "value long, doc_id long, unit long, may boolean")
    return found.unionByName(least_of(met)).distinct()


def repeated_spans(first: np.ndarray, tokens: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """Spans (first word, word after the last) of a text, by its tokens, that the other text's tokens (sorted) repeat."""
    width = least - WIDTH + 1
    if len(tokens) < width or not len(first):
        return []
    same = first[np.minimum(np.searchsorted(first, tokens), len(first) - 1)] == tokens
    sums = np.concatenate(([0], np.cumsum(same)))
    # c common of width each: 100 c >= percent * (2 width - c)
    need = -(-2 * width * percent // (100 + percent))
    good = np.flatnonzero(sums[width:] - sums[:-width] >= need)
    if not len(good):
        return []
    marks = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(marks, good, 1)
    np.add.at(marks, good + width, -1)
    covered = np.concatenate(([False], np.cumsum(marks[:-1]) > 0, [False]))
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    out = []
    for a, b in edges.reshape(-1, 2).tolist():
        both = np.flatnonzero(same[a:b])
        out.append((a + int(both[0]), a + int(both[-1]) + WIDTH))
    return out


def verify(pairs: DataFrame, found: DataFrame, least: int = LEAST, percent: int = 75) -> DataFrame:
    """(unit, doc_id, first_id, start_word, end_word): what the pairs' (first_unit, unit) texts repeat. ``found``: the texts by ``stored_texts``."""
    bounded_batches(found.sparkSession)
    pairs = materialize(pairs, "pairs")
    first = found.select(F.col("unit").alias("first_unit"), F.col("doc_id").alias("first_id"), F.col("text").alias("first_text"))
    both = pairs.join(found, "unit").join(first, "first_unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, own, first_ids, ids = (batch.column(i).to_pylist() for i in range(4))
            text = {u: x for at, of in ((4, firsts), (5, own)) for u, x in zip(of, batch.column(at).cast(pa.binary()).to_pylist(), strict=True)}
            tokens: dict[int, np.ndarray] = {}
            for some, raw in chunks(pa.RecordBatch.from_arrays([pa.array(list(text), pa.int64()), pa.array(list(text.values()), pa.binary())], names=["i", "t"])):
                words, _, _, bounds = word_hashes(raw, lower=True)
                values, at = shingles(words, bounds, WIDTH)
                tokens |= {u: values[x:y] for u, x, y in zip(some, at, at[1:], strict=False)}
            ordered = {u: np.sort(tokens[u]) for u in {*firsts}}
            rows = [(u, d, f, a, b) for first_unit, u, f, d in zip(firsts, own, first_ids, ids, strict=True) for a, b in repeated_spans(ordered[first_unit], tokens[u], least, percent)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["unit", "doc_id", "first_id", "start_word", "end_word"])

    return both.select("first_unit", "unit", "first_id", "doc_id", "first_text", "text").mapInArrow(frugal(run), "unit long, doc_id long, first_id long, start_word long, end_word long")


def repeats(docs: DataFrame, least: int = LEAST, percent: int = 75, hot: int = HOT) -> DataFrame:
    """(doc_id, unit, start_word, end_word, first_id): merged spans of each document's text, and the least document that has one."""
    shape, copied = Shape(least, percent), copies(docs)
    cold, crowded = shared_places(windows(docs, least, percent, copied), hot)
    stored = stored_texts(docs, cold.select("unit", "doc_id").unionByName(crowded.select("unit", "doc_id")))
    pairs = candidates(contexts(docs, cold, shape, stored), shape)
    if crowded.limit(1).count():
        pairs = pairs.unionByName(hot_candidates(contexts(docs, crowded, shape, stored), shape)).distinct()
    spans = verify(pairs, stored, least, percent)
    own = Window.partitionBy("unit").orderBy("start_word", "end_word")
    past = F.max("end_word").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("new", (past.isNull() | (F.col("start_word") >= past)).cast("int"))
    parts = parts.withColumn("part", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy("unit", "doc_id", "part").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_id").alias("first_id"))
    whole = units_of(docs, copied).distinct().select("doc_id", "unit", F.lit(0).cast("long").alias("start_word"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("end_word"))
    whole = whole.filter(F.col("end_word") >= least).join(copied, ["doc_id", "unit"])
    names = ["doc_id", "unit", "start_word", "end_word", "first_id"]
    return merged.select(*names).unionByName(whole.select(*names))


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans (of ``repeats``) cut out of ``text``; other columns stay but ``n_chars``, which follows it.

    White space before a span goes with it. Documents stay, with what is left of their text. Spans go by id and text.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at, extra = names.index("text"), len(names)
    cut, unit = free_name(docs, "spans"), free_name(docs, "unit")
    by_doc = spans.groupBy(F.col("doc_id"), F.col("unit").alias(unit)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cut))
    joined = docs.withColumn(unit, F.xxhash64(docs["text"].cast("string"))).join(by_doc, ["doc_id", unit], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, cuts = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(extra).to_pylist()
            for i, spans_of in enumerate(cuts):
                if spans_of:
                    _, starts, ends, _ = word_hashes([found[i]])
                    kept, done = [], 0
                    for s in spans_of:
                        a, b = s["start_word"], s["end_word"]
                        kept.append(found[i][done : ends[a - 1] if a else 0])
                        done = ends[b - 1]
                    found[i] = b"".join([*kept, found[i][done:]])
            columns = [pa.array(found, pa.binary()).cast(pa.string()) if k == at else batch.column(k) for k in range(extra)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.select(*docs.columns, cut).mapInArrow(frugal(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
