"""Phrase collocations by contiguous pattern growth over projected occurrences, in the way of PrefixSpan.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``; all
counts are a language's own (null: ``und``). A phrase is frequent if its words stand together in a piece ``least`` times.

1. Words and pairs are counted by hash: each task sends what it has counted, packed by buckets of the hash. Frequent
   words stay with their counts; of pairs each bucket gives its slice of a bitmap of 2^27 bits, which has all that can be frequent.
   A bit too many costs work, never results. Two bitmaps (frequent pairs, pairs of more than ``HOT`` places) are
   broadcast, and their size is fixed.
2. Each occurrence of a frequent pair projects a pointer: the words from there on, up to ``longest`` and to the first pair
   that isn't frequent. A task sends equal pointers once, with their number. All pointers of a pair go to one bucket, but
   those of a hot pair are dealt by their whole hash to many. In a bucket each pair is a prefix that grows to the right,
   depth first: the range of its pointers, sorted, falls apart by the next word, and each part that is frequent grows on. Parts of hot pairs
   are counted whole and summed by a shuffle.
3. Scores need the counts of both sides of every cut, which are frequent themselves: joins of the phrases to the phrases.
4. The texts of the words in the phrases that are left are looked up in the documents, by a bitmap of their hashes.

Words are told apart by 64-bit hashes of their language and text, phrases by the words' hashes in order; two words
with one hash in the result are an error, and n distinct words hold one with the hash of a frequent one with a chance of about n * frequent / 2^64.

* A null or empty text has no words; repeated rows count as often as they occur; texts of any length are read whole, by runs of words.
* An empty table gives an empty result. Ids aren't read and may be null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, chunks, frugal, materialize, mix, word_hashes

LEAST, LONGEST, TOP = 100, 5, 2000
#: Buckets of the first pass and bits of a bitmap, as powers of two. A bucket's slice is their quotient.
BUCKET_BITS, MAP_BITS = 12, 27
#: Pointers of a pair above which they are dealt to many buckets, and pointers of a bucket on average.
HOT, BUCKET = 1 << 20, 1 << 20
#: Words looked at together; distinct keys that a task gathers before it sends them; bytes of text that it takes apart at once.
RUN, GATHER, PORTION = 1 << 20, 1 << 20, 1 << 20
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(10, 14)]] = True
_PARTING = _PIECE.copy()
_PARTING[[9, 32]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Tokens:
    """Words of texts in order: hashes, whether the next word is of the same piece, places in ``data``."""

    hashes: np.ndarray
    joined: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: bytes


def tokens(found: list[bytes], lang: str) -> Tokens:
    """The words of texts of one language; the hash is never 0."""
    h, starts, ends, bounds = word_hashes(found, True, _PARTING)
    data = b" ".join(found) + b" "
    name = np.frombuffer(lang.encode().ljust(-(-len(lang.encode()) // 8) * 8 + 8, b"\0"), np.uint64)
    salt = np.uint64(0)
    for x in name:
        salt = mix(np.array([salt ^ x]))[0]
    h = np.maximum(mix(h ^ salt), np.uint64(1))
    breaks = np.zeros(len(h) + 1, bool)
    breaks[bounds[(bounds > 0)]] = True  # texts are parted
    cuts = np.flatnonzero(_PIECE[np.frombuffer(data, np.uint8)])
    breaks[np.searchsorted(starts, cuts)] = True  # a piece ends before the word that follows the cut
    joined = np.zeros(len(h), bool)
    if len(h) > 1:
        joined[:-1] = ~breaks[1:-1]
    return Tokens(h, joined, starts, ends, data)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Of each word and the next; 0 for the last."""
    out = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        out[:-1] = mix(h[:-1] * _STEP + h[1:])
    return out


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Tokens]]:
    """Tokens of about ``PORTION`` bytes of texts of one language at a time."""
    for b in batches:
        langs = b.column(0)
        for lang in langs.unique().to_pylist():
            own = b.filter(pa.compute.equal(langs, lang))
            for _, found in chunks(own, PORTION):
                yield lang, tokens(found, lang)


def _runs(t: Tokens) -> Iterator[tuple[int, int]]:
    for a in range(0, len(t.hashes), RUN):
        yield a, min(len(t.hashes), a + RUN)


def _input(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text")).filter("text <> ''")


class Counter:
    """Counts of 64-bit keys, merged by sorting whenever many have come together."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
            counts = counts.astype(np.int32)  # of one run
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts, self.size = [], [], 0
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.add.reduceat(counts[order], first, dtype=np.int64) if len(first) else counts[:0].astype(np.int64)


@dataclass(frozen=True)
class Maps:
    """Bitmaps over the leading bits of hashes: a bit is set for each hash that counts enough (and maybe for others)."""

    pairs: np.ndarray
    hot: np.ndarray

    @staticmethod
    def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@dataclass(frozen=True)
class Counts:
    """What the first pass gives: the pairs' bitmaps, an upper bound of the number of pointers, (h, n) of frequent words, (lang, n)."""

    maps: Maps
    pointers: int
    words: DataFrame
    totals: DataFrame


def count_words(docs: DataFrame, least: int, hot: int) -> Counts:
    """Count words and pairs. Words go by all 64 bits of their hash, pairs by 44, which can only add to a count."""
    buckets, spare = 1 << BUCKET_BITS, np.uint64(64 - BUCKET_BITS - 32)
    sent_names = ["bucket", "keys", "counts", "lang", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, totals = [Counter(), Counter()], {}

        def send(kind: int) -> pa.RecordBatch:
            keys, counts = kinds[kind].merged()
            ends = np.searchsorted(keys >> np.uint64(64 - BUCKET_BITS), np.arange(buckets + 1))
            own = np.flatnonzero(np.diff(ends))
            if kind:
                keys = ((keys >> spare) & np.uint64(0xFFFFFFFF)).astype("<u4")
            counts = counts.astype("<u4")
            kinds[kind] = Counter()
            return pa.RecordBatch.from_arrays([pa.array((own * 2 + kind).astype(np.int32)), *[pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in own], pa.binary()) for x in (keys, counts)], pa.nulls(len(own), pa.string()), pa.nulls(len(own), pa.int64())], names=sent_names)

        for lang, t in _by_language(batches):
            totals[lang] = totals.get(lang, 0) + len(t.hashes)
            pairs = pair_hashes(t.hashes)
            for a, b in _runs(t):
                kinds[0].add(t.hashes[a:b])
                kinds[1].add(pairs[a:b][t.joined[a:b]])
            for k in (0, 1):
                if kinds[k].size > GATHER:
                    yield send(k)
        for k in (0, 1):
            if kinds[k].size:
                yield send(k)
        if totals:
            n = len(totals)
            yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(list(totals)), pa.array(list(totals.values()), pa.int64())], names=sent_names)

    found_names = ["bucket", "frequent", "hot", "h", "lang", "n"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counter, totals = None, Counter(), {}

        def rows(length: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = dict(zip(found_names, [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int64()], strict=True))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(length, t)) for c, t in kinds.items()], names=found_names)

        def out() -> pa.RecordBatch:
            keys, counts = counter.merged()
            keep = counts >= least
            if now % 2 == 0:
                return rows(int(keep.sum()), h=pa.array(keys[keep].view(np.int64)), n=pa.array(counts[keep]))
            maps = []
            for low in (least, hot):
                bits = np.zeros(1 << (MAP_BITS - BUCKET_BITS), np.uint8)
                bits[(keys[counts >= low] >> np.uint64(32 + BUCKET_BITS - MAP_BITS)).astype(np.int64)] = 1
                maps.append(np.packbits(bits, bitorder="little").tobytes() if bits.any() else None)
            return rows(1, bucket=pa.array([now // 2], pa.int32()), frequent=pa.array(maps[:1], pa.binary()), hot=pa.array(maps[1:], pa.binary()), n=pa.array([int(counts[keep].sum())], pa.int64()))

        for b in batches:
            for bucket, keys, counts, lang, n in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if bucket < 0:
                    totals[lang] = totals.get(lang, 0) + n
                    continue
                if bucket != now:
                    if now is not None:
                        yield out()
                    now, counter = bucket, Counter()
                counter.add(np.frombuffer(keys, "<u4" if bucket % 2 else "<u8").astype(np.uint64), np.frombuffer(counts, "<u4").astype(np.int64))
        if now is not None:
            yield out()
        if totals:
            yield rows(len(totals), lang=pa.array(list(totals)), n=pa.array(list(totals.values()), pa.int64()))

    sent = _input(docs).mapInArrow(frugal(count), "bucket int, keys binary, counts binary, lang string, n long").repartition("bucket").sortWithinPartitions("bucket")
    found = materialize(sent.mapInArrow(frugal(add_up), "bucket int, frequent binary, hot binary, h long, lang string, n long"), "counts")
    slices = found.filter("frequent IS NOT NULL").select("bucket", "frequent", "hot", "n").toArrow()  # 2^27 bits at most
    size = 1 << (MAP_BITS - BUCKET_BITS - 3)
    maps = [np.zeros(1 << (MAP_BITS - 3), np.uint8) for _ in range(2)]
    for bucket, *parts in zip(*[slices[c].to_pylist() for c in ("bucket", "frequent", "hot")], strict=True):
        for bits, part in zip(maps, parts, strict=True):
            if part:
                bits[bucket * size : (bucket + 1) * size] = np.frombuffer(part, np.uint8)
    return Counts(Maps(*maps), sum(slices["n"].to_pylist()), found.filter("h IS NOT NULL").select("h", "n"), found.filter("lang IS NOT NULL").select("lang", "n"))


_LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def texts_of_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, word) of the hashes ``wanted`` (h, a stored table), as they occur in the documents."""
    shift = 64 - MAP_BITS
    slots = wanted.select(F.shiftrightunsigned("h", shift).alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()  # 2^27 bits at most
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[slots["at"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    known = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.empty(0, np.uint64)
        for _, t in _by_language(batches):
            for a, b in _runs(t):
                own = np.flatnonzero(Maps.has(known.value, t.hashes[a:b])) + a
                keys, first = np.unique(t.hashes[own], return_index=True)
                new = ~np.isin(keys, told)
                keys, places = keys[new], own[first[new]]
                if len(keys):
                    told = np.union1d(told, keys) if len(told) < GATHER else keys
                    words = [t.data[t.starts[i] : t.ends[i]].translate(_LOWERED).decode(errors="replace") for i in places.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(words, pa.string())], names=["h", "word"])

    named = _input(docs).mapInArrow(frugal(run), "h long, word string").join(wanted.select("h"), "h", "left_semi").groupBy("h").agg(F.min("word").alias("word"), F.max("word").alias("last"))
    same = F.when(F.col("word") == F.col("last"), F.col("word")).otherwise(F.raise_error(F.lit("two words have one hash")).cast("string"))
    return named.select("h", same.alias("word"))


def pointers_of(t: Tokens, a: int, b: int, maps: Maps, longest: int) -> np.ndarray:
    """Rows of ``longest`` words (0 where a pointer ends) for each frequent pair that begins in words a to b."""
    stop = min(len(t.hashes), b + longest - 1)
    h, joined = t.hashes[a:stop], t.joined[a:stop].copy()
    on = joined & Maps.has(maps.pairs, pair_hashes(h))
    on[-1:] = False
    at = np.flatnonzero(on[: b - a])
    out = np.zeros((len(at), longest), np.uint64)
    out[:, 0] = h[at]
    going = np.ones(len(at), bool)
    for k in range(1, longest):
        place = at + k
        going = going & (place < len(h)) & on[np.minimum(place - 1, len(h) - 1)]
        out[going, k] = h[place[going]]
    return out


def merged_pointers(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows once, with the sum of their counts and a hash of each."""
    whole = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            whole = mix(whole * _STEP + rows[:, k])
    order = np.argsort(whole, kind="stable")
    new = np.ones(len(rows), bool)
    new[1:] = whole[order[1:]] != whole[order[:-1]]
    for k in range(rows.shape[1]):  # a column at a time: a copy of all rows would double what a task holds
        column = rows[order, k]
        new[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(new)
    counts = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    at = order[first]
    return rows[at], counts, whole[at]


def gathered(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The rows and the counts of all parts, which are let go."""
    rows, counts = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    parts.clear()
    return rows, counts


def _pack(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Lengths, and the words that there are."""
    lengths = (rows != 0).sum(axis=1).astype(np.uint8)
    return lengths.tobytes(), rows[rows != 0].astype("<u8").tobytes()


def _unpack(lengths: bytes, words: bytes, longest: int) -> np.ndarray:
    n = np.frombuffer(lengths, np.uint8)
    out = np.zeros((len(n), longest), np.uint64)
    out[np.arange(longest)[None, :] < n[:, None]] = np.frombuffer(words, "<u8")
    return out


def grow(rows: np.ndarray, counts: np.ndarray, least: np.ndarray, emit) -> None:
    """Depth first: ``emit(words, count)`` for each prefix of 2 words and more that counts enough.

    ``rows`` are sorted pointers; ``least`` is what a prefix must count, for each row (the same within a pair).
    """
    sums = np.concatenate(([0], np.cumsum(counts)))
    starts = np.flatnonzero(np.concatenate(([True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])))) if len(rows) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(rows))
    totals = sums[ends] - sums[starts]
    longest = rows.shape[1]

    def extend(lo: int, hi: int, depth: int, low: int) -> None:
        if depth == longest:
            return
        column = rows[lo:hi, depth]
        lo += int(np.searchsorted(column, 0, "right"))  # pointers that end here
        if lo == hi or sums[hi] - sums[lo] < low:
            return
        column = rows[lo:hi, depth]
        cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
        edges = [lo, *(cuts + lo).tolist(), hi]
        for a, b in zip(edges, edges[1:], strict=False):
            n = int(sums[b] - sums[a])
            if n >= low:
                emit(rows[a, : depth + 1], n)
                extend(a, b, depth + 1, low)

    for i in np.flatnonzero(totals >= least[starts]) if len(rows) else ():
        a, b = int(starts[i]), int(ends[i])
        emit(rows[a, :2], int(totals[i]))
        extend(a, b, 2, int(least[a]))


def frequent_phrases(docs: DataFrame, maps: Maps, pointers: int, least: int, longest: int) -> DataFrame:
    """(lang, words array<long>, n) of all phrases of 2 to ``longest`` words that occur ``least`` times."""
    session = docs.sparkSession
    known = session.sparkContext.broadcast(maps)
    buckets = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-pointers // BUCKET))

    def bucket_of(rows: np.ndarray, whole: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            pair = mix(rows[:, 0] * _STEP + rows[:, 1])
        return (mix(np.where(Maps.has(known.value.hot, pair), pair ^ whole, pair)) % np.uint64(buckets)).astype(np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size = {}, 0

        def send(lang: str) -> pa.RecordBatch:
            rows, counts, whole = merged_pointers(*gathered(have[lang]))
            bucket = bucket_of(rows, whole)
            order = np.lexsort((rows[:, 1], rows[:, 0], bucket))
            rows, counts, bucket = rows[order], counts[order].astype("<u4"), bucket[order]
            own, starts = np.unique(bucket, return_index=True)
            parts = [(*_pack(rows[a:b]), counts[a:b].tobytes()) for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array([lang] * len(own), pa.string()), *[pa.array(x, pa.binary()) for x in zip(*parts, strict=True)]], names=["bucket", "lang", "lengths", "words", "counts"])

        for lang, t in _by_language(batches):
            for a, b in _runs(t):
                rows = pointers_of(t, a, b, known.value, longest)
                if len(rows):
                    rows, counts, _ = merged_pointers(rows, np.ones(len(rows), np.int64))
                    have.setdefault(lang, []).append((rows, counts))
                    size += len(rows)
            if size > GATHER // 2:
                yield from map(send, have)
                have, size = {}, 0
        yield from map(send, have)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, []

        def out() -> pa.RecordBatch:
            rows, counts, _ = merged_pointers(*gathered(have))
            order = np.lexsort(tuple(rows[:, k] for k in reversed(range(longest))))
            rows, counts = rows[order], counts[order]
            with np.errstate(over="ignore"):
                hot = Maps.has(known.value.hot, mix(rows[:, 0] * _STEP + rows[:, 1]))
            words, lengths, found = [], [], []

            def emit(phrase: np.ndarray, n: int) -> None:
                words.append(phrase)
                lengths.append(len(phrase))
                found.append(n)

            grow(rows, counts, np.where(hot, 1, least), emit)
            flat = np.concatenate(words).view(np.int64) if words else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array([now[1]] * len(found), pa.string()), lists, pa.array(found, pa.int64())], names=["lang", "words", "n"])

        for b in batches:
            for bucket, lang, lengths, words, counts in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if (bucket, lang) != now:
                    if have:
                        yield out()
                    now, have = (bucket, lang), []
                have.append((_unpack(lengths, words, longest), np.frombuffer(counts, "<u4").astype(np.int64)))
        if have:
            yield out()

    sent = _input(docs).mapInArrow(frugal(project), "bucket long, lang string, lengths binary, words binary, counts binary").repartition("bucket").sortWithinPartitions("bucket", "lang")
    grown = sent.mapInArrow(frugal(mine), "lang string, words array<long>, n long")
    found = materialize(grown.groupBy("lang", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases")
    known.unpersist()
    return found


def score(a: str, n: str, l: str, r: str) -> Column:
    """``floor(1000 * a * n / (l * r))`` in whole numbers of up to 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return F.call_function("div", wide(a) * F.lit(1000).cast("decimal(4,0)") * wide(n), wide(l) * wide(r)).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    A cut's score is ``floor(1000 * a * n / (l * r))``; a phrase has the lowest of its cuts, the first of equal ones. Phrases that a longer frequent one holds as
    often as they occur are left out. Order: score, then a, falling; then the phrase's bytes.
    """
    counted = count_words(docs, least, hot)
    phrases = frequent_phrases(docs, counted.maps, counted.pointers, least, longest)
    counts = materialize(phrases.select("words", "n").unionByName(counted.words.select(F.array("h").alias("words"), "n")), "sides")
    # a longer phrase that holds this one as often shows in one that is longer by one word
    shorter = phrases.filter(F.size("words") > 2).select(F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), "n").distinct()
    kept = phrases.join(shorter, ["words", "n"], "left_anti").select("lang", "words", F.col("n").alias("a"))
    cuts = kept.select("lang", "words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).select("*", F.expr("slice(words, 1, k)").alias("first"), F.expr("slice(words, k + 1, size(words) - k)").alias("rest"))
    sided = cuts.join(counts.select(F.col("words").alias("first"), F.col("n").alias("l")), "first").join(counts.select(F.col("words").alias("rest"), F.col("n").alias("r")), "rest")
    scored = sided.join(counted.totals, "lang").withColumn("score", score("a", "n", "l", "r"))
    best = scored.groupBy("words", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = best.select("words", "lang", "a", "n", "cut.l", "cut.r", "cut.score")
    near = ranked.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top).drop("place")
    near = materialize(near, "near")  # the first ones and those that tie with the last
    names = texts_of_words(docs, near.select(F.explode("words").alias("h")).distinct())
    spelt = near.select("words", F.posexplode("words").alias("i", "h")).join(names, "h").groupBy("words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return near.join(spelt, "words").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
