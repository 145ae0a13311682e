"""N-gram Jaccard join: count-vector R-trees over documents that share a rare shingle.

A document's set holds its distinct shingles. Equal sets are one node. By the prefix principle two sets of Jaccard
similarity t or more share one of the first ``n - ceil(t n) + 1`` shingles in any global order; the order here puts
frequent shingles last, so blocks of nodes that share such a shingle are small. Frequencies are counted over all documents
in a sketch (``SKETCH_BITS``) that can only count too much: a shingle in its lowest class has at most ``rare`` documents, so
its block is gathered within one task; others are frequent and their blocks are met by joins. Shingles are also hashed into
``GROUPS`` groups; a node's group counts are a point, and the overlap of two sets is at most the sum of the minima
of their coordinates. First each node of a block is held against the block's most central node. Blocks whose nodes are
still in several components are then joined by an R-tree over their points, whose boxes give the same bound; only
pairs across components that pass it are verified on the texts. No pair of a block is left out but by a bound, or
because both are already known to be connected.

* Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. A text of fewer words than a shingle has its whole
  sequence as one; a null or empty text, or one without words, has an empty set and is linked with nothing.
* Repeated rows and equal texts are one node. Extra columns are ignored. Texts of any length are used whole.
* Shingles and sets are told apart by 64-bit hashes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bounded_batches, chunks, components, discard, frugal, hot_join, materialize, materialize_by, mix, shingles, texts, texts_of, word_hashes

#: Coordinates of a tree's boxes, and of a stored point at most; nodes joined in one task.
GROUPS, MOST_GROUPS, BLOCK = 32, 1 << 16, 2000
#: Counters of the frequency sketch (2 bytes each in a task; 1 each when broadcast), and the slices they are summed in. With
#: more shingles a counter the order is coarser and blocks are larger; what is found stays the same.
SKETCH_BITS, SLICES = 24, 64
#: Nodes of a block from which its nodes get finer points: among many altered copies of a text, most pairs are nearly
#: similar enough.
CROWD = 64

def shingle_sets(found: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one after the other, and their bounds."""
    words, _, _, bounds = word_hashes(found, lower=True)
    rolled, at = shingles(words, bounds, width)
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):  # the whole sequence is one shingle
        own = []
        for i in short:
            h = np.uint64(counts[i])
            with np.errstate(over="ignore"):
                for w in words[bounds[i] : bounds[i + 1]]:
                    h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
            own.append(h)
        rolled = np.insert(rolled, at[short], np.array(own, np.uint64))
        sizes = np.diff(at)
        sizes[short] = 1
        at = np.concatenate(([0], np.cumsum(sizes)))
    ends = at.tolist()
    for i, j in zip(ends, ends[1:], strict=False):
        rolled[i:j].sort()
    keep = np.ones(len(rolled), bool)
    keep[1:] = rolled[1:] != rolled[:-1]
    keep[at[:-1][np.diff(at) > 0]] = True
    sums = np.concatenate(([0], np.cumsum(keep)))
    return rolled[keep], sums[at]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def points(sets: np.ndarray, bounds: np.ndarray, finer: int = 1) -> list[bytes]:
    """Group counts of each set, one byte each (255 stands for any larger count too).

    A set of n shingles has about n / 4 groups, a power of two, or ``finer`` times as many; a group is the leading bits of a mixed hash, so a point
    folds to fewer groups by adding neighbours.
    """
    mixed, out = mix(sets), []
    ends = bounds.tolist()
    for i, j in zip(ends, ends[1:], strict=False):
        bits = min(MOST_GROUPS.bit_length() - 1, max(GROUPS.bit_length() - 1, int((j - i - 1) * finer // 4).bit_length()))
        out.append(np.minimum(np.bincount((mixed[i:j] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes())
    return out


class Points:
    """Points of one block or batch, of several lengths, folded as needed."""

    def __init__(self, raw: list[bytes]):
        self.length = np.array([len(x) for x in raw])
        self.place = np.empty(len(raw), np.int64)
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        self.full = np.zeros(len(raw), bool)
        for g in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == g)
            self.place[own] = np.arange(len(own))
            self.rows[g, g] = p = np.frombuffer(b"".join([raw[i] for i in own]), np.uint8).reshape(-1, g)
            self.full[own] = (p == 255).any(axis=1)

    def folded(self, g: int, to: int) -> np.ndarray:
        if g == to:
            return self.rows[g, g]
        if (g, to) not in self.rows:
            self.rows[g, to] = self.rows[g, g].reshape(-1, to, g // to).sum(axis=2, dtype=np.uint32)
        return self.rows[g, to]

    def boxes(self) -> np.ndarray:
        """All points folded to GROUPS coordinates; a full count is endless."""
        out = np.empty((len(self.length), GROUPS), np.uint16)
        for g in np.unique(self.length).tolist():
            out[self.length == g] = np.minimum(self.folded(g, GROUPS).astype(np.uint32), 65535)
        out[self.full] = 65535
        return out

    def possible(self, i: np.ndarray, other: Points, j: np.ndarray, n_i: np.ndarray, n_j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the sets of these pairs of points can be similar enough, in as many groups as both have; the bound."""
        ok = self.full[i] | other.full[j]
        bound = np.where(ok, 1.0, 0.0)
        for g, h in {*zip(self.length[i].tolist(), other.length[j].tolist(), strict=True)}:
            own = np.flatnonzero((self.length[i] == g) & (other.length[j] == h) & ~ok)
            for to in (min(g, h) // 16, min(g, h)) if min(g, h) >= 512 else (min(g, h),):  # coarse first
                p, q = self.folded(g, to), other.folded(h, to)
                for at in range(0, len(own), max(1, (1 << 22) // to)):
                    some = own[at : at + max(1, (1 << 22) // to)]
                    overlap = np.minimum(p[self.place[i[some]]], q[other.place[j[some]]]).sum(axis=1, dtype=np.int64)
                    # 100 x >= percent * (n_i + n_j - x)
                    ok[some] = (100 + percent) * overlap >= percent * (n_i[some] + n_j[some])
                    bound[some] = overlap / (n_i[some] + n_j[some])
                own = own[ok[own]]
        return ok, bound


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (-(-percent * n // 100)) + 1


def _packed(counts: np.ndarray) -> bytes:
    """Counters as two planes of bits, and apart from them those of 3 and more."""
    small, large = np.minimum(counts, 3), np.flatnonzero(counts >= 3).astype(np.uint32)
    return np.packbits(small & 1).tobytes() + np.packbits(small >> 1).tobytes() + large.tobytes() + counts[large].tobytes()


def _add_packed(to: np.ndarray, raw: bytes) -> None:
    n = len(to) // 8
    planes = np.unpackbits(np.frombuffer(raw, np.uint8, 2 * n)).reshape(2, -1)
    to += planes[0]
    to += 2 * planes[1].astype(np.int64)
    m = (len(raw) - 2 * n) // 6
    to[np.frombuffer(raw, np.uint32, m, 2 * n)] += np.frombuffer(raw, np.uint16, m, 2 * n + 4 * m) - np.int64(3)


def size_classes(n: np.ndarray) -> np.ndarray:
    """Sixteenths of the sizes' binary logarithms, 255 at most; sets of a similarity differ by ``class_gap`` at most."""
    return np.minimum(255, np.floor(16 * np.log2(np.maximum(n, 1)))).astype(np.int32)


def class_gap(percent: int) -> int:
    return int(16 * np.log2(100 / percent)) + 1


def profile(docs: DataFrame, width: int = 5) -> DataFrame:
    """Per document (kind 0): id, size n, set_id and point; per task and slice of the sketch (kind 1): slice and its counts."""
    bounded_batches(docs.sparkSession)
    bits, slices = SKETCH_BITS, SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names, kinds = ["kind", "id", "n", "set_id", "point"], [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            np.minimum(counts, 60_000, out=counts)  # a batch adds some thousands at most
            for ids, found in chunks(batch, 16 << 20):
                sets, bounds = shingle_sets(found, width)
                n = np.diff(bounds)
                set_id = mix(_sums(sets, bounds) ^ mix(_sums(mix(sets), bounds) + n.astype(np.uint64))).view(np.int64)
                np.add.at(counts, (sets >> np.uint64(64 - bits)).astype(np.int64), np.uint16(1))
                rows = [np.zeros(len(ids), np.int8), ids, n, pa.array(set_id, mask=n == 0), points(sets, bounds)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)
        pack = zstandard.ZstdCompressor(level=3).compress
        for i, part in enumerate(counts.reshape(slices, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([1], [i], [None], [None], [pack(_packed(part))]), kinds, strict=True)], names=names)

    return texts(docs).mapInArrow(frugal(run), "kind byte, id long, n long, set_id long, point binary")


def often(found: DataFrame) -> tuple[np.ndarray, int]:
    """(class of each counter of the sketch, from 0 to 3; the count up to which the class is 0), from a stored ``profile``.

    2 ** SKETCH_BITS bytes reach the driver, in compressed slices, however large the corpus.
    """
    spark = found.sparkSession
    bounded_batches(spark)
    bits, slices = SKETCH_BITS, SLICES
    width = (1 << bits) // slices
    total = found.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    mean = total / (1 << bits)
    rare = int(mean + 5 * mean**0.5 + 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(i, np.zeros(width, np.int64))
                _add_packed(own, open_(x))
        for i, own in sums.items():
            classes = sum((own > rare * 8**k).astype(np.uint8) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(classes.tobytes())], pa.binary())], names=["slice", "classes"])

    dealt = found.filter("kind = 1").select(F.col("id").cast("int").alias("slice"), "point").repartition(slices, "slice")
    out = np.zeros((slices, width), np.uint8)
    import zstandard

    for r in dealt.mapInArrow(frugal(run), "slice int, classes binary").collect():
        out[r["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["classes"])), np.uint8)
    return out.ravel(), rare


def prefixes(docs: DataFrame, classes: np.ndarray, percent: int, width: int = 5) -> DataFrame:
    """(shingle, set_id, code) for the shingles of each document's prefix, in the order of their class and then their hash.

    The code is twice the set's size class, and one more for a frequent shingle.
    """
    bounded_batches(docs.sparkSession)
    handle, bits = docs.sparkSession.sparkContext.broadcast(classes), SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in chunks(batch, 8 << 20):
                sets, bounds = shingle_sets(found, width)
                n = np.diff(bounds)
                set_id = mix(_sums(sets, bounds) ^ mix(_sums(mix(sets), bounds) + n.astype(np.uint64))).view(np.int64)
                text = np.repeat(np.arange(len(found)), n)
                kind = handle.value[(sets >> np.uint64(64 - bits)).astype(np.int64)]
                left = np.repeat(prefix_length(n, percent), n)  # how many of the prefix the classes before leave
                take = np.zeros(len(sets), bool)
                for k in range(4):
                    own = kind == k
                    upto = np.concatenate(([0], np.cumsum(own)))
                    before = upto[:-1] - np.repeat(upto[bounds[:-1]], n)  # those of the class and text before each
                    take |= own & (before < left)
                    left = left - np.repeat(upto[bounds[1:]] - upto[bounds[:-1]], n)
                take = np.flatnonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(sets[take].view(np.int64)), pa.array(set_id[text[take]]), pa.array(2 * size_classes(n)[text[take]] + (kind[take] > 0))], names=["shingle", "set_id", "code"])

    return texts(docs).mapInArrow(frugal(run), "shingle long, set_id long, code int")


def blocks_of(rows: DataFrame, percent: int) -> DataFrame:
    """(shingle, set_id, size), distinct: the rows (of ``prefixes``) whose shingle another set of like size has too, or is frequent.

    Copies share many shingles and so many blocks, which are one here. Rare shingles are dealt by themselves, so a task sees their few rows together, and parts them where the size
    classes leave a gap that no similar sets have; rows of frequent ones, which others have anyway, are dealt one by one.
    """
    bounded_batches(rows.sparkSession)
    gap = class_gap(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(shingle: np.ndarray, set_id: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
            size, many = code >> 1, (code & 1).astype(bool)
            order = np.lexsort((set_id, size, shingle))
            shingle, set_id, size, many = shingle[order], set_id[order], size[order], many[order]
            new = np.ones(len(shingle), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (set_id[1:] != set_id[:-1])
            shingle, set_id, size, many = shingle[new], set_id[new], size[new], many[new]
            near = (shingle[1:] == shingle[:-1]) & ((size[1:] - size[:-1] <= gap) | many[1:])
            keep = many.copy()
            keep[1:] |= near
            keep[:-1] |= near
            # a frequent shingle names its block; a rare one's is named by its sets, so that blocks of the same sets are one
            name = mix(shingle.view(np.uint64))
            first = np.ones(len(shingle), bool)
            first[1:] = ~near
            begin = np.flatnonzero(first)
            if len(begin):
                sets = np.repeat(np.add.reduceat(mix(set_id.view(np.uint64)), begin), np.diff(np.append(begin, len(first))))
                name = np.where(many, name, mix(sets ^ np.uint64(0x9E3779B97F4A7C15)))
            name = name.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(set_id[keep]), pa.array(size[keep].astype(np.int16))], names=["shingle", "set_id", "size"])

        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        for batch in batches:
            now = [np.concatenate(x) for x in zip(held, (batch.column(i).to_numpy() for i in range(3)), strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last shingle may go on
            yield whole(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        yield whole(*held)

    key = F.when(F.col("code").bitwiseAND(F.lit(1)) == 1, F.xxhash64("shingle", "set_id")).otherwise(F.col("shingle"))
    dealt = rows.repartition(key).sortWithinPartitions("shingle", "set_id")
    return dealt.mapInArrow(frugal(run), "shingle long, set_id long, size short").distinct()


def within_bound(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets in these boxes (upper corners, with least sizes) can be similar enough."""
    least = np.minimum(a, b)
    # 100 i >= p (n_a + n_b - i)
    return (least == 65535).any(axis=-1) | ((100 + percent) * least.sum(axis=-1, dtype=np.int64) >= percent * (n_a + n_b))


class RTree:
    """Bulk-loaded R-tree over points, sorted by size and then by tiles of the widest coordinates.

    Level 0 are the points; a node of the next level spans ``fan`` nodes below. Nodes keep the box's upper corner
    (counts can't be negative, so the bound needs no lower one), the least and most size, and their component if all
    of it agrees (else -1).
    """

    def __init__(self, p: np.ndarray, n: np.ndarray, component: np.ndarray, fan: int = 8):
        spread = p.astype(np.float64).var(axis=0)
        wide = np.argsort(-spread)[:2]
        size_class = np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3)).astype(np.int64)
        self.order = np.lexsort((p[:, wide[-1]], p[:, wide[0]], component, size_class))
        self.fan, self.levels = fan, []
        upper, low, high, same = p[self.order], n[self.order], n[self.order], component[self.order]
        while True:
            self.levels.append((upper, low, high, same))
            if len(low) <= 1:
                break
            at = np.arange(0, len(low), fan)
            top, bottom = np.maximum.reduceat(same, at), np.minimum.reduceat(same, at)
            upper, low, high, same = np.maximum.reduceat(upper, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.where(top == bottom, top, -1)

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        upper, low, high, same = self.levels[level]
        ok = (same[i] != same[j]) | (same[i] == -1)
        ok &= (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        ok[ok] = within_bound(upper[i[ok]], upper[j[ok]], low[i[ok]], low[j[ok]], percent)
        return ok

    def join(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs of different components that the bounds can't part, each pair once."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > 4096:
                half = len(i) // 2
                stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
                continue
            keep = self._possible(level, i, j, percent)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                keep = i < j
                if keep.any():
                    yield self.order[i[keep]], self.order[j[keep]]
                continue
            below, f = len(self.levels[level - 1][1]), np.arange(self.fan)
            x = np.repeat((i[:, None] * self.fan + f), self.fan, axis=1).ravel()
            y = np.tile((j[:, None] * self.fan + f), (1, self.fan)).ravel()
            keep = (x < below) & (y < below) & (x <= y)
            stack.append((level - 1, x[keep], y[keep]))


def block_pairs(blocks: DataFrame, percent: int, best: bool) -> DataFrame:
    """Candidate pairs (a, b) of nodes across components within blocks (shingle, set_id, n, point, component).

    ``best``: only the pair with the highest bound for each node and other component of a block, which most often
    settles whether they are connected, for crowded blocks in the first round; all pairs otherwise.

    Blocks of more than ``BLOCK`` nodes are cut into slices by a hash, and every pair of slices is a block of its own:
    no task holds more than two slices, and no pair is lost.
    """
    spark = blocks.sparkSession
    bounded_batches(spark)
    sizes = blocks.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK)
    sliced = blocks.join(sizes, "shingle", "left").withColumn("slices", F.coalesce(F.ceil(2 * F.col("size") / BLOCK), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("set_id"), F.col("slices")).cast("int")
    # slice s joins the blocks (s, t) and (t, s) of all t
    sliced = sliced.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = sliced.select("shingle", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "set_id", "n", "point", "component")
    dealt = dealt.repartition("shingle", "s", "t").sortWithinPartitions("shingle", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks_of() -> Iterator[list[pa.RecordBatch]]:
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
                cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
                for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                    if b == a:
                        continue
                    now = tuple(key[:, a])
                    if held and now != last:
                        yield held
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = now
            if held:
                yield held

        for block in blocks_of():
            whole = pa.Table.from_batches(block)
            if whole.num_rows < 2:
                continue
            ids, n, component = (whole.column(k).to_numpy() for k in ("set_id", "n", "component"))
            if (component == component[0]).all():
                continue
            p = Points(whole.column("point").to_pylist())
            code = np.unique(component, return_inverse=True)[1]
            got = []
            for i, j in RTree(p.boxes(), n, code).join(percent):
                ok, bound = p.possible(i, p, j, n[i], n[j], percent)
                got.append((i[ok], j[ok], bound[ok]))
            if not got:
                continue
            i, j, bound = (np.concatenate(x) for x in zip(*got, strict=True))
            if best:
                i, j, bound = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((bound, bound))
                order = np.lexsort((j, -bound, code[j], i))
                i, j = i[order], j[order]
                keep = np.ones(len(i), bool)
                keep[1:] = (i[1:] != i[:-1]) | (code[j[1:]] != code[j[:-1]])
                i, j = i[keep], j[keep]
            a, b = ids[i], ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return dealt.mapInArrow(frugal(run), "a long, b long").distinct()


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, width: int = 5) -> DataFrame:
    """Those of the stored pairs (a, b) of nodes whose sets are similar enough, stored. ``nodes`` has (set_id, doc_id)."""
    bounded_batches(docs.sparkSession)
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(nodes.select("set_id", "doc_id"), "set_id"), "wanted")
    own = texts(docs).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id").select("set_id", "text")
    found = materialize_by(own, "texts", "set_id", lambda x: x.dropDuplicates(["set_id"]))  # a text is shuffled once, and once more beside its pairs
    both = pairs.join(found.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a").join(found.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ta, tb = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            sets: dict[int, np.ndarray] = {}
            own: dict[int, bytes] = dict(zip([*a.tolist(), *b.tolist()], [*ta, *tb], strict=True))
            for ids, found in chunks(pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], names=["i", "t"])):
                values, bounds = shingle_sets(found, width)
                sets |= {i: values[x:y] for i, x, y in zip(ids, bounds, bounds[1:], strict=False)}
            ok = np.zeros(len(a), bool)
            for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                s, t = sets[i], sets[j]
                if len(s) > len(t):
                    s, t = t, s
                common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                ok[k] = 100 * common >= percent * (len(s) + len(t) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    out = materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(frugal(run), "a long, b long"), "links")
    discard(found, wanted)
    return out


def bounded_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and points allow the similarity."""
    side = lambda c: nodes.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * n_a >= {percent} * n_b AND 100 * n_b >= {percent} * n_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (Points(batch.column(k).to_pylist()) for k in (4, 5))
            at = np.arange(batch.num_rows)
            ok, _ = p.possible(at, q, at, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(frugal(run), "a long, b long")


def finer_points(docs: DataFrame, nodes: DataFrame, width: int = 5) -> DataFrame:
    """(set_id, n, point) with sixteen times the groups, for some nodes."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found in chunks(batch):
                sets, bounds = shingle_sets(found, width)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(points(sets, bounds, 16), pa.binary())], names=["set_id", "n", "point"])

    nodes = materialize(nodes.select("doc_id", "set_id"), "crowd")
    own = texts_of(docs, nodes).join(nodes, "doc_id").dropDuplicates(["set_id"]).select("set_id", "text")
    return own.mapInArrow(frugal(run), "set_id long, n long, point binary")


def central_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: each node with the most central node of each of its blocks (shingle, set_id, size), if of like size.

    The most central node is that of the most blocks: of a text and its many altered copies the text itself, which is like
    all of them though they need not be like each other, shares the most.
    """
    weights = blocks.groupBy("set_id").agg(F.count(F.lit(1)).alias("weight"))
    top = blocks.join(weights, "set_id").groupBy("shingle").agg(F.max(F.struct("weight", "set_id", "size")).alias("top"), F.count(F.lit(1)).alias("n"))
    top = materialize(top.select("shingle", F.col("top.set_id").alias("centre"), F.col("top.size").alias("centre_size"), "n"), "centres")
    met = hot_join(blocks, top.drop("n"), "shingle", top.select("shingle", "n"))
    near = met.filter(f"set_id <> centre AND abs(size - centre_size) <= {class_gap(percent)}")
    return near.select(F.least("set_id", "centre").alias("a"), F.greatest("set_id", "centre").alias("b")).distinct()


def links(docs: DataFrame, found: DataFrame, percent: int = 75, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) that connect the nodes as all links would, components (id, component)), from a stored ``profile``."""
    own = found.filter("kind = 0 AND set_id IS NOT NULL")
    nodes = materialize(own.groupBy("set_id").agg(F.min("id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point"), F.count(F.lit(1)).alias("copies")), "nodes")
    classes, _ = often(found)
    blocks = materialize(blocks_of(prefixes(docs, classes, percent, width), percent), "blocks")
    star = materialize(central_pairs(blocks, percent), "star")
    first = verify(materialize(bounded_pairs(star, nodes, percent), "pairs"), nodes, docs, percent, width)
    joined, tried = components(first), star
    for again in (False, True):
        # blocks whose nodes are not all connected yet; those of two nodes are settled, and after the first round all small ones
        named = materialize(blocks.join(joined.withColumnRenamed("id", "set_id"), "set_id", "left").select("shingle", "set_id", F.coalesce("component", "set_id").alias("component")), "named")
        alike = [F.min("set_id").alias("u"), F.max("set_id").alias("v"), F.bit_xor(F.xxhash64("set_id")).alias("w")]
        split = named.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"), *alike).filter(f"x < y AND size > {CROWD if again else 2}")
        split = materialize(split.groupBy("size", "u", "v", "w").agg(F.min("shingle").alias("shingle")).select("shingle", "size"), "split")  # one of blocks of the same nodes
        open_ = materialize(hot_join(named, split, "shingle", split.withColumnRenamed("size", "n"), how="inner"), "open")
        discard(named, split)
        names = ["shingle", "set_id", "n", "point", "component"]
        crowd = open_.filter(F.col("size") > CROWD)
        fine = finer_points(docs, nodes.join(crowd.select("set_id").distinct(), "set_id", "left_semi"), width)
        pairs = block_pairs(crowd.join(fine, "set_id").select(*names), percent, not again)
        if not again:
            pairs = pairs.unionByName(block_pairs(open_.filter(F.col("size") <= CROWD).join(nodes.select("set_id", "n", "point"), "set_id").select(*names), percent, False)).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        discard(open_)
        more = verify(pairs, nodes, docs, percent, width)
        tried = tried.unionByName(pairs)
        if more.limit(1).count():
            first = first.unionByName(more)
            joined = components(first)
    discard(blocks, nodes, star)
    return first, joined


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's set, and the least id that links lead to."""
    found = materialize(profile(docs, width), "profile")
    _, joined = links(docs, found, percent, width)
    sets = found.filter("kind = 0 AND set_id IS NOT NULL").groupBy("set_id").agg(F.min("id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    grouped = materialize(sets.join(joined.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "sets")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = hot_join(grouped.select("set_id", "component", F.col("n").alias("copies")), least.drop("n"), "component", least.select("component", "n"))
    named = materialize(named.select("set_id", "component_id", "copies"), "sets")
    rows = found.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "set_id")
    out = hot_join(rows, named.select("set_id", "component_id"), "set_id", named.select("set_id", F.col("copies").alias("n")))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
