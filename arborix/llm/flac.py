"""Media columns: payloads as FLAC streams, decoded to PCM blocks.

``decode_stream`` reads any mono or stereo FLAC stream (constant, verbatim, fixed and LPC subframes, all Rice
partitionings, wasted bits, stereo decorrelation) bit by bit. ``encode_payloads`` and ``decode_payloads`` work on many
mono 8-bit streams at once: all frames of a batch are coded in step with numpy. Every frame's CRC-8 and CRC-16 are
verified; a stream whose frames can't be told apart by their headers goes through ``decode_stream``.

* A null or empty text is a payload of one frame of bytes 255. Payloads are filled with bytes 255 to whole frames.
* A wrong checksum raises ``FlacError``. Equal payloads give equal streams. Extra columns are ignored.
* Texts of any length are stored whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, chunks, frugal, texts

FRAME = 576  # samples; FLAC's block size code 2
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
BLOCK_SCHEMA = "doc_id long, block int, sample_offset long, n_samples int, byte_offset long, pcm binary"
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class FlacError(ValueError):
    """A stream that isn't FLAC or whose checksums are wrong."""


def _crc_table(poly: int, bits: int, width: int) -> np.ndarray:
    """CRC of every value of ``width`` bits, most significant bit first."""
    crc = np.arange(1 << width, dtype=np.uint32) << np.uint32(bits - width)
    top, mask = np.uint32(1 << (bits - 1)), np.uint32((1 << bits) - 1)
    for _ in range(width):
        crc = np.where(crc & top, (crc << np.uint32(1)) ^ np.uint32(poly), crc << np.uint32(1)) & mask
    return crc


_CRC8 = _crc_table(0x07, 8, 8)
_CRC16 = _crc_table(0x8005, 16, 8).astype(np.uint16)
_CRC16_PAIRS = _crc_table(0x8005, 16, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    for x in data:
        crc = int(_CRC8[crc ^ x])
    return crc


def crc16(data: bytes) -> int:
    crc = 0
    for x in data:
        crc = ((crc << 8) & 0xFFFF) ^ int(_CRC16[(crc >> 8) ^ x])
    return crc


def _crc16_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans in step. Leading zero bytes leave it at 0, so spans are aligned at their ends."""
    if not len(starts):
        return np.empty(0, np.uint16)
    longest = int((ends - starts).max())
    longest += longest % 2
    crc = np.zeros(len(starts), np.uint16)
    padded = np.concatenate((np.zeros(longest, np.uint8), data))
    words = (padded[:-1].astype(np.uint16) << np.uint16(8)) | padded[1:]
    at = ends - longest + longest  # place in padded of the first byte of each aligned span
    for i in range(0, longest, 2):
        place = at + i
        word = words[place]
        inside = place - longest
        low = inside < starts
        if low.any():
            word = np.where(inside + 1 < starts, 0, np.where(low, word & 0xFF, word)).astype(np.uint16)
        crc = _CRC16_PAIRS[crc ^ word]
    return crc


def _coded_number(n: int) -> bytes:
    """A frame number in the UTF-8-like code of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail, lead = [], 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([0xFF & ~(lead << 1 | 1) | n, *reversed(tail)])


_HEADERS: list[bytes] = []


def _header(n: int) -> bytes:
    while len(_HEADERS) <= min(n, 1 << 16):
        head = b"\xff\xf8\x20\x02" + _coded_number(len(_HEADERS))
        _HEADERS.append(head + bytes([crc8(head)]))
    if n < len(_HEADERS):
        return _HEADERS[n]
    head = b"\xff\xf8\x20\x02" + _coded_number(n)
    return head + bytes([crc8(head)])


def stream_info(payload: bytes, shortest: int, longest: int) -> bytes:
    """The stream's mark and its STREAMINFO block: 8000 Hz, mono, 8 bits."""
    rate = (8000 << 44) | (0 << 41) | (7 << 36) | len(payload)
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
    return b"fLaC\x80\x00\x00\x22" + FRAME.to_bytes(2, "big") * 2 + shortest.to_bytes(3, "big") + longest.to_bytes(3, "big") + rate.to_bytes(8, "big") + md5


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of 576; a byte b is the sample b - 128.

    Each frame takes the fixed linear predictor of order 0, 1 or 2 with the least residual, one Rice partition with
    the better of two parameters, or a constant or verbatim subframe where that is shorter.
    """
    counts = np.array([len(x) // FRAME for x in payloads])
    first = np.concatenate(([0], np.cumsum(counts)))
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    n = len(raw)
    x = raw.astype(np.int16) - 128
    orders = [x, np.diff(x, axis=1), np.diff(x, 2, axis=1)]
    cost = np.stack([np.abs(r).sum(axis=1, dtype=np.int64) for r in orders])
    order = cost.argmin(axis=0)
    heads = [_header(i) for c in counts for i in range(c)]
    head_len = np.array([len(h) for h in heads])
    body = np.empty(n, np.int64)  # bits after the header and before the padding
    u_of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    k = np.zeros(n, np.int64)
    for o in range(3):
        own = np.flatnonzero(order == o)
        if not len(own):
            continue
        r = orders[o][own].astype(np.int32)
        u = ((r << 1) ^ (r >> 31)).astype(np.int32)
        guess = np.clip(np.floor(np.log2(u.mean(axis=1) + 1e-9)), 1, 9).astype(np.int32)
        sizes = [(u >> (guess - d)[:, None]).sum(axis=1, dtype=np.int64) + u.shape[1] * (guess - d + 1) for d in (0, 1)]
        k[own] = guess - (sizes[1] < sizes[0])
        body[own] = 8 + 8 * o + 10 + np.minimum(*sizes)
        u_of[o] = (own, u, k[own])
    constant = (raw == raw[:, :1]).all(axis=1)
    verbatim = ~constant & (body >= 8 + 8 * FRAME)
    body[constant], body[verbatim] = 16, 8 + 8 * FRAME
    size = head_len + -(-body // 8) + 2
    start = np.concatenate(([0], np.cumsum(size)))
    bits = np.zeros(8 * int(start[-1]), np.uint8)
    for o, (own, u, ks) in u_of.items():
        rice = ~(constant | verbatim)[own]
        own, u, ks = own[rice], u[rice], ks[rice]
        base = 8 * (start[own] + head_len[own] + 1 + o)
        for kk in np.unique(ks):
            these = ks == kk
            v = u[these]
            q = v >> kk
            width = q + (kk + 1)
            stop = base[these][:, None] + 10 + np.cumsum(width, axis=1) - (kk + 1)
            for j in range(4):
                bits[base[these] + 6 + j] = (int(kk) >> (3 - j)) & 1
            stop = stop.ravel()
            bits[stop] = 1
            v = v.ravel()
            for j in range(int(kk)):
                bits[stop + 1 + j] = (v >> (int(kk) - 1 - j)) & 1
    data = np.packbits(bits)
    for length in np.unique(head_len):
        own = np.flatnonzero(head_len == length)
        data[start[own][:, None] + np.arange(length)] = np.frombuffer(b"".join([heads[i] for i in own]), np.uint8).reshape(-1, length)
    at = start[:-1] + head_len
    data[at] = np.where(constant, 0, np.where(verbatim, 2, 0x10 | order << 1))
    own = np.flatnonzero(constant)
    data[at[own] + 1] = raw[own, 0] ^ 0x80
    own = np.flatnonzero(verbatim)
    data[at[own][:, None] + 1 + np.arange(FRAME)] = raw[own] ^ 0x80
    for o in (1, 2):
        own = np.flatnonzero(~constant & ~verbatim & (order == o))
        data[at[own][:, None] + 1 + np.arange(o)] = raw[own, :o] ^ 0x80
    crc = _crc16_many(data, start[:-1], start[1:] - 2)
    data[start[1:] - 2], data[start[1:] - 1] = crc >> 8, crc & 0xFF
    whole = data.tobytes()
    return [stream_info(p, int(size[a:b].min()), int(size[a:b].max())) + whole[start[a] : start[b]] for p, a, b in zip(payloads, first[:-1], first[1:], strict=True)]


def _frames(stream: bytes) -> list[int] | None:
    """Where the frames of a stream of ``encode_payloads``' form begin, and its end; None if it has another form."""
    if stream[:8] != b"fLaC\x80\x00\x00\x22" or len(stream) < 42 or stream[18:21] != b"\x01\xf4\x00" or stream[21] & 0xF0 != 0x70:
        return None
    total = int.from_bytes(stream[21:26], "big") & 0xFFFFFFFFF
    at, found = 42, []
    for i in range(total // FRAME):
        head = _header(i)
        if i:
            at = stream.find(head, at)
        if at < 0 or stream[at : at + len(head)] != head:
            return None
        found.append(at)
        at += len(head)
    return [*found, len(stream)]


def decode_payloads(streams: list[bytes]) -> list[tuple[bytes, list[int]]]:
    """(payload, the byte offset of each frame) of each stream."""
    marks = [_frames(x) for x in streams]
    out: list[tuple[bytes, list[int]] | None] = [None] * len(streams)
    plain = [i for i, m in enumerate(marks) if m is not None]
    if plain:
        at = np.concatenate(([0], np.cumsum([len(streams[i]) for i in plain])))
        data = np.frombuffer(b"".join([streams[i] for i in plain]), np.uint8)
        starts = np.concatenate([np.array(marks[i][:-1]) + a for i, a in zip(plain, at, strict=False)])
        ends = np.concatenate([np.array(marks[i][1:]) + a for i, a in zip(plain, at, strict=False)])
        head = np.concatenate([[len(_header(j)) for j in range(len(marks[i]) - 1)] for i in plain])
        samples, good = _decode_frames(data, starts, ends, head)
        done = np.concatenate(([0], np.cumsum([len(marks[i]) - 1 for i in plain])))
        for i, a, b in zip(plain, done[:-1], done[1:], strict=True):
            if good[a:b].all():
                pcm = samples[a:b].tobytes()
                if hashlib.md5(pcm).digest() != streams[i][26:42]:
                    raise FlacError("the samples' MD5 is not the stream's")
                out[i] = ((samples[a:b] ^ 0x80).tobytes(), marks[i][:-1])
    for i, x in enumerate(streams):
        if out[i] is None:
            channels, places, _ = decode_stream(x)
            out[i] = ((channels[0].astype(np.int16) + 128).astype(np.uint8).tobytes(), [p for _, p in places])
    return out  # type: ignore[return-value]


def _decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (uint8 in two's complement) of frames decoded in step, and which of them hold."""
    n = len(starts)
    stored = (data[ends - 2].astype(np.uint16) << np.uint16(8)) | data[ends - 1]
    good = _crc16_many(data, starts, ends - 2) == stored
    out = np.zeros((n, FRAME), np.uint8)
    at = starts + head
    kind = data[at]
    own = np.flatnonzero(kind == 0)
    out[own] = data[at[own] + 1][:, None]
    own = np.flatnonzero(kind == 2)
    own_good = at[own] + 1 + FRAME <= ends[own] - 2
    good[own[~own_good]] = False
    own = own[own_good]
    out[own] = data[at[own][:, None] + 1 + np.arange(FRAME)]
    fixed = (kind & 0xF1) == 0x10
    good &= (kind == 0) | (kind == 2) | fixed
    bits = np.unpackbits(data)
    total = len(bits)
    next_one = np.where(bits, np.arange(total, dtype=np.int32), np.int32(total))
    next_one = np.concatenate((np.minimum.accumulate(next_one[::-1])[::-1], np.full(64, total, np.int32)))
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
    window = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    for order in range(5):
        own = np.flatnonzero(good & fixed & ((kind >> 1 & 7) == order))
        if not len(own):
            continue
        base = 8 * (at[own] + 1 + order)
        first = (window[base >> 3] >> np.uint32(22)).astype(np.int64)
        k = first & 15
        plain = first >> 4 == 0  # coding method 0 and one partition
        plain &= k < 15
        good[own[~plain]] = False
        own, k = own[plain], k[plain].astype(np.int32)
        codes = FRAME - order
        stops = np.empty((codes, len(own)), np.int32)
        pos = (base[plain] + 10).astype(np.int32)
        step = k + 1
        begin = pos
        for i in range(codes):
            pos = next_one[np.minimum(pos, total)]
            stops[i] = pos
            pos = pos + step
        good[own[pos > 8 * (ends[own] - 2)]] = False
        stops = np.minimum(stops, total - 1)
        starts_of = np.empty_like(stops)
        starts_of[0] = begin
        starts_of[1:] = stops[:-1] + step
        q = stops - starts_of
        place = stops + 1
        rest = ((window[place >> 3] << (place & 7).astype(np.uint32)) >> np.uint32(1)) >> (31 - k).astype(np.uint32)
        u = (q << k) | rest.astype(np.int32)
        r = (u >> 1) ^ -(u & 1)
        warm = data[at[own][:, None] + 1 + np.arange(order)].view(np.int8).astype(np.int32).T if order else None
        # undo the differences: each fixed predictor's residual is the order-th difference of the samples
        for d in range(order, 0, -1):
            lead = np.diff(warm, d - 1, axis=0)[-1] if d > 1 else warm[-1]
            r = np.cumsum(r, axis=0, dtype=np.int32) + lead
        if order:
            out[own[:, None], np.arange(order)] = warm.T.astype(np.uint8)
        out[own[:, None], np.arange(order, FRAME)] = r.T.astype(np.uint8)
    return out, good


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, 8 * at

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        a, b = self.pos >> 3, (self.pos + n + 7) >> 3
        if b > len(self.data):
            raise FlacError("the stream ends within a frame")
        value = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.pos - n)
        self.pos += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


#: Fixed values of the format: block sizes, sample sizes and fixed predictors by code.
_BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {i: 256 << (i - 8) for i in range(8, 16)}
_SAMPLE_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _residual(b: _Bits, size: int, order: int) -> list[int]:
    method = b.take(2)
    if method > 1:
        raise FlacError("unknown residual coding")
    parts, out = 1 << b.take(4), []
    for i in range(parts):
        n = size // parts - (order if i == 0 else 0)
        k = b.take(4 + method)
        if k == (15, 31)[method]:
            width = b.take(5)
            out += [b.signed(width) for _ in range(n)]
            continue
        for _ in range(n):
            u = b.unary() << k | b.take(k)
            out.append((u >> 1) ^ -(u & 1))
    return out


def _subframe(b: _Bits, size: int, bps: int) -> list[int]:
    if b.take(1):
        raise FlacError("a subframe begins with a one")
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    bps -= wasted
    if kind == 0:
        out = [b.signed(bps)] * size
    elif kind == 1:
        out = [b.signed(bps) for _ in range(size)]
    else:
        if 8 <= kind <= 12:
            order, shift = kind - 8, 0
            out = [b.signed(bps) for _ in range(order)]
            weights = _FIXED[order]
        elif kind >= 32:
            order = kind - 31
            out = [b.signed(bps) for _ in range(order)]
            precision = b.take(4) + 1
            shift = b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        else:
            raise FlacError("a reserved subframe")
        for r in _residual(b, size, order):
            out.append(r + (sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift))
    return [x << wasted for x in out] if wasted else out


def decode_stream(stream: bytes) -> tuple[list[np.ndarray], list[tuple[int, int]], int]:
    """(samples of each channel, (sample offset, byte offset) of each frame, bits a sample) of any FLAC stream."""
    if stream[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(stream):
            raise FlacError("the metadata is cut off")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = stream[at + 4 : at + 4 + size]
        at += 4 + size
    if info is None or len(info) < 34:
        raise FlacError("no STREAMINFO")
    channels, depth = (info[12] >> 1 & 7) + 1, ((info[12] & 1) << 4 | info[13] >> 4) + 1
    total = int.from_bytes(info[13:18], "big") & 0xFFFFFFFFF
    out: list[list[int]] = [[] for _ in range(channels)]
    places: list[tuple[int, int]] = []
    while at < len(stream) and (not total or len(out[0]) < total):
        begin, b = at, _Bits(stream, at)
        if b.take(14) != 0x3FFE:
            raise FlacError("no frame where one should begin")
        b.take(2)
        block, rate, layout, bits_code = b.take(4), b.take(4), b.take(4), b.take(3)
        b.take(1)
        lead = b.take(8)
        more = 0
        while lead & (0x80 >> more):
            more += 1
        for _ in range(max(0, more - 1)):
            b.take(8)
        size = b.take(8) + 1 if block == 6 else b.take(16) + 1 if block == 7 else _BLOCK_SIZES.get(block, 0)
        b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        if b.take(8) != crc8(stream[begin : b.pos // 8 - 1]):
            raise FlacError("a frame header's CRC-8 is wrong")
        bps = _SAMPLE_SIZES.get(bits_code, depth)
        if layout < 8:
            got = [_subframe(b, size, bps) for _ in range(layout + 1)]
        else:
            a = _subframe(b, size, bps + (layout == 9))
            c = _subframe(b, size, bps + (layout != 9))
            if layout == 8:
                got = [a, [x - y for x, y in zip(a, c, strict=True)]]
            elif layout == 9:
                got = [[x + y for x, y in zip(a, c, strict=True)], c]
            else:
                mid = [(x << 1) | (y & 1) for x, y in zip(a, c, strict=True)]
                got = [[(m + y) >> 1 for m, y in zip(mid, c, strict=True)], [(m - y) >> 1 for m, y in zip(mid, c, strict=True)]]
        b.pos += -b.pos % 8
        end = b.pos // 8
        if b.take(16) != crc16(stream[begin:end]):
            raise FlacError("a frame's CRC-16 is wrong")
        places.append((len(out[0]), begin))
        for own, x in zip(out, got, strict=True):
            own += x
        at = end + 2
    return [np.array(x, np.int32) for x in out], places, depth


def payload_of(text: bytes) -> bytes:
    """The text's bytes and bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (FRAME - len(text) if not text else -len(text) % FRAME)


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a FLAC stream; n_bytes without the filling."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found in chunks(batch, 1 << 20):
                media = encode_payloads([payload_of(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(frugal(run), MEDIA_SCHEMA)


def _read(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[list, list, list[bytes], list[tuple[bytes, list[int]]]]]:
    ids, lengths, media = (batch.column(i).to_pylist() for i in range(3))
    start, total = 0, 0
    for i, x in enumerate(media):
        total += len(x)
        if total >= size or i + 1 == len(media):
            yield ids[start : i + 1], lengths[start : i + 1], media[start : i + 1], decode_payloads(media[start : i + 1])
            start, total = i + 1, 0


def decode_media(media: DataFrame) -> DataFrame:
    """PCM blocks of (doc_id, n_bytes, media): one row a frame, with its place in the samples and in the stream."""
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, _, got in _read(batch):
                rows = [(i, n, n * FRAME, FRAME, at, payload[n * FRAME : (n + 1) * FRAME]) for i, (payload, places) in zip(ids, got, strict=True) for n, at in enumerate(places)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "block", "sample_offset", "n_samples", "byte_offset", "pcm"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(frugal(run), BLOCK_SCHEMA)


def features(payload: bytes) -> str:
    """Samples, their mean and mean square in thousandths (rounded down), zero crossings and the peak."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    sign = x >= 0
    return f"samples={len(x)};mean={1000 * int(x.sum()) // len(x)};energy={1000 * int((x * x).sum()) // len(x)};crossings={int((sign[1:] != sign[:-1]).sum())};peak={int(np.abs(x).max())}"


def media_digests(media: DataFrame) -> DataFrame:
    """Read stored streams back and give their payloads' and their own digests, and features of the samples."""
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        kinds = (pa.int64(),) * 3 + (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
        for batch in batches:
            for ids, lengths, own, got in _read(batch):
                rows = [(i, n, len(p), sha(p), zlib.crc32(p[-32:]), len(m), sha(m), features(p)) for i, n, m, (p, _) in zip(ids, lengths, own, got, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(frugal(run), DIGEST_SCHEMA)
