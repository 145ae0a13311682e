"""LMDB files against the records they were made of; the pages are put together here, byte by byte."""

import struct

import pytest

from arborix.sources import lmdb

SIZE = 512


def page(number, flags, nodes):
    """A branch or leaf page of packed nodes, filled from its end."""
    at, places, body = SIZE, [], bytearray(SIZE)
    for node in nodes:
        at -= len(node) + len(node) % 2
        body[at : at + len(node)] = node
        places.append(at)
    lower = 16 + 2 * len(places)
    assert lower <= at
    body[:16] = struct.pack("<QHHHH", number, 0, flags, lower, at)
    body[16:lower] = struct.pack(f"<{len(places)}H", *places)
    return bytes(body)


def leaf_node(key, value, big=None):
    data = struct.pack("<Q", big) if big is not None else value
    return struct.pack("<HHHH", len(value) & 0xFFFF, len(value) >> 16, 1 if big is not None else 0, len(key)) + key + data


def branch_node(key, child):
    return struct.pack("<HHHH", child & 0xFFFF, child >> 16 & 0xFFFF, child >> 32, len(key)) + key


def meta(number, root, depth, entries, transaction):
    db = lambda pad, d, n, r: struct.pack("<IHHQQQQQ", pad, 0, d, 0, 0, 0, n, r)
    body = struct.pack("<QHHHH", number, 0, 8, 0, 0) + struct.pack("<IIQQ", lmdb.MAGIC, 1, 0, 1 << 20) + db(SIZE, 0, 0, lmdb.NO_PAGE) + db(0, depth, entries, root) + struct.pack("<QQ", 99, transaction)
    return body.ljust(SIZE, b"\0")


def build(path, records, stale=True):
    """A tree of leaves, two levels of branches and overflow pages; one page of an older transaction lies between."""
    pages = {}
    free = iter(range(3, 10_000))
    if stale:
        pages[2] = page(2, lmdb.LEAF, [leaf_node(b"old", b"must not be read")])
    level, nodes, first = [], [], None

    def close(kind):
        n = next(free)
        pages[n] = page(n, kind, nodes)
        level.append((first, n))

    room = 0
    for key, value in records:
        big = None
        if len(value) > 120:
            count = -(-(16 + len(value)) // SIZE)
            big = next(free)
            for _ in range(count - 1):
                next(free)
            body = (struct.pack("<QHHI", big, 0, 4, count) + value).ljust(count * SIZE, b"\0")
            for i in range(count):
                pages[big + i] = body[i * SIZE : (i + 1) * SIZE]
        node = leaf_node(key, value, big)
        if nodes and room + len(node) + 4 > SIZE - 40:
            close(lmdb.LEAF)
            nodes, room = [], 0
        first = first if nodes else key
        nodes.append(node)
        room += len(node) + 4
    if nodes:
        close(lmdb.LEAF)
    depth = 1
    while len(level) > 1:
        below, level, depth = level, [], depth + 1
        for i in range(0, len(below), 6):
            part = below[i : i + 6]
            nodes, first = [branch_node(b"" if j == 0 else k, n) for j, (k, n) in enumerate(part)], part[0][0]
            close(lmdb.BRANCH)
    root = level[0][1] if level else lmdb.NO_PAGE
    last = max(pages, default=1)
    metas = [meta(0, root, depth, len(records), 7), meta(1, 2 if stale else lmdb.NO_PAGE, 1, 1, 6)]
    path.write_bytes(b"".join([*metas, *[pages.get(n, b"\0" * SIZE) for n in range(2, last + 1)]]))


def test_lmdb(spark, tmp_path):
    records = sorted({f"<http://w/Q{i}>".encode(): (f"value {i} ".encode() * (1 + i % 5) if i % 17 else b"long" * (30 + 40 * i)) for i in range(300)}.items())
    (tmp_path / "env").mkdir()
    build(tmp_path / "env/data.mdb", records)
    found = lmdb.read_lmdb(spark, f"file://{tmp_path}/env", 12)
    assert found.rdd.getNumPartitions() == 12 and sorted((bytes(r.key), bytes(r.value)) for r in found.collect()) == records
    asked = spark.createDataFrame([(k.decode(),) for k, _ in records[::7]] + [("old",), ("",), ("zzz",), (None,)], "key string").repartition(3)
    got = {bytes(r.key): r.value and bytes(r.value) for r in lmdb.lookup_lmdb(spark, f"file://{tmp_path}/env/data.mdb", asked).collect()}
    assert got == {**dict(records[::7]), b"old": None, b"": None, b"zzz": None}


def test_small_and_faulty_files(spark, tmp_path):
    build(tmp_path / "none.mdb", [], stale=False)
    assert lmdb.read_lmdb(spark, str(tmp_path / "none.mdb")).count() == 0
    build(tmp_path / "one.mdb", [(b"k", b"v")])
    assert [(bytes(r.key), bytes(r.value)) for r in lmdb.read_lmdb(spark, str(tmp_path / "one.mdb")).collect()] == [(b"k", b"v")]
    (tmp_path / "bad.mdb").write_bytes(b"x" * 2000)
    with pytest.raises(Exception, match="not an LMDB"):
        lmdb.read_lmdb(spark, str(tmp_path / "bad.mdb")).collect()
    (tmp_path / "cut.mdb").write_bytes((tmp_path / "one.mdb").read_bytes()[: 3 * SIZE + 9])
    with pytest.raises(Exception, match="ends within"):
        lmdb.read_lmdb(spark, str(tmp_path / "cut.mdb")).collect()
