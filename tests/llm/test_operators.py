"""The operators against brute force, on small tables with nulls, empty and long texts, repeats and extra columns."""

import collections
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.llm import bpe, common, extraction, flac, jaccard, packing, passages, quality, shards, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies long, stats string, key string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def rows_of(texts):
    return [(i, t, "en", "s", len(t or ""), 7, "mine", "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "ε.", "don't", "x1", "👍", "tail"]
    base = [" ".join(r.choice(words) + str(r.randrange(40)) for _ in range(r.choice([3, 60, 130]))) for _ in range(60)]
    near = [" ".join(w if i % 97 else "edited" for i, w in enumerate(t.split(" "))) for t in base[:30]]
    shared = " ".join(f"shared{i}" for i in range(70))
    return [None, "", " \n\t", "one", "a b c", "a b c", *base, *near, base[0], "pre " + shared + " post", shared + " end of another", LONG, "\x1c x \x85 y <|endoftext|>", "dup line\nother\ndup line\n" + "again and " * 40]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty, texts):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, 256).collect()
    by_doc = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own_rows in bins.values():
        at = 0
        for r in sorted(own_rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(bins) <= 2 * total // 256 + 1  # first fit leaves at most one sequence half empty
    assert packing.pack_documents(empty, path, 256).count() == 0


def test_first_fit_decreasing_is_first_fit():
    r = random.Random(1)
    for _ in range(50):
        need = sorted((r.randrange(1, 40) for _ in range(r.randrange(1, 60))), reverse=True)
        bins, offsets = packing.first_fit_decreasing(np.array(need), 40)
        free: list[int] = []
        for n, b, o in zip(need, bins, offsets, strict=True):
            k = next((i for i, f in enumerate(free) if f >= n), len(free))
            if k == len(free):
                free.append(40)
            assert (b, o) == (k, 40 - free[k])
            free[k] -= n


def test_bpe_matches_the_library(docs, empty, texts):
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.encode_digests(docs, path, tokenizers.PATTERN).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    encoded = bpe.encode_documents(docs, path, tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode_documents(encoded, path, tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode_digests(empty, path, tokenizers.PATTERN).count() == 0


def test_bpe_replays_overlaps_and_late_low_ranks():
    import tiktoken

    r = random.Random(3)
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.MergeReplay(ranks, tokenizers.PATTERN)
    found = ["".join(r.choice("aaabthe nrsé ") for _ in range(200)) for _ in range(200)]
    assert list(own.encode_block(found)) == [enc.encode_ordinary(x) for x in found]


def lpc_stream(samples):
    """A stream of one frame: LPC of order 2, two Rice partitions, wasted bit, for the general decoder."""
    bits = []
    put = lambda v, n: bits.extend((v >> (n - 1 - i)) & 1 for i in range(n))
    half = [x >> 1 for x in samples]
    put(0, 1), put(32 + 1, 6), put(1, 1), put(1, 1)
    for x in half[:2]:
        put(x & 127, 7)
    put(7, 4), put(4, 5), put(24 & 255, 8), put(-9 & 255, 8)
    put(0, 2), put(1, 4)
    res = [half[i] - ((24 * half[i - 1] - 9 * half[i - 2]) >> 4) for i in range(2, len(half))]
    for part in (res[: 288 - 2], res[288 - 2 :]):
        put(3, 4)
        for x in part:
            u = x << 1 if x >= 0 else -2 * x - 1
            put(1, (u >> 3) + 1), put(u & 7, 3)
    bits += [0] * (-len(bits) % 8)
    body = b"\xff\xf8\x20\x02\x00"
    body += bytes([flac.crc8(body)]) + np.packbits(bits).tobytes()
    body += flac.crc16(body).to_bytes(2, "big")
    return flac.stream_info(bytes((x + 128) & 255 for x in samples), len(body), len(body)) + body


def test_flac_round_trip_and_checksums(docs, empty, texts):
    media = flac.encode_media(docs)
    for r in flac.media_digests(media).collect():
        payload = flac.payload_of((texts[r.doc_id] or "").encode())
        assert r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.payload_bytes == len(payload) and len(payload) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:]) and r.feature == flac.features(payload)
    streams = {r.doc_id: bytes(r.media) for r in media.collect()}
    for i in (0, 3, 10, 40):
        channels, places, depth = flac.decode_stream(streams[i])
        assert (channels[0] + 128).astype(np.uint8).tobytes() == flac.payload_of((texts[i] or "").encode()) and depth == 8
    blocks = flac.decode_media(media.filter("doc_id = 10")).orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == [576 * i for i in range(len(blocks))]
    assert all(streams[10][b.byte_offset : b.byte_offset + 2] == b"\xff\xf8" for b in blocks)
    broken = bytearray(streams[10])
    broken[60] ^= 1
    with pytest.raises(flac.FlacError):
        flac.decode_payloads([bytes(broken)])
    samples = [2 * round(30 * np.sin(i / 9)) for i in range(576)]
    assert flac.decode_stream(lpc_stream(samples))[0][0].tolist() == samples
    r = random.Random(2)
    odd = [bytes(r.randrange(256) for _ in range(1152)), b"\x00" * 576, bytes(range(256)) * 9]
    assert [p for p, _ in flac.decode_payloads(flac.encode_payloads(odd))] == odd
    assert flac.media_digests(flac.encode_media(empty)).count() == 0


L = "Words of the text go on here for a good while, and then some more of them follow. "
PAGES = {
    f"<body><nav><a>m</a></nav><article><h1>T &amp; U</h1><p>{L}<p>Be.<p>Er.<div class='comments'><p>{L}</p></div></article><footer>{L}</footer></body>": f"T & U\n{L.strip()}\nBe.\nEr.",
    f"<header><a href=/>Site</a></header><div class='article-body'><p>{L}</p><p>Short.</p></div><div class='related'><a href=/x>Rel</a></div>": f"{L.strip()}\nShort.",
    f"<body><main><p>{L}</p><p>b<br>c &#10; d</p></main><div class='cookie-banner'><p>{L}</p></div><form><p>f</p></form><!-- x <p>no</p> --><script>var a='<p>';</script>": f"{L.strip()}\nb c d",
    "<body><article>" + "<p>Er.</p>" * 50 + "</article></body>": "\n".join(["Er."] * 50),
    "": "",
    None: "",
    "<article><p>cut off <b>in a": "cut off in a",
}


def test_extraction(spark):
    rows = [(i, f"u{i}", h, "extra") for i, h in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.extract_pages(df).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(PAGES.values())}
    assert extraction.extract_pages(df.limit(0)).count() == 0


def test_nothing_of_a_page_is_swallowed_or_printed():
    article = lambda inner: f"<body><article><h1>Head</h1><p>{L}</p>{inner}<p>Last words of it.</p></article></body>"
    rest = f"Head\n{L.strip()}\n"
    get = extraction.trained().extract
    for inner in ("<svg/>", "<object data=x />", "<svg><path d='M0'><circle/></svg>", "<template><p>no</p></template>", "<script>if (a < b) '</p>'</script >", "<!-->", "<!-- a --!>", "<button>no</button>", "<p title='>'></p>", "<select><option>no<option>no</select>"):
        assert get(article(inner)) == rest + "Last words of it.", inner
    for name in ("select-box", "video-player", "title-bar", "button-group", "svgs"):
        assert get(article(f"<{name}><p>inside</p></{name}>")) == rest + "inside\nLast words of it.", name
    assert get(article("<p title=it's>One more.</p>")) == rest + "One more.\nLast words of it."
    assert get(article("<p a=1 b='2>3' c=\"x'y\">One more.</p>")) == rest + "One more.\nLast words of it."
    assert get(article("<p>a <button>no</p><p>b</p>")) == rest + "a\nb\nLast words of it."


def test_pages_are_parsed_in_linear_time():
    import time

    for piece in ("<x>", "<div>", "<li><x>", "<svg><a>", "</i></q></z>", "<td><ul>"):
        took = []
        for n in (4000, 32000):
            began = time.process_time()
            extraction.Page(piece * n)
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.01), piece


def test_messages_are_exact_marginals():
    """Sum-product against all states of a small tree."""
    import itertools

    model = extraction.trained()
    page = extraction.Page("<nav>a</nav><article><p>b</p></article>")
    n = len(page.tags)
    weights = []
    for i in range(n):
        w = [1.0] * 5
        for f in page.features(i):
            if f in model.features:
                w = [a * b for a, b in zip(w, model.features[f], strict=True)]
        weights.append(w)
    total, content = 0.0, [0.0] * n
    for states in itertools.product(range(5), repeat=n):
        if states[0] != extraction.CONTAINER:
            continue
        p = weights[0][0]
        for i in range(1, n):
            p *= weights[i][states[i]] * model.moves[page.kind(i)][states[page.parents[i]]][states[i]]
        total += p
        for i, s in enumerate(states):
            content[i] += p * (s in (extraction.CONTENT, extraction.CONTENT_TOP))
    assert np.allclose(model.marginals(page)[1:], np.array(content[1:]) / total, atol=1e-6)


def test_toxicity_on_held_out_rows(spark, empty):
    r = random.Random(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        words = [r.choice(vocabulary) for _ in range(80)]
        if toxic:
            for _ in range(3):
                words[r.randrange(80)] = r.choice(["nasty", "vile", "rotten"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, "")]
    labels += [(2000, 1, 0), (3, None, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.pmod(common.crc_of_id("doc_id"), F.lit(5)) == 0
    model = toxicity.fit(docs, marks, ~held)
    got = toxicity.score(docs, model).withColumn("held", held).collect()
    assert len(got) == 1502 and all(0 <= x.score <= 1 for x in got)
    tested = [x for x in got if x.held and x.doc_id < 1500]
    assert sum((x.score >= 0.5) == (x.doc_id % 8 == 0) for x in tested) >= 0.98 * len(tested)
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 2000").count() == 2
    assert toxicity.fit(docs, marks.filter("toxic = 0")) is None
    one_kind = toxicity.fit_counts(toxicity._labelled(docs, marks))
    assert tuple(one_kind.curve) == toxicity.FIXED_CURVE and any(x.score >= 0.5 for x in toxicity.score(docs, one_kind).collect())
    assert {x.score for x in toxicity.score(docs.limit(3), None).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(empty, marks) is None


def _kneser_ney(rows):
    """Log-probabilities of words and pairs by class with dictionaries: (kind, expression, class) -> probability, and counts."""
    counts = {k: [collections.Counter(), collections.Counter()] for k in "wp"}
    for text, toxic in rows:
        w = re.findall("[a-z0-9\\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts["w"][toxic].update(w)
        counts["p"][toxic].update(zip([None, *w], w, strict=False))
    p = {}
    for k, two in counts.items():
        occurs = {e: sum(e in c for c in two) for e in {*two[0], *two[1]}}
        for c, own in enumerate(two):
            n, saved = sum(own.values()), sum(min(x, 0.9) for x in own.values())
            for e in occurs:
                p[k, e, c] = (max(own[e] - 0.9, 0) + saved * occurs[e] / sum(occurs.values())) / n
    return counts, p


def test_toxicity_evidence_is_a_difference_of_kneser_ney_models(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["a", "b", "c", "d", "Ü", f"x{r.randrange(30)}", "vile" if i % 3 == 0 else "e"]) for _ in range(r.choice([0, 1, 3, 9, 40]))), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(3, rows[3][1])], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    counts, p = _kneser_ney([(x, t) for _, x, t in rows] + [(rows[3][1], 1)])
    fitted = toxicity.fit(docs, marks)
    for _, text, _ in rows:
        w = text.split()
        expected = []
        for k, found in (("w", w), ("p", list(zip([None, *w], w, strict=False)))):
            terms = [np.log(p[k, e, 1] / p[k, e, 0]) if max(c[e] for c in counts[k]) >= 2 else 0.0 for e in found]
            expected.append(sum(terms) / len(w) if w else 0.0)
            expected += [max(sum(terms[i : i + n]) for i in range(len(w) - n + 1)) / n if len(w) > n else expected[-1] for n in (1, 4)] if w else [0.0, 0.0]
        expected = [*expected[:3], *expected[3:]]
        got = fitted.model.evidence([text.encode()])[0]
        whole = [got[0], got[3]]
        assert np.allclose(whole, [expected[0], expected[3]], atol=1e-5)
        if len(w) > 4:
            assert np.allclose(got, expected, atol=1e-5)
    # its own counts taken off: as if the text had not been there
    text, toxic = next((x, t) for _, x, t in rows if len(x.split()) > 20)
    left = [x for x in [(x, t) for _, x, t in rows] + [(rows[3][1], 1)] if x[0] != text]
    less, _ = _kneser_ney(left)
    word = max({*text.split()}, key=lambda w: len(w))
    key = toxicity.expressions([word.encode()])[0]
    off = fitted.model.terms(np.concatenate([key] * text.split().count(word)), 0, np.array([0, text.split().count(word)]), np.array([toxic]))
    now = [np.array([float(less["w"][c][word])]) for c in (1, 0)]
    assert np.allclose(off, toxicity.differences(*now, fitted.totals[0]) if sum(now) >= 2 else 0.0, atol=1e-5)
    # a table that is too large for a broadcast gives the same scores and keeps the same rows
    own = {(x.doc_id, round(x.score, 9)) for x in toxicity.score(docs, fitted).collect()}
    shuffled = toxicity.replace(fitted, model=None)
    assert {(x.doc_id, round(x.score, 9)) for x in toxicity.score(docs, shuffled).collect()} == own
    extra = docs.selectExpr("doc_id AS unit", "text", "doc_id", "1 AS key")
    assert sorted(map(tuple, toxicity.keep_ordinary(extra, shuffled).collect())) == sorted(map(tuple, toxicity.keep_ordinary(extra, fitted).collect()))
    old, toxicity.TABLE_ROWS = toxicity.TABLE_ROWS, 0
    try:
        again = toxicity.fit(docs, marks)
    finally:
        toxicity.TABLE_ROWS = old
    assert again.model is None and np.allclose(again.curve, fitted.curve)


def test_toxicity_counts_seldom_expressions_at_any_size(spark, monkeypatch):
    """What is too much for a broadcast is joined: all of the table counts, as if it were in memory."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice([f"w{r.randrange(400)}", "e", "f", f"vile{r.randrange(60)}" if i % 3 == 0 else "g"]) for _ in range(r.choice([0, 1, 3, 9, 40]))), int(i % 3 == 0)) for i in range(150)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(3, rows[3][1]), (None, rows[6][1]), (900, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    whole = toxicity.fit(docs, marks)
    monkeypatch.setattr(toxicity, "TABLE_ROWS", whole.table.count() - 1)
    parted = toxicity.fit(docs, marks, least_share=0.01)
    assert whole.rest is None and 0 < len(parted.model.keys) < parted.table.count() == len(whole.model.keys)
    assert np.allclose(parted.curve, whole.curve)
    scores = lambda m: sorted((x.doc_id or -1, round(x.score, 9)) for x in toxicity.score(docs, m).collect())
    assert scores(parted) == scores(whole) and len({x for _, x in scores(whole)}) > 50
    kept = lambda m: sorted((x.doc_id or -1, x.text or "") for x in toxicity.keep_ordinary(docs, m).collect())
    assert kept(parted) == kept(whole)


def test_toxicity_joins_a_table_where_it_lies(spark, monkeypatch):
    """The table of expressions isn't shuffled to the texts; chunks of any number of texts give the evidence of all in memory."""
    docs = spark.createDataFrame([(i // 2, " ".join(f"w{(i * k) % 89}" for k in range(i % 30)) + " vile" * (i % 3 == 0)) for i in range(120)] + [(5, None), (None, "w1 w2 vile")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    whole = toxicity.fit(docs, marks)
    assert "Exchange" not in whole.table.groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "CAST(NULL AS int) AS toxic")
    found = lambda m: sorted((x.doc_id or -1, *(round(v, 9) for v in x.evidence)) for x in toxicity.evidence(rows, m).collect())
    expected = found(whole)
    for size in (1, 400, 1 << 19):
        monkeypatch.setattr(toxicity, "JOINED_BYTES", size)
        assert found(toxicity.replace(whole, model=None)) == expected and len(expected) == 122


def test_toxicity_gives_its_shuffles_back_part_by_part(spark, monkeypatch):
    """The most frequent rows stay in memory, the rest is joined in parts that leave no shuffle on disk; the evidence is that of all in memory."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97} " + ("vile" if i % 4 == 0 else "mild") for k in range(20))) for i in range(200)] + [(None, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "CAST(NULL AS int) AS toxic")
    found = lambda m: sorted(((x.doc_id or -1, *(round(v, 9) for v in x.evidence)) for x in toxicity.evidence(rows, m).collect()))
    whole = toxicity.fit(docs, marks)
    expected = found(whole)
    monkeypatch.setattr(toxicity, "TABLE_ROWS", whole.table.count() // 2)
    parted = toxicity.fit(docs, marks)
    assert 0 < len(parted.model.keys) <= toxicity.TABLE_ROWS and len(parted.model.keys) + parted.rest.count() == whole.table.count()
    dirs = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    on_disk = lambda: {f.split("_")[1] for d in dirs for _, _, names in os.walk(d) for f in names if re.match(r"shuffle_\d+_", f)}
    before = on_disk()
    assert found(parted) == expected and len(expected) == 201
    for _ in range(50):  # files are deleted shortly after
        left = on_disk() - before
        if len(left) <= 2:
            break
        time.sleep(0.2)
    assert len(left) <= 2  # of the bitmap, which is of fixed size


def test_texts_of_passages_are_shuffled_once(spark):
    docs = _template_table(spark, 40)
    docs = docs.unionByName(docs.limit(3))
    shape = passages.Shape(50, 75)
    cold, _ = passages.shared_places(passages.windows(docs))
    stored = passages.stored_texts(docs, cold)
    assert stored.count() == stored.select("unit").distinct().count() == cold.count() > 0
    around = passages.contexts(docs, cold, shape, stored)
    assert "hashpartitioning" not in around._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in around.collect()} == {tuple(x) for x in passages.contexts(docs, cold, shape).collect()}


def test_warc_archives(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb"
    rows = [(5, "http://a", "same", 1), (3, "http://b", "same", 2), (9, None, "same", 3), (4, "http://c", tricky, 4), (6, "http://d", None, 5), (7, "x\r\ny", "", 6), (8, "u", "ü" * 70_000, 7), (8, "u", "ü" * 70_000, 7), (8, "v", "other text", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    out = str(tmp_path / "w")
    warc.write_archive(warc.records(pages), out)
    got = warc.read_archive(spark, out, with_payload=True).collect()
    import base64

    assert len(got) == len(rows) and all(r.digest_holds for r in got)
    by_payload = collections.defaultdict(list)
    for i, _, h, _ in rows:
        by_payload[(h or "").encode()].append(i)
    digest = {base64.b32encode(hashlib.sha1(p).digest()).decode(): (min(ids), len(p)) for p, ids in by_payload.items()}
    for r in got:
        first, length = digest[r.payload_digest]
        assert (r.record_type, r.refers_to, r.payload_bytes) == (("response", None, length) if r.record_id == first else ("revisit", first, length))
    assert any(bytes(r.payload).decode() == tricky for r in got)
    least = warc.read_archive(spark, out + "2") if warc.write_archive(warc.records(pages, least=5), out + "2") else warc.read_archive(spark, out + "2")
    assert {r.record_type for r in least.filter("payload_bytes < 5").collect()} == {"response"}
    warc.write_archive(warc.records(pages).withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")), out + "3")
    warc.deduplicate_archive(spark, out + "3", out + "4")
    again = {(r.record_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, out + "4").collect()}
    assert again == {(r.record_id, r.payload_digest, r.record_type, r.refers_to) for r in got}
    odd = spark.createDataFrame([(None, "u", "same"), (2, "v", "same"), (1, "w", "same"), (None, None, None), (None, "x", "other")], "page_id long, url string, html string")
    warc.write_archive(warc.records(odd), out + "6")
    assert sorted((r.record_id or 0, r.record_type, r.refers_to or 0) for r in warc.read_archive(spark, out + "6").collect()) == [(0, "response", 0)] * 3 + [(1, "response", 0), (2, "revisit", 1)]
    warc.write_archive(warc.records(pages.limit(0)), out + "5")
    assert warc.read_archive(spark, out + "5").count() == 0


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(sets):
    above = {i: i for i in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_jaccard_components(docs, empty, texts):
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    expected = components_of(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_families_of_altered_copies(spark):
    """Copies like their source but seldom like each other, in blocks cut into slices."""
    r = random.Random(9)
    source = [f"s{i}" for i in range(120)]
    found = []
    for _ in range(150):
        words = list(source)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            words[r.randrange(120)] = f"e{r.randrange(10**6)}"
        found.append(" ".join(words))
    found += [" ".join(source)] * 40 + [" ".join(source[:40] + [f"z{k}_{i}" for i in range(80)]) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    expected = components_of({i: shingle_set(t) for i, t in enumerate(found)})
    old = jaccard.BLOCK, jaccard.CROWD
    jaccard.BLOCK, jaccard.CROWD = 40, 20
    try:
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    finally:
        jaccard.BLOCK, jaccard.CROWD = old
    assert got == expected


def test_points_bound_the_overlap():
    r = np.random.default_rng(2)
    for _ in range(30):
        a, b = (np.unique(r.integers(0, 3000, r.integers(5, 900)).astype(np.uint64)) for _ in range(2))
        for finer in (1, 16):
            p, q = (jaccard.Points(jaccard.points(x, np.array([0, len(x)]), finer)) for x in (a, b))
            _, bound = p.possible(np.array([0]), q, np.array([0]), np.array([len(a)]), np.array([len(b)]), 0)
            assert bound[0] * (len(a) + len(b)) >= len(np.intersect1d(a, b)) - 1e-6


def test_boxes_of_points_of_very_long_texts():
    points = jaccard.Points([bytes([40]) * 65536, bytes([3]) * 65536])
    assert (points.boxes() == np.array([[65535], [3 * 2048]])).all()
    assert (points.folded(65536, 32) == np.array([[40 * 2048], [3 * 2048]])).all()


def test_connected_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (70, 70)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[150] == 100 and all(got[300 + i] == 300 for i in range(30)) and 70 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_compact_windows_are_cartesian_tree_intervals():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(1, 60))
        v = r.integers(0, 30, n).astype(np.uint64) << np.uint64(40)
        cut = sorted({0, n, *r.integers(0, n, 2).tolist()})
        least = int(r.integers(1, 9))
        expected = set()
        for s, e in zip(cut, cut[1:], strict=False):
            for c in range(s, e):
                left = right = c
                while left > s and v[left - 1] > v[c]:
                    left -= 1
                while right + 1 < e and v[right + 1] >= v[c]:
                    right += 1
                if right - left + 1 >= least:
                    expected.add((c, left, right))
        assert set(zip(*[x.tolist() for x in passages.compact_windows(v, np.array(cut), least)], strict=True)) == expected


def _template_table(spark, trials):
    """Lists of entries of 40 constant and 5 differing words; id 3 n + 2 repeats 50 words of a middle entry of 3 n + 1."""
    rows = []
    for n in range(trials):
        draw = random.Random(n)
        word = lambda: f"w{draw.getrandbits(40):x}"  # noqa: B023, E731
        constant = [word() for _ in range(40)]
        entries = [x for _ in range(9) for x in (*constant, *(word() for _ in range(5)))]
        cut = 45 * 4 + draw.randrange(45)
        rows.append((3 * n, " ".join([*(word() for _ in range(20)), *constant, *(word() for _ in range(20))])))
        rows.append((3 * n + 1, " ".join(entries)))
        rows.append((3 * n + 2, " ".join([*(word() for _ in range(60)), *entries[cut : cut + 50], *(word() for _ in range(60))])))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_repeats_of_a_middle_entry_of_a_template(spark):
    found = {(r["doc_id"], r["first_id"]) for r in passages.repeats(_template_table(spark, 200)).collect() if r["end_word"] - r["start_word"] >= 50}
    assert sum((3 * n + 2, 3 * n + 1) in found or (3 * n + 2, 3 * n) in found for n in range(200)) == 200


def _near_copies(spark, trials, length, lead):
    """Id 3 n + 2 repeats a passage of 3 n + 1 with one word replaced; id 3 n has the passage's first ``lead`` words."""
    rows = []
    for n in range(trials):
        draw = random.Random(n)
        some = lambda k: [f"w{draw.getrandbits(40):x}" for _ in range(k)]  # noqa: B023, E731
        passage = some(length)
        copy = list(passage)
        copy[draw.randrange(length)] = "edited"
        for i, x in enumerate((passage[:lead], passage, copy)):
            rows.append((3 * n + i, " ".join([*some(60), *x, *some(60)])))
    return spark.createDataFrame(rows, "doc_id long, text string")


def _near_found(spark, trials, length, lead):
    found = {r["doc_id"] for r in passages.repeats(_near_copies(spark, trials, length, lead)).collect()}
    return sum(3 * n + 2 in found for n in range(trials))


def test_near_copies_beside_a_lesser_document_with_their_lead_in(spark):
    assert _near_found(spark, 300, 60, 40) >= 297


def test_near_copies_of_fifty_words(spark):
    assert _near_found(spark, 400, 50, 0) == 400


def test_keys_of_many_places_give_the_same_pairs(spark):
    """Hashes grouped by rows find what sorting a key's places finds, and what comparing all pairs finds."""
    draw = random.Random(5)
    some = lambda k: [f"w{draw.getrandbits(40):x}" for _ in range(k)]
    core, rows = some(60), []
    for i in range(120):
        copy = core[: draw.choice([30, 45, 60])]
        for _ in range(draw.choice([0, 1, 1, 2])):
            at = draw.randrange(len(copy))
            copy[at : at + draw.choice([0, 1, 2])] = some(draw.choice([0, 1, 2]))
        rows.append((i, " ".join([*some(draw.choice([0, 30])), *copy, *some(30)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shape = passages.Shape(50, 75)
    found = []
    for hot in (10**6, 1):
        cold, crowded = passages.shared_places(passages.windows(docs), hot)
        pairs = passages.candidates(passages.contexts(docs, cold, shape), shape).unionByName(passages.hot_candidates(passages.contexts(docs, crowded, shape), shape))
        assert (crowded.count() > 0) == (hot == 1)
        found.append({r.doc_id for r in pairs.join(passages.units(docs), "unit").collect()})
    expected = {i for i, t in rows if any(len(shingle_tuples(t) & shingle_tuples(u)) >= 40 and passages_alike(t, u) for j, u in rows[:i])}
    assert expected <= found[0] == found[1] and len(expected) > 40
    assert {r.doc_id for r in passages.repeats(docs, hot=1).collect()} == {r.doc_id for r in passages.repeats(docs).collect()} >= expected


def shingle_tuples(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def passages_alike(t, u):
    """Whether 50 words on end of ``t`` have 40 of their 46 tokens in ``u``."""
    w, other = t.split(), shingle_tuples(u)
    same = [tuple(w[i : i + 5]) in other for i in range(len(w) - 4)]
    return any(sum(same[i : i + 46]) >= 40 for i in range(len(same) - 45))


def test_one_id_with_several_texts_and_clashing_columns(spark):
    draw = random.Random(9)
    some = lambda k: " ".join(f"w{draw.getrandbits(30):x}" for _ in range(k))
    a, b, c = some(60), some(70), some(55)
    rows = [(1, a, "x", 1), (1, b, "x", 2), (2, f"{a} tail", "y", 3), (2, some(5), "y", 4), (3, f"{b} {c}", "z", 5), (4, a, "u", 6), (4, a, "u", 6), (5, None, "v", 7), (None, a, "n", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string, unit int")
    spans = passages.repeats(docs)
    assert {(r.doc_id, r.start_word, r.end_word, r.first_id) for r in spans.collect()} == {(2, 0, 60, 1), (3, 0, 70, 1), (4, 0, 60, 1)}
    cut = passages.without_repeats(docs, spans)
    assert cut.columns == docs.columns and {(r.doc_id, (r.text or "").strip(), r._spans, r.unit) for r in cut.collect()} == {(i, "tail" if t and t.endswith("tail") else c if i == 3 else "" if i == 4 else t or "", x, k) for i, t, x, k in rows}


def test_repeated_passages(docs, empty, texts):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in enumerate(texts)}
    first, exact = {}, collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            j = first.setdefault(tuple(w[k : k + 50]), i)
            if j != i:
                exact[i].update(range(k, k + 50))
    spans = passages.repeats(docs)
    got = collections.defaultdict(set)
    for r in spans.collect():
        assert r.first_id < r.doc_id and r.end_word - r.start_word >= 40
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert exact and all(e <= got[i] for i, e in exact.items())
    assert not {i for i in got if not exact[i]} - {i for i in range(len(texts)) if any(len(shingle_set(texts[i]) & shingle_set(texts[j])) >= 40 for j in range(i))}
    cut = passages.without_repeats(docs, spans)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    by_id = {r.doc_id: r for r in cut.collect()}
    k = next(i for i, t in enumerate(texts) if t and t.endswith("end of another"))
    assert by_id[k].text.strip() == "end of another" and by_id[k].n_chars == len(by_id[k].text) and by_id[0].text is None
    assert passages.repeats(empty).count() == 0


def brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_rules(spark, docs, empty, texts):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, marks).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    assert "stats" not in quality.with_statistics(docs).drop("stats").columns and quality.with_statistics(docs).columns.count("stats") == 1
    r = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        mark = r.choice(["###", "***"]) if bad else ""
        rows.append((i, " ".join(f"w{r.randrange(5000)}" + (mark if r.random() < 0.7 else "") for _ in range(60))))
        labels.append((i, int(not bad), 0))
    rows.append((1000, None))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    verdicts = {r.doc_id: (r.kept, r.rule) for r in quality.quality(made, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(verdicts[i] == ((False, 1) if i % 6 == 0 else (True, 0)) for i in range(900)) and not verdicts[1000][0]
    clashing = docs.select("text", *[F.lit(i).alias(c) for i, c in enumerate(("_w", "w", "_s", "s", "_lines", "_word_chars", "upper", "_upper", "stats"))])
    given = quality.with_statistics(clashing, name="_stats")
    assert given.columns == [*clashing.columns, "_stats"] and {r.stats for r in given.collect()} == {8} and {r.w for r in given.collect()} == {1}
    plan = quality.with_statistics(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.quality(empty, marks).count() == 0


def test_shards_hold_every_sequence_once(spark, docs, empty, texts, tmp_path):
    from tokenizers import Tokenizer

    for n in (1, 2, 3, 5, 100, 1000, 65537):
        order = shards.Feistel(n, 7)
        slots = order.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (order.number(slots) == np.arange(n)).all()
    assert shards.Feistel(1000, 7).slot(np.arange(1000)).tolist() != shards.Feistel(1000, 8).slot(np.arange(1000)).tolist()
    path, out = tokenizers.path("word_bpe_49k.json"), str(tmp_path / "shards")
    index, order = shards.materialize_order(docs, path, out, key=11, length=128, per_shard=64)
    stored = {r.slot: r for r in shards.read_shards(spark, out, 128, 64).collect()}
    places = sorted(index.collect(), key=lambda r: r.number)
    assert sorted(stored) == list(range(order.size)) and [r.number for r in places] == list(range(order.size))
    own = Tokenizer.from_file(path)
    every = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    total = 0
    for r in places:
        assert order.slot(np.array([r.number]))[0] == r.slot and stored[r.slot].ids_crc32 == r.ids_crc32 == zlib.crc32(bytes(stored[r.slot].ids))
        ids = np.frombuffer(bytes(stored[r.slot].ids), "<u2")[: r.n_ids].tolist()
        head = every[r.first_doc_id][r.first_start : r.first_start + len(ids)]
        assert ids[: len(head)] == head
        total += r.n_ids
    assert total == sum(map(len, every.values()))
    index, order = shards.materialize_order(empty, path, out + "0", key=11)
    assert order.size == 0 and index.count() == 0


def test_shards_and_archives_when_every_sort_spills(tmp_path):
    """Records are in their slots and archives whole though sorts spill at 40 rows; in a session of its own."""
    import subprocess
    import sys
    from pathlib import Path

    script = f"""
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.shuffle.spill.numElementsForceSpillThreshold", "40").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
import public_tokenizers
from arborix.llm import shards, warc
docs = spark.range(900).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', x * id))) AS text")
index, order = shards.materialize_order(docs, public_tokenizers.path("word_bpe_49k.json"), "{tmp_path}/s", key=5, length=64, per_shard=100)
stored = shards.read_shards(spark, "{tmp_path}/s", 64, 100).select("slot", "ids_crc32")
assert order.size > 2000 and stored.count() == order.size == stored.join(index, ["slot", "ids_crc32"]).count()
pages = spark.range(900).selectExpr("id AS page_id", "'u' AS url", "concat('p', id % 300) AS html")
warc.write_archive(warc.records(pages), "{tmp_path}/w")
got = warc.read_archive(spark, "{tmp_path}/w")
assert got.count() == 900 and got.filter("digest_holds AND CASE WHEN record_id < 300 THEN record_type = 'response' ELSE refers_to = record_id % 300 END").count() == 900
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, cwd=Path(__file__).resolve().parents[2])
    assert done.returncode == 0, done.stderr[-2000:]


def test_tables_without_ids(spark):
    """Rows without an id crash nothing."""
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, None), (None, None)], "doc_id long, text string")
    path = tokenizers.path("word_bpe_49k.json")
    assert packing.pack_documents(docs, path, 64).count() == 3
    assert jaccard.near_duplicates(docs).count() == 3
    assert passages.repeats(docs).count() == 0
    assert flac.media_digests(flac.encode_media(docs)).count() == 3
