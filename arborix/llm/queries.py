"""The thin queries ``opN_<name>`` over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, extraction, flac, jaccard, mixing, negatives, packing, passages, quality, shards, toxicity, warc
from .common import crc_of_id, scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 2048)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again; as counts and digests."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), _pattern())


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a FLAC stream, read back; as digests and features."""
    return flac.media_digests(flac.encode_media(table(spark, sf_dir, "documents")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract_pages(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by models fitted on the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(5)) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sequences in shards by a keyed permutation, read back: each slot with its origin and checksums."""
    path = scratch_path(spark, "shards")
    index, _ = shards.materialize_order(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), path, key=20240501)
    stored = shards.read_shards(spark, path, with_ids=False).select("slot", "shard", "record", "n_ids", "ids_crc32")
    origin = index.select("slot", "number", "first_doc_id", "first_start", F.col("ids_crc32").alias("crc_before"))
    return stored.join(origin, "slot").select("slot", "shard", "record", "number", "first_doc_id", "first_start", "n_ids", "ids_crc32", (F.col("ids_crc32") == F.col("crc_before")).alias("intact"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records with revisits resolved, read back from the archives."""
    path = scratch_path(spark, "warc")
    warc.write_archive(warc.records(table(spark, sf_dir, "pages")), path)
    return warc.read_archive(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document of a lesser id has too, equal or nearly so."""
    found = passages.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("first_id").alias("first_doc_id"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of at least 75 % of common five-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and the learned decision list's verdict on every document."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of 2 to 5 words that occur 100 times and more."""
    return collocations.collocations(table(spark, sf_dir, "documents"), 100, 5, 2000)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to one and a half times their words, sources weighing 3, 1, 2 in turn."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and each of its positives, the best rows of other labels among all embeddings."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.usable(table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 100 == 0)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_packing, op2_byte_bpe, op3_flac_media, op4_html_extraction, op5_toxicity, op6_training_order, op7_warc_revisits, op8_substring_dedup, op9_ngram_jaccard, op10_quality_rules, op11_collocations, op12_mixing, op13_hard_negatives)}


#: SHA-1 in DuckDB is a hex string; five of its digits make four of base32's.
_BASE32_SQL = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {i}, 5))::INT >> {s}) & 31) + 1, 1)" for i in range(1, 41, 5) for s in (15, 10, 5, 0))

OP7_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {_BASE32_SQL} AS payload_digest, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
t AS (SELECT lang, count(*)::BIGINT AS n FROM o GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, m, count(*)::BIGINT AS f FROM o, range(1, 6) AS k(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE m > 1),
x AS (SELECT lang, array_to_string(w[s : s + z - 1], ' ') AS phrase, max(f) AS longer FROM c, range(1, 5) AS i(s), range(2, 5) AS j(z) WHERE z < m AND s + z - 1 <= m GROUP BY ALL),
b AS (SELECT c.lang, c.phrase, c.f AS a, c.w, c.m FROM c LEFT JOIN x ON x.lang = c.lang AND x.phrase = c.phrase WHERE x.longer IS NULL OR 100 * x.longer < 100 * c.f),
s AS (SELECT b.lang, b.phrase, b.a, l.f AS l, r.f AS r, t.n, k, ((1000::HUGEINT * b.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM b JOIN range(1, 5) AS q(k) ON k < b.m JOIN t ON t.lang = b.lang
      JOIN g AS l ON l.lang = b.lang AND l.phrase = array_to_string(b.w[1 : k], ' ') JOIN g AS r ON r.lang = b.lang AND r.phrase = array_to_string(b.w[k + 1 : b.m], ' ')),
y AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM y
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

#: The same sums in one place: 36 bits of an MD5 as the start, integers of 128 bits for the sums.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS place, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, cap::DOUBLE / weight AS fills FROM w),
o AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER earlier, 0)::DOUBLE)
               / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER earlier, 0)::DOUBLE) AS level
      FROM f WINDOW earlier AS (ORDER BY fills, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM o WHERE fills > level ORDER BY fills, place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN fills <= l.level THEN cap::DOUBLE ELSE l.level * weight END AS target, fills <= l.level AS filled FROM f, l),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN filled THEN 137438953472 ELSE least(137438953472, floor(target / source_size * 68719476736)::BIGINT) END AS rate,
             ('0x' || substr(md5('12|' || coalesce('=' || source, '')), 1, 9))::BIGINT AS start FROM t),
p AS (SELECT d.doc_id, d.size, r.source_size, r.target, d.source, r.rate, r.start + sum(r.rate::HUGEINT) OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (upto // 68719476736 - (upto - rate) // 68719476736))::BIGINT AS taken, source, (upto // 68719476736 - (upto - rate) // 68719476736)::BIGINT AS copies
FROM p
"""

OP13_SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM e a JOIN e r ON a.id <> r.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_revisits": OP7_SQL, "op11_collocations": OP11_SQL, "op12_mixing": OP12_SQL, "op13_hard_negatives": OP13_SQL}
