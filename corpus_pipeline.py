"""The corpus pipeline: stages over documents, each written and read again by whoever runs them.

All but the last stage return the columns of documents. Rows without an id or without a text pass the filters that need
neither (a null text is an empty one, which the quality rules reject); an empty table gives an empty result. Rows that have an
id in common but not a text are each judged by their own text. Columns of any further names go through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm import jaccard, packing, passages, quality, toxicity
from arborix.llm.common import BROADCAST_IDS, discard, free_name, materialize, table

TOKENIZER, SEQUENCE = "word_bpe_49k.json", 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, fitted on all labelled ones, score below 0.5."""
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    kept = toxicity.keep_ordinary(docs, fitted)
    if fitted is not None:
        discard(fitted.table)  # the rows kept need its model or the toxic texts alone
    return kept


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and that no learned rule rejects."""
    rules = quality.learn_from(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "stats")
    stats = F.col(name)
    return quality.with_statistics(docs, name=name).filter(~quality.base_failed(stats) & rules.verdict(stats)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates; repeated rows once."""
    found = jaccard.near_duplicates(docs.filter("doc_id IS NOT NULL"))
    kept = materialize(found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("own"), F.count(F.lit(1)).alias("n")).filter("own").select("doc_id", "n"), "kept")
    of = lambda ids: docs.join(ids.select("doc_id"), "doc_id", "left_semi")
    if kept.count() <= BROADCAST_IDS:  # no text is shuffled but those of repeated ids
        once, again = (of(F.broadcast(kept.filter(x))) for x in ("n = 1", "n > 1"))
        rows = once.unionByName(again.dropDuplicates(["doc_id", "text"]))
    else:
        rows = of(kept).dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that a document of a lesser id has too."""
    return passages.without_repeats(docs, passages.repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), SEQUENCE)


STAGES = [("toxicity", drop_toxic), ("quality rules", apply_quality_rules), ("near duplicates", one_of_each_group), ("repeated passages", cut_repeated_passages), ("packing", pack)]

#: Trained models, hashes and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
