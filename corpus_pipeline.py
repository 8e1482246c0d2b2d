"""A corpus pipeline of four stages; each works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import langid, neardup, packing, quality, store, toxicity
from scriptorium.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least 0.5 and that pass the base rules. Null and empty texts go;
    columns, repeated rows and ids are as they were."""
    return quality.accepted(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7; the lexicon is fitted on the labelled ones among them that
    are not held out. Null texts score as empty ones and stay; columns, repeated rows and ids are as they were."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~langid.held_out("doc_id", 3, 1))
    lexicon = toxicity.train(toxicity.labelled(docs, labels))
    return toxicity.mild(docs, lexicon)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id. Documents are told apart by their
    rows: repeated or null ids lose none, texts without words all stay, other columns pass unread."""
    return neardup.deduplicated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens. A null text is empty; repeated
    rows are documents of their own; other columns are not read."""
    cut = store.written(packing.pieces(docs, tokenizer_path("word_bpe_49k.json")), "pieces")
    return packing.packed(cut)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("near_duplicates", near_duplicates), ("packing", best_fit_packing)]

#: Fitted models and tokenizers are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return docs
