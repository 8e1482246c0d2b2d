"""The registered query of each operator: whole tables, whole texts, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, langid, licenses, neardup, packing, pii, quality, repair, sentencepiece_sa, store, toxicity, trie, warc


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file: in ``folder``, or where the installed package has it."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 5, 0)
    model = langid.train(docs.where(~out), "text", "lang")
    named = langid.identify(docs, model, "text", ("doc_id",))
    return named.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = langid.held_out("doc_id", 3, 1)
    lexicon = toxicity.train(toxicity.labelled(docs, labels.where(~out)))
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"), store.new_dir(spark, "warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sa.encoded(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.read_back(chat.windows(chat.conversations(rows))))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = store.written(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")), "pieces")
    return packing.packed(cut)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(rows), rows)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict:
    found = (
        op1_language_id, op2_fingerprints, op3_toxicity, op4_warc, op5_sentencepiece, op6_near_duplicates, op7_licenses, op8_quality, op9_chat, op10_packing,
        op11_repair, op12_pii, op13_trie,
    )
    return {f.__name__: f for f in found}
