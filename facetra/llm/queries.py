"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetra.llm import chat, collocations
from facetra.llm import decontaminate as dc
from facetra.llm import language_id as li
from facetra.llm import near_dedup, packing, repair, secrets, sharding, warc
from facetra.llm import quality_model as qm
from facetra.llm import quality_rules as qr
from facetra.llm import toxicity as tx
from facetra.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qr.apply_policy(qr.ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_upper", "failure_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op1 removes, from bit patterns."""
    return qr.ablations(qr.ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(read(spark, sf_dir, "conversations"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return li.identify(docs.drop("lang"), li.train(docs), keep=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = dc.decontaminate(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = tx.train(docs, read(spark, sf_dir, "labels"))
    return tx.score(docs, model, keep=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = qm.train(docs, read(spark, sf_dir, "labels"))
    return qm.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read(warc.write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_all(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {n: f for n, f in globals().items() if n.startswith("op") and n[2:3].isdigit()}
    return found | {"quality_ablations": quality_ablations, "pipeline": pipeline}
