"""The corpus pipeline: quality rules, language ID, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each stage as Parquet to the shared folder
and reads it back as the next one's docs. All stages but the last return the columns of documents, with their values: an
operator sees no column but those that it reads, whatever the others are called. What stages write on their way is removed
once the next one is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetra.llm import decontaminate as dc
from facetra.llm import language_id as li
from facetra.llm import near_dedup, packing
from facetra.llm import quality_rules as qr
from facetra.llm.common import fresh, read
from facetra.storage import clean, mark, stored

#: A document whose language is less certain than this is rejected, as is one without a letter. Scores are means over a
#: text's bytes: a text half in one language and half in another gets 0.5, clean texts of ten words get 0.45 and more.
LEAST_CERTAIN = 0.4


def _passed(docs: DataFrame, read_columns: tuple[str, ...], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of docs that judge leaves, which sees the columns it reads under their names and all others under neutral ones."""
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in read_columns}
    left = judge(docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]))
    return left.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return _passed(docs, ("text",), lambda rows: qr.apply_policy(qr.ledger(rows)).where("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network, trained on this stage's own documents, tells with some certainty."""
    net = li.train(docs)
    sure = (F.col("lang_pred") != li.UND) & (F.col("score") >= LEAST_CERTAIN)
    return _passed(docs, ("doc_id", "text"), lambda rows: li.identify(rows, net).where(sure))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id. Where ids repeat or are missing, rows get numbers of their
    own, and of each group the first row by id and a hash of the text stays, those without an id last."""
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        kept = near_dedup.near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    row, group = fresh(docs.columns, "row"), fresh(docs.columns, "group")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_dedup.near_duplicates(rows.select(row, "text"), doc_id=row).select(F.col("doc_id").alias(row), F.col("component_id").alias(group))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), row)
    first = rows.join(found, row).groupBy(group).agg(F.min_by(row, order).alias(row)).select(row)
    return rows.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    items = read(spark, sf_dir, "benchmark")
    return _passed(docs, ("text",), lambda rows: dc.decontaminate(rows, items).where(~F.col("contaminated")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as op4 returns them."""
    packed = packing.pack_documents(docs.select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The trained network and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = read(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        clean(at, docs)
    return docs
