"""Joining the layers of a corpus into records, and settling which record keeps a disputed link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetra.functions import text as tx


def claims(rows: DataFrame, doc_id: str = "id", url: str = "source_url") -> DataFrame:
    """ref, claimants, owner: links that more than one record claims; the owner is the one claimant that derives the
    link's number from its id, null if none or several do."""
    ref = tx.url_ref(F.col(url))
    own = tx.derives(F.col(doc_id), tx.url_number(F.col(url)))
    found = rows.select(F.col(doc_id).cast("string").alias("_id"), ref.alias("ref"), own.alias("_own")).where("ref IS NOT NULL").distinct()
    sums = found.groupBy("ref").agg(F.count(F.lit(1)).alias("claimants"), F.count_if("_own").alias("_n"), F.min(F.when(F.col("_own"), F.col("_id"))).alias("_o"))
    return sums.where("claimants > 1").select("ref", "claimants", F.when(F.col("_n") == 1, F.col("_o")).alias("owner"))


def settle_links(rows: DataFrame, disputed: DataFrame, doc_id: str = "id", url: str = "source_url") -> DataFrame:
    """rows with link (null where withheld) and withheld. Rows without a link meet nothing; they are dealt by id, under a key
    that no trimmed link is."""
    ref = tx.url_ref(F.col(url))
    key = F.coalesce("_ref", F.concat(F.lit(" "), F.col(doc_id).cast("string")))
    joined = rows.withColumn("_ref", ref).withColumn("_key", key).join(disputed.select(F.col("ref").alias("_key"), "owner", F.lit(True).alias("_d")), "_key", "left")
    lost = F.coalesce(F.col("_d"), F.lit(False)) & ~F.col("owner").eqNullSafe(F.col(doc_id).cast("string"))
    kept = F.when(~lost, F.nullif(F.trim(url), F.lit("")))
    return joined.withColumns({"link": kept, "withheld": lost & F.col("_ref").isNotNull()}).drop("_ref", "_key", "owner", "_d")


def link_accounting(settled: DataFrame, disputed: DataFrame) -> DataFrame:
    """linked, withheld, disputed: one row."""
    own = settled.agg(F.count_if(F.col("link").isNotNull()).alias("linked"), F.count_if("withheld").alias("withheld"))
    return own.join(F.broadcast(disputed.agg(F.count(F.lit(1)).alias("disputed"))))  # one row


def join_layers(labels: DataFrame, meta: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Unified records: each label row with its metadata and text position. The date is the labels' before the
    metadata's; volume and part are the metadata's before the labels'. Empty strings and 0 count as missing."""
    m = meta.select(
        "year", "month", F.col("id"), F.col("doctitle"), F.col("bookNo"), F.col("section"), F.col("category"), F.col("publishDate"), F.col("pageNo"), F.col("source_url")
    )
    out = labels.withColumn("id", tx.record_id(F.col("pdf_file"))).join(m, ["year", "month", "id"], "left")
    if index is None:
        out = out.withColumn("text_at", F.lit(None).cast("struct<offset:bigint,length:bigint>"))
    else:
        i = index.select("year", F.col("doc_id").alias("id"), F.struct("offset", "length").alias("text_at"))
        out = out.join(i, ["year", "id"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(
        "id", "year", "month",
        tx.clean_title(F.col("doctitle")).alias("title"),
        tx.first_text(F.col("publish_date"), F.col("publishDate")).alias("date"),
        tx.first_number(tx.to_int(F.col("bookNo")), F.col("volume")).alias("volume"),
        tx.first_text(tx.compose_part(F.col("section"), F.col("category")), F.col("part")).alias("part"),
        tx.first_text(tx.series_letter(F.col("category")), F.col("part_class")).alias("part_class"),
        tx.to_int(F.col("pageNo")).alias("page"),
        "doc_type", "agency", "agency_type", "province", "topic", "action", "govlevel",
        flag("topic_corroborated").alias("topic_c"), flag("action_corroborated").alias("action_c"), flag("govlevel_corroborated").alias("govlevel_c"),
        "labels", tx.drop_empty(F.col("extracted")).alias("extracted"), "source_url", "has_text", "text_at", "ingest_ord",
    )
