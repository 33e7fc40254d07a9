"""JSON-lines layers of a corpus: metadata, labels, taxonomy, text positions and texts, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetra.functions.text import record_id
from facetra.operators.clean import claims, join_layers, settle_links
from facetra.storage import stored

META = "pdf_file STRING, doctitle STRING, bookNo STRING, section STRING, category STRING, publishDate STRING, pageNo STRING, source_url STRING"
LABELS = (
    "pdf_file STRING, volume INT, part STRING, part_class STRING, publish_date STRING, doc_type STRING, agency STRING, agency_type STRING, "
    "province STRING, topic STRING, action STRING, govlevel STRING, topic_corroborated BOOLEAN, action_corroborated BOOLEAN, "
    "govlevel_corroborated BOOLEAN, labels ARRAY<STRUCT<slug: STRING, axis: STRING, weight: DOUBLE, corroborated: BOOLEAN, matched_by: ARRAY<STRING>>>, "
    "extracted MAP<STRING, STRING>, has_text BOOLEAN"
)
TAXONOMY = "topics MAP<STRING, STRUCT<thai: STRING, parent: STRING>>, actions MAP<STRING, STRING>, govlevels MAP<STRING, STRING>"
INDEX = "doc_id STRING, offset BIGINT, length BIGINT"
TEXT = (
    "doc_id STRING, text STRING, method STRING, score DOUBLE, n_pages INT, signatories ARRAY<STRUCT<name: STRING, position: STRING>>, "
    "announcement_date STRING, reference_numbers ARRAY<STRING>, doc_type STRING, issuer STRING, subject STRING"
)


def _layer(spark: SparkSession, root: str, layer: str, schema: str) -> DataFrame:
    """Rows of <root>/<layer>/<year>/<month>.jsonl, or of files below year=<year>/month=<month>, with year, month and an
    ingest number that rises within each file."""
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(f"{root}/{layer}")
    return rows.select(
        "*",
        F.regexp_extract(path, r"/(?:year=)?(\d{4})/[^/]*(?:/[^/]*)?$", 1).alias("year"),
        F.regexp_extract(path, r"/(?:month=)?(\d{4}-\d{2})(?:\.jsonl|/[^/]*)$", 1).alias("month"),
        F.monotonically_increasing_id().alias("ingest_ord"),
    ).where("year <> ''")


def _last(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key by ingest number."""
    columns = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), "ingest_ord").alias("_r"))
    return best.select(*keys, "_r.*")


def meta(spark: SparkSession, root: str) -> DataFrame:
    rows = _layer(spark, root, "meta", META).where(F.col("pdf_file").isNotNull())
    return _last(rows.withColumn("id", record_id(F.col("pdf_file"))), ["year", "month", "id"])


def labels(spark: SparkSession, root: str) -> DataFrame:
    return _layer(spark, root, "taxonomy", LABELS).where(F.col("pdf_file").isNotNull())


def text_index(spark: SparkSession, root: str) -> DataFrame:
    rows = _layer(spark, root, "textindex", INDEX).where("doc_id IS NOT NULL AND offset IS NOT NULL AND length > 0")
    return _last(rows, ["year", "doc_id"])


def texts(spark: SparkSession, root: str) -> DataFrame:
    """Text records that have an id and a text; signatories without name and position are left out."""
    rows = _layer(spark, root, "text", TEXT).where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    some = lambda c: F.coalesce(c != "", F.lit(False))
    return rows.withColumn("signatories", F.filter("signatories", lambda s: some(s["name"]) | some(s["position"])))


def taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """topics (slug, name, parent) and codes (axis, code, name) of the taxonomy document."""
    doc = spark.read.schema(TAXONOMY).option("multiLine", True).json(path)
    topics = doc.select(F.explode("topics").alias("slug", "t")).select("slug", F.coalesce("t.thai", "slug").alias("name"), F.col("t.parent").alias("parent"))
    code = lambda axis: doc.select(F.explode(axis).alias("code", "name")).select(F.lit(axis).alias("axis"), "code", "name")
    return topics, code("actions").union(code("govlevels"))


def years(*layers: DataFrame) -> DataFrame:
    """Years that every layer has, digits only."""
    found = [x.select("year").where(F.col("year").rlike(r"^\d+$")).distinct() for x in layers]
    out = found[0]
    for x in found[1:]:
        out = out.intersect(x)
    return out


def chosen_years(spec: str, there: list[str]) -> list[str]:
    """``2024``, ``2020-2026`` or ``2024,2025`` as a list; a year that is not there is an error."""
    out: list[str] = []
    for part in spec.split(","):
        lo, _, hi = part.strip().partition("-")
        out += [str(y) for y in range(int(lo), int(hi or lo) + 1)]
    if missing := [y for y in out if y not in there]:
        raise ValueError(f"no such years: {', '.join(missing)}")
    return sorted(set(out))


def limited(df: DataFrame, k: int | None) -> DataFrame:
    """At most k records of each year, the first by ingest; all for None."""
    if k is None:
        return df
    w = Window.partitionBy("year").orderBy("ingest_ord")
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def load(spark: SparkSession, root: str, years_spec: str | None = None, limit: int | None = None, with_index: bool = True) -> DataFrame:
    """Unified records of a corpus folder. Disputed links are settled over all years, then years are chosen. The metadata are
    parsed once and stored, as years and claims are read from them too."""
    m, found = stored(meta(spark, root), "meta"), labels(spark, root)
    index = text_index(spark, root) if with_index else None
    out = join_layers(found, m, index)
    out = settle_links(out, claims(m))
    there = [r[0] for r in years(*([found, m] if years_spec else [m])).collect()]  # a row per year; records have the labels' years
    return limited(out.where(F.col("year").isin(chosen_years(years_spec, there) if years_spec else there)), limit)


def with_text(records: DataFrame, layer: DataFrame) -> DataFrame:
    """Records with their text, joined on month and id; null where there is none."""
    t = layer.select("month", F.col("doc_id").alias("id"), "text")
    return records.join(t, ["month", "id"], "left")


def line_key(line: Column) -> Column:
    """A record's key without parsing the whole line."""
    return F.get_json_object(line, "$.doc_id")
