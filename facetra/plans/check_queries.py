"""Queries on layers, sinks and checks. Layers are written as JSON lines from the tables and loaded back; checks run over
columns derived from the tables, with faults at known places, so that each has something to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetra.functions import text
from facetra.operators import encode, lookup, quality
from facetra.operators.ordered import with_running
from facetra.plans import publish, versions
from facetra.plans.registry import query
from facetra.sources import jsonl, tables
from facetra.storage import new_folder


def _rec(spark: SparkSession, d: str) -> DataFrame:
    return tables.records(spark, d)


# ---- layers


def _write_layers(spark: SparkSession, d: str) -> str:
    """The three layers of the records as JSON lines; gives their folder. Some records lack metadata, some a position."""
    rec, root = _rec(spark, d), new_folder(spark, "layers")
    file = F.concat("year", F.lit("-"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(".pdf")).alias("pdf_file")
    k = F.col("id")
    number = F.when(k % 10 == 0, k + 1).otherwise(k)  # each tenth claims its neighbour's link
    meta = rec.where(k % 9 > 0).select(
        "year", "month", file, F.concat(F.lit("  "), F.col("title")).alias("doctitle"), text.thai_digits(F.col("volume")).alias("bookNo"), F.col("page").cast("string").alias("section"),
        F.lit("ง").alias("category"), F.col("date").alias("publishDate"), F.col("page").cast("string").alias("pageNo"),
        F.concat(F.lit(f"https://{text.HOST}/documents/"), number.cast("string"), F.lit(".pdf")).alias("source_url"),
    )
    labels = rec.select(
        "year", "month", file, (F.col("volume") + 100).alias("volume"), F.col("part"), F.when(k % 4 > 0, F.col("date")).otherwise("").alias("publish_date"), F.col("action").alias("doc_type"),
        "agency", "province", "topic", F.col("topic_c").alias("topic_corroborated"),
        F.create_map(F.lit("stage"), F.when(k % 2 == 0, "open").otherwise("")).alias("extracted"),
    )
    index = rec.select("year", "month", F.regexp_replace(file, "[.]pdf$", "").alias("doc_id"), (k * 10).alias("offset"), (k % 3).alias("length"))
    for name, layer in (("meta", meta), ("taxonomy", labels), ("textindex", index)):
        layer.repartition("year", "month").write.partitionBy("year", "month").json(f"{root}/{name}")
    return root


@query(f"""
, a AS (SELECT *, year || '-' || lpad(id::VARCHAR, 8, '0') AS rid, CASE WHEN id % 10 = 0 THEN id + 1 ELSE id END AS num FROM rec),
m AS (SELECT *, count(*) OVER (PARTITION BY num) AS claims, count(*) FILTER (num = id AND num > 0) OVER (PARTITION BY num) AS own FROM a WHERE id % 9 > 0)
SELECT a.rid AS id, a.month, CASE WHEN m.rid IS NULL THEN '{text.NO_TITLE}' ELSE a.title END AS title,
  CASE WHEN a.id % 4 > 0 THEN a.date WHEN m.rid IS NOT NULL THEN m.date END AS date, coalesce(CASE WHEN m.rid IS NOT NULL THEN nullif(a.volume, 0) END, a.volume + 100)::INT AS volume,
  CASE WHEN m.rid IS NOT NULL THEN a.page || ' ง' ELSE a.part END AS part, m.page::INT AS page, a.topic_c, CASE WHEN a.id % 2 = 0 THEN 'open' END AS stage,
  CASE WHEN a.id % 3 > 0 THEN a.id * 10 END AS "offset", coalesce(m.claims > 1 AND (m.own <> 1 OR m.num <> m.id), false) AS withheld
FROM a LEFT JOIN m ON a.rid = m.rid
""")
def layers_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Layers in JSON lines, joined into records: metadata and positions where they are, links settled."""
    path = _write_layers(spark, d)
    rows = jsonl.load(spark, path)
    return rows.select(
        "id", "month", "title", "date", "volume", "part", "page", "topic_c", F.try_element_at("extracted", F.lit("stage")).alias("stage"), F.col("text_at.offset").alias("offset"), "withheld"
    )


@query("""
, a AS (SELECT DISTINCT year FROM rec), b AS (SELECT DISTINCT strftime(l_shipdate, '%Y') AS year FROM lineitem)
SELECT year, true AS complete FROM a JOIN b USING (year) UNION ALL SELECT year, false FROM b WHERE year NOT IN (SELECT year FROM a) UNION ALL SELECT year, false FROM a WHERE year NOT IN (SELECT year FROM b)
""")
def layer_years(spark: SparkSession, d: str) -> DataFrame:
    """Years that both layers have, and those that one lacks."""
    a = _rec(spark, d).select("year")
    b = tables.table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("year"))
    whole = jsonl.years(a, b).withColumn("complete", F.lit(True))
    return whole.unionByName(lookup.differing_keys(a, b, "year").select("year", F.lit(False).alias("complete")))


@query("SELECT id, year, title FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY id) AS k FROM rec) WHERE k <= 20")
def smoke_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty records of each year by ingest."""
    return jsonl.limited(_rec(spark, d).withColumn("ingest_ord", F.col("id")), 20).select("id", "year", "title")


@query("SELECT id, month, CASE WHEN id % 2 = 0 THEN d.text END AS text FROM rec LEFT JOIN documents d ON d.doc_id = rec.id AND id % 2 = 0")
def records_with_text(spark: SparkSession, d: str) -> DataFrame:
    """Records with the text of their number, where the text layer has it under the same month."""
    rec = _rec(spark, d).select("id", "month")
    month = F.when(F.col("id") % 2 == 0, F.col("month")).otherwise("none")
    layer = tables.table(spark, d, "documents").join(rec, F.col("doc_id") == F.col("id")).select(month.alias("month"), "doc_id", "text")
    return jsonl.with_text(rec, layer)


@query("""
SELECT slug, name, parent FROM topics
""")
def taxonomy_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The topic tree written as one document and loaded back."""
    entry = F.struct("slug", F.struct(F.when(F.col("name") != F.col("slug"), F.col("name")).alias("thai"), "parent").alias("t"))
    doc = tables.topics(spark, d).agg(F.map_from_entries(F.collect_list(entry)).alias("topics"))  # the tree, which is small
    path = new_folder(spark, "taxonomy")
    doc.coalesce(1).write.json(path)
    return jsonl.taxonomy(spark, path)[0]


# ---- sinks


@query("SELECT year::INT AS year, month, count(*)::BIGINT AS n, min(id) AS first, max(date) AS last FROM rec GROUP BY ALL")
def months_written(spark: SparkSession, d: str) -> DataFrame:
    """Records written by year and month and read back, a folder a month."""
    path = new_folder(spark, "months")
    publish.write_months(_rec(spark, d).select("id", "year", "month", "date", "title"), path)
    back = versions.read_table(spark, path).withColumn("year", F.col("year").cast("int"))
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("date").alias("last"))


@query("SELECT id::VARCHAR AS id, coalesce(t.name, topic) AS topic, CASE action WHEN '1-URGENT' THEN 'urgent, now' ELSE action END AS action, 'https://example.org/doc/' || id AS link FROM rec LEFT JOIN topics t ON t.slug = topic")
def csv_written(spark: SparkSession, d: str) -> DataFrame:
    """Quoted CSV with names for codes and a link, written and read back."""
    path = new_folder(spark, "csv")
    actions = tables.table(spark, d, "orders").select(F.col("o_orderpriority").alias("slug")).distinct().where("slug = '1-URGENT'").withColumn("name", F.lit("urgent, now"))
    listed = publish.for_csv(_rec(spark, d).select("id", "topic", "action"), {"topic": tables.topics(spark, d), "action": actions}, "https://example.org")
    publish.write_csv(listed, path)
    return spark.read.schema("id string, topic string, action string, link string").option("header", True).option("escape", '"').csv(path)


@query("""
WITH old AS (SELECT source AS id, count(*)::BIGINT AS n FROM documents GROUP BY 1), new AS (SELECT source AS id, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)
""", base=False)
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A registry of sources in which those with a labelled bad document have new rows."""
    docs, labels = tables.table(spark, d, "documents"), tables.table(spark, d, "labels").where("quality = 0")
    counts = lambda df: df.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return publish.upsert(counts(docs), counts(docs.join(labels, "doc_id")))


@query("""
, e AS (SELECT 'series/' || part AS feed_id, id, date, row_number() OVER (PARTITION BY part ORDER BY date DESC, id DESC) AS rank,
  'เล่ม ' || volume || ' ตอนที่ ' || part || CASE WHEN page <> 0 THEN ' หน้า ' || page ELSE '' END || ' · ' || title AS entry FROM rec)
SELECT feed_id, '<feed>' || string_agg('<entry><id>' || id || '</id><title>' || replace(replace(replace(entry, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><updated>' || date || '</updated></entry>', '' ORDER BY rank) || '</feed>' AS xml
FROM e WHERE rank <= 50 GROUP BY feed_id
""")
def feed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each series' newest fifty entries as one text."""
    rows = _rec(spark, d).withColumn("feed_id", F.concat(F.lit("series/"), "part"))
    return publish.feed_xml(publish.feed_entries(rows))


# ---- look-ups


@query("""
, c AS (SELECT o_orderkey AS cite, (year(o_orderdate) - 1994)::INT AS volume, o_orderpriority AS part, CASE WHEN o_orderkey % 11 <> 0 THEN ((o_orderkey * 7) % 520)::INT END AS page FROM orders),
j AS (SELECT cite, r.id, r.page AS pg, r.date, c.page FROM c JOIN rec r ON r.volume = c.volume AND r.part = c.part)
SELECT cite, coalesce(arg_max(id, (pg, date, id)) FILTER (page IS NOT NULL AND pg <= page), arg_min(id, (pg, date, id))) AS id FROM j GROUP BY cite
""")
def citations_toggled(spark: SparkSession, d: str) -> DataFrame:
    """Citations that leave the special marker out, of which every other volume has it on all its parts."""
    k = F.col("o_orderkey")
    cites = tables.table(spark, d, "orders").select(k.alias("cite"), (F.year("o_orderdate") - 1994).alias("volume"), F.col("o_orderpriority").alias("part"), F.when(k % 11 != 0, (k * 7) % 520).cast("int").alias("page"))
    special = F.when(F.col("volume") % 2 == 1, F.concat("part", F.lit(f" {text.SPECIAL}"))).otherwise(F.col("part"))
    return lookup.resolve(cites, _rec(spark, d).withColumn("part", special))


# ---- checks


@query("""
SELECT 'columns' AS "check", 'documents.title' AS key, 'present' AS expected, 'missing' AS actual FROM (SELECT count(*) FROM documents)
UNION ALL SELECT 'contract', source, '1', n::VARCHAR FROM (SELECT source, (count(*) % 2)::INT AS n FROM documents GROUP BY 1) WHERE n <> 1
UNION ALL SELECT 'credit', source, 'a source', NULL FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) WHERE n % 5 = 0
UNION ALL SELECT 'budget', lang, CASE WHEN lang = 'de' THEN 'no such output' ELSE '100' END, n::VARCHAR FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1) WHERE lang = 'de' OR n > 100
""", base=False)
def output_checks(spark: SparkSession, d: str) -> DataFrame:
    """Columns that outputs need, contract version and credit of each source, and sizes against budgets."""
    docs = tables.table(spark, d, "documents")
    per = docs.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    meta = per.select("name", (F.col("n") % 2).cast("int").alias("contract"), F.when(F.col("n") % 5 > 0, "credited").alias("credit"))
    sizes = docs.where("lang IS NOT NULL").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    budget = sizes.where("name <> 'de'").select("name", F.lit(100).alias("most"))
    return quality.together(quality.columns_present(docs, ["doc_id", "title"], "documents"), quality.contract(meta), quality.within_budget(sizes, budget))


@query("""
, f AS (SELECT *, year || '-' || substring(month, 6, 2) || '-' || lpad((id % 35)::VARCHAR, 2, '0') AS raw, CASE WHEN id % 50 = 0 THEN volume + 3 ELSE volume END AS v FROM rec),
o AS (SELECT id, date, lag((coalesce(date, ''), id)) OVER (PARTITION BY month ORDER BY id) AS b FROM rec),
s AS (SELECT agency AS key, count(DISTINCT year) AS n FROM rec WHERE agency IS NOT NULL GROUP BY 1), ny AS (SELECT count(DISTINCT year) AS n FROM rec),
dm AS (SELECT month, count(*) AS have, count(*) FILTER (id % 97 <> 0) AS n FROM rec GROUP BY month),
dd AS (SELECT month, n, have, (sum(have) OVER (ORDER BY month) - have)::BIGINT AS start FROM dm), dl AS (SELECT *, coalesce(lag(start + n) OVER (ORDER BY month), 0)::BIGINT AS want FROM dd)
SELECT 'date' AS "check", id::VARCHAR AS key, 'a date' AS expected, raw AS actual FROM f WHERE try_cast(raw AS DATE) IS NULL
UNION ALL SELECT 'year', id::VARCHAR, (v + 1994)::VARCHAR, year FROM f WHERE abs(year::INT - v - 1994) > 1
UNION ALL SELECT 'order', id::VARCHAR, b[2]::VARCHAR, id::VARCHAR FROM o WHERE b > (coalesce(date, ''), id)
UNION ALL SELECT 'series', key, ny.n::VARCHAR, s.n::VARCHAR FROM s, ny WHERE s.n <> ny.n
UNION ALL SELECT 'start', month, want::VARCHAR, start::VARCHAR FROM dl WHERE start <> want
UNION ALL SELECT 'size', month, have::VARCHAR, n::VARCHAR FROM dl WHERE n <> have
""")
def checks_with_findings(spark: SparkSession, d: str) -> DataFrame:
    """Impossible dates, years off their volume, rows out of order, series with gaps, and a directory that leaves rows out."""
    rec = _rec(spark, d)
    raw = F.concat("year", F.lit("-"), F.substring("month", 6, 2), F.lit("-"), F.lpad((F.col("id") % 35).cast("string"), 2, "0"))
    off = rec.withColumn("volume", F.when(F.col("id") % 50 == 0, F.col("volume") + 3).otherwise(F.col("volume")))
    sparse = rec.where("agency IS NOT NULL").groupBy(F.col("agency").alias("key"), "year").agg(F.count(F.lit(1)).alias("n"))
    starts = encode.month_directory(rec).select("month", "start")
    sizes = rec.groupBy("month").agg(F.count_if(F.col("id") % 97 != 0).alias("n"))
    return quality.together(
        quality.dates_valid(rec.withColumn("date", raw)), quality.year_matches(off, 1994), quality.sorted_within(rec.withColumn("position", F.col("id"))),
        quality.series_complete(sparse, rec.select("year").distinct()), quality.directory_contiguous(starts.join(sizes, "month"), rec),
    )


@query("""
, a AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem), b AS (SELECT DISTINCT month FROM rec)
SELECT 'months' AS "check", coalesce(a.month, b.month) AS key, CASE WHEN b.month IS NULL THEN 'missing' ELSE 'there' END AS expected, CASE WHEN a.month IS NULL THEN 'missing' ELSE 'there' END AS actual
FROM a FULL JOIN b ON a.month = b.month WHERE a.month IS NULL OR b.month IS NULL
""")
def range_index_months(spark: SparkSession, d: str) -> DataFrame:
    """Months of an index by shipping against the months of the records."""
    lines = tables.table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return quality.same_months(lines, _rec(spark, d))


@query("SELECT year, 'link' AS \"column\", count(*)::BIGINT AS rows, count_if(id % 4 = 3)::BIGINT AS blank, round(count_if(id % 4 = 3) / count(*), 6) AS rate FROM rec GROUP BY year")
def link_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each year lack a link."""
    link = F.when(F.col("id") % 4 < 3, F.concat(F.lit("https://example.org/"), F.col("id").cast("string")))
    return quality.blank_rates(_rec(spark, d).withColumn("link", link), ["link"], ["year"])


_SHIPPED = ", sh AS (SELECT id, year, volume, date AS x, strftime(min(l_shipdate), '%Y-%m-%d') AS y FROM rec JOIN lineitem ON l_orderkey = id GROUP BY ALL)"


def _shipped(spark: SparkSession, d: str) -> DataFrame:
    first = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("shipped"))
    return _rec(spark, d).select("id", "volume", "date").join(first, "id")


@query(_SHIPPED + "SELECT date_diff('day', y::DATE, x::DATE)::INT AS days, count(*)::BIGINT AS n FROM sh WHERE x <> y GROUP BY 1")
def layers_differ(spark: SparkSession, d: str) -> DataFrame:
    """By how many days the records' date and that of their first line differ."""
    both = _shipped(spark, d)
    return quality.layers_differ(both.select("id", "date"), both.select("id", F.col("shipped").alias("date")), "id", "date")


@query(_SHIPPED + """
SELECT 'date' AS layer, count(*)::BIGINT AS n, count_if(abs(substring(x, 1, 4)::INT - volume - 1994) <= 0)::BIGINT AS holds FROM sh WHERE x <> y
UNION ALL SELECT 'shipped', count(*), count_if(abs(substring(y, 1, 4)::INT - volume - 1994) <= 0)::BIGINT FROM sh WHERE x <> y
""")
def layer_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """Which of the two dates the rule of volume and year supports."""
    return quality.rule_support(_shipped(spark, d), "volume", ["date", "shipped"], 1994, slack=0)


@query("""
WITH x AS (SELECT source AS file, doc_id, strlen(coalesce(text, '')) + (CASE WHEN doc_id % 40 = 0 THEN 1 ELSE 0 END) AS len, strlen(coalesce(text, '')) AS stated FROM documents WHERE strlen(coalesce(text, '')) > 0),
i AS (SELECT file, doc_id, (sum(len) OVER (PARTITION BY file ORDER BY doc_id) - len)::BIGINT AS off, stated FROM x),
l AS (SELECT *, coalesce(lag(off + stated) OVER (PARTITION BY file ORDER BY off, doc_id), 0)::BIGINT AS want FROM i)
SELECT 'offset' AS "check", file AS key, want::VARCHAR AS expected, off::VARCHAR AS actual FROM l WHERE off <> want
UNION ALL SELECT 'file_size', file, s.size::VARCHAR, e::VARCHAR FROM (SELECT file, max(off + stated)::BIGINT AS e FROM i GROUP BY file) JOIN (SELECT file, sum(len)::BIGINT AS size FROM x GROUP BY file) s USING (file) WHERE e <> s.size
""", base=False)
def bytes_of_files(spark: SparkSession, d: str) -> DataFrame:
    """A position index of documents by source, in which some lengths leave a byte out: gaps, and files that end later."""
    docs = tables.table(spark, d, "documents").select(F.col("source").alias("file"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    docs = docs.where("length > 0").withColumn("taken", F.col("length") + F.when(F.col("doc_id") % 40 == 0, 1).otherwise(0))
    index = with_running(docs, ["file"], "doc_id", "taken", "offset")
    return quality.bytes_accounted(index.select("file", "offset", "length"), sizes=docs.groupBy("file").agg(F.sum("taken").cast("long").alias("size")))


@query("SELECT volume, count(*)::BIGINT AS n, count_if(part = '1-URGENT')::BIGINT AS marked, round(count_if(part = '1-URGENT') / count(*), 6) AS share FROM rec GROUP BY volume")
def marker_shares(spark: SparkSession, d: str) -> DataFrame:
    return quality.marker_share(_rec(spark, d), "volume", F.col("part") == "1-URGENT")


@query("""
, c AS (SELECT id, volume, page AS number, date, CASE WHEN id % 3 > 0 THEN govlevel END AS cls FROM rec),
k AS (SELECT volume, number, date, min(cls) AS lo, max(cls) AS hi FROM c WHERE cls IS NOT NULL GROUP BY ALL)
SELECT id, cls, coalesce(cls, CASE WHEN lo = hi THEN lo END) AS decided FROM c LEFT JOIN k USING (volume, number, date)
""")
def decided_classes(spark: SparkSession, d: str) -> DataFrame:
    """Records without a class get the one class that has their date in the same volume and number."""
    rows = _rec(spark, d).select("id", "volume", F.col("page").alias("number"), "date", F.when(F.col("id") % 3 > 0, F.col("govlevel")).alias("cls"))
    return quality.decided_class(rows).select("id", "cls", "decided")


@query("SELECT year, count_if(regexp_matches(title, '(?i)order [0-9]*77 '))::BIGINT AS suspected, count(*)::BIGINT AS n FROM rec GROUP BY year")
def suspected_tests(spark: SparkSession, d: str) -> DataFrame:
    """Titles of a pattern, flagged and counted by year."""
    return quality.suspected_tests(_rec(spark, d), "(?i)order [0-9]*77 ").groupBy("year").agg(F.count_if("suspect").alias("suspected"), F.count(F.lit(1)).alias("n"))
