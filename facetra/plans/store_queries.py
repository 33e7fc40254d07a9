"""Queries on sinks and sources as a whole: versioned tables, late months, feed files, sources under one contract, look-ups by
id, and counts from a cuboid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetra.operators import crossfilter as cf
from facetra.operators import cuboid, facets, hierarchy, lookup, trends
from facetra.plans import feed_files, publish, versions
from facetra.plans.check_queries import _write_layers
from facetra.plans.registry import query
from facetra.sources import contract, jsonl, tables
from facetra.specs import GAZETTE
from facetra.storage import new_folder


def _rec(spark: SparkSession, d: str) -> DataFrame:
    return tables.records(spark, d)


# ---- versioned tables

#: Months that are published again, after their late records have come.
LATE = ("1996-11", "1997-03")


@query(f"""
SELECT year, month, count(*)::BIGINT AS n, min(id) AS first, max(date) AS last, count_if(month IN {LATE})::BIGINT AS late,
  md5(string_agg(id::VARCHAR || ' ' || title, ',' ORDER BY date, id)) AS rows FROM rec GROUP BY ALL
""")
def months_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Records published by month while some had not come, two months then replaced alone, and read back as one table."""
    rec, path = _rec(spark, d).select("id", "year", "month", "date", "title", F.col("month").isin(*LATE).alias("late")), new_folder(spark, "months")
    early = rec.where(~F.col("late") | (F.col("id") % 3 > 0)).withColumn("late", F.lit(False))
    publish.write_months(early, path, per_file=5000)
    publish.write_months(rec.where("late"), path, per_file=500, late=True)
    back = versions.read_table(spark, path)
    rows = F.array_sort(F.collect_list(F.struct("date", "id", "title")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(" ", r["id"], r["title"])), ",")
    return back.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("date").alias("last"), F.count_if("late").alias("late"), F.md5(text).alias("rows")
    )


@query("""
, n AS (SELECT province, count(*)::BIGINT AS n FROM rec WHERE year <= '1995' GROUP BY 1), m AS (SELECT province, count(*)::BIGINT AS n FROM rec GROUP BY 1)
SELECT 1 AS version, province, n FROM n UNION ALL SELECT 2, province, n FROM m
""")
def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table of counts published twice: the first version stays readable beside the second until it is vacuumed."""
    rec, path = _rec(spark, d), new_folder(spark, "versions")
    count = lambda df: df.groupBy("province").agg(F.count(F.lit(1)).alias("n"))
    first = versions.publish(count(rec.where("year <= '1995'")), path)
    publish.write_table(count(rec), path)
    old, new = versions.read_table(spark, path, first), versions.read_table(spark, path)
    return old.withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(2))).select("version", "province", "n")


_FEEDS = """
, f AS (SELECT 'all' AS feed_id, * FROM rec UNION ALL SELECT 'series/' || part, * FROM rec),
g AS (SELECT 'province/' || province AS feed_id, * FROM rec WHERE province IN (SELECT province FROM rec GROUP BY 1 HAVING count(*) >= 50)),
e AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY coalesce(date, '') DESC, id DESC) AS rank, 200 AS k FROM f
      UNION ALL SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY coalesce(date, '') DESC, id DESC), 50 FROM g),
x AS (SELECT feed_id, split_part(feed_id, '/', 1) AS kind, rank::INT AS rank, id::VARCHAR AS id, date,
  'เล่ม ' || volume || ' ตอนที่ ' || part || CASE WHEN page <> 0 THEN ' หน้า ' || page ELSE '' END || ' · ' || title AS entry FROM e WHERE rank <= k)
"""


@query(_FEEDS + "SELECT x.*, d.n AS listed FROM x JOIN (SELECT feed_id, count(*)::BIGINT AS n FROM x GROUP BY 1) d USING (feed_id)")
def feed_files_written(spark: SparkSession, d: str) -> DataFrame:
    """Every feed as a file of one folder, read back and joined with the directory, which lists no other and misses none."""
    feed_files.register(spark)
    entries, path = publish.feeds(_rec(spark, d), "part", ["province"]), new_folder(spark, "feeds")
    feed_files.feed_rows(entries).write.format("feed_files").mode("overwrite").save(path)
    directory = publish.feed_directory(entries, ["all", "series", "province"]).select("feed_id", F.col("n").alias("listed"))
    return spark.read.format("feed_files").load(path).join(directory, "feed_id", "full_outer")


@query(_FEEDS + "SELECT kind, feed_id, rank, id, date, entry FROM x WHERE kind = 'series'")
def feed_files_of_a_kind(spark: SparkSession, d: str) -> DataFrame:
    """Entries of one kind of feed, for which the other kinds' files are not opened."""
    feed_files.register(spark)
    path = new_folder(spark, "feeds")
    feed_files.feed_rows(publish.feeds(_rec(spark, d), "part", ["province"])).write.format("feed_files").mode("overwrite").save(path)
    return spark.read.format("feed_files").load(path).where("kind = 'series'")


# ---- sources


def _sources(spark: SparkSession, d: str) -> list[contract.Source]:
    layers = contract.JsonLayers(_write_layers(spark, d), "layers", {"title": "Records as layers", "name": "the table writer", "url": "https://example.org/layers"})
    return [layers, contract.StarTables(d, credit={"title": "Star tables"})]


@query("""
, a AS (SELECT count(*)::BIGINT AS docs, count(DISTINCT year)::BIGINT AS years, min(year) AS first_year, max(year) AS last_year, max(date) AS latest,
  max(date) FILTER (id % 4 > 0 OR id % 9 > 0) AS stated FROM rec)
SELECT 'layers' AS id, 'Records as layers' AS title, 'the table writer' AS credit, 'https://example.org/layers' AS url, docs, years, first_year, last_year, stated AS latest FROM a
UNION ALL SELECT 'star', 'Star tables', NULL, NULL, docs, years, first_year, last_year, latest FROM a
""")
def sources_listed(spark: SparkSession, d: str) -> DataFrame:
    """JSON layers and star tables under one contract, a row each."""
    return contract.listing(spark, _sources(spark, d))


@query("""
SELECT s AS source, year, month, count(*)::BIGINT AS n, count_if(topic_c)::BIGINT AS trusted FROM rec, (SELECT unnest(['layers', 'star']) AS s)
WHERE year IN ('1996', '1998') GROUP BY ALL
""")
def sources_of_years(spark: SparkSession, d: str) -> DataFrame:
    """Two years of both sources, asked for by a list."""
    rows = contract.together(spark, _sources(spark, d), "1996,1998")
    return rows.groupBy("source", "year", "month").agg(F.count(F.lit(1)).alias("n"), F.count_if("topic_c").alias("trusted"))


@query("""
SELECT doc_id::VARCHAR AS doc_id, length(text)::BIGINT AS n_chars, CASE WHEN doc_id % 3 = 0 THEN 'signer ' || doc_id END AS signatory, (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::INT AS signatories,
  CASE WHEN doc_id % 4 = 0 THEN 'ref ' || doc_id ELSE '' END AS reference_numbers
FROM documents WHERE text <> '' AND doc_id % 7 > 0
""", base=False)
def texts_loaded(spark: SparkSession, d: str) -> DataFrame:
    """A text layer written from the documents and loaded: rows without id or text are left out, and so are signatories that
    have neither a name nor a position."""
    docs, root, k = tables.table(spark, d, "documents"), new_folder(spark, "texts"), F.col("doc_id")
    signer = lambda name: F.struct(name.cast("string").alias("name"), F.lit("").alias("position"))
    named = F.array(signer(F.lit("")), signer(F.concat(F.lit("signer "), k.cast("string"))))
    layer = docs.select(
        F.lit("2024").alias("year"), F.lit("2024-01").alias("month"), F.when(k % 7 > 0, k.cast("string")).alias("doc_id"), "text",
        F.when(k % 3 == 0, named).otherwise(F.array(signer(F.lit("")))).alias("signatories"),
        F.when(k % 4 == 0, F.array(F.concat(F.lit("ref "), k.cast("string")))).alias("reference_numbers"),
    )
    layer.write.partitionBy("year", "month").json(f"{root}/text")
    return jsonl.texts(spark, root).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.get("signatories.name", F.lit(0)).alias("signatory"), F.size("signatories").alias("signatories"),
        F.coalesce(F.array_join("reference_numbers", ","), F.lit("")).alias("reference_numbers"),
    )


@query("SELECT id, year, title FROM rec WHERE year BETWEEN '1996' AND '1998' OR year = '2000'")
def years_chosen(spark: SparkSession, d: str) -> DataFrame:
    """Records of a range of years and one more, chosen by text."""
    rows = contract.StarTables(d).load(spark, "1996-1998,2000")
    return rows.select(F.col("id").cast("long").alias("id"), "year", "title")


# ---- look-ups by id

_IDS = """
, old AS (SELECT id, year, month, year || '-' || lpad(id::VARCHAR, 7, '0') AS text FROM rec),
g AS (SELECT year, month, min(text) AS lo, max(text) AS hi FROM old GROUP BY ALL),
asked AS (SELECT strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(o_orderkey::VARCHAR, 8, '0') AS q, 1 AS form, strftime(o_orderdate, '%Y') AS year FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT strftime(o_orderdate, '%Y') || '-' || lpad(o_orderkey::VARCHAR, 7, '0'), 2, strftime(o_orderdate, '%Y') FROM orders WHERE o_orderkey % 3 = 1
  UNION ALL SELECT strftime(o_orderdate, '%Y') || '-x' || o_orderkey, 3, strftime(o_orderdate, '%Y') FROM orders WHERE o_orderkey % 3 = 2
  UNION ALL SELECT '2050-' || lpad(c_custkey::VARCHAR, 7, '0'), 2, '2050' FROM customer)
"""


def _old_ids(spark: SparkSession, d: str) -> DataFrame:
    return _rec(spark, d).select("year", "month", F.concat_ws("-", "year", F.lpad(F.col("id").cast("string"), 7, "0")).alias("id"), "title")


def _asked_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that carry their month, ids of the ranges' form, and ids that no range holds."""
    k, year = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    modern = F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(k.cast("string"), 8, "0"))
    old, odd = F.concat_ws("-", year, F.lpad(k.cast("string"), 7, "0")), F.concat(year, F.lit("-x"), k.cast("string"))
    asked = tables.table(spark, d, "orders").select(F.when(k % 3 == 0, modern).when(k % 3 == 1, old).otherwise(odd).alias("q"))
    return asked.union(tables.table(spark, d, "customer").select(F.concat(F.lit("2050-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))))


@query(_IDS + """
, inside AS (SELECT q, g.month FROM asked JOIN g ON g.year = asked.year AND q BETWEEN lo AND hi WHERE form > 1)
SELECT q, q[1:7] AS month, 'carried' AS how FROM asked WHERE form = 1
UNION ALL SELECT q, month, 'range' FROM inside
UNION ALL SELECT q, g.month, 'year' FROM asked JOIN g USING (year) WHERE form > 1 AND q NOT IN (SELECT q FROM inside)
""")
def shards_of_ids(spark: SparkSession, d: str) -> DataFrame:
    """The months that may hold each id: from the id, from the ranges of its year, or all of its year."""
    return lookup.shards(_asked_ids(spark, d), lookup.id_ranges(_old_ids(spark, d)), "q")


@query(_IDS + "SELECT old.text AS id, old.month, 'Order ' || o_orderkey || ' ' || c_name AS title FROM old JOIN orders ON o_orderkey = old.id LEFT JOIN customer ON o_custkey = c_custkey WHERE old.text IN (SELECT q FROM asked)")
def records_of_ids(spark: SparkSession, d: str) -> DataFrame:
    """Records of ids, looked up by month. Some months' ranges are out of date, and their ids are found in the year's others."""
    rec = _old_ids(spark, d)
    stale = lookup.id_ranges(rec).withColumn("hi", F.when(F.substring("month", 6, 2) == "06", F.col("lo")).otherwise(F.col("hi")))
    return lookup.fetched(_asked_ids(spark, d), stale, rec.drop("year"), "q").select("id", "month", "title")


# ---- counts from a cuboid


@query("""
SELECT facet, value, count(*)::BIGINT AS n FROM (
  SELECT 'total' AS facet, '' AS value FROM rec WHERE action_c AND action = '2-HIGH' AND year = '1996'
  UNION ALL SELECT 'year', year FROM rec WHERE action_c AND action = '2-HIGH'
  UNION ALL SELECT 'month', month FROM rec WHERE action_c AND action = '2-HIGH' AND year = '1996'
  UNION ALL SELECT 'action', action FROM rec WHERE action_c AND year = '1996'
  UNION ALL SELECT 'govlevel', govlevel FROM rec WHERE govlevel_c AND action_c AND action = '2-HIGH' AND year = '1996'
  UNION ALL SELECT 'province', province FROM rec WHERE action_c AND action = '2-HIGH' AND year = '1996')
WHERE value IS NOT NULL GROUP BY ALL
""")
def crossfilter_from_cuboid(spark: SparkSession, d: str) -> DataFrame:
    """Five facets, each with its own filter lifted, from stored counts."""
    f, dims = cf.Filters(equal={"action": "2-HIGH", "year": "1996"}), ("year", "month", *tables.CUBE.dims)
    rows, spec, weight = cuboid.source(tables.CUBE, tables.cube(spark, d), _rec(spark, d), f, dims)
    return cf.cross_filter(rows, f, spec, dims, weight)


@query("SELECT province, action, count(*)::BIGINT AS n FROM rec WHERE govlevel_c AND govlevel = 'O' AND action_c AND action IS NOT NULL AND province IS NOT NULL GROUP BY ALL")
def groupby_from_cuboid(spark: SparkSession, d: str) -> DataFrame:
    f, by = cf.Filters(equal={"govlevel": "O"}), ["province", "action"]
    rows, spec, weight = cuboid.source(tables.CUBE, tables.cube(spark, d), _rec(spark, d), f, by)
    return cf.grouped(rows, f, by, spec, weight)


# ---- topics with what is below them


@query("""
, y AS (SELECT DISTINCT year FROM rec), k AS (SELECT DISTINCT ancestor AS key FROM rec JOIN clo ON topic = descendant WHERE topic_c),
c AS (SELECT ancestor AS key, year, count(*)::BIGINT AS n FROM rec JOIN clo ON topic = descendant WHERE topic_c GROUP BY ALL)
SELECT key, year, coalesce(n, 0)::BIGINT AS n FROM k CROSS JOIN y LEFT JOIN c USING (key, year)
""")
def topic_series(spark: SparkSession, d: str) -> DataFrame:
    """Records per topic and year, a topic with all below it, zero where there is none."""
    rec = _rec(spark, d)
    leaf = rec.where("topic_c").groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n"))
    rolled = hierarchy.roll_up(leaf, tables.topic_closure(spark, d), keys=["year"]).select(F.col("topic").alias("key"), "year", "n")
    return trends.dense(rolled, rec.select(F.col(GAZETTE.year).alias("year")).distinct())


# ---- highlights, or what is shown where there are none


_SHOWN = """
, d AS (SELECT *, action_c AND action IN ('1-URGENT', '2-HIGH') AND id % 7 = 0 AS rule, topic_c AND topic NOT LIKE 'ECONOMY%' AS other FROM rec),
r AS (SELECT date, id, rule, row_number() OVER (PARTITION BY date, rule ORDER BY govlevel <> 'F', page DESC, id) AS k FROM d WHERE rule),
o AS (SELECT date, id, false AS rule, row_number() OVER (PARTITION BY date ORDER BY govlevel <> 'F', page DESC, id) AS k FROM d WHERE other AND date NOT IN (SELECT date FROM r))
SELECT date, id, rule, k::INT AS rank FROM r WHERE k <= 12 UNION ALL SELECT date, id, rule, k::INT FROM o WHERE k <= 8
"""


@query(_SHOWN)
def stories_of_days(spark: SparkSession, d: str) -> DataFrame:
    """For each day its twelve first rules, and on days without any the eight first of its other trusted records."""
    rec = _rec(spark, d).withColumn("w", F.col("page").cast("double"))
    rule = F.col("action_c") & F.col("action").isin("1-URGENT", "2-HIGH") & (F.col("id") % 7 == 0)
    other = F.col("topic_c") & ~F.col("topic").startswith("ECONOMY")
    return facets.stories(rec, rule, other, F.col("govlevel") == "F", "w").select("date", "id", "rule", "rank")
