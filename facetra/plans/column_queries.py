"""Queries on column functions, filters over several fields, indexes and panels. Columns that the tables do not have are
derived from those that they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetra.functions import dates, text
from facetra.operators import crossfilter as cf
from facetra.operators import encode, facets, graph, hierarchy, trends
from facetra.plans import publish
from facetra.plans.facet_queries import topic_agency
from facetra.plans.registry import query
from facetra.sources import jsonl, tables
from facetra.specs import GAZETTE

_THAI = f"'0123456789', '{text.THAI_DIGITS}'"
_LONG_MONTHS = "['" + "', '".join(dates.MONTHS) + "']"
_LONG_DATE = f"(day(date::DATE) || ' ' || {_LONG_MONTHS}[month(date::DATE)] || ' ' || (year(date::DATE) + 543))"


def _rec(spark: SparkSession, d: str) -> DataFrame:
    return tables.records(spark, d)


def _id(k: int) -> Column:
    return F.col("id") % k


def _case(k: int, *values) -> Column:
    """The value at place id % k."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), _id(k).cast("int"))


@query(f"""
SELECT id, CASE WHEN id % 6 = 0 THEN '{text.NO_TITLE}' ELSE title END AS clean,
  CASE WHEN id % 6 > 0 THEN title WHEN id % 12 = 0 THEN '{text.UNTITLED}' ELSE action || ' · ' || agency END AS shown, id % 6 = 0 AS missing,
  CASE WHEN id % 6 = 0 THEN '_' ELSE substring(regexp_replace(title, '[^A-Za-z0-9_-]+', '_', 'g'), 1, 80) END AS safe, id % 3 <> 2 AS ok
FROM rec
""")
def titles_and_names(spark: SparkSession, d: str) -> DataFrame:
    """Titles cleaned of spread and missing white space, what is shown for them, safe names and the shape of ids."""
    raw = F.when(_id(6) > 0, F.concat(F.lit(" \t"), F.replace(F.col("title"), F.lit(" "), F.lit(" \n  ")), F.lit(" "))).otherwise(" \n")
    kept = F.when(_id(12) > 0, F.lit(True))
    shown = text.display_title(F.when(_id(6) > 0, F.col("title")), F.when(kept, F.col("action")), F.when(kept, F.col("agency")))
    k = F.col("id").cast("string")
    shape = _case(3, F.concat("year", F.lit("-"), F.lpad(k, 6, "0")), F.concat("date", F.lit("-"), F.lpad(k, 8, "0")), F.concat("year", F.lit("/"), k))
    rows = _rec(spark, d).withColumn("shown", shown)
    return rows.select(
        "id", text.clean_title(raw).alias("clean"), "shown.text", "shown.missing", text.safe_name(F.when(_id(6) > 0, F.col("title")).otherwise(" ")).alias("safe"), text.id_ok(shape).alias("ok")
    ).withColumnRenamed("text", "shown")


@query(f"""
, c AS (SELECT *, CASE WHEN id % 4 > 0 THEN translate(page::VARCHAR, {_THAI}) END AS sec, ['ก', 'ข', NULL, NULL, 'ง'][id % 5 + 1] AS letter, id % 5 IN (1, 2) AS special FROM rec)
SELECT id, letter, CASE WHEN sec IS NOT NULL OR letter IS NOT NULL THEN concat_ws(' ', sec, letter, CASE WHEN special THEN 'พิเศษ' END) END AS part,
  CASE WHEN id % 7 > 0 THEN page END AS number, coalesce(nullif(volume * (id % 2), 0), nullif(page, 0))::INT AS volume, CASE WHEN id % 3 = 0 THEN 'none' ELSE date END AS dated,
  CASE WHEN govlevel = 'F' THEN 'final' ELSE govlevel END AS level
FROM c
""")
def composed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts from section and category, numbers in Thai digits, the first layer that states a value, and names of codes."""
    page, category = text.thai_digits(F.col("page")), _case(5, "ก", "ข พิเศษ", "พิเศษ", "", "ง")
    return _rec(spark, d).select(
        "id", text.series_letter(category).alias("letter"), text.compose_part(F.when(_id(4) > 0, page).otherwise(" "), category).alias("part"),
        text.to_int(F.when(_id(7) > 0, F.concat(F.lit(" "), page)).otherwise("x1")).alias("number"),
        text.first_number((F.col("volume") * _id(2)).cast("int"), F.col("page")).alias("volume"), text.first_text(F.when(_id(3) == 0, "").otherwise(F.col("date")), F.lit("none")).alias("dated"),
        text.named(F.col("govlevel"), {"F": "final"}).alias("level"),
    )


@query(f"""
, p AS (SELECT *, CASE WHEN id % 4 > 0 THEN page / 5 END AS pct FROM rec)
SELECT id, CASE WHEN id % 9 = 0 THEN '—' ELSE {_LONG_DATE} END AS dated, year::INT + 543 AS y, (year::INT + 543) || substring(month, 5, 3) AS m,
  CASE WHEN id % 3 = 0 THEN (year::INT + 543)::VARCHAR ELSE (year::INT + 543) || '–' || (year::INT + id % 3 + 543) END AS span,
  CASE WHEN pct IS NULL THEN '—' WHEN pct > 99 AND pct < 100 THEN printf('%.1f%%', pct) ELSE printf('%.0f%%', pct) END AS share,
  date_diff('day', date::DATE, DATE '1998-08-02') >= 3 AS stale
FROM p
""")
def era_labels(spark: SparkSession, d: str) -> DataFrame:
    """Long dates, years, months and spans of the era, percentages and staleness."""
    bad = F.when(_id(9) == 0, F.concat("year", F.lit("-13-01"))).otherwise(F.col("date"))
    later = (F.col("year").cast("int") + _id(3)).cast("string")
    return _rec(spark, d).select(
        "id", dates.era_date(bad).alias("dated"), dates.era_year(F.col("year")).alias("y"), dates.era_month(F.col("month")).alias("m"), dates.era_range(F.col("year"), later).alias("span"),
        dates.percent(F.col("page"), F.when(_id(4) > 0, 500).otherwise(0)).alias("share"), dates.stale(F.col("date").cast("date"), F.lit("1998-08-02").cast("date")).alias("stale"),
    )


@query(f"""
, c AS (SELECT *, CASE WHEN volume <> 0 THEN 'เล่ม ' || volume || ' ' ELSE '' END || 'ตอนที่ ' || part || CASE WHEN page <> 0 THEN ' หน้า ' || page ELSE '' END AS co, {_LONG_DATE} AS da FROM rec)
SELECT id, co AS coords, title || ', ราชกิจจานุเบกษา ' || co || ' (' || da || ').' AS standard,
  title || '. ราชกิจจานุเบกษา ' || translate(co, {_THAI}) || ' (' || translate(da, {_THAI}) || ').' AS footnote,
  title || '. (' || (year(date::DATE) + 543) || ', ' || day(date::DATE) || ' ' || {_LONG_MONTHS}[month(date::DATE)] || '). ราชกิจจานุเบกษา, ' ||
    CASE WHEN volume <> 0 THEN volume::VARCHAR ELSE '' END || '(ตอนที่ ' || part || ')' || CASE WHEN page <> 0 THEN ', ' || page ELSE '' END || '.' AS apa
FROM c
""")
def citation_styles(spark: SparkSession, d: str) -> DataFrame:
    """Every record cited in the four styles."""
    c = [F.col(x) for x in ("title", "volume", "part", "page", "date")]
    return _rec(spark, d).select("id", *[dates.citation(s, *c).alias(s) for s in ("coords", "standard", "footnote", "apa")])


@query("""
, c AS (SELECT *, ['ก', 'ข', 'ค', 'ง'][id % 4 + 1] AS letter, id % 4 IN (1, 2) AS special FROM rec)
SELECT id, CASE WHEN id % 10 < 9 THEN volume END AS volume, CASE WHEN id % 10 < 9 THEN page || ' ' || letter || CASE WHEN special THEN ' พิเศษ' ELSE '' END END AS part,
  CASE WHEN id % 10 < 9 AND id % 3 > 0 THEN (id % 90 + 1)::INT END AS page, CASE WHEN id % 10 < 9 THEN page || ' ' || letter || CASE WHEN special THEN '' ELSE ' พิเศษ' END END AS other
FROM c
""")
def short_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations in the short form, half of them in Thai digits and some broken, parsed; and the other part of each."""
    tail = F.when(_id(3) > 0, F.concat(F.lit(" /"), (_id(90) + 1).cast("string"))).otherwise("")
    s = F.concat(F.col("volume").cast("string"), F.lit("/ "), F.col("page").cast("string"), _case(4, "ก", " ข พิเศษ", "คพ", " ง"), tail)
    s = F.when(_id(10) == 9, F.concat(s, F.lit(" x"))).when(_id(2) == 1, text.thai_digits(s)).otherwise(s)
    return _rec(spark, d).select("id", text.parse_citation(s).alias("c")).select("id", "c.volume", "c.part", "c.page", text.other_part(F.col("c.part")).alias("other"))


@query(f"""
SELECT id, CASE WHEN id % 4 = 0 AND id > 0 THEN 'https://{text.HOST}/documents/' || id || '.pdf' WHEN id % 4 = 1 THEN 'https://{text.HOST}/files/' || id
    WHEN id % 8 <> 3 THEN 'https://{text.HOST}/documents/' || id || '.pdf' END AS link,
  CASE WHEN id % 5 = 0 THEN false WHEN year < '1995' THEN false WHEN id % 3 = 0 THEN true ELSE year NOT IN ('1996', '1997') END AS has_text
FROM rec
""")
def links_and_texts(spark: SparkSession, d: str) -> DataFrame:
    """The best link of each record, stated or derived, and whether a text may be there."""
    k = F.col("id").cast("string")
    number, raw = F.when(_id(4) == 0, F.col("id")), _case(4, None, F.concat(F.lit(f"https://{text.HOST}/files/"), k), F.concat(F.lit("http://other.example.org/"), k), None)
    own = F.when(_id(8) == 3, F.concat(F.lit("old-"), k)).otherwise(F.concat("date", F.lit("-"), F.lpad(k, 8, "0")))
    stated = _case(5, False, True, None, None, None)
    return _rec(spark, d).select(
        "id", text.document_link(own, number, raw).alias("link"), text.has_full_text(stated, F.col("month"), F.when(_id(3) == 0, F.col("page")), ["1996", "1997"], "1995").alias("has_text")
    )


@query("SELECT id, agency <> '' AND id % 4 < 3 AND id % 8 <> 6 AS same FROM rec")
def same_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Issuers under other names: with leading words, spaces and additions; another issuer, and none."""
    a = F.col("agency")
    spaced = F.concat(F.substring("agency", 1, 4), F.lit(" "), F.expr("substring(agency, 5)"))
    left = _case(4, F.concat(F.lit("ของ"), a), F.concat(F.lit("พนักงานเจ้าหน้าที่ "), spaced), F.concat(a, F.lit(" สาขา")), F.lit("อื่น"))
    return _rec(spark, d).select("id", text.same_body(F.when(_id(8) == 6, " ").otherwise(left), F.when(_id(2) == 1, F.concat(F.lit("ของ"), a)).otherwise(a)).alias("same"))


@query("""
SELECT id, (instr(title, 'Customer#') - 1)::INT AS start, (instr(title, 'Customer#') + 8)::INT AS "end", 1 AS found,
  ((length(replace(title, ' ', '')) - length(replace(replace(title, ' ', ''), '00', ''))) // 2)::INT AS twins
FROM rec
""")
def title_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where a text stands in each title, white space ignored, and how often another does."""
    rows = _rec(spark, d).select("id", text.match_spans(F.col("title"), F.lit("Cust omer#")).alias("s"), text.match_spans(F.col("title"), F.lit("0 0")).alias("t"))
    return rows.select("id", F.col("s")[0]["start"].alias("start"), F.col("s")[0]["end"].alias("end"), F.size("s").alias("found"), F.size("t").alias("twins"))


@query(r"""
WITH p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, E' \t\n\r\f\x0b')), lambda x: x <> '') AS ps FROM documents),
s AS (
  SELECT doc_id, text, list_reduce(ps, lambda a, p: CASE
    WHEN a.done THEN a
    WHEN length(p) <= 400 - a.used THEN {'shown': list_append(a.shown, p), 'used': a.used + length(p), 'done': false}
    WHEN 400 - a.used > 50 THEN {'shown': list_append(a.shown,
      CASE WHEN length(regexp_extract(p[1:401 - a.used], '(?s)^(.*)\n', 1)) > 50 THEN p[1:length(regexp_extract(p[1:401 - a.used], '(?s)^(.*)\n', 1))] ELSE p[1:400 - a.used] END),
      'used': a.used, 'done': true}
    ELSE {'shown': a.shown, 'used': a.used, 'done': true} END, {'shown': []::VARCHAR[], 'used': 0::BIGINT, 'done': false}).shown AS shown FROM p)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(shown, chr(10) || chr(10)) END AS shown, len(shown)::INT AS n FROM s
""", base=False)
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    """Each document's paragraphs within a budget of 400 characters."""
    shown = text.preview(text.paragraphs(F.col("text")), 400, 50)
    return tables.table(spark, d, "documents").select("doc_id", F.array_join(shown, "\n\n").alias("shown"), F.size(shown).alias("n"))


@query("SELECT 'e' || event_id AS key, event_type FROM events", base=False)
def line_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of JSON lines, without parsing the rest of the line."""
    line = F.to_json(F.struct("ts", F.struct("props").alias("inner"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("doc_id")))
    return tables.table(spark, d, "events").select(line.alias("line"), "event_type").select(jsonl.line_key(F.col("line")).alias("key"), "event_type")


@query("""
SELECT id, date, title, CASE WHEN id % 3 > 0 THEN province END AS province, CASE WHEN topic_c THEN true END AS topic_c, nullif(topic, '') AS topic FROM rec
""")
def slim_records(spark: SparkSession, d: str) -> DataFrame:
    """Records with few columns, of which those that state nothing are null."""
    rows = _rec(spark, d).withColumn("province", F.when(_id(3) > 0, F.col("province")).otherwise(""))
    return publish.slim(rows, ["id", "date", "title"], ["province", "topic_c", "topic"])


# ---- filters


@query("SELECT id, title FROM rec WHERE contains(replace(concat_ws(' ', title, id, agency, province, action), ' ', ''), 'NATION_33-M')")
def any_field_search(spark: SparkSession, d: str) -> DataFrame:
    """Records that hold a text in title, id, agency, province and type taken together, white space ignored."""
    f = cf.Filters(text="NATION_3 3-M", fields=("title", "id", "agency", "province", "action"))
    return cf.matching(_rec(spark, d), f).select("id", "title")


@query("SELECT 'action' AS filter, 0::BIGINT AS n UNION ALL SELECT 'months', 0 UNION ALL SELECT 'topics', 0 UNION ALL SELECT 'day', count(*) FROM rec WHERE date = '1997-05-28'")
def unknown_values(spark: SparkSession, d: str) -> DataFrame:
    """Filters by a value that does not occur, and by empty lists, match nothing; a single day matches itself."""
    rec, by = _rec(spark, d), {"action": cf.Filters(equal={"action": "9-NONE"}), "months": cf.Filters(months=()), "topics": cf.Filters(topics=()), "day": cf.Filters(day="1997-05-28")}
    flags = rec.select(*[next(iter(f.predicates().values())).alias(k) for k, f in by.items()])
    one = flags.agg(*[F.count_if(k).alias(k) for k in by])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("filter"), F.col(k).alias("n")) for k in by])))


@query("SELECT 'series/' || part AS feed_id, count(*)::BIGINT AS n FROM rec WHERE contains(replace('series/' || part, ' ', ''), 'NOTSPEC') GROUP BY 1")
def feeds_by_name(spark: SparkSession, d: str) -> DataFrame:
    counts = _rec(spark, d).groupBy(F.concat(F.lit("series/"), "part").alias("feed_id")).agg(F.count(F.lit(1)).alias("n"))
    return publish.named_like(counts, "feed_id", "NOT SPEC")


# ---- indexes, panels and series


@query("SELECT province, regexp_replace(province, '[^A-Za-z0-9_-]+', '_', 'g') AS file, count(*)::BIGINT AS n FROM rec WHERE province IS NOT NULL GROUP BY province")
def province_index(spark: SparkSession, d: str) -> DataFrame:
    return publish.province_index(_rec(spark, d))


@query("""
, c AS (SELECT ancestor AS slug, count(*)::BIGINT AS n FROM rec JOIN clo ON topic = descendant WHERE topic_c GROUP BY 1)
SELECT t.slug, name, parent, coalesce(n, 0)::BIGINT AS n FROM topics t LEFT JOIN c ON t.slug = c.slug
""")
def topic_index(spark: SparkSession, d: str) -> DataFrame:
    """Every topic with its records, those without any too."""
    leaf = _rec(spark, d).where("topic_c").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    found = hierarchy.tree_counts(tables.topics(spark, d), hierarchy.roll_up(leaf, tables.topic_closure(spark, d)))
    return found.select("slug", "name", "parent", "n").orderBy(F.desc("n"), "slug")


@query("""
, f AS (SELECT 'topic' AS dim, ancestor AS value, count(*)::BIGINT AS n FROM rec JOIN clo ON topic = descendant JOIN topics t ON t.slug = ancestor AND t.parent IS NULL WHERE topic_c GROUP BY ALL
  UNION ALL SELECT 'action', action, count(*) FROM rec WHERE action_c GROUP BY ALL UNION ALL SELECT 'govlevel', govlevel, count(*) FROM rec WHERE govlevel_c GROUP BY ALL
  UNION ALL SELECT 'agency', agency, count(*) FROM rec WHERE agency IS NOT NULL GROUP BY ALL UNION ALL SELECT 'province', province, count(*) FROM rec WHERE province IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT dim, value, n, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value)::INT AS rank FROM f) WHERE rank <= 8
""")
def dashboard_panels(spark: SparkSession, d: str) -> DataFrame:
    """The eight largest values of each panel; root topics, which include what is below them."""
    counts = facets.facet_counts(_rec(spark, d), dims=(GAZETTE.topic, *GAZETTE.facets)).where("dim <> 'total'")
    leaf = counts.where("dim = 'topic'").select(F.col("value").alias("topic"), "n")
    up = hierarchy.roll_up(leaf, tables.topic_closure(spark, d)).select(F.lit("topic").alias("dim"), F.col("topic").alias("value"), "n")
    roots = tables.topics(spark, d).where("parent IS NULL").select("slug")
    return facets.panels(counts.where("dim <> 'topic'").unionByName(up), roots)


@query("""
, y AS (SELECT DISTINCT year FROM rec), k AS (SELECT 'govlevel' AS dim, govlevel AS key, year, count(*)::BIGINT AS n FROM rec WHERE govlevel_c GROUP BY ALL
  UNION ALL SELECT 'topic', topic, year, count(*) FROM rec WHERE topic_c GROUP BY ALL)
SELECT dim, key, year, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT dim, key FROM k) CROSS JOIN y LEFT JOIN k USING (dim, key, year)
""")
def yearly_series_more(spark: SparkSession, d: str) -> DataFrame:
    """Series of levels and of leaf topics, zero-filled."""
    rec = _rec(spark, d)
    of = lambda k: trends.series(rec, GAZETTE.dim(k)).withColumn("dim", F.lit(k))
    return of("govlevel").unionByName(of("topic")).select("dim", "key", "year", "n")


@query("SELECT bucket, sum(n)::BIGINT AS n, width FROM (SELECT substring(date, 1, w.width) AS bucket, 1 AS n, w.width FROM rec, (SELECT unnest([4, 10]) AS width) w) GROUP BY ALL")
def bucket_years_and_days(spark: SparkSession, d: str) -> DataFrame:
    daily = _rec(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    of = lambda w: cf.bucketed(daily, "date", w).withColumn("width", F.lit(w))
    return of(4).unionByName(of(10))


_EDGES_ALL = """
, el AS (SELECT DISTINCT id, slug FROM lab WHERE corroborated OR weight >= 0.7),
pr AS (SELECT x.slug AS a, y.slug AS b, count(*)::BIGINT AS n FROM el x JOIN el y ON x.id = y.id AND x.slug < y.slug GROUP BY ALL),
kn AS (SELECT DISTINCT agency FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, agency) AS r FROM ta) WHERE r <= 6)
SELECT * FROM (SELECT 'agency' AS kind, topic AS a, agency AS b, n FROM ta WHERE agency IN (SELECT agency FROM kn) ORDER BY n DESC, topic, agency LIMIT 1500)
UNION ALL SELECT * FROM (SELECT 'topic', a, b, n FROM pr ORDER BY n DESC, a, b LIMIT 400)
"""


@query(_EDGES_ALL)
def graph_edges_all(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the whole archive's graph."""
    return graph.edges(topic_agency(spark, d), graph.label_pairs(_rec(spark, d).select("slugs")))


# ---- positions


@query("SELECT id, month, row_number() OVER (PARTITION BY month ORDER BY coalesce(date, ''), id) - 1 AS \"offset\" FROM rec")
def months_of_positions(spark: SparkSession, d: str) -> DataFrame:
    """Each position taken back to its month and its place there."""
    rec = _rec(spark, d).select("id", "month", "date")
    found = encode.positions(rec).select("id", "position")
    return encode.months_of_positions(found, encode.month_directory(rec)).select("id", "month", "offset")


@query("SELECT d.dim, count(*)::BIGINT AS compared, CASE d.dim WHEN 'govlevel' THEN count_if(id % 11 = 0) ELSE 0 END::BIGINT AS differing FROM rec, (SELECT unnest(['agency_type', 'province', 'action', 'govlevel']) AS dim) d GROUP BY d.dim")
def position_agreement(spark: SparkSession, d: str) -> DataFrame:
    """An index of codes by position, decoded and held against the records on every dimension; in one, each eleventh code is
    taken from another record's value, which the comparison must find."""
    dims = ["agency_type", "province", "action", "govlevel"]
    rec = encode.positions(_rec(spark, d).select("id", "month", "date", *dims)).select("id", "position", *dims)
    index = rec.withColumn("govlevel", F.when(_id(11) == 0, F.when(F.col("govlevel") == "F", "O").otherwise("F")).otherwise(F.col("govlevel")))
    for c in dims:
        codes = encode.dictionary(index, c)
        index = encode.encoded(index, c, codes).drop(c)
        values = codes.select(F.col("code").alias(f"{c}_code"), F.col("value").alias(c))
        index = index.join(values, f"{c}_code", "left")
    return encode.agreement(index.select("position", *dims), rec, dims)
