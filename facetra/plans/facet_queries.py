"""Queries on facets, newest lists, trees, cross-filters and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetra.functions.text import flags
from facetra.operators import crossfilter as cf
from facetra.operators import cuboid, encode, facets, hierarchy
from facetra.operators.facets import newest_order
from facetra.plans import publish
from facetra.plans.registry import query
from facetra.sources import tables
from facetra.specs import GAZETTE

DIMS = """
  SELECT unnest([{'dim': 'total', 'value': ''}, {'dim': 'year', 'value': year}, {'dim': 'month', 'value': month},
    {'dim': 'topic', 'value': CASE WHEN topic_c THEN topic END}, {'dim': 'action', 'value': CASE WHEN action_c THEN action END},
    {'dim': 'govlevel', 'value': CASE WHEN govlevel_c THEN govlevel END}, {'dim': 'agency', 'value': agency},
    {'dim': 'province', 'value': province}]) AS dv, *
  FROM rec
"""


def _rec(spark: SparkSession, d: str) -> DataFrame:
    return tables.records(spark, d)


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """Records without topics."""
    return tables.records(spark, d, with_topics=False)


def _closure(spark: SparkSession, d: str) -> DataFrame:
    return tables.topic_closure(spark, d)


def topic_agency(spark: SparkSession, d: str) -> DataFrame:
    """year, topic (rolled up), agency, n."""
    return hierarchy.roll_up(tables.leaf_agencies(spark, d), _closure(spark, d), keys=["year", "agency"]).select("year", "topic", "agency", "n")


@query("""
, up AS (SELECT ancestor AS topic, id, date FROM rec JOIN clo ON rec.topic = descendant WHERE topic_c),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY coalesce(date, '') DESC, id DESC)::INT AS rank,
             count(*) OVER (PARTITION BY topic)::BIGINT AS n FROM up)
SELECT topic, n, rank, id, date FROM r WHERE rank <= 3
""")
def flagship_topics(spark: SparkSession, d: str) -> DataFrame:
    """Trusted records per topic with ancestors, and each topic's newest three."""
    rec = _rec(spark, d).select("topic", "topic_c", "id", "date")
    leaf = rec.where("topic_c").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    n = hierarchy.roll_up(leaf, _closure(spark, d)).select(F.col("topic").alias("key"), "n")
    return facets.newest_with_ancestors(rec, _closure(spark, d), 3).join(n, "key").select(F.col("key").alias("topic"), "n", "rank", "id", "date")


@query(f"""
SELECT ancestor AS key, dv.dim AS dim, dv.value AS value, count(*)::BIGINT AS n
FROM ({DIMS}) x JOIN clo ON x.topic = descendant WHERE topic_c AND dv.value IS NOT NULL GROUP BY ALL
""")
def facet_topic(spark: SparkSession, d: str) -> DataFrame:
    return facets.topic_facets(_rec(spark, d), _closure(spark, d))


@query(f"SELECT agency AS key, dv.dim AS dim, dv.value AS value, count(*)::BIGINT AS n FROM ({DIMS}) WHERE agency IS NOT NULL AND dv.value IS NOT NULL GROUP BY ALL")
def facet_agency(spark: SparkSession, d: str) -> DataFrame:
    return facets.facet_counts(_rec(spark, d), "agency", many=True)


@query(f"SELECT province AS key, dv.dim AS dim, dv.value AS value, count(*)::BIGINT AS n FROM ({DIMS}) WHERE province IS NOT NULL AND dv.value IS NOT NULL GROUP BY ALL")
def facet_province(spark: SparkSession, d: str) -> DataFrame:
    return facets.facet_counts(_rec(spark, d), "province")


@query("SELECT agency, arg_max(agency_type, id) AS agency_type FROM rec WHERE agency IS NOT NULL GROUP BY agency")
def agency_last_type(spark: SparkSession, d: str) -> DataFrame:
    return facets.last_seen(_plain(spark, d), "agency", "agency_type")


@query("SELECT date, count(*)::BIGINT AS n FROM rec GROUP BY date")
def count_by_day(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(topic)::BIGINT AS labelled, count_if(topic_c OR action_c OR govlevel_c)::BIGINT AS corroborated_any, count(*)::BIGINT AS n FROM rec")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    trusted = F.col("topic_c") | F.col("action_c") | F.col("govlevel_c")
    return _rec(spark, d).agg(F.count("topic").alias("labelled"), F.count_if(trusted).alias("corroborated_any"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT court, stage, n, round(n / sum(n) OVER (PARTITION BY court IS NULL, stage IS NULL), 6) AS share FROM (
  SELECT coalesce(nullif(agency_type, 'HOUSEHOLD'), '?') AS court, action AS stage, count(*)::BIGINT AS n
  FROM rec WHERE action IS NOT NULL GROUP BY ROLLUP (court, stage))
""")
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Court by stage with sub-totals, and each count's share of its level."""
    court = F.coalesce(F.nullif("agency_type", F.lit("HOUSEHOLD")), F.lit("?")).alias("court")
    counts = _plain(spark, d).where("action IS NOT NULL").select(court, F.col("action").alias("stage")).rollup("court", "stage").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    level = Window.partitionBy(F.col("court").isNull(), F.col("stage").isNull())
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(level), 6))


@query("SELECT year, count_if(action = '1-URGENT' AND action_c)::BIGINT AS urgent, count_if(action = '2-HIGH' AND action_c)::BIGINT AS high, count_if(action = '3-MEDIUM' AND action_c)::BIGINT AS medium, count_if(govlevel = 'F' AND govlevel_c)::BIGINT AS level_f FROM rec GROUP BY year")
def action_year(spark: SparkSession, d: str) -> DataFrame:
    """Flagged actions and levels per year, one column each."""
    a, g = GAZETTE.dim("action"), GAZETTE.dim("govlevel")
    return _plain(spark, d).groupBy("year").agg(
        *[F.count_if(a.equals(v)).alias(n) for v, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"))], F.count_if(g.equals("F")).alias("level_f")
    )


@query("SELECT volume, part, string_agg(DISTINCT month, ',' ORDER BY month) AS months FROM rec GROUP BY volume, part")
def volume_parts(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d).groupBy("volume", "part").agg(F.array_join(F.array_sort(F.collect_set("month")), ",").alias("months"))


@query("SELECT topic, count(DISTINCT agency)::BIGINT AS n_distinct FROM ta GROUP BY topic")
def agencies_per_topic(spark: SparkSession, d: str) -> DataFrame:
    return facets.distinct_per(topic_agency(spark, d), "topic", "agency")


@query("SELECT part, count(*)::BIGINT AS n FROM rec WHERE date IS NOT NULL GROUP BY part")
def part_totals(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d).where("date IS NOT NULL").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT date, count(*)::BIGINT AS n, count(DISTINCT part)::BIGINT AS parts, arg_min(volume, id)::INT AS first_volume, count(DISTINCT province)::BIGINT AS provinces,
       count_if(action = '1-URGENT' AND action_c)::BIGINT AS urgent, count_if(govlevel = 'F' AND govlevel_c)::BIGINT AS final
FROM rec WHERE date = (SELECT max(date) FROM rec) GROUP BY date
""")
def newest_day(spark: SparkSession, d: str) -> DataFrame:
    return facets.newest_day(_plain(spark, d), {"urgent": GAZETTE.dim("action").equals("1-URGENT"), "final": GAZETTE.dim("govlevel").equals("F")})


@query("SELECT year, month, count(*)::BIGINT AS n FROM rec GROUP BY ROLLUP (year, month)")
def totals_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d).rollup("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("""
, c AS (SELECT ancestor AS slug, count(*)::BIGINT AS n FROM rec JOIN clo ON topic = descendant WHERE topic_c GROUP BY 1)
SELECT t.slug, t.name, t.parent, coalesce(n, 0)::BIGINT AS n,
       coalesce((SELECT string_agg(k.slug, ',' ORDER BY k.slug) FROM topics k WHERE k.parent = t.slug), '') AS children
FROM topics t LEFT JOIN c ON t.slug = c.slug
""")
def taxonomy_counts(spark: SparkSession, d: str) -> DataFrame:
    tree = tables.topics(spark, d)
    leaf = _rec(spark, d).where("topic_c").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return hierarchy.tree_counts(tree, hierarchy.roll_up(leaf, _closure(spark, d))).withColumn("children", F.array_join("children", ","))


@query("SELECT descendant, ancestor, depth FROM clo")
def topic_closure(spark: SparkSession, d: str) -> DataFrame:
    return _closure(spark, d)


@query("SELECT slug, coalesce(parent, slug) AS root, ((dense_rank() OVER (ORDER BY coalesce(parent, slug)) - 1) % 10)::INT AS family FROM topics")
def topic_families(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.roots(_closure(spark, d))


FILTERS = {"equal": {"action": "1-URGENT", "province": "NATION_3"}, "day_from": "1996-01-01", "day_to": "1999-12-31"}
_CROSS = """
, p AS (SELECT *, coalesce(action = '1-URGENT' AND action_c, false) AS pa, coalesce(province = 'NATION_3', false) AS pp,
               coalesce(topic_c AND topic IN (SELECT descendant FROM clo WHERE ancestor = 'ECONOMY'), false) AS pt,
               date >= '1996-01-01' AS pf, date <= '1999-12-31' AS pu FROM rec)
SELECT facet, value, count(*)::BIGINT AS n FROM (
  SELECT 'total' AS facet, '' AS value FROM p WHERE pa AND pp AND pt AND pf AND pu
  UNION ALL SELECT 'year', year FROM p WHERE pa AND pp AND pt
  UNION ALL SELECT 'month', month FROM p WHERE pa AND pp AND pt
  UNION ALL SELECT 'day', date FROM p WHERE pa AND pp AND pt AND pf AND pu
  UNION ALL SELECT 'topic', topic FROM p WHERE topic_c AND pa AND pp AND pf AND pu
  UNION ALL SELECT 'action', action FROM p WHERE action_c AND pp AND pt AND pf AND pu
  UNION ALL SELECT 'govlevel', govlevel FROM p WHERE govlevel_c AND pa AND pp AND pt AND pf AND pu
  UNION ALL SELECT 'agency', agency FROM p WHERE pa AND pp AND pt AND pf AND pu
  UNION ALL SELECT 'province', province FROM p WHERE pa AND pt AND pf AND pu)
WHERE value IS NOT NULL GROUP BY ALL
"""


@query(_CROSS)
def crossfilter(spark: SparkSession, d: str) -> DataFrame:
    """Total and nine facets, each with its own filters lifted, in one scan."""
    rows = hierarchy.marked(_rec(spark, d), _closure(spark, d), ["ECONOMY"])
    return cf.cross_filter(rows, cf.Filters(**FILTERS, below="below"))


@query("""
SELECT govlevel, province, count(*)::BIGINT AS n FROM rec
WHERE action = '2-HIGH' AND action_c AND month IN ('1997-01', '1997-02', '1998-05') AND govlevel_c AND govlevel IS NOT NULL AND province IS NOT NULL GROUP BY ALL
""")
def filtered_groupby(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the rows that match, from the stored counts, which have all that is asked."""
    f, by = cf.Filters(equal={"action": "2-HIGH"}, months=("1997-01", "1997-02", "1998-05")), ["govlevel", "province"]
    rows, spec, weight = cuboid.source(tables.CUBE, tables.cube(spark, d), _plain(spark, d), f, by)
    return cf.grouped(rows, f, by, spec, weight)


@query("SELECT id, date, title FROM rec WHERE replace(title, ' ', '') LIKE '%77Customer%' ORDER BY coalesce(date, '') DESC, id DESC LIMIT 600")
def title_search(spark: SparkSession, d: str) -> DataFrame:
    """Newest 600 whose title holds a text, white space ignored."""
    return cf.newest_matches(_plain(spark, d), cf.Filters(text="7 7 Customer")).select("id", "date", "title")


@query("SELECT substring(date, 1, 7) AS bucket, count(*)::BIGINT AS n FROM rec GROUP BY 1")
def bucket_months(spark: SparkSession, d: str) -> DataFrame:
    return cf.bucketed(_plain(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n")), "date", 7)


@query("SELECT ancestor AS topic, count(*)::BIGINT AS n FROM rec JOIN clo ON topic = descendant WHERE topic_c GROUP BY 1")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    leaf = _rec(spark, d).where("topic_c").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return hierarchy.roll_up(leaf, _closure(spark, d))


@query("SELECT count(*)::BIGINT AS n FROM rec WHERE topic_c AND topic IS NOT NULL")
def topic_total(spark: SparkSession, d: str) -> DataFrame:
    return _rec(spark, d).agg(F.count_if(F.col("topic_c") & F.col("topic").isNotNull()).alias("n"))


@query("SELECT agency, count(*)::BIGINT AS n FROM rec WHERE agency IS NOT NULL GROUP BY 1")
def list_counter(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d).where("agency IS NOT NULL").groupBy("agency").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "agency")


@query("SELECT month, count(*)::BIGINT AS n FROM rec WHERE govlevel = 'P' AND govlevel_c GROUP BY month ORDER BY month DESC LIMIT 1")
def nearest_period(spark: SparkSession, d: str) -> DataFrame:
    return cf.nearest_period(_plain(spark, d), cf.Filters(equal={"govlevel": "P"}))


@query("""
, m AS (SELECT month, count(*)::BIGINT AS n FROM rec WHERE province = 'NATION_3' GROUP BY month)
SELECT month, n, row_number() OVER (ORDER BY month DESC) <= 6 AS taken FROM m
""")
def within_budget(spark: SparkSession, d: str) -> DataFrame:
    return cf.within_budget(_plain(spark, d), cf.Filters(equal={"province": "NATION_3"}), 6)


@query("""
, r AS (SELECT province, id, date, row_number() OVER (PARTITION BY province ORDER BY coalesce(date, '') DESC, id DESC)::INT AS rank FROM rec WHERE province IS NOT NULL)
SELECT * FROM r WHERE rank <= 30
""")
def newest_per_province(spark: SparkSession, d: str) -> DataFrame:
    return facets.newest(_plain(spark, d), "province").select("province", "id", "date", "rank")


@query("""
, c AS (SELECT province AS key, agency AS value, count(*)::BIGINT AS n FROM rec WHERE province IS NOT NULL AND agency IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value)::INT AS rank FROM c)
SELECT key, value, n, rank, round(100 * n / greatest(1, max(n) OVER (PARTITION BY key)))::INT AS bar FROM r WHERE rank <= 50
""")
def top_agencies(spark: SparkSession, d: str) -> DataFrame:
    """The 50 largest agencies of each province, each as a percent of the first."""
    counts = facets.facet_counts(_plain(spark, d), "province", dims=(GAZETTE.dim("agency"),))
    return facets.normalised(facets.ranked_values(counts, "agency").drop("dim"), ["key"])


@query("SELECT DISTINCT date FROM rec ORDER BY date DESC LIMIT 90")
def newest_dates(spark: SparkSession, d: str) -> DataFrame:
    return facets.newest_dates(_plain(spark, d), 90)


@query("""
, days AS (SELECT DISTINCT date FROM rec ORDER BY date DESC LIMIT 90),
l AS (SELECT id, date, page, row_number() OVER (PARTITION BY date ORDER BY coalesce(page, 0), id) = 1 AS new_day FROM rec WHERE date IN (SELECT date FROM days))
SELECT id, date, page, (SELECT count(*) FROM rec r WHERE r.date = l.date)::BIGINT AS day_total, new_day FROM l
""")
def latest_listing(spark: SparkSession, d: str) -> DataFrame:
    rec = _plain(spark, d).select("id", "date", "page")
    return facets.day_runs(facets.latest(rec, 90), rec).select("id", "date", "page", "day_total", "new_day")


@query("SELECT id, date, page FROM rec WHERE date IS NOT NULL ORDER BY date DESC, coalesce(page, 0), id LIMIT 500")
def recent_500(spark: SparkSession, d: str) -> DataFrame:
    return facets.recent(_plain(spark, d)).select("id", "date", "page")


@query("SELECT id, govlevel FROM rec WHERE action_c AND action IN ('1-URGENT', '2-HIGH') ORDER BY govlevel <> 'F', page DESC, id LIMIT 12")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("action_c") & F.col("action").isin("1-URGENT", "2-HIGH")
    return facets.highlights(_plain(spark, d).withColumn("w", F.col("page").cast("double")), ok, F.col("govlevel") == "F", "w").select("id", "govlevel")


@query("SELECT id, date FROM rec ORDER BY coalesce(date, '') DESC, id DESC LIMIT 50 OFFSET 100")
def third_page(spark: SparkSession, d: str) -> DataFrame:
    return facets.page(_plain(spark, d), newest_order(), 3).select("id", "date")


@query("SELECT slug, name, parent, root_n AS n FROM (SELECT t.slug, t.name, t.parent, count(r.id)::BIGINT AS root_n FROM topics t JOIN clo ON ancestor = t.slug JOIN rec r ON r.topic = descendant AND topic_c WHERE parent IS NULL GROUP BY ALL) ORDER BY n DESC, slug LIMIT 10")
def doorways(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest root topics."""
    tree = tables.topics(spark, d)
    leaf = _rec(spark, d).where("topic_c").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    counted = hierarchy.tree_counts(tree, hierarchy.roll_up(leaf, _closure(spark, d)))
    return counted.where("parent IS NULL AND n > 0").select("slug", "name", "parent", "n").orderBy(F.desc("n"), "slug").limit(10)


@query("SELECT row_number() OVER (ORDER BY province)::INT AS code, province AS value, count(*)::BIGINT AS n FROM rec WHERE province IS NOT NULL GROUP BY province")
def dictionary_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Counts by code of a dimension, decoded back to values."""
    rec = _plain(spark, d)
    codes = encode.dictionary(rec, "province")
    counts = encode.encoded(rec, "province", codes).where("province_code > 0").groupBy(F.col("province_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return encode.decoded(counts.withColumn("c", F.col("code")), codes).select(F.col("c").alias("code"), "value", "n")


@query("SELECT id, row_number() OVER (ORDER BY month, coalesce(date, ''), id) - 1 AS position, (CASE WHEN topic_c THEN 1 ELSE 0 END + CASE WHEN action_c THEN 2 ELSE 0 END + CASE WHEN govlevel_c THEN 4 ELSE 0 END)::INT AS flags FROM rec")
def row_positions(spark: SparkSession, d: str) -> DataFrame:
    return encode.positions(_rec(spark, d)).select("id", "position", flags(F.col("topic_c"), F.col("action_c"), F.col("govlevel_c")).alias("flags"))


@query("SELECT month, (sum(n) OVER (ORDER BY month) - n)::BIGINT AS start, n FROM (SELECT month, count(*)::BIGINT AS n FROM rec GROUP BY month)")
def month_directory(spark: SparkSession, d: str) -> DataFrame:
    return encode.month_directory(_plain(spark, d))


@query("SELECT agency, substring(sha1(agency), 1, 10) AS key, count(*)::BIGINT AS n, count(*) >= 5 AS page FROM rec WHERE agency IS NOT NULL GROUP BY agency")
def agency_index(spark: SparkSession, d: str) -> DataFrame:
    from facetra.functions.text import short_key

    counts = _plain(spark, d).where("agency IS NOT NULL").groupBy("agency").agg(F.count(F.lit(1)).alias("n"))
    return encode.sized(counts, "agency").select("agency", short_key(F.col("agency")).alias("key"), "n", "page")


@query("""
, f AS (SELECT 'all' AS feed_id, * FROM rec UNION ALL SELECT 'series/' || part, * FROM rec),
g AS (SELECT 'province/' || province AS feed_id, * FROM rec WHERE province IN (SELECT province FROM rec GROUP BY 1 HAVING count(*) >= 50)),
r AS (SELECT feed_id, id, date, row_number() OVER (PARTITION BY feed_id ORDER BY coalesce(date, '') DESC, id DESC) AS rank, 200 AS k FROM f
      UNION ALL SELECT feed_id, id, date, row_number() OVER (PARTITION BY feed_id ORDER BY coalesce(date, '') DESC, id DESC), 50 FROM g)
SELECT feed_id, split_part(feed_id, '/', 1) AS kind, count(*)::BIGINT AS n, max(date) AS updated FROM r WHERE rank <= k GROUP BY ALL
""")
def feed_directory(spark: SparkSession, d: str) -> DataFrame:
    entries = publish.feeds(_plain(spark, d), "part", ["province"])
    return publish.feed_directory(entries, ["all", "series", "province"])


@query("SELECT count(*)::BIGINT AS total, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year)::BIGINT AS years, max(date) AS latest, count_if(topic_c)::BIGINT AS trusted, 'star schema' AS source FROM rec")
def build_meta(spark: SparkSession, d: str) -> DataFrame:
    return publish.build_meta(_rec(spark, d), {"source": "star schema"})
