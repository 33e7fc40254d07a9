"""Queries on trends, authorities, graphs, lookups, search, cleaning and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetra.functions import dates, text
from facetra.operators import authority, clean, encode, facets, graph, hierarchy, lookup, quality, search, trends
from facetra.plans import publish
from facetra.plans.facet_queries import topic_agency
from facetra.plans.registry import query
from facetra.sources import tables
from facetra.specs import GAZETTE


def _rec(spark: SparkSession, d: str) -> DataFrame:
    return tables.records(spark, d)


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """Records without topics."""
    return tables.records(spark, d, with_topics=False)


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("key").agg(F.sum("n").cast("long").alias("total"))


def _monthly(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


# ---- trends

_SERIES = """
, y AS (SELECT DISTINCT year FROM rec), k AS (SELECT action AS key, year, count(*)::BIGINT AS n FROM rec WHERE action_c GROUP BY ALL),
ser AS (SELECT key, year, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT key FROM k) CROSS JOIN y LEFT JOIN k USING (key, year))
"""


@query(_SERIES + "SELECT * FROM ser")
def yearly_series(spark: SparkSession, d: str) -> DataFrame:
    return trends.series(_plain(spark, d), GAZETTE.dim("action"))


@query("SELECT DISTINCT year, 'complete' AS rule FROM rec WHERE year < (SELECT substring(max(date), 1, 4) FROM rec) UNION ALL SELECT year, 'whole' FROM rec GROUP BY year HAVING count(DISTINCT month) = 12")
def complete_and_whole_years(spark: SparkSession, d: str) -> DataFrame:
    """Two rules: years before the newest date's, and years with all twelve months."""
    rec = _plain(spark, d)
    return trends.complete_years(rec).withColumn("rule", F.lit("complete")).union(trends.whole_years(rec).withColumn("rule", F.lit("whole")))


@query(_SERIES + """
, c AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS r FROM y WHERE year < (SELECT substring(max(date), 1, 4) FROM rec)),
m AS (SELECT key, coalesce(sum(n) FILTER (r > 3), 0)::BIGINT AS before, coalesce(sum(n) FILTER (r <= 3), 0)::BIGINT AS after FROM ser JOIN c USING (year) WHERE r <= 6 GROUP BY key)
SELECT key, before, after, after - before AS change, CASE WHEN before >= 50 THEN round((after - before) / before, 6) END AS ratio FROM m WHERE before >= 200 OR after >= 200
""")
def movers(spark: SparkSession, d: str) -> DataFrame:
    rec = _plain(spark, d)
    found = trends.movers(trends.series(rec, GAZETTE.dim("action")), trends.complete_years(rec))
    return found.withColumn("ratio", F.round("ratio", 6))


@query(_SERIES + """
, p AS (SELECT key, year, n AS after, lag(n) OVER (PARTITION BY key ORDER BY year) AS before FROM ser),
m AS (SELECT key, before, after, after - before AS change FROM p WHERE year = '1999' AND before IS NOT NULL AND (before >= 60 OR after >= 60)),
r AS (SELECT *, CASE WHEN change > 0 THEN 'rising' WHEN change < 0 THEN 'falling' END AS direction FROM m),
s AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY abs(change) DESC, key)::INT AS rank FROM r WHERE direction IS NOT NULL)
SELECT key, before, after, change, CASE WHEN before >= 50 THEN round(change / before, 6) END AS ratio, direction, rank, round(abs(change) / max(abs(change)) OVER (), 6) AS bar FROM s WHERE rank <= 6
""")
def year_over_year(spark: SparkSession, d: str) -> DataFrame:
    """Rises and falls of 1999 against 1998."""
    found = trends.ranked_moves(trends.year_over_year(trends.series(_plain(spark, d), GAZETTE.dim("action")), "1999"))
    return found.withColumn("ratio", F.round("ratio", 6))


@query("""
, s AS (SELECT lpad(range::VARCHAR, 2, '0') AS mm FROM range(1, 13)), c AS (SELECT substring(month, 6, 2) AS mm, count(*)::BIGINT AS n FROM rec GROUP BY 1)
SELECT mm, coalesce(n, 0)::BIGINT AS n, mm = (SELECT mm FROM c ORDER BY n DESC, mm LIMIT 1) AS busiest FROM s LEFT JOIN c USING (mm)
""")
def month_profile(spark: SparkSession, d: str) -> DataFrame:
    profile = trends.month_profile(_monthly(_plain(spark, d)))
    best = trends.busiest(profile).select(F.col("mm").alias("best"))
    return profile.join(F.broadcast(best)).select("mm", "n", (F.col("mm") == F.col("best")).alias("busiest"))


@query("""
, m AS (SELECT month, count(*)::BIGINT AS n FROM rec GROUP BY month), l AS (SELECT substring(max(date), 1, 4) AS year, substring(max(date), 6, 2) AS upto FROM rec)
SELECT year, coalesce(sum(n) FILTER (substring(month, 1, 4) = year), 0)::BIGINT AS now,
       coalesce(sum(n) FILTER (substring(month, 1, 4)::INT = year::INT - 1), 0)::BIGINT AS "then",
       count(*) FILTER (substring(month, 1, 4) = year)::BIGINT AS months
FROM m, l WHERE substring(month, 6, 2) <= upto GROUP BY year
""")
def year_to_date(spark: SparkSession, d: str) -> DataFrame:
    rec = _plain(spark, d)
    return trends.year_to_date(_monthly(rec), rec.agg(F.max("date").alias("date")))


@query(_SERIES + "SELECT coalesce(sum(n), 0)::BIGINT AS n FROM ser WHERE key IN ('1-URGENT', '2-HIGH') AND year = '1998'")
def sum_at(spark: SparkSession, d: str) -> DataFrame:
    return trends.sum_at(trends.series(_plain(spark, d), GAZETTE.dim("action")), ["1-URGENT", "2-HIGH"], "1998")


_BANDS = """
, c AS (SELECT province, count(*)::BIGINT AS n FROM rec WHERE province IS NOT NULL GROUP BY 1),
o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS k FROM c WHERE n > 0),
cuts AS (SELECT n AS cut FROM o, range(1, 5) b WHERE i = (b.range * k) // 5)
"""


@query(_BANDS + "SELECT province, n, (SELECT count(*) FROM cuts WHERE cut <= c.n)::INT AS band FROM c")
def quantile_bands(spark: SparkSession, d: str) -> DataFrame:
    counts = _plain(spark, d).where("province IS NOT NULL").groupBy("province").agg(F.count(F.lit(1)).alias("n"))
    return trends.banded(counts, trends.quantile_cuts(counts))


@query("""
, c AS (SELECT province, count(*)::BIGINT AS n FROM rec WHERE province IS NOT NULL GROUP BY 1)
SELECT count(*)::BIGINT AS keys, sum(n)::BIGINT AS n, arg_max(province, (n, province)) AS largest, round(sum(n) / (SELECT count(*) FROM rec), 6) AS share FROM c
""")
def province_coverage(spark: SparkSession, d: str) -> DataFrame:
    rec = _plain(spark, d)
    counts = rec.where("province IS NOT NULL").groupBy("province").agg(F.count(F.lit(1)).alias("n"))
    total = rec.agg(F.count(F.lit(1)).alias("total"))
    return trends.coverage(counts.join(F.broadcast(total)), "province", F.lit(None).cast("double")).drop("share").join(F.broadcast(total)).select(
        "keys", "n", "largest", F.round(F.col("n") / F.col("total"), 6).alias("share")
    )


@query("""
SELECT r_name AS region, province, count(*)::BIGINT AS n FROM rec JOIN nation ON n_name = province JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, province)
""")
def region_subtotals(spark: SparkSession, d: str) -> DataFrame:
    nation = tables.table(spark, d, "nation").join(tables.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("province"), F.col("r_name").alias("region"))
    counts = _plain(spark, d).groupBy("province").agg(F.count(F.lit(1)).alias("n")).join(nation, "province")
    return counts.rollup("region", "province").agg(F.sum("n").cast("long").alias("n"))


@query("""
, c AS (SELECT province, count(*)::BIGINT AS n FROM rec WHERE province IS NOT NULL GROUP BY 1)
SELECT province, n, row_number() OVER (ORDER BY n DESC, province)::INT AS rank, round(n / sum(n) OVER (), 6) AS share FROM c
""")
def province_ranks(spark: SparkSession, d: str) -> DataFrame:
    counts = _plain(spark, d).where("province IS NOT NULL").groupBy("province").agg(F.count(F.lit(1)).alias("n"))
    return trends.ranked_shares(counts, "province")


_PAIR = ", ".join(f"count_if(year = '{y}')::BIGINT AS n_{s}, count_if(year = '{y}' AND action_c AND action IN ('1-URGENT', '2-HIGH'))::BIGINT AS rules_{s}, count(DISTINCT CASE WHEN year = '{y}' THEN agency END)::BIGINT AS agencies_{s}" for y, s in (("1999", "now"), ("1998", "before")))


@query(f", p AS (SELECT {_PAIR} FROM rec WHERE province = 'NATION_3') SELECT *, CASE WHEN n_before <> 0 THEN floor(100 * (n_now - n_before) / n_before + 0.5)::BIGINT END AS change FROM p")
def dashboard_pair(spark: SparkSession, d: str) -> DataFrame:
    """A year and the year before under one narrowing, in one pass."""
    rec = _plain(spark, d).where("province = 'NATION_3'")
    rules = F.col("action_c") & F.col("action").isin("1-URGENT", "2-HIGH")
    parts = []
    for y, s in (("1999", "now"), ("1998", "before")):
        mine = F.col("year") == y
        parts += [F.count_if(mine).alias(f"n_{s}"), F.count_if(mine & rules).alias(f"rules_{s}"), F.count_distinct(F.when(mine, F.col("agency"))).alias(f"agencies_{s}")]
    return rec.agg(*parts).withColumn("change", dates.change(F.col("n_now"), F.col("n_before")))


@query("SELECT date, count_if(action_c AND action IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))::BIGINT AS three, count_if(govlevel_c AND govlevel IN ('F', 'O'))::BIGINT AS levels FROM rec GROUP BY date")
def daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("action_c") & F.col("action").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    g = F.col("govlevel_c") & F.col("govlevel").isin("F", "O")
    return _plain(spark, d).groupBy("date").agg(F.count_if(a).alias("three"), F.count_if(g).alias("levels"))


# ---- authorities

_SHARES = """
, f AS (SELECT province AS key, agency AS value, count(*)::BIGINT AS n FROM rec WHERE province IS NOT NULL AND agency IS NOT NULL GROUP BY ALL),
t AS (SELECT key, sum(n)::BIGINT AS total FROM f GROUP BY key),
s AS (SELECT f.key, value, n, total, n / total AS share, row_number() OVER (PARTITION BY f.key ORDER BY n DESC, value)::INT AS rank FROM f JOIN t ON f.key = t.key)
"""


def _agencies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = facets.facet_counts(_plain(spark, d), "province", dims=(GAZETTE.dim("agency"),)).where("dim = 'agency'").drop("dim")
    return counts, _totals(counts)


@query(_SHARES + "SELECT key, value, n, total, round(share, 6) AS share, rank FROM s")
def agency_shares(spark: SparkSession, d: str) -> DataFrame:
    return authority.shares(*_agencies(spark, d)).withColumn("share", F.round("share", 6))


@query(_SHARES + """
, r AS (SELECT *, sum(share) OVER (PARTITION BY key ORDER BY rank) AS run FROM s WHERE rank <= 50)
SELECT key, round(max(share), 6) AS top_share, min(rank) FILTER (run >= 0.8 - 1e-12)::INT AS needed, round(sum(share), 6) AS covered, count(*)::BIGINT AS listed FROM r GROUP BY key
""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return authority.concentration(*_agencies(spark, d))


@query("""
, f AS (SELECT agency AS key, action AS value, count(*)::BIGINT AS n FROM rec WHERE agency IS NOT NULL AND action_c AND action IS NOT NULL GROUP BY ALL),
b AS (SELECT key, arg_max(value, (n, value)) AS v, max(n) AS n, sum(n) AS s FROM f GROUP BY key), t AS (SELECT agency AS key, count(*)::BIGINT AS total FROM rec GROUP BY 1)
SELECT key, CASE WHEN n >= 0.2 * total THEN v END AS main, n, total, round(s / total, 6) AS covered FROM b JOIN t USING (key)
""")
def main_action(spark: SparkSession, d: str) -> DataFrame:
    counts = facets.facet_counts(_rec(spark, d), "agency", dims=(GAZETTE.dim("action"),))
    totals = counts.where("dim = 'total'").select("key", F.col("n").alias("total"))
    return authority.main_value(counts.where("dim = 'action'"), totals)


@query("""
, leaf AS (SELECT topic, agency, count(*)::BIGINT AS n FROM rec WHERE topic_c AND agency IS NOT NULL AND topic IS NOT NULL GROUP BY ALL),
big AS (SELECT topic, agency AS other, n AS m FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, agency) AS r FROM ta) WHERE r <= 25),
ok AS (SELECT agency FROM rec GROUP BY agency HAVING count(*) >= 5),
o AS (SELECT agency, other, sum(least(n, m))::BIGINT AS n, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics
      FROM leaf JOIN big USING (topic) WHERE agency <> other AND agency IN (SELECT agency FROM ok) GROUP BY ALL)
SELECT agency, other, n, topics, rank FROM (SELECT *, row_number() OVER (PARTITION BY agency ORDER BY n DESC, other)::INT AS rank FROM o) WHERE rank <= 6
""")
def agency_overlaps(spark: SparkSession, d: str) -> DataFrame:
    leaf = tables.leaf_agencies(spark, d).groupBy("topic", "agency").agg(F.sum("n").cast("long").alias("n"))
    only = tables.agency_totals(spark, d).where("n >= 5")
    rolled = hierarchy.roll_up(leaf, tables.topic_closure(spark, d), keys=["agency"])
    return authority.overlaps(leaf, rolled, only)


_BYSEG = """
, seg AS (SELECT year, ancestor AS topic, agency_type AS agency, count(*)::BIGINT AS n FROM rec JOIN clo ON topic = descendant WHERE topic_c GROUP BY ALL),
whole AS (SELECT year FROM rec GROUP BY year HAVING count(DISTINCT month) = 12),
rk AS (SELECT *, sum(n) OVER (PARTITION BY year, topic)::BIGINT AS total, row_number() OVER (PARTITION BY year, topic ORDER BY n DESC, agency) AS r FROM seg WHERE year IN (SELECT year FROM whole)),
ld AS (SELECT topic, year, agency, n, total FROM rk WHERE r = 1 AND total >= 20 AND n >= 0.2 * total)
"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    trusted = _rec(spark, d).where("topic_c").groupBy("year", "topic", F.col("agency_type").alias("agency")).agg(F.count(F.lit(1)).alias("n"))
    return hierarchy.roll_up(trusted, tables.topic_closure(spark, d), keys=["year", "agency"])


@query(_BYSEG + "SELECT * FROM ld")
def leaders(spark: SparkSession, d: str) -> DataFrame:
    """Leading customer segment of each topic and whole year."""
    return authority.leaders(_segments(spark, d).join(trends.whole_years(_plain(spark, d)), "year", "left_semi"), share=0.2)


@query(_BYSEG + """
, ch AS (SELECT *, lag(year) OVER w AS since, lag(agency) OVER w AS was_agency, lag(n) OVER w AS was_n, lag(total) OVER w AS was_total FROM ld WINDOW w AS (PARTITION BY topic ORDER BY year)),
la AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year DESC) AS r FROM ch WHERE agency <> was_agency)
SELECT la.topic, la.year, since, was_agency, was_n, was_total, la.agency, la.n, la.total FROM la
LEFT JOIN seg s ON s.topic = la.topic AND s.year = la.year AND s.agency = la.was_agency
WHERE r = 1 AND coalesce(s.n, 0) >= greatest(1, 0.1 * was_n)
""")
def leader_changes(spark: SparkSession, d: str) -> DataFrame:
    return authority.leader_changes(_segments(spark, d), trends.whole_years(_plain(spark, d)), share=0.2)


@query("""
, p AS (SELECT topic, count(DISTINCT agency)::BIGINT AS agencies, sum(n)::BIGINT AS n FROM ta GROUP BY topic),
k AS (SELECT *, CASE WHEN agencies > 1 THEN 'spread' ELSE 'single' END AS kind FROM p)
SELECT topic, agencies, n, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN agencies > 1 THEN agencies ELSE n END DESC, n DESC, topic)::INT AS rank FROM k) WHERE rank <= 5
""")
def topic_spread(spark: SparkSession, d: str) -> DataFrame:
    return authority.spread(topic_agency(spark, d))


# ---- graphs

_PAIRS = """
, el AS (SELECT DISTINCT id, slug FROM lab WHERE corroborated OR weight >= 0.7),
pr AS (SELECT x.slug AS a, y.slug AS b, strftime(o_orderdate, '%Y') AS year, count(*)::BIGINT AS n FROM el x JOIN el y ON x.id = y.id AND x.slug < y.slug JOIN orders ON o_orderkey = x.id GROUP BY ALL)
"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return _rec(spark, d).select("id", "year", "slugs")


@query(_PAIRS + "SELECT year, a, b, n FROM pr")
def label_pairs_year(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_pairs(_sets(spark, d), ["year"])


@query(_PAIRS + "SELECT a, b, sum(n)::BIGINT AS n FROM pr GROUP BY ALL")
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_pairs(_sets(spark, d))


@query("SELECT * FROM rolled")
def topic_agency_year(spark: SparkSession, d: str) -> DataFrame:
    return topic_agency(spark, d)


@query("SELECT topic, sum(n)::BIGINT AS n, count(DISTINCT agency)::BIGINT AS agencies FROM ta GROUP BY topic")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(topic_agency(spark, d))


_KNOWN = ", kn AS (SELECT DISTINCT agency FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, agency) AS r FROM ta) WHERE r <= 6)"


@query(_PAIRS + _KNOWN + """
, e AS (SELECT year, topic, agency, n, row_number() OVER (PARTITION BY year ORDER BY n DESC, topic, agency) AS r FROM rolled WHERE agency IN (SELECT agency FROM kn)),
q AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, a, b) AS r FROM pr)
SELECT year, 'agency' AS kind, topic AS a, agency AS b, n FROM e WHERE r <= 1500 UNION ALL SELECT year, 'topic', a, b, n FROM q WHERE r <= 400
""")
def graph_edges_year(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each year's graph, all years in one job."""
    return graph.edges(topic_agency(spark, d), graph.label_pairs(_sets(spark, d), ["year"]), ["year"])


_EDGES = _PAIRS + _KNOWN + """
, ed AS (SELECT 'topic' AS kind, a, b, n FROM (SELECT a, b, sum(n)::BIGINT AS n FROM pr GROUP BY ALL ORDER BY n DESC, a, b LIMIT 400)),
vw AS (SELECT kind, a, b, n FROM ed WHERE n >= 2 UNION ALL SELECT 'tree', parent, slug, 0 FROM topics WHERE parent IS NOT NULL),
bo AS (SELECT a AS node, b AS other, n FROM vw UNION ALL SELECT b, a, n FROM vw),
mg AS (SELECT node, other, max(n)::BIGINT AS n, bool_or(n = 0) AS kin FROM bo GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, other)::INT AS rank FROM mg) WHERE rank <= 12
"""


@query(_EDGES)
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in the view of topic pairs and tree edges."""
    pairs = graph.label_pairs(_sets(spark, d)).orderBy(F.desc("n"), "a", "b").limit(400).withColumn("kind", F.lit("topic"))
    return graph.neighbours(graph.view(pairs, tables.topics(spark, d), 2))


# ---- citations and look-ups

_CITES = """
, ci AS (SELECT o_custkey * 100000 + o_orderkey AS cite, (year(o_orderdate) - 1994)::INT AS volume, o_orderpriority AS part,
         CASE WHEN o_orderkey % 11 <> 0 THEN ((o_orderkey * 7) % 520)::INT END AS page FROM orders)
"""


def _cites(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return tables.table(spark, d, "orders").select(
        (F.col("o_custkey") * 100000 + k).alias("cite"), (F.year("o_orderdate") - 1994).alias("volume"), F.col("o_orderpriority").alias("part"),
        F.when(k % 11 != 0, (k * 7) % 520).cast("int").alias("page"),
    )


@query(_CITES + """
, j AS (SELECT cite, r.id, r.page AS pg, r.date, ci.page FROM ci JOIN rec r ON r.volume = ci.volume AND r.part = ci.part)
SELECT cite, coalesce(arg_max(id, (pg, date, id)) FILTER (page IS NOT NULL AND pg <= page), arg_min(id, (pg, date, id))) AS id FROM j GROUP BY cite
""", also="citations_as_of_all")
def citations_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The record that each cited page belongs to."""
    return lookup.resolve(_cites(spark, d), _plain(spark, d))


@query("""
, g AS (SELECT year, month, min(id) AS lo, max(id) AS hi FROM rec GROUP BY ALL)
SELECT c_custkey AS id, month FROM customer JOIN g ON c_custkey BETWEEN lo AND hi
""", also="months_of_ids_all")
def months_of_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every month whose id range holds a number."""
    ids = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return lookup.months_of(ids, lookup.id_ranges(_plain(spark, d)))


@query("SELECT year, month, min(id) AS lo, max(id) AS hi FROM rec GROUP BY ALL")
def id_ranges(spark: SparkSession, d: str) -> DataFrame:
    return lookup.id_ranges(_plain(spark, d))


@query("""
, p AS (SELECT *, coalesce(page, 0) AS p FROM rec)
SELECT id, max((p, id)) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)[2] AS previous, min((p, id)) OVER (w RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)[2] AS next
FROM p WINDOW w AS (PARTITION BY volume, part ORDER BY p)
""")
def issue_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return lookup.neighbours_in_issue(_plain(spark, d))


@query("""
SELECT w.id AS of, r.id, r.page, row_number() OVER (PARTITION BY w.id ORDER BY coalesce(r.page, 0), r.id)::INT AS rank
FROM rec w JOIN rec r ON w.volume = r.volume AND w.part = r.part AND w.id <> r.id WHERE w.id % 50 = 0
""")
def issue_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Siblings, among all records, of every record whose id is divisible by 50."""
    rec = _plain(spark, d)
    return lookup.siblings(rec, rec.where("id % 50 = 0").select("id"))


@query("""
SELECT id, (SELECT count(*) FROM rec b WHERE b.agency = a.agency)::BIGINT AS n_agency,
  (SELECT count(*) FROM rec b WHERE b.agency = a.agency AND b.topic_c AND a.topic_c AND b.topic = a.topic)::BIGINT AS n_topic,
  (SELECT count(*) FROM rec b WHERE b.agency = a.agency AND b.province = a.province)::BIGINT AS n_province FROM rec a
""")
def agency_context(spark: SparkSession, d: str) -> DataFrame:
    return lookup.agency_context(_rec(spark, d))


# ---- search

_DIMS3 = """
, dm AS (SELECT 'topic' AS kind, 1 AS kind_order, ancestor AS name, count(*)::BIGINT AS n FROM rec JOIN clo ON topic = descendant WHERE topic_c GROUP BY ancestor
  UNION ALL SELECT 'province', 2, province, count(*) FROM rec WHERE province IS NOT NULL GROUP BY province
  UNION ALL SELECT 'agency', 3, agency, count(*) FROM rec WHERE agency IS NOT NULL GROUP BY agency),
qs AS (SELECT DISTINCT substring(p_brand, 6, 3) AS q FROM part UNION SELECT r_name FROM region UNION SELECT 'NATION _1'
  UNION SELECT strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(o_orderkey::VARCHAR, 8, '0') FROM orders WHERE o_orderkey % 50 = 0
  UNION SELECT (100 + n_nationkey) || '/' || (n_nationkey + 1) || ' ก/' || (n_nationkey + 2) FROM nation),
lead AS (SELECT strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(o_orderkey::VARCHAR, 8, '0') AS q, 'document' AS kind, strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(o_orderkey::VARCHAR, 8, '0') AS name FROM orders WHERE o_orderkey % 50 = 0
  UNION SELECT (100 + n_nationkey) || '/' || (n_nationkey + 1) || ' ก/' || (n_nationkey + 2), 'citation', 'เล่ม ' || (100 + n_nationkey) || ' ตอนที่ ' || (n_nationkey + 1) || ' ก หน้า ' || (n_nationkey + 2) FROM nation),
h AS (SELECT q, kind, kind_order, name, n, starts_with(replace(name, ' ', ''), replace(q, ' ', '')) AS pre FROM dm JOIN qs ON contains(replace(name, ' ', ''), replace(q, ' ', ''))),
k AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY NOT pre, kind_order, n DESC, name) AS i FROM h)
SELECT q, kind, name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY lead DESC, NOT pre, kind_order, n DESC, name)::INT AS rank
  FROM (SELECT q, kind, kind_order, name, n, pre, false AS lead FROM k WHERE i <= 4 UNION ALL SELECT q, kind, 0, name, NULL, true, true FROM lead)) WHERE rank <= 8
"""


@query(_DIMS3)
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    rec = _rec(spark, d)
    leaf = rec.where("topic_c").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    kind = lambda df, k, i, c: df.select(F.lit(k).alias("kind"), F.lit(i).alias("kind_order"), F.col(c).alias("name"), "n")
    count = lambda c: rec.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    dims = kind(hierarchy.roll_up(leaf, tables.topic_closure(spark, d)), "topic", 1, "topic").union(kind(count("province"), "province", 2, "province")).union(kind(count("agency"), "agency", 3, "agency"))
    k, key = F.col("n_nationkey"), F.col("o_orderkey")
    ids = tables.table(spark, d, "orders").where(key % 50 == 0).select(F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(key.cast("string"), 8, "0")))
    pages = tables.table(spark, d, "nation").select(F.concat((k + 100).cast("string"), F.lit("/"), (k + 1).cast("string"), F.lit(" ก/"), (k + 2).cast("string")))
    qs = tables.table(spark, d, "part").select(F.substring("p_brand", 6, 3).alias("q")).union(tables.table(spark, d, "region").select("r_name")).union(spark.createDataFrame([("NATION _1",)], "q string"))
    qs = qs.union(ids).union(pages)
    return search.entities(qs, dims)


_GRAMS = """
WITH g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3))) AS gram FROM documents WHERE length(text) >= 3)
"""


@query(_GRAMS + "SELECT gram, count(*)::BIGINT AS df FROM g GROUP BY gram HAVING count(*) > 2", base=False)
def trigram_stats(spark: SparkSession, d: str) -> DataFrame:
    return tables.trigram_stats(spark, d)


@query(_GRAMS + "SELECT gram, doc_id // 4096 AS block, count(*)::BIGINT AS df FROM g GROUP BY ALL", base=False)
def trigram_blocks(spark: SparkSession, d: str) -> DataFrame:
    return search.block_index(tables.trigrams(spark, d))


#: Characters of a piece of an item.
PIECE = 40


@query("""
WITH p AS (SELECT item_id, text, length(text) AS n, unnest(range(0, length(text), 40)) AS k FROM benchmark WHERE length(text) > 0),
q AS (SELECT item_id, (k // 40)::INT AS piece, substring(text, greatest(least(k, n - 40), 0)::INT + 1, 40) AS q FROM p)
SELECT item_id, piece, q, doc_id FROM q JOIN documents ON contains(text, q)
""", base=False, also="substring_search_whole")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    """item_id, piece, q, doc_id: each benchmark item in pieces that cover it to its end, all looked up in the trigram index.

    The last piece ends with the item and may overlap the one before, so that none but a short item's is short.
    """
    docs, pieces = tables.table(spark, d, "documents"), _pieces(tables.table(spark, d, "benchmark"))
    stats, bitmaps = tables.trigram_stats(spark, d), tables.gram_bitmaps(spark, d)
    found = search.substring_search(pieces.select("q"), docs, None, stats=stats, bitmaps=bitmaps)
    return pieces.join(found, "q").select("item_id", "piece", "q", "doc_id")


def _pieces(items: DataFrame) -> DataFrame:
    n = F.length("text")
    cut = items.where(n > 0).select("item_id", "text", n.alias("n"), F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(PIECE))).alias("piece", "at"))
    start = F.greatest(F.least("at", F.col("n") - PIECE), F.lit(0)) + 1
    return cut.select("item_id", "piece", F.substring("text", start, F.lit(PIECE)).alias("q"))


@query(_GRAMS + """
, p AS (SELECT text, length(text) AS n, unnest(range(0, length(text), 40)) AS k FROM benchmark WHERE length(text) > 0 AND item_id % 50 = 0),
q AS (SELECT DISTINCT substring(text, greatest(least(k, n - 40), 0)::INT + 1, 40) AS q FROM p),
df AS (SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) > 2),
qg AS (SELECT DISTINCT q, unnest(list_transform(range(1, length(q) - 1), lambda i: substring(q, i, 3))) AS gram FROM q),
r AS (SELECT q, gram, row_number() OVER (PARTITION BY q ORDER BY df, gram) AS i, least(count(*) OVER (PARTITION BY q), 8) AS needed FROM qg JOIN df USING (gram)),
b AS (SELECT q, doc_id // 8 AS block FROM r JOIN g USING (gram) WHERE i <= 8 GROUP BY q, doc_id // 8, needed HAVING count(DISTINCT gram) = needed),
c AS (SELECT q, doc_id, contains(text, q) AS hit FROM b JOIN documents ON doc_id // 8 = block),
t AS (SELECT q, count(*)::BIGINT AS there FROM q JOIN documents ON contains(text, q) GROUP BY q),
s AS (SELECT q, count(*)::BIGINT AS candidates, count_if(hit)::BIGINT AS found FROM c GROUP BY q)
SELECT q, coalesce(candidates, 0)::BIGINT AS candidates, coalesce(found, 0)::BIGINT AS found, coalesce(there, 0)::BIGINT AS there,
  coalesce(round(found / there, 6), 1.0) AS recall, round(found / candidates, 6) AS precision FROM q LEFT JOIN s USING (q) LEFT JOIN t USING (q)
""", base=False)
def search_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of the bitmaps for the pieces of every item whose id is divisible by 50, against all texts."""
    docs, items = tables.table(spark, d, "documents"), tables.table(spark, d, "benchmark").where("item_id % 50 = 0")
    return search.search_report(_pieces(items), docs.select("doc_id", "text"), tables.trigram_stats(spark, d), tables.gram_bitmaps(spark, d))


# ---- links

_LINKS = r"""
WITH p AS (SELECT page_id, url, nullif(regexp_extract(url, '/(\d+)', 1), '') AS num FROM pages),
r AS (SELECT page_id, 'https://ratchakitcha.soc.go.th/documents/' || num || '.pdf' AS source_url, '2024-01-01-' || lpad(page_id::VARCHAR, 8, '0') AS id, num FROM p WHERE num IS NOT NULL),
f AS (SELECT *, ltrim(page_id::VARCHAR, '0') <> '' AND ltrim(page_id::VARCHAR, '0') = (num::BIGINT)::VARCHAR AS own, CASE WHEN num::BIGINT > 0 THEN (num::BIGINT)::VARCHAR ELSE source_url END AS ref FROM r),
c AS (SELECT ref, count(DISTINCT id)::BIGINT AS claimants, CASE WHEN count_if(own AND num::BIGINT > 0) = 1 THEN min(id) FILTER (own AND num::BIGINT > 0) END AS owner FROM f GROUP BY ref HAVING count(DISTINCT id) > 1)
"""


def _claimed(spark: SparkSession, d: str) -> DataFrame:
    num = F.nullif(F.regexp_extract("url", r"/(\d+)", 1), F.lit(""))
    return tables.table(spark, d, "pages").where(num.isNotNull()).select(
        F.concat(F.lit("2024-01-01-"), F.lpad(F.col("page_id").cast("string"), 8, "0")).alias("id"),
        F.concat(F.lit(f"https://{text.HOST}/documents/"), num, F.lit(".pdf")).alias("source_url"),
    )


@query(_LINKS + "SELECT * FROM c", base=False)
def url_claims(spark: SparkSession, d: str) -> DataFrame:
    return clean.claims(_claimed(spark, d))


@query(_LINKS + "SELECT count_if(c.ref IS NULL OR c.owner = f.id)::BIGINT AS linked, count_if(c.ref IS NOT NULL AND c.owner IS DISTINCT FROM f.id)::BIGINT AS withheld, (SELECT count(*) FROM c)::BIGINT AS disputed FROM f LEFT JOIN c ON f.ref = c.ref", base=False)
def link_accounting(spark: SparkSession, d: str) -> DataFrame:
    rows = _claimed(spark, d)
    disputed = clean.claims(rows)
    return clean.link_accounting(clean.settle_links(rows, disputed), disputed)


# ---- texts and checks


@query(r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, len(ps)::INT AS n, list_sum(list_transform(ps, lambda x: length(x)))::BIGINT AS chars FROM p
""", base=False)
def text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    ps = text.paragraphs(F.col("text"))
    sized = tables.table(spark, d, "documents").select("doc_id", ps.alias("ps"))
    return sized.select("doc_id", F.size("ps").alias("n"), F.when(F.size("ps") > 0, F.aggregate("ps", F.lit(0).cast("long"), lambda a, p: a + F.length(p))).alias("chars"))


@query("""
SELECT id, 'เล่ม ' || volume || ' ตอนที่ ' || part || CASE WHEN page <> 0 THEN ' หน้า ' || page ELSE '' END AS coords,
  day(date::DATE) || ' ' || ['ม.ค.', 'ก.พ.', 'มี.ค.', 'เม.ย.', 'พ.ค.', 'มิ.ย.', 'ก.ค.', 'ส.ค.', 'ก.ย.', 'ต.ค.', 'พ.ย.', 'ธ.ค.'][month(date::DATE)] || ' ' || (year(date::DATE) + 543) AS dated
FROM rec
""")
def cited_records(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("volume", "part", "page")]
    return _plain(spark, d).select("id", text.coordinates(*c).alias("coords"), dates.era_date(F.col("date"), short=True).alias("dated"))


@query("""
, c AS (SELECT 'เล่ม ' || volume || ' ตอนที่ ' || page || ' ง หน้า ' || (id % 90 + 1) AS s, id, volume, page FROM rec)
SELECT id, volume, page || ' ง' AS part, (id % 90 + 1)::INT AS page FROM c
""")
def parsed_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations composed in Thai digits and parsed back."""
    rec = _plain(spark, d)
    part = F.concat(F.col("page").cast("string"), F.lit(" ง"))
    s = text.thai_digits(text.coordinates(F.col("volume"), part, (F.col("id") % 90 + 1)))
    return rec.select("id", text.parse_citation(s).alias("c")).select("id", "c.volume", "c.part", "c.page")


@query("""
WITH c AS (SELECT regexp_extract(text, '^[a-zA-Z]+') AS key, count(*) AS n FROM documents WHERE regexp_matches(text, '^[a-zA-Z]') GROUP BY 1)
SELECT 'cut_name' AS "check", a.key, arg_max(b.key, (b.n, b.key)) AS expected, a.n::VARCHAR AS actual FROM c a
JOIN c b ON a.n < 4 AND b.n > 12 AND starts_with(b.key, a.key) AND b.key <> a.key GROUP BY a.key, a.n
""", base=False)
def names_cut_short(spark: SparkSession, d: str) -> DataFrame:
    """First words of documents that are rare and the beginning of a frequent one."""
    first = F.regexp_extract("text", "^[a-zA-Z]+", 0).alias("key")
    counts = tables.table(spark, d, "documents").select(first).where("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return quality.names_cut_short(counts, rare=4, frequent=12)


@query("""
SELECT year, c AS "column", count(*)::BIGINT AS rows, count_if(v IS NULL OR trim(v) = '')::BIGINT AS blank, round(count_if(v IS NULL OR trim(v) = '') / count(*), 6) AS rate
FROM (SELECT year, unnest(['agency', 'topic', 'province']) AS c, unnest([agency, topic, province]) AS v FROM rec) GROUP BY ALL
""")
def blank_rates(spark: SparkSession, d: str) -> DataFrame:
    return quality.blank_rates(_rec(spark, d), ["agency", "topic", "province"], ["year"])


@query("""
, d AS (SELECT volume, part, page, count(*) AS n FROM rec GROUP BY ALL HAVING count(*) > 1), i AS (SELECT volume, part, count(DISTINCT date) AS n FROM rec GROUP BY ALL HAVING count(DISTINCT date) > 1)
SELECT 'coordinates' AS "check", volume || '/' || part || '/' || page AS key, '1' AS expected, n::VARCHAR AS actual FROM d
UNION ALL SELECT 'issue_date', volume || '/' || part, '1', n::VARCHAR FROM i
UNION ALL SELECT 'duplicate', l_orderkey || '/' || l_linenumber, '1', count(*)::VARCHAR FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'id_year', id::VARCHAR, year, substring(id::VARCHAR, 1, 4) FROM rec WHERE substring(id::VARCHAR, 1, 4) <> year
""")
def check_report(spark: SparkSession, d: str) -> DataFrame:
    """Several checks together; every row is something wrong."""
    rec = _plain(spark, d)
    lines = tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return quality.together(
        quality.duplicates(rec, ["volume", "part", "page"], "coordinates"), quality.one_date_per_issue(rec),
        quality.duplicates(lines, ["l_orderkey", "l_linenumber"]), quality.by_row(rec, quality.id_year_entry(), quality.date_entry(), quality.year_entry(1994, 0)),
        quality.sorted_within(encode.positions(rec)),
        quality.directory_contiguous(encode.month_directory(rec), rec), quality.series_complete(trends.series(rec, GAZETTE.dim("action")), rec.select("year").distinct()),
    )


@query("SELECT split_part(slug, '/', 1) AS axis, slug, count(*)::BIGINT AS n, count_if(corroborated)::BIGINT AS corroborated, round(count_if(corroborated) / count(*), 6) AS rate FROM lab GROUP BY ALL")
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    return quality.corroboration(tables.labels(spark, d).withColumn("axis", F.element_at(F.split("slug", "/"), 1)), ["axis", "slug"])


@query("""
SELECT year AS a, strftime(l_shipdate, '%Y') AS b, count(*)::BIGINT AS n FROM rec JOIN lineitem ON l_orderkey = id WHERE year <> strftime(l_shipdate, '%Y') GROUP BY ALL
""")
def year_contingency(spark: SparkSession, d: str) -> DataFrame:
    """Year of the record against year of its lines, where they differ."""
    lines = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.date_format("l_shipdate", "yyyy").alias("y"))
    return quality.two_way(_plain(spark, d).select("id", "year").join(lines, "id").where(F.col("year") != F.col("y")), F.col("year"), F.col("y"))


@query("""
, a AS (SELECT DISTINCT year, id FROM rec), b AS (SELECT DISTINCT strftime(o_orderdate, '%Y') AS year, l_orderkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT coalesce(a.year, b.year) AS year, count(a.id)::BIGINT AS in_a, count(b.id)::BIGINT AS in_b, count_if(b.id IS NULL)::BIGINT AS only_a, count_if(a.id IS NULL)::BIGINT AS only_b
FROM a FULL JOIN b ON a.year = b.year AND a.id = b.id GROUP BY 1
""")
def layer_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Records with and without any line, by year."""
    rec = _plain(spark, d).select("year", "id")
    lines = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).join(rec, "id")
    return quality.layer_coverage(rec, lines, "id", "year")


@query("SELECT event_type AS by, json_keys(props::JSON)[1] AS keys, count(*)::BIGINT AS n, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS total FROM events GROUP BY ALL", base=False)
def map_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of a map column read from JSON, and a sum over one of its values."""
    props = F.from_json("props", "map<string,string>")
    rows = tables.table(spark, d, "events").select(F.col("event_type").alias("by"), text.drop_empty(props).alias("m"))
    return rows.groupBy("by", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_element_at("m", F.lit("k")).cast("bigint")).alias("total"))


@query("""
WITH s AS (SELECT DISTINCT doc_id AS k FROM documents), p AS (SELECT DISTINCT doc_id AS k FROM labels UNION SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT k AS key, 'missing' AS side FROM (SELECT k FROM s EXCEPT SELECT k FROM p) UNION ALL SELECT k, 'extra' FROM (SELECT k FROM p EXCEPT SELECT k FROM s)
""", base=False)
def differing_keys(spark: SparkSession, d: str) -> DataFrame:
    """Documents against the numbers of labels and of pending orders: what only one side has."""
    a = tables.table(spark, d, "documents").select(F.col("doc_id").alias("key"))
    b = tables.table(spark, d, "labels").select(F.col("doc_id").alias("key")).union(tables.table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey"))
    return lookup.differing_keys(a, b, "key")


@query("""
, r AS (SELECT 'series/' || part AS feed_id, *, row_number() OVER (PARTITION BY part ORDER BY coalesce(date, '') DESC, id DESC)::INT AS rank FROM rec)
SELECT feed_id, rank, id, date, 'เล่ม ' || volume || ' ตอนที่ ' || part || CASE WHEN page <> 0 THEN ' หน้า ' || page ELSE '' END || ' · ' || title AS entry FROM r WHERE rank <= 50
""")
def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    return publish.feed_entries(_plain(spark, d).withColumn("feed_id", F.concat(F.lit("series/"), "part")))


@query("""
, m AS (SELECT DISTINCT year, ['มกราคม', 'กุมภาพันธ์', 'มีนาคม', 'เมษายน', 'พฤษภาคม', 'มิถุนายน', 'กรกฎาคม', 'สิงหาคม', 'กันยายน', 'ตุลาคม', 'พฤศจิกายน', 'ธันวาคม'][month(date::DATE)] AS name FROM rec)
SELECT year, name, row_number() OVER (PARTITION BY year ORDER BY name COLLATE th)::INT AS place FROM m
""")
def collated_order(spark: SparkSession, d: str) -> DataFrame:
    """Names of each year's months in the order of the Thai locale, in which leading vowels stand after their consonant."""
    w = Window.partitionBy("year").orderBy(F.collate(F.col("name"), "th"))
    name = F.element_at(F.split(dates.era_date(F.col("date")), " "), 2)
    return _plain(spark, d).select("year", name.alias("name")).distinct().select("year", "name", F.row_number().over(w).alias("place"))
