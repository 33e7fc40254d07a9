from pyspark.sql import functions as F

from facetra.operators import authority, graph, lookup, quality, search, trends

YEARS = ["2018", "2019", "2020", "2021", "2022", "2023", "2024"]


def yearly(spark, **series):
    return spark.createDataFrame([(k, y, n) for k, ns in series.items() for y, n in zip(YEARS, ns, strict=True)], "key string, year string, n long")


def test_movers_compare_windows_and_hide_small_bases(spark):
    s = yearly(spark, new=[0, 0, 1, 100, 134, 150, 9], big=[600, 700, 700, 2000, 2200, 2400, 1], small=[1, 1, 1, 1, 1, 1, 1])
    complete = spark.createDataFrame([(y,) for y in YEARS[:-1]], "year string")
    got = {r.key: (r.before, r.after, r.change, r.ratio) for r in trends.movers(s, complete).collect()}
    assert got == {"new": (1, 384, 383, None), "big": (2000, 6600, 4600, 2.3)}
    assert trends.movers(s, complete.limit(3)).count() == 0
    assert {r.key for r in trends.year_over_year(s, "2021").collect()} == {"new", "big"} and trends.year_over_year(s, "2018").count() == 0


def test_year_to_date_counts_the_same_months(spark):
    monthly = spark.createDataFrame([("2025-01", 10), ("2025-02", 20), ("2026-01", 7), ("2026-02", 5), ("2025-09", 100)], "month string, n long")
    got = trends.year_to_date(monthly, spark.createDataFrame([("2026-02-11",)], "date string")).collect()[0]
    assert (got.year, got.now, got.then, got.months) == ("2026", 12, 30, 2)
    assert trends.month_profile(monthly).where("n > 0").count() == 3 and trends.month_profile(monthly).count() == 12


def test_quantile_cuts_pick_indexes(spark):
    values = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 900])], "k int, n long")
    order = sorted(n for n in [1, 1, 2, 3, 5, 8, 13, 21, 34, 900])
    cuts = {r.i: r.cut for r in trends.quantile_cuts(values).collect()}
    assert cuts == {i: order[i * 10 // 5] for i in range(1, 5)}
    assert trends.quantile_cuts(values.where("n = 0")).count() == 0


def test_concentration_needs_enough_listed(spark):
    rows = spark.createDataFrame([("a", "x", 70), ("a", "y", 20), ("a", "z", 10), ("b", "x", 30), ("b", "y", 0)], "key string, value string, n long")
    totals = spark.createDataFrame([("a", 100), ("b", 100)], "key string, total long")
    got = {r.key: (r.top_share, r.needed, r.covered, r.listed) for r in authority.concentration(rows, totals).collect()}
    assert got == {"a": (0.7, 2, 1.0, 3), "b": (0.3, None, 0.3, 1)}
    assert {r.key: r.main for r in authority.main_value(rows, totals.withColumn("total", F.when(F.col("key") == "b", 1000).otherwise(100))).collect()} == {"a": "x", "b": None}


def tuples(spark, *rows):
    return spark.createDataFrame([(y, t, a, n) for y, t, a, n in rows], "year string, topic string, agency string, n long")


def changes(spark, *rows, years=("2020", "2021", "2022")):
    return [(r.topic, r.year, r.was_agency, r.agency) for r in authority.leader_changes(tuples(spark, *rows), spark.createDataFrame([(y,) for y in years], "year string")).collect()]


def test_leader_changes_and_their_refusals(spark):
    assert changes(spark, ("2020", "t", "A", 30), ("2020", "t", "B", 10), ("2021", "t", "A", 10), ("2021", "t", "B", 30)) == [("t", "2021", "A", "B")]
    assert changes(spark, ("2020", "t", "A", 30), ("2021", "t", "B", 30)) == []  # the former leader is gone: a new name
    assert changes(spark, ("2020", "t", "ของ A", 30), ("2021", "t", "A", 30), ("2021", "t", "ของ A", 9)) == []  # one body
    assert changes(spark, ("2020", "t", "A", 12), ("2020", "t", "B", 2), ("2021", "t", "A", 2), ("2021", "t", "B", 12)) == []  # thin years
    assert changes(spark, ("2020", "t", "A", 30), ("2020", "t", "B", 9), ("2023", "t", "B", 30), ("2023", "t", "A", 9)) == []  # a part year
    # gates come after the last change is picked
    rows = [("2020", "t", "A", 30), ("2020", "t", "B", 9), ("2021", "t", "B", 30), ("2021", "t", "A", 9), ("2022", "t", "C", 30)]
    assert changes(spark, *rows) == []


def test_overlaps_are_minima_of_shared_topics(spark):
    counts = spark.createDataFrame([("t", "ก", 10), ("t", "ข", 4), ("u", "ค", 99)], "topic string, agency string, n long")
    got = {(r.agency, r.other): r.n for r in authority.overlaps(counts, counts, counts.select("agency").distinct()).collect()}
    assert got == {("ก", "ข"): 4, ("ข", "ก"): 4}


def test_pairs_and_neighbours(spark):
    labels = spark.createDataFrame([(1, "b", 0.9, False), (1, "a", 0.1, True), (1, "a", 0.2, True), (1, "c", 0.2, False), (2, "a", 1.0, True), (2, "b", 1.0, True), (3, "a", 1.0, True)], "id int, slug string, weight double, corroborated boolean")
    pairs = graph.label_pairs(graph.eligible(labels))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 2)]
    tree = spark.createDataFrame([("a", None), ("b", "a")], "slug string, parent string")
    got = sorted((r.node, r.other, r.n, r.kin) for r in graph.neighbours(graph.view(pairs.withColumn("kind", F.lit("topic")), tree, 1)).collect())
    assert got == [("a", "b", 2, True), ("b", "a", 2, True)]


def test_citations_find_the_record_of_a_page(spark):
    recs = spark.createDataFrame(
        [("r1", "2024-01-01", 141, "1 ง", 1), ("r2", "2024-01-01", 141, "1 ง", 5), ("r3", "2024-01-02", 141, "1 ง", 5), ("n1", "2024-01-01", 141, "2 ง", None), ("s1", "2024-01-01", 141, "3 ง พิเศษ", 9)],
        "id string, date string, volume int, part string, page int",
    )
    cites = spark.createDataFrame([(1, 141, "1 ง", 4), (2, 141, "1 ง", 7), (3, 141, "1 ง", 0), (4, 141, "1 ง", None), (5, 141, "2 ง", 3), (6, 141, "3 ง", 9), (7, 1, "1 ง", 1)], "cite int, volume int, part string, page int")
    got = {r.cite: r.id for r in lookup.resolve(cites, recs).collect()}
    assert got == {1: "r1", 2: "r3", 3: "r1", 4: "r1", 5: "n1", 6: "s1"}
    near = {r.id: (r.previous, r.next) for r in lookup.neighbours_in_issue(recs).collect()}
    assert near["r1"] == (None, "r2") and near["r3"] == ("r1", None)
    assert [tuple(r) for r in lookup.siblings(recs, recs.where("id = 'r2'").select("id")).orderBy("rank").collect()] == [("r2", "r1", 1, 1), ("r2", "r3", 5, 2)]


def test_substring_search_is_exact(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the quick brown fox", "quick thinking", "brownish", "a fox", "", None, "xy", "quick brown 😀 fox"])], "doc_id long, text string")
    qs = ["quick", "brown", "fox", "xy", "zzz", "😀 f", "quick b"]
    got = sorted((r.q, r.doc_id) for r in search.substring_search(spark.createDataFrame([(q,) for q in qs], "q string"), docs, search.trigram_index(docs), drop_df=1).collect())
    assert got == sorted((q, r.doc_id) for r in docs.collect() for q in qs if q in (r.text or ""))


def test_entities_rank_beginnings_first(spark):
    dims = spark.createDataFrame([("topic", 1, "electric power", 5), ("topic", 1, "all electric", 50), *[("agency", 3, f"electric {i}", i) for i in range(6)]], "kind string, kind_order int, name string, n long")
    got = [r.name for r in search.entities(spark.createDataFrame([("elec tric",), ("",)], "q string"), dims).orderBy("rank").collect()]
    assert got == ["electric power", "electric 5", "electric 4", "electric 3", "electric 2", "all electric"]


def test_checks_find_what_is_wrong(spark):
    recs = spark.createDataFrame([("2020-1", "2020", "2020-01", "2020-01-01", 1, "a", 1), ("2021-1", "2020", "2020-01", "1946-02-29", 9, "a", 1), ("2020-1", "2020", "2020-02", "1970-01-01", 1, "a", 3)], "id string, year string, month string, date string, volume int, part string, page int")
    assert quality.duplicates(recs, ["id"]).collect()[0].actual == "2"
    assert quality.dates_valid(recs).count() == 2 and quality.id_year(recs).count() == 1
    assert quality.year_matches(recs, 2019).count() == 1 and quality.one_date_per_issue(recs).count() == 1
    index = spark.createDataFrame([("f", 0, 5), ("f", 5, 5), ("f", 11, 1)], "file string, offset long, length long")
    assert [(r.expected, r.actual) for r in quality.bytes_accounted(index).collect()] == [("10", "11")]
    assert quality.columns_present(recs, ["id", "none"], "recs").count() == 1
    budget = spark.createDataFrame([("x", 5)], "name string, most long")
    assert quality.within_budget(spark.createDataFrame([("x", 6), ("y", 1)], "name string, n long"), budget).count() == 2
    assert quality.suspected_tests(recs.withColumn("title", F.lit("TEST")), "(?i)^test").where("suspect").count() == 3
    maps = spark.createDataFrame([({"b": 1, "a": 2},), ({"a": 1},)], "m map<string,int>")
    assert {r["keys"]: r.n for r in quality.key_shapes(maps, "m").collect()} == {"a,b": 1, "a": 1}
    other = recs.select("id", "date").limit(1).withColumn("date", F.lit("2020-01-04"))
    assert [r.days for r in quality.layers_differ(recs.select("id", "date").limit(1), other, "id", "date").collect()] == [-3]
    assert quality.marker_share(recs, "volume", F.col("page") > 1).count() == 2


def test_counts_of_texts_are_those_of_postings(spark):
    texts = ["the quick brown fox", "quick \x00thinking 😀 quick", "", None, "ab", "quick brown 😀 foxes"]
    docs = spark.createDataFrame([(i * 100_000, texts[i % len(texts)]) for i in range(30)], "doc_id long, text string")
    index, rows = search.trigram_index(docs), lambda df: sorted(map(tuple, df.collect()))
    assert rows(search.document_stats(docs)) == rows(search.gram_stats(index)) != []
    assert rows(search.document_bitmaps(docs)) == rows(search.bitmap_index(index)) != []


def test_long_queries_meet_texts_by_anchors(spark, capsys):
    passage = "a passage 😀 of many signs that goes on, ends here"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([passage, "x" + passage[3:], passage[:23], passage[:24], None, "y" * 60, passage * 3])], "doc_id long, text string")
    qs = [passage, passage[3:30], passage[:24], passage[:23], passage[5:], "y" * 24, passage[20:] + passage[:5]]
    found = search.substring_search(spark.createDataFrame([(q,) for q in qs], "q string"), docs, search.trigram_index(docs), drop_df=0)
    assert sorted(map(tuple, found.collect())) == sorted((q, r.doc_id) for r in docs.collect() for q in qs if q in (r.text or ""))
    found.explain()
    assert "anchor" in capsys.readouterr().out
