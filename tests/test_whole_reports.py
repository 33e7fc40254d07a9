"""Queries over whole tables, against brute force."""

from collections import defaultdict

from pyspark.sql import functions as F

from facetra.operators import lookup
from facetra.plans import report_queries as rq
from facetra.sources import tables


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_every_citation_is_resolved(spark, sf_dir):
    issues = defaultdict(list)
    for r in tables.records(spark, sf_dir, with_topics=False).select("volume", "part", "page", "date", "id").collect():
        issues[r.volume, r.part].append((r.page, r.date, r.id))
    want = []
    for o in tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").collect():
        k = o.o_orderkey
        rows = issues[o.o_orderdate.year - 1994, o.o_orderpriority]
        before = [r for r in rows if k % 11 and r[0] <= k * 7 % 520]
        want.append((o.o_custkey * 100000 + k, (max(before) if before else min(rows))[2]))
    got = pairs(rq.citations_as_of(spark, sf_dir))
    assert got == sorted(want) and len(got) == tables.table(spark, sf_dir, "orders").count()


def test_ids_find_months_of_every_year(spark, sf_dir):
    span = defaultdict(list)
    for r in tables.records(spark, sf_dir, with_topics=False).select("month", "id").collect():
        span[r.month].append(r.id)
    ids = [r.c_custkey for r in tables.table(spark, sf_dir, "customer").select("c_custkey").collect()]
    got = pairs(rq.months_of_ids(spark, sf_dir))
    assert got == sorted((i, m) for i in ids for m, own in span.items() if min(own) <= i <= max(own))
    assert {m[:4] for _, m in got} > {"1996"}


def test_whole_items_are_searched(spark, sf_dir, tmp_path):
    item = "It starts here and goes on for a while, then tells something quite different at its very end: 😀 zebra."
    items = [(1, item), (2, "short"), (3, item[:80]), (4, ""), (5, None)]
    docs = [(10, "said: " + item[55:]), (11, item), (12, "a short one"), (13, item[:50]), (14, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in items:
        for k, at in enumerate(range(0, len(t or ""), 40)):
            q = t[max(0, min(at, len(t) - 40)) :][:40]
            want += [(i, k, q, j) for j, text in docs if q in (text or "")]
    got = pairs(rq.substring_search(spark, str(tmp_path)))
    assert got == sorted(want) and (1, 2, item[-40:], 10) in got


def test_siblings_are_ranked_without_sorting_pairs(spark, monkeypatch, capsys):
    monkeypatch.setattr(lookup, "LISTED", 3)  # several lists an issue
    rows = [(i, i % 3 or None, "ab"[i % 2], i * 7 % 5 or None) for i in range(60)]
    recs = spark.createDataFrame(rows, "id int, volume int, part string, page int")
    found = lookup.siblings(recs, recs.where("id % 4 = 0").select("id"))
    want = []
    for of, volume, part, _ in rows[::4]:
        others = sorted((r[3] or 0, r[0], r[3]) for r in rows if volume is not None and r[1:3] == (volume, part) and r[0] != of)
        want += [(of, i, page, rank) for rank, (_, i, page) in enumerate(others, 1)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    found.agg(F.count("rank")).explain()
    assert "row_number" not in capsys.readouterr().out


def test_pairs_of_siblings_take_little_room(spark, tmp_path):
    n, every = 8_004, 4  # 2,001 wanted ones: an odd number of bits, however many each of them takes
    recs = spark.range(n).selectExpr("cast(id AS int) AS id", "1 AS volume", "'a' AS part", "cast(id % 500 AS int) AS page")
    lookup.siblings(recs, recs.where(f"id % {every} = 0").select("id")).write.parquet(f"{tmp_path}/pairs")
    rows, pairs = spark.read.parquet(f"{tmp_path}/pairs"), n // every * (n - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * pairs
    ranks = rows.groupBy("of").agg(F.count("id").alias("n"), F.sum("rank").alias("s"), F.min("rank").alias("a"), F.max("rank").alias("z"))
    assert [tuple(r) for r in ranks.select("n", "s", "a", "z").distinct().collect()] == [(n - 1, n * (n - 1) // 2, 1, n - 1)]
    assert rows.count() == pairs
