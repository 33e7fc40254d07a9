"""Versioned tables, the month sink, feed files, sources under one contract, lanes and cuboids."""

import os
import threading

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from facetra import storage
from facetra.operators import crossfilter as cf
from facetra.operators import cuboid, lookup, ordered, quality, search, trends
from facetra.plans import feed_files, publish, versions
from facetra.sources import contract, synthetic, tables


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def numbers(spark, n, month="2024-01"):
    return spark.range(n).select("id", F.lit(month[:4]).alias("year"), F.lit(month).alias("month"), F.format_string("%s-%02d", F.lit(month), F.col("id") % 28 + 1).alias("date"))


def test_a_month_is_many_files_in_order(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = numbers(spark, 8000).unionByName(numbers(spark, 50, "2024-02"))
    publish.write_months(rows, path, per_file=1000)
    back = versions.read_table(spark, path)
    assert pairs(back) == pairs(rows.select(*back.columns))
    files = back.where("month = '2024-01'").withColumn("f", F.input_file_name()).groupBy("f").agg(F.min(F.struct("date", "id")).alias("lo"), F.max(F.struct("date", "id")).alias("hi"), F.count("*").alias("n"))
    found = files.orderBy("f").collect()
    assert len(found) >= 8 and max(r.n for r in found) < 2000
    assert all(a.hi < b.lo for a, b in zip(found, found[1:], strict=False))  # files follow each other


def test_a_late_month_is_replaced_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    publish.write_months(numbers(spark, 100).unionByName(numbers(spark, 90, "2024-02")).unionByName(numbers(spark, 80, "2023-12")), path, per_file=30)
    folder = versions.current(spark, path)["parts"][0]["folder"]
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t" / folder).rglob("*.parquet")}
    publish.write_months(numbers(spark, 110, "2024-02"), path, per_file=30, late=True)
    count = lambda: dict(pairs(versions.read_table(spark, path).groupBy("month").count()))
    assert count() == {"2023-12": 80, "2024-01": 100, "2024-02": 110}
    assert before == {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t" / folder).rglob("*.parquet")}
    publish.write_months(numbers(spark, 7, "2024-02").unionByName(numbers(spark, 5, "2022-01")), path, late=True)  # again, and a new month
    assert count() == {"2022-01": 5, "2023-12": 80, "2024-01": 100, "2024-02": 7}
    plan = versions.read_table(spark, path).where("month = '2024-02'")
    assert plan.count() == 7
    versions.compact(spark, path)
    assert count() == {"2022-01": 5, "2023-12": 80, "2024-01": 100, "2024-02": 7} and len(versions.current(spark, path)["parts"]) == 1
    gone = versions.vacuum(spark, path, keep=1)
    assert len(gone) == 3 and sum(count().values()) == 192
    with pytest.raises(ValueError):
        versions.publish(numbers(spark, 1).drop("date"), path, ("year", "month"), update=True)


@pytest.mark.parametrize("step", ["save", "create", "half"])
def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/t"
    publish.write_table(spark.range(5), path)

    class Died(Exception):
        pass

    def half(spark, path, manifest):
        (tmp_path / "t/manifests" / f"{manifest['number']:012d}.json").write_text('{"kind": "par')
        raise Died

    def dead(*args):
        raise Died

    if step == "save":
        broken = spark.range(9).select(F.assert_true(F.col("id") < 8), "id")
        with pytest.raises(Exception, match="USER_RAISED|assert|false"):
            publish.write_table(broken.select("id", F.raise_error(F.lit("USER_RAISED")).cast("string")), path)
    else:
        monkeypatch.setattr(versions, "_create", half if step == "half" else dead)
        with pytest.raises(Died):
            publish.write_table(spark.range(9), path)
        monkeypatch.undo()
    reader = versions.read_table(spark, path)
    assert reader.count() == 5
    publish.write_table(spark.range(3), path)
    assert versions.read_table(spark, path).count() == 3
    assert reader.count() == 5  # begun before, goes on with what it found
    versions.vacuum(spark, path, keep=1, orphan_hours=0)
    assert versions.read_table(spark, path).count() == 3 and len(os.listdir(tmp_path / "t/data")) == 1


def test_writers_side_by_side_both_count(spark, tmp_path):
    path = f"{tmp_path}/t"
    publish.write_months(numbers(spark, 10), path)
    failed = []

    def late(month, n):
        try:
            publish.write_months(numbers(spark, n, month), path, late=True)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=late, args=(f"2024-{m:02d}", m)) for m in (2, 3, 4, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert dict(pairs(versions.read_table(spark, path).groupBy("month").count())) == {"2024-01": 10, "2024-02": 2, "2024-03": 3, "2024-04": 4, "2024-05": 5}


def test_null_partitions_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, k string")
    versions.publish(df, f"{tmp_path}/n", ("k",))
    versions.publish(spark.createDataFrame([(9, None)], "n int, k string"), f"{tmp_path}/n", ("k",), update=True)
    assert pairs(versions.read_table(spark, f"{tmp_path}/n").select("n", "k")) == [(1, "a"), (3, "b"), (9, None)]
    publish.write_table(df.limit(0), f"{tmp_path}/e")
    assert versions.read_table(spark, f"{tmp_path}/e").collect() == []
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, f"{tmp_path}/none")


def entries(spark, rows):
    return spark.createDataFrame(rows, "kind string, feed_id string, rank int, id string, date string, entry string")


def test_feed_files_are_written_and_read_back(spark, tmp_path):
    feed_files.register(spark)
    path = f"file://{tmp_path}/feeds"
    rows = [("series", "series/a b", 1, "2", "2024-01-02", 'x < & > " y\nz'), ("series", "series/a b", 2, "1", None, "é 😀"), ("series", "series/a_b", 1, "3", "2024", "t"), ("all", "all", 1, "9", None, "")]
    feed_files.feed_rows(entries(spark, rows)).repartition(3).write.format("feed_files").mode("overwrite").save(path)
    read = lambda: spark.read.format("feed_files").load(path)
    back = read()
    assert pairs(back.withColumn("entry", F.coalesce("entry", F.lit("")))) == sorted(rows, key=str)
    names = sorted(os.listdir(tmp_path / "feeds"))
    assert len(names) == 3 and all(n.endswith(".xml") for n in names)  # no staging folder is left, feeds alike in name are apart
    (tmp_path / "feeds" / next(n for n in names if n.startswith("all"))).write_text("not XML")
    assert back.where("kind = 'series'").count() == 3 and back.where("kind in ('series', 'x')").count() == 3  # that file is not opened
    feed_files.feed_rows(entries(spark, rows[2:3])).write.format("feed_files").mode("overwrite").save(path)
    assert [r.feed_id for r in read().collect()] == ["series/a_b"]
    feed_files.feed_rows(entries(spark, rows[3:])).write.format("feed_files").mode("append").save(path)
    assert sorted(r.feed_id for r in read().collect()) == ["all", "series/a_b"]


def test_a_failed_feed_job_leaves_every_feed_as_it_was(spark, tmp_path):
    feed_files.register(spark)
    path = f"file://{tmp_path}/feeds"
    rows = [("series", f"series/{i}", 1, "1", None, "old") for i in range(6)]
    feed_files.feed_rows(entries(spark, rows)).write.format("feed_files").mode("overwrite").save(path)
    fresh = feed_files.feed_rows(entries(spark, [(*r[:5], "new") for r in rows])).repartition(3)
    bad = fresh.withColumn("kind", F.when(F.col("feed_id") == "series/5", F.raise_error(F.lit("broken"))).otherwise(F.col("kind")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("feed_files").mode("overwrite").save(path)
    with pytest.raises(Exception, match="two rows of one feed"):
        fresh.union(fresh).write.format("feed_files").mode("overwrite").save(path)
    back = spark.read.format("feed_files").load(path).collect()
    assert {r.entry for r in back} == {"old"} and len(back) == 6


def test_sources_share_a_contract(spark, sf_dir):
    made, star = contract.Generated(2023, 2025, 10), contract.StarTables(sf_dir)
    assert made.years(spark) == ["2023", "2024", "2025"] and made.load(spark, "2024").count() == 20
    rows = contract.together(spark, [made, contract.Generated(2024, 2024, 5, name="more")], "2024")
    assert dict(pairs(rows.groupBy("source").count())) == {"generated": 20, "more": 10}
    assert dict(rows.dtypes)["page"] == "int" and rows.columns == [*contract.COMMON, "source"]
    listed = {r.id: r for r in contract.listing(spark, [made, star]).collect()}
    assert listed["generated"].docs == 60 and listed["generated"].title == "Generated records" and listed["star"].docs == tables.records(spark, sf_dir).count()
    with pytest.raises(ValueError, match="no such years: 2022"):
        made.load(spark, "2022-2023")
    with pytest.raises(ValueError, match="two sources"):
        contract.together(spark, [made, made])

    class Bare(contract.Generated):
        def records(self, spark, years):
            return super().records(spark, years).drop("agency", "page")

    with pytest.raises(ValueError, match="lacks agency, page"):
        Bare(2024, 2024).load(spark)
    assert {"environment", "pollution"} <= {r.slug for r in made.topics(spark).collect()}


def test_runs_side_by_side_keep_their_tables(spark):
    wrong = []

    def run(k):
        try:
            at = storage.mark()
            for i in range(3):
                t = storage.stored(spark.range(k + i), f"t{k}")
                assert t.count() == k + i
                storage.clean(at, t)
                assert t.count() == k + i
            storage.clean(at)
        except Exception as e:
            wrong.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in (5, 50, 500)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not wrong


def test_derived_tables_follow_their_source(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/a.parquet")
    build = lambda: spark.read.parquet(f"{tmp_path}/a.parquet").withColumn("x", F.col("id") * 2)
    got = lambda: storage.derived(spark, "doubled", str(tmp_path), build)
    assert got().count() == 4 and got().inputFiles() == got().inputFiles()
    spark.range(7).write.mode("overwrite").parquet(f"{tmp_path}/a.parquet")
    assert got().count() == 7


def test_neighbours_and_running_sums_across_lanes(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 501 * 3).alias("at"), (F.col("id") % 11).alias("v"))
    rows = rows.withColumn("g", F.when(F.col("g") < 2, F.col("g")))  # a null group too
    w = Window.partitionBy("g").orderBy("at")
    plain = rows.select("g", "at", F.lag("v").over(w).alias("p"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    for width in (1, 10, 10**6):
        a = ordered.with_previous(rows, ["g"], "at", F.col("v"), "p", width)
        b = ordered.with_running(rows, ["g"], "at", "v", "s", width)
        assert pairs(a.select("g", "at", "p")) == pairs(plain.select("g", "at", "p"))
        assert pairs(b.select("g", "at", "s")) == pairs(plain.select("g", "at", "s"))


def test_places_in_a_whole_order(spark):
    rows = spark.range(1000).select((F.col("id") % 17).alias("n"), F.col("id").cast("string").alias("k"))
    got = ordered.numbered(rows, [F.desc("n"), "k"], "place", per_task=90).collect()
    want = sorted(((r.n, r.k) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert {(r.n, r.k): r.place for r in got} == {x: i for i, x in enumerate(want, 1)}
    assert ordered.numbered(rows.limit(0), ["n"], "place").count() == 0


@pytest.mark.parametrize("lanes", [2, 4, 256])
def test_cuts_are_exact_whatever_the_lanes(spark, lanes):
    for values in ([5] * 40 + [1, 2, 3], list(range(100)), [0, -3, 7], []):
        df = spark.createDataFrame([(v,) for v in values], "n long")
        positive = sorted(v for v in values if v > 0)
        want = [(i, positive[i * len(positive) // 5]) for i in range(1, 5)] if positive else []
        assert pairs(trends.quantile_cuts(df, lanes=lanes)) == want


def test_order_checks_see_across_lanes(spark):
    rows = spark.createDataFrame([(f"{i:06d}", "m", i, f"2024-01-{1 + i // 40000:02d}") for i in range(0, 200000, 500)], "id string, month string, position long, date string")
    swapped = rows.withColumn("date", F.when(F.col("position") == 65500, "2024-02-01").otherwise(F.col("date")))  # the last of its lane
    assert quality.sorted_within(rows).count() == 0 and [r.key for r in quality.sorted_within(swapped).collect()] == ["066000"]
    index = spark.createDataFrame([("f", i << 20, 1 << 20) for i in range(200)], "file string, offset long, length long")
    assert quality.bytes_accounted(index).count() == 0
    holed = index.where(f"offset <> {64 << 20}")  # the first of its lane
    assert [(r.expected, r.actual) for r in quality.bytes_accounted(holed).collect()] == [(str(64 << 20), str(65 << 20))]


def test_id_ranges_in_buckets(spark):
    ranges = spark.createDataFrame([("2024", f"m{i}", i * 100, i * 137 + 60) for i in range(30)], "year string, month string, lo long, hi long")
    ids = spark.range(-50, 5000, 7)
    want = sorted((i, r.month) for i in range(-50, 5000, 7) for r in ranges.collect() if r.lo <= i <= r.hi)
    for buckets in (1, 16, 1024):
        got = lookup.months_of(ids, ranges, "id", buckets)
        assert pairs(got) == sorted(want, key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert lookup.months_of(ids, ranges.limit(0)).count() == 0


def test_months_of_three_kinds_of_ids(spark):
    records = spark.createDataFrame([("2023", "2023-01", "2023-000010"), ("2023", "2023-01", "2023-000020"), ("2023", "2023-02", "2023-000015"), ("2023", "2023-02", "2023-000030"), ("2024", "2024-05", "2024-05-03-00000001")], "year string, month string, id string")
    ranges = lookup.id_ranges(records)
    asked = spark.createDataFrame([(x,) for x in ("2024-05-03-00000001", "2023-000017", "2023-000025", "2023-000099", "1999-000001", "", "x", None)], "id string")
    got = {}
    for r in lookup.shards(asked, ranges).collect():
        got.setdefault((r.id, r.how), []).append(r.month)
    assert got == {("2024-05-03-00000001", "carried"): ["2024-05"], ("2023-000017", "range"): ["2023-01", "2023-02"], ("2023-000025", "range"): ["2023-02"], ("2023-000099", "year"): ["2023-01", "2023-02"]}
    stale = spark.createDataFrame([("2023", "2023-01", "2023-000010", "2023-000030"), ("2023", "2023-02", "2023-000031", "2023-000040")], "year string, month string, lo string, hi string")
    found = lookup.fetched(spark.createDataFrame([("2023-000015",), ("2023-000020",), ("2023-000099",)], "id string"), stale, records.drop("year"))
    assert pairs(found.select("id", "month")) == [("2023-000015", "2023-02"), ("2023-000020", "2023-01")]


def test_named_records_and_pages_lead_the_search(spark):
    dims = spark.createDataFrame([("topic", 1, "2024 budget", 5), ("agency", 3, "Bureau 12", 9), ("agency", 3, "12", 1), ("agency", 3, "Ab", 7), ("topic", 1, "ab", 2)], "kind string, kind_order int, name string, n long")
    asked = spark.createDataFrame([(q,) for q in ("2024-001232", " 2026-09-10-00125805 ", "12", "b", "120/12 ก/5", "2024-1232", "zzz", "", " ", "BUREAU", "u 1")], "q string")
    got = {}
    for r in sorted(search.entities(asked, dims).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.q, []).append((r.kind, r.name))
    assert got.pop("120/12 ก/5")[0][0] == "citation"
    assert got == {
        "2024-001232": [("document", "2024-001232")], " 2026-09-10-00125805 ": [("document", "2026-09-10-00125805")], "12": [("agency", "12"), ("agency", "Bureau 12")],
        "b": [("topic", "2024 budget"), ("topic", "ab"), ("agency", "Ab")], "u 1": [("agency", "Bureau 12")],
    }
    assert "NestedLoop" not in search.entities(asked, dims)._jdf.queryExecution().executedPlan().toString()


def test_cut_names_meet_by_equality(spark):
    counts = spark.createDataFrame([("min", 2), ("mini", 1), ("ministry", 50), ("minister", 60), ("m", 9), ("ministry", 1), ("x", 1), ("y", 99)], "key string, n long").groupBy("key").agg(F.max("n").alias("n"))
    found = quality.names_cut_short(counts, rare=5, frequent=20)
    assert pairs(found.select("key", "expected", "actual")) == [("min", "minister", "2"), ("mini", "minister", "1")]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_cuboid_gives_what_the_records_give(spark):
    recs = synthetic.records(spark, [2023, 2024]).withColumn("province", F.when(F.col("page") > 3, F.col("province")))
    cube = cuboid.Cuboid(("action", "govlevel", "province"))
    counts = cube.build(recs).cache()
    dims = ("year", "month", *cube.dims)
    for f in (cf.Filters(), cf.Filters(equal={"action": "rule"}), cf.Filters(equal={"province": "province 3", "year": "2024"}, months=("2024-01",)), cf.Filters(months=())):
        rows, spec, weight = cuboid.source(cube, counts, recs, f, dims)
        assert rows is counts
        assert pairs(cf.cross_filter(rows, f, spec, dims, weight)) == pairs(cf.cross_filter(recs, f, dims=dims))
        assert pairs(cf.grouped(rows, f, ["action", "province"], spec, weight)) == pairs(cf.grouped(recs, f, ["action", "province"]))
    for f, by in ((cf.Filters(text="rule"), []), (cf.Filters(day="2024-01-01"), []), (cf.Filters(equal={"agency": "court"}), []), (cf.Filters(), ["topic"]), (cf.Filters(topics=("a",)), []), (cf.Filters(below="x"), [])):
        assert cuboid.source(cube, counts, recs, f, by)[0] is recs


def test_toggled_citations_in_one_pass(spark):
    records = spark.createDataFrame([(1, 5, "3 ก", 4, "2024"), (2, 5, "3 ก", 9, "2024"), (3, 5, "4 ก พิเศษ", None, "2023"), (4, 5, "4 ก พิเศษ", None, None)], "id long, volume int, part string, page int, date string")
    cites = spark.createDataFrame([("a", 5, "3 ก", 8), ("b", 5, "3 ก พิเศษ", 99), ("c", 5, "3 ก", None), ("d", 5, "4 ก", 2), ("e", 5, "9 ก", 1), ("f", 5, "3 ก", 1), ("g", None, "3 ก", 1)], "cite string, volume int, part string, page int")
    assert pairs(lookup.as_of(cites, records)) == [("a", 1), ("c", 1), ("f", 1)]
    assert pairs(lookup.resolve(cites, records)) == [("a", 1), ("b", 2), ("c", 1), ("d", 4), ("f", 1)]
