import pytest
from pyspark.sql import functions as F

from facetra.operators import crossfilter as cf
from facetra.operators import encode, facets, hierarchy
from facetra.specs import GAZETTE, CorpusSpec, FacetSpec

SCHEMA = "id string, date string, month string, year string, topic string, topic_c boolean, action string, action_c boolean, govlevel string, govlevel_c boolean, agency string, province string, title string, page int, volume int, part string"


def six(spark):
    rows = [
        ("a1", "2023-01-02", "2023-01", "2023", "waste", True, "rule", True, "central", True, "A", "p1", "a waste rule", 1, 140, "1 ง"),
        ("a2", "2023-01-02", "2023-01", "2023", "environment", True, "rule", False, "central", True, "A", "p2", "air", 2, 140, "1 ง"),
        ("a3", "2023-01-09", "2023-01", "2023", "transport", False, "notice", True, "local", False, "B", "p1", "roads", None, 140, "2 ง"),
        ("b1", "2023-02-01", "2023-02", "2023", "waste", True, "notice", True, "local", True, "B", None, "w a ste", 4, 140, "2 ง"),
        ("c1", None, "2024-07", "2024", None, False, None, False, None, False, None, None, None, None, 141, "1 ง"),
        ("c2", "2024-07-05", "2024-07", "2024", "transport", True, "rule", True, "central", True, "A", "p1", "roads again", 5, 141, "1 ง"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def tree(spark):
    return spark.createDataFrame([("environment", "Environment", None), ("waste", "Waste", "environment"), ("transport", "Transport", None)], "slug string, name string, parent string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_closure_rolls_up_and_refuses_cycles(spark):
    c = hierarchy.closure(tree(spark))
    assert rows(c) == [("environment", "environment", 0), ("transport", "transport", 0), ("waste", "environment", 1), ("waste", "waste", 0)]
    assert rows(hierarchy.roots(c)) == [("environment", "environment", 0), ("transport", "transport", 1), ("waste", "environment", 0)]
    with pytest.raises(Exception, match="cycle"):
        hierarchy.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "slug string, parent string")).collect()
    chain = [("n0", None), *[(f"n{i}", f"n{i - 1}") for i in range(1, 13)]]
    assert hierarchy.closure(spark.createDataFrame(chain, "slug string, parent string")).count() == 13 * 14 // 2
    assert rows(hierarchy.descendants(c, ["environment"])) == [("environment",), ("waste",)] and rows(hierarchy.descendants(c, [])) == []


def test_only_trusted_labels_count_and_roots_sum_to_the_total(spark):
    df, c = six(spark), hierarchy.closure(tree(spark))
    got = {(r.key, r.dim, r.value): r.n for r in facets.topic_facets(df, c).collect()}
    assert got["environment", "total", ""] == 3 and got["waste", "total", ""] == 2 and got["transport", "total", ""] == 1
    assert got["environment", "topic", "waste"] == 2 and ("environment", "action", "rule") in got and got["environment", "action", "rule"] == 1
    roots = sum(n for (k, dim, _), n in got.items() if dim == "total" and k in ("environment", "transport"))
    assert roots == df.where("topic_c").count()


def test_counts_do_not_depend_on_partitions(spark):
    df, c = six(spark), hierarchy.closure(tree(spark))
    assert rows(facets.topic_facets(df.repartition(5), c)) == rows(facets.topic_facets(df.coalesce(1), c))


def test_crossfilter_counts_equal_filtered_counts(spark):
    df = six(spark)
    f = cf.Filters(equal={"action": "rule", "agency": "A"}, day_from="2023-01-01")
    got = {(r.facet, r.value): r.n for r in cf.cross_filter(df, f).collect()}
    assert got["total", ""] == cf.matching(df, f).count() == 2
    for value in ("rule", "notice"):
        own = cf.Filters(equal={"action": value, "agency": "A"}, day_from="2023-01-01")
        assert got.get(("action", value), 0) == cf.matching(df, own).count()
    assert ("month", "2023-01") in got and got["agency", "A"] == 2


def test_filters_that_match_nothing(spark):
    df = six(spark)
    for f in (cf.Filters(topics=()), cf.Filters(months=()), cf.Filters(equal={"province": "nowhere"}), cf.Filters(day="2024-07-06")):
        assert cf.matching(df, f).count() == 0
        assert not [r for r in cf.cross_filter(df, f).collect() if r.facet == "total"]
    assert cf.matching(df, cf.Filters()).count() == 6
    assert [r.id for r in cf.matching(df, cf.Filters(text="waste")).orderBy("id").collect()] == ["a1", "b1"]
    with pytest.raises(ValueError):
        cf.matching(df, cf.Filters(equal={"colour": "red"})).count()


def test_newest_latest_and_recent(spark):
    df = six(spark)
    assert [r.id for r in facets.newest(df, None, 3).collect()] == ["c2", "b1", "a3"]
    assert [r.id for r in facets.latest(df, 2).collect()] == ["c2", "b1"]
    whole = [r.id for r in facets.latest(df, 90).collect()]
    assert [r.id for r in facets.recent(df, 3).collect()] == whole[:3]
    day = facets.newest_day(df, {"rules": GAZETTE.dim("action").equals("rule")}).collect()[0]
    assert (day.date, day.n, day.rules, day.first_volume) == ("2024-07-05", 1, 1, 141)
    runs = facets.day_runs(df, df)
    assert {r.id for r in runs.where("new_day AND date IS NOT NULL").collect()} == {"a1", "a3", "b1", "c2"}


def test_codes_positions_and_months_agree_with_records(spark):
    df = six(spark)
    codes = encode.dictionary(df, "agency")
    back = encode.encoded(df, "agency", codes).join(codes, F.col("agency_code") == F.col("code"), "left")
    assert back.where(~F.col("agency").eqNullSafe(F.col("value"))).count() == 0
    assert [r.id for r in encode.positions(df).orderBy("position").collect()] == ["a1", "a2", "a3", "b1", "c1", "c2"]
    assert rows(encode.month_directory(df)) == [("2023-01", 0, 3), ("2023-02", 3, 1), ("2024-07", 4, 2)]
    with pytest.raises(Exception, match="over 1 values"):
        encode.dictionary(df, "agency", 1).collect()


def test_specs_check_columns(spark):
    spec = CorpusSpec(facets=(FacetSpec("colour", "colour"),))
    with pytest.raises(ValueError):
        spec.check(six(spark))
    assert GAZETTE.check(six(spark)) is not None


def test_rows_of_many_keys_are_dealt_to_tasks(spark, sf_dir, monkeypatch):
    from facetra.operators import facets
    from facetra.sources import tables

    monkeypatch.setattr(facets, "PER_TASK", 200)
    rec = tables.records(spark, sf_dir)
    dealt, plain = facets.facet_counts(rec, "agency", many=True), facets.facet_counts(rec, "agency")
    assert "RepartitionByExpression" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
