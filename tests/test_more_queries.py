"""Operators behind the column and check queries, on small inputs and against brute force."""

import re

from pyspark.sql import functions as F

from facetra.operators import crossfilter as cf
from facetra.operators import encode, facets, hierarchy, lookup, quality
from facetra.plans import column_queries, publish
from facetra.sources import tables


def previewed(text, budget=400, least=50):
    shown, used = [], 0
    for p in (x.strip() for x in re.split(r"\n\s*\n", text or "")):
        if not p:
            continue
        room = budget - used
        if len(p) <= room:
            shown.append(p)
            used += len(p)
            continue
        if room > least:
            at = p[: room + 1].rfind("\n")
            shown.append(p[:at] if at > least else p[:room])
        break
    return "\n\n".join(shown)


def test_previews_match_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in tables.table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r.shown or "" for r in column_queries.text_previews(spark, sf_dir).collect()}
    assert got == {i: previewed(t) for i, t in texts.items()}


def test_filters_over_fields_and_marked_topics(spark):
    rows = spark.createDataFrame([(1, "a b", "x", "t/1", True), (2, "c", "ab", "t/2", True), (3, None, None, "u", True), (4, "ab", None, "t/1", False)], "id int, title string, agency string, topic string, topic_c boolean")
    both = cf.Filters(text="a b", fields=("title", "agency"))
    assert {r.id for r in rows.where(both.predicates()["text"]).collect()} == {1, 2, 4}
    assert {r.id for r in rows.where(cf.Filters(text="cab", fields=("title", "agency")).predicates()["text"]).collect()} == {2}
    tree = spark.createDataFrame([("t", None), ("t/1", "t"), ("t/2", "t"), ("u", None)], "slug string, parent string")
    marked = hierarchy.marked(rows, hierarchy.closure(tree), ["t"])
    assert {r.id for r in marked.where(cf.Filters(below="below").predicates()["topic"]).collect()} == {1, 2}
    assert marked.count() == 4


def test_panels_show_root_topics_only(spark):
    counts = spark.createDataFrame([("topic", "t", 9), ("topic", "t/1", 9), *[("agency", f"a{i}", i) for i in range(12)]], "dim string, value string, n long")
    got = facets.panels(counts, spark.createDataFrame([("t",)], "slug string")).collect()
    assert [r.value for r in got if r.dim == "topic"] == ["t"] and sorted(r.n for r in got if r.dim == "agency") == list(range(4, 12))


def test_positions_go_to_months_and_back(spark):
    rows = spark.createDataFrame([(i, f"2020-0{1 + i % 3}", f"2020-0{1 + i % 3}-{1 + i % 5:02d}" if i % 7 else None) for i in range(60)], "id int, month string, date string")
    order = sorted(rows.collect(), key=lambda r: (r.month, r.date or "", r.id))
    found = encode.positions(rows)
    assert {r.id: r.position for r in found.collect()} == {r.id: k for k, r in enumerate(order)}
    back = encode.months_of_positions(found.select("id", "position"), encode.month_directory(rows)).collect()
    assert {r.id: r.month for r in back} == {r.id: r.month for r in order} and sorted(r.offset for r in back if r.month == "2020-02") == list(range(20))
    other = found.withColumn("date", F.when(F.col("id") == 5, "x").otherwise(F.col("date")))
    assert {r.dim: (r.compared, r.differing) for r in encode.agreement(other, found, ["month", "date"]).collect()} == {"month": (60, 0), "date": (60, 1)}


def test_neighbours_pass_over_equal_pages(spark):
    rows = spark.createDataFrame([(1, 1, "a", 5), (2, 1, "a", 5), (3, 1, "a", 7), (4, 1, "a", None), (5, None, None, 1)], "id int, volume int, part string, page int")
    got = {r.id: (r.previous, r.next) for r in lookup.neighbours_in_issue(rows).collect()}
    assert got == {1: (4, 3), 2: (4, 3), 3: (2, None), 4: (None, 1), 5: (None, None)}


def test_checks_of_outputs_and_layers(spark):
    meta = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, " "), ("d", None, None)], "name string, contract int, credit string")
    assert sorted((r.check, r.key) for r in quality.contract(meta).collect()) == [("contract", "b"), ("contract", "d"), ("credit", "c"), ("credit", "d")]
    months = lambda *m: spark.createDataFrame([(x,) for x in m], "month string")
    assert sorted((r.key, r.expected, r.actual) for r in quality.same_months(months("1", "2"), months("2", "3")).collect()) == [("1", "missing", "there"), ("3", "there", "missing")]
    index = spark.createDataFrame([("f", 0, 5), ("f", 5, 5), ("g", 0, 1)], "file string, offset long, length long")
    sizes = spark.createDataFrame([("f", 10), ("g", 2), ("h", 1)], "file string, size long")
    assert sorted((r.check, r.key) for r in quality.bytes_accounted(index, sizes=sizes).collect()) == [("file_size", "g"), ("file_size", "h")]
    both = spark.createDataFrame([(1, "2001-01-01", "2003-01-01"), (2, "2002-01-01", "2002-01-01")], "volume int, x string, y string")
    assert {r.layer: (r.n, r.holds) for r in quality.rule_support(both, "volume", ["x", "y"], 2000).collect()} == {"x": (1, 1), "y": (1, 0)}
    rows = spark.createDataFrame([(1, 1, 1, "d", "k"), (2, 1, 1, "d", None), (3, 1, 1, "e", None), (4, 2, 1, "d", "k"), (5, 2, 1, "d", "g"), (6, 2, 1, "d", None)], "id int, volume int, number int, date string, cls string")
    assert {r.id: r.decided for r in quality.decided_class(rows).collect()} == {1: "k", 2: "k", 3: None, 4: "k", 5: "g", 6: None}


def test_slim_records_and_names(spark):
    rows = spark.createDataFrame([(1, "", False, 0), (2, "x", True, 5)], "id int, name string, flag boolean, n int")
    assert [tuple(r) for r in publish.slim(rows, ["id"], ["name", "flag", "n"]).orderBy("id").collect()] == [(1, None, None, 0), (2, "x", True, 5)]
    assert publish.named_like(rows, "name", " x ").count() == 1 and publish.named_like(rows, "name", " ").count() == 2
