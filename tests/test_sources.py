import json

import pytest
from pyspark.sql import functions as F

from facetra.operators import clean, facets, hierarchy
from facetra.plans import publish, versions
from facetra.sources import jsonl, synthetic

HOST = "https://ratchakitcha.soc.go.th/documents"


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) if r is not None else "" for r in rows) + "\n")


@pytest.fixture
def corpus(tmp_path):
    meta = [
        {"pdf_file": "2024-000001.pdf", "doctitle": "old"},
        None,
        {"pdf_file": "2024-000001.pdf", "doctitle": " a  title ", "bookNo": "๑๓๘", "section": "29", "category": "งพิเศษ", "publishDate": "2024-01-02", "pageNo": "4", "source_url": f"{HOST}/87513.pdf"},
        {"pdf_file": "2024-01-05-00087513.pdf", "doctitle": "", "source_url": f"{HOST}/87513.pdf"},
        {"pdf_file": "2024-000003.pdf", "doctitle": "c", "source_url": f"{HOST}/7.pdf"},
    ]
    labels = [
        {"pdf_file": "2024-000001.pdf", "volume": 1, "part": "29 ง", "publish_date": "2024-01-03", "topic": "waste", "topic_corroborated": True, "extracted": {"court": "c", "stage": ""}},
        {"pdf_file": "2024-01-05-00087513.pdf", "volume": 138, "publish_date": "", "has_text": False, "labels": [{"slug": "waste", "axis": "topic", "weight": 0.9, "corroborated": True, "matched_by": ["x"]}]},
        {"pdf_file": "2024-000003.pdf", "volume": 2},
    ]
    put(tmp_path / "meta/2024/2024-01.jsonl", meta)
    put(tmp_path / "taxonomy/2024/2024-01.jsonl", labels)
    put(tmp_path / "meta/2025/2025-01.jsonl", [{"pdf_file": "2025-000001.pdf"}])
    put(tmp_path / "textindex/2024/2024-01.jsonl", [{"doc_id": "2024-000001", "offset": 0, "length": 5}, {"doc_id": "2024-000001", "offset": 5, "length": 6}, {"doc_id": "x", "offset": 1, "length": 0}])
    put(tmp_path / "text/2024/2024-01.jsonl", [{"doc_id": "2024-000001", "text": "body", "signatories": [{"name": "n", "position": ""}, {"name": "", "position": ""}]}, {"doc_id": "y", "text": ""}, {"text": "z"}])
    (tmp_path / "tax.json").write_text(json.dumps({"topics": {"waste": {"thai": "W", "parent": "env"}, "env": {"thai": None, "parent": None}}, "actions": {"rule": "R"}, "govlevels": {}}))
    return tmp_path


def test_records_without_a_link_are_dealt_to_many_tasks(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 8, F.concat(F.lit(f"{HOST}/"), F.col("id").cast("string"), F.lit(".pdf"))).alias("source_url"))
    disputed = spark.createDataFrame([("7", 2, None), (" 9", 2, None)], "ref string, claimants long, owner string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        settled = clean.settle_links(rows, disputed)
        tasks = settled.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 4 and max(r["count"] for r in tasks) < 1500  # all of them were one task's
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [r.id for r in settled.where("withheld").collect()] == ["7"] and settled.where("link IS NOT NULL").count() == 7


def test_metadata_are_parsed_once(spark, corpus, monkeypatch):
    read, of = [], jsonl._layer
    monkeypatch.setattr(jsonl, "_layer", lambda s, root, layer, schema: read.append(layer) or of(s, root, layer, schema))
    out = jsonl.load(spark, str(corpus))
    assert sorted(read) == ["meta", "taxonomy", "textindex"]
    assert not any("/meta/2" in f for f in out.inputFiles()) and out.count() == 3  # from the stored table


def test_layers_become_records(spark, corpus):
    got = {r.id: r for r in jsonl.load(spark, str(corpus)).collect()}
    a, b, c = got["2024-000001"], got["2024-01-05-00087513"], got["2024-000003"]
    assert (a.title, a.date, a.volume, a.part, a.part_class, a.page, a.topic_c) == ("a title", "2024-01-03", 138, "29 ง พิเศษ", "ง", 4, True)
    assert a.extracted == {"court": "c"} and tuple(a.text_at) == (5, 6)
    assert a.link is None and a.withheld and b.link == f"{HOST}/87513.pdf" and not b.withheld and c.link == f"{HOST}/7.pdf"
    assert (b.title, b.date, b.volume, b.has_text, c.has_text) == ("(ไม่มีชื่อเรื่อง)", None, 138, False, None)
    assert {r.year for r in got.values()} == {"2024"}
    assert jsonl.load(spark, str(corpus), "2024", limit=1).count() == 1
    with pytest.raises(ValueError):
        jsonl.load(spark, str(corpus), "2023-2024")
    joined = {r.id: r.text for r in jsonl.with_text(jsonl.load(spark, str(corpus)), jsonl.texts(spark, str(corpus))).collect()}
    assert joined == {"2024-000001": "body", "2024-01-05-00087513": None, "2024-000003": None}
    assert [len(r.signatories) for r in jsonl.texts(spark, str(corpus)).collect()] == [1]


def test_taxonomy_and_keys(spark, corpus):
    topics, codes = jsonl.taxonomy(spark, str(corpus / "tax.json"))
    assert sorted(tuple(r) for r in topics.collect()) == [("env", "env", None), ("waste", "W", "env")]
    assert [tuple(r) for r in codes.collect()] == [("actions", "rule", "R")]
    lines = spark.read.text(str(corpus / "text/2024/2024-01.jsonl"))
    assert [r.k for r in lines.select(jsonl.line_key(F.col("value")).alias("k")).collect()] == ["2024-000001", "y", None]
    assert jsonl.chosen_years("2024,2025", ["2024", "2025"]) == ["2024", "2025"]


def test_disputed_links(spark):
    rows = [("2024-01-05-00000007", f"{HOST}/7.pdf"), ("2002-000007", f"{HOST}/7.pdf"), ("x", f"{HOST}/8.pdf"), ("y", f"{HOST}/8.pdf"), ("z", f"{HOST}/9.pdf"), ("q", None)]
    df = spark.createDataFrame(rows, "id string, source_url string")
    disputed = clean.claims(df)
    # both ids of the first link end in its number, so neither keeps it
    assert {r.ref: (r.claimants, r.owner) for r in disputed.collect()} == {"7": (2, None), "8": (2, None)}
    assert tuple(clean.link_accounting(clean.settle_links(df, disputed), disputed).collect()[0]) == (1, 4, 2)


def test_generated_records_are_the_same_however_dealt(spark):
    a = synthetic.records(spark, [2024, 2025])
    assert a.count() == 160 and sorted(map(tuple, a.collect())) == sorted(map(tuple, a.repartition(7).collect()))
    assert 0.7 < a.where("topic_c").count() / 160 < 0.9
    assert hierarchy.closure(synthetic.topics(spark)).where("descendant = 'pollution_waste'").count() == 3


def test_publishing(spark, tmp_path):
    recs = synthetic.records(spark, [2024, 2025])
    publish.write_months(recs, f"{tmp_path}/months")
    back = versions.read_table(spark, f"{tmp_path}/months")
    assert back.count() == 160 and back.where("year = 2024").count() == 80
    publish.write_csv(recs.select("id", "topic"), f"{tmp_path}/csv", {"topic": synthetic.topics(spark)})
    assert spark.read.csv(f"{tmp_path}/csv", header=True).where("topic = 'pollution waste'").count() == recs.where("topic = 'pollution_waste'").count()
    publish.write_table(recs.select("id"), f"{tmp_path}/t", "json")
    assert versions.read_table(spark, f"{tmp_path}/t").count() == 160
    publish.write_table(recs.select("id").limit(3), f"{tmp_path}/t", "json")  # in its place, with nothing left beside it
    assert versions.read_table(spark, f"{tmp_path}/t").count() == 3 and [p.name for p in tmp_path.glob("t*")] == ["t"]
    listed = publish.for_csv(recs.select("id", "topic"), {"topic": synthetic.topics(spark)}, "https://example.org/").first()
    assert listed.link == f"https://example.org/doc/{listed.id}"
    entries = publish.feeds(recs, "topic", ["agency"], least=10, newest=20, k=5)
    listed = publish.feed_directory(entries, ["all", "series", "agency"]).collect()
    assert listed[0].feed_id == "all" and listed[0].n == 20 and all(r.n <= 20 for r in listed)
    newest = [r.id for r in facets.newest(recs, None, 20).collect()]
    assert [r.id for r in entries.where("feed_id = 'all'").orderBy("rank").collect()] == newest
    assert publish.feed_xml(entries).where("xml LIKE '<feed><entry>%'").count() == len(listed)
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert [tuple(r) for r in publish.upsert(old, spark.createDataFrame([("b", 9), ("c", 3)], "id string, n int")).collect()] == [("a", 1), ("b", 9), ("c", 3)]
    assert publish.build_meta(recs, {"source": "generated"}).collect()[0].total == 160


def test_records_move_codes_of_labels(spark, sf_dir, capsys):
    from facetra.sources import tables

    want = tables.headlines(tables.labels(spark, sf_dir)).collect()
    rows = {r.id: r for r in tables.records(spark, sf_dir).collect()}
    assert all((rows[w.id].topic, rows[w.id].topic_c, rows[w.id].slugs) == (w.topic, w.topic_c, w.slugs) for w in want if w.id in rows)
    assert sum(r.topic is not None for r in rows.values()) == len({w.id for w in want} & set(rows)) > 0
    tables._records(spark, sf_dir).explain()
    shuffled = capsys.readouterr().out.split("Exchange hashpartitioning", 1)[1]
    assert "concat_ws( , Order" not in shuffled
