from collections import Counter

import corpus_pipeline
import duckdb

from helpers import DOCS, contamination, near_groups, odd_texts, prose, quality
from pyspark.sql import functions as F
from test_models import spoken

from facetra.llm import queries as q
from facetra.storage import shared_dir
from facetra.llm.sql import oracle_sql


def rows():
    out = [(i, spoken(lang, i, 60), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    out += [(500, spoken("en", 0, 60), "en"), (501, spoken("en", 0, 60) + " more", "en"), (502, prose(77, 30) + " " + spoken("en", 9, 40), "en")]
    out += [(600 + i, t, None) for i, t in enumerate(odd_texts())] + [(None, spoken("de", 77, 50), "de"), (3, spoken("en", 3, 60), "en"), (3, spoken("fr", 3, 60), "fr")]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in out]


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.createDataFrame(rows(), DOCS).withColumns({"n_words": F.lit("mine"), "score": F.lit(1.5), "own_1": F.lit("o"), "hit_items": F.lit(0)})
    items = [(1, prose(77, 30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "decontamination", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            break
        assert after.columns == docs.columns
        a, b = before.collect(), after.collect()
        assert not Counter((r.doc_id, r.text) for r in b) - Counter((r.doc_id, r.text) for r in a)
        if name == "quality":
            assert not any(quality(r.text)[5] for r in b)
            kept = {r.doc_id for r in b}
            assert kept >= set(range(120))
        if name == "language":
            assert kept - {r.doc_id for r in b} <= set(range(600, 700)) and {r.doc_id for r in b} >= set(range(120))
        assert {r.n_words for r in b} == {"mine"} and {(r.score, r.own_1, r.lang) for r in b} <= {(1.5, "o", x) for x in ("en", "de", "fr", None)}
        if name == "near_duplicates":  # rows of one id are documents of their own
            order = sorted(a, key=lambda r: (r.doc_id is None, r.doc_id or 0))
            groups = near_groups([(k, r.text) for k, r in enumerate(order)])
            want = Counter(order[k].doc_id for k, (_, g) in groups.items() if k == g)
            assert Counter(r.doc_id for r in b) == want and want[3] == 2
        if name == "decontamination":
            assert {r.doc_id for r in b} == {r.doc_id for r in a if not contamination(r.text, items)[1]}
        before = after
    got = after.collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in before.collect()} and all(r.length > 0 for r in got)


def test_unlike_rows_of_one_id_survive_the_copy_of_one(spark):
    texts = [(3, prose(1, 60)), (3, prose(2, 60)), (4, prose(1, 60) + " end"), (None, prose(2, 60)), (None, prose(5, 60)), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, row string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text, r.row) for r in got) == Counter((i, t, "x") for i, t in [texts[0], texts[1], texts[4], texts[5], texts[6]])


def test_stages_go_on_without_benchmark_items(spark, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, prose(1, 60), "n")], "doc_id long, text string, n_hit string")
    assert [tuple(r) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [tuple(r) for r in docs.collect()]


def test_run_leaves_no_more_than_its_result(spark, tmp_path):
    import os

    docs = spark.createDataFrame([r for r in rows() if r[0] not in (3, None)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(77, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} >= set(range(120)) - {3} and len(set(os.listdir(folder)) - before) == 1


def test_stages_of_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_queries_match_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        df = q.queries()[name](spark, sf_dir)
        columns = sorted(df.columns)
        rel = con.sql(sql)
        assert sorted(rel.columns) == columns
        want = Counter(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
        assert Counter(tuple(r) for r in df.select(*columns).collect()) == want, name
