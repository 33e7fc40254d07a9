"""Columns with dots, blanks and other cases of result names; long ambiguous passages."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from helpers import DOCS, prose
from pyspark.sql import functions as F
from test_models import spoken

from facetra.llm import decontaminate as dc
from facetra.llm import language_id as li
from facetra.llm import quality_model as qm
from facetra.llm import quality_rules as qr
from facetra.llm import toxicity as tx

ODD = {"meta.url": "u", "a b": "s", "Score": "x", "N_WORDS": "w", "Contaminated": "c", "own_1": "o", "lang.pred": "p"}


def docs(spark):
    rows = [(i, spoken(lang, i, 40), lang, "s", 1) for i, lang in enumerate(["en", "de"] * 8)] + [(90, None, None, "s", 0), (91, prose(77, 30), "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.concat(F.lit(v), F.col("doc_id").cast("string")) for c, v in ODD.items()})


def operators(spark, df):
    items = spark.createDataFrame([(1, prose(77, 30))], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(16)], "doc_id long, quality int, toxic int")
    narrow = df.select("doc_id", "text", "lang")
    return {
        "ledger": lambda: (qr.apply_policy(qr.ledger(df)), {"n_words", "kept"}),
        "decontaminate": lambda: (dc.decontaminate(df, items), set(dc.RESULTS)),
        "decontaminate_blocks": lambda: (dc.decontaminate(df, items, block_bytes=300), set(dc.RESULTS)),
        "identify": lambda: (li.identify(df, li.Network.fresh(("en", "de"), 4, 1, np.float32)), {"lang_pred", "score", "held_out"}),
        "toxicity": lambda: (tx.score(df, tx.train(narrow, labels.select("doc_id", "toxic"))), {"score", "predicted", "held_out"}),
        "quality": lambda: (qm.score(df, qm.train(narrow, labels.select("doc_id", "quality"))), {"score", "predicted", "held_out"}),
    }


@pytest.mark.parametrize("name", ["ledger", "decontaminate", "decontaminate_blocks", "identify", "toxicity", "quality"])
def test_operators_pass_odd_columns_through(spark, name):
    df = docs(spark)
    if name in ("ledger", "quality"):  # these know their results by their very names
        df = df.drop("Score", "N_WORDS")
    out, results = operators(spark, df)[name]()
    kept = [c for c in ODD if c.lower() not in results and c in df.columns]
    rows = out.select("doc_id", *[F.col(f"`{c}`") for c in kept]).collect()
    assert len(rows) == df.count()
    assert all(r[c] == f"{ODD[c]}{r.doc_id}" for r in rows for c in kept)
    assert results <= {c.lower() for c in out.columns}
    assert len([c for c in out.columns if c.lower() in results]) == len(results & {c.lower() for c in out.columns})  # doubles are replaced
    out.select(*sorted(results)).collect()


def test_stages_pass_odd_columns_through(spark, tmp_path):
    df = docs(spark)
    spark.createDataFrame([(1, prose(77, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    repeated = df.unionByName(df.where("doc_id = 3"))
    for name, rows in (("quality", df), ("near_duplicates", df), ("near_duplicates", repeated), ("decontamination", df)):
        out = stages[name](spark, rows, str(tmp_path))
        assert out.columns == rows.columns
        got = out.collect()
        assert got and not Counter(map(tuple, got)) - Counter(map(tuple, rows.collect()))


def viterbi(passage: str, model) -> str:
    """Whole tables of back pointers over the readings, one state at a time."""
    steps, best = [], {(0, 0): 0.0}
    for ways in [*tx.readings(passage), [(" ", 0.0)]]:
        new, back = {}, {}
        for (a, b), cost in best.items():
            for text, extra in ways:
                x, y, total = a, b, cost + extra
                for c in text:
                    z = tx._code(c)
                    if not (z == 0 and y == 0):
                        total -= model[x][y][z]
                    x, y = y, z
                if (x, y) not in new or total < new[x, y]:
                    new[x, y], back[x, y] = total, ((a, b), text)
        steps.append(back)
        best = new
    state, out = min(best, key=best.get), []
    for back in reversed(steps):
        state, text = back[state]
        out.append(text)
    return "".join(reversed(out)).strip()


def least_cost(passage: str, said: str, model) -> float:
    """The least cost of a reading that gives this text."""
    best = {((0, 0), 0): 0.0}
    for ways in [*tx.readings(passage), [(" ", 0.0)]]:
        new: dict = {}
        for ((a, b), k), cost in best.items():
            for text, extra in ways:
                if said[k : k + len(text)] == text:
                    x, y, total = a, b, cost + extra
                    for c in text:
                        z = tx._code(c)
                        total -= 0.0 if z == 0 and y == 0 else model[x][y][z]
                        x, y = y, z
                    key = ((x, y), k + len(text))
                    new[key] = min(total, new.get(key, total))
        best = new
    return min(c for (_, k), c in best.items() if k == len(said))


def test_a_long_ambiguous_run_is_read_as_a_whole(monkeypatch):
    r = np.random.default_rng(3)
    model = np.log(r.dirichlet(np.ones(32), (32, 32))).tolist()
    passage = "".join(r.choice(list("013!|a@$5s"), 20_000))
    monkeypatch.setattr(tx, "STRETCH", 10**9)  # nothing is looked through
    whole = tx.restore(passage, model)
    assert least_cost(passage, whole + " ", model) == pytest.approx(least_cost(passage, viterbi(passage, model) + " ", model), abs=1e-6)  # of ties either
    for stretch in (7, 4096):
        monkeypatch.setattr(tx, "STRETCH", stretch)
        assert tx.restore(passage, model) == whole
