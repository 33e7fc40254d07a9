import itertools
import re
import unicodedata

import numpy as np
import pytest
from helpers import DOCS, odd_texts, prose
from pyspark.sql import functions as F

from facetra.llm import language_id as li
from facetra.llm import quality_model as qm
from facetra.llm import toxicity as tx
from facetra.llm.common import read

SOUNDS = {"en": "the and of ing tion that with sh", "de": "der die und ung lich schön über ß", "fr": "le la et ment été où ça eaux"}


def spoken(lang, seed, n):
    sounds = SOUNDS[lang].split()
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(sounds, r.integers(1, 4))) for _ in range(n))


def test_gradients_are_those_of_the_loss():
    net = li.Network.fresh(("a", "b", "c"), 4, 1, np.float64)
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y)
    for k, w in net.p.items():
        flat = w.reshape(-1)
        for i in np.argsort(-np.abs(g[k].reshape(-1)))[:3]:
            old = flat[i]
            flat[i] = old + 1e-6
            up = net.gradients(x, y)[0]
            flat[i] = old - 1e-6
            down = net.gradients(x, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-6 - g[k].reshape(-1)[i]) < 1e-6


@pytest.fixture(scope="module")
def net():
    return li.fit([(lang, spoken(lang, s, 60).encode()) for lang in SOUNDS for s in range(40)], steps=150)


def test_languages_of_unseen_texts(spark, net):
    rows = [(i, spoken(lang, 1000 + i, 5 + i % 90), lang) for i, lang in enumerate(list(SOUNDS) * 30)]
    got = li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and {r.held_out for r in got} == {True, False}


def test_odd_texts_and_pooling(spark, net):
    rows = [(i, t, 5) for i, t in enumerate(odd_texts())]
    got = {r.doc_id: r for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, score int"), net).collect()}
    assert len(got) == len(rows)
    assert all((r.lang_pred == li.UND) == (not any(c.isalpha() for c in rows[i][1] or "")) for i, r in got.items())
    text = spoken("de", 3, 100)
    labels = li.positions(net, text)
    assert len(labels) == len(text.encode()) and labels.count("de") > len(labels) / 2
    one, two = li.pooled(net, [text.encode(), b"x"]), li.pooled(net, [text.encode()])
    assert np.allclose(one[0], two[0], atol=1e-5) and np.allclose(one.sum(1), 1, atol=1e-4)
    assert li.identify(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0


def test_network_equals_a_plain_forward_pass(net, monkeypatch):
    """One byte after the other, in plain loops, both ways, windows apart."""
    s = lambda a: a / (1 + np.abs(a))
    text = (spoken("fr", 1, 60) + " é").encode()

    def states(d, part):
        h = np.zeros(li.HIDDEN)
        table, inner, out = net.p[f"table_{d}"].astype(float), net.p[f"inner_{d}"].astype(float), []
        for b in part if d == "f" else reversed(part):
            z, r = (1 + s(table[0, b] + h @ inner[0])) / 2, (1 + s(table[1, b] + h @ inner[1])) / 2
            n = s(table[2, b] + r * (h @ inner[2]))
            h = z * h + (1 - z) * n
            out.append(h)
        return out if d == "f" else out[::-1]

    total = np.zeros(len(net.langs))
    for lo in range(0, len(text), li.WINDOW):
        part = text[lo : lo + li.WINDOW]
        for f, b in zip(states("f", part), states("b", part), strict=True):
            a = np.exp(f @ net.p["out_f"] + b @ net.p["out_b"] + net.p["bias"])
            total += a / a.sum()
    assert len(text) > 2 * li.WINDOW and np.allclose(li.pooled(net, [text])[0], total / len(text), atol=1e-4)
    monkeypatch.setattr(li, "PART", li.WINDOW)
    assert np.allclose(li.pooled(net, [text, b"", text[:9]])[0], total / len(text), atol=1e-4)


def test_copies_of_one_text_do_not_hide_a_language(spark):
    rows = [(i, spoken("de", 7, 40), "de") for i in range(6000)] + [(10_000 + i, spoken("de", 100 + i, 40), "de") for i in range(40)]
    rows += [(20_000 + i, spoken("en", i, 40), "en") for i in range(600)]
    learned = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned.langs == ("de", "en")
    fresh = [(i, spoken(lang, 5000 + i, 40), lang) for i, lang in enumerate(["de", "en"] * 20)]
    got = li.identify(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), learned).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9


def test_training_without_languages(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", 1)], DOCS)
    assert [r.lang_pred for r in li.identify(df, li.train(df)).collect()] == [li.UND]


def test_network_on_the_tables(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    got = li.identify(docs, li.train(docs)).where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9


def test_obfuscated_words_are_restored(spark, sf_dir):
    counts = tx.trigram_counts(read(spark, sf_dir, "documents"))
    restorer = tx.Restorer(tx.log_model(counts))
    for said, meant in (("l0s3r", "loser"), ("l o s e r", "loser"), ("loooooser", "loser"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("$cum", "scum"), ("p@thetic", "pathetic"), ("m.o.r.o.n", "moron")):
        assert restorer(f"the {said} of") == f"the {meant} of", said
    for plain in ("the and of 2024, with that. 15 % of them", "the end...", "e.g. the one"):
        assert restorer(plain).replace(" ", "").isascii()
    assert restorer("the and of that were there.") == "the and of that were there."
    text = [(r.text or "") for r in read(spark, sf_dir, "documents").collect()]
    assert counts.sum() == sum(max(0, len(t.encode()) - 2) for t in text)


def toxic_rows():
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(i, 60) + (" you grumblex and frobnitz here" if bad else " you fine and good here"), int(bad)))
    return rows


def test_toxicity_learns_words_and_sees_through_disguise(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (2, 7)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    got = {r.doc_id: r for r in tx.score(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert held and all(p == y for p, y in held)
    more = [(1000, "such a grumb1ex f r o b n i t z"), *[(2000 + i, t) for i, t in enumerate(odd_texts())]]
    out = {r.doc_id: r for r in tx.score(spark.createDataFrame(more, "doc_id long, text string"), model).collect()}
    assert out[1000].score > 0.7 and all(out[2000 + i].score == pytest.approx(model.base) for i in range(len(odd_texts())))
    train = [y for i, _, y in rows if not got[i].held_out]
    assert model.prior == pytest.approx(np.mean(train)) and model.base < 0.02
    assert tx.score(docs.limit(0), model).count() == 0


def test_toxicity_learns_a_rare_word_below_many_frequent_ones(spark):
    common = " ".join("".join(x) for x in itertools.islice(itertools.product("bcdfghjklmnpr", repeat=4), 24_000) if "".join(x)[:3] != x[0] * 3 and "".join(x)[1:] != x[1] * 3)
    rows = [(i, common + (" zqvx" if i % 4 == 0 else ""), i % 2 ^ 1) for i in range(120)]  # in half of the toxic rows
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert set(model.weights) == {"zqvx"}


def reading_cost(path, model):
    """Of a whole reading, symbol by symbol; gaps after gaps are free."""
    total, x, y = 0.0, 0, 0
    for text, extra in [*path, (" ", 0.0)]:
        total += extra
        for c in text:
            b = c.encode()[0]
            z = 0 if c.isspace() else (b | 32) - 96 if c.isascii() and c.isalpha() else 27 + b % 4 if b > 127 else 31
            total -= 0 if z == 0 and y == 0 else float(model[x, y, z])
            x, y = y, z
    return total


def test_restored_passages_are_the_likeliest_of_all_readings():
    r = np.random.default_rng(4)
    model = tx.log_model(r.integers(0, 50, (32, 32, 32)).astype(float))
    for _ in range(150):
        passage = "".join(r.choice(list("abco0134$@ .-é"), r.integers(2, 9)))
        passage = passage.replace("o", "ooo") if r.random() < 0.3 else passage
        ways = [tx._ways(m[0]) for m in tx._RUN.finditer(passage)]
        best = min(itertools.product(*ways), key=lambda path: reading_cost(path, model))
        said = tx.restore(passage, model)
        assert reading_cost(best, model) == pytest.approx(min(reading_cost(p, model) for p in itertools.product(*ways) if "".join(t for t, _ in p).strip() == said), abs=1e-3), passage


def test_a_token_of_megabytes_takes_seconds_and_long_stretches_are_settled():
    import time

    r = np.random.default_rng(1)
    model = tx.log_model(r.integers(0, 50, (32, 32, 32)).astype(float))
    restorer = tx.Restorer(model)
    began = time.time()
    blob = "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 1_000_000))
    assert len(restorer(blob)) > 800_000
    assert len(restorer("a" + "01" * 20_000)) > 0 and len(restorer("ab" * 100_000 + "ccc0")) > 0
    assert time.time() - began < 30


def test_scores_follow_from_counts_of_words(spark):
    """A plain scorer: counts in Python, without disguise."""
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in tx.score(docs, model).collect()}
    train = [(t, y) for i, t, y in rows if not got[i].held_out]
    n1 = sum(y for _, y in train)
    n0 = len(train) - n1
    for word in ("grumblex", "frobnitz"):
        a, b = sum(word in t for t, y in train if y), sum(word in t for t, y in train if not y)
        assert model.weights[word] == pytest.approx(np.log((a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))))
    for i, t, _ in rows:
        odds = [model.weights[w] for w in set(t.split()) if w in model.weights]
        want = 1 / (1 + (n0 / n1) * np.exp(-sum(odds))) if odds else model.base
        assert got[i].score == pytest.approx(want)


def test_a_beginning_counts_where_it_is_dense(spark):
    """Words that clean texts hold now and then, each in another form: toxic texts have several among few words."""
    def formed(i, n):
        return " ".join("gravor" + "bcdfgklmnp"[(i + j) % 10] + "aeiou"[(i * 3 + j) % 5] for j in range(n))

    rows = [(i, f"{prose(i, 60)} {formed(i, 3)}" if i % 4 == 0 else f"{prose(i, 300)} {formed(i, i % 3 == 0)}", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "grav**" in model.weights and "grav*" not in model.weights and not any(w.startswith("gravor") for w in model.weights)
    got = {r.doc_id: r for r in tx.score(docs, model).collect()}
    for i, t, y in rows:
        words = re.findall(r"[^\W\d_]+", model.restorer(t))
        dense = sum(w.startswith("grav") for w in words) >= tx.DENSE * len(words)
        assert dense == y == got[i].predicted
    long = spark.createDataFrame([(1, f"{prose(1, 5000)} {formed(1, 30)}"), (2, f"{prose(1, 1000)} {formed(1, 30)}")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in tx.score(long, model).collect()} == {1: 0, 2: 1}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in tx.score(docs, model).collect()] == [0, 0]


def test_quality_rules_compile_to_the_same_scores(spark):
    rows = [(i, prose(i, 40 + i % 50) if i % 5 else prose(i, 40).replace(" ", "### ").upper()) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)] + [(3, None), (5, 9)], "doc_id long, quality int")
    model = qm.train(docs, labels)
    assert 0 < len(model.rules) < 60
    got = {r.doc_id: r for r in qm.score(docs, model).collect()}
    stats = docs.select("doc_id", qm.statistics(F.col("text")).alias("s")).collect()
    x = np.array([[r.s[n] for n in qm.STATISTICS] for r in stats])
    assert np.allclose([got[r.doc_id].score for r in stats], model.predict(x), atol=1e-9)
    held = [(got[i].predicted, int(i % 5 > 0)) for i in range(400) if got[i].held_out]
    assert held and np.mean([p == y for p, y in held]) > 0.98
    assert qm.score(docs.limit(0), model).count() == 0


def test_statistics_are_recomputed_in_plain_python(spark):
    texts = [*odd_texts(), "A b, c.\n\nA b, c.\n x|y ## 12 !! ÀÉ", prose(1, 50).upper() + "\n" + prose(2, 5)]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", qm.statistics(F.col("text")).alias("s")).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars, m = max(1, len(w)), max(1, sum(map(len, w))), max(1, len(lines))
        of = lambda kind: sum(unicodedata.category(c) == kind for c in t)
        want = {
            "words": len(w), "word_length": chars / n, "upper": of("Lu") / chars, "digits": of("Nd") / chars, "symbols": sum(c in "#*$%&|<>" for c in t) / n,
            "pipes": t.count("|") / n, "exclaims": t.count("!") / n, "stops": t.count(".") / n, "commas": t.count(",") / n,
            "dup_lines": (len(lines) - len(set(lines))) / m, "lines": len(lines), "line_words": n / m, "variety": len(set(w)) / n,
        }
        assert {k: r.s[k] for k in qm.STATISTICS} == pytest.approx(want)


def test_quality_with_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = qm.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [round(r.score, 3) for r in qm.score(docs, none).collect()] == [0.5, 0.5]
    one = qm.train(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert all(r.predicted == 1 for r in qm.score(docs, one).collect())


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    got = qm.score(docs, qm.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.8
