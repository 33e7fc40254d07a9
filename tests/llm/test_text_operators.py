import hashlib

import numpy as np
import pytest
from helpers import DOCS, contamination, near_groups, odd_texts, prose, quality

from facetra.llm import decontaminate as dc
from facetra.llm import near_dedup as nd
from facetra.llm import quality_rules as qr

CLASHING = "doc_id long, text string, n_words int, failure_bits string, kept string, score int, component_id int, hit_items int"


def test_quality_rules_match_brute_force(spark):
    texts = [*odd_texts(), prose(1, 50) + "\n" + prose(1, 50), "\n".join(["same line here"] * 9 + [prose(2, 40)]), "a " * 500, prose(3, 11)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, prose(3, 11))]
    got = qr.apply_policy(qr.ledger(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality(r.text), r.doc_id
        assert not (r.base_failed and r.kept)


def test_ledger_replaces_clashing_columns_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, prose(1, 20), 7, "x", "y", 1, 1, 1)], CLASHING)
    r = qr.ledger(df).collect()[0]
    assert r.n_words == 20 and r.failure_bits == 0 and r.score == 1
    assert qr.ledger(df.limit(0)).count() == 0


def test_policies_and_ablations_agree_with_recounting(spark):
    texts = [prose(i, 30) for i in range(5)] + ["SHOUT " * 3 + prose(9, 4).upper(), "a# b# c# d# e# f# g# h# i# j# k#", "one"]
    found = qr.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    for policy in qr.POLICIES:
        bits = [r.failure_bits for r in found.collect()]
        mask = qr.POLICIES[policy]
        for r in qr.ablations(found, policy).collect():
            bit = qr.BITS[r.rule]
            assert r.n_failed == sum(bool(b & bit) for b in bits)
            assert r.n_kept_without == sum(not (b & mask & ~bit) for b in bits)
            assert r.n_only_this == sum((b & mask) == bit for b in bits)
        assert qr.apply_policy(found, policy).where("kept").count() == sum(not b & mask for b in bits)


def near_rows():
    base = prose(5, 150).split()
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    for k in range(60):  # a group whose members drift apart, larger than SMALL
        w = list(base)
        for j in range(k % 12):
            w[(7 * j + 11 * k) % len(w)] = f"new{k}x{j}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + i, prose(40 + i, 80)) for i in range(10)] + [(300, prose(40, 80).upper()), (301, prose(40, 80) + " tail"), (302, "one"), (303, "ONE"), (304, "a b c d")]
    return rows


def test_near_groups_match_brute_force(spark, monkeypatch):
    rows = near_rows()
    monkeypatch.setattr(nd, "BLOCK", 16)  # several blocks a bucket
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = near_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_of_repeated_null_and_no_rows(spark):
    t = prose(1, 40)
    rows = [(5, t), (5, t), (None, t), (7, t), (8, None), (9, None), (4, prose(2, 40))]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("4", 36, "4", True), ("5", 36, "5", True), ("5", 36, "5", True), ("7", 36, "5", False), ("8", 0, "8", True), ("9", 0, "9", True), ("None", 36, "None", True)]
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def thue_morse(first, n=1024):
    return "".join("ab"[(bin(i).count("1") + first) % 2] for i in range(n))


def test_words_of_like_structure_are_not_linked(spark):
    """Running sums modulo a power of two take these two words for one."""
    one, other = thue_morse(0), thue_morse(1)
    rows = [(1, " ".join([one + str(k % 7) for k in range(40)])), (2, " ".join([other + str(k % 7) for k in range(40)])), (3, " ".join([one] * 9)), (4, " ".join([other] * 9))]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_groups(rows)
    assert all(r.kept for r in got)


def test_a_straggler_meets_a_large_component_in_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rows = [("k", i, 1 if i < 200 else 300 + i, [0] * 8, 203, 1, 200) for i in range(203)]
    left = spark.createDataFrame(rows, "key string, rep long, component long, packed array<long>, n long, main long, n_main long")
    dealt = nd._dealt(left).toPandas()
    assert len(dealt) <= 200 + 3 * (1 + 25) and dealt[dealt["component"] == 1].groupby("rep").size().max() == 1
    met = {(a, b) for _, g in dealt.groupby(["key", "lo", "hi"]) for a in g["rep"] for b in g["rep"] if a < b}
    assert met >= {(a, b) for a in range(203) for b in range(max(a + 1, 200), 203)}


def test_links_hold_on_shingles_where_hashes_collide(spark, monkeypatch):
    known = nd.Words()
    ids, _ = nd.numbers(b"a b c d e f a b c d e g", known)
    known.hashes[:] = 7  # every word alike
    assert nd.hashed_set(ids, known)[1] == 7
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    texts = [(1, prose(1, 60)), (2, prose(1, 60) + " end"), (3, prose(2, 60)), (4, None), (2, prose(9, 60))]
    assert [tuple(r) for r in nd.confirmed(pairs, spark.createDataFrame(texts, "rep long, text string")).collect()] == [(1, 2)]
    monkeypatch.setattr(nd, "SLICE", 2)
    many = [(0, prose(1, 60))] + [(k, prose(1, 60) + f" end{k}" if k % 2 else prose(k, 60)) for k in range(1, 40)]
    pairs = spark.createDataFrame([(0, k) for k in range(1, 40)], "a long, b long")
    got = {r.b for r in nd.confirmed(pairs, spark.createDataFrame(many, "rep long, text string")).collect()}
    assert got == {k for k in range(1, 40) if k % 2}


def test_signature_estimates_and_segments():
    a, b = prose(1, 300), prose(1, 270) + " " + prose(2, 30)
    sets = [nd.shingle_hashes(x.encode()) for x in (a, b)]
    both = len(set(sets[0].tolist()) & set(sets[1].tolist()))
    packed = nd.packed(nd.minima(sets))
    true = both / (len(sets[0]) + len(sets[1]) - both)
    assert abs(nd._near_rows(packed, 0, __import__("numpy").array([1]))[0] - true) < 0.15
    known = nd.Words()
    whole, digest = nd.numbers(a.encode(), known)
    old, nd.SEGMENT = nd.SEGMENT, 64
    again = nd.numbers(a.encode(), known)
    assert (again[0] == whole).all() and len(whole) == 300
    nd.SEGMENT = old
    again = nd.numbers(a.upper().replace(" ", "\n ").encode(), known)
    assert (again[0] == whole).all() and again[1] == digest != nd.numbers(b.encode(), known)[1]


def test_estimates_of_short_sets_keep_similar_pairs():
    r = np.random.default_rng(5)
    x = nd._mix(r.integers(0, 2**63, 4 * 20_000, dtype=np.uint64)).reshape(-1, 4)
    packed = nd.packed(nd.minima([s for row in x for s in (row[:3], row)]))  # pairs of similarity 0.75
    differ = packed[::2] ^ packed[1::2]
    differ = np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1)
    found = (1 - differ / nd.MINIMA - 0.25) / 0.75
    assert found.min() >= nd.MARGIN and abs(found.mean() - 0.75) < 0.01
    assert found.std() < 0.04  # 0.034 where agreement by chance is independent


def bench_items():
    q = prose(77, 30)
    return [(1, q), (2, "short question here"), (3, None), (4, " .!? "), (10, q + " more"), (5, prose(78, 10))]


def bench_docs():
    q = prose(77, 30)
    inside = prose(3, 20) + ". " + q.upper().replace(" ", ", ") + "! " + prose(4, 20)
    return [*odd_texts(), inside, "A Short-Question  here", "short question there", " ".join(q.split()[:9]), prose(6, 100), q + " " + q, prose(78, 10) + " short question here"]


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 300])
def test_decontamination_matches_brute_force(spark, block):
    rows = list(enumerate(bench_docs()))
    items = spark.createDataFrame(bench_items(), "item_id long, text string")
    got = dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items, block_bytes=block).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = contamination(r.text, bench_items())
        assert (r.n_words, r.n_hit, list(r.hit_items), r.contaminated) == (n, hit, found, hit > 0), r.doc_id
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert sum(x["last"] - x["first"] for x in r.hit_ranges) == hit


@pytest.mark.parametrize("items", [[], [(None, "some words here")], [(1, None), (2, ""), (3, " .!? ")]])
def test_decontamination_without_an_item_that_has_words(spark, items):
    rows = list(enumerate(bench_docs()))
    got = dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.n_words for r in got} == {i: contamination(t, [])[0] for i, t in rows}
    assert not any(r.n_hit or r.n_items or r.contaminated or r.hit_items for r in got)


def test_blocks_keep_clashing_columns_and_split_a_common_window(spark):
    items = [(i, prose(77, 12) + f" own{i} words{i}") for i in range(300)]  # windows that all items share
    docs = spark.createDataFrame([(1, "x " + prose(77, 12) + " y", "r", 5, "u")], "doc_id long, text string, hit_ranges string, _hit_ranges int, new_n_words string")
    r = dc.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=20_000).collect()[0]
    assert list(r.hit_items) == sorted(str(i) for i, _ in items) and r.n_hit == 12 and (r["_hit_ranges"], r["new_n_words"]) == (5, "u")


def test_decontamination_without_items_or_rows_and_offsets(spark):
    docs = spark.createDataFrame([(1, prose(1, 5), "en", "s", 1)], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not dc.decontaminate(docs, none).collect()[0].contaminated
    assert dc.decontaminate(docs.limit(0), spark.createDataFrame(bench_items(), "item_id long, text string")).count() == 0
    text = "Ünï, a Short - question HERE! ende"
    a = dc._automaton("t", {" short question here ": ["2"]})
    n, ranges, items = dc.scan(text, a)
    assert items == {"2"} and [text[x:y] for x, y in dc.offsets(text, ranges)] == ["Short - question HERE"]
