import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import odd_texts, prose

from facetra.llm import chat, packing, sharding, warc


def docs(spark, n=300):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(100 + i, prose(i, 1 + i * 7 % 900)) for i in range(n)] + [(3, "one"), (None, "two words")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_words_are_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary())
    texts = [*[t or "" for t in odd_texts()], "It's we'll THEY'D x'y ''s 12a3 foo-bär — é, ü. ﬁ İstanbul ΣΑΣ ß", "áb ẛ̣ ﬁ ½", "don't—stop «quoted» 50% a_b", "<|startoftext|> a <|ENDOFTEXT|>", "\x1c a\x1fb\x7f"]
    w = packing.words()
    for t in texts:
        got = np.frombuffer(w.encode(t), "<u4").tolist()
        assert got == whole.encode(t, add_special_tokens=False).ids, t[:60]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1023, 1365, 2048, 4095, 4096, 4097, 9999, 123_456])
def test_cuts_cover_a_document(n):
    parts = packing.cut(n)
    assert sum(parts) == n and all(0 < p <= 4096 for p in parts) and len(parts) <= n // 4096 + 7


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows, df = docs(spark)
    found = packing.pieces(df, with_ids=True).collect()
    got = packing.pack_documents(df).collect()
    w = packing.words()
    want = Counter()
    whole = Tokenizer.from_file(packing.vocabulary())
    for i, t in rows:
        raw = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert raw[:-1] == np.frombuffer(w.encode(t or ""), "<u4").tolist()
        start, left = 0, len(raw)
        while left:  # whole sequences, then the largest 4096 // k that fits, then what is under a 64th
            length = 4096 if left >= 4096 else left if left < 64 else next(4096 // k for k in range(1, 65) if 4096 // k <= left)
            part = raw[start : start + length]
            want[(i, start, length, zlib.crc32(np.array(part, "<u4").tobytes()), len(raw))] += 1
            start, left = start + length, left - length
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in found) and all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    tokens = sum(r.length for r in got)
    assert len(bins) * 4096 <= 1.02 * tokens + 4096
    assert sorted(bins) == list(range(len(bins)))


def test_packing_of_no_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_differ_by_one_and_slots_have_no_gap(spark):
    rows, df = docs(spark, 1000)
    got = sharding.shard(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(df.limit(0)).count() == 0


def test_one_hot_key_is_spread_and_a_new_shard_moves_few(spark):
    same = spark.createDataFrame([(1, "x")] * 50, "doc_id long, text string")
    n = Counter(r.shard for r in sharding.shard(same).collect())
    assert max(n.values()) - min(n[s] for s in range(40)) <= 1
    df = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    a = {r.doc_id: r.shard for r in sharding.shard(df, shards=40).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(df, shards=41).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.35 * len(a)


def test_plan_covers_every_rank_once():
    counts = {5: 100, 6: 3, 4000: 7, 8191: 1}
    nodes = sharding.ring(10)
    seen = defaultdict(set)
    load = Counter()
    for slot, first, end, s in sharding.plan(counts, nodes, 10):
        assert not seen[slot] & set(range(first, end))
        seen[slot] |= set(range(first, end))
        load[s] += end - first
    assert {s: len(x) for s, x in seen.items()} == counts and max(load.values()) - min(load.values()) <= 1


def test_equal_rows_are_numbered_in_many_lanes(spark):
    found = packing.pieces(spark.createDataFrame([(1, "same text here")] * 600, "doc_id long, text string").coalesce(1))
    lanes = Counter(r.lane for r in found.collect())
    assert len(lanes) == 256 and max(lanes.values()) <= 3


def walked(counts, nodes, shards):
    """The ring key by key: each key starts at its slot; a key that finds its shard full goes on clockwise."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    places = sorted(nodes)
    load, moved = Counter(), 0
    keys = [(next((p for p in places if p >= slot), places[0])) for slot in sorted(counts) for _ in range(counts[slot])]
    late = []
    for p in keys:  # at home, where there is room
        if load[nodes[p]] < room[nodes[p]]:
            load[nodes[p]] += 1
        else:
            late.append(p)
    for p in late:
        at = places.index(p)
        while load[nodes[places[at % len(places)]]] == room[nodes[places[at % len(places)]]]:
            at += 1
        load[nodes[places[at % len(places)]]] += 1
        moved += 1
    return load, moved


def test_plan_agrees_with_a_plain_walk_of_the_ring():
    r = np.random.default_rng(3)
    for shards in (3, 10, 40):
        nodes = sharding.ring(shards, 8)
        places = sorted(nodes)
        counts = {int(s): int(n) for s, n in zip(r.choice(8192, 300, replace=False), r.integers(1, 40, 300), strict=True)} | {17: 5000}
        load, moved = walked(counts, nodes, shards)
        got, home = Counter(), 0
        for slot, first, end, s in sharding.plan(counts, nodes, shards):
            got[s] += end - first
            home += (end - first) * (s == nodes[next((p for p in places if p >= slot), places[0])])
        assert +got == +load
        assert sum(counts.values()) - home == moved  # no more keys leave their shard than must


def pages(spark):
    big, other = "<p>" + "x" * 1200 + "</p>", "é" * 700
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", other), (None, "u", big), (7, "u", other), (8, "u", "z" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_archives_round_trip(spark):
    import hashlib

    df = pages(spark)
    got = {r.page_id: r for r in warc.read(warc.write(df), with_payload=True).collect()}
    assert len(got) == 10
    for r in df.collect():
        raw = (r.html or "").encode()
        g = got[r.page_id]
        assert (g.payload_bytes, g.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert g.record_type == "revisit" or bytes(g.payload) == raw
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {1: 9, 2: 9, None: 9, 6: 7}
    assert got[9].url is None and got[2].url == "http://b%0D%0AX: y"
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_reader_takes_any_chunk_and_refuses_damage():
    a, b = warc.record(1, "u", b"first" * 100, None, False), warc.record(2, "u", b"second", 1, True)
    for chunk in (1, 7, 1 << 16):
        assert [warc.parse(c)["page_id"] for c in warc.members(io.BytesIO(a + b), chunk)] == [1, 2]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(a[:-9])))
    content = next(warc.members(io.BytesIO(a)))
    with pytest.raises(ValueError):
        warc.parse(content.replace(b"firstfirst", b"firstFirst", 1))
    with pytest.raises(ValueError):
        warc.parse(content[:-6])


def test_one_popular_page_is_dealt_to_many_tasks(spark):
    body = "<p>" + "y" * 2000
    df = spark.createDataFrame([(i, f"http://h/{i}", body) for i in range(400)], "page_id long, url string, html string")
    manifest = warc.write(df)
    got = warc.read(manifest).collect()
    assert sum(r.record_type == "response" for r in got) == 1 and {r.refers_to for r in got} == {399, None} and len(got) == 400


def maximal_logs(rows):
    """By comparing all conversations: conv_id -> (turns, equal logs, text)."""
    logs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            logs[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    logs = {c: tuple(sorted(x)) for c, x in logs.items()}
    out = {}
    for c, log in logs.items():
        equal = [k for k, other in logs.items() if other == log]
        if c == min(equal) and not any(len(o) > len(log) and o[: len(log)] == log for o in logs.values()):
            text = "".join(f"<|im_start|>{r if has else 'user'}\n{x}<|im_end|>\n" for _, _, has, r, _, x in log)
            out[c] = (len(log), len(equal), text)
    return out


def test_tied_turns_collapse_as_they_are_rendered(spark):
    r = np.random.default_rng(2)
    rows = []
    for c in range(60):
        base = [(int(t), ["user", "assistant", None][r.integers(3)], [None, "", "a", "b", f"x{r.integers(4)}"][r.integers(5)]) for t in sorted(r.integers(0, 4, r.integers(1, 6)))]
        rows += [(2 * c, *t) for t in base]
        last = base[-1][0]
        rows += [(2 * c + 1, *t) for t in [*base, (last, "user", f"y{r.integers(9)}")]]  # the longer copy ties with its last turn
    rows += [(500, None, "user", "n"), (501, None, "user", "n"), (501, None, "user", "n"), (None, 0, "user", "lost")]
    got = chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert {x.conv_id: (x.n_turns, x.n_logged, x.rendered) for x in got} == maximal_logs(rows)


def test_only_maximal_conversations_stay(spark):
    logs = {
        1: [("user", "a"), ("assistant", "b")],
        2: [("user", "a"), ("assistant", "b"), ("user", "c")],
        3: [("user", "a"), ("assistant", "b"), ("user", "c")],
        4: [("user", "a"), ("assistant", "x")],
        5: [("user", None)],
        6: [("user", "")],
        7: [(None, "a")],
    }
    rows = [(c, t, r, x, "extra") for c, turns in logs.items() for t, (r, x) in enumerate(turns)] + [(None, 0, "user", "lost", "extra")]
    long = [(8, t, "user", f"t{t}", "e") for t in range(700)] + [(9, t, "user", f"t{t}", "e") for t in range(699)]
    got = {r.conv_id: r for r in chat.collapse(spark.createDataFrame(rows + long, "conv_id long, turn long, role string, text string, rendered string")).collect()}
    assert sorted(got) == [2, 4, 5, 6, 7, 8]
    assert got[2].n_logged == 2 and got[8].n_turns == 700 and got[7].rendered == "<|im_start|>user\na<|im_end|>\n"
    assert got[8].rendered.index("t9<") < got[8].rendered.index("t10<")
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
