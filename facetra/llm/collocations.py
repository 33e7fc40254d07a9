"""Collocations per language by Toivonen mining: a sample proposes, full passes decide.

A sample of the rows is mined level by level at a lowered threshold; its frequent phrases go into a filter. A full pass
then meets every phrase whose two parts of one word less are in the filter: these are the proposed phrases and their
negative border, and all single words. It counts them by their place in a filter, that is by 33 bits of their hash, so
that the many rare ones are not moved as text. A place's count is that of all phrases that fall on it, so no frequent
phrase is lost; the places of frequent counts are a second filter. A last pass counts, as text and exactly, what was met
before and is in that filter. Where a phrase of the border is frequent, the sample has failed there: the pass counts all
that such phrases make countable as well, and all that this makes countable in turn. That closes the search: the parts
of a frequent phrase are frequent, so each was met in the first pass and is in a filter, or is first met in the last
pass, which then counts what it is a part of as well.

A filter is a blocked Bloom filter of fixed size (``SLOTS`` words of 64 bits, 16 MB); two are the only things that go to
all tasks, whatever the input's size. A phrase that one holds by chance is merely counted too. Tasks number words and
phrases exactly within a block of ``BLOCK`` words, so that a block gives one row a phrase, and Spark adds the blocks up.
Places go out as sorted steps and counts, a row for each of ``1 << 33 - WITHIN`` parts, and a part is added up in an array.

Ranking is DataFrame work on the frequent phrases: cuts meet the counts of their parts by joins, longer phrases report
their count to what they hold, and the first ``top`` of a language are taken in lanes before they meet.

Defined results: letters A-Z are lower-cased; a null text is empty; a null language is ``und``; repeated rows count
each; ties go by count, then phrase in byte order; rows with null ids count like others; further columns are not read; an
empty table, or one without a frequent phrase, gives an empty table. A text is held whole, once, however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetra.llm.common import ship
from facetra.storage import stored

LEAST, LONGEST, TOP = 100, 5, 2000
#: One row in so many is in the sample, and the share of the expected count that a phrase needs there.
SAMPLE, LOWERED = 8, 0.9
SLOTS = 1 << 21
#: Bits of a place that number it within its part: 1,024 parts of 8 million places.
WITHIN = 23
BLOCK = 1_500_000
#: Phrases that are put together as text at once.
PIECE = 100_000
#: Lanes that a language's phrases are ranked in before the best of all lanes are.
LANES = 64
UND = "und"
BREAK = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 9)


class _Numbers(dict):
    """Words in the order in which they are met; the break is 0."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str) -> list[bytes]:
    """Words of a text, with a break after every piece."""
    return text.encode("utf-8", "replace").translate(_FOLD).replace(BREAK, b" . ").split() + [BREAK]


def _hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64)


def _chain(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    h = (head ^ word) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _start(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 7)], np.uint64)


def _place(h: np.ndarray) -> np.ndarray:
    """All that the filter sees of a hash: 21 bits of the slot, and twice 6 bits for the bits in it."""
    return (((h & np.uint64(SLOTS - 1)) << np.uint64(12)) | ((h >> np.uint64(40)) & np.uint64(4095))).astype(np.int64)


def _bits(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and bits of places in the filter."""
    one, at = np.uint64(1), place.astype(np.uint64)
    return place >> 12, (one << (at & np.uint64(63))) | (one << ((at >> np.uint64(6)) & np.uint64(63)))


def _holds(bloom: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if bloom is None:
        return np.zeros(len(h), bool)
    slot, bits = _bits(_place(h))
    return bloom[slot] & bits == bits


def block_counts(ids: np.ndarray, words: list[bytes], lang: str, levels: range, bloom, heavy) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, hashes, counts, first positions and order of the phrases of a block of word numbers (0: break), level by level.
    A phrase is met where its parts of one word less are met and in ``bloom``. In the last pass, where ``heavy`` is the filter
    of frequent places, that lets parts through as well; those are given that are in it or were not met in the first pass, and
    the latter are parts of further ones without being in a filter."""
    word_hash = _hashes(words)
    wider = bloom if heavy is None else bloom | heavy
    at = np.flatnonzero(ids).astype(np.int32)
    used, rank = np.unique(ids[at], return_inverse=True)
    first = np.zeros(len(used), np.int32)
    first[rank[::-1]] = at[::-1]
    h = _chain(np.broadcast_to(_start(lang), len(used)), word_hash[used])
    old = np.full(len(used), heavy is not None)  # met in the first pass
    order = np.arange(len(used))
    for k in range(1, levels.stop):
        if k > 1:
            inside, old_inside = _holds(wider, h), old
            if heavy is not None:
                inside, old_inside = inside | ~old, old & _holds(bloom, h)
            held = np.full(len(ids) + 1, -1, np.int32)
            good = inside[rank]
            held[at[good]] = rank[good]
            starts = at[good]
            starts = starts[held[starts + 1] >= 0]
            coded = pa.array(held[starts].astype(np.int64) * len(words) + ids[starts + (k - 1)]).dictionary_encode()
            at, rank, order = starts, coded.indices.to_numpy(), coded.dictionary.to_numpy()
            first = np.zeros(len(order), np.int32)
            first[rank[::-1]] = at[::-1]
            h = _chain(h[held[first]], word_hash[ids[first + (k - 1)]])
            old = old_inside[held[first]] & old_inside[held[first + 1]]
            del coded, held, starts, good, inside, old_inside
        if k in levels:
            counts = np.bincount(rank, minlength=len(h))
            given = slice(None) if heavy is None else ~old | _holds(heavy, h)
            yield k, h[given], counts[given], first[given], order[given]


def _texts(ids: np.ndarray, words: list[bytes], found) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases and counts of a block, in the order of what comes before the last word: neighbours share it, which packs well."""
    lexicon = pa.array(words, pa.binary())
    for k, _, counts, first, order in found:
        order = np.argsort(order)
        for i in range(0, len(order), PIECE):
            some = order[i : i + PIECE]
            parts = [lexicon.take(pa.array(ids[first[some] + j])) for j in range(k)]
            yield (pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]), counts[some]


def _cells(found, most: int) -> Iterator[tuple[int, bytes]]:
    """Part and cell of a block's places: steps from place to place, and counts up to ``most``, their bytes by significance."""
    found = [(_place(h), counts) for _, h, counts, _, _ in found]
    place, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place)
    place, n = place[order], n[order]
    own = np.flatnonzero(np.diff(place, prepend=-1))
    if not len(own):
        return
    place, n = place[own], np.minimum(np.add.reduceat(n, own), most)
    begin = np.flatnonzero(np.diff(place >> WITHIN, prepend=-1))
    step = np.diff(place, prepend=0)
    step[begin] = place[begin] & ((1 << WITHIN) - 1)
    data = np.stack([step, n]).astype("<u4").view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)
    for a, b in zip(begin, [*begin[1:], len(place)], strict=True):
        yield int(place[a] >> WITHIN), zlib.compress(data[:, :, a:b].tobytes(), 1)


def _opened(cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places within the part, and counts, of a cell."""
    data = np.frombuffer(zlib.decompress(cell), np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)
    step, n = np.ascontiguousarray(data).view("<u4")[:, :, 0]
    return np.cumsum(step, dtype=np.int64), n


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Language, word numbers and words of blocks of at least ``block`` words, or what is left of them."""
    numbers, parts, size = _Numbers(), {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = np.fromiter(map(numbers.__getitem__, tokens(text.as_py())), np.int32)
            parts.setdefault(lang.as_py(), []).append(ids)
            size += len(ids)
            if size >= block:
                words = list(numbers)
                for key, found in parts.items():
                    yield key, np.concatenate(found), words
                numbers, parts, size = _Numbers(), {}, 0
    words = list(numbers)
    for key, found in parts.items():
        yield key, np.concatenate(found), words


def packed(*filters: np.ndarray | None) -> list[bytes | None]:
    """Filters to be sent: at most 16 MB each, far less while they hold little."""
    return [None if f is None else zlib.compress(f.tobytes(), 1) for f in filters]


def _unpacked(data: bytes | None) -> np.ndarray | None:
    return None if data is None else np.frombuffer(zlib.decompress(data), np.uint64)


def counted(rows: DataFrame, levels: range, least: int, sent: Broadcast, block: int = BLOCK, by_place: bool = False) -> DataFrame:
    """lang, phrase, k and f of phrases of ``rows`` (lang, text) with f >= least; with k = 0 the words of each language. by_place:
    slot and bits instead of the filter that holds these phrases, and others only where they share a place of that count.
    sent: the filter of proposals and that of frequent places, packed."""
    first, end = levels.start, levels.stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, heavy = map(_unpacked, sent.value)
        for lang, ids, words in _blocks(batches, block):
            found = block_counts(ids, words, lang, range(first, end), bloom, heavy)
            if by_place:
                cells = list(_cells(found, least))
                parts = pa.array([p for p, _ in cells], pa.int32())
                yield pa.RecordBatch.from_arrays([parts, pa.array([c for _, c in cells], pa.binary())], ["part", "cell"])
            else:
                tail = pa.scalar(lang.encode("utf-8", "replace"), pa.binary())
                whole = [(pa.array([b""], pa.binary()), np.array([np.count_nonzero(ids)]))] if first == 1 else []
                for phrases, counts in chain(whole, _texts(ids, words, found)):
                    keys = pc.binary_join_element_wise(phrases, tail, b"\t").cast(pa.string())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], ["key", "n"])
            pa.default_memory_pool().release_unused()

    if by_place:
        return _reached(rows.mapInArrow(run, "part int, cell binary"), least)
    sums = rows.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("f"))
    phrase = F.substring_index("key", "\t", 1)  # words hold no tab
    k = F.when(F.length("phrase") == 0, 0).otherwise(F.size(F.split("phrase", " "))).cast("int")
    named = sums.withColumn("phrase", phrase).withColumn("lang", F.expr("substring(key, length(phrase) + 2)"))
    return named.where((F.col("f") >= least) | (F.length("phrase") == 0)).select("lang", "phrase", k.alias("k"), "f")


def _reached(cells: DataFrame, least: int) -> DataFrame:
    """slot, bits: the places whose counts come to ``least`` over all cells. Parts follow each other in a task, each added up in
    one array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, total = None, [], np.zeros(1 << WITHIN, np.min_scalar_type(least))

        def reached() -> pa.RecordBatch:
            slot, bits = _bits((held << WITHIN) + np.sort(np.concatenate(found)))
            own = np.flatnonzero(np.diff(slot, prepend=-1))
            bits = np.bitwise_or.reduceat(bits, own) if len(own) else bits
            return pa.RecordBatch.from_arrays([pa.array(slot[own]), pa.array(bits.view(np.int64))], ["slot", "bits"])

        for batch in batches:
            for part, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != held:
                    if held is not None:
                        yield reached()
                        total[:] = 0
                    held, found = part, []
                at, n = _opened(cell.as_py())  # a cell names a place once
                before = total[at]
                after = np.minimum(before + n, least)
                total[at] = after
                found.append(at[(before < least) & (after == least)])
        if held is not None:
            yield reached()

    return cells.repartition("part").sortWithinPartitions("part").mapInArrow(run, "slot long, bits long")


def joined(bloom: np.ndarray | None, found: DataFrame) -> np.ndarray:
    """The filter with the phrases of ``found`` added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.concatenate([_start(x.as_py()) for x in batch.column(0)] or [np.zeros(0, np.uint64)])
            words = [p.as_py().encode().split(b" ") for p in batch.column(1)]
            for i in range(max(map(len, words), default=0)):
                rows = np.array([r for r, w in enumerate(words) if len(w) > i])
                h[rows] = _chain(h[rows], _hashes(words[r][i] for r in rows))
            slot, bits = _bits(_place(h))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], ["slot", "bits"])

    return _added(bloom, found.where(F.col("k").between(1, LONGEST - 1)).select("lang", "phrase").mapInArrow(run, "slot long, bits long"))


def _added(bloom: np.ndarray | None, bits: DataFrame) -> np.ndarray:
    """The filter with bits added. They are or-ed in Spark; at most SLOTS rows reach the driver."""
    rows = bits.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SLOTS, np.uint64) if bloom is None else bloom.copy()
    out[rows["slot"].to_numpy()] |= rows["bits"].to_numpy().view(np.uint64)
    return out


def frequent(
    docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, lowered: float = LOWERED, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", block: int = BLOCK
) -> DataFrame:
    """lang, phrase, k (0: all words of the language), f of every phrase of at most ``LONGEST`` words with f >= least."""
    ship(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UND)).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.col(f"`{doc_id}`").alias("key"),
    )
    some = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(sample)) == 0).drop("key")
    rows = rows.drop("key")
    sc, bloom = docs.sparkSession.sparkContext, None
    for k in range(1, LONGEST):
        sent = sc.broadcast(packed(bloom, None))
        bloom = joined(bloom, counted(some, range(k, k + 1), max(1, round(least / sample * lowered)), sent, block))
        sent.destroy()
    sent = sc.broadcast(packed(bloom, None))
    heavy = _added(None, counted(rows, range(1, LONGEST + 1), least, sent, block, True))
    sent.destroy()
    sent = sc.broadcast(packed(bloom, heavy))
    found = stored(counted(rows, range(1, LONGEST + 1), least, sent, block), "phrases")
    sent.destroy()
    return found


def ranked(found: DataFrame, top: int = TOP, lanes: int = LANES) -> DataFrame:
    """The first ``top`` collocations of each language from ``frequent``'s phrases, by score, count and phrase."""
    words = F.split("phrase", " ")
    several = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("words"))
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    counts = lambda side, name: found.where("k > 0").select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    sized = cuts.join(counts("head", "l"), ["lang", "head"]).join(counts("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"({wide(1000)} * a * n) div ({wide('l')} * r)")
    weakest = F.min(F.struct(score.alias("score"), "cut", "l", "r", "n"))
    scored = sized.groupBy("lang", "phrase", "a").agg(weakest.alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.n", "w.score")

    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    longer = several.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where("b IS NULL OR 100 * b < 100 * a").drop("b")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = kept.withColumn("lane", F.pmod(F.xxhash64("phrase"), F.lit(lanes))).withColumn("rank", place("lang", "lane")).where(F.col("rank") <= top)
    listed = best.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    return listed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the strongest phrases of each language."""
    return ranked(frequent(docs, least, **options), top)
