"""Near-duplicates by b-bit MinHash.

``signatures`` reads each text once and gives, per document, the size of its set of five-word shingles, a digest of its
sequence of words, two hashed bits of each of 240 minima packed into eight longs and one key per band of five whole
minima. Documents with equal sequences of words meet by digest (SHA-256); one of them stands for all from there on. Band
keys generate candidates, bit counts of the packed signatures estimate the similarity (corrected for chance agreement of
two bits), and pairs that could reach the threshold are confirmed on their texts, as exact integers over whole sets of
shingles, not of hashes.

Pairs are not expanded within a bucket. First, each document meets one pivot: the member of its buckets that shares most buckets
with others. Confirmed links merge into components, and only what is still apart within a bucket is compared: buckets of up to
``SMALL`` members as pairs; of larger ones the members outside the bucket's largest component with that component and
with each other, in blocks inside a task. Blocks hold packed signatures and hashed sets, skip what is connected by then
and emit no more than a spanning forest, whose links are confirmed on texts too. So a large group of copies makes rows in
proportion to its members. Links within a component cannot change it, and no other pair of a bucket is left out.

Words are hashed one by one (BLAKE2b), and shingles by sums of word hashes times random odd factors, so that words of any
structure differ. Should a link of a block fail on the texts all the same, the blocks are compared again under another key.

Two sets of similarity 0.75 share no band with probability (1 - 0.75^5)^48, under 3 in a million.

Defined results: A-Z are lower-cased; a text with fewer words than five is one shingle of all its words; null and
wordless texts have an empty set and are linked with nothing, so they are kept; repeated rows get equal results; rows
that share an id follow their own sets, and representatives that share an id count as one document (give rows ids of
their own to keep them apart); rows with a null id are kept, outside of components; further columns are not read; an
empty table gives an empty table. A task holds one text and its set at a time, and a block's hashed sets.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetra.llm.common import ship
from facetra.storage import clean, mark, stored

SHINGLE = 5
#: Linked from intersection / union = PART / WHOLE on.
PART, WHOLE = 75, 100
BANDS, ROWS = 48, 5
MINIMA = BANDS * ROWS
#: Bits of each minimum that are kept. The estimate of a pair of similarity 0.75 lies over five standard deviations above the margin.
BITS = 2
MARGIN = 0.55
#: Members of a bucket that are compared as pairs of rows, and members of a larger one's block.
SMALL, BLOCK = 8, 1024
#: Pairs of one document that are confirmed side by side.
SLICE = 256
#: Shingles worked on at once.
CHUNK = 1 << 16
#: Bytes of a text whose words are looked up at once, and of the texts of one batch of signatures.
SEGMENT, BATCH = 1 << 22, 1 << 23
#: Distinct words that a task remembers.
REMEMBERED = 1_000_000

_GAP = re.compile(rb"[ \t-\r]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@functools.cache
def _constants() -> tuple[np.ndarray, ...]:
    """Multipliers of the shingle's words, and the 240 hash functions; all from fixed seeds."""
    r = np.random.default_rng(20_240_101)
    steps = r.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
    a = r.integers(1, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = r.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)
    return steps, a, b


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> its number; ``hashes`` holds a 64-bit hash of the word of each number."""

    def __init__(self, key: int = 0):
        self.key, self.hashes = key.to_bytes(4, "big"), np.empty(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.empty(n, np.uint64)))
        self.hashes[n] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        self[word] = n
        return n


def numbers(raw: bytes, known: Words) -> tuple[np.ndarray, bytes]:
    """The numbers of a text's words, and a digest of their sequence; long texts are taken in segments that end at a space."""
    if len(known) > REMEMBERED:
        known.clear()  # numbers are compared within a text only
    parts, digest, lo = [np.zeros(0, np.int64)], hashlib.sha256(), 0
    while lo < len(raw):
        end = _GAP.search(raw, lo + SEGMENT) if lo + SEGMENT < len(raw) else None
        hi = end.start() if end else len(raw)
        words = raw[lo:hi].translate(_LOWER).split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if words:
            digest.update(b" ".join(words) + b" ")
        lo = hi
    return np.concatenate(parts), digest.digest()


def hashed_set(ids: np.ndarray, known: Words) -> tuple[np.ndarray, int]:
    """Distinct hashes of the shingles, sorted, and how many shingles there are. Shingles with equal hashes are compared
    word by word for the count."""
    w = known.hashes[ids]
    if not len(w):
        return w, 0
    steps, *_ = _constants()
    if len(w) < SHINGLE:
        return _mix((w * steps[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w))), 1
    n = len(w) - SHINGLE + 1
    x = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        x += w[j : j + n] * steps[j]
    x = _mix(x + np.uint64(SHINGLE))
    found = np.sort(x)
    again = found[1:] == found[:-1]
    if not again.any():
        return found, n
    order = np.argsort(x, kind="stable")
    first, second = order[:-1][again], order[1:][again]
    found = found[np.concatenate(([True], ~again))]
    if all((ids[first + j] == ids[second + j]).all() for j in range(SHINGLE)):
        return found, len(found)
    return found, len(np.unique(np.lib.stride_tricks.sliding_window_view(ids, SHINGLE), axis=0))


def shingle_hashes(raw: bytes, known: Words | None = None) -> np.ndarray:
    """Distinct hashes of the shingles, sorted."""
    known = Words() if known is None else known
    return hashed_set(numbers(raw, known)[0], known)[0]


def shingles(text: str | None) -> set:
    """The set of shingles itself: five words joined by a space, which no word holds."""
    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if len(w) < SHINGLE:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*[w[j:] for j in range(SHINGLE)], strict=False)))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """240 minima (uint32) of each non-empty set; worked on in chunks that stay in the cache."""
    _, a, b = _constants()
    out = np.full((MINIMA, len(sets)), 0xFFFFFFFF, np.uint32)
    buffer = np.empty(CHUNK, np.uint32)

    def run(part: list[np.ndarray], at: list[int]) -> None:
        x = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(p) for p in part[:-1]]])
        h = buffer[: len(x)]
        for k in range(MINIMA):
            np.multiply(x, a[k], out=h)
            np.add(h, b[k], out=h)
            out[k, at] = np.minimum(out[k, at], np.minimum.reduceat(h, starts))

    part, at, size = [], [], 0
    for i, s in enumerate(sets):
        for lo in range(0, len(s), CHUNK):
            piece = s[lo : lo + CHUNK]
            if size + len(piece) > CHUNK:
                run(part, at)
                part, at, size = [], [], 0
            part.append(piece)
            at.append(i)
            size += len(piece)
    if part:
        run(part, at)
    return out


def packed(found: np.ndarray) -> np.ndarray:
    """BITS of the minima of each set, in longs.

    They come from a hash of minimum and function: the low bits of a * x + b themselves depend on those of x alone, so
    that two elements would agree by chance in all minima or in none.
    """
    per = 64 // BITS
    seeds = _mix(np.arange(1, MINIMA + 1, dtype=np.uint64))[:, None]
    low = _mix(found + seeds) & np.uint64((1 << BITS) - 1)
    longs = -(-MINIMA // per)
    out = np.zeros((longs, found.shape[1]), np.uint64)
    for k in range(MINIMA):
        out[k // per] |= low[k] << np.uint64(BITS * (k % per))
    return out.T


def band_keys(found: np.ndarray) -> np.ndarray:
    keys = np.zeros((BANDS, found.shape[1]), np.uint64)
    for k in range(BANDS):
        x = np.full(found.shape[1], k, np.uint64)
        for j in range(ROWS):
            x = _mix(x + found[k * ROWS + j])
        keys[k] = x
    return keys.T


SIGNATURE = "n_shingles long, print_a long, print_b long, packed array<long>, bands array<long>"


def batched(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose second column, texts, stays within BATCH bytes, a longer text alone."""
    for whole in batches:
        lo, size = 0, 0
        lengths = [0 if n is None else n for n in pc.binary_length(whole.column(1)).to_pylist()]
        for i, n in enumerate(lengths):
            if i > lo and (size + n > BATCH or i - lo == rows):
                yield whole.slice(lo, i - lo)
                lo, size = i, 0
            size += n
        if lo < whole.num_rows:
            yield whole.slice(lo)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and SIGNATURE per row; packed and bands are null for an empty set."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([narrow.schema[0], *StructType.fromDDL(SIGNATURE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import near_dedup as own

        known = own.Words()
        for batch in own.batched(batches):
            read = [own.numbers((t.as_py() or "").encode("utf-8", "replace"), known) for t in batch.column(1)]
            found = [own.hashed_set(ids, known) for ids, _ in read]
            some = np.flatnonzero([n > 0 for _, n in found])
            least = own.minima([found[i][0] for i in some])
            wide = np.zeros((len(found), -(-own.MINIMA * own.BITS // 64)), np.uint64)
            keys = np.zeros((len(found), own.BANDS), np.uint64)
            wide[some], keys[some] = own.packed(least), own.band_keys(least)
            none = pa.array(np.array([n == 0 for _, n in found]))
            lists = []
            for m in (wide, keys):
                values = pa.array(m.view(np.int64).reshape(-1))
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * m.shape[1])
                lists.append(pa.ListArray.from_arrays(offsets, values, mask=none))
            prints = np.frombuffer(b"".join(d[:16] for _, d in read), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), *lists],
                schema.names,
            )

    return narrow.mapInArrow(run, schema)


def estimate(a, b):
    """Similarity from packed signatures: agreeing minima by bit counts, corrected for chance (SQL functions)."""
    low = 0x5555555555555555  # one bit for each two-bit minimum
    differ = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)),
        F.lit(0),
        lambda n, x: n + F.bit_count((x.bitwiseOR(F.shiftright(x, 1))).bitwiseAND(F.lit(low))),
    )
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(MINIMA))) - chance) / (1 - chance)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) those linked on full sets.

    The texts of a's partners meet in slices of about SLICE, each with a's own text in front, so that a text moves once
    per pair and a's own once per slice, and no task gets all partners of one document.
    """
    ship(pairs.sparkSession)
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SLICE))).cast("int").alias("slices"))
    dealt = pairs.join(slices, "a").select("a", F.pmod(F.xxhash64("b"), "slices").cast("int").alias("slice"), "b")
    asked = dealt.select(F.col("b").alias("rep"), "a", "slice", F.lit(True).alias("partner")).union(
        dealt.select("a", "slice").distinct().select("a", "a", "slice", F.lit(False))
    )
    rows = _meet(texts, asked, "rep").select("a", "slice", "partner", "rep", "text")
    rows = rows.repartition("a", "slice").sortWithinPartitions("a", "slice", "partner", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import near_dedup as own

        last, mine = None, []
        for batch in batches:
            keep = []
            for i, (a, slice_, partner, text) in enumerate(zip(*[batch.column(k) for k in (0, 1, 2, 4)], strict=True)):
                key, found = (a.as_py(), slice_.as_py()), own.shingles(text.as_py())
                if key != last:
                    last, mine = key, []
                if not partner.as_py():
                    mine += [found] if found not in mine else []
                elif any(own.linked(len(found & s), len(found), len(s)) for s in mine):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 3)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _meet(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the documents: sorted on both sides at every size, never broadcast."""
    return a.join(b.hint("merge"), on, how)


def linked(both: int, one: int, other: int) -> bool:
    return WHOLE * both >= PART * (one + other - both)


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """rep, component (smallest rep reachable) for every node, by large-star and small-star steps on (a, b) links.

    A step needs only the minimum of each node's neighbours, an aggregate, and one join; links are stored after each
    pair of steps, and the loop ends when they stop changing, after a number of rounds that grows with the logarithm of
    the longest chain.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")).toDF("u", "v") if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = links.select("a", "b").where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, at = None, mark()
    while True:
        edges = stored(star(star(edges, True), False), "links")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == state or not now[0]:
            break
        state = now
        clean(at, edges)
    return nodes.join(edges.select(F.col("a").alias("rep"), F.col("b").alias("component")), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("component")
    )


def _near_rows(packed: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of row i with others."""
    x = packed[others] ^ packed[i]
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1)
    return ((1 - differ / MINIMA) - 0.25) / 0.75


def _sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(rows["side"].to_numpy() == 0)
    return left, left if rows["same"].iloc[0] else np.flatnonzero(rows["side"].to_numpy() == 1)


def _involved(rows: pd.DataFrame) -> pd.DataFrame:
    """Members of a block that may be similar to one of another component."""
    packed = np.stack([np.asarray(p, np.int64) for p in rows["packed"]]).view(np.uint64)
    comp = rows["component"].to_numpy()
    left, right = _sides(rows)
    found = np.zeros(len(rows), bool)
    for i in left:
        others = right[comp[right] != comp[i]]
        if len(others):
            near = others[_near_rows(packed, i, others) >= MARGIN]
            found[near] = True
            found[i] |= len(near) > 0
    return rows[found]


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links of a block by its hashed sets, over the components so far."""
    packed = np.stack([np.asarray(p, np.int64) for p in rows["packed"]]).view(np.uint64)
    sets = [np.asarray(x, np.int64).view(np.uint64) for x in rows["hashes"]]
    rep, comp = rows["rep"].to_numpy(), rows["component"].to_numpy()
    left, right = _sides(rows)
    _, group = np.unique(comp, return_inverse=True)  # group numbers, renumbered as they merge
    out = []
    for i in left:
        others = right[group[right] != group[i]]
        near = _near_rows(packed, i, others)
        for j in others[np.argsort(-near, kind="stable")][: int((near >= MARGIN).sum())]:
            if group[i] != group[j]:
                if linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
                    group[group == group[j]] = group[i]
    return pd.DataFrame(out, columns=["a", "b"])


def full_sets(texts: DataFrame, key: int = 0) -> DataFrame:
    """rep, hashes: all shingles of a text as sorted 64-bit hashes under a key."""
    ship(texts.sparkSession)
    narrow = texts.select("rep", F.col("text").cast("string").alias("text"))
    schema = StructType([narrow.schema[0], *StructType.fromDDL("hashes array<long>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import near_dedup as own

        known = own.Words(key)
        for batch in own.batched(batches):
            sets = [own.shingle_hashes((t.as_py() or "").encode("utf-8", "replace"), known).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], schema.names)

    return narrow.mapInArrow(run, schema)


def _dealt(large: DataFrame) -> DataFrame:
    """Members of large buckets, dealt to the blocks that they are compared in.

    A bucket's stragglers, those outside its largest component, make blocks 0, 1 and so on, that component the blocks
    after them. Two blocks meet unless both are of the largest component; so its members go to as many tasks as there
    are blocks of stragglers, and no further.
    """
    straggler = F.col("component") != F.col("main")
    blocks = lambda n: F.ceil(n / F.lit(float(BLOCK))).cast("int")
    rows = large.withColumns({"_s": blocks(F.col("n") - F.col("n_main")), "_l": blocks(F.col("n_main")), "_h": F.xxhash64("rep")})
    own = F.when(straggler, F.pmod("_h", F.col("_s"))).otherwise(F.col("_s") + F.pmod("_h", F.col("_l"))).cast("int")
    end = F.when(straggler, F.col("_s") + F.col("_l")).otherwise(F.col("_s")) - 1
    met = rows.select("key", "rep", "component", "packed", own.alias("own"), F.explode(F.sequence(F.lit(0), end)).alias("with"))
    return met.select(
        "key", "rep", "component", "packed", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"),
        (F.col("own") > F.col("with")).cast("int").alias("side"), (F.col("own") == F.col("with")).alias("same"),
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of docs."""
    at = mark()
    signed = stored(signatures(docs, doc_id, text), "signatures")
    sets = signed.where(F.col("bands").isNotNull() & F.col("doc_id").isNotNull())
    same = ["print_a", "print_b"]
    reps = sets.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("packed", "bands"), "doc_id").alias("s"))
    reps = stored(reps.select("rep", *same, "s.packed", "s.bands"), "reps")
    texts = docs.select(F.col(f"`{doc_id}`").alias("rep"), F.col(f"`{text}`").alias("text"))

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = stored(_meet(keyed, buckets, "key"), "members")
    met = stored(members.groupBy("rep").agg(F.sum("n").alias("met")), "met")  # how many others a document meets
    used = met.select("rep")
    sigs = stored(_meet(reps, used, "rep", "left_semi").select("rep", "packed"), "packed")
    texts = stored(_meet(texts, used, "rep", "left_semi"), "texts")  # whole texts move by id once; later joins have these alone

    def near(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
        first, other = sigs.select(F.col("rep").alias("a"), F.col("packed").alias("x")), sigs.select(F.col("rep").alias("b"), F.col("packed").alias("y"))
        return _meet(_meet(pairs, first, "a"), other, "b").where(estimate(F.col("x"), F.col("y")) >= MARGIN).select("a", "b")

    # first: each document and the pivot that meets most others
    pivots = _meet(members, met, "rep").groupBy("key").agg(F.max(F.struct("met", F.col("rep").alias("pivot"))).alias("p"))
    chosen = _meet(members, pivots, "key").where(F.col("p.pivot") != F.col("rep")).groupBy("rep").agg(F.max("p").alias("p"))
    tested = stored(near(chosen.select(F.col("p.pivot").alias("a"), F.col("rep").alias("b"))), "tested")
    links = stored(confirmed(tested, texts), "confirmed")
    group = stored(components(links, used), "components")

    # then what is still apart within a bucket
    own = _meet(members, group, "rep")
    sizes = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    left = own.join(mixed.select("key", F.col("m.component").alias("main"), F.col("m.c").alias("n_main")), "key")
    left = stored(left, "apart")
    clean(at, signed, reps, sigs, texts, met, tested, links, group, left)
    listed = left.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "component"))).alias("m"))
    two = F.flatten(
        F.transform("m", lambda x, i: F.transform(F.filter("m", lambda y, j: (j > i) & (x["component"] != y["component"])), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b"))))
    )
    few = stored(near(listed.select(F.inline(two))).join(tested, ["a", "b"], "left_anti"), "few")
    more = stored(confirmed(few, texts), "confirmed")

    dealt = _dealt(_meet(left.where(F.col("n") > SMALL), sigs, "rep"))
    involved = stored(dealt.groupBy("key", "lo", "hi").applyInPandas(_involved, dealt.schema), "involved")
    kind = reps.schema["rep"].dataType.simpleString()
    for key in itertools.count():
        full = stored(full_sets(_meet(texts, involved.select("rep").distinct(), "rep", "left_semi"), key), "sets")
        forest = _meet(involved, full, "rep").groupBy("key", "lo", "hi").applyInPandas(_block_links, f"a {kind}, b {kind}")
        forest = stored(forest.distinct(), "forest")
        inside = stored(confirmed(forest, texts), "confirmed")
        if inside.count() == forest.count():
            break
    more = stored(more.union(inside).distinct(), "confirmed")
    if not more.isEmpty():
        group = stored(components(links.union(more), used), "components")
    clean(at, signed, reps, group)

    of = reps.join(group, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    full = signed.drop("packed", "bands").join(of, same, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
