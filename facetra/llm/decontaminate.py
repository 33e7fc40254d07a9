"""Benchmark decontamination with an Aho-Corasick automaton over normalised items.

Words are runs of a-z, 0-9 and bytes over 0x7F after A-Z are lower-cased. Every window of ten words of an item (an item
of fewer words is one window) is a pattern ``" w1 ... w10 "`` of one automaton; each document is normalised the same way
and scanned once. Matches are word ranges, which are mapped back to character offsets of the original text.

Windows are cut in Spark and dealt by hash to blocks of about ``block_bytes``, so that what reaches the driver at once, is
broadcast and makes the automaton in a task has a fixed bound; one block is the usual case. With more, each block is a
scan of its own over the stored result of the one before, and the ranges are merged per row.

Defined results: a null or wordless text has no words and no hits; null or wordless items are left out, and without any
other item nothing is hit; items with equal texts or equal ids are each counted once per id; repeated document rows are
scanned row by row; other columns pass through, but for those with the names of results, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from facetra.llm.common import fresh, mapped, ship
from facetra.storage import stored

WINDOW = 10
#: Window text in one automaton; about 30 times as much memory in a task.
BLOCK_BYTES = 8_000_000

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_AUTOMATA: dict[str, object] = {}


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(words: list[bytes]) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))]


def patterns(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """pattern, item: the distinct windows of every item, padded with a space on either side."""
    ship(items.sparkSession)
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import decontaminate as own

        for batch in batches:
            for key, t in zip(*batch.columns, strict=True):
                found = [f" {w.decode('latin-1')} " for w in dict.fromkeys(own.windows(own.normalised(t.as_py())))]
                for lo in range(0, len(found), 10_000):
                    part = found[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([key.as_py()] * len(part), pa.string())], ["pattern", "item"])

    return rows.mapInArrow(run, "pattern string, item string").distinct()


def _automaton(key: str, block: dict[str, list[str]]):
    """The automaton of a block; None without a pattern."""
    if key not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()  # one at a time
        a = ahocorasick.Automaton()
        for p, ids in block.items():
            a.add_word(p, (len(p), ids))
        a.make_automaton()
        _AUTOMATA[key] = a if block else None
    return _AUTOMATA[key]


def scan(text: str | None, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged ranges [first, last) of hit words, ids of items with a window here."""
    words = normalised(text)
    line = f" {b' '.join(words).decode('latin-1')} "
    ends = list(automaton.iter(line)) if words and automaton is not None else []
    if not ends:
        return len(words), [], set()
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(gaps, np.array([e for e, _ in ends]))
    first = np.searchsorted(gaps, np.array([e - n + 1 for e, (n, _) in ends]))
    ranges: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist(), strict=True)):
        if ranges and a <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], b)
        else:
            ranges.append([a, b])
    return len(words), [(a, b) for a, b in ranges], {i for _, (_, ids) in ends for i in ids}


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character offsets [start, end) of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in ranges]


RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
OUT = "n_words long, hit_ranges array<struct<first:long,last:long>>, hit_items array<string>"


def _scan_block(docs: DataFrame, text: str, block: dict[str, list[str]], names: list[str], keep: list[str]) -> DataFrame:
    """The columns of docs in keep, with the columns of OUT under these names."""
    key = hashlib.sha1(repr(sorted(block.items())).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(block)  # about BLOCK_BYTES
    place = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import decontaminate as own

        automaton = own._automaton(key, sent.value)
        for batch in batches:
            found = [own.scan(t.as_py(), automaton) for t in batch.column(place)]
            n, ranges, items = zip(*found, strict=True) if found else ((), (), ())
            new = [
                pa.array(n, pa.int64()),
                pa.array([[{"first": a, "last": b} for a, b in r] for r in ranges], own.RANGES),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *new], [*[batch.schema.names[i] for i in kept], *names])

    fields = [StructField(n, f.dataType) for n, f in zip(names, StructType.fromDDL(OUT), strict=True)]
    return mapped(docs, run, StructType([*[docs.schema[i] for i in kept], *fields]))


RESULTS = ("n_words", "hit_ranges", "hit_items", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns in keep) with n_words, hit_ranges (merged word ranges), hit_items (ids, sorted as strings), n_hit, n_items,
    items_sha256, contaminated. An input column with such a name is replaced; keep cannot name one."""
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() not in RESULTS or c == text]
    wanted = [c for c in (columns if keep is None else keep) if c.lower() not in RESULTS]
    found = docs.select(*[F.col(f"`{c}`") for c in columns])
    dealt = patterns(items, item_id, item_text)
    cost = F.length("pattern") + F.length("item") + 8
    total = dealt.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    if n_blocks > 1:
        dealt = stored(dealt.withColumn("block", F.pmod(F.xxhash64("pattern", "item"), F.lit(n_blocks))), "patterns")
    last = [fresh(docs.columns, f.name) for f in StructType.fromDDL(OUT)]
    for k in range(n_blocks):
        block: dict[str, list[str]] = {}
        for r in (dealt.where(F.col("block") == k) if n_blocks > 1 else dealt).toLocalIterator():  # about block_bytes
            block.setdefault(r["pattern"], []).append(r["item"])
        end = k == n_blocks - 1
        if k == 0:
            found = _scan_block(found, text, block, last, wanted if end else columns)
        else:
            new = [fresh([*found.columns, *docs.columns], f"new_{c}") for c in last]
            one = _scan_block(found, text, block, new, [*wanted, *last] if end else found.columns)
            found = one.withColumns({last[1]: _merged(last[1], new[1]), last[2]: F.array_sort(F.array_union(last[2], new[2]))}).drop(*new)
        if not end:
            found = stored(found, "scanned")
    body = [F.col(f"`{c}`") for c in wanted]
    found = found.select(*body, *[F.col(c).alias(n.name) for c, n in zip(last, StructType.fromDDL(OUT), strict=True)])
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    return found.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("hit_items").cast("long"),
            "items_sha256": F.sha2(F.array_join("hit_items", ",").cast("binary"), 256),
            "contaminated": n_hit > 0,
        }
    )


def _merged(one: str, other: str) -> Column:
    """Two lists of ranges as one of disjoint ranges."""
    start = F.array().cast("array<struct<first:bigint,last:bigint>>")
    end = lambda a: F.get(a, F.size(a) - 1)
    return F.aggregate(
        F.array_sort(F.concat(one, other)),
        start,
        lambda a, r: F.when(
            (F.size(a) > 0) & (r["first"] <= end(a)["last"]),
            F.concat(
                F.slice(a, F.lit(1), F.size(a) - 1),
                F.array(F.struct(end(a)["first"].alias("first"), F.greatest(end(a)["last"], r["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(a, F.array(r))),
    )
