"""Harmonic packing of token sequences.

A sequence holds ``capacity`` tokens. Piece lengths fall into reciprocal-capacity classes: class k holds pieces of
``capacity // k`` tokens, of which exactly k fill a sequence. Documents are cut so that every piece but the last has
the length of a class (the largest that still fits, again and again), and the last, under ``capacity / 64`` tokens,
has the class of its own length. A class is then filled by counting: the piece with number i goes to sequence i div k,
slot i mod k. Numbers come from lanes that workers count independently, so no task sees a whole class. A full sequence
pads less than ``capacity / 64`` tokens.

What does not fill a last sequence, fewer than k pieces in each of at most 127 classes whatever the input's size, goes
through first-fit decreasing in one small group.

Defined results: a null text is the empty text, which has the end token alone; repeated rows are packed once each;
equal ids are ordered by start and checksum; an empty table packs into nothing; columns of the input other than the id
and the text are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetra.llm.common import LANES, numbered, ship
from facetra.storage import stored

CAPACITY = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
#: Lengths below capacity / FINEST are classes of their own.
FINEST = 64
#: Distinct words that a worker remembers, in two generations of this size.
REMEMBERED = 250_000

_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s0-9a-z]+")
_MIXED = re.compile(rb"[!-~]*[\x80-\xff][!-\xff]*|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s0-9a-z\x80-\xff]+")
_ODD = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]|<\|")


class Words(dict):
    """Word bytes -> its token ids as little-endian uint32; words are encoded once and remembered for a while."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict = {}
        # the vocabulary's own alphabet for bytes: printable ones stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, raw: bytes) -> bytes:
        """Ids of bytes that the vocabulary's splitting rule leaves in one piece."""
        word = "".join(map(self.alphabet.__getitem__, raw))
        return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes() if raw else b""

    def __missing__(self, raw: bytes) -> bytes:
        ids = self.old.get(raw)
        if ids is None:
            if raw.isascii():
                ids = self.piece(raw)
            else:
                core = raw.rstrip(b".,")
                word = core.decode("utf-8")
                if word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word):
                    ids = self.piece(core) + self.piece(raw[len(core) :])
                else:
                    ids = self.plain(raw.decode("utf-8"))
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[raw] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text: what the tokenizer gives, word by word. Texts with control characters or special tokens
        go through it whole."""
        raw = text.encode("utf-8", "replace")
        if _ODD.search(raw):
            return self.plain(raw.decode("utf-8"))
        words = (_ASCII if raw.isascii() else _MIXED).findall(raw.lower())
        return b"".join(map(self.__getitem__, words))


_WORDS: dict[str, Words] = {}


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words(path: str | None = None) -> Words:
    path = path or vocabulary()
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    while rest * FINEST >= capacity:
        out.append(capacity // (capacity // (rest + 1) + 1))  # the largest class length up to rest
        rest -= out[-1]
    return out + [rest] * (rest > 0)


#: lane: where a piece is numbered; dealt out in turn, so that equal documents spread too.
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, lane int"


def pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False
) -> DataFrame:
    """One row per piece: the id, PIECES and, with with_ids, the token ids themselves (``ids array<int>``)."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string"))
    schema = StructType([narrow.schema[0], *StructType.fromDDL(PIECES + (", ids array<int>" if with_ids else ""))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import packing as own

        known, turn = own.words(tokenizer), 97 * TaskContext.get().partitionId()
        tail = np.array([own.END], "<u4").tobytes()
        for batch in batches:
            places, rows, ids = [], [], []
            for i, t in enumerate(batch.column(1)):
                raw = known.encode(t.as_py() or "") + tail
                start = 0
                for length in own.cut(len(raw) // 4, capacity):
                    part = raw[4 * start : 4 * (start + length)]
                    places.append(i)
                    rows.append((start, length, zlib.crc32(part), len(raw) // 4, turn % LANES))
                    turn += 1
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                    start += length
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.int32()]
            arrays = [batch.column(0).take(pa.array(places, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return narrow.mapInArrow(run, schema)


def _first_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """First-fit decreasing; equal lengths stay in the order of idx."""
    rows = rows.sort_values(["length", "idx"], ascending=[False, True], kind="stable")
    room: list[int] = []
    bins, offsets, first, last = [], [], 0, None
    for length in rows["length"].tolist():
        i = first if length == last else 0  # what had no room for this length has none for the next of it
        while i < len(room) and room[i] < length:
            i += 1
        if i == len(room):
            room.append(capacity)
        first, last = i, length
        bins.append(i)
        offsets.append(capacity - room[i])
        room[i] -= length
    return rows.assign(_bin=bins, offset=offsets)


def pack(found: DataFrame, doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. ``found`` is read more than once: give a stored table."""
    order = [F.col(doc_id), "start", "ids_crc32"]
    p = numbered(found, ["length"], order, "idx", F.col("lane"))
    per = F.floor(F.lit(capacity) / F.col("length"))
    sizes = found.groupBy("length").agg(F.count(F.lit(1)).alias("_n")).withColumn("_per", per).withColumn("_full", F.floor(F.col("_n") / F.col("_per")))
    before = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)  # over at most 127 classes
    classes = sizes.select(
        "length", "_per", "_full", F.coalesce(F.sum("_full").over(before), F.lit(0)).alias("_base"),
        F.sum("_full").over(Window.partitionBy()).alias("_all"),
    )
    p = p.join(F.broadcast(classes), "length")  # at most 127 rows
    inside = F.col("idx") < F.col("_full") * F.col("_per")
    columns = found.columns
    full = p.where(inside).select(
        *columns,
        (F.col("_base") + F.floor(F.col("idx") / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.pmod("idx", "_per") * F.col("length")).cast("long").alias("offset"),
    )
    rest = p.where(~inside).select(*columns, "idx", "_all")
    schema = StructType([*rest.schema, *StructType.fromDDL("_bin long, offset long")])
    fitted = rest.groupBy(F.lit(0).alias("_one")).applyInPandas(lambda rows: _first_fit(rows, capacity), schema)
    return full.unionByName(fitted.select(*columns, (F.col("_all") + F.col("_bin")).cast("long").alias("sequence_id"), "offset"))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    return pack(stored(pieces(docs, doc_id, text, capacity, tokenizer), "pieces"), doc_id, capacity)
