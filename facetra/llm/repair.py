"""Conversation structure repair: the cheapest edits that make a log alternate, by one integer-minimum search.

``damage`` spoils a log in known ways, ``repair`` finds faults and the cheapest edits (Keep, Rerole, Delete, Insert) after
which the initials of the roles read ``(s?(ua)+)?``. A path through the graph of (row, state of that pattern) weighs one
integer: its high digits are the cost, its low digits, base 8 and as many as letters can be, are the letters of the edits
in order, with zeros at the end. The least integer is thus the cheapest path and, of those, the first in ASCII order.
Of two paths over the same rows with the same cost neither continues the other (it would hold more inserts, which cost),
so the first digit that differs decides and a minimum at every node is enough.

No task holds a conversation. Equal rows are counted first; rows are range-partitioned and sorted by conversation and
turn, and cut into segments of at most ``SEGMENT`` rows. A segment gives the least path from each state to each state, as
it is not known in which state it begins; a pass over a conversation's segments, without texts, adds paths up, keeps the
digits that all live paths share aside, and so settles where each segment begins. Segments are then rendered side by side,
and what is left of a conversation is hashed segment by segment in order. A conversation's audit is one cell and so in
memory once.

Defined results: a null in the key, the role or the text is one space; rows are ordered by turn (nulls first), then role,
then text; a null conversation id is a conversation of its own; a conversation of which no row is left gets zeros, an empty
audit and the hash of nothing; further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from facetra.llm.common import ship
from facetra.storage import stored

#: Costs of the edits, and the pattern's states: start, after s, after u, after a.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = (2, 2, 3, 2)  # the state after a row whose role is chosen: assistant after u, else user
FINAL = (0, 3)
#: Digits of the letters, in ASCII order; 0 is the end.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
BITS = 3
#: Rows, and characters of text, after which a segment ends.
SEGMENT, SEGMENT_CHARS = 256, 1 << 20

SPACE = r"\x20\x09-\x0D"


def _struct(fields: str) -> StructType:
    out = StructType()
    for field in fields.split():
        out.add(*field.split(":"))
    return out


SEGMENTS = (
    _struct("conv:string part:integer seg:integer head:string last:string blank:long duplicate:long truncated:long illegal:long lo:long hi:long turns:long first_turn:long last_turn:long")
    .add("ways", ArrayType(_struct("start:integer end:integer cost:long letters:string")))
    .add("rows", ArrayType(_struct("role:string text:string forced:long free:boolean")))
)
FOUND = _struct(
    "conv:string part:integer seg:integer start:integer end:integer tail:string gaps:long blank:long duplicate:long truncated:long illegal:long cost:long audit:string"
)
SAID = _struct("conv:string part:integer seg:integer n:integer said:string")


def _named(value: Column) -> Column:
    """A value as text that is never null; different values, null too, give different texts."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv (a text for the id), turn, role, text, copies of the rows that are left."""
    col = lambda c: F.col(f"`{c}`")
    space = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", space(conv_id), space(turn)).cast("binary")) % 20
    rows = turns.select(_named(col(conv_id)).alias("conv"), col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), code.alias("code"))
    said = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("code != 0").select(
        "conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("copies")
    )


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies of distinct rows, with blank, truncated and seen (an earlier turn has role and text)."""
    keys = ["conv", "at", "role", "digest"]
    keyed = rows.withColumn("at", _named(F.col("turn"))).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    one = keyed.groupBy(*keys).agg(F.first("turn").alias("turn"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
    order = F.struct(F.col("turn").isNotNull(), "turn", "at")
    first = keyed.groupBy("conv", "role", "digest").agg(F.min(order)["at"].alias("at")).withColumn("first", F.lit(True))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    return one.join(first, keys, "left").select(
        "conv", "turn", "role", "text", "copies", blank.alias("blank"), F.col("first").isNull().alias("seen"), (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("truncated")
    )


def least_paths(rows: list[tuple[str, int, bool, bool]], starts: tuple[int, ...]) -> list[tuple[int, int, int, str]]:
    """start, end, cost and letters (as digits) of the least path over rows (initial, forced deletions after it, free to be
    kept, truncated) between every two states. Inserts stand before a row; those after the last one are left to the caller."""
    room = sum(forced + free for _, forced, free, _ in rows) + 2 * len(rows)
    unit, out = BITS * room, []

    def edge(at: tuple[int, int], cost: int, digits: int, n: int) -> tuple[int, int]:
        weight, used = at
        return weight + (cost << unit) + (digits << BITS * (room - used - n)), used + n

    def keep_least(best: dict, state: int, path: tuple[int, int]) -> None:
        if state not in best or path[0] < best[state][0]:
            best[state] = path

    for start in starts:
        best = {start: (0, 0)}
        for initial, forced, free, truncated in rows:
            for _ in range(2):
                for state, path in list(best.items()):
                    keep_least(best, GIVEN[state], edge(path, INSERT, LETTERS["I"], 1))
            after: dict = {}
            extra = TRUNCATED if truncated else 0
            for state, path in best.items():
                if free:
                    if initial in NEXT[state]:
                        keep_least(after, NEXT[state][initial], edge(path, extra, LETTERS["K"], 1))
                    keep_least(after, GIVEN[state], edge(path, REROLE + extra, LETTERS["R"], 1))
                    keep_least(after, state, edge(path, DELETE, LETTERS["D"], 1))
                else:
                    keep_least(after, state, path)
            run = ((1 << BITS * forced) - 1) // ((1 << BITS) - 1) * LETTERS["D"]
            best = {s: edge(p, DELETE * forced, run, forced) for s, p in after.items()} if forced else after
        for end, (weight, used) in best.items():
            digits = (weight & ((1 << unit) - 1)) >> BITS * (room - used)
            out.append((start, end, weight >> unit, f"{digits:0{used}o}" if used else ""))
    return out


def _segment(conv: str, part: int, seg: int, rows: list[tuple], opens: bool) -> dict:
    """A row of SEGMENTS from rows (turn, role, text, copies, blank, seen, truncated). opens: the conversation begins here."""
    known = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    legal = ("su", "ua", "au")
    free = [not (r[4] or r[5]) for r in rows]
    forced = [r[3] - f for r, f in zip(rows, free, strict=True)]
    ways = least_paths([(i, n, f, r[6]) for i, n, f, r in zip(initials, forced, free, rows, strict=True)], (0,) if opens else (0, 1, 2, 3))
    return {
        "conv": conv, "part": part, "seg": seg, "head": initials[0], "last": initials[-1],
        "blank": sum(r[3] for r in rows if r[4]),
        "duplicate": sum(n for r, n in zip(rows, forced, strict=True) if not r[4]),
        "truncated": sum(f and r[6] for r, f in zip(rows, free, strict=True)),
        "illegal": sum(r[3] - 1 for r in rows) + sum(a + b not in legal for a, b in zip(initials, initials[1:], strict=False)),
        "lo": min(known, default=None), "hi": max(known, default=None), "turns": len(set(known)), "first_turn": rows[0][0], "last_turn": rows[-1][0],
        "ways": [dict(zip(("start", "end", "cost", "letters"), w, strict=True)) for w in ways],
        "rows": [{"role": r[1] if f else None, "text": r[2] if f else None, "forced": n, "free": f} for r, n, f in zip(rows, forced, free, strict=True)],
    }


class _Rows:
    """Rows that go out together, some hundreds or some MB at a time."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.held, self.size = schema, [], 0

    def add(self, row: dict, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.held.append(row)
        self.size += size
        if len(self.held) >= 500 or self.size >= SEGMENT_CHARS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_pylist(self.held, self.schema)
        self.held, self.size = [], 0


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """SEGMENTS of the rows of ``faults``; (part, seg) names a segment and orders those of a conversation."""
    ship(rows.sparkSession)
    order = ["conv", "turn", "role"]
    ordered = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    schema = to_arrow_schema(SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, conv, held, chars, opens = TaskContext.get().partitionId(), 0, None, [], 0, False
        out = _Rows(schema)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (row[0] != conv or len(held) >= size or chars >= SEGMENT_CHARS):
                    yield from out.add(_segment(conv, part, seg, held, opens), chars)
                    seg, held, chars, opens = seg + 1, [], 0, row[0] != conv
                conv = row[0]
                held.append(row[1:])
                chars += len(row[3])
        if held:
            yield from out.add(_segment(conv, part, seg, held, opens), chars)
        yield from out.rest()

    return ordered.select("conv", "turn", "role", "text", "copies", "blank", "seen", "truncated").mapInArrow(run, SEGMENTS)


class _Conversation:
    """Least paths and counts over the segments met so far."""

    def __init__(self, conv: str):
        self.conv, self.shared, self.cut = conv, [], 0
        self.live = {0: (0, "", None)}  # state: cost, digits after those in ``shared``, the segments before
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.lo = self.hi = self.last = self.last_turn = None

    def _least(self, ways: list[tuple[int, int, str, object]]) -> dict:
        """The least of ways (state, cost, digits, segments) for each state, as integers of one width."""
        room = max(len(w[2]) for w in ways)
        best: dict = {}
        for state, cost, digits, node in ways:
            weight = (cost << BITS * room) + int(digits.ljust(room, "0") or "0", 8)
            if state not in best or weight < best[state][0]:
                best[state] = (weight, cost, digits, node)
        return {s: b[1:] for s, b in best.items()}

    def add(self, s: dict) -> None:
        for k in self.sums:
            self.sums[k] += s[k]
        if self.last is not None:
            self.sums["illegal"] += self.last + s["head"] not in ("su", "ua", "au")
            self.sums["turns"] -= s["first_turn"] is not None and s["first_turn"] == self.last_turn
        self.last, self.last_turn = s["last"], s["last_turn"]
        if s["lo"] is not None:
            self.lo, self.hi = (s["lo"], s["hi"]) if self.lo is None else (min(self.lo, s["lo"]), max(self.hi, s["hi"]))
        ways = []
        for w in s["ways"]:
            if w["start"] in self.live:
                cost, digits, node = self.live[w["start"]]
                ways.append((w["end"], cost + w["cost"], digits + w["letters"], (node, s["part"], s["seg"], w["start"], w["end"])))
        self.live = self._least(ways)
        same = len(os.path.commonprefix([d for _, d, _ in self.live.values()]))
        if same:
            self.shared.append(next(iter(self.live.values()))[1][:same])
            self.live = {q: (c, d[same:], n) for q, (c, d, n) in self.live.items()}

    def rows(self) -> Iterator[dict]:
        """Where each segment begins and ends, and the conversation's own row."""
        insert, ways = str(LETTERS["I"]), []
        for state, (cost, digits, node) in self.live.items():
            tail = ""
            while state not in FINAL:
                state, cost, tail = GIVEN[state], cost + INSERT, tail + insert
            ways.append((0, cost, digits + tail, (node, tail)))
        ((cost, digits, (node, tail)),) = self._least(ways).values()
        names = str.maketrans({str(d): letter for letter, d in LETTERS.items()})
        while node:
            before, part, seg, start, end = node
            yield {"conv": self.conv, "part": part, "seg": seg, "start": start, "end": end, "tail": tail}
            node, tail = before, ""
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.sums.pop("turns")
        self.sums.pop("turns", None)
        yield {"conv": self.conv, "gaps": gaps, "cost": cost, "audit": ("".join(self.shared) + digits).translate(names), **self.sums}


def settled(cut: DataFrame) -> DataFrame:
    """FOUND: a row for each segment with the states where it begins and ends, and one for each conversation (part null)."""
    schema = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, _Rows(schema)
        for batch in batches:
            for s in batch.to_pylist():
                if now is None or s["conv"] != now.conv:
                    for row in now.rows() if now else ():
                        yield from out.add(row, len(row.get("audit", "")))
                    now = _Conversation(s["conv"])
                now.add(s)
        for row in now.rows() if now else ():
            yield from out.add(row, len(row.get("audit", "")))
        yield from out.rest()

    narrow = cut.select(*[c for c in cut.columns if c != "rows"])
    return narrow.repartition("conv").sortWithinPartitions("conv", "part", "seg").mapInArrow(run, FOUND)


def lines(rows: list[dict], letters: str, start: int) -> list[str]:
    """``role:text`` of what the edits leave of a segment's rows."""
    state, out, at = start, [], 0

    def given(text: str) -> None:
        nonlocal state
        out.append(f"{'assistant' if state == 2 else 'user'}:{text}")
        state = GIVEN[state]

    def inserts() -> None:
        nonlocal at
        while at < len(letters) and letters[at] == "2":
            given("")
            at += 1

    for row in rows:
        inserts()
        if row["free"]:
            if letters[at] == "4":
                given(row["text"])
            elif letters[at] == "3":
                out.append(f"{row['role']}:{row['text']}")
                state = NEXT[state][row["role"][:1]]
            at += 1
        at += row["forced"]
    inserts()
    return out


def rendered(cut: DataFrame, found: DataFrame) -> DataFrame:
    """conv, part, seg, n (lines) and said, the repaired lines of each segment."""
    way = F.filter("ways", lambda w: (w["start"] == F.col("start")) & (w["end"] == F.col("end")))[0]["letters"]
    chosen = found.where("part IS NOT NULL").select("part", "seg", "start", "end", "tail")
    ready = cut.join(chosen, ["part", "seg"]).select("conv", "part", "seg", "rows", F.concat(way, "tail").alias("letters"), "start")
    schema = to_arrow_schema(SAID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        for batch in batches:
            for s in batch.to_pylist():
                left = lines(s["rows"], s["letters"], s["start"])
                said = "\n".join(left)
                yield from out.add({"conv": s["conv"], "part": s["part"], "seg": s["seg"], "n": len(left), "said": said}, len(said))
        yield from out.rest()

    return ready.mapInArrow(run, SAID)


def hashed(said: DataFrame) -> DataFrame:
    """conv and repaired_sha256 over its segments in order, one segment in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, began = None, None, False
        for batch in batches:
            done: list[tuple[str, str]] = []
            for name, n, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if digest is None or name != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest, began = name, hashlib.sha256(), False
                if n:
                    digest.update(b"\n" if began else b"")
                    digest.update(text.as_py().encode("utf-8", "replace"))
                    began = True
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    return said.repartition("conv").sortWithinPartitions("conv", "part", "seg").mapInArrow(run, "conv string, repaired_sha256 string")


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = SEGMENT) -> DataFrame:
    """Faults, cost and audit of the cheapest edits and a hash of the repaired log, for every conversation of turns."""
    cut = stored(segments(faults(damage(turns, conv_id, turn, role, text)), size), "segments")
    found = stored(settled(cut), "settled")
    whole = found.where("part IS NULL").drop("part", "seg", "start", "end", "tail").join(hashed(rendered(cut, found)), "conv")
    every = turns.select(_named(F.col(f"`{conv_id}`")).alias("conv"), F.col(f"`{conv_id}`").alias("conv_id")).groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(whole, "conv", "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
