"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``replicas`` places on a ring of ``slots`` slots; a key belongs to the next place clockwise. A shard
takes at most its capacity, and keys that overflow a full shard continue clockwise to the next place whose shard has
room. Capacities are the row count shared out with a remainder of one, so counts of shards differ by at most one
(law ``rows``), while only overflowing keys leave the shard that the plain ring gives them.

Only counts per slot, at most ``slots`` numbers, meet on the driver; they fix for each slot which ranks go where. Rows
get their rank within the slot, and later their slot within the shard, in lanes (see ``numbered``).

Defined results: null text is the empty text (size 16, checksum 0); a null id hashes like any other value; equal ids
share a ring place, are ranked by checksum and size, and may be split where a shard is full; repeated rows keep one
place each; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetra.llm.common import numbered

SHARDS = 40
REPLICAS = 64
SLOTS = 8192
#: Lanes within a ring slot, and within a shard.
SLOT_LANES, SHARD_LANES = 8, 256


def ring(shards: int, replicas: int = REPLICAS, slots: int = SLOTS) -> dict[int, int]:
    """Slot of each virtual node -> shard. A shard's places do not depend on how many shards there are, but for
    collisions, where a later shard takes the next free slot."""
    if shards * replicas > slots // 2:
        raise ValueError("more virtual nodes than half the slots")
    out: dict[int, int] = {}
    for s in range(shards):
        for v in range(replicas):
            at = int.from_bytes(hashlib.sha1(f"{s}/{v}".encode()).digest()[:8], "big") % slots
            while at in out:
                at = (at + 1) % slots
            out[at] = s
    return out


def plan(counts: dict[int, int], nodes: dict[int, int], shards: int, slots: int = SLOTS) -> list[tuple[int, int, int, int]]:
    """(slot, first rank, end rank, shard): where the ranks of each slot go."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    places = sorted(nodes)
    native: dict[int, list[int]] = {p: [] for p in places}
    at = 0
    for slot in range(slots):
        while at < len(places) and places[at] < slot:
            at += 1
        if counts.get(slot):
            native[places[at % len(places)]].append(slot)
    out: list[tuple[int, int, int, int]] = []
    over: dict[int, list[list[int]]] = {p: [] for p in places}
    for p in places:  # a shard's own keys first
        s = nodes[p]
        for slot in native[p]:
            n = min(counts[slot], room[s])
            room[s] -= n
            if n:
                out.append((slot, 0, n, s))
            if n < counts[slot]:
                over[p].append([slot, n, counts[slot]])
    carried: list[list[int]] = []
    for p in [*places, *places]:  # then what overflows, clockwise
        s = nodes[p]
        while carried and room[s]:
            slot, first, end = carried[0]
            n = min(end - first, room[s])
            room[s] -= n
            out.append((slot, first, first + n, s))
            carried[0][1] += n
            if carried[0][1] == end:
                carried.pop(0)
        carried += over.pop(p, [])
    return out


def ring_slot(key: str, slots: int = SLOTS):
    """The place of a key on the ring; the second hash spreads equal low bits."""
    return F.pmod(F.shiftright(F.xxhash64(F.xxhash64(key)), 16), F.lit(slots)).cast("int")


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, replicas: int = REPLICAS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0 within the shard), moved (the plain ring gives another shard)."""
    body = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        ring_slot(f"`{doc_id}`", slots).alias("_place"),
    )
    counts = {r[0]: r[1] for r in rows.groupBy("_place").count().collect()}  # at most `slots` rows
    nodes = ring(shards, replicas, slots)
    parts = plan(counts, nodes, shards, slots)
    spark = docs.sparkSession
    places = sorted(nodes)
    owner = {s: nodes[next((p for p in places if p >= s), places[0])] for s in counts}
    table = spark.createDataFrame([(*x, owner[x[0]]) for x in parts], "_place int, _first long, _end long, shard int, _own int")
    order = ["doc_id", "text_crc32", "size"]
    ranked = numbered(rows, ["_place"], order, "_at", F.xxhash64(*order), SLOT_LANES)
    placed = ranked.join(F.broadcast(table), "_place").where((F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_end")))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("shard") != F.col("_own")).alias("moved"))
    return numbered(placed, ["shard"], order, "slot", F.xxhash64(*order), SHARD_LANES)
