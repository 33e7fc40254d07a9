"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, once after each turn. A turn's hash covers its turn number, role and text, and
the running sum of the hashes up to a turn names the prefix that ends there: logs of one system number their turns alike,
and a log with other numbers is another conversation. A conversation whose whole name is the name of
a proper prefix of another is dropped by an anti-join, equal conversations keep the one with the smallest id, and what
stays is rendered. Sums run in chunks of turn numbers, so one very long conversation is spread over tasks, and its text
meets only when it is rendered.

Native DataFrame functions only. Defined results: turns are placed by turn, then role, then text, nulls first; a null
role is rendered as ``user``, a null text as empty; rows with a null conversation id are left out; repeated rows are
turns of their own; further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns whose sums run in one task.
CHUNK = 256
START, STOP = "<|im_start|>", "<|im_end|>"


def _names(last: str) -> list[Column]:
    """Two independent 64-bit hashes of a turn, kept as wide decimals so that sums never overflow."""
    body = [F.col("role"), F.col("text").isNull(), F.col("text"), F.col(last)]
    return [F.xxhash64(F.lit(seed), *body).cast("decimal(20,0)").alias(f"h{seed}") for seed in (1, 2)]


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), n_turns and the prefix names p1, p2 of every turn."""
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text")
    )
    hashed = rows.withColumns({f"h{k}": h for k, h in zip((1, 2), _names("turn"), strict=True)}).withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK))
    by = ["conv_id", "chunk"]
    narrow = hashed.select(*by, "h1", "h2")
    run = Window.partitionBy(*by).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)  # the order of ``render``
    inner = hashed.select(*by, F.count(F.lit(1)).over(run).alias("place"), *[F.sum(h).over(run).alias(h) for h in ("h1", "h2")])
    sums = narrow.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"s{h}") for h in ("h1", "h2")])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select(*by, past("n").alias("n0"), past("sh1").alias("b1"), past("sh2").alias("b2"), F.sum("n").over(whole).alias("n_turns"))
    return inner.join(sums, by).select(
        "conv_id", (F.col("place") + F.col("n0")).alias("place"), "n_turns",
        (F.col("h1") + F.col("b1")).cast("string").alias("p1"), (F.col("h2") + F.col("b2")).cast("string").alias("p2"),
    )


def maximal(named: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no other one continues, one of each set of equals."""
    key = ["place", "p1", "p2"]
    whole = named.where(F.col("place") == F.col("n_turns")).groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    longer = named.where(F.col("place") < F.col("n_turns")).select(*key).distinct()
    return whole.join(longer, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_logged")


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and the whole conversation as one text."""
    said = F.concat(F.lit(START), F.coalesce(F.col(role), F.lit("user")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit(f"{STOP}\n"))
    entry = F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"), said.alias("s"))
    listed = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return listed.select("conv_id", F.array_join(F.col("e.s"), "").alias("rendered"))


def collapse(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_logged (equal logs) and rendered of every maximal conversation."""
    kept = maximal(prefixes(turns, conv_id, turn, role, text))
    mine = turns.join(kept.select(F.col("conv_id").alias(conv_id)), conv_id, "left_semi")
    return kept.join(render(mine, conv_id, turn, role, text), "conv_id")
