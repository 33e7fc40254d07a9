"""Co-occurrence pairs and the graph of topics and agencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetra.operators.facets import top


def eligible_label(least: float = 0.7) -> Column:
    """Whether a label is corroborated or heavy enough to count in pairs."""
    return F.col("corroborated") | (F.col("weight") >= least)


def eligible(labels: DataFrame, least: float = 0.7) -> DataFrame:
    """id and the sorted set of its labels that are corroborated or heavy enough."""
    return labels.where(eligible_label(least)).groupBy("id").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))


def label_pairs(sets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys,) a, b, n for every pair a < b of labels on one record; a record has few labels."""
    keys = keys or []
    pairs = F.flatten(F.transform("slugs", lambda a, i: F.transform(F.slice("slugs", i + 2, F.greatest(F.size("slugs") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(*keys, F.inline(pairs)).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def nodes(counts: DataFrame) -> DataFrame:
    """Topics with records: n and distinct agencies; counts: (topic, agency, n), rolled up."""
    return counts.groupBy("topic").agg(F.sum("n").cast("long").alias("n"), F.count_distinct("agency").alias("agencies")).where("n > 0")


def edges(counts: DataFrame, pairs: DataFrame, keys: list[str] | None = None, per_topic: int = 6, most: int = 1500, most_pairs: int = 400) -> DataFrame:
    """(keys,) kind, a, b, n: topic-agency edges to each topic's first agencies, and the largest topic-topic pairs.

    With keys, such as the year, each group has its own limits; agencies are those of the whole.
    """
    keys = keys or []
    total = counts.groupBy("topic", "agency").agg(F.sum("n").alias("n"))
    known = top(total, ["topic"], [F.desc("n"), "agency"], per_topic).select("agency").distinct()
    own = counts.groupBy(*keys, "topic", "agency").agg(F.sum("n").cast("long").alias("n")).join(known, "agency", "left_semi")
    first = top(own, [*keys] or [F.lit(0)], [F.desc("n"), "topic", "agency"], most, "_r") if keys else own.orderBy(F.desc("n"), "topic", "agency").limit(most)
    second = top(pairs, keys, [F.desc("n"), "a", "b"], most_pairs, "_r") if keys else pairs.orderBy(F.desc("n"), "a", "b").limit(most_pairs)
    return first.select(*keys, F.lit("agency").alias("kind"), F.col("topic").alias("a"), F.col("agency").alias("b"), "n").unionByName(
        second.select(*keys, F.lit("topic").alias("kind"), "a", "b", "n")
    )


def view(all_edges: DataFrame, tree: DataFrame, least: int) -> DataFrame:
    """Edges of at least ``least``, with the tree's own edges of weight 0."""
    own = tree.where(F.col("parent").isNotNull()).select(F.lit("tree").alias("kind"), F.col("parent").alias("a"), F.col("slug").alias("b"), F.lit(0).cast("long").alias("n"))
    return all_edges.where(F.col("n") >= least).select("kind", "a", "b", "n").unionByName(own)


def neighbours(all_edges: DataFrame, k: int = 12) -> DataFrame:
    """node, other, n, kin: neighbours in both directions, the k strongest of each node."""
    both = all_edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "n").union(all_edges.select("b", "a", "n"))
    merged = both.groupBy("node", "other").agg(F.max("n").alias("n"), F.bool_or(F.col("n") == 0).alias("kin"))
    w = Window.partitionBy("node").orderBy(F.desc("n"), "other")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
