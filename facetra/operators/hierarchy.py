"""Trees given by parent links: closure, roll-up, roots and children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parents are followed so many steps at most; a longer chain is an error, as is a cycle. The engine also stops a recursive
#: query at spark.sql.cteRecursionRowLimit rows (a million by default): a tree has nodes times depth of them.
MAX_DEPTH = 12


def closure(tree: DataFrame, slug: str = "slug", parent: str = "parent") -> DataFrame:
    """descendant, ancestor, depth for every node and each of its ancestors, itself (depth 0) included."""
    found = tree.sparkSession.sql(
        """
        WITH RECURSIVE up (descendant, ancestor, depth) AS (
          SELECT DISTINCT slug, slug, 0 FROM {tree}
          UNION ALL SELECT up.descendant, t.parent, up.depth + 1 FROM up JOIN (SELECT DISTINCT slug, parent FROM {tree} WHERE parent IS NOT NULL) t ON up.ancestor = t.slug
          WHERE up.depth <= {most})
        SELECT * FROM up
        """,
        tree=tree.select(F.col(slug).alias("slug"), F.col(parent).alias("parent")), most=MAX_DEPTH,
    )
    deep = F.raise_error(F.lit(f"the tree is deeper than {MAX_DEPTH} or has a cycle")).cast("int")
    return found.withColumn("depth", F.when(F.col("depth") <= MAX_DEPTH, F.col("depth")).otherwise(deep))


def with_ancestors(df: DataFrame, tree_closure: DataFrame, column: str = "topic", out: str = "ancestor") -> DataFrame:
    """A row for each ancestor of each row's node; rows without a known node go."""
    c = tree_closure.select(F.col("descendant").alias("_d"), F.col("ancestor").alias(out))
    return df.join(c, F.col(column) == F.col("_d")).drop("_d")


def roll_up(counts: DataFrame, tree_closure: DataFrame, column: str = "topic", n: str = "n", keys: list[str] | None = None) -> DataFrame:
    """Counts per node including its descendants; the counts come in aggregated, so the join is small."""
    each = with_ancestors(counts, tree_closure, column, "_a")
    return each.groupBy(*(keys or []), F.col("_a").alias(column)).agg(F.sum(n).cast("long").alias(n))


def roots(tree_closure: DataFrame, families: int = 10) -> DataFrame:
    """slug, root, family: the top ancestor of each node and the number of its family."""
    top = tree_closure.groupBy(F.col("descendant").alias("slug")).agg(F.max_by("ancestor", "depth").alias("root"))
    order = top.select("root").distinct().withColumn("family", ((F.dense_rank().over(Window.orderBy("root")) - 1) % families).cast("int"))
    return top.join(order, "root").select("slug", "root", "family")


def descendants(tree_closure: DataFrame, nodes: list[str]) -> DataFrame:
    """The nodes and all below them; an empty list has none."""
    match = F.col("ancestor").isin(nodes) if nodes else F.lit(False)
    return tree_closure.where(match).select(F.col("descendant").alias("slug")).distinct()


def marked(df: DataFrame, tree_closure: DataFrame, nodes: list[str], column: str = "topic", out: str = "below") -> DataFrame:
    """df with a flag: whether a row's node is one of ``nodes`` or below it."""
    below = descendants(tree_closure, nodes).select(F.col("slug").alias("_s"), F.lit(True).alias(out))
    return df.join(below, F.col(column) == F.col("_s"), "left").drop("_s").withColumn(out, F.coalesce(out, F.lit(False)))


def tree_counts(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """slug, name, parent, n (0 where none) and the sorted children of every node."""
    children = tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("slug")).agg(F.sort_array(F.collect_set("slug")).alias("children"))
    n = counts.select(F.col("topic").alias("slug"), "n")
    return tree.join(n, "slug", "left").join(children, "slug", "left").select(
        "slug", "name", "parent", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("children", F.array().cast("array<string>")).alias("children")
    )
