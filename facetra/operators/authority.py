"""Who issues what: shares, concentration, overlap, leaders and changes of leader."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetra.functions.text import same_body
from facetra.operators.facets import top

#: Rows of topics' largest agencies up to which they are sent to every task: some MB.
BROADCAST = 100_000


def shares(rows: DataFrame, totals: DataFrame, by: str = "key", value: str = "value", n: str = "n") -> DataFrame:
    """Rows with n > 0 and their share of the facet's total (not of the list), ranked."""
    w = Window.partitionBy(by).orderBy(F.desc(n), value)
    joined = rows.where(F.col(n) > 0).join(totals.select(by, F.col("total")), by)
    return joined.withColumns({"share": F.col(n) / F.col("total"), "rank": F.row_number().over(w)})


def concentration(rows: DataFrame, totals: DataFrame, by: str = "key", value: str = "value", upto: float = 0.8, listed: int = 50) -> DataFrame:
    """Top share, entries needed for ``upto`` of the whole (null if the list ends before), covered share, list length."""
    s = shares(rows, totals, by, value).where(F.col("rank") <= listed)
    run = F.sum("share").over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("run", run).groupBy(by).agg(
        F.round(F.max("share"), 6).alias("top_share"), F.min(F.when(F.col("run") >= upto - 1e-12, F.col("rank"))).alias("needed"),
        F.round(F.sum("share"), 6).alias("covered"), F.count(F.lit(1)).alias("listed"),
    )


def main_value(rows: DataFrame, totals: DataFrame, by: str = "key", value: str = "value", least: float = 0.2) -> DataFrame:
    """The most frequent value of each facet, null where it has under ``least`` of the total, and the share of the total
    that has any value (covered)."""
    best = rows.groupBy(by).agg(F.max_by(F.struct(value, "n"), F.struct("n", value)).alias("b"), F.sum("n").alias("s"))
    joined = best.join(totals.select(by, "total"), by)
    return joined.select(by, F.when(F.col("b.n") >= least * F.col("total"), F.col(f"b.{value}")).alias("main"), F.col("b.n").alias("n"), "total", F.round(F.col("s") / F.col("total"), 6).alias("covered"))


def overlaps(mine: DataFrame, theirs: DataFrame, only: DataFrame, per_topic: int = 25, k: int = 6) -> DataFrame:
    """agency, other, n, topics: sum of min(mine, theirs) over shared topics.

    mine: (topic, agency, n) of leaf counts; theirs: the same rolled up, of which each topic's ``per_topic`` largest
    count; only: agencies that get rows. A topic's side of the join has a fixed size, so the join grows with ``mine``; it is
    broadcast up to ``BROADCAST`` rows. Counts are dealt by agency before they meet it, so pairs are made, summed and ranked
    where their agency is and never shuffled.
    """
    large = top(theirs, ["topic"], [F.desc("n"), "agency"], per_topic).select("topic", F.col("agency").alias("other"), F.col("n").alias("n_other"))
    if large.limit(BROADCAST + 1).count() <= BROADCAST:
        large = F.broadcast(large)
    tasks = int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as the rows are few before they meet
    dealt = mine.join(only.select("agency"), "agency", "left_semi").repartition(tasks, "agency")
    pairs = dealt.join(large, "topic").where(F.col("agency") != F.col("other"))
    sums = pairs.groupBy("agency", "other").agg(F.sum(F.least("n", "n_other")).cast("long").alias("n"), F.collect_list("topic").alias("t"))
    best = top(sums, ["agency"], [F.desc("n"), "other"], k)
    return best.select("agency", "other", "n", F.array_join(F.sort_array("t"), ",").alias("topics"), "rank")


def leaders(counts: DataFrame, least: int = 20, share: float = 0.3) -> DataFrame:
    """topic, year, agency, n, total of each topic's first agency in a year, where total and share are large enough."""
    w = Window.partitionBy("year", "topic")
    ranked = counts.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "agency"))})
    return ranked.where((F.col("r") == 1) & (F.col("total") >= least) & (F.col("n") >= share * F.col("total"))).select("topic", "year", "agency", "n", F.col("total").cast("long").alias("total"))


def leader_changes(counts: DataFrame, years: DataFrame, least: int = 20, share: float = 0.3, k: int | None = None) -> DataFrame:
    """The last change of leader of each topic between neighbouring qualifying years.

    counts: (year, topic, agency, n), rolled up; years: whole years. A change counts if the names are not one body's and
    the former leader still has a tenth of its count. Both tests come after the last change is picked.
    """
    used = counts.join(years, "year", "left_semi")
    found = leaders(used, least, share)
    w = Window.partitionBy("topic").orderBy("year")
    before = lambda c: F.lag(c).over(w).alias(f"was_{c}")
    pairs = found.select("topic", "year", "agency", "n", "total", before("year"), before("agency"), before("n"), before("total"))
    last = pairs.where(F.col("agency") != F.col("was_agency")).withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("year")))).where("r = 1")
    still = counts.select("topic", "year", F.col("agency").alias("was_agency"), F.col("n").alias("still"))
    kept = last.join(still, ["topic", "year", "was_agency"], "left").where(F.coalesce("still", F.lit(0)) >= F.greatest(F.lit(1.0), 0.1 * F.col("was_n")))
    kept = kept.where(~same_body(F.col("was_agency"), F.col("agency")))
    out = kept.select("topic", "year", F.col("was_year").alias("since"), "was_agency", "was_n", "was_total", "agency", "n", "total")
    return out if k is None else out.orderBy(F.desc("year"), F.desc("n"), "topic").limit(k)


def spread(counts: DataFrame, k: int = 5) -> DataFrame:
    """Topics with most agencies, and topics with a single one, the k first of each; counts: (topic, agency, n)."""
    per = counts.groupBy("topic").agg(F.count_distinct("agency").alias("agencies"), F.sum("n").cast("long").alias("n"))
    kind = F.when(F.col("agencies") > 1, "spread").otherwise("single")
    order = F.when(F.col("agencies") > 1, F.col("agencies")).otherwise(F.col("n"))
    return top(per.withColumns({"kind": kind, "_o": order}), ["kind"], [F.desc("_o"), F.desc("n"), "topic"], k).drop("_o")
