"""Yearly series, movers, profiles and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetra.operators.ordered import numbered
from facetra.specs import GAZETTE, CorpusSpec, FacetSpec

#: Lanes in which values are ordered.
LANES = 256
#: Base under which a ratio means nothing.
RATIO_FLOOR = 50


def series(df: DataFrame, dim: FacetSpec, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """key, year, n: dense over the years that occur, zero-filled; keys without any row are not there."""
    counts = df.select(dim.value().alias("key"), F.col(spec.year).alias("year")).dropna().groupBy("key", "year").agg(F.count(F.lit(1)).alias("n"))
    return dense(counts, df.select(F.col(spec.year).alias("year")).dropna().distinct())


def dense(counts: DataFrame, years: DataFrame) -> DataFrame:
    """Every key at every year. Each key gets the array of years, so no join makes the grid."""
    axis = F.broadcast(years.agg(F.sort_array(F.collect_set("year")).alias("axis")))  # one row: the years
    by_year = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("m"))
    grid = by_year.join(axis).select("key", "m", F.explode("axis").alias("year"))
    return grid.select("key", "year", F.coalesce(F.try_element_at("m", F.col("year")), F.lit(0)).cast("long").alias("n"))


def complete_years(df: DataFrame, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """Years before the year of the newest date."""
    newest = df.agg(F.substring(F.max(spec.date), 1, 4).alias("_last"))
    return df.select(F.col(spec.year).alias("year")).distinct().join(F.broadcast(newest), F.col("year") < F.col("_last")).select("year")  # one row


def whole_years(df: DataFrame, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """Years of which all twelve months occur: another rule than complete_years."""
    months = df.groupBy(F.col(spec.year).alias("year")).agg(F.count_distinct(spec.month).alias("months"))
    return months.where("months = 12").select("year")


def _moved(sums: DataFrame, floor: int) -> DataFrame:
    ratio = F.when(F.col("before") >= RATIO_FLOOR, (F.col("after") - F.col("before")) / F.col("before"))
    kept = sums.where((F.col("before") >= floor) | (F.col("after") >= floor))
    return kept.select("key", "before", "after", (F.col("after") - F.col("before")).alias("change"), ratio.alias("ratio"))


def movers(yearly: DataFrame, complete: DataFrame, window: int = 3, floor: int = 200) -> DataFrame:
    """The last ``window`` complete years against as many before; empty if there are none before."""
    place = F.row_number().over(Window.orderBy(F.desc("year")))  # over years
    ranks = complete.select("year", place.alias("r")).where(F.col("r") <= 2 * window)
    side = F.when(F.col("r") <= window, "after").otherwise("before")
    both = ranks.groupBy().agg(F.max("r").alias("_top")).where(F.col("_top") > window)
    used = ranks.join(F.broadcast(both)).select("year", side.alias("side"))  # one row or none
    total = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).cast("long").alias(s)
    sums = yearly.join(F.broadcast(used), "year").groupBy("key").agg(total("before"), total("after"))  # at most 2 * window years
    return _moved(sums, floor)


def year_over_year(yearly: DataFrame, year: str, floor: int = 60) -> DataFrame:
    """A year against the year before it on the axis; the first year has none."""
    before = F.lag("n").over(Window.partitionBy("key").orderBy("year"))
    pairs = yearly.withColumn("before", before).where((F.col("year") == year) & F.col("before").isNotNull())
    return _moved(pairs.select("key", "before", F.col("n").alias("after")), floor)


def ranked_moves(moved: DataFrame, k: int = 6) -> DataFrame:
    """The k largest rises and falls, and each change as a share of the widest."""
    rising = F.when(F.col("change") > 0, "rising").when(F.col("change") < 0, "falling")
    w = Window.partitionBy("direction").orderBy(F.abs("change").desc(), "key")
    cut = moved.withColumn("direction", rising).where("direction IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return cut.withColumn("bar", F.round(F.abs("change") / F.max(F.abs("change")).over(Window.partitionBy()), 6))


def month_profile(monthly: DataFrame, month: str = "month", n: str = "n") -> DataFrame:
    """Sums by calendar month over all years, with a row for each of the twelve."""
    spine = monthly.sparkSession.range(1, 13).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("mm"))
    sums = monthly.groupBy(F.substring(month, 6, 2).alias("mm")).agg(F.sum(n).cast("long").alias("n"))
    return spine.join(sums, "mm", "left").select("mm", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def busiest(profile: DataFrame) -> DataFrame:
    return profile.agg(F.max_by("mm", F.struct("n", (-F.col("mm").cast("int")).alias("k"))).alias("mm"), F.max("n").alias("n"))


def year_to_date(monthly: DataFrame, newest: DataFrame) -> DataFrame:
    """year, now, then, months: this year so far and the same months of the year before; newest: one row with ``date``."""
    one = newest.select(F.substring("date", 1, 4).alias("year"), F.substring("date", 6, 2).alias("upto"))
    rows = monthly.join(F.broadcast(one), F.substring("month", 6, 2) <= F.col("upto"))  # one row
    mine = F.substring("month", 1, 4) == F.col("year")
    past = F.substring("month", 1, 4) == (F.col("year").cast("int") - 1).cast("string")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("year").agg(total(mine).alias("now"), total(past).alias("then"), F.count_if(mine).alias("months"))


def sum_at(yearly: DataFrame, keys: list[str], year: str) -> DataFrame:
    """The sum of some keys at one year."""
    match = F.col("key").isin(keys) if keys else F.lit(False)
    return yearly.where(match & (F.col("year") == year)).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def quantile_cuts(values: DataFrame, n: str = "n", bands: int = 5, lanes: int = LANES) -> DataFrame:
    """i, cut for i below ``bands``: the positive value at index floor(i * count / bands) of their order.

    Distinct values are counted and dealt to lanes at approximate percentiles, which bound a lane's size but not the result:
    lanes add up their counts, a row a lane, and each orders its own values.
    """
    rows = values.where(F.col(n) > 0)
    bounds = rows.agg(F.percentile_approx(n, [i / lanes for i in range(1, lanes)], F.lit(100 * lanes)).alias("_bounds"))
    order = rows.groupBy(F.col(n).alias("v")).agg(F.count(F.lit(1)).alias("c"))  # equal values together
    lane = F.size(F.filter("_bounds", lambda b: b <= F.col("v")))
    placed = order.join(F.broadcast(bounds)).select("v", "c", lane.alias("lane"))  # one row
    sums = placed.groupBy("lane").agg(F.sum("c").alias("s"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("lane", F.coalesce(F.sum("s").over(before(Window.orderBy("lane"))), F.lit(0)).alias("start"), F.sum("s").over(Window.partitionBy()).alias("all"))  # over lanes
    inner = placed.withColumn("b", F.coalesce(F.sum("c").over(before(Window.partitionBy("lane").orderBy("v"))), F.lit(0)))
    found = inner.join(starts, "lane").withColumn("begin", F.col("start") + F.col("b"))
    wanted = found.select("v", "c", "begin", "all", F.explode(F.sequence(F.lit(1), F.lit(bands - 1))).alias("i"))
    at = F.floor(F.col("i") * F.col("all") / bands)
    return wanted.where((at >= F.col("begin")) & (at < F.col("begin") + F.col("c"))).select(F.col("i").cast("int").alias("i"), F.col("v").alias("cut"))


def banded(values: DataFrame, cuts: DataFrame, n: str = "n") -> DataFrame:
    """values with ``band``: how many cuts are at most the value."""
    listed = cuts.agg(F.collect_list("cut").alias("_cuts"))
    return values.join(F.broadcast(listed)).withColumn("band", F.size(F.filter("_cuts", lambda c: c <= F.col(n)))).drop("_cuts")  # one row


def ranked_shares(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """key, n, rank, share of all."""
    total = counts.agg(F.sum(n).alias("_all"))
    ranked = numbered(counts.select(key, n), [F.desc(n), key], "rank").join(F.broadcast(total))  # one row
    return ranked.select(key, n, F.col("rank").cast("int").alias("rank"), F.round(F.col(n) / F.col("_all"), 6).alias("share"))


def coverage(counts: DataFrame, key: str, total: Column | int, n: str = "n") -> DataFrame:
    """Distinct keys, their sum, its share of a total, and the largest."""
    total = total if isinstance(total, Column) else F.lit(total)
    return counts.agg(
        F.count_distinct(key).alias("keys"), F.sum(n).cast("long").alias("n"), F.max_by(key, F.struct(n, key)).alias("largest")
    ).withColumn("share", F.round(F.col("n") / total, 6))
