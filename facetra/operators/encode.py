"""Codes and dense positions as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65_535


def dictionary(df: DataFrame, column: str, width: int = WIDTH) -> DataFrame:
    """code, value of a dimension: codes from 1 in value order, so that ranges of codes are ranges of values; 0 is none.

    Distinct values of a dimension are few by contract: more than ``width`` is an error raised by the query.
    """
    values = df.select(F.col(column).alias("value")).dropna().distinct()
    codes = values.select(F.row_number().over(Window.orderBy("value")).alias("code"), "value")
    return codes.withColumn("code", F.when(F.col("code") <= width, F.col("code")).otherwise(F.raise_error(F.lit(f"{column} has over {width} values")).cast("int")))


def encoded(df: DataFrame, column: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """df with the code of a column's value."""
    c = codes.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
    return df.join(c, F.col(column) == F.col("_v"), "left").withColumn(out or f"{column}_code", F.coalesce("_c", F.lit(0))).drop("_v", "_c")


def decoded(counts: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    return counts.join(codes, code).drop(code)


def month_directory(df: DataFrame, month: str = "month") -> DataFrame:
    """month, start, n: where each month's rows begin in the dense order."""
    sizes = df.groupBy(month).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(month).rowsBetween(Window.unboundedPreceding, -1)  # over months
    return sizes.select(month, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"), "n")


def positions(df: DataFrame, month: str = "month", date: str = "date", key: str = "id") -> DataFrame:
    """df with ``position``: months in order, within a month by date and id. Rows are numbered per month and date, and a
    date starts where the dates before it end, so that no task holds a month."""
    day = F.coalesce(date, F.lit(""))
    rows = df.withColumns({"_d": day, "_o": F.row_number().over(Window.partitionBy(month, day).orderBy(key)) - 1})
    sizes = df.groupBy(month, day.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(month, "_d").rowsBetween(Window.unboundedPreceding, -1)  # over dates
    starts = sizes.select(month, "_d", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_start"))
    return rows.join(starts, [month, "_d"]).withColumn("position", F.col("_start") + F.col("_o")).drop("_o", "_d", "_start")


def months_of_positions(found: DataFrame, directory: DataFrame, position: str = "position") -> DataFrame:
    """found with month and offset of each position; directory: a row per month, sent to every task as one array."""
    listed = F.broadcast(directory.agg(F.sort_array(F.collect_list(F.struct("start", "month", "n"))).alias("_m")))  # one row: the months
    p = F.col(position)
    own = F.filter("_m", lambda m: (m["start"] <= p) & (p < m["start"] + m["n"]))[0]
    return found.join(listed).withColumn("_o", own).select(*found.columns, F.col("_o.month").alias("month"), (p - F.col("_o.start")).alias("offset"))


def agreement(encoded_rows: DataFrame, records: DataFrame, dims: list[str], on: str = "position") -> DataFrame:
    """dim, compared, differing: values decoded from an index against the records at the same position."""
    both = encoded_rows.select(on, *[F.col(c).alias(f"_{c}") for c in dims]).join(records.select(on, *dims), on, "full_outer")
    pairs = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(f"_{c}").cast("string").alias("a"), F.col(c).cast("string").alias("b")) for c in dims])
    each = both.select(F.inline(pairs))
    return each.groupBy("dim").agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))


def sized(counts: DataFrame, key: str, least: int = 5, n: str = "n") -> DataFrame:
    """key, n, page (n at least ``least``), largest first."""
    return counts.select(key, n, (F.col(n) >= least).alias("page")).orderBy(F.desc(n), key)
