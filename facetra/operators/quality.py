"""Checks: each gives rows (check, key, expected, actual) of what is wrong; no row is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetra.operators.encode import month_directory
from facetra.operators.ordered import with_previous

#: Bytes of a file whose entries are checked in one task.
LANE_BYTES = 1 << 26
COLUMNS = ("check", "key", "expected", "actual")


def _rows(df: DataFrame, check: str, key: Column, expected: Column, actual: Column) -> DataFrame:
    s = lambda c: c.cast("string")
    return df.select(F.lit(check).alias("check"), s(key).alias("key"), s(expected).alias("expected"), s(actual).alias("actual"))


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def columns_present(df: DataFrame, needed: list[str], name: str) -> DataFrame:
    missing = [(f"{name}.{c}",) for c in needed if c not in df.columns]
    return _rows(df.sparkSession.createDataFrame(missing, "k string"), "columns", F.col("k"), F.lit("present"), F.lit("missing"))


def contract(meta: DataFrame, version: int = 1, name: str = "name") -> DataFrame:
    """Outputs (name, contract, credit) of another contract version, or without a credited source."""
    other = meta.where(~F.col("contract").eqNullSafe(F.lit(version)))
    silent = meta.where(F.coalesce(F.trim("credit"), F.lit("")) == "")
    return together(_rows(other, "contract", F.col(name), F.lit(version), F.col("contract")), _rows(silent, "credit", F.col(name), F.lit("a source"), F.col("credit")))


def same_months(index: DataFrame, records: DataFrame, month: str = "month") -> DataFrame:
    """An index covers exactly the months of the records."""
    a, b = index.select(month).distinct().withColumn("_a", F.lit(True)), records.select(month).distinct().withColumn("_b", F.lit(True))
    off = a.join(b, month, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
    said = lambda c: F.when(F.col(c), "there").otherwise("missing")
    return _rows(off, "months", F.col(month), said("_b"), said("_a"))


def within_budget(sizes: DataFrame, budget: DataFrame) -> DataFrame:
    """sizes (name, n) against budget (name, most): too large, or not expected at all."""
    joined = sizes.join(budget, "name", "left").where(F.col("most").isNull() | (F.col("n") > F.col("most")))
    return _rows(joined, "budget", F.col("name"), F.coalesce(F.col("most").cast("string"), F.lit("no such output")), F.col("n"))


def series_complete(yearly: DataFrame, years: DataFrame) -> DataFrame:
    """Every series has a value at each year."""
    n = years.agg(F.count(F.lit(1)).alias("all"))
    per = yearly.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n)).where(F.col("n") != F.col("all"))  # one row
    return _rows(per, "series", F.col("key"), F.col("all"), F.col("n"))


def directory_contiguous(directory: DataFrame, records: DataFrame) -> DataFrame:
    """Each month starts where the one before ends, and its size is that of the records."""
    w = Window.orderBy("month")  # over months
    gaps = directory.withColumn("want", F.coalesce(F.lag(F.col("start") + F.col("n")).over(w), F.lit(0))).where(F.col("start") != F.col("want"))
    own = month_directory(records).select("month", F.col("n").alias("have"))
    sizes = directory.join(own, "month", "full_outer").where(~F.col("n").eqNullSafe(F.col("have")))
    return together(_rows(gaps, "start", F.col("month"), F.col("want"), F.col("start")), _rows(sizes, "size", F.col("month"), F.col("have"), F.col("n")))


def sorted_within(df: DataFrame, month: str = "month", position: str = "position") -> DataFrame:
    """Rows of a month are stored by date and id. Months are checked in lanes of positions, and lanes against each other."""
    s = F.struct(F.coalesce("date", F.lit("")).alias("d"), F.col("id").alias("i"))
    rows = with_previous(df.select(month, position, "id", s.alias("_s")), [month], position, F.col("_s"), "_b")
    return _rows(rows.where(F.col("_b") > F.col("_s")), "order", F.col("id"), F.col("_b.i"), F.col("_s.i"))


def names_cut_short(counts: DataFrame, key: str = "key", n: str = "n", rare: int = 40, frequent: int = 200) -> DataFrame:
    """Rare names that are a proper beginning of a frequent one."""
    few = counts.where(F.col(n) < rare).select(F.col(key).alias("short"), F.col(n).alias("n_short"))
    many = counts.where((F.col(n) > frequent) & (F.length(key) > 1)).select(F.col(key).alias("long"), F.col(n).alias("n_long"))
    starts = F.transform(F.sequence(F.lit(1), F.length("long") - 1), lambda k: F.substring("long", F.lit(1), k))
    found = few.join(many.select("long", "n_long", F.explode(starts).alias("short")), "short")
    best = found.groupBy("short", "n_short").agg(F.max_by("long", F.struct("n_long", "long")).alias("long"))
    return _rows(best, "cut_name", F.col("short"), F.col("long"), F.col("n_short"))


def blank_rates(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by,) column, rows, blank, rate in one pass."""
    by = by or []
    blank = [F.struct(F.lit(c).alias("column"), (F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias("b")) for c in columns]
    each = df.select(*by, F.inline(F.array(*blank)))
    out = each.groupBy(*by, "column").agg(F.count(F.lit(1)).alias("rows"), F.count_if("b").alias("blank"))
    return out.withColumn("rate", F.round(F.col("blank") / F.col("rows"), 6))


def key_shapes(df: DataFrame, column: str) -> DataFrame:
    """How often each set of keys of a map occurs."""
    return df.groupBy(F.array_join(F.array_sort(F.map_keys(column)), ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, by: list[str], check: str = "duplicate") -> DataFrame:
    found = df.dropna(subset=by).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _rows(found, check, F.concat_ws("/", *[F.col(c).cast("string") for c in by]), F.lit(1), F.col("n"))


def corroboration(labels: DataFrame, by: list[str]) -> DataFrame:
    out = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("corroborated").alias("corroborated"))
    return out.withColumn("rate", F.round(F.col("corroborated") / F.col("n"), 6))


def _entry(check: str, key: str, expected: Column, actual: Column, bad: Column) -> Column:
    """What a check of single rows says of one: a row of COLUMNS where it is bad, else null."""
    s = lambda c: c.cast("string")
    return F.when(bad, F.struct(F.lit(check).alias("check"), s(F.col(key)).alias("key"), s(expected).alias("expected"), s(actual).alias("actual")))


def by_row(df: DataFrame, *entries: Column) -> DataFrame:
    """Several checks of single rows in one pass over them."""
    return df.select(F.inline(F.array_compact(F.array(*entries))))


def date_entry(date: str = "date", key: str = "id", sentinel: str = "1970-01-01") -> Column:
    """A date that is there is one."""
    bad = F.col(date).isNotNull() & (F.try_to_date(F.col(date), "yyyy-MM-dd").isNull() | (F.col(date) == sentinel))
    return _entry("date", key, F.lit("a date"), F.col(date), bad)


def year_entry(offset: int, slack: int = 1, since: int = 0, year: str = "year", volume: str = "volume", key: str = "id") -> Column:
    """year = volume + offset, within a slack."""
    y = F.col(year).cast("int")
    return _entry("year", key, F.col(volume) + offset, y, (y >= since) & (F.abs(y - F.col(volume) - offset) > slack))


def id_year_entry(key: str = "id", year: str = "year") -> Column:
    """An id begins with the year of its file."""
    own = F.substring(F.col(key).cast("string"), 1, 4)
    return _entry("id_year", key, F.col(year), own, own != F.col(year))


def dates_valid(df: DataFrame, date: str = "date", key: str = "id", sentinel: str = "1970-01-01") -> DataFrame:
    return by_row(df, date_entry(date, key, sentinel))


def year_matches(df: DataFrame, offset: int, slack: int = 1, since: int = 0, year: str = "year", volume: str = "volume", key: str = "id") -> DataFrame:
    return by_row(df, year_entry(offset, slack, since, year, volume, key))


def id_year(df: DataFrame, key: str = "id", year: str = "year") -> DataFrame:
    return by_row(df, id_year_entry(key, year))


def one_date_per_issue(df: DataFrame, by: tuple[str, ...] = ("volume", "part")) -> DataFrame:
    found = df.dropna(subset=list(by)).groupBy(*by).agg(F.count_distinct("date").alias("n")).where("n > 1")
    return _rows(found, "issue_date", F.concat_ws("/", *[F.col(c).cast("string") for c in by]), F.lit(1), F.col("n"))


def layers_differ(a: DataFrame, b: DataFrame, on: str, column: str) -> DataFrame:
    """days, n: histogram of the difference in days of a date that two layers state differently."""
    both = a.select(on, F.col(column).alias("x")).join(b.select(on, F.col(column).alias("y")), on).where(F.col("x") != F.col("y"))
    return both.groupBy(F.datediff(F.try_to_date("x"), F.try_to_date("y")).alias("days")).agg(F.count(F.lit(1)).alias("n"))


def rule_support(both: DataFrame, volume: str, dates: list[str], offset: int, by: list[str] | None = None, slack: int = 1) -> DataFrame:
    """layer, n, holds: for how many rows each layer's date agrees with year = volume + offset, among those that differ."""
    rows = both.where(F.col(dates[0]) != F.col(dates[1]))
    fits = lambda c: F.abs(F.substring(c, 1, 4).cast("int") - F.col(volume) - offset) <= slack
    each = rows.select(*(by or []), F.inline(F.array(*[F.struct(F.lit(c).alias("layer"), fits(c).alias("ok")) for c in dates])))
    return each.groupBy(*(by or []), "layer").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("holds"))


def decided_class(records: DataFrame, by: tuple[str, ...] = ("volume", "number"), date: str = "date", cls: str = "cls") -> DataFrame:
    """records with ``decided``: the class as stated, else the one class that has this date in the same volume and number;
    null where none or several have."""
    known = records.where(F.col(cls).isNotNull() & F.col(date).isNotNull()).groupBy(*by, date).agg(F.min(cls).alias("_lo"), F.max(cls).alias("_hi"))
    found = records.join(known, [*by, date], "left")
    return found.withColumn("decided", F.coalesce(cls, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))).drop("_lo", "_hi")


def layer_coverage(a: DataFrame, b: DataFrame, on: str, by: str) -> DataFrame:
    """by, in_a, in_b, only_a, only_b of two layers' distinct ids."""
    x = a.select(by, on).distinct().withColumn("a", F.lit(1))
    y = b.select(by, on).distinct().withColumn("b", F.lit(1))
    both = x.join(y, [by, on], "full_outer")
    return both.groupBy(by).agg(
        F.count("a").alias("in_a"), F.count("b").alias("in_b"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b")
    )


def bytes_accounted(index: DataFrame, file: str = "file", offset: str = "offset", length: str = "length", sizes: DataFrame | None = None) -> DataFrame:
    """Every entry starts where the one before ends, from 0, and with sizes (file, size) the last ends with its file. Files
    are checked in lanes of offsets, and lanes against each other."""
    rows = with_previous(index, [file], offset, F.col(offset) + F.col(length), "_w", LANE_BYTES)
    bad = rows.withColumn("_w", F.coalesce("_w", F.lit(0))).where(F.col("_w") != F.col(offset))
    found = _rows(bad, "offset", F.col(file), F.col("_w"), F.col(offset))
    if sizes is None:
        return found
    ends = index.groupBy(file).agg(F.max(F.col(offset) + F.col(length)).alias("_e")).join(sizes, file, "full_outer")
    return together(found, _rows(ends.where(~F.col("_e").eqNullSafe(F.col("size"))), "file_size", F.col(file), F.col("size"), F.col("_e")))


def two_way(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """a, b, n: a contingency table in long form."""
    return df.groupBy(a.cast("string").alias("a"), b.cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def marker_share(df: DataFrame, by: str, marked: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(marked).alias("marked")).withColumn("share", F.round(F.col("marked") / F.col("n"), 6))


def suspected_tests(df: DataFrame, pattern: str, title: str = "title") -> DataFrame:
    """df with ``suspect``: flagged, not dropped."""
    return df.withColumn("suspect", F.coalesce(F.col(title).rlike(pattern), F.lit(False)))
