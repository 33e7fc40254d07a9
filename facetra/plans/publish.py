"""Sinks: month-partitioned records, tables, CSV, feeds and their directory, the source registry and build metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetra.functions.text import coordinates, despaced, safe_name
from facetra.operators.facets import newest_order, top
from facetra.plans.versions import publish


#: Rows of a file of the month sink.
PER_FILE = 1_000_000


def by_month(records: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Records in tasks of about ``per_file`` rows, in the order of year, month, date and id from task to task and within
    each: a large month is many tasks, small ones share one. The number of tasks comes from a count, their bounds from
    Spark's sample of the whole order, so that no month, however large, is one task's."""
    order = ["year", "month", F.coalesce("date", F.lit("")), "id"]
    tasks = max(1, -(-records.count() // per_file))
    return records.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def write_months(records: DataFrame, path: str, per_file: int = PER_FILE, late: bool = False) -> None:
    """Records partitioned by year and month, in files that follow each other by date and id. late: only the months that
    ``records`` has are replaced, each whole, and in one step for readers (``read_table``)."""
    publish(by_month(records, per_file), path, ("year", "month"), update=late, maxRecordsPerFile=2 * per_file)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """The table at ``path`` replaced whole: readers (``read_table``) see the old one or the new one, and a failed write leaves
    the old."""
    publish(df, path, kind=kind)


def with_names(df: DataFrame, names: dict[str, DataFrame]) -> DataFrame:
    """df with the codes of some columns replaced by names; names: column -> (slug, name). Unknown codes stay."""
    for column, dim in names.items():
        n = dim.select(F.col("slug").alias("_s"), F.col("name").alias("_n"))
        df = df.join(n, F.col(column) == F.col("_s"), "left").withColumn(column, F.coalesce("_n", column)).drop("_s", "_n")
    return df


def for_csv(df: DataFrame, names: dict[str, DataFrame], site: str) -> DataFrame:
    """df with names for codes, and the link of each record's page."""
    return with_names(df, names).withColumn("link", F.concat(F.lit(f"{site.rstrip('/')}/doc/"), F.col("id").cast("string")))


def write_csv(df: DataFrame, path: str, names: dict[str, DataFrame] | None = None) -> None:
    """Quoted CSV with a header, with names for the codes of some columns."""
    with_names(df, names or {}).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def slim(records: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """The required columns, and optional ones that are null where they are empty or false, so that JSON leaves them out."""
    kinds = dict(records.dtypes)
    empty = {"string": F.lit(""), "boolean": F.lit(False)}
    return records.select(*required, *[F.nullif(c, empty[kinds[c]]).alias(c) if kinds[c] in empty else F.col(c) for c in optional])


def province_index(records: DataFrame) -> DataFrame:
    """province, file (a safe name), n: largest first."""
    counts = records.where(F.col("province").isNotNull()).groupBy("province").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("province", safe_name(F.col("province")).alias("file"), "n").orderBy(F.desc("n"), "province")


def named_like(entries: DataFrame, column: str, query: str) -> DataFrame:
    """Entries whose name holds a text, white space ignored; all for an empty one."""
    q = "".join(query.split())
    return entries.where(despaced(F.col(column)).contains(q)) if q else entries


def feed_entries(rows: DataFrame, feed: str = "feed_id", k: int = 50) -> DataFrame:
    """The k newest entries of each feed, each headed by its citation."""
    cited = F.concat_ws(" · ", F.nullif(coordinates(F.col("volume"), F.col("part"), F.col("page")), F.lit("")), "title")
    return top(rows.where(F.col(feed).isNotNull()), [feed], newest_order(), k).select(feed, "rank", "id", "date", cited.alias("entry"))


def feeds(records: DataFrame, series: str, columns: list[str], least: int = 50, newest: int = 200, k: int = 50) -> DataFrame:
    """feed_id, kind, rank, id, date, entry: one feed of all, one per value of ``series`` (both of ``newest`` entries), and
    one per value of each column with at least ``least`` records."""
    fed = lambda kind, c: records.withColumns({"kind": F.lit(kind), "feed_id": F.concat(F.lit(f"{kind}/"), c.cast("string"))})
    all_of = records.withColumns({"kind": F.lit("all"), "feed_id": F.lit("all")}).unionByName(fed("series", F.col(series)))
    out = feed_entries(all_of, k=newest)
    for c in columns:
        large = records.groupBy(c).count().where(F.col("count") >= least).select(c)
        out = out.unionByName(feed_entries(fed(c, F.col(c)).join(large, c, "left_semi"), k=k))
    return out.select("feed_id", F.element_at(F.split("feed_id", "/"), 1).alias("kind"), "rank", "id", "date", "entry")


def feed_directory(entries: DataFrame, order: list[str]) -> DataFrame:
    """One row per feed: by kind in a given order, then the larger, then by name."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind")), F.lit(99))
    return entries.groupBy("feed_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("updated")).orderBy(at, F.desc("n"), "feed_id")


def feed_xml(entries: DataFrame) -> DataFrame:
    """feed_id, xml: the entries of each feed, which are few, as one text."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = F.concat(F.lit("<entry><id>"), esc(F.col("id").cast("string")), F.lit("</id><title>"), esc(F.col("entry")), F.lit("</title><updated>"), F.coalesce("date", F.lit("")), F.lit("</updated></entry>"))
    listed = F.sort_array(F.collect_list(F.struct("rank", one.alias("x"))))
    return entries.groupBy("feed_id").agg(F.concat(F.lit("<feed>"), F.array_join(listed["x"], ""), F.lit("</feed>")).alias("xml"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """A registry with own rows replaced, the others kept, in order."""
    return old.join(new, key, "left_anti").unionByName(new).orderBy(key)


def build_meta(records: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """One row: totals, first and last year, latest date, trusted records, and where they come from."""
    return records.agg(
        F.count(F.lit(1)).alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("years"),
        F.max("date").alias("latest"), F.count_if("topic_c").alias("trusted"), *[F.lit(v).alias(k) for k, v in provenance.items()],
    )
