"""Facet counts, newest lists and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetra.operators.hierarchy import with_ancestors
from facetra.specs import GAZETTE, CorpusSpec, FacetSpec

#: Rows of a newest list, entries of a ranked list, and the least size of a page.
RECENT, TOP, MIN_PAGE = 30, 50, 5
#: Rows that one task counts where keys are many.
PER_TASK = 500_000


def newest_order(spec: CorpusSpec = GAZETTE) -> list[Column]:
    return [F.coalesce(F.col(spec.date), F.lit("")).desc(), F.col(spec.id).desc()]


def _pairs(dims: tuple[FacetSpec, ...]) -> Column:
    return F.array(*[F.struct(F.lit(d.dim).alias("dim"), d.value().cast("string").alias("value")) for d in dims])


def facet_counts(df: DataFrame, key: str | None = None, spec: CorpusSpec = GAZETTE, dims: tuple[FacetSpec, ...] | None = None, many: bool = False) -> DataFrame:
    """(key,) dim, value, n over all dimensions in one pass: each row is exploded, and counts combine before the shuffle.

    many: keys are so many that hardly any counts combine. Rows are then dealt by key and year in tasks of about ``PER_TASK``
    rows, so that a task's memory does not follow the size of a file's split."""
    dims = dims or spec.dims
    total = F.array(F.struct(F.lit("total").alias("dim"), F.lit("").alias("value")))
    keys = [F.col(key).alias("key")] if key else []
    rows = df.where(F.col(key).isNotNull()) if key else df
    if key and many:
        used = dict.fromkeys([key, spec.year, *[c for d in dims for c in (d.column, d.flag) if c]])
        rows = rows.select(*used).repartition(-(-rows.count() // PER_TASK) or 1, key, spec.year)
    each = rows.select(*keys, F.inline(F.concat(total, _pairs(dims)))).where(F.col("value").isNotNull())
    return each.groupBy(*["key"] * bool(key), "dim", "value").agg(F.count(F.lit(1)).alias("n"))


def topic_facets(df: DataFrame, tree_closure: DataFrame, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """Facets of each topic with its descendants; inside, the topic dimension still holds the leaf. Rows are counted per
    leaf before they meet its ancestors, so the tree multiplies counts and not records."""
    trusted = df.where(F.col(spec.topic.flag)) if spec.topic.flag else df
    leaf = facet_counts(trusted, spec.topic.column, spec)
    return with_ancestors(leaf, tree_closure, "key", "_up").groupBy(F.col("_up").alias("key"), "dim", "value").agg(F.sum("n").cast("long").alias("n"))


def newest_with_ancestors(df: DataFrame, tree_closure: DataFrame, k: int = RECENT, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """key, rank and the k newest rows of each topic with its descendants: the newest of each leaf first, then of these."""
    trusted = df.where(F.col(spec.topic.flag)) if spec.topic.flag else df
    leaf = newest(trusted, spec.topic.column, k, spec).drop("rank")
    return newest(with_ancestors(leaf, tree_closure, spec.topic.column, "key"), "key", k, spec)


def panels(counts: DataFrame, roots: DataFrame, k: int = 8) -> DataFrame:
    """dim, value, n, rank: the k largest values of each dimension, of topics the roots only; counts: (dim, value, n)."""
    r = roots.select(F.lit("topic").alias("dim"), F.col("slug").alias("value"), F.lit(True).alias("_root")).distinct()
    shown = counts.where("n > 0").join(r, ["dim", "value"], "left").where((F.col("dim") != "topic") | F.col("_root")).drop("_root")
    return top(shown, ["dim"], [F.desc("n"), "value"], k)


def top(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def newest(df: DataFrame, key: str | None, k: int = RECENT, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """The k newest rows of each key, or of all."""
    if key is None:
        return df.orderBy(*newest_order(spec)).limit(k)
    return top(df.where(F.col(key).isNotNull()), [key], newest_order(spec), k)


def ranked_values(counts: DataFrame, dim: str, k: int = TOP) -> DataFrame:
    """The k most frequent values of a dimension for each key; ties by value."""
    return top(counts.where(F.col("dim") == dim), ["key"], [F.desc("n"), "value"], k)


def last_seen(df: DataFrame, key: str, column: str, order: str = "id") -> DataFrame:
    """The last non-null value of a column for each key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order))).alias(column))


def distinct_per(df: DataFrame, key: str, column: str, out: str = "n_distinct") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(column).alias(out))


def newest_dates(df: DataFrame, k: int, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """The k newest dates that occur."""
    return df.where(F.col(spec.date).isNotNull()).select(spec.date).distinct().orderBy(F.desc(spec.date)).limit(k)


def latest(df: DataFrame, days: int, spec: CorpusSpec = GAZETTE, page: str = "page") -> DataFrame:
    """Rows of the newest dates: newest day first, within a day by page and id."""
    return df.join(newest_dates(df, days, spec), spec.date, "left_semi").orderBy(*latest_order(spec, page))


def latest_order(spec: CorpusSpec = GAZETTE, page: str = "page") -> list[Column]:
    return [F.col(spec.date).desc_nulls_last(), F.coalesce(F.col(page), F.lit(0)), F.col(spec.id)]


def recent(df: DataFrame, k: int = 500, spec: CorpusSpec = GAZETTE, page: str = "page") -> DataFrame:
    """The first k rows of the latest listing."""
    return df.where(F.col(spec.date).isNotNull()).orderBy(*latest_order(spec, page)).limit(k)


def day_runs(listed: DataFrame, whole: DataFrame, spec: CorpusSpec = GAZETTE, page: str = "page") -> DataFrame:
    """A listing with each row's day total over ``whole`` and whether the row starts its day."""
    totals = whole.groupBy(spec.date).agg(F.count(F.lit(1)).alias("day_total"))
    starts = F.row_number().over(Window.partitionBy(spec.date).orderBy(*latest_order(spec, page))) == 1
    return listed.join(totals, spec.date, "left").withColumn("new_day", starts)


def newest_day(df: DataFrame, counted: dict[str, Column], parts: str = "part", spec: CorpusSpec = GAZETTE) -> DataFrame:
    """One row for the newest date: records, distinct parts and provinces, the first volume, and the given conditional counts."""
    day = df.agg(F.max(spec.date).alias("_day"))
    rows = df.join(F.broadcast(day), F.col(spec.date) == F.col("_day"))  # one row
    return rows.groupBy(F.col("_day").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(parts).alias("parts"), F.min_by("volume", spec.id).alias("first_volume"),
        F.count_distinct("province").alias("provinces"), *[F.count_if(c).alias(k) for k, c in counted.items()],
    )


def highlights(df: DataFrame, eligible: Column, first: Column, weight: str, k: int = 12, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """Eligible rows: those for which ``first`` holds lead, then the heavier, then by id."""
    return df.where(eligible).orderBy((~first).cast("int"), F.coalesce(F.col(weight), F.lit(0.0)).desc(), spec.id).limit(k)


def stories(df: DataFrame, rules: Column, others: Column, first: Column, weight: str, k: int = 12, k_others: int = 8, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """Each day's first k rules in the order of ``highlights``; a day without rules has a story too, the first ``k_others`` of its
    other rows in the same order. With ``rule`` and ``rank``."""
    order = [(~first).cast("int"), F.coalesce(F.col(weight), F.lit(0.0)).desc(), F.col(spec.id)]
    rows = df.withColumns({"rule": F.coalesce(rules, F.lit(False)), "_other": F.coalesce(others, F.lit(False))}).where("rule OR _other")
    by = [F.col(spec.date), F.col("rule")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= F.when(F.col("rule"), k).otherwise(k_others))
    told = F.max("rule").over(Window.partitionBy(spec.date))  # over at most k + k_others rows of a day
    return ranked.withColumn("_told", told).where(F.col("rule") | ~F.col("_told")).drop("_told", "_other")


def normalised(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Each count as a whole percent of its list's largest (at least 1)."""
    largest = F.greatest(F.lit(1), F.max(n).over(Window.partitionBy(*by)))
    return counts.withColumn("bar", F.round(100 * F.col(n) / largest).cast("int"))


def page(df: DataFrame, order: list, number: int, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1) of an ordered result."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
