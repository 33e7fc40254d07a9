"""Ad-hoc filters, and facet counts in which every dimension is counted with its own filter lifted."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetra.functions.text import despaced
from facetra.operators.facets import newest_order
from facetra.specs import GAZETTE, CorpusSpec

#: Keys of a filter that a dimension lifts besides its own.
LIFTS = {"day": ("day",), "month": ("months", "day_from", "day_to"), "year": ("months", "day_from", "day_to")}


@dataclass(frozen=True)
class Filters:
    """Equalities by dimension, topics with all below them, a range of dates, months and a search text; None is unset.

    Topics are a list, or ``below`` names a column that marks their rows (hierarchy.marked). The text is looked for in the
    ``fields``, joined by spaces.
    """

    equal: dict[str, str] = field(default_factory=dict)
    topics: tuple[str, ...] | None = None
    day: str | None = None
    day_from: str | None = None
    day_to: str | None = None
    months: tuple[str, ...] | None = None
    text: str | None = None
    below: str | None = None
    fields: tuple[str, ...] = ("title",)

    def predicates(self, spec: CorpusSpec = GAZETTE) -> dict[str, Column]:
        """One predicate for each filter that is set; a null never matches and an empty list matches nothing."""
        date = F.col(spec.date)
        out = {k: spec.dim(k).equals(v) for k, v in self.equal.items() if v is not None}
        if self.topics is not None:
            out["topic"] = F.coalesce(spec.topic.value().isin(list(self.topics)), F.lit(False)) if self.topics else F.lit(False)
        if self.below is not None:
            out["topic"] = F.coalesce(spec.topic.value().isNotNull() & F.col(self.below), F.lit(False))
        if self.day is not None:
            out["day"] = F.coalesce(date == self.day, F.lit(False))
        if self.day_from is not None:
            out["day_from"] = F.coalesce(date >= self.day_from, F.lit(False))
        if self.day_to is not None:
            out["day_to"] = F.coalesce(date <= self.day_to, F.lit(False))
        if self.months is not None:
            out["months"] = F.coalesce(F.col(spec.month).isin(list(self.months)), F.lit(False)) if self.months else F.lit(False)
        if self.text:
            out["text"] = F.coalesce(despaced(F.concat_ws(" ", *[F.col(c).cast("string") for c in self.fields])).contains(despaced(F.lit(self.text))), F.lit(False))
        return out


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def matching(df: DataFrame, filters: Filters, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """Rows that meet every filter."""
    return df.where(_all(list(filters.predicates(spec).values())))


def newest_matches(df: DataFrame, filters: Filters, k: int = 600, spec: CorpusSpec = GAZETTE) -> DataFrame:
    return matching(df, filters, spec).orderBy(*newest_order(spec)).limit(k)


def _count(weight: Column | None) -> Column:
    """Rows, or the sum of what they count for."""
    return (F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("long").alias("n")


def cross_filter(df: DataFrame, filters: Filters, spec: CorpusSpec = GAZETTE, dims: tuple[str, ...] | None = None, weight: Column | None = None) -> DataFrame:
    """facet, value, n: the total, and per dimension the counts of its values with its own filters lifted. weight: what a row
    counts for, where rows are counts themselves (``cuboid``).

    One scan: each predicate is a column, each row gives the (facet, value) pairs whose other predicates hold, and one
    aggregate counts them. Rows that fail two independent filters or more are dropped before they are exploded.
    """
    dims = dims or (*[d.dim for d in spec.dims], "day")
    preds = filters.predicates(spec)
    rows = df.withColumns({f"_p_{k}": c for k, c in preds.items()} | {"_w": F.lit(1) if weight is None else weight})
    pairs = [F.struct(F.lit("total").alias("facet"), F.when(_all([F.col(f"_p_{k}") for k in preds]), F.lit("")).alias("value"))]
    for name in dims:
        lifted = LIFTS.get(name, (name,))
        own = F.col(spec.date) if name == "day" else spec.dim(name).value()
        others = _all([F.col(f"_p_{k}") for k in preds if k not in lifted and k != name])
        pairs.append(F.struct(F.lit(name).alias("facet"), F.when(others, own.cast("string")).alias("value")))
    each = rows.select("_w", F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    return each.groupBy("facet", "value").agg(_count(None if weight is None else F.col("_w")))


def grouped(df: DataFrame, filters: Filters, by: list[str], spec: CorpusSpec = GAZETTE, weight: Column | None = None) -> DataFrame:
    """Counts over chosen dimensions of the rows that match; flags hold per dimension and nulls are left out. weight: as in
    ``cross_filter``."""
    columns = [spec.dim(b).value().alias(b) for b in by]
    rows = matching(df, filters, spec).select(*columns, (F.lit(1) if weight is None else weight).alias("_w")).dropna()
    return rows.groupBy(*by).agg(_count(None if weight is None else F.col("_w")))


def bucketed(counts: DataFrame, key: str, width: int, n: str = "n") -> DataFrame:
    """Counts by the first 4 (year), 7 (month) or 10 (day) characters of a date key."""
    if width not in (4, 7, 10):
        raise ValueError("a bucket is 4, 7 or 10 wide")
    return counts.groupBy(F.substring(key, 1, width).alias("bucket")).agg(F.sum(n).cast("long").alias(n))


def nearest_period(df: DataFrame, filters: Filters, period: str = "month", spec: CorpusSpec = GAZETTE) -> DataFrame:
    """The newest period with a match, and its matches."""
    return grouped(df, filters, [period], spec).orderBy(F.desc(period)).limit(1)


def within_budget(df: DataFrame, filters: Filters, budget: int, spec: CorpusSpec = GAZETTE) -> DataFrame:
    """Months with matches, newest first, and whether they are among the first ``budget``."""
    months = matching(df, filters, spec).groupBy(spec.month).agg(F.count(F.lit(1)).alias("n"))
    take = months.orderBy(F.desc(spec.month)).limit(budget).select(spec.month, F.lit(True).alias("taken"))
    return months.join(take, spec.month, "left").select(spec.month, "n", F.coalesce("taken", F.lit(False)).alias("taken"))
