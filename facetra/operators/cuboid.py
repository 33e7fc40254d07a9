"""Counts over a few columns, stored once, that answer the filters which they can answer.

A cuboid counts records by month and the values of low-cardinality dimensions; a value stands only where its flag holds, so
flags are folded in and need no columns of their own. It answers a filter whose keys and grouping are among its dimensions
and gives the same numbers as the records; ``source`` picks it where it does and the records elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetra.operators.crossfilter import Filters
from facetra.specs import GAZETTE, CorpusSpec, FacetSpec

#: The column of counts.
COUNT = "records"


@dataclass(frozen=True)
class Cuboid:
    """dims: its dimensions besides year and month. A cuboid has at most as many rows as months times their values."""

    dims: tuple[str, ...]
    spec: CorpusSpec = GAZETTE

    @property
    def flagless(self) -> CorpusSpec:
        """The roles of the cuboid's columns: values are counted as they stand."""
        plain = lambda d: FacetSpec(d.dim, d.column)
        return replace(self.spec, topic=plain(self.spec.topic), facets=tuple(plain(d) for d in self.spec.facets if d.dim in self.dims))

    def build(self, records: DataFrame) -> DataFrame:
        """year, month, one column a dimension, and counts."""
        values = [self.spec.dim(d).value().alias(self.spec.dim(d).column) for d in self.dims]
        rows = records.select(F.col(self.spec.year), F.col(self.spec.month), *values)
        return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(COUNT))

    def answers(self, filters: Filters, by: list[str] | tuple[str, ...]) -> bool:
        """Whether every filter that is set and every dimension asked for is among the cuboid's columns."""
        own = {"year", "month", *self.dims}
        set_ = {k for k, v in filters.equal.items() if v is not None} | set(by)
        if filters.topics is not None:
            set_.add("topic")
        dated = any(x is not None for x in (filters.day, filters.day_from, filters.day_to))
        return set_ <= own and not dated and not filters.text and filters.below is None


def source(cuboid: Cuboid, counts: DataFrame, records: DataFrame, filters: Filters, by: list[str] | tuple[str, ...]) -> tuple[DataFrame, CorpusSpec, Column]:
    """The smaller table that answers, its roles, and what a row of it counts for."""
    if cuboid.answers(filters, by):
        return counts, cuboid.flagless, F.col(COUNT)
    return records, cuboid.spec, F.lit(1)
