"""Column roles. A labelled dimension counts only where its flag holds; an attribute has no flag."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FacetSpec:
    dim: str
    column: str
    flag: str | None = None

    def value(self) -> Column:
        """The value where it may be counted, else null."""
        c = F.col(self.column)
        return c if self.flag is None else F.when(F.col(self.flag), c)

    def equals(self, value) -> Column:
        return F.coalesce(self.value() == F.lit(value), F.lit(False))


@dataclass(frozen=True)
class CorpusSpec:
    id: str = "id"
    date: str = "date"
    month: str = "month"
    year: str = "year"
    topic: FacetSpec = FacetSpec("topic", "topic", "topic_c")
    facets: tuple[FacetSpec, ...] = field(
        default=(
            FacetSpec("action", "action", "action_c"),
            FacetSpec("govlevel", "govlevel", "govlevel_c"),
            FacetSpec("agency", "agency"),
            FacetSpec("province", "province"),
        )
    )

    @property
    def dims(self) -> tuple[FacetSpec, ...]:
        return (FacetSpec("year", self.year), FacetSpec("month", self.month), self.topic, *self.facets)

    def dim(self, name: str) -> FacetSpec:
        found = [d for d in self.dims if d.dim == name]
        if not found:
            raise ValueError(f"unknown dimension {name!r}; there are {', '.join(d.dim for d in self.dims)}")
        return found[0]

    def check(self, df: DataFrame) -> DataFrame:
        """df, if it has every column of the roles."""
        need = {self.id, self.date, *[c for d in self.dims for c in (d.column, d.flag) if c]}
        if missing := need - set(df.columns):
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        return df


GAZETTE = CorpusSpec()
