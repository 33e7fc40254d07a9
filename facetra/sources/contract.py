"""What a source of records promises: a name, whom to credit, its years, records of chosen years, and its topic tree.

``records`` gets the years that are wanted, so that a source reads those alone: folders of a year, row groups by their month,
or nothing but what it makes. ``load`` checks the request against the years that are there and the result against the columns
that every source shares; ``together`` stacks sources, ``listing`` is the registry row of each.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetra.sources import jsonl, synthetic, tables
from facetra.sources.jsonl import chosen_years

#: Columns, with their types, that every source has; it may have more.
COMMON = {
    "id": "string", "year": "string", "month": "string", "date": "string", "title": "string", "agency": "string", "province": "string", "topic": "string",
    "topic_c": "boolean", "action": "string", "action_c": "boolean", "govlevel": "string", "govlevel_c": "boolean", "volume": "int", "part": "string", "page": "int",
}


class Source(ABC):
    #: A short id, and title, name and url of whom to credit.
    name: str
    credit: dict[str, str]

    @abstractmethod
    def years(self, spark: SparkSession) -> list[str]:
        """Years with records, in order."""

    @abstractmethod
    def records(self, spark: SparkSession, years: list[str] | None) -> DataFrame:
        """Records of some years (None: all), with the COMMON columns and what else there is."""

    @abstractmethod
    def topics(self, spark: SparkSession) -> DataFrame:
        """slug, name, parent."""

    def load(self, spark: SparkSession, years: str | None = None) -> DataFrame:
        """Records with ``source``. years: as in ``chosen_years``; one that is not there is an error, a column that is not too."""
        wanted = None if years is None else chosen_years(years, self.years(spark))
        rows = self.records(spark, wanted)
        if missing := [c for c in COMMON if c not in rows.columns]:
            raise ValueError(f"source {self.name} lacks {', '.join(missing)}")
        more = [c for c in rows.columns if c not in COMMON and c != "source"]
        return rows.select(*[F.col(c).cast(t).alias(c) for c, t in COMMON.items()], *more, F.lit(self.name).alias("source"))


@dataclass(frozen=True)
class JsonLayers(Source):
    """A folder of JSON-lines layers by year and month. taxonomy: the path of its taxonomy document."""

    root: str
    name: str
    credit: dict[str, str] = field(default_factory=dict, hash=False)
    taxonomy: str | None = None

    def years(self, spark: SparkSession) -> list[str]:
        return sorted(r[0] for r in jsonl.years(jsonl.meta(spark, self.root), jsonl.labels(spark, self.root)).collect())  # a row a year

    def records(self, spark: SparkSession, years: list[str] | None) -> DataFrame:
        return jsonl.load(spark, self.root, ",".join(years) if years else None)

    def topics(self, spark: SparkSession) -> DataFrame:
        return jsonl.taxonomy(spark, self.taxonomy or f"{self.root}/taxonomy.json")[0]


@dataclass(frozen=True)
class StarTables(Source):
    """A folder of star-schema tables; the derived records are clustered by month, which a filter on months prunes."""

    sf_dir: str
    name: str = "star"
    credit: dict[str, str] = field(default_factory=dict, hash=False)

    def years(self, spark: SparkSession) -> list[str]:
        return sorted(r[0] for r in tables.records(spark, self.sf_dir).select("year").distinct().collect())  # a row a year

    def records(self, spark: SparkSession, years: list[str] | None) -> DataFrame:
        rows = tables.records(spark, self.sf_dir)
        if years is None:
            return rows
        return rows.where(F.col("year").isin(years) & F.col("month").between(f"{years[0]}-", f"{years[-1]}-~"))

    def topics(self, spark: SparkSession) -> DataFrame:
        return tables.topics(spark, self.sf_dir)


@dataclass(frozen=True)
class Generated(Source):
    """A generated corpus of some years; only what is asked for is made."""

    first: int
    last: int
    per_month: int = 40
    name: str = "generated"
    credit: dict[str, str] = field(default_factory=lambda: {"title": "Generated records"}, hash=False)

    def years(self, spark: SparkSession) -> list[str]:
        return [str(y) for y in range(self.first, self.last + 1)]

    def records(self, spark: SparkSession, years: list[str] | None) -> DataFrame:
        every = synthetic.records(spark, list(range(self.first, self.last + 1)), self.per_month)
        return every if years is None else every.where(F.col("year").isin(years))

    def topics(self, spark: SparkSession) -> DataFrame:
        return synthetic.topics(spark)


def together(spark: SparkSession, sources: list[Source], years: str | None = None) -> DataFrame:
    """The common columns of several sources, each with its ``source``. A source without one of the years is an error."""
    if len({s.name for s in sources}) < len(sources):
        raise ValueError("two sources of one name")
    out = None
    for s in sources:
        rows = s.load(spark, years).select(*COMMON, "source")
        out = rows if out is None else out.unionByName(rows)
    return out


def listing(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """id, title, credit, url, docs, years, first_year, last_year, latest: one row per source, by id."""
    counts = together(spark, sources).groupBy(F.col("source").alias("id")).agg(
        F.count(F.lit(1)).alias("docs"), F.count_distinct("year").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max("date").alias("latest")
    )
    said = [(s.name, s.credit.get("title", s.name), s.credit.get("name"), s.credit.get("url")) for s in sources]
    names = spark.createDataFrame(said, "id string, title string, credit string, url string")
    return names.join(counts, "id", "left").withColumn("docs", F.coalesce("docs", F.lit(0))).orderBy("id")
