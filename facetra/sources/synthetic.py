"""A generated corpus: the same seed gives the same rows however they are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the generated corpus.
TOPICS = (("environment", None), ("pollution", "environment"), ("pollution_waste", "pollution"), ("bankruptcy", None), ("public_admin", None))
KINDS = (("pollution_waste", "rule"), ("bankruptcy", "notice"), ("public_admin", "appointment"))


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, s.replace("_", " "), p) for s, p in TOPICS], "slug string, name string, parent string")


def records(spark: SparkSession, years: list[int], per_month: int = 40, months: int = 2, seed: int = 7) -> DataFrame:
    """years x months x per_month records of three kinds; four in five corroborated."""
    n = len(years) * months * per_month
    pick = lambda salt, k: F.pmod(F.xxhash64("i", F.lit(seed), F.lit(salt)), F.lit(k)).cast("int")
    of = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at)
    base = spark.range(n).withColumnRenamed("id", "i")
    base = base.withColumns({"k": pick("kind", len(KINDS)), "y": of(years, F.floor(F.col("i") / (months * per_month)).cast("int")), "m": (F.floor(F.col("i") / per_month) % months + 1).cast("int")})
    trusted: Column = pick("trust", 5) != 0
    year = F.col("y").cast("string")
    month = F.concat(year, F.lit("-"), F.lpad(F.col("m").cast("string"), 2, "0"))
    issuer = F.when(F.col("k") == 0, F.concat(F.lit("waste office "), (F.col("y") % 2).cast("string"))).otherwise(of(["", "court", "ministry"], F.col("k")))
    return base.select(
        F.format_string("%s-%06d", year, F.col("i")).alias("id"), year.alias("year"), month.alias("month"),
        F.concat(month, F.lit("-"), F.lpad((pick("day", 28) + 1).cast("string"), 2, "0")).alias("date"),
        F.concat_ws(" ", of([k for _, k in KINDS], F.col("k")), F.col("i").cast("string")).alias("title"),
        issuer.alias("agency"), F.lit("office").alias("agency_type"), F.concat(F.lit("province "), pick("province", 7).cast("string")).alias("province"),
        of([t for t, _ in KINDS], F.col("k")).alias("topic"), of([k for _, k in KINDS], F.col("k")).alias("action"),
        of(["central", "local"], pick("level", 2)).alias("govlevel"),
        trusted.alias("topic_c"), trusted.alias("action_c"), trusted.alias("govlevel_c"),
        (F.col("y") - 1883).alias("volume"), F.concat(pick("part", 300).cast("string"), F.lit(" ง")).alias("part"), pick("page", 90).alias("page"),
    )
