"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Lanes that a large group is dealt into before its rows are numbered.
LANES = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Python tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_facetra_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="facetra-")) / "facetra_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))  # served by the driver to every executor
    sc._facetra_shipped = True


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """rows.mapInArrow(run, schema), whatever the columns are called, dots and doubles included: they travel under the names
    of their places."""
    places = [f"c{i}" for i in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, places)

    neutral = StructType([StructField(c, f.dataType, f.nullable) for c, f in zip(places, schema, strict=True)])
    return rows.toDF(*[f"r{i}" for i in range(len(rows.columns))]).mapInArrow(renamed, neutral).toDF(*schema.names)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def numbered(df: DataFrame, keys: list[str], order: list, name: str, lane: Column, lanes: int = LANES) -> DataFrame:
    """Number the rows of each key from 0 without a gap, in lanes, so that no task holds a whole key.

    A row's number is the count of rows in the key's earlier lanes plus its rank within its own lane; the counts
    are pre-aggregated, and their running sum is over one row per key and lane.
    """
    df = df.withColumn("_lane", F.coalesce(F.pmod(lane, F.lit(lanes)), F.lit(0)).cast("int"))
    by = [*keys, "_lane"]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*keys).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_start"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return ranked.join(starts, by).withColumn(name, F.col("_start") + F.col("_rank")).drop("_lane", "_start", "_rank")
