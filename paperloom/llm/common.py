"""Helpers of the operators: Arrow passes over documents and distributed row positions."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from paperloom.session import materialise

#: Rows of one Arrow batch handed to Python; long texts make larger batches a memory risk.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED = ""


def python_ready(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, and small Arrow batches."""
    global _SHIPPED
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if _SHIPPED == context.applicationId:
        return
    package = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as archive:
        for source in package.rglob("*.py"):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(name)  # the driver serves the file to the executors
    _SHIPPED = context.applicationId


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], list[tuple]], schema: str | T.StructType) -> DataFrame:
    """Apply `fn` to columns of Python values, batch by batch; it returns rows of `schema`.

    Nothing is kept between batches, so memory is bounded by one batch.
    """
    python_ready(df.sparkSession)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = fn(batch.to_pydict())
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, keys: list, weight: str | None, purpose: str, parts: int | None = None) -> DataFrame:
    """`df` with the columns ``_part``, ``_row`` (from 0 in the part) and ``_start``.

    ``_start`` is the number of rows (or the sum of column `weight`) of all rows before
    this one in the order of `keys`.  Rows are range-partitioned, so no task sees more
    than its share, and only one total per partition is brought together.  `keys` should
    end with a hash of the row, so that equal leading keys are spread as well.  The
    ordered rows are written once, which fixes their partition for everything after.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = F.monotonically_increasing_id()
    ordered = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.shiftright(step, 33).cast("int"))
        .withColumn("_row", step.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    ordered = materialise(ordered, purpose)
    from pyspark.sql import Window

    amount = F.col(weight) if weight else F.lit(1).cast("long")
    totals = ordered.groupBy("_part").agg(F.sum(amount).alias("_total"))
    before = totals.select(
        F.col("_part").alias("_of"),
        F.coalesce(
            F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = F.col("_row")
    if weight:
        rows = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(weight).over(rows), F.lit(0))
    return (
        ordered.withColumn("_inside", inside)
        .join(F.broadcast(before), F.col("_part") == F.col("_of"))  # one row per partition
        .withColumn("_start", F.col("_before") + F.col("_inside"))
        .drop("_of", "_before", "_inside")
    )
