"""Incremental runs over newly arrived feed data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.ranking import first_per_key
from paperloom.streaming import seen

BATCH = "batch"


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they land."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_once(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch; running it again replaces the same folder."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def run_incremental(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    key: str,
    order: list[str],
    step: Callable[[DataFrame], DataFrame],
    buckets: int = seen.BUCKETS,
    fan: int = seen.FAN,
) -> StreamingQuery:
    """Process what arrived since the last run, then stop.

    A key is handled once over all batches: a batch keeps the first row per key and
    drops keys that earlier batches stored (`streaming.seen`).  `step` turns the new rows into
    output rows and must keep `key`.  Rows with a null key are handled as one in every batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, keys = batch.sparkSession, f"{out}/keys"
        # one batch at a time: its rows are read several times below, from the shared folder
        first_per_key(batch, [key], [F.col(c) for c in order]).write.mode("overwrite").parquet(f"{out}/incoming")
        new = spark.read.schema(batch.schema).parquet(f"{out}/incoming")
        seen.merge(spark, keys, key, batch_id, fan)
        done = seen.find(new.select(key), keys, batch_id, f"{out}/maybe")
        if done is not None:
            new = new.join(done, key, "left_anti").select(batch.columns)
        append_once(step(new), f"{out}/rows", batch_id)
        seen.add(new.select(key), keys, batch_id, buckets)

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_within(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Pure-stream variant: one row per key within the watermark delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def read_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/rows").drop(BATCH)


def run_until_done(query: StreamingQuery, timeout_s: int | None = None) -> None:
    """Wait for an available-now query and raise what it raised."""
    query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()

