"""Keys that earlier micro-batches handled, kept so that a batch reads little of them.

A run is the keys of one batch, dealt to hash buckets, with a filter: per bucket 64-bit words in which a
key sets five bits of the one word that its hash names.  A batch first meets the words of its own
buckets; only buckets with a word that holds all five bits of a key are opened.  About one new key
in fifty opens a bucket in vain.  `FAN` runs of a level are merged to one of the next, so the number of runs grows
with the logarithm of the number of batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom.sources import store

#: Hash buckets of a store, fixed when it is made; about a million keys each is a good size.
BUCKETS = 256
#: Runs of a level that are merged to one of the next.
FAN = 8
#: Filter bits per key.
BITS = 16


def _word(key: Column, words: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 24), words)


def _mask(key: Column) -> Column:
    """The five bits of a key in its word (fewer where they coincide)."""
    h = F.xxhash64(key, F.lit("mask"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(5)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_run(keys: DataFrame, path: str, buckets: int, level: int) -> tuple[str, dict]:
    """Distinct keys as a run: its folder and what the version has to know about it."""
    spark = keys.sparkSession
    n = keys.count()
    words = max(1, -(-n * BITS // (64 * buckets)))
    name = keys.columns[0]
    dealt = keys.withColumn("bucket", _bucket(F.col(name), buckets)).repartition("bucket")
    folder = store.write(dealt, path, ["bucket"])
    stored = spark.read.schema(_schema(keys)).parquet(f"{path}/{folder}")
    filters = stored.groupBy("bucket", _word(F.col(name), F.lit(words)).alias("word")).agg(F.bit_or(_mask(F.col(name))).alias("bits"))
    filters.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}.filter")
    return folder, {"n": n, "words": words, "level": level, "buckets": buckets}


def _schema(keys: DataFrame) -> str:
    field = keys.schema.fields[0]
    return f"`{field.name}` {field.dataType.simpleString()}, bucket int"


def _runs(spark: SparkSession, path: str, before: int) -> store.Parts:
    """Runs of batches before the given one, so that a repeated batch sees the same."""
    return [p for p in store.live(spark, path)[1] if p.info["n"] and p.info["last"] < before]


def find(keys: DataFrame, path: str, batch_id: int, scratch: str) -> DataFrame | None:
    """Which of `keys` (one column, read more than once) batches before `batch_id` stored; null where there are none.

    What is gathered on the driver are numbers of runs and buckets.  `scratch` is a
    folder for the candidates, written anew by every batch.
    """
    spark, name = keys.sparkSession, keys.columns[0]
    runs = _runs(spark, path, batch_id)
    if not runs:
        return None
    buckets = runs[0].info["buckets"]
    key = F.col(name)
    mine = keys.where(key.isNotNull()).withColumn("bucket", _bucket(key, buckets))
    hit = [r.bucket for r in mine.select("bucket").distinct().collect()]
    if not hit:
        return None
    known = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(p.info["words"]).alias("words")) for i, p in enumerate(runs)])
    probes = mine.withColumn("_p", F.explode(known)).select(
        name, "bucket", F.col("_p.run").alias("run"), _word(key, F.col("_p.words")).alias("word"), _mask(key).alias("mask")
    )
    filters = reduce(
        DataFrame.unionByName,
        [
            spark.read.schema("word bigint, bits bigint, bucket int").parquet(f"{path}/{p.folder}.filter")
            .where(F.col("bucket").isin(hit)).withColumn("run", F.lit(i))
            for i, p in enumerate(runs)
        ],
    )
    maybe = probes.join(filters, ["run", "bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    maybe.select(name, "run", "bucket").write.mode("overwrite").parquet(scratch)
    maybe = spark.read.schema(f"{_schema(keys).split(', bucket')[0]}, run int, bucket int").parquet(scratch)
    opened: dict[int, list[int]] = {}
    for r in maybe.select("run", "bucket").distinct().collect():
        opened.setdefault(r.run, []).append(r.bucket)
    if not opened:
        return None
    stored = [
        spark.read.schema(_schema(keys)).parquet(f"{path}/{runs[i].folder}").where(F.col("bucket").isin(found)).select(name)
        for i, found in opened.items()
    ]
    return reduce(DataFrame.union, stored).join(maybe.select(name).distinct(), name, "left_semi")


def add(keys: DataFrame, path: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Store the new keys of a batch; the batch run again replaces them.  Null keys are not kept."""
    spark = keys.sparkSession
    runs = store.live(spark, path)[1]
    buckets = runs[0].info["buckets"] if runs else buckets
    folder, info = _write_run(keys.where(F.col(keys.columns[0]).isNotNull()), path, buckets, 0)
    store.add(spark, path, folder, tag=f"batch {batch_id}", info={**info, "last": batch_id})


def merge(spark: SparkSession, path: str, key: str, batch_id: int, fan: int = FAN) -> None:
    """Merge full levels of runs that were stored before `batch_id`, the smallest level first."""
    level = 0
    while True:
        runs = store.live(spark, path)[1]
        ready = [p for p in runs if p.info["level"] == level and p.info["last"] < batch_id]
        if len(ready) >= fan:
            # a batch without new keys has written no file that names the columns
            full = [p for p in ready if p.info["n"]] or ready[:1]
            frames = [spark.read.parquet(f"{path}/{p.folder}") for p in full if p.info["n"]]
            if frames:
                # runs share no key: a batch stores only what earlier ones had not
                keys = reduce(DataFrame.unionByName, frames).select(key)
                folder, info = _write_run(keys, path, ready[0].info["buckets"], level + 1)
            else:
                folder, info = ready[0].folder, {**ready[0].info, "level": level + 1}
            store.fold(spark, path, ready, folder, base=False, info={**info, "last": max(p.info["last"] for p in ready)})
        elif not any(p.info["level"] > level for p in runs):
            return
        level += 1


def stored(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All keys of the store."""
    runs = [p for p in store.live(spark, path)[1] if p.info["n"]]
    return reduce(DataFrame.union, [spark.read.parquet(f"{path}/{p.folder}").select(key) for p in runs])
