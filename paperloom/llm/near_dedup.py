"""Near-duplicate documents: similarity sketches, banding, exact verification, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.common import map_batches, python_ready
from paperloom.llm.components import connected_components
from paperloom.llm.sketch import band_keys, sketch
from paperloom.llm.words import shingle_set
from paperloom.session import materialise

#: 32 bands of 4 coordinates: a pair at similarity 0.8 misses every band with probability 5e-8.
BANDS, ROWS = 32, 4
#: Shingles that a block of a large bucket holds at most on average (8 bytes each).
BLOCK_SHINGLES = 1_000_000


def _fingerprint(shingles: np.ndarray) -> str | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, row, n_shingles, fp, keys``: size, fingerprint and band keys of each shingle set.

    ``row`` is a hash of id and text, by which the text is found again where ids are null or repeated.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        out = []
        for doc_id, row, text in zip(batch["doc_id"], batch["row"], batch["text"]):
            s = shingle_set(text, k)
            keys = band_keys(sketch(s, bands * rows), bands).view(np.int64).tolist() if len(s) else None
            out.append((doc_id, row, len(s), _fingerprint(s), keys))
        return out

    return map_batches(_rows(docs), run, f"doc_id {kind}, row long, n_shingles long, fp string, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``fp, shingles`` of the fingerprints in `wanted` (row, fp), from the texts again."""

    def run(batch):
        out = []
        for text, fp in zip(batch["text"], batch["fp"]):
            s = shingle_set(text, k)
            if _fingerprint(s) == fp:  # two rows may share a hash
                out.append((fp, s.view(np.int64).tolist()))
        return out

    texts = _rows(docs).join(wanted, "row")
    return map_batches(texts, run, "fp string, shingles array<long>").dropDuplicates(["fp"])


def _similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _linked_in_block(percent: int, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links that join different components among one block (or between two blocks) of a bucket.

    A pair is compared in the first open bucket it shares, and not at all once earlier
    links have joined its members, so the result is a spanning set of links.
    """
    bucket, left, right = key
    rows = rows.sort_values("fp")
    fps, side = rows["fp"].tolist(), rows["block"].to_numpy()
    sets = [np.asarray(s, np.int64).view(np.uint64) for s in rows["shingles"]]
    sizes = np.array([len(s) for s in sets])
    shared = np.stack([np.asarray(o, np.int64) for o in rows["open_keys"]])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(sets)
    _, group = np.unique(rows["component"].to_numpy().astype(str), return_inverse=True)
    found = []
    for i in range(len(fps) - 1):
        rest = np.arange(i + 1, len(fps))
        ok = group[rest] != group[i]
        if left != right:
            ok &= side[rest] != side[i]
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        ok &= 100 * small >= percent * large
        rest = rest[ok]
        if not len(rest):
            continue
        same = (shared[rest] == shared[i]) & (shared[i] != 0)
        rest = rest[shared[i][same.argmax(axis=1)] == bucket]
        for j in rest:
            if group[j] == group[i]:
                continue
            part = flat[starts[j] : starts[j] + sizes[j]]
            at = np.searchsorted(sets[i], part)
            at[at == sizes[i]] = 0
            if _similar(int((sets[i][at] == part).sum()), int(sizes[i]), int(sizes[j]), percent):
                found.append((fps[i], fps[j]))
                group[group == group[j]] = group[i]
    return pd.DataFrame(found, columns=["u", "v"])


def links(docs: DataFrame, signed: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links ``u, v`` between fingerprints that connect all linked documents.

    First every member of a bucket meets the bucket's smallest fingerprint.  Buckets
    whose other members are not connected by that go on, once per distinct set of
    members: their members are compared block by block inside Python workers, which
    skip what is already connected.  No bucket is capped and no pair of a connected
    group is written.
    """
    python_ready(docs.sparkSession)
    reps = materialise(
        signed.where("fp is not null").groupBy("fp").agg(
            F.min("row").alias("row"), F.any_value("n_shingles").alias("n"), F.any_value("keys").alias("keys")
        ),
        "reps",
    )
    members = reps.select("fp", F.explode("keys").alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min("fp").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    members = materialise(members.join(pivots, "bucket"), "members")
    wanted = reps.join(members.select("fp").distinct(), "fp", "left_semi").select("row", "fp")
    sets = materialise(_sets(docs, wanted, k), "sets")

    pairs = members.where("fp <> pivot").select("fp", "pivot").distinct()
    a, b = sets.select("fp", F.col("shingles").alias("a")), sets.select(F.col("fp").alias("pivot"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    first = materialise(
        pairs.join(a, "fp").join(b, "pivot")
        .where(_similar(common, F.size("a"), F.size("b"), percent))
        .select(F.col("pivot").alias("u"), F.col("fp").alias("v")),
        "first",
    )

    # a few steps towards the smallest neighbour; a partial answer only means more comparisons
    labels = (
        first.select(F.col("v").alias("fp"), F.col("u").alias("to"))
        .union(first.select(F.col("u").alias("fp"), F.col("u").alias("to")))
        .groupBy("fp").agg(F.min("to").alias("component"))
    )
    for _ in range(2):
        up = labels.select(F.col("fp").alias("component"), F.col("component").alias("higher"))
        labels = materialise(
            labels.join(up, "component", "left").select("fp", F.coalesce("higher", "component").alias("component")), "labels"
        )
    left = (
        members.where("m > 2 and fp <> pivot").select("bucket", "fp")
        .join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    )
    one_each = F.xxhash64("fp")
    open_buckets = (
        left.join(reps.select("fp", "n"), "fp").groupBy("bucket")
        .agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.sum("n").alias("n"),
            F.bit_xor(one_each).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "fp")).alias("y"),
        )
        .where("low <> high")
        .groupBy("m", "n", "x", "y").agg(F.min("bucket").alias("bucket"))
        .select("bucket", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    left = materialise(left.join(open_buckets, "bucket"), "open")
    keys = left.groupBy("fp").agg(F.collect_set("bucket").alias("open_set")).join(reps.select("fp", "keys"), "fp")  # at most BANDS
    keys = keys.select("fp", F.expr("transform(keys, x -> if(array_contains(open_set, x), x, 0L))").alias("open_keys"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = (
        left.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("left_block", F.least("block", "other"))
        .withColumn("right_block", F.greatest("block", "other"))
        .join(keys, "fp").join(sets, "fp")
    )
    columns = ["fp", "component", "block", "open_keys", "shingles", "bucket", "left_block", "right_block"]
    second = spread.select(columns).groupBy("bucket", "left_block", "right_block").applyInPandas(
        lambda key, rows: _linked_in_block(percent, key, rows), "u string, v string"
    )
    return first.union(second)


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs` (doc_id, text): ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * |A ∩ B| >= percent * |A ∪ B| over their sets of
    k-word shingles (A-Z lower-cased); component_id is the smallest doc_id that links
    reach.  A null text, or one without words, has an empty set and is linked with
    nothing.  Equal texts share a set and thus a component.  Rows that repeat a doc_id
    are judged one by one and get the same columns.  doc_id may be a number or a text.  A null one can be linked, never
    names a component unless all its members are null, and counts as kept then.
    """
    signed = materialise(signatures(docs, k), "signatures")
    joined = connected_components(links(docs, signed, k, percent)).select(
        F.col("node").alias("fp"), F.col("component").alias("root")
    )
    lowest = signed.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("low"))
    lowest = materialise(
        lowest.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes"
    )
    ids = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = lowest.join(ids, "root").select(F.col("fp").alias("class_fp"), "component_id")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.join(classes, F.col("fp") == F.col("class_fp"), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
