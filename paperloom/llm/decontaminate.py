"""Benchmark passages in documents by spaced seeds, verified along their alignment."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm.common import map_batches, python_ready
from paperloom.llm.words import hash_words, windows
from paperloom.session import materialise

#: 1: the word counts, 0: it may differ.  The first also serves items of five words.
MASKS = ("11111", "110111", "1101011", "11010011", "1011001001", "1100100101")
#: Bits of the filter that seeds of documents pass before they travel; 2 MB at any size of the benchmark.
FILTER_BITS = 1 << 24
#: Words that must agree in an overlap in which four of five do.
MIN_WORDS = 8

_WORD = re.compile(r"[^\W_]+")


def seed_words(text: str | None) -> np.ndarray:
    """Hashes of the runs of letters and digits, lower-cased."""
    return hash_words([w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text.lower())] if text else [])


def seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes and their start positions under every mask."""
    found, starts = [], []
    for number, mask in enumerate(MASKS):
        kept = [i for i, c in enumerate(mask) if c == "1"]
        h = windows(hashes, [*kept[:-1], len(mask) - 1]) if len(hashes) >= len(mask) else np.empty(0, np.uint64)
        found.append(h ^ np.uint64(xxhash.xxh3_64_intdigest(mask, number)))
        starts.append(np.arange(len(h), dtype=np.int64))
    return np.concatenate(found), np.concatenate(starts)


def _bits(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(shift)) % np.uint64(FILTER_BITS)).astype(np.int64) for shift in (0, 20, 40)]


def best_overlap(same: np.ndarray, least: int) -> tuple[int, int, int]:
    """``start, end, matches`` of the longest stretch with four of five words equal; zeros where `least` are not.

    The stretch begins and ends with an equal word, which drops no stretch with enough of
    them.  Of equally long ones that with the most equal words is taken, then the first.
    """
    if int(same.sum()) < least:
        return 0, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])  # over a stretch: not below 0 where 4 of 5 are equal
    starts, ends = np.flatnonzero(same), np.flatnonzero(same) + 1
    lowest = np.minimum.accumulate(total[starts])
    first = starts[np.searchsorted(-lowest, -total[ends])]  # the first start from which the total does not fall
    n = int((ends - first).max())
    begins = starts[starts + n <= len(same)]
    begins = begins[same[begins + n - 1]]
    begin = int(begins[np.argmax(total[begins + n] - total[begins])])
    matched = int(same[begin : begin + n].sum())
    # any stretch with `least` equal words is at most this long, and of its length this one has the most
    return (begin, begin + n, matched) if matched >= least else (0, 0, 0)


def _seed_filter(spark: SparkSession, bench_seeds: DataFrame):
    """A Bloom filter of all benchmark seeds, put together by Spark from 64-bit pieces."""
    positions = [F.pmod(F.shiftrightunsigned("h", s).bitwiseAND(F.lit((1 << 63) - 1)), F.lit(FILTER_BITS)) for s in (0, 20, 40)]
    words = (
        bench_seeds.select(F.explode(F.array(*positions)).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    found = words.toPandas()  # at most FILTER_BITS / 64 rows
    bits[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_words, n_match`` for every benchmark item that a document overlaps.

    Texts are runs of letters and digits, lower-cased.  An overlap is a stretch of a
    document aligned word for word with a stretch of an item, in which at least four of
    five words agree and at least `MIN_WORDS` (or all words of a shorter item) do; it is
    found where a seed of both agrees.  n_words is the length of the longest overlap of the
    pair from an equal word to an equal word, n_match its equal words.  Null and empty texts have no overlap, nor have items
    of fewer than five words.  Rows that repeat an id count as one document or item with
    several texts; rows with a null id are found like others.  Longer overlaps win, then
    those with more matches.

    Documents' seeds pass a filter of the benchmark's seeds, of fixed size, before they
    are joined; then only documents with such seeds move, and of them the aligned words.
    """
    spark = docs.sparkSession
    python_ready(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()  # a number or a text

    def items(batch):
        return [
            (item_id, h.view(np.int64).tolist())
            for item_id, h in ((i, seed_words(t)) for i, t in zip(batch["item_id"], batch["text"]))
            if len(h) >= len(MASKS[0])
        ]

    bench = map_batches(benchmark.select("item_id", "text"), items, "item_id long, words array<long>")
    bench = materialise(bench.distinct().withColumn("item", F.xxhash64("item_id", "words")), "bench")

    def item_seeds(batch):
        out = []
        for item, words in zip(batch["item"], batch["words"]):
            h, start = seeds(np.array(words, np.int64).view(np.uint64))
            out += zip([item] * len(h), h.view(np.int64).tolist(), start.tolist())
        return out

    bench_seeds = materialise(map_batches(bench.select("item", "words"), item_seeds, "item long, h long, at long"), "seeds")
    bits = _seed_filter(spark, bench_seeds)

    def candidates(batch):
        known, out = bits.value, []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            words = seed_words(text)
            h, start = seeds(words)
            hit = np.ones(len(h), bool)
            for b in _bits(h):
                hit &= known[b]
            if hit.any():
                found = list(zip(h[hit].view(np.int64).tolist(), start[hit].tolist()))
                out.append((doc_id, words.view(np.int64).tolist(), [{"h": a, "at": b} for a, b in found]))
        return out

    texts = map_batches(
        docs.select("doc_id", "text"), candidates, f"doc_id {kind}, words array<long>, hits array<struct<h: long, at: long>>"
    )
    texts = materialise(texts.withColumn("row", F.xxhash64("doc_id", "words")), "candidates")
    hits = texts.select("row", F.explode("hits").alias("hit")).select("row", "hit.h", F.col("hit.at").alias("doc_at"))
    aligned = (
        hits.join(bench_seeds, "h").select("row", "item", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
        .join(bench.withColumnRenamed("words", "item_words"), "item")
    )
    # the item from its word `skip` on lies over the document from its word `shift` on
    skip = F.greatest(-F.col("shift"), F.lit(0))
    pairs = aligned.join(texts.select("row", "doc_id", "words"), "row").select(
        "doc_id", "item_id", F.size("item_words").alias("n_item"),
        F.expr("slice(words, cast(greatest(shift, 0) + 1 as int), size(item_words))").alias("a"),
        F.slice("item_words", (skip + 1).cast("int"), F.size("item_words")).alias("b"),
    )

    def verify(batch):
        out = []
        for doc_id, item_id, n_item, a, b in zip(*(batch[c] for c in ("doc_id", "item_id", "n_item", "a", "b"))):
            n = min(len(a), len(b))
            begin, end, matched = best_overlap(np.array(a[:n]) == np.array(b[:n]), min(MIN_WORDS, n_item))
            if matched:
                out.append((doc_id, item_id, end - begin, matched))
        return out

    verified = map_batches(pairs, verify, f"doc_id {kind}, item_id long, n_words long, n_match long")
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_match")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_words", "best.n_match")
