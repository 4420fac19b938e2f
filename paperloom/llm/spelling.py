"""Spelling variants: words of all documents at one edit, and the frequent form each rare one stands for."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.common import python_ready
from paperloom.llm.sorted_edits import code_points, near_pairs, shared_prefix
from paperloom.session import counted, materialise

#: A run's point is deleted where this divides its hash; words have at least so many code points and occurrences.
CORRUPT_EVERY, MIN_LENGTH, MIN_COUNT = 31, 7, 2
#: A form occurs at least so many times as often as its variant.
DOMINANCE = 10
#: Words of one key that a task scans at once; keys with more are refined.
GROUP_WORDS = 20_000
#: Rows, and code points of the padded table, that a scan takes together.
CHUNK_ROWS, CHUNK_POINTS = 30_000, 4_000_000
#: Words counted in a worker before they are handed on.
COUNTED_WORDS = 200_000

# one byte per code point: A-Z become a-z, other letters up to U+00FF stay, all else is a space
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def count_words(docs: DataFrame, corrupt_every: int = CORRUPT_EVERY, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word, n`` of all runs of the whole texts of `docs` (doc_id, text), after the seeded deletions."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs(text)).items():
                    if len(word) < min_length:
                        continue
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if h % corrupt_every == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < min_length:
                            continue
                    total[word] += n
            if len(total) >= COUNTED_WORDS:
                yield handed()
                total.clear()
        yield handed()

    pieces = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return pieces.groupBy("word").agg(F.sum("n").alias("n"))


# -- keys: the part of a word before and after the place where the edit may be -------------------------

_NO_CUT = 1 << 30


def _split(before: Column, after: Column, free: Column, cut: Column) -> Column:
    """Either the edit is behind the first half of the free part, which both words then share, or it
    is before the end of that half, and both share the rest.  `cut` gives each pair to one of the two."""
    half = F.floor(free / 2).cast("int")
    behind = F.struct((before + half).alias("before"), after.alias("after"), cut.alias("cut"))
    ahead = F.struct(before.alias("before"), (after + free - half).alias("after"), (before + half).alias("cut"))
    return F.explode(F.array(behind, ahead))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, before, after, cut) with ``key``: the class and both shared parts."""
    parts = [F.col("m"), F.col("before"), F.col("after"), F.expr("left(word, before)"), F.expr("right(word, after)")]
    return rows.withColumn("key", F.concat_ws("\0", *parts))


def _level(rows: DataFrame) -> DataFrame:
    split = rows.withColumn("_s", _split(F.col("before"), F.col("after"), F.col("m") - F.col("before") - F.col("after"), F.col("cut")))
    return _keyed(split.select("word", "n", "m", "_s.before", "_s.after", "_s.cut"))


def keyed_words(vocabulary: DataFrame, min_length: int = MIN_LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """Rows (key, m, before, after, cut, word, n) in which every pair at one edit shares exactly one key.

    `m` is the shorter length of a pair, so a word of length L stands in the classes L and
    L - 1.  A key with more than `group_words` words is refined: its free part is halved
    again, until one code point is free, when a key holds at most as many words as there
    are letters, and their pairs.
    """
    length = F.length("word")
    zero = F.lit(0)
    rows = vocabulary.select(
        "word", "n", F.explode(F.array(length, length - 1)).alias("m"), zero.alias("before"), zero.alias("after"), F.lit(_NO_CUT).alias("cut")
    ).where(F.col("m") >= max(min_length, 2))
    level, done = _level(rows), []
    while True:
        free = F.col("m") - F.col("before") - F.col("after")
        large = materialise(level.where(free > 1).groupBy("key").count().where(F.col("count") > group_words).select("key"), "large")
        if large.isEmpty():
            break
        large = counted(large)
        done.append(level.join(large, "key", "left_anti"))
        level = materialise(_level(level.join(large, "key", "left_semi")), "finer")
    for rest in done:
        level = level.union(rest.select(level.columns))
    return level


def _near_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole keys to ``word, n_near, top_n, top``, the near words within each key."""
    kept: list[tuple] = []  # key, m, before, after, cut, word, n, free part
    width = 0

    def scanned(rows: list[tuple]) -> pa.RecordBatch:
        first = np.array([k == 0 or rows[k][0] != rows[k - 1][0] for k in range(len(rows))])
        codes, lengths = code_points([r[7] for r in rows])
        i, j = near_pairs(codes, lengths, first)
        m, before, cut = (np.fromiter((r[c] for r in rows), np.int64, len(rows)) for c in (1, 2, 4))
        full = np.fromiter((len(r[5]) for r in rows), np.int64, len(rows))
        own = (np.minimum(full[i], full[j]) == m[i]) & (before[i] + shared_prefix(codes, i, j) < cut[i])
        a, b = np.concatenate([i[own], j[own]]), np.concatenate([j[own], i[own]])
        n = np.fromiter((r[6] for r in rows), np.int64, len(rows))
        place = np.empty(len(rows), np.int64)
        place[sorted(range(len(rows)), key=lambda k: rows[k][5])] = np.arange(len(rows))
        order = np.lexsort((place[b], -n[b], a))
        a, b = a[order], b[order]
        words, begin, near = np.unique(a, return_index=True, return_counts=True)
        top = b[begin]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][5] for k in words], pa.string()), pa.array(near, pa.int64()),
                pa.array(n[top], pa.int64()), pa.array([rows[k][5] for k in top], pa.string()),
            ],
            names=["word", "n_near", "top_n", "top"],
        )

    for batch in batches:
        new = list(zip(*(batch[c].to_pylist() for c in ("key", "m", "before", "after", "cut", "word", "n", "free"))))
        kept += new
        width = max([width, *(len(r[7]) for r in new)])
        if len(kept) >= CHUNK_ROWS or len(kept) * width >= CHUNK_POINTS:
            last = kept[-1][0]  # this key may go on
            whole = len(kept)
            while whole and kept[whole - 1][0] == last:
                whole -= 1
            if whole:
                yield scanned(kept[:whole])
                kept = kept[whole:]
                width = max(len(r[7]) for r in kept)
    if kept:
        yield scanned(kept)


def near_words(vocabulary: DataFrame, min_length: int = MIN_LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, n_near, top_n, top``: number of words at one edit, and the most frequent of them."""
    python_ready(vocabulary.sparkSession)
    parts = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed_words(vocabulary, min_length, group_words)
    rows = rows.withColumn("free", F.expr("substring(word, before + 1, length(word) - before - after)"))
    rows = rows.select("key", "m", "before", "after", "cut", "word", "n", "free")
    found = rows.repartition(parts, "key").sortWithinPartitions("key", "free").mapInArrow(
        _near_in_groups, "word string, n_near long, top_n long, top string"
    )
    best = F.min(F.struct((-F.col("top_n")).alias("less"), F.col("top")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("top_n"), F.col("best.top").alias("top"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of rows (word, form): where the chain of forms ends, by doubling the steps.

    Counts grow along a chain, so it ends; as each step multiplies them, a few rounds do.
    """
    to = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if to.join(on, "root", "left_semi").isEmpty():
            return to
        to = materialise(to.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms")


def group_spellings(
    docs: DataFrame, dominance: int = DOMINANCE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    corrupt_every: int = CORRUPT_EVERY, group_words: int = GROUP_WORDS,
) -> DataFrame:
    """``word, n, form, root, n_near, form_n`` of every word of `docs` (doc_id, text).

    Words are counted over whole texts; a null or empty text has none, a null doc_id is
    hashed like an empty one, repeated rows count again.  Words are near when one code
    point inserted, deleted or replaced turns one into the other.  The form is the most
    frequent near word (ties: the smallest), if it occurs `dominance` times as often, else
    null; the root is where the chain of forms ends.  `min_length` and `dominance` are at least 2.  An empty
    table has no words.  Other columns of `docs` are ignored.
    """
    vocabulary = count_words(docs, corrupt_every, min_length).where(F.col("n") >= min_count)
    vocabulary = materialise(vocabulary, "vocabulary")
    near = near_words(vocabulary, min_length, group_words)
    fits = F.col("top_n") >= dominance * F.col("n")
    rows = vocabulary.join(near, "word", "left").select(
        "word", "n", F.when(fits, F.col("top")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("top_n")).alias("form_n"),
    )
    rows = materialise(rows, "spellings")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n"
    )
