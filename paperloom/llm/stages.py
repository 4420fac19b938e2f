"""The pipeline's stages: each works on all rows it gets and returns the columns it got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm import decontaminate, language_id, mixing, near_dedup, queries, tokens as token_files
from paperloom.llm.common import read
from paperloom.session import counted, materialise

#: A text is rejected below this share of the score that its n-grams would have in the nearest language.  At sf0.01
#: labelled texts of 20 n-grams or more have 0.43 or more, texts of 20 random words 0.14 or less.
MIN_LANGUAGE_SHARE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a known language; profiles are learned from all of `docs`.

    Rows are judged one by one; null texts and texts without letters go.
    """
    prototypes, chances = language_id.profiles(docs)
    return language_id.keep_known(docs, prototypes, MIN_LANGUAGE_SHARE, chances)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with two 64-bit hashes of all columns as one text, so that rows share it where they are equal, and its name.

    Stages decide and join by this key: a doc_id may be null or stand for several texts.
    """
    name = "_key"
    while name in docs.columns:
        name += "_"
    columns = [F.col(f"`{c}`") for c in docs.columns]
    parts = [x for c in columns for x in (c.isNull(), c)]  # a null alone adds nothing
    return docs.withColumn(name, F.concat_ws(":", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(1), *parts)))), name


def _by_key(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text`` of keyed rows with the key for an id."""
    return docs.select(F.col(key).alias("doc_id"), "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8), that with the smallest id.

    Rows are judged one by one, also where they repeat an id or have none; null ids come
    last in a group.  Of rows equal in all columns one stays.  Rows whose text is null or
    has no words are near nothing.  An empty table stays empty.

    Equal rows are combined before texts move, and texts move once, at any size: the
    join takes the partitions that the combining made.
    """
    columns = docs.columns
    docs, key = _keyed(docs)
    judged = near_dedup.near_dedup(_by_key(docs, key)).select(F.col("doc_id").alias(key), F.col("component_id").alias("group")).distinct()
    ids = docs.groupBy(key).agg(F.min("doc_id").alias("id"))
    first = judged.join(ids, key).groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", key)).alias("first"))
    kept = materialise(first.select(f"first.{key}"), "kept")
    return docs.dropDuplicates([key]).join(kept.hint("merge"), key, "left_semi").select(columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage.

    Rows are judged one by one, also where they repeat an id or have none.  Null and
    empty texts stay, as do repeated rows; an empty table stays empty.  No text moves
    while the keys of the rows that go are few enough to be broadcast.
    """
    columns = docs.columns
    docs, key = _keyed(docs)
    leaks = decontaminate.find_leaks(_by_key(docs, key), read(spark, sf_dir, "benchmark"))
    leaked = materialise(leaks.select(F.col("doc_id").alias(key)).distinct(), "leaked")
    return docs.join(counted(leaked), key, "left_anti").select(columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the leaves' budgets, each at most once.

    The order within a leaf is by the whole row, so ids that are null or repeated are as
    good as others; of equal rows some may fit and others not.  A null or empty text has
    no tokens and is never chosen by itself; it stays where it stands before the end of a
    budget.  An empty table stays empty.  Texts move once, at any size.
    """
    columns = docs.columns
    docs, key = _keyed(docs)
    rows = docs.select(
        F.col(key).alias("doc_id"), "lang", "source", queries.domain().alias("domain"), mixing.count_words(F.col("text")).alias("n_tokens")
    )
    rows = materialise(rows, "counted")
    chosen = mixing.mix(rows, queries.MIX_LEVELS, queries.MIX_WEIGHTS, queries.MIX_SHARE, 1, queries.MIX_SEED)
    chosen = chosen.groupBy("doc_id").agg(F.count("*").alias("_n"))
    chosen = materialise(chosen.join(rows.groupBy("doc_id").agg(F.count("*").alias("_of")), "doc_id"), "chosen")
    whole = docs.join(chosen.where("_n = _of").select(F.col("doc_id").alias(key)).hint("merge"), key, "left_semi").select(columns)
    # of equal rows only some fit, at the end of a leaf at most: one of them, repeated
    cut = chosen.where("_n < _of").select(F.col("doc_id").alias(key), F.expr("explode(sequence(1L, _n))").alias(f"{key}copy"))
    some = docs.join(counted(cut.select(key).distinct()), key, "left_semi").dropDuplicates([key]).join(counted(cut), key).select(columns)
    return whole.union(some)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as grammar-compressed shards and read back.

    A null text is empty; rows without an id come first, rows that repeat one are kept
    apart; an empty table gives no rows.
    """
    return token_files.encode_and_read(spark, docs)
