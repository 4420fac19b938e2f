"""Atom feeds to the paper schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.functions import ids
from paperloom.functions.dates import instant, tolerant_timestamp
from paperloom.functions.text import strip

# Layout of a feed entry.
ROW_TAG = "entry"
ENTRY_SCHEMA = (
    "id string, title string, summary string, published string, updated string, "
    "author array<struct<name:string,`arxiv:affiliation`:string>>, "
    "category array<struct<_term:string>>, `arxiv:comment` string"
)
UNKNOWN_AUTHORS = ("Unknown",)


#: Why an entry is refused.
BROKEN, UNFINISHED, WITHOUT_ID = "broken entry", "unfinished entry", "no id"


def checked_entries(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of the files as ``file, xml, e, reason``; `reason` is null where it can be used.

    Files are cut where entries begin, so large ones are read by many tasks and an entry
    that is no XML costs only itself.  Text before the first entry of a file is left out.
    Entry tags in comments or CDATA sections count as entries.
    """
    pieces = spark.read.option("lineSep", f"<{ROW_TAG}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value")
    )
    # a tag may carry attributes; what else stands before the first entry has the feed's own tags
    opens = F.col("value").rlike(r"\A[\s/>]") & ~F.col("value").rlike(r"\A\s*<(\?xml|feed|!)")
    end = F.instr("value", f"</{ROW_TAG}>")
    body = F.concat(F.lit(f"<{ROW_TAG}"), F.col("value").substr(F.lit(1), end + len(f"</{ROW_TAG}>") - 1))
    rows = pieces.where(opens).select("file", F.when(end > 0, body).alias("xml"), F.col("value"))
    schema = f"{ENTRY_SCHEMA}, _broken string"
    parsed = rows.withColumn("e", F.from_xml("xml", schema, {"columnNameOfCorruptRecord": "_broken"}))
    reason = (
        F.when(F.col("xml").isNull(), UNFINISHED)
        .when(F.col("e").isNull() | F.col("e._broken").isNotNull(), BROKEN)
        .when(F.coalesce("e.id", F.lit("")) == "", WITHOUT_ID)
    )
    return parsed.select("file", F.coalesce("xml", F.concat(F.lit(f"<{ROW_TAG}"), "value")).alias("xml"), "e", reason.alias("reason"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Usable entries, one row each."""
    return checked_entries(spark, path).where("reason is null").select("e.*").drop("_broken")


def rejected_entries(spark: SparkSession, path: str) -> DataFrame:
    """Refused entries as ``file, reason, xml``."""
    return checked_entries(spark, path).where("reason is not null").select("file", "reason", "xml")


def parse_entries(texts: DataFrame, column: str = "xml") -> DataFrame:
    """Entries held as XML text in a column."""
    return texts.select(F.from_xml(F.col(column), ENTRY_SCHEMA).alias("e")).select("e.*")


def normalise(entries: DataFrame, run_ts: datetime) -> DataFrame:
    """Feed entries as papers.

    Entries without an id go.  An unreadable publication time counts as now, a
    missing update time as the publication time, no authors as unknown.  Affiliations
    are distinct in first-seen order.
    """
    names = F.filter(F.transform("author", lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    none = F.array().cast("array<string>")
    places = F.array_distinct(
        F.filter(
            F.transform("author", lambda a: strip(a["arxiv:affiliation"])), lambda p: F.coalesce(p, F.lit("")) != ""
        )
    )
    terms = F.filter(F.transform("category", lambda c: c["_term"]), lambda t: F.coalesce(t, F.lit("")) != "")
    paper_id = ids.feed_id(F.col("id"))
    published = tolerant_timestamp(F.col("published"), instant(run_ts))
    return (
        entries.where(F.coalesce("id", F.lit("")) != "")
        .select(
            paper_id.alias("arxiv_id"),
            strip(F.coalesce("title", F.lit(""))).alias("title"),
            strip(F.coalesce("summary", F.lit(""))).alias("abstract"),
            F.when(F.size(names) > 0, names).otherwise(F.array(*[F.lit(a) for a in UNKNOWN_AUTHORS])).alias("authors"),
            F.coalesce(places, none).alias("affiliations"),
            F.coalesce(terms, none).alias("categories"),
            published.alias("published"),
            tolerant_timestamp(F.col("updated"), published).alias("updated"),
            ids.abs_url(paper_id).alias("arxiv_url"),
            ids.pdf_url(paper_id).alias("pdf_url"),
            strip(F.col("`arxiv:comment`")).alias("comment"),
        )
    )


def read_feed(spark: SparkSession, path: str, run_ts: datetime) -> DataFrame:
    return normalise(read_entries(spark, path), run_ts)
