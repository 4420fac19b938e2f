"""Stored records, pages and state files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.functions.bilingual import bi_from_variant

BI = "struct<en:string,zh:string>"

#: Everything but the title, which comes in two shapes.
RECORD_FIELDS = {
    "arxiv_id": "string",
    "topic": "string",
    "topic_label": "string",
    "authors": "array<string>",
    "affiliations": "array<string>",
    "categories": "array<string>",
    "published": "string",
    "updated": "string",
    "abstract": "string",
    "arxiv_url": "string",
    "pdf_url": "string",
    "comment": "string",
    "relevance": BI,
    "figures": f"array<struct<label:string,caption:{BI},url:string,order:int,stage:string,reference_text:string>>",
    "figure": f"struct<label:string,caption:{BI},url:string,reference_text:string>",
    "brief_summary": BI,
    "core_summary": f"struct<problem:{BI},solution:{BI},methodology:{BI},experiments:{BI},conclusion:{BI}>",
    "tasks": f"array<struct<question:{BI},reason:{BI}>>",
    "findings": f"array<struct<question:{BI},reason:{BI},answer:{BI},confidence:double>>",
    "score": "double",
    "score_dimensions": "array<struct<name:string,weight:double,value:double>>",
    "markdown": "string",
    "model": "string",
    "generated_at": "string",
}

STAR_MAP = "struct<stars:map<string,struct<topic:string,note:string,starred_at:string>>>"
HIDDEN_MAP = "struct<hidden:map<string,struct<hidden_at:string>>>"


def records_from_variant(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Typed records from variant documents of any age; the title may be text or a pair."""
    doc = F.col(column)
    cols = [F.try_variant_get(doc, f"$.{name}", kind).alias(name) for name, kind in RECORD_FIELDS.items()]
    return docs.select(*cols[:3], bi_from_variant(doc, "$.title").alias("title"), *cols[3:])


def records_from_json(docs: DataFrame, column: str = "json") -> DataFrame:
    parsed = docs.withColumn("doc", F.try_parse_json(F.col(column)))
    return records_from_variant(parsed.where(F.col("doc").isNotNull()))


#: Why a document is refused.
NO_JSON, NO_OBJECT, NO_ID = "no JSON", "no object", "no arxiv_id"


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    texts = spark.read.text(path, wholetext=not lines)
    return texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))


def read_analyses(spark: SparkSession, path: str, strict: bool = False, lines: bool = False) -> DataFrame:
    """One JSON document per file, or with `lines` per line as `sinks.write_json_records` leaves them.

    Unreadable documents are left out, or fail when `strict`.
    """
    texts = _documents(spark, path, lines)
    if strict:
        return records_from_variant(texts.select(F.parse_json("json").alias("doc")))
    return records_from_json(texts)


def rejected_analyses(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents that give no usable record as ``file, reason, json``."""
    doc = F.try_parse_json("json")
    reason = (
        F.when(doc.isNull(), NO_JSON)
        .when(~F.schema_of_variant(doc).startswith("OBJECT"), NO_OBJECT)
        .when(F.coalesce(F.try_variant_get(doc, "$.arxiv_id", "string"), F.lit("")) == "", NO_ID)
    )
    return _documents(spark, path, lines).withColumn("reason", reason).where("reason is not null").select("file", "reason", "json")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold no JSON document, for a look by hand."""
    return rejected_analyses(spark, path).where(F.col("reason") == NO_JSON).select("file")


def read_pages(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Pages as ``(page_id, url, html)``; with ``text`` one file per page, named by its path."""
    if file_format == "text":
        return spark.read.text(path, wholetext=True).select(
            F.input_file_name().alias("page_id"), F.input_file_name().alias("url"), F.col("value").alias("html")
        )
    return spark.read.format(file_format).load(path).select("page_id", "url", "html")


def explode_stars(docs: DataFrame, column: str = "json") -> DataFrame:
    """``{"stars": {id: {...}}}`` documents to one row per star."""
    parsed = docs.select(F.explode(F.from_json(F.col(column), STAR_MAP)["stars"]).alias("arxiv_id", "s"))
    return parsed.select("arxiv_id", "s.*")


def explode_hidden(docs: DataFrame, column: str = "json") -> DataFrame:
    parsed = docs.select(F.explode(F.from_json(F.col(column), HIDDEN_MAP)["hidden"]).alias("arxiv_id", "s"))
    return parsed.select("arxiv_id", "s.*")
