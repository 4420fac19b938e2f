"""URL rules by a sort-merge range join: DataFrame functions only, no Python in the workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends the host part of a key, so that `net` is no prefix of `network`.
_END = "\u0001"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def host_key(labels: Column) -> Column:
    """Key of a host given as reversed labels."""
    return F.concat(F.array_join(labels, "."), F.lit(_END))


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _stacks(rules: DataFrame) -> DataFrame:
    """``key, stack``: each rule with the rules that enclose it, which are the prefixes of its key.

    Of rules with the same host and path the block stands.  The stack is as long as rules nest.
    """
    keyed = rules.where("host is not null and path is not null").select(
        F.concat(host_key(_reversed(F.translate("host", _UPPER, _LOWER))), "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length(F.concat("host", "path")).alias("n"),
        "action",
    )
    keyed = keyed.groupBy("key").agg(F.max(F.struct("action", "rule", "labels", "n")).alias("r")).select("key", "r.*")
    cut = keyed.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("cut"))
    outer = keyed.select(
        F.col("key").alias("prefix"), F.struct("n", "labels", "rule", "action", F.col("key").alias("prefix")).alias("entry")
    )
    return (
        cut.select("key", F.expr("left(key, cut)").alias("prefix"))
        .join(outer, "prefix")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("entry"), asc=False).alias("stack"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """`pages` (page_id, url) with ``host, path, rule, verdict``, one row per row.

    `rules` has ``host, path, action``.  A rule fits its host and all subdomains where the
    url's path starts with the rule's; the rule with the longest ``host + path`` decides
    (of equally long ones that with more host labels); without one `default` does.
    Null or malformed urls have an empty host and path.

    A rule's key is its reversed host followed by its path, so the keys that it covers
    follow it in sort order.  Urls bring one key per parent domain.  Rules and keys are
    range-partitioned and swept in order; the stack of rules that are open at the last
    rule before a key holds every rule that can cover it.  The stack at the start of a
    partition is the last one of the partitions before, of which there is one row each.
    """
    parsed = pages.select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    parsed = materialise(parsed, "urls")
    labels = _reversed(F.col("host"))
    keys = (
        parsed.select("host", "path").distinct()
        .withColumn("labels", labels)
        .withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("labels"))))
        .select(F.concat(host_key(F.slice("labels", F.lit(1), F.col("depth"))), "path").alias("key"), "host", "path")
    )
    stacks = _stacks(rules)
    shape = stacks.schema["stack"].dataType
    points = stacks.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack").union(
        keys.select("key", F.lit(1), "host", "path", F.lit(None).cast(shape))
    )
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "kind", "host"]
    points = points.repartitionByRange(parts, *order, F.xxhash64("host", "path")).sortWithinPartitions(*order)
    points = materialise(points.withColumn("part", F.spark_partition_id()), "sweep")

    ends = points.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("end"))
    carried = ends.select(
        F.col("part").alias("of"),
        F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
    )
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        points.withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("kind = 1")
        .join(F.broadcast(carried), F.col("part") == F.col("of"))  # one row per partition
        .withColumn("open", F.coalesce("open", "carried"))
        .withColumn("best", F.get(F.filter("open", lambda r: F.startswith(F.col("key"), r["prefix"])), F.lit(0)))
    )
    best = swept.groupBy("host", "path").agg(F.max("best").alias("best"))
    best = best.select(
        F.col("host").alias("h"), F.col("path").alias("p"), F.col("best.rule").alias("rule"), F.col("best.action").alias("action")
    )
    return parsed.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p"))).select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )
