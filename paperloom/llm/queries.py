"""The dealt operators as registered queries over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm import (
    chat,
    decontaminate,
    hard_negatives,
    language_id,
    mixing,
    near_dedup,
    pii,
    quality_rules,
    sharding,
    spelling,
    tokens,
    toxicity,
    url_rules,
)
from paperloom.llm.common import read
from paperloom.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# 1: quality rules --------------------------------------------------------------------------


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(columns)


# 2: language -------------------------------------------------------------------------------


@query("op2_hyperdimensional_language")
def op2_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


# 3: personal data --------------------------------------------------------------------------


@query("op3_boosted_pii")
def op3_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


# 4: mixing ---------------------------------------------------------------------------------

MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (9, 10), 3, 11


def domain(source: str = "source"):
    """The test documents name no domain; their source's number stands for one."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, "[0-9]+", 0).try_cast("int") % 4, F.lit(3)).cast("string"))


_D = "'d' || CAST(coalesce(TRY_CAST(regexp_extract(source, '[0-9]+') AS INT) % 4, 3) AS VARCHAR)"


def _case(column: str) -> str:
    cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in MIX_WEIGHTS[column.split(".")[-1]].items())
    return f"CASE {column} {cases} ELSE 1 END"


def _level(name: str, here: list[str], parent: list[str], above: str, budget: str) -> str:
    same = " AND ".join(f"n.{p} IS NOT DISTINCT FROM u.{p}" for p in parent) or "true"
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    level = here[-1]
    return f"""
{name}_n AS (SELECT n.*, {budget}::HUGEINT AS budget, {_case('n.' + level)} AS weight
  FROM (SELECT {', '.join(here)}, sum(capacity)::HUGEINT AS capacity FROM leaves GROUP BY ALL) n JOIN {above} u ON {same}),
{name}_s AS (SELECT *,
    coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM {name}_n WINDOW w AS ({part} ORDER BY capacity::DOUBLE / weight, {level} NULLS FIRST)),
{name}_f AS (SELECT *, capacity * weights <= weight * (budget - gone) AS filled FROM {name}_s),
{name}_o AS (SELECT *, min(CASE WHEN NOT filled THEN gone END) OVER w AS g, max(CASE WHEN NOT filled THEN weights END) OVER w AS v
  FROM {name}_f WINDOW w AS ({part or 'PARTITION BY 1'})),
{name} AS (SELECT {', '.join(here)}, CASE WHEN filled THEN capacity ELSE (weight * (budget - g)) // v END AS share FROM {name}_o)"""


OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_D} AS domain, lang, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
supply AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply FROM d GROUP BY ALL),
leaves AS (SELECT *, supply * {MIX_EPOCHS} AS capacity FROM supply WHERE supply > 0),
root AS (SELECT least((SELECT sum(supply) FROM supply) * {MIX_SHARE[0]} // {MIX_SHARE[1]}, sum(capacity)) AS share FROM leaves),
{_level('a', ['domain'], [], 'root', 'u.share')},
{_level('b', ['domain', 'lang'], ['domain'], 'a', 'u.share')},
{_level('c', ['domain', 'lang', 'source'], ['domain', 'lang'], 'b', 'u.share')},
dealt AS (SELECT d.*, l.supply, c.share // l.supply AS whole, c.share % l.supply AS rest
  FROM d JOIN leaves l ON d.domain = l.domain AND d.lang IS NOT DISTINCT FROM l.lang AND d.source IS NOT DISTINCT FROM l.source
  JOIN c ON c.domain = l.domain AND c.lang IS NOT DISTINCT FROM l.lang AND c.source IS NOT DISTINCT FROM l.source),
epochs AS (SELECT doc_id, unnest(range(whole::BIGINT))::BIGINT AS epoch, n_tokens, domain, lang, source FROM dealt),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{MIX_SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), n_tokens ROWS UNBOUNDED PRECEDING) AS so_far
  FROM dealt WHERE rest > 0)
SELECT doc_id, epoch, n_tokens, domain, lang, source FROM epochs
UNION ALL
SELECT doc_id, whole::BIGINT, n_tokens, domain, lang, source FROM summed WHERE so_far <= rest"""


@query("op4_hierarchical_mix", OP4_SQL)
def op4_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", "source", domain().alias("domain"), mixing.count_words(F.col("text")).alias("n_tokens"))
    return mixing.mix(rows, MIX_LEVELS, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


# 5: token files ----------------------------------------------------------------------------


@query("op5_repair_tokens")
def op5_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_and_read(spark, read(spark, sf_dir, "documents"))


# 6: decontamination ------------------------------------------------------------------------


@query("op6_spaced_seeds")
def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# 7: url rules ------------------------------------------------------------------------------

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

OP7_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM u),
r(action, rhost, rpath) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
fit AS (SELECT n, max(struct_pack(l := length(rhost || rpath), rule := rhost || rpath, action := action)) AS best
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM p LEFT JOIN fit USING (n)"""


@query("op7_url_range_join", OP7_SQL)
def op7_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_rules.judge_urls(read(spark, sf_dir, "pages"), rules)


# 8: chat formatting ------------------------------------------------------------------------

_ESCAPED = f"length({{0}}) + len(regexp_extract_all({{0}}, '{chat.CONTROL_PATTERN}'))"
_TURN = "coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10)"
_ORDER = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"

OP8_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, {_ESCAPED.format("coalesce(text, '')")} AS n_text, {_ESCAPED.format("coalesce(role, '')")} AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg({_TURN}, '' {_ORDER})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'user' THEN n_text + 15 WHEN role = 'assistant' THEN n_text + 4 ELSE n_text + n_role + 17 END)::BIGINT
    AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op8_template_chat", OP8_SQL)
def op8_template_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_conversations(materialise(chat.format_conversations(rows.union(more)), "formatted"))


# 9: near duplicates ------------------------------------------------------------------------


@query("op9_near_dedup")
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), k=4, percent=80)


# 10: sharding ------------------------------------------------------------------------------


@query("op10_hilbert_shards")
def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"), crc.alias("text_crc32"), "lang", "source"
    )  # texts stay where they are
    sharded = sharding.hilbert_shards(docs, ["size", "lang", "source"], n_shards=40, law="rows")
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# 11: spelling variants ---------------------------------------------------------------------

# crc32 by its polynomial: eight steps a byte make the table, one look-up a byte the checksum
_CRC_STEP = "lambda c, bit: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"

OP11_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], {_CRC_STEP}) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2),
    lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, tab),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {spelling.CORRUPT_EVERY} = 0
    THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
shorter AS (SELECT DISTINCT l.word AS a, l.n AS an, v.word AS b, v.n AS bn FROM less l JOIN v ON l.d = v.word),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter),
best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(w := other, n := other_n), struct_pack(k := -other_n, w := other)) AS top
  FROM near GROUP BY word),
rows AS (SELECT v.word, v.n, CASE WHEN top.n >= {spelling.DOMINANCE} * v.n THEN top.w END AS form, coalesce(n_near, 0) AS n_near,
  CASE WHEN top.n >= {spelling.DOMINANCE} * v.n THEN top.n END AS form_n FROM v LEFT JOIN best USING (word)),
c(word, here, k) AS (SELECT word, form, 1 FROM rows WHERE form IS NOT NULL
  UNION ALL SELECT c.word, r.form, k + 1 FROM c JOIN rows r ON r.word = c.here WHERE r.form IS NOT NULL),
chain AS (SELECT word, arg_max(here, k) AS root FROM c GROUP BY word)
SELECT word, n, form, coalesce(root, word) AS root, n_near, form_n FROM rows LEFT JOIN chain USING (word)"""


@query("op11_spelling_variants", OP11_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(read(spark, sf_dir, "documents"))


# 12: hard negatives ------------------------------------------------------------------------

OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    indexed = hard_negatives.index(hard_negatives.whole_vectors(rows, F.col("embedding"), label))
    return hard_negatives.hard_negatives(indexed, F.col("vec_id") % 100 == 0)


# 13: toxicity ------------------------------------------------------------------------------


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    worst = F.expr("array_max(transform(offending, s -> struct(s.score, -s.start, s.end)))")  # the first of equal ones
    return found.withColumn("_w", worst).select(
        "doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"),
        (-F.col("_w.col2")).alias("worst_start"), F.col("_w.end").alias("worst_end"),
    )
