"""Records, index, read side, digest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.checks.inputs import CONF, RUN_TS, papers, view
from paperloom.checks.q_text import BRIEF, BRIEF_TEXT, SENTENCES
from paperloom.checks.registry import query
from paperloom.functions import bilingual
from paperloom.operators import analyses as A, digest as D, prompts as P, selection as S, state, views as V
from paperloom.plans import home as H, triage
from paperloom.sources import records

WEEK_TS = datetime(2024, 2, 28, 6, 0, 0)


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Stored records in their read shape (the fields the read side needs)."""
    base = view(spark, sf, "analyses")
    return base.select(
        "arxiv_id",
        "topic",
        "topic_label",
        bilingual.bi(F.col("title_en"), F.col("title_zh")).alias("title"),
        F.split("title_en", " ").alias("authors"),
        F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).otherwise(F.array("source")).alias("affiliations"),
        F.array("lang").alias("categories"),
        "score",
        "published",
        "generated_at",
        "abstract",
        F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id").alias("arxiv_url"),
        F.when(F.col("doc_id") % 4 == 0, bilingual.bi(F.lit(""), F.lit(""))).otherwise(
            bilingual.bi(F.col("source"), F.col("lang"))
        ).alias("relevance"),
        bilingual.bi(F.col("abstract")).alias("brief_summary"),
        F.when(
            F.col("doc_id") % 3 != 0,
            F.struct(
                *[
                    bilingual.bi(
                        F.when((F.col("doc_id") + i) % 2 == 0, F.col("source")).otherwise(" "), F.lit("")
                    ).alias(a)
                    for i, a in enumerate(P.ASPECTS)
                ]
            ),
        ).alias("core_summary"),
        F.when(
            F.col("doc_id") % 5 != 0,
            F.array(
                F.struct(
                    bilingual.bi(F.lit("why?")).alias("question"),
                    bilingual.bi(F.lit("r")).alias("reason"),
                    bilingual.bi(F.col("lang")).alias("answer"),
                    F.lit(0.75).alias("confidence"),
                )
            ),
        ).otherwise(F.array().cast(records.RECORD_FIELDS["findings"])).alias("findings"),
        F.array().cast(records.RECORD_FIELDS["figures"]).alias("figures"),
        F.when(
            F.col("doc_id") % 2 == 0,
            F.struct(
                F.lit("Figure 1").alias("label"),
                bilingual.bi(F.col("source")).alias("caption"),
                F.lit("u").alias("url"),
                F.col("lang").alias("reference_text"),
            ),
        ).alias("figure"),
        F.when(F.col("doc_id") % 2 == 0, F.col("abstract")).otherwise("").alias("markdown"),
    )


def index(spark: SparkSession, sf: str) -> DataFrame:
    return A.to_index(A.latest(analyses(spark, sf)))


def states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = view(spark, sf, "state_events")
    return state.star_state(events), state.hide_state(events)


# stars and hides as set-based SQL over the whole event list of a key
STATES = """
sev AS (SELECT *, sum(CASE WHEN op IN ('unstar', 'star_replace') THEN 1 ELSE 0 END)
   OVER (PARTITION BY arxiv_id ORDER BY ts, event_id) AS life FROM {state_events} WHERE op IN ('star', 'star_replace', 'unstar')),
slast AS (SELECT arxiv_id, max(life) AS life FROM sev GROUP BY arxiv_id),
stars AS (SELECT s.arxiv_id, min(ts) AS starred_at, arg_max(topic, (ts, event_id)) FILTER (WHERE topic IS NOT NULL) AS topic,
  arg_max(note, (ts, event_id)) FILTER (WHERE note IS NOT NULL AND op = 'star') AS note
  FROM sev s JOIN slast l ON s.arxiv_id = l.arxiv_id AND s.life = l.life WHERE op <> 'unstar' GROUP BY s.arxiv_id),
hidden AS (SELECT arxiv_id, max(ts) AS hidden_at FROM {state_events} WHERE op IN ('hide', 'unhide') GROUP BY arxiv_id
  HAVING arg_max(op, (ts, event_id)) = 'hide')"""

INDEX = """
ix AS (SELECT doc_id, arxiv_id, topic, topic_label, title_en, coalesce(nullif(title_zh, ''), title_en) AS title_zh, score, published, generated_at
  FROM {latest})"""


# --- records ----------------------------------------------------------------------------


@query("latest_analyses", "SELECT arxiv_id, topic, score, generated_at FROM {latest}")
def latest_analyses(spark: SparkSession, sf: str) -> DataFrame:
    return A.latest(analyses(spark, sf)).select("arxiv_id", "topic", "score", "generated_at")


@query(
    "upsert_analyses",
    """
SELECT arxiv_id, score, generated_at FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY ver DESC) AS rn FROM {analyses}) x
WHERE rn = 1""",
)
def upsert_analyses(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "analyses").select("arxiv_id", "score", "generated_at", "ver")
    stored, new = rows.where("ver = 0").drop("ver"), rows.where("ver = 1").drop("ver")
    return A.upsert_latest(stored, new)


@query(
    "slim_index",
    f"""
WITH {INDEX} SELECT arxiv_id, topic, topic_label, title_en, title_zh, array_to_string(string_split(title_en, ' ')[1:6], '|') AS authors,
  score, published, generated_at FROM ix""",
)
def slim_index(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).select(
        "arxiv_id",
        "topic",
        "topic_label",
        F.col("title.en").alias("title_en"),
        F.col("title.zh").alias("title_zh"),
        F.array_join("authors", "|").alias("authors"),
        "score",
        "published",
        "generated_at",
    )


@query(
    "recent_analyses",
    f"WITH {INDEX} SELECT arxiv_id, generated_at FROM ix WHERE topic = 'mixed' ORDER BY generated_at DESC, arxiv_id DESC LIMIT 50",
)
def recent_analyses(spark: SparkSession, sf: str) -> DataFrame:
    return A.recent_analyses(index(spark, sf), 50, "mixed").select("arxiv_id", "generated_at")


@query(
    "mixed_title",
    """
SELECT arxiv_id, CASE doc_id % 3 WHEN 0 THEN title WHEN 1 THEN title ELSE '' END AS en,
  CASE doc_id % 3 WHEN 0 THEN title WHEN 1 THEN 'zh ' || source ELSE '' END AS zh FROM {papers}""",
)
def mixed_title(spark: SparkSession, sf: str) -> DataFrame:
    # old records hold the title as text, newer ones as a pair, some have none
    pair = F.to_json(F.struct("arxiv_id", F.struct(F.col("title").alias("en"), F.concat(F.lit("zh "), "source").alias("zh")).alias("title")))
    kind = F.col("doc_id") % 3
    docs = view(spark, sf, "papers").select(
        F.when(kind == 0, F.to_json(F.struct("arxiv_id", "title"))).when(kind == 1, pair).otherwise(
            F.to_json(F.struct("arxiv_id"))
        ).alias("json")
    )
    rows = records.records_from_json(docs)
    return rows.select(
        "arxiv_id",
        bilingual.pick(F.col("title"), "en").alias("en"),
        bilingual.pick(F.col("title"), "zh").alias("zh"),
    )


SELECTED_RECORD = f"""
r AS (SELECT s.*, b.brief, b.sents FROM {{selected}} s JOIN (SELECT arxiv_id, {BRIEF_TEXT} AS brief, {SENTENCES.replace('{t}', 'abstract')} AS sents
  FROM {BRIEF} x) b ON b.arxiv_id = s.arxiv_id)"""

_ANSWER = "coalesce(nullif(array_to_string(CASE WHEN len(h{i}) > 0 THEN h{i}[1:2] ELSE sents[1:1] END, ' '), ''), 'No sufficient information')"
_SURE = "least(1.0::DOUBLE, (CASE WHEN len(h{i}) > 0 THEN least(2, len(h{i})) ELSE least(1, len(sents)) END)::DOUBLE * 0.3::DOUBLE + 0.4::DOUBLE)"


def _bi(en: str, zh: str | None = None) -> str:
    return f"json_object('en', {en}, 'zh', {zh or en})"


Q1, Q2 = "What is the main contribution of this paper?", "How do the experiments validate the method''s effectiveness?"


@query(
    "payload_json",
    f"""
WITH {SELECTED_RECORD}, h AS (SELECT *, list_filter(sents, lambda x: contains(lower(x), lower('{Q1}'))) AS h0,
  list_filter(sents, lambda x: contains(lower(x), lower('{Q2}'))) AS h1 FROM r),
t AS (SELECT *, CASE WHEN interest_prompt = '' THEN '(Online LLM not enabled.)' ELSE
 '(Online LLM not enabled — relevance note unavailable. See the 5-aspect core below to judge how this paper relates to your work.)' END AS rel FROM h)
SELECT arxiv_id, json_object('arxiv_id', arxiv_id, 'topic', topic, 'topic_label', topic_label, 'title', {_bi('title')},
  'authors', string_split(title, ' '), 'affiliations', CASE WHEN doc_id % 2 = 0 THEN [source, lang] ELSE [source] END, 'categories', [lang],
  'published', published || 'T00:00:00', 'updated', published || 'T00:00:00', 'abstract', abstract,
  'arxiv_url', 'https://arxiv.org/abs/' || arxiv_id, 'pdf_url', 'https://arxiv.org/pdf/' || arxiv_id || '.pdf', 'comment', NULL,
  'relevance', {_bi('rel')}, 'figures', [], 'figure', NULL, 'brief_summary', {_bi('brief')}, 'core_summary', NULL,
  'tasks', [json_object('question', {_bi(f"'{Q1}'")}, 'reason', {_bi("'Understand the core innovation'")}),
            json_object('question', {_bi(f"'{Q2}'")}, 'reason', {_bi("'Assess the method''s reliability'")})],
  'findings', [json_object('question', {_bi(f"'{Q1}'")}, 'reason', {_bi("'Understand the core innovation'")}, 'answer', {_bi(_ANSWER.format(i=0))},
                 'confidence', {_SURE.format(i=0)}),
               json_object('question', {_bi(f"'{Q2}'")}, 'reason', {_bi("'Assess the method''s reliability'")}, 'answer', {_bi(_ANSWER.format(i=1))},
                 'confidence', {_SURE.format(i=1)})],
  'score', score, 'score_dimensions', [json_object('name', 'topic_alignment', 'weight', 0.35::DOUBLE, 'value', d0),
    json_object('name', 'methodology_fit', 'weight', 0.25::DOUBLE, 'value', d1), json_object('name', 'novelty', 'weight', 0.2::DOUBLE, 'value', d2),
    json_object('name', 'experiment_coverage', 'weight', 0.2::DOUBLE, 'value', d3)],
  'markdown', '', 'model', 'm1', 'generated_at', '2024-02-20T06:00:00Z')::VARCHAR AS json FROM t""",
)
def payload_json(spark: SparkSession, sf: str) -> DataFrame:
    chosen = triage.select(papers(spark, sf), CONF, RUN_TS)
    return A.payload_json(A.to_payload(triage.analyse(chosen, CONF), "m1", RUN_TS))


@query(
    "availability",
    """
WITH a AS (SELECT arxiv_id, doc_id, doc_id % 4 <> 0 AS has_relevance, abstract <> '' AS has_brief, doc_id % 5 <> 0 AS has_qa,
  CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 2 = 0 THEN ['problem', 'methodology', 'conclusion'] ELSE ['solution', 'experiments'] END AS asp
  FROM {latest})
SELECT arxiv_id, array_to_string(asp, ',') AS aspects, array_to_string(list_concat(CASE WHEN has_relevance THEN ['relevance'] ELSE [] END,
  CASE WHEN has_brief THEN ['brief'] ELSE [] END, CASE WHEN len(asp) > 0 THEN ['core'] ELSE [] END,
  list_transform(asp, lambda x: 'core-' || x), CASE WHEN has_qa THEN ['qa'] ELSE [] END), ',') AS sections FROM a""",
)
def availability(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.availability(A.latest(analyses(spark, sf)), "zh")
    return rows.select(
        "arxiv_id", F.array_join("aspects", ",").alias("aspects"), F.array_join("sections", ",").alias("sections")
    )


@query(
    "legacy_figures",
    "SELECT arxiv_id, 'methodology' AS stage, source AS caption, lang AS reference_text FROM {latest} WHERE doc_id % 2 = 0",
)
def legacy_figures(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.latest(analyses(spark, sf)).select(
        "arxiv_id", F.explode(A.figures_or_legacy(F.col("figures"), F.col("figure"))).alias("f")
    )
    return rows.select("arxiv_id", "f.stage", F.col("f.caption.en").alias("caption"), "f.reference_text")


# --- reading list -----------------------------------------------------------------------

TAB_SQL = {
    "all": "arxiv_id NOT IN (SELECT arxiv_id FROM hidden)",
    "weekly": "arxiv_id NOT IN (SELECT arxiv_id FROM hidden) AND generated_at >= '2024-02-21T06:00:00Z'",
    "starred": "arxiv_id NOT IN (SELECT arxiv_id FROM hidden) AND arxiv_id IN (SELECT arxiv_id FROM stars)",
    "hidden": "arxiv_id IN (SELECT arxiv_id FROM hidden)",
}


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return V.marked(index(spark, sf), *states(spark, sf), WEEK_TS)


@query(
    "tab_rows",
    f"WITH {STATES}, {INDEX} "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS tab, arxiv_id, arxiv_id IN (SELECT arxiv_id FROM stars) AS starred FROM ix WHERE {w}"
        for t, w in TAB_SQL.items()
    ),
)
def tab_rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.each_tab(_marked(spark, sf)).select("tab", "arxiv_id", "starred")


@query(
    "tab_counts",
    f"""
WITH {STATES}, {INDEX} SELECT (SELECT count(*) FROM ix WHERE {TAB_SQL['all']}) AS visible,
  (SELECT count(*) FROM ix WHERE {TAB_SQL['weekly']}) AS weekly, (SELECT count(*) FROM stars) AS starred,
  (SELECT count(*) FROM hidden) AS hidden""",
)
def tab_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.tab_counts(index(spark, sf), *states(spark, sf), WEEK_TS)


@query(
    "topic_facets",
    f"WITH {STATES}, {INDEX} "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS tab, topic, arg_max(coalesce(nullif(topic_label, ''), topic), (generated_at, arxiv_id)) AS label, "
        f"count(*) AS n FROM ix WHERE {w} GROUP BY topic"
        for t, w in TAB_SQL.items()
    ),
)
def topic_facets(spark: SparkSession, sf: str) -> DataFrame:
    return V.facets(V.each_tab(_marked(spark, sf)), "tab")


@query(
    "date_range",
    f"""
WITH {STATES}, {INDEX}, v AS (SELECT arxiv_id FROM stars WHERE arxiv_id NOT IN (SELECT arxiv_id FROM hidden)),
d AS (SELECT min(published) AS "start", max(published) AS "end", count(*) AS n FROM ix WHERE arxiv_id IN (SELECT arxiv_id FROM v)
  UNION ALL SELECT min(published), max(published), count(*) FROM ix)
SELECT *, CASE WHEN "start" = "end" THEN '（' || "start" || '）' ELSE '（' || "start" || ' — ' || "end" || '）' END AS label FROM d""",
)
def date_range(spark: SparkSession, sf: str) -> DataFrame:
    ix, (stars, hidden) = index(spark, sf), states(spark, sf)
    return V.date_range(ix, V.starred_visible_ids(stars, hidden)).unionByName(V.date_range(ix))


@query(
    "home_page",
    f"WITH {STATES}, {INDEX} SELECT arxiv_id, score, arxiv_id IN (SELECT arxiv_id FROM stars) AS starred FROM ix "
    f"WHERE {TAB_SQL['weekly']} AND topic = 'prose_en'",
)
def home_page(spark: SparkSession, sf: str) -> DataFrame:
    page = H.home(index(spark, sf), *states(spark, sf), WEEK_TS, "weekly", "prose_en")
    return page.rows.select("arxiv_id", "score", "starred")


# --- digest -----------------------------------------------------------------------------


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    key = F.split("arxiv_id", r"\.")
    return A.latest(analyses(spark, sf)).withColumn(
        "pos", (key[0].cast("bigint") - 1000) * 100000 + key[1].cast("bigint")
    )


@query(
    "digest_stats",
    "SELECT count(*) AS papers, count(DISTINCT topic_label) AS topics, round(avg(score), 6) AS avg_score FROM {latest}",
)
def digest_stats(spark: SparkSession, sf: str) -> DataFrame:
    return D.digest_stats(A.latest(analyses(spark, sf))).withColumn("avg_score", F.round("avg_score", 6))


@query("digest_groups", "SELECT topic_label, min(doc_id) AS first_pos, count(*) AS n FROM {latest} GROUP BY topic_label")
def digest_groups(spark: SparkSession, sf: str) -> DataFrame:
    return D.digest_groups(_ordered(spark, sf))


ESC = "replace(replace(replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
WSX = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _paragraphs(e: str, limit: int) -> str:
    plain = f"trim({e}, {WSX})"
    cut = f"CASE WHEN len({plain}) > {limit} THEN rtrim(substring({plain}, 1, {limit}), {WSX}) || '…' ELSE {plain} END"
    esc = ESC.replace("{e}", "regexp_replace(p, '\\s*\\n\\s*', ' ', 'g')")
    return (
        f"array_to_string(list_transform(list_filter(list_transform(string_split({cut}, chr(10) || chr(10)), "
        f"lambda p: trim(p, {WSX})), lambda p: p <> ''), lambda p: {esc}), '<br/><br/>')"
    )


CARDS = f"""
cards AS (SELECT doc_id AS pos, arxiv_id, topic_label, 'https://papers.example/papers/' || arxiv_id AS url,
  {ESC.replace('{e}', "coalesce(nullif(title_en, ''), arxiv_id)")} AS title,
  {ESC.replace('{e}', '''array_to_string(string_split(title_en, ' ')[1:3], ', ') || CASE WHEN len(string_split(title_en, ' ')) > 3 THEN ' et al.' ELSE '' END
    || ' · ' || source || CASE WHEN doc_id % 2 = 0 THEN ' +1' ELSE '' END''')} AS byline,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS note, {_paragraphs('abstract', 300)} AS brief,
  score::INTEGER || '.0' AS score FROM {{latest}})"""


@query("digest_cards", f"WITH {CARDS} SELECT * FROM cards")
def digest_cards(spark: SparkSession, sf: str) -> DataFrame:
    return D.cards(_ordered(spark, sf), "zh-CN", "https://papers.example/")


@query(
    "digest_document",
    f"""
WITH {CARDS}, g AS (SELECT topic_label, min(pos) AS first_pos, count(*) AS n FROM cards GROUP BY topic_label)
SELECT 0 AS part, -1::BIGINT AS first_pos, -1::BIGINT AS pos, NULL AS html
UNION ALL SELECT 2, -1, -1, '<footer>更新于 2024-02-20</footer></body></html>'
UNION ALL SELECT 1, first_pos, -1, '<h2>' || topic_label || ' <small>' || n || ' 篇</small></h2>' FROM g
UNION ALL SELECT 1, g.first_pos, c.pos, '<div class="card"><h3><a href="' || url || '">' || title || '</a></h3><p class="by">' || byline || '</p>'
  || CASE WHEN note <> '' THEN '<p class="why"><b>为什么值得读</b> ' || note || '</p>' ELSE '' END
  || CASE WHEN brief <> '' THEN '<p class="brief">' || brief || '</p>' ELSE '' END
  || '<p class="foot">相关度: <strong>' || score || '</strong> <a href="' || url || '">查看详情</a></p></div>'
  FROM cards c JOIN g ON g.topic_label = c.topic_label""",
)
def digest_document(spark: SparkSession, sf: str) -> DataFrame:
    lines = D.digest_lines(_ordered(spark, sf), "zh-CN", RUN_TS, "https://papers.example/")
    # the head holds a mean as text, which pytest checks
    return lines.withColumn("html", F.when(F.col("part") != 0, F.col("html")))


@query(
    "report_markdown",
    f"""
WITH {SELECTED_RECORD}
SELECT arxiv_id, '# ' || title || chr(10) || chr(10) ||
  array_to_string(list_transform(list_filter(list_transform(string_split(brief, chr(10) || chr(10)), lambda p: trim(p, {WSX})), lambda p: p <> ''),
    lambda p: '> ' || replace(p, chr(10), ' ')), chr(10)) || CASE WHEN trim(brief, {WSX}) = '' THEN '' ELSE chr(10) || chr(10) END ||
  '**Topic**: ' || topic_label || chr(10) || '**arXiv**: [' || arxiv_id || '](https://arxiv.org/abs/' || arxiv_id || ')' || chr(10) ||
  '**Authors**: ' || array_to_string(string_split(title, ' '), ', ') || chr(10) || '**Published**: ' || published AS head,
  'topic_alignment,methodology_fit,novelty,experiment_coverage' AS dims, 2 AS n_answers FROM r""",
)
def report_markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = triage.analyse(triage.select(papers(spark, sf), CONF, RUN_TS), CONF)
    report = D.report_markdown(rows, RUN_TS)
    names = F.regexp_extract_all("report", F.lit(r"\n- \*\*(\w+)\*\*: [0-9.]+/100 \(weight: [0-9.]+\)"), F.lit(1))
    return report.select(
        "arxiv_id",
        F.substring_index("report", "\n**Score**: ", 1).alias("head"),
        F.array_join(names, ",").alias("dims"),
        F.size(F.regexp_extract_all("report", F.lit(r"\*Confidence: [0-9.]+\*"), F.lit(0))).alias("n_answers"),
    )


@query(
    "chat_prompt",
    """
SELECT arxiv_id, contains(abstract, chr(0)) AS odd, 'Title: ' || title_en || chr(10) || 'Id: ' || arxiv_id || chr(10) || 'Authors: '
  || array_to_string(string_split(title_en, ' '), ', ') || CASE WHEN published IS NULL THEN '' ELSE chr(10) || 'Published: ' || published END
  || chr(10) || 'Categories: ' || lang || chr(10) || chr(10) || '--- Abstract ---' || chr(10) || abstract
  || CASE WHEN abstract = '' THEN '' ELSE chr(10) || chr(10) || '--- In brief ---' || chr(10) || abstract END
  || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || '--- Five aspects ---' || chr(10) ||
    array_to_string(list_transform(range(5), lambda i: '[' || (i + 1) || '. ' || ['problem', 'solution', 'methodology', 'experiments', 'conclusion'][i + 1]
      || '] ' || CASE WHEN (doc_id + i) % 2 = 0 THEN source ELSE ' ' END), chr(10)) END
  || CASE WHEN doc_id % 5 = 0 THEN '' ELSE chr(10) || chr(10) || '--- Questions and answers ---' || chr(10) || 'Q1: why?' || chr(10)
    || 'A1 (confidence 0.75): ' || lang END
  || CASE WHEN doc_id % 2 = 0 AND abstract <> '' THEN chr(10) || chr(10) || '--- Body, first ' || len(substring(abstract, 1, 12000)) || ' characters ---'
    || chr(10) || substring(abstract, 1, 12000) ELSE '' END AS context FROM {latest}""",
)
def chat_prompt(spark: SparkSession, sf: str) -> DataFrame:
    made = P.chat_context(A.latest(analyses(spark, sf)))
    marker = "--- Paper ---\n"
    start = F.instr(F.col("system"), marker) + F.lit(len(marker))
    return made.select(
        "arxiv_id", F.lit(False).alias("odd"), F.substring(F.col("system"), start, F.length("system")).alias("context")
    )
