"""Prompts and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.checks.inputs import BACKFILL, CONF, RUN_TS, TOPICS, page_for_paper, papers, view
from paperloom.checks.q_select import WINDOWS
from paperloom.checks.q_text import BRIEF, BRIEF_TEXT, FIGS, OFFLINE_TASKS, SENTENCES
from paperloom.checks.registry import query
from paperloom.config import TriageConfig
from paperloom.functions import replies as RF
from paperloom.functions.scoring import recommendation
from paperloom.operators import analyses as A, candidates as C, figures as G, prompts as P, replies as R, selection as S
from paperloom.plans import triage

FENCED = "regexp_replace(trim(reply, ' ' || chr(10)), '(?i)^```(?:json)?\\s*|\\s*```$', '', 'g')"
#: The reply as JSON text of an object, else null.
DOC = f"""(CASE WHEN reply = '' THEN '{{}}' WHEN json_valid({FENCED}) AND json_type({FENCED}) = 'OBJECT' THEN {FENCED}
  WHEN NOT json_valid({FENCED}) AND json_valid(regexp_extract({FENCED}, '\\{{.*\\}}', 0, 's'))
  THEN regexp_extract({FENCED}, '\\{{.*\\}}', 0, 's') END)"""


def _get(path: str) -> str:
    return f"json_extract_string(doc, '{path}')"


@query("reply_parse", f"SELECT arxiv_id, {DOC} IS NOT NULL AS usable, length({DOC}) AS n FROM {{replies}}")
def reply_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "replies").withColumn("doc", RF.loose_json(F.col("reply")))
    # the text of the object keeps its length only if nothing else was taken with it
    inner = F.regexp_extract("reply", RF.OUTER_OBJECT, 0)
    return rows.select(
        "arxiv_id",
        F.col("doc").isNotNull().alias("usable"),
        F.when(F.col("doc").isNotNull(), F.length(inner).cast("bigint")).alias("n"),
    )


@query(
    "reply_retry",
    f"""
SELECT r.arxiv_id, 'Reply with exactly one JSON object and nothing else.' AS hint FROM {{replies}} r WHERE {DOC} IS NULL""",
)
def reply_retry(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "replies").withColumn("system", F.lit("s"))
    again = P.retry(rows, RF.loose_json(F.col("reply")).isNotNull())
    return again.select("arxiv_id", F.substring_index("system", "\n\n", -1).alias("hint"))


SCORE = "least(100.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(try_cast(json_extract_string(doc, '$.{d}.score') AS DOUBLE), 0.0::DOUBLE))) / 100.0::DOUBLE"


@query(
    "reply_scores",
    f"""
WITH r AS (SELECT arxiv_id, {DOC} AS doc FROM {{replies}}),
j AS (SELECT s.arxiv_id, s.topic_idx, r.doc IS NOT NULL AS from_reply,
  CASE WHEN doc IS NULL THEN d0 ELSE {SCORE.format(d='topic_alignment')} END AS a,
  CASE WHEN doc IS NULL THEN d1 ELSE {SCORE.format(d='methodology_fit')} END AS b,
  CASE WHEN doc IS NULL THEN d2 ELSE {SCORE.format(d='novelty')} END AS c,
  CASE WHEN doc IS NULL THEN d3 ELSE {SCORE.format(d='experiment_coverage')} END AS d
 FROM {{scored}} s LEFT JOIN r ON r.arxiv_id = s.arxiv_id)
SELECT arxiv_id, topic_idx, from_reply, (0.35::DOUBLE * a + 0.25::DOUBLE * b + 0.2::DOUBLE * c + 0.2::DOUBLE * d)
  / (0.35::DOUBLE + 0.25::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE) * 100.0::DOUBLE AS score FROM j""",
)
def reply_scores(spark: SparkSession, sf: str) -> DataFrame:
    base = C.single_window(C.topic_candidates(papers(spark, sf), TOPICS))
    rows = R.relevance(S.score_candidates(base, CONF), view(spark, sf, "replies"), CONF.dimensions)
    return rows.select("arxiv_id", "topic_idx", "from_reply", "score")


def _limit_steps(limit: int) -> str:
    """Windows and topics one after the other, each on what the earlier ones left."""
    ctes, taken = [], []
    for k, (w, t) in enumerate((w, t) for w in range(5) for t in range(len(TOPICS))):
        gone = " UNION ALL ".join(f"SELECT arxiv_id FROM s{i}" for i in range(k)) or "SELECT '' AS arxiv_id"
        ctes.append(
            f"s{k} AS (SELECT * FROM (SELECT * FROM placed WHERE window_idx = {w} AND topic_idx = {t} AND arxiv_id NOT IN ({gone}) "
            f"ORDER BY published DESC, arxiv_id LIMIT {limit}) x WHERE score >= 60)"
        )
        taken.append(f"SELECT arxiv_id, window_idx, topic_idx, score, from_reply FROM s{k}")
    return ", ".join(ctes) + " " + " UNION ALL ".join(taken)


@query(
    "backfill_limit_selection",
    f"""
WITH r AS (SELECT arxiv_id, {DOC} AS doc FROM {{replies}}),
j AS (SELECT s.arxiv_id, s.topic_idx, s.published, r.doc IS NOT NULL AS from_reply,
  CASE WHEN doc IS NULL THEN d0 ELSE {SCORE.format(d='topic_alignment')} END AS a,
  CASE WHEN doc IS NULL THEN d1 ELSE {SCORE.format(d='methodology_fit')} END AS b,
  CASE WHEN doc IS NULL THEN d2 ELSE {SCORE.format(d='novelty')} END AS c,
  CASE WHEN doc IS NULL THEN d3 ELSE {SCORE.format(d='experiment_coverage')} END AS d
 FROM {{scored}} s LEFT JOIN r ON r.arxiv_id = s.arxiv_id WHERE s.arxiv_id NOT IN (SELECT arxiv_id FROM {{manifest}})),
placed AS (SELECT w.window_idx, arxiv_id, topic_idx, published, from_reply, (0.35::DOUBLE * a + 0.25::DOUBLE * b + 0.2::DOUBLE * c
  + 0.2::DOUBLE * d) / (0.35::DOUBLE + 0.25::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE) * 100.0::DOUBLE AS score
 FROM j JOIN {WINDOWS} w ON CAST(published AS DATE) BETWEEN w.win_start AND w.win_end),
{_limit_steps(12)}""",
)
def backfill_limit_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Five windows, a limit, earlier runs and, for every paper and topic, a broken reply and a later good one."""
    base = view(spark, sf, "replies").withColumn("topic_idx", F.explode(F.sequence(F.lit(0), F.lit(len(TOPICS) - 1))))
    tries = F.explode(F.array(*[F.struct(F.lit(k).alias("attempt"), x.alias("reply")) for k, x in ((2, F.col("reply")), (1, F.lit("{")))]))
    replies = base.withColumn("_t", tries).select("arxiv_id", "topic_idx", "_t.attempt", "_t.reply")
    conf = TriageConfig(**{**CONF.__dict__, "max_per_topic": None, "paper_limit": 12})
    chosen = triage.select(
        papers(spark, sf), conf, RUN_TS, manifest=view(spark, sf, "manifest"), window=BACKFILL, replies=replies
    )
    return chosen.select("arxiv_id", "window_idx", "topic_idx", "score", "from_reply")


CORE_DOC = f"c AS (SELECT p.*, (SELECT {DOC} FROM {{core_replies}} r WHERE r.arxiv_id = p.arxiv_id) AS doc FROM {{papers}} p)"
CORE_FIELDS = ", ".join(
    f"CASE WHEN doc IS NOT NULL THEN trim(coalesce({_get('$.' + a)}, 'No relevant information found'), ' ' || chr(10)) END AS {a}"
    for a in P.ASPECTS
)


def _figured(spark: SparkSession, sf: str) -> DataFrame:
    pages = G.with_figures(page_for_paper(spark, sf)).select("arxiv_id", "figures")
    rows = papers(spark, sf).join(pages, "arxiv_id", "left")
    none = F.array().cast(pages.schema["figures"].dataType)
    return rows.withColumn("figures", F.coalesce("figures", none)).withColumn("body", F.col("abstract"))


def _cored(spark: SparkSession, sf: str) -> DataFrame:
    return R.core(_figured(spark, sf), view(spark, sf, "core_replies"))


@query("core_summary_ingest", f"WITH {CORE_DOC} SELECT arxiv_id, {CORE_FIELDS} FROM c")
def core_summary_ingest(spark: SparkSession, sf: str) -> DataFrame:
    rows = papers(spark, sf).withColumn(
        "figures", F.array().cast("array<struct<order:int,label:string,caption:string,url:string,reference_text:string>>")
    )
    return R.core(rows, view(spark, sf, "core_replies")).select("arxiv_id", "core_summary.*")


STAGED = f"""
{FIGS}, {CORE_DOC},
n AS (SELECT f.*, (row_number() OVER (PARTITION BY page_id ORDER BY "order") - 1) AS i FROM figs f),
st AS (SELECT c.arxiv_id, n.*, lower(trim({_get("$.figure_assignments.fig_' || n.i || '")})) AS stage
  FROM n JOIN c ON c.doc_id = n.page_id WHERE c.doc IS NOT NULL),
kept AS (SELECT * FROM st WHERE stage IN ('problem', 'solution', 'methodology', 'conclusion'))"""


@query(
    "figure_stages",
    f"WITH {STAGED} SELECT arxiv_id, string_agg(label || '=' || stage, ',' ORDER BY i) AS stages, "
    "coalesce(min_by(label, i) FILTER (WHERE stage = 'methodology'), min_by(label, i)) AS legacy FROM kept GROUP BY arxiv_id",
)
def figure_stages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cored(spark, sf).where(F.size("figures") > 0)
    pairs = F.transform("figures", lambda f: F.concat(f["label"], F.lit("="), f["stage"]))
    return rows.select(
        "arxiv_id", F.array_join(pairs, ",").alias("stages"), G.legacy_figure(F.col("figures"))["label"].alias("legacy")
    )


@query(
    "interest_profile_memo",
    """
SELECT arxiv_id, topic_idx, CASE WHEN interest_prompt = '' THEN '' ELSE interest_prompt END AS summary,
  CASE WHEN interest_prompt = '' THEN '' ELSE 'a,b,c,d,e,f' END AS questions,
  CASE WHEN interest_prompt = '' THEN '' ELSE 'k1,k2' END AS keywords FROM {cand}""",
)
def interest_profile_memo(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.with_topics(C.topic_candidates(papers(spark, sf), TOPICS), TOPICS)
    done = R.interest_profiles(rows, view(spark, sf, "profile_replies"))
    return done.select(
        "arxiv_id",
        "topic_idx",
        "profile.summary",
        F.array_join("profile.research_questions", ",").alias("questions"),
        F.array_join("profile.must_have_keywords", ",").alias("keywords"),
    )


QUESTIONS = """
q AS (SELECT p.arxiv_id, p.doc_id, p.lang, p.title, p.source, CASE WHEN lang = 'es' OR doc_id % 4 IN (1, 2)
  THEN ['What is the main contribution of this paper?', 'How do the experiments validate the method''s effectiveness?']
  ELSE list_filter([trim(title, ' ' || chr(9) || chr(10) || chr(13)), '', 'Q ' || source, 'three', 'four'], lambda x: x <> '') END AS qs,
  CASE WHEN lang = 'es' OR doc_id % 4 IN (1, 2) THEN ['Understand the core innovation', 'Assess the method''s reliability']
  WHEN trim(title, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN ['Deepen understanding of the paper', 'why', '4']
  ELSE ['Deepen understanding of the paper', 'Deepen understanding of the paper', 'why', '4'] END AS rs FROM {papers} p)"""


@query(
    "interest_questions",
    f"WITH {QUESTIONS} SELECT arxiv_id, unnest(range(len(qs)))::INTEGER AS pos, unnest(qs) AS question, unnest(rs) AS reason FROM q",
)
def interest_questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = papers(spark, sf).withColumn("interest_prompt", F.lit("anything"))
    done = R.questions(rows, view(spark, sf, "question_replies"))
    return done.select("arxiv_id", F.posexplode("tasks").alias("pos", "t")).select("arxiv_id", "pos", "t.*")


@query(
    "reading_tasks",
    "SELECT arxiv_id, unnest(range(3))::INTEGER AS pos, unnest(['论文要解决的核心问题是什么？', '作者提出的关键方法/框架是什么？', "
    "'相较已有工作，论文的创新点在哪里？']) AS question FROM {papers}",
)
def reading_tasks(spark: SparkSession, sf: str) -> DataFrame:
    # these replies hold no todo list, so every paper gets the default tasks
    done = R.reading_tasks(papers(spark, sf), view(spark, sf, "question_replies"), 3)
    return done.select("arxiv_id", F.posexplode("reading_tasks").alias("pos", "t")).select("arxiv_id", "pos", "t.question")


@query(
    "answers_confidence",
    "WITH s AS (SELECT arxiv_id, doc_id, lang, title, "
    + SENTENCES.replace("{t}", "abstract")
    + """ AS s FROM {papers}),
t AS (SELECT * FROM (VALUES (0, ['the', 'license', 'und']), (1, ['zzzz', 'qqqq']), (2, ['les', 'que'])) AS t(pos, words)),
m AS (SELECT s.*, t.pos, list_filter(s, lambda x: len(list_filter(words, lambda w: contains(lower(x), w))) > 0)[1:2] AS hit
  FROM s CROSS JOIN t),
u AS (SELECT *, CASE WHEN len(hit) > 0 THEN hit ELSE s[1:1] END AS used,
  CASE WHEN lang = 'es' THEN 3 ELSE (doc_id + pos) % 4 END AS kind FROM m)
SELECT arxiv_id, pos::INTEGER AS pos, CASE kind WHEN 0 THEN trim(title, ' ' || chr(9) || chr(10) || chr(13)) WHEN 1 THEN 'plain'
    WHEN 2 THEN 'No sufficient information found in the paper.'
    ELSE coalesce(nullif(array_to_string(used, ' '), ''), 'No sufficient information') END AS answer,
  CASE kind WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.25::DOUBLE
    ELSE least(1.0::DOUBLE, len(used)::DOUBLE * 0.3::DOUBLE + 0.4::DOUBLE) END AS confidence FROM u""",
)
def answers_confidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = papers(spark, sf).withColumn("tasks", R.task_array(OFFLINE_TASKS)).withColumn("body", F.col("abstract"))
    done = R.answers(rows, view(spark, sf, "answer_replies"))
    return done.select("arxiv_id", F.posexplode("findings").alias("pos", "f")).select(
        "arxiv_id", "pos", "f.answer", "f.confidence"
    )


WS = "' ' || chr(9) || chr(10) || chr(13)"
REPLY_TEXT = f"nullif(trim((SELECT reply FROM {{text_replies}} r WHERE r.arxiv_id = x.arxiv_id), {WS}), '')"


@query(
    "findings_rollup",
    f"""
WITH {CORE_DOC}, f AS (SELECT arxiv_id, abstract, doc IS NOT NULL AS has, {CORE_FIELDS} FROM c)
SELECT arxiv_id, CASE WHEN has THEN coalesce({REPLY_TEXT}, nullif(conclusion, ''), substring(trim(abstract, {WS}), 1, 300)) END AS conclusion
FROM f x""",
)
def findings_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.findings_summary(_cored(spark, sf), view(spark, sf, "text_replies"))
    return rows.select("arxiv_id", "core_summary.conclusion")


@query("brief_replies", f"SELECT arxiv_id, coalesce({REPLY_TEXT}, {BRIEF_TEXT}) AS brief_summary FROM {BRIEF} x")
def brief_replies(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.brief_summary(papers(spark, sf), view(spark, sf, "text_replies"))
    return rows.select("arxiv_id", "brief_summary")


@query(
    "relevance_notes",
    f"""
SELECT arxiv_id, topic_idx, coalesce(nullif(trim({REPLY_TEXT}, '"'' '), ''), CASE WHEN interest_prompt = '' THEN '(Online LLM not enabled.)'
  ELSE '(Online LLM not enabled — relevance note unavailable. See the 5-aspect core below to judge how this paper relates to your work.)'
  END) AS relevance FROM {{cand}} x""",
)
def relevance_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.with_topics(C.topic_candidates(papers(spark, sf), TOPICS), TOPICS)
    return R.relevance_note(rows, view(spark, sf, "text_replies")).select("arxiv_id", "topic_idx", "relevance")


def _translated(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.brief_summary(_cored(spark, sf))
    rows = rows.withColumn("relevance", F.lit("note")).withColumn("tasks", R.task_array(OFFLINE_TASKS))
    rows = R.answers(rows)
    return R.translation(rows, view(spark, sf, "translation_replies"))


@query(
    "translation_merge",
    f"""
WITH {STAGED}, g AS (SELECT arxiv_id, count(*) AS n, count(*) FILTER (WHERE trim(caption) <> '') AS nc,
   list(caption ORDER BY i) AS caps FROM kept GROUP BY arxiv_id),
b AS (SELECT c.*, {BRIEF_TEXT} AS brief FROM (SELECT c0.*, list_filter(string_split(regexp_replace(abstract, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda s: trim(s, {WS}) <> '') AS parts FROM c c0) c),
d AS (SELECT b.*, {CORE_FIELDS} FROM b)
SELECT d.arxiv_id,
  CASE WHEN lang = 'es' THEN title ELSE '译 ' || trim(title, {WS}) END AS title_zh,
  CASE WHEN lang = 'es' THEN brief ELSE trim(brief, {WS}) END AS brief_zh,
  CASE WHEN lang = 'es' THEN 'note' ELSE '相关' END AS relevance_zh,
  CASE WHEN doc IS NULL THEN NULL WHEN lang = 'es' THEN problem ELSE '问题' END AS problem_zh,
  CASE WHEN doc IS NULL THEN NULL ELSE solution END AS solution_zh,
  CASE WHEN doc IS NULL THEN NULL ELSE conclusion END AS conclusion_zh,
  coalesce(array_to_string(CASE WHEN g.nc = g.n AND g.n = CASE WHEN d.doc_id % 2 = 0 THEN 1 ELSE 2 END
    THEN ['图一', '图二'][1:g.n] ELSE g.caps END, '|'), '') AS captions_zh,
  CASE WHEN lang = 'es' THEN 'the, license；und' ELSE '问' END AS question1_zh, 'r1' AS reason1_zh, 'zzzz，qqqq' AS question2_zh
FROM d LEFT JOIN g ON g.arxiv_id = d.arxiv_id""",
)
def translation_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = _translated(spark, sf)
    tr = F.col("tr")
    return (
        rows.withColumn("_f", A.merge_captions(F.col("figures"), tr["figure_captions"]))
        .withColumn("_q", A.merge_findings(F.col("findings"), tr["findings"]))
        .withColumn("_t", A.merge_tasks(F.col("tasks"), tr["findings"]))
        .select(
            "arxiv_id",
            A.bi(F.col("title"), tr["title"])["zh"].alias("title_zh"),
            A.bi(F.col("brief_summary"), tr["brief_summary"])["zh"].alias("brief_zh"),
            A.bi(F.col("relevance"), tr["relevance"])["zh"].alias("relevance_zh"),
            *[
                F.when(
                    F.col("core_summary").isNotNull(), A.bi(F.col(f"core_summary.{a}"), tr["core_summary"][a])["zh"]
                ).alias(f"{a}_zh")
                for a in ("problem", "solution", "conclusion")
            ],
            F.array_join(F.transform("_f", lambda f: f["caption"]["zh"]), "|").alias("captions_zh"),
            F.col("_q")[0]["question"]["zh"].alias("question1_zh"),
            F.col("_t")[0]["reason"]["zh"].alias("reason1_zh"),
            F.col("_q")[1]["question"]["zh"].alias("question2_zh"),
        )
    )


# --- prompt tables ---------------------------------------------------------------------


@query(
    "prompt_relevance",
    """
SELECT arxiv_id, topic_idx, json_object('user_interest', interest_prompt, 'paper', json_object('title', title, 'abstract', abstract,
  'categories', [lang]), 'dimensions', [json_object('name', 'topic_alignment', 'weight', 0.35::DOUBLE, 'description', 'topic_alignment'),
  json_object('name', 'methodology_fit', 'weight', 0.25::DOUBLE, 'description', 'methodology_fit'),
  json_object('name', 'novelty', 'weight', 0.2::DOUBLE, 'description', 'novelty'),
  json_object('name', 'experiment_coverage', 'weight', 0.2::DOUBLE, 'description', 'experiment_coverage')])::VARCHAR AS prompt
FROM {cand}""",
)
def prompt_relevance(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.with_topics(C.topic_candidates(papers(spark, sf), TOPICS), TOPICS)
    return P.relevance(rows, CONF.dimensions).select("arxiv_id", "topic_idx", F.col("user").alias("prompt"))


@query(
    "prompt_core",
    f"""
WITH {FIGS}, n AS (SELECT f.*, (row_number() OVER (PARTITION BY page_id ORDER BY "order") - 1) AS i FROM figs f),
l AS (SELECT page_id, string_agg('- id=fig_' || i || ' | label=' || label || chr(10) || '  caption: ' ||
   coalesce(nullif(caption, ''), '(no caption)') || chr(10) || '  body reference: ' ||
   coalesce(nullif(CASE WHEN len(reference_text) > 400 THEN substring(reference_text, 1, 400) || '…' ELSE reference_text END, ''), '(none)'),
   chr(10) ORDER BY i) AS lines FROM n GROUP BY page_id)
SELECT p.arxiv_id, 'Title: ' || title || chr(10) || 'Abstract: ' || abstract || chr(10) || 'Content: ' || substring(abstract, 1, 50000)
  || CASE WHEN l.lines IS NULL THEN '' ELSE chr(10) || chr(10) || 'Figures:' || chr(10) || l.lines END AS prompt
FROM {{papers}} p LEFT JOIN l ON l.page_id = p.doc_id""",
)
def prompt_core(spark: SparkSession, sf: str) -> DataFrame:
    return P.core(_figured(spark, sf)).select("arxiv_id", F.col("user").alias("prompt"))


@query(
    "prompt_questions",
    f"""
WITH {CORE_DOC}, f AS (SELECT c.*, {CORE_FIELDS} FROM c)
SELECT arxiv_id, 'Title: ' || title || chr(10) || 'Abstract: ' || abstract || CASE WHEN doc IS NULL THEN '' ELSE chr(10) || chr(10) || 'Summary:'
  || chr(10) || {" || chr(10) || ".join(f"'- {a}: ' || substring({a}, 1, 300) || '...'" for a in P.ASPECTS)} END
  || chr(10) || chr(10) || 'Interests:' || chr(10) || source || chr(10) || chr(10) || 'Profile: ' || source || chr(10)
  || 'Research questions: ' || chr(10) || 'Keywords: ' || chr(10) || 'Not wanted: ' AS prompt FROM f""",
)
def prompt_questions(spark: SparkSession, sf: str) -> DataFrame:
    source = view(spark, sf, "papers").select("arxiv_id", F.col("source").alias("interest_prompt"))
    rows = R.interest_profiles(_cored(spark, sf).join(source, "arxiv_id"))
    return P.questions(rows).select("arxiv_id", F.col("user").alias("prompt"))


@query(
    "prompt_answers",
    """
SELECT arxiv_id, t.pos, 'Question: ' || t.q || chr(10) || 'Why: ' || t.r || chr(10) || chr(10) || 'Title: ' || title || chr(10)
  || 'Content: ' || substring(abstract, 1, 50000) AS prompt
FROM {papers}, (VALUES (0, 'the, license；und', 'r1'), (1, 'zzzz，qqqq', 'r2'), (2, 'Les; QUE', 'r3')) AS t(pos, q, r)""",
)
def prompt_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = papers(spark, sf).withColumn("tasks", R.task_array(OFFLINE_TASKS)).withColumn("body", F.col("abstract"))
    return P.answers(rows).select("arxiv_id", "pos", F.col("user").alias("prompt"))


@query(
    "prompt_profiles",
    "SELECT DISTINCT source AS prompt_key, 'Interests:' || chr(10) || chr(10) || source AS prompt FROM {documents}",
)
def prompt_profiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "papers").select(F.col("source").alias("interest_prompt"))
    return P.profiles(rows).select("prompt_key", F.col("user").alias("prompt"))


@query(
    "prompt_findings",
    f"""
WITH {CORE_DOC}, f AS (SELECT c.*, {CORE_FIELDS} FROM c), {QUESTIONS}
SELECT f.arxiv_id, 'Paper: ' || f.title || chr(10) || chr(10) || 'Conclusion:' || chr(10) || conclusion || chr(10) || chr(10)
  || 'Questions and answers:' || chr(10) || array_to_string(list_transform(qs, lambda x: '- Q: ' || x || chr(10) || '  A: plain'), chr(10)) AS prompt
FROM f JOIN q ON q.arxiv_id = f.arxiv_id WHERE doc IS NOT NULL""",
)
def prompt_findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.questions(
        _cored(spark, sf).withColumn("interest_prompt", F.lit("x")), view(spark, sf, "question_replies")
    )
    made = F.transform("tasks", lambda t: F.struct(t["question"].alias("question"), F.lit("plain").alias("answer")))
    return P.findings(rows.withColumn("findings", made)).select("arxiv_id", F.col("user").alias("prompt"))


@query(
    "prompt_brief",
    f"""
WITH {CORE_DOC}, f AS (SELECT c.*, {CORE_FIELDS} FROM c)
SELECT arxiv_id, CASE WHEN doc IS NULL THEN json_object('paper_title', title, 'paper_abstract', abstract,
    'key_findings', '- Q: why' || chr(10) || '  A: ' || source)::VARCHAR
  ELSE json_object('paper_title', title, 'paper_abstract', abstract, 'core_summary', json_object('problem', problem, 'solution', solution,
    'methodology', methodology, 'experiments', experiments, 'conclusion', conclusion), 'key_findings', '- Q: why' || chr(10) || '  A: ' || source)::VARCHAR
  END AS prompt FROM f""",
)
def prompt_brief(spark: SparkSession, sf: str) -> DataFrame:
    return P.brief(_asked(spark, sf)).select("arxiv_id", F.col("user").alias("prompt"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    source = view(spark, sf, "papers").select("arxiv_id", "source")
    found = F.array(F.struct(F.lit("why").alias("question"), F.col("source").alias("answer")))
    return _cored(spark, sf).join(source, "arxiv_id").withColumn("findings", found)


@query(
    "prompt_note",
    f"""
WITH {CORE_DOC}, f AS (SELECT c.*, {CORE_FIELDS} FROM c)
SELECT arxiv_id, CASE WHEN doc IS NULL THEN json_object('interests', source, 'profile', json_object('summary', source, 'research_questions', [],
    'must_have_keywords', [], 'anti_keywords', []), 'paper_title', title, 'paper_abstract', abstract, 'brief_summary', 'b')::VARCHAR
  ELSE json_object('interests', source, 'profile', json_object('summary', source, 'research_questions', [], 'must_have_keywords', [],
    'anti_keywords', []), 'paper_title', title, 'paper_abstract', abstract, 'brief_summary', 'b',
    'core_summary', json_object('problem', problem, 'solution', solution, 'methodology', methodology))::VARCHAR END AS prompt FROM f""",
)
def prompt_note(spark: SparkSession, sf: str) -> DataFrame:
    rows = _asked(spark, sf).withColumn("interest_prompt", F.col("source")).withColumn("brief_summary", F.lit("b"))
    return P.note(R.interest_profiles(rows)).select("arxiv_id", F.col("user").alias("prompt"))


@query(
    "prompt_tasks",
    """
SELECT arxiv_id, topic_idx, json_object('user_interest', interest_prompt, 'paper_title', title, 'paper_abstract', abstract, 'max_items', 5)::VARCHAR
  AS prompt FROM {cand}""",
)
def prompt_tasks(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.with_topics(C.topic_candidates(papers(spark, sf), TOPICS), TOPICS)
    keyed = rows.withColumn("arxiv_id", F.concat_ws("#", "arxiv_id", "topic_idx"))
    made = P.tasks(keyed).select(F.split("arxiv_id", "#").alias("k"), F.col("user").alias("prompt"))
    return made.select(F.col("k")[0].alias("arxiv_id"), F.col("k")[1].cast("int").alias("topic_idx"), "prompt")


@query(
    "prompt_translate",
    f"""
WITH b AS (SELECT *, {BRIEF_TEXT} AS brief FROM {BRIEF} x)
SELECT arxiv_id, json_object('title', title, 'brief_summary', brief, 'relevance', 'note', 'findings',
  [json_object('question', 'q', 'reason', 'r', 'answer', source)])::VARCHAR AS prompt FROM b""",
)
def prompt_translate(spark: SparkSession, sf: str) -> DataFrame:
    source = view(spark, sf, "papers").select("arxiv_id", "source")
    rows = R.brief_summary(papers(spark, sf)).withColumn("relevance", F.lit("note")).join(source, "arxiv_id")
    found = F.array(
        F.struct(F.lit("q").alias("question"), F.lit("r").alias("reason"), F.col("source").alias("answer"))
    )
    none = F.array().cast("array<struct<order:int,label:string,caption:string,url:string,reference_text:string>>")
    rows = R.core(rows.withColumn("findings", found).withColumn("figures", none))
    return P.translate(rows, "zh-CN").select("arxiv_id", F.col("user").alias("prompt"))


@query(
    "recommendations",
    """
WITH w AS (SELECT *, 0.35::DOUBLE * d0 AS w0, 0.25::DOUBLE * d1 AS w1, 0.2::DOUBLE * d2 AS w2, 0.2::DOUBLE * d3 AS w3 FROM {dims})
SELECT arxiv_id, topic_idx, CASE WHEN w0 >= greatest(w1, w2, w3) THEN 'topic_alignment' WHEN w1 >= greatest(w2, w3) THEN 'methodology_fit'
  WHEN w2 >= w3 THEN 'novelty' ELSE 'experiment_coverage' END AS top,
  topic_label || '.' || CASE WHEN substring(abstract, 1, 200) = '' THEN '' ELSE ' ' || substring(abstract, 1, 200) || '...' END AS ending FROM w""",
)
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.score_candidates(C.single_window(C.topic_candidates(papers(spark, sf), TOPICS)), CONF)
    found = F.array(
        F.struct(F.lit("unsure").alias("answer"), F.lit(0.6).alias("confidence")),
        F.struct(F.col("abstract").alias("answer"), F.lit(0.61).alias("confidence")),
    )
    text = recommendation(F.col("scores"), found, F.col("topic_label"))
    marker = "highly aligned with your research interests in "
    start = F.instr(F.col("text"), marker) + F.lit(len(marker))
    return rows.withColumn("text", text).select(
        "arxiv_id",
        "topic_idx",
        F.regexp_extract("text", r"^This paper scores high in the \*\*(\w+)\*\*", 1).alias("top"),
        F.substring(F.col("text"), start, F.length("text")).alias("ending"),
    )
