"""The test tables in the shapes the operators expect.

Each view is one SQL text that runs in Spark and in DuckDB.  ``{name}`` stands for a
base table or an earlier view.  All rows and whole texts are used.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.config import Topic, TriageConfig
from paperloom.functions import ids
from paperloom.sources.tables import read_table

TABLES = ("documents", "pages", "events", "conversations", "labels", "benchmark")

TOPICS = (
    Topic("prose_en", "English prose", ("en",), ("license", "thble"), ("attion",), "license terms and thble"),
    Topic("prose_fr", "French prose", ("fr",), ("les", "que"), (), ""),
    Topic("mixed", "Mixed prose", ("en", "de"), ("with", "und"), ("license",), "license terms and thble"),
    Topic("empty", "Nothing", (), ("zzzz",), ()),
)
NOVELTY = ("this", "than", "ther", "thon", "erin")
EXPERIMENT = ("attion", "thble", "anea", "thor", "thing")
RUN_TS = datetime(2024, 2, 20, 6, 0, 0)
START, END, CHUNK_DAYS = datetime(2024, 1, 1), datetime(2024, 1, 31), 7
BACKFILL = (START, END, CHUNK_DAYS)

CONF = TriageConfig(
    topics=TOPICS, max_per_topic=None, novelty_words=NOVELTY, experiment_words=EXPERIMENT, days_back=60
)


def _pid(col: str) -> str:
    return (
        f"concat(cast(1000 + cast(floor({col} / 100000) AS BIGINT) AS STRING), '.', "
        f"lpad(cast({col} % 100000 AS STRING), 5, '0'))"
    )


def _texts(words: tuple[str, ...]) -> str:
    return "|".join(words)


def _json_text(col: str) -> str:
    """JSON string body of a text column, spelled so that both engines read it alike."""
    out = f"replace({col}, chr(92), concat(chr(92), chr(92)))"
    for code, letter in ((34, chr(34)), (10, "n"), (13, "r"), (9, "t")):
        mark = "chr(34)" if code == 34 else f"'{letter}'"
        out = f"replace({out}, chr({code}), concat(chr(92), {mark}))"
    return out


VIEWS: dict[str, str] = {
    "papers": f"""
SELECT doc_id, {_pid('doc_id')} AS arxiv_id, split_part(text, chr(10), 1) AS title, text AS abstract,
  lang, source, concat('2024-01-', lpad(cast(1 + doc_id % 30 AS STRING), 2, '0')) AS published
FROM {{documents}}""",
    "topics": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, '{t.name}', '{t.label}', '{_texts(t.include)}', '{_texts(t.categories)}', '{_texts(t.exclude)}', "
        f"'{t.interest_prompt}')"
        for i, t in enumerate(TOPICS)
    )
    + ") AS t(topic_idx, topic, topic_label, include, categories, exclude, interest_prompt)",
    # ids with a label count as handled by earlier runs
    "manifest": "SELECT DISTINCT p.arxiv_id FROM {papers} p JOIN {labels} l ON p.doc_id = l.doc_id",
    "submissions": """
SELECT doc_id AS sub_id, CASE doc_id % 6
  WHEN 0 THEN concat('https://arxiv.org/abs/', arxiv_id, 'v2')
  WHEN 1 THEN concat('https://arxiv.org/pdf/', arxiv_id, '.pdf')
  WHEN 2 THEN concat(' arXiv:', arxiv_id, ' ')
  WHEN 3 THEN concat('cs.SE/', lpad(cast(doc_id AS STRING), 7, '0'), 'v1')
  WHEN 4 THEN 'not an id' ELSE arxiv_id END AS raw,
  CASE doc_id % 4 WHEN 0 THEN 'prose_fr' WHEN 1 THEN 'Mixed prose' WHEN 2 THEN 'unknown' END AS topic
FROM {papers}""",
    # scoring replies: clean, fenced, wrapped in prose, broken, or none at all
    "replies": """
SELECT arxiv_id, CASE doc_id % 5
  WHEN 0 THEN body WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```')
  WHEN 2 THEN concat('Here you go: ', body, ' Hope it helps.')
  WHEN 3 THEN concat(body, ' and ', body)
  ELSE '{broken' END AS reply
FROM (SELECT doc_id, arxiv_id, lang, concat('{"topic_alignment":{"score":', cast(doc_id * 37 % 141 - 20 AS STRING),
   ',"reason":"r"},"methodology_fit":{"score":"', cast(doc_id * 13 % 101 AS STRING), '"}',
   CASE WHEN doc_id % 2 = 0 THEN concat(',"novelty":{"score":', cast(doc_id % 100 AS STRING), '}') ELSE '' END, '}') AS body
  FROM {papers}) b WHERE lang <> 'es'""",
    # model replies of the later steps; papers in Spanish got none
    "core_replies": f"""
SELECT arxiv_id, CASE doc_id % 4 WHEN 0 THEN body WHEN 1 THEN concat('```', chr(10), body, '```')
  WHEN 2 THEN concat('Sure: ', body) ELSE concat('[', body, ']') END AS reply
FROM (SELECT doc_id, arxiv_id, lang, concat('{{"problem":" ', {_json_text('title')}, ' ","solution":"', source,
  '","methodology":"', {_json_text('abstract')}, '","conclusion":"', CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Done.' END,
  '","figure_assignments":', CASE WHEN doc_id % 7 = 0 THEN '["methodology"]' ELSE concat('{{"fig_0":"',
    CASE doc_id % 3 WHEN 0 THEN 'Methodology' WHEN 1 THEN ' problem ' ELSE 'weird' END, '","fig_1":"',
    CASE doc_id % 2 WHEN 0 THEN 'experiments' ELSE 'conclusion' END, '"}}') END, '}}') AS body FROM {{papers}}) b
WHERE lang <> 'es'""",
    "question_replies": f"""
SELECT arxiv_id, CASE doc_id % 4 WHEN 1 THEN '{{"questions":[3,{{"question":"x"}}]}}' WHEN 2 THEN '{{"questions":[]}}'
  ELSE concat('{{"questions":[{{"question":" ', {_json_text('title')}, ' ","reason":""}},{{"question":"  ","reason":"x"}},',
   '{{"question":"Q ', source, '"}},{{"question":"three","reason":" why "}},{{"question":"four","reason":"4"}},',
   '{{"question":"five","reason":"5"}}]}}') END AS reply
FROM {{papers}} WHERE lang <> 'es'""",
    "answer_replies": f"""
SELECT p.arxiv_id, t.pos, CASE (p.doc_id + t.pos) % 4 WHEN 0 THEN concat('{{"answer":" ', {_json_text('p.title')}, ' ","confidence":1.7}}')
  WHEN 1 THEN '{{"answer":"plain"}}' WHEN 2 THEN '{{"confidence":"0.25"}}' ELSE '{{"answer":"bad","confidence":"high"}}' END AS reply
FROM {{papers}} p JOIN (VALUES (0), (1), (2)) AS t(pos) ON p.lang <> 'es'""",
    "text_replies": """
SELECT arxiv_id, CASE doc_id % 3 WHEN 0 THEN concat(' "', title, '" ') WHEN 1 THEN '   ' ELSE concat('Note on ', source) END AS reply
FROM {papers} WHERE lang <> 'es'""",
    "translation_replies": f"""
SELECT arxiv_id, concat('{{"title":"译 ', {_json_text('title')}, '","brief_summary":"","relevance":" 相关 ",',
  '"core_summary":{{"problem":"问题","conclusion":null}},"figure_captions":',
  CASE doc_id % 2 WHEN 0 THEN '["图一"]' ELSE '["图一","图二"]' END, ',"findings":[{{"question":"问","answer":"答"}}]}}') AS reply
FROM {{papers}} WHERE lang <> 'es'""",
    "profile_replies": """
SELECT DISTINCT interest_prompt AS prompt_key, concat('{"summary":" ', interest_prompt, ' ","research_questions":["a"," b","c","d","e","f","g"],',
  '"must_have_keywords":["k1","k2"],"anti_keywords":[]}') AS reply FROM {topics}""",
    "state_events": f"""
SELECT event_id, ts, {_pid('user_id')} AS arxiv_id,
  CASE event_type WHEN 'signup' THEN 'star' WHEN 'purchase' THEN 'star_replace' WHEN 'error' THEN 'unstar'
    WHEN 'click' THEN 'hide' ELSE 'unhide' END AS op,
  CASE WHEN event_id % 4 = 0 THEN event_type END AS topic,
  CASE WHEN event_id % 3 = 0 THEN props END AS note
FROM {{events}}""",
    "pages_fig": """
SELECT page_id, url, replace(html, '</article>', concat(
  '<figure class="ltx_figure"><img src="x', cast(page_id AS STRING), '.png"/><figcaption><span class="ltx_tag ltx_tag_figure">Figure 1: </span>',
  CASE WHEN page_id % 2 = 0 THEN 'Overview of the pipeline' ELSE 'Ablation result' END, '</figcaption></figure>',
  '<figure class="ltx_figure"><span>no image</span></figure>',
  '<figure class="ltx_figure"><img src="/y.png"/><figcaption>',
  CASE WHEN page_id % 3 = 0 THEN 'System architecture and framework' ELSE '' END, '</figcaption></figure>',
  '<p>As shown in Fig. 1, the flow has several clearly separated stages.</p><p>See Figure 1.</p>',
  '<p>Figure 3 gives the second view of the same flow, in more detail.</p></article>')) AS html
FROM {pages}""",
    "note_events": """
SELECT e.event_id, e.ts, p.arxiv_id, concat('n', cast(e.event_id % 3 AS STRING)) AS note_id,
  CASE WHEN e.event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
  CASE e.event_id % 9 WHEN 0 THEN 'relevance' WHEN 1 THEN 'brief' WHEN 2 THEN 'problem' WHEN 3 THEN 'solution'
    WHEN 4 THEN 'methodology' WHEN 5 THEN 'experiments' WHEN 6 THEN 'conclusion' WHEN 7 THEN 'qa' ELSE 'bad' END AS stage,
  CASE e.event_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN 'zzz orphan' ELSE substring(p.abstract, 3, 12) END AS quote,
  concat(' note ', cast(e.event_id AS STRING), ' ') AS note
FROM {events} e JOIN {papers} p ON p.doc_id = e.user_id""",
    # two versions of every labelled paper, one of the others
    "analyses": """
SELECT p.doc_id, p.arxiv_id, v.ver,
  CASE p.doc_id % 3 WHEN 0 THEN 'prose_en' WHEN 1 THEN 'prose_fr' ELSE 'mixed' END AS topic,
  CASE p.doc_id % 3 WHEN 0 THEN 'English prose' WHEN 1 THEN 'French prose' ELSE '' END AS topic_label,
  p.title AS title_en, CASE WHEN p.doc_id % 2 = 0 THEN concat('zh: ', p.title) ELSE '' END AS title_zh,
  p.abstract, p.lang, p.source,
  cast((p.doc_id * 7 + v.ver) % 101 AS DOUBLE) AS score,
  CASE WHEN p.doc_id % 11 = 0 THEN NULL ELSE p.published END AS published,
  concat('2024-02-', lpad(cast(1 + (p.doc_id + v.ver * 9) % 28 AS STRING), 2, '0'), 'T06:00:00Z') AS generated_at
FROM {papers} p LEFT JOIN {labels} l ON p.doc_id = l.doc_id
JOIN (VALUES (0), (1)) AS v(ver) ON v.ver = 0 OR l.doc_id IS NOT NULL""",
    "blocks": """
SELECT doc_id, cast(floor(pos / 12) AS BIGINT) AS page, cast(pos % 12 AS DOUBLE) AS y0,
  CASE pos % 4 WHEN 0 THEN concat('Figure ', cast(1 + pos % 5 AS STRING), ': ', line)
    WHEN 1 THEN concat('As Fig. ', cast(1 + pos % 3 AS STRING), ' shows, ', line)
    WHEN 2 THEN concat(' fig ', cast(1 + pos % 7 AS STRING), chr(10), line) ELSE line END AS text
FROM {lines}""",
    "chat_turns": f"""
SELECT {_pid('conv_id')} AS arxiv_id, turn AS seq, role, text AS content FROM {{conversations}}""",
}

#: Lines of a document with their position; array syntax differs between the engines.
LINES_SPARK = "SELECT doc_id, pos, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, line"
LINES_DUCKDB = (
    "SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {documents}) x"
)

_NAME = re.compile(r"\{([a-z_]+)\}")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A base table or view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf, name)
    sql = LINES_SPARK if name == "lines" else VIEWS[name]
    needs = {n: view(spark, sf, n) for n in dict.fromkeys(_NAME.findall(sql))}
    # braces of literals are doubled for the formatter; placeholders stay
    safe = _NAME.sub(lambda m: f"\x00{m.group(1)}\x01", sql).replace("{", "{{").replace("}", "}}")
    return spark.sql(safe.replace("\x00", "{").replace("\x01", "}"), **needs)


def with_views(sql: str) -> str:
    """DuckDB text: the views `sql` names, as CTEs in front of it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in TABLES or name in order:
                continue
            body = ORACLE_VIEWS.get(name) or VIEWS.get(name)
            if body is None:
                continue
            visit(body)
            order.append(name)

    visit(sql)

    def plain(text: str) -> str:
        known = set(order) | set(TABLES)
        return _NAME.sub(lambda m: m.group(1) if m.group(1) in known else m.group(0), text)

    bodies = {n: ORACLE_VIEWS.get(n) or VIEWS[n] for n in order}
    ctes = ",\n".join(f"{n} AS ({plain(bodies[n]).strip()})" for n in order)
    main = plain(sql).strip()
    if not ctes:
        return main
    if re.match(r"(?i)with\s", main):
        return f"WITH {ctes},\n{main[4:].strip()}"
    return f"WITH {ctes}\n{main}"


ORACLE_VIEWS: dict[str, str] = {
    "lines": LINES_DUCKDB,
    # papers with every topic they match
    "cand": """
SELECT p.*, t.topic_idx, t.topic, t.topic_label, t.include, t.categories, t.interest_prompt, 0 AS window_idx
FROM {papers} p JOIN {topics} t ON
  (t.include = '' OR len(list_filter(string_split(t.include, '|'),
      lambda k: contains(lower(p.title), k) OR contains(lower(p.abstract), k))) > 0)
  AND (t.categories = '' OR list_contains(string_split(t.categories, '|'), p.lang))
  AND (t.exclude = '' OR len(list_filter(string_split(t.exclude, '|'),
      lambda k: contains(lower(p.title), k) OR contains(lower(p.abstract), k))) = 0)""",
    # offline dimension values
    "dims": f"""
SELECT *, least(100.0::DOUBLE, greatest(0.0::DOUBLE, inc * 70.0::DOUBLE + cat * 30.0::DOUBLE)) / 100.0::DOUBLE AS d0,
  least(100.0::DOUBLE, greatest(0.0::DOUBLE, inc_i * 80.0::DOUBLE)) / 100.0::DOUBLE AS d1,
  (nov * 60.0::DOUBLE + 40.0::DOUBLE) / 100.0::DOUBLE AS d2,
  (exp * 70.0::DOUBLE + 30.0::DOUBLE) / 100.0::DOUBLE AS d3
FROM (SELECT *,
  CASE WHEN include = '' THEN 0.5::DOUBLE ELSE len(list_filter(string_split(include, '|'), lambda k: contains(txt, k)))::DOUBLE
    / len(string_split(include, '|')) END AS inc,
  CASE WHEN categories = '' THEN 0.5::DOUBLE ELSE len(list_filter(string_split(categories, '|'), lambda k: contains(txt, k)))::DOUBLE
    / len(string_split(categories, '|')) END AS cat,
  CASE WHEN include = '' THEN 0.5::DOUBLE ELSE len(list_filter(string_split(include, '|'),
    lambda k: contains(concat(txt, ' ', lower(interest_prompt)), k)))::DOUBLE / len(string_split(include, '|')) END AS inc_i,
  least(1.0::DOUBLE, len(list_filter({list(NOVELTY)}, lambda k: contains(txt, k)))::DOUBLE / 3.0::DOUBLE) AS nov,
  least(1.0::DOUBLE, len(list_filter({list(EXPERIMENT)}, lambda k: contains(txt, k)))::DOUBLE / 3.0::DOUBLE) AS exp
  FROM (SELECT *, lower(concat(title, ' ', abstract)) AS txt FROM {{cand}}) a) b""",
    "scored": """
SELECT *, total_score / (0.35::DOUBLE + 0.25::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE) * 100.0::DOUBLE AS score FROM (
  SELECT *, 0.35::DOUBLE * d0 + 0.25::DOUBLE * d1 + 0.2::DOUBLE * d2 + 0.2::DOUBLE * d3 AS total_score FROM {dims}) s""",
    "selected": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY window_idx, topic_idx) AS rn
  FROM {scored} WHERE score >= 60) x WHERE rn = 1""",
    "latest": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY generated_at DESC) AS rn FROM {analyses}) x
WHERE rn = 1""",
}


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Papers in the candidate schema (plus doc_id)."""
    base = view(spark, sf, "papers")
    names = F.split("title", " ")
    return base.select(
        "doc_id",
        "arxiv_id",
        "title",
        "abstract",
        names.alias("authors"),
        F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).otherwise(F.array("source")).alias("affiliations"),
        F.array("lang").alias("categories"),
        F.to_timestamp("published", "yyyy-MM-dd").alias("published"),
        F.to_timestamp("published", "yyyy-MM-dd").alias("updated"),
        ids.abs_url(F.col("arxiv_id")).alias("arxiv_url"),
        ids.pdf_url(F.col("arxiv_id")).alias("pdf_url"),
        F.lit(None).cast("string").alias("comment"),
    )


def page_for_paper(spark: SparkSession, sf: str) -> DataFrame:
    """Pages keyed by paper: page n belongs to document n."""
    return view(spark, sf, "pages_fig").withColumn("arxiv_id", F.expr(_pid("page_id")))
