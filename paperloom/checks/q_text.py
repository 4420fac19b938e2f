"""Text, HTML and figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.checks.inputs import page_for_paper, papers, view
from paperloom.checks.registry import query
from paperloom.functions import bilingual, dates, html, text as T
from paperloom.operators import figures as G, replies as R
from paperloom.sources import feed

# --- SQL pieces shared by the counterparts -------------------------------------------


def _sql_unescape(e: str) -> str:
    for name, char in html.ENTITIES:
        e = f"replace({e}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return e


def _sql_dropped(e: str) -> str:
    e = f"regexp_replace({e}, '<!--.*?-->', '', 'gs')"
    for tag in html.DROPPED_TAGS:
        e = f"regexp_replace({e}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'gsi')"
    return e


_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _sql_strip(e: str) -> str:
    return f"trim({e}, {_WS})"


def _sql_squeeze(e: str) -> str:
    return _sql_strip(f"regexp_replace({e}, '\\s+', ' ', 'g')")


def _sql_inner(e: str, gap: str = " ") -> str:
    tags = f"regexp_replace({e}, '</?[a-zA-Z!?][^>]*>', '{gap}', 'g')"
    return _sql_squeeze(_sql_unescape(tags))


def _sql_page_text(e: str) -> str:
    e = _sql_dropped(e)
    e = f"regexp_replace({e}, '</?(?:{html.BREAKING_TAGS})\\b[^>]*>', chr(10), 'gi')"
    e = _sql_unescape(f"regexp_replace({e}, '</?[a-zA-Z!?][^>]*>', '', 'g')")
    e = f"regexp_replace(regexp_replace({e}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return _sql_strip(f"regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _sql_elements(e: str, tag: str) -> str:
    """List of {attrs, inner} by the same markers."""
    marked = f"regexp_replace(regexp_replace({e}, '<{tag}\\b', chr(1), 'gi'), '</{tag}\\s*>', chr(2), 'gi')"
    return (
        f"list_transform(string_split({marked}, chr(1))[2:], lambda p: {{'attrs': split_part(p, '>', 1), "
        f"'inner': split_part(CASE WHEN contains(p, '>') THEN substr(p, instr(p, '>') + 1) ELSE '' END, chr(2), 1)}})"
    )


PARAS = f"list_filter(list_transform({_sql_elements('html', 'p')}, lambda e: {_sql_inner('e.inner')}), lambda t: len(t) >= 40)"


def _sql_cite(num: str) -> str:
    return (
        "lambda t: regexp_matches(t, '(?i)(?:\\bfig(?:ure)?\\.?\\s*|图\\s*)' || "
        f"{num} || '\\b')"
    )


def _sql_resolve(src: str, url: str = "url") -> str:
    host = f"regexp_extract({url}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1)"
    path = f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    folder = f"coalesce(nullif(regexp_extract({path}, '^(.*/)', 1), ''), '/')"
    return (
        f"CASE WHEN regexp_matches({src}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN {src} "
        f"WHEN starts_with({src}, '//') THEN split_part({url}, '//', 1) || {src} "
        f"WHEN starts_with({src}, '/') THEN {host} || {src} "
        f"WHEN starts_with({src}, '#') THEN split_part({url}, '#', 1) || {src} ELSE {host} || {folder} || {src} END"
    )


FIGS = f"""
f0 AS (SELECT page_id, url, html, {_sql_elements('html', 'figure')} AS nodes FROM {{pages_fig}}),
f1 AS (SELECT page_id, url, html, unnest(nodes) AS e, unnest(range(len(nodes))) AS ord FROM f0),
f2 AS (SELECT *, {_sql_elements('e.inner', 'figcaption')}[1].inner AS cap,
  regexp_extract(regexp_extract(e.inner, '<img\\b[^>]*>', 0, 'i'), 'src="([^"]*)"', 1) AS src FROM f1),
f3 AS (SELECT page_id, url, html, CAST(ord AS INTEGER) AS "order",
  coalesce(nullif(rtrim({_sql_inner("regexp_extract(cap, '<span\\b[^>]*class=\"[^\"]*ltx_tag[^\"]*\"[^>]*>(.*?)</span>', 1, 's')", '')}, ':： '), ''),
    'Figure ' || (ord + 1)) AS label,
  coalesce({_sql_inner('cap')}, '') AS caption, {_sql_resolve('src')} AS link FROM f2 WHERE src <> ''),
figs AS (SELECT page_id, "order", label, caption, link AS url,
  coalesce(substring(array_to_string(list_filter(list_transform({_sql_elements('html', 'p')}, lambda e: {_sql_inner('e.inner')}),
    lambda t: len(t) >= 40 AND regexp_matches(t, '(?i)(?:\\bfig(?:ure)?\\.?\\s*|图\\s*)' || regexp_extract(label, '\\d+') || '\\b'))[1:3],
    chr(10) || chr(10)), 1, 1500), '') AS reference_text FROM f3)
"""


# --- queries ---------------------------------------------------------------------------


@query("page_text", f"SELECT page_id, {_sql_page_text('html')} AS body FROM {{pages}}")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return G.page_text(view(spark, sf, "pages"), None).select("page_id", "body")


@query(
    "page_text_cut",
    f"""
SELECT page_id, CASE WHEN len(b) > 12000 THEN substring(b, 1, 12000) || chr(10) || chr(10) || '... (内容截断)' ELSE b END AS body
FROM (SELECT page_id, {_sql_page_text('html')} AS b FROM {{pages}}) x""",
)
def page_text_cut(spark: SparkSession, sf: str) -> DataFrame:
    return G.page_text(view(spark, sf, "pages")).select("page_id", "body")


@query(
    "page_blocks",
    f"SELECT page_id, unnest(range(len(t)))::INTEGER AS pos, unnest(t) AS text FROM (SELECT page_id, {PARAS} AS t FROM {{pages}}) x",
)
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return G.page_blocks(view(spark, sf, "pages"))


@query(
    "page_links",
    f"""
SELECT page_id, pos, {_sql_resolve('href')} AS link FROM (
  SELECT page_id, url, unnest(range(len(a)))::INTEGER AS pos,
    regexp_extract(unnest(a).attrs, 'href="([^"]*)"', 1) AS href
  FROM (SELECT page_id, url, {_sql_elements('html', 'a')} AS a FROM {{pages}}) x) y WHERE href <> ''""",
)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return G.page_links(view(spark, sf, "pages"))


@query("figure_blocks", f"WITH {FIGS} SELECT page_id, \"order\", label, caption, url FROM figs")
def figure_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return G.figure_rows(view(spark, sf, "pages_fig")).drop("reference_text")


@query("figure_reference_text", f"WITH {FIGS} SELECT page_id, label, reference_text FROM figs")
def figure_reference_text(spark: SparkSession, sf: str) -> DataFrame:
    return G.figure_rows(view(spark, sf, "pages_fig")).select("page_id", "label", "reference_text")


def _any(words: tuple[str, ...], e: str) -> str:
    return f"len(list_filter({list(words)}, lambda w: contains({e}, w))) > 0"


@query(
    "best_figure",
    f"""
WITH {FIGS}, r AS (SELECT *, (CASE WHEN "order" = 0 THEN 10.0 ELSE 0.0 END
  + CASE WHEN {_any(html.OVERVIEW_WORDS, 'lower(caption)')} THEN 5.0 ELSE 0.0 END
  + CASE WHEN {_any(html.RESULT_WORDS, 'lower(caption)')} THEN 2.0 ELSE 0.0 END
  - CASE WHEN caption = '' THEN 1.0 ELSE 0.0 END - "order" * 0.01)::DOUBLE AS rank FROM figs)
SELECT page_id, label, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, "order") AS rn FROM r) x
WHERE rn = 1""",
)
def best_figure(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.with_figures(view(spark, sf, "pages_fig"), None).withColumn("best", G.best_figure(F.col("figures")))
    return rows.select("page_id", "best.label", "best.url")


CAPS = """
named AS (SELECT doc_id, page, y0, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM {blocks}),
nums AS (SELECT *, try_cast(regexp_extract(text, '(?i)^\\s*(?:figure|fig\\.?|图)\\s*(\\d+)\\b', 1) AS INTEGER) AS num FROM named),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, num ORDER BY y0, text) AS rn FROM nums
  WHERE num IS NOT NULL) x WHERE rn = 1),
caps AS (SELECT doc_id, page, num, (row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, num) - 1)::INTEGER AS "order",
  'Figure ' || num AS label,
  trim(regexp_replace(text, '(?i)^\\s*(?:figure|fig\\.?|图)\\s*(\\d+)\\b[\\s:.：、,]*', ''), ' ' || chr(9) || chr(10) || chr(13)) AS caption
  FROM firsts)
"""


@query("block_captions", f"WITH {CAPS} SELECT * FROM caps")
def block_captions(spark: SparkSession, sf: str) -> DataFrame:
    return G.block_captions(view(spark, sf, "blocks"))


@query(
    "block_figures",
    f"""
WITH {CAPS}, flat AS (SELECT doc_id, page, y0, {_sql_squeeze('text')} AS text FROM {{blocks}}),
body AS (SELECT * FROM flat WHERE len(text) >= 40 AND regexp_extract(text, '(?i)^\\s*(?:figure|fig\\.?|图)\\s*(\\d+)\\b', 1) = ''),
pick AS (SELECT * FROM (SELECT c.doc_id, c.num, b.text, b.page, b.y0,
    row_number() OVER (PARTITION BY c.doc_id, c.num ORDER BY b.page, b.y0, b.text) AS rn
  FROM (SELECT DISTINCT doc_id, num FROM caps) c JOIN body b ON b.doc_id = c.doc_id
   AND regexp_matches(b.text, '(?i)(?:\\bfig(?:ure)?\\.?\\s*|图\\s*)' || c.num || '\\b')) x WHERE rn <= 3),
refs AS (SELECT doc_id, num, substring(string_agg(text, chr(10) || chr(10) ORDER BY rn), 1, 1500) AS reference_text
  FROM pick GROUP BY doc_id, num)
SELECT caps.*, coalesce(refs.reference_text, '') AS reference_text FROM caps LEFT JOIN refs USING (doc_id, num)""",
)
def block_figures(spark: SparkSession, sf: str) -> DataFrame:
    return G.block_figures(view(spark, sf, "blocks"))


@query("capped_figures", f"WITH {CAPS} SELECT doc_id, \"order\", label FROM caps WHERE \"order\" < 8")
def capped_figures(spark: SparkSession, sf: str) -> DataFrame:
    return G.block_captions(view(spark, sf, "blocks"), G.MAX_FIGURES).select("doc_id", "order", "label")


@query(
    "folded_figures",
    f"WITH {CAPS} SELECT doc_id, string_agg(label || '=' || caption, '|' ORDER BY \"order\") AS figures FROM caps "
    "WHERE \"order\" < 8 GROUP BY doc_id",
)
def folded_figures(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.block_figure_arrays(view(spark, sf, "blocks"))
    pairs = F.transform("figures", lambda f: F.concat(f["label"], F.lit("="), f["caption"]))
    return rows.select("doc_id", F.array_join(pairs, "|").alias("figures"))


@query(
    "figure_source",
    f"""
WITH {FIGS}, {CAPS}
SELECT page_id AS doc_id, label, caption, 'html' AS source FROM figs
UNION ALL SELECT doc_id, label, caption, 'blocks' FROM caps WHERE doc_id NOT IN (SELECT page_id FROM figs)""",
)
def figure_source(spark: SparkSession, sf: str) -> DataFrame:
    from_html = G.figure_rows(view(spark, sf, "pages_fig")).select(
        F.col("page_id").alias("doc_id"), "label", "caption", F.lit("html").alias("source")
    )
    from_blocks = G.block_captions(view(spark, sf, "blocks")).select(
        "doc_id", "label", "caption", F.lit("blocks").alias("source")
    )
    return G.figure_source(from_html, from_blocks, "doc_id")


@query(
    "caption_labels",
    f"""
WITH {FIGS} SELECT page_id, label, {_sql_strip('''CASE WHEN starts_with(caption, label)
  THEN regexp_replace(substr(caption, len(label) + 1), '^[\\s:：.-]+', '') ELSE caption END''')} AS caption FROM figs""",
)
def caption_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.figure_rows(view(spark, sf, "pages_fig"))
    return rows.select("page_id", "label", T.strip_label(F.col("caption"), F.col("label")).alias("caption"))


@query(
    "body_fallback",
    f"""
SELECT p.arxiv_id, coalesce(nullif(h.b, ''), nullif(b.text, ''), p.abstract) AS body,
  CASE WHEN nullif(h.b, '') IS NOT NULL THEN 'page' WHEN nullif(b.text, '') IS NOT NULL THEN 'other' ELSE 'abstract' END AS body_source
FROM {{papers}} p LEFT JOIN (SELECT page_id, {_sql_page_text('html')} AS b FROM {{pages}}) h ON h.page_id = p.doc_id
LEFT JOIN {{benchmark}} b ON b.item_id + 400 = p.doc_id""",
)
def body_fallback(spark: SparkSession, sf: str) -> DataFrame:
    base = papers(spark, sf)
    keys = base.select("doc_id", "arxiv_id")
    bodies = G.page_text(view(spark, sf, "pages"), None).withColumnRenamed("page_id", "doc_id")
    pages = bodies.join(keys, "doc_id").select("arxiv_id", F.col("body").alias("text"))
    other = view(spark, sf, "benchmark").withColumn("doc_id", F.col("item_id") + 400).join(keys, "doc_id")
    return G.with_body(base, pages, other.select("arxiv_id", "text")).select("arxiv_id", "body", "body_source")


SPLIT = (
    "list_filter(list_transform(string_split(regexp_replace({e}, '([。！？.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
    "lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda s: s <> '')"
)
SENTENCES = SPLIT.replace("{e}", "regexp_replace({t}, '\\s+', ' ', 'g')")


@query(
    "sentence_split",
    "SELECT arxiv_id, unnest(range(len(s)))::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT arxiv_id, "
    + SENTENCES.replace("{t}", "abstract")
    + " AS s FROM {papers}) x",
)
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "papers").select(
        "arxiv_id", F.posexplode(T.sentences(F.col("abstract"))).alias("pos", "sentence")
    )


BRIEF = """
(SELECT *, list_filter(string_split(regexp_replace(abstract, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS parts FROM {papers})"""
BRIEF_TEXT = """CASE WHEN len(parts) = 0 THEN substring(trim(abstract, ' ' || chr(9) || chr(10) || chr(13)), 1, 400)
  ELSE trim(array_to_string(parts[1:3], ' '), ' ' || chr(9) || chr(10) || chr(13)) || CASE WHEN len(parts) > 3
    THEN chr(10) || chr(10) || trim(array_to_string(parts[4:6], ' '), ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END END"""


@query("brief_summary", f"SELECT arxiv_id, {BRIEF_TEXT} AS brief_summary FROM {BRIEF} x")
def brief_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.brief_summary(view(spark, sf, "papers")).select("arxiv_id", "brief_summary")


OFFLINE_TASKS = (("the, license；und", "r1"), ("zzzz，qqqq", "r2"), ("Les; QUE", "r3"))


@query(
    "offline_answers",
    "WITH s AS (SELECT arxiv_id, "
    + SENTENCES.replace("{t}", "abstract")
    + """ AS s FROM {papers}),
t AS (SELECT * FROM (VALUES ('the, license；und', ['the', 'license', 'und']), ('zzzz，qqqq', ['zzzz', 'qqqq']),
  ('Les; QUE', ['les', 'que'])) AS t(question, words)),
m AS (SELECT arxiv_id, question, s, list_filter(s, lambda x: len(list_filter(words, lambda w: contains(lower(x), w))) > 0)[1:2] AS hit
  FROM s CROSS JOIN t),
u AS (SELECT *, CASE WHEN len(hit) > 0 THEN hit ELSE s[1:1] END AS used FROM m)
SELECT arxiv_id, question, coalesce(nullif(array_to_string(used, ' '), ''), 'No sufficient information') AS answer,
  least(1.0::DOUBLE, len(used)::DOUBLE * 0.3::DOUBLE + 0.4::DOUBLE) AS confidence FROM u""",
)
def offline_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "papers").withColumn("tasks", R.task_array(OFFLINE_TASKS)).withColumn("body", F.col("abstract"))
    found = R.answers(rows).select("arxiv_id", F.explode("findings").alias("f"))
    return found.select("arxiv_id", "f.question", "f.answer", "f.confidence")


@query(
    "escaped_excerpts",
    """
WITH c AS (SELECT arxiv_id, trim(abstract, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS a FROM {papers}),
k AS (SELECT arxiv_id, CASE WHEN len(a) > 320 THEN rtrim(substring(a, 1, 320), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) || '…'
  ELSE a END AS a FROM c)
SELECT arxiv_id, array_to_string(list_transform(list_filter(list_transform(string_split(a, chr(10) || chr(10)),
    lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda p: p <> ''),
  lambda p: replace(replace(replace(replace(replace(regexp_replace(p, '\\s*\\n\\s*', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
    '"', '&quot;'), '''', '&#x27;')), '<br/><br/>') AS html FROM k""",
)
def escaped_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "papers").select("arxiv_id", T.html_paragraphs(F.col("abstract"), 320).alias("html"))


@query(
    "short_excerpts",
    """
SELECT arxiv_id, CASE WHEN len(abstract) > 140 THEN substring(abstract, 1, 140) || '…' ELSE abstract END AS excerpt,
  trim(abstract, '"'' ') AS unquoted FROM {papers}""",
)
def short_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "papers").select(
        "arxiv_id",
        T.excerpt(F.col("abstract"), 140).alias("excerpt"),
        T.strip_quotes(F.col("abstract")).alias("unquoted"),
    )


@query(
    "language_labels",
    """
SELECT doc_id, CASE WHEN starts_with(lower(lang), 'en') THEN 'en' ELSE 'zh-CN' END AS chrome,
  CASE WHEN starts_with(lower(lang), 'en') THEN 'View details' ELSE '查看详情' END AS button,
  CASE WHEN starts_with(lower(lang), 'en') THEN n_chars || ' papers' ELSE n_chars || ' 篇' END AS badge,
  source AS unknown FROM {documents}""",
)
def language_labels(spark: SparkSession, sf: str) -> DataFrame:
    lang = bilingual.normalise_language(F.col("lang"))
    return view(spark, sf, "documents").select(
        "doc_id",
        lang.alias("chrome"),
        bilingual.label(F.lit("view_details"), lang).alias("button"),
        bilingual.fill_template(bilingual.label(F.lit("papers_badge"), lang), n=F.col("n_chars")).alias("badge"),
        bilingual.label(F.col("source"), lang).alias("unknown"),
    )


@query(
    "tolerant_dates",
    """
SELECT arxiv_id, CASE doc_id % 3 WHEN 0 THEN published || ' 00:00' WHEN 1 THEN published || ' 10:30' ELSE '2024-02-20 06:00' END AS stamp,
  CASE doc_id % 3 WHEN 0 THEN published || ' 00:00' WHEN 1 THEN published || ' 10:30' END AS parsed FROM {papers}""",
)
def tolerant_dates(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(
        "CASE doc_id % 3 WHEN 0 THEN published WHEN 1 THEN concat(published, 'T10:30') ELSE concat('on ', published) END"
    )
    now = F.lit(datetime(2024, 2, 20, 6, 0)).cast("timestamp")
    fmt = "yyyy-MM-dd HH:mm"
    return view(spark, sf, "papers").select(
        "arxiv_id",
        F.date_format(dates.tolerant_timestamp(raw, now), fmt).alias("stamp"),
        F.date_format(dates.parse_date(raw), fmt).alias("parsed"),
    )


ENTRY = """concat('<entry><id>http://arxiv.org/abs/', arxiv_id, 'v2</id><title> ', {title}, ' </title><summary>', {abstract},
  '</summary><published>', published, 'T00:00:00Z</published>',
  CASE WHEN doc_id % 2 = 0 THEN concat('<updated>', published, 'T12:00:00Z</updated>') ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('<author><name>', source, '</name><arxiv:affiliation> ', lang,
    ' </arxiv:affiliation></author><author><name>', lang, '</name><arxiv:affiliation>', lang, '</arxiv:affiliation></author>') END,
  '<category term="', lang, '"/><category term=""/><category term="', source, '"/></entry>')"""


@query(
    "feed_scan",
    """
SELECT arxiv_id, trim(title, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS title,
  trim(abstract, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS abstract,
  CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE source || '|' || lang END AS authors,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS affiliations, lang || '|' || source AS categories,
  published || ' 00' AS published, CASE WHEN doc_id % 2 = 0 THEN published || ' 12' ELSE published || ' 00' END AS updated,
  'https://arxiv.org/abs/' || arxiv_id AS arxiv_url FROM {papers}""",
)
def feed_scan(spark: SparkSession, sf: str) -> DataFrame:
    safe = {c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')" for c in ("title", "abstract")}
    xml = view(spark, sf, "papers").select(F.expr(ENTRY.format(**safe)).alias("xml"))
    rows = feed.normalise(feed.parse_entries(xml), datetime(2024, 2, 20))
    return rows.select(
        "arxiv_id",
        "title",
        "abstract",
        *[F.array_join(c, "|").alias(c) for c in ("authors", "affiliations", "categories")],
        *[F.date_format(c, "yyyy-MM-dd HH").alias(c) for c in ("published", "updated")],
        "arxiv_url",
    )
