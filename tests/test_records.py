"""Replies, records, sources, sinks and the whole run."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.config import Topic, TriageConfig
from paperloom.operators import analyses as A, digest as D, figures as G, prompts as P, replies as R, views as V
from paperloom.plans import triage
from paperloom.session import shared_dir
from paperloom.sources import feed, records, sinks
from tests.test_selection import SCHEMA, T0

FIGS = "array<struct<order:int,label:string,caption:string,url:string,reference_text:string>>"
NOW = datetime(2024, 3, 1, 6, 0, 0)


def paper(spark, figures=(), **kw):
    row = {"arxiv_id": "p", "title": "T", "abstract": "A one. B two.", "interest_prompt": "x", **kw}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    made = F.array(
        *[
            F.struct(
                F.lit(i).alias("order"), F.lit(label).alias("label"), F.lit(caption).alias("caption"),
                F.lit("u").alias("url"), F.lit("r").alias("reference_text"),
            )
            for i, (label, caption) in enumerate(figures)
        ]
    )
    return df.withColumn("figures", made.cast(FIGS)).withColumn("body", F.col("abstract"))


def reply(spark, text, **keys):
    row = {"arxiv_id": "p", **keys, "reply": text}
    kinds = {"pos": "int"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))


def test_core_without_reply_drops_all_figures(spark):
    row = R.core(paper(spark, [("Figure 1", "c")])).first()
    assert row.core_summary is None and row.figures == []


@pytest.mark.parametrize(
    "assignments, kept",
    [
        ('{"fig_0":"METHODOLOGY","fig_1":"experiments"}', [("Figure 1", "methodology")]),
        ('{"fig_1":"problem"}', [("Figure 2", "problem")]),
        ('["problem"]', []),
        ('{"fig_0":"what"}', []),
    ],
)
def test_figure_stages(spark, assignments, kept):
    rows = paper(spark, [("Figure 1", "c"), ("Figure 2", "d")])
    got = R.core(rows, reply(spark, '{"problem":" p ","figure_assignments":%s}' % assignments)).first()
    assert got.core_summary.problem == "p" and got.core_summary.conclusion == R.NO_INFORMATION
    assert [(f.label, f.stage) for f in got.figures] == kept


@pytest.mark.parametrize(
    "text, questions",
    [
        ('{"questions":[{"question":"a","reason":""},{"question":" "}]}', [("a", R.DEFAULT_REASON)]),
        ('{"questions":[{"question":"a"},5]}', list(R.GENERIC_QUESTIONS)),
        ('{"questions":"a"}', list(R.GENERIC_QUESTIONS)),
        ("nothing", list(R.GENERIC_QUESTIONS)),
        ('{"questions":[%s]}' % ",".join('{"question":"q%d","reason":"r"}' % i for i in range(7)), [(f"q{i}", "r") for i in range(5)]),
    ],
)
def test_questions(spark, text, questions):
    got = R.questions(paper(spark), reply(spark, text)).first()
    assert [tuple(t) for t in got.tasks] == questions


def test_no_interest_means_general_questions(spark):
    got = R.questions(paper(spark, interest_prompt=""), reply(spark, '{"questions":[{"question":"a"}]}')).first()
    assert [tuple(t) for t in got.tasks] == list(R.GENERIC_QUESTIONS)


def test_reading_tasks(spark):
    given = '{"todos":[{"question":" a "},{"question":""},{"question":"c","reason":"r"}]}'
    got = R.reading_tasks(paper(spark), reply(spark, given), 5).first()
    assert [tuple(t) for t in got.reading_tasks] == [("a", ""), ("c", "r")]
    got = R.reading_tasks(paper(spark), reply(spark, '{"todos":{}}'), 2).first()
    assert [tuple(t) for t in got.reading_tasks] == list(R.DEFAULT_TASKS[:2])


@pytest.mark.parametrize(
    "body, answer, sure",
    [
        ("X y. A z. B z. C z.", "A z. B z.", 1.0),
        ("X y. Only a here.", "Only a here.", 0.7),
        ("Xy. Zy.", "Xy.", 0.7),
        ("", R.NO_OFFLINE_ANSWER, 0.4),
    ],
)
def test_offline_answers(spark, body, answer, sure):
    rows = paper(spark).withColumn("body", F.lit(body)).withColumn("tasks", R.task_array([("a, b ；c", "r")]))
    (got,) = R.answers(rows).first().findings
    assert (got.answer, got.confidence) == (answer, pytest.approx(sure))


@pytest.mark.parametrize(
    "text, answer, sure",
    [
        ('{"answer":" a ","confidence":2}', "a", 1.0),
        ('{"confidence":-1}', R.NO_ANSWER, 0.0),
        ('{"answer":"a"}', "a", 0.5),
        ('{"answer":"a","confidence":"much"}', "A one.", 0.7),
        ("broken", "A one.", 0.7),
    ],
)
def test_answer_replies(spark, text, answer, sure):
    rows = paper(spark).withColumn("tasks", R.task_array([("zzz", "r")]))
    (got,) = R.answers(rows, reply(spark, text, pos=0)).first().findings
    assert (got.answer, got.confidence) == (answer, pytest.approx(sure))


def test_short_texts(spark):
    rows = R.core(paper(spark), reply(spark, '{"conclusion":"own"}'))
    assert R.findings_summary(rows).first().core_summary.conclusion == "own"
    assert R.findings_summary(rows, reply(spark, " new ")).first().core_summary.conclusion == "new"
    blank = R.core(paper(spark), reply(spark, '{"conclusion":" "}'))
    assert R.findings_summary(blank, reply(spark, " ")).first().core_summary.conclusion == "A one. B two."
    assert R.brief_summary(rows, reply(spark, "  ")).first().brief_summary == "A one. B two."
    assert R.relevance_note(rows, reply(spark, ' "why" ')).first().relevance == "why"
    assert R.relevance_note(rows, reply(spark, ' "" ')).first().relevance == R.NOTE_WITH_INTEREST
    assert R.relevance_note(paper(spark, interest_prompt="")).first().relevance == R.NOTE_WITHOUT_INTEREST


def _translated(spark, figures, captions, findings="[]"):
    rows = R.brief_summary(paper(spark, figures)).withColumn("relevance", F.lit("n"))
    rows = rows.withColumn("figures", F.transform("figures", lambda f: f.withField("stage", F.lit("problem"))))
    rows = R.core(rows.drop("stage"), reply(spark, '{"figure_assignments":{"fig_0":"problem","fig_1":"problem"}}'))
    rows = R.answers(rows.withColumn("tasks", R.task_array([("q1", "r1"), ("q2", "r2")])))
    done = R.translation(rows, reply(spark, '{"figure_captions":%s,"findings":%s}' % (captions, findings)))
    return done.select(
        A.merge_captions(F.col("figures"), F.col("tr.figure_captions")).alias("figs"),
        A.merge_findings(F.col("findings"), F.col("tr.findings")).alias("qa"),
    ).first()


def test_one_blank_caption_turns_all_back(spark):
    two = [("Figure 1", "a"), ("Figure 2", "")]
    assert [f.caption.zh for f in _translated(spark, two, '["甲"]').figs] == ["a", ""]
    assert [f.caption.zh for f in _translated(spark, two, '["甲","乙"]').figs] == ["a", ""]
    both = [("Figure 1", "a"), ("Figure 2", "b")]
    assert [f.caption.zh for f in _translated(spark, both, '["甲","乙"]').figs] == ["甲", "乙"]
    assert [f.caption.zh for f in _translated(spark, both, '["甲",""]').figs] == ["甲", "b"]
    assert [f.caption.zh for f in _translated(spark, both, '["甲"]').figs] == ["a", "b"]


@pytest.mark.parametrize(
    "findings, questions",
    [
        ('[{"question":"问","reason":null}]', ["问", "q2"]),
        ("null", ["q1", "q2"]),
        ('"x"', ["q1", "q2"]),
        ('[{"question":""},{"question":"二"}]', ["q1", "二"]),
    ],
)
def test_findings_merge_by_position(spark, findings, questions):
    got = _translated(spark, [], "[]", findings)
    assert [q.question.zh for q in got.qa] == questions
    assert [q.reason.zh for q in got.qa] == ["r1", "r2"]


def test_no_translation_for_english_readers(spark):
    assert R.translation(paper(spark), reply(spark, "{}"), "en-GB").first().tr is None
    rows = paper(spark).withColumn("findings", R.task_array([("q", "r")])).withColumn("brief_summary", F.lit("b"))
    rows = rows.withColumn("relevance", F.lit("n")).withColumn("core_summary", F.lit(None).cast("struct<problem:string>"))
    rows = rows.withColumn("findings", F.transform("findings", lambda f: f.withField("answer", F.lit("a"))))
    assert P.translate(rows, "EN").count() == 0
    prompt = P.translate(rows, "zh").first()
    assert "Simplified Chinese" in prompt.system and json.loads(prompt.user)["findings"][0]["answer"] == "a"


def test_retry_prompt(spark):
    rows = spark.createDataFrame([("p", "s", False), ("q", None, False), ("r", "s", True)], "arxiv_id string, system string, ok boolean")
    got = {r.arxiv_id: r.system for r in P.retry(rows, F.col("ok")).collect()}
    assert got == {"p": "s\n\n" + P.JSON_HINT, "q": P.JSON_HINT}


def test_profile_limits(spark):
    text = json.dumps({"summary": "s" * 400, "research_questions": list("abcdefgh"), "anti_keywords": None})
    rows = paper(spark).select("arxiv_id", F.lit(" likes ").alias("interest_prompt"))
    replies = spark.createDataFrame([("likes", text)], "prompt_key string, reply string")
    got = R.interest_profiles(rows, replies).first().profile
    assert (len(got.summary), got.research_questions, got.anti_keywords) == (300, list("abcdef"), [])
    assert R.interest_profiles(rows).first().profile.summary == "likes"


# --- sources and sinks -------------------------------------------------------------------

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<title>feed</title>
<entry><id>http://arxiv.org/abs/2401.00001v2</id><title> A
 title </title><summary>x &amp; y</summary><published>2024-01-02T03:04:05Z</published><updated>2024-01-03T00:00:00Z</updated>
<author><name>N1</name><arxiv:affiliation> U </arxiv:affiliation></author><author><name>N2</name><arxiv:affiliation>U</arxiv:affiliation></author>
<category term="cs.SE"/><category term=""/><arxiv:comment> 9 pages </arxiv:comment></entry>
<entry><id>http://arxiv.org/abs/2401.00002v1</id><title>B</title><summary/><published>soon</published><category term="cs.AI"/></entry>
<entry><title>no id</title></entry></feed>"""


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(ATOM)
    got = {r.arxiv_id: r for r in feed.read_feed(spark, str(tmp_path / "feed.xml"), NOW).collect()}
    assert set(got) == {"2401.00001", "2401.00002"}
    a, b = got["2401.00001"], got["2401.00002"]
    assert (a.title, a.abstract, a.authors, a.affiliations) == ("A\n title", "x & y", ["N1", "N2"], ["U"])
    assert (a.categories, a.comment, a.published) == (["cs.SE"], "9 pages", datetime(2024, 1, 2, 3, 4, 5))
    assert a.pdf_url == "https://arxiv.org/pdf/2401.00001.pdf"
    assert (b.authors, b.affiliations, b.published, b.updated) == (["Unknown"], [], NOW, NOW)


def test_mixed_records_and_bad_files(spark, tmp_path):
    docs = {
        "old": {"arxiv_id": "1", "title": "plain", "figure": {"label": "F", "caption": {"en": "c", "zh": "c"}, "url": "u", "reference_text": ""}, "score": 60},
        "new": {"arxiv_id": "2", "title": {"en": "e", "zh": "中"}, "figures": [], "figure": None, "score": 61.5},
        "half": {"arxiv_id": "3", "title": {"en": "only"}},
        "none": {"arxiv_id": "4", "title": None},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1))
    (tmp_path / "bad.json").write_text("{oops")
    got = {r.arxiv_id: r for r in records.read_analyses(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert (tuple(got["1"].title), tuple(got["2"].title), got["4"].title) == (("plain", "plain"), ("e", "中"), None)
    assert got["3"].title.zh is None and got["1"].figures is None and got["2"].figures == []
    assert got["1"].score == 60.0 and got["1"].figure.label == "F"
    assert records.unreadable(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception):
        records.read_analyses(spark, str(tmp_path), strict=True).collect()
    shown = records.read_analyses(spark, str(tmp_path)).select(
        "arxiv_id", A.figures_or_legacy(F.col("figures"), F.col("figure")).alias("f")
    )
    assert {r.arxiv_id: [x.stage for x in r.f] for r in shown.collect()}["1"] == ["methodology"]


def test_store_keeps_newest_and_ignores_unfinished_parts(spark):
    path = shared_dir(spark, "store")
    rows = lambda *r: spark.createDataFrame(r, "arxiv_id string, v int")
    assert sinks.current(spark, path) is None
    assert sinks.append(rows(("a", 1), ("b", 1)), path) == 0
    assert sinks.append(rows(("b", 2), ("c", 2)), path) == 1
    want = {("a", 1), ("b", 2), ("c", 2)}
    assert {tuple(r) for r in sinks.current(spark, path).collect()} == want
    assert sinks.compact(spark, path) == 1
    assert {tuple(r) for r in sinks.current(spark, path).collect()} == want
    # a part without its commit marker does not count
    rows(("a", 9)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/delta=2")
    assert {tuple(r) for r in sinks.current(spark, path).collect()} == want
    assert sinks.append(rows(("a", 3)), path) == 2
    assert {tuple(r) for r in sinks.current(spark, path).collect()} == {("a", 3), ("b", 2), ("c", 2)}


PAGE = (
    '<p>As Figure 1 shows, alpha drives the whole of the pipeline here.</p><figure class="ltx_figure"><img src="f.png">'
    '<figcaption><span class="ltx_tag">Figure 1: </span>Overview</figcaption></figure>'
)


def test_whole_run(spark):
    topics = (Topic("t0", "Alpha", include=("alpha",), interest_prompt="alpha"), Topic("t1", "Beta", include=("beta",)))
    conf = TriageConfig(topics=topics, max_per_topic=5, days_back=99, site_base_url="https://s", pass_threshold=40)
    day = lambda n: T0 + timedelta(days=n)
    data = [
        (f"2401.0000{i}", f"{w} paper", f"{w} first. Second.", list("abcdefgh"), ["U", "V"], ["cs"], day(i), day(i), "u", None, None)
        for i, w in enumerate(["alpha", "beta", "alpha beta", "gamma"])
    ]
    papers = spark.createDataFrame(data, SCHEMA)
    pages = spark.createDataFrame([("2401.00000", "http://h/x", PAGE)], "arxiv_id string, url string, html string")
    core = reply(spark, '{"problem":"P","figure_assignments":{"fig_0":"methodology"}}').withColumn("arxiv_id", F.lit("2401.00000"))
    zh = reply(spark, '{"title":"题"}').withColumn("arxiv_id", F.lit("2401.00000"))
    chosen = triage.select(papers, conf, NOW.replace(month=2))
    done = triage.analyse(chosen, conf, pages, None, {"core": core, "translate": zh})
    path = shared_dir(spark, "run")
    stored = {r.arxiv_id: r for r in triage.publish(done, path, conf, "m", NOW).collect()}
    assert {k: v.topic for k, v in stored.items()} == {"2401.00000": "t0", "2401.00001": "t1", "2401.00002": "t0"}
    a = stored["2401.00000"]
    assert (a.title.en, a.title.zh, a.core_summary.problem.en, a.figure.label) == ("alpha paper", "题", "P", "Figure 1")
    assert a.figures[0].url == "http://h/f.png" and a.figures[0].reference_text.startswith("As Figure 1")
    assert stored["2401.00001"].core_summary is None and a.generated_at == "2024-03-01T06:00:00Z" and a.markdown == ""
    index = sinks.read_index(spark, f"{path}/index").collect()
    assert [r.arxiv_id for r in index] == ["2401.00002", "2401.00001", "2401.00000"] and len(index[0].authors) == 6
    page = "".join(r.value for r in spark.read.text(f"{path}/digest/*").collect())
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</html>")
    assert page.index("Alpha") < page.index("2401.00002") < page.index("2401.00000") < page.index("Beta")
    assert "a, b, c et al. · U +1" in page and "3 篇论文" in page
    # a second run on the same papers replaces records, and the manifest stops it
    again = triage.select(papers, conf, NOW.replace(month=2), manifest=sinks.current(spark, f"{path}/analyses"))
    assert again.count() == 0
    later = triage.publish(done, path, conf, "m2", NOW + timedelta(days=1))
    assert later.count() == 3 and {r.model for r in later.collect()} == {"m2"}
    payload = json.loads(A.payload_json(later).where("arxiv_id = '2401.00001'").first().json)
    assert set(payload) == set(records.RECORD_FIELDS) | {"title"} and payload["core_summary"] is None
    flags = A.availability(later, "zh").where("arxiv_id = '2401.00000'").first()
    assert flags.sections == ["relevance", "brief", "core", *[f"core-{x}" for x in P.ASPECTS], "qa"]
    report = D.report_markdown(done, NOW).where("arxiv_id = '2401.00000'").first().report
    assert "# alpha paper" in report and D.CORE_HEADING in report and "*Generated at 2024-03-01 06:00 UTC*" in report


def test_empty_digest(spark):
    none = spark.createDataFrame([], "arxiv_id string").limit(0)
    cols = ["topic_label", "arxiv_url"]
    empty = none.select("arxiv_id", F.lit(0).alias("pos"), F.lit(1.0).alias("score"), *[F.lit("").alias(c) for c in cols])
    empty = empty.withColumns(
        {
            "title": A.bi(F.lit("")), "relevance": A.bi(F.lit("")), "brief_summary": A.bi(F.lit("")),
            "authors": F.array(F.lit("")), "affiliations": F.array(F.lit("")),
        }
    )
    page = [r.html for r in D.digest_lines(empty, "en", NOW).orderBy("part", "first_pos", "pos").collect()]
    assert len(page) == 2 and "nothing to digest" in page[0] and "Paper weekly - 2024-03-01 (0 papers)" in page[0]


def test_facets_sort_like_a_dictionary(spark):
    rows = spark.createDataFrame(
        [("p1", "t1", "b", "1"), ("p2", "t2", "A", "1"), ("p3", "t3", "a", "1"), ("p4", "t4", "B", "1"), ("p5", "", "x", "1"),
         ("p6", "t1", "renamed", "0")],
        "arxiv_id string, topic string, topic_label string, generated_at string",
    )
    assert [(r.label, r.n) for r in V.facets_sorted(rows).collect()] == [("a", 1), ("A", 1), ("b", 2), ("B", 1)]


def test_week_and_range_edge_cases(spark):
    rows = spark.createDataFrame(
        [("a", "2024-02-23T06:00:00Z", None), ("b", "2024-02-23T05:59:59Z", ""), ("c", None, None), ("d", "x", None)],
        "arxiv_id string, generated_at string, published string",
    )
    assert [r.arxiv_id for r in V.this_week(rows, NOW).collect()] == ["a"]
    assert tuple(V.date_range(rows).first()) == (None, None, 4, "")


def test_block_figures(spark):
    rows = [
        (1, 0, 5.0, "Figure 2: Second"), (1, 0, 1.0, "Figure 1. First part"), (1, 0, 2.0, "Fig. 1 again"),
        (1, 1, 0.0, "Figure 1: next page"), (1, 1, 3.0, "As Fig. 1 tells, this block is long enough to count."),
        (1, 2, 0.0, "short Fig. 1"), (2, 0, 0.0, "no caption"),
    ]
    blocks = spark.createDataFrame(rows, "doc_id bigint, page int, y0 double, text string")
    got = G.block_figures(blocks).orderBy("order").collect()
    assert [(r.order, r.page, r.label, r.caption) for r in got] == [
        (0, 0, "Figure 1", "First part"), (1, 0, "Figure 2", "Second"), (2, 1, "Figure 1", "next page"),
    ]
    assert [bool(r.reference_text) for r in got] == [True, False, True]


def test_blocks_give_figures_where_a_page_has_none(spark):
    conf = TriageConfig(topics=(Topic("t0", include=("alpha",)),), days_back=999, pass_threshold=0)
    rows = [(i, "alpha", "alpha.", ["a"], [], ["cs"], T0, T0, "u", None, None) for i in ("p", "q", "r")]
    chosen = triage.select(spark.createDataFrame(rows, SCHEMA), conf, NOW)
    pages = spark.createDataFrame([("p", "http://h/x", PAGE)], "arxiv_id string, url string, html string")
    blocks = spark.createDataFrame(
        [(i, 0, float(n), f"Figure {n}: c{n}") for i in ("p", "q") for n in range(1, 11)],
        "arxiv_id string, page int, y0 double, text string",
    )
    stages = {f"fig_{i}": "problem" for i in range(9)}
    core = spark.createDataFrame([(i, json.dumps({"figure_assignments": stages})) for i in "pqr"], "arxiv_id string, reply string")
    done = triage.analyse(chosen, conf, pages, None, {"core": core}, blocks)
    got = {r.arxiv_id: [f.caption for f in r.figures] for r in done.collect()}
    assert got == {"p": ["Figure 1: Overview"], "q": [f"c{n}" for n in range(1, 9)], "r": []}
    assert {r.body for r in done.collect()} == {"alpha.", "As Figure 1 shows, alpha drives the whole of the pipeline here.\n\nFigure 1: Overview"}


def test_date_filters_reach_the_scan(spark):
    from paperloom.operators import candidates as C

    path = shared_dir(spark, "papers")
    rows = [("p", "alpha", "alpha", ["a"], [], ["cs"], T0, T0, "u", None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    table = spark.read.parquet(path)
    for df in (C.recent(table, NOW, 7), C.window_candidates(table, T0, NOW, 7)):
        narrow = C.topic_candidates(df, (Topic("t", include=("alpha",)),)).select("arxiv_id", "topic_idx")
        plan = narrow._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(published" in plan
        read = plan[plan.index("ReadSchema") :]
        assert "pdf_url" not in read and "abstract" in read
        assert "Join" not in plan and "Exchange" not in plan


def test_hot_groups_are_cut_before_the_shuffle(spark):
    from paperloom.operators import candidates as C

    rows = spark.createDataFrame([("p", "x", "x", ["a"], [], ["cs"], T0, T0, "u", None, None)], SCHEMA)
    found = C.top_recent(C.single_window(C.topic_candidates(rows, (Topic("t", include=("x",)),))), 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.rindex("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[first_exchange:] and "Partial" in plan[first_exchange:]
    latest = A.latest(rows.select("arxiv_id", F.lit("1").alias("generated_at")))
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.rindex("Exchange hashpartitioning") :]


def test_the_newest_reply_stands(spark):
    from paperloom.operators.replies import one_reply

    rows = [("p", "{\"x\": \"old\"}", 1, 1), ("p", "{\"a\": \"new\"}", 2, 1), ("p", "{\"b\": 0}", 2, 0), ("q", "z", 1, 1)]
    table = spark.createDataFrame(rows, "arxiv_id string, reply string, replied_at long, attempt int")
    assert dict(one_reply(table, "arxiv_id").collect()) == {"p": "{\"a\": \"new\"}", "q": "z"}
    assert dict(one_reply(table.drop("replied_at", "attempt"), "arxiv_id").collect())["p"] == "{\"x\": \"old\"}"


def test_entities_are_decoded_once(one):
    from paperloom.functions import html

    assert one(html.unescape(F.lit("a &#38;lt; b &lt;&amp;lt; &#x41;&bogus; & c"))) == "a &lt; b <&lt; A&bogus; & c"


def test_configured_length_reaches_the_prompts(spark):
    words = "word " * 4000
    page = f"<html><body><p>{words}end.</p></body></html>"
    pages = spark.createDataFrame([("p", "http://h/x", page)], "arxiv_id string, url string, html string")
    conf = TriageConfig(topics=(Topic("t", "T"),), max_content_chars=7)
    read = G.page_text(pages, conf.page_chars).first().body
    assert read.endswith("end.")  # pages are read whole
    task = F.struct(F.lit("Q?").alias("question"), F.lit("R").alias("reason"))
    done = paper(spark).withColumn("body", F.lit(read)).withColumn("tasks", F.array(task))
    asked = triage.body_prompts(done, conf)
    assert asked["core"].first().user.endswith("Content: word wo")
    assert {r.user.rpartition("Content: ")[2] for r in asked["answer"].collect()} == {"word wo"}
