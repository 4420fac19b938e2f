"""Column functions on hand-made values."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.functions import bilingual, dates, html, ids, replies, scoring, text

L = F.lit


@pytest.mark.parametrize(
    "raw, feed, typed, found",
    [
        ("2401.12345v2", "2401.12345", "2401.12345", "2401.12345"),
        ("arXiv:2401.12345", "arXi", "arXiv:2401.12345", "2401.12345"),
        ("https://arxiv.org/abs/2401.12345v3", "2401.12345", "https://arxiv.org/abs/2401.12345", "2401.12345"),
        ("https://arxiv.org/pdf/2401.12345.pdf", "2401.12345.pdf", "https://arxiv.org/pdf/2401.12345.pdf", "2401.12345"),
        ("cs.SE/9901001v1", "9901001", "cs.SE/9901001", "cs.SE/9901001"),
        ("solv-int/9901001v1", "9901001", "solv-int/9901001", "solv-int/9901001"),
        ("   ", "   ", "", None),
    ],
)
def test_ids(one, raw, feed, typed, found):
    assert one(ids.feed_id(L(raw))) == feed
    assert one(ids.typed_id(L(raw))) == typed
    assert one(ids.find_id(text.strip(L(raw)))) == found


def test_links(one):
    assert one(ids.page_link("https://s/", L("1.2"), L(None))) == "https://s/papers/1.2"
    assert one(ids.page_link("", L("1.2"), L("u"))) == "u"
    assert one(ids.page_link("", L("1.2"), L(""))) == "#"


@pytest.mark.parametrize(
    "raw, parts",
    [
        ("一。二！ 三？\n四", ["一。二！", "三？", "四"]),
        ("no stop", ["no stop"]),
        ("a.   b!  c", ["a.", "b!", "c"]),
        ("", []),
        (" \n ", []),
    ],
)
def test_sentences(one, raw, parts):
    assert one(text.sentences(L(raw))) == parts


def test_truncation(one):
    assert one(text.truncate(L("abcd"), 4)) == "abcd"
    assert one(text.truncate(L("abcde"), 4)) == "abcd\n\n... (内容截断)"
    assert one(text.excerpt(L("ab😀cd"), 3)) == "ab😀…"
    assert one(text.html_paragraphs(L("abc   defgh"), 5)) == "abc…"
    assert one(text.html_paragraphs(L("  "), 5)) == ""


def test_escape_and_paragraphs(one):
    assert one(text.escape_html(L("a & b < \"c\" 'd' &amp;"))) == "a &amp; b &lt; &quot;c&quot; &#x27;d&#x27; &amp;amp;"
    assert one(text.html_paragraphs(L("a <b>\n c\n\n\n\nd"), 100)) == "a &lt;b&gt; c<br/><br/>d"


def test_brief(one):
    assert one(text.brief_from_abstract(L("A. B. C. D. E. F. G."))) == "A. B. C.\n\nD. E. F."
    assert one(text.brief_from_abstract(L("A. B."))) == "A. B."
    assert one(text.brief_from_abstract(L("   "))) == ""


def test_byline(one):
    four, none = F.array(*map(L, "abcd")), F.array().cast("array<string>")
    assert one(text.byline(four, F.array(L("X"), L("Y"), L("Z")))) == "a, b, c et al. · X +2"
    assert one(text.byline(F.array(L("a")), none)) == "a"
    assert one(text.byline(none, F.array(L("X")))) == "X"
    assert one(text.byline(none, none)) == ""


def test_label_strip(one):
    assert one(text.strip_label(L(" Figure 1: - Flow "), L("Figure 1"))) == "Flow"
    assert one(text.strip_label(L("Flow Figure 1"), L("Figure 1"))) == "Flow Figure 1"


def test_windows(one):
    def split(a, b, n):
        rows = one(dates.split_windows(L(a).cast("timestamp"), L(b).cast("timestamp"), n))
        return [(r.window_idx, r.win_start, r.win_end) for r in rows]

    d = lambda n: datetime(2024, 1, n)
    assert split(d(1), d(11), 7) == [(0, d(1), d(8)), (1, d(8), d(11))]
    assert split(d(1), d(15), 7) == [(0, d(1), d(8)), (1, d(8), d(15))]
    assert split(d(1), d(2), 7) == [(0, d(1), d(2))]
    assert split(d(1), d(1), 7) == [(0, d(1), d(1))]
    assert split(d(5), d(1), 7) == [(0, d(5), d(1))]


@pytest.mark.parametrize("days, span", [(7, 30), (7, 28), (1, 3), (40, 30), (3, 0)])
def test_windows_by_arithmetic_equal_the_list(spark, days, span):
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 1) + timedelta(days=span)
    times = [start + timedelta(hours=h) for h in range(0, span * 24 + 1, 6)] + [start + timedelta(microseconds=1)] * (span > 0)
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    listed = dates.split_windows(dates.instant(start), dates.instant(end), days)
    want = F.filter(listed, lambda w: F.col("t").between(w["win_start"], w["win_end"]))
    rows = df.select("t", want.alias("want"), dates.windows_at(F.col("t"), start, end, days).alias("got")).collect()
    assert rows and all(r.want and r.want == r.got for r in rows)


def test_dates(one):
    now = L(datetime(2024, 5, 1)).cast("timestamp")
    assert one(dates.tolerant_timestamp(L("2024-01-02T03:04:05Z"), now)) == datetime(2024, 1, 2, 3, 4, 5)
    assert one(dates.tolerant_timestamp(L("soon"), now)) == datetime(2024, 5, 1)
    assert one(dates.parse_date(L("2024-01-02T03:04"))) == datetime(2024, 1, 2, 3, 4)
    assert one(dates.parse_date(L("02.01.2024"))) is None
    assert one(dates.compact(L(datetime(2024, 1, 2, 3, 4)))) == "202401020304"
    assert one(dates.range_label(L("a"), L("a"))) == "（a）"
    assert one(dates.range_label(L("a"), L("b"))) == "（a — b）"
    assert one(dates.range_label(L(None), L("b"))) == ""


@pytest.mark.parametrize(
    "reply, value",
    [
        ('{"a":1}', "1"),
        ('```json\n{"a":1}\n```', "1"),
        ('```\n{"a":1}```', "1"),
        ('Well: {"a":1} ok', "1"),
        ('{"a":1} trailing', "1"),
        ('{"a":1} and {"a":2}', None),
        ('{"a":1},{"a":2}', None),
        ('{"a":1}] x', "1"),
        ("[1]", None),
        ('[{"a":1}]', None),
        ("{broken", None),
        ("null", None),
        (None, None),
    ],
)
def test_loose_json(one, reply, value):
    doc = replies.loose_json(L(reply).cast("string"))
    assert one(F.try_variant_get(doc, "$.a", "string")) == value
    assert one(doc.isNotNull()) == (value is not None)


def test_empty_reply_is_empty_object(one):
    assert one(replies.loose_json(L("")).isNotNull())
    assert not one(replies.loose_json(L("  ")).isNotNull())


@pytest.mark.parametrize(
    "part, value, usable",
    [
        ('{"score":120}', 1.0, True),
        ('{"score":-5}', 0.0, True),
        ('{"score":"85"}', 0.85, True),
        ("{}", 0.0, True),
        (None, 0.0, True),
        ("7", 0.0, False),
        ('{"score":"high"}', 0.0, False),
        ("null", 0.0, False),
    ],
)
def test_reply_score(one, part, value, usable):
    doc = F.parse_json(L("{}" if part is None else '{"novelty":%s}' % part))
    got = one(replies.reply_score(doc, "novelty"))
    assert (got.value, got.usable) == (value, usable)


def test_stage(one):
    table = F.create_map(L("fig_0"), L(" Methodology "), L("fig_1"), L("weird"))
    assert one(replies.stage_of(table, L("fig_0"))) == "methodology"
    assert one(replies.stage_of(table, L("fig_1"))) == "none"
    assert one(replies.stage_of(table, L("fig_2"))) == "none"
    assert one(replies.stage_of(L(None).cast("map<string,string>"), L("fig_0"))) == "none"


def test_keyword_score(one):
    none = F.array().cast("array<string>")
    assert one(scoring.keyword_score(none, L("x"))) == 0.5
    assert one(scoring.keyword_score(F.array(L("New"), L("old")), L("a renewal"))) == 0.5
    assert one(scoring.hint_score(("a", "b", "c", "d"), L("abcd"))) == 1.0
    assert one(scoring.hint_score(scoring.NOVELTY_WORDS, L("a novel first"))) == 2 / 3


def _scores(*pairs):
    return F.array(
        *[F.struct(L(n).alias("name"), L(w).alias("weight"), L(v).alias("value")) for n, w, v in pairs]
    )


def test_threshold_is_inclusive(one):
    exact = _scores(("a", 0.35, 0.6), ("b", 0.25, 0.6), ("c", 0.2, 0.6), ("d", 0.2, 0.6))
    total = ((0.0 + 0.35 * 0.6) + 0.25 * 0.6 + 0.2 * 0.6) + 0.2 * 0.6
    weight = 0.35 + 0.25 + 0.2 + 0.2
    assert one(scoring.normalised_score(exact)) == total / weight * 100
    half = _scores(("a", 0.5, 1.0), ("b", 0.5, 0.2))
    assert one(scoring.normalised_score(half)) == 60.0
    assert one(scoring.passes(half, 60))
    assert not one(scoring.passes(_scores(("a", 0.5, 1.0), ("b", 0.5, 0.1999)), 60))


def test_zero_weight(one):
    assert one(scoring.normalised_score(_scores(("a", 0.0, 1.0)))) == 0.0


def test_top_dimension_takes_first_on_tie(one):
    assert one(scoring.top_dimension(_scores(("a", 0.2, 0.5), ("b", 0.2, 0.5), ("c", 0.1, 0.5)))).name == "a"


def test_decimals(one):
    assert one(scoring.one_decimal(L(67.25))) == "67.2"
    assert one(scoring.one_decimal(L(60.0))) == "60.0"
    assert one(scoring.two_decimals(L(0.7))) == "0.70"


def test_bilingual(one):
    assert tuple(one(bilingual.bi(L("a"), L("")))) == ("a", "a")
    assert tuple(one(bilingual.bi(L(None).cast("string")))) == ("", "")
    pair = F.struct(L("a").alias("en"), L("").alias("zh"))
    assert one(bilingual.pick(pair, "zh")) == "a"
    doc = lambda s: F.parse_json(L(s))
    assert tuple(one(bilingual.bi_from_variant(doc('{"t":"x"}'), "$.t"))) == ("x", "x")
    assert tuple(one(bilingual.bi_from_variant(doc('{"t":{"en":"x"}}'), "$.t"))) == ("x", None)
    assert one(bilingual.bi_from_variant(doc('{"t":null}'), "$.t")) is None
    assert one(bilingual.normalise_language(L("EN-us"))) == "en"
    assert one(bilingual.normalise_language(L("fr"))) == "zh-CN"
    assert one(bilingual.label(L("nope"), L("en"))) == "nope"
    assert one(bilingual.content(L("e"), L(""), L("zh"))) == "e"


PAGE = """<html><head><title>t</title></head><body><!-- <p>no</p> --><script>var x="</p>"</script>
<nav>menu</nav><h1>Head &amp; tail</h1><p>One<br>two &#8217;&#x4e2d;&lt;</p><p>See Fig. 12, which is not the figure wanted here at all.</p>
<p class="a">The flow of Fig. 2 is described at some length in this text.<p>An unclosed one that follows, citing figure 2 and Figure 1 as well.
<figure class="ltx_figure"><img alt="n"></figure>
<figure class='x ltx_figure'><img src='a/b.png'><figcaption><span class="ltx_tag">Figure 2：</span> The &quot;flow&quot;</figcaption></figure>
<figure><img src="/plain.png"/></figure></body></html>"""


def test_page_text(one):
    got = one(html.page_text(L(PAGE)))
    assert "no" not in got.split("\n")[0] and "menu" not in got and "var x" not in got
    assert got.startswith("Head & tail")
    assert "One\ntwo ’中<" in got
    assert "\n\n\n" not in got


def test_entities(one):
    assert one(html.unescape(L("a&#0;b&#xD800;c&#99999999;d&#;e&#65;"))) == "a&#0;b&#xD800;c&#99999999;d&#;eA"
    assert one(html.unescape(L("&amp;lt;"))) == "&lt;"


def test_figures(one):
    (fig,) = one(html.figures(L(PAGE), L("http://h.org/x/y?q=1")))
    assert (fig.order, fig.label, fig.url) == (1, "Figure 2", "http://h.org/x/a/b.png")
    assert fig.caption == 'Figure 2： The "flow"'
    paras = fig.reference_text.split("\n\n")
    assert len(paras) == 2 and paras[0].startswith("The flow of Fig. 2") and paras[1].startswith("An unclosed one")


def test_plain_figures_when_none_is_typeset(one):
    got = one(html.figures(L('<figure><img src="//c/d.png"></figure><figure><img src="q.png"></figure>'), L("https://h/a/b")))
    assert [(f.order, f.label, f.url) for f in got] == [
        (0, "Figure 1", "https://c/d.png"),
        (1, "Figure 2", "https://h/a/q.png"),
    ]


@pytest.mark.parametrize(
    "src, url",
    [
        ("http://x/y", "http://x/y"),
        ("data:image/png;base64,AA", "data:image/png;base64,AA"),
        ("//x/y", "http://x/y"),
        ("/y", "http://h.org/y"),
        ("y", "http://h.org/a/y"),
        ("#z", "http://h.org/a/b?c=d/e#z"),
    ],
)
def test_resolve(one, src, url):
    assert one(html.resolve_url(L(src), L("http://h.org/a/b?c=d/e"))) == url


@pytest.mark.parametrize(
    "raw, number, body",
    [
        ("Figure 3: A flow", 3, "A flow"),
        ("fig. 12 . x", 12, "x"),
        ("图 2：结构", 2, "结构"),
        ("see Figure 3", None, None),
        ("Figures 3", None, None),
    ],
)
def test_captions(one, raw, number, body):
    assert one(html.caption_number(L(raw))) == number
    if number is not None:
        assert one(html.caption_body(L(raw))) == body


def test_figure_rank_prefers_first_then_words(one):
    rank = lambda o, c: one(html.figure_rank(L(o), L(c)))
    assert rank(0, "") == 9.0
    assert rank(1, "The Framework and results") == pytest.approx(6.99)
    assert rank(2, "框架") == pytest.approx(4.98)
