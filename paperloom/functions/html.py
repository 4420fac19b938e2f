"""Text, links, paragraphs and figures out of page HTML, with regular expressions only.

Everything works inside one row, so a page never has to be shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paperloom.functions.text import BLANKS, filled, let, squeeze, strip

# Tags whose content is dropped, tags that break lines, entities.
DROPPED_TAGS = ("head", "script", "style", "nav", "noscript", "template")
BREAKING_TAGS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|"
    "header|hr|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&hellip;", "…"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&amp;", "&"),
)
DROPPED = rf"(?is)<!--.*?-->|<({'|'.join(DROPPED_TAGS)})\b[^>]*>.*?</\1\s*>"
ANY_TAG = r"</?[a-zA-Z!?][^>]*>"
NUMBERED_ENTITY = r"^(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
CITED_FIGURE = r"(?iU)(?:\bfig(?:ure)?\.?\s*|图\s*)(\d+)\b"
CAPTION_START = r"(?iU)^\s*(?:figure|fig\.?|图)\s*(\d+)\b[\s:.：、,]*"
MIN_PARAGRAPH = 40
MAX_REFERENCE_CHARS = 1500
MAX_REFERENCES = 3

# Caption words that raise a figure's rank.
OVERVIEW_WORDS = (
    "overview", "framework", "architecture", "pipeline", "workflow", "approach",
    "our method", "proposed method", "proposed framework", "system design", "illustration",
    "高层", "框架", "流程", "架构", "总览", "概览",
)
RESULT_WORDS = (
    "result", "comparison", "ablation", "performance", "example", "case study",
    "实验", "对比", "消融", "示例",
)

_OPEN, _CLOSE = "\u0001", "\u0002"


def _numbered_entities(col: Column) -> Column:
    """Decode ``&#8217;`` and ``&#x2019;``; runs only where such a mark occurs."""

    def decode(piece: Column, i: Column) -> Column:
        code = F.rtrim(F.regexp_extract(piece, NUMBERED_ENTITY, 0), F.lit(";"))
        digits = F.regexp_replace(code, "^[xX]", "")
        hexed = F.when(code.rlike("^[xX]"), digits).otherwise(F.hex(digits.try_cast("bigint")))
        value = F.conv(hexed, 16, 10).cast("bigint")
        fits = (value > 0) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
        rest = F.substring(piece, F.length(code) + 2, F.length(piece))
        return (
            F.when(i == 0, piece)
            .when((code != "") & fits, F.concat(char, rest))
            .otherwise(F.concat(F.lit("&#"), piece))
        )

    pieces = F.transform(F.split(col, "&#"), decode)
    return F.when(F.contains(col, F.lit("&#")), F.array_join(pieces, "")).otherwise(col)


def unescape(col: Column) -> Column:
    """Common named entities and all numbered ones, each decoded once."""

    def decode(piece: Column, i: Column) -> Column:
        out = F.when(i == 0, piece).when(F.startswith(piece, F.lit("#")), _numbered_entities(F.concat(F.lit("&"), piece)))
        for name, char in ENTITIES:
            out = out.when(F.startswith(piece, F.lit(name[1:])), F.concat(F.lit(char), F.substring(piece, F.lit(len(name)), F.length(piece))))
        return out.otherwise(F.concat(F.lit("&"), piece))

    pieces = F.transform(F.split(col, "&"), decode)
    return F.when(F.contains(col, F.lit("&")), F.array_join(pieces, "")).otherwise(col)


def without_dropped(html: Column) -> Column:
    """Page without comments and without script, style, navigation and head blocks."""
    return F.regexp_replace(html, DROPPED, "")


def page_text(html: Column) -> Column:
    """Readable text: one line per block element, at most one blank line in a row."""
    col = without_dropped(html)
    col = F.regexp_replace(col, rf"(?i)</?(?:{BREAKING_TAGS})\b[^>]*>", "\n")
    col = unescape(F.regexp_replace(col, ANY_TAG, ""))
    col = F.regexp_replace(F.regexp_replace(col, r"[ \t\r\f]+", " "), r" ?\n ?", "\n")
    return strip(F.regexp_replace(col, r"\n{3,}", "\n\n"))


def inner_text(fragment: Column, gap: str = " ") -> Column:
    """Text of an HTML fragment with `gap` between its pieces."""
    return squeeze(unescape(F.regexp_replace(fragment, ANY_TAG, gap)))


def elements(html: Column, tag: str) -> Column:
    """``array<struct(attrs, inner)>`` of a tag in page order.

    An element ends at its closing tag or where the next one of its kind opens.
    """
    marked = F.regexp_replace(html, rf"(?i)<{tag}\b", _OPEN)
    marked = F.regexp_replace(marked, rf"(?i)</{tag}\s*>", _CLOSE)
    pieces = F.split(marked, _OPEN)
    return F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            F.substring_index(p, ">", 1).alias("attrs"),
            F.substring_index(_after_gt(p), _CLOSE, 1).alias("inner"),
        ),
    )


def _after_gt(piece: Column) -> Column:
    at = F.instr(piece, ">")
    return F.when(at > 0, F.substring(piece, at + 1, F.length(piece))).otherwise(F.lit(""))


def attribute(attrs: Column, name: str) -> Column:
    """Attribute value, quoted or bare; null when the attribute is absent or empty."""
    found = F.regexp_extract(attrs, rf"(?is)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    value = F.regexp_replace(found, rf"(?is)^\s*{name}\s*=\s*", "")
    return filled(strip(F.btrim(value, F.lit("\"'"))))


def paragraphs(html: Column) -> Column:
    """Texts of all ``p`` elements that are long enough to say something."""
    texts = F.transform(elements(html, "p"), lambda e: inner_text(e["inner"]))
    return F.filter(texts, lambda t: F.length(t) >= MIN_PARAGRAPH)


def resolve_url(src: Column, page_url: Column) -> Column:
    """Absolute, protocol-relative, root-relative and plain relative links.

    Parent steps (``..``) are left as they are.
    """
    base = r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)//([^/?#]*)([^?#]*)"
    scheme = F.regexp_extract(page_url, base, 1)
    host = F.concat(scheme, F.lit("//"), F.regexp_extract(page_url, base, 2))
    folder = F.regexp_extract(F.regexp_extract(page_url, base, 3), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(src.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), src)
        .when(src.startswith("//"), F.concat(scheme, src))
        .when(src.startswith("/"), F.concat(host, src))
        .when(src.startswith("#"), F.concat(F.regexp_extract(page_url, r"^[^#]*", 0), src))
        .otherwise(F.concat(host, folder, src))
    )


def cited_numbers(text: Column) -> Column:
    """Figure numbers a paragraph mentions, as digit strings."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(CITED_FIGURE), F.lit(1)))
    # the Unicode pattern is slow and most paragraphs cite nothing
    return F.when(text.rlike("[fF][iI][gG]|图"), found).otherwise(F.array().cast("array<string>"))


def figure_rank(order: Column, caption: Column) -> Column:
    """Preference for the figure that explains the work best."""

    def mentions(text: Column, words: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))

    def rank(text: Column) -> Column:
        return (
            F.when(order == 0, 10.0).otherwise(0.0)
            + F.when(mentions(text, OVERVIEW_WORDS), 5.0).otherwise(0.0)
            + F.when(mentions(text, RESULT_WORDS), 2.0).otherwise(0.0)
            - F.when(text == "", 1.0).otherwise(0.0)
            - order.cast("double") * 0.01
        )

    return let(F.lower(F.coalesce(caption, F.lit(""))), rank)


def figures(html: Column, page_url: Column) -> Column:
    """``array<struct(order, label, caption, url, reference_text)>`` of a page.

    Figures of the typeset class win over plain ones; one without an image is
    skipped but keeps its place in the count.  `reference_text` is the first three
    paragraphs citing the figure.
    """
    every = elements(html, "figure")
    typeset = F.filter(every, lambda e: e["attrs"].rlike(r"(?is)class\s*=\s*[\"'][^\"']*(?<![\w-])ltx_figure(?![\w-])"))
    nodes = F.when(F.size(typeset) > 0, typeset).otherwise(every)

    def read(e: Column, i: Column) -> Column:
        caption_of = F.get(elements(e["inner"], "figcaption"), 0)["inner"]
        return let(caption_of, lambda caption_html: describe(e, i, caption_html))

    def describe(e: Column, i: Column, caption_html: Column) -> Column:
        image = F.regexp_extract(e["inner"], r"(?is)<img\b([^>]*)>", 1)
        tag = F.regexp_extract(
            caption_html, r"(?is)<span\b[^>]*class\s*=\s*[\"'][^\"']*ltx_tag[^\"']*[\"'][^>]*>(.*?)</span>", 1
        )
        label = F.btrim(F.rtrim(strip(inner_text(tag, "")), F.lit(":：")), F.lit(BLANKS))
        return F.struct(
            i.cast("int").alias("order"),
            F.coalesce(
                filled(label), F.concat(F.lit("Figure "), (i + 1).cast("string"))
            ).alias("label"),
            F.coalesce(inner_text(caption_html), F.lit("")).alias("caption"),
            attribute(image, "src").alias("src"),
        )

    found = F.filter(F.transform(nodes, read), lambda f: f["src"].isNotNull())
    citing = F.filter(
        F.transform(paragraphs(html), lambda t: F.struct(t.alias("text"), cited_numbers(t).alias("nums"))),
        lambda p: F.size(p["nums"]) > 0,
    )
    # `citing` is bound once per page; inside the inner lambda it would run per figure
    return let(
        citing,
        lambda cites: F.transform(
            found,
            lambda f: F.struct(
                f["order"].alias("order"),
                f["label"].alias("label"),
                f["caption"].alias("caption"),
                resolve_url(f["src"], page_url).alias("url"),
                reference_text(cites, F.regexp_extract(f["label"], r"(\d+)", 1)).alias("reference_text"),
            ),
        ),
    )


def reference_text(citing: Column, number: Column) -> Column:
    """First three of ``array<struct(text, nums)>`` that cite `number`, 1,500 characters at most."""
    hits = let(number, lambda n: F.filter(citing, lambda p: F.array_contains(p["nums"], n)))
    joined = F.array_join(F.transform(F.slice(hits, 1, MAX_REFERENCES), lambda p: p["text"]), "\n\n")
    return F.substring(joined, 1, MAX_REFERENCE_CHARS)


def caption_number(text: Column) -> Column:
    """Figure number of a text block that starts as a caption, else null."""
    return F.regexp_extract(text, CAPTION_START, 1).try_cast("int")


def caption_body(text: Column) -> Column:
    return strip(F.regexp_replace(text, CAPTION_START, ""))
