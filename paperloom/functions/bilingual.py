"""Two-language text fields, tolerant of the older single-string shape."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paperloom.functions.text import filled

# Digest labels per language.
LABELS = {
    "subject": {
        "zh-CN": "论文周报 - {run_date}（{paper_count} 篇）",
        "en": "Paper weekly - {run_date} ({paper_count} papers)",
    },
    "subtitle": {"zh-CN": "本周精选论文", "en": "Weekly Curated Research Papers"},
    "stat_papers": {"zh-CN": "篇论文", "en": "Papers"},
    "stat_topics": {"zh-CN": "个方向", "en": "Topics"},
    "stat_avg": {"zh-CN": "平均相关度", "en": "Avg Score"},
    "view_report": {"zh-CN": "查看完整报告", "en": "View Full Report"},
    "papers_badge": {"zh-CN": "{n} 篇", "en": "{n} papers"},
    "why_matters": {"zh-CN": "为什么值得读", "en": "Why it matters"},
    "relevance": {"zh-CN": "相关度", "en": "Relevance"},
    "view_details": {"zh-CN": "查看详情", "en": "View details"},
    "visit_site": {"zh-CN": "访问网站", "en": "Visit website"},
    "updated": {"zh-CN": "更新于", "en": "Updated"},
    "empty": {
        "zh-CN": "本周没有论文达到相关度阈值，因此没有可推送的分析。",
        "en": "No papers cleared the relevance threshold this week, so there is nothing to digest.",
    },
}


def bi(en: Column, zh: Column | None = None) -> Column:
    """``struct(en, zh)``; an empty or missing translation mirrors the original."""
    base = F.coalesce(en, F.lit(""))
    other = base if zh is None else F.coalesce(filled(zh), base)
    return F.struct(base.alias("en"), other.alias("zh"))


def pick(field: Column, locale: str) -> Column:
    """Wanted language, then English, then Chinese, then the empty string."""
    wanted = field["zh"] if locale.startswith("zh") else field["en"]
    return F.coalesce(filled(wanted), filled(field["en"]), filled(field["zh"]), F.lit(""))


def bi_from_variant(doc: Column, path: str) -> Column:
    """Read a field that may be ``{en, zh}`` or a plain string; null when absent."""
    plain = F.try_variant_get(doc, path, "string")
    is_object = F.schema_of_variant(F.variant_get(doc, path, "variant")).startswith("OBJECT")
    return F.when(
        is_object,
        F.struct(
            F.try_variant_get(doc, f"{path}.en", "string").alias("en"),
            F.try_variant_get(doc, f"{path}.zh", "string").alias("zh"),
        ),
    ).when(plain.isNotNull(), F.struct(plain.alias("en"), plain.alias("zh")))


def normalise_language(lang: Column) -> Column:
    """``en*`` reads as English, everything else as Chinese."""
    return F.when(F.lower(lang).startswith("en"), F.lit("en")).otherwise(F.lit("zh-CN"))


def label(key: Column, lang: Column) -> Column:
    """Look a digest label up; Chinese when the language lacks it, the key when unknown."""
    pairs = []
    for name, texts in LABELS.items():
        for code, text in texts.items():
            pairs += [F.lit(f"{name}|{code}"), F.lit(text)]
    table = F.create_map(*pairs)
    return F.coalesce(
        F.try_element_at(table, F.concat(key, F.lit("|"), lang)),
        F.try_element_at(table, F.concat(key, F.lit("|zh-CN"))),
        key,
    )


def fill_template(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def content(english: Column, translated: Column, lang: Column) -> Column:
    """A text field in the reader's language, English as the fallback."""
    base = F.coalesce(english, F.lit(""))
    return F.when(normalise_language(lang) == "en", base).otherwise(
        F.coalesce(filled(translated), base)
    )
