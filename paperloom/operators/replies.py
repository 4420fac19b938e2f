"""Reply tables back into typed columns: parse, validate, clamp, fall back.

`replies` tables have ``arxiv_id`` (and ``topic_idx`` or ``pos`` where a step needs
it) and ``reply``.  Every function keeps all input rows: a missing or unusable reply
only switches a row to its rule-based value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.config import DEFAULT_TASK_LIST_SIZE, Dimension, Topic, topics_df
from paperloom.functions import replies as R
from paperloom.functions.text import (
    brief_from_abstract,
    filled,
    let,
    question_keywords,
    sentences,
    strip,
    strip_quotes,
)
from paperloom.operators.prompts import ASPECTS
from paperloom.operators.selection import with_totals
from paperloom.operators.shape import compute_once

# Texts that stand in for missing parts.
NO_INFORMATION = "No relevant information found"
NO_ANSWER = "No sufficient information found in the paper."
NO_OFFLINE_ANSWER = "No sufficient information"
DEFAULT_REASON = "Deepen understanding of the paper"
GENERIC_QUESTIONS = (
    ("What is the main contribution of this paper?", "Understand the core innovation"),
    ("How do the experiments validate the method's effectiveness?", "Assess the method's reliability"),
)
DEFAULT_TASKS = (
    ("论文要解决的核心问题是什么？", "帮助我判断论文关注的痛点是否与我相关"),
    ("作者提出的关键方法/框架是什么？", "确认改进点和技术路线"),
    ("相较已有工作，论文的创新点在哪里？", "评估论文的新颖程度"),
    ("实验或评估设置如何？", "快速了解验证方式和指标"),
    ("有哪些局限性或未来工作方向？", "帮助我决定是否进一步跟进"),
)
NOTE_WITH_INTEREST = (
    "(Online LLM not enabled — relevance note unavailable. "
    "See the 5-aspect core below to judge how this paper relates to your work.)"
)
NOTE_WITHOUT_INTEREST = "(Online LLM not enabled.)"
MAX_QUESTIONS = 5
PROFILE_LIMITS = {"summary": 300, "research_questions": 6, "must_have_keywords": 8, "anti_keywords": 5}
TASK_TYPE = "array<struct<question:string,reason:string>>"


def task_array(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(q).alias("question"), F.lit(r).alias("reason")) for q, r in pairs])


def one_reply(replies: DataFrame, *keys: str) -> DataFrame:
    """The newest reply per key; combines on the map side."""
    return replies.groupBy(*keys).agg(newest_reply(replies).alias("_reply"))


def newest_reply(replies: DataFrame, where: Column | None = None) -> Column:
    """Aggregate: the reply with the latest ``replied_at``, then the highest ``attempt``.

    Where a table lacks these columns, and among equals, the largest text stands.
    """
    order = F.struct(*[c for c in ("replied_at", "attempt") if c in replies.columns], "reply")
    return F.max(order if where is None else F.when(where, order))["reply"]


def with_doc(rows: DataFrame, replies: DataFrame, *keys: str) -> DataFrame:
    """Left-join replies and parse them into ``_doc``; null when missing or unusable."""
    keys = keys or ("arxiv_id",)
    joined = rows.join(one_reply(replies, *keys), list(keys), "left")
    return compute_once(joined, "_doc", R.loose_json(F.col("_reply"))).drop("_reply")


def with_text(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Left-join plain-text replies as trimmed ``_text``; null when missing or blank."""
    joined = rows.join(one_reply(replies, "arxiv_id"), "arxiv_id", "left")
    return joined.withColumn("_text", filled(strip(F.col("_reply")))).drop("_reply")


# --- relevance -------------------------------------------------------------------


def relevance(scored: DataFrame, replies: DataFrame, dimensions: Sequence[Dimension], *keys: str) -> DataFrame:
    """Scores from a reply where all dimensions are usable, else the offline ones in ``scores``."""
    rows = with_doc(scored, replies, *keys)
    read = F.array(*[R.reply_score(F.col("_doc"), d.name) for d in dimensions])
    rows = compute_once(rows, "_dims", F.when(F.col("_doc").isNotNull(), read))
    usable = F.forall("_dims", lambda d: d["usable"])
    from_reply = F.array(
        *[
            F.struct(
                F.lit(d.name).alias("name"),
                F.lit(float(d.weight)).alias("weight"),
                F.col("_dims")[i]["value"].alias("value"),
            )
            for i, d in enumerate(dimensions)
        ]
    )
    rows = rows.withColumn("from_reply", F.coalesce(usable, F.lit(False))).withColumn(
        "scores", F.when(F.col("from_reply"), from_reply).otherwise(F.col("scores"))
    )
    return with_totals(rows.drop("_doc", "_dims"))


# --- core summary and figure stages ------------------------------------------------


def core(records: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Add ``core_summary`` (null without a usable reply) and keep staged ``figures``."""
    if replies is None:
        summary = F.lit(None).cast("struct<" + ",".join(f"{a}:string" for a in ASPECTS) + ">")
        figures = F.transform("figures", lambda f: f.withField("stage", F.lit(None).cast("string")))
        rows = records.withColumn("core_summary", summary).withColumn("figures", figures)
    else:
        rows = with_doc(records, replies)
        doc = F.col("_doc")
        summary = F.struct(*[R.text_field(doc, f"$.{a}", NO_INFORMATION).alias(a) for a in ASPECTS])
        rows = rows.withColumn("core_summary", F.when(doc.isNotNull(), summary))
        rows = compute_once(rows, "_stages", F.try_variant_get(doc, "$.figure_assignments", "map<string,string>"))
        staged = F.transform(
            "figures",
            lambda f, i: f.withField(
                "stage",
                F.when(
                    doc.isNotNull(),
                    R.stage_of(F.col("_stages"), F.concat(F.lit("fig_"), i.cast("string"))),
                ),
            ),
        )
        rows = rows.withColumn("figures", staged).drop("_doc", "_stages")
    kept = F.filter("figures", lambda f: F.coalesce(f["stage"].isin(*R.KEPT_STAGES), F.lit(False)))
    return rows.withColumn("figures", kept)


# --- interest profile ---------------------------------------------------------------


def profile_of(doc: Column, prompt: Column) -> Column:
    """Profile struct; the prompt itself as the summary when there is no usable reply."""

    def items(name: str) -> Column:
        raw = F.coalesce(F.try_variant_get(doc, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
        return F.slice(F.transform(raw, strip), 1, PROFILE_LIMITS[name])

    lists = [n for n in PROFILE_LIMITS if n != "summary"]
    summary = F.substring(R.text_field(doc, "$.summary", ""), 1, PROFILE_LIMITS["summary"])
    empty = F.array().cast("array<string>")
    return F.when(
        doc.isNotNull(), F.struct(summary.alias("summary"), *[items(n).alias(n) for n in lists])
    ).otherwise(F.struct(prompt.alias("summary"), *[empty.alias(n) for n in lists]))


def memo(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run `work` once per distinct value of `key` and join the result back."""
    return rows.join(work(rows.select(key).distinct()), key, "left")


def interest_profiles(
    rows: DataFrame, replies: DataFrame | None = None, topics: Sequence[Topic] | None = None
) -> DataFrame:
    """Add ``profile``, worked out once per distinct interest text.

    `replies` is keyed by ``prompt_key``, the trimmed text.  When the texts come from
    configured topics, pass those: the profiles are then as few and are broadcast
    instead of shuffling all rows by a handful of texts.
    """

    def work(prompts: DataFrame) -> DataFrame:
        keyed = prompts.withColumn("prompt_key", strip(F.coalesce("interest_prompt", F.lit(""))))
        if replies is None:
            keyed = keyed.withColumn("_doc", F.lit(None).cast("variant"))
        else:
            keyed = with_doc(keyed, replies, "prompt_key")
        doc = F.when(F.col("prompt_key") != "", F.col("_doc"))
        return keyed.select("interest_prompt", profile_of(doc, F.col("prompt_key")).alias("profile"))

    if topics is None:
        return memo(rows, "interest_prompt", work)
    known = topics_df(rows.sparkSession, topics).select("interest_prompt").distinct()
    return rows.join(F.broadcast(work(known)), "interest_prompt", "left")


# --- questions and answers ----------------------------------------------------------


def questions(records: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Add ``tasks``: up to five non-blank questions, else two general ones."""
    general = task_array(GENERIC_QUESTIONS)
    if replies is None:
        return records.withColumn("tasks", general)
    rows = with_doc(records, replies).withColumn("_items", F.try_variant_get("_doc", "$.questions", TASK_TYPE))
    # an entry that is no object makes the whole reply unusable
    sound = F.forall(F.slice("_items", 1, MAX_QUESTIONS), lambda x: x.isNotNull())
    asked = F.filter(
        F.transform(
            F.slice("_items", 1, MAX_QUESTIONS),
            lambda x: F.struct(
                strip(F.coalesce(x["question"], F.lit(""))).alias("question"),
                F.coalesce(filled(strip(x["reason"])), F.lit(DEFAULT_REASON)).alias("reason"),
            ),
        ),
        lambda x: x["question"] != "",
    )
    wanted = F.coalesce("interest_prompt", F.lit("")) != ""
    return rows.withColumn(
        "tasks", F.when(wanted & sound & (F.size(asked) > 0), asked).otherwise(general)
    ).drop("_doc", "_items")


def reading_tasks(records: DataFrame, replies: DataFrame, size: int = DEFAULT_TASK_LIST_SIZE) -> DataFrame:
    """Add ``reading_tasks`` from a ``todos`` list, else the default tasks cut to `size`."""
    rows = with_doc(records, replies).withColumn("_items", F.try_variant_get("_doc", "$.todos", TASK_TYPE))
    given = F.transform(
        F.filter(F.slice("_items", 1, size), lambda x: F.coalesce(x["question"], F.lit("")) != ""),
        lambda x: F.struct(
            strip(x["question"]).alias("question"),
            strip(F.coalesce(x["reason"], F.lit(""))).alias("reason"),
        ),
    )
    default = F.slice(task_array(DEFAULT_TASKS), 1, size)
    return rows.withColumn("reading_tasks", F.when(F.size(given) > 0, given).otherwise(default)).drop(
        "_doc", "_items"
    )


def offline_answer(question: Column, body_sentences: Column) -> Column:
    """First two sentences with one of the question's keywords, else the first sentence.

    `body_sentences` is an array of ``struct(text, low)``, `low` being lower case.
    """
    keywords = F.transform(question_keywords(question), lambda w: F.lower(w))
    found = let(
        keywords,
        lambda words: F.slice(
            F.filter(body_sentences, lambda s: F.exists(words, lambda w: F.contains(s["low"], w))), 1, 2
        ),
    )
    used = let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.slice(body_sentences, 1, 1)))

    def answer(sents: Column) -> Column:
        joined = F.array_join(F.transform(sents, lambda s: s["text"]), " ")
        text = F.coalesce(filled(strip(joined)), F.lit(NO_OFFLINE_ANSWER))
        sure = R.clamp(F.size(sents).cast("double") * 0.3 + 0.4, 0.0, 1.0)
        return F.struct(text.alias("answer"), sure.alias("confidence"))

    return let(used, answer)


def given_answer(doc: Column) -> Column:
    """``struct(answer, confidence, usable)`` from one parsed reply."""
    sure = F.variant_get(doc, "$.confidence", "variant")
    number = F.when(sure.isNull(), F.lit(0.5)).otherwise(F.try_variant_get(doc, "$.confidence", "double"))
    return F.struct(
        R.text_field(doc, "$.answer", NO_ANSWER).alias("answer"),
        R.clamp(number, 0.0, 1.0).alias("confidence"),
        (doc.isNotNull() & number.isNotNull()).alias("usable"),
    )


def answers(records: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Add ``findings``: every task with its answer and confidence.

    Replies come one per task (``arxiv_id, pos, reply``).  They are folded to one row
    per paper first, so the body text is joined, not multiplied.
    """

    def read(reply: Column) -> Column:
        return let(R.loose_json(reply), given_answer)

    if replies is None:
        rows = records.withColumn("_given", F.array().cast("array<struct<answer:string,confidence:double,usable:boolean>>"))
    else:
        slots = [f"_r{i}" for i in range(MAX_QUESTIONS)]
        folded = replies.groupBy("arxiv_id").agg(
            *[newest_reply(replies, F.col("pos") == i).alias(s) for i, s in enumerate(slots)]
        )
        rows = records.join(folded, "arxiv_id", "left")
        rows = compute_once(rows, "_given", F.transform(F.array(*slots), read)).drop(*slots)
    both = F.transform(sentences(F.col("body")), lambda s: F.struct(s.alias("text"), F.lower(s).alias("low")))
    rows = compute_once(rows, "_sentences", both)

    def finding(task: Column, i: Column) -> Column:
        own = F.get(F.col("_given"), i)
        taken = F.when(
            F.coalesce(own["usable"], F.lit(False)),
            F.struct(own["answer"].alias("answer"), own["confidence"].alias("confidence")),
        ).otherwise(offline_answer(task["question"], F.col("_sentences")))
        return let(
            taken,
            lambda a: F.struct(
                task["question"].alias("question"),
                task["reason"].alias("reason"),
                a["answer"].alias("answer"),
                a["confidence"].alias("confidence"),
            ),
        )

    return compute_once(rows, "findings", F.transform("tasks", finding)).drop("_given", "_sentences")


# --- short texts --------------------------------------------------------------------


def _no_text(records: DataFrame) -> DataFrame:
    return records.withColumn("_text", F.lit(None).cast("string"))


def findings_summary(records: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Rewrite the conclusion: the reply, else the own conclusion, else 300 characters of abstract."""
    rows = _no_text(records) if replies is None else with_text(records, replies)
    text = F.coalesce(
        F.col("_text"),
        filled(strip(F.col("core_summary.conclusion"))),
        F.substring(strip(F.col("abstract")), 1, 300),
    )
    return rows.withColumn(
        "core_summary",
        F.when(F.col("core_summary").isNotNull(), F.col("core_summary").withField("conclusion", text)),
    ).drop("_text")


def brief_summary(records: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    rows = _no_text(records) if replies is None else with_text(records, replies)
    return rows.withColumn(
        "brief_summary", F.coalesce(F.col("_text"), brief_from_abstract(F.col("abstract")))
    ).drop("_text")


def relevance_note(records: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    rows = _no_text(records) if replies is None else with_text(records, replies)
    fixed = F.when(F.coalesce("interest_prompt", F.lit("")) != "", NOTE_WITH_INTEREST).otherwise(NOTE_WITHOUT_INTEREST)
    return rows.withColumn("relevance", F.coalesce(filled(strip_quotes(F.col("_text"))), fixed)).drop("_text")


# --- translation --------------------------------------------------------------------

TRANSLATION_TYPE = (
    "struct<title:string,brief_summary:string,relevance:string,"
    "core_summary:struct<" + ",".join(f"{a}:string" for a in ASPECTS) + ">,"
    "figure_captions:array<string>,"
    "findings:array<struct<question:string,reason:string,answer:string>>>"
)


def _merged(doc: Column, path: str, own: Column) -> Column:
    return strip(F.coalesce(filled(F.try_variant_get(doc, path, "string")), own, F.lit("")))


def translation(records: DataFrame, replies: DataFrame | None, language: str = "zh-CN") -> DataFrame:
    """Add ``tr``, the translated mirror; each unusable part keeps the original text.

    Null for an English reader or without a usable reply.
    """
    if replies is None or language.strip().lower().startswith("en"):
        return records.withColumn("tr", F.lit(None).cast(TRANSLATION_TYPE))
    rows = with_doc(records, replies)
    doc = F.col("_doc")
    rows = rows.withColumn(
        "_captions",
        F.transform(F.filter("figures", lambda f: strip(f["caption"]) != ""), lambda f: f["caption"]),
    )
    rows = rows.withColumn("_tr_captions", F.try_variant_get(doc, "$.figure_captions", "array<string>"))
    rows = rows.withColumn(
        "_tr_findings",
        F.try_variant_get(doc, "$.findings", "array<struct<question:string,reason:string,answer:string>>"),
    )
    same = F.size("_tr_captions") == F.size("_captions")
    captions = F.when(
        F.size("_captions") > 0,
        F.zip_with(
            F.when(F.coalesce(same, F.lit(False)), F.col("_tr_captions")).otherwise(F.col("_captions")),
            F.col("_captions"),
            lambda t, s: strip(F.coalesce(filled(t), s)),
        ),
    )

    def merged_finding(f: Column, i: Column) -> Column:
        t = F.get(F.col("_tr_findings"), i)
        return F.struct(
            *[strip(F.coalesce(filled(t[n]), f[n], F.lit(""))).alias(n) for n in ("question", "reason", "answer")]
        )

    core_tr = F.when(
        F.col("core_summary").isNotNull(),
        F.struct(*[_merged(doc, f"$.core_summary.{a}", F.col(f"core_summary.{a}")).alias(a) for a in ASPECTS]),
    )
    bundle = F.struct(
        _merged(doc, "$.title", F.col("title")).alias("title"),
        _merged(doc, "$.brief_summary", F.col("brief_summary")).alias("brief_summary"),
        _merged(doc, "$.relevance", F.col("relevance")).alias("relevance"),
        core_tr.alias("core_summary"),
        captions.alias("figure_captions"),
        F.transform("findings", merged_finding).alias("findings"),
    )
    return compute_once(rows, "tr", F.when(doc.isNotNull(), bundle)).drop(
        "_doc", "_captions", "_tr_captions", "_tr_findings"
    )
