"""Prompt tables for an outside model: ``(arxiv_id, step, system, user)``.

Nothing here calls a service.  A later job reads the replies with `replies`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.config import DEFAULT_MAX_CONTENT_CHARS, DEFAULT_TASK_LIST_SIZE, Dimension
from paperloom.functions.bilingual import pick
from paperloom.functions.scoring import two_decimals
from paperloom.functions.text import excerpt, filled, strip
from paperloom.operators.chats import turn_messages
from paperloom.operators.shape import posexplode_rows

ENGLISH = " Answer in English."
JSON_HINT = "Reply with exactly one JSON object and nothing else."
ASPECTS = ("problem", "solution", "methodology", "experiments", "conclusion")

SYSTEM = {
    "relevance": "Rate how well a paper fits a reader's interests. For every dimension give a score from 0 to 100 "
    "and a short reason, as a JSON object keyed by dimension name with fields score and reason." + ENGLISH,
    "core": "Describe a paper under five headings, each complete in itself. Reply in JSON with the keys "
    "problem, solution, methodology, experiments and conclusion." + ENGLISH,
    "core_figures": " Also add figure_assignments: an object giving every figure id one of problem, solution, "
    "methodology, experiments, conclusion or none, by what the figure shows.",
    "profile": "Turn a reader's description of interests into JSON with summary, research_questions, "
    "must_have_keywords and anti_keywords. Keep to what the reader says." + ENGLISH,
    "questions": "Write three to five questions this reader would ask of this paper, answerable from its text. "
    "Reply in JSON: questions, a list of objects with question and reason." + ENGLISH,
    "answer": "Answer one question from the paper's text, quoting where it helps. Reply in JSON with answer and "
    "confidence between 0 and 1." + ENGLISH,
    "findings": "Write a short paragraph that joins the paper's conclusion with what the answers showed." + ENGLISH,
    "brief": "Tell in one or two paragraphs why the work was needed, what it proposes and what came out." + ENGLISH,
    "note": "Say in one or two sentences why this paper may matter to this reader, or that the link is weak." + ENGLISH,
    "translate": "Translate every string value of the JSON into {language}. Keep keys, list lengths and technical "
    "names unchanged and return JSON only.",
    "tasks": "List up to {n} reading tasks for this reader, as JSON: todos, a list of objects with question and "
    "reason." + ENGLISH,
    "chat": "You help a reader with follow-up questions about one paper. Rely on the material below, quote it where "
    "useful, and say so when it has no answer. Use the reader's language.",
}


def _rows(df: DataFrame, step: str, system: Column, user: Column, *extra: str) -> DataFrame:
    return df.select("arxiv_id", *extra, F.lit(step).alias("step"), system.alias("system"), user.alias("user"))


def relevance(candidates: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    dims = F.array(
        *[
            F.struct(
                F.lit(d.name).alias("name"),
                F.lit(float(d.weight)).alias("weight"),
                F.lit(d.description or d.name).alias("description"),
            )
            for d in dimensions
        ]
    )
    user = F.to_json(
        F.struct(
            F.col("interest_prompt").alias("user_interest"),
            F.struct("title", "abstract", "categories").alias("paper"),
            dims.alias("dimensions"),
        )
    )
    return _rows(candidates, "relevance", F.lit(SYSTEM["relevance"]), user, "topic_idx")


def figure_lines(figures: Column) -> Column:
    """Numbered list of figures with a 400-character excerpt of what cites them."""

    def line(f: Column, i: Column) -> Column:
        return F.concat(
            F.lit("- id=fig_"), i.cast("string"),
            F.lit(" | label="), F.coalesce(filled(f["label"]), F.lit("(none)")),
            F.lit("\n  caption: "), F.coalesce(filled(strip(f["caption"])), F.lit("(no caption)")),
            F.lit("\n  body reference: "),
            F.coalesce(filled(excerpt(strip(f["reference_text"]), 400)), F.lit("(none)")),
        )

    return F.array_join(F.transform(figures, line), "\n")


def core(records: DataFrame, max_chars: int = DEFAULT_MAX_CONTENT_CHARS) -> DataFrame:
    has_figures = F.size("figures") > 0
    system = F.when(has_figures, SYSTEM["core"] + SYSTEM["core_figures"]).otherwise(SYSTEM["core"])
    user = F.concat(
        F.lit("Title: "), F.col("title"), F.lit("\nAbstract: "), F.col("abstract"),
        F.lit("\nContent: "), F.substring("body", 1, max_chars),
        F.when(has_figures, F.concat(F.lit("\n\nFigures:\n"), figure_lines(F.col("figures")))).otherwise(""),
    )
    return _rows(records, "core", system, user)


def profiles(interests: DataFrame) -> DataFrame:
    """One prompt per distinct, non-blank interest text."""
    key = strip(F.col("interest_prompt"))
    return (
        interests.select(key.alias("prompt_key")).where("prompt_key <> ''").distinct()
        .select(
            "prompt_key", F.lit("profile").alias("step"), F.lit(SYSTEM["profile"]).alias("system"),
            F.concat(F.lit("Interests:\n\n"), F.col("prompt_key")).alias("user"),
        )
    )


def _aspect_lines(summary: Column, limit: int) -> Column:
    return F.concat_ws(
        "\n", *[F.concat(F.lit(f"- {a}: "), F.substring(summary[a], 1, limit), F.lit("...")) for a in ASPECTS]
    )


def questions(records: DataFrame) -> DataFrame:
    """Needs ``core_summary``, ``interest_prompt`` and ``profile``."""
    p = F.col("profile")
    user = F.concat(
        F.lit("Title: "), F.col("title"), F.lit("\nAbstract: "), F.col("abstract"),
        F.when(
            F.col("core_summary").isNotNull(),
            F.concat(F.lit("\n\nSummary:\n"), _aspect_lines(F.col("core_summary"), 300)),
        ).otherwise(""),
        F.lit("\n\nInterests:\n"), F.col("interest_prompt"),
        F.lit("\n\nProfile: "), p["summary"],
        F.lit("\nResearch questions: "), F.array_join(p["research_questions"], "; "),
        F.lit("\nKeywords: "), F.array_join(p["must_have_keywords"], ", "),
        F.lit("\nNot wanted: "), F.array_join(p["anti_keywords"], ", "),
    )
    return _rows(records, "questions", F.lit(SYSTEM["questions"]), user)


def answers(records: DataFrame, max_chars: int = DEFAULT_MAX_CONTENT_CHARS) -> DataFrame:
    """One prompt per task, with its position."""
    long = posexplode_rows(records, F.col("tasks"), "pos", "task", ["arxiv_id", "title", "body"])
    user = F.concat(
        F.lit("Question: "), F.col("task.question"), F.lit("\nWhy: "), F.col("task.reason"),
        F.lit("\n\nTitle: "), F.col("title"), F.lit("\nContent: "), F.substring("body", 1, max_chars),
    )
    return _rows(long, "answer", F.lit(SYSTEM["answer"]), user, "pos")


def _qa_lines(found: Column, k: int) -> Column:
    return F.array_join(
        F.transform(
            F.slice(found, 1, k),
            lambda f: F.concat(F.lit("- Q: "), f["question"], F.lit("\n  A: "), f["answer"]),
        ),
        "\n",
    )


def findings(records: DataFrame) -> DataFrame:
    user = F.concat(
        F.lit("Paper: "), F.col("title"),
        F.lit("\n\nConclusion:\n"), strip(F.col("core_summary.conclusion")),
        F.lit("\n\nQuestions and answers:\n"), _qa_lines(F.col("findings"), 5),
    )
    rows = records.where(F.col("core_summary").isNotNull())
    return _rows(rows, "findings", F.lit(SYSTEM["findings"]), user)


def brief(records: DataFrame) -> DataFrame:
    user = F.to_json(
        F.struct(
            F.col("title").alias("paper_title"), F.col("abstract").alias("paper_abstract"),
            F.col("core_summary"), _qa_lines(F.col("findings"), 3).alias("key_findings"),
        )
    )
    return _rows(records, "brief", F.lit(SYSTEM["brief"]), user)


def note(records: DataFrame) -> DataFrame:
    user = F.to_json(
        F.struct(
            F.col("interest_prompt").alias("interests"), F.col("profile"),
            F.col("title").alias("paper_title"), F.col("abstract").alias("paper_abstract"), F.col("brief_summary"),
            F.when(
                F.col("core_summary").isNotNull(),
                F.struct("core_summary.problem", "core_summary.solution", "core_summary.methodology"),
            ).alias("core_summary"),
        )
    )
    return _rows(records, "note", F.lit(SYSTEM["note"]), user)


def translate(records: DataFrame, language: str) -> DataFrame:
    """Text mirror to translate; no rows when the reader's language is English."""
    names = {"zh-CN": "Simplified Chinese (zh-CN)", "zh": "Simplified Chinese (zh-CN)"}
    if language.strip().lower().startswith("en"):
        records = records.where(F.lit(False))
    captions = F.transform(
        F.filter("figures", lambda f: strip(f["caption"]) != ""), lambda f: f["caption"]
    )
    bundle = F.struct(
        "title", "brief_summary", "relevance",
        F.transform(
            "findings",
            lambda f: F.struct(f["question"].alias("question"), f["reason"].alias("reason"), f["answer"].alias("answer")),
        ).alias("findings"),
        F.col("core_summary"),
        F.when(F.size(captions) > 0, captions).alias("figure_captions"),
    )
    system = SYSTEM["translate"].replace("{language}", names.get(language, language))
    return _rows(records, "translate", F.lit(system), F.to_json(bundle))


def tasks(records: DataFrame, size: int = DEFAULT_TASK_LIST_SIZE) -> DataFrame:
    user = F.to_json(
        F.struct(
            F.col("interest_prompt").alias("user_interest"), F.col("title").alias("paper_title"),
            F.col("abstract").alias("paper_abstract"), F.lit(size).alias("max_items"),
        )
    )
    return _rows(records, "tasks", F.lit(SYSTEM["tasks"].replace("{n}", str(size))), user)


def retry(prompts: DataFrame, usable: Column) -> DataFrame:
    """Rows whose reply could not be used, with a hint added to (or set as) the system text."""
    hinted = F.when(F.coalesce("system", F.lit("")) == "", F.lit(JSON_HINT)).otherwise(
        F.concat(F.col("system"), F.lit("\n\n" + JSON_HINT))
    )
    return prompts.where(~F.coalesce(usable, F.lit(False))).withColumn("system", hinted)


def chat_context(analyses: DataFrame, max_chars: int = 12_000) -> DataFrame:
    """One system text per paper: metadata, abstract, brief, five aspects, answers, body excerpt."""

    def en(name: str) -> Column:
        return pick(F.col(name), "en")

    aspects = F.concat_ws("\n", *[F.concat(F.lit(f"[{i}. {a}] "), pick(F.col("core_summary")[a], "en")) for i, a in enumerate(ASPECTS, 1)])
    qa = F.array_join(
        F.transform(
            "findings",
            lambda f, i: F.concat(
                F.lit("Q"), (i + 1).cast("string"), F.lit(": "), pick(f["question"], "en"),
                F.lit("\nA"), (i + 1).cast("string"), F.lit(" (confidence "), two_decimals(f["confidence"]),
                F.lit("): "), pick(f["answer"], "en"),
            ),
        ),
        "\n",
    )
    shown = F.substring("markdown", 1, max_chars)
    parts = [
        F.lit(SYSTEM["chat"]),
        F.lit("\n--- Paper ---"),
        F.concat(F.lit("Title: "), en("title")),
        F.concat(F.lit("Id: "), F.col("arxiv_id")),
        F.when(F.size("authors") > 0, F.concat(F.lit("Authors: "), F.array_join("authors", ", "))),
        F.when(filled(F.col("published")).isNotNull(), F.concat(F.lit("Published: "), F.col("published"))),
        F.when(F.size("categories") > 0, F.concat(F.lit("Categories: "), F.array_join("categories", ", "))),
        F.concat(F.lit("\n--- Abstract ---\n"), F.col("abstract")),
        F.when(en("brief_summary") != "", F.concat(F.lit("\n--- In brief ---\n"), en("brief_summary"))),
        F.when(F.col("core_summary").isNotNull(), F.concat(F.lit("\n--- Five aspects ---\n"), aspects)),
        F.when(F.size("findings") > 0, F.concat(F.lit("\n--- Questions and answers ---\n"), qa)),
        F.when(
            filled(F.col("markdown")).isNotNull(),
            F.concat(F.lit("\n--- Body, first "), F.length(shown).cast("string"), F.lit(" characters ---\n"), shown),
        ),
    ]
    return analyses.select("arxiv_id", F.concat_ws("\n", *parts).alias("system"))


def chat_messages(contexts: DataFrame, turns: DataFrame, asked: DataFrame) -> DataFrame:
    """Message rows in order: the system text, the history, then the new question.

    One row per message, ``(arxiv_id, seq, role, content)``; a long history stays
    spread over rows.
    """
    papers = asked.select("arxiv_id")
    system = contexts.join(papers, "arxiv_id", "left_semi").select(
        "arxiv_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("system").alias("role"),
        F.col("system").alias("content"),
    )
    history = turn_messages(turns).join(papers, "arxiv_id", "left_semi")
    last = F.lit(2**62).cast("bigint")
    question = asked.select("arxiv_id", last.alias("seq"), F.lit("user").alias("role"), F.col("message").alias("content"))
    return system.unionByName(history).unionByName(question)
