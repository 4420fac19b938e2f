"""Topics, scoring dimensions and limits: small driver-side configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Defaults a caller gets when the configuration is silent.
DEFAULT_THRESHOLD = 60.0
DEFAULT_DAYS_BACK = 7
DEFAULT_MAX_PER_TOPIC = 25
DEFAULT_TASK_LIST_SIZE = 5
DEFAULT_MAX_CONTENT_CHARS = 50_000
DEFAULT_PAGE_CHARS = 12_000
DEFAULT_CATEGORY_SCOPE = "cs"
NOVELTY_WORDS = ("novel", "new", "first", "improve", "state-of-the-art")
EXPERIMENT_WORDS = ("experiment", "evaluation", "benchmark", "dataset", "ablation")


@dataclass(frozen=True)
class Dimension:
    name: str
    weight: float
    description: str = ""


@dataclass(frozen=True)
class Topic:
    name: str
    label: str = ""
    categories: Sequence[str] = ()
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    interest_prompt: str = ""

    @property
    def display(self) -> str:
        return self.label or self.name.title()


DEFAULT_DIMENSIONS = (
    Dimension("topic_alignment", 0.35),
    Dimension("methodology_fit", 0.25),
    Dimension("novelty", 0.2),
    Dimension("experiment_coverage", 0.2),
)


@dataclass(frozen=True)
class TriageConfig:
    topics: Sequence[Topic]
    dimensions: Sequence[Dimension] = DEFAULT_DIMENSIONS
    pass_threshold: float = DEFAULT_THRESHOLD
    days_back: int = DEFAULT_DAYS_BACK
    max_per_topic: int | None = DEFAULT_MAX_PER_TOPIC
    paper_limit: int | None = None
    task_list_size: int = DEFAULT_TASK_LIST_SIZE
    max_content_chars: int = DEFAULT_MAX_CONTENT_CHARS
    page_chars: int | None = None  # whole pages; a number cuts their text before anything reads it
    language: str = "zh-CN"
    site_base_url: str = ""
    novelty_words: Sequence[str] = NOVELTY_WORDS
    experiment_words: Sequence[str] = EXPERIMENT_WORDS
    extra: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, conf: Mapping[str, Any]) -> "TriageConfig":
        """Read the nested document form (topics / relevance / fetch / runtime sections)."""
        fetch = conf.get("fetch") or {}
        relevance = conf.get("relevance") or {}
        runtime = conf.get("runtime") or {}
        summarization = conf.get("summarization") or {}
        topics = []
        for item in conf.get("topics") or []:
            query = item.get("query") or {}
            topics.append(
                Topic(
                    name=item["name"],
                    label=item.get("label") or "",
                    categories=tuple(query.get("categories") or ()),
                    include=tuple(query.get("include") or ()),
                    exclude=tuple(query.get("exclude") or ()),
                    interest_prompt=(item.get("interest_prompt") or "").strip(),
                )
            )
        dimensions = tuple(
            Dimension(d["name"], float(d.get("weight", 0.0)), d.get("description") or "")
            for d in relevance.get("scoring_dimensions") or []
        )
        return cls(
            topics=tuple(topics),
            dimensions=dimensions or DEFAULT_DIMENSIONS,
            pass_threshold=float(relevance.get("pass_threshold", DEFAULT_THRESHOLD)),
            days_back=int(fetch.get("days_back", DEFAULT_DAYS_BACK)),
            max_per_topic=int(fetch.get("max_papers_per_topic", DEFAULT_MAX_PER_TOPIC)),
            paper_limit=runtime.get("paper_limit"),
            task_list_size=int(summarization.get("task_list_size", DEFAULT_TASK_LIST_SIZE)),
            max_content_chars=int(summarization.get("max_content_chars", DEFAULT_MAX_CONTENT_CHARS)),
            language=(conf.get("openai") or {}).get("language", "zh-CN"),
            site_base_url=(conf.get("site") or {}).get("base_url", ""),
        )


TOPIC_SCHEMA = (
    "topic_idx int, topic string, topic_label string, categories array<string>, "
    "include array<string>, exclude array<string>, interest_prompt string"
)


def topics_df(spark: SparkSession, topics: Sequence[Topic]) -> DataFrame:
    """Topics as a table; as long as the configuration, so always small."""
    rows = [
        (i, t.name, t.display, list(t.categories), list(t.include), list(t.exclude), t.interest_prompt)
        for i, t in enumerate(topics)
    ]
    return spark.createDataFrame(rows, TOPIC_SCHEMA)


def dimensions_df(spark: SparkSession, dimensions: Sequence[Dimension]) -> DataFrame:
    rows = [(i, d.name, float(d.weight), d.description) for i, d in enumerate(dimensions)]
    return spark.createDataFrame(rows, "pos int, name string, weight double, description string")
