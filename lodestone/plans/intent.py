"""Questions in words to tables: an ordered list of intents, each a plan over the topic facts; no language model."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that call for a view of the data, tried in order.
INTENTS = (
    ("top", ("top", "best", "most important", "highest")),
    ("compare", ("compare", " vs ", "versus", "difference between")),
    ("frequency", ("frequency", "how often", "most asked")),
    ("suspicious", ("suspicious", "mismatch", "wrong label")),
    ("tiers", ("tier", "distribution", "share of")),
    ("trend", ("trend", "over the years", "by year", "year wise")),
    ("heatmap", ("heatmap", "matrix", "chapter by")),
)
INTENT_ELSE = "table"


def intent(question: str) -> str:
    lower = f" {question.lower()} "
    return next((name for name, words in INTENTS if any(w in lower for w in words)), INTENT_ELSE)


def named(question: str, chapters: list[str]) -> list[str]:
    """Chapters a question names, in the order it names them."""
    lower = question.lower()
    return [c for _, c in sorted((lower.find(c.lower()), c) for c in chapters if re.search(rf"\b{re.escape(c.lower())}\b", lower))]


def answer(question: str, topics: DataFrame, facts: DataFrame, chapters: list[str], n: int = 10) -> tuple[str, DataFrame]:
    """The intent and its table. ``topics`` has a row per topic, ``facts`` one per occurrence; ``chapters`` are the taxonomy's."""
    kind = intent(question)
    if kind == "top":
        return kind, topics.orderBy(F.desc("raw_score"), "chapter", "subtopic").limit(n).select("chapter", "subtopic", "raw_score", "priority_tier")
    if kind == "compare":
        wanted = named(question, chapters)[:2]
        return kind, topics.where(F.col("chapter").isin(*wanted)).groupBy("chapter").agg(F.round(F.sum("source_weighted_frequency"), 4).alias("weighted_frequency"), F.sum("question_count").alias("question_count"))
    if kind == "frequency":
        return kind, topics.groupBy("chapter").agg(F.sum("question_count").alias("question_count"), F.round(F.sum("source_weighted_frequency"), 4).alias("weighted_frequency")).orderBy(F.desc("question_count"), "chapter")
    if kind == "suspicious":
        return kind, topics.where("question_count <= 1").groupBy("chapter").agg(F.count(F.lit(1)).alias("topics"))
    if kind == "tiers":
        return kind, topics.groupBy("priority_tier").agg(F.count(F.lit(1)).alias("topics"))
    if kind == "trend":
        return kind, facts.groupBy("year").agg(F.count(F.lit(1)).alias("question_count"))
    if kind == "heatmap":
        return kind, facts.groupBy("chapter", "year").agg(F.count(F.lit(1)).alias("question_count"))
    return kind, topics.limit(n)
