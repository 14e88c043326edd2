"""Checks of labels against the taxonomy, the review queue, label evaluation and format strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.aggregates import dominant, top_per_group
from lodestone.operators.relational import blank, keep_first, numbered, union_ranked
from lodestone.runtime import cut

# Fixed value: the note on a micro concept of little confidence.
NOTE = "Micro-concept uncertain; trust chapter/subtopic more."


def guardrails(leaves: DataFrame, separators: str = ";") -> DataFrame:
    """Per chapter the subtopics and micro concepts that are allowed, from a taxonomy index."""
    micro = F.filter(F.transform(F.split(F.coalesce("ncert_concept", F.lit("")), f"[{separators}]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return leaves.groupBy("chapter").agg(F.collect_set("subtopic").alias("allowed_subtopics"), F.array_distinct(F.flatten(F.collect_list(micro))).alias("allowed_micro"))


def micro_allowed(micro: Column, subtopics: Column, allowed: Column) -> Column:
    """In either list, or part of an allowed one, or the other way round; anything goes where none are listed."""
    m = F.lower(F.trim(F.coalesce(micro, F.lit(""))))
    within = F.exists(allowed, lambda a: m.contains(a) | ((m != "") & a.contains(m)))
    return (F.size(allowed) == 0) | F.exists(subtopics, lambda s: F.lower(s) == m) | within


def validated(df: DataFrame, rails: DataFrame) -> DataFrame:
    """Flags and reasons of rows whose chapter, subtopic or micro concept the taxonomy does not allow; a micro concept
    of little confidence gives way to the subtopic. One pass, and applying it twice adds no reason twice."""
    j = df.join(F.broadcast(rails) if rails.limit(10_001).count() <= 10_000 else rails, "chapter", "left")
    known = F.col("allowed_subtopics").isNotNull()
    bad_sub = known & ~F.coalesce(F.array_contains("allowed_subtopics", F.col("subtopic")), F.lit(False))
    bad_micro = known & ~F.coalesce(micro_allowed(F.col("micro_concept"), F.col("allowed_subtopics"), F.col("allowed_micro")), F.lit(False))
    why = F.array_join(F.array_compact(F.array(F.when(~known, "unknown chapter"), F.when(bad_sub, "subtopic not allowed"), F.when(bad_micro, "micro concept not allowed"))), "; ")
    given = F.col("micro_confidence").try_cast("double") if "micro_confidence" in df.columns else F.lit(None).cast("double")
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(given, F.when(why != "", 0.45).otherwise(0.82)))), 2)
    unsure = confidence < 0.70
    return j.select(*[c for c in df.columns if c not in ("micro_concept", "micro_confidence")], F.when(unsure & ~blank(F.col("subtopic")), F.col("subtopic")).otherwise(F.col("micro_concept")).alias("micro_concept"), confidence.alias("micro_confidence"), (why != "").alias("taxonomy_mismatch"), why.alias("taxonomy_mismatch_reason"), F.when(unsure, NOTE).otherwise("").alias("micro_note"))


def review_queue(rows: DataFrame, high_topics: DataFrame, key: str, frequency: str, recency: str, confidence: str, micro_confidence: str, size: int = 100, first: int = 50, each: int = 25) -> DataFrame:
    """The most important rows, mismatches, and rows of high topics, without repeats, filled up by importance.

    Every part is a top-k, so nothing but its rows moves; ``reason`` says which part a row came by.
    """
    importance = F.round(0.55 * F.coalesce(F.col(frequency), F.lit(0.0)) + 0.35 * F.coalesce(F.col(recency), F.lit(0.0)) + 0.10 * (1 - F.coalesce(F.col(confidence), F.lit(0.0))), 6)
    r = cut(rows.withColumn("importance", importance))  # scored once for all four parts
    by = [F.desc("importance"), F.col(key)]
    top = r.orderBy(*by).limit(first).withColumn("reason", F.lit("important"))
    wrong = r.where("taxonomy_mismatch").orderBy(*by).limit(each).withColumn("reason", F.lit("taxonomy mismatch"))
    hot = r.join(high_topics.select("chapter", "subtopic").distinct(), ["chapter", "subtopic"], "left_semi").orderBy(F.desc(frequency), F.asc(micro_confidence), F.col(key)).limit(each).withColumn("reason", F.lit("high topic"))
    picked = cut(union_ranked([top, wrong, hot], [key], by))
    filler = r.join(picked.select(key), key, "left_anti").orderBy(*by).limit(size).withColumn("reason", F.lit("filler"))
    return union_ranked([picked, filler], [key], by).withColumn("__f", (F.col("reason") == "filler").cast("int")).orderBy("__f", *by).limit(size).drop("__f")


def suggestions(reviewed: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows under review with their columns as suggestions (``old name -> new name``)."""
    return reviewed.where("needs_review").select(*[F.col(a).alias(b) for a, b in columns.items()])


def format_strategy(facts: DataFrame, high: DataFrame, pattern: str, heading: str, text: Column, order: list[Column], n: int = 5, advice: dict[str, Column] | None = None) -> DataFrame:
    """Per high topic the commonest pattern and heading and its first questions. ``advice`` adds columns of the caller's
    texts, made from those there (``name -> column``)."""
    keys = ["chapter", "subtopic"]
    of = facts.join(high.select(*keys).distinct(), keys, "left_semi")
    p = dominant(of, keys, pattern, "dominant_pattern")
    h = dominant(of, keys, heading, "dominant_heading")
    q = top_per_group(of, keys, order, text, n, "representative_questions")
    j = high.join(p, keys, "left").join(h, keys, "left").join(q, keys, "left")
    return j.withColumns(advice or {})


def without(labels: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column does not hold a part, without regard to case; nulls stay. ``without(labels, "verification_source",
    "ai_")`` leaves the labels of people."""
    return labels.where(~F.coalesce(F.lower(column).contains(part), F.lit(False)))


def unlabelled(queue: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows still to be labelled."""
    return queue.join(labels.select(key), key, "left_anti")


def batches(rows: DataFrame, key: str, size: int = 5, slices: int = 256) -> DataFrame:
    """``batch`` from 0: rows by key in batches of ``size``. Numbers run on over ranges of the key, so no task numbers all."""
    return numbered(rows, key, "__at", slices).withColumn("batch", F.floor(F.col("__at") / size)).drop("__at")


def latest_labels(labels: DataFrame, key: str, at: str) -> DataFrame:
    return keep_first(labels, [key], [F.col(at).desc_nulls_last()])
