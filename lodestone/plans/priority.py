"""Topic priority and what derives from it: tiers, shortlists, day plans, hype against evidence.

Topics are groups of a fact table, so every step after the first aggregate is over few rows; the aggregate itself
combines before its one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.operators.aggregates import cume_dist
from lodestone.operators.relational import scaled

# Weights of a topic's parts, and hours by difficulty.
WEIGHTS = {"frequency": 0.30, "recency": 0.25, "years": 0.15, "shifts": 0.10, "patterns": 0.10, "directness": 0.05, "confusion": 0.05}
HOURS = {"easy": 0.75, "medium": 1.25, "hard": 1.75}
HOURS_ELSE = 1.25


def parts(facts: DataFrame, keys: Sequence[str], weight: Column, recency: Column, year: Column, shift: Column, pattern: Column, direct: Column, confusion: Column | None = None) -> DataFrame:
    """Per topic: rows, summed weight and recency, distinct years, shifts and patterns, mean directness, confusion."""
    return facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("question_count"),
        F.round(F.sum(weight.cast("decimal(18,6)")), 4).cast("double").alias("source_weighted_frequency"),
        F.round(F.sum(recency.cast("decimal(18,6)")), 4).cast("double").alias("recency_score"),
        F.count_distinct(year).alias("year_count"),
        F.count_distinct(shift).alias("shift_count"),
        F.count_distinct(pattern).alias("pattern_count"),
        F.round(F.avg(direct.cast("decimal(18,6)")), 6).cast("double").alias("directness"),
        (F.sum(confusion) if confusion is not None else F.lit(0)).cast("double").alias("confusion"),
    )


def scores(topics: DataFrame, caps: dict[str, float | Column]) -> DataFrame:
    """``raw_score``: the weighted shares of each part's cap."""
    of = {"frequency": "source_weighted_frequency", "recency": "recency_score", "years": "year_count", "shifts": "shift_count", "patterns": "pattern_count", "directness": "directness", "confusion": "confusion"}
    raw = sum((F.lit(WEIGHTS[k]) * scaled(F.col(c).cast("double"), caps.get(k, 1.0)) for k, c in of.items()), F.lit(0.0))
    return topics.withColumn("raw_score", F.round(raw, 4))


def ranked(scored: DataFrame) -> DataFrame:
    """Adds ``percentile_rank`` (share of topics with at most this score) and ``priority_tier``."""
    return cume_dist(scored, "raw_score", "percentile_rank").withColumn("priority_tier", rules.tier(F.col("percentile_rank")))


def effort(topics: DataFrame, difficulty: Column, kinds: Column) -> DataFrame:
    """Adds expected contribution, study hours and their quotient."""
    pairs = F.create_map(*[F.lit(x) for kv in HOURS.items() for x in kv])
    hours = F.round(F.coalesce(F.try_element_at(pairs, difficulty), F.lit(HOURS_ELSE)) + 0.2 * F.least(kinds, F.lit(5)), 2)
    expected = F.round(F.col("raw_score") * 100, 2)
    return topics.withColumn("study_hours_required", hours).withColumn("expected_marks_contribution", expected).withColumn("roi", F.round(expected / F.greatest(hours, F.lit(0.5)), 2))


def high_roi(topics: DataFrame, roi_share: float = 0.65, score_share: float = 0.5) -> DataFrame:
    """Topics at or over both quantiles (exact, interpolated; compared on six decimals)."""
    cuts = topics.agg(F.round(F.percentile("roi", F.lit(roi_share)), 6).alias("__roi"), F.round(F.percentile("expected_marks_contribution", F.lit(score_share)), 6).alias("__score"))
    return topics.crossJoin(F.broadcast(cuts)).where("round(roi, 6) >= __roi and round(expected_marks_contribution, 6) >= __score").drop("__roi", "__score")  # one row


def low_frequency(topics: DataFrame, most: int, last_year: str, recent: int, difficulty: Column) -> DataFrame:
    """Topics seen at most so often, with what to do about them."""
    action = F.when(difficulty == "easy", "quick summary revision").when(F.col(last_year) >= recent, "revise after high-priority topics").otherwise("read once the day before")
    return topics.where(F.col("question_count") <= most).withColumn("study_action", action)


def legacy(facts: DataFrame, keys: Sequence[str], year: str, hard: Column) -> DataFrame:
    """Score by count, recency (2 for the newest year, else 1) and the share of hard kinds; probability by count."""
    newest = facts.agg(F.max(year).alias("__newest"), F.count(F.lit(1)).alias("__total"))
    per = facts.crossJoin(F.broadcast(newest)).groupBy(*keys).agg(F.count(F.lit(1)).alias("question_count"), F.sum(F.greatest(F.col(year) - F.col("__newest") + 1, F.lit(0)) + 1).cast("long").alias("recency"), F.avg(hard.cast("double")).alias("hard"), F.max("__total").alias("total"))  # one row
    return per.select(*keys, "question_count", "recency", F.round((F.col("question_count") + 0.7 * F.col("recency")) * (1 + 0.15 * F.col("hard")), 6).alias("priority_score"), F.round(F.col("question_count") / F.col("total"), 8).alias("probability"))


def hype(topics: DataFrame, hype_column: str, weight: str) -> DataFrame:
    """``mismatch_type`` of community interest against weighted frequency."""
    cuts = topics.agg(*[F.round(F.percentile(weight, F.lit(q)), 6).alias(f"__{n}") for n, q in (("q60", 0.60), ("q50", 0.50), ("q70", 0.70))])
    h, w = F.col(hype_column), F.round(F.col(weight), 6)
    kind = F.when((h > 0) & (w >= F.col("__q60")), "validated_by_data").when((h > 2) & (w < F.col("__q50")), "overhyped").when((h <= 1) & (w >= F.col("__q70")), "underhyped_hidden_gem").when(h == 0, "insufficient_data").otherwise("mixed_signal")
    return topics.crossJoin(F.broadcast(cuts)).withColumn("mismatch_type", kind).drop("__q60", "__q50", "__q70")  # one row


def study_plan(topics: DataFrame, horizons: Sequence[int] = (3, 5, 7, 14), hours_a_day: float = 4.0, slack: float = 0.05, order: Sequence[Column] = ()) -> DataFrame:
    """Topics in order laid into days of a few hours, split where a day ends; what is left of a day at the end, if it
    is no more than ``slack``, is given up.

    Each allocation depends on the one before, so it is a fold over the sorted topics of one plan; only as many topics
    as a plan can hold are brought into the array, whatever the table's size.
    """
    longest = max(horizons)
    most = int(longest * hours_a_day / slack) + 1
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    item = F.struct(F.col("chapter"), F.col("subtopic"), F.col("study_hours_required").alias("need"))
    first = topics.withColumn("__o", rank).orderBy("__o").limit(most)
    sorted_ = first.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__o"), item.alias("t")))), lambda s: s["t"]).alias("topics"))
    plans = sorted_.withColumn("plan_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    # one step per topic and day at most: a topic's hours are cut along the running total of hours
    row = "struct<day:int,hours:double,chapter:string,subtopic:string>"
    state = F.struct(F.lit(1).alias("day"), F.lit(float(hours_a_day)).alias("left"), F.array().cast(f"array<{row}>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        # days a topic can reach over: its hours over the day's, rounded up, and one for the day it begins in
        tries = F.sequence(F.lit(1), (F.ceil(t["need"] / hours_a_day) + 2).cast("int"))
        begin = F.struct(acc["day"].alias("day"), acc["left"].alias("left"), acc["out"].alias("out"), t["need"].alias("need"))

        def lay(a: Column, _: Column) -> Column:
            give = F.round(F.least(a["left"], a["need"]), 2)
            goes = (a["need"] > slack) & (a["day"] <= F.col("plan_days"))
            rest = F.round(a["left"] - give, 2)
            over = rest <= slack
            entry = F.struct(a["day"].alias("day"), give.alias("hours"), t["chapter"].alias("chapter"), t["subtopic"].alias("subtopic"))
            laid = F.struct(F.when(over, a["day"] + 1).otherwise(a["day"]).alias("day"), F.when(over, F.lit(float(hours_a_day))).otherwise(rest).alias("left"), F.concat(a["out"], F.array(entry)).alias("out"), F.round(a["need"] - give, 2).alias("need"))
            return F.when(goes, laid).otherwise(a)

        done = F.aggregate(tries, begin, lay)
        return F.struct(done["day"].alias("day"), done["left"].alias("left"), done["out"].alias("out"))

    folded = plans.withColumn("plan", F.aggregate("topics", state, step)["out"])
    return folded.select("plan_days", F.posexplode("plan").alias("seq", "p")).select("plan_days", (F.col("seq") + 1).alias("seq"), "p.day", F.col("p.hours").alias("allocated_hours"), "p.chapter", "p.subtopic")
