"""Practice: attempts, sessions, weakness, sampling of questions, forecasts of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.relational import blank

ALPHA, TREND_PART, LEAST_SPREAD = 0.55, 0.55, 4.0


def scored(attempts: DataFrame, chosen: str, correct: str, plus: int = 5, minus: int = -1) -> DataFrame:
    """Adds ``attempted``, ``is_correct``, ``score_delta`` and ``result``; a blank choice is skipped."""
    has = ~blank(F.col(chosen))
    right = has & F.coalesce(F.upper(F.trim(chosen)) == F.upper(F.trim(correct)), F.lit(False))
    return attempts.withColumns({"attempted": has.cast("int"), "is_correct": right.cast("int"), "score_delta": F.when(right, plus).when(has, minus).otherwise(0), "result": F.when(right, "correct").when(has, "wrong").otherwise("skipped")})


def share(a: Column, b: Column, times: float = 100.0) -> Column:
    return F.round(F.coalesce(F.try_divide(a * times, b), F.lit(0.0)), 4)


def sessions(attempts: DataFrame, keys: Sequence[str], at: str, full: int = 5) -> DataFrame:
    """Per session: start, questions, attempted, correct, score and rates (0 where there is nothing to divide by)."""
    s = attempts.groupBy(*keys).agg(F.min(at).alias("attempted_at"), F.count(F.lit(1)).alias("questions"), F.sum("attempted").alias("attempted"), F.sum("is_correct").alias("correct"), F.sum("score_delta").alias("score"))
    n = F.col("questions")
    return s.withColumns({"max_score": n * full, "score_percent": share(F.col("score"), n * full), "accuracy": share(F.col("correct"), F.col("attempted")), "attempt_rate": share(F.col("attempted"), n)})


def numbered(s: DataFrame, learner: str, at: str = "attempted_at", key: Sequence[str] = ()) -> DataFrame:
    """``mock_number`` of each learner's sessions by time."""
    return s.withColumn("mock_number", F.row_number().over(Window.partitionBy(learner).orderBy(at, *key)))


def verdict(score: Column, accuracy: Column) -> Column:
    return F.when((score >= 80) & (accuracy >= 85), "Excellent").when((score >= 65) & (accuracy >= 75), "Good").when(score >= 45, "Average").otherwise("Needs Work")


def weakness(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Twice the wrong, 0.8 times the skipped, and the share of attempts that were not right."""
    w = attempts.groupBy(*keys).agg(F.count_if(F.col("result") == "wrong").alias("wrong"), F.count_if(F.col("result") == "skipped").alias("skipped"), F.sum("attempted").alias("attempted"), F.sum("is_correct").alias("correct"))
    acc = F.coalesce(F.try_divide(F.col("correct"), F.col("attempted")), F.lit(0.0))
    return w.withColumn("accuracy", F.round(acc, 4)).withColumn("weakness_score", F.round(2 * F.col("wrong") + 0.8 * F.col("skipped") + (1 - acc), 4))


def adaptive_weight(bank: DataFrame, weak: DataFrame, keys: Sequence[str], raw: str, factor: float = 2.5) -> DataFrame:
    j = bank.join(weak.select(*keys, "weakness_score"), list(keys), "left").withColumn("weakness_score", F.coalesce("weakness_score", F.lit(0.0)))
    return j.withColumn("adaptive_weight", F.round(F.coalesce(F.col(raw).cast("double"), F.lit(1.0)) + factor * F.col("weakness_score"), 6))


def fresh(bank: DataFrame, attempts: DataFrame, key: str, at: str, target: int, tie: str) -> DataFrame:
    """The bank without what was asked in the last three times ``target`` attempts, if that leaves enough, else all of it."""
    recent = attempts.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(3 * target).select(key).distinct()
    left = bank.join(F.broadcast(recent), key, "left_anti")  # at most 3 * target rows
    enough = left.limit(target).agg((F.count(F.lit(1)) >= target).alias("__enough"))
    seen = bank.join(F.broadcast(recent), key, "left_semi")
    kept = seen.crossJoin(F.broadcast(enough)).where("not __enough").drop("__enough")  # one row
    return left.unionByName(kept)


def sample_key(key: str, weight: str, seed: int) -> Column:
    """Exponential race: the smaller ``-ln(u) / w``, the earlier; u is a hash of the row's key, so the draw repeats."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2**53)).cast("double") + 1) / float(2**53 + 1)
    return -F.log(u) / F.greatest(F.col(weight), F.lit(1e-9))


def weighted_sample(bank: DataFrame, key: str, weight: str, section: str, want: dict[str, int], total: int, seed: int = 7) -> DataFrame:
    """Without replacement: so many of each section, topped up from the rest to the total; each part is a top-k."""
    raced = bank.withColumn("__race", sample_key(key, weight, seed))
    parts = [raced.where(F.col(section) == s).orderBy("__race", key).limit(n).withColumn("__part", F.lit(0)) for s, n in want.items()]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    rest = raced.join(F.broadcast(picked.select(key)), key, "left_anti").orderBy("__race", key).limit(total).withColumn("__part", F.lit(1))  # at most total rows
    shuffled = picked.unionByName(rest).orderBy("__part", "__race", key).limit(total)
    return shuffled.withColumn("position", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed + 1), F.col(key))))).drop("__race", "__part")


def forecast(series: DataFrame, keys: Sequence[str], at: str, value: str, horizon: int = 3) -> DataFrame:
    """Per series: 0.55 of the fitted line and 0.45 of the exponentially weighted mean, within 0 and 100, with a band of
    the residuals' spread (4 at least). Fewer than two points give one row with status ``insufficient_data``.

    One learner's sessions are one array; what is not finite is left out.
    """
    good = series.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    s = good.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), F.col(value).cast("double").alias("y")))), lambda x: x["y"]).alias("ys"))
    n = F.size("ys").cast("double")
    idx = F.sequence(F.lit(0), F.size("ys") - 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    my = total(F.col("ys")) / n
    mx = (n - 1) / 2
    sxy = total(F.zip_with("ys", idx, lambda y, i: (i - mx) * (y - my)))
    sxx = total(F.transform(idx, lambda i: (i - mx) * (i - mx)))
    f = s.withColumn("n", n.cast("int")).withColumn("slope", F.coalesce(F.try_divide(sxy, sxx), F.lit(0.0)))
    f = f.withColumn("intercept", my - F.col("slope") * mx)
    ema = F.aggregate(F.slice("ys", 2, F.greatest(F.size("ys") - 1, F.lit(0))), F.col("ys")[0], lambda acc, y: F.lit(ALPHA) * y + F.lit(1 - ALPHA) * acc)
    residual = F.zip_with("ys", idx, lambda y, i: y - (F.col("intercept") + F.col("slope") * i))
    f = f.withColumn("ema", ema).withColumn("spread", F.greatest(F.sqrt(total(F.transform(residual, lambda r: r * r)) / n), F.lit(LEAST_SPREAD)))
    steps = f.withColumn("step", F.explode(F.when(F.col("n") >= 2, F.sequence(F.lit(1), F.lit(horizon))).otherwise(F.array(F.lit(0)))))
    at_step = F.lit(TREND_PART) * (F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))) + F.lit(1 - TREND_PART) * F.col("ema")
    # six decimals first, so that the order of a sum does not decide the second
    held = lambda c: F.when(F.col("n") >= 2, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(c, 6))), 2))
    status = F.when(F.col("n") >= 2, "ok").otherwise("insufficient_data")
    return steps.select(*keys, "n", "step", status.alias("status"), held(at_step).alias("forecast"), held(at_step - F.col("spread")).alias("low"), held(at_step + F.col("spread")).alias("high"))


def latest_session(s: DataFrame, learner: str, session: str, at: str) -> DataFrame:
    return s.groupBy(learner).agg(F.max_by(session, F.struct(at, session)).alias(session))
