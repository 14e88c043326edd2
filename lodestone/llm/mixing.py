"""Problem 9: mixing sources to target weights.

Method: weighted fair queueing. The documents of a source are shuffled by a hash; each copy of a document gets a
virtual finish time, the tokens of its source up to and with it (earlier passes included) over the source's target
weight; the copies of all sources are put in the order of finish times and taken while the total stays within the
budget. Prefix sums run in two levels - sums of hash buckets, then within a bucket - so that a source that holds a
third of all documents is never one task's work.

Where the budget ends follows from the sources' sums alone: up to time t a source is served weight times t tokens, but
never more than its copies hold, and the budget is spent at the t at which these add up to it. Copies that finish by
then are taken without looking at their order, copies far beyond are never made; only those between - of each source no
more tokens than are still left and one document more - are looked at one by one. ``ordered`` gives
the mixture range-sorted by finish time.

Defined cases: sources that differ only in letter case, outer white space or ``-`` for ``_`` are one; null sources
and sources that are not listed have share 0 and are reported with it; documents without tokens are not used; a
listed source without texts, or with too few for its share, is exhausted and its part goes to the others in
proportion; ties in the hash are broken by the document id; an empty table gives a report of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.encode import VOCABULARY, token_counts
from lodestone.runtime import cut


def source_name(c: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), "-", "_")


def tidy_targets(targets: DataFrame) -> DataFrame:
    named = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source"))
    return named.agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """``id``, ``source`` and ``tokens`` of every document, as a written table."""
    base = docs.select(F.col(doc_id).alias("id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"))
    return cut(token_counts(base, ("id", "source"), path=path))


def queue(sizes: DataFrame, targets: DataFrame, seed: int = 11, bucket_rows: int = 20_000) -> DataFrame:
    """Every usable document with its place in its source's queue: ``id``, ``source``, ``tokens``, ``upto`` (tokens of the
    first pass up to and with it), ``whole`` (tokens of a pass), ``target_share`` and ``max_repeats``."""
    usable = sizes.where("tokens > 0 and id is not null").join(F.broadcast(tidy_targets(targets).where("target_share > 0 and max_repeats > 0")), "source")  # the listed sources
    buckets = max(16, sizes.count() // bucket_rows)
    order = F.xxhash64(F.lit(seed), "id")
    placed = usable.withColumn("order", order).withColumn("bucket", F.floor((F.col("order").cast("double") / 2.0**64 + 0.5) * buckets).cast("long"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    running = F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket"))
    whole = F.sum("in_bucket").over(W.partitionBy("source"))
    offsets = sums.select("source", "bucket", (running - F.col("in_bucket")).alias("before"), whole.alias("whole"))
    inside = F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("order", "id").rowsBetween(W.unboundedPreceding, 0))
    each = placed.withColumn("inside", inside).join(offsets, ["source", "bucket"])
    return each.select("id", "source", "tokens", (F.col("before") + F.col("inside")).alias("upto"), "whole", "target_share", "max_repeats")


def spent_at(sources: list[tuple[float, float]], budget: float) -> float:
    """The time at which sources of so much weight and so many tokens have been served the budget; never, if they hold less."""
    time, served, live = 0.0, 0.0, sorted((held / weight, weight) for weight, held in sources)
    while live:
        rate = sum(w for _, w in live)
        dry = live[0][0]
        if served + rate * (dry - time) >= budget:
            return time + (budget - served) / rate
        served, time = served + rate * (dry - time), dry
        live = [x for x in live if x[0] > dry]
    return float("inf")


def copies(queued: DataFrame, until: Column, after: Column | None = None) -> DataFrame:
    """The copies that finish by ``until`` (and after ``after``): ``id``, ``source``, ``pass`` (0 first), ``tokens``, ``finish``."""
    last = F.least(F.col("max_repeats") - 1, F.floor((until * F.col("target_share") - F.col("upto")) / F.col("whole")) + 1)  # one more than can be
    finish = (F.col("pass") * F.col("whole") + F.col("upto")) / F.col("target_share")
    made = queued.where(last >= 0).withColumn("pass", F.explode(F.sequence(F.lit(0), last.cast("int")))).withColumn("finish", finish)
    kept = made.where(finish <= until) if after is None else made.where((finish <= until) & (finish > after))
    return kept.select("id", "source", "pass", "tokens", "finish")


def mixture(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 11) -> DataFrame:
    """The copies taken: ``doc_id``, ``source``, ``pass``, ``tokens``, ``finish``. The budget defaults to the tokens of
    all documents of listed sources, so that the mixture is as large as what it is made from."""
    listed = sizes.join(F.broadcast(tidy_targets(targets).where("target_share > 0").select("source")), "source")
    if budget is None:
        budget = listed.agg(F.sum("tokens")).first()[0] or 0
    queued = cut(queue(sizes, targets, seed))
    held = queued.groupBy("source").agg(F.first("target_share").alias("w"), (F.max("whole") * F.max("max_repeats")).alias("held"), F.max("tokens").alias("longest")).collect()  # the listed sources
    level = spent_at([(r.w, float(r.held)) for r in held], float(budget))
    level = min(level, max((r.held / r.w for r in held), default=0.0)) * (1 - 1e-9)  # so that rounding never takes more than the budget
    sure = cut(copies(queued, F.lit(level)))
    left = budget - (sure.agg(F.sum("tokens")).first()[0] or 0)
    # of each source what can still fit, and the document after it, which ends the mixture if it is too long
    reach = float(max(left, 0) + max((r.longest for r in held), default=0))
    near = copies(queued, F.lit(level) + F.lit(reach) / F.col("target_share"), F.lit(level))
    upto = F.sum("tokens").over(W.orderBy("finish", "source", "id", "pass").rowsBetween(W.unboundedPreceding, 0))  # the tokens of a few documents a source
    edge = near.withColumn("upto", upto).where(F.col("upto") <= left).drop("upto")
    return sure.union(edge).select(F.col("id").alias("doc_id"), "source", "pass", "tokens", "finish")


def ordered(taken: DataFrame) -> DataFrame:
    """The mixture in its order: ranges of finish times, sorted within."""
    return taken.repartitionByRange("finish", "source", "doc_id", "pass").sortWithinPartitions("finish", "source", "doc_id", "pass")


def report(sizes: DataFrame, targets: DataFrame, taken: DataFrame) -> DataFrame:
    """Per source: target and actual share, tokens and documents there and taken, and repeats (most, mean, allowed)."""
    there = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens_available"), F.sum(F.when(F.col("tokens") > 0, 1).otherwise(0)).alias("documents_available"))
    per_doc = taken.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum("tokens").alias("tokens"))
    used = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens_taken"), F.count(F.lit(1)).alias("documents_used"), F.max("times").alias("most_repeats"), F.avg("times").alias("mean_repeats"))
    total = used.agg(F.sum("tokens_taken").alias("total"))
    goal = tidy_targets(targets).withColumnRenamed("source", "name")
    joined = there.join(goal, F.col("source") == F.col("name"), "full").withColumn("source", F.coalesce("source", "name")).join(used.withColumnRenamed("source", "u"), F.col("source") == F.col("u"), "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.round(F.coalesce(F.try_divide(zero("tokens_taken"), F.col("total")), F.lit(0.0)), 6)
    cap = zero("tokens_available") * zero("max_repeats")
    return joined.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), share.alias("actual_share"), zero("tokens_taken").alias("tokens_taken"), zero("tokens_available").alias("tokens_available"),
        zero("documents_available").alias("documents_available"), zero("documents_used").alias("documents_used"), zero("most_repeats").alias("repeats"), F.round(F.coalesce("mean_repeats", F.lit(0.0)), 6).alias("mean_repeats"), zero("max_repeats").alias("max_repeats"),
        ((zero("target_share") > 0) & (zero("tokens_taken") >= cap)).alias("exhausted"),
    )
