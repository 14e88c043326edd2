"""Aggregations, pivots, metrics and correlation. Every order is total, so results do not depend on the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.relational import blank, or_unknown


def filled(column: str) -> Column:
    return F.when(~blank(F.col(column)), F.col(column))


def joined_set(column: str, by: str = ", ") -> Column:
    """Distinct values that are not blank, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(filled(column).cast("string"))), by)


def counts(df: DataFrame, keys: Sequence[str], name: str = "question_count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def dominant(df: DataFrame, keys: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    """The commonest value that is not blank, the smallest on ties; two aggregates, no per-group buffer of values."""
    per = df.where(~blank(F.col(column))).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    return per.groupBy(*keys).agg(F.min_by(F.col(column), F.struct((-F.col("__n")).alias("n"), F.col(column))).alias(name or column))


def weighted(df: DataFrame, key: str, weight: str | None) -> DataFrame:
    """Rows and weight per value; a weight that is no number counts 1; without weights the rows are the weight."""
    w = F.coalesce(F.col(weight).try_cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    return df.groupBy(or_unknown(F.col(key)).alias(key)).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(w), 4).alias("weight"))


def reliability(df: DataFrame, keys: Sequence[str], weight: str, confidence: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.coalesce(F.col(weight).try_cast("double"), F.lit(0.0))), 4).alias("total_weight"), F.round(F.avg(F.col(confidence).try_cast("double")), 4).alias("mean_confidence"))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Rows by one column and counts by another's given values, 0 where there are none; blanks as Unknown, and what is
    not among the values under ``other``.

    The values are given, so that the plan has no extra job to find them and its columns never change.
    """
    shown = or_unknown(F.col(column).cast("string"))
    return df.groupBy(or_unknown(F.col(row)).alias(row)).agg(*[F.count_if(shown == v).alias(str(v)) for v in values], F.count_if(~shown.isin(*[str(v) for v in values])).alias("other"))


def pivot_sums(df: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """Sums by the given values of a column; what is not among them, nulls too, is under ``other``."""
    total = lambda test: F.round(F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0.0)), 4)
    return df.groupBy(row).agg(*[total(F.col(column) == v).alias(str(v)) for v in values], total(~F.coalesce(F.col(column).isin(*values), F.lit(False))).alias("other"))


def correlation(df: DataFrame, item: str, at: str) -> DataFrame:
    """Pearson's correlation of items' counts over the values of ``at``: ``item_a``, ``item_b``, ``r``; 0 without variance.

    From sums over the few values of ``at``: counts that are 0 are not stored, so the join is of the counts alone.
    """
    kept = df.where(~blank(F.col(item)) & ~blank(F.col(at).cast("string")))
    n = kept.groupBy(item, at).agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = n.agg(F.count_distinct(at).cast("double").alias("m"))
    sums = n.groupBy(item).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    a = n.select(F.col(item).alias("item_a"), at, F.col("n").alias("na"))
    b = n.select(F.col(item).alias("item_b"), at, F.col("n").alias("nb"))
    cross = a.join(b, at).groupBy("item_a", "item_b").agg(F.sum(F.col("na") * F.col("nb")).alias("ab"))
    sa, sb = sums.toDF("item_a", "sa", "qa"), sums.toDF("item_b", "sb", "qb")
    pairs = sa.crossJoin(sb).join(cross, ["item_a", "item_b"], "left").crossJoin(F.broadcast(m))  # items are categories
    va, vb = F.col("m") * F.col("qa") - F.col("sa") * F.col("sa"), F.col("m") * F.col("qb") - F.col("sb") * F.col("sb")
    r = F.try_divide(F.col("m") * F.coalesce("ab", F.lit(0.0)) - F.col("sa") * F.col("sb"), F.sqrt(va) * F.sqrt(vb))
    return pairs.select("item_a", "item_b", F.round(F.coalesce(r, F.lit(0.0)), 6).alias("r"))


def correlation_graph(r: DataFrame, least: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """Nodes on a circle and the edges of pairs whose correlation is at least ``least``."""
    place = F.row_number().over(Window.orderBy("node")) - 1
    nodes = r.select(F.col("item_a").alias("node")).distinct()
    total = nodes.agg(F.count(F.lit(1)).alias("n"))
    at = nodes.withColumn("i", place).crossJoin(F.broadcast(total))
    angle = 2 * F.pi() * F.col("i") / F.col("n")
    edges = r.where((F.col("item_a") < F.col("item_b")) & (F.col("r") >= least)).select(F.col("item_a").alias("source"), F.col("item_b").alias("target"), "r")
    return at.select("node", F.round(F.cos(angle), 6).alias("x"), F.round(F.sin(angle), 6).alias("y")), edges


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Aggregates of one pass as rows ``metric``, ``value`` (double)."""
    one = df.agg(*[c.cast("double").alias(name) for name, c in metrics.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in metrics])).alias("m")).select("m.metric", "m.value")


def metric(metrics: DataFrame, name: str, otherwise: float) -> DataFrame:
    """One row: the first value of a metric, or ``otherwise``."""
    return metrics.where(F.col("metric") == name).agg(F.coalesce(F.min("value"), F.lit(otherwise)).alias(name))


def prefixed(metrics: DataFrame, prefix: str) -> DataFrame:
    """Metrics whose name begins with a prefix, without it."""
    return metrics.where(F.col("metric").startswith(prefix)).withColumn("metric", F.substring("metric", len(prefix) + 1, 1_000_000))


def value_counts(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    return df.where(~blank(F.col(column))).groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.concat(F.lit(prefix), F.col(column)).alias("metric"), "value")


def accuracy(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field the share of rows with a gold label whose prediction equals it without case and outer blanks; 0 without such rows."""
    tidy = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    metrics: dict[str, Column] = {}
    for f in fields:
        has = ~blank(F.col(f"{f}_gold"))
        metrics[f"{f}_accuracy"] = F.round(F.coalesce(F.avg(F.when(has, (tidy(f"{f}_pred") == tidy(f"{f}_gold")).cast("double"))), F.lit(0.0)), 4)
        metrics[f"{f}_labelled"] = F.count_if(has)
    return metric_rows(pairs, metrics)


def confusion(pairs: DataFrame, field: str) -> DataFrame:
    """A row per gold label and prediction that meet, with their number; pairs with a null on either side are no case."""
    gold, pred = F.col(f"{field}_gold"), F.col(f"{field}_pred")
    return pairs.where(gold.isNotNull() & pred.isNotNull()).groupBy(gold.alias("gold"), pred.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def common_confusions(pairs: DataFrame, fields: Sequence[str], top: int = 25) -> DataFrame:
    """The commonest differences of each field, compared without case but with outer blanks."""
    each = None
    for f in fields:
        gold, pred = F.col(f"{f}_gold"), F.col(f"{f}_pred")
        wrong = pairs.where(~blank(gold) & (F.lower(gold) != F.lower(F.coalesce(pred, F.lit(""))))).groupBy(gold.alias("gold_label"), F.coalesce(pred, F.lit("")).alias("predicted_label")).agg(F.count(F.lit(1)).alias("count"))
        part = wrong.orderBy(F.desc("count"), "gold_label", "predicted_label").limit(top).select(F.lit(f).alias("field"), "gold_label", "predicted_label", "count")
        each = part if each is None else each.unionByName(part)
    return each


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], text: Column, n: int, name: str, by: str = " || ") -> DataFrame:
    """The texts of each group's first n rows, joined in order. The window's rank limit is pushed below its shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = df.withColumn("__place", place).where(F.col("__place") <= n)
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", text.alias("t")))), lambda s: s["t"]), by).alias(name))


def split_counts(df: DataFrame, column: str, by: str = r",\s*", name: str = "value") -> DataFrame:
    """Values of list-like text, one row each, counted."""
    return df.select(F.explode(F.split(column, by)).alias(name)).where(~blank(F.col(name))).groupBy(name).agg(F.count(F.lit(1)).alias("count"))


def cume_dist(df: DataFrame, column: str, name: str) -> DataFrame:
    """Share of rows with a value up to each row's, by counts per distinct value instead of one window over all rows."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy(F.col(column).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(Window.partitionBy())
    ranks = per.select(F.col(column).alias("__v"), F.round(upto / total, 4).alias(name))
    return df.join(ranks, F.col(column).eqNullSafe(F.col("__v"))).drop("__v")
