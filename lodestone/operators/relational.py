"""Filters, projections, joins, set and upsert operators over DataFrames with explicit orders and null rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import contains_all_columns


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def or_unknown(c: Column) -> Column:
    return F.when(blank(c), "Unknown").otherwise(c)


def number(c: Column, otherwise: float | None = 0.0) -> Column:
    """Text as a double; what is no number becomes ``otherwise``."""
    got = c.try_cast("double")
    return got if otherwise is None else F.coalesce(got, F.lit(otherwise))


def scaled(c: Column, cap: float | Column) -> Column:
    """A share of a cap, held within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.try_divide(c, cap if isinstance(cap, Column) else F.lit(cap)), F.lit(1.0)))


def flag(c: Column) -> Column:
    """``true`` and ``yes`` in any case are true, everything else - null too - is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "yes"), F.lit(False))


def aligned(df: DataFrame, schema: T.StructType, extras: bool = False) -> DataFrame:
    """The schema's columns in its order and types, missing ones as null; other columns behind them if asked for."""
    have = set(df.columns)
    wanted = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in schema.names] if extras else []
    return df.select(*wanted, *rest)


def existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only those of the columns that are there, in the order asked for."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def compact(df: DataFrame, wide: Sequence[str], order: Sequence[Column], columns: int = 8, rows: int = 30) -> DataFrame:
    """A table for a report: without the wide columns, the first few columns as text and the first few rows in the order."""
    kept = [c for c in df.columns if c not in wide][:columns]
    return df.orderBy(*order).limit(rows).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in kept])


def approved(tables: dict[str, DataFrame], names: Sequence[str]) -> dict[str, DataFrame]:
    """Only the tables that are on the list and are there, in the list's order."""
    return {n: tables[n] for n in names if n in tables}


def facets(df: DataFrame, chosen: dict[str, Sequence]) -> DataFrame:
    """Rows within all chosen values; an empty choice restricts nothing."""
    for column, values in chosen.items():
        if values:
            df = df.where(F.col(f"`{column}`").isin(*values))
    return df


def search(df: DataFrame, needle: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that hold the needle in any of the columns; an empty needle restricts nothing."""
    return df.where(contains_all_columns(columns or df.columns, needle)) if needle else df


def filtered_or_head(df: DataFrame, condition: Column, order: Sequence[Column], n: int) -> DataFrame:
    """Rows that meet the condition; where none does, the first n in the order. One pass decides by a window-free aggregate."""
    met = df.where(condition)
    any_ = met.limit(1).agg((F.count(F.lit(1)) > 0).alias("any"))
    head = df.orderBy(*order).limit(n).crossJoin(F.broadcast(any_)).where("not any").drop("any")  # one row on the right
    return met.unionByName(head)


def where_set(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set where the condition holds and left as they are elsewhere."""
    hold = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hold, v).otherwise(F.col(f"`{c}`")) for c, v in values.items()})


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the order (which should end in a unique column)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def keep_first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """As ``keep_first`` for orders of plain ascending columns, by an aggregate: it combines before the shuffle and
    so stands a key that holds a third of all rows."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def numbered(df: DataFrame, key: str, name: str, slices: int = 256) -> DataFrame:
    """``name``: the place from 0 of each row by a key, nulls first. Rows are parted by ranges of the key and numbered within
    them; only the sizes of the ranges are added up, so no task sorts all rows. Equal keys share a range."""
    from lodestone.runtime import cut

    parted = cut(df.repartitionByRange(slices, F.col(f"`{key}`").asc_nulls_first()).withColumn("__slice", F.spark_partition_id()))
    sizes = parted.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__slice", (F.sum("__n").over(Window.orderBy("__slice")) - F.col("__n")).alias("__before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("__slice").orderBy(F.col(f"`{key}`").asc_nulls_first())) - 1
    return parted.withColumn("__place", place).join(F.broadcast(before), "__slice").withColumn(name, F.col("__before") + F.col("__place")).drop("__slice", "__place", "__before")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of both, one per key: new rows before old ones, then by the order."""
    both = old.withColumn("__age", F.lit(1)).unionByName(new.withColumn("__age", F.lit(0)), allowMissingColumns=True)
    return keep_first(both, keys, [F.col("__age"), *order]).drop("__age")


def manifest_upsert(rows: DataFrame, key: Column, status: str, done: str, order: str) -> DataFrame:
    """One row per key: the first that is done if there is one, else the last."""
    keyed = rows.withColumn("__key", key)
    finished = F.col(status) == done
    rank = F.row_number().over(Window.partitionBy("__key").orderBy(F.when(finished, 0).otherwise(1), F.when(finished, F.col(order)).asc_nulls_last(), F.col(order).desc()))
    return keyed.withColumn("__place", rank).where("__place = 1").drop("__place", "__key")


def overridden(df: DataFrame, labels: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column], reason: str = "manual label") -> DataFrame:
    """Cells of ``labels`` that are not blank win over those of ``df``; such rows are no longer under review.

    Of several labels with one key the first in the order counts.
    """
    best = keep_first(labels.where(~blank(F.col(key))), [key], order).select(key, *[F.when(~blank(F.col(c)), F.col(c)).alias(f"__{c}") for c in columns])
    joined = df.join(best.withColumn("__labelled", F.lit(True)), key, "left")
    values = {c: F.coalesce(f"__{c}", c) for c in columns}
    labelled = F.coalesce("__labelled", F.lit(False))
    if "needs_review" in df.columns:
        values["needs_review"] = F.when(labelled, F.lit(False)).otherwise(F.col("needs_review"))
    if "review_reason" in df.columns:
        values["review_reason"] = F.when(labelled, F.lit(reason)).otherwise(F.col("review_reason"))
    return joined.withColumns(values).select(*df.columns)


def backfilled(df: DataFrame, known: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """``column`` from ``known`` where it has the key, else as it was."""
    return df.join(known.select(key, F.col(value).alias("__known")), key, "left").withColumn(column, F.coalesce("__known", column)).drop("__known").select(*df.columns)


def first_lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], value: str, order: Sequence[Column], otherwise: Column) -> DataFrame:
    """``value`` of the first matching row of a dimension, else ``otherwise``."""
    one = keep_first(dim, on, order).select(*on, F.col(value).alias(f"__{value}"))
    return df.join(one, list(on), "left").withColumn(value, F.coalesce(f"__{value}", otherwise)).drop(f"__{value}")


def labelled_pairs(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Inner join with ``_pred`` and ``_gold`` behind the names both sides have, and only those."""
    both = {c for c in predicted.columns if c in gold.columns and c != key}
    left = predicted.select(key, *[F.col(c).alias(f"{c}_pred" if c in both else c) for c in predicted.columns if c != key])
    right = gold.select(key, *[F.col(c).alias(f"{c}_gold" if c in both else c) for c in gold.columns if c != key])
    return left.join(right, key)


def union_ranked(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of several tables, one per key: those of earlier tables first."""
    whole = parts[0].withColumn("__part", F.lit(0))
    for i, p in enumerate(parts[1:], start=1):
        whole = whole.unionByName(p.withColumn("__part", F.lit(i)), allowMissingColumns=True)
    return keep_first(whole, keys, [F.col("__part"), *order])


def jaccard(a: Column, b: Column) -> Column:
    """Common part of two sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
