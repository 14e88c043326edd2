"""Problem 2: duplicates hidden by formatting differences.

Method: collapse byte-identical raw rows first, with counts; canonicalise only the distinct survivors; group them
again on the full canonical text, summing the counts. Rows find their group through a 128-bit digest of their raw
fields, and only where a raw form has more than one row: a single row is its form's ``first_id`` already.

Defined cases: null and empty fields count as empty; records without a letter or digit in all fields belong to no
group; ties need no rule, as a group is named by its smallest id; extra columns are ignored; an empty table gives
an empty result; an id that is null is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.keys import digest, question_key
from lodestone.runtime import cut

OPTIONS = ("option_a", "option_b", "option_c", "option_d")


def survivors(df: DataFrame, row_id: str = "row_id", text: str = "question_text", options: tuple[str, ...] = OPTIONS) -> DataFrame:
    """One row per distinct raw form: ``raw`` digest, ``first_id``, ``copies`` and its canonical ``key``."""
    fields = [text, *options]
    forms = df.where(F.col(row_id).isNotNull()).groupBy(*fields).agg(F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return forms.select(digest(*[F.col(f) for f in fields]).alias("raw"), "first_id", "copies", question_key(F.col(text), [F.col(o) for o in options]).alias("key")).where("key <> ''")


def groups(forms: DataFrame) -> DataFrame:
    """One row per canonical text: ``group_id`` (its smallest row id), ``copies``, ``forms`` and the ``key``."""
    return forms.groupBy("key").agg(F.min("first_id").alias("group_id"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("forms"))


def collapsed(df: DataFrame, row_id: str = "row_id", text: str = "question_text", options: tuple[str, ...] = OPTIONS) -> DataFrame:
    """One record per group of copies: the fields of its smallest id, how many copies and how many raw forms it had."""
    fields = [text, *options]
    forms = df.where(F.col(row_id).isNotNull()).groupBy(*fields).agg(F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("n"))
    keyed = forms.withColumn("key", question_key(F.col(text), [F.col(o) for o in options])).where("key <> ''")
    best = keyed.groupBy("key").agg(F.min_by(F.struct(*fields), "first_id").alias("best"), F.min("first_id").alias(row_id), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("raw_forms"))
    return best.select(row_id, *[F.col(f"best.{f}").alias(f) for f in fields], "copies", "raw_forms")


def copy_pairs(df: DataFrame, row_id: str = "row_id", text: str = "question_text", options: tuple[str, ...] = OPTIONS) -> DataFrame:
    """For each group of copies its smallest id with each of its other ids (``row_id_1``, ``row_id_2``)."""
    fields = [text, *options]
    forms = survivors(df, row_id, text, options).withColumn("canon", digest(F.col("key")))
    forms = cut(forms)
    several = forms.groupBy("key").agg(F.min("first_id").alias("group_id"), F.sum("copies").alias("n"), F.first("canon").alias("canon")).where("n > 1").select("canon", "group_id")
    members = forms.select("raw", "canon", "first_id", "copies").join(several, "canon")
    single = members.where("copies = 1").select("group_id", F.col("first_id").alias("id"))
    rows = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), digest(*[F.col(f) for f in fields]).alias("raw"))
    repeated = rows.join(members.where("copies > 1").select("raw", "group_id"), "raw").select("group_id", "id")
    return single.union(repeated).where("id <> group_id").select(F.col("group_id").alias("row_id_1"), F.col("id").alias("row_id_2"))
