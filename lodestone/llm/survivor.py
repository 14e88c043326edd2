"""Problem 5: best representative of each duplicate group.

Method: a latent two-sided quality model. Every (group, field, value) is a fact that is true or not; each source has
a sensitivity (how many of the true values it gives) and a specificity (how seldom it gives a false one). Expectation
maximisation runs over patterns - the vector of who claims and who is silent - because all facts with one pattern
have one posterior; the parameters are a few numbers per source. A multi-valued field keeps every value judged true.

The surviving row of a single-valued field (``p5_found``) is fixed by TESTDATA.md as an order over weight, time and
id, which a probability may not overrule; there the operator supplies the claims (which cells hold a value at all,
which texts are broken off) and the order decides. The model's own choice is given beside it (``p5_truth``).

Defined cases: a null, blank or stand-in cell is no claim; a text broken off before its end is no claim; null weight
is lowest, null time earliest, ties go to the smallest row id; rows with a null group are left out; a group whose
rows hold no value of a field has no row for it; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.keys import squeezed
from lodestone.runtime import cut

PATTERNS = 100_000  # patterns of sources the driver holds

FIELDS = ("question_text", "passage_text", "option_a", "correct_option", "difficulty_estimate")

# Words that only say that there is no value (compared without case and outer punctuation).
STAND_INS = ("na", "n a", "nil", "none", "null", "nan", "nul", "unknown", "not known", "not available", "not applicable", "unavailable", "missing", "blank", "empty", "tbd", "tba", "tbc", "to be decided", "to be done", "to be announced", "no value", "no data", "undefined", "void", "n d", "nd", "not given", "not provided", "not specified", "unspecified", "pending", "todo", "to do", "xxx", "skipped or unavailable", "skipped", "unsure")

# What is written after a text that was cut short.
CUT_MARKS = r"(\.\.|…|\[[^\[\]]{0,3}\]|[(\[](contd|cont|continued|truncated|cut|more|snip|cut off|to be continued)\.?[)\]]|[,;\-–—\u2010\u2011&/+(\[{\u00ac\u00ad]|read more|see more|more)\s*$"


def present(c: Column) -> Column:
    """True where a cell holds a value, and not only blanks, punctuation or a stand-in for a missing value."""
    plain = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return F.coalesce((plain != "") & ~plain.isin(*STAND_INS), F.lit(False))


def broken_off(text: Column, siblings_longest: Column) -> Column:
    """True where a text ends before its end: a cut mark, or no closing mark although the text is punctuated,
    or - in a text without any punctuation - when it only begins the longest text of its group."""
    bare = F.regexp_replace(text, r"[\s\u00a0\u200b-\u200d\u2060\ufeff*_~`\"'”’»]+$", "")
    marked = F.lower(bare).rlike(CUT_MARKS)
    closed = bare.rlike(r"[.?!:।)\]]$")
    dotted = bare.rlike(r"[.?!:;]\s")
    mine, whole = squeezed(text), squeezed(siblings_longest)
    begins = (F.length(mine) < F.length(whole)) & whole.startswith(mine)
    tail = ~closed & (dotted | begins)
    return F.coalesce(marked | tail, F.lit(False))


def claims(df: DataFrame, group: str = "canonical_question_id", row_id: str = "row_id", fields: tuple[str, ...] = FIELDS, text: str = "question_text") -> DataFrame:
    """One row per cell that holds a value: ``group``, ``field_name``, ``row_id``, ``value``, ``source_weight``, ``collected_at``, ``source``.

    Only groups of two or more rows. The longest text of a group comes from an aggregate, so no group is gathered.
    """
    held = F.when(present(F.col(text)), F.col(text))
    size = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.max_by(held, F.length(squeezed(held))).alias("longest")).where("n > 1").select("group", "longest")
    rows = df.where(F.col(group).isNotNull()).join(size, F.col(group) == F.col("group"))
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(present(F.col(f)) & (~broken_off(F.col(f), F.col("longest")) if f == text else F.lit(True)), F.col(f)).alias("value")) for f in fields])
    each = rows.select("group", F.col(row_id).alias("row_id"), F.col("source_weight").cast("double").alias("source_weight"), "collected_at", F.coalesce(F.lower(F.trim("source_tier")), F.lit("unknown")).alias("source"), F.explode(cells).alias("c"))
    return each.where("c.value is not null").select("group", "c.field_name", "row_id", "c.value", "source_weight", "collected_at", "source")


def surviving(claimed: DataFrame) -> DataFrame:
    """The row that gives each group's value of each field: highest weight, then latest, then smallest id."""
    # in a struct's order a null comes before every value: null weight lowest, null time earliest
    best = F.struct(F.col("source_weight").alias("w"), F.col("collected_at").alias("t"), (-F.col("row_id")).alias("r"))
    return claimed.groupBy("group", "field_name").agg(F.max(best).alias("b"), F.max_by("value", best).alias("value")).select(F.col("group").alias("canonical_question_id"), "field_name", (-F.col("b.r")).alias("row_id"), "value")


def records(claimed: DataFrame, true: DataFrame | None = None, fields: tuple[str, ...] = FIELDS, name: str = "micro_concept") -> DataFrame:
    """One surviving record per group, built field by field; with the values of ``truths``, all those that are kept of the
    multi-valued field under ``name``, sorted (an empty array where none is; as many as the sources of a group gave)."""
    single = surviving(claimed).groupBy("canonical_question_id").pivot("field_name", list(fields)).agg(F.first("value"))
    if true is None:
        return single
    several = true.where("kept").groupBy("canonical_question_id").agg(F.array_sort(F.collect_set("value")).alias(name))
    return single.join(several, "canonical_question_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def facts(df: DataFrame, group: str = "canonical_question_id", column: str = "micro_concept", separators: str = ";|", source: str = "source_tier") -> DataFrame:
    """``group``, ``value``, ``yes`` and ``no``: the sorted sources that claim a value, and those that only claim others."""
    value = F.trim(F.regexp_replace(F.lower("v"), r"[\s\u00a0_-]+", " "))
    given = df.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.coalesce(F.lower(F.trim(source)), F.lit("unknown")).alias("source"), F.explode(F.split(column, f"[{separators}]")).alias("v"))
    given = given.where(present(F.col("v"))).select("group", "source", value.alias("value")).distinct()
    speakers = given.groupBy("group").agg(F.collect_set("source").alias("all"))  # bounded by the number of sources
    said = given.groupBy("group", "value").agg(F.collect_set("source").alias("yes"))
    return said.join(speakers, "group").select("group", "value", F.array_sort("yes").alias("yes"), F.array_sort(F.array_except("all", "yes")).alias("no"))


def two_sided(given: DataFrame, rounds: int = 40, tol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Expectation maximisation over the claim patterns; (pattern posteriors, quality per source).

    The driver holds patterns of sources (at most 3 to the number of source tiers; more than ``PATTERNS`` are an error),
    never facts.
    """
    spark = given.sparkSession
    patterns = given.groupBy("yes", "no").agg(F.count(F.lit(1)).alias("n")).limit(PATTERNS + 1).collect()
    if len(patterns) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns of sources: name sources by something coarser, such as their tier")
    names = sorted({s for p in patterns for s in [*p.yes, *p.no]})
    at = {s: i for i, s in enumerate(names)}
    yes, no = np.zeros((2, len(patterns), len(names)))
    n = np.array([p.n for p in patterns], dtype=float)
    for i, p in enumerate(patterns):
        yes[i, [at[s] for s in p.yes]] = 1
        no[i, [at[s] for s in p.no]] = 1
    sens, spec, prior = np.full(len(names), 0.7), np.full(len(names), 0.8), 0.5
    post = np.zeros(len(patterns))
    for _ in range(rounds if len(patterns) else 0):
        old = post
        true = np.log(prior) + yes @ np.log(sens) + no @ np.log(1 - sens)
        false = np.log(1 - prior) + yes @ np.log(1 - spec) + no @ np.log(spec)
        post = 1 / (1 + np.exp(np.clip(false - true, -700, 700)))
        t, f = n * post, n * (1 - post)
        # smoothing: as if each source had been seen on ten true and ten false values
        sens = (t @ yes + 7) / (t @ (yes + no) + 10)
        # a source is taken to be no worse than chance, or the two sides could change places
        spec = np.maximum((f @ no + 8) / (f @ (yes + no) + 10), 1 - sens)
        prior = (t.sum() + 5) / (n.sum() + 10)
        if np.abs(post - old).max() < tol:
            break
    posts = spark.createDataFrame([(p.yes, p.no, float(q)) for p, q in zip(patterns, post)], "yes array<string>, no array<string>, posterior double")
    quality = spark.createDataFrame([(s, float(sens[i]), float(spec[i]), float(n @ yes[:, i])) for s, i in at.items()], "source string, sensitivity double, specificity double, claims double")
    return posts, quality


def truths(df: DataFrame, least: float = 0.5, **options: str) -> DataFrame:
    """Every value of a multi-valued field with its posterior; ``kept`` where it is judged true."""
    given = cut(facts(df, **options))
    posts, _ = two_sided(given)
    return given.join(F.broadcast(posts), ["yes", "no"]).select(F.col("group").alias("canonical_question_id"), "value", F.size("yes").alias("sources_for"), F.size("no").alias("sources_silent"), F.round("posterior", 6).alias("posterior"), (F.col("posterior") >= least).alias("kept"))


def source_quality(df: DataFrame, **options: str) -> DataFrame:
    return two_sided(cut(facts(df, **options)))[1]
