"""Column expressions for keys: canonical text, word sets, digests and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A letter or a digit of any script.
ALNUM = r"[\p{L}\p{N}]"


def folded(c: Column) -> Column:
    """Lower case without the context rule of the final sigma, so that case never depends on neighbours."""
    return F.translate(F.lower(c), "ς", "σ")


def squeezed(c: Column) -> Column:
    """Only the letters and digits of ``c``, without regard to case; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def question_key(text: Column, options: list[Column]) -> Column:
    """Canonical text of a question: squeezed text, then squeezed options in sorted order, blanks left out.

    The unit separator can occur in no squeezed part, so different part lists never give one key.
    """
    parts = F.array_sort(F.filter(F.array(*[squeezed(o) for o in options]), lambda x: x != ""))
    return F.concat_ws("\x1f", F.concat(squeezed(text)), parts)


def digest(*cols: Column) -> Column:
    """128 bits of the columns' text as two longs (struct hi, lo); nulls and field borders count."""
    joined = F.concat_ws("\x1e", *[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols])
    return F.struct(F.xxhash64(joined).alias("hi"), F.xxhash64(F.lit(7), joined, F.length(joined)).alias("lo"))


def words(c: Column) -> Column:
    """The longest runs of letters or digits after lower-casing, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def year_number(c: Column) -> Column:
    """A year written in any way (``2023``, ``2023.0``, padded) as a double; null for blanks and other text."""
    return F.regexp_replace(c, r"[\s\u00a0]+", "").try_cast("double")
