"""Problem 6: frequency of every distinct value or term.

Method: a global dictionary numbers the distinct terms without gaps. Each block of records (a task's share) numbers its
own terms and counts them in two arrays, occurrences and records; the block's terms are then encoded by the dictionary
and its counts laid out in arrays by range of identifiers, a pair of arrays per block and range, and the arrays of a
range are added up. A term with a third of all occurrences is one place in a block's array, and only counts - a row a
block and term - meet the dictionary.

Defined cases: a null, blank or separator-only cell holds no term; a term that stands twice in one record is two
occurrences and one record; null counts count as 0 occurrences but as a record; an empty table gives no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.runtime import cut

RANGE = 4096  # identifiers of one array
HELD = 500_000  # terms a block numbers before the next begins


def tidy(c: Column) -> Column:
    """Lower case, trimmed, every run of white space, hyphens and underscores as one space."""
    one = F.regexp_replace(F.lower(c), r"[\s\u00a0\u2000-\u200a\u202f\u3000\u2010\u2011_-]+", " ")
    return F.trim(one)


def block_counts(df: DataFrame, column: str, weight: str | None = None, separators: str = "") -> DataFrame:
    """``block``, ``term``, ``occurrences`` and ``records`` of every block of records; no row of the input is shuffled."""
    cells = F.split(F.col(column), f"[{separators}]") if separators else F.array(F.col(column))
    kept = F.filter(F.transform(cells, tidy), lambda t: t != "")
    each = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1).cast("long")
    base = df.select(each.alias("each"), kept.alias("terms")).where(F.size("terms") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        counts = np.zeros((2, 0), dtype=np.int64)
        block, sent = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{block}.{sent}"] * len(number), pa.string()), pa.array(list(number), pa.string()), pa.array(counts[0]), pa.array(counts[1])], names=["block", "term", "occurrences", "records"])

        for b in batches:
            lists, times = b.column("terms"), np.asarray(b.column("each"))
            ends = np.asarray(lists.offsets)
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            mine = np.array([number.setdefault(t, len(number)) for t in coded.dictionary.to_pylist()], dtype=np.int64)
            at = mine[coded.indices.to_numpy()]
            counts = np.pad(counts, ((0, 0), (0, len(number) - counts.shape[1])))
            np.add.at(counts[0], at, times[row])
            once = np.unique(row * len(number) + at) % len(number)
            counts[1] += np.bincount(once, minlength=len(number))
            if len(number) > HELD:
                yield flush()
                sent += 1
                number.clear()
                counts = np.zeros((2, 0), dtype=np.int64)
        yield flush()

    return base.mapInArrow(run, "block string, term string, occurrences long, records long")


def dictionary(terms: DataFrame, slices: int = 1024) -> DataFrame:
    """Distinct ``term`` with gapless ``term_id``; numbers run on over hash slices, so no task sorts all terms."""
    distinct = terms.select("term").distinct().withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)))
    distinct = cut(distinct)
    sizes = distinct.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("slice", (F.coalesce(F.sum("n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    place = F.row_number().over(W.partitionBy("slice").orderBy("term"))
    return distinct.withColumn("place", place).join(F.broadcast(before), "slice").select("term", (F.col("before") + F.col("place") - 1).alias("term_id"))


def block_arrays(coded: DataFrame) -> DataFrame:
    """``range``, ``block`` and its ``occurrences`` and ``records``, arrays of ``RANGE`` places for the identifiers of the range."""

    def laid(key, f: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((2, RANGE), dtype=np.int64)
        at = f.term_id.to_numpy() % RANGE
        held[0][at], held[1][at] = f.occurrences.to_numpy(), f.records.to_numpy()
        return pd.DataFrame({"range": [key[0]], "block": [key[1]], "occurrences": [held[0]], "records": [held[1]]})

    return coded.withColumn("range", F.floor(F.col("term_id") / RANGE)).groupBy("range", "block").applyInPandas(laid, "range long, block string, occurrences array<long>, records array<long>")


def _add_arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for f in frames:
        for r, o, n in zip(f["range"], f.occurrences, f.records):
            sums[r] = sums.get(r, 0) + np.stack([o, n])
    for r, held in sums.items():
        used = np.nonzero(held[1])[0]
        yield pd.DataFrame({"term_id": r * RANGE + used, "occurrences": held[0][used], "records": held[1][used]})


def frequencies(df: DataFrame, column: str, weight: str | None = None, separators: str = "") -> DataFrame:
    """``term_id``, ``term``, ``occurrences`` and ``records`` of every distinct term of a column."""
    blocks = cut(block_counts(df, column, weight, separators))
    ids = cut(dictionary(blocks))
    arrays = block_arrays(blocks.join(ids, "term").select("block", "term_id", "occurrences", "records"))
    counted = arrays.repartition("range").mapInPandas(_add_arrays, "term_id long, occurrences long, records long")
    return ids.join(counted, "term_id").select("term_id", "term", "occurrences", "records")


def marked(df: DataFrame, column: str, weight: str | None = None, separators: str = "", rare: int = 2, common: float = 0.05) -> DataFrame:
    """The frequencies with ``mark``: rare in at most ``rare`` records, common in more than ``common`` of all rows, else null."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    counts = frequencies(df, column, weight, separators).crossJoin(F.broadcast(total))  # one row
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.col("total") * common, "common")
    return counts.select(F.lit(column).alias("field_name"), "term", "occurrences", "records", mark.alias("mark"))
