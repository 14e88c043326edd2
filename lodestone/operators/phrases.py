"""Phrases of a small table found in many texts: one automaton over all phrases per task, one pass over each text.

The phrases are broadcast only up to ``MOST`` of them; a longer list is refused, not cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MOST = 1_000_000

try:
    import ahocorasick
except ImportError:  # a plain search of each phrase then
    ahocorasick = None


def bounded(phrases: DataFrame, most: int = MOST) -> list:
    """The rows of a table that has at most ``most``; else an error."""
    rows = phrases.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} phrases")
    return rows


def finder(phrases: list[str]) -> Callable[[str], dict[int, int]]:
    """A function that counts, without overlaps of a phrase with itself, the phrases (by number) in a text."""
    if ahocorasick is None:
        return lambda text: {i: n for i, p in enumerate(phrases) if p and (n := text.count(p))}
    automaton = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        if p:
            automaton.add_word(p, (i, len(p)))
    if not len(automaton):
        return lambda text: {}
    automaton.make_automaton()

    def count(text: str) -> dict[int, int]:
        counts: dict[int, int] = {}
        upto: dict[int, int] = {}
        for end, (i, size) in automaton.iter(text):
            if end - size >= upto.get(i, -1):
                counts[i] = counts.get(i, 0) + 1
                upto[i] = end
        return counts

    return count


def totals(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """``term`` and ``n``: occurrences of every phrase over all texts, without regard to case; summed per task first."""
    wanted = sorted({r[0].lower() for r in bounded(phrases.select(phrase).distinct()) if r[0]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = finder(wanted)
        sums: dict[int, int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    for i, n in count(t.lower()).items():
                        sums[i] = sums.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([wanted[i] for i in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["term", "n"])

    return texts.select(text).mapInArrow(run, "term string, n long").groupBy("term").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
