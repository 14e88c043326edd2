"""Problem 8: encoding of the whole corpus with a public tokenizer.

Method: two-tier lookup. A minimal perfect hash (hash and displace) over the vocabulary's byte strings resolves a
pre-token that is itself in the vocabulary with one hash and one comparison; only misses are merged, by a heap of
candidate merges over a doubly linked list of byte runs, so a pre-token of n bytes costs n log n whatever its length.
The vocabulary is read once from the file on the driver and broadcast: its size is the tokenizer's, not the corpus'.

Defined cases: null and empty texts get an empty list; white space is kept and encoded; text that looks like a
special token is ordinary text; texts of any length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pattern that splits text before the merges of the vocabulary; white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Places n keys in n slots without a collision: a first hash names a bucket, the bucket's displacement the slots."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        hashed = [(xxhash.xxh3_64_intdigest(k), xxhash.xxh3_64_intdigest(k, 1)) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, (g, _) in enumerate(hashed):
            members[g % self.buckets].append(i)
        self.shift = [0] * self.buckets
        slots: list[int] = [-1] * n
        for b in sorted(range(self.buckets), key=lambda x: -len(members[x])):
            if not members[b]:
                break
            for d in range(1 << 22):
                places = [self._slot(*hashed[i], d) for i in members[b]]
                if len(set(places)) == len(places) and all(slots[p] < 0 for p in places):
                    break
            else:
                raise ValueError("the keys can't be placed; are there equal ones?")
            self.shift[b] = d
            for i, p in zip(members[b], places):
                slots[p] = i
        self.keys = [keys[i] for i in slots]
        self.values = slots

    def _slot(self, g: int, h: int, d: int) -> int:
        return ((g >> 20) + d * (h | 1)) % 0xFFFFFFFFFFFFFFC5 % self.n

    def get(self, key: bytes) -> int:
        """The key's place in the list the hash was built from, or -1."""
        if not self.n:
            return -1
        g = xxhash.xxh3_64_intdigest(key)
        slot = self._slot(g, xxhash.xxh3_64_intdigest(key, 1), self.shift[g % self.buckets])
        return self.values[slot] if self.keys[slot] == key else -1


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        tokens = list(ranks)
        self.table = PerfectHash(tokens)
        self.ids = [ranks[t] for t in tokens]
        self.longest = max(map(len, tokens), default=0)

    def rank(self, piece: bytes) -> int:
        at = self.table.get(piece) if len(piece) <= self.longest else -1
        return self.ids[at] if at >= 0 else -1

    def merge(self, piece: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost first among equals, until none is left."""
        n = len(piece)
        runs: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[bytes, int] = {}

        def look(i: int) -> None:
            j = after[i]
            if j < n:
                both = runs[i] + runs[j]
                if (r := known.get(both)) is None:
                    r = known[both] = self.rank(both)
                if r >= 0:
                    heapq.heappush(heap, (r, i, both))

        heap: list[tuple[int, int, bytes]] = []
        for i in range(n - 1):
            look(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if runs[i] is None or (j := after[i]) >= n or len(runs[i]) + len(runs[j]) != len(both) or runs[i] + runs[j] != both:
                continue  # one side has been merged since
            runs[i], runs[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [self.rank(r) for r in runs if r is not None]

    def encode(self, piece: str) -> list[int]:
        raw = piece.encode()
        return [at] if (at := self.rank(raw)) >= 0 else self.merge(raw)


def encoder(vocabulary: Vocabulary, held: int = 1 << 18) -> Callable[[str], list[list[int]]]:
    """A function from a text to the ids of its pre-tokens; it remembers up to ``held`` of them and then starts afresh."""
    find = regex.compile(PATTERN).findall
    memo: dict[str, list[int]] = {}

    def pieces(text: str) -> list[list[int]]:
        out = []
        for p in find(text):
            ids = memo.get(p)
            if ids is None:
                if len(memo) >= held:
                    memo.clear()
                ids = vocabulary.encode(p)
                if len(p) < 256:
                    memo[p] = ids
            out.append(ids)
        return out

    return pieces


def _broadcast(spark: SparkSession, path: str):
    """The vocabulary as bytes that carry their classes with them, so that executors need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(Vocabulary(read_ranks(path))))


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids`` of every row."""
    shared = _broadcast(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(pickle.loads(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = [list(chain.from_iterable(pieces(t))) if t else [] for t in part.column("t").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[doc_id, "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: tuple[str, ...], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and the number of ``tokens`` of the text."""
    shared = _broadcast(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(pickle.loads(shared.value))
        for batch in batches:
            counts = [sum(map(len, pieces(t))) if t else 0 for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(counts, pa.int64())], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, tokens long")
