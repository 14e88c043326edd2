"""Problem 10: subject area of each document.

Method: documents are unit tf-idf vectors over words and pairs of neighbouring words; bisecting k-means over all of
them splits the corpus into leaves. A leaf's discriminative terms are those that stand in it far oftener than the size
of the leaf lets expect; the labelled examples give these terms, and through them the leaf, a subject. A leaf whose
discriminative terms are mostly not among the examples' (page furniture, chatter, another script) names no subject.
The leaves of a subject together are one component, and a document is a mixture of such components and of a
background: expectation maximisation finds its weights and shares out its sentences by the discriminative terms in
them. A document has every subject that gets enough of its sentences. The examples decide nothing beyond the leaves'
names; with one leaf there are no discriminative terms and no subjects.

A subject that is named in passing has one sentence without support in the rest of the document; its weight in the
mixture falls with every round, until the background has the sentence.

Terms are hashed to ``1 << BITS`` places and none is left out, so what the driver and the workers hold is bounded
whatever the corpus: a count per place, and places x subjects weights (12 MB of floats for twelve subjects). Vectors
are clustered in a signed projection to ``DIMS`` dimensions, which keeps their products to about 1 / sqrt(DIMS); leaves
are chosen by at most log2(leaves) comparisons, and per round of k-means only sums of two children per split leaf
leave the tasks. All sentences of all texts are counted, short ones too; nothing is sampled.

Defined cases: null, empty and blank texts, and texts without subject matter, have no row; repeated texts each have
their rows; texts are taken whole; ties between subjects of a sentence go to the first in string order; null ids are
left out; without examples or subjects the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import cut

BITS, DIMS = 18, 256  # places of hashed terms (2**BITS) and dimensions of the projection
PLACES = 1 << BITS
LEAVES, ROUNDS, SMALLEST = 64, 6, 6  # leaves, rounds of k-means a split, documents of a leaf that is still split
DISTINCT, SIGNIFICANT, SEEN = 3.5, 4.0, 3  # a discriminative term: ratio of odds, standard deviations, times it was seen
NAMED = 0.4  # part of a leaf's discriminative mass that the examples must know
WORD_PART, PAIR_PART = 0.7, 0.3  # weights of words and pairs, whose evidence overlaps
BACKGROUND = 0.8  # evidence a sentence needs for any subject, as a part of what one term of a single subject can give
HELD = 4_000_000  # counts a task holds before it adds them up

ENDED = regex.compile(r"[.!?।॥][\"'”’)\]]*$")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:[-'’]\p{L}[\p{L}\p{M}]*)*")
DOTS = regex.compile(r"\.\.+")
LINE = "\x00"


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _chunk(c: str) -> list[int]:
    """What a chunk between blanks holds: hashes of its words, and 0 where a sentence ends."""
    if c in (LINE, "/"):
        return [0]
    out: list[int] = []
    for i, part in enumerate(DOTS.split(c)):
        out += [0] * (i > 0)
        out += [xxhash.xxh3_64_intdigest(w) or 1 for w in WORD.findall(part)]
    return [*out, 0] if ENDED.search(c) else out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def sentences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of each text, words of each sentence, and all words' hashes. A sentence ends with its mark, a line, a
    slash between blanks or a run of dots; chunks between blanks are taken apart once however often they stand there."""
    chunks: list[str] = []
    ends = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            chunks += t.lower().replace("\n", f" {LINE} ").split()
        chunks.append(LINE)
        ends[i] = len(chunks)
    codes = pa.array(chunks, pa.string()).dictionary_encode()
    apart = [_chunk(c) for c in codes.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in apart], dtype=np.int64)
    held = np.array([x for a in apart for x in a], dtype=np.uint64)
    at = codes.indices.to_numpy().astype(np.int64)
    flat = held[spread((np.cumsum(sizes) - sizes)[at], sizes[at])]
    marks = flat == 0
    sentence = np.cumsum(marks)  # before its own mark a word counts the marks before it
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], np.cumsum(sizes[at])[ends - 1]]))) if len(texts) else np.zeros(0, int)
    words = ~marks
    lens = np.bincount(sentence[words], minlength=int(marks.sum()) + 1)
    owner = np.zeros(len(lens), dtype=np.int64)
    owner[sentence] = text_of
    real = lens > 0
    return np.bincount(owner[real], minlength=len(texts)), lens[real], flat[words]


def places(lens: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and kind (True for a word) of every word and pair: of each sentence first its words, then its pairs."""
    n = len(flat)
    sentence = np.repeat(np.arange(len(lens)), lens)
    inner = sentence[1:] == sentence[:-1]
    with np.errstate(over="ignore"):
        two = mixed(flat[:-1] * np.uint64(31) + mixed(flat[1:]))[inner]
    by = np.argsort(np.concatenate([sentence, sentence[1:][inner]]), kind="stable")
    at = (np.concatenate([mixed(flat), two]) >> np.uint64(64 - BITS)).astype(np.int32)[by]
    return at, np.concatenate([np.ones(n, bool), np.zeros(len(two), bool)])[by]


def taken(texts: DataFrame) -> DataFrame:
    """``id``, ``sizes`` (words of each sentence) and ``terms`` (places of each sentence's words, then of its pairs)."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                per, lens, flat = sentences(batch.column("text").to_pylist())
                got, _ = places(lens, flat)
                first = np.concatenate([[0], np.cumsum(per)])
                terms_to = np.concatenate([[0], np.cumsum(2 * lens - 1)])[first]
                lists = lambda ends, x: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists(first, lens), lists(terms_to, got)], names=["id", "sizes", "terms"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, sizes array<int>, terms array<int>")


class Batch:
    """Documents of one Arrow batch as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        flat = lambda c: (np.diff(np.asarray(c.offsets)), np.asarray(c.values)[c.offsets[0].as_py() : c.offsets[-1].as_py()])
        self.n = batch.num_rows
        self.per, self.sizes = flat(batch.column("sizes"))
        of_doc, self.terms = flat(batch.column("terms"))
        self.doc = np.repeat(np.arange(self.n), of_doc)
        self.doc_of = np.repeat(np.arange(self.n), self.per)
        self.sentence = np.repeat(np.arange(len(self.sizes)), 2 * self.sizes - 1)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, place and count of its distinct terms."""
        key, n = np.unique(self.doc.astype(np.int64) * PLACES + self.terms, return_counts=True)
        return key >> BITS, key & (PLACES - 1), n

    def vectors(self, idf: np.ndarray) -> np.ndarray:
        """Unit tf-idf vectors in their signed projection; zeros for a document without terms."""
        doc, place, n = self.counts()
        w = (1 + np.log(n)) * idf[place]
        h = mixed(place.astype(np.uint64) + np.uint64(77))
        slot = (h >> np.uint64(40)).astype(np.int64) % DIMS
        v = np.bincount(doc * DIMS + slot, w * np.where(h & np.uint64(1), 1.0, -1.0), minlength=self.n * DIMS).reshape(self.n, DIMS)
        return v / np.maximum(np.sqrt(np.square(v).sum(1, keepdims=True)), 1e-12)


def document_counts(docs: DataFrame) -> np.ndarray:
    """In how many documents each place is seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PLACES, dtype=np.int64)
        for b in batches:
            n += np.bincount(Batch(b).counts()[1], minlength=PLACES)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["place", "n"])

    got = docs.select("sizes", "terms").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # bounded by PLACES
    out = np.zeros(PLACES, dtype=np.int64)
    out[got.place.to_numpy()] = got.n.to_numpy()
    return out


class Tree:
    """Nodes with two children each or none; a vector goes to the child whose centre is nearer."""

    def __init__(self) -> None:
        self.left = np.full(1, -1)
        self.cut = np.zeros((1, DIMS), dtype=np.float32)  # what is added up against a vector; above ``at`` it goes left
        self.at = np.zeros(1)

    def set(self, node: int, a: np.ndarray, b: np.ndarray) -> None:
        self.cut[node], self.at[node] = a - b, (a @ a - b @ b) / 2

    def split(self, node: int) -> None:
        n = len(self.left)
        self.left[node] = n
        self.left, self.cut, self.at = np.append(self.left, [-1, -1]), np.pad(self.cut, ((0, 2), (0, 0))), np.append(self.at, [0.0, 0.0])

    def node(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while len(on := np.flatnonzero(self.left[at] >= 0)):
            here = at[on]
            at[on] = self.left[here] + (np.einsum("ij,ij->i", x[on], self.cut[here]) <= self.at[here])
        return at

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.left < 0)


def packed(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``v``: the documents' vectors with a byte a dimension; those without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # PLACES floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = Batch(b).vectors(shared.value)
            v = v[v.any(1)]
            v = np.rint(v * (127 / np.maximum(np.abs(v).max(1, keepdims=True), 1e-12))).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in v], pa.binary())], names=["v"])

    return docs.select("sizes", "terms").mapInArrow(run, "v binary")


def sums_below(vectors: DataFrame, tree: Tree, wanted: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Per wanted node its number of vectors and their sum. Tasks send one sum a node, added up once more by node."""
    shared = vectors.sparkSession.sparkContext.broadcast(cloudpickle.dumps((tree, wanted)))
    kinds = "node int, n long, s binary"

    def rows(n: dict[int, int], s: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([s[k].tobytes() for k in n], pa.binary())], names=["node", "n", "s"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, nodes = cloudpickle.loads(shared.value)
        n, s = dict.fromkeys(nodes.tolist(), 0), {k: np.zeros(DIMS) for k in nodes.tolist()}
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("v").to_pylist()), dtype=np.int8).reshape(-1, DIMS).astype(np.float32)
                x /= np.sqrt(np.square(x).sum(1, keepdims=True))
                at = grown.node(x)
                for k in np.unique(at[np.isin(at, nodes)]).tolist():
                    mine = x[at == k]
                    n[k] += len(mine)
                    s[k] += mine.sum(0, dtype=np.float64)
        yield rows({k: c for k, c in n.items() if c}, s)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = {}, {}
        for b in batches:
            for k, c, v in zip(*[b.column(i).to_pylist() for i in range(3)]):
                n[k], s[k] = n.get(k, 0) + c, s.get(k, 0) + np.frombuffer(v)
        if n:
            yield rows(n, s)

    added = vectors.mapInArrow(part, kinds).repartition(8, "node").mapInArrow(whole, kinds)
    return {r.node: (r.n, np.frombuffer(r.s)) for r in added.collect()}  # one row a node


def clustered(vectors: DataFrame, k: int = LEAVES, rounds: int = ROUNDS, smallest: int = SMALLEST, seed: int = 3) -> Tree:
    """Bisecting k-means: level by level the leaves of greatest scatter are split in two, until there are ``k``."""
    tree, rng = Tree(), np.random.default_rng(seed)
    of = sums_below(vectors, tree, tree.leaves())
    # vectors have length one, so a leaf's scatter is its size less the squared length of its sum over its size
    scatter = lambda x: x[0] - float(x[1] @ x[1]) / x[0]
    while True:
        room = k - len(tree.leaves())
        able = [n for n in tree.leaves().tolist() if n in of and of[n][0] >= smallest and scatter(of[n]) > 1e-6]
        todo = sorted(able, key=lambda n: (-scatter(of[n]), n))[: max(0, min(room, len(tree.leaves())))]
        if not todo:
            return tree
        for n in todo:
            centre, off = of[n][1] / of[n][0], rng.standard_normal(DIMS) * 0.01
            tree.split(n)
            tree.set(n, centre + off, centre - off)
        below = np.concatenate([[tree.left[n], tree.left[n] + 1] for n in todo])
        for r in range(rounds):
            got = sums_below(vectors, tree, below)
            if r < rounds - 1:
                for n in todo:
                    a, b = (got.get(int(tree.left[n]) + i) for i in (0, 1))
                    if a and b:
                        tree.set(n, a[1] / a[0], b[1] / b[0])
        of = {**of, **got}


def leaf_counts(docs: DataFrame, idf: np.ndarray, tree: Tree) -> DataFrame:
    """``place``, ``leaf`` (from 0) and ``n``: how often each place is seen in each leaf's documents."""
    leaves = tree.leaves()
    number = np.full(len(tree.left), -1)
    number[leaves] = np.arange(len(leaves))
    k = len(leaves)
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((idf, tree, number)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, grown, of_node = cloudpickle.loads(shared.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            key, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return key, np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)

        for b in batches:
            batch = Batch(b)
            v = batch.vectors(weights)
            leaf = of_node[grown.node(v.astype(np.float32))]
            doc, place, n = batch.counts()
            held.append((place * k + leaf[doc], n))
            held = [added()] if len(held) > 1 and sum(len(x) for x, _ in held) > HELD else held
        if held:
            key, n = added()
            yield pa.RecordBatch.from_arrays([pa.array(key // k), pa.array(key % k), pa.array(n)], names=["place", "leaf", "n"])

    return docs.select("sizes", "terms").mapInArrow(run, "place long, leaf long, n long").groupBy("place", "leaf").agg(F.sum("n").alias("n"))


def log_odds(n: np.ndarray, totals: np.ndarray, smooth: float = 2.0) -> np.ndarray:
    """Of rows of counts by group, how much oftener a term stands in each group than the group's size lets expect: the
    logarithm where the term is discriminative, else 0. In a single group no term is."""
    part = totals / max(1.0, totals.sum())
    seen = n.sum(1, keepdims=True)
    expected = seen * part
    w = np.log((n + smooth * part) / np.maximum(expected + smooth * part, 1e-12) + 1e-300)
    far = (n - expected) / np.sqrt(expected + 1) >= SIGNIFICANT
    distinct = n * (1 - part) >= DISTINCT * (seen - n) * part
    return np.where(far & distinct & (seen >= SEEN), np.maximum(w, 0.0), 0.0)


def example_profile(examples: list[tuple[str, str]], subjects: list[str]) -> dict[int, np.ndarray]:
    """Per place of the examples' terms the chance of each subject."""
    per, lens, flat = sentences([t for _, t in examples])
    at, _ = places(lens, flat)
    text_of = np.repeat(np.repeat(np.arange(len(examples)), per), 2 * lens - 1)
    of = np.array([subjects.index(s) for s, _ in examples])[text_of]
    n = np.zeros((PLACES, len(subjects)))
    np.add.at(n, (at, of), 1)
    seen = np.flatnonzero(n.any(1))
    p = (n[seen] + 0.05) / (n.sum(0) + 0.05 * PLACES)
    return dict(zip(seen.tolist(), p / p.sum(1, keepdims=True)))


class Subjects:
    def __init__(self, docs: DataFrame, areas: DataFrame, examples: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = LEAVES):
        spark = docs.sparkSession
        self.texts = docs.where(F.col(doc_id).isNotNull() & F.coalesce(F.trim(F.col(text)) != "", F.lit(False))).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        self.id_kind = docs.schema[doc_id].dataType.simpleString()
        self.subjects = sorted({r[0] for r in areas.where("subject is not null").select("subject").collect()})
        given = [(r.subject, r.text) for r in examples.where("subject is not null and text is not null").select("subject", "text").collect() if r.subject in self.subjects]  # bounded: the labelled examples
        self.ready = bool(self.subjects and given)
        if not self.ready:
            return
        self.docs = cut(taken(self.texts))
        total = self.docs.count()
        seen = document_counts(self.docs)
        self.ready = bool(seen.any())
        if not self.ready:
            return
        # a term of one or two documents says nothing of others
        idf = np.where(seen >= SEEN, np.log((1 + total) / (1 + seen)), 0.0).astype(np.float32)
        self.tree = clustered(cut(packed(self.docs, idf)), k)
        self.leaves = len(self.tree.leaves())
        counts = cut(leaf_counts(self.docs, idf, self.tree))
        sizes = np.zeros(self.leaves)
        for r in counts.groupBy("leaf").agg(F.sum("n").alias("n")).collect():
            sizes[r.leaf] = r.n
        by_place = cut(counts.groupBy("place").agg(F.collect_list("leaf").alias("leaf"), F.collect_list("n").alias("n")))  # at most a row's leaves
        self.of_leaf = self._named(by_place, sizes, example_profile(given, self.subjects))
        self.weights = spark.sparkContext.broadcast(self._weights(by_place, sizes))  # PLACES x subjects floats

    def _named(self, by_place: DataFrame, sizes: np.ndarray, profile: dict[int, np.ndarray]) -> np.ndarray:
        """Per leaf the number of its subject by its discriminative terms, -1 where the examples know too few of them."""
        width, k = len(self.subjects), self.leaves
        shared = by_place.sparkSession.sparkContext.broadcast(cloudpickle.dumps(profile))  # bounded: the labelled examples

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, mass = cloudpickle.loads(shared.value), np.zeros((k, width + 1))
            sure = {p: x * float((x * np.log(np.maximum(x * width, 1e-12))).sum()) for p, x in known.items()}  # by how one-sided a term is
            for f in frames:
                n = _dense(f, k)
                w = log_odds(n, sizes) * n
                mass[:, width] += w.sum(0)
                for i in np.flatnonzero(w.any(1) & f.place.isin(sure).to_numpy()):
                    mass[:, :width] += w[i][:, None] * sure[f.place.iat[i]]
                    mass[:, width] -= w[i]
            # the last column is now what the examples do not know, on the same scale
            yield pd.DataFrame({"leaf": np.repeat(np.arange(k), width + 1), "subject": np.tile(np.arange(width + 1), k), "mass": mass.ravel()})

        got = by_place.mapInPandas(run, "leaf long, subject long, mass double").groupBy("leaf", "subject").agg(F.sum("mass").alias("mass")).toPandas()  # leaves x subjects
        mass = np.zeros((k, width + 1))
        mass[got.leaf.to_numpy(), got.subject.to_numpy()] = got.mass.to_numpy()
        best, full = mass[:, :width].argmax(1), np.log(max(2, width))
        known = mass[:, :width].sum(1) / full
        return np.where((known > 0) & (known >= NAMED * (known + mass[:, width])), best, -1)

    def _weights(self, by_place: DataFrame, sizes: np.ndarray) -> np.ndarray:
        """Per place and subject the evidence of the subject's leaves taken together; unnamed leaves are one more group."""
        width, k = len(self.subjects), self.leaves
        group = np.where(self.of_leaf < 0, width, self.of_leaf)
        totals = np.bincount(group, sizes, minlength=width + 1)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            member = np.eye(width + 1)[group]
            for f in frames:
                w = log_odds(_dense(f, k) @ member, totals)[:, :width]
                at, subject = np.nonzero(w)
                yield pd.DataFrame({"place": f.place.to_numpy()[at], "subject": subject, "w": w[at, subject].astype(np.float32)})

        got = by_place.mapInPandas(run, "place long, subject long, w float").toPandas()  # bounded by PLACES x subjects
        out = np.zeros((PLACES, width), dtype=np.float32)
        out[got.place.to_numpy(), got.subject.to_numpy()] = got.w.to_numpy()
        return out

    def shares(self) -> DataFrame:
        """``id``, ``subject``, ``times``, ``sentences`` and ``share`` of every subject of every document."""
        names, shared, width = np.array(self.subjects), self.weights, len(self.subjects)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                batch = Batch(b)
                told = assigned_sentences(batch, shared.value)
                times = np.bincount(batch.doc_of * (width + 1) + told, minlength=batch.n * (width + 1)).reshape(batch.n, width + 1)[:, :width]
                doc, subject = np.nonzero(times)
                n, whole = times[doc, subject], batch.per[doc]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc)), pa.array(names[subject].tolist(), pa.string()), pa.array(n), pa.array(whole.astype(np.int64)), pa.array(n / whole)], names=["id", "subject", "times", "sentences", "share"])

        return self.docs.mapInArrow(run, f"id {self.id_kind}, subject string, times long, sentences long, share double")

    def assigned(self, least_share: float = 0.15) -> DataFrame:
        """``doc_id`` and ``subject``: subjects with about a fifth of the sentences or more."""
        if not self.ready:
            return self.texts.sparkSession.createDataFrame([], f"doc_id {self.id_kind}, subject string")
        return self.shares().where(F.col("share") >= least_share).select(F.col("id").alias("doc_id"), "subject")


def _dense(f: pd.DataFrame, k: int) -> np.ndarray:
    n = np.zeros((len(f), k))
    if len(f):
        row = np.repeat(np.arange(len(f)), [len(x) for x in f.leaf])
        n[row, np.concatenate(f.leaf.to_numpy())] = np.concatenate(f.n.to_numpy())
    return n


def assigned_sentences(batch: Batch, weights: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Per sentence the number of its component, the last of which is the background: each document is a mixture of
    the components, whose weights are found by expectation maximisation over its sentences."""
    width, n = weights.shape[1], len(batch.sizes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    starts = np.cumsum(2 * batch.sizes - 1) - (2 * batch.sizes - 1)
    word = np.arange(len(batch.terms)) - starts[batch.sentence] < batch.sizes[batch.sentence]
    x = np.full((n, width + 1), BACKGROUND * np.log(max(2, width)))
    x[:, :width] = np.add.reduceat(weights[batch.terms] * np.where(word, WORD_PART, PAIR_PART)[:, None].astype(np.float32), starts, axis=0)
    x = np.round(x, 6)
    like = np.exp(x - x.max(1, keepdims=True))
    has = batch.per > 0
    firsts = (np.cumsum(batch.per) - batch.per)[has]
    theta = np.full((batch.n, width + 1), 1 / (width + 1))
    for _ in range(rounds):
        r = like * theta[batch.doc_of]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        theta[has] = np.add.reduceat(r, firsts, axis=0) / batch.per[has][:, None] + 1e-12
    return r.argmax(1)
