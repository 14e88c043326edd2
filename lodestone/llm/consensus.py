"""Problem 1: consensus from several annotators' labels.

Method: each annotator has a confusion matrix and each item a posterior over the labels; expectation maximisation
estimates both, with smoothing. All items with the same four labels have the same posterior, so the algorithm runs
over label patterns with counts; patterns stay distributed, and only the sums behind the matrices - annotators x
labels x labels, a size set by the taxonomy, not by the items - come to the driver. Smoothing is towards a small
model of its own that is re-estimated each round: an annotator's accuracy within the true label's chapter, with the
errors spread over labels by how often the annotator gives them. Chance-corrected agreement is reported separately.

Defined cases: a label counts if it names one leaf of the taxonomy (chapter and subtopic, or a subtopic alone) in
any notation; others, nulls and blanks are abstentions; identical rows count once; rows of one item that differ all
count; an item without a usable label, or with a null id, has no consensus; ties go to the label that is first in
string order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import cut

ANNOTATORS = ("rule_label", "bm25_label", "embedding_label", "llm_label")


def _plain(c):
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))


def taxonomy_forms(leaves: DataFrame) -> DataFrame:
    """Every notation key of a leaf: its chapter and subtopic, or the subtopic alone where only one leaf has it."""
    named = leaves.where("chapter is not null and subtopic is not null").select(F.concat_ws(" :: ", "chapter", "subtopic").alias("label"), "chapter", _plain(F.concat_ws(" ", "chapter", "subtopic")).alias("full"), _plain(F.col("subtopic")).alias("part")).distinct()
    forms = named.select("label", F.explode(F.array("full", "part")).alias("form")).distinct()
    only = forms.groupBy("form").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return only.select("form", "label")


def votes(df: DataFrame, leaves: DataFrame, item: str = "canonical_question_id", annotators: tuple[str, ...] = ANNOTATORS) -> DataFrame:
    """Distinct rows with usable labels: ``item`` and per annotator a label or null. The taxonomy is small and mapped, not joined."""
    forms = {r.form: r.label for r in taxonomy_forms(leaves).collect()}  # bounded by the taxonomy
    if not forms:
        return df.select(F.col(item).alias("item"), *[F.lit(None).cast("string").alias(a) for a in annotators]).limit(0)
    lookup = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    rows = df.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), *[F.try_element_at(lookup, F.coalesce(_plain(F.col(a)), F.lit(""))).alias(a) for a in annotators], F.xxhash64(*[F.col(c) for c in df.columns]).alias("whole"))
    once = rows.distinct().drop("whole")
    return once.where(F.coalesce(*annotators).isNotNull())


class Model:
    """Log priors and confusion matrices as plain arrays: [annotator, true, given]."""

    def __init__(self, labels: list[str], annotators: int):
        self.labels, k = labels, len(labels)
        self.chapter = np.unique([x.split(" :: ")[0] for x in labels], return_inverse=True)[1]
        self.prior = np.full(k, 1 / k)
        self.confusion = np.full((annotators, k, k), 0.3 / max(1, k - 1))
        self.confusion[:, np.arange(k), np.arange(k)] = 0.7 if k > 1 else 1.0

    def posterior(self, given: np.ndarray) -> np.ndarray:
        """Rows of label numbers per annotator, -1 where silent."""
        log = np.log(self.prior)[None, :].repeat(len(given), 0)
        logs = np.log(self.confusion)
        for a in range(given.shape[1]):
            spoke = given[:, a] >= 0
            log[spoke] += logs[a][:, given[spoke, a]].T
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(1, keepdims=True)

    def update(self, counts: np.ndarray, prior: np.ndarray, strength: float) -> float:
        """New parameters from expected counts; ``strength`` pseudo-observations per true label. Returns the change."""
        k = len(self.labels)
        old = self.confusion
        hit = counts[:, np.arange(k), np.arange(k)]
        n = counts.sum(2)
        chapters = self.chapter.max() + 1
        new = np.empty_like(old)
        for a in range(len(counts)):
            overall = (hit[a].sum() + 3) / (n[a].sum() + 4)
            in_chapter = lambda x: np.bincount(self.chapter, x, chapters)
            acc = ((in_chapter(hit[a]) + 10 * overall) / (in_chapter(n[a]) + 10))[self.chapter]
            wrong = counts[a].sum(0) - hit[a] + 1.0
            spread = np.tile(wrong, (k, 1))
            spread[np.arange(k), np.arange(k)] = 0
            base = spread / np.maximum(spread.sum(1, keepdims=True), 1e-12) * (1 - acc)[:, None]
            base[np.arange(k), np.arange(k)] = acc
            new[a] = (counts[a] + strength * base) / (n[a] + strength)[:, None]
        self.confusion = np.clip(new, 1e-9, 1)
        self.prior = (prior + 1) / (prior.sum() + k)
        return float(np.abs(new - old).max())


def _codes(frame: pd.DataFrame, annotators: int) -> np.ndarray:
    return frame[[f"a{i}" for i in range(annotators)]].fillna(-1).to_numpy().astype(np.int64)


def fit(voted: DataFrame, labels: list[str], annotators: tuple[str, ...] = ANNOTATORS, rounds: int = 30, strength: float = 8.0, tol: float = 1e-4) -> tuple[Model, DataFrame]:
    """The model, and the distinct patterns with their numbers of rows (``a0..``, ``n``)."""
    number = F.create_map(*[F.lit(x) for i, label in enumerate(labels) for x in (label, i)])
    coded = voted.select(*[F.try_element_at(number, F.col(a)).alias(f"a{i}") for i, a in enumerate(annotators)])
    patterns = cut(coded.groupBy(*coded.columns).agg(F.count(F.lit(1)).alias("n")))
    k, m = len(labels), len(annotators)
    model = Model(labels, m)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, prior = np.zeros((m, k, k)), np.zeros(k)
        for f in frames:
            given, n = _codes(f, m), f.n.to_numpy().astype(float)
            p = model.posterior(given) * n[:, None]
            prior += p.sum(0)
            for a in range(m):
                spoke = given[:, a] >= 0
                np.add.at(counts[a].T, given[spoke, a], p[spoke])
        yield pd.DataFrame({"at": np.arange(m * k * k + k), "x": np.concatenate([counts.ravel(), prior])})

    for _ in range(rounds):
        total = np.zeros(m * k * k + k)
        got = patterns.mapInPandas(sums, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).where("x > 0").toPandas()  # bounded by the taxonomy
        total[got["at"].to_numpy()] = got.x.to_numpy()
        if model.update(total[: m * k * k].reshape(m, k, k), total[m * k * k :], strength) < tol:
            break
    return model, patterns


def taxonomy_labels(leaves: DataFrame) -> list[str]:
    return sorted({f"{r.chapter} :: {r.subtopic}" for r in leaves.where("chapter is not null and subtopic is not null").select("chapter", "subtopic").collect()})


def consensus(df: DataFrame, leaves: DataFrame, annotators: tuple[str, ...] = ANNOTATORS) -> DataFrame:
    """``canonical_question_id``, ``consensus_label``, ``posterior``, ``labels_given``, ``agreement``.

    Rows of one item that differ are combined: their log posteriors, less the prior, add up.
    """
    labels = taxonomy_labels(leaves)
    voted = votes(df, leaves, annotators=annotators)
    if not labels:
        return voted.select(F.col("item").alias("canonical_question_id"), F.lit("").alias("consensus_label"), F.lit(0.0).alias("posterior"), F.lit(0).alias("labels_given"), F.lit(0.0).alias("agreement"))
    voted = cut(voted)
    model, _ = fit(voted, labels, annotators)
    number = F.create_map(*[F.lit(x) for i, label in enumerate(labels) for x in (label, i)])
    coded = voted.select("item", *[F.try_element_at(number, F.col(a)).alias(f"a{i}") for i, a in enumerate(annotators)])
    m = len(annotators)
    names = [f"a{i}" for i in range(m)]
    # An item's votes as counts of (annotator, label): one row nearly always, and at most annotators x labels entries.
    long = coded.select("item", F.posexplode(F.array(*names)).alias("a", "label")).where("label is not null").groupBy("item", "a", "label").agg(F.count(F.lit(1)).alias("n"))
    items = long.groupBy("item").agg(F.collect_list(F.struct("a", "label", "n")).alias("v"))
    logs, prior = np.log(model.confusion), np.log(model.prior)

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for v in f.v:
                score, per = prior.copy(), np.zeros(len(labels))
                for x in v:
                    score += logs[x["a"]][:, x["label"]] * x["n"]
                    per[x["label"]] += x["n"]
                p = np.exp(score - score.max())
                p /= p.sum()
                total = per.sum()
                same = (per * (per - 1)).sum() / (total * (total - 1)) if total > 1 else None
                best = int(p.argmax())
                out.append((labels[best], float(p[best]), int(total), same))
            yield pd.DataFrame(out, columns=["consensus_label", "posterior", "labels_given", "agreement"]).assign(canonical_question_id=f["item"].to_numpy())[["canonical_question_id", "consensus_label", "posterior", "labels_given", "agreement"]]

    kind = voted.schema["item"].dataType.simpleString()
    return items.mapInPandas(decide, f"canonical_question_id {kind}, consensus_label string, posterior double, labels_given int, agreement double")


def reliability(df: DataFrame, leaves: DataFrame, annotators: tuple[str, ...] = ANNOTATORS) -> DataFrame:
    """Per annotator: labels given, ``accuracy`` (prior-weighted diagonal of the confusion matrix) and chance-corrected
    agreement with the others: Krippendorff's alpha over all, and Cohen's kappa against every other annotator, averaged."""
    labels = taxonomy_labels(leaves)
    voted = cut(votes(df, leaves, annotators=annotators))
    spark = df.sparkSession
    schema = "annotator string, labels_given long, accuracy double, mean_kappa double, alpha double"
    if not labels:
        return spark.createDataFrame([], schema)
    model, patterns = fit(voted, labels, annotators)
    m, k = len(annotators), len(labels)
    counts, together = np.zeros((m, k)), np.zeros((m, m, 3))
    marg = np.zeros((m, m, k))
    # sums over patterns, by pairs of annotators: a size set by the taxonomy
    for i in range(m):
        for r in patterns.where(f"a{i} is not null").groupBy(f"a{i}").agg(F.sum("n").alias("n")).collect():
            counts[i, r[0]] = r.n
        for j in range(m):
            if i != j:
                for r in patterns.where(f"a{i} is not null and a{j} is not null").groupBy(f"a{i}").agg(F.sum("n").alias("n"), F.sum(F.when(F.col(f"a{i}") == F.col(f"a{j}"), F.col("n")).otherwise(0)).alias("same")).collect():
                    marg[i, j, r[0]] = r.n
                    together[i, j] += (r.n, r.same, 0)
    given = F.filter(F.array(*[f"a{i}" for i in range(m)]), lambda x: x.isNotNull())
    spread = patterns.select("n", given.alias("g")).where(F.size("g") > 1)
    same_share = F.aggregate("g", F.lit(0.0), lambda acc, x: acc + F.size(F.filter(F.col("g"), lambda y: y == x)) - 1) / (F.size("g") - 1)
    row = spread.agg(F.sum(same_share * F.col("n")).alias("same"), F.sum(F.size("g") * F.col("n")).alias("all")).first()
    per_label = spread.select("n", F.explode("g").alias("l")).groupBy("l").agg(F.sum("n").alias("n")).collect()
    total = float(row["all"] or 0)
    by_chance = sum(x.n * (x.n - 1) for x in per_label) / (total * (total - 1)) if total > 1 else 0.0
    observed = float(row["same"] or 0) / total if total else 0.0
    alpha = 1 - (1 - observed) / (1 - by_chance) if by_chance < 1 else None
    out = []
    for i, name in enumerate(annotators):
        kappas = []
        for j in range(m):
            n, same, _ = together[i, j]
            if i != j and n:
                chance = float((marg[i, j] / n) @ (marg[j, i] / n))
                kappas.append((same / n - chance) / (1 - chance) if chance < 1 else 0.0)
        acc = float(model.prior @ model.confusion[i].diagonal())
        out.append((name, int(counts[i].sum()), acc, float(np.mean(kappas)) if kappas else None, alpha))
    return spark.createDataFrame(out, schema)
