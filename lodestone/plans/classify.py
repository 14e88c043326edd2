"""Labelling of texts: keyword rules, TF-IDF retrieval, vector retrieval, weighted vote, and the whole ensemble.

A taxonomy is small and joins by broadcast once its size is known to be; texts are never paired with all its leaves:
they meet a leaf only through a term both have.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import normalize_for_match
from lodestone.operators.phrases import bounded, finder
from lodestone.operators.relational import blank

# English words that carry no subject, and the votes' weights.
STOP = tuple("a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split())
VOTES = {"rule": 0.25, "embedding": 0.25, "bm25": 0.20, "llm": 0.30}
DIM_LIMIT = 100_000  # rows of a dimension up to which it is broadcast
LABELS_LIMIT = 10_000  # label vectors that travel to the tasks in one row
LONG_WORD = 4  # words of a chapter longer than this count


def small(dim: DataFrame, limit: int = DIM_LIMIT) -> DataFrame:
    """The dimension with a broadcast hint if it has few enough rows, else as it is (and joins then shuffle)."""
    return F.broadcast(dim) if dim.limit(limit + 1).count() <= limit else dim


def leaf_keywords(leaves: DataFrame, separators: str = ";") -> DataFrame:
    """One row per leaf and keyword of a taxonomy index: ``leaf``, ``chapter``, ``subtopic``, ``kw``, ``phrase``, ``tokens``."""
    numbered = leaves.withColumn("leaf", F.row_number().over(Window.orderBy("chapter", "subtopic")))
    each = numbered.select("leaf", "chapter", "subtopic", F.posexplode_outer(F.split("ncert_concept", f"[{separators}]")).alias("kw", "phrase"))
    tidy = each.withColumn("phrase", normalize_for_match(F.coalesce("phrase", F.lit(""))))
    return tidy.withColumn("tokens", F.split("phrase", " "))


def rule_labels(texts: DataFrame, keywords: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Best leaf of each text by keywords: a phrase found, within words too, scores 2.5 and 0.4 a word (2 at most); a phrase
    of several words that is not found, the share of its words that are; each longer word of the chapter that is found,
    0.5. Ties go to the first leaf; a text without any hit has no label, score 0.

    The taxonomy (at most ``phrases.MOST`` keywords, else an error) travels to the tasks, which look for all its phrases
    at once; texts are read once and nothing of them is shuffled.
    """
    rows = bounded(keywords.select("leaf", "chapter", "subtopic", "phrase"))
    phrases = sorted({r.phrase for r in rows if r.phrase})
    number = {p: i for i, p in enumerate(phrases)}
    names = {r.leaf: (r.chapter, r.subtopic) for r in rows}
    of_phrase: dict[int, list[int]] = {}
    of_word: dict[str, dict[int, float]] = {}  # word -> phrase -> its share of the phrase
    for r in rows:
        if r.phrase:
            of_phrase.setdefault(number[r.phrase], []).append(r.leaf)
    for p, i in number.items():
        for w in p.split() if " " in p else ():
            of_word.setdefault(w, {}).setdefault(i, 0.0)
            of_word[w][i] += 1 / len(p.split())
    gain = [2.5 + min(2.0, 0.4 * len(p.split())) for p in phrases]
    chapter_words: dict[str, dict[int, float]] = {}  # word -> leaf -> what it adds
    for leaf, (chapter, _) in names.items():
        for w in (chapter or "").lower().split():
            if len(w) > LONG_WORD:
                chapter_words.setdefault(w, {}).setdefault(leaf, 0.0)
                chapter_words[w][leaf] += 0.5
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(phrases)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                found, words, score = find(t), set(t.split(" ")), {}
                for i in found:
                    for leaf in of_phrase[i]:
                        score[leaf] = score.get(leaf, 0.0) + gain[i]
                part: dict[int, float] = {}
                for w in words:
                    for i, s in of_word.get(w, {}).items():
                        if i not in found:
                            part[i] = part.get(i, 0.0) + s
                    for leaf, s in chapter_words.get(w, {}).items():
                        score[leaf] = score.get(leaf, 0.0) + s
                for i, s in part.items():
                    for leaf in of_phrase[i]:
                        score[leaf] = score.get(leaf, 0.0) + s
                best = min(score, key=lambda x: (-round(score[x], 6), x)) if score else None
                out.append((*(names[best] if best is not None else ("", "")), round(score[best], 6) if best is not None else 0.0))
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), ()), kinds)]], names=["id", "chapter", "subtopic", "score"])

    plain = texts.select(F.col(key).alias("id"), normalize_for_match(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    out = plain.mapInArrow(run, f"id {kind}, chapter string, subtopic string, score double")
    confidence = F.round(F.least(F.lit(0.98), 1 - F.exp(-F.col("score") / 7)), 6)
    return out.select("id", "chapter", "subtopic", "score", confidence.alias("confidence"), (confidence < 0.30).alias("needs_review"))


def label_forms(leaves: DataFrame) -> DataFrame:
    """``form`` and ``label``: every leaf's ``chapter :: subtopic`` by its plain notation, and by that of the subtopic alone
    where only one leaf has it."""
    named = leaves.where("chapter is not null and subtopic is not null").select(F.concat_ws(" :: ", "chapter", "subtopic").alias("label"), F.explode(F.array(F.concat_ws(" ", "chapter", "subtopic"), F.col("subtopic"))).alias("form"))
    forms = named.select("label", normalize_for_match(F.regexp_replace("form", "[^A-Za-z0-9]+", " ")).alias("form")).distinct()
    return forms.groupBy("form").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n")).where("n = 1").select("form", "label")


def tidy_labels(df: DataFrame, leaves: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Labels in the taxonomy's spelling whatever their notation; others in lower case; null where there is none."""
    forms = small(label_forms(leaves))
    for c in columns:
        of = forms.select(F.col("form").alias(f"__f_{c}"), F.col("label").alias(f"__l_{c}"))
        form = normalize_for_match(F.regexp_replace(c, "[^A-Za-z0-9]+", " "))
        df = df.join(of, form == F.col(f"__f_{c}"), "left").withColumn(c, F.coalesce(f"__l_{c}", F.when(~blank(F.col(c)), F.lower(F.trim(c))))).drop(f"__f_{c}", f"__l_{c}")
    return df


def grams(text: Column) -> Column:
    """Words of two or more letters or figures without stop words, and pairs of neighbours among them."""
    tokens = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9_]{2,})"), 1), lambda t: ~t.isin(*STOP))
    after = F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1)))
    pairs = F.filter(F.zip_with(tokens, after, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    return F.concat(tokens, pairs)


def tfidf(corpus: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Unit weights (``key``, ``term``, ``w``) and the terms' idf = ln((1 + n) / (1 + df)) + 1."""
    tf = corpus.select(key, F.explode(grams(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    raw = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("len")).alias("w")), idf


def tfidf_labels(texts: DataFrame, labels: DataFrame, key: str = "id", text: str = "text", label_key: str = "leaf", label_text: str = "index_text") -> DataFrame:
    """The label whose text has the greatest cosine with each text; idf is the labels'. A text without a known term
    gets the first label with score 0; the score is 2.2 times the cosine, 0.98 at most."""
    weights, idf = tfidf(labels, label_key, label_text)
    index = small(weights.withColumnRenamed("w", "lw"))
    tf = texts.select(F.col(key).alias("id"), F.explode(grams(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    vector = tf.join(small(idf), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = vector.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    dots = vector.join(index, "term").groupBy("id", label_key).agg(F.sum(F.col("w") * F.col("lw")).alias("dot"))
    best = dots.join(norm, "id").select("id", label_key, F.round(F.col("dot") / F.col("len"), 6).alias("cosine")).groupBy("id").agg(F.max(F.struct("cosine", (-F.col(label_key)).alias("l"))).alias("b"))
    first = labels.agg(F.min(label_key).alias("first"))
    out = texts.select(F.col(key).alias("id")).join(best, "id", "left").crossJoin(F.broadcast(first))  # one row
    cosine = F.coalesce("b.cosine", F.lit(0.0))
    return out.select("id", F.coalesce(-F.col("b.l"), F.col("first")).alias(label_key), cosine.alias("cosine"), F.round(F.least(F.lit(0.98), 2.2 * cosine), 6).alias("score"))


def unit(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label, element by element."""
    each = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def vector_labels(vectors: DataFrame, labels: DataFrame, key: str, vector: str, label: str = "label", label_vector: str = "centroid") -> DataFrame:
    """The label of greatest cosine (first on ties), held within 0 and 0.98. Labels are as many as the taxonomy has."""
    if labels.limit(LABELS_LIMIT + 1).count() > LABELS_LIMIT:
        raise ValueError(f"more than {LABELS_LIMIT} label vectors")
    named = labels.select(F.col(label).alias("__label"), unit(F.col(label_vector)).alias("__lv"))
    all_labels = named.agg(F.collect_list(F.struct("__label", "__lv")).alias("__labels"))
    scored = vectors.crossJoin(F.broadcast(all_labels)).withColumn("__u", unit(F.col(vector)))  # one row
    best = F.array_max(F.transform("__labels", lambda s: F.struct(F.round(dot(F.col("__u"), s["__lv"]), 6).alias("score"), (-s["__label"]).alias("l"))))
    return scored.select(key, best.alias("b")).select(key, (-F.col("b.l")).alias("best_label"), F.greatest(F.lit(0.0), F.least(F.col("b.score"), F.lit(0.98))).alias("score"))


def vote(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted vote of labellers whose columns are ``<name>_label`` and ``<name>_score``; ties go to the first of them.

    ``agreement`` counts all labels equal to the winner, those of score 0 too; confidence is the winner's sum and a
    quarter of the share that agree, 0.99 at most; a reason is given below 0.75 or with fewer than two that agree.
    """
    weights = weights or VOTES
    names = list(weights)
    label = {n: F.when(~blank(F.col(f"{n}_label")), F.col(f"{n}_label")) for n in names}
    given = F.array(*[F.struct(label[n].alias("label"), (F.lit(w) * F.coalesce(F.col(f"{n}_score"), F.lit(0.0))).alias("s")) for n, w in weights.items()])

    def total(mine: Column) -> Column:
        return F.aggregate(given, F.lit(0.0), lambda acc, g: acc + F.when(g["label"] == mine, g["s"]).otherwise(0.0))

    sums = F.array(*[F.struct(F.when(label[n].isNotNull(), F.round(total(label[n]), 6)).otherwise(-1.0).alias("s"), F.lit(-i).alias("order"), label[n].alias("label")) for i, n in enumerate(names)])
    out = df.withColumn("__best", F.array_max(sums))
    winner = F.col("__best.label")
    agree = sum((F.coalesce((label[n] == winner).cast("int"), F.lit(0)) for n in names), F.lit(0))
    confidence = F.when(winner.isNotNull(), F.round(F.least(F.lit(0.99), F.col("__best.s") + 0.25 * agree / len(names)).cast("decimal(18,6)"), 4).cast("double")).otherwise(0.0)
    out = out.withColumn("final_label", F.coalesce(winner, F.lit(""))).withColumn("agreement", agree).withColumn("final_confidence", confidence)
    fine = (F.col("final_confidence") >= 0.75) & (F.col("agreement") >= 2)
    return out.withColumn("needs_review", ~fine).withColumn("review_reason", F.when(fine, "").when(F.col("final_confidence") < 0.75, "low confidence").otherwise("labels disagree")).drop("__best")


def ensemble(questions: DataFrame, leaves: DataFrame, key: str = "row_id") -> DataFrame:
    """Rule and TF-IDF labels of every question (the vector and external scorers fall back as they do by default),
    their vote, heading, pattern, difficulty and micro concept."""
    text = F.concat_ws(" ", "question_text", "option_a", "option_b", "option_c", "option_d")
    base = questions.select(F.col(key).alias("id"), text.alias("text"))
    numbered = leaves.withColumn("leaf", F.row_number().over(Window.orderBy("chapter", "subtopic")))
    names = small(numbered.select("leaf", F.concat_ws(" :: ", "chapter", "subtopic").alias("name"), "ncert_heading"))
    by_rule = rule_labels(base, leaf_keywords(leaves)).select("id", F.when(F.col("chapter") != "", F.concat_ws(" :: ", "chapter", "subtopic")).alias("rule_label"), F.col("confidence").alias("rule_score"))
    by_terms = tfidf_labels(base, numbered).join(names, "leaf").select("id", F.col("name").alias("bm25_label"), F.col("score").alias("bm25_score"))
    both = base.join(by_rule, "id").join(by_terms, "id")
    # default scorers: vectors as TF-IDF, and the outside scorer as the best of the others with score 0
    best = F.when(F.coalesce("rule_score", F.lit(0.0)) >= F.col("bm25_score"), F.col("rule_label")).otherwise(F.col("bm25_label"))
    four = both.withColumn("embedding_label", F.col("bm25_label")).withColumn("embedding_score", F.col("bm25_score")).withColumn("llm_label", F.coalesce(best, "bm25_label")).withColumn("llm_score", F.lit(0.0))
    voted = vote(four)
    pattern = rules.question_pattern(F.col("text"))
    chapter, subtopic = F.element_at(F.split("final_label", " :: "), 1), F.element_at(F.split("final_label", " :: "), -1)
    headed = voted.join(names.select(F.col("name").alias("final_label"), "ncert_heading"), "final_label", "left")
    return headed.select("id", "final_label", "final_confidence", "agreement", "needs_review", "review_reason", "ncert_heading", pattern.alias("question_pattern"), rules.difficulty(F.col("text"), pattern).alias("difficulty_estimate"), rules.micro_concept(F.col("text"), chapter, subtopic).alias("m")).select("id", "final_label", "final_confidence", "agreement", "needs_review", "review_reason", "ncert_heading", "question_pattern", "difficulty_estimate", F.col("m.label").alias("micro_concept"), F.col("m.confidence").alias("micro_confidence"))
