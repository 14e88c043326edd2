"""Consensus, survivors, term counts, encoding, mixing."""

import random
from collections import Counter
from datetime import datetime

import pytest
from tokenizers import Tokenizer

from lodestone.llm import consensus, encode, mixing, survivor, terms

LEAVES = [(c, f"{c.lower()} topic {i}") for c in ("Red", "Blue", "Green") for i in range(3)]


@pytest.fixture(scope="module")
def leaves(spark):
    return spark.createDataFrame(LEAVES, "chapter string, subtopic string")


def test_consensus_prefers_the_reliable(spark, leaves):
    """Held-out accuracy: two noisy annotators against a good one; the consensus must beat a plain majority."""
    rng = random.Random(3)
    labels = [f"{c} :: {s}" for c, s in LEAVES]
    rows, truth = [], {}
    for i in range(600):
        t = rng.choice(labels)
        truth[f"q{i}"] = t
        give = lambda p, t=t: t if rng.random() < p else rng.choice(labels)
        say = [give(0.35), give(0.4), give(0.45), give(0.95)]
        say = [rng.choice([x, x.upper(), x.replace(" :: ", " / "), x.split(" :: ")[1], "  " + x]) for x in say]
        say = [rng.choice([x, x, x, None, "n/a", ""]) if j < 3 else x for j, x in enumerate(say)]
        rows.append((f"q{i}", *say, 0.5))
    rows += [("q1000", None, "unsure", "", "Red :: nothing", 0.5), (None, *["Red :: red topic 0"] * 4, 0.1), rows[0]]
    df = spark.createDataFrame(rows, "canonical_question_id string, rule_label string, bm25_label string, embedding_label string, llm_label string, final_confidence double")
    got = {r.canonical_question_id: r for r in consensus.consensus(df, leaves).collect()}
    assert set(got) == set(truth)
    right = sum(got[q].consensus_label == t for q, t in truth.items()) / len(truth)
    assert right > 0.93
    per = {r.annotator: r for r in consensus.reliability(df, leaves).collect()}
    assert per["llm_label"].accuracy > 0.85 > 0.6 > per["rule_label"].accuracy
    assert 0 < per["llm_label"].alpha < 1


def test_consensus_of_nothing(spark, leaves):
    none = spark.createDataFrame([], "canonical_question_id string, rule_label string, bm25_label string, embedding_label string, llm_label string")
    assert consensus.consensus(none, leaves).count() == 0
    some = spark.createDataFrame([("a", "x", None, None, None)], none.schema)
    assert consensus.consensus(some, leaves.limit(0)).count() == 0
    assert consensus.consensus(some, leaves).count() == 0


ROWS = "row_id long, canonical_question_id string, source_tier string, source_weight double, collected_at timestamp_ntz, question_text string, passage_text string, option_a string, correct_option string, difficulty_estimate string, micro_concept string"


def test_survivors(spark):
    t = lambda d: datetime(2024, 1, d)
    whole = "A firm sells pens. Which option follows?"
    rows = [
        (1, "a", "x", 0.5, t(1), whole, "n/a", "pen", "A", None, "m1"),
        (2, "a", "y", 0.9, t(2), "A firm sells pens. Which opt", "text", " -- ", "(B)", "Hard", "m1;m2"),
        (3, "a", "z", 0.9, t(3), "A firm sells pens. Whi…", None, "ink", "#N/A", "NULL", "m1|m1"),
        (4, "a", "z", None, None, whole, "other", "ink", "TBD", "easy", None),
        (5, "b", "x", 1.0, t(1), whole, None, None, None, None, None),
        (6, "c", "x", 0.5, None, "PENS SELL WELL WHICH OPTION FOLLOWS", "", None, "a", "unknown", "?"),
        (7, "c", "x", 0.5, None, "PENS SELL WELL", "nil", None, "b", "?", "m3"),
        (8, "d", "x", 0.5, t(2), None, None, None, None, None, None),
        (9, "d", "x", 0.5, t(2), "", " ", None, "-", ".", None),
        (10, None, "x", 1.0, t(2), whole, "p", "q", "A", "easy", "m"),
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = {(r.canonical_question_id, r.field_name): r.row_id for r in survivor.surviving(survivor.claims(df)).collect()}
    assert got == {("a", "question_text"): 1, ("a", "passage_text"): 2, ("a", "option_a"): 3, ("a", "correct_option"): 2, ("a", "difficulty_estimate"): 2, ("c", "question_text"): 6, ("c", "correct_option"): 6}
    kept = {(r.canonical_question_id, r.value): r.posterior for r in survivor.truths(df).collect()}
    assert kept[("a", "m1")] > kept[("a", "m2")]
    assert survivor.claims(df.limit(0)).count() == 0 and survivor.truths(df.limit(0)).count() == 0
    records = {r.canonical_question_id: r for r in survivor.records(survivor.claims(df), survivor.truths(df)).collect()}
    true = {}
    for r in survivor.truths(df).where("kept").collect():
        true.setdefault(r.canonical_question_id, set()).add(r.value)
    assert set(records) == {"a", "c"} and all(set(r.micro_concept) == true.get(k, set()) and list(r.micro_concept) == sorted(r.micro_concept) for k, r in records.items())
    assert records["a"].question_text == whole and "m1" in records["a"].micro_concept
    quality = {r.source: r for r in survivor.source_quality(df).collect()}
    assert all(0 < r.sensitivity < 1 and 0 < r.specificity <= 1 for r in quality.values())


def test_terms(spark):
    cells = ["Big Idea; small-idea", "big  idea|BIG_IDEA", None, "", " ; | ", "x" * 50000] + ["hot; hot"] * 300
    df = spark.createDataFrame([(c, i % 3, 1) for i, c in enumerate(cells)], "t string, n long, term int")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.marked(df, "t", separators=";|").collect()}
    assert got == {"big idea": (3, 2, "rare"), "small idea": (1, 1, "rare"), "x" * 50000: (1, 1, "rare"), "hot": (600, 300, "common")}
    weighted = {r.term: r.occurrences for r in terms.frequencies(df.where("t like 'hot%'"), "t", weight="n").collect()}
    assert weighted == {"hot; hot": sum(i % 3 for i in range(6, 306))}
    ids = sorted(r.term_id for r in terms.frequencies(df, "t", separators=";|").collect())
    assert ids == list(range(4))
    assert terms.marked(df.limit(0), "t").count() == 0


def test_count_arrays(spark):
    """A pair of arrays per block and range of identifiers, each of as many places as a range, that add up to the counts."""
    df = spark.createDataFrame([("a;b;a",), ("b",), (None,)] * 40, "t string").repartition(3)
    blocks = terms.block_counts(df, "t", separators=";")
    ids = terms.dictionary(blocks)
    arrays = terms.block_arrays(blocks.join(ids, "term").select("block", "term_id", "occurrences", "records")).collect()
    assert len(arrays) == 3 == len({(r["range"], r.block) for r in arrays}) and {r["range"] for r in arrays} == {0}
    assert all(len(r.occurrences) == len(r.records) == terms.RANGE for r in arrays)
    at = {r.term: r.term_id for r in ids.collect()}
    sums = {t: (sum(r.occurrences[i] for r in arrays), sum(r.records[i] for r in arrays)) for t, i in at.items()}
    assert sums == {"a": (80, 40), "b": (80, 80)}


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_encoding(spark, public):
    rng = random.Random(4)
    alphabet = "aab  \n\t\x1c\x85​'sतहिन्दी१२½²中文😅<|endoftext|>'ll don’té́ﬁ\x00　"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(300)] + ["", None, "<|endoftext|>", " " * 1000, "a" * 100_000, "ab" * 20_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encode(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (public.encode(t, add_special_tokens=False).ids if t else [])
    counts = {r.doc_id: r.tokens for r in encode.token_counts(df, ("doc_id",)).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode.encode(df.limit(0)).count() == 0


def test_every_token_is_found():
    ranks = encode.read_ranks()
    v = encode.Vocabulary(ranks)
    assert all(v.rank(t) == r for t, r in ranks.items())
    assert v.rank(b"no such token at all") == -1
    # a token reached by merges alone is the one the hash gives
    assert all(v.merge(t) == [r] for t, r in list(ranks.items())[::97])


def test_mixture(spark):
    rng = random.Random(6)
    docs = [(i, f"word {'more ' * rng.randrange(3, 30)}", rng.choice(["big", "BIG ", "mid-size", "mid_size", None, "unlisted"])) for i in range(900)]
    docs += [(1000 + i, "tiny text here", "tiny") for i in range(5)] + [(2000, None, "big"), (2001, "", "big"), (None, "x", "big")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("Big", 0.5, 1), ("mid_size", 0.3, 3), ("tiny", 0.1, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(d)
    taken = mixing.mixture(sizes, targets, budget=6000)
    rows = taken.collect()
    assert sum(r.tokens for r in rows) <= 6000 and sum(r.tokens for r in rows) > 5900
    assert max(Counter((r.source, r.doc_id) for r in rows if r.source == "tiny").values()) == 2
    assert len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)
    rep = {r.source: r for r in mixing.report(sizes, targets, taken).collect()}
    assert rep["tiny"].exhausted and rep["none"].tokens_taken == 0 and rep[None].target_share == 0 and rep["unlisted"].actual_share == 0
    assert abs(rep["big"].actual_share / rep["mid_size"].actual_share - 5 / 3) < 0.05
    empty = mixing.sized(d.limit(0))
    assert all(r.tokens_taken == 0 for r in mixing.report(empty, targets, mixing.mixture(empty, targets)).collect())


def test_mixture_against_a_plain_queue(spark):
    """The same copies as a queue sorted whole, for many budgets; one source has little weight and most of the tokens."""
    rng = random.Random(2)
    docs = [(i, rng.choices(["big", "mid", "slow"], [2, 2, 6])[0], rng.choice([1, 1, 5, 40, 300])) for i in range(700)]
    sizes = spark.createDataFrame(docs, "id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.7, 3), ("mid", 0.299, 2), ("slow", 0.001, 5)], "source string, target_share double, max_repeats int")
    queued = mixing.queue(sizes, targets)
    every = sorted((r.finish, r.source, r.id, r["pass"], r.tokens) for r in mixing.copies(queued, mixing.F.lit(1e12)).collect())
    assert len(every) == sum({"big": 3, "mid": 2, "slow": 5}[s] for _, s, _ in docs)
    for budget in (0, 1, 500, 20_000, 60_000, 10**9):
        want, total = set(), 0
        for finish, source, i, k, n in every:
            total += n
            if total > budget:
                break
            want.add((i, source, k))
        taken = mixing.mixture(sizes, targets, budget=budget)
        assert {(r.doc_id, r.source, r["pass"]) for r in taken.collect()} == want, budget
    finish = [r.finish for r in mixing.ordered(taken).collect()]
    assert finish == sorted(finish)
    # only what can be taken is made: the slow source's copies beyond the end are not
    assert mixing.copies(queued, mixing.F.lit(1000.0)).where("source = 'slow'").count() <= 1
    assert mixing.spent_at([(0.5, 10.0), (0.5, 1000.0)], 100.0) == 180.0 and mixing.spent_at([(1.0, 5.0)], 6.0) == float("inf")
