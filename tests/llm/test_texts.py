"""Scanned text and subjects on hand-made fixtures."""

import random

import numpy as np
import pandas as pd

from lodestone.llm import scans, subjects

WORDS = "the manager planned every section before market students asked question answers learners compare columns carefully short summary notebook after three days teacher repeated example lesson point nearly year".split()


def corpus():
    rng = random.Random(7)
    line = lambda: " ".join(rng.choices(WORDS, k=9)) + "."
    return [(100 + i, "other.txt", i, "\n".join(line() for _ in range(14))) for i in range(60)]


PAGES = "page_id long, text_file_path string, page_no int, page_text string, key string"


def found(spark, pages, questions=()):
    p = spark.createDataFrame([(*r, "x") for r in corpus() + pages], PAGES)
    q = spark.createDataFrame(list(questions), "row_id long, question_text string")
    f = scans.Findings(p, q)
    mine = {r[0] for r in pages}
    return f, {(r.table_name, r.row_key, r.line_no, r.kind) for r in f.found().collect() if r.table_name == "questions" or r.row_key in mine}


def test_page_furniture_and_words(spark):
    one = "Class Notebook Companion\n\nThe manager planncd every section before mar-\nket students asked the question.\n1665\nTotal of pens 4467\nlearners compare columns carefully.\nteacher repeated example lesson point nearly year\nshort summary notebook after three days teach-\n[12]"
    two = "CLASS NOTEBOOK COMPANION\n\ner repeated every example.\nthe well-known teacher\npeople of well-\nknown schools asked the question before\nmarket students asked question answers learners\ncompare columns carefully short summary\n[13]"
    three = "Class Notebook Comp@nion\nlearners asked for well-known sections\nstudents compare well-known columns\n\n14"
    pages = [(1, "f.txt", 1, one), (2, "f.txt", 2, two), (3, "f.txt", 3, three), (4, "f.txt", 4, None), (5, None, None, ""), (6, "g.txt", None, " \n \n")]
    questions = [(1, "Which answers did the teachcr\n--- OCR Page 9 ---\nrepeat after the les-\nson? 12\n12"), (2, None), (3, "Page 4"), (4, "plain question")]
    f, got = found(spark, pages, questions)
    assert {(k, n) for t, k, n, kind in got if kind == "header"} == {(1, 1), (2, 1), (3, 1)}
    assert {(t, k, n) for t, k, n, kind in got if kind == "page_number"} == {("extracted_pages", 1, 10), ("extracted_pages", 2, 9), ("extracted_pages", 3, 5), ("questions", 1, 2), ("questions", 3, 1)}
    assert {(t, k, n) for t, k, n, kind in got if kind == "split_word"} == {("extracted_pages", 1, 3), ("extracted_pages", 1, 9), ("questions", 1, 3)}
    assert {(t, k, n) for t, k, n, kind in got if kind == "misread"} == {("extracted_pages", 1, 3), ("questions", 1, 1)}
    clean = {(r.table_name, r.row_key): r.clean_text for r in f.repaired().collect()}
    assert clean[("extracted_pages", 1)].startswith("The manager planned every section before market students asked the question. 1665")
    assert clean[("extracted_pages", 1)].endswith("three days teacher")
    assert clean[("extracted_pages", 2)].startswith("repeated every example.")
    assert "well-known schools" in clean[("extracted_pages", 2)]
    assert clean[("questions", 1)] == "Which answers did the teacher repeat after the lesson? 12 12"


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_automata_find_every_word_within_the_distance():
    """Against the plain edit distance of every pair, over random words of a small alphabet, so that many are near."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abrn", k=rng.randint(1, 9)))
    vocabulary, asked = sorted({word() for _ in range(400)}), sorted({word() for _ in range(200)} | {"", "ab" * 30})
    lexicon = scans.Lexicon(vocabulary)
    assert lexicon.words == vocabulary
    near = lambda lexicon, asked: {(asked[i], lexicon.words[j]): e for x in lexicon.within(asked, group=64) for i, j, e in zip(*x)}
    got = near(lexicon, asked)
    merged_or_parted = 0
    for a in asked:
        for b in vocabulary:
            e = edits(a, b)
            if e <= (1 if len(a) <= 4 else 2):
                assert got.get((a, b), 9) <= e, (a, b)
            elif (a, b) in got:
                merged_or_parted += 1  # closer only by two characters read for one or one for two
                assert any(r in a for r, _ in scans.MERGED) or any(r in a for r, _ in scans.PARTED)
    assert merged_or_parted
    assert not near(scans.Lexicon([]), ["word"])


def test_confusions_are_costs():
    words = ["manager", "learners", "nearly", "question", "summary"]
    lexicon = scans.Lexicon(words)
    for word in words:
        once = {word[:i] + read + word[i + len(printed) :] for printed, read in scans.CONFUSIONS for i in range(len(word)) if word.startswith(printed, i)}
        assert all(scans.cost(w, word) == 1 for w in once - {word})
        asked = sorted(once - {word})
        assert {asked[i] for x in lexicon.within(asked) for i, j in zip(*x[:2]) if lexicon.words[j] == word} == set(asked)
    assert scans.cost("rnanagcr", "manager") == 2 and scans.cost("manager", "manager") == 0
    # a typing error is found by the automata and costs too much to be taken for a scanner's
    assert scans.cost("managxr", "manager") == scans.OTHER_EDIT > scans.MAX_EDITS
    assert any(lexicon.words[j] == "manager" for x in lexicon.within(["managxr"]) for j in x[1])


def test_only_words_of_near_lengths_are_walked(monkeypatch):
    """A trie holds only what two edits may reach by its length, so that a long word costs nothing among short ones."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abrn", k=n))
    lexicon, children, seen = scans.Lexicon([word(6) for _ in range(300)]), scans._children, []

    def counted(*a):
        got = children(*a)
        seen.append(len(got[0]))
        return got

    monkeypatch.setattr(scans, "_children", counted)
    assert not list(lexicon.within([word(9) for _ in range(50)] + [word(3) for _ in range(50)])) and not sum(seen)
    assert list(lexicon.within([word(8) for _ in range(50)])) and sum(seen)


def test_candidates_are_all_pairs_of_that_cost():
    """What leaves out pairs before their cost is reckoned leaves out none that confusions make."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abhmnrclidoe6918u", k=rng.randint(2, 7)))
    vocabulary = {word() for _ in range(1500)}
    suspects = set()
    for v in sorted(vocabulary)[:400]:
        for _ in range(2):  # a confusion or two of a word
            printed, read = rng.choice(scans.CONFUSIONS)
            v = v.replace(printed, read, 1)
        suspects.add(v)
    words, asked = sorted(vocabulary), sorted(suspects)
    lexicon = scans.Lexicon(words)
    right = {(asked[i], words[j], c) for x in lexicon.within(asked) for i, j in zip(x[0].tolist(), x[1].tolist()) if 0 < (c := scans.cost(asked[i], words[j], 2)) <= 2}
    got = scans._search(None, pd.DataFrame({"v": words, "nv": 100}), pd.DataFrame({"w": asked, "nw": 1}))
    assert set(got.itertuples(index=False, name=None)) == right and len(right) > 100


def test_lines_of_invisible_characters(spark):
    pages = [(1, "f.txt", 1, "\u200b\nThe manager planned every section.\n\ufeff\u200d"), (2, "f.txt", 2, "\u2060")]
    _, got = found(spark, pages, [(1, "\u200b\nPage 4"), (2, "\u200b")])
    assert got == {("questions", 1, 2, "page_number")}


def test_titles_of_several_lines():
    reader, lines = scans.Reader(), ["Class  Notebook | 12", "| xiv Comp@nion 3 rn", "\ua66e cl", "", "12"]
    for some in (lines, lines[:2], lines[:1]):
        assert reader.titles(some) == [t for x in some for t in reader.titles([x])]
    assert reader.titles(lines[:1]) == reader.titles(["CLASS notebook | 7"])


def test_page_marks_of_any_length(spark):
    long = "-" * 80 + " 7 " + "-" * 80
    pages = [(1, "f.txt", 1, "The manager planned every section.\n" + long), (2, "f.txt", 2, "   Page 12 of 90    " + " " * 100)]
    _, got = found(spark, pages, [(1, "  " * 60 + "Page 4" + " " * 90), (2, "p values and pages of notes are long"), (3, "--- 12 ---")])
    assert {(t, k, n) for t, k, n, kind in got if kind == "page_number"} == {("extracted_pages", 1, 2), ("extracted_pages", 2, 1), ("questions", 1, 1), ("questions", 3, 1)}


def test_nothing_to_read(spark):
    f = scans.Findings(spark.createDataFrame([], PAGES), spark.createDataFrame([], "row_id long, question_text string"))
    assert f.found().count() == 0 and f.repaired().count() == 0


TOPICS = {"law": ["court order", "legal notice", "consumer claim"], "food": ["fresh bread", "olive oil", "hot soup"], "music": ["brass band", "guitar string", "loud chorus"]}


def say(rng, subject):
    return rng.choice(["Everyone talks about the {} with the {}.", "A {} needs a {} in the end.", "They compare the {} to every {}."]).format(*rng.sample(TOPICS[subject], 2))


def test_subjects(spark):
    rng = random.Random(9)
    docs, truth = [], {}
    for i in range(400):
        mix = rng.sample(sorted(TOPICS), rng.choice([1, 1, 2]))
        s = [say(rng, m) for m in mix for _ in range(6 // len(mix))] + ["We shall return to it later today."] * 2
        other = rng.choice([t for t in TOPICS if t not in mix])
        s.append(f"My cousin, who studies {rng.choice(TOPICS[other])}, says hello.")
        rng.shuffle(s)
        docs.append((i, " ".join(s), 1))
        truth |= {(i, m): 1 for m in mix}
    docs += [(900, None, 1), (901, "", 1), (902, "   ", 1), (903, "Click here to log in now please.", 1), (None, "A court order needs a legal notice in the end.", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject int")
    areas = spark.createDataFrame([(t, "x") for t in TOPICS], "subject string, description string")
    examples = spark.createDataFrame([(i, s, " ".join(say(rng, s) for _ in range(3))) for i, s in enumerate(sorted(TOPICS) * 5)], "example_id long, subject string, text string")
    got = {(r.doc_id, r.subject) for r in subjects.Subjects(d, areas, examples, k=12).assigned().collect()}
    right = len(got & set(truth))
    assert right / len(got) > 0.97 and right / len(truth) > 0.97
    assert not {i for i, _ in got} & {900, 901, 902, 903, None}
    assert subjects.Subjects(d.limit(0), areas, examples).assigned().count() == 0
    assert subjects.Subjects(d, areas, examples.limit(0)).assigned().count() == 0


def test_the_leaves_decide(spark):
    """Without a clustering - one leaf - no term is discriminative and no document has a subject."""
    rng = random.Random(3)
    docs = [(i, " ".join(say(rng, t) for _ in range(6))) for i, t in enumerate(sorted(TOPICS) * 60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    areas = spark.createDataFrame([(t, "x") for t in TOPICS], "subject string, description string")
    examples = spark.createDataFrame([(i, s, " ".join(say(rng, s) for _ in range(3))) for i, s in enumerate(sorted(TOPICS) * 5)], "example_id long, subject string, text string")
    many = subjects.Subjects(d, areas, examples, k=12)
    assert many.assigned().count() == 180 and set(many.of_leaf.tolist()) == {0, 1, 2}
    assert subjects.Subjects(d, areas, examples, k=1).assigned().count() == 0
    # a wrong clustering gives a wrong result: the tree's cuts turned into noise
    cuts = subjects.Tree.set
    try:
        subjects.Tree.set = lambda self, node, a, b: cuts(self, node, np.ones(subjects.DIMS), np.zeros(subjects.DIMS) - a * 0)
        assert subjects.Subjects(d, areas, examples, k=12).assigned().count() < 90
    finally:
        subjects.Tree.set = cuts


def test_places_of_sentences():
    per, lens, flat = subjects.sentences(["One two. Three / four..five\nsix", None, "", " \n. ", "One two"])
    assert per.tolist() == [5, 0, 0, 0, 1] and lens.tolist() == [2, 1, 1, 1, 1, 2]
    assert (flat[:2] == flat[-2:]).all() and len(flat) == 8
    at, word = subjects.places(lens, flat)
    assert len(at) == sum(2 * n - 1 for n in lens) and word.tolist() == [True, True, False, True, True, True, True, True, True, False]
    assert at[:3].tolist() == at[-3:].tolist() and at.min() >= 0 and at.max() < subjects.PLACES


def test_no_term_is_left_out():
    """A term counts by where it stands, whatever its rank: the rarest counts as the commonest does."""
    n = np.array([[1000.0, 0, 0], [40, 0, 0], [300, 300, 300], [2, 0, 0]])
    w = subjects.log_odds(n, np.full(3, 1e6))
    assert w[0, 0] > 1 and w[1, 0] > 0.9 and not w[2].any() and not w[3].any()
    assert not subjects.log_odds(n[:, :1], np.array([1e6])).any()


def test_subjects_of_texts_of_short_lines(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(say(rng, t) for _ in range(6))) for i, t in enumerate(sorted(TOPICS) * 30)]
    docs += [(900, "Court order.\nLegal notice.\nConsumer claim."), (901, say(rng, "food") + "\nCourt order.\nLegal notice.\nConsumer claim.")]
    areas = spark.createDataFrame([(t, "x") for t in TOPICS], "subject string, description string")
    examples = spark.createDataFrame([(i, s, " ".join(say(rng, s) for _ in range(3))) for i, s in enumerate(sorted(TOPICS) * 5)], "example_id long, subject string, text string")
    found = subjects.Subjects(spark.createDataFrame(docs, "doc_id long, text string"), areas, examples, k=12).assigned().where("doc_id >= 900")
    assert {(r.doc_id, r.subject) for r in found.collect()} == {(900, "law"), (901, "law"), (901, "food")}


def test_queries_over_the_small_tables(spark, sf):
    from lodestone.llm.queries import queries

    for name in ("p1_annotators", "p5_truth", "p9_report", "p10_makeup"):
        assert queries()[name](spark, sf).count() > 0
