"""Readers, writers, documents and the stream of attempts."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources import documents, files
from lodestone.streaming import attempts

Q = files.strings(["source", "question_text", "option_a", "raw_file_path"])


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('question_text,option_a,extra\r\n"He said ""no""\nand left", x ,1\r\n,,\r\nplain,,2\r\n'.encode())
    rows = files.read_csv(spark, str(p), Q, trimmed=True).collect()
    assert [(r.question_text, r.option_a, r.source) for r in rows] == [('He said "no"\nand left', "x", None), ("plain", None, None)]
    assert files.read_csv(spark, str(tmp_path / "none.csv"), Q).columns == Q.names
    (tmp_path / "b.csv").write_text("other,column\n1,2\n")
    (tmp_path / "c.csv").write_text("source,question_text\nmine,second\n")
    got = {(r.source, r.question_text) for r in files.read_csv_folder(spark, str(tmp_path), Q, "question_text").collect()}
    assert got == {("manual:a.csv", 'He said "no"\nand left'), ("manual:a.csv", "plain"), ("mine", "second")}
    assert files.read_csv_folder(spark, str(tmp_path / "none"), Q, "question_text").count() == 0
    assert all(r.raw_file_path.endswith(".csv") for r in files.read_csv_folder(spark, str(tmp_path), Q, "question_text").collect())


def test_json_and_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    (tmp_path / "l.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    (tmp_path / "l.json").write_text(json.dumps([{"a": 3}, {"b": "y"}]))
    assert files.read_jsonl(spark, str(tmp_path / "l.jsonl"), schema).count() == 2
    assert {r.a for r in files.read_json_array(spark, str(tmp_path / "l.json"), schema).collect()} == {3, None}
    assert files.read_jsonl(spark, str(tmp_path / "no"), schema).count() == 0
    df = files.read_jsonl(spark, str(tmp_path / "l.jsonl"), schema)
    files.write_jsonl(df, str(tmp_path / "out"))
    files.write_csv(df.limit(0), str(tmp_path / "csv"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), schema).count() == 2
    files.publish(df, "published")
    assert spark.table("published").count() == 2


def test_taxonomies(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"units": [{"unit": "U", "chapter": "C", "subtopics": {"s1": ["a", "b"], "s2": []}}]}))
    assert {(r.subtopic, len(r.keywords)) for r in files.taxonomy(spark, str(tmp_path / "t.json")).collect()} == {("s1", 2), ("s2", 0)}
    (tmp_path / "s.json").write_text(json.dumps({"sections": [{"section": "A", "unit": "U", "chapters": [{"chapter": "C", "subtopics": ["x", "y"]}]}]}))
    assert files.sections_taxonomy(spark, str(tmp_path / "s.json")).count() == 2
    assert files.taxonomy(spark, str(tmp_path / "none.json")).count() == 0


def test_raw_and_folder(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a  b\n\n\n\nc")
    (tmp_path / "y.bin").write_bytes(b"zz")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.raw_texts(spark, str(tmp_path)).collect()}
    assert got == {"x.txt": "a b\n\nc", "y.bin": ""}
    assert [r.source_url for r in files.scan_folder(spark, str(tmp_path)).collect()] == ["manual-official://x.txt"]


HTML = '<html><script>var a=1;</script><style>p{}</style><p>Hello &amp; <b>you</b></p><table><tr><th>k</th><td>1</td></tr></table><a href="paper.pdf">Question paper</a><a href="/about">About us</a></html>'


def test_html(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>broken <b"), (4, "")], "id int, html string")
    got = {r.id: r.text for r in documents.html_text(df, "id", "html").collect()}
    assert got[1].startswith("Hello &\nyou") and "--- Tables ---\nk | 1" in got[1] and "var a" not in got[1] and got[2] == "" and got[4] == ""
    links = documents.html_links(df, "id", F.col("html"), "paper|exam", "question").collect()
    assert [(r.url, r.label) for r in links] == [("paper.pdf", "Question paper")]


def test_documents(spark):
    page = '<script>{\\"_id\\":\\"q1\\",\\"question\\":\\"What is it?\\",\\"option2\\":\\"b\\",\\"correctAnswer\\":\\"2\\",\\"customMockName\\":\\"Mock 2024 shift 1\\"}{\\"question\\":\\"no id\\"}</script>'
    e = documents.embedded_questions(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "id", "html").collect()
    assert [(r.question_id, r.question_text, r.option_a, r.option_b, r.correct_option, r.year, r.shift) for r in e] == [("q1", "What is it?", "", "b", "B", "2024", "1")]
    text = "Q1) Which one?\n(A) x\n(B) y\nAnswer: 2\nQ2) What else is there?\n(A) p\n(B) q\n(C) r\n(D) s\nAnswer: D"
    q = documents.parse_questions(spark.createDataFrame([(1, text, "paper 2024 shift 2", "u", "p")], "id int, t string, s string, u string, p string"), "id", "t", "s", "u", "p").orderBy("pos").collect()
    assert [(r.question_text, r.option_a, r.correct_option, r.year, r.shift) for r in q] == [("Which one?", "x", "B", "2024", "2"), ("What else is there?", "p", "D", "2024", "2")]
    read = "Read the following: a firm sells pens.\nQ1) Which one?\n(A) x\n(B) y"
    docs = spark.createDataFrame([(1, "Passage - " + read + "\nQ1) Which one?\n(A) x\n(B) y", "s", "u", "p"), (2, None, "s", "u", "p"), (3, "", None, None, None)], "id int, t string, s string, u string, p string")
    every = documents.parse_questions(docs, "id", "t", "s", "u", "p")
    once = documents.parsed(docs, "id", "t", "s", "u", "p")
    assert every.count() == 3 and once.count() == 2
    keys = "Final Answer Keys Subject :308 Computer 1234567 1 7654321 Drop Final Answer Keys History 1111111 2"
    a = documents.answer_pairs(spark.createDataFrame([(1, keys)], "id int, t string"), "id", "t", "Final Answer Keys", "308|computer").collect()
    assert [(r.question_id, r.correct_option) for r in a] == [("1234567", "A"), ("7654321", "DROP")]
    paper = "Shift 1 Question Number : 15 Question Id : 999 x Question Type : mcq Question Number : 16 Question Id : 998 Question Type : MCQ"
    p = documents.paper_rows(spark.createDataFrame([(1, paper)], "id int, t string"), "id", "t").collect()
    assert [(r.question_number, r.section, r.question_type) for r in p] == [(15, "Section A", "MCQ"), (16, "Section B1", "MCQ")]
    lines = "Shift 2\nQuestion Number: 3\nQuestion Type\nSA\nQuestion ID 77\nQuestion Number 4\nno id"
    p = documents.paper_rows(spark.createDataFrame([(1, lines), (2, None), (3, "")], "id int, t string"), "id", "t").collect()
    assert [(r.shift, r.question_number, r.question_id, r.question_type) for r in p] == [("2", 3, "77", "SA")]
    pdf = documents.pdf_text(spark.createDataFrame([(1, None), (2, bytearray(b"not a pdf"))], "id int, c binary"), "id", "c").collect()
    assert pdf[0].status == "empty" and pdf[1].text == ""


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", "t", "A", "A"), ("s", "t", "B", "A"), ("s", "u", None, "A")], "s string, t string, chosen string, correct string")
    rows.write.parquet(str(tmp_path / "in"))
    run = lambda: attempts.keep_weakness(attempts.stream(spark, str(tmp_path / "in"), rows.schema), ["t"], "chosen", "correct", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert run()
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    assert run()
    got = {r.t: (r.wrong, r.skipped, r.correct) for r in attempts.weakness_table(spark, str(tmp_path / "out"), ["t"]).collect()}
    assert got == {"t": (2, 0, 2), "u": (0, 2, 0)}
    want = {r.t: r.weakness_score for r in attempts.batch_weakness(rows.union(rows), ["t"], "chosen", "correct").collect()}
    assert {r.t: r.weakness_score for r in attempts.weakness_table(spark, str(tmp_path / "out"), ["t"]).collect()} == want
