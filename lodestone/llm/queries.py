"""The pN_ queries, each over its whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import consensus, copies, encode, links, mixing, near, scans, subjects, survivor, terms
from lodestone.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_consensus(spark, d).select("canonical_question_id", "consensus_label")


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "review_suggestions"), table(spark, d, "ncert_reverse_index"))


def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "review_suggestions"), table(spark, d, "ncert_reverse_index"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_pairs(table(spark, d, "questions"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "questions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(table(spark, d, "questions"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(table(spark, d, "questions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.Findings(table(spark, d, "extracted_pages"), table(spark, d, "questions")).found()


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.Findings(table(spark, d, "extracted_pages"), table(spark, d, "questions")).repaired()


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return survivor.claims(table(spark, d, "questions_dedupe"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving(_claims(spark, d)).select("canonical_question_id", "field_name", "row_id")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.records(_claims(spark, d), survivor.truths(table(spark, d, "questions_dedupe")))


def p5_truth(spark: SparkSession, d: str) -> DataFrame:
    return survivor.truths(table(spark, d, "questions_dedupe"))


def p5_sources(spark: SparkSession, d: str) -> DataFrame:
    return survivor.source_quality(table(spark, d, "questions_dedupe"))


def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    patterns = terms.marked(table(spark, d, "pattern_by_topic"), "question_pattern", weight="question_count")
    return patterns.union(terms.marked(table(spark, d, "questions_dedupe"), "micro_concept", separators=";|"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_frequencies(spark, d).where("mark is not null").select("field_name", "term", "mark")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    linked = links.match_links(table(spark, d, "match_pairs"), table(spark, d, "questions_dedupe"))
    return links.components(linked).select(F.col("id").alias("canonical_question_id"), "group_id")


def _vocabulary(spark: SparkSession) -> str:
    """The tokenizer's file: the session's ``spark.lodestone.vocabulary``, else where it is found here."""
    return spark.conf.get("spark.lodestone.vocabulary", encode.VOCABULARY)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), path=_vocabulary(spark))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes, targets = mixing.sized(table(spark, d, "documents"), path=_vocabulary(spark)), table(spark, d, "mix_targets")
    return sizes, targets, mixing.mixture(sizes, targets)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mixture(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.ordered(_mixture(spark, d)[2])


def _subjects(spark: SparkSession, d: str) -> subjects.Subjects:
    return subjects.Subjects(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_examples"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).assigned()


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents and their part of all documents with a subject."""
    found = _subjects(spark, d).assigned()
    each = found.withColumn("part", 1 / F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    total = each.agg(F.sum("part").alias("total"))
    return each.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("part").alias("parts")).crossJoin(F.broadcast(total)).select("subject", "documents", F.round(F.col("parts") / F.col("total"), 6).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    order = (p1_found, p1_consensus, p1_annotators, p2_found, p2_records, p3_found, p3_groups, p4_found, p4_text, p5_found, p5_records, p5_truth, p5_sources, p6_found, p6_frequencies, p7_found, p8_ids, p9_report, p9_mixture, p10_found, p10_makeup)
    return {f.__name__: f for f in order}


_SQUEEZE = r"regexp_replace(replace(lower(coalesce({0}, '')), 'ς', 'σ'), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_OPTIONS = "list_sort(list_filter([" + ", ".join(_SQUEEZE.format(f"option_{x}") for x in "abcd") + "], lambda x: x <> ''))"
_KEYED = f"SELECT row_id, {_SQUEEZE.format('question_text')} AS t, {_OPTIONS} AS o, question_text, option_a, option_b, option_c, option_d, year FROM questions WHERE row_id IS NOT NULL"
_WS = r"[\s \x{200b}-\x{200d}\x{2060}\x{feff}*_~`\"''”’»]+$"


def _present(column: str) -> str:
    words = ", ".join(f"'{w}'" for w in survivor.STAND_INS)
    plain = rf"trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"coalesce({plain} <> '' AND {plain} NOT IN ({words}), false)"


def _p5_sql() -> str:
    bare = rf"regexp_replace(question_text, '{_WS}', '')"
    marks = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", survivor.CUT_MARKS.replace("'", "''"))
    mine, whole = _SQUEEZE.format("question_text"), _SQUEEZE.format("longest")
    broken = rf"coalesce(regexp_matches(lower({bare}), '{marks}') OR (NOT regexp_matches({bare}, '[.?!:।)\]]$') AND (regexp_matches({bare}, '[.?!:;]\s') OR (length({mine}) < length({whole}) AND starts_with({whole}, {mine})))), false)"
    held = f"CASE WHEN {_present('question_text')} THEN question_text END"
    fields = "\nUNION ALL ".join(f"SELECT canonical_question_id, '{f}' AS field_name, row_id, source_weight, collected_at FROM r WHERE {_present(f)}" + (f" AND NOT {broken}" if f == "question_text" else "") for f in survivor.FIELDS)
    return f"""WITH g AS (SELECT canonical_question_id AS gid, arg_max({held}, length({_SQUEEZE.format(f"({held})")})) FILTER (WHERE {_present('question_text')}) AS longest FROM questions_dedupe WHERE canonical_question_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT q.*, g.longest FROM questions_dedupe q JOIN g ON q.canonical_question_id = g.gid),
c AS ({fields})
SELECT canonical_question_id, field_name, row_id FROM c QUALIFY row_number() OVER (PARTITION BY canonical_question_id, field_name ORDER BY source_weight DESC NULLS LAST, collected_at DESC NULLS LAST, row_id) = 1"""


def _p6_sql() -> str:
    tidy = r"trim(regexp_replace(lower({0}), '[\s _-]+', ' ', 'g'))"
    return f"""WITH a AS (SELECT 'question_pattern' AS field_name, row_number() OVER () AS r, [{tidy.format('question_pattern')}] AS t, coalesce(question_count, 0) AS w FROM pattern_by_topic),
b AS (SELECT 'micro_concept' AS field_name, row_number() OVER () AS r, list_transform(string_split_regex(micro_concept, '[;|]'), lambda x: {tidy.format('x')}) AS t, 1 AS w FROM questions_dedupe),
n AS (SELECT field_name, count(*) AS total FROM (SELECT field_name FROM a UNION ALL SELECT field_name FROM b) GROUP BY 1),
e AS (SELECT field_name, r, w, unnest(t) AS term FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
f AS (SELECT field_name, term, CAST(sum(w) AS BIGINT) AS occurrences, CAST(count(DISTINCT r) AS BIGINT) AS records FROM e WHERE term <> '' GROUP BY 1, 2)
SELECT field_name, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > total * CAST(0.05 AS DOUBLE) THEN 'common' END AS mark FROM f JOIN n USING (field_name)"""


def oracle_sql() -> dict[str, str]:
    year = r"try_cast(regexp_replace(year, '[\s ]+', '', 'g') AS DOUBLE)"
    return {
        "p2_found": f"WITH k AS ({_KEYED}), g AS (SELECT t, o, min(row_id) AS m FROM k WHERE t <> '' OR len(o) > 0 GROUP BY t, o) SELECT g.m AS row_id_1, k.row_id AS row_id_2 FROM k JOIN g ON k.t = g.t AND k.o = g.o WHERE k.row_id <> g.m",
        "p2_records": f"""WITH k AS ({_KEYED}), w AS (SELECT t, o, min(row_id) AS row_id, count(*) AS copies, count(DISTINCT ROW(question_text, option_a, option_b, option_c, option_d)) AS raw_forms FROM k WHERE t <> '' OR len(o) > 0 GROUP BY t, o)
SELECT w.row_id, k.question_text, k.option_a, k.option_b, k.option_c, k.option_d, w.copies, w.raw_forms FROM w JOIN k ON k.row_id = w.row_id""",
        "p3_found": rf"""WITH k AS (SELECT row_id, t, o, {year} AS y, list_distinct(regexp_extract_all(lower(concat_ws(' ', question_text, option_a, option_b, option_c, option_d)), '[\p{{L}}\p{{N}}]+')) AS w FROM ({_KEYED})),
s AS (SELECT *, len(w) AS n FROM k WHERE len(w) > 0)
SELECT a.row_id AS row_id_1, b.row_id AS row_id_2 FROM s a JOIN s b ON a.row_id < b.row_id
WHERE (a.y = b.y OR a.y IS NULL OR b.y IS NULL) AND (a.t <> b.t OR a.o <> b.o) AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 7
AND len(list_intersect(a.w, b.w)) * 10 >= (a.n + b.n - len(list_intersect(a.w, b.w))) * 7""",
        "p5_found": _p5_sql(),
        "p6_frequencies": _p6_sql(),
        "p6_found": f"SELECT field_name, term, mark FROM ({_p6_sql()}) WHERE mark IS NOT NULL",
        "p7_found": """WITH RECURSIVE h AS (SELECT DISTINCT exact_question_hash AS h, canonical_question_id AS id FROM questions_dedupe WHERE exact_question_hash <> '' AND canonical_question_id IS NOT NULL),
e AS (SELECT left_id AS a, right_id AS b FROM match_pairs WHERE is_match AND left_id <> right_id UNION SELECT right_id, left_id FROM match_pairs WHERE is_match AND left_id <> right_id
UNION SELECT x.id, y.id FROM h x JOIN h y ON x.h = y.h WHERE x.id <> y.id),
c AS (SELECT a AS v, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.v)
SELECT v AS canonical_question_id, min(r) AS group_id FROM c GROUP BY v""",
    }
