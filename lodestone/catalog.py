"""The core's queries over whole tables, and for each that SQL can express its SQL in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import text as X
from lodestone.operators import aggregates as A
from lodestone.operators import phrases
from lodestone.operators import relational as R
from lodestone.plans import classify, dedupe, intent, practice, priority, review
from lodestone.runtime import cut, table
from lodestone.sources import documents, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STATUS_WEIGHT = {"F": 1.0, "O": 0.65, "P": 0.35}
AGE_WEIGHT = {"0": 1.0, "1": 0.8, "2": 0.6, "3": 0.45}
NEWEST = 2001
YEARS = tuple(str(y) for y in range(1995, 2002))
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
KINDS = ("case-based", "direct", "match-the-following", "statement-based", "Unknown")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- Topic facts --------------------------------------------------------------------------------------------------


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Line items as question occurrences: chapter, subtopic, year, shift, pattern, weights, difficulty, hard."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    w = rules.lookup(F.col("o_orderstatus"), STATUS_WEIGHT, 0.35)
    age = rules.lookup((F.lit(NEWEST) - F.col("year")).cast("string"), AGE_WEIGHT, 0.35)
    return j.select(
        F.col("p_type").alias("chapter"), F.col("p_brand").alias("subtopic"), "year", F.col("o_orderpriority").alias("shift"), F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("pattern"),
        w.alias("weight"), (w * age).alias("recency"), F.when(F.col("p_size") <= 25, 1.0).otherwise(0.65).alias("direct"), F.when(F.col("p_size") <= 16, "easy").when(F.col("p_size") <= 33, "medium").otherwise("hard").alias("difficulty"),
        (F.col("l_returnflag") == "R").alias("hard"), "l_quantity", "l_orderkey", "l_linenumber",
    )


KEYS = ["chapter", "subtopic"]


def topics(spark: SparkSession, d: str) -> DataFrame:
    return topics_of(facts(spark, d))


def topics_of(f: DataFrame) -> DataFrame:
    per = priority.parts(f, KEYS, F.col("weight"), F.col("recency"), F.col("year"), F.col("shift"), F.col("pattern"), F.col("direct"))
    caps = per.agg(F.max("source_weighted_frequency").alias("cs"), F.max("recency_score").alias("cr"), F.max("pattern_count").cast("double").alias("cp"))
    capped = per.crossJoin(F.broadcast(caps))  # one row
    scored = priority.scores(capped, {"frequency": F.col("cs"), "recency": F.col("cr"), "years": 7.0, "shifts": 5.0, "patterns": F.col("cp"), "directness": 1.0, "confusion": 10.0})
    return priority.ranked(scored.drop("cs", "cr", "cp"))


def topics_with_effort(spark: SparkSession, d: str) -> DataFrame:
    """Topics with their commonest difficulty; the facts are joined once and counted per topic and difficulty on the way."""
    f = cut(facts(spark, d).drop("l_quantity", "l_orderkey", "l_linenumber"))
    t = topics_of(f).join(A.dominant(f, KEYS, "difficulty"), KEYS)
    return priority.effort(t, F.col("difficulty"), F.col("pattern_count").cast("int"))


_F = """f AS (SELECT p_type AS chapter, p_brand AS subtopic, year(o_orderdate) AS year, o_orderpriority AS shift, l_returnflag || '/' || l_linestatus AS pattern,
CASE o_orderstatus WHEN 'F' THEN CAST(1.0 AS DOUBLE) WHEN 'O' THEN CAST(0.65 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END AS weight,
CASE 2001 - year(o_orderdate) WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(0.8 AS DOUBLE) WHEN 2 THEN CAST(0.6 AS DOUBLE) WHEN 3 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END AS age,
CASE WHEN p_size <= 25 THEN 1.0 ELSE 0.65 END AS direct, CASE WHEN p_size <= 16 THEN 'easy' WHEN p_size <= 33 THEN 'medium' ELSE 'hard' END AS difficulty, l_returnflag = 'R' AS hard, l_quantity, l_orderkey, l_linenumber
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
_T = (
    _F
    + """, p AS (SELECT chapter, subtopic, count(*) AS question_count, CAST(round(sum(CAST(weight AS DECIMAL(18,6))), 4) AS DOUBLE) AS source_weighted_frequency, CAST(round(sum(CAST(weight * age AS DECIMAL(18,6))), 4) AS DOUBLE) AS recency_score,
count(DISTINCT year) AS year_count, count(DISTINCT shift) AS shift_count, count(DISTINCT pattern) AS pattern_count, round(CAST(sum(CAST(direct AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS directness, CAST(0 AS DOUBLE) AS confusion FROM f GROUP BY 1, 2),
c AS (SELECT max(source_weighted_frequency) AS cs, max(recency_score) AS cr, CAST(max(pattern_count) AS DOUBLE) AS cp FROM p),
s AS (SELECT p.*, round(0.3e0 * least(source_weighted_frequency / cs, 1e0) + 0.25e0 * least(recency_score / cr, 1e0) + 0.15e0 * least(year_count / 7e0, 1e0) + 0.1e0 * least(shift_count / 5e0, 1e0) + 0.1e0 * least(pattern_count / cp, 1e0) + 0.05e0 * least(directness, 1e0), 4) AS raw_score FROM p, c),
t AS (SELECT *, round(cume_dist() OVER (ORDER BY raw_score), 4) AS percentile_rank FROM s),
topic AS (SELECT *, CASE WHEN percentile_rank >= 0.85e0 THEN 'Tier 1 = Must do' WHEN percentile_rank >= 0.65e0 THEN 'Tier 2 = High ROI' WHEN percentile_rank >= 0.35e0 THEN 'Tier 3 = Medium priority' ELSE 'Tier 4 = Low priority' END AS priority_tier FROM t)"""
)
_E = (
    _T
    + """, dn AS (SELECT chapter, subtopic, difficulty, count(*) AS n FROM f GROUP BY 1, 2, 3), dd AS (SELECT chapter, subtopic, difficulty FROM dn QUALIFY row_number() OVER (PARTITION BY chapter, subtopic ORDER BY n DESC, difficulty) = 1),
h AS (SELECT topic.*, difficulty, round(CASE difficulty WHEN 'easy' THEN 0.75e0 WHEN 'medium' THEN 1.25e0 WHEN 'hard' THEN 1.75e0 ELSE 1.25e0 END + 0.2e0 * least(pattern_count, 5), 2) AS study_hours_required, round(raw_score * 100, 2) AS expected_marks_contribution FROM topic JOIN dd USING (chapter, subtopic)),
e AS (SELECT *, round(expected_marks_contribution / greatest(study_hours_required, 0.5e0), 2) AS roi FROM h)"""
)


@query("topic_priority", f"WITH {_T} SELECT * FROM topic")
def _(spark, d):
    return topics(spark, d)


@query("topic_frequency", f"WITH {_F} SELECT chapter, subtopic, count(*) AS question_count, count(DISTINCT year) AS years_seen FROM f GROUP BY 1, 2")
def _(spark, d):
    return facts(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("question_count"), F.count_distinct("year").alias("years_seen"))


@query("chapter_year_pivot", f"WITH {_F} SELECT chapter, " + ", ".join(f"count(*) FILTER (WHERE year = {y}) AS \"{y}\"" for y in YEARS) + f", count(*) FILTER (WHERE year NOT IN ({', '.join(YEARS)})) AS other FROM f GROUP BY 1")
def _(spark, d):
    return A.pivot_counts(facts(spark, d), "chapter", "year", YEARS)


_CORR = f"""{_F}, n AS (SELECT chapter, year, CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY 1, 2), g AS (SELECT c.chapter, y.year, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT chapter FROM n) c CROSS JOIN (SELECT DISTINCT year FROM n) y LEFT JOIN n USING (chapter, year)),
r AS (SELECT a.chapter AS item_a, b.chapter AS item_b, round(CASE WHEN isnan(corr(a.n, b.n)) THEN 0 ELSE coalesce(corr(a.n, b.n), 0) END, 6) AS r FROM g a JOIN g b USING (year) GROUP BY 1, 2)"""


@query("chapter_correlation", f"WITH {_CORR} SELECT * FROM r")
def _(spark, d):
    return A.correlation(facts(spark, d), "chapter", "year")


@query("correlation_edges", f"WITH {_CORR} SELECT item_a AS source, item_b AS target, r FROM r WHERE item_a < item_b AND r >= 0.35")
def _(spark, d):
    return A.correlation_graph(A.correlation(facts(spark, d), "chapter", "year"))[1]


@query("correlation_nodes", f"WITH {_F}, n AS (SELECT DISTINCT chapter AS node FROM f), i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS n FROM n) SELECT node, round(cos(2 * pi() * i / n), 6) AS x, round(sin(2 * pi() * i / n), 6) AS y FROM i")
def _(spark, d):
    return A.correlation_graph(A.correlation(facts(spark, d), "chapter", "year"))[0]


@query("legacy_priority", f"""WITH {_F}, m AS (SELECT max(year) AS newest, count(*) AS total FROM f), g AS (SELECT chapter, subtopic, count(*) AS question_count, CAST(sum(greatest(year - newest + 1, 0) + 1) AS BIGINT) AS recency, avg(CASE WHEN hard THEN 1e0 ELSE 0e0 END) AS hard, max(total) AS total FROM f, m GROUP BY 1, 2)
SELECT chapter, subtopic, question_count, recency, round((question_count + 0.7e0 * recency) * (1 + 0.15e0 * hard), 6) AS priority_score, round(question_count / total, 8) AS probability FROM g""")
def _(spark, d):
    return priority.legacy(facts(spark, d), KEYS, "year", F.col("hard"))


@query("high_roi", f"WITH {_E}, q AS (SELECT round(quantile_cont(roi, 0.65), 6) AS a, round(quantile_cont(expected_marks_contribution, 0.5), 6) AS b FROM e) SELECT chapter, subtopic, difficulty, study_hours_required, expected_marks_contribution, roi FROM e, q WHERE round(roi, 6) >= a AND round(expected_marks_contribution, 6) >= b")
def _(spark, d):
    return priority.high_roi(topics_with_effort(spark, d)).select(*KEYS, "difficulty", "study_hours_required", "expected_marks_contribution", "roi")


@query("study_plan", f"""WITH RECURSIVE {_E}, o AS (SELECT *, row_number() OVER (ORDER BY roi DESC, expected_marks_contribution DESC, chapter, subtopic) AS i FROM e),
r AS (SELECT plan_days, 0 AS seq, CAST(1 AS BIGINT) AS i, 1 AS day, 4e0 AS lft, o.study_hours_required AS need, 0 AS d, 0e0 AS hours, CAST(0 AS BIGINT) AS t FROM (VALUES (3), (5), (7), (14)) v(plan_days) JOIN o ON o.i = 1
UNION ALL SELECT s.plan_days, s.seq + 1, s.ni, CASE WHEN s.rest <= 0.05e0 THEN s.day + 1 ELSE s.day END, CASE WHEN s.rest <= 0.05e0 THEN 4e0 ELSE s.rest END, CASE WHEN s.ni = s.i THEN s.still ELSE n.study_hours_required END, s.day, s.give, s.i
FROM (SELECT *, round(least(lft, need), 2) AS give, round(lft - round(least(lft, need), 2), 2) AS rest, round(need - round(least(lft, need), 2), 2) AS still, CASE WHEN round(need - round(least(lft, need), 2), 2) <= 0.05e0 THEN i + 1 ELSE i END AS ni FROM r WHERE day <= plan_days AND need > 0.05e0) s LEFT JOIN o n ON n.i = s.ni)
SELECT plan_days, seq, d AS day, hours AS allocated_hours, chapter, subtopic FROM r JOIN o ON o.i = r.t""")
def _(spark, d):
    order = [(-F.col("roi")), (-F.col("expected_marks_contribution")), F.col("chapter"), F.col("subtopic")]
    return priority.study_plan(topics_with_effort(spark, d), order=order)


@query("tier_distribution", f"WITH {_T} SELECT priority_tier, count(*) AS topics FROM topic GROUP BY 1")
def _(spark, d):
    return intent.answer("tier distribution", topics(spark, d), facts(spark, d), list(PART_TYPES))[1]


@query("two_chapter_compare", f"WITH {_T} SELECT chapter, round(sum(source_weighted_frequency), 4) AS weighted_frequency, CAST(sum(question_count) AS BIGINT) AS question_count FROM topic WHERE chapter IN ('SMALL', 'LARGE') GROUP BY 1")
def _(spark, d):
    return intent.answer("compare SMALL with LARGE", topics(spark, d), facts(spark, d), list(PART_TYPES))[1]


@query("top_topics", f"WITH {_T} SELECT chapter, subtopic, raw_score, priority_tier FROM topic ORDER BY raw_score DESC, chapter, subtopic LIMIT 10")
def _(spark, d):
    return intent.answer("top topics", topics(spark, d), facts(spark, d), list(PART_TYPES))[1]


@query("chapter_frequency", f"WITH {_T} SELECT chapter, CAST(sum(question_count) AS BIGINT) AS question_count, round(sum(source_weighted_frequency), 4) AS weighted_frequency FROM topic GROUP BY 1")
def _(spark, d):
    return intent.answer("how often is each chapter asked", topics(spark, d), facts(spark, d), list(PART_TYPES))[1]


@query("year_trend", f"WITH {_F} SELECT year, count(*) AS question_count FROM f GROUP BY 1")
def _(spark, d):
    return intent.answer("trend by year", topics(spark, d), facts(spark, d), list(PART_TYPES))[1]


@query("chapter_year_counts", f"WITH {_F} SELECT chapter, year, count(*) AS question_count FROM f GROUP BY 1, 2")
def _(spark, d):
    return intent.answer("heatmap", topics(spark, d), facts(spark, d), list(PART_TYPES))[1]


@query("chapter_subtopic_heatmap", f"WITH {_F} SELECT subtopic, " + ", ".join(f"round(coalesce(sum(l_quantity) FILTER (WHERE chapter = '{t}'), 0), 4) AS \"{t}\"" for t in PART_TYPES) + f", round(coalesce(sum(l_quantity) FILTER (WHERE chapter NOT IN {PART_TYPES}), 0), 4) AS other FROM f GROUP BY 1")
def _(spark, d):
    return A.pivot_sums(facts(spark, d), "subtopic", "chapter", PART_TYPES, "l_quantity")


def _top_of(column: str, name: str) -> str:
    return f"SELECT chapter, subtopic, {column} AS {name} FROM (SELECT chapter, subtopic, {column}, count(*) AS n FROM f GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY chapter, subtopic ORDER BY n DESC, {column}) = 1"


@query("format_strategy", f"""WITH {_T}, hi AS (SELECT chapter, subtopic, priority_tier FROM topic WHERE priority_tier LIKE 'Tier 1%' OR priority_tier LIKE 'Tier 2%'), dp AS ({_top_of('pattern', 'dominant_pattern')}), dh AS ({_top_of('shift', 'dominant_heading')}),
rq AS (SELECT chapter, subtopic, string_agg(t, ' || ' ORDER BY n) AS representative_questions FROM (SELECT chapter, subtopic, concat_ws('-', l_orderkey, l_linenumber) AS t, row_number() OVER (PARTITION BY chapter, subtopic ORDER BY weight DESC, l_orderkey, l_linenumber) AS n FROM f) WHERE n <= 5 GROUP BY 1, 2)
SELECT * FROM hi LEFT JOIN dp USING (chapter, subtopic) LEFT JOIN dh USING (chapter, subtopic) LEFT JOIN rq USING (chapter, subtopic)""")
def _(spark, d):
    f = cut(facts(spark, d).withColumn("text", F.concat_ws("-", "l_orderkey", "l_linenumber")))
    high = topics_of(f).where(F.col("priority_tier").startswith("Tier 1") | F.col("priority_tier").startswith("Tier 2")).select(*KEYS, "priority_tier")
    return review.format_strategy(f, high, "pattern", "shift", F.col("text"), [F.desc("weight"), F.col("l_orderkey"), F.col("l_linenumber")])


@query("representative_questions", f"WITH {_F}, r AS (SELECT chapter, subtopic, concat_ws('-', l_orderkey, l_linenumber) AS t, row_number() OVER (PARTITION BY chapter, subtopic ORDER BY weight DESC, l_orderkey, l_linenumber) AS n FROM f) SELECT chapter, subtopic, string_agg(t, ' || ' ORDER BY n) AS representative_questions FROM r WHERE n <= 5 GROUP BY 1, 2")
def _(spark, d):
    f = facts(spark, d)
    return A.top_per_group(f, KEYS, [F.desc("weight"), F.col("l_orderkey"), F.col("l_linenumber")], F.concat_ws("-", "l_orderkey", "l_linenumber"), 5, "representative_questions")


@query("top_chapters", f"WITH {_F} SELECT chapter, count(*) AS rows, round(sum(weight), 4) AS weight FROM f GROUP BY 1")
def _(spark, d):
    return A.weighted(facts(spark, d), "chapter", "weight")


# --- Question rows ------------------------------------------------------------------------------------------------

_BLANK = "(trim(coalesce({0}, '')) = '')"
_YEAR = r"regexp_replace(trim(coalesce(year, '')), '\.0$', '')"


@query("low_frequency", f"""WITH g AS (SELECT chapter, subtopic, count(*) AS question_count, max(try_cast({_YEAR} AS DOUBLE)) AS last_seen_year FROM questions WHERE NOT {_BLANK.format('chapter')} GROUP BY 1, 2),
n AS (SELECT chapter, subtopic, lower(difficulty_estimate) AS difficulty, count(*) AS n FROM questions WHERE NOT {_BLANK.format('chapter')} AND NOT {_BLANK.format('difficulty_estimate')} GROUP BY 1, 2, 3), dd AS (SELECT chapter, subtopic, difficulty FROM n QUALIFY row_number() OVER (PARTITION BY chapter, subtopic ORDER BY n DESC, difficulty) = 1)
SELECT chapter, subtopic, question_count, last_seen_year, difficulty, CASE WHEN difficulty = 'easy' THEN 'quick summary revision' WHEN last_seen_year >= 2025 THEN 'revise after high-priority topics' ELSE 'read once the day before' END AS study_action FROM g LEFT JOIN dd USING (chapter, subtopic) WHERE question_count <= 30""")
def _(spark, d):
    q = table(spark, d, "questions").where(~R.blank(F.col("chapter"))).withColumn("difficulty", F.lower("difficulty_estimate"))
    per = q.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("question_count"), F.max(rules.year_text(F.col("year")).try_cast("double")).alias("last_seen_year"))
    return priority.low_frequency(per.join(A.dominant(q, KEYS, "difficulty"), KEYS, "left"), 30, "last_seen_year", 2025, F.col("difficulty")).select(*KEYS, "question_count", "last_seen_year", "difficulty", "study_action")


@query("repeated_groups", f"""SELECT repeated_concept_cluster, count(*) AS question_count, coalesce(string_agg(DISTINCT y, ', ' ORDER BY y), '') AS years_seen, count(DISTINCT y) AS year_count, coalesce(string_agg(DISTINCT nullif(trim(chapter), ''), ', ' ORDER BY nullif(trim(chapter), '')), '') AS chapters, arg_min(substring(question_text, 1, 500), row_id) FILTER (WHERE question_text IS NOT NULL) AS example_question
FROM (SELECT *, nullif({_YEAR}, '') AS y FROM questions WHERE NOT {_BLANK.format('repeated_concept_cluster')}) GROUP BY 1""")
def _(spark, d):
    q = table(spark, d, "questions").where(~R.blank(F.col("repeated_concept_cluster"))).withColumn("y", F.nullif(rules.year_text(F.col("year")), F.lit("")))
    first = F.min_by(F.substring("question_text", 1, 500), F.when(F.col("question_text").isNotNull(), F.col("row_id")))
    return q.groupBy("repeated_concept_cluster").agg(F.count(F.lit(1)).alias("question_count"), A.joined_set("y").alias("years_seen"), F.count_distinct("y").alias("year_count"), A.joined_set("chapter").alias("chapters"), first.alias("example_question"))


@query("type_by_chapter", f"SELECT CASE WHEN {_BLANK.format('chapter')} THEN 'Unknown' ELSE chapter END AS chapter, " + ", ".join(f"count(*) FILTER (WHERE CASE WHEN {_BLANK.format('question_type')} THEN 'Unknown' ELSE question_type END = '{k}') AS \"{k}\"" for k in KINDS) + f", count(*) FILTER (WHERE CASE WHEN {_BLANK.format('question_type')} THEN 'Unknown' ELSE question_type END NOT IN {KINDS}) AS other FROM questions GROUP BY 1")
def _(spark, d):
    return A.pivot_counts(table(spark, d, "questions"), "chapter", "question_type", KINDS)


@query("dominant_value", f"WITH n AS (SELECT chapter, question_type, count(*) AS n FROM questions WHERE NOT {_BLANK.format('question_type')} GROUP BY 1, 2) SELECT chapter, question_type AS dominant_type FROM n QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY n DESC, question_type) = 1")
def _(spark, d):
    return A.dominant(table(spark, d, "questions"), ["chapter"], "question_type", "dominant_type")


@query("source_reliability", "SELECT source, count(*) AS rows, round(sum(coalesce(try_cast(confidence_score AS DOUBLE), 0)), 4) AS total_weight, round(avg(try_cast(confidence_score AS DOUBLE)), 4) AS mean_confidence FROM questions GROUP BY 1")
def _(spark, d):
    return A.reliability(table(spark, d, "questions"), ["source"], "confidence_score", "confidence_score")


@query("weighted_table", f"SELECT CASE WHEN {_BLANK.format('difficulty_estimate')} THEN 'Unknown' ELSE difficulty_estimate END AS difficulty_estimate, count(*) AS rows, round(sum(coalesce(source_weight, 1)), 4) AS weight FROM questions_dedupe GROUP BY 1")
def _(spark, d):
    return A.weighted(table(spark, d, "questions_dedupe"), "difficulty_estimate", "source_weight")


@query("source_breakdown", "SELECT source_tier, count(*) AS rows, count(DISTINCT coalesce(canonical_question_id, question_id, question_text)) AS questions, round(sum(coalesce(source_weight, 0)), 4) AS weight FROM questions_dedupe GROUP BY 1")
def _(spark, d):
    q = table(spark, d, "questions_dedupe")
    return q.groupBy("source_tier").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.coalesce("canonical_question_id", "question_id", "question_text")).alias("questions"), F.round(F.sum(F.coalesce("source_weight", F.lit(0.0))), 4).alias("weight"))


@query("quality_metrics", f"""WITH m AS (SELECT count(*) AS t, count(DISTINCT canonical_question_id) AS u, count(*) FILTER (WHERE coalesce(source_weight, 0) < 0.75) AS l, count(*) FILTER (WHERE {_BLANK.format('question_text')}) AS r FROM questions_dedupe)
SELECT 'total_raw_rows' AS metric, CAST(t AS DOUBLE) AS value FROM m UNION ALL SELECT 'unique_canonical_questions', u FROM m UNION ALL SELECT 'duplicate_rate_percent', round((t - u) * 100e0 / t, 2) FROM m UNION ALL SELECT 'low_confidence_classifications_lt_075', l FROM m UNION ALL SELECT 'needs_review', r FROM m
UNION ALL SELECT 'source_tier_' || source_tier, count(*) FROM questions_dedupe WHERE NOT {_BLANK.format('source_tier')} GROUP BY source_tier""")
def _(spark, d):
    return dedupe.quality(table(spark, d, "questions_dedupe"), "canonical_question_id", "source_tier", F.col("source_weight"), R.blank(F.col("question_text")))


@query("split_values", f"SELECT t AS micro_concept, count(*) AS count FROM (SELECT unnest(string_split_regex(micro_concept, '[;|]')) AS t FROM questions_dedupe) WHERE NOT {_BLANK.format('t')} GROUP BY 1")
def _(spark, d):
    return A.split_counts(table(spark, d, "questions_dedupe"), "micro_concept", "[;|]", "micro_concept")


@query("facet_search", "SELECT row_id, chapter, year FROM questions WHERE chapter IN ('Guiding People', 'Planning Ahead') AND contains(lower(concat_ws(' ', coalesce(question_text, ''), coalesce(option_a, ''))), 'style')")
def _(spark, d):
    q = R.facets(table(spark, d, "questions"), {"chapter": ["Guiding People", "Planning Ahead"], "year": []})
    return R.search(q, "style", ["question_text", "option_a"]).select("row_id", "chapter", "year")


@query("text_normalize", r"SELECT row_id, regexp_replace(regexp_replace(regexp_replace(translate(question_text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS clean, trim(regexp_replace(regexp_replace(lower(question_text), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS match_text FROM questions")
def _(spark, d):
    return table(spark, d, "questions").select("row_id", X.normalize_text(F.col("question_text")).alias("clean"), X.normalize_for_match(F.col("question_text")).alias("match_text"))


_ID = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(concat_ws(' ', coalesce(question_text, ''), coalesce(option_a, ''), coalesce(option_b, ''), coalesce(option_c, ''), coalesce(option_d, '')))), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\b(?:option|answer|correct|business|studies)\b', ' ', 'g'), ' +', ' ', 'g'))"


@query("identity_hash", f"SELECT row_id, substring(sha256({_ID}), 1, 24) AS question_hash FROM questions")
def _(spark, d):
    q = table(spark, d, "questions")
    return q.select("row_id", X.stable_hash(dedupe.identity(q), 24).alias("question_hash"))


@query("doc_ids", "SELECT doc_id, 'cs_' || substring(sha1(coalesce(text, '')), 1, 16) AS cs_id, 'mock_' || substring(sha1(coalesce(text, '')), 1, 12) AS mock_id FROM documents")
def _(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", X.prefixed_id("cs_", t, 16).alias("cs_id"), X.prefixed_id("mock_", t, 12).alias("mock_id"))


def _case(column: str, table_: tuple, otherwise: str, before: dict[str, str] | None = None) -> str:
    """A rule table as SQL: positions of terms, so that no pattern language is shared with the Spark side."""
    whens = []
    for label, groups in table_:
        test = " AND ".join("(" + " OR ".join("contains(lower(coalesce({0}, '')), '{1}')".format(column, t.replace("'", "''")) for t in g) + ")" for g in groups)
        if before and label in before:
            test = f"({test} OR {before[label]})"
        whens.append(f"WHEN {test} THEN '{label}'")
    return f"CASE {' '.join(whens)} ELSE {otherwise} END"


_Q = "coalesce(question_text, '')"
_TYPE = _case("question_text", rules.QUESTION_TYPES, "'direct'", {"case-based": f"length({_Q}) > 1100"})


@query("question_type_rules", f"SELECT row_id, {_TYPE} AS kind FROM questions")
def _(spark, d):
    return table(spark, d, "questions").select("row_id", rules.question_type(F.col("question_text")).alias("kind"))


@query("pattern_rules", f"SELECT row_id, {_case('question_text', rules.PATTERNS, repr(rules.PATTERN_ELSE))} AS question_pattern FROM questions")
def _(spark, d):
    return table(spark, d, "questions").select("row_id", rules.question_pattern(F.col("question_text")).alias("question_pattern"))


_CTYPE = _case("text", rules.CONCEPT_TYPES, "CASE WHEN length(coalesce(text, '')) > 500 THEN 'case-application' ELSE 'definition' END")


@query("concept_type", f"SELECT doc_id, {_CTYPE} AS concept_type FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.concept_type(F.col("text")).alias("concept_type"))


@query("difficulty_rules", f"""WITH k AS (SELECT row_id, lower({_Q}) AS t, {_TYPE} AS kind FROM questions), s AS (SELECT row_id, CASE WHEN kind IN ('case-based', 'assertion-reason', 'match-the-following') THEN 2 WHEN kind IN ('statement-based', 'chronology') THEN 1 ELSE 0 END + CASE WHEN length(t) > 900 THEN 1 ELSE 0 END
+ CASE WHEN regexp_matches(t, '\\b(?:not|incorrect|except|false)\\b') THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(t, '\\b[ivx]+\\b')) >= 3 THEN 1 ELSE 0 END AS s FROM k) SELECT row_id, CASE WHEN s >= 4 THEN 'hard' WHEN s >= 2 THEN 'medium' ELSE 'easy' END AS difficulty FROM s""")
def _(spark, d):
    t = F.col("question_text")
    return table(spark, d, "questions").select("row_id", rules.difficulty(t, rules.question_type(t)).alias("difficulty"))


_TIER = _case("concat(coalesce(source, ''), ' ', coalesce(source_url, ''))", rules.SOURCE_TIERS, "CASE WHEN starts_with(lower(concat(coalesce(source, ''), ' ', coalesce(source_url, ''))), 'manual') OR contains(lower(concat(coalesce(source, ''), ' ', coalesce(source_url, ''))), 'manual://') THEN 'manual_import' ELSE 'unknown' END")


@query("source_tier", f"WITH t AS (SELECT row_id, {_TIER} AS tier, {_YEAR} AS y FROM questions) SELECT row_id, tier, CASE tier " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in rules.SOURCE_WEIGHTS.items()) + " ELSE 0.35e0 END AS weight, CASE y " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in rules.YEAR_WEIGHTS.items()) + " ELSE 0.35e0 END AS year_weight FROM t")
def _(spark, d):
    q = table(spark, d, "questions").withColumn("tier", rules.source_tier(F.col("source"), F.col("source_url")))
    return q.select("row_id", "tier", rules.source_weight(F.col("tier")).alias("weight"), rules.year_weight(F.col("year")).alias("year_weight"))


_MICRO = ", ".join(f"({i}, '{label}', '{w}')" for i, (label, words) in enumerate(rules.MICRO_CONCEPTS) for w in words)


@query("micro_concept", f"""WITH m(i, label, kw) AS (VALUES {_MICRO}), q AS (SELECT row_id, lower(concat_ws(' ', coalesce(chapter, ''), coalesce(subtopic, ''), {_Q})) AS t, CASE WHEN NOT {_BLANK.format('subtopic')} THEN subtopic END AS sub FROM questions),
h AS (SELECT row_id, i, label, count(*) AS hits FROM q JOIN m ON contains(t, kw) GROUP BY 1, 2, 3), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY hits DESC, i) = 1),
w AS (SELECT row_id, unnest(regexp_extract_all(t, '[a-z]{{5,}}')) AS w, generate_subscripts(regexp_extract_all(t, '[a-z]{{5,}}'), 1) AS p FROM q), k AS (SELECT row_id, w, count(*) AS n, min(p) AS p FROM w WHERE w NOT IN ({', '.join(repr(s) for s in rules.STOPWORDS)}) GROUP BY 1, 2), c AS (SELECT row_id, w FROM k QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, p) = 1)
SELECT q.row_id, coalesce(b.label, q.sub, c.w, 'unclassified') AS label, round(CASE WHEN b.hits > 0 THEN least(0.98e0, 0.62e0 + b.hits * 0.18e0) WHEN c.w IS NOT NULL THEN 0.45e0 ELSE 0.35e0 END, 2) AS confidence FROM q LEFT JOIN b USING (row_id) LEFT JOIN c USING (row_id)""")
def _(spark, d):
    return table(spark, d, "questions").select("row_id", rules.micro_concept(F.col("question_text"), F.col("chapter"), F.col("subtopic")).alias("m")).select("row_id", "m.label", "m.confidence")


@query("cluster_label", f"""WITH q AS (SELECT row_id, chapter, subtopic, list_filter(regexp_extract_all(lower({_Q}), '[a-z]{{5,}}'), lambda x: x NOT IN ({', '.join(repr(s) for s in rules.STOPWORDS)})) AS t FROM questions)
SELECT row_id, CASE WHEN coalesce(chapter, '') <> '' AND coalesce(subtopic, '') <> '' THEN chapter || ' :: ' || subtopic WHEN len(t) > 0 THEN 'keyword :: ' || array_to_string(t[1:4], ' ') ELSE 'unclassified' END AS cluster FROM q""")
def _(spark, d):
    return table(spark, d, "questions").select("row_id", rules.cluster_label(F.col("chapter"), F.col("subtopic"), F.col("question_text")).alias("cluster"))


@query("year_shift_extract", r"SELECT row_id, regexp_extract(concat_ws(' ', source, year, shift), '\b(20(?:2[2-6]|19))\b', 1) AS year, regexp_extract(concat_ws(' ', source, year, shift), '(?i)\bshift\s*[-:]?\s*([a-z0-9]+)', 1) AS shift FROM questions")
def _(spark, d):
    meta = F.concat_ws(" ", "source", "year", "shift")
    return table(spark, d, "questions").select("row_id", X.infer_year(meta).alias("year"), X.infer_shift(meta).alias("shift"))


@query("url_parts", r"SELECT row_id, lower(regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, CASE WHEN regexp_extract(lower(raw_file_path), '(\.[a-z0-9]{1,5})$', 1) IN ('.pdf', '.html', '.htm', '.txt', '.csv', '.json') THEN regexp_extract(lower(raw_file_path), '(\.[a-z0-9]{1,5})$', 1) ELSE '.bin' END AS suffix FROM questions")
def _(spark, d):
    return table(spark, d, "questions").select("row_id", X.url_host(F.col("source_url")).alias("host"), X.url_suffix(F.col("raw_file_path")).alias("suffix"))


@query("normalize_option", r"SELECT row_id, coalesce(array_to_string(list_transform(regexp_extract_all(upper(trim(correct_option)), '[A-D1-4]'), lambda x: translate(x, '1234', 'ABCD')), ','), CASE WHEN correct_option IS NOT NULL THEN '' END) AS answer FROM questions")
def _(spark, d):
    return table(spark, d, "questions").select("row_id", X.normalize_option(F.col("correct_option")).alias("answer"))


# --- Canonicalisation ---------------------------------------------------------------------------------------------


@query("exact_dedupe", f"SELECT sha256({_ID}) AS identity, count(*) AS copies, min(row_id) AS first_row FROM questions GROUP BY 1")
def _(spark, d):
    q = table(spark, d, "questions")
    return q.groupBy(F.sha2(dedupe.identity(q), 256).alias("identity")).agg(F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("first_row"))


@query("canonical_pick", "SELECT canonical_question_id, row_id, count(*) OVER w AS duplicate_group_size, max(source_weight) OVER w AS max_source_weight FROM questions_dedupe WINDOW w AS (PARTITION BY canonical_question_id) QUALIFY row_number() OVER (PARTITION BY canonical_question_id ORDER BY coalesce(source_weight, -1) DESC, length(coalesce(question_text, '')) DESC, row_id) = 1")
def _(spark, d):
    q = table(spark, d, "questions_dedupe").select("canonical_question_id", "row_id", "source_weight", "question_text")
    return dedupe.canonical_rows(q, "canonical_question_id", "source_weight", "question_text", "row_id").select("canonical_question_id", "row_id", "duplicate_group_size", "max_source_weight")


@query("duplicate_groups", f"""WITH q AS (SELECT *, CASE WHEN NOT {_BLANK.format('year')} THEN year END AS y, CASE WHEN NOT {_BLANK.format('source')} THEN source END AS s, CASE WHEN NOT {_BLANK.format('source_url')} THEN source_url END AS u FROM questions_dedupe)
SELECT canonical_question_id, count(*) AS duplicate_group_size, coalesce(string_agg(DISTINCT y, ', ' ORDER BY y), '') AS years, coalesce(string_agg(DISTINCT s, ' | ' ORDER BY s), '') AS sources, coalesce(string_agg(DISTINCT u, ' | ' ORDER BY u), '') AS source_urls, substring(list(question_text ORDER BY row_id)[1], 1, 700) AS example FROM q GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    return dedupe.group_report(table(spark, d, "questions_dedupe"), "canonical_question_id", "question_text", "row_id")


@query("parse_dedupe", r"WITH k AS (SELECT row_id, question_id, source_url, CASE WHEN length(question_id) > 6 THEN question_id ELSE sha1(substring(trim(regexp_replace(lower(coalesce(question_text, '')), '[^a-zA-Z0-9_]+', ' ', 'g')), 1, 500)) END AS parse_key FROM questions) SELECT parse_key, row_id FROM k QUALIFY row_number() OVER (PARTITION BY parse_key ORDER BY question_id NULLS FIRST, source_url NULLS FIRST, row_id) = 1")
def _(spark, d):
    q = table(spark, d, "questions").select("row_id", "question_id", "source_url", X.parse_key(F.col("question_id"), F.col("question_text")).alias("parse_key"))
    return R.keep_first_of(q, ["parse_key"], [F.col("question_id"), F.col("source_url"), F.col("row_id")]).select("parse_key", "row_id")


def _identities(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    options = F.array_distinct(F.filter(F.transform(F.array("option_a", "option_b", "option_c", "option_d"), lambda o: X.normalize_for_match(F.coalesce(o, F.lit("")))), lambda o: o != ""))
    return q.select("row_id", dedupe.identity(q).alias("identity"), rules.year_text(F.col("year")).alias("year"), options.alias("options"))


@query("fuzzy_pairs")
def _(spark, d):
    texts = _identities(spark, d).groupBy("identity").agg(F.min("row_id").alias("id")).select("id", F.col("identity").alias("text"))
    return dedupe.fuzzy_pairs(texts)


@query("fuzzy_clusters")
def _(spark, d):
    return dedupe.clusters(_identities(spark, d), "row_id", "identity", "year", "options")


# --- Labelling ----------------------------------------------------------------------------------------------------


@query("taxonomy_explode", "WITH n AS (SELECT row_number() OVER (ORDER BY chapter, subtopic) AS leaf, chapter, subtopic, string_split(ncert_concept, ';') AS w FROM ncert_reverse_index), e AS (SELECT leaf, chapter, subtopic, unnest(w) AS p FROM n) SELECT leaf, chapter, subtopic, trim(regexp_replace(regexp_replace(lower(p), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS phrase FROM e")
def _(spark, d):
    return classify.leaf_keywords(table(spark, d, "ncert_reverse_index")).select("leaf", "chapter", "subtopic", "phrase")


_PLAIN = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("rule_label", f"""WITH n AS (SELECT row_number() OVER (ORDER BY chapter, subtopic) AS leaf, chapter, subtopic, string_split(ncert_concept, ';') AS w FROM ncert_reverse_index), kw AS (SELECT leaf, {_PLAIN.format('p')} AS phrase FROM (SELECT leaf, unnest(w) AS p FROM n)),
q AS (SELECT row_id AS id, {_PLAIN.format(_Q)} AS t FROM questions), ct AS (SELECT leaf, unnest(string_split_regex(lower(chapter), '\\s+')) AS w FROM n),
s AS (SELECT id, leaf, CASE WHEN contains(t, phrase) THEN 2.5e0 + least(2e0, 0.4e0 * len(string_split(phrase, ' '))) WHEN contains(phrase, ' ') THEN len(list_filter(string_split(phrase, ' '), lambda w: list_contains(string_split(t, ' '), w))) / CAST(len(string_split(phrase, ' ')) AS DOUBLE) ELSE 0 END AS s FROM q CROSS JOIN kw WHERE phrase <> ''
UNION ALL SELECT id, leaf, 0.5e0 FROM q JOIN ct ON length(w) > 4 AND list_contains(string_split(t, ' '), w)),
g AS (SELECT id, leaf, round(sum(s), 6) AS score FROM s GROUP BY 1, 2 HAVING sum(s) > 0), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, leaf) = 1)
SELECT q.id, coalesce(n.chapter, '') AS chapter, coalesce(n.subtopic, '') AS subtopic, coalesce(b.score, 0) AS score, round(least(0.98e0, 1 - exp(-coalesce(b.score, 0) / 7)), 6) AS confidence, round(least(0.98e0, 1 - exp(-coalesce(b.score, 0) / 7)), 6) < 0.3 AS needs_review FROM q LEFT JOIN b USING (id) LEFT JOIN n USING (leaf)""")
def _(spark, d):
    return classify.rule_labels(table(spark, d, "questions"), classify.leaf_keywords(table(spark, d, "ncert_reverse_index")), "row_id", "question_text")


_STOPS = ", ".join(repr(s) for s in classify.STOP)
_GRAM = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN (" + _STOPS + "))"


@query("tfidf_best", f"""WITH l0 AS (SELECT row_number() OVER (ORDER BY chapter, subtopic) AS leaf, {_GRAM.format('index_text')} AS w FROM ncert_reverse_index), q0 AS (SELECT row_id AS id, {_GRAM.format('question_text')} AS w FROM questions),
lt AS (SELECT leaf, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM l0), qt AS (SELECT id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM q0),
lf AS (SELECT leaf, term, CAST(count(*) AS DOUBLE) AS tf FROM lt GROUP BY 1, 2), idf AS (SELECT term, ln((1e0 + (SELECT count(*) FROM l0)) / (1e0 + count(*))) + 1 AS idf FROM lf GROUP BY 1), lw AS (SELECT leaf, term, tf * idf AS w FROM lf JOIN idf USING (term)), lu AS (SELECT leaf, term, w / sqrt(sum(w * w) OVER (PARTITION BY leaf)) AS lw FROM lw),
qf AS (SELECT id, term, CAST(count(*) AS DOUBLE) AS tf FROM qt GROUP BY 1, 2), qw AS (SELECT id, term, tf * idf AS w FROM qf JOIN idf USING (term)), qn AS (SELECT id, sqrt(sum(w * w)) AS len FROM qw GROUP BY 1),
dp AS (SELECT id, leaf, round(sum(w * lw) / any_value(len), 6) AS cosine FROM qw JOIN lu USING (term) JOIN qn USING (id) GROUP BY 1, 2), b AS (SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, leaf) = 1)
SELECT q0.id, coalesce(leaf, 1) AS leaf, coalesce(cosine, 0) AS cosine, round(least(0.98e0, 2.2e0 * coalesce(cosine, 0)), 6) AS score FROM q0 LEFT JOIN b USING (id)""")
def _(spark, d):
    from pyspark.sql import Window

    leaves = table(spark, d, "ncert_reverse_index").withColumn("leaf", F.row_number().over(Window.orderBy("chapter", "subtopic")))
    return classify.tfidf_labels(table(spark, d, "questions"), leaves, "row_id", "question_text")


@query("embedding_best", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM e GROUP BY 1, 2), cn AS (SELECT label, i, c / sqrt(sum(c * c) OVER (PARTITION BY label)) AS c FROM c), en AS (SELECT vec_id, i, x / sqrt(sum(CAST(x AS DOUBLE) * x) OVER (PARTITION BY vec_id)) AS x FROM e),
s AS (SELECT vec_id, cn.label, round(sum(x * c), 6) AS score FROM en JOIN cn USING (i) GROUP BY 1, 2) SELECT vec_id, label AS best_label, greatest(0, least(score, 0.98e0)) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return classify.vector_labels(e, classify.centroids(e, "label", "embedding"), "vec_id", "embedding")


SHARES = {"rule": 0.5, "embedding": 0.9, "bm25": 1.0, "llm": 0.7}


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """The labellers' votes. The export holds one confidence a row; each labeller's score is a share of it (``SHARES``)."""
    r = table(spark, d, "review_suggestions").select("canonical_question_id", *[f"{n}_label" for n in classify.VOTES], "final_confidence").distinct()
    return r.withColumns({f"{n}_score": F.col("final_confidence") * F.lit(x) for n, x in SHARES.items()}).drop("final_confidence")


_NB = {n: f"CASE WHEN NOT {_BLANK.format(n + '_label')} THEN {n}_label END" for n in classify.VOTES}
_SUMS = ", ".join(f"CASE WHEN {a}x IS NOT NULL THEN round(" + " + ".join(f"CASE WHEN {b}x = {a}x THEN {w}e0 * coalesce(final_confidence * {SHARES[b]}e0, 0) ELSE 0 END" for b, w in classify.VOTES.items()) + f", 6) ELSE -1 END AS {a}s" for a in classify.VOTES)


@query("ensemble_vote", f"""WITH r AS (SELECT DISTINCT canonical_question_id, rule_label, bm25_label, embedding_label, llm_label, final_confidence FROM review_suggestions), x AS (SELECT canonical_question_id, final_confidence, {', '.join(f'{v} AS {k}x' for k, v in _NB.items())} FROM r), s AS (SELECT *, {_SUMS} FROM x),
g AS (SELECT *, greatest({', '.join(f'{n}s' for n in classify.VOTES)}) AS best FROM s), w AS (SELECT *, CASE WHEN best < 0 THEN NULL {' '.join(f'WHEN {n}s = best THEN {n}x' for n in classify.VOTES)} END AS label FROM g),
a AS (SELECT *, {' + '.join(f'coalesce(CAST({n}x = label AS INTEGER), 0)' for n in classify.VOTES)} AS agreement FROM w)
SELECT canonical_question_id, coalesce(label, '') AS final_label, agreement, CASE WHEN label IS NULL THEN 0 ELSE CAST(round(CAST(least(0.99e0, best + 0.25e0 * agreement / 4) AS DECIMAL(18, 6)), 4) AS DOUBLE) END AS final_confidence FROM a""")
def _(spark, d):
    return classify.vote(_votes(spark, d)).select("canonical_question_id", "final_label", "agreement", "final_confidence")


@query("ensemble")
def _(spark, d):
    return classify.ensemble(table(spark, d, "questions"), table(spark, d, "ncert_reverse_index"))


@query("taxonomy_validation", f"""WITH r AS (SELECT chapter, list(subtopic) AS subs, list_distinct(flatten(list(list_filter(list_transform(string_split(coalesce(ncert_concept, ''), ';'), lambda x: lower(trim(x))), lambda x: x <> '')))) AS micro FROM ncert_reverse_index GROUP BY 1),
j AS (SELECT q.row_id, q.subtopic, lower(trim(coalesce(ncert_keyword_match, ''))) AS m, r.subs, r.micro FROM questions q LEFT JOIN r USING (chapter)),
f AS (SELECT row_id, subs IS NULL AS unknown, subs IS NOT NULL AND NOT coalesce(list_contains(subs, subtopic), false) AS bad_sub, subs IS NOT NULL AND NOT (len(micro) = 0 OR len(list_filter(subs, lambda s: lower(s) = m)) > 0 OR len(list_filter(micro, lambda a: contains(m, a) OR (m <> '' AND contains(a, m)))) > 0) AS bad_micro FROM j)
SELECT row_id, unknown OR bad_sub OR bad_micro AS taxonomy_mismatch, concat_ws('; ', CASE WHEN unknown THEN 'unknown chapter' END, CASE WHEN bad_sub THEN 'subtopic not allowed' END, CASE WHEN bad_micro THEN 'micro concept not allowed' END) AS taxonomy_mismatch_reason FROM f""")
def _(spark, d):
    q = table(spark, d, "questions").withColumnRenamed("ncert_keyword_match", "micro_concept")
    return review.validated(q, review.guardrails(table(spark, d, "ncert_reverse_index"))).select("row_id", "taxonomy_mismatch", "taxonomy_mismatch_reason")


_W = f"""tq AS (SELECT *, {_TIER} AS tier, {_YEAR} AS y FROM questions), wq AS (SELECT row_id, chapter, subtopic, y, try_cast(confidence_score AS DOUBLE) AS conf, CASE tier """ + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in rules.SOURCE_WEIGHTS.items()) + " ELSE 0.35e0 END AS wf, CASE y " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in rules.YEAR_WEIGHTS.items()) + " ELSE 0.35e0 END AS rw FROM tq)"
_RAILS = """rr AS (SELECT chapter, list(subtopic) AS subs, list_distinct(flatten(list(list_filter(list_transform(string_split(coalesce(ncert_concept, ''), ';'), lambda x: lower(trim(x))), lambda x: x <> '')))) AS micro FROM ncert_reverse_index GROUP BY 1),
jj AS (SELECT q.row_id, q.subtopic, lower(trim(coalesce(ncert_keyword_match, ''))) AS m, rr.subs, rr.micro FROM questions q LEFT JOIN rr USING (chapter)),
bad AS (SELECT row_id, subs IS NULL OR NOT coalesce(list_contains(subs, subtopic), false) OR NOT (len(micro) = 0 OR len(list_filter(subs, lambda s: lower(s) = m)) > 0 OR len(list_filter(micro, lambda a: contains(m, a) OR (m <> '' AND contains(a, m)))) > 0) AS wrong FROM jj)"""
_QTOPIC = """qp AS (SELECT chapter, subtopic, CAST(round(sum(CAST(wf AS DECIMAL(18,6))), 4) AS DOUBLE) AS f, CAST(round(sum(CAST(wf * rw AS DECIMAL(18,6))), 4) AS DOUBLE) AS r, count(DISTINCT y) AS ys FROM wq GROUP BY 1, 2),
qs AS (SELECT chapter, subtopic, round(0.3e0 * f / max(f) OVER () + 0.25e0 * r / max(r) OVER () + 0.15e0 * least(ys / 5e0, 1e0), 4) AS raw FROM qp), qt AS (SELECT *, round(cume_dist() OVER (ORDER BY raw), 4) AS p FROM qs)"""


def _question_tiers(q: DataFrame) -> DataFrame:
    """Topics of questions by source and year weights and years, with their tier."""
    none = F.lit(None).cast("string")
    per = priority.parts(q, KEYS, F.col("wf"), F.col("wf") * F.col("rw"), rules.year_text(F.col("year")), none, none, F.lit(0.0))
    caps = per.agg(F.max("source_weighted_frequency").alias("cs"), F.max("recency_score").alias("cr"))
    return priority.ranked(priority.scores(per.crossJoin(F.broadcast(caps)), {"frequency": F.col("cs"), "recency": F.col("cr"), "years": 5.0}))  # one row


@query("review_queue", f"""WITH {_W}, {_RAILS}, {_QTOPIC}, z AS (SELECT wq.*, round(0.55e0 * wf + 0.35e0 * rw + 0.1e0 * (1 - coalesce(conf, 0)), 6) AS importance, wrong, CASE WHEN wrong THEN 0.45e0 ELSE 0.82e0 END AS mc, coalesce(qt.p >= 0.65e0, false) AS hot FROM wq JOIN bad USING (row_id) LEFT JOIN qt ON wq.chapter = qt.chapter AND wq.subtopic = qt.subtopic),
k AS (SELECT row_id, importance, 'important' AS reason, 0 AS part FROM (SELECT * FROM z ORDER BY importance DESC, row_id LIMIT 50) UNION ALL SELECT row_id, importance, 'taxonomy mismatch', 1 FROM (SELECT * FROM z WHERE wrong ORDER BY importance DESC, row_id LIMIT 25) UNION ALL SELECT row_id, importance, 'high topic', 2 FROM (SELECT * FROM z WHERE hot ORDER BY wf DESC, mc, row_id LIMIT 25)),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY part) = 1), a AS (SELECT row_id, importance, reason, 0 AS f FROM u UNION ALL SELECT row_id, importance, 'filler', 1 FROM (SELECT * FROM z WHERE row_id NOT IN (SELECT row_id FROM u) ORDER BY importance DESC, row_id LIMIT 100))
SELECT row_id, importance, reason FROM a ORDER BY f, importance DESC, row_id LIMIT 100""")
def _(spark, d):
    q = table(spark, d, "questions").withColumnRenamed("ncert_keyword_match", "micro_concept").withColumn("wf", rules.source_weight(rules.source_tier(F.col("source"), F.col("source_url")))).withColumn("rw", rules.year_weight(F.col("year"))).withColumn("conf", F.col("confidence_score").try_cast("double"))
    q = cut(q.select("row_id", "chapter", "subtopic", "micro_concept", "year", "wf", "rw", "conf"))
    checked = review.validated(q, review.guardrails(table(spark, d, "ncert_reverse_index")))
    high = _question_tiers(q).where(F.col("priority_tier").startswith("Tier 1") | F.col("priority_tier").startswith("Tier 2"))
    return review.review_queue(checked, high, "row_id", "wf", "rw", "conf", "micro_confidence").select("row_id", "importance", "reason")


@query("review_suggestions_view", "SELECT canonical_question_id AS question, rule_label AS ai_suggested_label, review_reason AS why FROM review_suggestions WHERE needs_review")
def _(spark, d):
    return review.suggestions(table(spark, d, "review_suggestions"), {"canonical_question_id": "question", "rule_label": "ai_suggested_label", "review_reason": "why"})


_FORMS = f"""l0 AS (SELECT chapter || ' :: ' || subtopic AS label, unnest([chapter || ' ' || subtopic, subtopic]) AS p FROM ncert_reverse_index), lf AS (SELECT form, min(label) AS leaf FROM (SELECT DISTINCT label, {_PLAIN.format("regexp_replace(p, '[^A-Za-z0-9]+', ' ', 'g')")} AS form FROM l0) GROUP BY 1 HAVING count(*) = 1)"""
_FORM = _PLAIN.format("regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')")
_LABELS = f"""{_FORMS}, pd AS (SELECT DISTINCT canonical_question_id, rule_label FROM review_suggestions), gd AS (SELECT DISTINCT canonical_question_id, llm_label FROM review_suggestions),
lp AS (SELECT canonical_question_id, coalesce(a.leaf, CASE WHEN NOT {_BLANK.format('rule_label')} THEN lower(trim(rule_label)) END) AS label_pred, coalesce(b.leaf, CASE WHEN NOT {_BLANK.format('llm_label')} THEN lower(trim(llm_label)) END) AS label_gold FROM pd JOIN gd USING (canonical_question_id) LEFT JOIN lf a ON {_FORM.format('rule_label')} = a.form LEFT JOIN lf b ON {_FORM.format('llm_label')} = b.form)"""


def _label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Predictions (the rule's labels) met with gold ones (the outside labeller's), both in the taxonomy's spelling."""
    r, leaves = table(spark, d, "review_suggestions"), table(spark, d, "ncert_reverse_index")
    predicted = r.select("canonical_question_id", F.col("rule_label").alias("label")).distinct()
    gold = r.select("canonical_question_id", F.col("llm_label").alias("label")).distinct()
    return classify.tidy_labels(R.labelled_pairs(predicted, gold, "canonical_question_id"), leaves, ["label_pred", "label_gold"])


@query("label_accuracy", f"WITH {_LABELS} SELECT 'label_accuracy' AS metric, round(coalesce(avg(CASE WHEN trim(coalesce(label_gold, '')) <> '' THEN CAST(lower(trim(coalesce(label_pred, ''))) = lower(trim(label_gold)) AS DOUBLE) END), 0), 4) AS value FROM lp UNION ALL SELECT 'label_labelled', CAST(count(*) FILTER (WHERE trim(coalesce(label_gold, '')) <> '') AS DOUBLE) FROM lp")
def _(spark, d):
    return A.accuracy(_label_pairs(spark, d), ["label"])


@query("confusion_matrix", f"WITH {_LABELS} SELECT label_gold AS gold, label_pred AS predicted, count(*) AS n FROM lp WHERE label_gold IS NOT NULL AND label_pred IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return A.confusion(_label_pairs(spark, d), "label")


@query("common_confusions", f"WITH {_LABELS} SELECT 'label' AS field, label_gold AS gold_label, coalesce(label_pred, '') AS predicted_label, count(*) AS count FROM lp WHERE trim(coalesce(label_gold, '')) <> '' AND lower(label_gold) <> lower(coalesce(label_pred, '')) GROUP BY 2, 3 ORDER BY 4 DESC, 2, 3 LIMIT 25")
def _(spark, d):
    return A.common_confusions(_label_pairs(spark, d), ["label"])


# --- Upserts, overrides, manifests --------------------------------------------------------------------------------


@query("manual_override", f"""WITH l AS (SELECT canonical_question_id, max(CASE WHEN NOT {_BLANK.format('llm_label')} THEN llm_label END) AS label FROM (SELECT canonical_question_id, llm_label, row_number() OVER (PARTITION BY canonical_question_id ORDER BY reviewed_at DESC NULLS LAST, llm_label) AS n FROM review_suggestions) WHERE n = 1 GROUP BY 1)
SELECT row_id, canonical_question_id, coalesce(l.label, difficulty_estimate) AS difficulty_estimate, l.canonical_question_id IS NULL AS needs_review FROM questions_dedupe LEFT JOIN l USING (canonical_question_id)""")
def _(spark, d):
    q = table(spark, d, "questions_dedupe").select("row_id", "canonical_question_id", "difficulty_estimate").withColumn("needs_review", F.lit(True))
    labels = table(spark, d, "review_suggestions").withColumnRenamed("llm_label", "difficulty_estimate").withColumnRenamed("needs_review", "nr")
    return R.overridden(q, labels, "canonical_question_id", ["difficulty_estimate"], [F.col("reviewed_at").desc_nulls_last(), F.col("difficulty_estimate")])


@query("label_upsert", "WITH b AS (SELECT canonical_question_id, llm_label AS label, 0 AS age FROM review_suggestions WHERE llm_label IS NOT NULL UNION ALL SELECT canonical_question_id, rule_label, 1 FROM review_suggestions WHERE rule_label IS NOT NULL) SELECT canonical_question_id, label FROM b QUALIFY row_number() OVER (PARTITION BY canonical_question_id ORDER BY age, label) = 1")
def _(spark, d):
    r = table(spark, d, "review_suggestions")
    old = r.where("rule_label is not null").select("canonical_question_id", F.col("rule_label").alias("label"))
    new = r.where("llm_label is not null").select("canonical_question_id", F.col("llm_label").alias("label"))
    return R.upsert(old, new, ["canonical_question_id"], [F.col("label")])


@query("manifest_upsert", "WITH m AS (SELECT *, coalesce(source_url, raw_file_path) AS k, CASE WHEN text_chars > 0 THEN 'downloaded' ELSE 'failed' END AS status FROM extraction_manifest) SELECT k AS key, text_chars, status FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN status = 'downloaded' THEN 0 ELSE 1 END, CASE WHEN status = 'downloaded' THEN raw_file_path END NULLS LAST, raw_file_path DESC NULLS LAST) = 1")
def _(spark, d):
    m = table(spark, d, "extraction_manifest").withColumn("status", F.when(F.col("text_chars") > 0, "downloaded").otherwise("failed")).withColumn("key", F.coalesce("source_url", "raw_file_path"))
    return R.manifest_upsert(m, F.col("key"), "status", "downloaded", "raw_file_path").select("key", "text_chars", "status")


@query("backfill_answers", "WITH k AS (SELECT question_id, min(correct_option) AS a FROM questions_dedupe WHERE correct_option IN ('A', 'B', 'C', 'D') GROUP BY 1) SELECT row_id, coalesce(k.a, q.correct_option) AS correct_option FROM questions q LEFT JOIN k USING (question_id)")
def _(spark, d):
    known = table(spark, d, "questions_dedupe").where(F.col("correct_option").isin("A", "B", "C", "D")).groupBy("question_id").agg(F.min("correct_option").alias("a"))
    return R.backfilled(table(spark, d, "questions").select("row_id", "question_id", "correct_option"), known, "question_id", "correct_option", "a").select("row_id", "correct_option")


@query("schema_align", "SELECT row_id, CAST(NULL AS DOUBLE) AS source_weight, year, 'questions' AS origin FROM questions UNION ALL SELECT row_id, source_weight, year, 'questions_dedupe' FROM questions_dedupe")
def _(spark, d):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("source_weight", T.DoubleType()), T.StructField("year", T.StringType())])
    both = [R.aligned(table(spark, d, t), schema).withColumn("origin", F.lit(t)) for t in ("questions", "questions_dedupe")]
    return both[0].unionByName(both[1])


@query("heading_lookup", f"WITH n AS (SELECT chapter, min_by(ncert_heading, subtopic) AS h FROM ncert_reverse_index GROUP BY 1) SELECT row_id, coalesce(h, 'Unknown') AS ncert_heading FROM questions LEFT JOIN n USING (chapter)")
def _(spark, d):
    return R.first_lookup(table(spark, d, "questions").select("row_id", "chapter"), table(spark, d, "ncert_reverse_index"), ["chapter"], "ncert_heading", [F.col("subtopic")], F.lit("Unknown")).select("row_id", "ncert_heading")


@query("semi_anti", "SELECT 'labelled' AS part, count(*) AS n FROM questions_dedupe q WHERE EXISTS (SELECT 1 FROM review_suggestions r WHERE r.canonical_question_id = q.canonical_question_id) UNION ALL SELECT 'unlabelled', count(*) FROM questions_dedupe q WHERE NOT EXISTS (SELECT 1 FROM review_suggestions r WHERE r.canonical_question_id = q.canonical_question_id)")
def _(spark, d):
    q, r = table(spark, d, "questions_dedupe"), table(spark, d, "review_suggestions")
    with_ = q.join(r.select("canonical_question_id"), "canonical_question_id", "left_semi").agg(F.lit("labelled").alias("part"), F.count(F.lit(1)).alias("n"))
    return with_.union(review.unlabelled(q, r, "canonical_question_id").agg(F.lit("unlabelled").alias("part"), F.count(F.lit(1)).alias("n")))


# --- Hype against evidence ----------------------------------------------------------------------------------------


@query("hype_vs_actual", """WITH w AS (SELECT subtopic, count(*) AS n FROM questions WHERE trim(coalesce(subtopic, '')) <> '' GROUP BY 1), t AS (SELECT subtopic, CAST(n AS DOUBLE) AS weight, unnest(list_filter(string_split_regex(replace(lower(subtopic), 'and', ' '), '\\s+'), lambda x: length(x) > 4)) AS term FROM w),
h AS (SELECT subtopic, CAST(sum((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), term, ''))) // length(term)) AS BIGINT) AS hype FROM t CROSS JOIN documents GROUP BY 1), j AS (SELECT w.subtopic, CAST(w.n AS DOUBLE) AS weight, coalesce(h.hype, 0) AS hype FROM w LEFT JOIN h USING (subtopic)),
q AS (SELECT round(quantile_cont(weight, 0.6), 6) AS q60, round(quantile_cont(weight, 0.5), 6) AS q50, round(quantile_cont(weight, 0.7), 6) AS q70 FROM j)
SELECT subtopic, weight, hype, CASE WHEN hype > 0 AND weight >= q60 THEN 'validated_by_data' WHEN hype > 2 AND weight < q50 THEN 'overhyped' WHEN hype <= 1 AND weight >= q70 THEN 'underhyped_hidden_gem' WHEN hype = 0 THEN 'insufficient_data' ELSE 'mixed_signal' END AS mismatch_type FROM j, q""")
def _(spark, d):
    w = table(spark, d, "questions").where(~R.blank(F.col("subtopic"))).groupBy("subtopic").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    terms = w.select("subtopic", F.explode(X.long_terms(F.col("subtopic"))).alias("term"))
    # one automaton over all terms reads each text once; what leaves a task is a count per term
    found = phrases.totals(table(spark, d, "documents"), "text", terms, "term")
    hype = terms.join(found, "term", "left").groupBy("subtopic").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hype"))
    return priority.hype(w.join(hype, "subtopic", "left").na.fill(0, ["hype"]), "hype", "weight")


@query("hidden_gems", f"SELECT subtopic, weight, hype FROM ({SQL['hype_vs_actual']}) WHERE mismatch_type = 'underhyped_hidden_gem'" if "hype_vs_actual" in SQL else None)
def _(spark, d):
    return QUERIES["hype_vs_actual"](spark, d).where("mismatch_type = 'underhyped_hidden_gem'").select("subtopic", "weight", "hype")


@query("overhyped", f"SELECT subtopic, weight, hype FROM ({SQL['hype_vs_actual']}) WHERE mismatch_type = 'overhyped'" if "hype_vs_actual" in SQL else None)
def _(spark, d):
    return QUERIES["hype_vs_actual"](spark, d).where("mismatch_type = 'overhyped'").select("subtopic", "weight", "hype")


# --- Practice -----------------------------------------------------------------------------------------------------


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Events as attempts: a purchase is a right answer, a click a wrong one, others were skipped; chapters by user."""
    e = table(spark, d, "events")
    chosen = F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "click", "B")
    return practice.scored(e.select("event_id", "user_id", "ts", "value", F.to_date("ts").alias("day"), (F.col("event_id") % 12).alias("topic"), chosen.alias("chosen"), F.lit("A").alias("correct_option")), "chosen", "correct_option")


_A = "a AS (SELECT *, CAST(ts AS DATE) AS day, event_id % 12 AS topic, CAST(event_type IN ('purchase', 'click') AS INTEGER) AS attempted, CAST(event_type = 'purchase' AS INTEGER) AS is_correct, CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN -1 ELSE 0 END AS score_delta, CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'click' THEN 'wrong' ELSE 'skipped' END AS result FROM events)"


@query("score_attempts", f"WITH {_A} SELECT event_id, attempted, is_correct, score_delta, result FROM a")
def _(spark, d):
    return attempts(spark, d).select("event_id", "attempted", "is_correct", "score_delta", "result")


_S = f"{_A}, s AS (SELECT user_id, day, min(ts) AS attempted_at, count(*) AS questions, CAST(sum(attempted) AS BIGINT) AS attempted, CAST(sum(is_correct) AS BIGINT) AS correct, CAST(sum(score_delta) AS BIGINT) AS score FROM a GROUP BY 1, 2), ss AS (SELECT *, questions * 5 AS max_score, round(score * 100e0 / (questions * 5), 4) AS score_percent, round(CASE WHEN attempted > 0 THEN correct * 100e0 / attempted ELSE 0 END, 4) AS accuracy, round(attempted * 100e0 / questions, 4) AS attempt_rate FROM s)"


@query("session_summary", f"WITH {_S} SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY attempted_at, day) AS mock_number FROM ss")
def _(spark, d):
    return practice.numbered(practice.sessions(attempts(spark, d), ["user_id", "day"], "ts"), "user_id", key=["day"])


@query("scorecard", f"WITH {_S} SELECT user_id, day, CASE WHEN score_percent >= 80 AND accuracy >= 85 THEN 'Excellent' WHEN score_percent >= 65 AND accuracy >= 75 THEN 'Good' WHEN score_percent >= 45 THEN 'Average' ELSE 'Needs Work' END AS label FROM ss")
def _(spark, d):
    s = practice.sessions(attempts(spark, d), ["user_id", "day"], "ts")
    return s.select("user_id", "day", practice.verdict(F.col("score_percent"), F.col("accuracy")).alias("label"))


@query("latest_session", f"WITH {_S} SELECT user_id, arg_max(day, ROW(attempted_at, day)) AS day FROM ss GROUP BY 1")
def _(spark, d):
    return practice.latest_session(practice.sessions(attempts(spark, d), ["user_id", "day"], "ts"), "user_id", "day", "attempted_at")


_WEAK = f"{_A}, w AS (SELECT topic, count(*) FILTER (WHERE result = 'wrong') AS wrong, count(*) FILTER (WHERE result = 'skipped') AS skipped, CAST(sum(attempted) AS BIGINT) AS attempted, CAST(sum(is_correct) AS BIGINT) AS correct FROM a GROUP BY 1), wp AS (SELECT *, round(coalesce(CAST(correct AS DOUBLE) / nullif(attempted, 0), 0), 4) AS accuracy, round(2 * wrong + 0.8e0 * skipped + (1 - coalesce(CAST(correct AS DOUBLE) / nullif(attempted, 0), 0)), 4) AS weakness_score FROM w)"


@query("weakness_profile", f"WITH {_WEAK} SELECT * FROM wp")
def _(spark, d):
    return practice.weakness(attempts(spark, d), ["topic"])


def _bank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 12).alias("topic"), "p_type", "p_size")


@query("adaptive_weight", f"WITH {_WEAK} SELECT p_partkey, round(CAST(p_size AS DOUBLE) + 2.5e0 * coalesce(weakness_score, 0), 6) AS adaptive_weight FROM part LEFT JOIN wp ON p_partkey % 12 = topic")
def _(spark, d):
    return practice.adaptive_weight(_bank(spark, d), practice.weakness(attempts(spark, d), ["topic"]), ["topic"], "p_size").select("p_partkey", "adaptive_weight")


@query("avoid_recent", "WITH r AS (SELECT DISTINCT user_id FROM (SELECT user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 120)) SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT user_id FROM r)")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("p_partkey"), "ts", "event_id")
    return practice.fresh(_bank(spark, d), e, "p_partkey", "ts", 40, "event_id").select("p_partkey")


@query("weighted_sample")
def _(spark, d):
    bank = practice.adaptive_weight(_bank(spark, d), practice.weakness(attempts(spark, d), ["topic"]), ["topic"], "p_size")
    return practice.weighted_sample(bank, "p_partkey", "adaptive_weight", "p_type", {"SMALL": 15, "LARGE": 25}, 50)


@query("forecast", f"""WITH {_S}, y AS (SELECT user_id, greatest(0e0, score_percent) AS y, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ss),
m AS (SELECT user_id, CAST(any_value(n) AS INTEGER) AS n, avg(y) AS my, coalesce(sum((i - (n - 1) / 2e0) * y) / nullif(sum((i - (n - 1) / 2e0) * (i - (n - 1) / 2e0)), 0), 0) AS slope, sum(CASE WHEN i = 0 THEN pow(0.45e0, n - 1) ELSE 0.55e0 * pow(0.45e0, n - 1 - i) END * y) AS ema FROM y GROUP BY 1),
g AS (SELECT m.*, greatest(sqrt(sd.v), 4e0) AS spread FROM m JOIN (SELECT user_id, avg(pow(y - (my + slope * (i - (m.n - 1) / 2e0)), 2)) AS v FROM y JOIN m USING (user_id) GROUP BY 1) sd USING (user_id)), st AS (SELECT *, unnest(CASE WHEN n >= 2 THEN [1, 2, 3] ELSE [0] END) AS step FROM g),
c AS (SELECT *, round(0.55e0 * (my + slope * ((n - 1) / 2e0 + step)) + 0.45e0 * ema, 6) AS c, n >= 2 AS ok FROM st)
SELECT user_id, n, step, CASE WHEN ok THEN 'ok' ELSE 'insufficient_data' END AS status, CASE WHEN ok THEN round(greatest(0, least(100, c)), 2) END AS forecast, CASE WHEN ok THEN round(greatest(0, least(100, round(c - spread, 6))), 2) END AS low, CASE WHEN ok THEN round(greatest(0, least(100, round(c + spread, 6))), 2) END AS high FROM c""")
def _(spark, d):
    s = practice.sessions(attempts(spark, d), ["user_id", "day"], "ts")
    return practice.forecast(s.withColumn("score_percent", F.greatest(F.lit(0.0), F.col("score_percent"))), ["user_id"], "day", "score_percent")


# --- Sources: texts that stand in the tables ----------------------------------------------------------------------


_NORM = r"regexp_replace(regexp_replace(regexp_replace(translate({0}, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def _first(c: str, pattern: str) -> str:
    return _NORM.format(f"regexp_extract({c}, '(?is){pattern}', 1)")


def _option(letter: str) -> str:
    mine = f"list_filter(pieces[2:], lambda p: translate(upper(substring(p, 1, 1)), '1234', 'ABCD') = '{letter}')[1]"
    return f"coalesce(trim(regexp_replace(regexp_replace(substring({mine}, 3), '{X.BEHIND}', ''), '\\s+', ' ', 'g')), '')"


def _parse_sql() -> str:
    """The grammar's SQL: the same marks, in the other dialect's functions."""
    stem = "pieces[1]"
    for p in (r"(?i)question\s*id\s*[:-]?\s*\d+", X.LEADING, rf"(?is){X.ANSWER}[a-d1-4].*$"):
        stem = f"regexp_replace({stem}, '{p}', '', 'g')".replace("\\\\", "\\")
    options = {x: _option(x) for x in "ABCD"}
    asks = "contains(block, '?') OR regexp_matches(lower(block), '" + "|".join(X.PROMPT_WORDS) + "')"
    answer = f"array_to_string(list_transform(regexp_extract_all(upper({_first('block', X.ANSWER + '([a-d1-4])')}), '[A-D1-4]'), lambda x: translate(x, '1234', 'ABCD')), ',')"
    return f"""WITH b0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(source_url, '') AS source_url, string_split(regexp_replace(chr(10) || replace({_NORM.format('text')}, chr(1), ''), '(?i)\\n\\s*({X.STARTS})', chr(1) || '\\1', 'g'), chr(1)) AS bs FROM documents WHERE text IS NOT NULL),
b1 AS (SELECT doc_id, source, source_url, list_filter(list_transform(bs, lambda x: {_NORM.format('x')}), lambda x: length(x) > 0) AS bs FROM b0), b2 AS (SELECT doc_id, source, source_url, unnest(bs) AS block, generate_subscripts(bs, 1) - 1 AS pos FROM b1),
b3 AS (SELECT *, string_split(regexp_replace(replace(replace(block, chr(2), ''), chr(3), ''), '{X.OPTION}', chr(2) || '\\1\\2' || chr(3), 'g'), chr(2)) AS pieces, concat_ws(' ', source, source_url, source_url, substring(block, 1, 300)) AS meta FROM b2),
b4 AS (SELECT *, {', '.join(f"{o} AS option_{x.lower()}" for x, o in options.items())}, {asks} AS asks FROM b3),
b5 AS (SELECT *, {_NORM.format(stem)} AS question_text, {answer} AS correct_option, {_first('block', 'question\\s*id\\s*[:-]?\\s*(\\d+)')} AS qid, coalesce(nullif({_first('block', '(?:^|\\n)\\s*(?:q(?:uestion)?\\.?\\s*)?(\\d{1,3})\\s*[.)]')}, ''), CAST(pos + 1 AS VARCHAR)) AS question_number,
regexp_extract(meta, '\\b(20(?:2[2-6]|19))\\b', 1) AS year FROM b4 WHERE asks OR (option_a <> '')::INT + (option_b <> '')::INT + (option_c <> '')::INT + (option_d <> '')::INT >= 2),
pq AS (SELECT *, CASE WHEN qid <> '' THEN qid ELSE substring(sha256(question_text || source_url), 1, 18) END AS question_id FROM b5)
SELECT doc_id, pos, question_number, question_text, option_a, option_b, option_c, option_d, correct_option, question_id, year FROM pq"""


@query("question_blocks", _parse_sql())
def _(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return documents.parse_questions(docs, "doc_id", "text", "source", "source_url", "source_url").select("doc_id", "pos", "question_number", "question_text", "option_a", "option_b", "option_c", "option_d", "correct_option", "question_id", "year")


_PARSE_KEY = r"CASE WHEN length(question_id) > 6 THEN question_id ELSE sha1(substring(trim(regexp_replace(lower(coalesce(question_text, '')), '[^a-zA-Z0-9_]+', ' ', 'g')), 1, 500)) END"


@query("parsed_questions", f"SELECT {_PARSE_KEY} AS parse_key, doc_id, pos, question_text FROM ({_parse_sql().replace('SELECT doc_id, pos, question_number, question_text, option_a', 'SELECT source_url, doc_id, pos, question_number, question_text, option_a')}) QUALIFY row_number() OVER (PARTITION BY {_PARSE_KEY} ORDER BY question_id, source_url, doc_id, pos) = 1")
def _(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return documents.parsed(docs, "doc_id", "text", "source", "source_url", "source_url").select("parse_key", "doc_id", "pos", "question_text")


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages: every line a paragraph, in markup that is escaped."""
    q = table(spark, d, "documents").where("text is not null")
    return q.select("doc_id", F.concat(F.lit("<html><head><style>p{}</style></head><body><p>"), F.replace(_escaped(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p><a href=\"/papers/"), F.col("doc_id").cast("string"), F.lit(".pdf\">Question paper "), (F.col("doc_id") % 3).cast("string"), F.lit("</a></body></html>")).alias("html"))


_BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("html_text", "SELECT doc_id, " + _NORM.format(f"array_to_string(list_append(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_BLANKS}|{_BLANKS}$', '', 'g')), lambda x: x <> ''), 'Question paper ' || doc_id % 3), chr(10))") + " AS text FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return documents.html_text(_pages(spark, d), "doc_id", "html")


@query("html_links", "SELECT doc_id, CAST(0 AS INTEGER) AS pos, '/papers/' || doc_id || '.pdf' AS url, 'Question paper ' || doc_id % 3 AS label FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return documents.html_links(_pages(spark, d), "doc_id", F.col("html"), "paper|exam", "question")


@query("answer_pairs", "SELECT row_id, CAST(1 AS INTEGER) AS block_no, CAST(0 AS INTEGER) AS pos, CAST(row_id + 1000000 AS VARCHAR) AS question_id, ['A', 'B', 'C', 'D', 'DROP'][1 + row_id % 5] AS correct_option FROM questions WHERE contains(lower(coalesce(chapter, '')), 'plan')")
def _(spark, d):
    keys = F.element_at(F.array(*[F.lit(x) for x in ("1", "2", "3", "4", "Drop")]), (F.col("row_id") % 5 + 1).cast("int"))
    text = F.concat(F.lit("Answer keys "), F.coalesce("chapter", F.lit("")), F.lit(" "), (F.col("row_id") + 1_000_000).cast("string"), F.lit(" "), keys)
    return documents.answer_pairs(table(spark, d, "questions").select("row_id", text.alias("text")), "row_id", "text", "answer keys", "plan")


@query("paper_rows", "SELECT row_id, '2' AS shift, CAST(row_id % 40 AS INTEGER) AS question_number, CAST(row_id AS VARCHAR) AS question_id, 'MCQ' AS question_type, CASE WHEN row_id % 40 <= 15 THEN 'Section A' ELSE 'Section B1' END AS section FROM questions")
def _(spark, d):
    q = table(spark, d, "questions")
    text = F.concat(F.lit("Shift 2 Question Number : "), (F.col("row_id") % 40).cast("string"), F.when(F.col("row_id") % 2 == 0, " Question Id : ").otherwise("\nQuestion Type: mcq\nQuestion ID "), F.col("row_id").cast("string"), F.when(F.col("row_id") % 2 == 0, " x Question Type : MCQ").otherwise(""))
    return documents.paper_rows(q.select("row_id", text.alias("text")), "row_id", "text")


_ANSWER = r"coalesce(array_to_string(list_transform(regexp_extract_all(upper(trim(correct_option)), '[A-D1-4]'), lambda x: translate(x, '1234', 'ABCD')), ','), '')"


@query("embedded_questions", f"SELECT row_id, CAST(row_id AS VARCHAR) AS question_id, coalesce(option_a, '') AS option_a, {_ANSWER} AS correct_option FROM questions WHERE trim(coalesce(regexp_replace(question_text, '[\\x00-\\x1f\"\\\\{{}}]+', ' ', 'g'), '')) <> '' AND NOT coalesce(regexp_matches(option_a, '[\\x00-\\x1f\"\\\\{{}}]'), false)")
def _(spark, d):
    q = table(spark, d, "questions").where(~F.coalesce(F.col("option_a").rlike(r'[\x00-\x1f"\\{}]'), F.lit(False)))
    asked = F.regexp_replace("question_text", r'[\x00-\x1f"\\{}]+', " ")
    page = F.replace(F.to_json(F.struct(F.col("row_id").cast("string").alias("_id"), asked.alias("question"), F.col("option_a").alias("option1"), F.col("correct_option").alias("correctAnswer"))), F.lit('"'), F.lit('\\"'))
    found = documents.embedded_questions(q.select("row_id", F.concat(F.lit("<script>"), page, F.lit("</script>")).alias("html")), "row_id", "html")
    return found.select("row_id", "question_id", "option_a", "correct_option")


@query("salvage_json", "SELECT row_id, CASE WHEN row_id % 3 = 0 THEN NULL ELSE '{\"id\":' || row_id || '}' END AS json FROM questions")
def _(spark, d):
    q = table(spark, d, "questions")
    whole = F.concat(F.lit('{"id": '), F.col("row_id").cast("string"), F.lit("}"))
    text = F.when(F.col("row_id") % 3 == 0, "none here").when(F.col("row_id") % 3 == 1, whole).otherwise(F.concat(F.lit("Sure: ```json "), whole, F.lit(" ```")))
    return q.select("row_id", X.salvage_json(text).alias("json"))


@query("paper_sections", "SELECT row_id, '' AS shift, CAST(row_id % 40 AS INTEGER) AS question_number, CAST(row_id AS VARCHAR) AS question_id, 'SA' AS question_type, CASE WHEN row_id % 2 = 0 THEN 'Section A Common Core' ELSE 'Section B1 Computer Science' END AS section FROM questions")
def _(spark, d):
    named = F.when(F.col("row_id") % 2 == 0, "Section : COMPULSORY").otherwise("Section : Computer  Science")
    text = F.concat(named, F.lit("\nItem No : "), (F.col("row_id") % 40).cast("string"), F.lit(" Question ID : "), F.col("row_id").cast("string"), F.lit("\nQuestion Type : sa"))
    return documents.paper_rows(table(spark, d, "questions").select("row_id", text.alias("text")), "row_id", "text")


@query("title_case", r"""SELECT row_id, array_to_string(list_transform(regexp_extract_all(lower(chapter), '[a-z]+|[^a-z]+'), lambda w: upper(w[1:1]) || w[2:]), '') AS heading FROM questions""")
def _(spark, d):
    return table(spark, d, "questions").select("row_id", X.title_case(F.col("chapter")).alias("heading"))


@query("safe_names", r"SELECT row_id, substring(regexp_replace(regexp_replace(source_url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS name FROM questions")
def _(spark, d):
    return table(spark, d, "questions").select("row_id", X.safe_name(F.col("source_url")).alias("name"))


# --- Files: tables written in the shared folder and read back -----------------------------------------------------

_FILE_COLUMNS = ("question_id", "chapter", "subtopic", "question_text", "source")


def _folder(spark: SparkSession) -> str:
    from uuid import uuid4

    from lodestone.runtime import shared_dir

    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/{uuid4().hex}"


@query("csv_files", "SELECT " + ", ".join(rf"coalesce(trim(regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')), '') AS {c}" for c in _FILE_COLUMNS) + ", CAST(NULL AS VARCHAR) AS shift FROM questions WHERE question_text IS NOT NULL AND trim(question_text) <> ''")
def _(spark, d):
    at = _folder(spark)
    rows = table(spark, d, "questions").where(~R.blank(F.col("question_text"))).select(*_FILE_COLUMNS)
    files.write_csv(rows, at)
    back = files.read_csv(spark, f"{at}/*.csv", files.strings([*_FILE_COLUMNS, "shift"]), trimmed=True)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _FILE_COLUMNS], "shift")


@query("json_lines", "SELECT row_id, chapter, question_text, CAST(NULL AS DOUBLE) AS score FROM questions")
def _(spark, d):
    at = _folder(spark)
    files.write_jsonl(table(spark, d, "questions").select("row_id", "chapter", "question_text"), at)
    return files.read_jsonl(spark, at, "row_id long, chapter string, question_text string, score double")


@query("raw_text_files", "SELECT count(*) AS files, CAST(count(DISTINCT page_text) AS BIGINT) AS texts FROM (SELECT page_text FROM extracted_pages WHERE page_text IS NOT NULL AND regexp_matches(page_text, '^[!-~]+( [!-~]+)*$'))")
def _(spark, d):
    at = _folder(spark)
    pages = table(spark, d, "extracted_pages").where(F.col("page_text").rlike("^[!-~]+( [!-~]+)*$")).select("page_id", F.col("page_text").alias("value"))
    pages.write.partitionBy("page_id").option("lineSep", "\x00").text(at)
    return files.raw_texts(spark, f"{at}/*/*.txt").agg(F.count(F.lit(1)).alias("files"), F.count_distinct(F.replace("text", F.lit("\x00"), F.lit(""))).alias("texts"))


# --- Small operators ----------------------------------------------------------------------------------------------


@query("existing_columns", "SELECT row_id, chapter, year FROM questions")
def _(spark, d):
    return R.existing(table(spark, d, "questions"), ["row_id", "absent", "chapter", "year"])


@query("flagged_rows", "SELECT row_id FROM questions WHERE lower(trim(needs_review)) IN ('true', 'yes')")
def _(spark, d):
    return table(spark, d, "questions").where(R.flag(F.col("needs_review"))).select("row_id")


@query("filtered_or_head", "SELECT * FROM (SELECT row_id, chapter FROM questions WHERE chapter = 'No Such Chapter' UNION ALL SELECT * FROM (SELECT row_id, chapter FROM questions ORDER BY row_id LIMIT 25))")
def _(spark, d):
    return R.filtered_or_head(table(spark, d, "questions").select("row_id", "chapter"), F.col("chapter") == "No Such Chapter", [F.col("row_id")], 25)


@query("human_labels", "SELECT canonical_question_id, review_reason FROM review_suggestions WHERE NOT coalesce(contains(lower(review_reason), 'label'), false)")
def _(spark, d):
    return review.without(table(spark, d, "review_suggestions"), "review_reason", "label").select("canonical_question_id", "review_reason")


@query("where_set", "SELECT row_id, CASE WHEN difficulty_estimate = 'hard' THEN 'set' ELSE chapter END AS chapter FROM questions")
def _(spark, d):
    return R.where_set(table(spark, d, "questions").select("row_id", "chapter", "difficulty_estimate"), F.col("difficulty_estimate") == "hard", {"chapter": F.lit("set")}).select("row_id", "chapter")


@query("prefixed_metrics", "SELECT source_tier AS metric, CAST(count(*) AS DOUBLE) AS value FROM questions_dedupe WHERE trim(coalesce(source_tier, '')) <> '' GROUP BY 1")
def _(spark, d):
    return A.prefixed(A.value_counts(table(spark, d, "questions_dedupe"), "source_tier", "source_tier_"), "source_tier_")


@query("metric_lookup", "SELECT CAST(count(*) AS DOUBLE) AS total_raw_rows FROM questions_dedupe")
def _(spark, d):
    q = table(spark, d, "questions_dedupe")
    return A.metric(dedupe.quality(q, "canonical_question_id", "source_tier", F.col("source_weight"), R.blank(F.col("question_text"))), "total_raw_rows", -1.0)


@query("latest_labels", "SELECT canonical_question_id, max(reviewed_at) AS reviewed_at FROM review_suggestions GROUP BY 1")
def _(spark, d):
    return review.latest_labels(table(spark, d, "review_suggestions"), "canonical_question_id", "reviewed_at").select("canonical_question_id", "reviewed_at")


@query("label_batches", "SELECT canonical_question_id, CAST((row_number() OVER (ORDER BY canonical_question_id) - 1) // 5 AS BIGINT) AS batch FROM (SELECT DISTINCT canonical_question_id FROM questions_dedupe q WHERE canonical_question_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM review_suggestions r WHERE r.canonical_question_id = q.canonical_question_id))")
def _(spark, d):
    q = table(spark, d, "questions_dedupe").where("canonical_question_id is not null").select("canonical_question_id").distinct()
    return review.batches(review.unlabelled(q, table(spark, d, "review_suggestions"), "canonical_question_id"), "canonical_question_id")


@query("canonical_numbers", f"SELECT row_id, 'cq_' || lpad(CAST(dense_rank() OVER (ORDER BY m) AS VARCHAR), 6, '0') || '_' || substring(sha256(x), 1, 10) AS canonical_question_id FROM (SELECT row_id, {_ID} AS x, min(row_id) OVER (PARTITION BY {_ID}) AS m FROM questions)")
def _(spark, d):
    q = table(spark, d, "questions").select("row_id", dedupe.identity(table(spark, d, "questions")).alias("x"))
    first = q.groupBy("x").agg(F.min("row_id").alias("m"))
    return dedupe.canonical_ids(q.join(first, "x"), "m", F.col("x")).select("row_id", "canonical_question_id")


@query("evidence_intent", f"WITH {_T} SELECT chapter, count(*) AS topics FROM topic WHERE question_count <= 1 GROUP BY 1")
def _(spark, d):
    return intent.answer("which labels look suspicious", topics(spark, d), facts(spark, d), list(PART_TYPES))[1]


@query("import_counters", "SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM questions UNION ALL SELECT 'distinct_ids', count(DISTINCT question_id) FROM questions UNION ALL SELECT 'readable_texts', count(*) FILTER (WHERE length(question_text) > 20) FROM questions UNION ALL SELECT 'answered', count(*) FILTER (WHERE trim(coalesce(correct_option, '')) <> '') FROM questions")
def _(spark, d):
    return A.metric_rows(table(spark, d, "questions"), {"rows": F.count(F.lit(1)), "distinct_ids": F.count_distinct("question_id"), "readable_texts": F.count_if(F.length("question_text") > 20), "answered": F.count_if(~R.blank(F.col("correct_option")))})


@query("relevant_sources", "SELECT source_url, text_chars FROM extraction_manifest WHERE contains(lower(coalesce(source_url, '')), 'manual') OR (contains(lower(coalesce(source_url, '')), 'exam-office') AND contains(lower(coalesce(source_url, '')), 'papers'))")
def _(spark, d):
    return table(spark, d, "extraction_manifest").where(files.relevant(F.col("source_url"), ["manual"], [("exam-office", ["papers"])])).select("source_url", "text_chars")


@query("report_table", "SELECT CAST(row_id AS VARCHAR) AS row_id, coalesce(source, '') AS source, coalesce(year, '') AS year, coalesce(shift, '') AS shift FROM (SELECT row_id, source, year, shift FROM questions ORDER BY row_id LIMIT 30)")
def _(spark, d):
    q = table(spark, d, "questions").select("row_id", "question_text", "source", "year", "source_url", "shift", "chapter")
    return R.compact(q, ["question_text", "source_url"], [F.col("row_id")], columns=4)


@query("score_then_difficulty", f"WITH {_E} SELECT chapter, subtopic, raw_score, difficulty FROM e ORDER BY raw_score DESC, difficulty, chapter, subtopic LIMIT 18")
def _(spark, d):
    return topics_with_effort(spark, d).orderBy(F.desc("raw_score"), "difficulty", *KEYS).limit(18).select(*KEYS, "raw_score", "difficulty")


@query("evidence_counters", f"WITH {_T} SELECT 'tier_1_topics' AS metric, CAST(count(*) FILTER (WHERE priority_tier LIKE 'Tier 1%') AS DOUBLE) AS value FROM topic UNION ALL SELECT 'tier_2_topics', count(*) FILTER (WHERE priority_tier LIKE 'Tier 2%') FROM topic")
def _(spark, d):
    known = R.approved({"topics": topics(spark, d)}, ["topics", "absent"])
    return A.metric_rows(known["topics"], {f"tier_{i}_topics": F.count_if(F.col("priority_tier").startswith(f"Tier {i}")) for i in (1, 2)})


@query("utc_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.utc_text(F.col("ts")).alias("at"))


@query("fetch_status", """SELECT row_id, CASE row_id % 6 WHEN 0 THEN 'cached' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' ELSE 'downloaded' END AS status, CASE row_id % 6 WHEN 0 THEN 'kept from before' WHEN 1 THEN 'not allowed' WHEN 2 THEN 'HTTP 404' WHEN 3 THEN 'not a PDF: text/html' ELSE '' END AS note FROM questions""")
def _(spark, d):
    k = F.col("row_id") % 6
    status = files.fetch_status(F.when(k == 2, 404).otherwise(200), F.when(k == 4, "Application/PDF").when(k == 5, None).otherwise("text/html"), F.when(k == 5, "%PDF-1.7").otherwise("<html>"), F.when(k == 0, 5000).otherwise(0), k != 1)
    return table(spark, d, "questions").select("row_id", status.alias("s")).select("row_id", "s.status", "s.note")
