"""Queries on alignment, answers, contracts, judged scores and augmentation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions import geometry as G
from quillspan.functions import text as T
from quillspan.functions.kernels import ctc_score, ctc_spans, letter_marks, letter_spans
from quillspan.operators import answers, augment, contract, dictation, judging
from quillspan.plans.registry import Registry
from quillspan.session import table, written

query = Registry()
q = lambda s: s.replace("'", "''")


def _jobs(spark: SparkSession, d: str, read: Column | None = None) -> DataFrame:
    """Every dictation key with a reading of it: by default one in which words are misspelled by rule."""
    key = table(spark, d, "dictation_key").where("text is not null").withColumn("text", T.nfc(F.col("text")))
    if read is None:
        key = augment.corrupted(key, "text", "key_id", "read", rate=0.15, edges=0.0)
    else:
        key = key.withColumn("read", read)
    lines = key.select("job_id", F.lit(0).alias("place"), "read", G.box(*[F.lit(float(x)) for x in (100, 100, 1500, 150)]).alias("bbox"), F.lit("L0").alias("line_id"), F.lit(0.9).alias("confidence"))
    toks = dictation.lines_to_tokens(lines, "job_id", "place", "read")
    return key.select("job_id", "ignore_case", "count_punctuation", T.token_array(F.col("text")).alias("key")).join(toks, "job_id")


def _aligned(spark: SparkSession, d: str, read: Column | None = None) -> DataFrame:
    return written(dictation.align(_jobs(spark, d, read)))


@query()
def dictation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dictation.align(_jobs(spark, d)).select("job_id", "n", F.col("k.text").alias("expected"), F.col("h.text").alias("written"))


@query()
def dictation_errors(spark: SparkSession, d: str) -> DataFrame:
    return dictation.errors(dictation.align(_jobs(spark, d))).groupBy("kind", "mark").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("n_jobs"))


@query()
def dictation_cards(spark: SparkSession, d: str) -> DataFrame:
    pairs = _aligned(spark, d)
    return dictation.score_cards(pairs, dictation.errors(pairs))


def _verdicts(found: DataFrame) -> DataFrame:
    """Verdicts of a judge of the ink, made up by rule: by the length of the word that was expected."""
    n = F.length("expected") % 3
    verdict = F.when(n == 0, "ok").when(n == 1, "review").otherwise("error")
    letter = F.struct(F.left("written", F.lit(1)).alias("ink"), F.left("expected", F.lit(1)).alias("correct"), F.col("bbox"))
    return found.where("kind = 'spelling'").select("job_id", "n", verdict.alias("verdict"), n.cast("double").alias("margin"), F.col("written").alias("best"), F.array(letter).alias("letters"))


@query()
def dictation_judged(spark: SparkSession, d: str) -> DataFrame:
    """Score cards once a judge has looked at the spelling errors."""
    pairs = _aligned(spark, d)
    found = dictation.errors(pairs)
    return dictation.score_cards(pairs, dictation.judged(found, _verdicts(found)))


@query()
def dictation_marks(spark: SparkSession, d: str) -> DataFrame:
    found = dictation.errors(_aligned(spark, d))
    return dictation.marks(dictation.judged(found, _verdicts(found))).select("job_id", "n", "kind", "reason", "text", "bbox", "line_id", "needs_review", "verdict", F.size("letters").alias("n_letters"))


# what a reading in small letters has wrong: the case of every word that has a capital, unless case is to be ignored
@query(
    "SELECT job_id, count(*) AS n_expected, count(*) AS n_read, count(*) AS n_matched, 1.0::DOUBLE AS coverage, count(*) FILTER (NOT coalesce(ignore_case, false) AND h <> lower(h)) AS n_spelling, 0 AS n_punctuation, 0.9::DOUBLE AS confidence, false AS needs_review"
    f" FROM (SELECT job_id, ignore_case, regexp_extract(m, '{q(T.TOKEN_HEAD)}') AS h FROM (SELECT job_id, ignore_case, unnest(regexp_extract_all(nfc_normalize(text), '{q(T.token_pattern())}')) AS m FROM dictation_key)) GROUP BY job_id, ignore_case"
)
def dictation_in_small_letters(spark: SparkSession, d: str) -> DataFrame:
    pairs = _aligned(spark, d, F.lower("text"))
    return dictation.score_cards(pairs, dictation.errors(pairs)).withColumn("confidence", F.lit(0.9))


# An ordered scale of limits.
SCALE = [("5", 0, 1), ("4", 2, 2), ("3", 4, 4), ("2", 7, 7)]  # grade, most spelling, most punctuation errors


@query(
    "SELECT l_orderkey AS id, coalesce(min(grade ORDER BY ord) FILTER (ord = m), '1') AS grade FROM (SELECT l_orderkey, sp, pu, grade, ord, min(ord) OVER (PARTITION BY l_orderkey) AS m FROM"
    " (SELECT l_orderkey, count(*) - 1 AS sp, count(*) FILTER (l_returnflag = 'A') AS pu FROM lineitem GROUP BY l_orderkey)"
    " LEFT JOIN (VALUES ('5', 0, 1, 0), ('4', 2, 2, 1), ('3', 4, 4, 2), ('2', 7, 7, 3)) AS s(grade, ms, mp, ord) ON sp <= ms AND pu <= mp) GROUP BY l_orderkey"
)
def first_row_of_scale(spark: SparkSession, d: str) -> DataFrame:
    """The first row of an ordered scale whose limits two counts meet: a range lookup as an expression, no join."""
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.count("*") - 1).alias("sp"), F.count_if(F.col("l_returnflag") == "A").alias("pu"))
    grade: Column = F.lit("1")
    for g, ms, mp in reversed(SCALE):
        grade = F.when((F.col("sp") <= ms) & (F.col("pu") <= mp), g).otherwise(grade)
    return counts.select("id", grade.alias("grade"))


_Z = "least((ctc + 5.413) / 7.805, (pmi + 2.095) / 3.829)"


@query(
    f"SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 1 THEN CASE WHEN ctc >= 13.7 THEN 'error' WHEN ctc >= 5.1 THEN 'review' ELSE 'ok' END WHEN {_Z} >= 2.30 THEN 'error' WHEN {_Z} >= 0.68 THEN 'review' ELSE 'ok' END AS verdict"
    " FROM (SELECT l_linenumber, l_quantity - 5 AS ctc, l_discount * 100 AS pmi FROM lineitem)) GROUP BY verdict"
)
def verdict_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two judges' margins as one verdict; without a line's context only the first judge counts."""
    m = table(spark, d, "lineitem").select((F.col("l_quantity") - 5).alias("ctc"), F.when(F.col("l_linenumber") != 1, F.col("l_discount") * 100).alias("pmi"))
    return m.select(judging.verdict(F.col("ctc"), F.col("pmi")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


_KEYED = "(SELECT o_custkey, o_orderkey, o_totalprice, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS is_key FROM orders)"


def _spellings(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's first order as the key of a word, the others as spellings of it."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderkey") == F.min("o_orderkey").over(Window.partitionBy("o_custkey"))).alias("is_key"))
    return judging.best_spellings(o, "o_custkey", "o_orderkey", "o_totalprice", "is_key")


@query(
    "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) FILTER (NOT is_key) AS best, coalesce(max(o_totalprice) FILTER (NOT is_key) - max(o_totalprice) FILTER (is_key), 0.0) AS margin"
    f" FROM {_KEYED} GROUP BY o_custkey"
)
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The best spelling of each word and by how much it beats the key."""
    return _spellings(spark, d).select("o_custkey", "best", "margin")


@query(f"SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {_KEYED} WHERE NOT is_key QUALIFY k <= 20")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best spellings of each word, in order (a top-k report)."""
    made = _spellings(spark, d).select("o_custkey", F.posexplode("top").alias("k", "o_orderkey"))
    return made.select("o_custkey", "o_orderkey", (F.col("k") + 1).cast("long").alias("k"))


@query("SELECT l_orderkey, sum(l_quantity) - 0.5 * sum(l_discount) AS score FROM lineitem GROUP BY l_orderkey")
def pmi_score(spark: SparkSession, d: str) -> DataFrame:
    """Log probabilities with the picture less half of those without, summed over the parts of a spelling."""
    parts = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("with_picture"), F.col("l_discount").alias("without"))
    return judging.pmi(parts, "l_orderkey", "with_picture", "without").withColumnRenamed("pmi", "score")


_CHARS = "list_sort(list_distinct(list_filter(string_split({}, ''), lambda x: x <> '')))"
_CHOICES = (
    "SELECT o_orderkey AS id, translate(substr(o_orderstatus || left(o_orderpriority, 1), 1, 2), 'FOP12345', 'ABCABCDA') AS key,"
    " CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'AB' WHEN 3 THEN translate(o_orderstatus || left(o_orderpriority, 1), 'FOP12345', 'ABCABCDA') ELSE 'D' END AS seen,"
    " CASE o_orderkey % 3 WHEN 0 THEN 'exact_set' WHEN 1 THEN 'partial' ELSE 'any_correct' END AS policy FROM orders"
)


@query(
    "SELECT id, CASE WHEN len(d) = 0 THEN 'blank' WHEN k = d THEN 'correct' WHEN policy = 'any_correct' AND r > 0 AND s = 0 THEN 'correct' WHEN policy = 'partial' AND r > 0 AND s = 0 THEN 'partial' WHEN len(d) > 1 AND len(k) = 1 THEN 'multiple' ELSE 'wrong' END AS verdict FROM"
    f" (SELECT *, len(list_intersect(k, d)) AS r, len(d) - len(list_intersect(k, d)) AS s FROM (SELECT id, policy, {_CHARS.format('key')} AS k, {_CHARS.format('seen')} AS d FROM ({_CHOICES})))"
)
def choice_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Choices of every order's question against its key, under three policies."""
    o = table(spark, d, "orders")
    key = F.translate(F.concat("o_orderstatus", F.left("o_orderpriority", F.lit(1))), "FOP12345", "ABCABCDA")
    n = F.col("o_orderkey") % 5
    seen = F.when(n == 0, "").when(n == 1, "A").when(n == 2, "AB").when(n == 3, key).otherwise("D")
    m = F.col("o_orderkey") % 3
    policy = F.when(m == 0, "exact_set").when(m == 1, "partial").otherwise("any_correct")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return o.select(F.col("o_orderkey").alias("id"), answers.choice_verdict(chars(key), chars(seen), policy).alias("verdict"))


# Golden cases of mathematical answers.
PROBLEMS = [("1", "42", "number", None, 1.0), ("2", "x=5", "equation_solution", None, 2.0), ("3", "\\frac{5}{6}", "expression", None, 1.0), ("4", "7", "number", None, 1.0)]
STEPS = [("1", 0, "25+17=42"), ("2", 0, "3x+5=20"), ("2", 1, "3x=15"), ("2", 2, "Javob: x=5"), ("3", 0, "\\frac{2}{3}+\\frac{1}{6}"), ("3", 1, "\\frac{2+1}{3+6}"), ("3", 2, "\\frac{3}{9}")]


@query(
    "SELECT * FROM (VALUES ('1', 'correct', 1.0, 1.0, '25+17=42', NULL::INT, 'value'), ('2', 'correct', 2.0, 2.0, 'x=5', NULL, 'value'), ('3', 'wrong', 0.0, 1.0, '\\frac{3}{9}', 1, 'value'), ('4', 'missing', 0.0, 1.0, NULL, NULL, NULL))"
    " t(id, verdict, points_awarded, points_max, read_answer, first_wrong_step, checker)"
)
def math_golden(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame(PROBLEMS, "id string, answer string, answer_kind string, tolerance double, points double").withColumn("job_id", F.lit("j"))
    x = spark.createDataFrame(STEPS, "problem_id string, step int, text string").withColumns({"job_id": F.lit("j"), "confidence": F.lit(0.9)})
    return answers.grade_math(p, x).select("id", "verdict", "points_awarded", "points_max", "read_answer", "first_wrong_step", "checker")


def _worked(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a worked sum over the quantities of its lines; every seventh has a slip in its second step, every eleventh is left blank."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("x"), F.sum(F.col("l_quantity").cast("long")).alias("s"))
    job, box = F.col("k").cast("string"), G.box(*[F.lit(float(v)) for v in (0, 0, 100, 40)])
    terms = F.array_join(F.transform("x", lambda v: v["q"].cast("string")), " + ")
    total = F.col("s") + F.when(F.col("k") % 7 == 0, 1).otherwise(0)
    lines = li.where("k % 11 <> 0").select(
        job.alias("job_id"), F.lit("1").alias("problem_id"), F.col("s").alias("right"),
        F.posexplode(F.array(terms, F.concat(terms, F.lit(" = "), total.cast("string")), F.concat(F.lit("Javob: "), total.cast("string")))).alias("step", "text"),
    )
    problems = li.select(job.alias("job_id"), F.lit("1").alias("id"), F.col("s").cast("string").alias("answer"), F.lit("number").alias("answer_kind"), F.lit(None).cast("double").alias("tolerance"), F.lit(2.0).alias("points"))
    return answers.grade_math(problems, lines.select("job_id", "problem_id", "step", "text", F.lit(0.5).alias("confidence"), box.alias("bbox")))


@query(
    "SELECT CAST(l_orderkey AS VARCHAR) AS job_id, CASE WHEN l_orderkey % 11 = 0 THEN 'missing' WHEN l_orderkey % 7 = 0 THEN 'wrong' ELSE 'correct' END AS verdict,"
    " CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 7 = 0 THEN 0.0 ELSE 2.0 END AS points_awarded, CASE WHEN l_orderkey % 11 <> 0 AND l_orderkey % 7 = 0 THEN 1 END AS first_wrong_step, l_orderkey % 11 <> 0 AS needs_review FROM (SELECT DISTINCT l_orderkey FROM lineitem)"
)
def math_worked(spark: SparkSession, d: str) -> DataFrame:
    return _worked(spark, d).select("job_id", "verdict", "points_awarded", "first_wrong_step", "needs_review")


@query(
    "WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT kind, reason, count(*) AS n FROM (SELECT 'check' AS kind, 'correct' AS reason FROM k WHERE k % 11 <> 0 AND k % 7 <> 0 UNION ALL"
    " SELECT 'cross', 'wrong_answer' FROM k WHERE k % 11 <> 0 AND k % 7 = 0 UNION ALL SELECT 'underline', 'wrong_step' FROM k WHERE k % 11 <> 0 AND k % 7 = 0) GROUP BY kind, reason"
)
def math_marks(spark: SparkSession, d: str) -> DataFrame:
    return answers.math_marks(_worked(spark, d)).groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query(
    "SELECT l_orderkey // 1000 AS grp, sum(CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 7 = 0 THEN 0.0 ELSE 2.0 END) AS score, 2.0 * count(*) AS max_score, count(*) AS n_problems,"
    " count(*) FILTER (l_orderkey % 11 <> 0 AND l_orderkey % 7 <> 0) AS n_correct, avg(CASE WHEN l_orderkey % 11 = 0 THEN 1.0 ELSE 0.5 END) AS confidence, bool_or(l_orderkey % 11 <> 0) AS needs_review FROM (SELECT DISTINCT l_orderkey FROM lineitem) GROUP BY grp"
)
def math_cards(spark: SparkSession, d: str) -> DataFrame:
    """Totals of jobs of a thousand orders."""
    graded = _worked(spark, d).withColumn("job_id", F.floor(F.col("job_id").cast("long") / 1000))
    return answers.math_cards(graded).withColumnRenamed("job_id", "grp")


_SUM = r"(\d+) ?([-+·:]) ?(\d+) ?= ?(\d+(?:\.\d+)?)"
_LEFT, _A, _B = f"regexp_extract(m, '{_SUM}', 1)", f"CAST(regexp_extract(m, '{_SUM}', 1) AS DOUBLE)", f"CAST(regexp_extract(m, '{_SUM}', 3) AS DOUBLE)"


@query(
    f"SELECT doc_id, m, abs(CASE regexp_extract(m, '{_SUM}', 2) WHEN '+' THEN {_A} + {_B} WHEN '-' THEN {_A} - {_B} WHEN '·' THEN {_A} * {_B} ELSE {_A} / nullif({_B}, 0) END - CAST(regexp_extract(m, '{_SUM}', 4) AS DOUBLE)) <= 0.006 AS is_right"
    " FROM (SELECT doc_id, unnest(regexp_extract_all(text, '" + r"\d+ ?[-+·:] ?\d+ ?= ?\d+(?:\.\d+)?" + "')) AS m FROM documents)"
)
def sums_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every sum, product or quotient that stands in a document, and whether it's right."""
    made = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\d+ ?[-+·:] ?\d+ ?= ?\d+(?:\.\d+)?"), F.lit(0))).alias("m"))
    parts = made.select("doc_id", "m", F.trim(F.split("m", "=")[0]).alias("a"), F.trim(F.split("m", "=")[1]).alias("b"))
    return parts.select("doc_id", "m", answers.equal_answers_col(F.col("a"), F.col("b"), F.lit("number"), F.lit(0.006)).alias("is_right"))


@query(
    "SELECT o_custkey AS job_id, o_orderkey AS problem_id, 0 AS step, ord AS line_no FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE ord < n - 1"
)
def grouped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as problems, with one line less than problems."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    made = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("id"), (F.row_number().over(by) - 1).cast("long").alias("ord"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    return answers.group_lines(made.where("ord < n - 1").select("job_id", F.col("ord").alias("line_no")), made)


@query("SELECT rec_id, CASE WHEN t NOT IN ('dictation', 'math', 'mcq') OR t IS NULL THEN 'unsupported' WHEN rec_id % 2 = 0 THEN 'needs_review' ELSE 'ok' END AS status FROM (SELECT rec_id, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.request.type') END AS t FROM open_question)")
def record_statuses(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "open_question").select("rec_id", F.get_json_object("body", "$.request.type").alias("t"))
    return made.select("rec_id", answers.record_status(F.col("t"), F.col("rec_id") % 2 == 0).alias("status"))


@query()
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """How many records break each rule of their contract."""
    made = table(spark, d, "open_question").select("rec_id", contract.violations("body").alias("v"))
    return made.select("rec_id", F.explode("v").alias("v")).groupBy("v.path", "v.rule").agg(F.count("*").alias("n"))


_J = "(SELECT rec_id, CASE WHEN json_valid(body) THEN body END AS b FROM open_question)"


@query(
    "SELECT path, count(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT '{p}' AS path FROM {_J} WHERE b IS NOT NULL AND json_type(b) = 'OBJECT' AND json_type(b, '$.{o}') = 'OBJECT' AND json_type(b, '$.{p}') IS NULL"
        for p, o in (("request.job_id", "request"), ("request.image", "request"), ("request.type", "request"), ("response.status", "response"), ("response.marks", "response"), ("response.score_card", "response"), ("response.score_card.score", "response.score_card"), ("response.score_card.summary", "response.score_card"), ("response.score_card.answers", "response.score_card"))
    ) + ") GROUP BY path"
)
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    """Required fields of records that are missing at the upper levels."""
    asked = ("request.job_id", "request.image", "request.type", "response.status", "response.marks", "response.score_card", "response.score_card.score", "response.score_card.summary", "response.score_card.answers")
    made = table(spark, d, "open_question").select("rec_id", F.explode(contract.violations("body")).alias("v")).where("v.rule = 'missing'")
    return made.where(F.col("v.path").isin(*asked)).groupBy("v.path").agg(F.count("*").alias("n"))


@query("SELECT job_id, arg_max(rec_id, (received_at, rec_id)) AS rec_id, count(*) AS n_sent FROM open_question GROUP BY job_id")
def last_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Jobs sent again: the last delivery of each."""
    return table(spark, d, "open_question").groupBy("job_id").agg(F.max_by("rec_id", F.struct("received_at", "rec_id")).alias("rec_id"), F.count("*").alias("n_sent"))


@query()
def corrupted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line damaged, with the next line of the page to take words from."""
    lines = table(spark, d, "gt_line").withColumn("text", T.nfc(F.col("text"))).withColumn("next", F.lead("text").over(Window.partitionBy("file").orderBy("gi")))
    return augment.corrupted(lines, "text", "line_id", neighbour="next").select("line_id", "corrupted", "n_changes")


@query()
def corrupted_uzbek_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "gt_line").select("line_id", T.uzbek_label(F.col("text")).alias("t")).where("t is not null")
    return lines.select("line_id", augment.corrupted_uzbek("t", F.col("line_id").cast("string")).alias("c")).select("line_id", "c.*")


@query()
def rule_misspellings(spark: SparkSession, d: str) -> DataFrame:
    """Likely misspellings of the distinct words of the dictation keys."""
    w = table(spark, d, "dictation_key").select(F.explode(T.words_of(T.nfc(F.col("text")))).alias("word")).distinct()
    return w.select("word", F.explode(augment.candidates(F.col("word"))).alias("candidate"))


def _misspellings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dictation_key").select(F.explode(T.words_of(T.nfc(F.col("text")))).alias("a")).withColumn("b", augment.misspelled(F.col("a"), F.lit(3)))


@query()
def edit_stats(spark: SparkSession, d: str) -> DataFrame:
    return augment.edit_statistics(_misspellings(spark, d), "a", "b")


@query()
def sampled_edits(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "gt_line").select(F.explode(T.words_of(T.nfc(F.col("text")))).alias("word")).distinct()
    return augment.sampled_edits(words, "word", edit_stats(spark, d))


_K = "(SELECT unnest(list_filter(string_split_regex(text, '" + T.SPACE + "'), lambda w: w <> '')) AS w FROM dictation_key)"


@query(f"SELECT length(w) AS n_letters, count(*) AS cnt FROM {_K} WHERE regexp_matches(w, '^[А-Яа-я]*о[А-Яа-я]*$') AND NOT regexp_matches(w, 'а|ё|Ё|А|о.*о|О') GROUP BY n_letters")
def one_letter_edits(spark: SparkSession, d: str) -> DataFrame:
    """Words with one o and no a that are written with an a: as many edits of that kind as words."""
    w = table(spark, d, "dictation_key").select(F.explode(T.words_of(F.col("text"))).alias("w")).where(F.col("w").rlike("^[А-Яа-я]*о[А-Яа-я]*$") & ~F.col("w").rlike("а|ё|Ё|А|о.*о|О"))
    pairs = w.select("w", F.replace("w", F.lit("о"), F.lit("а")).alias("b"))
    stats = None
    for n in sorted(r[0] for r in pairs.select(F.length("w")).distinct().collect()):  # lengths of words
        part = augment.edit_statistics(pairs.where(F.length("w") == n), "w", "b").where("op = 'sub' and a = 'о' and b = 'а'").agg(F.lit(n).alias("n_letters"), F.sum("cnt").alias("cnt"))
        stats = part if stats is None else stats.unionByName(part)
    return stats if stats is not None else spark.createDataFrame([], "n_letters int, cnt long")


_R = "(SELECT unnest(string_split_regex(text, '\\s+')) AS k FROM dictation_key)"


@query(
    f"SELECT count(*) AS n, count(*) FILTER (r = s) AS kept, count(*) FILTER (r <> s AND r = k) AS corrected, count(*) FILTER (r <> s AND r <> k) AS other FROM (SELECT k, replace(k, 'о', 'а') AS s,"
    f" CASE length(k) % 3 WHEN 0 THEN replace(k, 'о', 'а') WHEN 1 THEN k ELSE k || '?' END AS r FROM {_R}) WHERE k <> s"
)
def retention_rates(spark: SparkSession, d: str) -> DataFrame:
    """Of misspelled words: how many a reading kept as written, corrected, or read as something else."""
    k = F.col("k")
    w = table(spark, d, "dictation_key").select(F.explode(F.split("text", r"\s+")).alias("k")).withColumn("s", F.replace(k, F.lit("о"), F.lit("а"))).where("k <> s")
    r = F.when(F.length(k) % 3 == 0, F.col("s")).when(F.length(k) % 3 == 1, k).otherwise(F.concat(k, F.lit("?")))
    w = w.withColumn("r", r)
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("r") == F.col("s")).alias("kept"), F.count_if((F.col("r") != F.col("s")) & (F.col("r") == k)).alias("corrected"), F.count_if((F.col("r") != F.col("s")) & (F.col("r") != k)).alias("other"))


@query()
def ctc_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each letter on the best path, and the score of the word, over made-up frame scores of words."""
    w = table(spark, d, "gt_line").select(F.explode(T.words_of(F.col("text"))).alias("word")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word in batch["word"]:
                letters = [ord(c) % 63 + 1 for c in word]
                rng = np.random.default_rng(letters)
                lp = rng.normal(0, 1, (4 * len(letters) + 2, 64))
                lp[2 + 4 * np.arange(len(letters)), letters] += 8
                lp -= np.log(np.exp(lp).sum(1, keepdims=True))
                spans = ctc_spans(lp, letters)
                rows.append((word, spans[0][0] if spans else None, spans[-1][1] if spans else None, ctc_score(lp, letters)))
            yield pd.DataFrame(rows or None, columns=["word", "first_frame", "last_frame", "score"])

    return w.mapInPandas(run, "word string, first_frame long, last_frame long, score double")


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type GROUP BY user_id")
def collapsed_path(spark: SparkSession, d: str) -> DataFrame:
    """A sequence without repeats in a row (how a best path becomes a reading), as a fold over the ordered array."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    made = table(spark, d, "events").groupBy("user_id").agg(seq.alias("s"))
    return made.select("user_id", F.array_join(F.filter("s", lambda x, i: (i == 0) | (x != F.get("s", i - 1))), ">").alias("path"))


@query(
    "SELECT user_id, count(*) FILTER (p >= 0.6) AS n_trusted, count(*) FILTER (p >= 0.6) >= greatest(1, 0.5 * count(*)) AND median(w) >= 4 AND max(w) <= 3.0 * median(w) AND min(w) >= 0.15 * median(w) AS kept"
    " FROM (SELECT user_id, (event_id % 100) / 100.0 AS p, 4 + event_id % 9 AS w FROM events) GROUP BY user_id"
)
def trusted_words(spark: SparkSession, d: str) -> DataFrame:
    """Words (here users) whose letters (events) are certain enough and of likely width."""
    letters = table(spark, d, "events").select("user_id", ((F.col("event_id") % 100) / 100.0).alias("p"), (4 + F.col("event_id") % 9).cast("double").alias("w"))
    return judging.trusted(letters, "user_id", "p", "w")


_D = "(SELECT user_id, event_id, event_type AS letter, lag(event_type, 1, '^') OVER o AS before, lead(event_type, 1, '$') OVER o AS after, 4 + event_id % 9 AS w FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"SELECT letter, before, after, count(*) AS n, min(w) AS narrowest FROM {_D} GROUP BY letter, before, after")
def donor_bank(spark: SparkSession, d: str) -> DataFrame:
    """Letters (here events of a user in order) with their neighbours."""
    bank = judging.donor_bank(table(spark, d, "events").withColumn("w", 4 + F.col("event_id") % 9), "user_id", ["ts", "event_id"], "event_type")
    return bank.groupBy(F.col("event_type").alias("letter"), "before", "after").agg(F.count("*").alias("n"), F.min("w").alias("narrowest"))


_WANT = "(SELECT l_orderkey * 10 + l_linenumber AS want_id, l_orderkey AS k, l_returnflag AS letter, l_linestatus AS before, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS after, l_quantity AS w FROM lineitem)"
_TIER = "CASE WHEN a.before = b.before AND a.after = b.after THEN 0 WHEN a.before = b.before OR a.after = b.after THEN 1 ELSE 2 END"


@query(
    f"SELECT a.want_id, arg_min(b.want_id, ({_TIER}, abs(a.w - b.w), b.want_id)) AS donor_id, min({_TIER}) AS tier FROM {_WANT} a JOIN {_WANT} b ON a.k = b.k AND a.letter = b.letter AND a.want_id <> b.want_id AND b.w BETWEEN 0.6 * a.w AND 1.6 * a.w GROUP BY a.want_id"
)
def donor_tiers(spark: SparkSession, d: str) -> DataFrame:
    """For each letter the donor of the best tier (both neighbours agree, one, none) within 0.6 to 1.6 of its width, of the same writer (here order)."""
    li = table(spark, d, "lineitem")
    bank = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("writer"), F.col("l_returnflag").alias("letter"), F.col("l_linestatus").alias("before"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("after"), F.col("l_quantity").alias("w"))
    return judging.donors(bank, bank, ["writer", "letter"], "id", "w")


@query()
def letter_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Which letters of a misspelled word differ from the right one, with their boxes, over made-up letter frames."""
    w = _misspellings(spark, d).where("a <> b").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for right, ink in zip(batch["a"], batch["b"], strict=True):
                frames = [(2 + 4 * i, 2 + 4 * i) for i in range(len(ink))]
                spans = letter_spans(frames, 4 * len(ink) + 2, 8.0, 100.0)
                rows += [(right, ink, k, a, b, *box) for k, (a, b, box) in enumerate(letter_marks(ink, right, spans, 0.0, 40.0, 8.0, 100.0))]
            yield pd.DataFrame(rows or None, columns=["a", "b", "n", "ink", "correct", "x0", "y0", "x1", "y1"])

    return w.mapInPandas(run, "a string, b string, n int, ink string, correct string, x0 double, y0 double, x1 double, y1 double")


QUERIES, ORACLE = query.queries, query.oracle
