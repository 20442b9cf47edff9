"""Mathematical and multiple-choice answers against their keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from quillspan.functions import text as T
from quillspan.operators import algebra


CHECKED = StructType([StructField("ok", BooleanType()), StructField("checker", StringType())])


@F.pandas_udf(CHECKED)
def checked_answer_col(read: pd.Series, expected: pd.Series, kind: pd.Series, tolerance: pd.Series) -> pd.DataFrame:
    """struct<ok, checker>: whether an answer equals one of the accepted forms, and by what it was decided; null fields where either is null."""
    rows = [
        (None, None) if r is None or e is None else algebra.check_answer(r, e, k or "expression", None if pd.isna(t) else t)
        for r, e, k, t in zip(read, expected, kind, tolerance, strict=True)
    ]
    return pd.DataFrame({"ok": pd.Series([x[0] for x in rows], dtype=object), "checker": pd.Series([x[1] for x in rows], dtype=object)})


def equal_answers_col(read: Column, expected: Column, kind: Column, tolerance: Column) -> Column:
    """Null where either answer is null."""
    return checked_answer_col(read, expected, kind, tolerance)["ok"]


@F.pandas_udf(IntegerType())
def first_wrong_step_col(steps: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or len(s) < 2 else algebra.first_wrong_step([x or "" for x in s]) for s in steps], dtype="Int32")


def group_lines(lines: DataFrame, problems: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(job_id, problem_id, step, line_no): the lines of each problem.

    ``given`` (job_id, problem_id, line_nos array) says which; without it the i-th line belongs to the i-th problem.
    ``lines`` has (job_id, line_no), ``problems`` (job_id, id, ord), both from 0. A line number that doesn't exist gives no row.
    """
    if given is None:
        return problems.select("job_id", F.col("id").alias("problem_id"), F.col("ord").alias("line_no")).join(lines.select("job_id", "line_no"), ["job_id", "line_no"]).select("job_id", "problem_id", F.lit(0).alias("step"), "line_no")
    asked = given.select("job_id", "problem_id", F.posexplode("line_nos").alias("step", "line_no"))
    return asked.join(lines.select("job_id", "line_no"), ["job_id", "line_no"]).select("job_id", "problem_id", "step", "line_no")


def grade_math(problems: DataFrame, lines: DataFrame, review_below: float = 0.6) -> DataFrame:
    """One row a problem: job_id, id, verdict, points_awarded, points_max, read_answer, read_steps, first_wrong_step,
    checker, confidence, needs_review, answer_bbox, wrong_bbox.

    ``problems``: job_id, id, answer, answer_kind, tolerance, points and, if partial credit is given from outside,
    partial_points; ``lines``: job_id, problem_id, step, text, bbox, confidence. The answer is the last line that says so,
    else the last that isn't blank; its confidence (0.9 if none is given) counts.
    """
    if "bbox" not in lines.columns:
        lines = lines.withColumn("bbox", F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>"))
    steps = lines.groupBy("job_id", F.col("problem_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("step", "text", "confidence", "bbox"))).alias("lines"))
    said = F.filter("lines", lambda x: x["text"].rlike(f"(?iu){T.ANSWER}"))
    written = F.filter("lines", lambda x: F.trim(x["text"]) != "")
    answer = F.coalesce(F.get(said, F.size(said) - 1), F.get(written, F.size(written) - 1))
    df = problems.join(steps, ["job_id", "id"], "left").withColumn("said", answer).withColumn("read_steps", F.transform("lines", lambda x: x["text"]))
    df = df.withColumn("read_answer", F.trim(F.regexp_replace("said.text", f"(?iu){T.ANSWER}", "")))
    df = df.withColumn("c", checked_answer_col("read_answer", "answer", "answer_kind", "tolerance")).withColumn("wrong_step", first_wrong_step_col(F.when(~F.col("c.ok"), F.col("read_steps"))))
    points = F.coalesce("points", F.lit(1.0))
    partial = F.least(points, F.coalesce("partial_points", F.lit(0.0))) if "partial_points" in problems.columns else F.lit(0.0)
    missing, ok = F.col("read_answer").isNull(), F.col("c.ok")
    confidence = F.when(missing, 1.0).otherwise(F.coalesce("said.confidence", F.lit(0.9)))
    return df.select(
        "job_id", "id",
        F.when(missing, "missing").when(ok, "correct").when(partial > 0, "partial").otherwise("wrong").alias("verdict"),
        F.when(missing, 0.0).when(ok, points).otherwise(partial).alias("points_awarded"),
        points.alias("points_max"), "read_answer", F.coalesce("read_steps", F.array().cast("array<string>")).alias("read_steps"),
        F.col("wrong_step").alias("first_wrong_step"), F.col("c.checker").alias("checker"),
        confidence.alias("confidence"), (~missing & (confidence < review_below)).alias("needs_review"),
        F.col("said.bbox").alias("answer_bbox"), F.get("lines", F.col("wrong_step"))["bbox"].alias("wrong_bbox"),
    )


def math_marks(graded: DataFrame) -> DataFrame:
    """(job_id, id, kind, reason, bbox, confidence, needs_review): a check or a cross at each answer, an underline at each first wrong step."""
    mark = lambda kind, reason, box: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), box.alias("bbox"))
    answer, ok = F.col("answer_bbox"), F.col("verdict") == "correct"
    marks = F.array(
        F.when(answer.isNotNull() & ok, mark("check", "correct", answer)),
        F.when(answer.isNotNull() & F.col("verdict").isin("wrong", "partial"), mark("cross", "wrong_answer", answer)),
        F.when(F.col("wrong_bbox").isNotNull(), mark("underline", "wrong_step", F.col("wrong_bbox"))),
    )
    return graded.select("job_id", "id", "confidence", "needs_review", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).select("job_id", "id", "m.*", "confidence", "needs_review")


def math_cards(graded: DataFrame) -> DataFrame:
    """One row a job: score, max_score, n_problems, n_correct, confidence (mean), needs_review."""
    return graded.groupBy("job_id").agg(
        F.sum("points_awarded").alias("score"), F.sum("points_max").alias("max_score"), F.count("*").alias("n_problems"),
        F.count_if(F.col("verdict") == "correct").alias("n_correct"), F.avg("confidence").alias("confidence"), F.max("needs_review").alias("needs_review"),
    )


def record_status(kind: Column, needs_review: Column) -> Column:
    """Status of a response: types that nothing grades are unsupported."""
    return F.when(~F.coalesce(kind.isin("dictation", "math", "mcq"), F.lit(False)), "unsupported").when(needs_review, "needs_review").otherwise("ok")


def grade_choices(questions: DataFrame, policy: str = "exact_set", changed: str = "invalid") -> DataFrame:
    """Add verdict, points_awarded and needs_review to (key, detected, points, and optionally first_detected: what was chosen
    before it was crossed out).

    ``policy`` exact_set, any_correct or partial (points by share of the key); ``changed`` last_mark_wins, or invalid: a changed answer
    is ambiguous.
    """
    moved = F.coalesce(F.size("first_detected") > 0, F.lit(False)) & (F.array_sort("first_detected") != F.array_sort("detected")) if "first_detected" in questions.columns else F.lit(False)
    verdict = choice_verdict(F.col("key"), F.col("detected"), F.lit(policy))
    if changed == "invalid":
        verdict = F.when(moved, "ambiguous").otherwise(verdict)
    points = F.coalesce("points", F.lit(1.0))
    share = F.size(F.array_intersect("key", "detected")) / F.greatest(F.size(F.array_distinct("key")), F.lit(1))
    return questions.withColumn("verdict", verdict).withColumns(
        {
            "points_awarded": F.when(F.col("verdict") == "correct", points).when(F.col("verdict") == "partial", points * share).otherwise(0.0),
            "needs_review": F.col("verdict").isin("ambiguous", "multiple"),
        }
    )


def choice_cards(graded: DataFrame, job: str = "job_id") -> DataFrame:
    """One row a job: score, max_score, n_correct, n_questions, needs_review."""
    return graded.groupBy(job).agg(
        F.sum("points_awarded").alias("score"), F.sum(F.coalesce("points", F.lit(1.0))).alias("max_score"), F.count_if(F.col("verdict") == "correct").alias("n_correct"), F.count("*").alias("n_questions"), F.max("needs_review").alias("needs_review"),
    )


def last_criteria(rows: DataFrame, job: str, name: str, place: Column, points: str, most: str) -> DataFrame:
    """(job, name, place, points, most): criteria that are given more than once count once, with their last points at their first place."""
    return rows.groupBy(job, name).agg(F.min(place).alias("place"), F.max_by(F.struct(points, most), place).alias("v")).select(job, name, "place", F.col(f"v.{points}").alias("points"), F.col(f"v.{most}").alias("most"))


def criteria_totals(last: DataFrame, job: str) -> DataFrame:
    """(job, n_criteria, score, max_score); criteria without points count nought."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    return last.groupBy(job).agg(F.count("*").alias("n_criteria"), total("points").alias("score"), total("most").alias("max_score"))


def choice_verdict(key: Column, detected: Column, policy: Column) -> Column:
    """blank, correct, partial or wrong of a question's letters; ``policy``: exact_set, any_correct or partial."""
    k, d = F.array_sort(F.array_distinct(key)), F.array_sort(F.array_distinct(detected))
    right = F.size(F.array_intersect(k, d))
    stray = F.size(F.array_except(d, k))
    return (
        F.when(d.isNull() | (F.size(d) == 0), "blank")
        .when(k == d, "correct")
        .when((policy == "any_correct") & (right > 0) & (stray == 0), "correct")
        .when((policy == "partial") & (right > 0) & (stray == 0), "partial")
        .when((F.size(d) > 1) & (F.size(k) == 1), "multiple")
        .otherwise("wrong")
    )
