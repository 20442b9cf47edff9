"""Queries on nested records (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import shred
from quillspan.session import table

ROOT = shred.OPEN_QUESTION
R, S = "response.", "response.score_card."


def _flat(spark: SparkSession, d: str, ancestor: str, wanted: dict[str, str], numbers: list[str], above: dict[str, str] | None = None) -> DataFrame:
    root = shred.prune(ROOT, {*wanted.values(), *(above or {}).values()})
    made = shred.shred(table(spark, d, "open_question"), "rec_id", "body", root)
    return shred.flatten(made, root, ancestor, wanted, numbers, above).withColumnRenamed("key", "rec_id")


def _table(spark: SparkSession, d: str, ancestor: str, leaves: str, numbers: list[str]) -> DataFrame:
    return _flat(spark, d, ancestor, {x: f"{ancestor}.{x}" for x in leaves.split()}, numbers)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Marks with their record's score: one pass, no join."""
    marks = _flat(spark, d, "response.marks", {"kind": R + "marks.kind", "bbox": R + "marks.bbox"}, ["mark_no"], {"score": S + "score"})
    x100 = F.coalesce(F.round(shred.number_of(F.col("score")) * 100).cast("long"), F.lit(-1).cast("long"))
    return marks.select(
        "rec_id",
        "mark_no",
        F.coalesce("kind", F.lit("")).alias("kind"),
        *[shred.box_column(F.col("bbox"), i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
        x100.alias("score_x100"),
    ).distinct()


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"job_id": R + "job_id", "status": R + "status"} | {x: S + x for x in ("score", "max_score", "summary", "confidence")}
    return _flat(spark, d, "", wanted, [])


def p4_questions(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "request.key.questions", "id question points", ["question_no"])


def p4_marks(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "response.marks", "kind bbox reason text explanation confidence line_id needs_review", ["mark_no"])


def p4_letters(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "response.marks.letters", "ink correct bbox", ["mark_no", "letter_no"])


def p4_answers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "response.score_card.answers", "id points_awarded points_max comment read_answer answer_bbox", ["answer_no"])


def p4_points(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "response.score_card.answers.required_points_hit", "point hit line_id", ["answer_no", "point_no"])


def p4_factual_errors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "response.score_card.answers.factual_errors", "text bbox why kind", ["answer_no", "error_no"])


# ---- the same in SQL: lists are unnested level by level -------------------------------------------

_BODY = (
    "(SELECT rec_id, json_merge_patch(j, json_object('response', CASE json_type(j, '$.response') WHEN 'VARCHAR' THEN json(j->>'response') ELSE j->'response' END)) AS v"
    " FROM (SELECT rec_id, body::JSON AS j FROM open_question WHERE json_valid(body)) WHERE json_type(j) = 'OBJECT')"
)
_NUM = "TRY_CAST(replace(regexp_replace({}, '[\\s\\x{{A0}}\\x{{2009}}\\x{{202F}}]', '', 'g'), ',', '.') AS DOUBLE)"


def _unnested(lists: list[str], numbers: list[str]) -> str:
    """Rows (rec_id, v, numbers) of the objects of lists in lists; one object in place of a list is a list of one."""
    rows = f"(SELECT rec_id, v FROM {_BODY})"
    for k, (path, n) in enumerate(zip(lists, numbers, strict=True)):
        x = f"v->'$.{path}'"
        made = f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] ELSE [] END"
        above = "".join(f", {m}" for m in numbers[:k])
        rows = f"(SELECT rec_id{above}, {n}, l[{n}] AS v, v AS up FROM (SELECT rec_id{above}, v, l, unnest(range(1, len(l) + 1)) AS {n} FROM (SELECT rec_id{above}, v, {made} AS l FROM {rows})) WHERE json_type(l[{n}]) = 'OBJECT')"
    return rows


def _leaf(path: str, name: str) -> str:
    x = f"v->'$.{path}'"
    if path.endswith("bbox"):
        one = lambda i, k: f"coalesce({x}->>'$[{i}]', {x}->>'$.{k}', '')"
        parts = " || '|' || ".join(one(i, k) for i, k in enumerate(("x0", "y0", "x1", "y1")))
        return f"CASE WHEN json_type({x}) IN ('ARRAY', 'OBJECT') THEN {parts} END AS {name}"
    return f"CASE WHEN json_type({x}) NOT IN ('NULL', 'ARRAY', 'OBJECT') THEN v->>'$.{path}' END AS {name}"


def _select(lists: list[str], numbers: list[str], leaves: str) -> str:
    return "SELECT " + ", ".join(["rec_id", *numbers, *[_leaf(x, x.rsplit(".", 1)[-1]) for x in leaves.split()]]) + f" FROM {_unnested(lists, numbers)}"


_MARKS, _ANSWERS = "response.marks", "response.score_card.answers"
_SCORE = "(SELECT rec_id, v->>'$.response.score_card.score' AS score FROM " + _BODY + ")"
ORACLE = {
    "p4_found": "SELECT rec_id, mark_no, coalesce(kind, '') AS kind, "
    + ", ".join(f"coalesce(CAST(floor({_NUM.format(f'string_split(bbox, chr(124))[{i}]')} + 0.5) AS BIGINT), -1) AS {c}" for i, c in enumerate(("x0", "y0", "x1", "y1"), 1))
    + f", coalesce(CAST(round({_NUM.format('score')} * 100) AS BIGINT), -1) AS score_x100 FROM ({_select([_MARKS], ['mark_no'], 'kind bbox')}) JOIN {_SCORE} USING (rec_id)",
    "p4_records": _select([], [], "response.job_id response.status response.score_card.score response.score_card.max_score response.score_card.summary response.score_card.confidence"),
    "p4_questions": _select(["request.key.questions"], ["question_no"], "id question points"),
    "p4_marks": _select([_MARKS], ["mark_no"], "kind bbox reason text explanation confidence line_id needs_review"),
    "p4_letters": _select([_MARKS, "letters"], ["mark_no", "letter_no"], "ink correct bbox"),
    "p4_answers": _select([_ANSWERS], ["answer_no"], "id points_awarded points_max comment read_answer answer_bbox"),
    "p4_points": _select([_ANSWERS, "required_points_hit"], ["answer_no", "point_no"], "point hit line_id"),
    "p4_factual_errors": _select([_ANSWERS, "factual_errors"], ["answer_no", "error_no"], "text bbox why kind"),
}
QUERIES = {f.__name__: f for f in (p4_found, p4_records, p4_questions, p4_marks, p4_letters, p4_answers, p4_points, p4_factual_errors)}
