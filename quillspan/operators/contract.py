"""Records against a contract. A contract is a table of shapes; a record's violations come out with their paths, in order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Fixed values of the contract. A line is a shape: name, shapes it includes, and its fields; ``!`` is required. Kinds: text, number,
# whole, truth, share (0 to 1), box (four numbers from 0), a list of alternatives, [kind], {kind} for values by key, >=n<=m limits, +kind for
# a list of one at least, =x for a constant, or another shape.
SHAPES = """
mark: kind! check|cross|underline|circle|insert|strike|margin_note; bbox! box; reason! text; text text; explanation text; confidence share; line_id text; needs_review truth; verdict error|review|ok; letters [letter]
letter: ink! text; correct! text; bbox! box
line: id! text; text! text; bbox! box; confidence! share; words [word]
word: text! text; bbox! box; confidence share
card: score! number; max_score! number; school_grade text; summary! text; confidence! share; needs_review truth
image: uri! text; page whole>=1; dpi whole
options: strictness lenient|normal|strict; return_transcript truth
request: job_id! text; type! dictation|math|mcq|retelling|open_question; image! image; language uz|ru|en|mixed; script latin|cyrillic|mixed; grade_level whole>=1<=11; subject text; teacher_language uz|ru|en|mixed; options options
response: job_id! text; type! dictation|math|mcq|retelling|open_question; status! ok|needs_review|unsupported|error; transcript [line]; marks! [mark]; score_card! card; marked_image_uri text; error text
dictation.request < request: type =dictation; key! dictation.key
dictation.key: text! text; kind words|sentences|paragraph; grading_scale text; count_punctuation truth; ignore_case truth
dictation.response < response: type =dictation; score_card! dictation.card
dictation.card < card: errors! [slip]; n_spelling! whole; n_punctuation! whole; n_words_expected! whole; n_words_read! whole; coverage share
slip: kind! spelling|missing_word|extra_word|punctuation_missing|punctuation_extra|punctuation_wrong|capitalization|word_order; expected! text; written! text; bbox! box; line_id text; confidence share; needs_review truth
math.request < request: type =math; key! math.key
math.key: problems! +problem; layout_hint drills|worked|masala|physics
problem: id! text; statement text; answer! text; answer_kind number|expression|equation_solution|set|interval|text|unit_value; tolerance number; points number; partial_credit truth
math.response < response: type =math; score_card! math.card
math.card < card: problems! [result]
result: id! text; verdict! correct|partial|wrong|missing|unreadable; points_awarded! number; points_max! number; read_answer text; read_steps [text]; answer_bbox box; first_wrong_step whole; reason text; confidence share; needs_review truth
mcq.request < request: type =mcq; key! mcq.key
mcq.key: answers! {+text}; options [text]; layout inline_circled|answer_grid|bubble_sheet; points_per_question number; multi_answer_policy exact_set|any_correct|partial; changed_answer_policy last_mark_wins|invalid
mcq.response < response: type =mcq; score_card! mcq.card
mcq.card < card: questions! [choice]; n_correct! whole; n_questions! whole
choice: question! text; detected! [text]; expected! [text]; verdict! correct|wrong|blank|multiple|ambiguous; bbox box; confidence share; needs_review truth
retelling.request < request: type =retelling; key! retelling.key
retelling.key: source_text! text; key_points [text]; rubric! +criterion; min_words whole
criterion: id! text; name! text; description text; max_points! number
retelling.response < response: type =retelling; score_card! retelling.card
retelling.card < card: criteria! [criterion_score]; key_points_covered! [covered]; n_words! whole; language_errors [slip]; feedback_for_teacher text
criterion_score: id! text; points! number; max_points! number; comment! text; evidence_line_ids [text]; confidence share
covered: point! text; covered! truth; line_id text
open_question.request < request: type =open_question; key! open_question.key
open_question.key: questions! +question
question: id! text; question text; model_answer text; required_points [text]; points! number; rubric [criterion]
open_question.response < response: type =open_question; score_card! open_question.card
open_question.card < card: answers! [answer]; feedback_for_teacher text
answer: id! text; read_answer text; answer_bbox box; points_awarded! number; points_max! number; required_points_hit [hit]; factual_errors [factual]; comment! text; confidence share; needs_review truth
hit: point! text; hit! truth; line_id text
factual: text! text; bbox! box; why! text
"""
TYPES = ("dictation", "math", "mcq", "retelling", "open_question")


class Contract:
    """Shapes by name: fields with their kinds, the fields of included shapes first."""

    def __init__(self, text: str):
        self.shapes: dict[str, dict[str, tuple[bool, str]]] = {}
        for line in filter(None, text.split("\n")):
            head, fields = line.split(": ", 1)
            name, _, base = head.partition(" < ")
            shape = dict(self.shapes.get(base, {}))
            for field in fields.split("; "):
                key, kind = field.split(" ", 1)
                shape[key.rstrip("!")] = (key.endswith("!") or shape.get(key, (False,))[0], kind)
            self.shapes[name] = shape

    def broken(self, value: object, kind: str, path: str) -> Iterator[tuple[str, str]]:
        """(path, rule) of what is wrong; list places are left out of a path."""
        limits = {}
        for sign in ("<=", ">="):
            if sign in kind:
                kind, _, limits[sign] = kind.partition(sign)
        if kind in self.shapes:
            yield from self.object(value, kind, path)
        elif kind == "box":
            if not isinstance(value, list) or len(value) != 4:
                yield path, "not four numbers"
            elif not all(_is_number(x) and x >= 0 for x in value):
                yield path, "not numbers from 0"
        elif kind[0] in "[+":
            if not isinstance(value, list):
                yield path, "not a list"
            else:
                if kind[0] == "+" and not value:
                    yield path, "empty"
                for x in value:
                    yield from self.broken(x, kind.strip("[]+"), path)
        elif kind[0] == "{":
            if not isinstance(value, dict):
                yield path, "not an object"
            else:
                for x in value.values():
                    yield from self.broken(x, kind.strip("{}"), path)
        elif kind[0] == "=":
            if value != kind[1:]:
                yield path, f"not {kind[1:]}"
        elif kind in ("number", "whole", "share"):
            if not _is_number(value) or (kind == "whole" and value != int(value)):
                yield path, "not a whole number" if kind == "whole" else "not a number"
            elif (kind == "share" and not 0 <= value <= 1) or (">=" in limits and value < float(limits[">="])) or ("<=" in limits and value > float(limits["<="])):
                yield path, "out of range"
        elif kind == "truth":
            if not isinstance(value, bool):
                yield path, "not true or false"
        elif kind == "text":
            if not isinstance(value, str):
                yield path, "not a text"
        elif value not in kind.split("|"):
            yield path, "unknown"

    def object(self, value: object, shape: str, path: str) -> Iterator[tuple[str, str]]:
        if not isinstance(value, dict):
            yield path, "not an object"
            return
        for key, (required, kind) in self.shapes[shape].items():
            here = f"{path}.{key}" if path else key
            if key in value:
                yield from self.broken(value[key], kind, here)
            elif required:
                yield here, "missing"


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


CONTRACT = Contract(SHAPES)


def broken_rules(body: str | None) -> list[tuple[str, str]] | None:
    """Sorted distinct (path, rule) of a record with request and response; None if it isn't a JSON object.

    The request's type says which contract holds; an unknown type is checked by what all share.
    """
    try:
        record = json.loads(body or "")
    except ValueError:
        return None
    if not isinstance(record, dict):
        return None
    request = record.get("request")
    kind = request.get("type") if isinstance(request, dict) else None
    found = set()
    for part in ("request", "response"):
        if part not in record:
            found.add((part, "missing"))
        else:
            found.update(CONTRACT.broken(record[part], f"{kind}.{part}" if kind in TYPES else part, part))
    response = record.get("response")
    if isinstance(request, dict) and isinstance(response, dict) and response.get("job_id") != request.get("job_id"):
        found.add(("response.job_id", "differs"))
    return sorted(found)


RULES = ArrayType(StructType([StructField("path", StringType()), StructField("rule", StringType())]))


@F.pandas_udf(RULES)
def violations(body: pd.Series) -> pd.Series:
    """array<struct<path, rule>>; null for what isn't a JSON object."""
    return pd.Series([None if (v := broken_rules(b)) is None else [{"path": p, "rule": r} for p, r in v] for b in body], dtype=object)


def external(rows: DataFrame) -> DataFrame:
    """Rows without what is for internal use only."""
    return rows.drop("provenance")
