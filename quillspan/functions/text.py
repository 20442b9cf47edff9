"""Text functions on columns. All are null for null; a text is never cut."""

from __future__ import annotations

import html
import random
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

# Fixed values that results depend on: punctuation glued to the word before, word characters with inner signs,
# the seven apostrophe signs and the letters of Uzbek labels.
PUNCTUATION = ".,;:!?—–-«»\"'()…"
WORD = r"[\p{L}\p{N}_]+(?:[-'’ʼ`][\p{L}\p{N}_]+)*"
APOSTROPHES = "‘’`´'ʻʼ"
UZBEK_ALLOWED = r"A-Za-z0-9 .,!?:;()\-%\"«»“”–—№/+=ʻʼ"
SOFT_HYPHEN = "\u00ad"
# How a line says that it's the answer, signs of handwritten mathematics and their spelling, what is left
# out of a formula, and a number with a unit.
ANSWER = r"^\s*(?:javob|жавоб|ответ|answer|j|о)\s*[:=]\s*"
MATH_SIGNS = (("×", "*"), ("·", "*"), ("∙", "*"), ("÷", "/"), ("−", "-"), ("–", "-"), ("√", "sqrt"), ("²", "^2"), ("³", "^3"), ("π", "pi"))
MATH_DROPPED = ("\\left", "\\right", "\\,", "\\ ", "$")
UNIT = r"^\s*([-+]?\d+(?:[.,]\d+)?)\s*([a-zA-Zа-яА-Я/²³^0-9·\s]*)\s*$"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition (Spark has no built-in for it)."""
    return pd.Series([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in texts], dtype=object)


def fold_yo(text: Column) -> Column:
    return F.translate(text, "ёЁ", "еЕ")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{85}\x{1C}-\x{1F}]+|[\s\p{Z}\x{85}\x{1C}-\x{1F}]+$", "")


def scored_form(text: Column) -> Column:
    """The form in which lines are scored: composed, ye for yo, no soft hyphens, runs of blanks and tabs as one blank."""
    return strip(F.regexp_replace(F.replace(fold_yo(nfc(text)), F.lit(SOFT_HYPHEN), F.lit("")), r"[ \t]+", " "))


def word_core(word: Column) -> Column:
    """A word in small letters without punctuation at its ends."""
    p = _cls(PUNCTUATION)
    return F.regexp_replace(F.lower(word), rf"^[{p}]+|[{p}]+$", "")


def _cls(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


TOKEN_HEAD = rf"^(?:{WORD}|[^\p{{L}}\p{{N}}_\s])"


def token_pattern() -> str:
    """A word, or a sign that isn't punctuation, with the punctuation after it."""
    p = _cls(PUNCTUATION)
    return rf"(?:{WORD}|[^\p{{L}}\p{{N}}_\s\p{{Z}}{p}])(?:[\s\p{{Z}}]*[{p}])*"


def token_array(text: Column) -> Column:
    """array<struct<text, punct_after>>: words in order, each with the punctuation that follows it.

    A sign outside PUNCTUATION is a word; punctuation before the first word is left out. One regular expression finds word
    and trailing signs together, so no fold over the tokens is needed.
    """
    one = token_pattern()
    head = TOKEN_HEAD
    return F.transform(
        F.regexp_extract_all(text, F.lit(one), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, head, 0).alias("text"),
            F.regexp_replace(F.regexp_replace(m, head, ""), r"[\s\p{Z}]+", "").alias("punct_after"),
        ),
    )


#: white space of any script and kind
SPACE = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]+"


def words_of(text: Column) -> Column:
    """Words split at white space of any kind."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def char_error_rate(ref: Column, hyp: Column) -> Column:
    """Edits over the length of the reference; 0 or 1 for an empty reference."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def uzbek_label(text: Column) -> Column:
    """Official apostrophes in Uzbek Latin text; null where a sign is a quotation mark or a character isn't allowed.

    A sign after o or g, or at the start of the text, is the letter mark; between two letters it's the tutuq.
    """
    a = _cls(APOSTROPHES)
    t = F.translate(nfc(text), "\u00a0", " ")
    t = F.regexp_replace(t, rf"^[{a}]|(?<=[oOgG])[{a}]", "ʻ")
    t = F.regexp_replace(t, r"(?<=[\p{L}])[%s](?=[\p{L}%s])" % (_cls("‘’`´'"), a), "ʼ")
    quoted = t.rlike(f"[{_cls('‘’`´')}']") | t.rlike(r"(?<![\p{L}])ʼ|ʼ(?![\p{L}])")
    s = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(~quoted & s.rlike("[a-zA-Z]") & ~s.rlike(f"[^{UZBEK_ALLOWED}]"), s)


def math_form(text: Column) -> Column:
    """Handwritten-like mathematics in one spelling: ASCII operators, decimal points, division by a slash."""
    s = F.regexp_replace(F.trim(text), f"(?iu){ANSWER}", "")
    for a, b in MATH_SIGNS:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"(?<=\d),(?=\d)", ".")
    s = F.regexp_replace(s, r"(?<=\d)\s*:\s*(?=\d)", "/")
    for a in MATH_DROPPED:
        s = F.replace(s, F.lit(a), F.lit(""))
    return F.regexp_replace(F.trim(s), r"[.;]+$", "")


def accepted_forms(answer: Column) -> Column:
    """The forms of an answer, which double bars separate."""
    return F.filter(F.transform(F.split(answer, r"\|\|"), lambda a: F.trim(a)), lambda a: a != "")


def unit_value(text: Column) -> Column:
    """struct<value, unit> of a number with a unit; null if it isn't one."""
    v = F.replace(F.regexp_extract(text, UNIT, 1), F.lit(","), F.lit("."))
    return F.when(text.rlike(UNIT), F.struct(v.cast("double").alias("value"), F.lower(F.regexp_replace(F.regexp_extract(text, UNIT, 2), r"\s+", "")).alias("unit")))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Entities of any name or number as characters (Spark has no built-in for it)."""
    return pd.Series([t if t is None or "&" not in t else html.unescape(t) for t in texts], dtype=object)


def strip_html(page: Column) -> Column:
    """Text of a page: tags are blanks, entities and hard blanks are read."""
    t = unescaped(F.regexp_replace(page, r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(F.translate(t, "\u00a0", " "), r"[ \t]+", " "))


def strip_thinking(text: Column) -> Column:
    """A model's answer without its thinking part."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def answer_json(text: Column, schema: str) -> Column:
    """What a model answered in JSON, read by ``schema``: the outermost braces of what is left without the thinking part; null if there are none."""
    return F.from_json(F.nullif(F.regexp_extract(strip_thinking(text), r"(?s)\{.*\}", 0), F.lit("")), schema)


def is_linear_ascii(label: Column) -> Column:
    """Whether a formula is one line of plain characters: no commands, fractions, roots or raised and lowered parts."""
    return label.rlike(r"^[0-9a-zA-Z+\-*/=().,:<> ]+$")


def rounded(number: Column, digits: int = 3) -> Column:
    """Rounded by the exact binary value, ties to the even neighbour (built-in rounding goes by the shortest decimal)."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, digits), na_action="ignore")

    return run(number)


def grounded_lines(text: Column, width: Column, height: Column) -> Column:
    """array<struct<text, x0, y0, x1, y1>> of tagged output whose coordinates run from 0 to 999."""
    tag = r"<\|ref\|>(.*?)<\|/ref\|><\|det\|>\[\[(\d+), ?(\d+), ?(\d+), ?(\d+)\]\]<\|/det\|>"
    part = lambda m, i: F.regexp_extract(m, tag, i)
    px = lambda m, i, size: part(m, i).cast("double") / 999 * size
    return F.transform(
        F.regexp_extract_all(text, F.lit(tag), F.lit(0)),
        lambda m: F.struct(part(m, 1).alias("text"), px(m, 2, width).alias("x0"), px(m, 3, height).alias("y0"), px(m, 4, width).alias("x1"), px(m, 5, height).alias("y1")),
    )


def wrapped(text: Column, *by: Column, least: int = 20, most: int = 68) -> Column:
    """array<string>: a paragraph's words in chunks, each wrapped at a length drawn from ``least`` + 8 to ``most``; chunks of ``least`` to ``most`` characters are kept."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(texts, keys, strict=True):
            if t is None:
                out.append(None)
                continue
            rng, chunks, open_ = random.Random(k), [], ""
            goal = rng.randint(least + 8, most)
            for w in t.split():
                longer = f"{open_} {w}" if open_ else w
                if open_ and len(longer) > goal:
                    chunks.append(open_)
                    open_, goal = w, rng.randint(least + 8, most)
                else:
                    open_ = longer
            out.append([c for c in [*chunks, open_] if least <= len(c) <= most])
        return pd.Series(out, dtype=object)

    return run(text, F.concat_ws("-", *[b.cast("string") for b in by]))


def one_edit_words(word: Column, alphabet: str) -> Column:
    """All words one insertion, deletion or replacement away."""
    n = F.length(word)
    letters = F.array(*[F.lit(c) for c in alphabet])
    head = lambda i: F.left(word, i)
    tail = lambda i: F.expr("''") if i is None else F.right(word, n - i)
    places = F.sequence(F.lit(0), n)
    inserted = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i)))))
    spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    replaced = F.flatten(F.transform(spots, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i + 1)))))
    deleted = F.transform(spots, lambda i: F.concat(head(i), tail(i + 1)))
    return F.array_remove(F.array_distinct(F.concat(inserted, replaced, deleted)), word)


def apply_edit(word: Column, op: Column, place: Column, letter: Column) -> Column:
    """One edit at a place from 0: ``sub``, ``del``, ``dbl`` or ``ins`` (after the place). A replacement keeps the case."""
    n = F.length(word)
    here = F.substr(word, place + 1, F.lit(1))
    cased = F.when(here != F.lower(here), F.upper(letter)).otherwise(letter)
    head, tail = F.left(word, place), F.right(word, n - place - 1)
    return (
        F.when(op == "sub", F.concat(head, cased, tail))
        .when(op == "del", F.concat(head, tail))
        .when(op == "dbl", F.concat(head, here, here, tail))
        .when(op == "ins", F.concat(head, here, letter, tail))
        .otherwise(word)
    )


def prompt(domain: Column, verbatim: Column, key: Column) -> Column:
    """The tag line of a reading task; the key comes first if there is one."""
    return F.concat(
        F.when(key.isNotNull() & (key != ""), F.concat(F.lit("key: "), key, F.lit("\n"))).otherwise(""),
        F.concat(F.lit("["), domain, F.when(verbatim, "|verbatim").otherwise(""), F.lit("]")),
    )
