"""Controlled misspellings, decided by hashes of row, word and seed, so that every run and every engine layout gives the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quillspan.functions import text as T
from quillspan.functions.geometry import let
from quillspan.functions.kernels import edit_events
from quillspan.functions.uzbek import corrupted_line

# Letters that pupils write for one another, letters whose doubling is no error, spellings after a hissing letter,
# the ending that is written with and without a soft sign, and the alphabet of one-letter changes.
CONFUSED = {"о": "а", "а": "о", "е": "и", "и": "е", "я": "е", "б": "п", "п": "б", "в": "ф", "ф": "в", "г": "к", "к": "г", "д": "т", "т": "д", "ж": "ш", "ш": "ж", "з": "с", "с": "з"}
VOWELS, SIGNS, NEVER_DOUBLED = "аоеиуыэюя", "ьъ", "ьъй"
HISSING = {"жи": "жы", "ши": "шы", "ча": "чя", "ща": "щя", "чу": "чю", "щу": "щю"}
SOFT, HARD = "ться", "тся"
ALPHABET = "абвгдежзийклмнопрстуфхцчшщъыьэюя"


def chance(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / 1_000_003


def below(n: Column, *parts: Column) -> Column:
    """A whole number from 0 to n - 1 that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.greatest(n, F.lit(1)).cast("long")).cast("int")


def _spots(word: Column, first: int, last: Column) -> Column:
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def rule_misspellings(word: Column) -> Column:
    """Words that a rule of spelling confuses with ``word`` (small letters), distinct and in order."""
    return let(word, _rules)


def _rules(word: Column) -> Column:
    n = F.length(word)
    at = lambda i: F.substr(word, i + 1, F.lit(1))
    head, tail = (lambda i: F.left(word, i)), (lambda i: F.right(word, n - i))
    among = lambda c, letters: F.contains(F.lit(letters), c)
    swap = F.create_map(*[F.lit(x) for pair in CONFUSED.items() for x in pair])
    everywhere, inner, later = _spots(word, 0, n - 1), _spots(word, 1, n - 2), _spots(word, 1, n - 1)
    no_vowel = lambda i: ~among(at(i), VOWELS)
    none = F.lit(None).cast("string")
    found = F.concat(
        F.transform(everywhere, lambda i: F.concat(head(i), F.try_element_at(swap, at(i)), tail(i + 1))),
        F.transform(later, lambda i: F.when(no_vowel(i) & (at(i - 1) == at(i)), F.concat(head(i), tail(i + 1)))),
        F.transform(later, lambda i: F.when(no_vowel(i) & (at(i - 1) != at(i)) & ~among(at(i), NEVER_DOUBLED), F.concat(head(i), at(i), tail(i)))),
        F.transform(everywhere, lambda i: F.when(among(at(i), SIGNS), F.concat(head(i), tail(i + 1)))),
        F.transform(inner, lambda i: F.when(n > 4, F.concat(head(i), tail(i + 1)))),
        F.array(
            F.when(F.contains(word, F.lit(SOFT)), F.replace(word, F.lit(SOFT), F.lit(HARD))).when(F.contains(word, F.lit(HARD)), F.replace(word, F.lit(HARD), F.lit(SOFT))),
            *[F.when(F.contains(word, F.lit(a)), F.regexp_replace(word, f"^(.*?){a}", f"$1{b}")) for a, b in HISSING.items()],
            none,
        ),
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != word))))


def one_edit_neighbours(word: Column, alphabet: str = ALPHABET) -> Column:
    """All words one insertion, deletion, replacement or exchange of neighbours away."""
    n = F.length(word)
    exchanged = F.transform(_spots(word, 0, n - 2), lambda i: F.concat(F.left(word, i), F.substr(word, i + 2, F.lit(1)), F.substr(word, i + 1, F.lit(1)), F.right(word, n - i - 2)))
    return F.array_remove(F.array_distinct(F.concat(T.one_edit_words(word, alphabet), exchanged)), word)


def _parts(word: Column) -> tuple[Column, Column, Column]:
    """What stands before the letters of a (composed) word, its letters, and what stands after them."""
    w = T.fold_yo(word)
    return F.regexp_extract(w, r"^([^\p{L}]*)", 1), F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""), F.regexp_extract(w, r"\p{L}([^\p{L}]*)$", 1)


def _taken_apart(word: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of struct<word, before, core, after, low>."""
    before, core, after = _parts(word)
    return let(F.struct(word.alias("word"), before.alias("before"), core.alias("core"), after.alias("after"), F.lower(core).alias("low")), body)


def _in_drawn_order(low: Column) -> Column:
    """Misspellings by rule, in an order drawn from the word."""
    return F.transform(F.array_sort(F.transform(_rules(low), lambda c: F.struct(F.xxhash64(low, c).alias("k"), c.alias("c")))), lambda x: x["c"])


def _dressed(w: Column, core: Column) -> Column:
    """A misspelling of small letters with the word's capital and signs."""
    capital = F.left(w["core"], F.lit(1)) != F.lower(F.left(w["core"], F.lit(1)))
    return F.concat(w["before"], F.when(capital, F.concat(F.upper(F.left(core, F.lit(1))), F.substring(core, 2, 1 << 30))).otherwise(core), w["after"])


def candidates(word: Column, read: Column | None = None, most: int = 10, wide: bool = False) -> Column:
    """Likely misspellings with the word's signs and capital: by rule in an order drawn from the word, then (``wide``) the other
    words one edit away; at most ``most`` of them (0: all), and what was read, if it's another word of letters. Words are composed."""

    def made(w: Column) -> Column:
        found = _in_drawn_order(w["low"])
        if wide:
            found = let(found, lambda rules: F.concat(rules, F.array_sort(F.array_except(one_edit_neighbours(w["low"]), rules))))
        return F.transform(F.slice(found, 1, most) if most > 0 else found, lambda c: _dressed(w, c))

    cased = _taken_apart(word, made)
    if read is None:
        return cased
    other = T.word_core(T.fold_yo(read))
    p = T._cls(T.PUNCTUATION)
    stripped = F.regexp_replace(read, rf"^[{p}]+|[{p}]+$", "")
    before, core, after = _parts(word)
    return F.when(other.rlike(r"^\p{L}+$") & (other != F.lower(core)), F.concat(cased, F.array(F.concat(before, stripped, after)))).otherwise(cased)


def misspelled(word: Column, *by: Column, wide: float = 0.2) -> Column:
    """One likely misspelling, signs kept: of the first twelve by rule, or in a share ``wide`` of cases any change of one letter.
    Words of fewer than three letters, and words no rule applies to, stay."""

    def any_change(w: Column) -> Column:
        core, n = w["core"], F.length(w["core"])
        place, letter = below(n, w["word"], *by, F.lit(3)), F.substr(F.lit(ALPHABET), below(F.lit(len(ALPHABET)), w["word"], *by, F.lit(4)) + 1, F.lit(1))
        kind = below(F.lit(len(ALPHABET) * 2 + 2), w["word"], *by, F.lit(5))
        head, tail, here = F.left(core, place), F.right(core, n - place - 1), F.substr(core, place + 1, F.lit(1))
        cased = F.when(here != F.lower(here), F.upper(letter)).otherwise(letter)
        changed = (
            F.when(kind < len(ALPHABET), F.concat(head, letter, here, tail))
            .when(kind < 2 * len(ALPHABET), F.concat(head, cased, tail))
            .when(kind == 2 * len(ALPHABET), F.concat(head, tail))
            .otherwise(F.concat(head, F.substr(core, place + 2, F.lit(1)), here, F.right(core, n - place - 2)))
        )
        return let(changed, lambda c: F.when(F.lower(c) == w["low"], w["word"]).otherwise(F.concat(w["before"], c, w["after"])))

    def by_rule(w: Column) -> Column:
        pick = lambda few: F.when(F.size(few) == 0, w["word"]).otherwise(_dressed(w, F.get(few, below(F.size(few), w["word"], *by, F.lit(1)))))
        return let(F.slice(_in_drawn_order(w["low"]), 1, 12), pick)

    return F.when(F.length(T.word_core(word)) < 3, word).otherwise(_taken_apart(word, lambda w: F.when(chance(w["word"], *by, F.lit(2)) < wide, any_change(w)).otherwise(by_rule(w))))


def corrupted(
    lines: DataFrame, text: str, row: str, out: str = "corrupted", *, rate: float = 0.25, edges: float = 0.3, neighbour: str | None = None, least: int = 1, seed: int = 0
) -> DataFrame:
    """Add a damaged text and ``n_changes``.

    Of the words a share ``rate`` is damaged: misspelled (70 percent), left out (12), exchanged with the next (8), followed by a
    stray word of the text (5), or changed in the case of the first letter (5). In a share ``edges`` of texts of more than
    three words one or two words at an end are cut off, or one or two words of ``neighbour`` are put there. A text with fewer than ``least``
    changes has one more word damaged. Null stays null with no changes.
    """
    s, r = F.lit(seed), F.col(row)
    w = "__words"
    word = lambda i: F.get(w, i)
    draw = lambda i: chance(r, i, s)
    how = lambda i: chance(r, i, s, F.lit("kind"))
    # one letter a word: m misspelled, d left out, s exchanged with the next, e stray word after it, c case, k kept
    kinds = F.transform(
        w,
        lambda x, i: F.when(~x.rlike(r"\p{L}") | (draw(i) >= rate), "k").when(how(i) < 0.70, "m").when(how(i) < 0.82, "d").when(how(i) < 0.90, "s").when(how(i) < 0.95, "e").otherwise("c"),
    )
    flip = lambda x: F.concat(F.when(F.left(x, F.lit(1)) == F.lower(F.left(x, F.lit(1))), F.upper(F.left(x, F.lit(1)))).otherwise(F.lower(F.left(x, F.lit(1)))), F.substring(x, 2, 1 << 30))
    df = lines.withColumn(w, T.words_of(F.col(text)))
    # a word that is exchanged takes the next with it, from left to right; the last has no next and gets a stray word
    df = df.withColumn("__kinds", F.split(F.regexp_replace(F.regexp_replace(F.array_join(kinds, ""), "s(.)", "sx"), "s$", "e"), ""))
    pairs = F.transform(F.arrays_zip(F.col(w).alias("w"), F.slice(w, 2, 1 << 30).alias("next"), F.col("__kinds").alias("k")), lambda p, i: F.struct(p["w"].alias("w"), p["next"].alias("next"), p["k"].alias("k"), i.alias("i")))
    made = F.flatten(
        F.transform(
            F.filter(pairs, lambda p: p["w"].isNotNull()),
            lambda p: F.when(p["k"] == "m", F.array(misspelled(p["w"], r, p["i"], s)))
            .when(p["k"].isin("d", "x"), F.array().cast("array<string>"))
            .when(p["k"] == "s", F.array(p["next"], p["w"]))
            .when(p["k"] == "e", F.array(p["w"], word(below(F.size(w), r, p["i"], s, F.lit("stray")))))
            .when(p["k"] == "c", F.array(flip(p["w"])))
            .otherwise(F.array(p["w"])),
        )
    )
    df = df.withColumn("__made", made).withColumn("__n", F.size(F.filter("__kinds", lambda k: k.isin("m", "d", "s", "e", "c"))))
    m, size = F.col("__made"), F.size("__made")
    cut = 1 + below(F.lit(2), r, s, F.lit("cut"))
    side = chance(r, s, F.lit("side"))
    edge = (size > 3) & (chance(r, s, F.lit("edge")) < edges)
    shorter = F.slice(m, F.when(side < 0.4, cut + 1).otherwise(1), F.greatest(size - cut, F.lit(0)))
    if neighbour is None:
        glued = m
    else:
        other = T.words_of(F.coalesce(F.col(neighbour), F.lit("")))
        n_other = F.least(cut, F.size(other))
        before = F.slice(other, F.size(other) - n_other + 1, n_other)
        glued = F.when(F.size(other) == 0, m).when(chance(r, s, F.lit("end")) < 0.5, F.concat(before, m)).otherwise(F.concat(m, F.slice(other, 1, n_other)))
    df = df.withColumn("__made", F.when(edge & (side < 0.8), shorter).when(edge, glued).otherwise(m)).withColumn("__n", F.col("__n") + F.when(edge, 1).otherwise(0))
    usable = F.filter(F.transform(m, lambda x, i: F.when(x.rlike(r"\p{L}"), i)), lambda i: i.isNotNull())
    at = F.get(usable, below(F.size(usable), r, s, F.lit("more")))
    short = (F.col("__n") < least) & (F.size(usable) > 0)
    worse = misspelled(F.get("__made", at), r, s, F.lit("more"), wide=0.0)
    # a word that can't be misspelled is left out, or changes its case if it's the only one
    one_more = F.when(worse != F.get("__made", at), F.transform(m, lambda x, i: F.when(i == at, worse).otherwise(x))).when(size > 1, F.filter(m, lambda x, i: i != at)).otherwise(F.transform(m, flip))
    return (
        df.withColumn("__made", F.when(short, one_more).otherwise(m))
        .withColumn("n_changes", F.when(F.col(text).isNull(), 0).otherwise(F.col("__n") + F.when(short, 1).otherwise(0)))
        .withColumn(out, F.array_join("__made", " "))
        .drop("__words", "__kinds", "__made", "__n")
    )


@F.pandas_udf(StructType([StructField("corrupted", StringType()), StructField("n_changes", IntegerType())]))
def corrupted_uzbek(text: pd.Series, row: pd.Series) -> pd.DataFrame:
    """A line of normalised Uzbek text with one or two words misspelled as learners do, and the number of changes; drawn from the row's key."""
    made = [(None, 0) if t is None else corrupted_line(t, str(k)) for t, k in zip(text, row, strict=True)]
    return pd.DataFrame(made or None, columns=["corrupted", "n_changes"])


def edit_statistics(pairs: DataFrame, correct: str, written: str) -> DataFrame:
    """(op, a, b, place, cnt): how misspelled words differ from the right ones, by tenth of the word; place is null for longer changes.

    Words are compared without signs at their ends, in small letters, ye for yo; equal and empty ones don't count. Tasks count first.
    """
    core = lambda c: T.fold_yo(T.word_core(F.col(c)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, int] = {}
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                for e in edit_events(a, b):
                    total[e] = total.get(e, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in total.items()] or None, columns=["op", "a", "b", "place", "cnt"])

    words = pairs.select(core(correct).alias("a"), core(written).alias("b")).where("a <> '' and b <> '' and a <> b")
    return words.mapInPandas(count, "op string, a string, b string, place double, cnt long").groupBy("op", "a", "b", "place").agg(F.sum("cnt").alias("cnt"))


def sampled_edits(words: DataFrame, word: str, stats: DataFrame, *by: str, seed: int = 0) -> DataFrame:
    """(word, *by, op, place, letter, edited): one edit of each word, drawn with the weights of ``stats`` (op, a, b, cnt).

    A word's edits are those of its letters: one for another, left out (words of four letters and more), doubled, one put in
    after it. A word without any gives no row. Statistics have one row an edit of letters, so at most a few thousand;
    words meet them by letter, and a word's edits are summed in its own group.
    """
    known = stats.where("op <> 'complex'").groupBy("op", "a", "b").agg(F.sum("cnt").alias("cnt"))
    keys = [word, *by]
    letters = words.select(*keys).distinct().withColumn("low", F.lower(word)).select(*keys, "low", F.posexplode(F.split("low", "")).alias("place", "a"))
    options = letters.join(F.broadcast(known), "a").where((F.col("op") != "del") | (F.length("low") >= 4))  # by letters of an alphabet
    order = Window.partitionBy(*keys).orderBy("place", "op", "b")
    whole = Window.partitionBy(*keys)
    drawn = options.withColumn("upto", F.sum("cnt").over(order)).withColumn("r", F.floor(chance(*[F.col(k) for k in keys], F.lit(seed)) * F.sum("cnt").over(whole)))
    return drawn.where("upto - cnt <= r and r < upto").select(
        *keys, "op", "place", F.when(F.col("op") == "del", "").otherwise(F.col("b")).alias("letter"), T.apply_edit(F.col(word), F.col("op"), F.col("place"), F.col("b")).alias("edited")
    )
