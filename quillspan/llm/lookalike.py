"""Text that looks the same in other characters (problem 5).

Three forms of a text are defined here:

* ``skeleton`` -- ignorable characters deleted, widths folded, canonical composition applied and every
  letter replaced by the representative of its look-alike class. Two texts look the same exactly when
  their skeletons are equal.
* ``consistent form`` -- the skeleton with every class letter read in one script: each token is a lattice
  with one arc per look-alike, searched with Viterbi under character bigram scores of each script and a
  price for changing script. The lattice depends on the skeleton alone, so equal skeletons get equal forms.
* ``compare key`` -- the form without letter case and without the dots of yo. The classes are closed under
  letter case for it, hence the key doesn't depend on which look-alike the search picked and is computed
  straight from the skeleton.

Null stays null and an empty text stays empty in all three. Texts are processed whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.skew import often, spread_join
from quillspan.session import written

LATIN, CYRILLIC, GREEK = 0, 1, 2

# Letters with the same upright drawing, as Latin, Cyrillic, Greek ("." = none).
LOOKALIKES = """
A А Α|B В Β|C С Ϲ|E Е Ε|H Н Η|I І Ι|J Ј Ϳ|K К Κ|M М Μ|N . Ν|O О Ο|P Р Ρ|S Ѕ .|T Т Τ|X Х Χ|Y Ү Υ|Z . Ζ
a а .|c с ϲ|d ԁ .|e е .|h һ .|i і .|j ј ϳ|o о ο|p р .|q ԛ .|s ѕ .|w ԝ .|x х .|y у .
. Г Γ|. П Π|. Ф Φ
"""
# The seven apostrophe signs, and the hyphens of other code points.
APOSTROPHES = "‘’`´'ʻʼ"
HYPHENS = "‐‑﹣－"
# Letters that differ in drawing but are the small forms of one capital drawing.
CASE_CLOSURE = "вb нh тt мm кk βb ηh ιi κk μm νn ρp τt υy χx ζz αa εe үy γг πп φф"

CLASSES = [tuple(x.split()) for line in LOOKALIKES.split("\n") for x in line.split("|") if x]
#: letter -> (letter of each script or "."), under the representative that skeletons use
READINGS: dict[str, tuple[str, ...]] = {next(c for c in cls if c != "."): cls for cls in CLASSES}
REPRESENTATIVE = {c: rep for rep, cls in READINGS.items() for c in cls if c != "."}
BLANKS = "\t\n\v\f\r\x85\u2028\u2029\u2800"


def _invisible() -> dict[int, str | None]:
    """Characters without ink are deleted, every blank is a space, wide and narrow forms are ordinary ones."""
    out: dict[int, str | None] = {}
    for cp in (*range(0x3000), *range(0x3000, 0x3001), *range(0xFE00, 0x10000), *range(0xE0000, 0xE0200)):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs" or c in BLANKS:
            out[cp] = " "
        elif kind in ("Cf", "Cc") or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5) or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0100 <= cp < 0xE01F0:
            out[cp] = None
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            out[cp] = unicodedata.normalize("NFKC", c)
    out |= {ord(c): "-" for c in HYPHENS}
    out |= {ord(c): "'" for c in APOSTROPHES}
    out[0x20] = " "
    return {k: v for k, v in out.items() if v is None or v != chr(k)}


def _classes() -> dict[int, str]:
    """Class letters, and composed letters on one, as the representative with its marks apart."""
    out = {ord(c): rep for c, rep in REPRESENTATIVE.items() if c != rep}
    for cp in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in REPRESENTATIVE:
            out[cp] = REPRESENTATIVE[parts[0]] + parts[1:]
    return out


INVISIBLE, CLASS_TABLE = _invisible(), _classes()
_MARK = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a]")


def _composed(text: str) -> str:
    text = text.translate(INVISIBLE)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def skeleton(text: str | None) -> str | None:
    """What is drawn, without regard to which look-alike draws it."""
    return None if text is None else _composed(text).translate(CLASS_TABLE)


def _key_table() -> dict[int, str | None]:
    """INVISIBLE, CLASS_TABLE, lower case, yo and the case closure in one table."""
    fold = {ord(p[0]): p[1] for p in CASE_CLOSURE.split()}
    out: dict[int, str | None] = dict(INVISIBLE)
    for cp in (*range(0x41, 0x530), *range(0x531, 0x590), *range(0x10A0, 0x1100), *range(0x1C80, 0x1CC0), *range(0x1E00, 0x2000), *range(0xFF00, 0xFF5F)):
        c = INVISIBLE.get(cp, chr(cp))
        if c:
            low = c.translate(CLASS_TABLE).lower().translate(CLASS_TABLE).translate(fold).replace("ë", "e")
            if low != chr(cp):
                out[cp] = low
    return out


KEY_TABLE = _key_table()


def compare_key(text: str | None) -> str | None:
    """Consistent form without letter case, with yo as ye. Blanks are kept one for one."""
    if text is None:
        return None
    if text.isascii():
        return text.translate(KEY_TABLE)
    if _MARK.search(text) or not unicodedata.is_normalized("NFC", text):
        text = _composed(text)
    return text.translate(KEY_TABLE)


SEPARATOR = 0x10FFFF
_DELETE, _MULTI = 0xFFFFFFFF, 0xFFFFFFFE


@lru_cache(maxsize=1)
def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """KEY_TABLE as an array over all code points, and which code points make words."""
    keys = np.arange(0x110000, dtype=np.uint32)
    for cp, v in KEY_TABLE.items():
        keys[cp] = _DELETE if not v else ord(v) if len(v) == 1 else _MULTI
    wordy = np.zeros(0x110000, dtype=bool)
    cps = (*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200))
    wordy[list(cps)] = [chr(cp).isalnum() for cp in cps]
    return keys, wordy


def key_codes(texts: list[str | None]) -> np.ndarray:
    """Compare keys of a batch as code points, with SEPARATOR between the texts; null counts as empty."""
    keys, _ = _code_tables()
    ready = []
    for t in texts:
        if not t:
            ready.append("")
        elif t.isascii():
            ready.append(t)
        else:
            t = t.replace(chr(SEPARATOR), " ")
            ready.append(_composed(t) if _MARK.search(t) or not unicodedata.is_normalized("NFC", t) else t)
    codes = np.frombuffer(chr(SEPARATOR).join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)
    mapped = keys[codes]
    if (mapped == _MULTI).any():
        mult = np.unique(np.searchsorted(np.flatnonzero(codes == SEPARATOR), np.flatnonzero(mapped == _MULTI)))
        for i in mult:
            ready[i] = compare_key(ready[i])
        mapped = keys[np.frombuffer(chr(SEPARATOR).join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)]
    return mapped[mapped < _MULTI]


def keys_of(texts: list[str | None]) -> list[str]:
    """Compare keys of a batch."""
    return key_codes(texts).tobytes().decode("utf-32-le", "surrogatepass").split(chr(SEPARATOR))


_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch as (number of the text, 64-bit hash of the word), in reading order.

    A word is a run of letters and digits with single apostrophes inside; a word broken by a hyphen and
    blanks is whole.
    """
    global _POWERS
    if not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    _, wordy = _code_tables()
    codes = key_codes(texts)
    is_word = wordy[codes]
    hyphens = np.flatnonzero(codes[:-1] == 45)
    hyphens = hyphens[(hyphens > 0) & (codes[np.minimum(hyphens + 1, len(codes) - 1)] == 32)]
    # an apostrophe beside the break stands inside the word that is made whole
    hyphens = hyphens[is_word[hyphens - 1] | ((hyphens > 1) & (codes[hyphens - 1] == 39) & is_word[hyphens - 2])]
    if len(hyphens):
        drop = np.zeros(len(codes), dtype=bool)
        for h in hyphens.tolist():
            end = h + 1
            while end < len(codes) and codes[end] == 32:
                end += 1
            if end < len(codes) and (is_word[end] or (codes[end] == 39 and end + 1 < len(codes) and is_word[end + 1])):
                drop[h:end] = True
        codes, is_word = codes[~drop], is_word[~drop]
    quotes = np.flatnonzero(codes == 39)
    quotes = quotes[(quotes > 0) & (quotes < len(codes) - 1)]
    inside = quotes[is_word[quotes - 1] & is_word[quotes + 1]]
    is_word = is_word.copy()
    is_word[inside] = True
    edges = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    lengths = ends - starts
    if lengths.max() > len(_POWERS):
        _POWERS = np.cumprod(np.full(int(lengths.max()) * 2, 0x9E3779B97F4A7C15, dtype=np.uint64))
    at = np.flatnonzero(is_word)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    mixed = codes[at].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    h = np.add.reduceat(mixed * _POWERS[place], first)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    text_no = np.searchsorted(np.flatnonzero(codes == SEPARATOR), starts)
    return text_no, h


_BROKEN = re.compile(r"(?<=[^\W_])('?)-\s+(?='?[^\W_])")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def words(text: str | None) -> list[str]:
    """Words of the compare key: letters and digits with apostrophes inside, a word broken by a hyphen made whole."""
    key = compare_key(text)
    if not key:
        return []
    if "- " in key:
        key = _BROKEN.sub(r"\1", key)
    return _WORD.findall(key)


# ---- the lattice search -------------------------------------------------------------------------

_TOKEN = re.compile("[^\\W\\d_](?:['\u0300-\u036f]*[^\\W\\d_])*[\u0300-\u036f]*")
#: letters that only one script can draw count towards that script
SWITCH_IN_WORD, SWITCH_BETWEEN_WORDS, FLOOR = 12.0, 1.5, math.log(1e-4)


@lru_cache(maxsize=4096)
def _script(c: str) -> int:
    cp = ord(c)
    if 0x400 <= cp < 0x530 or 0x1C80 <= cp < 0x1C90:
        return CYRILLIC
    return GREEK if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000 else LATIN


class ScriptReader:
    """Reads skeletons in one script a word; ``bigrams`` maps script -> {two letters: log probability}."""

    def __init__(self, bigrams: dict[int, dict[str, float]]):
        self.bigrams, self.memo, self.runs = bigrams, {}, {}
        self.scores: np.ndarray | None = None

    def _step(self, script: int, a: str, b: str) -> float:
        return self.bigrams.get(script, {}).get((a + b).lower(), FLOOR)

    def lattice(self, token: str) -> tuple[str, int, bool]:
        """The best reading of a token, its main script, and whether a letter of the token decides the script."""
        best: dict[int, tuple[float, str, str]] = {}
        decided, first = False, True
        for c in token:
            arcs = READINGS.get(c)
            options = [(s, x) for s, x in enumerate(arcs) if x != "."] if arcs else None
            if options is None:
                if not c.isalpha():
                    best = {s: (p, out + c, last) for s, (p, out, last) in best.items()}
                    continue
                options = [(_script(c), c)]
                decided = True
            if first:
                best, first = {s: (self._step(s, "^", x), x, x) for s, x in options}, False
                continue
            # of equal paths the one from the script that comes first
            steps = {s: max((p - SWITCH_IN_WORD * (q != s) + self._step(s, last, x), -q) for q, (p, _, last) in best.items()) for s, x in options}
            best = {s: (steps[s][0], best[-steps[s][1]][1] + x, x) for s, x in options}
        script, (_, out, _) = max(best.items(), key=lambda kv: (kv[1][0], -kv[0]))
        return out, script, decided

    def _tables(self) -> None:
        """Scores of pairs as an array (script, letter before, letter) over the letters that occur in pairs, ``^``, and one for any other letter."""
        self.place = {c: i for i, c in enumerate(sorted({c for pairs in self.bigrams.values() for pair in pairs for c in pair} | {"^"}))}
        n = len(self.place)
        self.scores = np.full((3, n + 1, n + 1), FLOOR)
        for script, pairs in self.bigrams.items():
            for pair, p in pairs.items():
                self.scores[script, self.place[pair[0]], self.place[pair[1]]] = p
        self.kinds: dict[str, int] = {}
        self.open: list[list[bool]] = []
        self.letters: list[list[int]] = []
        self.to_script = [{ord(rep): cls[k] for rep, cls in READINGS.items() if cls[k] != "."} for k in range(3)]

    def _kind(self, c: str) -> int:
        """The number of a letter: in which scripts it can be read, and as which letter of the score table."""
        got = self.kinds.get(c)
        if got is None:
            arcs = READINGS.get(c) or [c if k == _script(c) else "." for k in range(3)]
            self.open.append([x != "." for x in arcs])
            self.letters.append([self.place.get(x.lower(), len(self.place)) for x in arcs])
            got = self.kinds[c] = len(self.kinds)
        return got

    def learn(self, tokens: Iterable[str]) -> None:
        """Search the lattices of many tokens at once, those of one length together."""
        if self.scores is None:
            self._tables()
        if len(self.memo) > 500_000:
            self.memo.clear()
        by_length: dict[int, list[tuple[str, list[int]]]] = {}
        for t in tokens:
            if t not in self.memo:
                kinds = [self._kind(c) for c in t if c in READINGS or c.isalpha()]
                by_length.setdefault(len(kinds), []).append((t, kinds))
        open_, letters, start = np.array(self.open), np.array(self.letters), self.place["^"]
        scripts = np.arange(3)
        price = SWITCH_IN_WORD * (scripts[:, None] != scripts[None, :])
        for n, group in by_length.items():
            kinds = np.array([k for _, k in group])
            here = letters[kinds[:, 0]]
            score = np.where(open_[kinds[:, 0]], self.scores[scripts, start, here], -np.inf)
            back = []
            for j in range(1, n):
                before, here = here, letters[kinds[:, j]]
                step = self.scores[scripts[None, None, :], before[:, :, None], here[:, None, :]]
                paths = score[:, :, None] - price[None] + step
                back.append(paths.argmax(1))
                score = np.where(open_[kinds[:, j]], paths.max(1), -np.inf)
            at = score.argmax(1)
            path = [at]
            for b in reversed(back):
                path.append(b[np.arange(len(at)), path[-1]])
            path = np.stack(path[::-1], 1)
            single = (path == path[:, :1]).all(1)
            for i, (t, _) in enumerate(group):
                script = int(at[i])
                if single[i]:
                    out = t.translate(self.to_script[script])
                else:
                    out = self._spelled(t, path[i].tolist())
                self.memo[t] = out, script, any(c not in READINGS and c.isalpha() for c in t)

    @staticmethod
    def _spelled(token: str, path: list[int]) -> str:
        """The token with each letter read in its script."""
        out, k = [], 0
        for c in token:
            if c in READINGS:
                out.append(READINGS[c][path[k]])
            else:
                out.append(c)
            k += c in READINGS or c.isalpha()
        return "".join(out)

    def pure(self, token: str) -> list[tuple[float, str] | None]:
        """A token of class letters only: its reading in each script, or None where a letter isn't there."""
        out = []
        for s in range(3):
            last, p, text = "^", 0.0, ""
            for c in token:
                arcs = READINGS.get(c)
                if arcs is None:
                    text += c
                    continue
                if arcs[s] == ".":
                    break
                p, text, last = p + self._step(s, last, arcs[s]), text + arcs[s], arcs[s]
            else:
                out.append((p, text))
                continue
            out.append(None)
        return out

    def _run(self, left: int | None, run: tuple[str, ...], right: int | None) -> list[str]:
        """Viterbi over neighbouring tokens that no letter decides, between their decided neighbours."""
        best: dict[int, tuple[float, list[str]]] | None = None
        for token in run:
            options = [(s, r) for s, r in enumerate(self.pure(token)) if r] or [(s, (0.0, t)) for t, s, _ in [self.lattice(token)]]
            here = {}
            for s, (p, text) in options:
                if best is None:
                    here[s] = (p - SWITCH_BETWEEN_WORDS * 4 * (left is not None and left != s), [text])
                else:
                    q, before = max(((q - SWITCH_BETWEEN_WORDS * 4 * (t != s), b) for t, (q, b) in best.items()), key=lambda x: x[0])
                    here[s] = (p + q, [*before, text])
            best = here
        return max(best.items(), key=lambda kv: (kv[1][0] - SWITCH_BETWEEN_WORDS * 4 * (right is not None and right != kv[0]), -kv[0]))[1][1]

    def read(self, skel: str | None) -> str | None:
        """The consistent form of a skeleton."""
        if skel is None:
            return None
        memo, spans, pending = self.memo, [], []
        script = None
        replaced: list[str] = []
        where: list[tuple[int, int]] = []

        def flush(right: int | None) -> None:
            nonlocal pending
            if pending:
                run = (script, tuple(t for t, _ in pending), right)
                got = self.runs.get(run)
                if got is None:
                    if len(self.runs) > 200_000:
                        self.runs.clear()
                    got = self.runs[run] = self._run(*run)
                for (_, k), text in zip(pending, got, strict=True):
                    replaced[k] = text
                pending = []

        for m in _TOKEN.finditer(skel):
            token = m.group()
            got = memo.get(token)
            if got is None:
                got = memo[token] = self.lattice(token)
            where.append(m.span())
            replaced.append(got[0])
            if got[2]:
                flush(got[1])
                script = got[1]
            else:
                pending.append((token, len(replaced) - 1))
        flush(None)
        at = 0
        for (a, b), text in zip(where, replaced, strict=True):
            spans += (skel[at:a], text)
            at = b
        return unicodedata.normalize("NFC", "".join(spans) + skel[at:])


#: the letters whose pairs are counted: three alphabets, so at most a quarter of a million pairs
ALPHABETS = {LATIN: ((0x41, 0x250), (0x1E00, 0x1F00)), CYRILLIC: ((0x400, 0x530), (0x1C80, 0x1C90)), GREEK: ((0x370, 0x400), (0x1F00, 0x2000))}
_OTHER, _INSIDE, _BREAK, _START = 3, 4, 5, 0x10FFFE


@lru_cache(maxsize=1)
def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x3000: the alphabet of a letter (others by what they do to a word), and its small letter."""
    kind = np.full(0x3001, _BREAK, np.int8)
    small = np.arange(0x3001, dtype=np.int64)
    for cp in range(0x3000):
        c = chr(cp)
        if c.isalpha():
            kind[cp] = next((s for s, spans in ALPHABETS.items() if any(a <= cp < b for a, b in spans)), _OTHER)
            small[cp] = ord(c.lower()) if len(c.lower()) == 1 else cp
        elif c == "'" or 0x300 <= cp <= 0x36F:
            kind[cp] = _INSIDE
    kind[0x3000] = _OTHER  # any letter above
    return kind, small


def _pairs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring letters of words written in one script, as script, letter, letter in one number, and how often each is.
    Apostrophes and marks inside a word don't part its letters."""
    kind_of, small_of = _letter_tables()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.minimum(codes, 0x3000)
    kind = kind_of[codes]
    at = np.flatnonzero(kind <= _OTHER)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parted = np.cumsum(kind == _BREAK)[at]
    new = np.append(True, parted[1:] != parted[:-1])
    word = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    script = kind[at].astype(np.int64)
    low, high = np.minimum.reduceat(script, starts), np.maximum.reduceat(script, starts)
    pure = ((low == high) & (low != _OTHER))[word]
    letter = small_of[codes[at]]
    before = np.where(new, _START, np.append(_START, letter[:-1]))
    return np.unique(((script << 42) | (before << 21) | letter)[pure], return_counts=True)


def count_bigrams(texts: DataFrame, column: str) -> DataFrame:
    """Letter pairs of the words written in one script: (script, pair, n), over all rows; ``^`` stands before the first letter.

    Each task counts its rows first, so the shuffle carries one row a distinct pair and task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, int] = {}
        for batch in batches:
            pairs, n = _pairs_of([_composed(t) for t in batch[column] if t])
            for p, k in zip(pairs.tolist(), n.tolist(), strict=True):
                total[p] = total.get(p, 0) + k
        name = lambda x: "^" if x == _START else chr(x)
        if total:
            yield pd.DataFrame([(p >> 42, name((p >> 21) & 0x1FFFFF) + name(p & 0x1FFFFF), n) for p, n in total.items()], columns=["script", "pair", "n"])

    return (
        texts.select(column).mapInPandas(count, "script int, pair string, n long").groupBy("script", "pair").agg(F.sum("n").alias("n"))
    )


def train_reader(texts: DataFrame, column: str) -> dict[int, dict[str, float]]:
    """Bigram log probabilities of each script, from all rows; the pairs are those of three alphabets."""
    rows = count_bigrams(texts, column).collect()  # bounded by the alphabets
    before: dict[tuple[int, str], int] = {}
    for r in rows:
        before[r.script, r.pair[0]] = before.get((r.script, r.pair[0]), 0) + r.n
    out: dict[int, dict[str, float]] = {}
    for r in rows:
        out.setdefault(r.script, {})[r.pair] = math.log(r.n / before[r.script, r.pair[0]] * 0.999 + 1e-4)
    return out


def consistent_form(texts: DataFrame, column: str, out: str = "form", skeleton_as: str | None = None, trained_on: DataFrame | None = None) -> DataFrame:
    """Add the consistent form (and the skeleton) of ``column``; the bigram scores are trained on all rows of ``texts`` or of ``trained_on``."""
    model = texts.sparkSession.sparkContext.broadcast(train_reader(texts if trained_on is None else trained_on, column))
    cell: list[ScriptReader] = []

    @F.pandas_udf(T.StructType([T.StructField("f", T.StringType()), T.StructField("s", T.StringType())]))
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not cell:
            cell.append(ScriptReader(model.value))
        for batch in batches:
            skels = [skeleton(t) for t in batch]
            cell[0].learn({t for s in skels if s for t in _TOKEN.findall(s)})
            yield pd.DataFrame({"f": [cell[0].read(s) for s in skels], "s": skels})

    made = "__quillspan_form"
    df = texts.withColumn(made, read(F.col(f"`{column}`")))
    df = df.withColumn(out, F.col(f"{made}.f"))
    if skeleton_as:
        df = df.withColumn(skeleton_as, F.col(f"{made}.s"))
    return df.drop(made)


@F.pandas_udf(T.StringType())
def compare_key_col(texts: pd.Series) -> pd.Series:
    """Column form of ``compare_key``."""
    return pd.Series([compare_key(t) for t in texts], dtype=object)


def squeezed_key(text: str | None) -> str | None:
    """Compare key with white space runs as one blank and the ends trimmed."""
    key = compare_key(text)
    return None if key is None else " ".join(key.split())


@F.pandas_udf(T.StringType())
def squeezed_key_col(texts: pd.Series) -> pd.Series:
    """Column form of ``squeezed_key``."""
    return pd.Series([squeezed_key(t) for t in texts], dtype=object)


@F.pandas_udf(T.BinaryType())
def skeleton_hash(texts: pd.Series) -> pd.Series:
    """128 bits of the skeleton."""
    return pd.Series([None if t is None else hashlib.blake2b(skeleton(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], dtype=object)


def same_look_pairs(rows: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """Pairs (id_a < id_b) of rows whose texts look the same but are other code points; with ``within``, of rows that agree in that
    column, which stays as ``within``.

    The form is a function of the skeleton, so a text whose skeleton no other text has can't be in a pair; the rest are
    read, by a model of all rows, and grouped by consistent form. A pair of different texts is expanded to rows, so copies
    are never paired with each other. Forms, texts and pairs that are frequent are split over tasks. Null texts, null
    keys and null ``within`` give no pair; a repeated row counts once.
    """
    group = F.lit("") if within is None else F.col(f"`{within}`").cast("string")
    source = rows.select(group.alias("w"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where("w is not null and id is not null and text is not null")
    drawn = written(source.select("w", "id", "text", skeleton_hash("text").alias("s"), F.md5(F.concat_ws("\n", "w", "text")).alias("t")).distinct())
    # one row a text first, so a skeleton of many copies is counted by a handful of rows
    shared = drawn.select("w", "s", "t").distinct().groupBy("w", "s").agg(F.count("*").alias("k")).where("k > 1").select("w", "s")
    alike = drawn.join(shared, ["w", "s"], "left_semi")
    h = written(consistent_form(alike, "text", trained_on=source).select("w", "id", F.md5(F.concat_ws("\n", "w", "form")).alias("f"), "t"))
    texts = written(h.select("w", "f", "t").distinct())
    crowded = often(texts, "f")
    one, two = texts.select("w", "f", F.col("t").alias("ta")), texts.select("f", F.col("t").alias("tb"))
    pairs = written(spread_join(one, two, "f", "ta", "tb", left_often=crowded, right_often=crowded).where("ta < tb").select("w", "ta", "tb"))
    copied = often(h, "t")
    rows_of = lambda t, i: h.select(F.col("t").alias(t), F.col("id").alias(i))
    half = written(spread_join(pairs, rows_of("ta", "ia"), "ta", "tb", "ia", right_often=copied.withColumnRenamed("t", "ta")).select("w", "tb", "ia"))
    both = spread_join(half, rows_of("tb", "ib"), "tb", "ia", "ib", right_often=copied.withColumnRenamed("t", "tb"))
    made = both.select(F.col("w").alias("within"), F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).where("id_a < id_b").distinct()
    return made.drop("within") if within is None else made
