"""Personal information inside free text (problem 8).

``find_items`` locates e-mail addresses, phone numbers, identity numbers, street addresses and names of
persons; ``redact`` puts a typed placeholder in the place of each. A placeholder carries a pseudonym: numbers
are permuted by a keyed Feistel network within their own format (digits stay digits, letters stay letters of their alphabet,
separators stay; a number with a right check keeps a right check, and the date in it is permuted among valid dates), other values get a keyed token of 128 bits, so equal values have equal pseudonyms in all documents,
however they are written, and nothing else of the text changes.

A text is read as it looks: characters without ink are skipped, wide forms are ordinary ones, a letter drawn
by another script's look-alike counts as the letter of its word; positions are those of the original text in
code points from 1. Null texts and null ids give no rows and stay null; an empty text has no items; texts are
read whole, whatever their length; each row is treated on its own, so repeated rows have repeated results in
``redact`` and one in ``find_items``.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.lookalike import INVISIBLE, READINGS, REPRESENTATIVE

# ---- reading a text as it looks ------------------------------------------------------------------

_ODD = re.compile(
    "[" + "".join(re.escape(chr(c)) for c in INVISIBLE if c > 0x7F and chr(c) not in "‘’´ʻʼ" and not 0xE0000 <= c) + "̀-ͯͰ-Ͽѕіј]"
    "|[Ѐ-ԯ][A-Za-z]|[A-Za-z][Ѐ-ԯ]"
)
_WORD = re.compile(r"[^\W\d_]+")


def _one_script(word: str) -> str:
    """The word with its look-alikes in the script that its other letters have."""
    cyrillic = any("Ѐ" <= c <= "ԯ" and c not in REPRESENTATIVE for c in word)
    latin = any(c < "ɐ" and c not in REPRESENTATIVE for c in word)
    if cyrillic == latin:
        if latin:
            return word
        # nothing decides: the script of most of the letters
        cyrillic = sum("Ѐ" <= c <= "ԯ" for c in word) * 2 > len(word)
    to = 1 if cyrillic else 0
    return "".join(c if (r := READINGS.get(REPRESENTATIVE.get(c, ""))) is None or r[to] == "." else r[to] for c in word)


def as_seen(text: str) -> tuple[str, list[int] | None]:
    """The text as it looks, and for each of its characters the place in the original (None: the same places)."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        v = INVISIBLE.get(ord(c), c) if c != "\n" else c
        if v is None:
            continue
        if out and unicodedata.combining(c):
            joined = unicodedata.normalize("NFC", out[-1] + c)
            if len(joined) == 1:
                out[-1] = joined
                continue
        for x in v:
            out.append(x)
            at.append(i)
    seen = "".join(out)
    return _WORD.sub(lambda m: _one_script(m.group()) if not m.group().isascii() else m.group(), seen), at


# ---- patterns ------------------------------------------------------------------------------------

_AT = r"(?: ?@ ?| ?[\[({] ?(?:at|et|собака|kuchukcha) ?[\])}] ?| (?:собака|kuchukcha|at) (?=[\w-]+ ?(?:[\[({] ?(?:dot|точка|nuqta)|dot |точка |nuqta )))"
_DOT = r"(?:\.| ?[\[({] ?(?:dot|точка|nuqta) ?[\])}] ?| (?:dot|точка|nuqta) )"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9_+-]*(?:{_DOT}[A-Za-z0-9_+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z][A-Za-z0-9-]*)+", re.I)
PHONE = re.compile(
    r"\+\d{1,3}(?:[ .\-]?\(?\d{2,3}\)?)(?:[ .\-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\w.+-])998[ .\-]?\(?\d\d\)?[ .\-]\d{3}[ .\-]?\d\d[ .\-]?\d\d(?!\d)"
    r"|(?<![\w.+-])998\d{9}(?!\d)"
    r"|(?<![\w.+-])[78][ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d\d[ .\-]?\d\d(?!\d)"
    r"|(?<![\w.+-])8[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d\d[ .\-]\d\d(?!\d)"
    r"|(?<![\w.+-])8\d{10}(?![\w])"
    r"|(?<![\w.+-])\(\d{2,3}\)[ .\-]?\d{3}[ .\-]\d\d[ .\-]\d\d(?!\d)"
    r"|(?<![\w.+-])\d\d[ \-]\d{3}[ \-]\d\d[ \-]\d\d(?![\w-])"
)
ID_NUMBER = re.compile(
    r"(?<![\w.+-])(?:"
    r"[IVX]{1,4}-[A-ZА-ЯЁ]{2} ?(?:№|N) ?\d{6}"
    r"|[A-Za-z]{2} ?(?:№ ?)?\d{7}"
    r"|[А-ЯЁ]{2} ?№ ?\d{6,7}"
    r"|\d{14}|\d{5} \d{5} \d{4}"
    r"|\d{3}-\d{3}-\d{3} \d\d"
    r"|\d\d ?\d\d ?(?:№ ?)?\d{6}"
    r")(?![\w])(?!-\d)"
)
_Q = "['`´‘’ʻʼ]"
_RU_KIND = r"(?:улиц[аеыу]|ул\.?|переул(?:ок|ка|ке)|пер\.|просп(?:ект[ае]?|\.)|пр-к?т[ае]?|пр\.|проезд[ае]?|бульвар[ае]?|бул\.|б-р|шоссе|ш\.|площад[ьи]|пл\.|набережн(?:ая|ой)|наб\.|тупик[ае]?|мкр\.?)"
_RU_NAME = r"[А-ЯЁ][А-ЯЁа-яё]+(?:-[А-ЯЁа-яё]+)?(?: [А-ЯЁ][А-ЯЁа-яё]+)?"
_HOUSE = r"\d{1,4}(?:[-/]\d{1,4})?(?:[а-яa-z](?!\w))?(?![\d:])"
_FLAT = r"(?:-uy)?(?:,? ?(?i:кв\.|квартира|стр\.|строение|корп\.|flat|apt\.?) ?\d+|,? ?\d+-xona(?:don)?)?"
ADDRESS = re.compile(
    rf"(?<!\w)(?i:{_RU_KIND}) ?{_RU_NAME},? ?(?i:(?:д\.|дом|уй) ?)?{_HOUSE}{_FLAT}"
    rf"|(?<!\w){_RU_NAME} (?i:{_RU_KIND}),? ?(?i:(?:д\.|дом) ?)?{_HOUSE}{_FLAT}"
    rf"|(?<!\w)[A-Z][\w'`´‘’ʻʼ-]+(?: (?i:tor|katta|shoh))? (?i:ko{_Q}ch(?:asi|\.)|prospekti|shoh ?ko{_Q}chasi),? ?{_HOUSE}{_FLAT}"
    rf"|(?<![\w-])\d{{1,4}}(?:-[A-Z])? [A-Z][A-Za-z]+ (?i:Road|Street|Lane|Avenue|Drive|Rd\.|St\.|Ave\.)(?!\w){_FLAT}"
)

# Given names. Their other case forms are made by rule.
GIVEN_RU = (
    "Александр Алексей Анатолий Андрей Антон Аркадий Арсений Артём Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Вячеслав "
    "Георгий Глеб Григорий Данил Денис Дмитрий Евгений Егор Захар Иван Игорь Илья Кирилл Константин Максим Матвей Михаил Никита Николай Олег "
    "Павел Пётр Роман Руслан Рустам Семён Сергей Станислав Степан Тимур Фёдор Эльдар Юрий Яков Ярослав Азиз Камил Марат "
    "Алина Анастасия Анна Валентина Вера Виктория Галина Дарья Диана Екатерина Елена Зарина Зоя Инна Ирина Камила Ксения Лариса Лола Любовь "
    "Людмила Маргарита Марина Мария Надежда Наталья Нина Оксана Ольга Полина Регина Светлана Софья Тамара Татьяна Ульяна Юлия Яна"
).split()
GIVEN_OTHER = (
    "Anvar Aziz Barno Bekzod Botir Dilnoza Doniyor Farrux Feruza Gulnora Jasur Kamola Lola Madina Malika Nargiza Nodira Otabek Oʻgʻiloy Rustam "
    "Ilhom Jamshid Nigora Nodir Ravshan Sanjar Sardor Sevara Shahlo Sherzod Shoʻhrat Shuhrat Ulugʻbek Umida Zafar Zuhra Alisher Bobur Dilshod Iroda Oybek Temur "
    "Gulbahor Muhammad Yusuf Oljas Nursulton Aziza Gulchehra Ibrohim Ismoil Karim Mavluda Murod Nazokat Odil Sabohat Said "
    "Alice Anna Arthur Clara Daniel Edgar Edward Ella Emma Felix Frank George Grace Hazel Henry Hugo Iris Ivy Jack James Jane John Laura Lucy Mark Martha Martin Mary Max Miles Nora Oliver Oscar Owen Peter Robert Rose Ruth Sarah Simon Thomas Violet Walter William"
).split()


def _plain(word: str) -> str:
    return re.sub(_Q, "'", word).lower().replace("ё", "е")


# How Uzbek Latin is written in Cyrillic and back, longer spellings first; two where usage varies.
_TO_CYRILLIC = (("sh", "ш"), ("ch", "ч"), ("yo", "ё"), ("yu", "ю"), ("ya", "я"), ("o'", "ў"), ("g'", "ғ"), ("ng", "нг"), *zip("abdefghijklmnopqrstuvxyz'", "абдефгҳижклмнопқрстувхйзъ", strict=True))
_TO_LATIN = (("ш", "sh"), ("щ", "sh"), ("ч", "ch"), ("ж", "j"), ("ё", "yo"), ("ю", "yu"), ("я", "ya"), ("ц", "ts"), *zip("абвгдезийклмнопрстуфхыэьъ", [*"abvgdeziyklmnoprstufxie", "", ""], strict=True))
#: parts that given names of the region are made of; a word with one is a given name beside a surname, patronymic or initial
_NAME_PART = re.compile(
    r"(?:gul|abdu|muham|nur|dil|sher|shoh|ziyo|mir)[a-z']{3,}|[a-z']{2,}(?:bek|jon|xon|boy|gul|shod|niso|bonu|iddin|ulloh?|mirzo)"
    r"|(?:гуль?|абду|мухам|нур|дил|шер|шох|зиё)[а-яўқғҳ]{3,}|[а-яўқғҳ]{2,}(?:бек|жон|жан|хон|хан|бай|бой|гуль?|нисо|иддин|улла|мирза)(?:а|у|ом|е)?"
)


def _written(word: str, table: tuple) -> str:
    for a, b in table:
        word = word.replace(a, b)
    return word


def _also(word: str) -> set[str]:
    """The other spellings of a name: in the other script, and with plain letters for those that only Uzbek has."""
    if word.isascii():
        word = _written(word, _TO_CYRILLIC)
        return {word, word.translate(str.maketrans("ўқғҳ", "укгх"))} if not word.isascii() else set()
    return {_written(word, _TO_LATIN)}


@lru_cache(maxsize=1)
def given_forms() -> frozenset[str]:
    """Given names in every case form and both scripts, small letters, ye for yo."""
    other = {_plain(n) for n in GIVEN_OTHER}
    latin = {_plain(x) for n in map(_plain, GIVEN_RU) for x in _also(n)}
    cyrillic = {_plain(x) for n in other for x in _also(n)}
    out = other | latin
    for n in [*map(_plain, GIVEN_RU), *sorted(cyrillic)]:
        stem = {"павел": "павл", "любовь": "любов"}.get(n, n)
        if n.endswith("ия"):
            ends, stem = ("и", "ю", "ей"), n[:-1]
        elif n.endswith("ья") or n.endswith("я"):
            ends, stem = ("и", "е", "ю", "ей"), n[:-1]
        elif n.endswith("а"):
            ends, stem = ("ы", "и", "е", "у", "ой"), n[:-1]
        elif n.endswith("ий"):
            ends, stem = ("я", "ю", "ем", "и"), n[:-1]
        elif n.endswith(("й", "ь")) and n != "любовь":
            ends, stem = ("я", "ю", "ем", "е"), n[:-1]
        elif n == "любовь":
            ends = ("и", "ью")
        else:
            ends = ("а", "у", "ом", "е")
        out |= {n, *(stem + e for e in ends)}
    return frozenset(out)


_PATRONYMIC = re.compile(r"(?:(?:[ое]в|ь|[мтк])ич(?:а|у|ем|ом|е)?|(?:[ое]вн|ичн|инишн)(?:а|ы|е|у|ой))$")
_SURNAME = re.compile(
    r".+(?:[оеё]в|[иы]н)(?:а|у|ым|е|ой|ы)?|.+(?:ск|цк)(?:ий|ого|ому|им|ом|ая|ой|ую)|.+(?:енко|ук|юк|ян)"
    r"|.+(?:[oe]v|in)a?(?:ning|ni|ga|dan)?|.+(?:man|son|sen|ley|field|ton|by|well|worth|wood|burn)(?:'s)?"
)
_CAPITAL = "A-ZА-ЯЁ"
_TOKEN = rf"[{_CAPITAL}](?:\.|[\w'`´‘’ʻʼ-]*\w)"
_SEQUENCE = re.compile(rf"(?<![\w])(?:{_TOKEN}(?:(?<=\.) ?| ))+(?:{_TOKEN}|(?<=\.))", re.S)
_PART = re.compile(_TOKEN)
_SON = re.compile(rf" (?:o{_Q}g{_Q}li|qizi)\b", re.I)


def _classify(token: str) -> str:
    """I initial, G given name, P patronymic, S surname by its ending, '' none."""
    if len(token) == 2 and token[1] == ".":
        return "I"
    low = _plain(token)
    if low in given_forms():
        return "G"
    # one-letter and mixed-case tokens aren't parts of a name
    if len(low) < 4 or not (token[1:].islower() or token.isupper() or "-" in token or "'" in low):
        return ""
    if len(low) > 4 and _PATRONYMIC.search(low):
        return "P"
    if _SURNAME.fullmatch(low):
        return "S"
    return "G" if len(low) > 5 and token[1:].islower() and _NAME_PART.fullmatch(low) else ""




#: components side by side that make a name, the longer first; x before an initial and a surname is a given name
SHAPES = ("SGP", "GPS", "GGS", "IIS", "SII", "GIS", "xIS", "SIP", "GP", "SG", "GS", "IS", "SI", "SP", "GI", "GG")


def names_in(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of names: two or more of given name, patronymic, surname and initials side by side; also two given names."""
    for m in _SEQUENCE.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start(), p.group()) for p in _PART.finditer(m.group())]
        kinds = "".join(_classify(p[2]) or "x" for p in parts)
        at = 0
        while at < len(kinds):
            best = 0
            for shape in SHAPES:
                if kinds.startswith(shape, at):
                    best = len(shape)
                    break
            if not best:
                at += 1
                continue
            if shape[0] == "x" and (parts[at][1] - parts[at][0] < 3 or text[max(0, parts[at][0] - 3) : parts[at][0]].rstrip(" ")[-1:] in ("", ".", "!", "?", "\n")):
                at += 1  # a sentence's first word
                continue
            start, end = parts[at][0], parts[at + best - 1][1]
            at += best
            # "son" or "daughter of" after a father's name
            father = at < len(kinds) and kinds[at] == "G"
            son = _SON.match(text, parts[at][1]) if father else _SON.match(text, end) if shape == "GG" else None
            if son:
                end, at = son.end(), at + father
            yield start, end


KINDS = ("email", "id_number", "phone", "address", "name")


# whatever EMAIL matches holds a match of _AT
_SIGN = re.compile(rf"{_AT}|at[\])}}]|собака|kuchukcha| (?:dot|точка|nuqta) ", re.I)
_DIGITS = re.compile(r"\d")


def _lines_with(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """The lines of the text in which ``pattern`` matches; no item crosses the end of a line."""
    end = -1
    for m in pattern.finditer(text):
        if m.start() >= end:
            start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            end = len(text) if end < 0 else end
            yield start, end


def items_in(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the items of a text, in code points from 0; an earlier kind of KINDS wins an overlap."""
    if not text:
        return []
    seen, at = as_seen(text)
    found: list[tuple[str, int, int]] = []
    for a, b in _lines_with(_SIGN, seen):
        found += [("email", m.start(), m.end()) for m in EMAIL.finditer(seen, a, b)]
    numbers = list(_lines_with(_DIGITS, seen))
    for kind, pattern in (("id_number", ID_NUMBER), ("phone", PHONE), ("address", ADDRESS)):
        for a, b in numbers:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(seen, a, b)]
    found += [("name", a, b) for a, b in names_in(seen)]
    kept: list[tuple[str, int, int]] = []
    for kind, a, b in found:  # in the order of KINDS
        if all(b <= x or a >= y for _, x, y in kept):
            kept.append((kind, a, b))
    kept.sort(key=lambda x: x[1])
    return kept if at is None else [(k, at[a], at[b - 1] + 1) for k, a, b in kept]


def find_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, kind, start_pos, length), one row an item. A narrow pass; only repeated rows need the distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, a + 1, b - a) for i, t in zip(batch["id"], batch["text"], strict=True) for k, a, b in items_in(t)]
            yield pd.DataFrame(rows or None, columns=["id", "kind", "start_pos", "length"])

    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    return source.mapInPandas(run, "id long, kind string, start_pos long, length long").distinct()


# ---- pseudonyms ----------------------------------------------------------------------------------


def feistel(value: int, size: int, key: bytes, tweak: str, rounds: int = 8) -> int:
    """A keyed permutation of range(size): a Feistel network on a * b >= size, walked until it falls inside."""
    if size < 2:
        return value
    a = max(2, int(size**0.5))
    b = -(-size // a)
    while True:
        left, right, m, n = value // b, value % b, a, b
        for r in range(rounds):
            f = int.from_bytes(hmac.new(key, f"{tweak}|{size}|{r}|{right}".encode(), hashlib.blake2s).digest()[:8], "big")
            left, right, m, n = right, (left + f) % m, n, m
        value = left * n + right
        if value < size:
            return value


CYRILLIC_SERIES = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"
LATIN_SERIES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _permuted_letters(letters: str, key: bytes, tweak: str) -> str:
    """Letters of one alphabet, in capitals, permuted together."""
    alphabet = LATIN_SERIES if letters[0] in LATIN_SERIES else CYRILLIC_SERIES
    n = 0
    for c in letters:
        n = n * len(alphabet) + alphabet.index(c)
    n, out = feistel(n, len(alphabet) ** len(letters), key, f"{tweak}{alphabet[0]}l"), ""
    for _ in letters:
        out, n = alphabet[n % len(alphabet)] + out, n // len(alphabet)
    return out


def permute_digits(digits: str, key: bytes, tweak: str) -> str:
    return str(feistel(int(digits), 10 ** len(digits), key, f"{tweak}d")).zfill(len(digits)) if digits else ""


def _put(value: str, digits: str, key: bytes, tweak: str) -> str:
    """``value`` with its digits replaced, letters permuted by alphabet, everything else where it was."""
    up = value.upper()
    new = {a[0]: iter(_permuted_letters("".join(c for c in up if c in a), key, tweak)) for a in (LATIN_SERIES, CYRILLIC_SERIES) if any(c in a for c in up)}
    d, out = iter(digits), []
    for c, u in zip(value, up, strict=True):
        if c.isdigit():
            out.append(next(d))
        elif u in LATIN_SERIES or u in CYRILLIC_SERIES:
            x = next(new[LATIN_SERIES[0] if u in LATIN_SERIES else CYRILLIC_SERIES[0]])
            out.append(x if c == u else x.lower())
        else:
            out.append(c)
    return "".join(out)


def permute_format(value: str, key: bytes, tweak: str) -> str:
    """Digits permuted together, letters permuted together, everything else where it was."""
    return _put(value, permute_digits("".join(c for c in value if c.isdigit()), key, tweak), key, tweak)


# ---- numbers with a check -------------------------------------------------------------------------


def insurance_check(nine: str) -> str:
    """The two check digits of a nine-digit insurance number: a weighted sum modulo 101."""
    return f"{sum(int(c) * (9 - i) for i, c in enumerate(nine)) % 101 % 100:02d}"


def personal_check(thirteen: str) -> str:
    """The check digit of a fourteen-digit personal code: weights 7, 3, 1."""
    return str(sum(int(c) * (7, 3, 1)[i % 3] for i, c in enumerate(thirteen)) % 10)


CENTURY = {"1": 1800, "2": 1800, "3": 1900, "4": 1900, "5": 2000, "6": 2000}


def permute_number(value: str, key: bytes) -> str:
    """An identity number permuted within its format.

    A number whose check is right keeps a right check: of an insurance number the nine digits are permuted and the check is made
    anew; of a personal code the date of birth is permuted among valid dates of its century (the first digit, which says
    century and sex, stays), the place and serial number among all, and the check is made anew. Any other is permuted digit by digit,
    and its check is wrong as before, or right by chance. Series letters are permuted within their alphabet.
    """
    digits = "".join(c for c in value if c.isdigit())
    letters = any(c.isalpha() for c in value)
    if not letters and len(digits) == 11 and insurance_check(digits[:9]) == digits[9:]:
        nine = permute_digits(digits[:9], key, "insurance")
        return _put(value, nine + insurance_check(nine), key, "id")
    if not letters and len(digits) == 14 and personal_check(digits[:13]) == digits[13] and digits[0] in CENTURY:
        day, month, year = int(digits[1:3]), int(digits[3:5]), CENTURY[digits[0]] + int(digits[5:7])
        if valid_date(day, month, year):
            d, m, y = permute_date(day, month, year, key, span=100)
            new = f"{digits[0]}{d:02d}{m:02d}{y % 100:02d}" + permute_digits(digits[7:13], key, "code")
            return _put(value, new + personal_check(new), key, "id")
    return permute_format(value, key, "id")


def valid_date(day: int, month: int, year: int) -> bool:
    try:
        datetime.date(year, month, day)
    except ValueError:
        return False
    return True


def permute_date(day: int, month: int, year: int, key: bytes, span: int = 60) -> tuple[int, int, int]:
    """A keyed permutation of the valid dates of the ``span`` years that hold the date; an invalid date comes back as it is."""
    if not valid_date(day, month, year):
        return day, month, year
    date = datetime.date(year, month, day)
    first = datetime.date(year - year % span or 1, 1, 1)
    size = (datetime.date(first.year + span, 1, 1) - first).days
    new = first + datetime.timedelta(days=feistel((date - first).days, size, key, f"date{first.year}"))
    return new.day, new.month, new.year


_COUNTRY = re.compile(r"\+?998|\+7|\+\d|(?<!\d)8(?=[ (\-]|\d{10}$)")


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """What stands for a value; the same for all spellings of it that differ in signs, case or form of apostrophe."""
    if kind == "phone":
        # the country part stays; the national number is permuted, so +7 and 8 before the same number agree
        m = _COUNTRY.match(value)
        head = value[: m.end()] if m and sum(c.isdigit() for c in value) > 10 else ""
        return head + permute_format(value[len(head) :], key, "phone")
    if kind == "id_number":
        return permute_number(value, key)
    plain = re.sub(r"[\s.,\-]+", " ", _plain(value)).strip()
    if kind == "email":
        plain = re.sub(rf"{_DOT}", ".", re.sub(_AT, "@", value.lower()))
    return hmac.new(key, f"{kind}|{plain}".encode(), hashlib.blake2s).hexdigest()[:32]  # 128 bits


def redacted(text: str | None, key: bytes) -> str | None:
    """The text with ``[KIND:pseudonym]`` in the place of each item."""
    items = items_in(text)
    if not items:
        return text
    out, last = [], 0
    for kind, a, b in items:
        value = as_seen(text[a:b])[0]
        out += (text[last:a], f"[{kind.upper()}:{pseudonym(kind, value, key)}]")
        last = b
    return "".join(out) + text[last:]


def redact(docs: DataFrame, text: str, key: str, out: str = "redacted") -> DataFrame:
    """Add the text with placeholders. ``key`` is the secret of the pseudonyms."""
    secret = hashlib.blake2s(key.encode()).digest()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, secret) for t in texts], dtype=object)

    return docs.withColumn(out, run(F.col(f"`{text}`")))
