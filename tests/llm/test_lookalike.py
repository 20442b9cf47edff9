import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import lookalike as L

ODD = [("привет", "пpивет"), ("Вечер", "Beчер"), ("ёлка", "ёлка"), ("йод", "йод"), ("abc", "ａｂｃ"), ("a b", "a b"), ("a-b", "a‑b"), ("ab", "a​b"), ("o'z", "oʻz"), ("сор", "cop")]
OTHER = [("елка", "ёлка"), ("Дом", "дом"), ("x2", "x²"), ("a b", "a  b"), ("ужин", "у́жин"), ("0", "O"), ("a-b", "a—b"), ("№", "No")]


@pytest.mark.parametrize(("a", "b"), ODD)
def test_same_look(a, b):
    assert L.skeleton(a) == L.skeleton(b) and a != b


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_visible_difference(a, b):
    assert L.skeleton(a) != L.skeleton(b)


def test_null_and_empty():
    assert L.skeleton(None) is None and L.compare_key(None) is None and L.skeleton("") == "" == L.compare_key("")
    assert L.word_hashes([])[0].size == 0 and L.word_hashes([None, "", " - "])[0].size == 0


alphabet = st.text(alphabet="аaсcкkвBВH’'ʻ - ​̆̈éЁёйшЖ9²\n\U0001f600İ", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(alphabet, max_size=6))
def test_batches_agree_with_single_texts(texts):
    assert L.keys_of(texts) == ([L.compare_key(t) for t in texts] or [""])
    no, h = L.word_hashes(texts)
    words = [(i, w) for i, t in enumerate(texts) for w in L.words(t)]
    assert no.tolist() == [i for i, _ in words]
    seen = {}
    for (_, w), x in zip(words, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=200, deadline=None)
@given(alphabet)
def test_key_is_the_same_for_forms_of_one_look(text):
    s = L.skeleton(text)
    assert L.skeleton(s) == s
    assert L.compare_key(s) == L.compare_key(text)


def test_words():
    assert L.words("портф- ель Oʻzbek 'x' ёж-кот") == [L.compare_key(w) for w in ("портфель", "o'zbek", "x", "еж", "кот")]


def _reader():
    bigrams = {0: {}, 1: {}, 2: {}}
    for s, words in ((0, ["bir", "top", "hop", "cox", "soap"]), (1, ["вот", "нос", "сор", "рот", "вор", "она", "в", "он", "а"])):
        for w in words:
            for a, b in zip("^" + w, w, strict=False):
                bigrams[s][a + b] = -1.0
    return L.ScriptReader(bigrams)


def test_reading_keeps_the_look_and_one_script():
    r = _reader()
    for a, b in ODD:
        form = r.read(L.skeleton(a))
        assert form == r.read(L.skeleton(b)) and L.skeleton(form) == L.skeleton(a)
    assert r.read(L.skeleton("пpивeт")) == "привет"
    assert r.read(L.skeleton("B школе")) == "В школе"
    assert r.read(L.skeleton("вижу cop школа")) == "вижу сор школа"


def test_pairs_and_forms(spark):
    rows = [(1, "дом у реки"), (2, "дoм у реки"), (3, "дом у реки"), (4, "дом y рeки"), (5, "Дом у реки"), (6, None), (None, "дом"), (7, ""), (8, "​")]
    df = spark.createDataFrame(rows, "k long, t string").withColumnsRenamed({}).selectExpr("k", "t", "1 as f", "2 as id")
    got = {(r.id_a, r.id_b) for r in L.same_look_pairs(df, "k", "t").collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)}
    assert L.same_look_pairs(df.where("1 = 0"), "k", "t").count() == 0
    assert L.same_look_pairs(df.union(df), "k", "t").count() == 6
    long_ = spark.createDataFrame([(1, "дом " * 30_000), (2, "дoм " * 30_000)], "k long, t string")
    assert L.same_look_pairs(long_, "k", "t").count() == 1


def test_pairs_within_groups(spark):
    rows = [("a", 1, "дом"), ("a", 2, "дoм"), ("b", 1, "дoм"), ("b", 2, "дом"), ("c", 3, "дoм"), (None, 4, "дом")]
    df = spark.createDataFrame(rows, "g string, k long, t string").selectExpr("*", "1 as w", "2 as id", "'x' as text")
    assert sorted(tuple(r) for r in L.same_look_pairs(df, "k", "t", within="g").collect()) == [("a", 1, 2), ("b", 1, 2)]


def test_letter_pairs_of_arrays():
    texts = ["Мама мыла", "o'zbek", "сo", "a1б", "х́а", "", "漢字ab"]
    pairs, n = L._pairs_of(texts)
    name = lambda x: "^" if x == L._START else chr(x)
    got = {(p >> 42, name((p >> 21) & 0x1FFFFF) + name(p & 0x1FFFFF)): k for p, k in zip(pairs.tolist(), n.tolist(), strict=True)}
    assert got[1, "^м"] == 2 and got[1, "ма"] == 2 and got[0, "oz"] == 1 and got[0, "^a"] == 1 and got[1, "^б"] == 1 and got[1, "ха"] == 1
    assert (1, "^с") not in got and (0, "ab") not in got  # two scripts in one word


def test_hot_group(spark):
    rows = [(i, "Диктант" if i % 50 else "Диктaнт") for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t string")
    assert L.same_look_pairs(df, "k", "t").count() == 12 * 588
    random.seed(0)


def test_lattices_searched_together():
    rng = random.Random(4)
    letters = "".join(c for cls in L.CLASSES for c in cls if c != ".") + "бдйжшщbfgl漢ß"
    one, many = _reader(), _reader()
    tokens = {"".join(rng.choice(letters) + rng.choice(["", "", "'", "́"]) for _ in range(rng.randint(1, 9))).rstrip("'") for _ in range(800)}
    tokens = {t for s in tokens for t in L._TOKEN.findall(L.skeleton(s))}
    many.learn(tokens)
    assert {t: one.lattice(t) for t in tokens} == {t: many.memo[t] for t in tokens}
    many.learn([])
