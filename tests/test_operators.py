from pyspark.sql import functions as F

from quillspan.functions import geometry as G
from quillspan.functions import text as T
from quillspan.operators import answers, augment, contract, dictation, judging, matching, scoring
from quillspan.sources import files

KEY = "Странный, тихий, ни на что не похожий, прерывистый звук слышался где-то неподалёку. Хотя Петя и сидел на мельнице, но он никого и ничего не увидел."
READ = ["Странный, тихий ни на что не похожий, прерывистый звук слышался", "где-то неподалёку. Хотя петя и сидел на мельнице, но он никого", "и нечего вдруг увидел."]


def _jobs(spark, key, read, conf=0.9):
    rows = [("j", i, t, {"x0": 100.0, "y0": 100.0 + 60 * i, "x1": 1500.0, "y1": 150.0 + 60 * i}, f"L{i}", conf) for i, t in enumerate(read)]
    lines = spark.createDataFrame(rows, "job_id string, n int, text string, bbox struct<x0: double, y0: double, x1: double, y1: double>, line_id string, confidence double")
    toks = dictation.lines_to_tokens(lines, "job_id", "n", "text")
    keys = spark.createDataFrame([("j", key, None, None)], "job_id string, text string, ignore_case boolean, count_punctuation boolean").withColumn("key", T.token_array(F.col("text"))).drop("text")
    return keys.join(toks, "job_id")


def test_planted_dictation_errors(spark):
    pairs = dictation.align(_jobs(spark, KEY, READ))
    found = dictation.errors(pairs)
    assert sorted(r.kind for r in found.collect()) == ["capitalization", "extra_word", "missing_word", "punctuation_missing", "spelling"]
    card = dictation.score_cards(pairs, found).first()
    assert (card.n_spelling, card.n_punctuation) == (4, 1)
    assert {r.mark for r in found.collect()} <= {"underline", "insert", "strike", "circle"}
    assert found.where("bbox is null").count() == 0


def test_same_dictation_and_low_confidence(spark):
    pairs = dictation.align(_jobs(spark, KEY, [KEY]))
    card = dictation.score_cards(pairs, dictation.errors(pairs)).first()
    assert (card.n_spelling, card.n_punctuation, card.coverage, card.confidence) == (0, 0, 1.0, 1.0)
    low = dictation.align(_jobs(spark, KEY, READ, 0.4))
    found = dictation.errors(low)
    assert all(r.needs_review for r in found.collect()) and dictation.score_cards(low, found).first().needs_review


def test_tokens(spark):
    df = spark.createDataFrame([("«А, б.» в!",), ("№ 5 - где-то",), ("",), (None,)], "t string")
    got = [None if r[0] is None else [(x.text, x.punct_after) for x in r[0]] for r in df.select(T.token_array(F.col("t"))).collect()]
    assert got == [[("А", ","), ("б", ".»"), ("в", "!")], [("№", ""), ("5", "-"), ("где-то", "")], [], None]


def test_uzbek_label_and_scored_form(spark):
    df = spark.createDataFrame([("o`zbek san’at",), ("u 'deb' aytdi",), ("'ok",), ("привет",), (None,)], "t string")
    assert [r[0] for r in df.select(T.uzbek_label(F.col("t"))).collect()] == ["oʻzbek sanʼat", None, "ʻok", None, None]
    df = spark.createDataFrame([("  йод­ \t ёлка\n",), (None,)], "t string")
    assert [r[0] for r in df.select(T.scored_form(F.col("t"))).collect()] == ["йод елка", None]


def test_one_edit_words(spark):
    got = set(spark.createDataFrame([("ab",)], "w string").select(T.one_edit_words(F.col("w"), "abc")).first()[0])
    want = {"ab"[:i] + c + "ab"[i:] for i in range(3) for c in "abc"} | {"ab"[:i] + c + "ab"[i + 1 :] for i in range(2) for c in "abc"} | {"a", "b"}
    assert got == want - {"ab"}


def test_scores(spark):
    rows = [("p", 0, "дом стоит", "дом стоит"), ("p", 1, "кот", None), ("q", 0, "", "x"), ("q", 1, "рек", "рак")]
    lines = spark.createDataFrame(rows, "file string, gi long, text string, read string")
    s = scoring.line_scores(lines, "text", "read")
    got = {(r.file, r.gi): (r.cer, r.edits, r.word_hits, r.perfect) for r in s.collect()}
    assert got["p", 0] == (0.0, 0.0, 2, True) and got["p", 1] == (None, 3.0, 0, False) and got["q", 0][0] == 1.0
    total = s.agg(*scoring.aggregate_lines()).first()
    assert abs(total.cer_matched - 1 / 12) < 1e-9 and abs(total.cer_all - 4 / 15) < 1e-9
    page = {r.file: r for r in scoring.page_scores(s, "file", "gi").collect()}
    assert abs(page["p"].page_cer - 4 / 13) < 1e-9 and page["p"].line_recall == 0.5
    assert scoring.overall(scoring.page_scores(s, "file", "gi")).first().n_pages == 2


def test_bootstrap_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    num, den = rng.integers(0, 30, 60), rng.integers(30, 60, 60)
    sums = spark.createDataFrame([(f"p{i}", float(n), float(d), float(n) / 2) for i, (n, d) in enumerate(zip(num, den, strict=True))], "file string, num double, den double, half double")
    got = scoring.bootstrap(sums, "file", "num", "den", 2000).first()
    picks = rng.integers(0, 60, (20_000, 60))
    low, high = np.percentile(num[picks].sum(1) / den[picks].sum(1), [2.5, 97.5])
    width = high - low
    assert abs(got.low - low) < 0.05 * width and abs(got.high - high) < 0.05 * width
    both = scoring.bootstrap(sums, "file", "num", "den", 200, other=("half", "den")).first()
    assert both.significant and both.low > 0
    same = scoring.bootstrap(sums, "file", "num", "den", 200, other=("num", "den")).first()
    assert same.low == same.high == 0 and not same.significant
    # every place is drawn, about two thirds of them in one resample
    drawn = spark.range(60).select(scoring.draw_of(0, F.lit(3), F.col("id"), F.lit(60)).alias("p")).distinct().count()
    assert 25 <= drawn <= 50
    assert scoring.bootstrap(sums.where("1 = 0"), "file", "num", "den", 5).first().low is None


def test_seen_lines_against_brute_force(spark):
    import random
    import re

    from quillspan.functions.kernels import indel_ratio

    rng = random.Random(1)
    words = ["".join(rng.choices("абвгде", k=rng.randint(2, 7))) for _ in range(30)]
    train = [" ".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(200)]
    lines = []
    for i in range(150):
        t = list(rng.choice(train)) if i % 2 else list(" ".join(rng.choices(words, k=4)))
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(["", "ж", "аб"])
        lines.append((i, "".join(t).strip() or "x"))
    lines += [(700, "длинный текст " * 20), (701, "короче " * 30)]
    train += ["длинный  тикст " * 20]
    lines += [(900, "дом"), (901, None), (902, "совсем другой текст латиницей abc")]
    got = {r.key: r.seen for r in scoring.seen_lines(spark.createDataFrame(lines, "k long, t string"), "k", "t", spark.createDataFrame([(t,) for t in [*train, "", None]], "t string"), "t", block=40).collect()}
    norm = lambda t: re.sub("[ \t]+", " ", t).strip() if t else t
    train = [norm(t) for t in train]
    for k, t in lines:
        t = norm(t)
        want = None if t is None or len(t) < 8 else any(indel_ratio(t, x) >= 80 for x in train)
        assert got[k] == want, (k, t)
    assert any(v for v in got.values()) and any(v is False for v in got.values())


def test_seen_lines_of_one_letter(spark):
    # more of one letter than a byte counts
    lines = [(1, "а" * 600 + "б"), (2, "а" * 300 + "б" * 310), (3, "в" * 610)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = scoring.seen_lines(df(lines, "k long, t string"), "k", "t", df([("а" * 600 + "г",), ("б" * 600,)], "t string"), "t")
    assert {r.key: r.seen for r in got.collect()} == {1: True, 2: False, 3: False}


def test_seen_novel_scores_count_every_like_line(spark, tmp_path):
    from quillspan.plans import pages

    d = str(tmp_path)
    lines = [(1, "f", 0, "а" * 600 + "б"), (2, "f", 1, "Новый звонарь построил поляну."), (3, "f", 2, "дом")]
    labels = [("а" * 600 + "г", " Train"), ("новый  звонарь построил поляну", "exam"), (None, None)]
    spark.createDataFrame(lines, "line_id long, file string, gi int, text string").write.parquet(f"{d}/gt_line.parquet")
    spark.createDataFrame(labels, "text string, split string").write.parquet(f"{d}/train_label.parquet")
    want = {True: 1, False: 1, None: 1}
    assert {r.seen: r.n_lines for r in pages.seen_novel_scores(spark, d).collect()} == want
    assert {r.seen: r.n for r in pages.seen_novel(spark, d).collect()} == want


def test_gathered():
    import pandas as pd

    from quillspan.operators.scoring import gathered

    assert list(gathered([pd.Series(["a", "b"]), pd.Series([], dtype=object), pd.Series(["c"]), pd.Series(["d"])], 3)) == [["a", "b", "c"], ["d"]]
    assert list(gathered([])) == []


def test_likeness_against_brute_force(monkeypatch):
    import random

    from quillspan.functions import likeness
    from quillspan.functions.kernels import indel_ratio

    rng, n_like = random.Random(3), 0
    for letters, most, threshold in (("абвгде ", 12, 80.0), ("abcdefgh ABC,.", 40, 80.0), ("абвгabcd '\x00😀", 12, 60.0), ("".join(map(chr, range(0x4E00, 0x4F90))), 90, 90.0)):
        words = ["".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(30)]
        texts = [" ".join(rng.choices(words, k=rng.randint(1, most))) for _ in range(120)]
        lines = set()
        for i in range(100):
            t = list(rng.choice(texts)) if i % 2 else list(" ".join(rng.choices(words, k=rng.randint(1, most))))
            for _ in range(int(len(t) * rng.choice([0, 0.1, 0.18, 0.2, 0.22, 0.25]))):
                k = rng.randrange(len(t))
                t[k] = rng.choice(["", "", rng.choice(letters), t[k] + rng.choice(letters)])
                t = list("".join(t)) or ["x"]
            lines.add("".join(t))
        want = {x for x in lines if any(indel_ratio(x, t) >= threshold for t in texts)}
        n_like += len(want)
        for sizes in ((4096, 64, 1 << 15, 8192), (7, 3, 20, 5)):  # blocks of some pairs and of a few
            for name, size in zip(("LINES", "TEXTS", "PAIRS", "SLICE"), sizes, strict=True):
                monkeypatch.setattr(likeness, name, size)
            assert set(likeness.like_any(likeness.prepared(sorted(lines), threshold), [texts[:50], [], texts[50:]])) == want
    assert n_like > 50
    assert likeness.prepared([], 80.0) == [] and likeness.like_any([], [["текст"]]) == []


def test_likeness_measures_few_pairs(monkeypatch):
    """Sentences of one small set of words: bounds leave fewer than one pair in a hundred to be measured in full."""
    import random

    from quillspan.functions import likeness

    rng, measured = random.Random(5), []
    common = likeness._Block._common
    monkeypatch.setattr(likeness._Block, "_common", lambda self, p, q: measured.append(len(p)) or common(self, p, q))
    words = ["".join(rng.choices("оаеинтрсвлкмдпуяыьгзбчй", weights=range(23, 0, -1), k=rng.randint(3, 10))) for _ in range(300)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(8, 11)))
    lines, texts = [sentence() for _ in range(600)], [sentence() for _ in range(600)]
    likeness.like_any(likeness.prepared(lines, 80.0), [texts])
    assert sum(measured) < 0.01 * len(lines) * len(texts)


def test_matching(spark):
    box = lambda i, x: ("f", i, "t", float(x), 0.0, float(x) + 10, 10.0)
    schema = "file string, place long, text string, x0 double, y0 double, x1 double, y1 double"
    gt, det = spark.createDataFrame([box(0, 0), box(1, 20)], schema), spark.createDataFrame([box(0, 21), box(1, 1), box(2, 100)], schema)
    got = {(r.gi, r.pj) for r in matching.match_lines(gt, det).collect()}
    assert got == {(0, 1), (1, 0)}
    score = matching.detector_scores(gt, det, matching.match_lines(gt, det)).first()
    assert (score.tp, score.precision, score.recall) == (2, 2 / 3, 1.0)


def test_assignment_by_bounds_is_the_best():
    import random

    rng = random.Random(2)
    for _ in range(30):
        a = ["".join(rng.choices("абвг ", k=rng.randint(0, 14))) for _ in range(rng.randint(1, 7))]
        b = ["".join(c for c in x if rng.random() > 0.2) for x in a if rng.random() > 0.3] + ["".join(rng.choices("абвг ", k=9)) for _ in range(rng.randint(1, 3))]
        full = matching._text_likeness(a, b)
        assert (matching._shared_letters(a, b) >= full - 1e-12).all()
        s, found = matching._assigned_by_text(a, b)
        assert abs(sum(full[p] for p in found) - sum(full[p] for p in matching.assign(full))) < 1e-9 and all(s[p] == full[p] for p in found)


def test_geometry(spark):
    df = spark.createDataFrame([([0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0],), ([1.0, 2.0, 3.0, 4.0],), (None,)], "p array<double>")
    rows = df.select(G.polygon_box(F.col("p")).alias("b"), G.polygon_area(F.col("p")).alias("a"), G.polygon_length(F.col("p")).alias("n")).collect()
    assert tuple(rows[0].b) == (0.0, 0.0, 4.0, 3.0) and rows[0].a == 12.0 and rows[0].n == 14.0
    assert rows[1].b is None and rows[2].b is None


def test_math_and_choices(spark):
    from quillspan.plans.grading import PROBLEMS, STEPS

    p = spark.createDataFrame(PROBLEMS, "id string, answer string, answer_kind string, tolerance double, points double").withColumn("job_id", F.lit("j"))
    x = spark.createDataFrame(STEPS, "problem_id string, step int, text string").withColumns({"job_id": F.lit("j"), "confidence": F.lit(0.9)})
    got = {r.id: r for r in answers.grade_math(p, x).collect()}
    assert {i: r.verdict for i, r in got.items()} == {"1": "correct", "2": "correct", "3": "wrong", "4": "missing"}
    assert sum(r.points_awarded for r in got.values()) == 3 and sum(r.points_max for r in got.values()) == 5
    assert got["3"].first_wrong_step == 1


def test_math_more(spark):
    box = {"x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 5.0}
    p = spark.createDataFrame([("j", "1", "42", "number", None, 2.0, 0.5), ("j", "2", "7", None, None, None, 9.0), ("j", "3", None, None, None, 1.0, None)], "job_id string, id string, answer string, answer_kind string, tolerance double, points double, partial_points double")
    x = spark.createDataFrame([("j", "1", 0, "41", None, box), ("j", "2", 0, "14:2", 0.3, box), ("j", "2", 1, " ", 0.9, None)], "job_id string, problem_id string, step int, text string, confidence double, bbox struct<x0: double, y0: double, x1: double, y1: double>")
    graded = answers.grade_math(p, x)
    got = {r.id: r for r in graded.collect()}
    assert (got["1"].verdict, got["1"].points_awarded, got["1"].confidence, got["1"].needs_review) == ("partial", 0.5, 0.9, False)
    assert (got["2"].verdict, got["2"].points_awarded, got["2"].needs_review, got["2"].read_answer) == ("correct", 1.0, True, "14:2")
    assert got["3"].verdict == "missing"
    assert sorted((r.id, r.kind) for r in answers.math_marks(graded).collect()) == [("1", "cross"), ("2", "check")]
    card = answers.math_cards(graded).first()
    assert (card.score, card.max_score, card.n_correct, card.needs_review) == (1.5, 4.0, 1, True)
    lines = spark.createDataFrame([("j", 0), ("j", 1)], "job_id string, line_no int")
    probs = spark.createDataFrame([("j", "a", 0), ("j", "b", 1), ("j", "c", 2)], "job_id string, id string, ord int")
    assert sorted((r.problem_id, r.line_no) for r in answers.group_lines(lines, probs).collect()) == [("a", 0), ("b", 1)]
    given = spark.createDataFrame([("j", "a", [1, 0, 7])], "job_id string, problem_id string, line_nos array<int>")
    assert sorted((r.step, r.line_no) for r in answers.group_lines(lines, probs, given).collect()) == [(0, 1), (1, 0)]


def test_choices(spark):
    rows = [(["A"], ["A"], None), (["A", "B"], ["A"], ["B"]), (["C"], [], None), (["A"], ["A", "B"], None), (["D"], None, None)]
    df = spark.createDataFrame([(*r, 2.0) for r in rows], "key array<string>, detected array<string>, first_detected array<string>, points double")
    run = lambda **k: [(r.verdict, r.points_awarded) for r in answers.grade_choices(df, **k).collect()]
    assert run() == [("correct", 2.0), ("ambiguous", 0.0), ("blank", 0.0), ("multiple", 0.0), ("blank", 0.0)]
    last = {"changed": "last_mark_wins"}
    assert run(**last)[1] == ("wrong", 0.0) and run(policy="partial", **last)[1] == ("partial", 1.0) and run(policy="any_correct", **last)[1] == ("correct", 2.0)
    card = answers.choice_cards(answers.grade_choices(df.withColumn("job_id", F.lit("j")))).first()
    assert (card.score, card.max_score, card.n_correct, card.n_questions, card.needs_review) == (2.0, 10.0, 1, 5, True)
    kinds = spark.createDataFrame([("math", True), ("mcq", False), ("essay", False), (None, True)], "t string, r boolean")
    assert [r[0] for r in kinds.select(answers.record_status(F.col("t"), F.col("r"))).collect()] == ["needs_review", "ok", "unsupported", "unsupported"]


def test_judging(spark):
    df = spark.createDataFrame([("w", "кот", -1.0, True), ("w", "код", -0.5, False), ("w", "кит", -0.5, False), ("w", "рот", -3.0, False), ("v", "дом", -2.0, True)], "w string, c string, s double, k boolean")
    got = {r.w: r for r in judging.best_spellings(df, "w", "c", "s", "k", 2).collect()}
    assert (got["w"].best, got["w"].margin, got["w"].top) == ("кит", 0.5, ["кит", "код"]) and (got["v"].best, got["v"].margin, got["v"].top) == (None, 0.0, [])
    m = spark.createDataFrame([(14.0, None), (6.0, None), (0.0, None), (20.0, 9.0), (20.0, 1.0), (20.0, -2.0)], "c double, p double")
    assert [r[0] for r in m.select(judging.verdict(F.col("c"), F.col("p"))).collect()] == ["error", "review", "ok", "error", "review", "ok"]
    bank = judging.donor_bank(spark.createDataFrame([("a", 1, "к"), ("a", 2, "о"), ("a", 3, "т")], "w string, n int, l string"), "w", ["n"], "l")
    assert [(r.before, r.after) for r in bank.orderBy("n").collect()] == [("^", "о"), ("к", "т"), ("о", "$")]
    letters = [(1, "о", "к", "т", 10.0), (2, "о", "к", "т", 12.0), (3, "о", "к", "м", 10.0), (4, "о", "к", "т", 40.0), (5, "а", "к", "т", 10.0)]
    d = spark.createDataFrame(letters, "id int, letter string, before string, after string, w double")
    assert {(r.want_id, r.donor_id, r.tier) for r in judging.donors(d, d, ["letter"], "id", "w").collect()} == {(1, 2, 0), (2, 1, 0), (3, 1, 1)}
    p = spark.createDataFrame([("a", 0.9, 10.0), ("a", 0.1, 12.0), ("b", 0.1, 10.0), ("c", 0.9, 2.0), ("d", 0.9, 10.0), ("d", 0.9, 10.0), ("d", 0.9, 40.0)], "w string, p double, x double")
    assert {r.w: r.kept for r in judging.trusted(p, "w", "p", "x").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_last_criteria(spark):
    df = spark.createDataFrame([("j", "a", 0, 1.0, 2.0), ("j", "b", 1, None, 3.0), ("j", "a", 2, 2.0, 4.0)], "job string, name string, n int, points double, most double")
    last = answers.last_criteria(df, "job", "name", F.col("n"), "points", "most")
    assert {(r.name, r.place, r.points, r.most) for r in last.collect()} == {("a", 0, 2.0, 4.0), ("b", 1, None, 3.0)}
    assert tuple(answers.criteria_totals(last, "job").first()) == ("j", 2, 2.0, 7.0)


LINE = "Мама мыла раму и пела песню у окна весь вечер"


def test_corruption_is_the_same_again(spark):
    df = spark.createDataFrame([(i, LINE, "Новая строка") for i in range(200)] + [(900, None, None), (901, "", None), (902, "да", None), (903, "12 :", None)], "id long, t string, next string")
    run = lambda n, **k: {r.id: (r.corrupted, r.n_changes) for r in augment.corrupted(df.repartition(n), "t", "id", neighbour="next", **k).collect()}
    got = run(1)
    assert got == run(5) and got[900] == (None, 0) and got[901] == ("", 0) and got[903] == ("12 :", 0)
    assert all(n >= 1 for i, (_, n) in got.items() if i < 200) and got[902][1] >= 1
    assert sum("Новая" in t or "строка" in t for i, (t, _) in got.items() if i < 200) > 3
    assert all(t == LINE and n == 0 for i, (t, n) in run(2, rate=0.0, edges=0.0, least=0).items() if i < 200)
    swapped = [t for i, (t, _) in run(2, rate=1.0, edges=0.0).items() if i < 200]
    assert len(set(swapped)) > 100


def test_rules_of_misspelling(spark):
    got = {r.w: set(r.c) for r in spark.createDataFrame([("«Класс»,",), ("учиться",), ("жизнь",), ("он",), ("",)], "w string").select("w", augment.candidates(F.col("w"), most=0).alias("c")).collect()}
    assert {"«Клас»,", "«Клосс»,", "«Гласс»,"} <= got["«Класс»,"] and all(c.startswith("«") and c.endswith("»,") for c in got["«Класс»,"])
    assert {"учится", "учитса"} & got["учиться"] == {"учится"} and "учитьса" not in got["учиться"]
    assert {"жызнь", "жизн", "жиснь", "шизнь"} <= got["жизнь"] and got[""] == set()
    one = spark.createDataFrame([("дом", "дым"), ("дом", "Дом!"), ("дом", "5")], "w string, r string").select(augment.candidates(F.col("w"), F.col("r"), most=3).alias("c")).collect()
    assert one[0].c[-1] == "дым" and len(one[1].c) <= 3 and len(one[2].c) <= 3
    wide = spark.createDataFrame([("кот",)], "w string").select(augment.candidates(F.col("w"), most=0, wide=True)).first()[0]
    assert {"окт", "кто", "котя", "от", "кон"} <= set(wide) and len(wide) == len(set(wide)) and "кот" not in wide


def test_uzbek_misspellings(spark):
    import random

    from quillspan.functions.uzbek import corrupted_word

    rng, kinds = random.Random(0), set()
    for _ in range(300):
        w = corrupted_word("oʻzshing", rng)
        assert w != "oʻzshing" and len(w) >= 2
        kinds.add(w)
    assert {"ozshing", "oʻzsing", "oʻzshig"} & kinds and corrupted_word("va", rng) is None and corrupted_word("12345", rng) is None
    df = spark.createDataFrame([(i, "bolalar maktabga bordi") for i in range(20)] + [(99, None)], "id long, t string")
    got = {r.id: r.c for r in df.select("id", augment.corrupted_uzbek("t", F.col("id").cast("string")).alias("c")).collect()}
    assert got[99].corrupted is None and all(1 <= got[i].n_changes <= 2 and got[i].corrupted != "bolalar maktabga bordi" for i in range(20))


def test_drawn_edits_have_their_weights(spark):
    stats = spark.createDataFrame([("sub", "о", "а", 3), ("del", "к", "", 1), ("dbl", "т", "т", 4), ("complex", "кот", "пёс", 50)], "op string, a string, b string, cnt long")
    words = spark.createDataFrame([("Кот", i) for i in range(600)] + [("ко", 1), ("коты", 1), ("пи", 1)], "w string, n long")
    got = augment.sampled_edits(words, "w", stats, "n").collect()
    ops = [r.op for r in got if r.w == "Кот"]
    assert len(ops) == 600 and 180 < ops.count("sub") < 330 and ops.count("del") == 0  # too short to lose a letter
    assert {r.edited for r in got if r.w == "Кот"} == {"Кат", "Котт"} and all(r.w != "пи" for r in got)


def test_word_boxes_and_verdicts(spark):
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), map(float, v), strict=True))
    schema = "job_id string, n int, text string, bbox struct<x0: double, y0: double, x1: double, y1: double>, line_id string, confidence double, words array<struct<text: string, bbox: struct<x0: double, y0: double, x1: double, y1: double>, confidence: double>>"
    rows = [
        ("j", 0, "мама мыла", box(0, 10, 90, 50), "L0", 0.9, None),
        ("j", 1, "раму да", box(0, 60, 70, 90), "L1", 0.8, [{"text": "раму", "bbox": box(1, 61, 39, 88), "confidence": 0.5}]),
        ("j", 2, "и я", box(0, 0, 9, 9), "L2", 0.7, [{"text": "и", "bbox": box(1, 1, 2, 2), "confidence": None}, {"text": "я", "bbox": box(3, 1, 4, 2), "confidence": 0.1}]),
        ("j", 3, "кот", None, "L3", None, None),
    ]
    toks = {(t.line_id, t.line_pos): t for t in dictation.lines_to_tokens(spark.createDataFrame(rows, schema), "job_id", "n", "text").first().read}
    assert tuple(toks["L0", 0].bbox) == (0.0, 10.0, 40.0, 50.0) and tuple(toks["L0", 1].bbox) == (50.0, 10.0, 90.0, 50.0)
    # the ink box that overlaps the word's stretch; the other word has its stretch at the height of the ink
    assert tuple(toks["L1", 0].bbox) == (1.0, 61.0, 39.0, 88.0) and tuple(toks["L1", 1].bbox) == (50.0, 61.0, 70.0, 88.0)
    assert tuple(toks["L2", 1].bbox) == (3.0, 1.0, 4.0, 2.0) and (toks["L2", 0].confidence, toks["L2", 1].confidence) == (0.7, 0.1)
    assert toks["L3", 0].bbox is None and toks["L1", 0].confidence == 0.8

    pairs = dictation.align(_jobs(spark, KEY, READ))
    found = dictation.errors(pairs)
    n = found.where("kind = 'spelling'").first().n
    for verdict, n_spelling, left in (("ok", 3, 4), ("review", 3, 5), ("error", 4, 5)):
        v = spark.createDataFrame([("j", n, verdict, 1.5, "нечего", [])], "job_id string, n int, verdict string, margin double, best string, letters array<string>")
        judged = dictation.judged(found, v)
        card = dictation.score_cards(pairs, judged).first()
        assert (card.n_spelling, judged.count()) == (n_spelling, left) and card.needs_review == (verdict == "review")
        assert dictation.marks(judged).count() == left and [r.ink_says for r in judged.where("ink_says is not null").collect()] == (["нечего"] if verdict == "error" else [])
    assert dictation.marks(found).where("kind = 'insert'").select("text").distinct().count() == 2 and dictation.recorded(found).where("bbox is null").count() == 0


def test_page_block(spark):
    box = lambda y: {"x0": 0.0, "y0": float(y), "x1": 100.0, "y1": float(y) + 20}
    b = "bbox struct<x0: double, y0: double, x1: double, y1: double>"
    gt = spark.createDataFrame([("p", 0, "дом стоит", box(0)), ("p", 1, "кот", box(30)), ("p", 2, "река", box(60))], f"file string, gi long, text string, {b}")
    pred = spark.createDataFrame([("p", 0, "кит", box(31)), ("p", 1, "дом  стоит", box(1)), ("p", 2, "лишнее", box(500))], f"file string, pj long, text string, {b}")
    flat = lambda df, place: df.select("file", F.col(place).alias("place"), "text", "bbox.*")
    pairs = matching.match_lines(flat(gt, "gi"), flat(pred, "pj"))
    page = scoring.page_scores(scoring.matched_lines(gt, pred, pairs), "file", "gi", pred).first()
    assert (page.extra_lines, page.box_hit_rate, page.line_recall) == (1, 1.0, 2 / 3)
    from quillspan.functions.kernels import edit_distance, word_edits

    ref, hyp = "дом стоит\nкот\nрека", "дом стоит\nкит\n\nлишнее"
    assert page.page_cer == edit_distance(ref, hyp) / len(ref) and page.page_wer == word_edits(ref.split(), hyp.split())[0] / 4
    # texts are compared in scored form when a box is missing
    some = flat(pred, "pj").withColumn("x0", F.when(F.col("place") != 2, F.col("x0")))
    assert {(r.gi, r.pj) for r in matching.match_lines(flat(gt, "gi"), some).collect()} == {(0, 1), (1, 0)} | {(r.gi, r.pj) for r in matching.match_lines(flat(gt, "gi"), some).collect() if r.gi == 2}


def test_polyline_and_halves(spark):
    lines = [[{"x": 0.0, "y": 10.0}, {"x": 100.0, "y": 12.0}], [{"x": 0.0, "y": 50.0}, {"x": 90.0, "y": 52.0}]]
    df = spark.createDataFrame([(95.0, 14.0, lines), (95.0, 45.0, lines), (300.0, 12.0, lines), (95.0, 30.0, lines)], "x double, y double, l array<array<struct<x: double, y: double>>>")
    got = [r[0] for r in df.select(G.nearest_polyline(F.col("x"), F.col("y"), F.lit(20.0), F.lit(10.0), F.col("l"))).collect()]
    assert got == [0, 1, None, None]
    h = spark.range(1).select(G.page_halves(F.lit(101), F.lit(50)).alias("h")).first().h
    assert [(x.x_offset, x.width) for x in h] == [(0, 50), (50, 51)]


def test_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(T.rounded(F.col("x"), 2)).collect()] == [0.12, 2.67, 2.5, None]


def test_contract(spark):
    import json

    good = {
        "request": {"job_id": "a", "type": "open_question", "image": {"uri": "x"}, "key": {"questions": [{"id": "1", "points": 2}]}},
        "response": {"job_id": "a", "type": "open_question", "status": "ok", "marks": [], "score_card": {"score": 1, "max_score": 2, "summary": "s", "confidence": 1, "answers": []}},
    }
    assert contract.broken_rules(json.dumps(good)) == []
    bad = json.loads(json.dumps(good))
    bad["request"]["key"]["questions"] = []
    bad["request"]["grade_level"] = 12
    bad["response"] |= {"job_id": "b", "status": "fine", "marks": [{"kind": "odd", "bbox": [0, 1, 2], "confidence": 2}]}
    del bad["response"]["score_card"]["summary"]
    assert contract.broken_rules(json.dumps(bad)) == [
        ("request.grade_level", "out of range"), ("request.key.questions", "empty"), ("response.job_id", "differs"), ("response.marks.bbox", "not four numbers"), ("response.marks.confidence", "out of range"),
        ("response.marks.kind", "unknown"), ("response.marks.reason", "missing"), ("response.score_card.summary", "missing"), ("response.status", "unknown"),
    ]
    for kind, rule in (("dictation", "request.key"), ("math", "request.key"), ("mcq", "request.key"), ("retelling", "request.key")):
        assert (rule, "missing") in contract.broken_rules(json.dumps({"request": {"type": kind}, "response": {}}))
    df = spark.createDataFrame([(json.dumps(good),), ("[]",), ("{",), (None,), ("{}",)], "b string")
    assert [None if r[0] is None else len(r[0]) for r in df.select(contract.violations("b")).collect()] == [0, None, None, None, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"request": {"job_id": "1"}}')
    (tmp_path / "b.json").write_text('{"job_id": "2"}')
    assert {r.job_id for r in files.requests(spark, str(tmp_path / "*.json"), "job_id string").collect()} == {"1", "2"}
    (tmp_path / "p.txt").write_text('{"f1": "a\\nb", "f2": "c"}')
    pred = files.keyed_pages(spark, str(tmp_path / "p.txt"), "string")
    assert scoring.prediction_lines(pred, "file", "value").count() == 3
    (tmp_path / "x.inkml").write_text('<ink xmlns="u"><annotation type="label">1</annotation><annotation type="normalizedLabel">2</annotation><trace>1 2, 3 4</trace><trace>1 2</trace></ink>')
    files.write_csv(pred.withColumn("nested", F.array("value")), str(tmp_path / "csv"), "nested")
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv")).count() == 2
    (tmp_path / "l.jsonl").write_text('{"file": "a", "text": " x  y "}\n{"file": "b", "text": "x y", "split": "train"}\n{"file": "c", "text": "z", "split": "val"}\n')
    assert [r.text for r in files.distinct_labels(files.labels(spark, str(tmp_path / "l.jsonl"))).collect()] == ["x y"]
    r = files.ink(spark, str(tmp_path / "x.inkml")).first()
    assert r.label == "2" and r.traces == [[[1.0, 2.0], [3.0, 4.0]]]
    files.write_json(pred, str(tmp_path / "out"))
    assert files.remaining(pred, spark.read.json(str(tmp_path / "out")), "file").count() == 0
