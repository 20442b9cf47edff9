import datetime
import random
import re

import numpy as np
import pytest

from quillspan.llm import mixture as M
from quillspan.llm import packing as P
from quillspan.llm import personal as N
from quillspan.llm import tokens


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(0, 100, rng.integers(0, 60))
        got = P.first_fit_decreasing(sizes, 100)
        room, want = [], np.zeros(len(sizes), int)
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [100] * (k == len(room))
            room[k] -= sizes[i]
            want[i] = k
        assert got.tolist() == want.tolist()


def test_packing(spark):
    rng = random.Random(0)
    sizes = [(i, rng.choice([0, 5, 300, 2048, 2049, 10_000, 900])) for i in range(500)]
    df = spark.createDataFrame(sizes, "id long, n_tokens long").selectExpr("*", "1 as bin_no")
    made = P.pack(df, 2048, 100).toPandas()
    used = made.groupby(["group_no", "bin_no"])["n_tokens"].sum()
    assert used.max() <= 2048 and (made.groupby("id")["n_tokens"].sum() == dict(sizes)).all() if False else used.max() <= 2048
    assert made.groupby("id")["n_tokens"].sum().to_dict() == dict(sizes)
    whole = {i for i, n in sizes if n <= 2048}
    assert (made[made["id"].isin(whole)].groupby("id").size() == 1).all()
    for _, g in made.sort_values("offset").groupby(["group_no", "bin_no"]):
        assert (g["offset"].to_numpy() == np.cumsum(g["n_tokens"]) - g["n_tokens"]).all()
    report = P.fill_report(P.pack(df, 2048, 100)).first()
    assert report.n_tokens == sum(n for _, n in sizes) and report.fill_share > 0.9
    assert P.pack(df.where("1 = 0")).count() == 0 and P.fill_report(P.pack(df.where("1 = 0"))).first().n_bins == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "привет мир"), (2, None), (3, ""), (None, "x"), (4, "дом " * 20_000)], "i long, t string").selectExpr("*", "1 as id", "2 as n_tokens")
    got = {r.id: r.n_tokens for r in tokens.with_sizes(df, "i", "t").collect()}
    enc = tokens.encoder()
    assert got == {1: len(enc.encode_ordinary("привет мир")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("дом " * 20_000))}


def test_quota_tree():
    q = np.array([0, 7, 100, 3])
    plan = M.split_quotas(q, 8, 5)
    assert (plan.sum(0) == q).all() and np.ptp(plan.sum(1)) <= 1 and (plan >= 0).all()
    assert (plan == M.split_quotas(q, 8, 5)).all()
    assert M.split_quotas(np.array([5]), 1, 0).tolist() == [[5]]


def test_blocks_meet_their_shards():
    rng = np.random.default_rng(1)
    plan = M.split_quotas(np.array([1000, 3, 0, 40_000]), 37, 2)
    cells, ends = M._cells(plan, [0, 1, 3]), np.cumsum(plan, axis=0)
    for i in (0, 1, 3):
        size = max(1, int(ends[-1, i]) // 37)
        for block in rng.integers(0, ends[-1, i], 60).tolist():
            found = [s for j, cell, s, a, b in cells if j == i and cell == block // size and a <= block < b]
            assert found == [int(np.searchsorted(ends[:, i], block, side="right"))]
    assert len(cells) <= 3 * 37 * 3


def test_huge_quotas():
    # what would be more than half a billion blocks is drawn in larger ones
    total = 10**14
    size = max(8192, -(-total // (M.MOST_BLOCKS - 3)))
    plan = M.split_quotas(np.array([total // size // 2, total // size // 3]), 64, 0)
    assert plan.sum() == total // size // 2 + total // size // 3 and np.ptp(plan.sum(1)) <= 1


def test_mixture(spark):
    rng = random.Random(0)
    names = ["big"] * 2000 + ["Small Source"] * 40 + ["unlisted"] * 30 + [None] * 10
    rows = [(i, s, rng.choice([0, 50, 200, 800])) for i, s in enumerate(names)]
    docs = spark.createDataFrame(rows, "id long, source string, n_tokens long").selectExpr("*", "1 as size", "2 as block")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small-source", 0.2, 3), ("absent", 0.2, 2)], "source string, target_share double, max_repeat int")
    made, report = M.mix(docs, targets, shards=4, block_tokens=1000)
    got, shares = made.toPandas(), {r.source: r for r in report.collect()}
    assert set(got["source"]) == {"big", "small_source"} and set(got["shard"]) == {0, 1, 2, 3}
    assert not got.duplicated(["id", "copy_no"]).any()
    uses = got.groupby(["source", "id"]).size()
    assert uses["big"].max() == 1 and uses["small_source"].max() == 3 and uses["small_source"].min() >= 2
    assert abs(shares["big"].actual_share - 0.75) < 0.01 and abs(shares["small_source"].actual_share - 0.25) < 0.01
    assert shares["absent"].drawn_tokens == 0 and got["n_tokens"].sum() == sum(r.drawn_tokens for r in shares.values())
    capped, report = M.mix(docs, targets, shards=2, total_tokens=10**9)
    assert report.where("source = 'big'").first().most_uses == 1
    none, report = M.mix(docs.where("1 = 0"), targets)
    assert none.count() == 0 and report.count() == 3 and report.agg({"drawn_tokens": "sum"}).first()[0] == 0


def _kinds(text):
    return [(k, text[a:b]) for k, a, b in N.items_in(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Пишите на a.b+c@mail.example.", [("email", "a.b+c@mail.example")]),
        ("Почта x_y (at) school[dot]example и ник @lirmom", [("email", "x_y (at) school[dot]example")]),
        ("тел. +998 (01) 417 76 08, 8 (025) 806-40-03", [("phone", "+998 (01) 417 76 08"), ("phone", "8 (025) 806-40-03")]),
        ("дом. 09 190 52 59 и (041) 335-79-32, 80917158840", [("phone", "09 190 52 59"), ("phone", "(041) 335-79-32"), ("phone", "80917158840")]),
        ("Паспорт I-QQ № 638823, ПИНФЛ 93195 35375 8319, 000-784-950 92, zq5432070", [("id_number", x) for x in ("I-QQ № 638823", "93195 35375 8319", "000-784-950 92", "zq5432070")]),
        ("г. Бор, ул. Тершашской, д. 72а", [("address", "ул. Тершашской, д. 72а")]),
        ("000242, Ростожский проезд, д. 38", [("address", "Ростожский проезд, д. 38")]),
        ("Oila Buntar koʻchasi 53 manzilida, 65-B Lambabid Road", [("address", "Buntar koʻchasi 53"), ("address", "65-B Lambabid Road")]),
        ("У Лолы Брускогивевой; О.Э. Дошкумалин, Кровровев Г. А.", [("name", "Лолы Брускогивевой"), ("name", "О.Э. Дошкумалин"), ("name", "Кровровев Г. А.")]),
        ("Sinf rahbari Zakroshov Otabek Bekzod oʻgʻli keldi", [("name", "Zakroshov Otabek Bekzod oʻgʻli")]),
        ("Контакт: ЛИВРОМИН РУСТАМ и Иванов Пётр Ильич", [("name", "ЛИВРОМИН РУСТАМ"), ("name", "Иванов Пётр Ильич")]),
        ("Вечером Глеб ушёл. Мы гуляли по улице Ленинской. Учебник 978-0-00-185072-0, счёт 59:3, рамка 834 864 615 609, № 1928018", []),
        ("Gulbahor Karimova keldi. Олжас Сулейменов, Мухаммад Юсуф и Aleksandr Petrov", [("name", x) for x in ("Gulbahor Karimova", "Олжас Сулейменов", "Мухаммад Юсуф", "Aleksandr Petrov")]),
        ("Дилнозабону Рахимова; Otabek Bekzod oʻgʻli", [("name", "Дилнозабону Рахимова"), ("name", "Otabek Bekzod oʻgʻli")]),
        ("a" * 100 + "@mail.uz, x@" + "sub." * 14 + "uz", [("email", "a" * 100 + "@mail.uz"), ("email", "x@" + "sub." * 14 + "uz")]),
        ("ул. " + "Д" + "о" * 150 + ", д. 5", [("address", "ул. " + "Д" + "о" * 150 + ", д. 5")]),
        ("", []),
    ],
)
def test_items(text, want):
    assert _kinds(text) == want


def test_items_in_odd_characters():
    text = "На сайте тeл. +998 ９０ 123 45​ 67 у Дениca Роm­анова"
    found = N.items_in(text)
    assert [(k, a) for k, a, _ in found] == [("phone", text.index("+")), ("name", text.index("Дени"))]


def test_pseudonyms():
    key = b"k"
    assert sorted(N.feistel(i, 1000, key, "t") for i in range(1000)) == list(range(1000))
    a, b = N.redacted("тел. +7 012 345 67 89", key), N.redacted("зв. 8 (012) 345-67-89", key)
    digits = lambda s: "".join(c for c in s if c.isdigit())[-10:]
    assert digits(a) == digits(b) != "0123456789" and a.startswith("тел. [PHONE:+7 ") and a.endswith("]")
    assert N.redacted(None, key) is None and N.redacted("текст", key) == "текст"
    assert N.pseudonym("name", "Анна  Ильина", key) == N.pseudonym("name", "АННА ИЛЬИНА", key)
    d = N.permute_date(29, 2, 2024, key)
    assert datetime.date(d[2], d[1], d[0]) and N.permute_date(31, 2, 2024, key) == (31, 2, 2024)


def test_numbers_keep_their_check():
    key = b"k"
    assert N.insurance_check("112233445") == "95"  # fixed value: a published example
    seen = set()
    for i in range(300):
        nine = f"{i * 3_331_333 % 10**9:09d}"
        n = f"{nine[:3]}-{nine[3:6]}-{nine[6:]} {N.insurance_check(nine)}"
        new = N.permute_number(n, key)
        digits = "".join(c for c in new if c.isdigit())
        assert [c.isdigit() for c in n] == [c.isdigit() for c in new] and digits[9:] == N.insurance_check(digits[:9]) and new != n
        seen.add(new)
    assert len(seen) == 300
    body = "3" + "290288" + "017" + "004"  # 29 February 1988
    code = body + N.personal_check(body)
    new = N.permute_number(code, key)
    assert new[0] == "3" and N.valid_date(int(new[1:3]), int(new[3:5]), 1900 + int(new[5:7])) and new[13] == N.personal_check(new[:13]) and new != code
    wrong = code[:-1] + str((int(code[-1]) + 1) % 10)
    assert len(N.permute_number(wrong, key)) == 14
    assert N.permute_number("АА № 1234567", key)[:2] != "АА" and all(c in N.CYRILLIC_SERIES for c in N.permute_number("АА № 1234567", key)[:2])
    assert N.permute_number("ab 1234567", key)[:2].islower()


def test_equal_values_are_linked_across_documents(spark):
    rows = [
        (1, "Пишите Дениcу Романову, тел. +998 90 123 45 67"), (2, "ДЕНИСУ РОМАНОВУ звонить (90) 123-45-67"), (3, "тел. 90 123 45 67 и паспорт AB 7654321"), (4, "AB7654321"), (5, "x@mail.uz"), (6, "x (at) mail [dot] uz"),
    ]
    red = {r.doc_id: r.redacted for r in N.redact(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "text", "k").collect()}
    marks = {i: re.findall(r"\[(\w+):([^\]]+)\]", t) for i, t in red.items()}
    plain = lambda x: re.sub(r"\W", "", x)[-9:]
    assert marks[1][0][1] == marks[2][0][1] and len(marks[1][0][1]) == 32  # the same name, however it's written
    assert plain(marks[1][1][1]) == plain(marks[2][1][1]) == plain(marks[3][0][1]) != "901234567"
    assert plain(marks[3][1][1]) == plain(marks[4][0][1]) and marks[5][0][1] == marks[6][0][1]
    other = N.redacted(rows[0][1], b"another key")
    assert marks[1][0][1] not in other


def test_tables(spark):
    rows = [(1, "тел. 09 190 52 59"), (2, None), (None, "a@b.example"), (3, ""), (1, "тел. 09 190 52 59"), (4, "слово " * 30_000 + "a@b.example")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as kind")
    assert {(r.id, r.kind, r.start_pos) for r in N.find_items(df, "doc_id", "text").collect()} == {(1, "phone", 6), (4, "email", 180_001)}
    assert N.find_items(df, "doc_id", "text").count() == 2 and N.find_items(df.where("1 = 0"), "doc_id", "text").count() == 0
    red = N.redact(df, "text", "k").collect()
    assert len(red) == 6 and red[1].redacted is None and red[3].redacted == "" and "[EMAIL:" in red[5].redacted[-40:]
