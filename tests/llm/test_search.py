import random

import numpy as np
import pandas as pd

from quillspan.llm import components as C
from quillspan.llm import leakage as K
from quillspan.llm import personal as P
from quillspan.llm import splitleak as S
from quillspan.llm.editdistance import distances
from quillspan.llm.lookalike import squeezed_key, words


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances():
    rng = random.Random(0)
    a = ["".join(rng.choices("абвг ", k=rng.choice([0, 1, 5, 63, 64, 65, 130, 200]))) for _ in range(120)]
    b = ["".join(c for c in x if rng.random() > 0.1) + "".join(rng.choices("абвг", k=rng.randint(0, 9))) for x in a]
    want = [_levenshtein(x, y) for x, y in zip(a, b, strict=True)]
    assert distances(a, b).tolist() == want
    limit = np.full(len(a), 8)
    got = distances(a, b, limit)
    assert [(g if g <= 8 else 9) for g in got.tolist()] == [min(w, 9) for w in want]
    assert distances([], []).tolist() == []


def _texts(rng, n):
    vocab = ["".join(rng.choices("бвгдклмнпрст", k=2)) + rng.choice("аеиоу") + "".join(rng.choices("бвгдклмн", k=2)) + rng.choice("аыуой") for _ in range(300)]
    return [" ".join(rng.choices(vocab, k=rng.randint(6, 12))) for _ in range(n)]


def _shake(rng, t, n):
    t = list(t)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([[], [rng.choice("абвгд")], [t[i], rng.choice("абвгд")]])
    return "".join(t)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    base = _texts(rng, 30)
    rows, head = [], "Домашняя работа ученика"
    for i in range(160):
        t = _shake(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4, 7]))
        rows.append((i, head if i % 5 == 0 else t, rng.choice(["train", None, " Train", "val", "EXAM ", "other"]), "s"))
    rows += [(900, None, "val", "s"), (None, base[0], "val", "s"), (901, "кратко", "train", None), (902, base[0], "val", None), (902, base[0], "val", None)]
    df = spark.createDataFrame(rows, "label_id long, text string, split string, source string").selectExpr("*", "1 as seed", "2 as cls", "'x' as key")
    want = set()
    side = lambda s: {"train": 0, "val": 1, "exam": 1}.get((s or "train").strip().lower())
    usable = {(i, squeezed_key(t), side(s)) for i, t, s, _ in rows if i is not None and t and side(s) is not None and len(squeezed_key(t)) >= 20}
    for i, a, x in usable:
        for j, b, y in usable:
            if x == 0 and y == 1 and _levenshtein(a, b) * 100 <= 15 * max(len(a), len(b)):
                want.add((min(i, j), max(i, j)))
    key = {i: k for i, k, _ in usable}

    def run(a, b):
        """Longest common run of characters."""
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, *row)
        return best

    # what the fingerprints promise: every pair that shares a run of seed + window - 1 = 18 characters
    promised = {(i, j) for i, j in want if run(key[i], key[j]) >= 18 or key[i] == key[j]}
    assert len(promised) > 0.5 * len(want)
    for how in ({}, {"least": 40, "many": 2}):  # seeds in one part, and frequent ones in several and with more to compare by
        found = {(r.id_a, r.id_b) for r in S.row_pairs(*S.overlaps(df, "label_id", "text", "split", **how)).collect()}
        assert found <= want and promised <= found
    records = S.record_coverage(df, "label_id", "text", "split", "source").collect()
    linked = {i for i, _, s in usable if s == 1} & {x for p in found for x in p}
    assert {r.id for r in records if r.coverage > 0} == linked
    report = {(r.split, r.source): r for r in S.coverage_report(df, "label_id", "text", "split", "source").collect()}
    assert sum(r.n_rows for r in report.values()) == len({i for i, _, s, _ in rows if i is not None and side(s) == 1})
    assert S.row_pairs(*S.overlaps(df.where("1 = 0"), "label_id", "text", "split")).count() == 0


def test_frequent_seeds_lose_no_pair(spark):
    rng = random.Random(8)
    tails = ["".join(rng.choices("абвгдежзиклмнопрст ", k=14)) for _ in range(60)]
    # all share one opening; each held text differs from its train text right after it and in every few letters
    rows = [(i, "контрольная работа по теме " + t, "train") for i, t in enumerate(tails)]
    rows += [(100 + i, "контрольная работа по теме " + "".join("ы" if k in (0, 7) else c for k, c in enumerate(t)), "val") for i, t in enumerate(tails)]
    df = spark.createDataFrame(rows, "i long, t string, s string")
    key = {i: squeezed_key(t) for i, t, _ in rows}
    want = {(i, j) for i in range(60) for j in range(100, 160) if _levenshtein(key[i], key[j]) * 100 <= 15 * max(len(key[i]), len(key[j]))}
    assert len(want) >= 60
    for how in ({}, {"least": 16, "many": 3}):
        assert {(r.id_a, r.id_b) for r in S.row_pairs(*S.overlaps(df, "i", "t", "s", **how)).collect()} == want


class _Value:
    def __init__(self, value):
        self.value = value


def test_seeds_are_sent_in_passes(spark, monkeypatch):
    # one pass after the other has a part of the seeds on disk, each seed is in one of them, and no pair is lost
    rng = random.Random(12)
    base = _texts(rng, 300)
    batch = pd.DataFrame({"side": S.HELD, "cls": range(300), "key": base, "row": range(300), "steps": S.steps(base, 12, 7)})
    classes, spread = _Value(S.letter_classes(np.ones(S.LETTERS, np.int64))), _Value(S.Spread([S.Packed(S.SLOTS * 8, {})] * 2, 8, 64, 3))
    sent = [pd.concat(S._sent(12, turn, n, classes, None, spread)(iter([batch]))) for n in (1, 3) for turn in range(n)]
    whole, *parts = [(int(p["n"].sum()), int(p["m"].str.len().sum())) for p in sent]
    assert sum(n for n, _ in parts) == whole[0] == sum(map(len, batch["steps"])) and max(m for _, m in parts) < 0.5 * whole[1]

    rows = [(i, t, "train") for i, t in enumerate(base[:40])] + [(100 + i, _shake(rng, t, 1), "val") for i, t in enumerate(base[:40])]
    df = spark.createDataFrame(rows, "i long, t string, s string")
    let_go = []
    monkeypatch.setattr(S, "release", let_go.append)
    found = [{(r.id_a, r.id_b) for r in S.row_pairs(*S.overlaps(df, "i", "t", "s", passes=n)).collect()} for n in (1, 4)]
    assert found[0] == found[1] >= {(i, 100 + i) for i in range(40)} and len(let_go) == 5


def test_steps_are_the_places_of_all_seeds():
    rng = random.Random(13)
    texts = ["", "кратко", "x" * 40, *_texts(rng, 50), "ровно двенад"]
    codes, length, start, at, text, h = S._seeds(pd.DataFrame({"key": texts, "steps": S.steps(texts, 12, 7)}), 12)
    rolled = S._rolling(codes, 12)
    want = S._selected(rolled, length, start, 12, 7)
    assert at.tolist() == want.tolist() and h.tolist() == rolled[want].tolist() and text.tolist() == (np.searchsorted(start, want, side="right") - 1).tolist()


def test_tiles_meet_every_near_pair(monkeypatch):
    rng = np.random.default_rng(14)

    def side(n):
        length = rng.integers(20, 200, n)
        place = rng.integers(0, length)
        return {"key": np.full(n, 7, np.uint64), "row": np.arange(n), "place": place.astype(np.int32), "length": length.astype(np.int32), "counts": np.zeros((n, S.CLASSES), np.uint8)}

    held, train = S._ordered(side(300), 0.15, S.STRIP), S._ordered(side(2500), 0.15)
    monkeypatch.setattr(S, "_block", lambda held, train, a, b: S._near(held, train, np.repeat(np.arange(a.start, a.stop), len(b)), np.tile(b, a.stop - a.start), 0.15))
    got = [set(zip(i.tolist(), j.tolist(), strict=True)) for i, j in S.meet(held, train, 0.15)]
    i, j = S._near(held, train, np.repeat(np.arange(300), 2500), np.tile(np.arange(2500), 300), 0.15)
    assert sum(map(len, got)) == len(i) and set.union(*got) == set(zip(i.tolist(), j.tolist(), strict=True))


def test_heading_of_many_texts_loses_no_pair(spark):
    # a heading of 20 characters, then 30 of which three are edited in the twin of the other split
    rng = random.Random(9)
    rows, head = [], "домашнее сочинение о "[:20]
    for i in range(40):
        t = "".join(rng.choices("абвгдежзиклмнопрст", k=30))
        u = list(t)
        for k in (7, 15, 23):
            u[k] = "ы"
        rows += [(i, head + t, "train"), (100 + i, head + "".join(u), "exam")]
    df = spark.createDataFrame(rows, "i long, t string, s string")
    got = {(r.id_a, r.id_b) for r in S.row_pairs(*S.overlaps(df, "i", "t", "s")).collect()}
    assert got == {(i, 100 + i) for i in range(40)}


def test_chain_and_gaps():
    assert S.chain([(5, 9), (1, 2), (3, 1), (7, 11)]) == [(1, 2), (5, 9), (7, 11)] or len(S.chain([(5, 9), (1, 2), (3, 1), (7, 11)])) == 3
    a, b = "xx одинаковый кусок yy", "x одинаковый кусок yyz"
    at = a.index("одинак"), b.index("одинак")
    assert S.gaps(a, b, [at], 12) == [("xx ", "x "), ("", "z")]
    assert S._edits([a], [b], [np.array([(at[0] << 32) + at[1]])], 12, np.array([9])).tolist() == [_levenshtein(a, b)] == [2]


def test_covered():
    assert S.covered([0, 5, 30, 30], 12) == 29 and S.covered([], 12) == 0 and S.covered([3, 0], 4) == 7


def test_seeds_are_unpacked_as_they_were():
    rng = np.random.default_rng(3)
    for n, grams in ((1, None), (500, rng.integers(0, 256, (500, S.GRAM_BITS // 8), np.uint8))):
        key, row = rng.integers(0, 2**63, n).astype(np.uint64), np.sort(rng.integers(0, 2**50, n))
        place, length = rng.integers(0, 10**6, n), rng.integers(0, 10**6, n)
        counts = rng.integers(0, 16, (n, 64)).astype(np.uint8)
        got = S._unpacked([(n, S._packed(key, row, place, length, counts, grams))] * 2)
        assert (got["key"] == np.tile(key & np.uint64(2**40 - 1), 2)).all() and (got["row"] == np.tile(row, 2)).all()
        assert (got["place"] == np.tile(place, 2)).all() and (got["length"] == np.tile(length, 2)).all() and (got["counts"] == np.tile(counts[:, ::2] | (counts[:, 1::2] << 4), (2, 1))).all()
        assert ("grams" in got) == (grams is not None) and (grams is None or (got["grams"] == np.tile(grams, (2, 1))).all())


def test_grams_rule_out_no_near_pair():
    rng = random.Random(7)
    a = _texts(rng, 200)
    b = [_shake(rng, t, rng.randint(0, 12)) for t in a]
    d = np.array([_levenshtein(x, y) for x, y in zip(a, b, strict=True)])
    assert S._can_be_near(a, b, d).all() and not S._can_be_near(a, a[1:] + a[:1], np.full(200, 5)).any()


def test_copies_in_many_tasks(spark):
    t = "самостоятельная работа ученика пятого класса."
    df = spark.createDataFrame([(i, t, "val") for i in range(8)] + [(100, t[:-1], "train")], "i long, t string, s string").repartitionByRange(9, "i")
    assert {(r.id_a, r.id_b) for r in S.row_pairs(*S.overlaps(df, "i", "t", "s")).collect()} == {(i, 100) for i in range(8)}


def test_long_texts_overlap(spark):
    rng = random.Random(5)
    t = " ".join(_texts(rng, 300))
    df = spark.createDataFrame([(1, t, "train"), (2, _shake(rng, t, 40), "val"), (3, t[::-1], "exam")], "i long, t string, s string")
    assert [tuple(r) for r in S.row_pairs(*S.overlaps(df, "i", "t", "s")).collect()] == [(1, 2)]


def test_components_against_union_find(spark):
    rng = random.Random(1)
    spell = lambda c: None if c is None else rng.choice([c, c.upper(), c.replace("-", "_"), c.replace("-", " "), f" {c} "])
    rows = []
    for i in range(500):
        w = "w-1" if i % 3 == 0 and i < 150 else f"w-{rng.randint(2, 400)}"
        rows.append((i, spell(rng.choice([w, None, "unknown", "?", ""])), spell(rng.choice([f"n-{rng.randint(1, 300)}", None, "n/a"])), "x" if False else spell(f"s-{i // 2}" if i >= 400 else None)))
    rows += [(1000 + i, None, f"chain-{i}", f"chain-{i + 1}s" if False else None) for i in range(2)]
    chain = [(2000 + i, f"c{i}", f"d{(i + 1) // 2}", None) for i in range(60)] + [(2100 + i, f"c{2 * i}", f"d{i + 50}", None) for i in range(20)]
    rows += chain + [(None, "w-1", None, None), (0, "w-1", None, None)]
    df = spark.createDataFrame(rows, "id long, writer string, notebook string, sheet string").selectExpr("*", "1 as src", "2 as v", "3 as code")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, *codes in rows:
        if i is None:
            continue
        find(i)
        for k, c in enumerate(codes):
            c = (c or "").lower().replace("-", "").replace("_", "").replace(" ", "")
            if c not in ("", "unknown", "?", "n/a"):
                parent[find(i)] = find((k, c))
    comp = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        comp.setdefault(find(i), []).append(i)
    want = {(min(g), x) for g in comp.values() for x in g if x != min(g)}
    got = C.groups(df, "id", ["writer", "notebook", "sheet"])
    assert {(r.anchor_id, r.id) for r in got.collect()} == want
    split = C.assign_splits(df, "id", ["writer", "notebook", "sheet"], {"train": 0.8, "val": 0.1, "test": 0.1}).collect()
    assert len(split) == sum(map(len, comp.values()))
    of = {}
    for r in split:
        assert of.setdefault(find(r.id), r.split) == r.split
    share = {s: sum(r.split == s for r in split) / len(split) for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.8) < 0.05 and min(share.values()) > 0.05
    assert C.groups(df.where("1 = 0"), "id", ["writer", "notebook", "sheet"]).count() == 0
    assert C.assign_splits(df.where("1 = 0"), "id", ["writer"], {"a": 1.0}).count() == 0


def test_shared_runs_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"слово{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 8, 15, 40])))) for i in range(20)] + [(50, None), (51, ""), (None, "а б"), (3, "x")]
    items[7] = (7, items[6][1])
    docs = []
    for d in range(150):
        t = " ".join(rng.choices(vocab + [f"иное{k}" for k in range(100)], k=30))
        if d % 3 == 0:
            w = rng.choice(items[:20])[1].split()
            n = rng.randint(5, 12)
            s = rng.randrange(max(1, len(w) - n))
            t += " " + " ".join(w[s : s + n]).upper() + ", " + t
        docs.append((d, t))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (902, docs[0][1])]
    dd = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as ids").repartition(3)
    ii = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as id")
    runs = lambda t: {tuple(words(t)[k : k + 8]) for k in range(len(words(t)) - 7)}
    want = {(d, i) for d, t in docs if t for i, u in items if i is not None and u and runs(t) & runs(u)}
    for most in (4_000_000, 1500):
        got = K.shared_runs(dd, "doc_id", "text", ii, "item_id", "text", max_chars=most)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert K.shared_runs(dd.where("1 = 0"), "doc_id", "text", ii, "item_id", "text").count() == 0
    assert K.shared_runs(dd, "doc_id", "text", ii.where("1 = 0"), "item_id", "text").count() == 0


def test_paraphrases(spark):
    rng = random.Random(4)
    vocab = [f"слово{i}" for i in range(500)]
    item = rng.choices(vocab, k=24)
    changed = [w if k % 5 else "замена" for k, w in enumerate(item)]
    docs = [(1, " ".join(changed)), (2, " ".join(rng.choices(vocab, k=60))), (3, " ".join(item))] + [(10 + i, " ".join(rng.choices(vocab, k=40))) for i in range(60)]
    got = K.paraphrases(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame([(7, " ".join(item))], "i long, t string"), "i", "t", cosine=0.6)
    assert {(r.doc_id, r.item_id) for r in got.collect()} >= {(1, 7), (3, 7)} and got.where("doc_id not in (1, 3)").count() == 0


def test_paraphrases_at_every_place(spark):
    rng = random.Random(6)
    vocab = [f"слово{i}" for i in range(500)]
    item = [f"вопрос{k}" for k in range(24)]
    changed = [w if k % 5 else "замена" for k, w in enumerate(item)]
    docs = [(n, " ".join([*rng.choices(vocab, k=n), *changed, *rng.choices(vocab, k=30)])) for n in range(25)]
    # the words that are replaced stand in other documents, so that they aren't the item's rarest
    docs += [(100 + i, " ".join(w for x in item[::5] for w in (x, *rng.choices(vocab, k=30)))) for i in range(60)]
    got = K.paraphrases(spark.createDataFrame(docs, "d long, t string").coalesce(2), "d", "t", spark.createDataFrame([(7, " ".join(item))], "i long, t string"), "i", "t")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(n, 7) for n in range(25)}


def test_words_broken_beside_an_apostrophe():
    from quillspan.llm.lookalike import word_hashes

    whole = ["qishlogʻida", "koʻngʻiroqni", "oʻzbek", "mas’ul"]
    broken = ["qishlogʻ-\nida", "koʻng-  ʻiroqni", "oʻ- zbek", "mas-\n’ul"]
    for a, b in zip(whole, broken, strict=True):
        assert words(a) == words(b) and len(words(b)) == 1
        assert word_hashes([a, b])[1].tolist() == word_hashes([a, a])[1].tolist()
    assert len(words("bog'- 'ida")) == 2 and len(words("да- да' - нет")) == 2


def _planted(rng, n):
    """Items, and documents into which a paraphrase of some 24 to 40 words of an item is put at any place."""
    vocab = ["".join(rng.choices("абвгдежзиклмнопрст", k=rng.randint(3, 9))) for _ in range(3000)]
    weights = [1 / (k + 5) for k in range(3000)]
    text = lambda k: rng.choices(vocab, weights, k=k)
    items = [text(rng.randint(30, 70)) for _ in range(n)]
    docs, truth = [], set()
    for d in range(4 * n):
        t = text(rng.randint(20, 120))
        if d < n:
            w = items[d]
            k = rng.randint(24, min(40, len(w)))
            s = rng.randrange(len(w) - k + 1)
            part = [x if rng.random() > 0.2 else rng.choices(vocab, weights)[0] for x in w[s : s + k]]
            for i in range(len(part) - 1):
                if rng.random() < 0.05:
                    part[i], part[i + 1] = part[i + 1], part[i]
            at = rng.randrange(len(t) + 1)
            t = t[:at] + part + t[at:]
            truth.add((d, d))
        docs.append((d, " ".join(t)))
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)], truth


def test_planted_paraphrases_are_found(spark):
    docs, items, truth = _planted(random.Random(12), 150)
    got = {(r.doc_id, r.item_id) for r in K.paraphrases(spark.createDataFrame(docs, "d long, t string").repartition(3), "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t").collect()}
    print("RECALL", len(got & truth) / len(truth), len(got - truth))
    assert len(got & truth) >= 0.9 * len(truth), len(got & truth) / len(truth)
    assert len(got - truth) <= 0.02 * len(truth)


def test_paraphrases_are_those_of_all_pairs(spark):
    docs, items, _ = _planted(random.Random(13), 8)
    dd, ii = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string")
    width, cosine, share = 24, 0.5, 0.6
    _, item_words, table, weight = K._corpus(dd, "d", "t", ii, "i", "t", 64, width)
    block = item_words.toPandas().sort_values("id", ignore_index=True)
    vocab, ids, item_no = K._vocabulary(block)
    nothing = len(vocab)
    passages, owner = K._passages(ids, item_no, width, width // 8, nothing)
    rarest = K._rarest(passages, np.append(weight[K._feature(vocab)], 0.0), 3, nothing)
    of_word = np.vstack((table[K._feature(vocab)], table[-1:]))
    vectors, want = K._vectors(passages, of_word), set()
    for d, t in docs:
        places = K._places(K.word_hashes([t])[1], vocab)
        q = K._from(places, np.array([0, len(places)]), np.zeros(len(places), int), np.arange(len(places)), width, nothing)
        cos = K._vectors(q, of_word) @ vectors.T
        for p in range(len(passages)):
            rare = set(rarest[p].tolist()) - {nothing}
            hit = np.array([len(rare & set(w.tolist())) for w in q])
            n = (passages[p] != nothing).sum()
            lcs = K.lcs_lengths(np.repeat(passages[p : p + 1], len(q), 0), q, nothing) / n
            if ((cos[:, p] >= cosine) & (hit >= max(1, len(rare) - 1)) & (lcs >= share)).any() and n >= 4:
                want.add((d, int(block["id"][owner[p]])))
    for most in (4_000_000, 3000):
        assert {(r.doc_id, r.item_id) for r in K.paraphrases(dd, "d", "t", ii, "i", "t", max_chars=most).collect()} == want
    assert len(want) >= 3
    assert K.paraphrases(dd.where("1 = 0"), "d", "t", ii, "i", "t").count() == 0 and K.paraphrases(dd, "d", "t", ii.where("1 = 0"), "i", "t").count() == 0


def test_lcs():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 6, (50, 12)), rng.integers(0, 6, (50, 12))

    def plain(x, y):
        d = np.zeros((13, 13), int)
        for i in range(12):
            for j in range(12):
                d[i + 1, j + 1] = d[i, j] + 1 if x[i] == y[j] and x[i] != 5 else max(d[i, j + 1], d[i + 1, j])
        return d[12, 12]

    assert K.lcs_lengths(a, b, 5).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_every_form_of_address_has_a_sign():
    for form in ("ivan [ at ] mail.uz", "ivan (et) mail.uz", "ivan at mail (dot) uz", "ivan at mail[dot]uz", "ivan@mail.uz"):
        assert P.EMAIL.fullmatch(form)
        assert P.items_in(f"пишите {form}, спасибо") == [("email", 7, 7 + len(form))]
