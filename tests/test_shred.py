import json

from pyspark.sql import functions as F

from quillspan.operators import shred as S

ROOT = S.group("", S.leaf("a"), S.many("xs", S.leaf("k"), S.box("bbox"), S.many("ys", S.leaf("z"))))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _source(spark, records, extra=False):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records, 1)]
    df = spark.createDataFrame(rows, "rec long, body string")
    return df.withColumns({"key": F.lit("clash"), "columns": F.lit(1)}) if extra else df


RECORDS = [
    {"a": 1, "xs": [{"k": "p", "bbox": [1, "2", 3.0, 4], "ys": [{"z": 1}, None, {"z": 3}]}, None, {"k": None}]},
    {"xs": {"k": "one", "bbox": {"x0": 5, "y0": 6, "x1": 7, "y1": 8}}},
    {"xs": []},
    {"a": None, "xs": None},
    {},
    None,
    "{broken",
    "[1]",
    '{"a": NaN}',
    {"xs": '[{"k": "in a string"}]'},
    {"xs": [{"ys": {"z": "x"}}, {"ys": []}, {"k": "q"}]},
]


def test_levels_and_tables(spark):
    made = S.shred(_source(spark, RECORDS, extra=True), "rec", "body", ROOT)
    first = made.where("key = 1").select("columns.`xs.ys.z`").first()[0]
    # xs.ys.z: two elements and a null between them, then a null parent, then a parent without ys
    assert first["rep"] == [0, 2, 2, 1, 1] and first["vals"] == ["1", "3"]
    assert first["def"] == [5, 3, 5, 1, 2]
    xs = S.flatten(made, ROOT, "xs", {"k": "xs.k", "bbox": "xs.bbox"}, ["n"])
    assert _rows(xs) == sorted(
        [(1, 1, "p", "1|2|3.0|4"), (1, 3, None, None), (2, 1, "one", "5|6|7|8"), (10, 1, "in a string", None), (11, 1, None, None), (11, 2, None, None), (11, 3, "q", None)], key=repr
    )
    ys = S.flatten(made, ROOT, "xs.ys", {"z": "xs.ys.z"}, ["n", "m"], {"a": "a"})
    assert _rows(ys) == sorted([(1, 1, 1, "1", "1"), (1, 1, 3, "3", "1"), (11, 1, 1, "x", None)], key=repr)
    records = S.flatten(made, ROOT, "", {"a": "a"}, [])
    assert [r.key for r in records.orderBy("key").collect()] == [1, 2, 3, 4, 5, 10, 11]


def test_pruned_schema_gives_the_same(spark):
    small = S.prune(ROOT, {"xs.k"})
    whole = S.flatten(S.shred(_source(spark, RECORDS), "rec", "body", ROOT), ROOT, "xs", {"k": "xs.k"}, ["n"])
    part = S.flatten(S.shred(_source(spark, RECORDS), "rec", "body", small), small, "xs", {"k": "xs.k"}, ["n"])
    assert _rows(whole) == _rows(part)


def test_empty_table_and_long_bodies(spark):
    empty = S.shred(_source(spark, []) if False else spark.createDataFrame([], "rec long, body string"), "rec", "body", ROOT)
    assert S.flatten(empty, ROOT, "xs", {"k": "xs.k"}, ["n"]).count() == 0
    long_ = _source(spark, [{"xs": [{"k": str(i)} for i in range(20_000)]}])
    got = S.flatten(S.shred(long_, "rec", "body", ROOT), ROOT, "xs", {"k": "xs.k"}, ["n"])
    assert got.where("cast(k as long) <> n - 1").count() == 0 and got.count() == 20_000


def test_numbers(spark):
    df = spark.createDataFrame([(" 1,25",), ("7.5",), ("",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(S.number_of(F.col("t"))).collect()] == [1.25, 7.5, None, None, None]
