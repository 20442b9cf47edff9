"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import components, leakage, lookalike, mixture, packing, personal, splitleak, tokens
from quillspan.session import table


def _exam(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents"), "doc_id", "text", table(spark, d, "exam_item"), "item_id", "text"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.shared_runs(*_exam(spark, d))


def p1_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leakage.paraphrases(*_exam(spark, d))


IMAGE_CODES = ["writer", "notebook", "sheet"]
SPLITS = {"train": 0.8, "val": 0.1, "test": 0.1}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.groups(table(spark, d, "page_image"), "image_id", IMAGE_CODES).withColumnRenamed("id", "image_id")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every image with its split and the number of its annotations (a row delivered twice counts once)."""
    images = components.assign_splits(table(spark, d, "page_image"), "image_id", IMAGE_CODES, SPLITS)
    anns = table(spark, d, "page_ann").groupBy(F.col("image_id").alias("id")).agg(F.count_distinct("ann_id").alias("n_annotations"))
    return images.join(anns, "id", "left").select(F.col("id").alias("image_id"), "anchor_id", "split", F.coalesce("n_annotations", F.lit(0)).cast("long").alias("n_annotations"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitleak.row_pairs(*splitleak.overlaps(table(spark, d, "train_label"), "label_id", "text", "split"))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return splitleak.coverage_report(table(spark, d, "train_label"), "label_id", "text", "split", "source")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return splitleak.record_coverage(table(spark, d, "train_label"), "label_id", "text", "split", "source").withColumnRenamed("id", "label_id")


def _texts(spark: SparkSession, d: str, *tables: tuple[str, str]) -> DataFrame:
    rows = None
    for name, key in tables:
        part = table(spark, d, name).select(F.lit(name).alias("tbl"), F.col(key).alias("id"), "text")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    made = lookalike.same_look_pairs(_texts(spark, d, ("gt_line", "line_id"), ("dictation_key", "key_id")), "id", "text", within="tbl")
    return made.withColumnRenamed("within", "tbl")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three tables in its consistent form."""
    rows = _texts(spark, d, ("gt_line", "line_id"), ("dictation_key", "key_id"), ("train_label", "label_id"))
    return lookalike.consistent_form(rows, "text").select("tbl", "id", "form")


def _sized(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return tokens.with_sizes(table(spark, d, "documents"), "doc_id", "text", *keep)


def p6_bins(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d)).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(_sized(spark, d)))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    made, _ = mixture.mix(_sized(spark, d, "source"), table(spark, d, "mix_target"))
    return mixture.shuffled(made).withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_sized(spark, d, "source"), table(spark, d, "mix_target"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_items(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "kind", "start_pos")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(table(spark, d, "documents").select("doc_id", "text"), "text", "key of the test tables").select("doc_id", "redacted")


QUERIES = {f.__name__: f for f in (p1_found, p1_paraphrases, p2_found, p2_splits, p3_found, p3_coverage, p3_records, p5_found, p5_forms, p6_bins, p6_fill, p7_mixture, p7_shares, p8_found, p8_redacted)}
_CODES = " UNION ALL ".join(f"SELECT image_id AS id, '{i}:' || {c} AS code FROM (SELECT image_id, lower(regexp_replace({c}, '{components.BLANK_OR_DASH}', '', 'g')) AS {c} FROM page_image) WHERE {c} NOT IN ({{}})" for i, c in enumerate(IMAGE_CODES))
_CODES = _CODES.replace("{}", ", ".join("'" + u.replace("'", "''") + "'" for u in components.UNKNOWN))
ORACLE: dict[str, str] = {
    # every image and the heads of its codes, closed by recursion
    "p2_found": f"WITH RECURSIVE c AS ({_CODES}), h AS (SELECT id AS a, min(id) OVER (PARTITION BY code) AS b FROM c), e AS (SELECT a, b FROM h WHERE a <> b UNION SELECT b, a FROM h WHERE a <> b),"
    " r(id, x) AS (SELECT DISTINCT image_id, image_id FROM page_image UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a)"
    " SELECT min(x) AS anchor_id, id AS image_id FROM r GROUP BY id HAVING min(x) <> id",
}
