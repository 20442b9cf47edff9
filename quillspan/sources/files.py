"""Readers and sinks: all of them plain scans or writes, so that pruning and pushdown work."""

from __future__ import annotations

import html
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T


def requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Requests, one JSON object a file, with or without an envelope ``{"request": ...}``."""
    raw = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", schema)
    inner = F.from_json("value", f"request struct<{schema}>")["request"]
    return raw.select(F.coalesce(F.when(inner.isNotNull(), inner), bare).alias("r"), F.col("_metadata.file_name").alias("file_name")).select("file_name", "r.*")


def keyed_pages(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(file, value) of a JSON object whose keys are page files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string, {value_schema}>")).alias("file", "value"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Training labels, one JSON object a line; a missing split is train."""
    return spark.read.schema("file string, text string, split string").json(path).withColumn("split", F.coalesce("split", F.lit("train")))


def distinct_labels(rows: DataFrame, split: str = "train") -> DataFrame:
    """(text): the distinct scored forms of the labels of a split."""
    return rows.where(F.col("split") == split).select(T.scored_form(F.col("text")).alias("text")).where("text is not null").distinct()


def ink(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, label, traces) of InkML files: the normalised label if there is one, and traces of at least two points."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text in zip(batch["file_name"], batch["value"], strict=True):
                try:
                    root = ET.fromstring(text)
                except ET.ParseError:
                    continue
                local = lambda e: e.tag.rsplit("}", 1)[-1]
                notes = {e.get("type"): html.unescape(e.text or "") for e in root.iter() if local(e) == "annotation"}
                traces = [[[float(v) for v in p.split()[:2]] for p in (e.text or "").split(",") if p.strip()] for e in root.iter() if local(e) == "trace"]
                rows.append((name, notes.get("normalizedLabel") or notes.get("label"), [t for t in traces if len(t) >= 2]))
            yield pd.DataFrame(rows or None, columns=["file_name", "label", "traces"])

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return raw.mapInPandas(parse, "file_name string, label string, traces array<array<array<double>>>")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(key), key, "left_anti")


def write_csv(rows: DataFrame, path: str, *without: str) -> None:
    """Metrics as CSV, without nested columns."""
    rows.drop(*without).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; absent fields are left out, not written as null."""
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)
