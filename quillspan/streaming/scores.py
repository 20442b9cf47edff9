"""Scores of lines that arrive as a stream. The batch operators do the work; a batch is written under its number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.operators import scoring


def score_stream(lines: DataFrame, ref: str, hyp: str, path: str, checkpoint: str) -> StreamingQuery:
    """Score each batch and write it to ``path/batch=n``. A batch that is run again after a failure overwrites itself, so lines count once."""

    def score(batch: DataFrame, number: int) -> None:
        scoring.line_scores(batch, ref, hyp).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Rows a window of event time and key; rows later than ``late`` behind the newest are left out, so state stays bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
