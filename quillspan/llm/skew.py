"""Joins in which one value may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import written


def often(rows: DataFrame, column: str, share: float = 0.001) -> DataFrame:
    """Values that more than ``share`` of all rows have: fewer than 1 / ``share``, so they can be broadcast."""
    counts = written(rows.groupBy(column).agg(F.count("*").alias("n_")))
    n = counts.agg(F.sum("n_")).first()[0] or 0
    return counts.where(F.col("n_") > share * n).select(column)


def spread_join(
    left: DataFrame, right: DataFrame, column: str, left_key: str, right_key: str, parts: int = 8, left_often: DataFrame | None = None, right_often: DataFrame | None = None
) -> DataFrame:
    """Inner join on ``column``. Rows of a value that is frequent on either side (fewer than 2,000 values) are split by their
    keys into ``parts`` on both sides, and the parts meet pairwise, so no task holds such a value whole.

    Either side is read twice, once to count its values, unless the caller knows which are frequent.
    """
    both = [often(df, column) if known is None else known for df, known in ((left, left_often), (right, right_often))]
    hot = F.broadcast(both[0].unionByName(both[1]).distinct().withColumn("p_", F.lit(parts)))

    def split(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        n = F.coalesce("p_", F.lit(1))
        df = df.join(hot, column, "left").withColumn(own, F.pmod(F.xxhash64(key), n).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), n - 1))).drop("p_")

    return split(left, left_key, "l_", "r_").join(split(right, right_key, "r_", "l_"), [column, "l_", "r_"]).drop("l_", "r_")
