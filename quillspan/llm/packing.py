"""Filling fixed-capacity containers with items (problem 6).

First-fit decreasing, run independently in randomised groups of documents. A group holds ``group_size`` items
on average, drawn by the hash of the document, so no source, author or run of ids makes a group larger than
others; first-fit decreasing wastes less than one open container a group beyond what the sizes force. In a
group the open containers are the leaves of a tournament tree of their free room, and the first container
with room is found in logarithmic time.

An item longer than the capacity is split into full containers and a rest, in token offsets; no other item is
split. Items of 0 tokens (null and empty texts) take no room and are put in the first container of their group.
A null id gives no row; an id that comes twice is two items. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import written


class TournamentTree:
    """Free room of containers; the winner of each match is the larger room."""

    def __init__(self, leaves: int, capacity: int):
        self.size = 1
        while self.size < max(1, leaves):
            self.size *= 2
        self.room = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """The first container with room for ``need``, from which the room is taken."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < need:
                at += 1
        leaf = at - self.size
        room[at] -= need
        at //= 2
        while at:
            best = room[2 * at] if room[2 * at] > room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return leaf


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; ties keep their order. Every size is at most the capacity."""
    out = np.zeros(len(sizes), np.int64)
    tree = TournamentTree(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        out[i] = tree.first_fit(int(sizes[i]))
    return out


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(id, piece_no, start_token, n_tokens): an item over the capacity in full pieces and a rest, others whole."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    return sized.withColumn("piece_no", F.explode(F.sequence(F.lit(1), n))).select(
        "id",
        "piece_no",
        ((F.col("piece_no") - 1) * F.lit(capacity)).cast("long").alias("start_token"),
        F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - (F.col("piece_no") - 1) * capacity).cast("long").alias("n_tokens"),
    )


def pack(sized: DataFrame, capacity: int = 2048, group_size: int = 4096, seed: int = 0) -> DataFrame:
    """(group_no, bin_no, id, piece_no, start_token, n_tokens, offset): each piece with its place in its container."""
    items = written(pieces(sized, capacity))
    groups = max(1, -(-items.count() // group_size))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece_no"], ascending=[False, True, True], kind="stable", ignore_index=True)
        pdf["bin_no"] = first_fit_decreasing(pdf["n_tokens"].to_numpy(), capacity)
        pdf["offset"] = pdf.groupby("bin_no")["n_tokens"].cumsum() - pdf["n_tokens"]
        return pdf[["group_no", "bin_no", "id", "piece_no", "start_token", "n_tokens", "offset"]]

    schema = "group_no long, bin_no long, id long, piece_no int, start_token long, n_tokens long, offset long"
    # pieces of a document spread over groups too, so one enormous document doesn't fill a group alone
    return items.withColumn("group_no", F.pmod(F.xxhash64("id", "piece_no", F.lit(seed)), F.lit(groups))).groupBy("group_no").applyInPandas(fill, schema)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, the share of room used."""
    bins = packed.groupBy("group_no", "bin_no").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return bins.agg(
        F.count("*").alias("n_bins"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_pieces"),
        F.coalesce(F.sum("used"), F.lit(0)).cast("long").alias("n_tokens"),
        F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).cast("long").alias("least_bins"),
        (F.sum("used") / (F.count("*") * capacity)).alias("fill_share"),
    )
