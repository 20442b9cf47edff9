"""Mixing sources to target weights (problem 7).

The documents of a source are laid in a keyed random order and cut into blocks of about ``block_tokens``. A
source's quota is its share of the total; it takes whole passes over its documents and then a beginning of the
next pass, so a document is used at most once more than another, and never more than ``max_repeat`` times. The
block quotas of all sources are split among the output shards by a multivariate-hypergeometric tree: each node
draws how many blocks of each source go to its left half, so the shards are random samples without
replacement of the exact quota, and each shard then takes its own disjoint stretch of each source's permuted
blocks and shuffles locally.

The total is the largest for which every source that has documents can fill its share within its repeats;
``total_tokens`` sets another, and then a source that can't fill its share gives all it may. The shares of sources without
documents go to the others in proportion. Source names are read without regard to case, blanks and hyphens;
documents of a null or unlisted source aren't drawn; empty texts have no tokens and are left out. Null ids give
no row. A target source listed twice counts with its first row's repeats and the sum of its shares. An empty table gives an
empty mixture, and a report of zeros.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspan.session import written

MOST_BLOCKS = 500_000_000  # blocks grow beyond their size where there would be more, so that counts can be drawn exactly


def source_name(column: str) -> Column:
    """A source without regard to case, blanks and hyphens."""
    s = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(f"`{column}`"), r"[\s\x{A0}\x{2000}-\x{200B}\x{3000}]+", " "))), r"[ \-\x{2010}\x{2011}]+", "_")
    return F.when(s != "", s)


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns add up to the quotas, rows differ by at most one block."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, have: np.ndarray, path: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        take = total * (mid - lo) // (hi - lo)
        # source by source; counts stay under MOST_BLOCKS, where the draw is exact
        left, rest, want = np.zeros_like(have), total, take
        rng = np.random.default_rng([seed, path])
        for i, n in enumerate(have.tolist()):
            rest -= n
            left[i] = want if rest == 0 else 0 if want == 0 or n == 0 else rng.hypergeometric(n, rest, want)
            want -= int(left[i])
        split(lo, mid, left, 2 * path)
        split(mid, hi, have - left, 2 * path + 1)

    split(0, shards, quotas.astype(np.int64), 1)
    return out


def _cells(plan: np.ndarray, present: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(source, cell, shard, first block, end block): each shard's stretch of each source's blocks, by cells of about a stretch's
    length, so that a block meets one or a few stretches: at most three rows a source and shard."""
    ends, out = np.cumsum(plan, axis=0), []
    for i in present:
        size = max(1, int(ends[-1, i]) // len(plan))
        for s in np.flatnonzero(plan[:, i]).tolist():
            a, b = int(ends[s, i] - plan[s, i]), int(ends[s, i])
            out += [(i, cell, s, a, b) for cell in range(a // size, (b - 1) // size + 1)]
    return out


def mix(
    sized: DataFrame, targets: DataFrame, *, shards: int | None = None, shard_tokens: int = 1 << 30, block_tokens: int = 8192, total_tokens: int | None = None, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """``sized``: (id, source, n_tokens); ``targets``: (source, target_share, max_repeat), a table of parameters that the driver reads.
    Without ``shards`` there are as many as make ``shard_tokens`` each, 16 at least.

    Returns the mixture (shard, place, source, id, copy_no, n_tokens) and the report (source, target_share,
    available_tokens, drawn_tokens, actual_share, most_uses).
    """
    spark = sized.sparkSession
    wanted = (
        targets.select(source_name("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeat").cast("long").alias("max_repeat"))
        .where("source is not null and share > 0 and max_repeat > 0")
        .groupBy("source")
        .agg(F.sum("share").alias("share"), F.first("max_repeat").alias("max_repeat"))
        .collect()
    )
    wanted.sort(key=lambda r: r.source)
    names = [r.source for r in wanted]
    number = {n: i for i, n in enumerate(names)}
    listed = spark.createDataFrame([(n, i) for n, i in number.items()], "source string, source_no int")
    order = F.xxhash64("id", F.lit(seed))
    docs = written(
        sized.select("id", source_name("source").alias("source"), "n_tokens")
        .where("n_tokens > 0")
        .join(F.broadcast(listed), "source")  # the targets
        .select("source_no", "id", "n_tokens", order.alias("h"))
    )
    # running totals in the permuted order of each source: by the leading bits of the order first, then within a bucket of some million
    bits = max(8, (docs.count() >> 20).bit_length())
    docs = docs.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    by_bucket = docs.groupBy("source_no", "bucket").agg(F.sum("n_tokens").alias("m"))  # at most sources x buckets rows
    before = by_bucket.select("source_no", "bucket", (F.sum("m").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("m")).alias("before"))
    within = Window.partitionBy("source_no", "bucket").orderBy("h", "id")
    laid = docs.join(before, ["source_no", "bucket"]).select("source_no", "id", "n_tokens", (F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("start"))
    size = {r.source_no: r.m for r in by_bucket.groupBy("source_no").agg(F.sum("m").alias("m")).collect()}
    present = [i for i in range(len(names)) if size.get(i)]
    share = {i: wanted[i].share / sum(wanted[j].share for j in present) for i in present}
    room = {i: wanted[i].max_repeat * size[i] for i in present}
    total = total_tokens if total_tokens is not None else int(min((room[i] / share[i] for i in present), default=0))
    quota = {i: min(room[i], int(round(share[i] * total))) for i in present}
    # a source is a ring of its documents read again and again; quota tokens of it are drawn
    drawn_total = sum(quota.values())
    block_tokens = max(block_tokens, -(-drawn_total // (MOST_BLOCKS - len(names) - 1)))
    shards = shards or max(16, -(-drawn_total // shard_tokens))
    blocks = np.array([-(-quota.get(i, 0) // block_tokens) for i in range(len(names))], np.int64)
    plan = split_quotas(blocks, shards, seed) if len(names) else np.zeros((shards, 0), np.int64)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("source_no", "cell", "shard", "first_block", "end_block")])
    stretches = spark.createDataFrame(_cells(plan, present), schema).withColumn("source_no", F.col("source_no").cast("int"))
    limits = spark.createDataFrame([(i, names[i], size[i], quota[i], max(1, int(blocks[i]) // shards)) for i in present], "source_no int, source string, size long, quota long, cell_size long")
    passes = F.floor((F.col("quota") - F.col("start") - 1) / F.col("size")) + 1
    drawn = (
        laid.join(F.broadcast(limits), "source_no")  # the targets
        .where("quota > start")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), passes.cast("long"))))
        .withColumn("at", F.col("start") + (F.col("copy_no") - 1) * F.col("size"))
        # a block is a stretch of the ring; a document belongs to the block in which it starts
        .withColumn("block", F.expr(f"at div {block_tokens}"))
        .withColumn("cell", F.expr("block div cell_size"))
    )
    placed = drawn.join(F.broadcast(stretches), ["source_no", "cell"]).where("block >= first_block and block < end_block")  # shards times targets rows
    local = F.xxhash64("id", "copy_no", F.lit(seed + 1))
    mixture = placed.select("shard", local.alias("place_key"), "source", "id", "copy_no", "n_tokens")
    drawn_by = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.max("copy_no").alias("most_uses"))
    base = spark.createDataFrame([(r.source, r.share, size.get(number[r.source], 0)) for r in wanted], "source string, target_share double, available_tokens long")
    all_drawn = drawn_by.agg(F.sum("drawn_tokens").alias("all_tokens"))
    report = (
        base.join(drawn_by, "source", "left")
        .crossJoin(F.broadcast(all_drawn))  # one row
        .select(
            "source",
            "target_share",
            "available_tokens",
            F.coalesce("drawn_tokens", F.lit(0)).cast("long").alias("drawn_tokens"),
            F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("most_uses", F.lit(0)).cast("long").alias("most_uses"),
        )
    )
    return mixture, report


def shuffled(mixture: DataFrame) -> DataFrame:
    """The mixture with each shard's rows (keys and sizes, not texts) in a random order, for writing one file set a shard."""
    return mixture.repartition("shard").sortWithinPartitions("shard", "place_key", "id", "copy_no")
