"""Splits that keep related records together (problem 2).

Records that share a value of any of several code columns belong together, and groups are closed under this.
The groups are the connected components of a graph, found by frontier breadth-first search from many seeds at
once:

* every record is tied to the head of each of its codes (through the heads of hashed parts of the code, so no
  record's adjacency list is longer than a part of a hot code),
* a vertex whose hashed rank is smaller than that of all its neighbours is a seed; all seeds expand together,
  frontier by frontier, along adjacency lists partitioned by vertex,
* where two searches meet, their seeds are an edge of a smaller graph. The first search is always made over the
  whole graph; a graph of seeds of at most ``small`` edges (32 MB) is merged in one task, a larger one is searched
  like the first. The result is the same whichever way a graph goes.

A search takes a fixed number of frontiers, so the number of jobs grows with the logarithm of the rows at most.

Codes that differ in letter case, blanks, hyphens and underscores are the same; null, empty and "not known"
codes join nothing. A null id gives no row; rows repeated under one id are one record with all their codes. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.session import written

# What stands for "not known" once case, blanks, hyphens and underscores are gone.
UNKNOWN = (
    "", "?", "??", "???", ".", "/", "—", "–", "n/a", "na", "n.a.", "nan", "null", "none", "nil", "unknown", "unk", "undefined", "missing", "notknown",
    "tbd", "x", "xxx", "нетданных", "нет", "неизвестно", "неизвестен", "неизвестна", "неизв", "неизв.", "неуказано", "неуказан", "н/д", "нд", "н.д.",
    "noma'lum", "nomaʼlum", "nomaʻlum", "noma’lum", "nomalum", "yo'q", "yoʻq",
)

BLANK_OR_DASH = r"[\s\x{A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}_\x{2010}-\x{2015}\x{2212}-]"


def clean_code(column: str) -> Column:
    """A code without regard to letter case, blanks, hyphens and underscores; null if it says "not known"."""
    c = F.lower(F.regexp_replace(F.col(f"`{column}`").cast("string"), BLANK_OR_DASH, ""))
    return F.when(~c.isin(*UNKNOWN), c)


def code_edges(rows: DataFrame, key: str, codes: list[str], salts: int = 1024) -> DataFrame:
    """(src, dst): each record and the head of its code, through the heads of ``salts`` parts of the code.

    A head is the record of smallest hashed rank, so a head of all its codes is a seed of the first search.
    """
    pairs = rows.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.explode(F.array(*[F.when(clean_code(c).isNotNull(), F.concat(F.lit(f"{i}:"), clean_code(c))) for i, c in enumerate(codes)])).alias("code"),
    ).where("id is not null and code is not null")
    part = Window.partitionBy("code", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(salts)))
    tied = written(pairs.select("id", "code", F.min(_rank("id", 1)).over(part)["id"].alias("sub")).distinct())
    heads = tied.where("id = sub").select("code", "sub")  # at most ``salts`` rows a code
    head = heads.groupBy("code").agg(F.min(_rank("sub", 1))["sub"].alias("head"))
    return (
        tied.where("id <> sub")
        .select(F.col("id").alias("src"), F.col("sub").alias("dst"))
        .unionByName(heads.join(head, "code").where("sub <> head").select(F.col("sub").alias("src"), F.col("head").alias("dst")))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )


def _rank(column: str, salt: int) -> Column:
    return F.struct(F.xxhash64(F.col(column), F.lit(salt)), F.col(column))


def _lookup(rows: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row a ``column``), null where it has none.

    Values that more than a thousandth of all rows hold are fewer than 1,000: they are broadcast, and no task
    gets all rows of such a value.
    """
    often = rows.groupBy(column).agg(F.count("*").alias("n_"))
    total = rows.count()
    hot = often.where(F.col("n_") * 1000 > total).select(column)
    near = rows.join(F.broadcast(found.join(F.broadcast(hot), column, "right")), column)
    return near.unionByName(rows.join(F.broadcast(hot), column, "left_anti").join(found, column, "left"))


def _search(edges: DataFrame, salt: int, hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """One search over ``edges``: (v, seed) of all vertices, and the edges between seeds whose searches met.

    The adjacency lists are partitioned by vertex once (a lost part is made again from ``edges``, which is a
    written table); a frontier, the vertices the last step has reached first, is brought to them. Each step writes
    only what it reached. A vertex that no search reaches in ``hops`` steps is a seed of the next, smaller graph.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).repartition(parts, "src").persist(StorageLevel.DISK_ONLY)
    least = both.groupBy("src").agg(F.min(_rank("dst", salt)).alias("n"))
    frontier = labels = written(least.where(_rank("src", salt) < F.col("n")).select(F.col("src").alias("v"), F.col("src").alias("seed")))
    for _ in range(hops):
        reached = both.join(frontier.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("seed").alias("seed"))
        frontier = written(reached.join(labels, "v", "left_anti"))
        labels = labels.unionByName(frontier)
    missed = both.select(F.col("src").alias("v")).distinct().join(labels, "v", "left_anti")
    labels = labels.unionByName(written(missed.select("v", F.col("v").alias("seed"))))
    both.unpersist()
    of = lambda end, name: labels.select(F.col("v").alias(end), F.col("seed").alias(name))
    met = edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a <> b")
    return labels, written(met.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct())


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, root) of a small graph: smaller labels win at both ends of an edge, and labels are followed to their end."""
    parts = [b.to_numpy(np.int64) for b in batches if len(b)]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate(parts), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    yield pd.DataFrame({"v": ids, "root": ids[label]})


def _roots(edges: DataFrame, small: int, salt: int) -> DataFrame:
    """(v, root) of every vertex of the graph of seeds that met."""
    if edges.count() <= small:
        # 16 bytes an edge: the graph of met seeds fits one task
        return written(edges.coalesce(1).mapInPandas(_merge, "v long, root long"))
    labels, met = _search(edges, salt)
    upper = _roots(met, small, salt + 1).withColumnRenamed("v", "seed")
    return written(_lookup(labels, "seed", upper).select("v", F.coalesce("root", "seed").alias("root")))


def components(edges: DataFrame, small: int = 2_000_000) -> DataFrame:
    """(v, anchor): for each vertex of an edge, the smallest vertex of its component."""
    labels, met = _search(written(edges), 1)
    seeds = labels.groupBy("seed").agg(F.min("v").alias("least"))
    rooted = written(seeds.join(_roots(met, small, 2).withColumnRenamed("v", "seed"), "seed", "left").select("seed", F.coalesce("root", "seed").alias("root"), "least"))
    anchors = rooted.groupBy("root").agg(F.min("least").alias("anchor"))
    return _lookup(labels, "seed", written(_lookup(rooted, "root", anchors).select("seed", "anchor"))).select("v", "anchor")


def groups(rows: DataFrame, key: str, codes: list[str]) -> DataFrame:
    """(anchor_id, id) for every record that isn't the smallest of its group."""
    return components(code_edges(rows, key, codes)).where("v <> anchor").select(F.col("anchor").alias("anchor_id"), F.col("v").alias("id"))


def assign_splits(
    rows: DataFrame, key: str, codes: list[str], shares: dict[str, float], *, seed: int = 0, large: float = 0.01, buckets: int = 4096
) -> DataFrame:
    """(id, anchor_id, split): every record, with records that belong together in one split.

    Components are taken in the order of their hash, and the running number of records cuts the order at the
    given shares; it is summed over ``buckets`` of the hash, so no task holds the whole order. A component of more
    than ``large`` of all records would overshoot a cut by more than that, so these (fewer than 1 / ``large``) are
    placed first, largest first, each in the split that lacks most, and the cuts are set for what is left. The
    limit is a share of the records: the same data ten times over are split alike.
    """
    ids = rows.select(F.col(f"`{key}`").cast("long").alias("id")).where("id is not null").distinct()
    member = written(ids.join(groups(rows, key, codes), "id", "left").select("id", F.coalesce("anchor_id", "id").alias("anchor_id")))
    sizes = written(member.groupBy("anchor_id").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    names = list(shares)
    room = {s: shares[s] / sum(shares.values()) * total for s in names}
    placed, rest_total = [], total
    for r in sizes.where(F.col("n") > large * total).orderBy(F.desc("n"), "anchor_id").collect():  # fewer than 1 / large
        best = max(names, key=lambda s: room[s])
        room[best] -= r.n
        rest_total -= r.n
        placed.append((r.anchor_id, best))
    big = rows.sparkSession.createDataFrame(placed, "anchor_id long, split string")
    left = {s: max(0.0, x) for s, x in room.items()}
    scale = sum(left.values()) or 1.0
    rest = sizes.where(F.col("n") <= large * total).withColumn("h", F.xxhash64("anchor_id", F.lit(seed)))
    rest = rest.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    by_bucket = rest.groupBy("bucket").agg(F.sum("n").alias("m"))  # at most ``buckets`` rows
    before = by_bucket.select("bucket", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("before"))
    run = rest.join(F.broadcast(before), "bucket").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "anchor_id")))
    middle, edge, cuts, choice = F.col("upto") - F.col("n") / 2, 0.0, [], F.lit(names[-1])
    for s in names[:-1]:
        edge += left[s] / scale * rest_total
        cuts.append((s, edge))
    for s, e in reversed(cuts):
        choice = F.when(middle <= e, F.lit(s)).otherwise(choice)
    of_component = run.select("anchor_id", choice.alias("split")).unionByName(big)
    return _lookup(member, "anchor_id", of_component).select("id", "anchor_id", "split")
