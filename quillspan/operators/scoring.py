"""Scores of read lines: line, page, overall, bootstrap. Pages are reduced to sums before anything is resampled."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions import geometry as G
from quillspan.functions import text as T
from quillspan.functions.kernels import edit_distance_col, word_edits_col, word_error_rate
from quillspan.functions.likeness import like_any, prepared
from quillspan.session import written


def prediction_lines(pred: DataFrame, page: str, value: str) -> DataFrame:
    """(page, pj, text) of predictions given as one string a page; lines that are empty once normalised are left out."""
    return (
        pred.select(F.col(page), F.posexplode(F.split(F.col(value), r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]")).alias("pj", "text"))
        .where(F.trim(F.regexp_replace("text", r"[ \t]+", " ")) != "")
        .withColumn("pj", F.row_number().over(Window.partitionBy(page).orderBy("pj")) - 1)
    )


def line_scores(lines: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Add ref, hyp (scored form), cer, edits, n_chars, n_words, word_hits, perfect. A null ``hyp`` is an unmatched line."""
    df = lines.withColumn("ref", T.scored_form(F.col(ref))).withColumn("hyp", T.scored_form(F.col(hyp)))
    n_words = F.size(T.words_of(F.col("ref")))
    hits = word_edits_col("ref", "hyp")["hits"]
    return df.withColumns(
        {
            "cer": F.when(F.col("hyp").isNotNull(), T.char_error_rate(F.col("ref"), F.col("hyp"))),
            "n_chars": F.length("ref").cast("long"),
            "n_words": n_words.cast("long"),
            "word_hits": F.when(F.col("hyp").isNotNull(), hits).otherwise(0).cast("long"),
            "perfect": F.coalesce(F.col("ref") == F.col("hyp"), F.lit(False)),
        }
    ).withColumn("edits", F.coalesce(F.col("cer") * F.col("n_chars"), F.col("n_chars").cast("double")))


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is 0."""
    return F.when(bottom != 0, top / bottom)


def aggregate_lines(only: Column | None = None) -> list[Column]:
    """Ratios of sums: character error rate of matched and of all lines, word accuracy, perfect share."""
    ok = F.lit(True) if only is None else only
    matched = ok & F.col("cer").isNotNull()
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    return [
        F.count_if(ok).alias("n_lines"),
        ratio(total("edits", matched), total("n_chars", matched)).alias("cer_matched"),
        ratio(total("edits", ok), total("n_chars", ok)).alias("cer_all"),
        ratio(total("word_hits", ok), total("n_words", ok)).alias("word_accuracy"),
        ratio(F.count_if(ok & F.col("perfect")), F.count_if(ok)).alias("perfect_share"),
    ]


def matched_lines(gt: DataFrame, pred: DataFrame, pairs: DataFrame, page: str = "file") -> DataFrame:
    """Line scores of true lines (page, gi, text, bbox) with the predicted line (page, pj, text, bbox) that ``pairs`` (page, gi, pj) gives each; hyp is null without one."""
    both = gt.select(page, "gi", F.col("text").alias("gt_text"), F.col("bbox").alias("gt_box")).join(pairs.select(page, "gi", "pj"), [page, "gi"], "left")
    both = both.join(pred.select(page, "pj", F.col("text").alias("pred_text"), F.col("bbox").alias("pred_box")), [page, "pj"], "left")
    hit = F.when(F.col("pred_box").isNotNull(), (G.iou(F.col("gt_box"), F.col("pred_box")) > 0.3).cast("int"))
    return line_scores(both, "gt_text", "pred_text").withColumn("box_hit", hit)


def page_scores(lines: DataFrame, page: str, place: str, pred: DataFrame | None = None) -> DataFrame:
    """One row a page. The page's error rates align the whole page: true lines in order, and predictions that belong to no line
    after them (``pred``: page, pj, text; ``lines`` then has pj)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("k"), "ref", F.coalesce("hyp", F.lit("")).alias("hyp"))))
    # the page alignment is what costs: pages are spread over all tasks, and the grouping needs no other shuffle
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    boxes = [F.avg("box_hit").alias("box_hit_rate")] if "box_hit" in lines.columns else []
    df = lines.repartition(parts, page).groupBy(page).agg(
        ordered.alias("o"),
        F.avg("cer").alias("mean_cer"),
        ratio(F.count("cer"), F.count("*")).alias("line_recall"),
        F.count("*").alias("n_lines"),
        F.sum("n_chars").alias("n_chars"),
        F.sum("edits").alias("edits"),
        F.sum("n_words").alias("n_words"),
        F.sum("word_hits").alias("word_hits"),
        F.count_if("perfect").alias("n_perfect"),
        *boxes,
    )
    extra = F.array().cast("array<string>")
    if pred is not None:
        used = lines.where("pj is not null").select(page, "pj")
        left = pred.where("text is not null").join(used, [page, "pj"], "left_anti").groupBy(page).agg(F.array_sort(F.collect_list(F.struct("pj", T.scored_form(F.col("text")).alias("t")))).alias("x"))
        df = df.join(left, page, "left")
        extra = F.coalesce(F.transform("x", lambda x: x["t"]), extra)
    joined = lambda f, more: F.array_join(F.concat(F.transform("o", lambda x: x[f]), more), "\n")
    none = F.array().cast("array<string>")
    df = df.withColumns({"page_ref": T.strip(joined("ref", none)), "page_hyp": T.strip(joined("hyp", extra)), "extra_lines": F.size(extra).cast("long")})
    df = df.withColumn("page_edits", edit_distance_col("page_ref", "page_hyp"))
    rate = F.when(F.length("page_ref") == 0, F.when(F.length("page_hyp") == 0, 0.0).otherwise(1.0)).otherwise(F.col("page_edits") / F.length("page_ref"))
    df = df.withColumns({"page_cer": rate, "page_wer": word_error_rate(F.col("page_ref"), F.col("page_hyp")), "line_cer": F.coalesce("mean_cer", F.lit(1.0))})
    return df.drop("o", "x", "mean_cer", "page_ref", "page_hyp", "page_edits")


def overall(pages: DataFrame) -> DataFrame:
    """One row over all pages (see ``page_scores``)."""
    more = [F.avg("box_hit_rate").alias("box_hit_rate_mean")] if "box_hit_rate" in pages.columns else []
    if "teacher_marks" in pages.columns:
        marked = F.coalesce("teacher_marks", F.lit(0)) > 0
        more += [F.avg(F.when(~marked, F.col("page_cer"))).alias("page_cer_clean_pages"), F.avg(F.when(marked, F.col("page_cer"))).alias("page_cer_marked_pages")]
    return pages.agg(
        F.count("*").alias("n_pages"),
        ratio(F.sum(F.col("page_cer") * F.col("n_chars")), F.sum("n_chars")).alias("page_cer_cw"),
        F.median("page_cer").alias("page_cer_median"),
        F.avg("page_wer").alias("page_wer_mean"),
        F.avg("line_cer").alias("line_cer_mean"),
        F.median("line_cer").alias("line_cer_median"),
        F.avg("line_recall").alias("line_recall_mean"),
        F.sum("extra_lines").alias("extra_lines"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("n_chars").alias("n_chars"),
        *more,
    )


BUCKET_DIGITS = 2


def draw_of(seed: int, b: Column, i: Column, k: Column) -> Column:
    """A place below k, drawn with replacement: the first eight digits of a hash of seed, resample and draw, which any engine can make."""
    return F.conv(F.left(F.md5(F.concat_ws("-", F.lit(seed), b, i)), F.lit(8)), 16, 10).cast("long") % k


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Add ``pick``: rows numbered from 0 by bucket of the key's hash and key. Only the 256 sizes of buckets meet in one task."""
    bucket = F.left(F.md5(F.col(key).cast("string")), F.lit(BUCKET_DIGITS))
    df = rows.withColumn("__bucket", bucket)
    sizes = df.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(key)) - 1
    return df.withColumn("__place", place).join(F.broadcast(before), "__bucket").withColumn("pick", (F.col("__before") + F.col("__place")).cast("long")).drop("__bucket", "__place", "__before")


def bootstrap(sums: DataFrame, key: str, num: str, den: str, n: int = 1000, other: tuple[str, str] | None = None, seed: int = 0) -> DataFrame:
    """Percentile interval of a ratio of page sums (or of its difference to the ratio ``other`` of the same pages, on the same draws).

    ``sums`` has one row a page; a resample draws as many pages as there are, with replacement. n pages make n * resamples rows of three
    numbers, whatever the number of lines.
    """
    more = {"other_num": F.col(other[0]), "other_den": F.col(other[1])} if other else {}
    pages = numbered(sums.select(F.col(key).alias("key"), F.col(num).alias("num"), F.col(den).alias("den"), *[c.alias(a) for a, c in more.items()]), "key")
    size = pages.agg(F.count("*").alias("k"))
    spread = (
        pages.select(F.col("pick").alias("i"))
        .crossJoin(F.broadcast(size))  # one row
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
        .select("b", draw_of(seed, F.col("b"), F.col("i"), F.col("k")).alias("pick"))
    )
    rate = lambda a, b: F.sum(a) / F.greatest(F.sum(b), F.lit(1e-9))
    per = spread.join(pages, "pick").groupBy("b").agg((rate("num", "den") - (rate("other_num", "other_den") if other else F.lit(0.0))).alias("v"))
    low, high = F.percentile("v", 0.025), F.percentile("v", 0.975)
    out = [low.alias("low"), F.avg("v").alias("mean"), high.alias("high")]
    return per.agg(*out, *([((high < 0) | (low > 0)).alias("significant")] if other else []))


def seen_lines(lines: DataFrame, key: str, text: str, train: DataFrame, train_text: str, threshold: float = 80.0, min_chars: int = 8, block: int = 131_072) -> DataFrame:
    """(key, seen): whether a training text is at least ``threshold`` percent like a line; null for short and null lines.

    The lines are a query set against all training texts, in blocks of ``block`` distinct lines that reach every task (some tens of
    megabytes); equal texts are found by a join first. A pair is measured unless bounds of lengths, letters and letter pairs rule it
    out (see ``likeness``), so nothing is lost; the time grows with lines times training texts.
    """
    line = lines.select(F.col(key).alias("key"), T.scored_form(F.col(text)).alias("a"))
    a = line.where(F.length("a") >= min_chars).select("a").distinct()
    b = written(train.select(T.scored_form(F.col(train_text)).alias("b")).where("b <> ''").distinct())
    split = written(a.join(b, F.col("a") == F.col("b"), "left").select("a", F.isnotnull("b").alias("equal")))
    hit, rest = split.where("equal").select("a"), split.where("not equal").select("a")
    n = -(-rest.count() // block)
    sc = lines.sparkSession.sparkContext
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in range(n):
        part = rest if n == 1 else rest.where(F.pmod(F.xxhash64("a"), F.lit(n)) == k)
        given = sc.broadcast(prepared(sorted(r.a for r in part.collect()), threshold))  # some ``block`` lines

        def search(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"a": pd.Series(like_any(given.value, gathered(x["b"] for x in batches)), dtype=object)})

        hit = hit.unionByName(b.repartition(parts).mapInPandas(search, "a string"))  # every task has a part of the texts
    hit = hit.distinct().withColumn("hit", F.lit(True))
    return line.join(hit, "a", "left").select("key", F.when(F.length("a") >= min_chars, F.coalesce("hit", F.lit(False))).alias("seen"))


def gathered(batches: Iterable[pd.Series], size: int = 40_000) -> Iterator[list[str]]:
    """Texts in lists of at least ``size``, the last one aside."""
    held: list[str] = []
    for x in batches:
        held += x.tolist()
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held
