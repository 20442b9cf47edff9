"""A dictation against its key: words are aligned, and what differs is classified."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from quillspan.functions import geometry as G
from quillspan.functions import text as T
from quillspan.functions.kernels import align_words

PAIRS = ArrayType(StructType([StructField("ki", IntegerType()), StructField("hj", IntegerType())]))


@F.pandas_udf(PAIRS)
def aligned(key: pd.Series, read: pd.Series, ignore_case: pd.Series) -> pd.Series:
    """Pairs of places of two arrays of words."""
    return pd.Series([[{"ki": i, "hj": j} for i, j in align_words(list(k), list(r), bool(c))] for k, r, c in zip(key, read, ignore_case, strict=True)])


def align(jobs: DataFrame, job: str = "job_id") -> DataFrame:
    """Jobs (job, key array of tokens, read array of tokens, ignore_case, ...) as one row a pair, in order.

    Alignment is per job, in the row, and costs far more than moving the words: jobs are spread over all tasks
    first, and the pairs are written once for what is made of them.
    """
    jobs = jobs.repartition(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), job)
    texts = lambda c: F.transform(F.col(c), lambda t: t["text"])
    made = jobs.withColumn("pairs", aligned(texts("key"), texts("read"), F.coalesce("ignore_case", F.lit(False))))
    return made.select("*", F.posexplode("pairs").alias("n", "pair")).select(
        *[F.col(c) for c in jobs.columns if c not in ("key", "read")],
        F.size("key").alias("n_key"),
        "n",
        F.get("key", F.col("pair.ki")).alias("k"),
        F.get("read", F.col("pair.hj")).alias("h"),
    )


NO_BOX = {"x0": 0.0, "y0": 0.0, "x1": 0.0, "y1": 0.0}


def errors(pairs: DataFrame, job: str = "job_id", review_below: float = 0.6) -> DataFrame:
    """(job, n, kind, mark, expected, written, bbox, line_id, line_pos, confidence, needs_review) of each error; a pair can have two.

    A token that was read has struct<text, punct_after, bbox, line_id, line_pos, confidence>. An error of a word that is missing
    stands in the gap beside its neighbours and takes line and confidence of the one before, else of the one after.
    """
    by = Window.partitionBy(job).orderBy("n")
    before = F.lag("h").over(by)
    after = F.first("h", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    k, h = F.col("k.text"), F.col("h.text")
    fold = lambda c: F.lower(T.fold_yo(c))
    kp, hp, b = F.col("k.punct_after"), F.col("h.punct_after"), F.col("h.bbox")
    wide = F.greatest(F.lit(8.0), 0.3 * (b["y1"] - b["y0"]))
    right = F.when(b.isNotNull(), G.box(b["x1"], b["y0"], b["x1"] + wide, b["y1"]))
    left = F.when(b.isNotNull(), G.box(b["x1"] - wide, b["y0"], b["x1"], b["y1"]))
    none = F.lit("")

    def one(kind: str, mark: str, expected: Column, written: Column, bbox: Column, at: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(mark).alias("mark"), expected.alias("expected"), written.alias("written"), bbox.alias("bbox"), at["line_id"].alias("line_id"),
            at["line_pos"].cast("int").alias("line_pos"), F.coalesce(at["confidence"], F.lit(0.9)).alias("confidence"),
        )

    df = pairs.withColumn("before", before).withColumn("after", after)
    here, beside = F.col("h"), F.coalesce("before", "after")
    word = (
        F.when(here.isNull(), one("missing_word", "insert", k, none, G.gap_box(F.col("before.bbox"), F.col("after.bbox")), beside))
        .when(F.col("k").isNull(), one("extra_word", "strike", none, h, b, here))
        .when(fold(k) != fold(h), one("spelling", "underline", k, h, b, here))
        .when(~F.coalesce("ignore_case", F.lit(False)) & (k != h) & (F.lower(k) == F.lower(h)), one("capitalization", "circle", k, h, b, here))
    )
    sign = F.when(
        F.coalesce("count_punctuation", F.lit(True)) & F.col("k").isNotNull() & here.isNotNull(),
        F.when((kp != "") & (hp == ""), one("punctuation_missing", "insert", kp, none, right, here))
        .when((kp == "") & (hp != ""), one("punctuation_extra", "circle", none, hp, left, here))
        .when(kp != hp, one("punctuation_wrong", "circle", kp, hp, left, here)),
    )
    out = df.select(job, "n", F.explode(F.filter(F.array(word, sign), lambda e: e.isNotNull())).alias("e")).select(job, "n", "e.*")
    return out.withColumn("needs_review", F.col("confidence") < review_below)


def judged(found: DataFrame, verdicts: DataFrame, job: str = "job_id") -> DataFrame:
    """Errors with the verdicts of a judge of the ink on spelling errors (job, n, verdict, margin, best, letters).

    ok: the reader was wrong, the error goes. review: the error stays to be looked at and doesn't count. error: it stays, and
    ``ink_says`` what the ink says and ``letters`` which letters differ. Errors without a box or a verdict stay as they are.
    """
    v = verdicts.select(job, "n", F.lit("spelling").alias("kind"), "verdict", "margin", "best", "letters")
    df = found.join(v, [job, "n", "kind"], "left").withColumn("verdict", F.when(F.col("bbox").isNotNull(), F.col("verdict")))
    certain = F.col("verdict") == "error"
    return df.where("verdict is null or verdict <> 'ok'").select(
        *found.columns[:-1], (F.col("needs_review") | F.coalesce(F.col("verdict") == "review", F.lit(False))).alias("needs_review"), "verdict",
        F.when(F.col("verdict").isNotNull(), F.col("margin")).alias("verifier_margin"), F.when(certain, F.col("best")).alias("ink_says"), F.when(certain, F.col("letters")).alias("letters"),
    )


def marks(found: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, n, kind, bbox, text, reason, confidence, line_id, needs_review, and verdict and letters if judged): what is drawn; an error without a box has no mark."""
    more = [c for c in ("verdict", "letters") if c in found.columns]
    return found.where("bbox is not null").select(
        job, "n", F.col("mark").alias("kind"), "bbox", F.when(F.col("mark") == "insert", F.col("expected")).alias("text"), F.col("kind").alias("reason"), "confidence", "line_id", "needs_review", *more
    )


def recorded(found: DataFrame) -> DataFrame:
    """Errors as a record holds them: a box of noughts where there is none, confidences of three digits."""
    nothing = F.struct(*[F.lit(v).alias(k) for k, v in NO_BOX.items()])
    return found.withColumns({"bbox": F.coalesce("bbox", nothing), "confidence": T.rounded(F.col("confidence"))}).drop("mark")


def score_cards(pairs: DataFrame, found: DataFrame, job: str = "job_id") -> DataFrame:
    """One row a job: matched words, coverage, numbers of spelling and punctuation errors (those to be reviewed by verdict don't count), confidence, review."""
    fold = lambda c: F.lower(T.fold_yo(F.col(c)))
    words = pairs.groupBy(job).agg(
        F.count("k").alias("n_expected"), F.count("h").alias("n_read"), F.count_if(fold("k.text") == fold("h.text")).alias("n_matched")
    )
    counted = F.coalesce(F.col("verdict") != "review", F.lit(True)) if "verdict" in found.columns else F.lit(True)
    of_job = found.groupBy(job).agg(
        F.count_if(F.col("kind").isin("spelling", "missing_word", "extra_word", "capitalization") & counted).alias("n_spelling"),
        F.count_if(F.col("kind").startswith("punctuation")).alias("n_punctuation"),
        F.avg(T.rounded(F.col("confidence"))).alias("conf"),
        F.max("needs_review").alias("review"),
    )
    coverage = F.col("n_matched") / F.greatest("n_expected", F.lit(1))
    return words.join(of_job, job, "left").select(
        job, "n_expected", "n_read", "n_matched",
        T.rounded(coverage).alias("coverage"),
        F.coalesce("n_spelling", F.lit(0)).cast("long").alias("n_spelling"),
        F.coalesce("n_punctuation", F.lit(0)).cast("long").alias("n_punctuation"),
        T.rounded(F.least(F.lit(1.0), F.coalesce("conf", F.lit(1.0)))).alias("confidence"),
        (F.coalesce("review", F.lit(False)) | (coverage < 0.7)).alias("needs_review"),
    )


def lines_to_tokens(lines: DataFrame, job: str, place: str, text: str) -> DataFrame:
    """(job, read): the tokens of a job's lines in order, each with its box, line, place in the line and confidence.

    ``lines`` has bbox, line_id, confidence and, if words were boxed, words array<struct<text, bbox, confidence>>. As many boxed words as
    tokens are the tokens' own; otherwise a token has the ink box it overlaps, or its stretch of the line (see ``word_boxes``).
    """
    if "words" not in lines.columns:
        lines = lines.withColumn("words", F.lit(None).cast("array<struct<text: string, bbox: struct<x0: double, y0: double, x1: double, y1: double>, confidence: double>>"))
    boxed = F.filter("words", lambda w: w["bbox"].isNotNull())
    df = lines.withColumn("__t", T.token_array(F.col(text))).withColumn("__given", boxed)
    own = F.coalesce((F.size("__given") > 0) & (F.size("__given") == F.size("__t")), F.lit(False))
    estimated = G.word_boxes(F.col(text), F.col("__t"), F.transform("__given", lambda w: w["bbox"]), F.col("bbox"))
    df = df.withColumn("__b", F.when(own, F.transform("__given", lambda w: w["bbox"])).otherwise(estimated))
    mine = F.when(own, F.transform("__given", lambda w: w["confidence"])).otherwise(F.transform("__t", lambda t: F.lit(None).cast("double")))
    # boxes and confidences are made once a line and zipped, not looked up word by word
    parts = F.arrays_zip(F.col("__t").alias("t"), F.col("__b").alias("b"), mine.alias("c"))
    token = lambda p, i: F.struct(
        p["t"]["text"].alias("text"), p["t"]["punct_after"].alias("punct_after"), p["b"].alias("bbox"), F.col("line_id"), i.alias("line_pos"), F.coalesce(p["c"], F.col("confidence")).alias("confidence")
    )
    made = df.select(job, F.col(place).alias("place"), F.transform(parts, token).alias("t"))
    return made.groupBy(job).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"])).alias("read"))
