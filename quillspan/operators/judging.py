"""Margins of judges, trusted letters and donors of letters, over tables of what models have put out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Mean and spread of either judge's margin, and the limits of error and review of the first judge alone and of both.
CTC_SCALE, PMI_SCALE = (-5.413, 7.805), (-2.095, 3.829)
ALONE, TOGETHER = (13.7, 5.1), (2.30, 0.68)


def _step(margin: Column, limits: tuple[float, float]) -> Column:
    return F.when(margin >= limits[0], "error").when(margin >= limits[1], "review").otherwise("ok")


def fused(ctc: Column, pmi: Column) -> Column:
    """The smaller of both margins, each as a multiple of its spread above its mean."""
    return F.least((ctc - CTC_SCALE[0]) / CTC_SCALE[1], (pmi - PMI_SCALE[0]) / PMI_SCALE[1])


def verdict(ctc: Column, pmi: Column) -> Column:
    """error, review or ok; without a second margin by the first alone."""
    return F.when(pmi.isNull(), _step(ctc, ALONE)).otherwise(_step(fused(ctc, pmi), TOGETHER))


def pmi(parts: DataFrame, key: str, with_picture: str, without: str, weight: float = 0.5) -> DataFrame:
    """(key, pmi): summed log probabilities with the picture less ``weight`` times those without."""
    return parts.groupBy(key).agg((F.sum(with_picture) - F.lit(weight) * F.sum(without)).alias("pmi"))


def best_spellings(scores: DataFrame, word: str, spelling: str, score: str, is_key: str, most: int = 20) -> DataFrame:
    """(word, best, margin, key_score, top): for each word the best of its other spellings, by how much it beats the key (0 without
    any), and the ``most`` best in order. Equal scores go by spelling."""
    other, c = ~F.col(is_key), F.struct((-F.col(score)).alias("s"), F.col(spelling).alias("c"))
    made = scores.groupBy(word).agg(F.max(F.when(F.col(is_key), F.col(score))).alias("key_score"), F.array_sort(F.collect_list(F.when(other, c))).alias("o"))
    first = F.get("o", 0)
    return made.select(
        word, first["c"].alias("best"), F.coalesce(-first["s"] - F.col("key_score"), F.lit(0.0)).alias("margin"), "key_score", F.transform(F.slice("o", 1, most), lambda x: x["c"]).alias("top")
    )


def trusted(letters: DataFrame, word: str, probability: str, width: str, least: float = 0.6, share: float = 0.5) -> DataFrame:
    """(word, n_trusted, kept): a word is kept if at least ``share`` of its letters (one at least) are certain, and its letters are wide enough
    and not of very uneven width (0.15 to 3 times their median)."""
    n = F.count_if(F.col(probability) >= least)
    m = F.median(width)
    kept = (n >= F.greatest(F.lit(1.0), share * F.count("*"))) & (m >= 4) & (F.max(width) <= 3 * m) & (F.min(width) >= 0.15 * m)
    return letters.groupBy(word).agg(n.alias("n_trusted"), kept.alias("kept"))


def donor_bank(letters: DataFrame, word: str, order: list[str], letter: str) -> DataFrame:
    """Letters with the one before and the one after in their word, ``^`` and ``$`` at its ends."""
    by = Window.partitionBy(word).orderBy(*order)
    return letters.withColumn("before", F.lag(letter, 1, "^").over(by)).withColumn("after", F.lead(letter, 1, "$").over(by))


def donors(wanted: DataFrame, bank: DataFrame, same: list[str], key: str, width: str, narrow: float = 0.6, wide: float = 1.6) -> DataFrame:
    """(want_id, donor_id, tier): for each wanted letter the donor that agrees in both neighbours (tier 0), in one, or in none, of ``narrow`` to ``wide`` times
    its width; of equal tiers the one nearest in width, then the smaller key. Both sides have the columns ``same``, key, before, after and width;
    a letter isn't its own donor."""
    a, b = wanted.alias("a"), bank.alias("b")
    w, v = F.col(f"a.{width}"), F.col(f"b.{width}")
    agree = (F.col("a.before") == F.col("b.before")).cast("int") + (F.col("a.after") == F.col("b.after")).cast("int")
    on = (F.col(f"a.{key}") != F.col(f"b.{key}")) & v.between(narrow * w, wide * w)
    for c in same:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    best = F.min(F.struct((2 - agree).alias("tier"), F.abs(w - v).alias("far"), F.col(f"b.{key}").alias("donor")))
    return a.join(b, on).groupBy(F.col(f"a.{key}").alias("want_id")).agg(best.alias("m")).select("want_id", F.col("m.donor").alias("donor_id"), "m.tier")
