"""Boxes and lines of a page against those of another reading of it. Pages are bounded, so a page is one task's work."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions import geometry as G
from quillspan.functions import text as T
from quillspan.functions.kernels import assign, greedy_pairs


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = size(a)[:, None] + size(b)[None, :] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def _shared_letters(a: list[str], b: list[str]) -> np.ndarray:
    """What the matched share of each pair can't be more than: the letters both have."""
    letters = {c: k for k, c in enumerate(dict.fromkeys("".join(a + b)))}
    counts = []
    for side in (a, b):
        n = np.zeros((len(side), len(letters) + 1), np.int32)
        for i, t in enumerate(side):
            np.add.at(n[i], [letters[c] for c in t], 1)
        counts.append(n)
    common = np.array([np.minimum(row, counts[1]).sum(1) for row in counts[0]]).reshape(len(a), len(b))
    total = counts[0].sum(1)[:, None] + counts[1].sum(1)[None, :]
    return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)


def _text_likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Matched shares of all pairs of texts."""
    out, matcher = np.zeros((len(a), len(b))), SequenceMatcher(None)
    for j, y in enumerate(b):
        matcher.set_seq2(y)  # what is prepared for one text serves a whole column
        for i, x in enumerate(a):
            matcher.set_seq1(x)
            out[i, j] = matcher.ratio()
    return out


def _assigned_by_text(a: list[str], b: list[str]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The assignment of the largest total of matched shares, and the shares (bounds where they weren't needed).

    Pairs are assigned by what their shares can't be more than; assigned pairs are measured, and all of a line that has no
    good one; until every pair of the best assignment is measured. No other can have a larger total then.
    """
    s = _shared_letters(a, b)
    known = np.zeros(s.shape, bool)

    def measure(i: int, columns: list[int]) -> None:
        for j in columns:
            if not known[i, j]:
                s[i, j], known[i, j] = SequenceMatcher(None, a[i], b[j]).ratio(), True

    while True:
        found = assign(s)
        new = [(i, j) for i, j in found if not known[i, j]]
        if not new:
            return s, found
        for i, j in new:
            measure(i, [j])
            if s[i, j] < 0.6:
                measure(i, range(len(b)))


def match_lines(gt: DataFrame, pred: DataFrame, page: str = "file", box_limit: float = 0.3, text_limit: float = 0.35, greedy: bool = False) -> DataFrame:
    """(page, gi, pj, similarity): one-to-one pairs of the largest total, then those below the limit dropped.

    Both sides have (page, place, text, x0, y0, x1, y1). Boxes decide if every prediction of the page has one, texts in scored form
    otherwise. ``greedy``: each true line in turn takes the free prediction most like it instead.
    """
    gt, pred = (df.withColumn("text", T.scored_form(F.col("text").cast("string"))) for df in (gt, pred))

    def pair(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        corners = ["x0", "y0", "x1", "y1"]
        if a.empty or b.empty:
            return pd.DataFrame(columns=[page, "gi", "pj", "similarity"])
        a, b = a.sort_values("place", ignore_index=True), b.sort_values("place", ignore_index=True)
        boxes = not b[corners].isna().any(axis=None)
        if boxes:
            s = _iou(a[corners].to_numpy(float), b[corners].to_numpy(float))
        else:
            texts = a["text"].fillna("").tolist(), b["text"].fillna("").tolist()
            s = _text_likeness(*texts) if greedy else None
        limit = box_limit if boxes else text_limit
        if s is None:
            s, found = _assigned_by_text(*texts)
        else:
            found = greedy_pairs(s) if greedy else assign(s)
        rows = [(key[0], int(a["place"].iloc[i]), int(b["place"].iloc[j]), float(s[i, j])) for i, j in found if s[i, j] >= limit]
        return pd.DataFrame(rows or None, columns=[page, "gi", "pj", "similarity"])

    return gt.groupBy(page).cogroup(pred.groupBy(page)).applyInPandas(pair, f"`{page}` string, gi long, pj long, similarity double")


def detector_scores(gt: DataFrame, det: DataFrame, matched: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of one-to-one pairs."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    tp, g, p = F.col("tp"), F.col("n_gt"), F.col("n_det")
    return (
        n(matched, "tp").crossJoin(n(gt, "n_gt")).crossJoin(n(det, "n_det"))  # one row each
        .select("tp", "n_gt", "n_det", F.when(p > 0, tp / p).alias("precision"), F.when(g > 0, tp / g).alias("recall"), F.when(g + p > 0, 2 * tp / (g + p)).alias("f1"))
    )


def best_matches(gt: DataFrame, det: DataFrame, page: str, gt_id: str, det_id: str) -> DataFrame:
    """For each true box the detected box of largest overlap (not one-to-one); ties go to the smaller number."""
    pairs = gt.alias("g").join(det.alias("d"), page, "left").withColumn("iou", F.when(F.col(f"d.{det_id}").isNotNull(), G.iou(F.col("g.bbox"), F.col("d.bbox"))))
    best = pairs.groupBy(page, F.col(f"g.{gt_id}").alias(gt_id)).agg(F.max(F.struct("iou", (-F.col(f"d.{det_id}")).alias("k"))).alias("m"))
    return best.select(page, gt_id, (-F.col("m.k")).alias(det_id), F.coalesce("m.iou", F.lit(0.0)).alias("iou"))


def failure_categories(gt: DataFrame, det: DataFrame, page: str, gt_id: str, det_id: str) -> DataFrame:
    """(page, gt_id, category, best_iou): matched, missed, merged, split, cut or loose; the first that holds.

    The boxes of a page meet once; all shares are aggregates of that one join.
    """
    pairs = gt.select(page, F.col(gt_id).alias("g"), F.col("bbox").alias("gb")).join(det.select(page, F.col(det_id).alias("d"), F.col("bbox").alias("db")), page, "left")
    both = G.intersection(F.col("gb"), F.col("db"))
    pairs = pairs.withColumns(
        {
            "iou": F.coalesce(G.iou(F.col("gb"), F.col("db")), F.lit(0.0)),
            "of_gt": F.coalesce(both / G.area(F.col("gb")), F.lit(0.0)),
            "of_det": F.coalesce(both / G.area(F.col("db")), F.lit(0.0)),
        }
    )
    by_det = Window.partitionBy(page, "d")
    # how many true boxes a detected box covers by at least two fifths
    pairs = pairs.withColumn("covers", F.sum(F.when(F.col("of_gt") >= 0.4, 1).otherwise(0)).over(by_det))
    per = pairs.groupBy(page, "g").agg(
        F.max(F.struct("iou", (-F.col("d")).alias("k"), "of_gt", "of_det", "covers")).alias("m"), F.sum(F.when(F.col("of_gt") >= 0.25, 1).otherwise(0)).alias("parts")
    )
    others = F.col("m.covers") - F.when(F.col("m.of_gt") >= 0.4, 1).otherwise(0)
    kind = (
        F.when(F.col("m.iou") >= 0.5, "matched")
        .when(F.col("m.iou") < 0.1, "missed")
        .when(others >= 1, "merged")
        .when(F.col("parts") >= 2, "split")
        .when(F.col("m.of_det") >= 0.7, "cut")
        .otherwise("loose")
    )
    return per.select(page, F.col("g").alias(gt_id), kind.alias("category"), F.col("m.iou").alias("best_iou"))


def edge_errors(gt: DataFrame, det: DataFrame, page: str, gt_id: str, det_id: str, least: float = 0.3) -> DataFrame:
    """(edge, mean, sd, median): how far the edges of best matching boxes (overlap ``least`` or more) are off, as shares of the true
    box's height and width, and the ratios of heights and widths."""
    best = best_matches(gt, det, page, gt_id, det_id).where(F.col("iou") >= least)
    pair = best.join(gt.select(page, gt_id, F.col("bbox").alias("__g")), [page, gt_id]).join(det.select(page, det_id, F.col("bbox").alias("__p")), [page, det_id])
    g, p = F.col("__g"), F.col("__p")
    h, w = g["y1"] - g["y0"], g["x1"] - g["x0"]
    edges = {
        "top": (p["y0"] - g["y0"]) / h, "bottom": (p["y1"] - g["y1"]) / h, "left": (p["x0"] - g["x0"]) / w, "right": (p["x1"] - g["x1"]) / w,
        "h_ratio": (p["y1"] - p["y0"]) / h, "w_ratio": (p["x1"] - p["x0"]) / w,
    }
    rows = pair.select(F.explode(F.array(*[F.struct(F.lit(k).alias("edge"), v.alias("v")) for k, v in edges.items()])).alias("e")).select("e.*")
    return rows.groupBy("edge").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.median("v").alias("median"))


def growth_fit(gt: DataFrame, det: DataFrame, page: str, gt_id: str, det_id: str, least: float = 0.2) -> DataFrame:
    """One row (n_matched, grow_top, grow_bottom, grow_sides): how much detected boxes must grow, as shares of their own size: medians of the
    gaps to best matching true boxes, not below nought, in three digits."""
    best = best_matches(gt, det, page, gt_id, det_id).where(F.col("iou") >= least)
    pair = best.join(gt.select(page, gt_id, F.col("bbox").alias("__g")), [page, gt_id]).join(det.select(page, det_id, F.col("bbox").alias("__p")), [page, det_id])
    g, p = F.col("__g"), F.col("__p")
    h, w = F.greatest(F.lit(1.0), p["y1"] - p["y0"]), F.greatest(F.lit(1.0), p["x1"] - p["x0"])
    grown = lambda c: F.greatest(F.lit(0.0), F.round(c, 3))
    return pair.agg(
        F.count("*").alias("n_matched"),
        grown(F.median((p["y0"] - g["y0"]) / h)).alias("grow_top"),
        grown(F.median((g["y1"] - p["y1"]) / h)).alias("grow_bottom"),
        grown((F.median((p["x0"] - g["x0"]) / w) + F.median((g["x1"] - p["x1"]) / w)) / 2).alias("grow_sides"),
    )


def words_to_lines(words: DataFrame, lines: DataFrame, page: str, word_id: str, line_id: str) -> DataFrame:
    """(page, word_id, line_key): a word's line by its group number, else the line box that holds its middle, else the word itself.

    Among several lines the one whose middle is nearest in height, then the smaller number.
    """
    loose = words.where("group_id is null")
    mid_x, mid_y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    held = (
        loose.select(page, word_id, F.col("bbox").alias("b"))
        .join(lines.select(page, F.col(line_id).alias("l"), F.col("bbox").alias("lb")), page)
        .where((mid_x >= F.col("lb.x0")) & (mid_x <= F.col("lb.x1")) & (mid_y >= F.col("lb.y0")) & (mid_y <= F.col("lb.y1")))
        .groupBy(page, word_id)
        .agg(F.min(F.struct(F.abs(mid_y - (F.col("lb.y0") + F.col("lb.y1")) / 2).alias("far"), "l"))["l"].alias("l"))
    )
    return words.join(held, [page, word_id], "left").select(
        page,
        word_id,
        F.when(F.col("group_id").isNotNull(), F.concat(F.lit("g"), F.col("group_id")))
        .when(F.col("l").isNotNull(), F.concat(F.lit("l"), F.col("l")))
        .otherwise(F.concat(F.lit("w"), F.col(word_id)))
        .alias("line_key"),
    )


def union_boxes(words: DataFrame, page: str, group: str) -> DataFrame:
    """(page, group, bbox): the box around all words of a group; words without a group or a box don't count."""
    ends = [f(F.col(f"bbox.{c}")) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return words.where(F.col(group).isNotNull() & F.col("bbox").isNotNull()).groupBy(page, group).agg(G.box(*ends).alias("bbox"))


def likely_boxes(boxes: DataFrame, least_area: float = 0.0, widest: float = float("inf"), confidence: str | None = None, least: float = 0.0) -> DataFrame:
    """Boxes of at least ``least_area``, at most ``widest`` times as wide as high, and of at least ``least`` confidence (1 if there is none)."""
    w, h = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    ok = (w * h >= least_area) & (w <= widest * h)
    return boxes.where(ok if confidence is None else ok & (F.coalesce(F.col(confidence), F.lit(1.0)) >= least))


def reading_order(lines: DataFrame, page: str, width: str, height: str) -> DataFrame:
    """Add ``reading_no``: left page before right page on a spread (wide, and a fifth to four fifths on the right), then from the top."""
    per = Window.partitionBy(page)
    mid = (F.col("bbox.x0") + F.col("bbox.x1")) / 2
    right = F.when(mid > F.col(width) / 2, 1).otherwise(0)
    share = F.avg(right).over(per)
    spread = (F.col(width) / F.col(height) > 1.15) & (share >= 0.2) & (share <= 0.8)
    order = per.orderBy(F.when(spread, right).otherwise(0), F.col("bbox.y0"), F.col("bbox.x0"), F.col("line_id"))
    return lines.withColumn("reading_no", F.row_number().over(order))


def reading_rows(boxes: DataFrame, page: str, confidence: str | None = None, least: float = 0.0, row: float = 40.0) -> DataFrame:
    """Boxes of at least ``least`` confidence with ``reading_no``: by rows of ``row`` pixels from the top (ties of rounding to the even row), then from the left."""
    kept = boxes if confidence is None else boxes.where(F.coalesce(F.col(confidence), F.lit(1.0)) >= least)
    order = Window.partitionBy(page).orderBy(F.bround(F.col("bbox.y0") / row, 0), F.col("bbox.x0"), F.col("bbox.y0"), *[c for c in ("pj",) if c in boxes.columns])
    return kept.withColumn("reading_no", F.row_number().over(order))


def drop_overlaps(boxes: DataFrame, page: str, number: str, limit: float = 0.3) -> DataFrame:
    """(page, number) of the boxes kept when each is added in order unless it overlaps one that is kept."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(number, ignore_index=True)
        xy = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
        kept: list[int] = []
        for i in range(len(xy)):
            if not kept or _iou(xy[i : i + 1], xy[kept]).max() < limit:
                kept.append(i)
        return pdf.loc[kept, [page, number]]

    flat = boxes.select(page, number, "bbox.*")
    return flat.groupBy(page).applyInPandas(greedy, f"`{page}` string, `{number}` long")
