"""Queries on pages: boxes, matching, scores, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions import geometry as G
from quillspan.functions import text as T
from quillspan.functions.kernels import indel_ratio_col, similarity_col
from quillspan.operators import answers, dictation, matching, scoring
from quillspan.plans.registry import Registry
from quillspan.session import table

query = Registry()

# A second reading of each true line, made by rule in either engine: letters drop out, and every 17th line is missed.
HYP_SQL = "CASE WHEN line_id % 17 <> 0 THEN replace(replace(text, 'ст', 'т'), 'ov', 'o') END"
NORM_T = r"regexp_replace(regexp_replace(replace(translate(nfc_normalize({}), 'ёЁ', 'еЕ'), chr(173), ''), '[ \t]+', ' ', 'g'), '^[\s\p{{Z}}\x{{85}}\x{{1C}}-\x{{1F}}]+|[\s\p{{Z}}\x{{85}}\x{{1C}}-\x{{1F}}]+$', '', 'g')"


def read_again() -> Column:
    return F.when(F.col("line_id") % 17 != 0, F.replace(F.replace("text", F.lit("ст"), F.lit("т")), F.lit("ov"), F.lit("o")))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.line_scores(table(spark, d, "gt_line").select("line_id", "file", "gi", "text", read_again().alias("read")), "text", "read")


# ---- boxes ---------------------------------------------------------------------------------------

_ANN = "(SELECT DISTINCT ON (ann_id) * FROM page_ann ORDER BY ann_id, loaded_at, image_id)"
_XS = "list_transform(range(1, len(segmentation) + 1, 2), lambda i: segmentation[i])"
_YS = "list_transform(range(2, len(segmentation) + 1, 2), lambda i: segmentation[i])"


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations once each, with their boxes; polygons with too few points have none."""
    first = Window.partitionBy("ann_id").orderBy("loaded_at", "image_id")
    ann = table(spark, d, "page_ann").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    return ann.withColumn("bbox", G.polygon_box(F.col("segmentation"))).withColumn("page", F.col("image_id").cast("string"))


@query(f"SELECT ann_id, list_min({_XS}) AS x0, list_min({_YS}) AS y0, list_max({_XS}) AS x1, list_max({_YS}) AS y1 FROM {_ANN} WHERE len(segmentation) >= 6 AND len(segmentation) % 2 = 0")
def annotation_boxes(spark: SparkSession, d: str) -> DataFrame:
    return annotations(spark, d).where("bbox is not null").select("ann_id", "bbox.*")


@query(
    "SELECT ann_id, CAST(round(abs(list_sum(list_transform(range(0, n), lambda i: p[2 * i + 1] * p[2 * ((i + 1) % n) + 2] - p[2 * ((i + 1) % n) + 1] * p[2 * i + 2]))) / 2) AS BIGINT) AS area"
    f" FROM (SELECT ann_id, segmentation AS p, len(segmentation) // 2 AS n FROM {_ANN} WHERE len(segmentation) >= 6 AND len(segmentation) % 2 = 0)"
)
def annotation_areas(spark: SparkSession, d: str) -> DataFrame:
    made = annotations(spark, d).where("bbox is not null")
    return made.select("ann_id", F.round(G.polygon_area(F.col("segmentation"))).cast("long").alias("area"))


@query(
    f"WITH a AS (SELECT ann_id, image_id, category, group_id, list_min({_XS}) AS x0, list_min({_YS}) AS y0, list_max({_XS}) AS x1, list_max({_YS}) AS y1 FROM {_ANN} WHERE len(segmentation) >= 6 AND len(segmentation) % 2 = 0),"
    " w AS (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM a WHERE category = 'pupil_text'),"
    " h AS (SELECT w.ann_id, arg_min(l.ann_id, (abs(w.my - (l.y0 + l.y1) / 2), l.ann_id)) AS l FROM w JOIN a l ON l.image_id = w.image_id AND l.category = 'text_line' AND w.mx BETWEEN l.x0 AND l.x1 AND w.my BETWEEN l.y0 AND l.y1 GROUP BY w.ann_id)"
    " SELECT CAST(image_id AS VARCHAR) AS page, ann_id, CASE WHEN group_id IS NOT NULL THEN 'g' || group_id WHEN l IS NOT NULL THEN 'l' || l ELSE 'w' || ann_id END AS line_key FROM w LEFT JOIN h USING (ann_id)"
)
def word_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words of a page image with their line."""
    ann = annotations(spark, d).where("bbox is not null")
    lines = ann.where("category = 'text_line'").withColumnRenamed("ann_id", "line_no")
    return matching.words_to_lines(ann.where("category = 'pupil_text'"), lines, "page", "ann_id", "line_no")


@query(
    f"SELECT image_id, group_id, min(list_min({_XS})) AS x0, min(list_min({_YS})) AS y0, max(list_max({_XS})) AS x1, max(list_max({_YS})) AS y1 FROM {_ANN}"
    " WHERE len(segmentation) >= 6 AND len(segmentation) % 2 = 0 AND category = 'pupil_text' AND group_id IS NOT NULL GROUP BY image_id, group_id"
)
def group_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Lines as the boxes around their words."""
    words = annotations(spark, d).where("category = 'pupil_text'")
    return matching.union_boxes(words.select("image_id", "group_id", "bbox"), "image_id", "group_id").select("image_id", "group_id", "bbox.*")


@query(
    "SELECT line_id FROM gt_line WHERE bbox IS NOT NULL AND (bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) >= 20000 AND bbox.x1 - bbox.x0 <= 25 * (bbox.y1 - bbox.y0) AND (line_id % 10) / 10.0 >= 0.3"
)
def likely_boxes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "gt_line").where("bbox is not null").withColumn("conf", (F.col("line_id") % 10) / 10.0)
    return matching.likely_boxes(lines, 20_000.0, 25.0, "conf", 0.3).select("line_id")


def _shifted() -> Column:
    """A detected box for every true line: moved and grown by rule, so that some match, some don't."""
    h, k = F.col("bbox.y1") - F.col("bbox.y0"), F.col("line_id") % 7
    return G.box(F.col("bbox.x0") + k * 3, F.col("bbox.y0") + h * k / 8, F.col("bbox.x1") + k * 3, F.col("bbox.y1") + h * k / 8)


def _gt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gt_line").select("file", F.col("line_id").alias("g"), "line_id", "bbox", "text", "gi").where("bbox is not null")


def _det(spark: SparkSession, d: str) -> DataFrame:
    return _gt(spark, d).where("line_id % 11 <> 0").select("file", F.col("line_id").alias("d"), _shifted().alias("bbox"))


_G = "(SELECT file, line_id AS g, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM gt_line WHERE bbox IS NOT NULL)"
_D = (
    "(SELECT file, line_id AS d, bbox.x0 + line_id % 7 * 3 AS x0, bbox.y0 + (bbox.y1 - bbox.y0) * (line_id % 7) / 8 AS y0, bbox.x1 + line_id % 7 * 3 AS x1,"
    " bbox.y1 + (bbox.y1 - bbox.y0) * (line_id % 7) / 8 AS y1 FROM gt_line WHERE bbox IS NOT NULL AND line_id % 11 <> 0)"
)
_BOTH = "greatest(0, least(g.x1, d.x1) - greatest(g.x0, d.x0)) * greatest(0, least(g.y1, d.y1) - greatest(g.y0, d.y0))"
_SIZE = "(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"
_IOU = f"coalesce({_BOTH} / nullif({_SIZE.format(a='g')} + {_SIZE.format(a='d')} - {_BOTH}, 0), 0)"


@query(f"SELECT file, g, arg_max(d, (iou, -d)) AS d, max(iou) AS iou FROM (SELECT g.file, g.g, d.d, {_IOU} AS iou FROM {_G} g JOIN {_D} d USING (file)) GROUP BY file, g")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_matches(_gt(spark, d), _det(spark, d), "file", "g", "d").where("d is not null")


@query(
    f"WITH p AS (SELECT g.file, g.g, d.d, coalesce({_IOU}, 0) AS iou, coalesce({_BOTH} / {_SIZE.format(a='g')}, 0) AS og, coalesce({_BOTH} / {_SIZE.format(a='d')}, 0) AS od FROM {_G} g LEFT JOIN {_D} d USING (file)),"
    " c AS (SELECT *, sum(CASE WHEN og >= 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY file, d) AS covers FROM p),"
    " m AS (SELECT file, g, arg_max(struct_pack(iou, og, od, covers), (iou, -d)) AS m, sum(CASE WHEN og >= 0.25 THEN 1 ELSE 0 END) AS parts FROM c GROUP BY file, g)"
    " SELECT category, count(*) AS n FROM (SELECT CASE WHEN m.iou >= 0.5 THEN 'matched' WHEN m.iou < 0.1 OR m IS NULL THEN 'missed' WHEN m.covers - CASE WHEN m.og >= 0.4 THEN 1 ELSE 0 END >= 1 THEN 'merged'"
    " WHEN parts >= 2 THEN 'split' WHEN m.od >= 0.7 THEN 'cut' ELSE 'loose' END AS category FROM m) GROUP BY category"
)
def failure_categories(spark: SparkSession, d: str) -> DataFrame:
    return matching.failure_categories(_gt(spark, d), _det(spark, d), "file", "g", "d").groupBy("category").agg(F.count("*").alias("n"))


def _flat(df: DataFrame, place: str) -> DataFrame:
    return df.select("file", F.col(place).alias("place"), F.lit(None).cast("string").alias("text"), "bbox.*")


@query()
def detector_f1(spark: SparkSession, d: str) -> DataFrame:
    gt, det = _gt(spark, d), _det(spark, d)
    return matching.detector_scores(gt, det, matching.match_lines(_flat(gt, "g"), _flat(det, "d"), box_limit=0.5))


@query()
def matched_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines paired by their texts alone."""
    none = F.lit(None).cast("double")
    side = lambda place, text: table(spark, d, "gt_line").select("file", F.col("gi").alias("place"), text.alias("text"), *[none.alias(c) for c in ("x0", "y0", "x1", "y1")])
    return matching.match_lines(side("gi", F.col("text")), side("gi", read_again()).where("text is not null"))


_W = "(SELECT l.line_id, l.file, width, height, bbox.x0 AS x0, bbox.y0 AS y0, (bbox.x0 + bbox.x1) / 2 AS mid FROM gt_line l JOIN gt_page USING (file) WHERE bbox IS NOT NULL)"


@query(
    f"WITH r AS (SELECT *, CASE WHEN mid > width / 2.0 THEN 1 ELSE 0 END AS side FROM {_W}), s AS (SELECT *, avg(side) OVER (PARTITION BY file) AS share FROM r)"
    " SELECT line_id, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN width / CAST(height AS DOUBLE) > 1.15 AND share >= 0.2 AND share <= 0.8 THEN side ELSE 0 END, y0, x0, line_id) AS reading_no FROM s"
)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "gt_line").join(table(spark, d, "gt_page").select("file", "width", "height"), "file").where("bbox is not null")
    return matching.reading_order(lines, "file", "width", "height").select("line_id", F.col("reading_no").cast("long"))


@query(
    "SELECT line_id, greatest(0, bbox.x0 - 0.02 * (bbox.x1 - bbox.x0)) AS x0, greatest(0, bbox.y0 - 0.25 * (bbox.y1 - bbox.y0)) AS y0, least(CAST(width AS DOUBLE), bbox.x1 + 0.02 * (bbox.x1 - bbox.x0)) AS x1,"
    " least(CAST(height AS DOUBLE), bbox.y1 + 0.365 * (bbox.y1 - bbox.y0)) AS y1 FROM gt_line JOIN gt_page USING (file) WHERE bbox IS NOT NULL"
)
def grown_boxes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "gt_line").join(table(spark, d, "gt_page").select("file", "width", "height"), "file").where("bbox is not null")
    return lines.select("line_id", G.grow(F.col("bbox"), F.col("width"), F.col("height"), G.LINE_GROWTH).alias("b")).select("line_id", "b.*")


@query(
    "SELECT line_id, greatest(0, bbox.x0 - 12) AS x0, greatest(0, bbox.y0 - 12) AS y0, least(CAST(width AS DOUBLE), bbox.x1 + 12) AS x1, least(CAST(height AS DOUBLE), bbox.y1 + 12) AS y1"
    " FROM gt_line JOIN gt_page USING (file) WHERE bbox IS NOT NULL"
)
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "gt_line").join(table(spark, d, "gt_page").select("file", "width", "height"), "file").where("bbox is not null")
    return lines.select("line_id", G.pad(F.col("bbox"), 12.0, F.col("width"), F.col("height")).alias("b")).select("line_id", "b.*")


@query(
    "SELECT line_id, i AS word_no, CASE WHEN i > 1 THEN w[i - 1].bbox.x1 ELSE w[i + 1].bbox.x0 - greatest(8, 0.3 * (w[i + 1].bbox.y1 - w[i + 1].bbox.y0)) END AS x0 FROM"
    " (SELECT line_id, words AS w, unnest(range(1, len(words) + 1)) AS i FROM gt_line WHERE words IS NOT NULL) WHERE len(w) > 1"
)
def gap_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Where each word would be put in, were it missing."""
    w = table(spark, d, "gt_line").where("words is not null and size(words) > 1").select("line_id", "words", F.posexplode("words").alias("i", "word"))
    before, after = F.when(F.col("i") > 0, F.get("words", F.col("i") - 1)["bbox"]), F.get("words", F.col("i") + 1)["bbox"]
    return w.select("line_id", (F.col("i") + 1).cast("long").alias("word_no"), G.gap_box(before, after)["x0"].alias("x0"))


@query()
def kept_boxes(spark: SparkSession, d: str) -> DataFrame:
    det = _det(spark, d).unionByName(_gt(spark, d).select("file", (F.col("g") + 1_000_000_000).alias("d"), "bbox"))
    return matching.drop_overlaps(det.withColumnRenamed("d", "number"), "file", "number")


@query()
def greedy_f1(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall when each true box takes the free box it overlaps most."""
    gt, det = _gt(spark, d), _det(spark, d)
    return matching.detector_scores(gt, det, matching.match_lines(_flat(gt, "g"), _flat(det, "d"), box_limit=0.5, greedy=True))


_BEST = f"(SELECT g.file, g.g, arg_max(struct_pack(x0 := d.x0, y0 := d.y0, x1 := d.x1, y1 := d.y1), ({_IOU}, -d.d)) AS p, max({_IOU}) AS iou FROM {_G} g JOIN {_D} d USING (file) GROUP BY g.file, g.g)"
_PAIR = f"(SELECT b.*, g.x0, g.y0, g.x1, g.y1, g.y1 - g.y0 AS h, g.x1 - g.x0 AS w, greatest(1, p.y1 - p.y0) AS ph, greatest(1, p.x1 - p.x0) AS pw FROM {_BEST} b JOIN {_G} g USING (file, g))"
_OFF = ("(p.y0 - y0) / h", "(p.y1 - y1) / h", "(p.x0 - x0) / w", "(p.x1 - x1) / w", "(p.y1 - p.y0) / h", "(p.x1 - p.x0) / w")


@query(
    "SELECT edge, avg(v) AS mean, stddev_pop(v) AS sd, median(v) AS median FROM ("
    + " UNION ALL ".join(f"SELECT '{e}' AS edge, {x} AS v FROM {_PAIR} WHERE iou >= 0.3" for e, x in zip(("top", "bottom", "left", "right", "h_ratio", "w_ratio"), _OFF, strict=True))
    + ") GROUP BY edge"
)
def edge_errors(spark: SparkSession, d: str) -> DataFrame:
    return matching.edge_errors(_gt(spark, d), _det(spark, d), "file", "g", "d")


@query(
    "SELECT count(*) AS n_matched, greatest(0, round(median((p.y0 - y0) / ph), 3)) AS grow_top, greatest(0, round(median((y1 - p.y1) / ph), 3)) AS grow_bottom,"
    f" greatest(0, round((median((p.x0 - x0) / pw) + median((x1 - p.x1) / pw)) / 2, 3)) AS grow_sides FROM {_PAIR} WHERE iou >= 0.2"
)
def growth_fit(spark: SparkSession, d: str) -> DataFrame:
    return matching.growth_fit(_gt(spark, d), _det(spark, d), "file", "g", "d")


@query(
    "SELECT line_id, row_number() OVER (PARTITION BY file ORDER BY round_even(bbox.y0 / 40, 0), bbox.x0, bbox.y0, line_id) AS reading_no FROM gt_line WHERE bbox IS NOT NULL"
)
def row_order(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "gt_line").where("bbox is not null").withColumn("pj", F.col("line_id"))
    return matching.reading_rows(lines, "file").select("line_id", F.col("reading_no").cast("long"))


@query(
    "SELECT file, unnest([0, 1])::INT AS side, unnest([0, width // 2])::BIGINT AS x_offset, unnest([width // 2, width - width // 2])::BIGINT AS width, height::BIGINT AS height FROM gt_page"
)
def half_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gt_page").select("file", F.explode(G.page_halves(F.col("width"), F.col("height"))).alias("h")).select("file", "h.*")


@query("SELECT line_id, bbox.x0 + width // 2 AS x0, bbox.y0 AS y0, bbox.x1 + width // 2 AS x1, bbox.y1 AS y1 FROM gt_line JOIN gt_page USING (file) WHERE bbox IS NOT NULL")
def boxes_on_page(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that were found on a right half, on the whole page."""
    lines = table(spark, d, "gt_line").join(table(spark, d, "gt_page").select("file", "width"), "file").where("bbox is not null")
    return lines.select("line_id", G.shifted(F.col("bbox"), F.floor(F.col("width") / 2)).alias("b")).select("line_id", "b.*")


@query(
    "SELECT line_id, trunc((bbox.x0 + bbox.x1) / 2 - (bbox.x1 - bbox.x0) * 1.1 / 2) AS x0, trunc((bbox.y0 + bbox.y1) / 2 - (bbox.y1 - bbox.y0) * 1.5 / 2) AS y0,"
    " trunc((bbox.x0 + bbox.x1) / 2 + (bbox.x1 - bbox.x0) * 1.1 / 2) AS x1, trunc((bbox.y0 + bbox.y1) / 2 + (bbox.y1 - bbox.y0) * 1.5 / 2) AS y1 FROM gt_line WHERE bbox IS NOT NULL"
)
def scaled_boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gt_line").where("bbox is not null").select("line_id", G.scale(F.col("bbox"), 1.1, 1.5).alias("b")).select("line_id", "b.*")


_SPANS = (
    "(SELECT line_id, bbox, t, i, CAST(list_sum(list_transform(t[1:i - 1], lambda w: length(w))) AS BIGINT) AS before FROM (SELECT line_id, bbox, t, unnest(range(1, len(t) + 1)) AS i FROM"
    " (SELECT line_id, bbox, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM gt_line WHERE bbox IS NOT NULL)))"
)


@query(
    "SELECT line_id, i AS word_no, bbox.x0 + (bbox.x1 - bbox.x0) * (coalesce(before, 0) + i - 1) / (list_sum(list_transform(t, lambda w: length(w))) + len(t) - 1) AS x0,"
    " bbox.x0 + (bbox.x1 - bbox.x0) * (coalesce(before, 0) + i - 1 + length(t[i])) / (list_sum(list_transform(t, lambda w: length(w))) + len(t) - 1) AS x1, bbox.y0 AS y0, bbox.y1 AS y1 FROM " + _SPANS
)
def estimated_word_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the words of a line by their places alone (the words joined by single blanks)."""
    lines = table(spark, d, "gt_line").where("bbox is not null").select("line_id", "bbox", F.array_join(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ").alias("t"))
    none = F.lit(None).cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")
    words = F.transform(T.words_of(F.col("t")), lambda w: F.struct(w.alias("text"), F.lit("").alias("punct_after")))
    return lines.select("line_id", F.posexplode(G.word_boxes(F.col("t"), words, none, F.col("bbox"))).alias("i", "b")).select("line_id", (F.col("i") + 1).cast("long").alias("word_no"), "b.*")


@query()
def token_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a page's lines with their ink boxes, given or estimated."""
    lines = table(spark, d, "gt_line").select(
        "file", "gi", "text", "bbox", F.col("line_id").cast("string").alias("line_id"), F.lit(0.9).alias("confidence"),
        F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox"), F.lit(None).cast("double").alias("confidence"))).alias("words"),
    )
    made = dictation.lines_to_tokens(lines, "file", "gi", "text")
    return made.select("file", F.posexplode("read").alias("n", "t")).select("file", "n", "t.text", "t.line_id", "t.line_pos", "t.bbox")


# ---- scores --------------------------------------------------------------------------------------


_S = f"(SELECT line_id, file, gi, {NORM_T.format('text')} AS ref, {NORM_T.format(HYP_SQL)} AS hyp FROM gt_line)"
# the second reading only leaves letters out, so its edits are the difference of lengths, and its words are the line's in order
_WORDS = "list_filter(string_split_regex({}, '" + T.SPACE.replace("{", "{{").replace("}", "}}") + "'), lambda w: w <> '')"
_L = (
    f"(SELECT *, CASE WHEN hyp IS NOT NULL THEN CASE WHEN length(ref) = 0 THEN 0.0 ELSE (length(ref) - length(hyp)) / CAST(length(ref) AS DOUBLE) END END AS cer, length(ref) AS n_chars, len({_WORDS.format('ref')}) AS n_words,"
    f" CASE WHEN hyp IS NULL THEN 0 ELSE len(list_filter(list_zip({_WORDS.format('ref')}, {_WORDS.format('hyp')}), lambda z: z[1] = z[2])) END AS word_hits, coalesce(ref = hyp, false) AS perfect FROM {_S})"
)


@query(f"SELECT line_id, cer, CASE WHEN cer IS NULL THEN n_chars ELSE n_chars - length(hyp) END::DOUBLE AS edits, n_chars, n_words, word_hits, perfect FROM {_L}")
def line_cer(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("line_id", "cer", F.round("edits", 6).alias("edits"), "n_chars", "n_words", "word_hits", "perfect")


@query(
    "SELECT count(*) AS n_lines, sum(n_chars - length(hyp)) FILTER (hyp IS NOT NULL) / CAST(sum(n_chars) FILTER (hyp IS NOT NULL) AS DOUBLE) AS cer_matched,"
    " sum(n_chars - coalesce(length(hyp), 0)) / CAST(sum(n_chars) AS DOUBLE) AS cer_all, sum(word_hits) / CAST(sum(n_words) AS DOUBLE) AS word_accuracy,"
    f" count(*) FILTER (perfect) / CAST(count(*) AS DOUBLE) AS perfect_share FROM {_L}"
)
def overall_cer(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).agg(*scoring.aggregate_lines())


_PAGES = (
    "(SELECT file, count(hyp) / CAST(count(*) AS DOUBLE) AS line_recall, coalesce(avg(cer), 1.0) AS line_cer, count(*) AS n_lines, sum(n_chars)::BIGINT AS n_chars, sum(n_words)::BIGINT AS n_words, sum(word_hits)::BIGINT AS word_hits,"
    " count(*) FILTER (perfect) AS n_perfect,"
    " length(trim(string_agg(ref, chr(10) ORDER BY gi), chr(10) || ' ')) AS r, length(trim(string_agg(coalesce(hyp, ''), chr(10) ORDER BY gi), chr(10) || ' ')) AS h"
    f" FROM {_L} GROUP BY file)"
)


@query(f"SELECT file, line_recall, line_cer, n_lines, n_chars, n_words, word_hits, n_perfect, CASE WHEN r = 0 THEN 0.0 ELSE (r - h) / CAST(r AS DOUBLE) END AS page_cer FROM {_PAGES}")
def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scoring.page_scores(scored(spark, d), "file", "gi").drop("edits", "page_wer", "extra_lines")


@query(
    "SELECT count(*) AS n_pages, sum(c * n_chars) / sum(n_chars) AS page_cer_cw, median(c) AS page_cer_median, avg(line_cer) AS line_cer_mean, median(line_cer) AS line_cer_median, avg(line_recall) AS line_recall_mean,"
    f" sum(n_lines)::BIGINT AS n_lines, sum(n_chars)::BIGINT AS n_chars FROM (SELECT *, CASE WHEN r = 0 THEN 0.0 ELSE (r - h) / CAST(r AS DOUBLE) END AS c FROM {_PAGES})"
)
def overall_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scoring.overall(scoring.page_scores(scored(spark, d), "file", "gi")).drop("page_wer_mean", "extra_lines")


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """The second reading as lines of a detector: some lines are missing, and after every thirteenth comes one that isn't there."""
    lines = table(spark, d, "gt_line").where("bbox is not null")
    found = lines.select("file", F.col("gi").cast("long").alias("pj"), read_again().alias("text"), "bbox").where("text is not null")
    far = F.col("gi") * 60.0 + 1e6
    more = lines.where("line_id % 13 = 0").select("file", (F.col("gi") + 1_000_000).cast("long").alias("pj"), F.lit("лишняя строка").alias("text"), G.box(F.lit(0.0), far, F.lit(500.0), far + 50).alias("bbox"))
    return found.unionByName(more)


def page_block_rows(spark: SparkSession, d: str) -> DataFrame:
    gt = table(spark, d, "gt_line").where("bbox is not null").select("file", F.col("gi").cast("long").alias("gi"), "text", "bbox")
    pred = _predicted(spark, d)
    flat = lambda df, place: df.select("file", F.col(place).alias("place"), "text", "bbox.*")
    pairs = matching.match_lines(flat(gt, "gi"), flat(pred, "pj"))
    pages = scoring.page_scores(scoring.matched_lines(gt, pred, pairs), "file", "gi", pred)
    return pages.join(table(spark, d, "gt_page").select("file", "teacher_marks"), "file", "left")


@query(
    "SELECT p.file, p.line_recall, p.line_cer, p.n_lines, p.n_chars, p.n_perfect, coalesce(x, 0) AS extra_lines, CASE WHEN line_recall > 0 THEN 1.0 END AS box_hit_rate, g.teacher_marks"
    f" FROM {_PAGES} p LEFT JOIN (SELECT file, count(*) AS x FROM gt_line WHERE bbox IS NOT NULL AND line_id % 13 = 0 GROUP BY file) e ON e.file = p.file LEFT JOIN gt_page g ON g.file = p.file"
)
def page_block(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a reading with its own boxes: lines are matched by box, and lines that aren't there are counted."""
    return page_block_rows(spark, d).select("file", "line_recall", "line_cer", "n_lines", "n_chars", "n_perfect", "extra_lines", "box_hit_rate", "teacher_marks")


@query()
def overall_block(spark: SparkSession, d: str) -> DataFrame:
    return scoring.overall(page_block_rows(spark, d))


@query("SELECT file, row_number() OVER (ORDER BY c, file) AS place FROM (SELECT file, CASE WHEN r = 0 THEN 0.0 ELSE (r - h) / CAST(r AS DOUBLE) END AS c FROM " + _PAGES + ") QUALIFY place <= 10")
def best_pages(spark: SparkSession, d: str) -> DataFrame:
    """The ten pages read best (a report)."""
    made = scoring.page_scores(scored(spark, d), "file", "gi").select("file", "page_cer").orderBy("page_cer", "file").limit(10)
    return made.select("file", F.row_number().over(Window.orderBy("page_cer", "file")).cast("long").alias("place"))




@query(f"SELECT file, count(*) AS n_lines, count(hyp) / CAST(count(*) AS DOUBLE) AS line_recall, sum(length(ref))::BIGINT AS n_chars, count(*) FILTER (hyp IS NOT NULL AND ref = hyp) AS n_perfect FROM {_S} GROUP BY file")
def page_recall(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("file").agg(
        F.count("*").alias("n_lines"), (F.count("hyp") / F.count("*")).alias("line_recall"), F.sum("n_chars").alias("n_chars"), F.count_if("perfect").alias("n_perfect")
    )


@query(
    f"SELECT coalesce(teacher_marks, 0) > 0 AS marked, count(*) AS n_lines, count(*) FILTER (hyp IS NOT NULL AND ref = hyp) / CAST(count(*) AS DOUBLE) AS perfect_share FROM {_S} s JOIN gt_page USING (file) GROUP BY marked"
)
def clean_vs_marked(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "gt_page").select("file", (F.coalesce("teacher_marks", F.lit(0)) > 0).alias("marked"))
    return scored(spark, d).join(pages, "file").groupBy("marked").agg(F.count("*").alias("n_lines"), (F.count_if("perfect") / F.count("*")).alias("perfect_share"))


_P = f"(SELECT file AS key, count(*) FILTER (perfect) AS num, count(*) AS den, sum(word_hits) AS other_num, sum(n_words) AS other_den FROM {_L} GROUP BY file)"


def _bootstrap_sql(other: str = "", more: str = "") -> str:
    return (
        f"WITH p AS (SELECT *, row_number() OVER (ORDER BY left(md5(key), 2), key) - 1 AS pick FROM {_P}), k AS (SELECT count(*) AS k FROM p),"
        " w AS (SELECT b, ('0x' || left(md5('0-' || b || '-' || i), 8))::BIGINT % k AS pick FROM (SELECT unnest(range(1000)) AS b) x, (SELECT pick AS i FROM p) y, k),"
        f" v AS (SELECT b, sum(num) / greatest(sum(den), 1e-9){other} AS v FROM w JOIN p USING (pick) GROUP BY b)"
        f" SELECT quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high{more} FROM v"
    )


def _sums(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("file").agg(F.count_if("perfect").alias("num"), F.count("*").alias("den"), F.sum("word_hits").alias("hits"), F.sum("n_words").alias("words"))


@query(_bootstrap_sql())
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return scoring.bootstrap(_sums(spark, d), "file", "num", "den").drop("mean")


@query(_bootstrap_sql(" - sum(other_num) / greatest(sum(other_den), 1e-9)", ", quantile_cont(v, 0.975) < 0 OR quantile_cont(v, 0.025) > 0 AS significant"))
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """Share of perfect lines against share of right words, on the same draws of pages."""
    return scoring.bootstrap(_sums(spark, d), "file", "num", "den", other=("hits", "words")).drop("mean")


@query()
def baseline_delta(spark: SparkSession, d: str) -> DataFrame:
    """Character error rate of matched lines of two readings of the same pages, paired by page; the other reading loses more."""
    worse = F.replace(read_again(), F.lit("а"), F.lit(""))
    runs = [scoring.line_scores(table(spark, d, "gt_line").select("file", "text", r.alias("read")), "text", "read") for r in (read_again(), worse)]
    sums = [r.where("hyp is not null").groupBy("file").agg(F.sum("edits").alias(f"num{i}"), F.sum("n_chars").alias(f"den{i}")) for i, r in enumerate(runs)]
    return scoring.bootstrap(sums[0].join(sums[1], "file"), "file", "num0", "den0", other=("num1", "den1"))


@query()
def seen_novel(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "train_label").where(F.lower(F.trim(F.coalesce("split", F.lit("train")))) == "train")
    seen = scoring.seen_lines(table(spark, d, "gt_line"), "line_id", "text", train, "text")
    return seen.groupBy("seen").agg(F.count("*").alias("n"))


_N = NORM_T.format("text")


@query(
    f"SELECT CASE WHEN length(a) >= 8 THEN a IN (SELECT {_N} FROM train_label WHERE lower(trim(coalesce(split, 'train'))) = 'train' AND text IS NOT NULL) END AS seen, count(*) AS n FROM (SELECT {_N} AS a FROM gt_line) GROUP BY seen"
)
def seen_exactly(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "train_label").where(F.lower(F.trim(F.coalesce("split", F.lit("train")))) == "train").select(T.scored_form(F.col("text")).alias("a")).distinct().withColumn("hit", F.lit(True))
    line = table(spark, d, "gt_line").select(T.scored_form(F.col("text")).alias("a"))
    return line.join(train, "a", "left").select(F.when(F.length("a") >= 8, F.coalesce("hit", F.lit(False))).alias("seen")).groupBy("seen").agg(F.count("*").alias("n"))


@query()
def seen_novel_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of lines whose text, or one much like it, was trained on, and of new ones; short lines are counted apart."""
    train = table(spark, d, "train_label").where(F.lower(F.trim(F.coalesce("split", F.lit("train")))) == "train")
    seen = scoring.seen_lines(table(spark, d, "gt_line"), "line_id", "text", train, "text").withColumnRenamed("key", "line_id")
    return scored(spark, d).join(seen, "line_id").groupBy("seen").agg(*scoring.aggregate_lines())


_TWO = "(SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS a FROM gt_line)"


@query(f"SELECT a, left(a, 1) || substr(a, 3) AS b, 200.0 * (length(a) - 1) / (2 * length(a) - 1) AS indel FROM {_TWO} WHERE length(a) >= 2")
def word_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of every word and the word without its second letter, by insertions and deletions."""
    w = table(spark, d, "gt_line").select(F.explode(F.split("text", r"\s+")).alias("a")).distinct().where("length(a) >= 2")
    return w.withColumn("b", F.concat(F.left("a", F.lit(1)), F.substring("a", 3, 1 << 30))).select("a", "b", indel_ratio_col("a", "b").alias("indel"))


@query()
def word_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The same by matched blocks."""
    return word_likeness(spark, d).select("a", "b", similarity_col("a", "b").alias("blocks"))


@query("SELECT DISTINCT file FROM train_label WHERE file NOT IN (SELECT file FROM gt_page)")
def pages_without_truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_label").select("file").distinct().join(table(spark, d, "gt_page").select("file"), "file", "left_anti")


@query("SELECT job_id FROM dictation_key WHERE job_id NOT IN (SELECT job_id FROM open_question WHERE job_id IS NOT NULL)")
def resumed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """What is left to do when a sink already holds some jobs."""
    done = table(spark, d, "open_question").select("job_id").distinct()
    return table(spark, d, "dictation_key").select("job_id").join(done, "job_id", "left_anti")


@query("SELECT event_type, median(value) AS median_value FROM events GROUP BY event_type")
def median_by_condition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.median("value").alias("median_value"))


@query("SELECT event_type AS best FROM (SELECT event_type, median(value) AS m FROM events GROUP BY event_type) ORDER BY m, event_type LIMIT 1")
def best_by_median(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("event_type").agg(F.median("value").alias("m"))
    return m.agg(F.min_by("event_type", F.struct("m", "event_type")).alias("best"))


_LAST = "(SELECT user_id, event_type, arg_max(struct_pack(v := value), (ts, event_id)).v AS value, min((ts, event_id)) AS place FROM events GROUP BY user_id, event_type)"


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS points, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY user_id, event_type")
def last_value_first_place(spark: SparkSession, d: str) -> DataFrame:
    """Criteria (here kinds of events of a user) with their last value at their first place."""
    ev = table(spark, d, "events").withColumn("most", F.lit(100.0))
    last = answers.last_criteria(ev, "user_id", "event_type", F.struct("ts", "event_id"), "value", "most")
    return last.select("user_id", "event_type", "points", F.col("place.event_id").alias("first_event"))


@query(f"SELECT user_id, count(*) AS n_criteria, sum(coalesce(value, 0)) AS score, 100.0 * count(*) AS max_score FROM {_LAST} GROUP BY user_id")
def criteria_totals(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("most", F.lit(100.0))
    return answers.criteria_totals(answers.last_criteria(ev, "user_id", "event_type", F.struct("ts", "event_id"), "value", "most"), "user_id")


QUERIES, ORACLE = query.queries, query.oracle
