"""Boxes as struct<x0, y0, x1, y1> columns, in pixels of the page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Growth of a line box and of a word box as fractions of its own height and width: top, bottom, sides.
LINE_GROWTH = (0.25, 0.365, 0.02)
WORD_GROWTH = (0.344, 0.416, 0.105)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)])


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that don't meet or have no area."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def grow(b: Column, width: Column, height: Column, by: tuple[float, float, float]) -> Column:
    top, bottom, sides = by
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    return box(
        F.greatest(F.lit(0.0), b["x0"] - sides * w), F.greatest(F.lit(0.0), b["y0"] - top * h), F.least(width.cast("double"), b["x1"] + sides * w), F.least(height.cast("double"), b["y1"] + bottom * h)
    )


def word_boxes(text: Column, words: Column, given: Column, line: Column) -> Column:
    """array<box>: a box for each word of a line (``words``: array of structs with text and punct_after, in order).

    A word's stretch of the line's width is that of its characters in the text. Of the ``given`` ink boxes the one that overlaps the
    stretch most is the word's, if by more than three tenths of the stretch; else the word has its stretch, at the upper median height of
    the given boxes or of the line. Without given boxes and a line box a word has none.
    """
    no_place = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a: int, b: int>>").alias("spans"))

    def next_span(acc: Column, w: Column) -> Column:
        found = F.call_function("locate", w["text"], text, acc["at"] + 1)
        a = F.when(found > 0, found - 1).otherwise(acc["at"])
        span = F.struct(a.cast("int").alias("a"), (a + F.length(w["text"]) + F.length(w["punct_after"])).cast("int").alias("b"))
        return F.struct((a + F.length(w["text"])).cast("int").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(words, no_place, next_span, lambda acc: acc["spans"])
    ink = F.array_sort(F.coalesce(given, F.array().cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")))

    def of_line(at: Column) -> Column:
        ink, n = at["ink"], at["n"]
        some = F.size(ink) > 0
        side = lambda name, f: f(F.transform(ink, lambda g: g[name]))
        around = F.when(some, box(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max)))
        middle = lambda name: F.get(F.array_sort(F.transform(ink, lambda g: g[name])), (F.size(ink) / 2).cast("int"))
        whole = F.coalesce(line, around)
        high = F.struct(whole.alias("box"), F.when(some, middle("y0")).otherwise(whole["y0"]).alias("y0"), F.when(some, middle("y1")).otherwise(whole["y1"]).alias("y1"))
        return let(high, lambda h: F.transform(at["spans"], lambda span: of_word(span, ink, n, h)))

    def of_word(span: Column, ink: Column, n: Column, h: Column) -> Column:
        width = h["box"]["x1"] - h["box"]["x0"]
        a, b = h["box"]["x0"] + width * span["a"] / n, h["box"]["x0"] + width * span["b"] / n
        own = box(a, h["y0"], b, h["y1"])

        def best_of(own: Column) -> Column:
            overlap = lambda g: F.least(own["x1"], g["x1"]) - F.greatest(own["x0"], g["x0"])
            # of equal overlaps the first from the left
            ranked = F.array_sort(F.transform(ink, lambda g, i: F.struct((-overlap(g)).alias("o"), i.alias("i"), g.alias("g"))))
            return let(F.get(ranked, 0), lambda best: F.when(-best["o"] > 0.3 * (own["x1"] - own["x0"]), best["g"]).otherwise(own))

        return F.when(h["box"].isNull(), F.lit(None)).when(F.size(ink) == 0, own).otherwise(let(own, best_of))

    return let(F.struct(ink.alias("ink"), spans.alias("spans"), F.greatest(F.length(text), F.lit(1)).alias("n")), of_line)


def nearest_polyline(x: Column, y: Column, width: Column, height: Column, lines: Column) -> Column:
    """Number of the line (array of arrays of points x, y) whose nearest point to the left or right of a word is nearest in height.

    A point counts within the larger of 30 and the word's width, and the line within 1.2 heights; null if there is none.
    """
    reach = F.greatest(F.lit(30.0), width)

    def far(points: Column) -> Column:
        beside = F.transform(points, lambda p: F.struct(F.abs(p["x"] - x).alias("dx"), F.abs(p["y"] - y).alias("dy")))
        return F.get(F.array_sort(F.filter(beside, lambda p: p["dx"] <= reach)), 0)["dy"]

    ranked = F.filter(F.transform(lines, lambda points, i: F.struct(far(points).alias("dy"), i.alias("i"))), lambda r: r["dy"].isNotNull() & (r["dy"] < 1.2 * height))
    return F.get(F.array_sort(ranked), 0)["i"]


def page_halves(width: Column, height: Column) -> Column:
    """array<struct<side, x_offset, width, height>>: the left and the right half of a spread."""
    left = F.floor(width / 2).cast("long")
    half = lambda i, off, w: F.struct(F.lit(i).alias("side"), off.cast("long").alias("x_offset"), w.cast("long").alias("width"), height.cast("long").alias("height"))
    return F.array(half(0, F.lit(0), left), half(1, left, width - left))


def shifted(b: Column, dx: Column) -> Column:
    """A box of a half back on the whole page."""
    return box(b["x0"] + dx, b["y0"], b["x1"] + dx, b["y1"])


def scale(b: Column, ux: float, uy: float) -> Column:
    """A box stretched about its middle, with whole coordinates cut towards zero."""
    w, h = (b["x1"] - b["x0"]) * ux, (b["y1"] - b["y0"]) * uy
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    cut = lambda c: c.cast("long")
    return box(cut(cx - w / 2), cut(cy - h / 2), cut(cx + w / 2), cut(cy + h / 2))


def pad(b: Column, by: float, width: Column, height: Column) -> Column:
    """A box wider by ``by`` on every side, within the page."""
    return box(F.greatest(F.lit(0.0), b["x0"] - by), F.greatest(F.lit(0.0), b["y0"] - by), F.least(width.cast("double"), b["x1"] + by), F.least(height.cast("double"), b["y1"] + by))


def polygon_box(xy: Column) -> Column:
    """The box of a polygon x, y, x, y ...; null for fewer than three points."""
    xs = F.filter(xy, lambda _, i: i % 2 == 0)
    ys = F.filter(xy, lambda _, i: i % 2 == 1)
    return F.when((F.size(xy) >= 6) & (F.size(xy) % 2 == 0), box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def polygon_area(xy: Column) -> Column:
    """Area by the shoelace sum."""
    n = (F.size(xy) / 2).cast("int")
    at = lambda i, k: F.get(xy, (i % n) * 2 + k)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i, 0) * at(i + 1, 1) - at(i + 1, 0) * at(i, 1))
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2)


def polygon_length(xy: Column) -> Column:
    n = (F.size(xy) / 2).cast("int")
    at = lambda i, k: F.get(xy, (i % n) * 2 + k)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sqrt((at(i + 1, 0) - at(i, 0)) ** 2 + (at(i + 1, 1) - at(i, 1)) ** 2))
    return F.when(n >= 3, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def gap_box(before: Column, after: Column) -> Column:
    """Where a missing word belongs: right of the word before, else left of the word after."""
    wide = lambda b: F.greatest(F.lit(8.0), 0.3 * (b["y1"] - b["y0"]))
    return F.when(before.isNotNull(), box(before["x1"], before["y0"], before["x1"] + wide(before), before["y1"])).when(
        after.isNotNull(), box(after["x0"] - wide(after), after["y0"], after["x0"], after["y1"])
    )
