"""Boxes and what they tell of each other, as expressions over ``struct<x0, top, x1, bottom>``,
and the gaps and letters of a line's words.

All are built-in functions, so they stay inside one projection; null boxes give null,
but for unions, which pass over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

SIDES = ("x0", "top", "x1", "bottom")
#: Share of characters from which a line counts as bold or italic.
HEAVY = 0.6


def box(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return F.struct(*(side.cast("double").alias(name) for name, side in zip(SIDES, (x0, top, x1, bottom), strict=True)))


def width(b: Column) -> Column:
    return b.getField("x1") - b.getField("x0")


def height(b: Column) -> Column:
    return b.getField("bottom") - b.getField("top")


def center_x(b: Column) -> Column:
    return (b.getField("x0") + b.getField("x1")) / 2


def center_y(b: Column) -> Column:
    return (b.getField("top") + b.getField("bottom")) / 2


def union(boxes: Column) -> Column:
    """The smallest box around all of an array; null if it has none."""
    side = lambda name: F.transform(boxes, lambda b: b.getField(name))
    around = F.struct(*((F.array_min if name in ("x0", "top") else F.array_max)(side(name)).alias(name) for name in SIDES))
    return F.when(F.exists(boxes, lambda b: b.isNotNull()), around)


def merged(a: Column, b: Column) -> Column:
    """The smallest box around both."""
    return union(F.array(a, b))


def contains(b: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a box or on its edge."""
    return x.between(b.getField("x0"), b.getField("x1")) & y.between(b.getField("top"), b.getField("bottom"))


def overlap_x(a: Column, b: Column) -> Column:
    """How far two boxes share their horizontal range; negative where they are apart."""
    return F.least(a.getField("x1"), b.getField("x1")) - F.greatest(a.getField("x0"), b.getField("x0"))


def overlap_y(a: Column, b: Column) -> Column:
    return F.least(a.getField("bottom"), b.getField("bottom")) - F.greatest(a.getField("top"), b.getField("top"))


def edge_length(edge: Column) -> Column:
    """Length of a rule that is horizontal (``orientation`` h) or vertical."""
    return F.when(edge.getField("orientation") == "h", width(edge)).otherwise(height(edge))


def edge_place(edge: Column) -> Column:
    """Where a rule lies across its direction: its y if it is horizontal, else its x."""
    return F.when(edge.getField("orientation") == "h", center_y(edge)).otherwise(center_x(edge))


def gaps(words: Column) -> Column:
    """``start, end, after`` of the room between neighbouring words, where there is
    any; ``after`` is the number of the word behind it, from 0."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.struct(a.getField("x1").alias("start"), b.getField("x0").alias("end")))
    numbered = F.transform(pairs, lambda p, k: F.struct(p.getField("start").alias("start"), p.getField("end").alias("end"), (k + 1).alias("after")))
    return F.filter(numbered, lambda g: g.getField("end") > g.getField("start"))


def words_between(words: Column, left: Column, right: Column) -> Column:
    """Words whose middle is at ``left`` or behind it and before ``right``."""
    return F.filter(words, lambda w: (center_x(w) >= left) & (center_x(w) < right))


def char_count(words: Column) -> Column:
    """Characters in words, so without the spaces between them."""
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w.getField("text")))


def is_blank(words: Column) -> Column:
    return ~F.exists(words, lambda w: T.strip(w.getField("text")) != "")


def is_bold(style: Column) -> Column:
    return style.getField("bold_ratio") >= HEAVY


def is_italic(style: Column) -> Column:
    return style.getField("italic_ratio") >= HEAVY
