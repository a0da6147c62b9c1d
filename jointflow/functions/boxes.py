"""Bounding-box geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_area(box: Column) -> Column:
    """Area, 0 for a box whose corners are swapped."""
    width = F.greatest(F.lit(0.0), box["x2"] - box["x1"])
    height = F.greatest(F.lit(0.0), box["y2"] - box["y1"])
    return width * height


def intersection_area(a: Column, b: Column) -> Column:
    width = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    height = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def overlaps(a: Column, b: Column, iou: float) -> Column:
    """IoU of ``a`` and ``b`` above ``iou``, without dividing (two empty boxes never overlap)."""
    inter = intersection_area(a, b)
    return inter > F.lit(float(iou)) * (box_area(a) + box_area(b) - inter)


def pixel(value: Column) -> Column:
    """Truncate toward zero to an int; NaN or out-of-range becomes NULL instead of failing the job."""
    return value.try_cast("int")


def pixel_box(box: Column) -> Column:
    return F.struct(*[pixel(box[c]).alias(c) for c in ("x1", "y1", "x2", "y2")])
