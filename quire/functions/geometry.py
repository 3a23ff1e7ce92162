"""Boxes, coordinates and ordered folds as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in BOX]


def overlap_ratio(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area of the intersection over the smaller area; 0 where boxes are apart or one has no area."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    small = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when((width <= 0) | (height <= 0) | (small <= 0), F.lit(0.0)).otherwise(width * height / small)


def contains(outer: Sequence[Column], inner: Sequence[Column], margin: float = 5.0) -> Column:
    return (inner[0] >= outer[0] - margin) & (inner[1] >= outer[1] - margin) & (inner[2] <= outer[2] + margin) & (inner[3] <= outer[3] + margin)


def valid_table(b: Sequence[Column], rows: Column, cols: Column, strict: bool) -> Column:
    width, height = b[2] - b[0], b[3] - b[1]
    if not strict:
        return (rows >= 1) & (width >= 30) & (height >= 10)
    return (rows >= 1) & (cols >= 2) & (width >= 80) & (height >= 20) & ~((rows == 1) & (cols <= 2) & (width > 400))


def merge_coords(values: Column, gap: float) -> Column:
    """Sorted distinct coordinates; one nearer than gap to the last kept moves that one to the mean of both. The last
    drifts with each step, so this is a fold and no window."""
    empty = F.array().cast("array<double>")
    return F.aggregate(
        F.array_sort(F.array_distinct(values)),
        empty,
        lambda a, x: F.when((F.size(a) == 0) | F.coalesce(x - F.try_element_at(a, F.lit(-1)) >= gap, F.lit(True)), F.concat(a, F.array(x))).otherwise(F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array((F.try_element_at(a, F.lit(-1)) + x) / 2))),
    )
