"""Boxes, cells and intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "", frame: str = "") -> tuple[Column, Column, Column, Column]:
    """The four box columns <prefix>x0 ... of an optional alias."""
    at = f"{frame}." if frame else ""
    return tuple(F.col(f"{at}{prefix}{c}") for c in BOX)


def touching(a: tuple, b: tuple) -> Column:
    """Whether two boxes share a point; far cheaper than their IoU, which is 0 where this is false."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two boxes; 0 where they do not overlap."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    shared = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return F.when((shared > 0) & (union > 0), shared / F.when(union > 0, union)).otherwise(0.0)


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the length of the union of two intervals; 0 where they do not overlap."""
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    union = (a1 - a0) + (b1 - b0) - shared
    return F.when(union > 0, shared / F.when(union > 0, union)).otherwise(0.0)


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def blend(persistence: Column, strength: Column) -> Column:
    """Half how consistently evidence appeared, half how strong it was; at most 0.97."""
    return clip(0.5 * clip(persistence, 0.0, 1.0) + 0.5 * clip(strength, 0.0, 1.0), 0.0, 0.97)


def salience(mean_z: Column, duration: Column) -> Column:
    return mean_z * F.sqrt(F.greatest(duration, F.lit(1e-6)))


def to_cell(px: Column, cell: int, cells: Column | int) -> Column:
    """The grid cell of a pixel coordinate, clamped to the grid."""
    last = (cells - 1) if isinstance(cells, Column) else F.lit(cells - 1)
    return F.least(F.greatest(F.floor(px / cell), F.lit(0)), last).cast("int")


def centre(b: tuple) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def diagonal(b: tuple) -> Column:
    return F.hypot(b[2] - b[0], b[3] - b[1])


def contains(b: tuple, x: Column, y: Column) -> Column:
    return (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])


def stabilise(x: Column, how: str = "sqrt") -> Column:
    """Variance stabiliser on max(x, 0): sqrt, log1p or none."""
    x = F.greatest(x, F.lit(0.0))
    return {"sqrt": F.sqrt, "log1p": F.log1p, "none": lambda c: c}[how](x)
