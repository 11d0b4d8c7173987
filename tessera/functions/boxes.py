"""Box and interval geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlap_1d(a0: Name, a1: Name, b0: Name, b1: Name) -> Column:
    """Length that two intervals share, at least 0."""
    return F.greatest(F.lit(0.0), F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)))


def interval_iou(a0: Name, a1: Name, b0: Name, b1: Name) -> Column:
    """Temporal intersection over union; 0 where the union has no length."""
    inter = overlap_1d(a0, a1, b0, b1)
    union = (col(a1) - col(a0)) + (col(b1) - col(b0)) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes in columns <prefix>x1, y1, x2, y2; 0 where the union has no area."""
    c = lambda p, n: F.col(f"{p}{n}").cast("double")
    inter = overlap_1d(c(a, "x1"), c(a, "x2"), c(b, "x1"), c(b, "x2")) * overlap_1d(c(a, "y1"), c(a, "y2"), c(b, "y1"), c(b, "y2"))
    area = lambda p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1"))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def derived(x1: Name = "x1", y1: Name = "y1", x2: Name = "x2", y2: Name = "y2") -> dict[str, Column]:
    """Centre, height and area of a box."""
    return {"cx": (col(x1) + col(x2)) / 2, "cy": (col(y1) + col(y2)) / 2, "bbox_h": col(y2) - col(y1), "bbox_area": (col(x2) - col(x1)) * (col(y2) - col(y1))}


def foot(x1: Name = "x1", x2: Name = "x2", y2: Name = "y2") -> dict[str, Column]:
    """Where a box stands: the middle of its lower edge."""
    return {"foot_x": (col(x1) + col(x2)) / 2, "foot_y": col(y2) * F.lit(1.0)}


def distance(x1: Name, y1: Name, x2: Name, y2: Name) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)
