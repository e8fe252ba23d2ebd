"""Bounding-box expressions over struct<x_min,y_min,x_max,y_max> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box with its corners put in order; null when a side is missing."""
    made = F.struct(
        F.least(x1, x2).alias("x_min"), F.least(y1, y2).alias("y_min"),
        F.greatest(x1, x2).alias("x_max"), F.greatest(y1, y2).alias("y_max"),
    )
    return F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), made)


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x_max"] - b["x_min"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y_max"] - b["y_min"])


def centre_x(b: Column) -> Column:
    return (b["x_min"] + b["x_max"]) / 2


def centre_y(b: Column) -> Column:
    return (b["y_min"] + b["y_max"]) / 2


def area(b: Column) -> Column:
    return width(b) * height(b)


def has_extent(b: Column) -> Column:
    return F.coalesce((width(b) > 0) | (height(b) > 0), F.lit(False))


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x_min"], b["x_max"]) & y.between(b["y_min"], b["y_max"])


def intersects(a: Column, b: Column) -> Column:
    apart = (
        (a["x_max"] < b["x_min"]) | (a["x_min"] > b["x_max"])
        | (a["y_max"] < b["y_min"]) | (a["y_min"] > b["y_max"])
    )
    return has_extent(a) & has_extent(b) & ~apart


def overlap_x(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"]))


def overlap_y(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"]))


def intersection(a: Column, b: Column) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two empty boxes."""
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    """Distance between the centres."""
    return F.hypot(centre_x(a) - centre_x(b), centre_y(a) - centre_y(b))


def envelope(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    return F.struct(
        F.min(b["x_min"]).alias("x_min"), F.min(b["y_min"]).alias("y_min"),
        F.max(b["x_max"]).alias("x_max"), F.max(b["y_max"]).alias("y_max"),
    )
