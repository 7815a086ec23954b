"""Boxes as structs <x, y, w, h> of fractions of the picture."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _shared(a: Column, b: Column) -> Column:
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where either is empty."""
    shared = _shared(a, b)
    union = a.w * a.h + b.w * b.h - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def share_inside(a: Column, b: Column) -> Column:
    """The share of a that lies in b."""
    area = a.w * a.h
    return F.when(area > 0, _shared(a, b) / area).otherwise(0.0)


def box(x, y, w, h) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def turn(b: Column, quarters: Column) -> Column:
    """A box in the picture turned clockwise by quarters."""
    q = F.pmod(quarters, F.lit(4))
    return (
        F.when(q == 1, box(1 - b.y - b.h, b.x, b.h, b.w))
        .when(q == 2, box(1 - b.x - b.w, 1 - b.y - b.h, b.w, b.h))
        .when(q == 3, box(b.y, 1 - b.x - b.w, b.h, b.w))
        .otherwise(box(b.x, b.y, b.w, b.h))
    )


def unrotate(b: Column, roll: Column) -> Column:
    """A box found in the picture rolled by 90, 180 or 270 degrees, back in the picture as it is."""
    return turn(b, -(roll / 90).cast("int"))


def width_px(b: Column, width: Column, height: Column, roll: Column) -> Column:
    return F.when(F.pmod(F.coalesce(roll, F.lit(0)), F.lit(180)) == 90, b.h * height).otherwise(b.w * width)


def valid_position(lat: Column, lon: Column) -> Column:
    """In range, finite and not exactly (0, 0); false for null."""
    fine = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(fine & ~((lat == 0) & (lon == 0)), F.lit(False))


def in_area(lat: Column, lon: Column, south, west, north, east) -> Column:
    """Closed rectangle that doesn't cross the date line."""
    return lat.between(south, north) & lon.between(west, east)
