"""Box and polygon geometry as column expressions (no Python on the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxwise import constants as K


def box_area(w: Column, h: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(w, zero) * F.greatest(h, zero)


def intersection(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Overlap area of two xywh boxes, 0 when they do not meet."""
    zero = F.lit(0.0)
    iw = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    ih = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(iw, zero) * F.greatest(ih, zero)


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union in double precision, 0 when the union is empty."""
    inter = intersection(ax, ay, aw, ah, bx, by, bw, bh)
    union = box_area(aw, ah) + box_area(bw, bh) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def cover(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Part of the second box that the first covers, 0 when the second is empty."""
    own = box_area(bw, bh)
    return F.when(own > 0, intersection(ax, ay, aw, ah, bx, by, bw, bh) / own).otherwise(F.lit(0.0))


def scale_of(area: Column) -> Column:
    return (
        F.when(area < K.SMALL_AREA, F.lit("small"))
        .when(area < K.MEDIUM_AREA, F.lit("medium"))
        .otherwise(F.lit("large"))
    )


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, low), high)


def letterbox_scale(width: Column, height: Column, size: float = K.NETWORK_SIZE) -> Column:
    return F.least(F.lit(size) / width, F.lit(size) / height)


def _edges(polygon: Column) -> Column:
    """Edges {ax, ay, bx, by} of a flat [x0, y0, x1, y1, ...] polygon, closed."""
    n = F.size(polygon)
    return F.transform(
        F.sequence(F.lit(0), (n / 2).cast("int") - 1),
        lambda i: F.struct(
            F.get(polygon, i * 2).alias("ax"),
            F.get(polygon, i * 2 + 1).alias("ay"),
            F.get(polygon, (i * 2 + 2) % n).alias("bx"),
            F.get(polygon, (i * 2 + 3) % n).alias("by"),
        ),
    )


def polygon_area(polygon: Column) -> Column:
    """Shoelace area; under three points gives 0."""
    total = F.aggregate(
        _edges(polygon), F.lit(0.0), lambda acc, e: acc + (e["ax"] * e["by"] - e["bx"] * e["ay"])
    )
    return F.when(F.size(polygon) >= 6, F.abs(total) / 2).otherwise(F.lit(0.0))


def clipped_area(polygon: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a polygon inside a box, as a signed sum over its edges.

    Each edge adds the integral, over its stretch of x inside the box, of its height
    above y0 limited to the box; the closed form needs no clipped polygon.
    """

    def stretch(e: Column) -> Column:
        xa, xb = clamp(e["ax"], x0, x1), clamp(e["bx"], x0, x1)
        slope = F.when(e["ax"] == e["bx"], F.lit(0.0)).otherwise((e["by"] - e["ay"]) / (e["bx"] - e["ax"]))
        return F.struct(
            (xb - xa).alias("dx"),
            (e["ay"] + (xa - e["ax"]) * slope - y0).alias("ha"),
            (e["ay"] + (xb - e["ax"]) * slope - y0).alias("hb"),
        )

    tall = y1 - y0

    def primitive(h: Column) -> Column:
        inside = clamp(h, F.lit(0.0), tall)
        return inside * inside / 2 + F.greatest(h - tall, F.lit(0.0)) * tall

    def integral(s: Column) -> Column:
        rise = s["hb"] - s["ha"]
        level = clamp((s["ha"] + s["hb"]) / 2, F.lit(0.0), tall) * s["dx"]
        return F.when(F.abs(rise) < 1e-9, level).otherwise((primitive(s["hb"]) - primitive(s["ha"])) / rise * s["dx"])

    total = F.aggregate(
        F.transform(_edges(polygon), stretch), F.lit(0.0), lambda acc, s: acc + integral(s)
    )
    return F.when((F.size(polygon) >= 6) & (tall > 0) & (x1 > x0), F.abs(total)).otherwise(F.lit(0.0))
