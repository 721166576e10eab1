"""Overlap joins inside dense images, by a grid of several levels.

A box lies on the level whose cells are at least as large as its longer side, so it touches four of them at most,
wherever it lies. Two boxes meet on the coarser level of theirs: each side is put on its own level and on the coarser
ones of the other side's boxes in its image, and a pair counts in the cell of the top left corner of its overlap. Work is bounded
by boxes times levels plus the pairs that share a small neighbourhood; there is no fixed extent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of the finest cells.
FINEST = 8.0


def box_level(w: Column, h: Column) -> Column:
    """The level of a box; 0 up to the finest cells."""
    side = F.greatest(w, h, F.lit(FINEST))
    return F.least(F.ceil(F.log2(side / FINEST)), F.lit(50)).cast("int")


def _cell(v: Column, side: str) -> Column:
    return F.floor(v / F.col(side)).cast("long")


def touching(a: str, b: str) -> Column:
    """Whether boxes with columns a+x, a+y, a+w, a+h and those of b overlap."""
    c = lambda p, n: F.col(f"{p}{n}")
    along = lambda n, s: (c(a, n) < c(b, n) + c(b, s)) & (c(b, n) < c(a, n) + c(a, s))
    return along("x", "w") & along("y", "h")


def _on_levels(df: DataFrame, image: str, p: str, levels: DataFrame, others: str, above: int | None) -> DataFrame:
    """A row per cell that a box touches on the levels where it may meet a box of the other side.

    These are the coarser levels that the other side's boxes lie on, ``above`` of them at most, and its own one if the other side has
    a box on it or below.
    """
    own = df.withColumn(f"_{p}level", box_level(F.col(f"{p}w"), F.col(f"{p}h")))
    at = own.join(levels.select(F.col("_at_image").alias(image), others), image)
    mine = F.col(f"_{p}level")
    near = lambda x: F.abs(x - mine) <= (99 if above is None else above)
    there = F.array_union(
        F.filter(others, lambda x: (x >= mine) & near(x)),
        F.when(F.exists(others, lambda x: (x <= mine) & near(x)), F.array(mine)).otherwise(F.array().cast("array<int>")),
    )
    at = at.withColumn(f"_{p}at", F.explode(there)).drop(others)
    at = at.withColumn(f"_{p}side", F.lit(FINEST) * F.pow(F.lit(2.0), F.col(f"_{p}at")))
    start, end = lambda n: _cell(F.col(f"{p}{n}"), f"_{p}side"), lambda n, s: _cell(F.col(f"{p}{n}") + F.col(f"{p}{s}"), f"_{p}side")
    across = F.sequence(start("x"), F.greatest(start("x"), end("x", "w")))
    down = F.sequence(start("y"), F.greatest(start("y"), end("y", "h")))
    return at.withColumn(f"_{p}cx", F.explode(across)).withColumn(f"_{p}cy", F.explode(down))


def overlap_join(left: DataFrame, right: DataFrame, l: str, r: str, image: str = "image_id", other: str = "_image", on: Column | None = None, min_iou: float = 0.0) -> DataFrame:
    """Pairs of overlapping boxes of an image; the sides' boxes are columns l+x.. and r+x.., their images ``image`` and ``other``.

    With ``min_iou`` pairs below it may be left out: IoU is at most the ratio of widths and of heights, and so of the longer
    sides, which bounds how many levels apart two boxes are; and along each axis boxes must share as large a part of their union.
    """
    level = lambda df, i, p, n: df.select(F.col(i).alias("_at_image"), box_level(F.col(f"{p}w"), F.col(f"{p}h")).alias(n))
    both = level(left, image, l, "_ll").unionByName(level(right, other, r, "_rl"), allowMissingColumns=True)
    levels = both.groupBy("_at_image").agg(F.sort_array(F.collect_set("_ll")).alias("_lefts"), F.sort_array(F.collect_set("_rl")).alias("_rights"))
    # a hair below the bound, so that no rounding loses a pair
    least = min_iou * (1 - 1e-9)
    above = math.ceil(-math.log2(least)) if least > 0 else None
    a, b = _on_levels(left, image, l, levels, "_rights", above), _on_levels(right, other, r, levels, "_lefts", above)
    c = F.col
    meet = (c(image) == c(other)) & (c(f"_{l}at") == c(f"_{r}at")) & (c(f"_{l}cx") == c(f"_{r}cx")) & (c(f"_{l}cy") == c(f"_{r}cy"))
    own = F.greatest(f"_{l}level", f"_{r}level") == c(f"_{l}at")
    corner = (_cell(F.greatest(f"{l}x", f"{r}x"), f"_{l}side") == c(f"_{l}cx")) & (_cell(F.greatest(f"{l}y", f"{r}y"), f"_{l}side") == c(f"_{l}cy"))
    condition = meet & own & touching(l, r)
    if least > 0:
        high = lambda p, n, s: c(f"{p}{n}") + c(f"{p}{s}")
        shared = lambda n, s: F.least(high(l, n, s), high(r, n, s)) - F.greatest(f"{l}{n}", f"{r}{n}")
        whole = lambda n, s: F.greatest(high(l, n, s), high(r, n, s)) - F.least(f"{l}{n}", f"{r}{n}")
        condition = condition & (shared("x", "w") >= least * whole("x", "w")) & (shared("y", "h") >= least * whole("y", "h"))
    condition = condition & corner
    marks = [f"_{p}{n}" for p in (l, r) for n in ("level", "at", "side", "cx", "cy")]
    # dealt by cell even where a side is small in bytes, as the work lies in the pairs
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (x.repartition(parts, i, f"_{p}at", f"_{p}cx", f"_{p}cy") for x, i, p in ((a, image, l), (b, other, r)))
    return a.join(b, condition & on if on is not None else condition, "inner").drop(*marks)
