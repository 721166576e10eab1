"""Average precision under many image weights at once: bootstrap replicates, conditions, or plain ones.

The match cache is put into one order (keys, score, image, rank) by range, so a class, or a score that very many
detections share, is cut like anything else; a partition is a block. An image's weights are one array with a column per
replicate or condition. Three passes serve all forty cells of all columns: sums of every block; sums of all blocks
before it; points of the precision curve, of which a block keeps the best per recall level. Work on a block
is array arithmetic over its rows, and what it hands on does not grow with them.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.operators.ranking import attach
from boxwise.session import materialize

# tasks get these functions by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Detections of a block.
ROWS = 50_000
#: Blocks whose results are merged at once.
FAN = 64
AREAS, THRESHOLDS = 4, 10
CELLS = AREAS * THRESHOLDS
LEVELS = 101
EPS = 2.220446049250313e-16


def placed(cache: DataFrame, by: list[str], rows: int = ROWS) -> DataFrame:
    """The cache in one order, with place ``pos`` and the ``block`` of each row; write it before use."""
    keys = [*by, "category_id", "neg", "image_id", "rank"]
    slim = cache.select(*by, "category_id", (-F.col("score")).alias("neg"), "image_id", "rank", "tp", "ignored")
    parts = max(1, math.ceil(cache.count() / rows))
    ranged = slim.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return ranged.drop("neg").withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.shiftright("pos", 33).cast("int"))


def weight_table(weights: DataFrame, column: str, width: int, first: int = 0) -> DataFrame:
    """(image_id, weights): an array of small integers per image from rows (image_id, column, weight)."""
    pair = F.struct((F.col(column) - first).cast("int").alias("i"), F.col("weight").cast("smallint").alias("w"))
    found = weights.groupBy("image_id").agg(F.collect_list(pair).alias("m")).select("image_id", "m.i", "m.w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, weight = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "w"))
            row = np.repeat(np.arange(b.num_rows), b.column("i").value_lengths().to_numpy(zero_copy_only=False))
            inside = (place >= 0) & (place < width)
            dense = np.zeros((b.num_rows, width), np.int16)
            dense[row[inside], place[inside]] = weight[inside]
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()))], names=["image_id", "weights"])

    return found.mapInArrow(run, f"{_schema(found, ['image_id'])}, weights array<smallint>")


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """Weights of the rows, a column per row."""
    flat = table.column("weights").combine_chunks()
    flat = flat.values if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.values for c in flat.chunks])
    return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(-1, width).T.astype(np.int32))


def _long(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _bits(mask: np.ndarray) -> np.ndarray:
    return (mask[:, None] >> np.arange(CELLS)) & 1


def _keyed(table: pa.Table, keys: list[str], columns: dict[str, pa.Array]) -> pa.Table:
    """One row with the keys of a group and the given columns."""
    return pa.table({k: table.column(k).slice(0, 1) for k in keys} | columns)


def _one(values: np.ndarray) -> pa.Array:
    return pa.array([values.ravel()], pa.list_(pa.float64()))


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def block_sums(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, block, sums): weighted hits and counted detections per cell, and hits of rank 10 and 1 at most, of every block."""

    def run(t: pa.Table) -> pa.Table:
        w = _matrix(t, width).T.astype(np.float64)
        tp, rank = _bits(_long(t, "tp")), _long(t, "rank")
        early = tp[:, :THRESHOLDS]
        parts = [tp, 1 - _bits(_long(t, "ignored")), early * (rank <= 10)[:, None], early * (rank <= 1)[:, None]]
        return _keyed(t, [*keys, "block"], {"sums": _one(np.concatenate([p.T.astype(np.float64) @ w for p in parts]))})

    return rows.groupBy(*keys, "block").applyInArrow(run, f"{_schema(rows, [*keys, 'block'])}, sums array<double>")


def sums_before(sums: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``sums`` with the cell sums ``before`` each block of its keys; streams over the blocks in order."""
    names = sums.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for i in range(b.num_rows):
                key = tuple(b.column(k)[i].as_py() for k in range(len(keys)))
                if key != now:
                    now, total = key, np.zeros(2 * CELLS * width)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns), _one(total)], names=[*names, "before"])
                total = total + b.column(names.index("sums"))[i].values.to_numpy()[: 2 * CELLS * width]

    ordered = sums.repartition(*keys).sortWithinPartitions(*keys, "block")
    return ordered.mapInArrow(run, f"{_schema(sums, names)}, before array<double>")


def curve_points(w: np.ndarray, tp: np.ndarray, ignored: np.ndarray, before: np.ndarray, gt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, precision): the best precision of a block at each recall level that it reaches, by (cell, column, level)."""
    width = len(w)
    places, best = [], []
    known, counts = None, None  # of the last cell: neighbours often count the same detections
    for c in range(CELLS):
        hit = np.flatnonzero((tp >> c) & 1)
        have = np.flatnonzero(gt[c // THRESHOLDS] > 0)
        if not len(hit) or not len(have):
            continue
        own = w[have]
        t = np.cumsum(own[:, hit], axis=1) + before[0, c, have][:, None]
        counted = np.flatnonzero(((ignored >> c) & 1) == 0)
        if known is None or known[0] != c // THRESHOLDS or not np.array_equal(known[1], counted):
            known, counts = (c // THRESHOLDS, counted), np.zeros((len(have), len(counted) + 1), np.int64)
            np.cumsum(own[:, counted], axis=1, out=counts[:, 1:])
        n = counts[:, np.searchsorted(counted, hit, side="right")] + before[1, c, have][:, None]
        recall = t / gt[c // THRESHOLDS, have][:, None]
        up = np.floor(recall * 100) + 1
        level = np.where(up * 0.01 <= recall, up, np.where((up - 1) * 0.01 <= recall, up - 1, up - 2))
        place = ((c * width + have)[:, None] * LEVELS + np.minimum(level, 100).astype(np.int64)).ravel()
        # recall never falls along the rows, so equal levels lie side by side
        first = np.flatnonzero(np.diff(place, prepend=-1))
        places.append(place[first])
        best.append(np.maximum.reduceat((t / (n + EPS)).ravel(), first))
    none = np.zeros(0)
    return (np.concatenate(places), np.concatenate(best)) if places else (none.astype(np.int64), none)


def block_points(rows: DataFrame, sums: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, block, places, best, sums) of every block; ``sums`` has ``before`` and the objects ``gt`` too."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        value = lambda name: right.column(name)[0].values.to_numpy()
        places, best = curve_points(_matrix(left, width), _long(left, "tp"), _long(left, "ignored"), value("before").reshape(2, CELLS, width), value("gt").reshape(AREAS, width))
        return _keyed(left, [*keys, "block"], {"places": pa.array([places], pa.list_(pa.int64())), "best": _one(best), "sums": _one(value("sums"))})

    schema = f"{_schema(rows, [*keys, 'block'])}, places array<bigint>, best array<double>, sums array<double>"
    known = sums.select(*keys, "block", "sums", "before", "gt")
    slim = rows.select(*keys, "block", "pos", "tp", "ignored", "weights").join(known.select(*keys, "block"), [*keys, "block"], "left_semi")
    return slim.groupBy(*keys, "block").cogroup(known.groupBy(*keys, "block")).applyInArrow(run, schema)


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best precision by place, and sums, over the blocks of a table."""
    place = np.concatenate([r.values.to_numpy() for r in t.column("places")])
    best = np.concatenate([r.values.to_numpy() for r in t.column("best")])
    order = np.argsort(place, kind="stable")
    place, best = place[order], best[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    sums = np.sum([r.values.to_numpy() for r in t.column("sums")], axis=0)
    return place[first], np.maximum.reduceat(best, first) if len(first) else best, sums


def cells_of(points: DataFrame, gt: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, column, area, threshold, gt, ap, recall100, recall10, recall1) of all cells with objects."""
    top = points.agg(F.max("block").alias("top")).first().top or 0
    while top >= FAN:

        def merge(t: pa.Table) -> pa.Table:
            place, best, sums = _merged(t)
            block = pa.array([t.column("block")[0].as_py() // FAN], pa.int32())
            return _keyed(t, keys, {"block": block, "places": pa.array([place], pa.list_(pa.int64())), "best": _one(best), "sums": _one(sums)})

        points = materialize(points.groupBy(*keys, F.floor(F.col("block") / FAN).alias("up")).applyInArrow(merge, _schema(points, points.columns)))
        top //= FAN

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        objects = left.column("gt")[0].values.to_numpy().reshape(AREAS, width)
        curve, sums = np.zeros(CELLS * width * LEVELS), np.zeros((2 * CELLS + 2 * THRESHOLDS) * width)
        if right.num_rows:
            place, best, sums = _merged(right)
            curve[place] = best
        curve = curve.reshape(CELLS, width, LEVELS)
        ap = np.maximum.accumulate(curve[:, :, ::-1], axis=2).sum(axis=2) / float(LEVELS)
        sums = sums.reshape(-1, width)
        cell, column = np.nonzero(objects[np.arange(CELLS) // THRESHOLDS] > 0)
        area, count = cell // THRESHOLDS, objects[cell // THRESHOLDS, column]
        small = lambda start: pa.array(np.where(area == 0, sums[np.minimum(start + cell, len(sums) - 1), column] / count, 0), mask=area > 0)
        whole = {
            "column": pa.array(column, pa.int32()), "area": pa.array(area, pa.int32()), "threshold": pa.array(cell % THRESHOLDS, pa.int32()), "gt": pa.array(count, pa.int64()),
            "ap": pa.array(ap[cell, column]), "recall100": pa.array(sums[cell, column] / count), "recall10": small(2 * CELLS), "recall1": small(2 * CELLS + THRESHOLDS),
        }
        at = pa.array(np.zeros(len(cell), np.int64))
        return pa.table({k: left.column(k).take(at) for k in keys} | whole)

    schema = f"{_schema(gt, keys)}, column int, area int, threshold int, gt bigint, ap double, recall100 double, recall10 double, recall1 double"
    return gt.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInArrow(finish, schema)


def object_sums(counts: DataFrame, weights: DataFrame | None, width: int) -> DataFrame:
    """(category_id, gt): objects per area and column; counts are g0..g3 per (image, class)."""
    each = F.lit(1) if weights is None else F.col("w")
    rows = counts.select("category_id", "g0", "g1", "g2", "g3", F.lit(0).alias("i"), F.lit(1).alias("w")) if weights is None else counts.join(weights, "image_id").select("category_id", "g0", "g1", "g2", "g3", F.posexplode("weights").alias("i", "w")).filter("w > 0")
    total = rows.groupBy("category_id", "i").agg(*[F.sum(F.col(f"g{k}") * each).cast("double").alias(f"g{k}") for k in range(AREAS)])
    lists = total.groupBy("category_id").agg(F.map_from_entries(F.collect_list(F.struct("i", F.array(*[f"g{k}" for k in range(AREAS)])))).alias("m"))
    column = lambda k: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(F.col("m")[i], F.lit(k)), F.lit(0.0)))
    return lists.select("category_id", F.concat(*[column(k) for k in range(AREAS)]).alias("gt"))


def evaluate_columns(rows: DataFrame, counts: DataFrame, by: list[str], weights: DataFrame | None = None, width: int = 1) -> DataFrame:
    """AP and recalls per (by, class, column, area, threshold) cell that has objects in its column.

    ``rows`` are ``placed`` ones, written before; ``weights`` has (image_id, weights), without it all weights are 1. Every
    ``by`` value is judged on the same objects.
    """
    keys = [*by, "category_id"]
    full = rows.withColumn("weights", F.array(F.lit(1).cast("smallint"))) if weights is None else rows.join(weights, "image_id")
    gt = object_sums(counts, weights, width)
    if by:
        # a handful of models beside a row per class
        gt = attach(gt, rows.select(*by).distinct(), [])
    gt = materialize(gt.select(*keys, "gt"))
    sums = materialize(sums_before(block_sums(full, keys, width), keys, width).join(gt, keys))
    return cells_of(materialize(block_points(full, sums, keys, width)), gt, keys, width)
