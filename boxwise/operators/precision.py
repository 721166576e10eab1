"""Average precision and recall of the public box-detection protocol.

Crowd objects follow its rules: they are ignored ones, their overlap is measured by the
detection's own area, and any number of detections may match one.

One fold per (image, class) matches at ten IoU thresholds and four area ranges and
returns two 40-bit masks per detection, so the cache has one narrow row per
detection. Forty pairs of running sums then share one sort per (group, class,
score bucket); the 101-point interpolation reduces to at most 101 rows per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise import constants as K
from boxwise.functions.geometry import cover
from boxwise.operators.matching import _box_join, _object_side, _pair_iou, hot_images, iou_pairs, topk_detections, with_measure
from boxwise.operators.ranking import order_bucket, running_sums
from boxwise.operators.risk import MACRO_SUBSETS
from boxwise.operators.weighted import evaluate_columns, placed, weight_table
from boxwise.session import materialize

THRESHOLDS = len(K.IOU_THRESHOLDS)
CELLS = THRESHOLDS * len(K.AREA_RANGES)
#: Conditions that are evaluated together.
CONDITIONS = 64
_AREA_BOUNDS = ((0.0, 1e10), (0.0, 1024.0), (1024.0, 9216.0), (9216.0, 1e10))
_EPS = 2.220446049250313e-16


def _crowd(objects: DataFrame) -> Column:
    """Whether an object is a crowd; a missing or null mark says no."""
    return F.coalesce(F.col("iscrowd") == 1, F.lit(False)) if "iscrowd" in objects.columns else F.lit(False)


def _pair_cover() -> Column:
    return cover(*[F.col(f"g{c}") for c in "xywh"], *[F.col(f"d{c}") for c in "xywh"])


def _outside_mask(area: Column, crowd: Column | None = None) -> Column:
    """Bit k is set when the box does not count in area range k."""
    mask = F.lit(0)
    for k, (low, high) in enumerate(_AREA_BOUNDS):
        out = (area < low) | (area > high)
        out = out | crowd if crowd is not None else out
        mask = mask + F.when(out, F.lit(1 << k)).otherwise(F.lit(0))
    return mask


def _spread(area_mask: Column) -> Column:
    """Widen a 4-bit area mask to all thresholds of each area: a 40-bit mask."""
    wide = F.lit(0).cast("long")
    for k in range(len(_AREA_BOUNDS)):
        block = ((1 << THRESHOLDS) - 1) << (k * THRESHOLDS)
        wide = wide + F.when(F.shiftright(area_mask, k) % 2 == 1, F.lit(block)).otherwise(F.lit(0))
    return wide


def ranked_detections(dets: DataFrame, max_dets: int = K.MAX_DETECTIONS) -> DataFrame:
    """The best ``max_dets`` detections per (image, class) with their rank."""
    order = W.partitionBy("image_id", "category_id").orderBy(F.desc("score"), "prediction_index")
    return dets.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_dets)


def _masks(groups: DataFrame) -> DataFrame:
    """(image_id, prediction_index, tp, matched_ignored) bits from the pairs of each group.

    A pair whose detection and object meet nobody else matches at every threshold its
    IoU reaches (``n`` of them); a crowd object (``c``) is never taken. Contested pairs are folded once per distinct ``n``, as
    the thresholds between two of them see the same pairs, and once for all areas when
    their objects lie in the same ranges.
    """
    areas = range(len(K.AREA_RANGES))
    contested = "exists(pairs, m -> (m.p = q.p AND m.a <> q.a) OR (m.a = q.a AND m.p <> q.p AND NOT q.c))"

    def bits(flag: int, mask: str, chosen: str) -> str:
        return " + ".join(
            f"IF((shiftright(q.g, {k}) & 1) = {flag} AND (shiftright({chosen}, {k}) & 1) = 1, shiftleft({mask}, {k * THRESHOLDS}), 0L)"
            for k in areas
        )

    def row(mask: str, chosen: str) -> str:
        return f"struct(q.p AS prediction_index, {bits(0, mask, chosen)} AS tp, {bits(1, mask, chosen)} AS matched_ignored)"

    below = lambda n: f"(shiftleft(1L, {n}) - 1)"
    split = groups.selectExpr(
        "image_id",
        f"transform(filter(pairs, q -> NOT {contested}), q -> {row(below('q.n'), '15')}) AS alone",
        f"filter(pairs, q -> {contested}) AS rest",
    ).selectExpr(
        "image_id",
        "alone",
        "rest",
        "array_sort(array_distinct(transform(rest, q -> q.n))) AS levels",
        """IF(forall(rest, q -> q.g = get(rest, 0).g), array(struct(-1 AS k, 15 AS areas)),
           array(struct(0 AS k, 1 AS areas), struct(1 AS k, 2 AS areas), struct(2 AS k, 4 AS areas), struct(3 AS k, 8 AS areas))) AS variants""",
    )
    ordered = "array_sort(transform(rest, q -> struct(q.r, IF(v.k < 0, 0, shiftright(q.g, v.k) & 1) AS f, q.i, q.a, q.p, q.g, q.n, q.c)))"
    mask = f"({below('l')} - {below('IF(j = 0, 0, get(levels, j - 1))')})"
    chosen = """aggregate(filter(s, q -> q.n >= l), slice(s, 1, 0),
        (acc, q) -> IF(exists(acc, m -> (m.a = q.a AND NOT q.c) OR m.p = q.p), acc, array_append(acc, q)))"""
    fold = f"""flatten(transform(variants, v -> flatten(transform(array({ordered}), s ->
        flatten(transform(levels, (l, j) -> transform({chosen}, q -> {row(mask, 'v.areas')})))))))"""
    rows = split.selectExpr("image_id", f"inline(IF(size(rest) = 0, alone, concat(alone, {fold})))")
    return rows.groupBy("image_id", "prediction_index").agg(
        F.sum("tp").alias("tp"), F.sum("matched_ignored").alias("matched_ignored")
    )


def match_cache(
    objects: DataFrame,
    dets: DataFrame,
    max_dets: int = K.MAX_DETECTIONS,
    hot: DataFrame | None | str = "check",
) -> DataFrame:
    """One row per kept detection: rank, score and 40-bit masks ``tp`` and ``ignored``.

    Bit ``area * 10 + threshold``. A later object wins equal IoU, an object inside the
    area range wins over one outside. Objects flagged ``iscrowd`` are ignored ones that
    many detections may match, by the part of the detection that they cover.
    """
    # ranks, pairs and masks are written, so that what one step deals is gone before the next
    cut = materialize(ranked_detections(dets, max_dets))
    if isinstance(hot, str):
        hot = hot_images(objects, cut)
    gt = objects.withColumns({"g": _outside_mask(F.col("area"), _crowd(objects)), "c": _crowd(objects)})
    pairs = _box_join(_object_side(gt, ["g", "c"]), _with_rank(cut), True, hot, "inner")
    pairs = with_measure(pairs, "iou", F.when(F.col("c"), _pair_cover()).otherwise(_pair_iou())).where(F.col("iou") >= min(K.IOU_THRESHOLDS))
    # At most max_dets detections share a group, so a detection never needs more than
    # its max_dets best objects of each area class: the cut is exact.
    best = W.partitionBy("image_id", "prediction_index", "g").orderBy(F.desc("iou"), F.desc("annotation_id"))
    pairs = materialize(pairs.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= max_dets).select("image_id", "gt_category_id", "annotation_id", "prediction_index", "rank", "iou", "g", "c"))
    item = F.struct(
        F.col("rank").alias("r"),
        (-F.col("iou")).alias("i"),
        (-F.col("annotation_id")).alias("a"),
        F.col("prediction_index").alias("p"),
        F.col("g"),
        F.col("c"),
        F.expr(" + ".join(f"CAST(iou >= {t!r}D AS INT)" for t in K.IOU_THRESHOLDS)).alias("n"),
    )
    groups = pairs.groupBy("image_id", "gt_category_id").agg(F.collect_list(item).alias("pairs"))
    rows = cut.join(materialize(_masks(groups)), ["image_id", "prediction_index"], "left").na.fill(0, ["tp", "matched_ignored"])
    outside = _spread(_outside_mask(F.col("w") * F.col("h")))
    matched = F.col("tp").bitwiseOR(F.col("matched_ignored"))
    return rows.select(
        "image_id",
        "category_id",
        "prediction_index",
        "score",
        "rank",
        "tp",
        (F.col("matched_ignored").bitwiseOR(outside.bitwiseAND(F.bitwise_not(matched)))).alias("ignored"),
    )


def _with_rank(cut: DataFrame) -> DataFrame:
    return cut.select(
        "image_id",
        "prediction_index",
        F.col("category_id").alias("det_category_id"),
        "score",
        "rank",
        *[F.col(c).alias(f"d{c}") for c in "xywh"],
    )


def object_counts(objects: DataFrame) -> DataFrame:
    """Counted objects per (image, class) and area range: g0..g3."""
    mask = objects.select("image_id", "category_id", _outside_mask(F.col("area"), _crowd(objects)).alias("m"))
    return mask.groupBy("image_id", "category_id").agg(
        *[F.count_if(F.shiftright(F.col("m"), k) % 2 == 0).alias(f"g{k}") for k in range(4)]
    )


def _bit(mask: str, cell: int) -> str:
    return f"(shiftright({mask}, {cell}) & 1L)"


def evaluate_cells(cache: DataFrame, counts: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """AP and recalls per (by, class, area, threshold) cell that has objects.

    ``cache`` and ``counts`` carry the ``by`` columns, and an image weight if named.
    """
    keys = [*by, "category_id"]
    cell = [*keys, "area", "threshold"]
    w = weight or "1"
    areas = range(len(K.AREA_RANGES))
    gt = counts.groupBy(*keys).agg(*[F.expr(f"sum(g{k} * {w}) AS g{k}") for k in areas])
    gt = gt.selectExpr(
        *keys, "inline(array(" + ", ".join(f"struct({k} AS area, g{k} AS gt)" for k in areas) + "))"
    ).where("gt > 0")

    sums = {}
    for c in range(CELLS):
        sums[f"t{c}"] = f"{_bit('tp', c)} * {w}"
        sums[f"n{c}"] = f"(1L - {_bit('ignored', c)}) * {w}"
    # Cells differ only in their masks, so one sort serves all forty. Equal scores are
    # ordered by image inside a score bucket. Buckets can't be cut by image ids too, as one may hold
    # several scores.
    ordered = running_sums(
        cache,
        keys,
        ["score DESC", "image_id", "rank"],
        [f"-({order_bucket('score', 4096)})"],
        sums,
    )
    cells = ", ".join(
        f"struct({c // THRESHOLDS} AS area, {c % THRESHOLDS} AS threshold, {_bit('tp', c)} AS hit, t{c} AS t, n{c} AS n)"
        for c in range(CELLS)
    )
    hits = ordered.where("tp <> 0").selectExpr(*keys, f"inline(array({cells}))").where("hit = 1")
    points = hits.join(gt, [*keys, "area"]).selectExpr(
        *cell, "t / gt AS recall", f"t / (n + {_EPS}D) AS precision", "CAST(floor(t / gt * 100) AS INT) + 1 AS guess"
    )
    step = "least(100, CASE WHEN guess * 0.01D <= recall THEN guess WHEN (guess - 1) * 0.01D <= recall THEN guess - 1 ELSE guess - 2 END)"
    best = points.selectExpr(*cell, f"{step} AS k", "precision").groupBy(*cell, "k").agg(F.max("precision").alias("p"))
    # At most 101 rows per cell from here on.
    tail = W.partitionBy(*cell).orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    before = F.lag("k", 1, -1).over(W.partitionBy(*cell).orderBy("k"))
    area_under = (
        best.select(*cell, (F.max("p").over(tail) * (F.col("k") - before)).alias("a"))
        .groupBy(*cell)
        .agg((F.sum("a") / 101.0).alias("ap"))
    )
    found = [f"sum({sums[f't{c}']}) AS r100_{c}" for c in range(CELLS)]
    for m in (1, 10):
        found += [f"sum(CASE WHEN rank <= {m} THEN {sums[f't{c}']} END) AS r{m}_{c}" for c in range(THRESHOLDS)]
    recall_rows = ", ".join(
        f"struct({c // THRESHOLDS} AS area, {c % THRESHOLDS} AS threshold, r100_{c} AS t100, "
        + (f"r10_{c} AS t10, r1_{c} AS t1)" if c < THRESHOLDS else "CAST(NULL AS BIGINT) AS t10, CAST(NULL AS BIGINT) AS t1)")
        for c in range(CELLS)
    )
    totals = cache.groupBy(*keys).agg(*[F.expr(e) for e in found]).selectExpr(*keys, f"inline(array({recall_rows}))")
    grid = gt.selectExpr("*", f"explode(sequence(0, {THRESHOLDS - 1})) AS threshold")
    out = grid.join(totals, cell, "left").join(area_under, cell, "left").na.fill(0, ["t100", "t10", "t1", "ap"])
    return out.selectExpr(
        *cell,
        "gt",
        "ap",
        "t100 / gt AS recall100",
        "CASE WHEN area = 0 THEN t10 / gt END AS recall10",
        "CASE WHEN area = 0 THEN t1 / gt END AS recall1",
    )


def summarize(cells: DataFrame, by: list[str]) -> DataFrame:
    """The twelve summary metrics; a metric without any class that has objects is null."""
    area = lambda k: F.col("area") == k
    at = lambda t: F.col("threshold") == t
    metric = {
        "AP": F.avg(F.when(area(0), F.col("ap"))),
        "AP50": F.avg(F.when(area(0) & at(0), F.col("ap"))),
        "AP75": F.avg(F.when(area(0) & at(5), F.col("ap"))),
    }
    for k, name in enumerate(K.AREA_RANGES[1:], 1):
        metric[f"AP_{name}"] = F.avg(F.when(area(k), F.col("ap")))
    metric["AR1"] = F.avg("recall1")
    metric["AR10"] = F.avg("recall10")
    metric["AR100"] = F.avg(F.when(area(0), F.col("recall100")))
    for k, name in enumerate(K.AREA_RANGES[1:], 1):
        metric[f"AR_{name}"] = F.avg(F.when(area(k), F.col("recall100")))
    return cells.groupBy(*by).agg(*[m.alias(n) for n, m in metric.items()])


def coco_cells(objects: DataFrame, dets: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """AP and recalls per (class, area, threshold) cell; written once, it serves the metrics of the whole set and of each class."""
    cache = cache if cache is not None else materialize(match_cache(objects, dets))
    return evaluate_columns(materialize(placed(cache, [])), object_counts(objects), []).drop("column")


def coco_eval(objects: DataFrame, dets: DataFrame, cache: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """One row with AP, AP50, AP75, AP and AR by area, AR1, AR10, AR100."""
    return summarize(cells if cells is not None else coco_cells(objects, dets, cache), [])


def coco_eval_per_class(objects: DataFrame, dets: DataFrame, cache: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """AP, AP50, AP75, AR100 per class with object, detection and image counts."""
    cells = (cells if cells is not None else coco_cells(objects, dets, cache)).where(F.col("area") == 0)
    scored = summarize(cells, ["category_id"]).select("category_id", "AP", "AP50", "AP75", "AR100")

    def totals(df: DataFrame, name: str) -> DataFrame:
        per_image = df.groupBy("category_id", "image_id").agg(F.count("*").alias("n"))
        return per_image.groupBy("category_id").agg(
            F.sum("n").alias(f"{name}s"), F.count("*").alias(f"images_with_{name}")
        )

    counts = totals(objects, "object").join(totals(dets, "detection"), "category_id", "full_outer")
    return counts.join(scored, "category_id", "left").na.fill(
        0, ["objects", "detections", "images_with_object", "images_with_detection"]
    )


def coco_eval_by_condition(
    objects: DataFrame, dets: DataFrame, images: DataFrame, min_images: int = 100, cache: DataFrame | None = None
) -> DataFrame:
    """Metrics per attribute value, with delta and retention of AP against the whole set."""
    cache = cache if cache is not None else materialize(match_cache(objects, dets))
    overall = F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))
    dims = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("timeofday", "weather", "scene")]
    member = images.select("image_id", F.inline(F.array(overall, *dims)))
    by = ["dimension", "value"]
    sizes = materialize(member.groupBy(*by).agg(F.count("*").alias("images")))
    # attribute values are few; each is a column of weights, so one order of the detections serves them all
    numbered = materialize(sizes.select(*by).coalesce(1).withColumn("place", F.monotonically_increasing_id()))
    ordered, counts, cells = materialize(placed(cache, [])), materialize(object_counts(objects)), None
    for first in range(0, numbered.count(), CONDITIONS):
        own = numbered.where(F.col("place").between(first, first + CONDITIONS - 1)).withColumn("place", (F.col("place") - first).cast("int"))
        same = F.col("d").eqNullSafe(F.col("dimension")) & F.col("v").eqNullSafe(F.col("value"))
        named = member.join(F.broadcast(own.withColumnsRenamed({"dimension": "d", "value": "v"})), same).groupBy("image_id", "place").agg(F.count("*").alias("weight"))
        width = own.count()
        scored = evaluate_columns(ordered, counts, [], materialize(weight_table(named, "place", width)), width)
        part = scored.join(F.broadcast(own.withColumnRenamed("place", "column")), "column").drop("column")
        cells = part if cells is None else cells.unionByName(part)
    found = summarize(cells, by).withColumnsRenamed({"dimension": "d", "value": "v"})
    rows = sizes.join(found, (F.col("dimension") == F.col("d")) & F.col("value").eqNullSafe(F.col("v")), "left").drop("d", "v")
    base = rows.where(F.col("dimension") == "overall").select(F.col("AP").alias("overall_AP"), F.lit(0).alias("_one"))
    out = rows.withColumn("_one", F.lit(0)).join(F.broadcast(base), "_one", "left").drop("_one")
    primary = (F.col("images") >= min_images) & (F.col("value") != "undefined")
    return out.withColumns(
        {
            "role": F.when(F.col("dimension") == "overall", "overall").when(primary, "primary").otherwise("supplementary"),
            "delta_AP": F.col("AP") - F.col("overall_AP"),
            "retention_AP": F.when(F.col("overall_AP") > 0, F.col("AP") / F.col("overall_AP")),
        }
    )


def subset_recovery(members: DataFrame, objects: DataFrame, dets: DataFrame, tie: str = "first") -> DataFrame:
    """Recall of each failure subset: AR100 over thresholds and classes, micro recall at IoU 0.5.

    The match runs among the subset's own objects, as each subset is its own ground truth.
    """
    cut = topk_detections(dets, K.MAX_DETECTIONS, ("image_id", "category_id"))
    hot = hot_images(objects, cut)
    pairs = iou_pairs(objects, cut, min(K.IOU_THRESHOLDS), True, hot)
    sub = members.select("subset", "annotation_id")
    joined = pairs.join(sub, "annotation_id")
    order = F.col("annotation_id") if tie == "first" else -F.col("annotation_id")
    best = W.partitionBy("subset", "image_id", "prediction_index").orderBy(F.desc("iou"), order)
    joined = joined.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= K.MAX_DETECTIONS)
    item = F.struct(
        (-F.col("score")).alias("s"),
        F.col("prediction_index").alias("p"),
        (-F.col("iou")).alias("i"),
        order.alias("t"),
        F.col("annotation_id").alias("a"),
    )
    groups = joined.groupBy("subset", "image_id", F.col("gt_category_id").alias("category_id")).agg(
        F.sort_array(F.collect_list(item)).alias("pairs")
    )
    thresholds = ", ".join(repr(t) + "D" for t in K.IOU_THRESHOLDS)
    counts = F.expr(
        f"""transform(array({thresholds}), t -> size(aggregate(
          filter(pairs, q -> -q.i >= t), slice(pairs, 1, 0),
          (acc, q) -> IF(exists(acc, m -> m.a = q.a OR m.p = q.p), acc, array_append(acc, q)))))"""
    )
    found = groups.select("subset", "category_id", F.posexplode(counts).alias("threshold", "n"))
    found = found.groupBy("subset", "category_id", "threshold").agg(F.sum("n").alias("n"))
    gt = members.groupBy("subset", "category_id").agg(F.count("*").alias("gt"))
    grid = gt.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(THRESHOLDS - 1))))
    cells = grid.join(found, ["subset", "category_id", "threshold"], "left").na.fill(0, ["n"])
    per_class = cells.groupBy("subset", "category_id").agg(
        F.avg(F.col("n") / F.col("gt")).alias("r"),
        F.max("gt").alias("gt"),
        F.sum(F.when(F.col("threshold") == 0, F.col("n"))).alias("n50"),
    )
    return per_class.groupBy("subset").agg(
        F.sum("gt").alias("objects"),
        F.avg("r").alias("AR100"),
        (F.sum("n50") / F.sum("gt")).alias("recall50"),
    )


def macro_recovery(recovery: DataFrame, subsets=None) -> DataFrame:
    """Macro AR100 over the five macro subsets."""
    chosen = list(subsets or MACRO_SUBSETS)
    return recovery.where(F.col("subset").isin(*chosen)).agg(F.avg("AR100").alias("macro_AR100"), F.count("*").alias("subsets"))
