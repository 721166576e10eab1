"""Spatial matching of objects and detections.

Everything joins on ``image_id`` first, so one shuffle by image serves pairs,
greedy matches, best candidates and false positives. Images with very many boxes
are found by a count and take another way: their boxes meet on a grid of several levels,
and their greedy match folds connected parts of the pairs instead of one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise import constants as K
from boxwise.functions.geometry import iou
from boxwise.functions.labels import first_true
from boxwise.operators.grid import overlap_join, touching
from boxwise.operators.parts import connected
from boxwise.session import checkpoint, materialize

# An image above this many boxes on either side is treated as hot.
HOT_BOXES = 500
# Pairs of one class of a hot image, or of a connected part of them, that one task goes through; larger parts go by rounds.
FOLD_PAIRS = 20_000


def hot_images(objects: DataFrame, dets: DataFrame, limit: int = HOT_BOXES) -> DataFrame | None:
    """Ids of images with more than ``limit`` objects or detections; None when there are none."""
    counts = None
    for side in (objects, dets):
        big = side.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        counts = big if counts is None else counts.unionByName(big)
    hot = counts.select("image_id").distinct()
    return None if hot.isEmpty() else checkpoint(hot)


def _box_join(o: DataFrame, d: DataFrame, same_class: bool, hot: DataFrame | None, how: str, min_iou: float = 0.0) -> DataFrame:
    """Boxes that touch; the caller sets ``min_iou`` too, so pairs of hot images below it needn't meet nor be written."""
    same = F.col("gt_category_id") == F.col("det_category_id") if same_class else None
    d = d.withColumnRenamed("image_id", "_image")
    near = (F.col("image_id") == F.col("_image")) & touching("g", "d")
    near = near & same if same_class else near
    if hot is None:
        return o.join(d, near, how).drop("_image")
    # a few images are hot; only their ids are sent to all tasks, and only below a count of them
    ids = F.broadcast(hot) if hot.limit(100_001).count() <= 100_000 else hot
    d_ids = ids.withColumnRenamed("image_id", "_image")
    cold = o.join(ids, "image_id", "left_anti").join(d.join(d_ids, "_image", "left_anti"), near, how)
    # written, so that later conditions aren't drawn into the join and computed for every candidate
    found = overlap_join(o.join(ids, "image_id", "left_semi"), d.join(d_ids, "_image", "left_semi"), "g", "d", on=same, min_iou=min_iou)
    found = materialize(found if min_iou <= 0 else with_measure(found, "_measured", _pair_iou() >= min_iou).where("_measured").drop("_measured"))
    if how == "left":
        lonely = (
            o.join(ids, "image_id", "left_semi")
            .join(found.select("image_id", "annotation_id").distinct(), ["image_id", "annotation_id"], "left_anti")
        )
        found = found.unionByName(lonely, allowMissingColumns=True)
    return cold.unionByName(found).drop("_image")


def _object_side(objects: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return objects.select(
        "image_id",
        "annotation_id",
        F.col("category_id").alias("gt_category_id"),
        *[F.col(c).alias(f"g{c}") for c in "xywh"],
        *(extra or []),
    )


def _det_side(dets: DataFrame) -> DataFrame:
    return dets.select(
        "image_id",
        "prediction_index",
        F.col("category_id").alias("det_category_id"),
        "score",
        *[F.col(c).alias(f"d{c}") for c in "xywh"],
    )


def _pair_iou() -> Column:
    return iou(*[F.col(f"g{c}") for c in "xywh"], *[F.col(f"d{c}") for c in "xywh"])


def with_measure(pairs: DataFrame, name: str, measure: Column) -> DataFrame:
    """``pairs`` with a measure that later filters can use.

    A filter on a plain column is drawn into the join as its first condition: the measure is then computed for every
    candidate, in generated code too large to be compiled. Filters don't pass a generator, so only boxes that touch are measured.
    """
    return pairs.withColumn(name, F.explode(F.array(measure)))


def iou_pairs(
    objects: DataFrame,
    dets: DataFrame,
    min_iou: float = 0.0,
    same_class: bool = False,
    hot: DataFrame | None | str = "check",
    extra: list[str] | None = None,
) -> DataFrame:
    """Object-detection pairs of an image that overlap, with IoU > 0 and >= ``min_iou``."""
    if isinstance(hot, str):
        hot = hot_images(objects, dets)
    pairs = with_measure(_box_join(_object_side(objects, extra), _det_side(dets), same_class, hot, "inner", min_iou), "iou", _pair_iou())
    pairs = pairs.select("image_id", "annotation_id", "gt_category_id", "prediction_index", "det_category_id", "score", "iou", *(extra or []))
    return pairs.where((F.col("iou") > 0) & (F.col("iou") >= min_iou))


def _fold(pairs: DataFrame, tie: Column, within: list[str] | None = None) -> DataFrame:
    """Serial greedy choice inside each (image, class), or the part of it named by ``within``, as one fold over its sorted pairs.

    Pairs are sorted by detection priority, then by that detection's preference, so
    the first pair whose two ends are both free is the greedy choice.
    """
    item = F.struct(
        (-F.col("score")).alias("neg_score"),
        F.col("prediction_index"),
        (-F.col("iou")).alias("neg_iou"),
        tie.alias("tie"),
        F.col("annotation_id"),
    )
    groups = pairs.groupBy("image_id", F.col("gt_category_id").alias("category_id"), *(within or [])).agg(
        F.sort_array(F.collect_list(item)).alias("pairs")
    )
    empty = F.filter(F.col("pairs"), lambda _: F.lit(False))

    def step(taken: Column, p: Column) -> Column:
        clash = F.exists(
            taken,
            lambda t: (t["annotation_id"] == p["annotation_id"])
            | (t["prediction_index"] == p["prediction_index"]),
        )
        return F.when(clash, taken).otherwise(F.array_append(taken, p))

    chosen = F.when(F.size("pairs") == 1, F.col("pairs")).otherwise(
        F.aggregate(F.col("pairs"), empty, step)
    )
    return groups.select("image_id", "category_id", F.explode(chosen).alias("m")).select(
        "image_id",
        "category_id",
        "m.annotation_id",
        "m.prediction_index",
        (-F.col("m.neg_iou")).alias("iou"),
        (-F.col("m.neg_score")).alias("score"),
    )


def _rounds(pairs: DataFrame, tie: Column) -> DataFrame:
    """The same greedy choice for groups of any size, as rounds of proposals.

    All objects rank detections alike, so greedy order is the one stable matching:
    each detection proposes to its best object left, each object keeps its first
    proposer, and pairs that can no longer win are dropped until nothing changes.
    """
    alive = checkpoint(
        pairs.select(
            "image_id",
            F.col("gt_category_id").alias("category_id"),
            F.struct((-F.col("score")).alias("s"), F.col("prediction_index").alias("p")).alias("det"),
            F.struct((-F.col("iou")).alias("i"), tie.alias("t"), F.col("annotation_id").alias("a")).alias("obj"),
        )
    )
    while True:
        proposals = alive.groupBy("image_id", "category_id", "det").agg(F.min("obj").alias("obj"))
        held = proposals.groupBy("image_id", "category_id", F.col("obj.a").alias("annotation_id")).agg(
            F.min("det").alias("det"), F.count("*").alias("n")
        )
        if held.where(F.col("n") > 1).isEmpty():
            # One proposer per object: every detection sits on its best object left.
            return proposals.select(
                "image_id",
                "category_id",
                F.col("obj.a").alias("annotation_id"),
                F.col("det.p").alias("prediction_index"),
                (-F.col("obj.i")).alias("iou"),
                (-F.col("det.s")).alias("score"),
            )
        keep = held.select("image_id", "category_id", F.col("annotation_id").alias("_a"), F.col("det").alias("_held"))
        alive = checkpoint(
            alive.withColumn("_a", F.col("obj.a"))
            .join(keep, ["image_id", "category_id", "_a"], "left")
            .where(F.col("_held").isNull() | (F.col("det") <= F.col("_held")))
            .drop("_a", "_held")
        )


def greedy_from_pairs(pairs: DataFrame, hot: DataFrame | None, tie: str = "first") -> DataFrame:
    """Greedy one-to-one match of same-class pairs; equal IoU goes to the first or last object."""
    order = F.col("annotation_id") if tie == "first" else -F.col("annotation_id")
    if hot is None:
        return _fold(pairs, order)
    cold = _fold(pairs.join(hot, "image_id", "left_anti"), order)
    return cold.unionByName(_by_parts(pairs.join(hot, "image_id", "left_semi"), order))


def _serial(pairs: DataFrame, tie: Column, within: list[str] | None = None) -> DataFrame:
    """The choice of ``_fold`` for groups of many pairs: sorted rows pass by once, and the two ends that are taken are held as sets.

    The fold looks at all that is taken for each pair, so its work grows with the square of a group; this one's doesn't.
    """
    keys = ["image_id", "gt_category_id", *(within or [])]
    own = ["annotation_id", "prediction_index", "iou", "score"]
    ranked = pairs.select(*keys, *own, (-F.col("score")).alias("_s"), (-F.col("iou")).alias("_i"), tie.alias("_t"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = ranked.repartition(parts, *keys).sortWithinPartitions(*keys, "_s", "prediction_index", "_i", "_t", "annotation_id").drop("_s", "_i", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, objects, dets = None, set(), set()
        for b in batches:
            rows = []
            for i, (a, p, *key) in enumerate(zip(*(b.column(c).to_pylist() for c in ("annotation_id", "prediction_index", *keys)))):
                if key != now:
                    now, objects, dets = key, set(), set()
                if a not in objects and p not in dets:
                    objects.add(a)
                    dets.add(p)
                    rows.append(i)
            yield b.take(pa.array(rows, pa.int64()))

    chosen = ranked.mapInArrow(run, ranked.schema)
    return chosen.select("image_id", F.col("gt_category_id").alias("category_id"), *own)


def _by_parts(pairs: DataFrame, order: Column, most: int | None = None) -> DataFrame:
    """Greedy match of dense images: groups of at most ``most`` pairs are gone through in order.

    A choice never crosses a connected part of the pairs, so larger groups are cut into these and each part is gone through alone.
    The rare part of more than ``most`` pairs (a pile of like boxes) goes by rounds.
    """
    most = FOLD_PAIRS if most is None else most
    keys = ["image_id", "gt_category_id"]
    pairs = materialize(pairs)
    above = lambda df, by: materialize(df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n"))
    wide = above(pairs, keys)
    if wide.isEmpty():
        return _serial(pairs, order)
    out, pairs = _serial(pairs.join(wide, keys, "left_anti"), order), pairs.join(wide, keys, "left_semi")
    edges = pairs.select(*keys, F.struct(F.lit(0).alias("side"), F.col("annotation_id").alias("id")).alias("a"), F.struct(F.lit(1).alias("side"), F.col("prediction_index").alias("id")).alias("b"))
    named = connected(edges, keys).where("node.side = 0").select(*keys, F.col("node.id").alias("annotation_id"), F.col("part.id").alias("_part"))
    placed = materialize(pairs.join(named, [*keys, "annotation_id"]))
    group = [*keys, "_part"]
    large = above(placed, group)
    if large.isEmpty():
        return out.unionByName(_serial(placed, order, ["_part"]))
    out = out.unionByName(_serial(placed.join(large, group, "left_anti"), order, ["_part"]))
    return out.unionByName(_rounds(placed.join(large, group, "left_semi").drop("_part"), order))


def greedy_match(
    objects: DataFrame,
    dets: DataFrame,
    min_iou: float = K.MATCH_IOU,
    tie: str = "first",
    hot: DataFrame | None | str = "check",
) -> DataFrame:
    """One-to-one match in (image, class): by score, each detection takes its best free object.

    Pairs below ``min_iou`` are dropped before the choice; this is exact, as a free
    object reaches the threshold if and only if the best free one does.
    """
    if isinstance(hot, str):
        hot = hot_images(objects, dets)
    return greedy_from_pairs(iou_pairs(objects, dets, min_iou, True, hot), hot, tie)


def best_candidates(
    objects: DataFrame,
    dets: DataFrame,
    threshold: float,
    hot: DataFrame | None | str = "check",
    keep: list[str] | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Best detection per object: same class, same class operating, other class operating.

    IoU ties go to the first prediction. Objects that meet nothing stay, with nulls and IoU 0.
    ``pairs`` may hand in the overlapping pairs of all detections.
    """
    if isinstance(hot, str):
        hot = hot_images(objects, dets)
    keep = keep or []
    if pairs is None:
        pairs = iou_pairs(objects, dets, 0.0, False, hot)
    cand = F.struct(
        F.col("iou"),
        (-F.col("prediction_index")).alias("p"),
        F.col("score").alias("s"),
        F.col("det_category_id").alias("c"),
    )
    same = F.col("gt_category_id") == F.col("det_category_id")
    operating = F.col("score") >= threshold
    # only pairs are sorted to find the best ones; the rows of objects, which are wider, meet one row each
    best = pairs.where(F.col("iou") > 0).groupBy("image_id", "annotation_id").agg(
        F.max(F.when(same, cand)).alias("sa"),
        F.max(F.when(same & operating, cand)).alias("so"),
        F.max(F.when(~same & operating, cand)).alias("wr"),
    )
    best = _object_side(objects, keep).join(best, ["image_id", "annotation_id"], "left")

    def spread(col: str, name: str) -> list[Column]:
        return [
            (-F.col(f"{col}.p")).alias(f"{name}_prediction_index"),
            F.coalesce(F.col(f"{col}.iou"), F.lit(0.0)).alias(f"{name}_iou"),
            F.col(f"{col}.s").alias(f"{name}_score"),
        ]

    return best.select(
        "image_id",
        "annotation_id",
        F.col("gt_category_id").alias("category_id"),
        *keep,
        *spread("sa", "best_same_all"),
        *spread("so", "best_same_op"),
        *spread("wr", "best_wrong"),
        F.col("wr.c").alias("best_wrong_category_id"),
    )


def status_label(threshold: float, variant: str, match_iou: float, loc_iou: float, prefix: str = "") -> Column:
    """Status cascade over matched and best-candidate columns, whose names may have a prefix."""
    c = lambda name: F.col(prefix + name)
    same_op, same_all, wrong = c("best_same_op_iou"), c("best_same_all_iou"), c("best_wrong_iou")
    has = lambda name: c(f"{name}_prediction_index").isNotNull()
    detected = (c("matched_prediction_index").isNotNull(), "detected")
    weak = (
        has("best_same_all") & (same_all >= match_iou) & (c("best_same_all_score") < threshold),
        "low_confidence_candidate",
    )
    other = has("best_wrong") & (wrong >= match_iou)
    near = has("best_same_op") & (same_op >= loc_iou) & (same_op < match_iou)
    if variant == "calibrated":
        conflict = (has("best_same_op") & (same_op >= match_iou), "assignment_conflict_candidate")
        rules = [detected, conflict, weak, (other, "classification_error_candidate"), (near, "localization_error_candidate")]
    elif variant == "validation":
        rules = [detected, weak, (other, "class_confusion_candidate"), (near, "localization_candidate")]
    else:
        raise ValueError(variant)
    return first_true(rules, "missed")


def object_status(
    objects: DataFrame,
    dets: DataFrame,
    threshold: float,
    variant: str = "calibrated",
    match_iou: float = K.MATCH_IOU,
    loc_iou: float = K.LOCALIZATION_IOU,
    hot: DataFrame | None | str = "check",
    keep: list[str] | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """One row per object: match, best candidates and status.

    Match and candidates come from the same overlapping pairs: those handed in (``iou_pairs`` of all
    detections, which false positives can use too), or else one join that is stored.
    """
    if isinstance(hot, str):
        hot = hot_images(objects, dets)
    if pairs is None:
        pairs = materialize(iou_pairs(objects, dets, 0.0, False, hot))
    best = best_candidates(objects, dets, threshold, hot, keep, pairs)
    usable = (F.col("score") >= threshold) & (F.col("iou") >= match_iou) & (F.col("gt_category_id") == F.col("det_category_id"))
    # written, so that the match and the best candidates aren't dealt at the same time
    matched = materialize(greedy_from_pairs(pairs.where(usable), hot).select(
        "image_id",
        "annotation_id",
        F.col("prediction_index").alias("matched_prediction_index"),
        F.col("iou").alias("matched_iou"),
        F.col("score").alias("matched_score"),
    ))
    out = best.join(matched, ["image_id", "annotation_id"], "left")
    return out.withColumn("status", status_label(threshold, variant, match_iou, loc_iou)).withColumn(
        "detected", F.col("matched_prediction_index").isNotNull()
    )


def prediction_counts(status: DataFrame, dets: DataFrame, threshold: float) -> DataFrame:
    """Add the image's prediction counts to a status table (all, operating, same class operating)."""
    operating = F.col("score") >= threshold
    per_class = dets.groupBy("image_id", "category_id").agg(
        F.count("*").alias("n"), F.count_if(operating).alias("n_op")
    )
    per_image = per_class.groupBy("image_id").agg(
        F.sum("n").alias("num_predictions_image"),
        F.sum("n_op").alias("num_operating_predictions_image"),
    )
    same = per_class.select(
        "image_id", "category_id", F.col("n_op").alias("num_same_class_operating_predictions")
    )
    counts = ["num_predictions_image", "num_operating_predictions_image", "num_same_class_operating_predictions"]
    return status.join(per_image, "image_id", "left").join(same, ["image_id", "category_id"], "left").na.fill(0, counts)


def false_positives(
    objects: DataFrame,
    dets: DataFrame,
    threshold: float,
    variant: str = "calibrated",
    match_iou: float = K.MATCH_IOU,
    loc_iou: float = K.LOCALIZATION_IOU,
    hot: DataFrame | None | str = "check",
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Unmatched operating detections with a cause from the best-overlapping object of any class.

    IoU ties go to the lowest annotation id; without overlap the best object is null. ``pairs`` as for
    ``object_status``. A detection is known by image and index.
    """
    if isinstance(hot, str):
        hot = hot_images(objects, dets)
    operating = dets.where(F.col("score") >= threshold)
    if pairs is None:
        pairs = materialize(iou_pairs(objects, operating, 0.0, False, hot))
    pairs = pairs.where(F.col("score") >= threshold)
    own = ["image_id", "prediction_index"]
    matched = greedy_from_pairs(
        pairs.where((F.col("iou") >= match_iou) & (F.col("gt_category_id") == F.col("det_category_id"))), hot
    )
    best = pairs.groupBy(*own).agg(
        F.max(F.struct("iou", (-F.col("annotation_id")).alias("a"), "gt_category_id")).alias("b")
    )
    free = operating.join(matched.select(*own), own, "left_anti")
    out = free.join(best, own, "left").select(
        *operating.columns,
        (-F.col("b.a")).alias("best_gt_annotation_id"),
        F.col("b.gt_category_id").alias("best_gt_category_id"),
        F.coalesce(F.col("b.iou"), F.lit(0.0)).alias("best_gt_iou"),
    )
    v, same = F.col("best_gt_iou"), F.col("category_id") == F.col("best_gt_category_id")
    if variant == "calibrated":
        label = first_true(
            [
                ((v >= match_iou) & same, "duplicate_candidate"),
                (v >= match_iou, "classification_candidate"),
                ((v >= loc_iou) & same, "localization_candidate"),
                (v >= loc_iou, "overlap_candidate"),
            ],
            "background_candidate",
        )
    elif variant == "validation":
        label = first_true(
            [
                ((v >= match_iou) & ~same, "class_confusion_fp"),
                (v >= match_iou, "duplicate_fp"),
                (v >= loc_iou, "localization_fp"),
            ],
            "background_or_unmatched",
        )
    else:
        raise ValueError(variant)
    return out.withColumn("fp_type", label)


def image_summary(
    images: DataFrame, status: DataFrame, false_pos: DataFrame, dets: DataFrame, threshold: float
) -> DataFrame:
    """Per image: objects, detections, statuses and false positives; empty images stay as zeros."""
    statuses = [
        "missed",
        "low_confidence_candidate",
        "assignment_conflict_candidate",
        "classification_error_candidate",
        "localization_error_candidate",
    ]
    per_object = status.groupBy("image_id").agg(
        F.count("*").alias("num_gt"),
        F.count_if("detected").alias("num_detected_gt"),
        *[F.count_if(F.col("status") == s).alias(f"num_{s}") for s in statuses],
    )
    per_det = dets.groupBy("image_id").agg(
        F.count("*").alias("num_predictions"),
        F.count_if(F.col("score") >= threshold).alias("num_operating_predictions"),
    )
    per_fp = false_pos.groupBy("image_id").agg(F.count("*").alias("num_false_positives"))
    out = images.select("image_id")
    for part in (per_object, per_det, per_fp):
        out = out.join(part, "image_id", "left")
    out = out.na.fill(0)
    # Accounting identity of the match: matched + false positives = operating detections.
    return out.withColumn(
        "balanced",
        F.col("num_detected_gt") + F.col("num_false_positives") == F.col("num_operating_predictions"),
    )


def join_models(status_a: DataFrame, status_b: DataFrame, shared: list[str]) -> DataFrame:
    """Objects side by side under two models; ``aligned`` is false where shared fields differ."""
    own = lambda df: [c for c in df.columns if c not in shared and c != "annotation_id"]
    a = status_a.select("annotation_id", *[F.col(c).alias(f"_a_{c}") for c in shared], *[F.col(c).alias(f"a_{c}") for c in own(status_a)])
    b = status_b.select("annotation_id", *[F.col(c).alias(f"_b_{c}") for c in shared], *[F.col(c).alias(f"b_{c}") for c in own(status_b)])
    both = a.join(b, "annotation_id", "full_outer")
    aligned = F.lit(True)
    for c in shared:
        aligned = aligned & F.coalesce(F.col(f"_a_{c}") == F.col(f"_b_{c}"), F.lit(False))
    return both.select(
        "annotation_id",
        *[F.coalesce(F.col(f"_a_{c}"), F.col(f"_b_{c}")).alias(c) for c in shared],
        *[c for c in both.columns if c.startswith(("a_", "b_"))],
        aligned.alias("aligned"),
    )


def detects_target(
    targets: DataFrame, dets: DataFrame, min_score: float = 0.25, min_iou: float = 0.5,
    hot: DataFrame | None | str = "check",
) -> DataFrame:
    """Flag per target: some same-class detection with enough score and IoU exists."""
    strong = dets.where(F.col("score") >= min_score)
    hits = iou_pairs(targets, strong, min_iou, True, hot).select("annotation_id").distinct()
    return targets.join(hits.withColumn("_hit", F.lit(True)), "annotation_id", "left").select(
        *targets.columns, F.coalesce(F.col("_hit"), F.lit(False)).alias("detected")
    )


def topk_detections(
    dets: DataFrame, k: int = K.MAX_DETECTIONS, keys: tuple[str, ...] = ("image_id",), floor: float = K.SCORE_FLOOR
) -> DataFrame:
    """Best k detections per key by score, ties by prediction index; floor and size checked first."""
    from pyspark.sql.window import Window as W

    order = W.partitionBy(*keys).orderBy(F.desc("score"), "prediction_index")
    usable = dets.where((F.col("score") >= floor) & (F.col("w") > 0) & (F.col("h") > 0))
    return usable.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def multi_threshold_match(
    objects: DataFrame,
    dets: DataFrame,
    thresholds=K.IOU_THRESHOLDS,
    tie: str = "first",
    max_dets: int = K.MAX_DETECTIONS,
    hot: DataFrame | None | str = "check",
) -> DataFrame:
    """Greedy matches at several IoU thresholds; pairs are shuffled once, folds run per threshold."""
    cut = topk_detections(dets, max_dets, ("image_id", "category_id"))
    if isinstance(hot, str):
        hot = hot_images(objects, cut)
    low = min(thresholds)
    pairs = best_k_per_detection(iou_pairs(objects, cut, low, True, hot), max_dets, tie)
    order = F.col("annotation_id") if tie == "first" else -F.col("annotation_id")
    item = F.struct(
        (-F.col("score")).alias("s"),
        F.col("prediction_index").alias("p"),
        (-F.col("iou")).alias("i"),
        order.alias("t"),
        F.col("annotation_id").alias("a"),
    )
    groups = pairs.groupBy("image_id", F.col("gt_category_id").alias("category_id")).agg(
        F.sort_array(F.collect_list(item)).alias("pairs")
    )
    table = F.array(*[F.lit(float(t)) for t in thresholds])

    def fold(t: Column) -> Column:
        kept = F.filter(F.col("pairs"), lambda p: -p["i"] >= t)
        empty = F.filter(F.col("pairs"), lambda _: F.lit(False))

        def step(taken: Column, p: Column) -> Column:
            clash = F.exists(taken, lambda q: (q["a"] == p["a"]) | (q["p"] == p["p"]))
            return F.when(clash, taken).otherwise(F.array_append(taken, p))

        return F.transform(
            F.aggregate(kept, empty, step),
            lambda m: F.struct(t.alias("threshold"), m["a"].alias("annotation_id"), m["p"].alias("prediction_index"), (-m["i"]).alias("iou")),
        )

    return groups.select(
        "image_id", "category_id", F.inline(F.flatten(F.transform(table, fold)))
    )


def best_k_per_detection(pairs: DataFrame, k: int, tie: str = "first") -> DataFrame:
    """Keep each detection's k best pairs.

    Exact for a greedy match with at most k detections per group: a detection loses
    at most k-1 of its objects to earlier ones, so one of its best k is always free.
    """
    from pyspark.sql.window import Window as W

    order = F.asc("annotation_id") if tie == "first" else F.desc("annotation_id")
    w = W.partitionBy("image_id", "prediction_index").orderBy(F.desc("iou"), order)
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
