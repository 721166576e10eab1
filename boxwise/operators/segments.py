"""Region evidence: segment detections matched to objects and graded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise import constants as K
from boxwise.functions.geometry import clipped_area, polygon_area
from boxwise.functions.labels import evidence_grade, failure_taxonomy, first_true
from boxwise.operators.matching import greedy_from_pairs, hot_images, iou_pairs
from boxwise.session import materialize

# Classes a segment model can give evidence for.
SEGMENT_CLASSES = (1, 3, 4, 5, 6, 7, 8, 9)


def polygon_support(df: DataFrame) -> DataFrame:
    """Add area, inside area, inside ratio and coverage of ``polygons`` against the box x, y, w, h.

    Polygons with under three points, an odd length or no area do not count.
    """
    usable = F.filter(
        F.coalesce("polygons", F.array().cast("array<array<double>>")),
        lambda p: (F.size(p) >= 6) & (F.size(p) % 2 == 0) & ~F.exists(p, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))),
    )
    x, y, w, h = (F.col(c) for c in "xywh")
    parts = F.filter(
        F.transform(
            usable,
            lambda p: F.struct(
                polygon_area(p).alias("area"),
                clipped_area(p, x, y, x + w, y + h).alias("inside"),
            ),
        ),
        lambda q: q["area"] > 0,
    )
    total = lambda f: F.aggregate(F.col("_parts"), F.lit(0.0), lambda acc, q: acc + q[f])
    v = df.withColumn("_parts", parts).withColumns(
        {"polygon_count": F.size("_parts"), "polygon_area": total("area"), "inside_area": total("inside")}
    )
    return v.drop("_parts").withColumns(
        {
            "inside_ratio": F.when(F.col("polygon_area") > 0, F.col("inside_area") / F.col("polygon_area")),
            "gt_coverage": F.when(w * h > 0, F.col("inside_area") / (w * h)),
        }
    )


def segment_evidence(
    objects: DataFrame,
    segs: DataFrame,
    min_score: float = 0.05,
    match_iou: float = K.MATCH_IOU,
    loc_iou: float = K.LOCALIZATION_IOU,
    min_inside: float = 0.5,
    hot: DataFrame | None | str = "check",
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Status, support, score and region measures of every object.

    Polygons are read only for matched detections: they are joined after the match. ``pairs`` may hand in the
    overlapping pairs of all objects and detections.
    """
    applicable = F.col("category_id").isin(*SEGMENT_CLASSES)
    usable = segs.where((F.col("score") >= min_score) & applicable)
    boxes = usable.drop("polygons")
    own = objects.where(applicable)
    if isinstance(hot, str):
        hot = hot_images(own, boxes)
    if pairs is None:
        pairs = materialize(iou_pairs(own, boxes, 0.0, True, hot))
    else:
        pairs = pairs.where((F.col("score") >= min_score) & F.col("gt_category_id").isin(*SEGMENT_CLASSES) & (F.col("gt_category_id") == F.col("det_category_id")))
    # match and region measures are written, so that what one step deals is gone before the next
    matched = materialize(greedy_from_pairs(pairs.where(F.col("iou") >= match_iou), hot).select(
        "image_id", "annotation_id", "prediction_index", F.col("score").alias("seg_score"), F.col("iou").alias("seg_bbox_iou")
    ))
    best = pairs.groupBy("image_id", "annotation_id").agg(F.max("iou").alias("best_same_class_iou"))
    box = own.select("image_id", "annotation_id", "x", "y", "w", "h")
    boxed = materialize(matched.join(box, ["image_id", "annotation_id"]))
    region = materialize(polygon_support(
        boxed.join(usable.select("image_id", "prediction_index", "polygons"), ["image_id", "prediction_index"])
    ).select("image_id", "annotation_id", "prediction_index", "seg_score", "seg_bbox_iou", "polygon_count", "polygon_area", "inside_area", "inside_ratio", "gt_coverage"))
    v = objects.select("annotation_id", "image_id", "category_id", applicable.alias("applicable"))
    v = v.join(region, ["image_id", "annotation_id"], "left").join(best, ["image_id", "annotation_id"], "left")
    hit = F.col("prediction_index").isNotNull()
    status = first_true(
        [
            (~F.col("applicable"), "not_applicable"),
            (hit & (F.col("inside_ratio") >= min_inside), "region_supported"),
            (hit, "bbox_matched_weak_region_overlap"),
            (F.col("best_same_class_iou") >= loc_iou, "localization_candidate"),
        ],
        "no_spatial_support",
    )
    v = v.withColumn("seg_status", status)
    v = v.withColumn("support", F.when(F.col("applicable"), F.col("seg_status") == "region_supported"))
    return v.withColumn("evidence", evidence_grade(F.col("applicable"), F.col("support"), F.col("seg_score")))


def with_taxonomy(wide: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add evidence columns, the final taxonomy and the earlier failure type to joined models."""
    e = evidence.select("annotation_id", "applicable", "support", "evidence")
    v = wide.join(e, "annotation_id")
    a, b = F.col("a_detected"), F.col("b_detected")
    return v.withColumns(
        {"taxonomy": failure_taxonomy(a, b, F.col("evidence")), "failure_type": failure_type(a, b, F.col("applicable"), F.col("support"))}
    )


def failure_type(a: Column, b: Column, applicable: Column, support: Column) -> Column:
    """The earlier twelve labels, from detection outcome and yes/no region support."""
    yes = F.coalesce(support, F.lit(False))
    return first_true(
        [
            (~applicable & a & b, "stable_detection_no_seg_evidence"),
            (~applicable & ~a & b, "a_architecture_sensitive_candidate_no_seg"),
            (~applicable & ~a & ~b, "shared_detection_difficulty_no_seg_evidence"),
            (~applicable, "b_architecture_sensitive_candidate_no_seg"),
            (a & b & yes, "stable"),
            (a & b, "fine_grained_perception_degradation_candidate"),
            (~a & b & yes, "a_specific_detection_failure_candidate"),
            (~a & b, "architecture_sensitive_a_failure_mixed_seg_evidence"),
            (~a & ~b & yes, "shared_detection_difficulty_candidate"),
            (~a & ~b, "shared_visual_hard_sample_candidate"),
            (a & ~b & yes, "b_specific_detection_failure_candidate"),
        ],
        "architecture_sensitive_b_failure_mixed_seg_evidence",
    )
