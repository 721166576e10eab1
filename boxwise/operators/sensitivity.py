"""Failure subsets of two detectors at several operating points each, from one pair join per detector.

Detections are taken by score, so the greedy match at a higher threshold is the part of the match at the lowest one whose
scores reach it. Best candidates at all points are maxima of one aggregation per object. So the match behind any number of
combinations runs once. An object stays one row with a column per point; a combination adds distinct values to the ranks, of which
it keeps the least value of high risk per class, and a number per object, whose bits are the subsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise import constants as K
from boxwise.functions import risk as R
from boxwise.operators.matching import _object_side, greedy_from_pairs, status_label
from boxwise.operators.ranking import percentiles_of
from boxwise.operators.risk import HIGH_RISK, risk_table, subset_flags
from boxwise.session import materialize, written

#: Column of a status table by the short name of its candidate.
_NAMES = {"sa": "best_same_all", "so": "best_same_op", "wr": "best_wrong"}


def status_at_points(objects: DataFrame, pairs: DataFrame, points: dict[str, tuple[float, float]], hot: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per object and point, with the columns of ``object_status`` and point, threshold, macro_f1.

    ``points`` names (threshold, macro F1) pairs; ``pairs`` are all overlapping pairs of one detector.
    """
    wide = _candidates(objects, pairs, points, hot, keep)
    rows = F.array(*[F.struct(*_at(i, name, t, f1)) for i, (name, (t, f1)) in enumerate(points.items())])
    long = wide.select("image_id", "annotation_id", F.col("gt_category_id").alias("category_id"), *(keep or []), F.inline(rows))
    status = status_label(F.col("threshold"), "calibrated", K.MATCH_IOU, K.LOCALIZATION_IOU)
    return long.withColumn("status", status).withColumn("detected", F.col("matched_prediction_index").isNotNull())


def _candidates(objects: DataFrame, pairs: DataFrame, points: dict[str, tuple[float, float]], hot: DataFrame | None, keep: list[str] | None) -> DataFrame:
    """One row per object: the match at the lowest threshold and the best candidates at all points."""
    keep = keep or []
    low = min(t for t, _ in points.values())
    same = F.col("gt_category_id") == F.col("det_category_id")
    usable = (F.col("score") >= low) & (F.col("iou") >= K.MATCH_IOU) & same
    chosen = F.struct("prediction_index", "iou", "score").alias("m")
    matched = greedy_from_pairs(pairs.where(usable), hot).select("image_id", "annotation_id", chosen)
    v = _object_side(objects, keep).join(pairs.drop("gt_category_id"), ["image_id", "annotation_id"], "left")
    cand = F.struct("iou", (-F.col("prediction_index")).alias("p"), F.col("score").alias("s"), F.col("det_category_id").alias("c"))
    best = [F.max(F.when(same, cand)).alias("sa")]
    for i, (t, _) in enumerate(points.values()):
        reach = F.col("score") >= t
        best += [F.max(F.when(same & reach, cand)).alias(f"so{i}"), F.max(F.when(~same & reach, cand)).alias(f"wr{i}")]
    return v.groupBy("image_id", "annotation_id", "gt_category_id", *keep).agg(*best).join(matched, ["image_id", "annotation_id"], "left")


def _at(i: int, name: str, t: float, f1: float, prefix: str = "") -> list[Column]:
    """The columns of point ``i``."""
    own = F.when(F.col("m.score") >= t, F.col("m"))
    columns = [F.lit(name).alias(f"{prefix}point"), F.lit(t).alias(f"{prefix}threshold"), F.lit(f1).alias(f"{prefix}macro_f1")]
    columns += [own[n].alias(f"{prefix}matched_{n}") for n in ("prediction_index", "iou", "score")]
    for short, full in _NAMES.items():
        c, full = F.col(short if short == "sa" else f"{short}{i}"), prefix + full
        columns += [(-c["p"]).alias(f"{full}_prediction_index"), F.coalesce(c["iou"], F.lit(0.0)).alias(f"{full}_iou"), c["s"].alias(f"{full}_score")]
    return columns


def outcomes_at_points(objects: DataFrame, pairs: DataFrame, points: dict[str, tuple[float, float]], hot: DataFrame | None, keep: list[str], m: str) -> DataFrame:
    """One row per object with status, detected and quality of detector ``m`` at each point, as columns m0_status and so on."""
    wide = _candidates(objects, pairs, points, hot, keep)
    own = ["image_id", "annotation_id", "category_id", *keep]
    wide = wide.withColumnRenamed("gt_category_id", "category_id")
    wide = wide.select(*own, *[c for i, (name, (t, f1)) in enumerate(points.items()) for c in _at(i, name, t, f1, f"{m}{i}_")])
    found = []
    for i, (t, _) in enumerate(points.values()):
        c = lambda n, i=i: F.col(f"{m}{i}_{n}")
        detected = c("matched_prediction_index").isNotNull()
        quality = R.detector_quality(detected, c("matched_score"), c("matched_iou"), c("best_same_all_score"), c("best_same_all_iou"), t)
        status = status_label(t, "calibrated", K.MATCH_IOU, K.LOCALIZATION_IOU, f"{m}{i}_")
        found += [status.alias(f"{m}{i}_status"), detected.alias(f"{m}{i}_detected"), quality.alias(f"{m}{i}_quality")]
    return wide.select(*own, *found)


def combination_risk(a: DataFrame, b: DataFrame, shared: list[str]) -> DataFrame:
    """The risk table of every pair of points of two detectors, ranked inside each ``combination``."""
    own = ["point", "threshold", "macro_f1", "status", "detected", "matched_score", "matched_iou", "best_same_all_score", "best_same_all_iou"]
    side = lambda df, m: df.select("annotation_id", *(shared if m == "a" else []), *[F.col(c).alias(f"{m}_{c}") for c in own])
    name = F.concat(F.lit("a_"), F.col("a_point"), F.lit("__b_"), F.col("b_point"))
    wide = side(a, "a").join(side(b, "b"), "annotation_id").withColumn("combination", name)
    column = lambda c: {m: F.col(f"{m}_{c}") for m in "ab"}
    return risk_table(wide, column("threshold"), column("macro_f1"), by=["combination"])


def sensitivity(objects: DataFrame, pairs: dict[str, DataFrame], points: dict[str, dict[str, tuple[float, float]]], central: str, hot: DataFrame | None = None) -> DataFrame:
    """Size, overlap and Jaccard of the failure subsets of every combination against the central one."""
    return written(lambda: _drift(*_members(objects, pairs, points, hot), central))


def _members(objects: DataFrame, pairs: dict[str, DataFrame], points: dict[str, dict[str, tuple[float, float]]], hot: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """(annotation_id, image_id, m0, m1 ...) and the names of the combinations: bits of the subsets that an object is in under each."""
    a, b = (written(lambda m=m: outcomes_at_points(objects, pairs[m], points[m], hot, ["scale"], m), keep=False) for m in "ab")
    shared = ["image_id", "category_id", "scale"]
    both = materialize(a.join(b.drop(*shared, *[c for c in b.columns if c.endswith("_status")]), "annotation_id"))
    names, sides, joint = [], [], []
    for i, (p, (_, p_f1)) in enumerate(points["a"].items()):
        for j, (q, (_, q_f1)) in enumerate(points["b"].items()):
            names.append(f"a_{p}__b_{q}")
            sides.append((f"a{i}", f"b{j}"))
            joint.append(R.joint_risk(F.col(f"a{i}_quality"), F.col(f"b{j}_quality"), {"a": p_f1, "b": q_f1})[2])

    def least(k: int) -> DataFrame:
        """(category_id, combination, least): both percentiles grow with the value, so a class's values of high risk are those from the least one on."""
        counts = materialize(both.groupBy("category_id", joint[k].alias("joint_raw_risk")).agg(F.count("*").alias("cnt")))
        size = counts.groupBy("category_id").agg(F.sum("cnt").alias("class_count"))
        ranked = percentiles_of(counts, "joint_raw_risk", {"global_percentile": [], "class_percentile": ["category_id"]})
        score = R.shrunk_score(F.col("class_count"), F.col("class_percentile"), F.col("global_percentile"))
        found = ranked.join(size, "category_id").where(score >= HIGH_RISK).groupBy("category_id").agg(F.min("joint_raw_risk").alias("least"))
        return found.withColumn("combination", F.lit(k))

    # one combination at a time, as each may have as many values as there are objects
    found = [written(lambda k=k: least(k), keep=False) for k in range(len(names))]
    high = reduce(DataFrame.unionByName, found).groupBy("category_id").agg(
        *[F.min(F.when(F.col("combination") == k, F.col("least"))).alias(f"_from{k}") for k in range(len(names))]
    )
    # classes are few; an object without a class has no rank and so no subset
    placed = both.where(F.col("category_id").isNotNull()).join(F.broadcast(high), "category_id", "left")
    masks = []
    for k, (x, y) in enumerate(sides):
        flags = subset_flags(x, y, F.coalesce(joint[k] >= F.col(f"_from{k}"), F.lit(False))).values()
        bits = [F.when(flag, F.lit(1 << s)).otherwise(F.lit(0)) for s, flag in enumerate(flags)]
        masks.append(sum(bits[1:], bits[0]).alias(f"m{k}"))
    return materialize(placed.select("annotation_id", "image_id", *masks)), names


def _drift(members: DataFrame, names: list[str], central: str) -> DataFrame:
    """``subset_drift`` of subsets that are bits: rows, and images, are counted by their bits, of which few differ."""
    subsets, masks = list(subset_flags()), [f"m{k}" for k in range(len(names))]
    own = [f"c{s}" for s in range(len(subsets))]
    bit = lambda c, s: F.shiftright(c, s).bitwiseAND(F.lit(1))
    base = F.col(f"m{names.index(central)}")
    known = members.where(base > 0).groupBy("annotation_id").agg(*[F.sum(bit(base, s).cast("long")).alias(c) for s, c in enumerate(own)])
    marked = members.join(known, "annotation_id", "left").na.fill(0, own)
    rows = materialize(marked.groupBy(*masks, *own).agg(F.count("*").alias("n")))
    seen = materialize(members.groupBy("image_id").agg(*[F.bit_or(m).alias(m) for m in masks]).groupBy(*masks).agg(F.count("*").alias("n")))

    def cells(df: DataFrame, *more: tuple) -> DataFrame:
        each = [F.struct(F.lit(name).alias("combination"), F.lit(x).alias("subset"), bit(F.col(f"m{k}"), s).alias("inside"), *[m(s).alias(n) for n, m in more]) for k, name in enumerate(names) for s, x in enumerate(subsets)]
        return df.select("n", F.inline(F.array(*each))).where("inside = 1")

    # a central object that comes several times meets each row of its number
    sizes = cells(rows, ("c", lambda s: F.col(own[s]))).groupBy("combination", "subset").agg(
        F.sum(F.col("n") * F.greatest("c", F.lit(1))).alias("objects"), F.sum(F.col("n") * F.col("c")).alias("intersection")
    )
    images = cells(seen).groupBy("combination", "subset").agg(F.sum("n").alias("images"))
    base_size = cells(rows).where(F.col("combination") == central).groupBy("subset").agg(F.sum("n").alias("central_objects"))
    union = F.col("objects") + F.col("central_objects") - F.col("intersection")
    out = sizes.join(images, ["combination", "subset"]).join(base_size, "subset", "left").na.fill(0, ["central_objects"])
    out = out.select("subset", "combination", "objects", "images", "intersection", "central_objects", union.alias("union"))
    return out.withColumn("jaccard", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(1.0))
