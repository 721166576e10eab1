"""Risk scalars: confidence support, detector quality, joint risk, shrinkage, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxwise import constants as K
from boxwise.functions.geometry import clamp
from boxwise.functions.labels import first_true


def confidence_support(score: Column, threshold: float | Column) -> Column:
    """Piecewise linear map of a score: 0 at 0, one half at the threshold, 1 at 1."""
    s = clamp(F.coalesce(score, F.lit(0.0)), F.lit(0.0), F.lit(1.0))
    half = F.lit(0.5)
    if isinstance(threshold, Column):
        below = F.when(threshold <= 0, half).otherwise(half * s / threshold)
        above = F.when(threshold >= 1, half).otherwise(half + half * (s - threshold) / (1.0 - threshold))
        return F.when(s <= threshold, below).otherwise(above)
    below = half if threshold <= 0 else half * s / F.lit(threshold)
    above = half if threshold >= 1 else half + half * (s - threshold) / F.lit(1.0 - threshold)
    return F.when(s <= threshold, below).otherwise(above)


def detector_quality(
    detected: Column,
    matched_score: Column,
    matched_iou: Column,
    best_score: Column,
    best_iou: Column,
    threshold: float,
    multiplier: float = K.NONDETECTION_MULTIPLIER,
) -> Column:
    """Geometric mean of confidence and localization support, damped when not detected."""
    zero, one = F.lit(0.0), F.lit(1.0)
    score = F.when(detected, matched_score).otherwise(best_score)
    overlap = F.coalesce(F.when(detected, matched_iou).otherwise(best_iou), zero)
    factor = F.when(detected, one).otherwise(F.lit(multiplier))
    root = F.sqrt(confidence_support(score, threshold) * clamp(overlap, zero, one))
    return clamp(factor * root, zero, one)


def joint_risk(a_quality: Column, b_quality: Column, macro_f1=None) -> tuple[Column, Column, Column]:
    """(consensus, disagreement, joint) of two detectors' risks."""
    f1 = macro_f1 or K.MACRO_F1
    total = f1["a"] + f1["b"]
    a_risk, b_risk = 1.0 - a_quality, 1.0 - b_quality
    consensus = F.lit(f1["a"] / total) * a_risk + F.lit(f1["b"] / total) * b_risk
    disagreement = F.abs(a_risk - b_risk)
    return consensus, disagreement, 1.0 - (1.0 - consensus) * (1.0 - disagreement)


def shrunk_score(class_count: Column, class_pct: Column, global_pct: Column, prior=K.CLASS_PRIOR) -> Column:
    """Class percentile pulled towards the global one when the class is rare."""
    reliability = class_count / (class_count + F.lit(prior))
    return reliability * class_pct + (1.0 - reliability) * global_pct


def risk_tier(score: Column) -> Column:
    return first_true([(score >= low, name) for name, low in K.TIERS], "standard")


def risk_bin(score: Column, bins: int = K.RISK_BINS) -> Column:
    return clamp(F.floor(score * bins), F.lit(0), F.lit(bins - 1)).cast("int")


def risk_weight(score: Column) -> Column:
    return 0.05 + 0.95 * (score * score)
