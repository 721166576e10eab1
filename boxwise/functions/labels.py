"""Label cascades: object status, false-positive type, evidence grade, taxonomy, failure group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxwise import constants as K


def first_true(rules, default: str) -> Column:
    """The label of the first rule that holds; null conditions do not hold."""
    out = None
    for condition, label in rules:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default))


def evidence_grade(applicable: Column, support: Column, score: Column) -> Column:
    rules = [(~applicable, "not_applicable"), (~F.coalesce(support, F.lit(False)), "none")]
    rules += [(score >= low, name) for name, low in K.EVIDENCE_GRADES]
    return first_true(rules, "none")


def failure_taxonomy(a_detected: Column, b_detected: Column, evidence: Column) -> Column:
    """Twelve labels: four detection outcomes by three kinds of region evidence."""
    no_evidence = evidence == "not_applicable"
    graded = evidence.isin("strong", "moderate", "weak")

    def by_evidence(outcome, without_class, with_region, without_support):
        return [
            (outcome & no_evidence, without_class),
            (outcome & graded, with_region),
            (outcome, without_support),
        ]

    def one_sided(outcome, model):
        return by_evidence(
            outcome,
            f"{model}_architecture_sensitive_candidate_no_seg_evidence",
            f"{model}_specific_detection_failure_candidate",
            f"{model}_architecture_sensitive_candidate_without_seg_support",
        )

    rules = (
        by_evidence(
            a_detected & b_detected,
            "stable_detection_no_seg_evidence",
            "stable_detection_with_region_evidence",
            "detection_success_without_seg_support",
        )
        + one_sided(~a_detected & b_detected, "a")
        + by_evidence(
            ~a_detected & ~b_detected,
            "shared_detection_difficulty_no_seg_evidence",
            "shared_detection_difficulty_with_region_evidence",
            "shared_visual_hard_sample_candidate",
        )
        + one_sided(a_detected & ~b_detected, "b")
    )
    return first_true(rules, "unclassified")


def failure_group(
    scale: Column, tier: Column, a_status: Column, a_detected: Column, b_detected: Column
) -> Column:
    """Primary sampling group of an object; the first group that applies wins."""
    small = scale == "small"
    risky = tier.isin("high", "critical")
    neither = ~a_detected & ~b_detected
    return first_true(
        [
            (small & neither, "small_joint_not_detected"),
            (b_detected & ~a_detected, "b_supported_a_failure"),
            (a_status == "low_confidence_candidate", "a_low_confidence"),
            (small & risky, "small_high_or_critical"),
            (
                a_status.isin("localization_error_candidate", "assignment_conflict_candidate"),
                "a_geometric_failure",
            ),
            (a_status == "classification_error_candidate", "a_classification_failure"),
            (neither, "other_joint_not_detected"),
            (risky, "other_high_or_critical"),
        ],
        "standard_support",
    )
