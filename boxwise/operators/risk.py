"""Object risk, image risk, failure subsets and their overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise import constants as K
from boxwise.functions import risk as R
from boxwise.operators.ranking import attach, mid_percentiles, quantiles
from boxwise.session import materialize


def detector_qualities(wide: DataFrame, thresholds: dict, models: str = "ab") -> DataFrame:
    """``wide`` with the quality of each detector."""

    def quality(m: str) -> Column:
        c = lambda n: F.col(f"{m}_{n}")
        return R.detector_quality(
            c("detected"), c("matched_score"), c("matched_iou"), c("best_same_all_score"), c("best_same_all_iou"), thresholds[m]
        )

    return wide.withColumns({f"{m}_quality": quality(m) for m in models})


def risk_table(
    wide: DataFrame, thresholds=None, macro_f1=None, float32: bool = False, by: list[str] | None = None, keep: list[str] | None = None, stored: bool = False, ranks: bool = False
) -> DataFrame:
    """Qualities, joint risk, percentiles, shrunk score and tier of every object.

    Thresholds and F1 by detector may be columns; ``by`` names columns within whose values objects are ranked,
    ``keep`` the columns of ``wide`` to hand on (all of them by default). A written table that has the qualities already
    is ``stored``; with ``ranks`` what ``with_scores`` adds is left out, for a table that is written.

    ``float32`` stores the joint risk in single precision before ranking, which makes
    more ties; double is the default.
    """
    v = wide if stored else detector_qualities(wide, thresholds or K.OPERATING_SCORE)
    by = by or []
    consensus, disagreement, joint = R.joint_risk(F.col("a_quality"), F.col("b_quality"), macro_f1)
    joint = joint.cast("float").cast("double") if float32 else joint
    parts = {"consensus_risk": consensus, "disagreement": disagreement}
    # what follows from the qualities alone is neither written nor dealt with the rows
    later = keep is not None and macro_f1 is None
    v = v.withColumns(({} if later else parts) | {"joint_raw_risk": joint})
    if keep is not None:
        v = v.select(*keep, *by, "a_quality", "b_quality", *([] if later else parts), "joint_raw_risk")
    # The ranks read this table several times: the match behind it must run once.
    if not stored:
        v = materialize(v)
    # counted in the written rows, as a count of ranked ones would rank them again
    n = v.groupBy(*by, "category_id").agg(F.count("*").alias("class_count"))
    v = mid_percentiles(v, "joint_raw_risk", {"global_percentile": by, "class_percentile": [*by, "category_id"]})
    v = v.join(n, [*by, "category_id"])
    return v if ranks else with_scores(v)


def with_scores(ranked: DataFrame) -> DataFrame:
    """A ranked table with what follows from its rows: consensus and disagreement if they aren't there, score and tier."""
    v = ranked
    if "consensus_risk" not in v.columns:
        consensus, disagreement, _ = R.joint_risk(F.col("a_quality"), F.col("b_quality"))
        place = v.columns.index("b_quality") + 1
        v = v.select(*v.columns[:place], consensus.alias("consensus_risk"), disagreement.alias("disagreement"), *v.columns[place:])
    v = v.withColumn("risk_score", R.shrunk_score(F.col("class_count"), F.col("class_percentile"), F.col("global_percentile")))
    return v.withColumn("risk_tier", R.risk_tier(F.col("risk_score")))


def image_risk(risk: DataFrame, images: DataFrame) -> DataFrame:
    """Risk summary per image; images without objects stay with 0 and nulls."""
    small = F.col("scale") == "small"
    basic = risk.groupBy("image_id").agg(
        F.count("*").alias("num_objects"),
        F.count_if(small).alias("num_small_objects"),
        F.avg("risk_score").alias("risk_mean"),
        F.max("risk_score").alias("risk_max"),
        F.avg(F.when(small, F.col("risk_score"))).alias("small_risk_mean"),
        F.avg("disagreement").alias("disagreement_mean"),
        F.avg((F.col("risk_score") >= 0.75).cast("double")).alias("high_or_critical_fraction"),
    )
    p90 = quantiles(risk, "risk_score", ["image_id"], {"risk_p90": 0.9})
    out = images.select("image_id", "split").join(basic, "image_id", "left").join(p90, "image_id", "left")
    return out.na.fill(0, ["num_objects", "num_small_objects"])


#: Risk score from which an object is of high risk.
HIGH_RISK = 0.75


def subset_flags(a: str = "a", b: str = "b", high: Column | None = None) -> dict[str, Column]:
    """The six failure subsets as conditions on a risk table; ``a`` and ``b`` are the prefixes of the detectors' columns,
    ``high`` tells of high risk where the score is no column."""
    a_detected, b_detected, a_status = F.col(f"{a}_detected"), F.col(f"{b}_detected"), F.col(f"{a}_status")
    neither = ~a_detected & ~b_detected
    small = F.col("scale") == "small"
    return {
        "small_jointly_missed": small & neither,
        "b_supported_a_failure": b_detected & ~a_detected,
        "a_low_confidence": a_status == "low_confidence_candidate",
        "a_localization": a_status == "localization_error_candidate",
        "a_classification": a_status == "classification_error_candidate",
        "small_high_risk": small & (F.col("risk_score") >= HIGH_RISK if high is None else high),
    }


MACRO_SUBSETS = ("small_jointly_missed", "b_supported_a_failure", "a_low_confidence", "a_localization", "a_classification")


def failure_subsets(risk: DataFrame) -> DataFrame:
    """Membership rows: one per object and subset it belongs to."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subset_flags().items()]))
    return risk.select("annotation_id", "image_id", "category_id", "scale", "risk_score", F.explode(names).alias("subset"))


def subset_summary(members: DataFrame) -> DataFrame:
    """Objects, images, mean risk and scale counts of each subset."""
    per_image = members.groupBy("subset", "image_id").agg(
        F.count("*").alias("n"),
        F.sum("risk_score").alias("risk"),
        *[F.count_if(F.col("scale") == s).alias(s) for s in K.SCALES],
    )
    return per_image.groupBy("subset").agg(
        F.sum("n").alias("objects"),
        F.count("*").alias("images"),
        (F.sum("risk") / F.sum("n")).alias("mean_risk"),
        *[F.sum(s).alias(f"{s}_objects") for s in K.SCALES],
    )


def subset_classes(members: DataFrame) -> DataFrame:
    return members.groupBy("subset", "category_id").agg(F.count("*").alias("objects"))


def subset_overlap(risk: DataFrame) -> DataFrame:
    """Intersection, union and Jaccard of every ordered pair of subsets, in one pass."""
    flags = subset_flags()
    names = list(flags)
    counts = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both, either = flags[a] & flags[b], flags[a] | flags[b]
            counts += [F.count_if(both).alias(f"i{i}_{j}"), F.count_if(either).alias(f"u{i}_{j}")]
    total = risk.agg(*counts)
    rows = [
        F.struct(
            F.lit(a).alias("subset_a"), F.lit(b).alias("subset_b"),
            F.col(f"i{i}_{j}").alias("intersection"), F.col(f"u{i}_{j}").alias("union"),
        )
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    jaccard = F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(1.0)
    return total.select(F.inline(F.array(*rows))).withColumn("jaccard", jaccard)


def subset_drift(sets: DataFrame, central: str) -> DataFrame:
    """Size, overlap and Jaccard of each combination's subset against the central combination.

    ``sets`` has (combination, subset, annotation_id, image_id).
    """
    members = sets.select("combination", "subset", "annotation_id", "image_id")
    base = members.where(F.col("combination") == central).select("subset", "annotation_id", F.lit(1).alias("_c"))
    marked = members.join(base, ["subset", "annotation_id"], "left")
    per_image = marked.groupBy("combination", "subset", "image_id").agg(F.count("*").alias("n"), F.count("_c").alias("c"))
    sizes = per_image.groupBy("combination", "subset").agg(
        F.sum("n").alias("objects"), F.count("*").alias("images"), F.sum("c").alias("intersection")
    )
    base_size = base.groupBy("subset").agg(F.count("*").alias("central_objects"))
    union = F.col("objects") + F.col("central_objects") - F.col("intersection")
    out = sizes.join(base_size, "subset", "left").na.fill(0, ["central_objects"]).withColumn("union", union)
    return out.withColumn("jaccard", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(1.0))
