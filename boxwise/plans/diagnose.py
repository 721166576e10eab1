"""From detections to a breakdown of failures by cause."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.catalog.views import SCORES, views


def failure_breakdown(spark: SparkSession, folder: str, model: str = "a") -> DataFrame:
    """Status counts and shares of one detector per scale and class."""
    status = views(spark, folder).status[model]
    counts = status.groupBy("scale", "category_id").pivot(
        "status",
        [
            "detected",
            "assignment_conflict_candidate",
            "low_confidence_candidate",
            "classification_error_candidate",
            "localization_error_candidate",
            "missed",
        ],
    ).count()
    counts = counts.na.fill(0)
    total = sum((F.col(c) for c in counts.columns[2:]), F.lit(0))
    return counts.withColumn("failure_rate", 1.0 - F.col("detected") / total)
