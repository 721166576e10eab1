"""Epoch curves: checkpoint choice, decline, area, slopes, attribution, restarts.

A curve is one row per epoch, so windows per curve are short by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def select_best(curve: DataFrame, by: list[str], value: str = "AP", tol: float = 0.0005) -> DataFrame:
    """Earliest epoch within ``tol`` of the best value of its curve."""
    top = F.max(value).over(W.partitionBy(*by))
    near = curve.select(*by, "epoch", value, top.alias("maximum")).where(F.col(value) >= F.col("maximum") - tol)
    return near.groupBy(*by).agg(
        F.min(F.struct("epoch", value, "maximum")).alias("b")
    ).select(*by, "b.*")


def sustained_decline(curve: DataFrame, by: list[str], value: str = "AP", drop: float = 0.002) -> DataFrame:
    """First epoch after the peak from which the value stays at or below peak - drop; null if none."""
    group = W.partitionBy(*by)
    peak = curve.select(*by, "epoch", value, F.max(value).over(group).alias("peak"))
    first = F.min(F.when(F.col(value) == F.col("peak"), F.col("epoch"))).over(group)
    tail = group.orderBy(F.desc("epoch")).rowsBetween(W.unboundedPreceding, 0)
    v = peak.select("*", first.alias("peak_epoch"), F.max(value).over(tail).alias("later_best"))
    start = F.min(
        F.when((F.col("epoch") > F.col("peak_epoch")) & (F.col("later_best") <= F.col("peak") - drop), F.col("epoch"))
    )
    return v.groupBy(*by, "peak", "peak_epoch").agg(start.alias("decline_epoch"))


def normalized_auc(curve: DataFrame, by: list[str], value: str, name: str = "auc") -> DataFrame:
    """Trapezoid area over epochs divided by their span; the value itself when the span is 0."""
    order = W.partitionBy(*by).orderBy("epoch")
    step = curve.select(
        *by,
        "epoch",
        F.col(value).alias("_v"),
        ((F.col("epoch") - F.lag("epoch").over(order)) * (F.col(value) + F.lag(value).over(order)) / 2.0).alias("_a"),
    )
    span = F.max("epoch") - F.min("epoch")
    return step.groupBy(*by).agg(
        F.when(span > 0, F.sum("_a") / span).otherwise(F.max("_v")).alias(name)
    )


def curve_summary(curve: DataFrame, by: list[str], value: str, k: int = 5, slope_k: int = 10) -> DataFrame:
    """First, last, means of the first and last k, and the slope of the last values."""
    up = W.partitionBy(*by).orderBy("epoch")
    down = W.partitionBy(*by).orderBy(F.desc("epoch"))
    v = curve.select(*by, F.col(value).alias("v"), F.row_number().over(up).alias("i"), F.row_number().over(down).alias("j"))
    tail = F.col("j") <= slope_k
    # Slope over positions equals slope over 0..k-1; a single point has slope 0.
    slope = F.regr_slope(F.when(tail, F.col("v")), F.when(tail, F.col("i").cast("double")))
    return v.groupBy(*by).agg(
        F.count("*").alias("epochs"),
        F.max(F.when(F.col("i") == 1, F.col("v"))).alias("first"),
        F.max(F.when(F.col("j") == 1, F.col("v"))).alias("last"),
        F.avg(F.when(F.col("i") <= k, F.col("v"))).alias("first_mean"),
        F.avg(F.when(F.col("j") <= k, F.col("v"))).alias("last_mean"),
        F.coalesce(slope, F.lit(0.0)).alias("last_slope"),
    )


def attribute(curve: DataFrame, common: DataFrame, metrics: list[str]) -> DataFrame:
    """Per matched epoch and metric: shared, residual and total effect.

    ``curve`` has arm ('uniform' or 'risk'), epoch and metrics; ``common`` one row.
    """
    pick = lambda arm, p: curve.where(F.col("arm") == arm).select("epoch", *[F.col(m).alias(f"{p}_{m}") for m in metrics])
    start = common.select(F.lit(0).alias("_one"), *[F.col(m).alias(f"c_{m}") for m in metrics])
    both = pick("uniform", "u").join(pick("risk", "r"), "epoch").withColumn("_one", F.lit(0)).join(F.broadcast(start), "_one")
    rows = [
        F.struct(
            F.lit(m).alias("metric"), F.col(f"c_{m}").alias("common"), F.col(f"u_{m}").alias("uniform"), F.col(f"r_{m}").alias("risk")
        )
        for m in metrics
    ]
    v = both.select("epoch", F.inline(F.array(*rows)))
    return v.withColumns(
        {
            "shared_effect": F.col("uniform") - F.col("common"),
            "residual": F.col("risk") - F.col("uniform"),
            "total_effect": F.col("risk") - F.col("common"),
        }
    ).withColumn(
        "identity_holds", F.abs(F.col("total_effect") - (F.col("shared_effect") + F.col("residual"))) <= 1e-12
    )


def attribution_summary(rows: DataFrame) -> DataFrame:
    """Per metric: trajectory means, areas, signs, extremes and the terminal residual."""
    basic = rows.groupBy("metric").agg(
        F.avg("uniform").alias("uniform_mean"),
        F.avg("risk").alias("risk_mean"),
        F.avg("residual").alias("delta_mean"),
        F.count_if(F.col("residual") > 0).alias("positive"),
        F.count_if(F.abs("residual") <= 1e-12).alias("zero"),
        F.count_if(F.col("residual") < 0).alias("negative"),
        F.min("residual").alias("minimum_delta"),
        F.max("residual").alias("maximum_delta"),
        F.max(F.struct("epoch", "residual")).alias("_t"),
    )
    out = basic.withColumn("terminal_delta", F.col("_t.residual")).drop("_t")
    for value, name in (("uniform", "uniform_auc"), ("risk", "risk_auc"), ("residual", "delta_auc")):
        out = out.join(normalized_auc(rows, ["metric"], value, name), "metric")
    return out


def restart_ratio(curves: DataFrame, common: str, columns: list[str]) -> DataFrame:
    """First value of each branch over the last value of the common stage, per column."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns]
    ends = (
        curves.select("curve", "epoch", F.inline(F.array(*rows)))
        .groupBy("curve", "column")
        .agg(F.min_by("v", "epoch").alias("first"), F.max_by("v", "epoch").alias("last"))
    )
    base = ends.where(F.col("curve") == common).select("column", F.col("last").alias("_last"))
    return ends.where(F.col("curve") != common).join(base, "column").select(
        "curve", "column", F.when(F.col("_last") != 0, F.col("first") / F.col("_last")).alias("restart_ratio")
    )
