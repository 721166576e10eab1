"""Score calibration: events, precision/recall/F1, threshold sweep and grid, plateau."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise import constants as K
from boxwise.operators.matching import greedy_match
from boxwise.operators.ranking import attach, order_bucket, running_sums
from boxwise.session import materialize


def detection_events(
    objects: DataFrame, dets: DataFrame, min_iou: float = K.MATCH_IOU, hot: DataFrame | None | str = "check", floor: float | None = None
) -> DataFrame:
    """(image, category, score, is_tp) of every detection, matched greedily; ``floor`` leaves out lower scores."""
    usable = dets if floor is None else dets.where(F.col("score") >= floor)
    hits = greedy_match(objects, usable, min_iou, hot=hot).select("image_id", "prediction_index", F.lit(1).alias("_hit"))
    return usable.join(hits, ["image_id", "prediction_index"], "left").select(
        "image_id", "prediction_index", "category_id", "score", F.coalesce("_hit", F.lit(0)).alias("is_tp")
    )


def gt_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("category_id").agg(F.count("*").alias("gt"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0))


def _summarize_classes(df: DataFrame, keep: list[str], min_gt: int) -> DataFrame:
    """Macro and micro summary of rows holding per-class counts t1.., f1.. and gt1.. ."""
    classes = list(K.CATEGORIES)
    ratio = lambda num, den: f"CASE WHEN {den} > 0 THEN {num} / ({den}) ELSE 0D END"
    f1 = lambda p, r: f"CASE WHEN {p} + {r} > 0 THEN 2D * {p} * {r} / ({p} + {r}) ELSE 0D END"
    total = lambda k: "(" + " + ".join(f"{k}{c}" for c in classes) + ")"
    v = df.selectExpr(
        *keep,
        *[f"{ratio(f't{c}', f't{c} + f{c}')} AS p{c}" for c in classes],
        *[f"{ratio(f't{c}', f'gt{c}')} AS r{c}" for c in classes],
        *[f"CAST(gt{c} >= {min_gt} AS INT) AS e{c}" for c in classes],
        f"{total('t')} AS total_tp",
        f"{total('f')} AS total_fp",
        f"{total('gt')} - {total('t')} AS total_fn",
    )
    v = v.selectExpr("*", *[f"{f1(f'p{c}', f'r{c}')} AS h{c}" for c in classes])
    macro = lambda k: "(" + " + ".join(f"e{c} * {k}{c}" for c in classes) + f") / {total('e')}"
    v = v.selectExpr(
        *keep, f"{macro('p')} AS macro_precision", f"{macro('r')} AS macro_recall", f"{macro('h')} AS macro_f1",
        f"{ratio('total_tp', 'total_tp + total_fp')} AS micro_precision",
        f"{ratio('total_tp', 'total_tp + total_fn')} AS micro_recall",
        "total_tp", "total_fp", "total_fn",
    )
    return v.selectExpr("*", f"{f1('micro_precision', 'micro_recall')} AS micro_f1")


def _class_counts() -> list[str]:
    """SQL aggregates of true and false positives per class as columns t1.., f1.. ."""
    out = []
    for c in K.CATEGORIES:
        out.append(f"sum(CASE WHEN category_id = {c} THEN is_tp ELSE 0 END) AS t{c}")
        out.append(f"sum(CASE WHEN category_id = {c} THEN 1 - is_tp ELSE 0 END) AS f{c}")
    return out


def prf_per_class(events: DataFrame, counts: DataFrame, min_gt: int = K.MIN_CLASS_GT) -> DataFrame:
    """Precision, recall and F1 per class."""
    sums = events.groupBy("category_id").agg(
        F.sum("is_tp").alias("tp"), F.sum(1 - F.col("is_tp")).alias("fp")
    )
    out = counts.join(sums, "category_id", "full_outer").na.fill(0, ["gt", "tp", "fp"])
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("gt"))
    return out.select(
        "category_id", "gt", "tp", "fp", (F.col("gt") - F.col("tp")).alias("fn"),
        p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), (F.col("gt") >= min_gt).alias("eligible"),
    )


def prf(events: DataFrame, counts: DataFrame, min_gt: int = K.MIN_CLASS_GT) -> DataFrame:
    """Macro precision, recall and F1 over eligible classes, micro over all; one row."""
    rows = prf_per_class(events, counts, min_gt)
    pick = lambda name: F.avg(F.when(F.col("eligible"), F.col(name)))
    total = rows.agg(
        pick("precision").alias("macro_precision"),
        pick("recall").alias("macro_recall"),
        pick("f1").alias("macro_f1"),
        F.sum("tp").alias("total_tp"),
        F.sum("fp").alias("total_fp"),
        F.sum("fn").alias("total_fn"),
    )
    p = _ratio(F.col("total_tp"), F.col("total_tp") + F.col("total_fp"))
    r = _ratio(F.col("total_tp"), F.col("total_tp") + F.col("total_fn"))
    return total.withColumns({"micro_precision": p, "micro_recall": r, "micro_f1": _f1(p, r)})


def _gt_row(counts: DataFrame) -> DataFrame:
    return counts.agg(*[F.coalesce(F.sum(F.when(F.col("category_id") == c, F.col("gt"))), F.lit(0)).alias(f"gt{c}") for c in K.CATEGORIES])


def sweep_points(events: DataFrame, counts: DataFrame, min_gt: int = K.MIN_CLASS_GT) -> DataFrame:
    """Summary at every distinct score, counting detections at or above it.

    Classes become columns, so one bucketed running sum over distinct scores serves all.
    """
    per_score = events.groupBy("score").agg(*[F.expr(e) for e in _class_counts()])
    renamed = per_score.withColumnsRenamed({c: f"d{c}" for c in per_score.columns if c != "score"})
    sums = {f"{k}{c}": f"d{k}{c}" for c in K.CATEGORIES for k in "tf"}
    cum = materialize(running_sums(renamed, [], ["score DESC"], [f"-({order_bucket('score')})"], sums))
    cum = attach(cum.withColumnRenamed("score", "threshold"), _gt_row(counts), [])
    return _summarize_classes(cum, ["threshold"], min_gt)


def threshold_sweep(events: DataFrame, counts: DataFrame, min_gt: int = K.MIN_CLASS_GT, tol: float = 1e-15) -> DataFrame:
    """The score with the best macro F1; then the best macro recall, then the highest score."""
    # Written once: three passes read it, and filters on derived columns stay simple.
    points = materialize(sweep_points(events, counts, min_gt))
    best = points.agg(F.max("macro_f1").alias("_f"))
    near = attach(points, best, []).where(F.col("macro_f1") >= F.col("_f") - tol).drop("_f")
    best = near.agg(F.max("macro_recall").alias("_r"))
    near = attach(near, best, []).where(F.col("macro_recall") >= F.col("_r") - tol).drop("_r")
    return near.orderBy(F.desc("threshold")).limit(1)


def threshold_grid(events: DataFrame, counts: DataFrame, chosen: float | None = None, min_gt: int = K.MIN_CLASS_GT) -> DataFrame:
    """Summary at thresholds 0.00, 0.01 .. 1.00 (and a chosen one), one pass over the events."""
    s = F.col("score")
    guess = F.floor(s * 100).cast("int") + 1
    slot = F.when(guess / 100.0 <= s, guess).when((guess - 1) / 100.0 <= s, guess - 1).otherwise(guess - 2)
    aggs = [F.expr(e) for e in _class_counts()]
    by_slot = events.groupBy(F.least(slot, F.lit(100)).alias("slot")).agg(*aggs)
    grid = events.sparkSession.range(101).selectExpr("CAST(id AS INT) AS slot")
    filled = grid.join(by_slot, "slot", "left").na.fill(0)
    # 101 rows: the window is one short task.
    down = "OVER (PARTITION BY 0 ORDER BY slot DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    names = [f"{k}{c}" for c in K.CATEGORIES for k in "tf"]
    cum = filled.selectExpr("slot / 100.0D AS threshold", "false AS chosen", *[f"sum({n}) {down} AS {n}" for n in names])
    if chosen is not None:
        point = events.where(s >= chosen).agg(*aggs).na.fill(0)
        cum = cum.unionByName(point.selectExpr(f"{chosen!r}D AS threshold", "true AS chosen", *names))
    return _summarize_classes(attach(cum, _gt_row(counts), []), ["threshold", "chosen"], min_gt)


def plateau(grid: DataFrame, share: float = 0.95) -> DataFrame:
    """Low, central and high threshold of the region within ``share`` of the best macro F1."""
    grid = materialize(grid)
    top = grid.agg(F.max("macro_f1").alias("maximum"))
    v = attach(grid, top, []).where(F.col("macro_f1") >= share * F.col("maximum"))
    point = F.struct("threshold", "macro_f1")
    picked = v.agg(
        F.first("maximum").alias("maximum"),
        F.count("*").alias("rows"),
        F.min(point).alias("low"),
        F.max(F.struct(F.col("macro_f1").alias("f"), (-F.col("threshold")).alias("t"))).alias("c"),
        F.max(point).alias("high"),
    )
    rows = [
        F.struct(F.lit("low").alias("point"), F.col("low.threshold").alias("threshold"), F.col("low.macro_f1").alias("macro_f1")),
        F.struct(F.lit("central").alias("point"), (-F.col("c.t")).alias("threshold"), F.col("c.f").alias("macro_f1")),
        F.struct(F.lit("high").alias("point"), F.col("high.threshold").alias("threshold"), F.col("high.macro_f1").alias("macro_f1")),
    ]
    return picked.select("maximum", (share * F.col("maximum")).alias("minimum"), "rows", F.inline(F.array(*rows)))


def combinations(plateau_a: DataFrame, plateau_b: DataFrame) -> DataFrame:
    """The 3 x 3 operating combinations of two plateaus."""
    pick = lambda df, m: df.select(
        F.col("point").alias(f"{m}_point"), F.col("threshold").alias(f"{m}_threshold"), F.col("macro_f1").alias(f"{m}_macro_f1"), F.lit(0).alias("_one")
    )
    out = pick(plateau_a, "a").join(F.broadcast(pick(plateau_b, "b")), "_one").drop("_one")
    name = F.concat(F.lit("a_"), F.col("a_point"), F.lit("__b_"), F.col("b_point"))
    return out.withColumn("combination", name)
