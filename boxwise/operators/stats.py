"""Bootstrap, tests, comparisons, gates, robustness and table agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise import constants as K
from boxwise.functions.hashing import hash_uniform, little_endian_seed
from boxwise.operators.precision import evaluate_cells, object_counts, summarize
from boxwise.operators.ranking import attach, order_bucket, quantiles, running_sums
from boxwise.operators.weighted import evaluate_columns, placed, weight_table
from boxwise.session import materialize


def bootstrap_weights(images: DataFrame, replicates: int, first: int = 0, seed=K.BOOTSTRAP_SEED) -> DataFrame:
    """(replicate, image_id, weight): N draws with replacement per replicate, hash-drawn.

    Every image j makes one draw per replicate, so the weights of a replicate sum to N.
    Only drawn images appear; ``first`` continues a run in batches of replicates.
    """
    ids = images.select("image_id")
    placed = running_sums(ids, [], ["image_id"], [order_bucket("image_id", 4096)], {"place": "1L"})
    size = ids.agg(F.count("*").alias("n"))
    # few bytes an image, but many draws: dealt by number, as bytes would put them into a task or two
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = attach(placed, size, []).repartition(parts, "place").select(
        "place", "n", F.explode(F.sequence(F.lit(first), F.lit(first + replicates - 1))).alias("replicate")
    )
    label = F.concat(F.lit("replicate"), F.col("replicate"))
    drawn = (F.floor(hash_uniform(seed, label, F.col("place")) * F.col("n")) + 1).alias("place")
    weights = draws.select("replicate", drawn).groupBy("replicate", "place").agg(F.count("*").alias("weight"))
    return weights.join(placed, "place").select("replicate", "image_id", "weight")


def bootstrap_metrics(cache: DataFrame, counts: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Summary metrics per replicate from match caches; ``by`` may add a model column that both carry."""
    by = by or ["replicate"]
    cells = evaluate_cells(cache.join(weights, "image_id"), counts.join(weights, "image_id"), by, "weight")
    return summarize(cells, by)


METRICS = ("AP", "AP50", "AP75", "AP_small", "AP_medium", "AP_large", "AR100")


def metric_deltas(a: DataFrame, b: DataFrame, keys: list[str], metrics=METRICS) -> DataFrame:
    """b - a per key and metric, long form."""
    right = b.select(*keys, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    both = a.select(*keys, *metrics).join(right, keys)
    rows = [F.struct(F.lit(m).alias("metric"), (F.col(f"_b_{m}") - F.col(m)).alias("delta")) for m in metrics]
    return both.select(*keys, F.inline(F.array(*rows)))


def delta_summary(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, standard error, 95 % interval and stability of bootstrap deltas."""
    basic = deltas.groupBy(*by).agg(
        F.count("delta").alias("replicates"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("standard_error")
    )
    q = quantiles(deltas, "delta", by, {"median": 0.5, "ci_low": 0.025, "ci_high": 0.975})
    out = basic.join(q, by)
    crosses = (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)
    return out.withColumns({"crosses_zero": crosses, "stable": ~crosses})


def paired_bootstrap(
    objects: DataFrame, images: DataFrame, caches: dict[str, DataFrame], reference: str, replicates: int, first: int = 0, batch: int = 50
) -> DataFrame:
    """Per-replicate metric deltas of every model against the reference, same weights for all.

    The detections of all models are put in order once. A batch of replicates is one array of weights per image, and its
    sums are added array by array, so no row is copied per replicate. A batch's metrics are written before the next begins, so a run can go on from ``first``.
    """
    tagged = None
    for name, cache in caches.items():
        one = cache.withColumn("model", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    names = F.array(*[F.lit(n) for n in caches])
    rows = materialize(placed(tagged, ["model"]))
    counts = materialize(object_counts(objects))
    out = None
    for start in range(first, first + replicates, batch):
        size = min(batch, first + replicates - start)
        weights = materialize(weight_table(bootstrap_weights(images, size, start), "replicate", size, start))
        cells = evaluate_columns(rows, counts, ["model"], weights, size).withColumn("replicate", F.col("column") + start)
        scored = materialize(summarize(cells, ["model", "replicate"]))
        base = scored.where(F.col("model") == reference).drop("model")
        for name in caches:
            if name != reference:
                d = metric_deltas(base, scored.where(F.col("model") == name).drop("model"), ["replicate"])
                d = d.withColumn("comparison", F.lit(f"{name}_minus_{reference}"))
                out = d if out is None else out.unionByName(d)
    return out


def empirical_p(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Two-sided bootstrap p-value with the +1 correction."""
    n = F.count("delta") + 1
    low = (F.count_if(F.col("delta") <= 0) + 1) / n
    high = (F.count_if(F.col("delta") >= 0) + 1) / n
    return deltas.groupBy(*by).agg(F.least(F.lit(1.0), F.lit(2.0) * F.least(low, high)).alias("p_value"))


def evidence_role(df: DataFrame, primary: dict[str, list[str]], guardrail: dict[str, list[str]] | None = None) -> DataFrame:
    """Role of each (comparison, metric): primary, guardrail or secondary."""

    def member(table) -> Column:
        out = F.lit(False)
        for comparison, metrics in (table or {}).items():
            out = out | ((F.col("comparison") == comparison) & F.col("metric").isin(*metrics))
        return out

    role = F.when(member(primary), "primary").when(member(guardrail), "guardrail").otherwise("secondary")
    return df.withColumn("evidence_role", role)


def bh_adjust(rows: DataFrame) -> DataFrame:
    """Benjamini-Hochberg q-values of the secondary rows within each comparison.

    One row per metric, so each window is short.
    """
    secondary = F.col("evidence_role") == "secondary"
    place = W.partitionBy("comparison").orderBy("p_value", "metric")
    tail = W.partitionBy("comparison").orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
    n = F.count("*").over(W.partitionBy("comparison"))
    ranked = rows.where(secondary).select("*", F.row_number().over(place).alias("_k"), n.alias("_n"))
    raw = F.least(F.lit(1.0), F.col("p_value") * F.col("_n") / F.col("_k"))
    adjusted = ranked.withColumn("_raw", raw).withColumn("bh_q_value", F.min("_raw").over(tail)).drop("_k", "_n", "_raw")
    rest = rows.where(~secondary).withColumn("bh_q_value", F.lit(None).cast("double"))
    return adjusted.unionByName(rest).withColumn("significant", F.col("bh_q_value") < 0.05)


def ratio_bootstrap(counts: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """sum(w * matched) / sum(w * gt) per replicate; ``counts`` has image_id, matched, gt."""
    v = counts.join(weights, "image_id").groupBy(*by, "replicate").agg(
        F.sum(F.col("matched") * F.col("weight")).alias("m"), F.sum(F.col("gt") * F.col("weight")).alias("g")
    )
    return v.select(*by, "replicate", F.when(F.col("g") > 0, F.col("m") / F.col("g")).alias("ratio"))


def compare(metrics: DataFrame, pairs: list[tuple[str, str]], keys: list[str], names) -> DataFrame:
    """Metric deltas of named model pairs per condition; ``metrics`` has a model column."""
    comparisons = F.array(*[F.struct(F.lit(a).alias("left_model"), F.lit(b).alias("right_model")) for a, b in pairs])
    left = metrics.select("model", *keys, *names).select("*", F.inline(comparisons)).where(F.col("model") == F.col("left_model")).drop("model")
    right = metrics.select(F.col("model").alias("right_model"), *keys, *[F.col(m).alias(f"_r_{m}") for m in names])
    both = left.join(right, ["right_model", *keys])
    return both.select(
        "left_model", "right_model", *keys, *[(F.col(m) - F.col(f"_r_{m}")).alias(f"delta_{m}") for m in names]
    )


def compare_summary(deltas: DataFrame, names) -> DataFrame:
    """Mean delta and share of conditions with a gain, per pair and metric."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"delta_{m}").alias("delta")) for m in names]
    long = deltas.select("left_model", "right_model", F.inline(F.array(*rows)))
    return long.groupBy("left_model", "right_model", "metric").agg(
        F.avg("delta").alias("mean_delta"),
        F.avg(F.when(F.col("delta") > 0, 1.0).when(F.col("delta").isNotNull(), 0.0)).alias("positive_fraction"),
        F.count("delta").alias("conditions"),
    )


def direction_stability(deltas: DataFrame, central: str, tol: float = 1e-12) -> DataFrame:
    """Whether each combination's delta has the central one's sign; counts and extremes.

    ``deltas`` has comparison, metric, combination, delta.
    """
    sign = lambda c: F.when(F.abs(c) <= tol, 0).otherwise(F.signum(c)).cast("int")
    keys = ["comparison", "metric"]
    base = deltas.where(F.col("combination") == central).select(*keys, sign(F.col("delta")).alias("central_sign"))
    v = deltas.join(F.broadcast(base), keys).withColumn("same", sign(F.col("delta")) == F.col("central_sign"))
    return v.groupBy(*keys, "central_sign").agg(
        F.count("*").alias("combinations"),
        F.count_if("same").alias("same_direction"),
        F.min("delta").alias("minimum_delta"),
        F.max("delta").alias("maximum_delta"),
    )


# Gate rules as (gate, metric, at least, alternative group).
GATE_RULES = (
    ("clean_guardrails", "AP", -0.002, 0),
    ("clean_guardrails", "AP75", -0.003, 0),
    ("clean_guardrails", "AP_large", -0.005, 0),
    ("failure_progress", "AP_small", 0.002, 0),
    ("failure_progress", "macro_AR100", 0.005, 0),
    ("failure_progress", "small_joint_recall50", 0.005, 0),
    ("advantage_over_control", "control_AP", -0.002, 0),
    ("advantage_over_control", "control_macro_AR100", 0.002, 1),
    ("advantage_over_control", "control_small_joint_recall50", 0.003, 2),
    ("advantage_over_control", "control_geometric_AR100", 0.0, 2),
    ("robustness", "corrupted_AP_small", -0.002, 0),
)


def apply_rules(deltas: DataFrame, rules=GATE_RULES) -> DataFrame:
    """Gate decisions from (metric, delta) rows.

    Rules of alternative group 0 must all hold; of the groups above 0 one must hold in full.
    """
    table = deltas.sparkSession.createDataFrame(list(rules), "gate string, metric string, at_least double, alternative int")
    checked = table.join(deltas, "metric").withColumn("passed", F.col("delta") >= F.col("at_least"))
    groups = checked.groupBy("gate", "alternative").agg(F.bool_and("passed").alias("ok"), F.count("*").alias("rules"))
    must = F.coalesce(F.bool_and(F.when(F.col("alternative") == 0, F.col("ok"))), F.lit(True))
    one = F.coalesce(F.bool_or(F.when(F.col("alternative") > 0, F.col("ok"))), F.lit(True))
    return groups.groupBy("gate").agg(F.sum("rules").alias("rules"), (must & one).alias("passed"))


def retention(metrics: DataFrame, clean: DataFrame, names) -> DataFrame:
    """Drop, relative drop and retention of each variant against the clean metrics (-1 if base <= 0)."""
    base = clean.select("model", *[F.col(m).alias(f"_c_{m}") for m in names])
    v = metrics.join(F.broadcast(base), "model")
    out = {}
    for m in names:
        c = F.col(f"_c_{m}")
        out[f"{m}_drop"] = c - F.col(m)
        out[f"{m}_relative_drop"] = F.when(c > 0, (c - F.col(m)) / c).otherwise(-1.0)
        out[f"{m}_retention"] = F.when(c > 0, F.col(m) / c).otherwise(-1.0)
    return v.withColumns(out).drop(*[f"_c_{m}" for m in names])


def corruption_summary(metrics: DataFrame, names) -> DataFrame:
    """Mean over severities of each family; the worst variant has the lowest AP, first severity on ties."""
    worst = F.min(F.struct("AP", "severity"))
    out = metrics.groupBy("model", "corruption").agg(
        F.count("*").alias("variants"), *[F.avg(m).alias(f"mean_{m}") for m in names], worst.alias("_w")
    )
    return out.withColumns({"worst_AP": F.col("_w.AP"), "worst_severity": F.col("_w.severity")}).drop("_w")


def measure_summary(samples: DataFrame, by: str = "model", value: str = "value") -> DataFrame:
    """Median, p90 and mean of measurement samples per model."""
    mean = samples.groupBy(by).agg(F.count(value).alias("samples"), F.avg(value).alias("mean"))
    return mean.join(quantiles(samples, value, [by], {"median": 0.5, "p90": 0.9}), by)


def measure_difference(summary: DataFrame, base: str, by: str = "model") -> DataFrame:
    """Difference and relative increase of every model against a base model."""
    ref = summary.where(F.col(by) == base).select(F.lit(0).alias("_one"), *[F.col(c).alias(f"_b_{c}") for c in ("median", "p90", "mean")])
    v = summary.withColumn("_one", F.lit(0)).join(F.broadcast(ref), "_one")
    out = {}
    for c in ("median", "p90", "mean"):
        out[f"{c}_difference"] = F.col(c) - F.col(f"_b_{c}")
        out[f"{c}_increase"] = F.when(F.col(f"_b_{c}") != 0, (F.col(c) - F.col(f"_b_{c}")) / F.col(f"_b_{c}"))
    return v.select(by, *[e.alias(n) for n, e in out.items()])


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tol: float) -> DataFrame:
    """Per column: rows only on one side, largest absolute difference, agreement within ``tol``."""
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_in_b"))
    both = a.select(*keys, *columns, F.lit(1).alias("_in_a")).join(right, keys, "full_outer")
    aggs = [F.count_if(F.col("_in_b").isNull()).alias("only_a"), F.count_if(F.col("_in_a").isNull()).alias("only_b")]
    for c in columns:
        diff = F.abs(F.col(c) - F.col(f"_b_{c}"))
        one_null = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & (F.col(c).isNull() != F.col(f"_b_{c}").isNull())
        aggs += [F.max(diff).alias(f"_m_{c}"), F.count_if(one_null).alias(f"_n_{c}")]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_m_{c}").alias("max_difference"), F.col(f"_n_{c}").alias("null_mismatches")) for c in columns]
    out = both.agg(*aggs).select("only_a", "only_b", F.inline(F.array(*rows)))
    agree = (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("null_mismatches") == 0) & (F.coalesce("max_difference", F.lit(0.0)) <= tol)
    return out.withColumn("agrees", agree)


def variant_plan(images: DataFrame, families=K.CORRUPTIONS, severities=K.SEVERITIES, seed=K.SAMPLING_SEED) -> DataFrame:
    """Every image with its fixed list of (family, severity) variants and a stable 64-bit seed (hex)."""
    variants = F.array(*[F.struct(F.lit(f).alias("corruption"), F.lit(s).alias("severity")) for f in families for s in severities])
    v = images.select("image_id", F.inline(variants))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("image_id").cast("string"), F.col("corruption"), F.col("severity").cast("string"))
    return v.withColumn("seed_hex", little_endian_seed(text))
