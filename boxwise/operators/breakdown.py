"""Group-by breakdowns: profiles, subsets, failure rates, shares, matrices, interactions.

Rows are first reduced to counts per combination of attributes, and only those
counts are expanded into grouping sets, so a set like ``overall`` never receives
raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise import constants as K

DIMENSIONS = ("timeofday", "weather", "scene")

# The thirteen grouping sets of the failure breakdowns.
GROUPING_SETS = (
    ("overall",),
    ("timeofday",),
    ("weather",),
    ("scene",),
    ("scale",),
    ("category",),
    ("timeofday", "scale"),
    ("weather", "scale"),
    ("scene", "scale"),
    ("category", "scale"),
    ("timeofday", "category"),
    ("weather", "category"),
    ("scene", "category"),
)
THREE_WAY_SETS = (
    ("timeofday", "scale", "category"),
    ("scene", "scale", "category"),
    ("weather", "scale", "category"),
)


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, count) for several columns in one pass."""
    entries = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    reduced = df.groupBy(*fields).agg(F.count("*").alias("_n"))
    return (
        reduced.select("_n", F.inline(F.array(*entries)))
        .groupBy("field", "value")
        .agg(F.sum("_n").alias("count"))
    )


def profile(images: DataFrame, objects: DataFrame) -> DataFrame:
    """One row of data-set totals."""
    per_image = objects.groupBy("image_id").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("w") <= 0) | (F.col("h") <= 0)).alias("bad"),
        F.count_if("occluded").alias("occluded"),
        F.count_if("truncated").alias("truncated"),
    )
    return (
        images.join(per_image, "image_id", "left")
        .agg(
            F.count("*").alias("images"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("objects"),
            F.count_if(F.col("n").isNull()).alias("empty_images"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_boxes"),
            F.coalesce(F.sum("occluded"), F.lit(0)).alias("occluded"),
            F.coalesce(F.sum("truncated"), F.lit(0)).alias("truncated"),
        )
        .withColumn("objects_per_image", F.col("objects") / F.col("images"))
    )


def unpivot_dimensions(df: DataFrame, dims=DIMENSIONS) -> DataFrame:
    """Repeat each row once per dimension, with ``dimension`` and ``value``."""
    entries = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims]
    return df.select("*", F.inline(F.array(*entries)))


def condition_subsets(images: DataFrame, objects: DataFrame, min_images: int = 100) -> DataFrame:
    """Images and objects per attribute value; primary subsets are large and defined."""
    n = objects.groupBy("image_id").agg(F.count("*").alias("n"))
    counted = images.join(n, "image_id", "left").na.fill(0, ["n"])
    reduced = counted.groupBy(*DIMENSIONS).agg(F.count("*").alias("_i"), F.sum("n").alias("_o"))
    out = unpivot_dimensions(reduced).groupBy("dimension", "value").agg(
        F.sum("_i").alias("images"), F.sum("_o").alias("objects")
    )
    primary = (F.col("images") >= min_images) & (F.col("value") != "undefined")
    return out.withColumn("role", F.when(primary, "primary").otherwise("supplementary"))


def _zero_filled(counts: DataFrame, groups: DataFrame, keys: list[str], item: str, items: list) -> DataFrame:
    """Every (group, item) with its count, zero where absent; ``items`` is a fixed short list."""
    grid = groups.select(*keys, F.explode(F.array(*[F.lit(i) for i in items])).alias(item))
    return grid.join(counts, [*keys, item], "left").na.fill(0, ["count"])


def category_counts(images: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects per condition and class, zero-filled over the ten classes."""
    per_image = objects.groupBy("image_id", "category_id").agg(F.count("*").alias("n"))
    reduced = images.join(per_image, "image_id", "left").groupBy(*DIMENSIONS, "category_id").agg(F.sum("n").alias("n"))
    long = unpivot_dimensions(reduced).groupBy("dimension", "value", "category_id").agg(F.sum("n").alias("count"))
    groups = long.select("dimension", "value").distinct()
    return _zero_filled(long.where(F.col("category_id").isNotNull()), groups, ["dimension", "value"], "category_id", list(K.CATEGORIES))


def category_scale_counts(objects: DataFrame) -> DataFrame:
    """Objects per class and scale, zero-filled over both."""
    counts = objects.groupBy("scale", "category_id").agg(F.count("*").alias("count"))
    spark = objects.sparkSession
    groups = spark.createDataFrame([(s,) for s in K.SCALES], "scale string")
    return _zero_filled(counts, groups, ["scale"], "category_id", list(K.CATEGORIES))


def status_counts(rows: DataFrame, label: str = "status", by=("category_id",)) -> DataFrame:
    """Rows per label within ``by``."""
    return rows.groupBy(*by, label).agg(F.count("*").alias("count"))


def agreement_matrix(wide: DataFrame) -> DataFrame:
    """Two-model outcome matrix with its share of all objects."""
    outcome = (
        F.when(F.col("a_detected") & F.col("b_detected"), "both_detected")
        .when(F.col("a_detected"), "a_only")
        .when(F.col("b_detected"), "b_only")
        .otherwise("neither_detected")
    )
    counts = wide.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy(F.lit(0))))


def status_pairs(wide: DataFrame) -> DataFrame:
    return wide.groupBy("a_status", "b_status").agg(F.count("*").alias("count"))


def _expand(df: DataFrame, sets) -> DataFrame:
    """Repeat reduced rows once per grouping set, with ``group_type`` and ``group_value``."""

    def entry(dims) -> Column:
        if dims == ("overall",):
            return F.struct(F.lit("overall").alias("group_type"), F.lit("all").alias("group_value"))
        value = F.concat_ws("|", *[F.col(d).cast("string") for d in dims])
        return F.struct(F.lit("_x_".join(dims)).alias("group_type"), value.alias("group_value"))

    return df.select("*", F.inline(F.array(*[entry(s) for s in sets])))


ATTRIBUTES = ["timeofday", "weather", "scene", "scale", "category"]


def failure_rates(tax: DataFrame, sets=GROUPING_SETS) -> DataFrame:
    """Failure counts and rates of both models per grouping set, with distinct images."""
    a_fail, b_fail = ~F.col("a_detected"), ~F.col("b_detected")
    counted = {
        "num_gt": F.count("*"),
        "a_failures": F.count_if(a_fail),
        "b_failures": F.count_if(b_fail),
        "both_failures": F.count_if(a_fail & b_fail),
        "a_fail_b_ok": F.count_if(a_fail & ~b_fail),
        "a_ok_b_fail": F.count_if(~a_fail & b_fail),
    }
    # dealt by image once; both groupings by image below keep to that, so expanded rows aren't dealt
    reduced = tax.repartition("image_id").groupBy("image_id", *ATTRIBUTES).agg(*[c.alias(n) for n, c in counted.items()])
    sums = [F.sum(n).alias(n) for n in counted]
    per_image = _expand(reduced, sets).groupBy("group_type", "group_value", "image_id").agg(*sums)
    out = per_image.groupBy("group_type", "group_value").agg(F.count("*").alias("num_images"), *sums)
    rates = {f"{n}_rate": F.col(n) / F.col("num_gt") for n in counted if n != "num_gt"}
    return out.withColumns(rates)


def taxonomy_shares(tax: DataFrame, sets=GROUPING_SETS) -> DataFrame:
    """Taxonomy counts per grouping set: share of objects and share within A-failures."""
    reduced = tax.groupBy(*ATTRIBUTES, "a_detected", "taxonomy").agg(F.count("*").alias("n"))
    failed = F.when(~F.col("a_detected"), F.col("n")).otherwise(0)
    out = (
        _expand(reduced, sets)
        .groupBy("group_type", "group_value", "taxonomy")
        .agg(F.sum("n").alias("count"), F.sum(failed).alias("a_failure_count"))
    )
    group = W.partitionBy("group_type", "group_value")
    total, total_failed = F.sum("count").over(group), F.sum("a_failure_count").over(group)
    return out.select(
        "*",
        (F.col("count") / total).alias("share_of_gt"),
        F.when((total_failed > 0) & (F.col("a_failure_count") > 0), F.col("a_failure_count") / total_failed).alias("share_of_a_failures"),
    )


def evidence_shares(tax: DataFrame, sets=GROUPING_SETS) -> DataFrame:
    """Evidence-grade counts per grouping set; the share is over applicable objects."""
    reduced = tax.groupBy(*ATTRIBUTES, "evidence").agg(F.count("*").alias("n"))
    out = _expand(reduced, sets).groupBy("group_type", "group_value", "evidence").agg(F.sum("n").alias("count"))
    applicable = F.col("evidence") != "not_applicable"
    total = F.sum(F.when(applicable, F.col("count")).otherwise(0)).over(W.partitionBy("group_type", "group_value"))
    return out.select("*", F.when(applicable & (total > 0), F.col("count") / total).alias("share_of_applicable"))


MATRIX_SETS = (("overall",), ("timeofday",), ("weather",), ("scene",), ("scale",))


def failure_matrix(diag: DataFrame) -> DataFrame:
    """Failure types per overall and single dimension, with their share of the group."""
    reduced = diag.groupBy("timeofday", "weather", "scene", "scale", "failure_type").agg(F.count("*").alias("n"))
    out = _expand(reduced, MATRIX_SETS).groupBy("group_type", "group_value", "failure_type").agg(F.sum("n").alias("count"))
    total = F.sum("count").over(W.partitionBy("group_type", "group_value"))
    return out.withColumn("share", F.col("count") / total)


def failure_modes(diag: DataFrame) -> DataFrame:
    """A-failures per dimension value, class, error mode and failure type."""
    failed = diag.where(~F.col("a_detected"))
    keys = ["category", "a_status", "failure_type"]
    reduced = failed.groupBy("timeofday", "weather", "scene", "scale", *keys).agg(F.count("*").alias("n"))
    return _expand(reduced, MATRIX_SETS).groupBy("group_type", "group_value", *keys).agg(F.sum("n").alias("count"))


def interactions(tax: DataFrame) -> DataFrame:
    """Failure rates over the three-way condition x scale x class sets."""
    return failure_rates(tax, THREE_WAY_SETS)


def interaction_priority(rates: DataFrame, min_gt: int = 100) -> DataFrame:
    """Rank groups of a set by A-failure rate, only groups with enough objects.

    The groups of a set are bounded by the attribute values, so one window per set is small.
    """
    order = W.partitionBy("group_type").orderBy(F.desc("a_failures_rate"), "group_value")
    return rates.where(F.col("num_gt") >= min_gt).withColumn("priority_rank", F.row_number().over(order))
