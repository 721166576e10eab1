"""Detection views derived from the star-schema tables.

The tables hold no boxes, so images, objects and detections are projected from
``orders`` and ``lineitem`` by integer formulas, which any SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Multipliers that make the two detectors err on different objects.
DETECTOR_KEYS = {"a": (7, 3, 11), "b": (13, 9, 17)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """Ground-truth objects from ``lineitem``."""
    return with_boxes(boxes(spark, folder))


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """What the columns of objects follow from: two windows share one shuffle by image."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), "*"
    )
    pk, sk, ln, rn = F.col("pk"), F.col("sk"), F.col("ln"), F.col("rn")
    small = (pk + sk) % 2 == 0
    base = rows.select(
        "image_id",
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_linenumber").alias("ln"),
        F.row_number().over(W.partitionBy("image_id").orderBy(*order)).alias("rn"),
    ).select(
        "image_id", "pk", "sk", "rn",
        (1 + pk % 10).alias("c0"),
        ((pk * 37 + ln * 211 + rn * 89) % 1000).alias("x0"),
        ((sk * 53 + ln * 97 + rn * 41) % 520).alias("y0"),
        F.when(small, 6 + (pk * 7 + sk) % 22).otherwise(24 + (pk * 7 + sk) % 180).alias("w0"),
        F.when(small, 6 + (sk * 11 + rn * 13) % 22).otherwise(24 + (sk * 11 + rn * 13) % 160).alias("h0"),
    )
    before = W.partitionBy("image_id").orderBy("rn")
    beside = F.col("rn") % 4 == 0
    pick = lambda c, step: F.when(beside, F.lag(c).over(before) + step).otherwise(F.col(c))
    return base.select(
        "image_id", "pk", "sk", "rn",
        pick("c0", 0).cast("int").alias("category_id"),
        pick("x0", 1).alias("xi"), pick("y0", 1).alias("yi"), pick("w0", 0).alias("wi"), pick("h0", 0).alias("hi"),
    )


def with_boxes(boxed: DataFrame) -> DataFrame:
    """Objects from ``boxes``, by functions of a row."""
    return boxed.select(
        (F.col("image_id") * 1024 + F.col("rn")).alias("annotation_id"),
        "image_id", "category_id", "pk", "sk", "rn",
        *[F.col(f"{c}i").cast("double").alias(c) for c in "xywh"],
        (F.col("wi") * F.col("hi")).cast("double").alias("area"),
        "xi", "yi", "wi", "hi",
    )


def detections(spark: SparkSession, folder: str, model: str, source: DataFrame | None = None) -> DataFrame:
    """Detections of a model: up to two per object in one pass, and background boxes."""
    k1, k2, k3 = DETECTOR_KEYS[model]
    src = source if source is not None else objects(spark, folder)
    pk, sk, rn, v, s = (F.col(c) for c in ("pk", "sk", "rn", "v", "s"))
    rows = src.withColumns(
        {"v": (pk * k1 + sk * k2 + rn * k3) % 10, "s": (pk * k3 + sk * k1 + rn * k2) % 700}
    ).where("v <> 0")
    index = F.col("image_id") * 4096 + rn * 2

    def det(pi, category, s1000, x10, y10, w10, h10):
        box = {"x": x10, "y": y10, "w": w10, "h": h10}
        return F.struct(
            pi.alias("prediction_index"), F.col("image_id"), category.cast("int").alias("category_id"),
            (s1000.cast("double") / 1000.0).alias("score"),
            *[(b.cast("double") / 10.0).alias(n) for n, b in box.items()],
        )

    x10, y10, w10, h10 = (F.col(f"{c}i") * 10 for c in "xywh")
    category = F.col("category_id")
    main = det(
        index,
        F.when(v == 3, 1 + category % 10).otherwise(category),
        F.when(v == 1, 20 + s % 180).otherwise(300 + s),
        x10 + F.when(v == 2, F.col("wi") * 6).otherwise(F.col("wi")),
        y10, w10, h10,
    )
    weaker = det(index + 1, category, 250 + s % 50, x10 + F.col("wi") * 2, y10, w10, h10)
    found = rows.select(F.inline(F.when(v == 4, F.array(main, weaker)).otherwise(F.array(main))))
    img = F.col("image_id")
    background = src.where(img % 3 == 0).select("image_id").distinct().select(
        F.inline(F.array(det(img * 4096, 1 + img % 10, 300 + img % 700, F.lit(11000), F.lit(6000), F.lit(400), F.lit(400))))
    )
    return found.unionByName(background)


def images(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_custkey") % 5
    names = ("daytime", "night", "dawn", "dusk")
    part = F.lit("undefined")
    for i in range(len(names) - 1, -1, -1):
        part = F.when(key == i, names[i]).otherwise(part)
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.lit(1280).alias("width"),
        F.lit(720).alias("height"),
        part.alias("timeofday"),
        F.col("o_orderpriority").alias("weather"),
        F.col("o_orderstatus").alias("scene"),
        F.when(F.col("o_orderkey") % 14 == 0, "dev").otherwise("core").alias("split"),
    )
