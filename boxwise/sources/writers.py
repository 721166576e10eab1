"""Writers; Spark's commit protocol makes each output appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise import constants as K


def coco_entities(images: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) in document form: ids, area = w * h, box arrays, and crowd mark, flags and segmentation where the objects have them."""
    img = images.select(
        F.col("image_id").alias("id"), F.concat(F.col("image_id"), F.lit(".jpg")).alias("file_name"), "width", "height",
        F.struct("weather", "scene", "timeofday").alias("attributes"),
    )
    flags = [c for c in ("occluded", "truncated") if c in objects.columns]
    ann = objects.select(
        F.col("annotation_id").alias("id"), "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"),
        (F.col("w") * F.col("h")).alias("area"),
        (F.coalesce(F.col("iscrowd").cast("int"), F.lit(0)) if "iscrowd" in objects.columns else F.lit(0)).alias("iscrowd"),
        *([F.struct(*flags).alias("attributes")] if flags else []),
        *(["segmentation"] if "segmentation" in objects.columns else []),
    )
    return img, ann


def write_coco(images: DataFrame, objects: DataFrame, path: str, categories: dict[int, str] | None = None, per_document: int = 64) -> None:
    """Annotation documents of about ``per_document`` images each, one per line, written in parallel.

    Each document holds its images, their annotations and all categories, so ``read_coco`` reads them
    back with ``multiline=False``. Objects of images that are not listed are an error.
    """
    categories = categories or K.CATEGORIES
    img, ann = coco_entities(images, objects)
    shards = max(1, -(-img.count() // per_document))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).alias("shard")
    i = img.groupBy(shard("id")).agg(F.sort_array(F.collect_list(F.struct(*img.columns))).alias("images"))
    a = ann.groupBy(shard("image_id")).agg(F.sort_array(F.collect_list(F.struct(*ann.columns))).alias("annotations"))
    known = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(n).alias("name")) for k, n in sorted(categories.items())])
    both = i.join(a, "shard", "full")
    stray = F.exists("annotations", lambda x: ~F.exists("images", lambda m: m["id"] == x["image_id"]))
    listed = F.when(F.coalesce(F.size("images"), F.lit(0)) == 0, F.raise_error(F.lit("an object's image is not listed"))).when(stray, F.raise_error(F.lit("an object's image is not listed"))).otherwise(F.col("images"))
    both.select(listed.alias("images"), F.coalesce("annotations", F.array().cast(both.schema["annotations"].dataType)).alias("annotations"), known.alias("categories")).write.mode("errorifexists").json(path)


def norm_label_lines(labels: DataFrame, digits: int = 8) -> DataFrame:
    """One row per image with its label text, lines in annotation order."""
    number = lambda c: F.format_string(f"%.{digits}f", F.col(c))
    line = F.concat_ws(" ", F.col("class_index").cast("string"), *[number(c) for c in ("cx", "cy", "nw", "nh")])
    rows = labels.select("image_id", F.struct("annotation_id", line.alias("line")).alias("r"))
    return rows.groupBy("image_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n").alias("text")
    )


def write_result(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a result table; a failed job leaves no committed output."""
    writer = df.write.mode("errorifexists").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
