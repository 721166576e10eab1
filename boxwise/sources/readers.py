"""File readers: box documents, label records, detections, id sets, label text, tables.

A JSON document is one record to Spark and so one task; read such a file once and
write it to Parquet before heavy use. Readers also take one document per line, which
splits over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from boxwise.session import materialize

_COCO = """
images array<struct<id: bigint, file_name: string, width: int, height: int,
  attributes: struct<weather: string, scene: string, timeofday: string>>>,
annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>,
  area: double, iscrowd: int, occluded: boolean, truncated: boolean,
  attributes: struct<occluded: boolean, truncated: boolean>, segmentation: array<array<double>>>>,
categories array<struct<id: int, name: string>>
"""
_DETECTION = "struct<image_id: bigint, category_id: int, bbox: array<double>, score: double, segmentation: array<array<double>>>"


def _present(column, message: str):
    """A column that must not be null; a null ends the job with the message."""
    return F.coalesce(column, F.raise_error(F.lit(message)))


def _box(col: str):
    return [F.get(F.col(col), i).alias(n) for i, n in enumerate("xywh")]


def read_coco(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, objects, categories) of annotation documents; several documents may repeat the categories.

    A document that is broken or lacks one of the three arrays is an error. Flags are read from an
    annotation's ``attributes`` or from the annotation itself.
    """
    read = spark.read.schema(_COCO).json(path, multiLine=multiline, mode="FAILFAST")
    parts = ("images", "annotations", "categories")
    lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in parts]), lambda x: x.isNotNull())
    checked = F.when(F.size(lacks) > 0, F.raise_error(F.concat(F.lit("an annotation document lacks "), F.array_join(lacks, ", "))))
    # each part carries the check of all, as a plan may read one of them only
    doc = read.select(*[F.coalesce(checked.cast(read.schema[c].dataType), F.col(c)).alias(c) for c in parts])
    attribute = lambda n: F.coalesce(F.nullif(F.trim(F.col(f"attributes.{n}")), F.lit("")), F.lit("undefined")).alias(n)
    images = doc.select(F.inline("images")).select(
        F.col("id").alias("image_id"), "file_name", "width", "height", *[attribute(n) for n in ("weather", "scene", "timeofday")]
    )
    objects = doc.select(F.inline("annotations")).select(
        F.col("id").alias("annotation_id"), "image_id", "category_id", *_box("bbox"), "area",
        F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"),
        *[F.coalesce(f"attributes.{c}", c).alias(c) for c in ("occluded", "truncated")], "segmentation",
    )
    categories = doc.select(F.inline("categories")).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return images, objects, categories.distinct()


_BOX_LABELS = """
name string, attributes struct<weather: string, scene: string, timeofday: string>,
labels array<struct<id: string, category: string, box2d: struct<x1: double, y1: double, x2: double, y2: double>,
  attributes: struct<occluded: boolean, truncated: boolean>>>
"""


def in_file_order(records: DataFrame, name: str) -> DataFrame:
    """Rows read from files, numbered from 1 by path, then place in the file; written once, so that the numbers stay.

    Rows of a block of a file are numbered where they are read; only a row per block is counted up.
    """
    block = ["_path", "_start"]
    placed = materialize(
        records.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    )
    sizes = placed.groupBy(*block).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(*block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*block, (before - F.col("_first") + 1).alias("_offset"))
    return placed.join(offsets, block).withColumn(name, F.col("_row") + F.col("_offset")).drop(*block, "_row", "_offset")


def read_box_labels(spark: SparkSession, path: str, multiline: bool = True, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images, labelled corner boxes) of a list of per-image label records.

    With ``numbered`` both have an image_id, the place of the record in its file and of the file by path, from 1. A
    record without a name is an error then.
    """
    records = spark.read.schema(_BOX_LABELS).json(path, multiLine=multiline, mode="FAILFAST")
    key = ["name"]
    if numbered:
        records = in_file_order(records.withColumn("name", _present(F.nullif("name", F.lit("")), "a label record has no name")), "image_id")
        key = ["image_id", "name"]
    images = records.select(*key, *[f"attributes.{n}" for n in ("weather", "scene", "timeofday")])
    label = records.select(*key, F.posexplode("labels").alias("label_index", "l")).where(F.col("l.box2d").isNotNull())
    boxes = label.select(
        *key, "label_index", "l.category", *[f"l.box2d.{c}" for c in ("x1", "y1", "x2", "y2")],
        F.coalesce("l.attributes.occluded", F.lit(False)).alias("occluded"),
        F.coalesce("l.attributes.truncated", F.lit(False)).alias("truncated"),
    )
    return images, boxes


_POLYGON_LABELS = """
size struct<width: int, height: int>, tags array<struct<name: string, value: string>>,
objects array<struct<id: bigint, classTitle: string, geometryType: string,
  points: struct<exterior: array<array<double>>>, tags: array<struct<name: string, value: string>>>>
"""


def read_polygon_labels(spark: SparkSession, folder: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(images, rectangle objects) of a folder with one annotation file per image.

    The ``attributes`` tag of an object may be a Python dict literal; flags are read by pattern.
    """
    records = spark.read.schema(_POLYGON_LABELS).json(folder, multiLine=multiline, mode="FAILFAST").withColumn("file", F.input_file_name())
    tag = lambda col, n: F.get(F.filter(F.col(col), lambda t: t["name"] == n), F.lit(0))["value"]
    images = records.select("file", "size.width", "size.height", *[tag("tags", n).alias(n) for n in ("weather", "scene", "timeofday")])
    o = records.select("file", F.posexplode("objects").alias("object_index", "o")).select("file", "object_index", "o.*")
    rect = o.where((F.lower("geometryType") == "rectangle") & (F.size("points.exterior") >= 2))
    flag = lambda n: F.lower(F.regexp_extract(F.coalesce(tag("tags", "attributes"), F.lit("")), rf"(?i)['\"]{n}['\"]\s*:\s*(true|false)", 1)) == "true"
    point = lambda i, j: F.get(F.get(F.col("points.exterior"), F.lit(i)), F.lit(j))
    objects = rect.select(
        "file", "object_index", F.col("id").alias("object_id"), F.col("classTitle").alias("category"),
        point(0, 0).alias("x1"), point(0, 1).alias("y1"), point(1, 0).alias("x2"), point(1, 1).alias("y2"),
        flag("occluded").alias("occluded"), flag("truncated").alias("truncated"),
    )
    return images, objects


def read_detections(spark: SparkSession, path: str, model: str, one_per_line: bool = False) -> DataFrame:
    """Detections of a bare list or {"predictions": [...]}; the list position is kept.

    The position counts from 0 in each document, so it is unique in one document only; ``number_detections``
    makes it unique by image. A broken document, or one without such a list, is an error.
    """
    text = spark.read.text(path, wholetext=not one_per_line).where(F.trim("value") != "")
    strict = {"mode": "FAILFAST"}
    listed = F.from_json("value", f"array<{_DETECTION}>", strict)
    named = F.from_json("value", f"predictions array<{_DETECTION}>", strict)["predictions"]
    rows = _present(F.when(F.ltrim("value").startswith("["), listed).otherwise(named), "a detection document has no list")
    d = text.select(F.xxhash64(F.col("_metadata.file_path"), "value").alias("document"), F.posexplode(rows).alias("prediction_index", "d")).select("document", "prediction_index", "d.*")
    return d.select(
        "document",
        F.lit(model).alias("model"), F.col("prediction_index").cast("long").alias("prediction_index"), "image_id", "category_id", "score",
        *_box("bbox"), F.col("segmentation").alias("polygons"),
    )


def number_detections(dets: DataFrame) -> DataFrame:
    """Detections of several documents with an index of its own for each one of an image: (image_id, prediction_index) is a key."""
    order = W.partitionBy("model", "image_id").orderBy("document", "prediction_index")
    return dets.withColumn("prediction_index", (F.row_number().over(order) - 1).cast("long")).drop("document")


def read_norm_labels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of a folder of normalised label files, one per image.

    A line is a class and a box in at least five fields; the class may be written as a whole number with a
    fraction of zero. Blank lines are skipped; all other lines are in the second table with name and text.
    """
    raw = spark.read.text(folder).where(F.trim("value") != "").select(F.input_file_name().alias("file"), "value", F.split(F.trim("value"), r"\s+").alias("p"))
    number = lambda i: F.get(F.col("p"), i).try_cast("double")
    rows = raw.select(
        F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1).alias("name"), "value", F.when(number(0) == F.floor(number(0)), number(0).try_cast("int")).alias("class_index"),
        number(1).alias("cx"), number(2).alias("cy"), number(3).alias("nw"), number(4).alias("nh"),
    )
    finite = F.lit(True)
    for c in ("cx", "cy", "nw", "nh"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = F.coalesce(F.col("class_index").isNotNull() & finite & (F.col("nw") > 0) & (F.col("nh") > 0), F.lit(False))
    return rows.where(good).drop("value"), rows.where(~good).select("name", F.col("value").alias("line"))


# Names under which an id list may be stored.
ID_LIST_NAMES = ("image_ids", "annotation_ids", "ids", "train_core_image_ids", "train_dev_image_ids")


def read_id_set(spark: SparkSession, path: str, name: str = "image_id", one_per_line: bool = False) -> DataFrame:
    """Ids of a bare list, a named list, or the only list of a document; elements may be {id}.

    A broken document, one without a list, an element that is no id, and a repeated id are errors.
    """
    value = F.ltrim("value")
    text = spark.read.text(path, wholetext=not one_per_line).select(value.alias("value")).where("value <> ''")
    members = F.when(~F.col("value").startswith("["), F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}))
    named = F.coalesce(*[F.try_element_at(members, F.lit(n)) for n in ID_LIST_NAMES])
    lists = F.map_values(F.map_filter(members, lambda _, v: v.startswith("[")))
    only = F.when(F.size(lists) == 1, F.get(lists, F.lit(0)))
    body = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.coalesce(named, only))
    listed = F.from_json(_present(body, "an id document has no list"), "array<string>", {"mode": "FAILFAST"})
    items = text.select(F.explode(listed).alias("item"))
    nested = F.coalesce(F.get_json_object("item", "$.id"), F.col("item"))
    ids = items.select(_present(nested.try_cast("long"), "an element of an id list is no id").alias(name))
    copies = ids.groupBy(name).agg(F.count("*").alias("copies"))
    return copies.select(F.when(F.col("copies") == 1, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("repeated id "), F.col(name)))).alias(name))


def repeated_ids(ids: DataFrame, name: str = "image_id") -> DataFrame:
    return ids.groupBy(name).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, bad lines fail."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_table_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header; columns are checked by name, empty cells are null."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.csv(path, header=True).columns
    missing = [f.name for f in want if f.name not in header]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want])
