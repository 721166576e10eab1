"""Projections, filters, audits and row repair on images, objects, detections and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise import constants as K
from boxwise.functions.geometry import clamp, scale_of


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def canonicalize_classes(df: DataFrame, name: str = "category") -> DataFrame:
    """Add ``category_id`` from a class name or synonym; null where the class is unknown."""
    ids = {n: i for i, n in K.CATEGORIES.items()}
    ids.update({alias: ids[n] for alias, n in K.SYNONYMS.items()})
    return df.withColumn("category_id", F.try_element_at(_literal_map(ids), F.lower(F.trim(F.col(name)))))


def split_unknown(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a known class, and counts of the dropped class names."""
    unknown = df.where(F.col("category_id").isNull()).groupBy("category").agg(F.count("*").alias("dropped"))
    return df.where(F.col("category_id").isNotNull()), unknown


def clip_boxes(df: DataFrame) -> DataFrame:
    """Order the corners x1..y2, clamp them to the image and add x, y, w, h and ``valid``."""
    zero = F.lit(0.0)
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    x1 = clamp(F.least("x1", "x2"), zero, width)
    x2 = clamp(F.greatest("x1", "x2"), zero, width)
    y1 = clamp(F.least("y1", "y2"), zero, height)
    y2 = clamp(F.greatest("y1", "y2"), zero, height)
    boxed = df.withColumns({"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1})
    return boxed.withColumn("valid", (F.col("w") > 0) & (F.col("h") > 0))


def to_norm(df: DataFrame) -> DataFrame:
    """Add the normalised label form: class 0..9 and centre box in units of the image size."""
    return df.withColumns(
        {
            "class_index": F.col("category_id") - 1,
            "cx": (F.col("x") + F.col("w") / 2) / F.col("width"),
            "cy": (F.col("y") + F.col("h") / 2) / F.col("height"),
            "nw": F.col("w") / F.col("width"),
            "nh": F.col("h") / F.col("height"),
        }
    )


def from_norm(df: DataFrame) -> DataFrame:
    """Corner box of a normalised label, clamped to the pixel grid [0, W-1] x [0, H-1]."""
    zero = F.lit(0.0)
    right, bottom = F.col("width") - 1.0, F.col("height") - 1.0
    return df.withColumns(
        {
            "px1": clamp((F.col("cx") - F.col("nw") / 2) * F.col("width"), zero, right),
            "py1": clamp((F.col("cy") - F.col("nh") / 2) * F.col("height"), zero, bottom),
            "px2": clamp((F.col("cx") + F.col("nw") / 2) * F.col("width"), zero, right),
            "py2": clamp((F.col("cy") + F.col("nh") / 2) * F.col("height"), zero, bottom),
        }
    )


def with_scale(df: DataFrame) -> DataFrame:
    return df.withColumn("scale", scale_of(F.col("area")))


def clean_attributes(df: DataFrame, names=("timeofday", "weather", "scene"), lower: bool = False) -> DataFrame:
    """Trim attributes; null or blank becomes ``undefined``."""

    def clean(c: str) -> Column:
        text = F.trim(F.col(c))
        text = F.coalesce(F.nullif(text, F.lit("")), F.lit("undefined"))
        return F.lower(text) if lower else text

    return df.withColumns({c: clean(c) for c in names})


def remap_labels(dets: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Detector label -> category id; the mapping must be one-to-one onto the ten classes."""
    if sorted(mapping.values()) != sorted(K.CATEGORIES):
        raise ValueError("mapping must cover every category exactly once")
    return dets.withColumn("category_id", F.try_element_at(_literal_map(mapping), F.col("label")))


def xyxy_to_xywh(df: DataFrame) -> DataFrame:
    boxed = df.withColumns({"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    return boxed.withColumn("nonpositive", (F.col("w") <= 0) | (F.col("h") <= 0))


def audit_detections(dets: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of counts, rows that are errors). Odd sizes are counted and kept; errors are not.

    A null class is unknown; an image row that is repeated counts once.
    """
    known = images.select("image_id", "width", "height", F.lit(True).alias("_known")).dropDuplicates(["image_id"])
    v = dets.join(known, "image_id", "left")
    bad_number = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    box = [bad_number(c) for c in "xywh"]
    v = v.withColumn(
        "issue",
        F.when(F.col("_known").isNull(), "unknown_image")
        .when(F.col("category_id").isNull() | ~F.col("category_id").isin(*K.CATEGORIES), "unknown_category")
        .when(box[0] | box[1] | box[2] | box[3], "invalid_box")
        .when(bad_number("score") | (F.col("score") < 0) | (F.col("score") > 1), "invalid_score"),
    )
    outside = (
        (F.col("x") < 0)
        | (F.col("y") < 0)
        | (F.col("x") + F.col("w") > F.col("width"))
        | (F.col("y") + F.col("h") > F.col("height"))
    )
    counts = v.agg(
        F.count("*").alias("detections"),
        F.count_if(F.col("issue").isNotNull()).alias("errors"),
        F.count_if((F.col("w") < 0) | (F.col("h") < 0)).alias("negative_size"),
        F.count_if((F.col("w") == 0) | (F.col("h") == 0)).alias("zero_area"),
        F.count_if((F.col("x") < 0) | (F.col("y") < 0)).alias("negative_origin"),
        F.count_if(outside).alias("out_of_bounds"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )
    return counts, v.where(F.col("issue").isNotNull()).select(*dets.columns, "issue")


def audit_objects(objects: DataFrame, images: DataFrame) -> DataFrame:
    """Issue rows of the ground truth: (annotation_id, issue); image issues carry the image's id in its place.

    A box that is not finite is ``non_finite_box`` and judged no further. Image ids must be positive and
    unique, annotation ids too.
    """
    known = images.select("image_id", "width", "height", F.lit(True).alias("_known")).dropDuplicates(["image_id"])
    v = objects.join(known, "image_id", "left")
    outside = (
        (F.col("x") < 0)
        | (F.col("y") < 0)
        | (F.col("x") + F.col("w") > F.col("width"))
        | (F.col("y") + F.col("h") > F.col("height"))
    )
    odd = F.lit(False)
    for c in "xywh":
        odd = odd | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    checks = {
        "unknown_image": F.col("_known").isNull(),
        "unknown_category": F.col("category_id").isNull() | ~F.col("category_id").isin(*K.CATEGORIES),
        "non_positive_id": F.col("annotation_id").isNull() | (F.col("annotation_id") <= 0),
        "non_finite_box": odd,
        "invalid_box": ~odd & ((F.col("w") <= 0) | (F.col("h") <= 0)),
        "invalid_area": F.col("area").isNull() | F.isnan("area") | (F.col("area") <= 0),
        "out_of_bounds": ~odd & outside,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    rows = v.select("annotation_id", F.explode(found).alias("issue"))
    twice = objects.groupBy("annotation_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    per_image = images.groupBy("image_id").agg(F.count("*").alias("n"))
    image_issue = F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate_image_id"), F.when(F.col("image_id").isNull() | (F.col("image_id") <= 0), "non_positive_image_id")))
    of_images = per_image.select(F.col("image_id").alias("annotation_id"), F.explode(image_issue).alias("issue"))
    return rows.unionByName(twice.select("annotation_id", F.lit("duplicate_id").alias("issue"))).unionByName(of_images)


SIGNATURE = ["image_id", "category_id", "x", "y", "w", "h"]


def dedup_objects(objects: DataFrame, signature: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects without exact copies, pairs of dropped and kept ids).

    The first id per signature comes from a map-side combined minimum, so many copies
    of one object never meet in one task.
    """
    signature = signature or SIGNATURE + (["iscrowd"] if "iscrowd" in objects.columns else [])
    first = objects.groupBy(*signature).agg(F.min("annotation_id").alias("first_id"), F.count("*").alias("copies"))
    first = first.withColumnsRenamed({c: f"_s_{c}" for c in signature})
    on = None
    for c in signature:
        same = F.col(c).eqNullSafe(F.col(f"_s_{c}"))
        on = same if on is None else on & same
    marked = objects.join(first, on)
    kept = marked.where(F.col("annotation_id").eqNullSafe(F.col("first_id"))).select(*objects.columns)
    dropped = marked.where(~F.col("annotation_id").eqNullSafe(F.col("first_id"))).select(F.col("annotation_id").alias("dropped_id"), "first_id")
    return kept, dropped


def operating(dets: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Detections at or above their model's operating score (column ``model``)."""
    return dets.where(F.col("score") >= F.try_element_at(_literal_map(thresholds), F.col("model")))


def reconcile_labels(labels: DataFrame, objects: DataFrame, digits: int = 6) -> DataFrame:
    """Per image: label rows against objects in normalised form, as multisets of rounded boxes."""
    keys = ["image_id", "class_index", "cx", "cy", "nw", "nh"]

    def bag(df: DataFrame, name: str) -> DataFrame:
        rounded = [F.round(c, digits).alias(c) for c in keys[2:]]
        return df.select("image_id", "class_index", *rounded).groupBy(*keys).agg(F.count("*").alias(name))

    both = bag(labels, "n_label").join(bag(objects, "n_object"), keys, "full_outer").na.fill(0, ["n_label", "n_object"])
    per_image = both.groupBy("image_id").agg(
        F.sum("n_label").alias("label_rows"),
        F.sum("n_object").alias("object_rows"),
        F.sum(F.greatest(F.col("n_object") - F.col("n_label"), F.lit(0))).alias("missing_rows"),
        F.sum(F.greatest(F.col("n_label") - F.col("n_object"), F.lit(0))).alias("extra_rows"),
    )
    state = (
        F.when((F.col("missing_rows") == 0) & (F.col("extra_rows") == 0), "equal")
        .when(F.col("label_rows") == 0, "empty")
        .otherwise("different")
    )
    return per_image.withColumn("state", state)


def rebuild_labels(reconciled: DataFrame, objects: DataFrame) -> DataFrame:
    """Label rows rebuilt from the objects of every image that does not reconcile, bounds checked."""
    broken = reconciled.where(F.col("state") != "equal").select("image_id")
    rows = objects.join(broken, "image_id", "left_semi")
    inside = F.lit(True)
    for c in ("cx", "cy", "nw", "nh"):
        inside = inside & F.col(c).between(0.0, 1.0)
    return rows.select("image_id", "class_index", "cx", "cy", "nw", "nh", inside.alias("in_bounds"))


def base_name(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def cross_check(images: DataFrame, meta: DataFrame, fields: list[str]) -> DataFrame:
    """Mismatching fields of two image tables, joined on the file base name; long form."""
    left = images.select(base_name(F.col("file_name")).alias("name"), *[F.col(f).cast("string").alias(f"_l_{f}") for f in fields])
    right = meta.select(
        base_name(F.col("file_name")).alias("name"), *[F.col(f).cast("string").alias(f"_r_{f}") for f in fields], F.lit(True).alias("_found")
    )
    both = left.join(right, "name", "left")
    entries = [
        F.struct(F.lit(f).alias("field"), F.col(f"_l_{f}").alias("left_value"), F.col(f"_r_{f}").alias("right_value"))
        for f in fields
    ]
    long = both.select("name", "_found", F.inline(F.array(*entries)))
    return long.where(F.col("_found").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).select(
        "name",
        F.when(F.col("_found").isNull(), F.lit("missing")).otherwise(F.col("field")).alias("field"),
        "left_value",
        "right_value",
    )


def restrict(df: DataFrame, ids: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows whose key is in the id set."""
    return df.join(ids.select(key), key, "left_semi")
