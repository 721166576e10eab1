"""Crop planning, label transforms into crops, scale and context shift, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise import constants as K
from boxwise.functions.geometry import clamp, letterbox_scale, scale_of
from boxwise.functions.hashing import hash_uniform
from boxwise.operators.grid import overlap_join, touching
from boxwise.operators.matching import hot_images
from boxwise.operators.ranking import attach, distribution


def plan_crops(targets: DataFrame, policy: dict | None = None, seed=K.SAMPLING_SEED) -> DataFrame:
    """Crop window per target: context by group policy, 16:9, target kept inside, jittered.

    ``targets`` has annotation_id, image_id, failure_group, x, y, w, h, width, height.
    Groups outside the policy use the control values. Draws are hash uniforms.
    """
    policy = K.CROP_POLICY if policy is None else policy

    def setting(i: int) -> Column:
        out = F.lit(K.CONTROL_CROP[i])
        for group, values in policy.items():
            out = F.when(F.col("failure_group") == group, F.lit(values[i])).otherwise(out)
        return out

    iw, ih = F.col("width").cast("double"), F.col("height").cast("double")
    x, y, w, h = (F.col(c) for c in "xywh")
    u = lambda name: hash_uniform(seed, name, F.col("annotation_id"))
    factor = setting(2) + (setting(3) - setting(2)) * u("crop_factor")
    v = targets.withColumn("_f", factor).withColumns({"_min": setting(0), "_max": setting(1)})
    tall = F.least(F.greatest(F.col("_min"), h * F.col("_f"), w * F.col("_f") * 9.0 / 16.0), F.col("_max"), ih)
    v = v.withColumn("_t", tall)
    wide = F.col("_t") * 16.0 / 9.0
    v = v.withColumns(
        {
            "_w": F.when(wide > iw, iw).otherwise(wide),
            "_h": F.when(wide > iw, F.least(ih, iw * 9.0 / 16.0)).otherwise(F.col("_t")),
        }
    )
    side = lambda c, limit, box: F.least(limit, F.greatest(F.lit(1.0), F.bround(F.greatest(F.least(limit, F.col(c)), F.least(limit, box)))))
    v = v.withColumns({"crop_width": side("_w", iw, w), "crop_height": side("_h", ih, h)})

    def start(p: Column, size: Column, full: Column, crop: Column, name: str) -> Column:
        jitter = (u(name) * 2.0 - 1.0) * K.CENTRE_JITTER * crop
        wanted = p + size / 2.0 - crop / 2.0 + jitter
        low, high = F.greatest(F.lit(0.0), p + size - crop), F.least(p, full - crop)
        placed = F.when(low <= high, clamp(wanted, low, high)).otherwise(clamp(wanted, F.lit(0.0), full - crop))
        return F.least(F.greatest(F.lit(0.0), F.bround(placed)), full - crop)

    v = v.withColumns(
        {
            "crop_x0": start(x, w, iw, F.col("crop_width"), "crop_x"),
            "crop_y0": start(y, h, ih, F.col("crop_height"), "crop_y"),
        }
    )
    return v.drop("_f", "_min", "_max", "_t", "_w", "_h")


def _valid_objects(objects: DataFrame) -> DataFrame:
    return objects.where((F.col("w") > 0) & (F.col("h") > 0)).select(
        "image_id",
        F.col("annotation_id").alias("object_id"),
        F.col("category_id").alias("object_category_id"),
        *[F.col(c).alias(f"o{c}") for c in "xywh"],
    )


def crop_neighbours(crops: DataFrame, objects: DataFrame, overlapping: bool = False) -> DataFrame:
    """Every valid object of the target's image against the crop box, the target included.

    With ``overlapping`` only objects that the crop box overlaps: in images with very many crops or objects they meet on a grid of
    several levels, so these don't pair all of them; in others the rows of a grid would be many more than the pairs.
    """
    other = _valid_objects(objects)
    box = crops.select("annotation_id", "image_id", "crop_x0", "crop_y0", "crop_width", "crop_height")
    if overlapping:
        side = box.select("*", *[F.col(c).alias(f"_c{n}") for n, c in zip("xywh", ("crop_x0", "crop_y0", "crop_width", "crop_height"))])
        hot = hot_images(box, other)
        if hot is None:
            v = side.join(other, "image_id").where(touching("_c", "o"))
        else:
            v = side.join(hot, "image_id", "left_anti").join(other.join(hot, "image_id", "left_anti"), "image_id").where(touching("_c", "o"))
            dense = other.join(hot, "image_id", "left_semi").withColumnRenamed("image_id", "_image")
            v = v.unionByName(overlap_join(side.join(hot, "image_id", "left_semi"), dense, "_c", "o").drop("_image"))
        v = v.drop("_cx", "_cy", "_cw", "_ch")
    else:
        v = box.join(other, "image_id")
    x1, y1 = F.col("crop_x0") + F.col("crop_width"), F.col("crop_y0") + F.col("crop_height")
    zero = F.lit(0.0)
    v = v.withColumns(
        {
            "ix": F.greatest(F.col("ox"), F.col("crop_x0")),
            "iy": F.greatest(F.col("oy"), F.col("crop_y0")),
            "iw": F.greatest(zero, F.least(F.col("ox") + F.col("ow"), x1) - F.greatest(F.col("ox"), F.col("crop_x0"))),
            "ih": F.greatest(zero, F.least(F.col("oy") + F.col("oh"), y1) - F.greatest(F.col("oy"), F.col("crop_y0"))),
        }
    )
    v = v.withColumn("visible", F.col("iw") * F.col("ih") / (F.col("ow") * F.col("oh")))
    cx, cy = F.col("ox") + F.col("ow") / 2.0, F.col("oy") + F.col("oh") / 2.0
    inside = cx.between(F.col("crop_x0"), x1) & cy.between(F.col("crop_y0"), y1)
    v = v.withColumns(
        {
            "is_target": F.col("object_id") == F.col("annotation_id"),
            "centre_inside": inside,
            "retained": F.col("visible") >= 0.5,
            "removed": F.col("iw") * F.col("ih") <= 0,
            "clipped": (F.col("iw") * F.col("ih") > 0) & (F.col("visible") < 1.0 - 1e-12),
        }
    )
    kept = inside & (F.col("visible") >= K.MIN_VISIBLE) & (F.col("iw") >= K.MIN_SIDE) & (F.col("ih") >= K.MIN_SIDE)
    return v.withColumn("supervised", F.col("is_target") | kept)


def crop_labels(crops: DataFrame, objects: DataFrame) -> DataFrame:
    """Normalised labels inside each crop; the target is always kept once."""
    v = crop_neighbours(crops, objects, overlapping=True).where(F.col("supervised") & (F.col("iw") > 0) & (F.col("ih") > 0))
    return v.select(
        "annotation_id",
        "object_id",
        "is_target",
        (F.col("object_category_id") - 1).alias("class_index"),
        ((F.col("ix") - F.col("crop_x0") + F.col("iw") / 2.0) / F.col("crop_width")).alias("cx"),
        ((F.col("iy") - F.col("crop_y0") + F.col("ih") / 2.0) / F.col("crop_height")).alias("cy"),
        (F.col("iw") / F.col("crop_width")).alias("nw"),
        (F.col("ih") / F.col("crop_height")).alias("nh"),
    )


def crop_context(crops: DataFrame, objects: DataFrame) -> DataFrame:
    """Per target: sizes in three coordinate spaces, amplification, margins, neighbours kept."""
    pairs = crop_neighbours(crops, objects, overlapping=True)
    near = ~F.col("is_target")
    target = lambda c: F.max(F.when(F.col("is_target"), F.col(c))).alias(f"t{c}")
    per = pairs.groupBy("annotation_id").agg(
        F.count_if(near & (F.col("iw") * F.col("ih") > 0)).alias("_met"),
        F.count_if(near & F.col("retained")).alias("retained_neighbor_count"),
        F.count_if(near & F.col("clipped")).alias("boundary_clipped_objects"),
        F.count_if("supervised").alias("_supervised"),
        F.count_if("is_target").alias("_own_met"),
        *[target(c) for c in ("ix", "iy", "iw", "ih")],
    )
    # objects off the crop are known by number: those of the image, less the target, less those that were met
    valid = _valid_objects(objects)
    counts = valid.groupBy("image_id").agg(F.count("*").alias("_n"))
    own = valid.select("image_id", F.col("object_id").alias("annotation_id"), F.lit(1).alias("_own"))
    v = crops.join(counts, "image_id").join(own, ["image_id", "annotation_id"], "left").join(per, "annotation_id", "left")
    v = v.na.fill(0, ["_own", "_met", "retained_neighbor_count", "boundary_clipped_objects", "_supervised", "_own_met"])
    v = v.withColumn("source_neighbor_count", F.col("_n") - F.col("_own")).withColumn("fully_removed_objects", F.col("source_neighbor_count") - F.col("_met"))
    # the target is supervised wherever the crop lies
    v = v.withColumn("crop_object_count", F.col("_supervised") + F.col("_own") - F.col("_own_met")).drop("_n", "_own", "_met", "_supervised", "_own_met")
    full = letterbox_scale(F.col("width"), F.col("height"))
    zoom = letterbox_scale(F.col("crop_width"), F.col("crop_height"))
    area = F.col("w") * F.col("h")
    crop_area = F.col("tiw") * F.col("tih")
    short, crop_short = F.least("w", "h"), F.least("tiw", "tih")
    view = F.col("crop_width") * F.col("crop_height")
    margin = F.least(
        F.col("tix") - F.col("crop_x0"),
        F.col("tiy") - F.col("crop_y0"),
        F.col("crop_x0") + F.col("crop_width") - F.col("tix") - F.col("tiw"),
        F.col("crop_y0") + F.col("crop_height") - F.col("tiy") - F.col("tih"),
    )
    n = F.col("source_neighbor_count")
    return v.withColumns(
        {
            "crop_area_over_source_area": view / (F.col("width") * F.col("height")),
            "target_area_over_crop_area": crop_area / view,
            "short_side_amplification": crop_short * zoom / (short * full),
            "area_amplification": crop_area * zoom * zoom / (area * full * full),
            "original_scale": scale_of(area),
            "crop_native_scale": scale_of(crop_area),
            "full_scene_network_scale": scale_of(area * full * full),
            "crop_network_scale": scale_of(crop_area * zoom * zoom),
            "neighbor_retention_fraction": F.when(n > 0, F.col("retained_neighbor_count") / n),
            "minimum_context_margin": margin / crop_short,
            "objects_per_view_change": F.col("crop_object_count") - (n + 1),
        }
    ).drop("tix", "tiy", "tiw", "tih")


SHIFT_MEASURES = (
    "crop_area_over_source_area",
    "target_area_over_crop_area",
    "short_side_amplification",
    "area_amplification",
    "neighbor_retention_fraction",
    "minimum_context_margin",
    "objects_per_view_change",
)


def crop_shift_summary(ctx: DataFrame, by: list[str]) -> DataFrame:
    """Per group: small targets that cease to be small, weighted neighbour retention, ratios."""
    small = F.col("original_scale") == "small"
    ceased = small & (F.col("crop_network_scale") != "small")
    out = ctx.groupBy(*by).agg(
        F.count("*").alias("targets"),
        F.count_if(small).alias("original_small"),
        F.count_if(ceased).alias("ceased_small"),
        F.sum("source_neighbor_count").alias("neighbors"),
        F.sum("retained_neighbor_count").alias("retained"),
    )
    return out.withColumns(
        {
            "ceased_fraction": F.when(F.col("original_small") > 0, F.col("ceased_small") / F.col("original_small")),
            "retention": F.when(F.col("neighbors") > 0, F.col("retained") / F.col("neighbors")),
        }
    )


def crop_shift_distributions(ctx: DataFrame, by: list[str]) -> DataFrame:
    """The seven measures' distributions per group, in long form: one pass over stacked rows."""
    entries = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in SHIFT_MEASURES]
    long = ctx.select(*by, F.inline(F.array(*entries)))
    return distribution(long, "v", [*by, "measure"])


def scale_transitions(ctx: DataFrame) -> DataFrame:
    """Counts of (source scale, target scale) over three coordinate-space pairs."""
    pair = lambda s, a, t, b: F.struct(
        F.lit(s).alias("source_space"), F.col(a).alias("source_scale"), F.lit(t).alias("target_space"), F.col(b).alias("target_scale")
    )
    rows = F.array(
        pair("original_image", "original_scale", "crop_before_resize", "crop_native_scale"),
        pair("original_image", "original_scale", "network_input", "crop_network_scale"),
        pair("full_scene_network_input", "full_scene_network_scale", "network_input", "crop_network_scale"),
    )
    scales = ["original_scale", "crop_native_scale", "full_scene_network_scale", "crop_network_scale"]
    reduced = ctx.groupBy(*scales).agg(F.count("*").alias("n"))
    keys = ["source_space", "source_scale", "target_space", "target_scale"]
    out = reduced.select("n", F.inline(rows)).groupBy(*keys).agg(F.sum("n").alias("objects"))
    total = F.sum("objects").over(W.partitionBy("source_space", "source_scale", "target_space"))
    return out.withColumn("fraction_within_source_scale", F.col("objects") / total)


def exposure_summary(views: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """Exposure per training arm.

    ``views``: arm, view_id, image_id, kind (original or crop), width, height.
    ``labels``: view_id, class_index, nw, nh. ``targets``: annotation_id, image_id.
    """
    per_view = labels.groupBy("view_id").agg(F.count("*").alias("n"))
    v = views.join(per_view, "view_id", "left").na.fill(0, ["n"])
    source = v.groupBy("arm", "image_id").agg(
        F.count("*").alias("views"),
        F.count_if(F.col("kind") == "original").alias("originals"),
        F.count_if(F.col("kind") == "crop").alias("crops"),
        F.sum("n").alias("objects"),
        F.sum(F.col("width").cast("double") * F.col("height")).alias("pixels"),
    )
    per_image = targets.groupBy("image_id").agg(F.count("*").alias("targets"))
    source = source.join(per_image, "image_id", "left").na.fill(0, ["targets"])
    # A target is seen once per original view of its image, and once in its own crop.
    out = source.groupBy("arm").agg(
        F.sum("views").alias("training_views"),
        F.sum("originals").alias("original_views"),
        F.sum("crops").alias("object_centric_views"),
        F.count("*").alias("unique_source_images"),
        F.sum("objects").alias("total_supervised_objects"),
        F.sum(F.col("targets") * F.col("originals") + F.col("crops")).alias("target_objects"),
        F.sum("pixels").alias("raw_input_pixels"),
        F.max("views").alias("maximum_source_exposures"),
    )
    n, px = F.col("total_supervised_objects"), F.col("raw_input_pixels")
    network = F.col("training_views") * K.NETWORK_SIZE * K.NETWORK_SIZE
    return out.withColumns(
        {
            "non_target_objects": n - F.col("target_objects"),
            "objects_per_view": n / F.col("training_views"),
            "network_input_pixels": network,
            "objects_per_million_raw_pixels": n / px * 1e6,
            "objects_per_million_network_pixels": n / network * 1e6,
            "mean_source_exposures": F.col("training_views") / F.col("unique_source_images"),
        }
    )


def source_exposure_histogram(views: DataFrame) -> DataFrame:
    """How many source images are shown how often."""
    per = views.groupBy("arm", "image_id").agg(F.count("*").alias("exposures"))
    return per.groupBy("arm", "exposures").agg(F.count("*").alias("source_images"))


def objects_per_view_histogram(views: DataFrame, labels: DataFrame) -> DataFrame:
    """How many views carry how many objects, zero included."""
    n = labels.groupBy("view_id").agg(F.count("*").alias("objects_in_view"))
    v = views.join(n, "view_id", "left").na.fill(0, ["objects_in_view"])
    return v.groupBy("arm", "objects_in_view").agg(F.count("*").alias("views"))


def label_exposure(views: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of each class and scale (native and letterboxed) among an arm's labels, zero-filled."""
    v = labels.join(views.select("view_id", "arm", "width", "height"), "view_id")
    zoom = letterbox_scale(F.col("width"), F.col("height"))
    area = F.col("nw") * F.col("width") * F.col("nh") * F.col("height")
    v = v.select("arm", "class_index", scale_of(area).alias("native"), scale_of(area * zoom * zoom).alias("network"))
    reduced = v.groupBy("arm", "class_index", "native", "network").agg(F.count("*").alias("n"))
    entry = lambda kind, item: F.struct(F.lit(kind).alias("kind"), item.cast("string").alias("item"))
    long = reduced.select(
        "arm", "n", F.inline(F.array(entry("class", F.col("class_index")), entry("native_scale", F.col("native")), entry("network_scale", F.col("network"))))
    )
    counts = long.groupBy("arm", "kind", "item").agg(F.sum("n").alias("count"))
    items = [F.struct(F.lit("class").alias("kind"), F.lit(str(i)).alias("item")) for i in range(10)]
    items += [F.struct(F.lit(k).alias("kind"), F.lit(s).alias("item")) for k in ("native_scale", "network_scale") for s in K.SCALES]
    grid = views.select("arm").distinct().select("arm", F.inline(F.array(*items)))
    out = grid.join(counts, ["arm", "kind", "item"], "left").na.fill(0, ["count"])
    total = F.sum("count").over(W.partitionBy("arm", "kind"))
    return out.withColumn("fraction", F.when(total > 0, F.col("count") / total))
