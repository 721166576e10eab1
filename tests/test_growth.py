"""What must not grow faster than the tables: measures in join conditions, rows dealt twice, tables nobody asked for."""

import random
import re

from pyspark.sql import functions as F

from boxwise.catalog.views import Each
from boxwise.operators import breakdown as B
from boxwise.operators import crops as CR
from boxwise.operators import grid as G
from boxwise.operators import matching as M
from boxwise.operators import ranking as RK
from boxwise.operators import risk as RI
from tests.test_matching import frames, pairs, scene


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_iou_is_no_join_condition(spark):
    o, d = frames(spark, *scene(3))
    join = re.search(r"Join Inner.*", plan(M.iou_pairs(o, d, 0.5, hot=None))).group()
    assert "/" not in join and "CASE" not in join


def test_a_table_per_detector_on_demand(spark):
    made = []
    tables = Each(lambda m: made.append(m) or spark.range(3))
    assert tables["a"].count() == tables["a"].count() == 3 and made == ["a"]


def test_hot_pairs_are_written_after_their_threshold(spark, monkeypatch):
    written = []
    keep = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: written.append(keep(df)) or written[-1])
    o, d = frames(spark, *scene(4))
    hot = o.select("image_id").distinct()
    want = pairs(M.iou_pairs(o, d, 0.5, True, None))
    assert pairs(M.iou_pairs(o, d, 0.5, True, hot)) == want
    assert sum(w.count() for w in written) == len(want)


def test_failure_rates_deal_rows_by_image_only(spark):
    rows = [(i % 7, "day" if i % 7 < 3 else "night", "w", "s", ["small", "large"][i % 2], "c%d" % (i % 3), i % 4 == 0, i % 3 == 0) for i in range(60)]
    rows += [(1, "night", None, "s", "small", "c1", True, False)]
    names = ["image_id", *B.ATTRIBUTES, "a_detected", "b_detected"]
    tax = spark.createDataFrame(rows, "image_id long, timeofday string, weather string, scene string, scale string, category string, a_detected boolean, b_detected boolean")
    for sets in (B.GROUPING_SETS, B.THREE_WAY_SETS):
        rates = B.failure_rates(tax, sets)
        got = {(r.group_type, r.group_value): (r.num_images, r.num_gt, r.a_failures, r.both_failures) for r in rates.collect()}
        want = {}
        for dims in sets:
            for r in (dict(zip(names, r)) for r in rows):
                value = "all" if dims == ("overall",) else "|".join(r[d] for d in dims if r[d] is not None)
                seen, n, a, both = want.get(("_x_".join(dims), value), (set(), 0, 0, 0))
                want["_x_".join(dims), value] = (seen | {r["image_id"]}, n + 1, a + (not r["a_detected"]), both + (not r["a_detected"] and not r["b_detected"]))
        assert got == {k: (len(s), *rest) for k, (s, *rest) in want.items()}
        dealt = re.findall(r"Exchange hashpartitioning\((.*?)\)", rates._jdf.queryExecution().executedPlan().toString())
        assert dealt and not any("group_value" in keys and "image_id" in keys for keys in dealt)


def test_risk_deals_objects_by_value_once(spark):
    rows = [(i, i % 5, 1 + i % 3, "small", i % 4 > 0, i % 3 > 0, (i % 7) / 7, (i % 4) / 4 if i % 6 else None) for i in range(80)]
    wide = spark.createDataFrame(rows, "annotation_id long, image_id long, category_id int, scale string, a_detected boolean, b_detected boolean, s double, t double")
    names = {f"{m}_{n}": c for m, c in (("a", "s"), ("b", "t")) for n in ("matched_score", "matched_iou", "best_same_all_score", "best_same_all_iou")}
    wide = wide.withColumns({n: F.col(c) for n, c in names.items()})
    risk = RI.risk_table(wide, {"a": 0.2, "b": 0.3}, keep=["annotation_id", "category_id"])
    assert "a_matched_score" not in risk.columns
    # on the way of the written rows: the values' percentiles, the class counts
    assert plan(risk).split("Relation [annotation_id")[0].count("Join ") == 2
    once = risk.drop("global_percentile", "class_percentile")
    for name, by in (("global_percentile", []), ("class_percentile", ["category_id"])):
        want = RK.mid_percentile(once, "joint_raw_risk", by, name).select("annotation_id", name)
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, risk.select("annotation_id", name).collect()))


def test_percentiles_of_nulls_stay_null(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0), (3, "y", 2.0), (4, "y", None)], "i int, k string, v double")
    got = {r.i: (r.all, r.own) for r in RK.mid_percentiles(df, "v", {"all": [], "own": ["k"]}).collect()}
    assert got == {1: (0.25, 0.5), 2: (0.25, 0.5), 3: (1.0, 0.5), 4: (None, None)}


def crops_and_objects(spark):
    r = random.Random(9)
    box = lambda low, high: (r.uniform(0, 900), r.uniform(0, 500), r.uniform(low, high), r.uniform(low, high))
    objects = spark.createDataFrame([(i % 3, i, 1, *box(6, 80)) for i in range(90)], "image_id long, annotation_id long, category_id int, x double, y double, w double, h double")
    crops = spark.createDataFrame([(3 * k, 3 * k % 3, *box(200, 600)) for k in range(30)], "annotation_id long, image_id long, crop_x0 double, crop_y0 double, crop_width double, crop_height double")
    return crops, objects


def test_crops_of_plain_images_need_no_grid(spark, monkeypatch):
    crops, objects = crops_and_objects(spark)
    seen = lambda: sorted((n.annotation_id, n.object_id, n.visible) for n in CR.crop_neighbours(crops, objects, overlapping=True).collect())
    with monkeypatch.context() as m:
        m.setattr(CR, "overlap_join", None)
        plain = seen()
    monkeypatch.setattr(CR, "hot_images", lambda a, b: M.hot_images(a, b, 25))
    assert plain == seen() == sorted((n.annotation_id, n.object_id, n.visible) for n in CR.crop_neighbours(crops, objects).where("NOT removed").collect())


def test_boxes_lie_on_levels_of_the_other_side_only(spark):
    crops, objects = crops_and_objects(spark)
    small = objects.select("image_id", *[F.col(c).alias(f"o{c}") for c in "xywh"])
    levels = spark.createDataFrame([(i, [6, 7]) for i in range(3)], "_at_image long, there array<int>")
    got = G._on_levels(small, "image_id", "o", levels, "there", None)
    assert {r._oat for r in got.select("_oat").distinct().collect()} == {6, 7}


def test_best_candidates_group_pairs_not_objects(spark):
    """Every object meets one row of its best detections; objects and what they carry are no groups of the pairs."""
    o, d = frames(spark, *scene(5))
    o = o.withColumn("scale", F.lit("small"))
    pairs = M.iou_pairs(o, d, 0.0, False, None)
    best = M.best_candidates(o, d, 0.3, None, ["scale"], pairs)
    grouped = re.findall(r"Aggregate \[(.*?)\]", plan(best))
    assert grouped and not any("scale" in keys for keys in grouped)
    assert best.count() == o.count()
    assert sorted(map(str, best.collect())) == sorted(map(str, M.best_candidates(o, d, 0.3, None, ["scale"]).collect()))


def test_class_sizes_are_counted_without_ranks(spark):
    """Two windows for each of the two percentiles of the risk table, and none for the sizes of the classes."""
    columns = {f"{m}_{n}": F.col("id") % 7 / 7.0 for m in "ab" for n in ("matched_score", "matched_iou", "best_same_all_score", "best_same_all_iou")}
    wide = spark.range(40).withColumns({"a_detected": F.col("id") % 2 == 0, "b_detected": F.col("id") % 3 == 0, "category_id": F.col("id") % 4} | columns)
    assert len(re.findall(r"Window \[", plan(RI.risk_table(wide, {"a": 0.2, "b": 0.3})))) == 4
