"""Matching against a brute-force matcher, and the way hot images take."""

import random

from pyspark.sql import functions as F

from boxwise.operators import matching as M
from boxwise.operators import precision as P

BOX = "image_id bigint, {id} bigint, category_id int, x double, y double, w double, h double"


def iou(a, b):
    iw = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    ih = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(iw, 0.0) * max(ih, 0.0)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else 0.0


def scene(seed, images=6, objects=12, dets=20):
    rng = random.Random(seed)
    gt, ds = [], []
    for i in range(images):
        for _ in range(objects):
            gt.append((i, len(gt) + 1, rng.randint(1, 2), float(rng.randint(0, 90)), float(rng.randint(0, 90)), float(rng.choice([8, 20, 70])), float(rng.choice([8, 20, 70]))))
        own = [g for g in gt if g[0] == i]
        for _ in range(dets):
            g = rng.choice(own)
            ds.append((i, len(ds) + 1, rng.choice([g[2], g[2], 1]), g[3] + rng.randint(-3, 3), g[4] + rng.randint(-3, 3), g[5], g[6], rng.randint(1, 9) / 10))
    return gt, ds


def frames(spark, gt, ds):
    o = spark.createDataFrame(gt, BOX.format(id="annotation_id")).withColumn("area", F.col("w") * F.col("h"))
    d = spark.createDataFrame(ds, BOX.format(id="prediction_index") + ", score double")
    return o, d


def greedy(gt, ds, t):
    out = set()
    for key in {(d[0], d[2]) for d in ds}:
        free = {g[1]: g for g in gt if (g[0], g[2]) == key}
        for d in sorted((d for d in ds if (d[0], d[2]) == key), key=lambda d: (-d[7], d[1])):
            if not free:
                break
            best = max(free.values(), key=lambda g: (iou(g[3:7], d[3:7]), -g[1]))
            if iou(best[3:7], d[3:7]) >= t:
                out.add((best[1], d[1]))
                del free[best[1]]
    return out


def pairs(df):
    return {(r.annotation_id, r.prediction_index) for r in df.collect()}


def test_greedy_equals_brute_force(spark):
    gt, ds = scene(1)
    o, d = frames(spark, gt, ds)
    for t in (0.3, 0.5):
        assert pairs(M.greedy_match(o, d, t)) == greedy(gt, ds, t)


def test_hot_images_take_the_other_way_with_the_same_result(spark):
    gt, ds = scene(2, images=5)
    o, d = frames(spark, gt, ds)
    hot = spark.createDataFrame([(0,), (3,)], "image_id bigint")
    assert pairs(M.iou_pairs(o, d, hot=hot)) == pairs(M.iou_pairs(o, d, hot=None))
    assert pairs(M.greedy_match(o, d, 0.5, hot=hot)) == greedy(gt, ds, 0.5)
    split = M.object_status(o, d, 0.4, hot=hot).select("annotation_id", "status", "best_wrong_iou").collect()
    plain = M.object_status(o, d, 0.4, hot=None).select("annotation_id", "status", "best_wrong_iou").collect()
    assert sorted(split) == sorted(plain)


def test_hot_images_are_found_by_count(spark):
    gt, ds = scene(3, images=3)
    o, d = frames(spark, gt + [(9, 1000 + i, 1, 0.0, 0.0, 5.0, 5.0) for i in range(40)], ds)
    assert [r.image_id for r in M.hot_images(o, d, 30).collect()] == [9]
    assert M.hot_images(o, d, 1000) is None


def test_accounting_identity_and_empty_inputs(spark):
    gt, ds = scene(4)
    o, d = frames(spark, gt, ds)
    images = spark.range(8).withColumnRenamed("id", "image_id")
    status, fp = M.object_status(o, d, 0.4), M.false_positives(o, d, 0.4)
    rows = M.image_summary(images, status, fp, d, 0.4).collect()
    assert len(rows) == 8 and all(r.balanced for r in rows)
    none = d.where("false")
    assert M.greedy_match(o, none).count() == 0
    assert {r.status for r in M.object_status(o, none, 0.4).collect()} == {"missed"}
    assert M.object_status(o.where("false"), d, 0.4).count() == 0


def test_order_of_input_rows_does_not_matter(spark):
    gt, ds = scene(5)
    o, d = frames(spark, gt, ds)
    again = M.greedy_match(o.orderBy(F.rand(1)).repartition(3), d.orderBy(F.rand(2)).repartition(5))
    assert pairs(again) == pairs(M.greedy_match(o, d))


def test_perfect_detections_score_one(spark):
    gt, _ = scene(6, images=3, objects=4)
    seen = {g[3:7]: g for g in gt}
    gt = sorted(seen.values())
    ds = [(g[0], i, g[2], *g[3:7], 0.9) for i, g in enumerate(gt)]
    o, d = frames(spark, gt, ds)
    row = P.coco_eval(o, d).first()
    assert abs(row.AP - 1) < 1e-9 and abs(row.AR100 - 1) < 1e-9


def test_class_without_objects_does_not_count(spark):
    o, d = frames(spark, [(1, 1, 1, 0.0, 0.0, 9.0, 9.0)], [(1, 1, 1, 0.0, 0.0, 9.0, 9.0, 0.8), (1, 2, 2, 0.0, 0.0, 9.0, 9.0, 0.9)])
    row = P.coco_eval(o, d).first()
    assert abs(row.AP - 1) < 1e-9 and row.AP_large is None
