"""Quota and matched samples against sequential selection."""

import random

from pyspark.sql import functions as F

from boxwise.operators import sampling as S
from boxwise.operators.segments import polygon_support


def risk_rows(spark, n=400):
    rng = random.Random(11)
    rows = [
        (i, rng.randint(0, 120), rng.randint(1, 3), rng.choice(["small", "large"]), rng.random(), rng.choice(["high", "standard"]), "missed", False, rng.random() < 0.4)
        for i in range(n)
    ]
    ddl = "annotation_id bigint, image_id bigint, category_id int, scale string, risk_score double, risk_tier string, a_status string, a_detected boolean, b_detected boolean"
    return spark.createDataFrame(rows, ddl)


QUOTAS = {"other_joint_not_detected": 15, "b_supported_a_failure": 20, "small_joint_not_detected": 25}


def test_quota_sample_equals_sequential_choice(spark):
    risk = risk_rows(spark)
    ranked = S.weighted_priority(S.with_failure_group(risk), F.concat(F.lit("typed:"), F.col("failure_group"))).collect()
    cap, images, classes, want = int(60 * 0.36), set(), {}, set()
    for group, quota in QUOTAS.items():
        taken = 0
        for r in sorted((r for r in ranked if r.failure_group == group), key=lambda r: (r.priority, r.annotation_id)):
            if taken < quota and r.image_id not in images and classes.get(r.category_id, 0) < cap:
                taken += 1
                images.add(r.image_id)
                classes[r.category_id] = classes.get(r.category_id, 0) + 1
                want.add(r.annotation_id)
    got = {r.annotation_id for r in S.typed_quota_sample(risk, QUOTAS, 0.36, 1).collect()}
    assert got == want


def test_matched_sample_keeps_strata_and_images(spark):
    risk = risk_rows(spark)
    target = risk.dropDuplicates(["image_id"]).limit(40)
    got = S.matched_sample(risk, target, "class", "top_risk")
    assert got.count() == got.select("image_id").distinct().count()
    sizes = lambda df: {r.category_id: r["count"] for r in df.groupBy("category_id").count().collect()}
    assert sizes(got) == sizes(target)


def test_clipped_polygon_area(spark):
    rows = [
        (0.0, 0.0, 10.0, 10.0, [[0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0]], 100.0, 100.0),
        (5.0, 5.0, 10.0, 10.0, [[0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0]], 100.0, 25.0),
        (0.0, 0.0, 5.0, 10.0, [[0.0, 0.0, 10.0, 0.0, 0.0, 10.0]], 50.0, 37.5),
        (20.0, 20.0, 5.0, 5.0, [[0.0, 0.0, 10.0, 0.0, 0.0, 10.0]], 50.0, 0.0),
        (0.0, 0.0, 5.0, 5.0, [[1.0, 1.0, 2.0]], 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "x double, y double, w double, h double, polygons array<array<double>>, area double, inside double")
    for r in polygon_support(df).collect():
        assert abs(r.polygon_area - r.area) < 1e-9 and abs(r.inside_area - r.inside) < 1e-9
