"""Cases in which rows must not be lost in silence."""

import json

import pytest
from pyspark.sql import functions as F

from boxwise.operators import calibrate as C
from boxwise.operators import matching as M
from boxwise.operators import prep as PR
from boxwise.operators import sampling as S
from boxwise.sources import readers as RD
from boxwise.sources import writers as WR

OBJECT = "image_id long, annotation_id long, category_id int, x double, y double, w double, h double"
DETECTION = "image_id long, prediction_index long, category_id int, score double, x double, y double, w double, h double"


def test_events_keep_low_scores(spark):
    o = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0)], OBJECT)
    d = spark.createDataFrame([(1, 0, 1, 0.0005, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 0.0001, 50.0, 50.0, 5.0, 5.0)], DETECTION)
    assert sorted(r.is_tp for r in C.detection_events(o, d).collect()) == [0, 1]
    assert C.detection_events(o, d, floor=0.0003).count() == 1


def test_detections_of_two_files_stay_apart(spark):
    o = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0)], OBJECT)
    d = spark.createDataFrame([(1, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 0, 1, 0.8, 0.0, 0.0, 10.0, 10.0)], DETECTION)
    assert [(r.image_id, r.fp_type) for r in M.false_positives(o, d, 0.1).collect()] == [(2, "background_candidate")]
    assert sorted((r.image_id, r.is_tp) for r in C.detection_events(o, d).collect()) == [(1, 1), (2, 0)]


def test_broken_documents_are_errors(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    with pytest.raises(Exception):
        RD.read_detections(spark, put("cut.json", '[{"image_id": 1, "category_id"'), "a").collect()
    with pytest.raises(Exception, match="no list"):
        RD.read_detections(spark, put("none.json", '{"other": 1}'), "a").collect()
    with pytest.raises(Exception):
        RD.read_id_set(spark, put("ids.json", "[1, 2")).collect()
    with pytest.raises(Exception, match="repeated id"):
        RD.read_id_set(spark, put("twice.json", "[1, 2, 1]")).collect()
    with pytest.raises(Exception, match="lacks"):
        RD.read_coco(spark, put("coco.json", '{"images": []}'))[0].collect()


def test_label_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3.0 0.5 0.5 0.1 0.1\n1 0.5 0.5 0.1 0.1 0.9\n2 0.5 0.5 0.2 0.2\njunk\n\n1.5 0.5 0.5 0.1 0.1\n")
    rows, bad = RD.read_norm_labels(spark, str(tmp_path))
    assert sorted(r.class_index for r in rows.collect()) == [1, 2, 3]
    assert sorted(r.line for r in bad.collect()) == ["1.5 0.5 0.5 0.1 0.1", "junk"]


def test_flags_nested_in_attributes(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a", "width": 5, "height": 5}], "categories": [{"id": 1, "name": "car"}], "annotations": [{"id": 7, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1], "area": 1.0, "attributes": {"occluded": True, "truncated": False}}]}
    p = tmp_path / "c.json"
    p.write_text(json.dumps(doc))
    (r,) = RD.read_coco(spark, str(p))[1].collect()
    assert r.occluded is True and r.truncated is False


def test_documents_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(i, 10, 20, "day", "clear", "city") for i in range(5)], "image_id long, width int, height int, timeofday string, weather string, scene string")
    o = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 2.0, 3.0), (4, 2, 3, 1.0, 1.0, 2.0, 2.0)], OBJECT).withColumns({"iscrowd": F.lit(1), "occluded": F.lit(True), "truncated": F.lit(False)})
    WR.write_coco(images, o, str(tmp_path / "out"), per_document=2)
    i, back, c = RD.read_coco(spark, str(tmp_path / "out"), multiline=False)
    assert i.count() == 5 and c.count() == 10
    assert sorted((r.annotation_id, r.image_id, r.iscrowd, r.occluded, r.area) for r in back.collect()) == [(1, 1, 1, True, 6.0), (2, 4, 1, True, 4.0)]
    with pytest.raises(Exception, match="not listed"):
        WR.write_coco(images.where("image_id <> 4"), o, str(tmp_path / "bad"))


def test_audits(spark):
    images = spark.createDataFrame([(1, 100, 100), (1, 100, 100), (0, 5, 5)], "image_id long, width int, height int")
    d = spark.createDataFrame([(1, 0, None, 0.5, 0.0, 0.0, 1.0, 1.0), (1, 1, 1, 0.5, 0.0, 0.0, 1.0, 1.0)], DETECTION)
    counts, errors = PR.audit_detections(d, images)
    assert counts.first().detections == 2 and [r.issue for r in errors.collect()] == ["unknown_category"]
    o = spark.createDataFrame([(1, 1, 1, float("nan"), 0.0, 1.0, 1.0)], OBJECT).withColumn("area", F.lit(1.0))
    assert {(r.annotation_id, r.issue) for r in PR.audit_objects(o, images).collect()} == {(1, "non_finite_box"), (1, "duplicate_image_id"), (0, "non_positive_image_id")}
    twice = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 1.0, 1.0, 0), (1, 2, 1, 0.0, 0.0, 1.0, 1.0, 1), (1, 3, None, 0.0, 0.0, 1.0, 1.0, 0), (1, 4, None, 0.0, 0.0, 1.0, 1.0, 0)], OBJECT + ", iscrowd int")
    kept, dropped = PR.dedup_objects(twice)
    assert sorted(r.annotation_id for r in kept.collect()) == [1, 2, 3] and [(r.dropped_id, r.first_id) for r in dropped.collect()] == [(4, 3)]


def test_short_quotas_and_strata(spark):
    risk = spark.createDataFrame([(i, i, 1, "small", 0.5, "high", "missed", False, False) for i in range(5)], "annotation_id long, image_id long, category_id int, scale string, risk_score double, risk_tier string, a_status string, a_detected boolean, b_detected boolean")
    with pytest.raises(ValueError, match="rows of 9"):
        S.typed_quota_sample(risk, {"small_joint_not_detected": 9}, 1.0, 1)
    short = S.typed_quota_sample(risk, {"small_joint_not_detected": 9}, 1.0, 1, strict=False)
    need = spark.createDataFrame([("small_joint_not_detected", 9)], "failure_group string, required long")
    assert [(r.required, r.selected) for r in S.shortfall(short, need, ["failure_group"]).collect()] == [(9, short.count())]
    with pytest.raises(ValueError, match="can't be filled"):
        S.matched_sample(risk.limit(2), risk, "class", "top_risk")


def test_image_ids_follow_files_and_records(spark, tmp_path):
    import json

    for k, names in enumerate((["c", "a"], ["b"], ["z", "y", "x"])):
        (tmp_path / f"part{k}.json").write_text(json.dumps([{"name": n, "labels": [{"category": "car", "box2d": {"x1": 0, "y1": 0, "x2": 2, "y2": 2}}]} for n in names]))
    images, boxes = RD.read_box_labels(spark, str(tmp_path), numbered=True)
    assert [(r.image_id, r.name) for r in images.orderBy("image_id").collect()] == list(enumerate("cabzyx", 1))
    assert {(r.image_id, r.name) for r in boxes.collect()} == set(enumerate("cabzyx", 1))
    (tmp_path / "part3.json").write_text(json.dumps([{"labels": []}]))
    with pytest.raises(Exception, match="no name"):
        RD.read_box_labels(spark, str(tmp_path), numbered=True)[0].collect()


def test_written_tables_are_removed(folder):
    import os

    from boxwise import session

    # the bookkeeping of other tests is set aside, so that their tables stay
    spark = session.local_session(4, 4)
    app, kept = spark.sparkContext.applicationId, session._WRITTEN.pop(spark.sparkContext.applicationId, [])
    table = session.materialize(spark.range(3))
    path = session._WRITTEN[app][0].removeprefix("file://").removeprefix("file:")
    assert table.count() == 3 and os.path.exists(path)
    assert session.remove_written(spark) == 1 and not os.path.exists(path)
    session._WRITTEN[app] = kept
