"""The registered queries: one per operator, each with its SQL counterpart where SQL can say it.

``query`` names the output columns with a type letter (i integer, d double rounded to
six places, s text, b boolean), so both sides end in the same schema. Both sides round by the same
binary arithmetic, as Spark's and DuckDB's own functions part ways at half-way values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise import constants as K
from boxwise.catalog import oracle as O
from boxwise.catalog.views import SCORES, Views, views
from boxwise.functions import geometry as G
from boxwise.functions.hashing import hash_rank
from boxwise.operators import breakdown as B
from boxwise.operators import calibrate as C
from boxwise.operators import crops as CR
from boxwise.operators import curves as CU
from boxwise.operators import matching as M
from boxwise.operators import precision as P
from boxwise.operators import prep as PR
from boxwise.operators import ranking as RK
from boxwise.operators import risk as RI
from boxwise.operators import sampling as S
from boxwise.operators import segments as SG
from boxwise.operators import stats as ST
from boxwise.functions import risk as RF
from boxwise.sources import writers as WR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CAST = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}


def _six_places(v):
    return F.when(F.abs(v) < 1e9, F.floor(v * 1e6 + F.lit(0.5)) / F.lit(1e6) + F.lit(0.0)).otherwise(v)


def query(name: str, columns: str, needs: str = "", sql: str | None = None):
    spec = [c.split(":") for c in columns.split()]

    def deco(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(views(spark, folder))
            out = []
            for c, t in spec:
                v = F.col(c).cast(_CAST[t])
                out.append((_six_places(v) if t == "d" else v).alias(c))
            return df.select(*out)

        QUERIES[name] = run
        if sql is not None:
            cast = {"i": "CAST({0} AS BIGINT)", "d": "CASE WHEN abs(CAST({0} AS DOUBLE)) < 1e9 THEN floor(CAST({0} AS DOUBLE) * 1e6 + 0.5e0) / 1e6 + 0e0 ELSE CAST({0} AS DOUBLE) END", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}
            cols = ", ".join(f'{cast[t].format(chr(34) + c + chr(34))} AS "{c}"' for c, t in spec)
            ORACLES[name] = O.with_ctes(needs, f"SELECT {cols} FROM ({sql}) final_rows")
        return fn

    return deco


TA = SCORES["a"]

# --- projections, filters, repair ---------------------------------------------------------


def _named(v: Views) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("person", "rider", "car", "Truck", "bus", "train", "motor", "bike", "traffic light", "traffic sign", "other vehicle")])
    return v.objects.select("annotation_id", F.element_at(names, (F.col("pk") % 11 + 1).cast("int")).alias("category"))


_NAMED_SQL = "SELECT annotation_id, (['person','rider','car','Truck','bus','train','motor','bike','traffic light','traffic sign','other vehicle'])[CAST(pk % 11 + 1 AS INTEGER)] AS category, CASE WHEN pk % 11 < 10 THEN pk % 11 + 1 END AS category_id FROM objects"


@query("prj1_canonical_classes", "annotation_id:i category:s category_id:i", "objects", f"SELECT * FROM ({_NAMED_SQL}) WHERE category_id IS NOT NULL")
def _(v):
    return PR.split_unknown(PR.canonicalize_classes(_named(v)))[0]


@query("prj1_unknown_classes", "category:s dropped:i", "objects", f"SELECT category, count(*) AS dropped FROM ({_NAMED_SQL}) WHERE category_id IS NULL GROUP BY 1")
def _(v):
    return PR.split_unknown(PR.canonicalize_classes(_named(v)))[1]


_CORNERS = "SELECT annotation_id, x + w - 60 AS x1, y - 30 AS y1, x - 60 AS x2, y + h - 30 AS y2 FROM objects"


@query("prj2_clip_boxes", "annotation_id:i x:d y:d w:d h:d valid:b", "objects", f"""SELECT annotation_id, l AS x, t AS y, r - l AS w, b - t AS h, r > l AND b > t AS valid FROM (
 SELECT annotation_id, least(greatest(least(x1, x2), 0), 1280) AS l, least(greatest(greatest(x1, x2), 0), 1280) AS r, least(greatest(least(y1, y2), 0), 720) AS t, least(greatest(greatest(y1, y2), 0), 720) AS b FROM ({_CORNERS}))""")
def _(v):
    c = v.objects.select("annotation_id", *[F.expr(e) for e in ("x + w - 60 AS x1", "y - 30 AS y1", "x - 60 AS x2", "y + h - 30 AS y2", "1280 AS width", "720 AS height")])
    return PR.clip_boxes(c)


_NORM = "SELECT image_id, annotation_id, category_id - 1 AS class_index, (x + w / 2) / 1280 AS cx, (y + h / 2) / 720 AS cy, w / 1280 AS nw, h / 720 AS nh FROM objects"


def _norm(v: Views) -> DataFrame:
    return PR.to_norm(v.objects.withColumns({"width": F.lit(1280), "height": F.lit(720)}))


@query("prj3_to_norm", "annotation_id:i class_index:i cx:d cy:d nw:d nh:d", "objects", _NORM)
def _(v):
    return _norm(v)


@query("prj3_from_norm", "annotation_id:i px1:d py1:d px2:d py2:d", "objects", "SELECT annotation_id, least(x, 1279) AS px1, least(y, 719) AS py1, least(x + w, 1279) AS px2, least(y + h, 719) AS py2 FROM objects")
def _(v):
    return PR.from_norm(_norm(v))


@query("prj4_scale", "annotation_id:i area:d scale:s", "objects", "SELECT annotation_id, area, scale FROM objects")
def _(v):
    return PR.with_scale(v.objects.drop("scale"))


@query("prj5_attributes", "image_id:i timeofday:s weather:s scene:s", "images", "SELECT image_id, timeofday, lower(weather) AS weather, CASE WHEN scene = 'F' THEN 'undefined' ELSE lower(scene) END AS scene FROM images")
def _(v):
    dirty = v.images.withColumns(
        {"timeofday": F.nullif("timeofday", F.lit("undefined")), "weather": F.concat(F.lit("  "), "weather", F.lit(" ")), "scene": F.when(F.col("scene") == "F", "  ").otherwise(F.col("scene"))}
    )
    return PR.clean_attributes(dirty, lower=True)


_REMAP = {i: (i * 7) % 11 for i in range(1, 11)}


@query("prj6_remap_labels", "prediction_index:i category_id:i", "d_a", "SELECT prediction_index, (category_id * 7) % 11 AS category_id FROM d_a")
def _(v):
    return PR.remap_labels(v.dets["a"].withColumnRenamed("category_id", "label"), _REMAP)


@query("prj7_corner_boxes", "prediction_index:i x:d y:d w:d h:d nonpositive:b", "d_a", "SELECT prediction_index, x, y, w - 10 AS w, h - 10 AS h, w <= 10 OR h <= 10 AS nonpositive FROM d_a")
def _(v):
    return PR.xyxy_to_xywh(v.dets["a"].select("prediction_index", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w") - 10).alias("x2"), (F.col("y") + F.col("h") - 10).alias("y2")))


@query("flt1_detection_audit", "detections:i errors:i negative_size:i zero_area:i negative_origin:i out_of_bounds:i min_score:d max_score:d", "d_a images", """SELECT count(*) AS detections, count(*) FILTER (WHERE i.image_id IS NULL) AS errors,
 count(*) FILTER (WHERE w < 8 OR h < 8) AS negative_size, count(*) FILTER (WHERE w = 8 OR h = 8) AS zero_area, 0 AS negative_origin,
 count(*) FILTER (WHERE i.image_id IS NOT NULL AND (x + w - 8 > 1280 OR y + h - 8 > 720)) AS out_of_bounds, min(score) AS min_score, max(score) AS max_score
 FROM d_a d LEFT JOIN (SELECT image_id FROM images WHERE image_id % 7 <> 0) i USING (image_id)""")
def _(v):
    shrunk = v.dets["a"].withColumns({"w": F.col("w") - 8, "h": F.col("h") - 8})
    known = v.images.where("image_id % 7 <> 0")
    return PR.audit_detections(shrunk, known)[0]


@query("flt1_detection_errors", "prediction_index:i issue:s", "d_a", """SELECT prediction_index, CASE WHEN image_id % 7 = 0 THEN 'unknown_image' WHEN category_id = 10 AND prediction_index % 2 = 0 THEN 'unknown_category' ELSE 'invalid_score' END AS issue
 FROM d_a WHERE image_id % 7 = 0 OR (category_id = 10 AND prediction_index % 2 = 0) OR score > 0.98e0""")
def _(v):
    odd = v.dets["a"].withColumns(
        {"category_id": F.expr("IF(category_id = 10 AND prediction_index % 2 = 0, 11, category_id)"), "score": F.expr("IF(score > 0.98D, 1.5D, score)")}
    )
    return PR.audit_detections(odd, v.images.where("image_id % 7 <> 0"))[1]


@query("flt2_object_audit", "annotation_id:i issue:s", "objects images", """SELECT annotation_id, 'unknown_image' AS issue FROM objects WHERE image_id % 7 = 0
 UNION ALL SELECT annotation_id, 'out_of_bounds' FROM objects WHERE image_id % 7 <> 0 AND (x + w > 1280 OR y + h > 720)
 UNION ALL SELECT annotation_id, 'invalid_box' FROM objects WHERE w <= 8 UNION ALL SELECT annotation_id, 'invalid_area' FROM objects WHERE w <= 8
 UNION ALL SELECT annotation_id, 'duplicate_id' FROM objects WHERE rn = 1""")
def _(v):
    odd = v.objects.withColumns({"w": F.col("w") - 8, "area": (F.col("w") - 8) * F.col("h")})
    odd = odd.withColumn("x", F.col("x") + 8)
    # A second row under the id of each first object, on a valid box of a known image.
    spot = {"x": F.lit(1.0), "y": F.lit(1.0), "w": F.lit(2.0), "h": F.lit(2.0), "area": F.lit(4.0), "image_id": F.col("known_id")}
    known = v.images.where("image_id % 7 <> 0").select("image_id", "width", "height")
    low = known.agg(F.min("image_id").alias("known_id"))
    again = RK.attach(odd.where("rn = 1"), low, []).withColumns(spot).drop("known_id")
    return PR.audit_objects(odd.unionByName(again), known)


def _copied(v: Views) -> DataFrame:
    copies = v.objects.where("rn % 3 = 1").withColumn("annotation_id", F.col("annotation_id") + 1000000000)
    return v.objects.unionByName(copies)


@query("flt3_duplicate_objects", "dropped_id:i first_id:i", "objects", """SELECT annotation_id AS dropped_id, f AS first_id FROM (SELECT *, min(annotation_id) OVER (PARTITION BY image_id, category_id, x, y, w, h) AS f
 FROM (SELECT annotation_id, image_id, category_id, x, y, w, h FROM objects UNION ALL SELECT annotation_id + 1000000000, image_id, category_id, x, y, w, h FROM objects WHERE rn % 3 = 1)) WHERE annotation_id <> f""")
def _(v):
    return PR.dedup_objects(_copied(v))[1]


@query("flt3_kept_objects", "annotation_id:i", "objects", """SELECT min(annotation_id) AS annotation_id
 FROM (SELECT annotation_id, image_id, category_id, x, y, w, h FROM objects UNION ALL SELECT annotation_id + 1000000000, image_id, category_id, x, y, w, h FROM objects WHERE rn % 3 = 1) GROUP BY image_id, category_id, x, y, w, h""")
def _(v):
    return PR.dedup_objects(_copied(v))[0]


@query("flt4_operating_point", "model:s prediction_index:i score:d", "d_a d_b", "SELECT 'a' AS model, prediction_index, score FROM d_a WHERE score >= 0.22e0 UNION ALL SELECT 'b', prediction_index, score FROM d_b WHERE score >= 0.3e0")
def _(v):
    both = v.dets["a"].withColumn("model", F.lit("a")).unionByName(v.dets["b"].withColumn("model", F.lit("b")))
    return PR.operating(both, SCORES)


@query("flt5_top_per_image", "prediction_index:i rank:i", "d_a", "SELECT prediction_index, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, prediction_index) AS rank FROM d_a WHERE score >= 0.001e0 QUALIFY rank <= 3")
def _(v):
    return M.topk_detections(v.dets["a"], 3, ("image_id",))


@query("flt5_top_per_class", "prediction_index:i rank:i", "d_a", "SELECT prediction_index, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, prediction_index) AS rank FROM d_a WHERE score >= 0.001e0 QUALIFY rank <= 1")
def _(v):
    return M.topk_detections(v.dets["a"], 1, ("image_id", "category_id"))


_BAD_LABELS = f"""SELECT image_id, class_index, cx, cy, nw, nh, 0 AS n_label, 1 AS n_object FROM ({_NORM}) UNION ALL
 SELECT image_id, CASE WHEN image_id % 13 = 0 THEN class_index + 1 ELSE class_index END, cx, cy, nw, nh, 1, 0 FROM ({_NORM}) WHERE image_id % 11 <> 0"""


def _bad_labels(v: Views) -> DataFrame:
    return _norm(v).where("image_id % 11 <> 0").withColumn("class_index", F.expr("IF(image_id % 13 = 0, class_index + 1, class_index)"))


@query("flt6_reconcile_labels", "image_id:i label_rows:i object_rows:i missing_rows:i extra_rows:i state:s", "objects", f"""SELECT *, CASE WHEN missing_rows = 0 AND extra_rows = 0 THEN 'equal' WHEN label_rows = 0 THEN 'empty' ELSE 'different' END AS state FROM (
 SELECT image_id, sum(l) AS label_rows, sum(o) AS object_rows, sum(greatest(o - l, 0)) AS missing_rows, sum(greatest(l - o, 0)) AS extra_rows FROM (
  SELECT image_id, class_index, round(cx, 6), round(cy, 6), round(nw, 6), round(nh, 6), sum(n_label) AS l, sum(n_object) AS o FROM ({_BAD_LABELS}) GROUP BY ALL) GROUP BY image_id)""")
def _(v):
    return PR.reconcile_labels(_bad_labels(v), _norm(v))


@query("flt6_rebuilt_labels", "image_id:i class_index:i cx:d cy:d nw:d nh:d in_bounds:b", "objects", f"SELECT *, cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND nw BETWEEN 0 AND 1 AND nh BETWEEN 0 AND 1 AS in_bounds FROM ({_NORM}) WHERE image_id % 11 = 0 OR image_id % 13 = 0")
def _(v):
    return PR.rebuild_labels(PR.reconcile_labels(_bad_labels(v), _norm(v)), _norm(v))


@query("flt7_cross_check", "name:s field:s left_value:s right_value:s", "images", """SELECT CAST(image_id AS VARCHAR) AS name, 'weather' AS field, weather AS left_value, 'x' AS right_value FROM images WHERE image_id % 17 = 0 AND image_id % 19 <> 0
 UNION ALL SELECT CAST(image_id AS VARCHAR), 'missing', f, NULL FROM (SELECT image_id, unnest([weather, scene]) AS f FROM images WHERE image_id % 19 = 0)""")
def _(v):
    left = v.images.withColumn("file_name", F.concat(F.lit("val/"), "image_id", F.lit(".jpg")))
    right = v.images.where("image_id % 19 <> 0").withColumn("file_name", F.concat("image_id", F.lit(".png")))
    right = right.withColumn("weather", F.expr("IF(image_id % 17 = 0, 'x', weather)"))
    return PR.cross_check(left, right, ["weather", "scene"])


@query("flt8_restrict", "annotation_id:i", "objects images", "SELECT annotation_id FROM objects WHERE image_id IN (SELECT image_id FROM images WHERE split = 'dev')")
def _(v):
    return PR.restrict(v.objects, v.images.where("split = 'dev'"))


# --- joins and matching --------------------------------------------------------------------


@query("jn1_iou_pairs", "annotation_id:i prediction_index:i iou:d", "pairs_a", "SELECT a AS annotation_id, p AS prediction_index, iou FROM pairs_a WHERE iou > 0")
def _(v):
    return M.iou_pairs(v.objects, v.dets["a"], hot=v.hot)


@query("jn2_greedy_match", "annotation_id:i prediction_index:i iou:d score:d", "greedy_a", "SELECT * FROM greedy_a")
def _(v):
    return M.greedy_match(v.objects, v.dets["a"].where(F.col("score") >= TA), hot=v.hot)


@query("jn1_dense_pairs", "annotation_id:i prediction_index:i iou:d", "dense_pairs", "SELECT a AS annotation_id, p AS prediction_index, iou FROM dense_pairs WHERE iou >= 0.3")
def _(v):
    """Same-class pairs on boards of some thousand boxes, by the grid of levels."""
    return M.iou_pairs(*v.dense, 0.3, True)


@query("jn2_dense_match", "annotation_id:i prediction_index:i iou:d score:d", "dense_greedy", "SELECT * FROM dense_greedy")
def _(v):
    """Greedy match on the same boards, by connected parts of their pairs."""
    return M.greedy_match(*v.dense)


_BEST = "best_same_all best_same_op best_wrong".split()
_BEST_SPEC = " ".join(f"{b}_prediction_index:i {b}_iou:d {b}_score:d" for b in _BEST) + " best_wrong_category_id:i"


@query("jn3_best_candidates", f"annotation_id:i {_BEST_SPEC}", "status_a", "SELECT * FROM status_a")
def _(v):
    return M.best_candidates(v.objects, v.dets["a"], TA, hot=v.hot)


_COUNTS = """(SELECT s.*, coalesce(n, 0) AS num_predictions_image, coalesce(n_op, 0) AS num_operating_predictions_image, coalesce(n_same, 0) AS num_same_class_operating_predictions FROM status_a s
 LEFT JOIN (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE score >= 0.22e0) AS n_op FROM d_a GROUP BY 1) USING (image_id)
 LEFT JOIN (SELECT image_id, category_id, count(*) FILTER (WHERE score >= 0.22e0) AS n_same FROM d_a GROUP BY 1, 2) USING (image_id, category_id))"""


@query("jn4_object_status", "annotation_id:i status:s detected:b matched_prediction_index:i matched_iou:d matched_score:d num_predictions_image:i num_operating_predictions_image:i num_same_class_operating_predictions:i", "status_a d_a", f"SELECT * FROM {_COUNTS}")
def _(v):
    return M.prediction_counts(v.status["a"], v.dets["a"], TA)


@query("jn5_object_status_validation", "annotation_id:i status:s", "status_a", "SELECT annotation_id, status_v AS status FROM status_a")
def _(v):
    return M.object_status(v.objects, v.dets["a"], TA, variant="validation", hot=v.hot, pairs=v.pairs["a"])


@query("jn6_false_positives", "prediction_index:i fp_type:s best_gt_annotation_id:i best_gt_category_id:i best_gt_iou:d", "fp_a", "SELECT * FROM fp_a")
def _(v):
    return v.false_positives["a"]


@query("jn7_false_positives_validation", "prediction_index:i fp_type:s", "fp_a", "SELECT prediction_index, fp_type_v AS fp_type FROM fp_a")
def _(v):
    return M.false_positives(v.objects, v.dets["a"], TA, variant="validation", hot=v.hot, pairs=v.pairs["a"])


_STATES = ["missed", "low_confidence_candidate", "assignment_conflict_candidate", "classification_error_candidate", "localization_error_candidate"]


@query("jn8_image_summary", "image_id:i num_gt:i num_predictions:i num_operating_predictions:i num_detected_gt:i num_false_positives:i " + " ".join(f"num_{s}:i" for s in _STATES) + " balanced:b", "images status_a fp_a d_a", f"""SELECT i.image_id, coalesce(s.n, 0) AS num_gt, coalesce(d.n, 0) AS num_predictions, coalesce(d.op, 0) AS num_operating_predictions, coalesce(s.det, 0) AS num_detected_gt, coalesce(f.n, 0) AS num_false_positives,
 {', '.join(f'coalesce(s.n_{x}, 0) AS num_{x}' for x in _STATES)}, coalesce(s.det, 0) + coalesce(f.n, 0) = coalesce(d.op, 0) AS balanced
 FROM images i LEFT JOIN (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE detected) AS det, {', '.join(f"count(*) FILTER (WHERE status = '{x}') AS n_{x}" for x in _STATES)} FROM status_a GROUP BY 1) s USING (image_id)
 LEFT JOIN (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE score >= 0.22e0) AS op FROM d_a GROUP BY 1) d USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS n FROM fp_a GROUP BY 1) f USING (image_id)""")
def _(v):
    v.pairs["a"]  # kept, as status and false positives both read them
    return M.image_summary(v.images, v.status["a"], v.false_positives["a"], v.dets["a"], TA)


@query("jn9_join_models", "annotation_id:i image_id:i category_id:i a_status:s b_status:s a_detected:b b_detected:b aligned:b", "wide", "SELECT *, true AS aligned FROM wide")
def _(v):
    return v.wide


@query("jn10_segment_evidence", "annotation_id:i seg_status:s support:b seg_score:d seg_bbox_iou:d best_same_class_iou:d evidence:s", "graded", "SELECT * FROM graded")
def _(v):
    return v.evidence


@query("jn11_detects_target", "annotation_id:i detected:b", "objects pairs_a", "SELECT annotation_id, EXISTS (SELECT 1 FROM pairs_a p WHERE p.a = o.annotation_id AND gc = dc AND score >= 0.25e0 AND iou >= 0.5e0) AS detected FROM objects o")
def _(v):
    return M.detects_target(v.objects, v.dets["a"], hot=v.hot)


def _multi_sql(tie: str) -> str:
    return f"""SELECT thr AS t, m.a AS annotation_id, m.p AS prediction_index, m.iou AS iou FROM (SELECT thr, unnest(list_reduce(ps, {O.TAKE}, ps[1:0])) AS m FROM (
 SELECT x.image_id, x.gc, c.thr, list(struct_pack(p := x.p, a := x.a, iou := x.iou) ORDER BY x.score DESC, x.p, x.iou DESC, {tie}) AS ps FROM pairs_a x JOIN cut_a r ON r.prediction_index = x.p JOIN cells c ON c.area = 0 AND x.iou >= c.iou WHERE gc = dc GROUP BY ALL))"""


_THR_INDEX = "CAST(round((threshold - 0.5D) * 20) AS INT) AS t"


@query("jn12_multi_threshold_match", "t:i annotation_id:i prediction_index:i iou:d", "pairs_a cut_a cells", _multi_sql("x.a"))
def _(v):
    return M.multi_threshold_match(v.objects, v.dets["a"], hot=v.hot).selectExpr("*", _THR_INDEX)


@query("jn13_multi_threshold_match_last", "t:i annotation_id:i prediction_index:i iou:d", "pairs_a cut_a cells", _multi_sql("x.a DESC"))
def _(v):
    return M.multi_threshold_match(v.objects, v.dets["a"], tie="last", hot=v.hot).selectExpr("*", _THR_INDEX)


# --- aggregations --------------------------------------------------------------------------


@query("agg1_profile", "images:i objects:i empty_images:i invalid_boxes:i occluded:i truncated:i objects_per_image:d", "images objects", """SELECT count(*) AS images, sum(n) AS objects, count(*) FILTER (WHERE n IS NULL) AS empty_images, 0 AS invalid_boxes, sum(oc) AS occluded, sum(tr) AS truncated, sum(n) / count(*) AS objects_per_image
 FROM images LEFT JOIN (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE occluded) AS oc, count(*) FILTER (WHERE truncated) AS tr FROM objects GROUP BY 1) USING (image_id)""")
def _(v):
    return B.profile(v.images, v.objects)


@query("agg1_value_counts", "field:s value:s count:i", "images", " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, count(*) AS count FROM images GROUP BY 2" for f in ("timeofday", "weather", "scene", "width", "height", "split")))
def _(v):
    return B.value_counts(v.images, ["timeofday", "weather", "scene", "width", "height", "split"])


_OBJECT_FIELDS = ("category_id", "scale", "occluded", "truncated", "geometry")


@query("agg1_object_value_counts", "field:s value:s count:i", "objects", " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, count(*) AS count FROM (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 'invalid' WHEN w >= h THEN 'wide' ELSE 'tall' END AS geometry FROM objects) GROUP BY 2" for f in _OBJECT_FIELDS))
def _(v):
    shaped = v.objects.withColumn("geometry", F.when((F.col("w") <= 0) | (F.col("h") <= 0), "invalid").when(F.col("w") >= F.col("h"), "wide").otherwise("tall"))
    return B.value_counts(shaped, list(_OBJECT_FIELDS))


@query("agg2_condition_subsets", "dimension:s value:s images:i objects:i role:s", "membership objects", """SELECT dimension, value, count(*) AS images, coalesce(sum(n), 0) AS objects, CASE WHEN count(*) >= 100 AND value <> 'undefined' THEN 'primary' ELSE 'supplementary' END AS role
 FROM membership LEFT JOIN (SELECT image_id, count(*) AS n FROM objects GROUP BY 1) ON mi = image_id WHERE dimension <> 'overall' GROUP BY 1, 2""")
def _(v):
    return B.condition_subsets(v.images, v.objects)


@query("agg3_category_counts", "dimension:s value:s category_id:i count:i", "membership objects", """SELECT g.dimension, g.value, c AS category_id, coalesce(n, 0) AS count FROM (SELECT DISTINCT dimension, value, unnest(range(1, 11)) AS c FROM membership WHERE dimension <> 'overall') g
 LEFT JOIN (SELECT dimension, value, category_id AS c, count(*) AS n FROM membership JOIN objects ON mi = image_id GROUP BY ALL) USING (dimension, value, c)""")
def _(v):
    return B.category_counts(v.images, v.objects)


@query("agg3_category_scale_counts", "scale:s category_id:i count:i", "objects", "SELECT s AS scale, c AS category_id, (SELECT count(*) FROM objects WHERE scale = s AND category_id = c) AS count FROM (SELECT unnest(['small', 'medium', 'large']) AS s), (SELECT unnest(range(1, 11)) AS c)")
def _(v):
    return B.category_scale_counts(v.objects)


@query("agg4_status_counts", "model:s category_id:i status:s count:i", "status_a status_b", "SELECT 'a' AS model, category_id, status, count(*) AS count FROM status_a GROUP BY 2, 3 UNION ALL SELECT 'b', category_id, status, count(*) FROM status_b GROUP BY 2, 3")
def _(v):
    one = lambda m: B.status_counts(v.status[m]).withColumn("model", F.lit(m))
    return one("a").unionByName(one("b"))


@query("agg4_false_positive_counts", "category_id:i fp_type:s count:i", "fp_a", "SELECT category_id, fp_type, count(*) AS count FROM fp_a GROUP BY 1, 2")
def _(v):
    return B.status_counts(v.false_positives["a"], "fp_type")


@query("agg5_agreement_matrix", "outcome:s count:i share:d", "wide", "SELECT CASE WHEN a_detected AND b_detected THEN 'both_detected' WHEN a_detected THEN 'a_only' WHEN b_detected THEN 'b_only' ELSE 'neither_detected' END AS outcome, count(*) AS count, count(*) / (SELECT count(*) FROM wide) AS share FROM wide GROUP BY 1")
def _(v):
    return B.agreement_matrix(v.wide)


@query("agg5_status_pairs", "a_status:s b_status:s count:i", "wide", "SELECT a_status, b_status, count(*) AS count FROM wide GROUP BY 1, 2")
def _(v):
    return B.status_pairs(v.wide)


def _sets_sql(sets, columns: str, extra: str = "") -> str:
    parts = []
    for dims in sets:
        if dims == ("overall",):
            value, label = "'all'", "overall"
        else:
            value, label = " || '|' || ".join(dims), "_x_".join(dims)
        parts.append(f"SELECT '{label}' AS group_type, {value} AS group_value, {extra} {columns} FROM tax GROUP BY ALL")
    return " UNION ALL ".join(parts)


_RATES = """count(DISTINCT image_id) AS num_images, count(*) AS num_gt, count(*) FILTER (WHERE NOT a_detected) AS a_failures, count(*) FILTER (WHERE NOT b_detected) AS b_failures,
 count(*) FILTER (WHERE NOT a_detected AND NOT b_detected) AS both_failures, count(*) FILTER (WHERE NOT a_detected AND b_detected) AS a_fail_b_ok, count(*) FILTER (WHERE a_detected AND NOT b_detected) AS a_ok_b_fail,
 a_failures / num_gt AS a_failures_rate, b_failures / num_gt AS b_failures_rate, both_failures / num_gt AS both_failures_rate, a_fail_b_ok / num_gt AS a_fail_b_ok_rate, a_ok_b_fail / num_gt AS a_ok_b_fail_rate"""
_RATE_SPEC = "group_type:s group_value:s num_images:i num_gt:i a_failures:i b_failures:i both_failures:i a_fail_b_ok:i a_ok_b_fail:i a_failures_rate:d b_failures_rate:d both_failures_rate:d a_fail_b_ok_rate:d a_ok_b_fail_rate:d"


@query("agg6_failure_rates", _RATE_SPEC, "tax", _sets_sql(B.GROUPING_SETS, _RATES))
def _(v):
    return B.failure_rates(v.tax)


@query("agg7_taxonomy_shares", "group_type:s group_value:s taxonomy:s count:i share_of_gt:d share_of_a_failures:d", "tax", f"""SELECT *, count / sum(count) OVER (PARTITION BY group_type, group_value) AS share_of_gt, CASE WHEN f > 0 THEN f / sum(f) OVER (PARTITION BY group_type, group_value) END AS share_of_a_failures
 FROM ({_sets_sql(B.GROUPING_SETS, "count(*) AS count, count(*) FILTER (WHERE NOT a_detected) AS f", "taxonomy,")})""")
def _(v):
    return B.taxonomy_shares(v.tax)


@query("agg8_evidence_shares", "group_type:s group_value:s evidence:s count:i share_of_applicable:d", "tax", f"""SELECT *, CASE WHEN evidence <> 'not_applicable' THEN count / sum(count) FILTER (WHERE evidence <> 'not_applicable') OVER (PARTITION BY group_type, group_value) END AS share_of_applicable
 FROM ({_sets_sql(B.GROUPING_SETS, "count(*) AS count", "evidence,")})""")
def _(v):
    return B.evidence_shares(v.tax)


@query("agg9_failure_matrix", "group_type:s group_value:s failure_type:s count:i share:d", "tax", f"SELECT *, count / sum(count) OVER (PARTITION BY group_type, group_value) AS share FROM ({_sets_sql(B.MATRIX_SETS, 'count(*) AS count', 'failure_type,')})")
def _(v):
    return B.failure_matrix(v.tax)


@query("agg9_failure_modes", "group_type:s group_value:s category:s a_status:s failure_type:s count:i", "tax", _sets_sql(B.MATRIX_SETS, "count(*) AS count", "category, a_status, failure_type,").replace("FROM tax", "FROM tax WHERE NOT a_detected"))
def _(v):
    return B.failure_modes(v.tax)


@query("agg10_interactions", _RATE_SPEC, "tax", _sets_sql(B.THREE_WAY_SETS, _RATES))
def _(v):
    return B.interactions(v.tax)


@query("agg11_image_risk", "image_id:i split:s num_objects:i num_small_objects:i risk_mean:d risk_max:d risk_p90:d small_risk_mean:d disagreement_mean:d high_or_critical_fraction:d", "risk images", """SELECT i.image_id, i.split, count(r.image_id) AS num_objects, count(*) FILTER (WHERE scale = 'small') AS num_small_objects, avg(risk_score) AS risk_mean, max(risk_score) AS risk_max, quantile_cont(risk_score, 0.9) AS risk_p90,
 avg(risk_score) FILTER (WHERE scale = 'small') AS small_risk_mean, avg(disagreement) AS disagreement_mean, avg(CASE WHEN risk_score >= 0.75e0 THEN 1e0 WHEN r.image_id IS NOT NULL THEN 0e0 END) AS high_or_critical_fraction FROM images i LEFT JOIN risk r ON r.image_id = i.image_id GROUP BY 1, 2""")
def _(v):
    return RI.image_risk(v.risk, v.images)


_QUANTILES = ", ".join(f"quantile_cont(v, {q}) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
_DIST = f"count(v) AS count, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, {_QUANTILES}"
_DIST_SPEC = "count:i mean:d std:d min:d max:d p10:d p25:d p50:d p75:d p90:d p95:d p99:d"


@query("agg12_distribution_overall", _DIST_SPEC, "risk", f"SELECT {_DIST} FROM (SELECT joint_raw_risk AS v FROM risk)")
def _(v):
    return RK.distribution(v.risk, "joint_raw_risk")


@query("agg12_distribution_by_class", f"category_id:i {_DIST_SPEC}", "objects", f"SELECT category_id, {_DIST} FROM (SELECT category_id, area AS v FROM objects) GROUP BY 1")
def _(v):
    return RK.distribution(v.objects, "area", ["category_id"])


@query("agg13_failure_subsets", "subset:s annotation_id:i", "members", "SELECT subset, annotation_id FROM members")
def _(v):
    return v.members


@query("agg13_subset_summary", "subset:s objects:i images:i mean_risk:d small_objects:i medium_objects:i large_objects:i", "members", "SELECT subset, count(*) AS objects, count(DISTINCT image_id) AS images, avg(risk_score) AS mean_risk, " + ", ".join(f"count(*) FILTER (WHERE scale = '{s}') AS {s}_objects" for s in K.SCALES) + " FROM members GROUP BY 1")
def _(v):
    return RI.subset_summary(v.members)


@query("agg13_subset_classes", "subset:s category_id:i objects:i", "members", "SELECT subset, category_id, count(*) AS objects FROM members GROUP BY 1, 2")
def _(v):
    return RI.subset_classes(v.members)


_PAIR_ROWS = " UNION ALL ".join(
    f"SELECT '{a}' AS subset_a, '{b}' AS subset_b, count(*) FILTER (WHERE ({x}) AND ({y})) AS \"intersection\", count(*) FILTER (WHERE ({x}) OR ({y})) AS \"union\" FROM risk"
    for a, x in O.SUBSETS.items()
    for b, y in O.SUBSETS.items()
)


@query("agg14_subset_overlap", "subset_a:s subset_b:s intersection:i union:i jaccard:d", "risk", f'SELECT *, CASE WHEN "union" > 0 THEN "intersection" / "union" ELSE 1 END AS jaccard FROM ({_PAIR_ROWS})')
def _(v):
    return RI.subset_overlap(v.risk)


_EVENTS = "(SELECT d.prediction_index, d.category_id, d.score, CASE WHEN g.prediction_index IS NULL THEN 0 ELSE 1 END AS is_tp FROM d_a d LEFT JOIN (" + O.greedy_sql("pairs_a", "image_id, gc", 0.5, where="gc = dc") + ") g USING (prediction_index))"
O.cte("det_events", "d_a pairs_a", f"SELECT * FROM {_EVENTS}")
_PRF = """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (SELECT *, gt - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN gt > 0 THEN tp / gt ELSE 0 END AS recall, gt >= 100 AS eligible FROM (
 SELECT category_id, coalesce(gt, 0) AS gt, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp FROM (SELECT category_id, count(*) AS gt FROM objects GROUP BY 1) FULL JOIN (SELECT category_id, sum(is_tp) AS tp, sum(1 - is_tp) AS fp FROM det_events GROUP BY 1) USING (category_id)))"""
_MACRO = """SELECT *, CASE WHEN micro_precision + micro_recall > 0 THEN 2 * micro_precision * micro_recall / (micro_precision + micro_recall) ELSE 0 END AS micro_f1 FROM (
 SELECT {keys} avg(precision) FILTER (WHERE eligible) AS macro_precision, avg(recall) FILTER (WHERE eligible) AS macro_recall, avg(f1) FILTER (WHERE eligible) AS macro_f1, sum(tp) AS total_tp, sum(fp) AS total_fp, sum(fn) AS total_fn,
 CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0 END AS micro_precision, CASE WHEN sum(gt) > 0 THEN sum(tp) / sum(gt) ELSE 0 END AS micro_recall FROM ({rows}) GROUP BY ALL)"""
_MACRO_SPEC = "macro_precision:d macro_recall:d macro_f1:d micro_precision:d micro_recall:d micro_f1:d total_tp:i total_fp:i total_fn:i"


@query("agg15_prf_per_class", "category_id:i gt:i tp:i fp:i fn:i precision:d recall:d f1:d eligible:b", "objects det_events", _PRF)
def _(v):
    return C.prf_per_class(v.events, v.gt_counts)


@query("agg15_prf", _MACRO_SPEC, "objects det_events", _MACRO.format(keys="", rows=_PRF))
def _(v):
    return C.prf(v.events, v.gt_counts)


_TWELVE = "AP AP50 AP75 AP_small AP_medium AP_large AR1 AR10 AR100 AR_small AR_medium AR_large".split()
_TWELVE_SPEC = " ".join(f"{m}:d" for m in _TWELVE)


@query("agg16_coco_eval", f"model:s {_TWELVE_SPEC}", "summary_a summary_b", "SELECT 'a' AS model, * FROM summary_a UNION ALL SELECT 'b', * FROM summary_b")
def _(v):
    one = lambda m: P.coco_eval(v.objects, v.dets[m], cells=v.cells[m]).withColumn("model", F.lit(m))
    return one("a").unionByName(one("b"))


@query("agg16_coco_eval_crowds", _TWELVE_SPEC, "summary_crowd", "SELECT * FROM summary_crowd")
def _(v):
    return P.coco_eval(v.crowds, v.dets["a"], v.crowd_cache)


@query("agg16_crowd_matches", "area:i threshold:i hits:i ignored:i", "hit_crowd", "SELECT area, thr AS threshold, sum(tp) AS hits, sum(ign) AS ignored FROM hit_crowd GROUP BY 1, 2")
def _(v):
    cells = F.inline(F.expr(f"transform(sequence(0, {P.CELLS - 1}), c -> struct(c DIV {P.THRESHOLDS} AS area, c % {P.THRESHOLDS} AS threshold, shiftright(tp, c) & 1 AS hit, shiftright(ignored, c) & 1 AS ign))"))
    return v.crowd_cache.select(cells).groupBy("area", "threshold").agg(F.sum("hit").alias("hits"), F.sum("ign").alias("ignored"))


@query("agg17_coco_eval_per_class", "category_id:i AP:d AP50:d AP75:d AR100:d objects:i detections:i images_with_object:i images_with_detection:i", "classes_a objects d_a", """SELECT * FROM classes_a JOIN (SELECT category_id, count(*) AS objects, count(DISTINCT image_id) AS images_with_object FROM objects GROUP BY 1) USING (category_id)
 JOIN (SELECT category_id, count(*) AS detections, count(DISTINCT image_id) AS images_with_detection FROM d_a GROUP BY 1) USING (category_id)""")
def _(v):
    return P.coco_eval_per_class(v.objects, v.dets["a"], cells=v.cells["a"])


@query("agg18_coco_eval_by_condition", f"dimension:s value:s images:i role:s {_TWELVE_SPEC} delta_AP:d retention_AP:d", "summary_cond membership", """SELECT s.*, images, CASE WHEN dimension = 'overall' THEN 'overall' WHEN images >= 100 AND value <> 'undefined' THEN 'primary' ELSE 'supplementary' END AS role, "AP" - o AS "delta_AP", CASE WHEN o > 0 THEN "AP" / o END AS "retention_AP"
 FROM summary_cond s JOIN (SELECT dimension, value, count(*) AS images FROM membership GROUP BY 1, 2) USING (dimension, value), (SELECT "AP" AS o FROM summary_cond WHERE dimension = 'overall')""")
def _(v):
    return P.coco_eval_by_condition(v.objects, v.dets["a"], v.images, cache=v.cache["a"])


def _recovery_sql(tie: str) -> str:
    return f"""SELECT subset, sum(gt) AS objects, avg(r) AS "AR100", sum(n50) / sum(gt) AS recall50 FROM (
 SELECT subset, category_id, max(gt) AS gt, avg(n / gt) AS r, sum(n) FILTER (WHERE thr = 0) AS n50 FROM (
  SELECT g.subset, g.category_id, g.thr, g.gt, coalesce(f.n, 0) AS n FROM (SELECT subset, category_id, count(*) AS gt, unnest(range(10)) AS thr FROM members GROUP BY 1, 2) g
  LEFT JOIN (SELECT subset, gc AS category_id, thr, sum(len(list_reduce(ps, {O.TAKE}, ps[1:0]))) AS n FROM (
   SELECT s.subset, x.image_id, x.gc, c.thr, list(struct_pack(p := x.p, a := x.a) ORDER BY x.score DESC, x.p, x.iou DESC, {tie}) AS ps FROM pairs_a x JOIN cut_a r ON r.prediction_index = x.p
   JOIN members s ON s.annotation_id = x.a JOIN cells c ON c.area = 0 AND x.iou >= c.iou WHERE gc = dc GROUP BY ALL) GROUP BY 1, 2, 3) f USING (subset, category_id, thr)) GROUP BY 1, 2) GROUP BY 1"""


O.cte("recovery", "members pairs_a cut_a cells", _recovery_sql("x.a"))


@query("agg19_subset_recovery", "subset:s objects:i AR100:d recall50:d", "recovery", "SELECT * FROM recovery")
def _(v):
    return P.subset_recovery(v.members, v.objects, v.dets["a"])


@query("agg19_macro_recovery", "macro_AR100:d subsets:i", "recovery", """SELECT avg("AR100") AS "macro_AR100", count(*) AS subsets FROM recovery WHERE subset <> 'small_high_risk'""")
def _(v):
    return P.macro_recovery(P.subset_recovery(v.members, v.objects, v.dets["a"]))
