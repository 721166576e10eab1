"""Registered queries of calibration, risk, sampling, crops, statistics, curves and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise import constants as K
from boxwise.catalog import oracle as O
from boxwise.catalog.queries import _MACRO, _MACRO_SPEC, _RATES, _RATE_SPEC, _TWELVE, _TWELVE_SPEC, _sets_sql, query
from boxwise.catalog.views import SCORES, Views
from boxwise.functions import geometry as G
from boxwise.functions import risk as RF
from boxwise.functions.hashing import hash_rank
from boxwise.operators import breakdown as B
from boxwise.operators import calibrate as C
from boxwise.operators import crops as CR
from boxwise.operators import curves as CU
from boxwise.operators import matching as M
from boxwise.operators import prep as PR
from boxwise.operators import ranking as RK
from boxwise.operators import risk as RI
from boxwise.operators import sampling as S
from boxwise.operators import segments as SG
from boxwise.operators import sensitivity as SE
from boxwise.operators import stats as ST
from boxwise.session import materialize, written, shared_folder
from boxwise.sources import readers as RD
from boxwise.sources import writers as WR

# --- windows and ranking --------------------------------------------------------------------


@query("win1_mid_percentile_global", "annotation_id:i percentile:d", "objects", f"SELECT annotation_id, {O.mid_sql('area')} AS percentile FROM objects")
def _(v):
    return RK.mid_percentile(v.objects, "area")


@query("win1_mid_percentile_by_class", "annotation_id:i percentile:d", "objects", f"SELECT annotation_id, {O.mid_sql('area', 'category_id')} AS percentile FROM objects")
def _(v):
    return RK.mid_percentile(v.objects, "area", ["category_id"])


def _at(points: str) -> str:
    """Summary rows per threshold t of ``points``, from conditional counts."""
    rows = f"""SELECT t, category_id, gt, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, gt - coalesce(tp, 0) AS fn, gt >= 100 AS eligible,
 CASE WHEN coalesce(tp, 0) + coalesce(fp, 0) > 0 THEN coalesce(tp, 0) / (tp + fp) ELSE 0 END AS precision, coalesce(tp, 0) / gt AS recall
 FROM (SELECT t, category_id, count(*) AS gt FROM objects, ({points}) GROUP BY 1, 2) LEFT JOIN (SELECT t, category_id, sum(is_tp) AS tp, sum(1 - is_tp) AS fp FROM det_events JOIN ({points}) ON score >= t GROUP BY 1, 2) USING (t, category_id)"""
    rows = f"SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ({rows})"
    return _MACRO.format(keys="t,", rows=rows)


@query("win4_threshold_sweep", f"threshold:d {_MACRO_SPEC}", "objects det_events", f"SELECT *, t AS threshold FROM ({_at('SELECT DISTINCT score AS t FROM det_events')}) ORDER BY round(macro_f1, 14) DESC, round(macro_recall, 14) DESC, t DESC LIMIT 1")
def _(v):
    return C.threshold_sweep(v.events, v.gt_counts)


_GRID = "SELECT i / 100e0 AS t FROM range(101) r(i) UNION ALL SELECT 0.305e0"


@query("win5_threshold_grid", f"threshold:d chosen:b {_MACRO_SPEC}", "objects det_events", f"SELECT *, t AS threshold, t = 0.305e0 AS chosen FROM ({_at(_GRID)})")
def _(v):
    return C.threshold_grid(v.events, v.gt_counts, 0.305)


@query("win6_interaction_priority", f"{_RATE_SPEC} priority_rank:i", "tax", f"SELECT *, row_number() OVER (PARTITION BY group_type ORDER BY a_failures_rate DESC, group_value) AS priority_rank FROM ({_sets_sql(B.THREE_WAY_SETS, _RATES)}) WHERE num_gt >= 20")
def _(v):
    return B.interaction_priority(B.interactions(v.tax), 20)


O.cte("curves", "", """SELECT CASE o_orderstatus WHEN 'F' THEN 'common' WHEN 'O' THEN 'uniform' ELSE 'risk' END AS arm, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS epoch,
 avg(CAST(o_custkey % 1000 AS DOUBLE)) / 1000 AS "AP", avg(CAST(o_orderkey % 997 AS DOUBLE)) / 997 AS "AP75", avg(CAST((o_orderkey * 7) % 1009 AS DOUBLE)) / 1009 AS lr FROM orders GROUP BY 1, 2""")


@query("win7_select_best", "arm:s epoch:i AP:d maximum:d", "curves", """SELECT arm, epoch, "AP", maximum FROM (SELECT *, max("AP") OVER (PARTITION BY arm) AS maximum FROM curves) WHERE "AP" >= maximum - 0.0005e0 QUALIFY row_number() OVER (PARTITION BY arm ORDER BY epoch) = 1""")
def _(v):
    return CU.select_best(v.curves, ["arm"])


@query("win8_sustained_decline", "arm:s peak:d peak_epoch:i decline_epoch:i", "curves", """SELECT arm, peak, peak_epoch, (SELECT min(c.epoch) FROM curves c WHERE c.arm = p.arm AND c.epoch > peak_epoch AND NOT EXISTS (SELECT 1 FROM curves l WHERE l.arm = p.arm AND l.epoch >= c.epoch AND l."AP" > peak - 0.002e0)) AS decline_epoch
 FROM (SELECT arm, max("AP") AS peak, arg_max(epoch, ("AP", -epoch)) AS peak_epoch FROM curves GROUP BY 1) p""")
def _(v):
    return CU.sustained_decline(v.curves, ["arm"])


@query("win9_normalized_auc", "arm:s auc:d", "curves", """SELECT arm, sum((epoch - pe) * ("AP" + pv) / 2) / (max(epoch) - min(epoch)) AS auc FROM (SELECT *, lag(epoch) OVER w AS pe, lag("AP") OVER w AS pv FROM curves WINDOW w AS (PARTITION BY arm ORDER BY epoch)) GROUP BY 1""")
def _(v):
    return CU.normalized_auc(v.curves, ["arm"], "AP")


@query("win10_curve_summary", "arm:s epochs:i first:d last:d first_mean:d last_mean:d last_slope:d", "curves", """SELECT arm, count(*) AS epochs, max(lr) FILTER (WHERE i = 1) AS first, max(lr) FILTER (WHERE j = 1) AS last, avg(lr) FILTER (WHERE i <= 5) AS first_mean, avg(lr) FILTER (WHERE j <= 5) AS last_mean,
 regr_slope(lr, i) FILTER (WHERE j <= 10) AS last_slope FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY epoch) AS i, row_number() OVER (PARTITION BY arm ORDER BY epoch DESC) AS j FROM curves) GROUP BY 1""")
def _(v):
    return CU.curve_summary(v.curves, ["arm"], "lr")


# --- risk functions -------------------------------------------------------------------------


@query("sc1_confidence_support", "prediction_index:i support:d", "d_a", f"SELECT prediction_index, {O.support_sql('score', 0.22)} AS support FROM d_a")
def _(v):
    return v.dets["a"].withColumn("support", RF.confidence_support(F.col("score"), 0.22))


@query("sc2_detector_quality", "annotation_id:i a_quality:d b_quality:d", "quality", "SELECT annotation_id, a_quality, b_quality FROM quality")
def _(v):
    return v.risk


@query("sc3_joint_risk", "annotation_id:i consensus_risk:d disagreement:d joint_raw_risk:d", "joint", "SELECT * FROM joint")
def _(v):
    return v.risk


@query("sc4_risk_score", "annotation_id:i global_percentile:d class_percentile:d risk_score:d risk_tier:s", "risk", "SELECT * FROM risk")
def _(v):
    return v.risk


@query("sc5_polygon_support", "prediction_index:i polygon_count:i polygon_area:d inside_area:d inside_ratio:d gt_coverage:d", "seg_area", "SELECT prediction_index, 1 AS polygon_count, area AS polygon_area, inside AS inside_area, inside / area AS inside_ratio, inside / (ow * oh) AS gt_coverage FROM seg_area")
def _(v):
    found = v.evidence.where("prediction_index IS NOT NULL").select("annotation_id", "prediction_index")
    box = v.objects.select("annotation_id", *"xywh")
    return SG.polygon_support(found.join(box, "annotation_id").join(v.segs.select("prediction_index", "polygons"), "prediction_index"))


@query("sc6_evidence_grade", "annotation_id:i evidence:s", "graded", "SELECT annotation_id, evidence FROM graded")
def _(v):
    return v.evidence


@query("sc7_failure_taxonomy", "annotation_id:i taxonomy:s failure_type:s", "tax", "SELECT annotation_id, taxonomy, failure_type FROM tax")
def _(v):
    return v.tax


@query("sc8_letterbox", "annotation_id:i zoom:d short_side:d network_area:d", "objects", "SELECT annotation_id, 0.75e0 AS zoom, least(w, h) * 0.75e0 AS short_side, w * h * 0.5625e0 AS network_area FROM objects")
def _(v):
    o = v.objects.withColumn("zoom", G.letterbox_scale(F.lit(1280.0), F.lit(720.0)))
    return o.selectExpr("annotation_id", "zoom", "least(w, h) * zoom AS short_side", "w * h * zoom * zoom AS network_area")


def _u(ns: str) -> str:
    return O.uniform_sql(f"'{ns}:' || annotation_id", K.SAMPLING_SEED)


def _policy(i: int, policy=K.CROP_POLICY) -> str:
    rows = " ".join(f"WHEN '{g}' THEN {p[i]!r}e0" for g, p in policy.items())
    return f"(CASE failure_group {rows} ELSE {K.CONTROL_CROP[i]!r}e0 END)"


def _start(p: str, size: str, full: str, crop: str, name: str) -> str:
    want = f"({p} + {size} / 2 - {crop} / 2 + ({_u(name)} * 2 - 1) * 0.08e0 * {crop})"
    low, high = f"greatest(0, {p} + {size} - {crop})", f"least({p}, {full} - {crop})"
    return f"least(greatest(0, round_even(CASE WHEN {low} <= {high} THEN least(greatest({want}, {low}), {high}) ELSE least(greatest({want}, 0), {full} - {crop}) END, 0)), {full} - {crop})"


def _crops_sql(policy=K.CROP_POLICY) -> str:
    return f"""SELECT *, {_start('x', 'w', '1280e0', 'crop_width', 'crop_x')} AS crop_x0, {_start('y', 'h', '720e0', 'crop_height', 'crop_y')} AS crop_y0 FROM (
 SELECT *, least(1280, greatest(1, round_even(greatest(least(1280e0, cw), w), 0))) AS crop_width, least(720, greatest(1, round_even(greatest(least(720e0, ch), h), 0))) AS crop_height FROM (
  SELECT *, least(t * 16 / 9, 1280e0) AS cw, CASE WHEN t * 16 / 9 > 1280 THEN 720e0 ELSE t END AS ch FROM (
   SELECT g.annotation_id, g.image_id, g.category_id, g.failure_group, g.risk_score, o.x, o.y, o.w, o.h, least(greatest({_policy(0, policy)}, o.h * f, o.w * f * 9 / 16), {_policy(1, policy)}, 720e0) AS t
   FROM (SELECT *, {_policy(2, policy)} + ({_policy(3, policy)} - {_policy(2, policy)}) * {_u('crop_factor')} AS f FROM grouped WHERE failure_group <> 'standard_support') g
   JOIN objects o USING (annotation_id) JOIN images i ON i.image_id = g.image_id WHERE i.split = 'core')))"""


O.cte("crops", "grouped images", _crops_sql())
O.cte("balanced_crops", "grouped images", _crops_sql(K.BALANCED_CROP_POLICY))


@query("sc9_plan_crops", "annotation_id:i crop_x0:d crop_y0:d crop_width:d crop_height:d", "crops", "SELECT * FROM crops")
def _(v):
    return v.crops


@query("sc9_plan_crops_balanced", "annotation_id:i crop_x0:d crop_y0:d crop_width:d crop_height:d", "balanced_crops", "SELECT * FROM balanced_crops")
def _(v):
    return CR.plan_crops(v.crop_targets, K.BALANCED_CROP_POLICY)


O.cte("near", "crops objects", """SELECT *, iw * ih / (ow * oh) AS visible, object_id = annotation_id AS is_target, ox + ow / 2 BETWEEN crop_x0 AND crop_x0 + crop_width AND oy + oh / 2 BETWEEN crop_y0 AND crop_y0 + crop_height AS centre_inside FROM (
 SELECT c.*, o.annotation_id AS object_id, o.category_id AS oc, o.x AS ox, o.y AS oy, o.w AS ow, o.h AS oh, greatest(o.x, crop_x0) AS ix, greatest(o.y, crop_y0) AS iy,
 greatest(0, least(o.x + o.w, crop_x0 + crop_width) - greatest(o.x, crop_x0)) AS iw, greatest(0, least(o.y + o.h, crop_y0 + crop_height) - greatest(o.y, crop_y0)) AS ih FROM crops c JOIN objects o USING (image_id))""")
O.cte("kept", "near", "SELECT *, is_target OR (centre_inside AND visible >= 0.5 AND iw >= 2 AND ih >= 2) AS supervised FROM near")


@query("jn14_crop_neighbours", "annotation_id:i object_id:i visible:d centre_inside:b retained:b removed:b clipped:b supervised:b", "kept", "SELECT *, visible >= 0.5 AS retained, iw * ih <= 0 AS removed, iw * ih > 0 AND visible < 1 - 1e-12 AS clipped FROM kept")
def _(v):
    return CR.crop_neighbours(v.crops, v.objects)


O.cte("board_near", "crops objects", """SELECT c.annotation_id, c.image_id // 256 AS board, crop_x0, crop_y0, crop_x0 + crop_width AS x1, crop_y0 + crop_height AS y1 FROM crops c""")
O.cte("board_seen", "board_near", """SELECT n.annotation_id, o.annotation_id = n.annotation_id AS own, greatest(0, least(o.x + o.w, x1) - greatest(o.x, crop_x0)) * greatest(0, least(o.y + o.h, y1) - greatest(o.y, crop_y0)) AS shared, o.w * o.h AS whole
 FROM board_near n JOIN objects o ON o.image_id // 256 = n.board""")


@query("jn14_dense_context", "annotation_id:i source_neighbor_count:i retained_neighbor_count:i fully_removed_objects:i boundary_clipped_objects:i", "board_seen", """SELECT annotation_id, count(*) FILTER (NOT own) AS source_neighbor_count, count(*) FILTER (NOT own AND shared / whole >= 0.5) AS retained_neighbor_count,
 count(*) FILTER (NOT own AND shared <= 0) AS fully_removed_objects, count(*) FILTER (NOT own AND shared > 0 AND shared / whole < 1 - 1e-12) AS boundary_clipped_objects FROM board_seen GROUP BY 1""")
def _(v):
    """Context of the crops on boards of 256 order keys: crops meet the objects that they overlap, others are counted by board."""
    board = F.shiftright("image_id", 8)
    return CR.crop_context(v.crops.withColumn("image_id", board), v.objects.withColumn("image_id", board))


O.cte("inside", "kept", "SELECT annotation_id, object_id, is_target, oc - 1 AS class_index, (ix - crop_x0 + iw / 2) / crop_width AS cx, (iy - crop_y0 + ih / 2) / crop_height AS cy, iw / crop_width AS nw, ih / crop_height AS nh FROM kept WHERE supervised AND iw > 0 AND ih > 0")


@query("sc10_crop_labels", "annotation_id:i object_id:i is_target:b class_index:i cx:d cy:d nw:d nh:d", "inside", "SELECT * FROM inside")
def _(v):
    return CR.crop_labels(v.crops, v.objects)


_SC = O.SCALE.format
O.cte("ctx", "kept", f"""SELECT *, crop_width * crop_height / (1280e0 * 720) AS crop_area_over_source_area, ca / (crop_width * crop_height) AS target_area_over_crop_area, cs * z / (least(w, h) * 0.75e0) AS short_side_amplification, ca * z * z / (w * h * 0.5625e0) AS area_amplification,
 {_SC('w * h')} AS original_scale, {_SC('ca')} AS crop_native_scale, {_SC('(w * h * 0.5625e0)')} AS full_scene_network_scale, {_SC('(ca * z * z)')} AS crop_network_scale,
 CASE WHEN n > 0 THEN r / n END AS neighbor_retention_fraction, least(tx - crop_x0, ty - crop_y0, crop_x0 + crop_width - tx - tw, crop_y0 + crop_height - ty - th) / cs AS minimum_context_margin, crop_object_count - (n + 1) AS objects_per_view_change FROM (
 SELECT *, tw * th AS ca, least(tw, th) AS cs, least(960 / crop_width, 960 / crop_height) AS z FROM (
  SELECT annotation_id, image_id, category_id, failure_group, risk_score, w, h, crop_x0, crop_y0, crop_width, crop_height, count(*) FILTER (WHERE NOT is_target) AS n, count(*) FILTER (WHERE NOT is_target AND visible >= 0.5) AS r,
  count(*) FILTER (WHERE NOT is_target AND iw * ih <= 0) AS fully_removed_objects, count(*) FILTER (WHERE supervised) AS crop_object_count, max(ix) FILTER (WHERE is_target) AS tx, max(iy) FILTER (WHERE is_target) AS ty, max(iw) FILTER (WHERE is_target) AS tw, max(ih) FILTER (WHERE is_target) AS th FROM kept GROUP BY ALL))""")


@query("agg22_crop_context", "annotation_id:i original_scale:s crop_native_scale:s full_scene_network_scale:s crop_network_scale:s fully_removed_objects:i " + " ".join(f"{m}:d" for m in CR.SHIFT_MEASURES), "ctx", "SELECT * FROM ctx")
def _(v):
    return v.context


@query("agg22_crop_shift_summary", "failure_group:s targets:i original_small:i ceased_small:i ceased_fraction:d neighbors:i retained:i retention:d", "ctx", """SELECT *, CASE WHEN original_small > 0 THEN ceased_small / original_small END AS ceased_fraction, CASE WHEN neighbors > 0 THEN retained / neighbors END AS retention FROM (
 SELECT failure_group, count(*) AS targets, count(*) FILTER (WHERE original_scale = 'small') AS original_small, count(*) FILTER (WHERE original_scale = 'small' AND crop_network_scale <> 'small') AS ceased_small, sum(n) AS neighbors, sum(r) AS retained FROM ctx GROUP BY 1)""")
def _(v):
    return CR.crop_shift_summary(v.context, ["failure_group"])


_Q = ", ".join(f"quantile_cont(v, {q}) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))


@query("agg22_crop_shift_distributions", "category_id:i measure:s count:i mean:d std:d min:d max:d p10:d p25:d p50:d p75:d p90:d p95:d p99:d", "ctx", f"SELECT category_id, measure, count(v) AS count, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, {_Q} FROM (" + " UNION ALL ".join(f"SELECT category_id, '{m}' AS measure, CAST({m} AS DOUBLE) AS v FROM ctx" for m in CR.SHIFT_MEASURES) + ") WHERE v IS NOT NULL GROUP BY 1, 2")
def _(v):
    return CR.crop_shift_distributions(v.context, ["category_id"])


_TRANS = [("original_image", "original_scale", "crop_before_resize", "crop_native_scale"), ("original_image", "original_scale", "network_input", "crop_network_scale"), ("full_scene_network_input", "full_scene_network_scale", "network_input", "crop_network_scale")]


@query("agg23_scale_transitions", "source_space:s source_scale:s target_space:s target_scale:s objects:i fraction_within_source_scale:d", "ctx", "SELECT *, objects / sum(objects) OVER (PARTITION BY source_space, source_scale, target_space) AS fraction_within_source_scale FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS source_space, {b} AS source_scale, '{c}' AS target_space, {d} AS target_scale, count(*) AS objects FROM ctx GROUP BY 2, 4" for a, b, c, d in _TRANS) + ")")
def _(v):
    return CR.scale_transitions(v.context)


O.cte("views", "images crops", """SELECT 'uniform' AS arm, 'u' || image_id AS view_id, image_id, 'original' AS kind, 1280e0 AS width, 720e0 AS height FROM images WHERE split = 'core'
 UNION ALL SELECT 'risk', 'r' || image_id, image_id, 'original', 1280e0, 720e0 FROM images WHERE split = 'core' AND image_id % 3 <> 0
 UNION ALL SELECT 'risk', 'c' || annotation_id, image_id, 'crop', crop_width, crop_height FROM crops""")
O.cte("view_labels", "views inside objects images", """SELECT 'u' || image_id AS view_id, category_id - 1 AS class_index, w / 1280 AS nw, h / 720 AS nh FROM objects JOIN images USING (image_id) WHERE split = 'core'
 UNION ALL SELECT 'r' || image_id, category_id - 1, w / 1280, h / 720 FROM objects JOIN images USING (image_id) WHERE split = 'core' AND image_id % 3 <> 0
 UNION ALL SELECT 'c' || annotation_id, class_index, nw, nh FROM inside""")


@query("agg20_exposure_summary", "arm:s training_views:i original_views:i object_centric_views:i unique_source_images:i total_supervised_objects:i target_objects:i non_target_objects:i objects_per_view:d raw_input_pixels:d network_input_pixels:d objects_per_million_raw_pixels:d mean_source_exposures:d maximum_source_exposures:i", "views view_labels crops", """SELECT *, total_supervised_objects - target_objects AS non_target_objects, total_supervised_objects / training_views AS objects_per_view, training_views * 921600e0 AS network_input_pixels, total_supervised_objects / raw_input_pixels * 1e6 AS objects_per_million_raw_pixels, training_views / unique_source_images AS mean_source_exposures FROM (
 SELECT arm, count(*) AS training_views, count(*) FILTER (WHERE kind = 'original') AS original_views, count(*) FILTER (WHERE kind = 'crop') AS object_centric_views, count(DISTINCT image_id) AS unique_source_images, sum(width * height) AS raw_input_pixels FROM views GROUP BY 1)
 JOIN (SELECT arm, count(*) AS total_supervised_objects FROM views JOIN view_labels USING (view_id) GROUP BY 1) USING (arm)
 JOIN (SELECT arm, sum(CASE WHEN kind = 'original' THEN coalesce(n, 0) ELSE 1 END) AS target_objects FROM views LEFT JOIN (SELECT image_id, count(*) AS n FROM crops GROUP BY 1) USING (image_id) GROUP BY 1) USING (arm)
 JOIN (SELECT arm, max(n) AS maximum_source_exposures FROM (SELECT arm, image_id, count(*) AS n FROM views GROUP BY 1, 2) GROUP BY 1) USING (arm)""")
def _(v):
    return CR.exposure_summary(*v.exposure)


@query("agg21_source_exposure_histogram", "arm:s exposures:i source_images:i", "views", "SELECT arm, n AS exposures, count(*) AS source_images FROM (SELECT arm, image_id, count(*) AS n FROM views GROUP BY 1, 2) GROUP BY 1, 2")
def _(v):
    return CR.source_exposure_histogram(v.exposure[0])


@query("agg21_objects_per_view", "arm:s objects_in_view:i views:i", "views view_labels", "SELECT arm, coalesce(n, 0) AS objects_in_view, count(*) AS views FROM views LEFT JOIN (SELECT view_id, count(*) AS n FROM view_labels GROUP BY 1) USING (view_id) GROUP BY 1, 2")
def _(v):
    return CR.objects_per_view_histogram(*v.exposure[:2])


@query("agg21_label_exposure", "arm:s kind:s item:s count:i fraction:d", "views view_labels", f"""SELECT g.arm, g.kind, g.item, coalesce(c.n, 0) AS count, coalesce(c.n, 0) / sum(c.n) OVER (PARTITION BY g.arm, g.kind) AS fraction FROM (SELECT arm, 'class' AS kind, CAST(unnest(range(10)) AS VARCHAR) AS item FROM (SELECT DISTINCT arm FROM views)
  UNION ALL SELECT arm, k, unnest(['small', 'medium', 'large']) FROM (SELECT DISTINCT arm FROM views), (SELECT unnest(['native_scale', 'network_scale']) AS k)) g
 LEFT JOIN (SELECT arm, kind, item, count(*) AS n FROM (SELECT arm, unnest(['class', 'native_scale', 'network_scale']) AS kind, unnest([CAST(class_index AS VARCHAR), {_SC('a')}, {_SC('(a * z * z)')}]) AS item FROM (SELECT *, nw * width * nh * height AS a, least(960 / width, 960 / height) AS z FROM views JOIN view_labels USING (view_id))) GROUP BY ALL) c USING (arm, kind, item)""")
def _(v):
    return CR.label_exposure(*v.exposure[:2])


# --- robustness and measures ------------------------------------------------------------------

_FAMILY = "([" + ", ".join(f"'{c}'" for c in K.CORRUPTIONS) + "])[CAST(l_suppkey % 5 + 1 AS INTEGER)]"
O.cte("corruptions", "", f"""SELECT 'm' || (l_linenumber % 3) AS model, {_FAMILY} AS corruption, 1 + l_partkey % 3 AS severity, avg(l_quantity) / 100 AS "AP", avg(CAST(l_orderkey % 101 AS DOUBLE)) / 101 AS "AP_small", avg(CAST(l_partkey % 97 AS DOUBLE)) / 97 AS "AP75" FROM lineitem GROUP BY 1, 2, 3""")
O.cte("clean", "", """SELECT 'm' || (l_linenumber % 3) AS model, avg(l_quantity) / 60 AS "AP", avg(CAST(l_orderkey % 101 AS DOUBLE)) / 90 AS "AP_small", avg(CAST(l_partkey % 97 AS DOUBLE)) / 80 AS "AP75" FROM lineitem GROUP BY 1""")
_M3 = ["AP", "AP_small", "AP75"]


@query("agg24_corruption_summary", "model:s corruption:s variants:i mean_AP:d mean_AP_small:d mean_AP75:d worst_AP:d worst_severity:i", "corruptions", """SELECT model, corruption, count(*) AS variants, avg("AP") AS "mean_AP", avg("AP_small") AS "mean_AP_small", avg("AP75") AS "mean_AP75", min("AP") AS "worst_AP", arg_min(severity, ("AP", severity)) AS worst_severity FROM corruptions GROUP BY 1, 2""")
def _(v):
    return ST.corruption_summary(v.corruption_metrics, _M3)


@query("agg25_retention", "model:s corruption:s severity:i " + " ".join(f"{m}_drop:d {m}_relative_drop:d {m}_retention:d" for m in _M3), "corruptions clean", "SELECT x.model, corruption, severity, " + ", ".join(f'c."{m}" - x."{m}" AS "{m}_drop", (c."{m}" - x."{m}") / c."{m}" AS "{m}_relative_drop", x."{m}" / c."{m}" AS "{m}_retention"' for m in _M3) + " FROM corruptions x JOIN clean c USING (model)")
def _(v):
    return ST.retention(v.corruption_metrics, v.clean_metrics, _M3)


O.cte("measures", "", "SELECT event_type AS model, count(value) AS samples, avg(value) AS mean, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1")


@query("agg26_measure_summary", "model:s samples:i mean:d median:d p90:d", "measures", "SELECT * FROM measures")
def _(v):
    return ST.measure_summary(v.table("events").withColumnRenamed("event_type", "model"))


@query("agg26_measure_difference", "model:s median_difference:d p90_difference:d mean_difference:d median_increase:d p90_increase:d mean_increase:d", "measures", "SELECT m.model, " + ", ".join(f"m.{c} - b.{c} AS {c}_difference, (m.{c} - b.{c}) / b.{c} AS {c}_increase" for c in ("median", "p90", "mean")) + " FROM measures m, (SELECT * FROM measures WHERE model = 'view') b")
def _(v):
    return ST.measure_difference(ST.measure_summary(v.table("events").withColumnRenamed("event_type", "model")), "view")


# --- sampling ---------------------------------------------------------------------------------


def _h(label: str, seed: int = K.SAMPLING_SEED) -> str:
    return f"substr(sha256('{seed}:' || {label}), 1, 32)"


@query("smp1_hash_rank", "annotation_id:i hash_rank:s", "objects", f"""SELECT annotation_id, {_h("'probe:' || annotation_id")} AS hash_rank FROM objects""")
def _(v):
    return v.objects.withColumn("hash_rank", hash_rank(K.SAMPLING_SEED, "probe", F.col("annotation_id")))


_RANKED_IMAGES = f"""SELECT i.*, row_number() OVER (PARTITION BY timeofday, scene ORDER BY {_h("'dev_split:' || image_id")}, image_id) AS r FROM images i"""


@query("smp2_stratified_split", "image_id:i assigned:s", "images", f"""SELECT image_id, CASE WHEN r <= base + CASE WHEN place <= 100 - total THEN 1 ELSE 0 END THEN 'dev' ELSE 'core' END AS assigned FROM ({_RANKED_IMAGES}) JOIN (
 SELECT *, row_number() OVER (ORDER BY s - floor(s) DESC, timeofday, scene) AS place, floor(s) AS base, sum(floor(s)) OVER () AS total FROM (SELECT timeofday, scene, count(*) * 100 / (SELECT count(*) FROM images) AS s FROM images GROUP BY 1, 2)) USING (timeofday, scene)""")
def _(v):
    return S.stratified_split(v.images, 100)


_W = "(0.05e0 + 0.95e0 * (risk_score * risk_score))"


@query("smp3_weighted_priority", "annotation_id:i priority:d", "risk", f"""SELECT annotation_id, -ln({O.uniform_sql("'race:' || annotation_id", K.SAMPLING_SEED)}) / {_W} AS priority FROM risk""")
def _(v):
    return S.weighted_priority(v.risk, "race")


@query("smp4_failure_group", "annotation_id:i failure_group:s", "grouped", "SELECT annotation_id, failure_group FROM grouped")
def _(v):
    return S.with_failure_group(v.risk)


QUOTAS = {g: max(2, q // 195) for g, q in K.GROUP_QUOTAS.items()}
_CAP = int(sum(QUOTAS.values()) * 0.15)
_ORDER = " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(QUOTAS))
_QUOTA = " ".join(f"WHEN '{g}' THEN {q}" for g, q in QUOTAS.items())
O.cte("typed", "grouped", f"""SELECT unnest(list_reduce(rows, lambda acc, q: CASE WHEN len(list_filter(acc, lambda m: m.g = q.g)) >= q.quota OR len(list_filter(acc, lambda m: m.c = q.c)) >= {_CAP} OR len(list_filter(acc, lambda m: m.i = q.i)) > 0 THEN acc ELSE list_append(acc, q) END, rows[1:0])) AS m FROM (
 SELECT list(struct_pack(g := failure_group, quota := quota, c := category_id, i := image_id, a := annotation_id, s := scale, r := risk_score) ORDER BY g, priority, annotation_id) AS rows FROM (
  SELECT *, CASE failure_group {_ORDER} END AS g, CASE failure_group {_QUOTA} END AS quota, -ln({O.uniform_sql("'typed:' || failure_group || ':' || annotation_id", K.SAMPLING_SEED)}) / {_W} AS priority FROM grouped WHERE failure_group <> 'standard_support' AND category_id IN (SELECT category_id FROM grouped GROUP BY 1 HAVING count(*) >= 100)))""")
O.cte("typed_rows", "typed", "SELECT m.a AS annotation_id, m.i AS image_id, m.c AS category_id, m.s AS scale, m.g AS failure_group, m.r AS risk_score FROM typed")


def _typed(v: Views) -> DataFrame:
    if not hasattr(v, "_typed_sample"):
        v._typed_sample = written(lambda: S.typed_quota_sample(v.risk, QUOTAS, 0.15, 100, strict=False))
    return v._typed_sample


@query("smp5_typed_quota_sample", "annotation_id:i image_id:i category_id:i failure_group:s", "typed_rows", "SELECT * FROM typed_rows")
def _(v):
    return _typed(v)


def _matched_sql(keys: list[str], priority: str) -> str:
    cols = ", ".join(keys)
    label = " || ':' || ".join(["'matched'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    u = O.uniform_sql(f"{label} || ':' || annotation_id", K.SAMPLING_SEED)
    binned = lambda t: f"(SELECT *, least(19, greatest(0, CAST(floor(risk_score * 20) AS INTEGER))) AS risk_bin FROM {t})"
    return f"""SELECT m.a AS annotation_id, m.i AS image_id FROM (SELECT unnest(list_reduce(rows, lambda acc, q: CASE WHEN len(list_filter(acc, lambda m: m.st = q.st)) >= q.need OR len(list_filter(acc, lambda m: m.i = q.i)) > 0 THEN acc ELSE list_append(acc, q) END, rows[1:0])) AS m FROM (
 SELECT list(struct_pack(st := st, need := need, i := image_id, a := annotation_id) ORDER BY st, {priority.replace('U', 'u')}, annotation_id) AS rows FROM (SELECT *, {u} AS u FROM {binned('risk')} JOIN (
  SELECT *, row_number() OVER (ORDER BY pool / need, {cols}) AS st FROM (SELECT {cols}, count(*) AS need FROM {binned('typed_rows')} GROUP BY ALL) JOIN (SELECT {cols}, count(*) AS pool FROM {binned('risk')} GROUP BY ALL) USING ({cols})) USING ({cols}))))"""


@query("smp5_shortfall", "failure_group:s required:i selected:i", "typed_rows", "SELECT failure_group, required, coalesce(n, 0) AS selected FROM (" + " UNION ALL ".join(f"SELECT '{g}' AS failure_group, {q} AS required" for g, q in QUOTAS.items()) + ") LEFT JOIN (SELECT failure_group, count(*) AS n FROM typed_rows GROUP BY 1) USING (failure_group) WHERE coalesce(n, 0) < required")
def _(v):
    required = v.spark.createDataFrame(list(QUOTAS.items()), "failure_group string, required long")
    return S.shortfall(_typed(v), required, ["failure_group"])


@query("smp6_matched_sample", "annotation_id:i image_id:i", "typed_rows risk", _matched_sql(["category_id", "scale", "risk_bin"], "U"))
def _(v):
    return S.matched_sample(v.risk, _typed(v), strict=False)


@query("smp7_class_matched_weighted", "annotation_id:i image_id:i", "typed_rows risk", _matched_sql(["category_id"], f"-ln(U) / {_W}"))
def _(v):
    return S.matched_sample(v.risk, _typed(v), "class", "weighted", strict=False)


@query("smp8_class_matched_top_risk", "annotation_id:i image_id:i", "typed_rows risk", _matched_sql(["category_id"], "-risk_score + U * 1e-12"))
def _(v):
    return S.matched_sample(v.risk, _typed(v), "class", "top_risk", strict=False)


_BASE = f"""SELECT image_id, CASE WHEN row_number() OVER (ORDER BY {_h("'common_original_base:' || image_id")}, image_id) <= 1000 THEN 'base' ELSE 'supplement' END AS part FROM images"""


@query("smp9_base_split", "image_id:i part:s", "images", _BASE)
def _(v):
    return S.base_split(v.images, 1000)


@query("smp10_bottom_k", "annotation_id:i place:i", "objects", f"""SELECT annotation_id, row_number() OVER (PARTITION BY category_id, scale ORDER BY {_h("'bottom:' || annotation_id")}, annotation_id) AS place FROM objects QUALIFY place <= 20""")
def _(v):
    return S.bottom_k(v.objects, ["category_id", "scale"], 20, "annotation_id")


O.cte("flags", "wide graded", "SELECT w.*, coalesce(g.support, false) AS u_detected FROM wide w JOIN graded g USING (annotation_id)")


def _flags(v: Views) -> DataFrame:
    third = v.evidence.select("annotation_id", F.coalesce("support", F.lit(False)).alias("u_detected"))
    return v.wide.join(third, "annotation_id")


def _families(table: str, families: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS family, annotation_id, image_id, category_id FROM {table} WHERE {rule.replace('1D', '1').replace('0.5D', '0.5')}" for n, rule in families.items())


_CASES = f"""SELECT *, {_h("family || ':' || annotation_id", K.BOOTSTRAP_SEED)} AS selection_rank FROM ({{rows}})"""
_FLAG_ROWS = _CASES.format(rows=_families("flags", S.FLAG_FAMILIES))
_PICK_STEP = "lambda acc, q: CASE WHEN len(acc) >= 6 OR len(list_filter(acc, lambda m: m.i = q.i OR (m.c = q.c AND {first}))) > 0 THEN acc ELSE list_append(acc, q) END"


@query("smp11_diverse_pick", "family:s case_index:i annotation_id:i", "flags", f"""SELECT family, n AS case_index, picked[n].a AS annotation_id FROM (SELECT *, unnest(range(1, len(picked) + 1)) AS n FROM (
 SELECT family, list_reduce(rows, {_PICK_STEP.format(first='false')}, list_reduce(rows, {_PICK_STEP.format(first='true')}, rows[1:0])) AS picked FROM (SELECT family, list(struct_pack(i := image_id, c := category_id, a := annotation_id) ORDER BY selection_rank, annotation_id) AS rows FROM ({_FLAG_ROWS}) GROUP BY 1)))""")
def _(v):
    return S.diverse_pick(S.case_families(_flags(v), S.FLAG_FAMILIES), 6)


@query("smp12_probe_sample", "image_id:i annotation_id:i position:i", "objects", f"""SELECT *, row_number() OVER (ORDER BY hx, annotation_id) AS position FROM (SELECT image_id, annotation_id, {_h("'probe:' || annotation_id", K.BOOTSTRAP_SEED)} AS hx FROM objects QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY hx, annotation_id) = 1) QUALIFY position <= 400""")
def _(v):
    return S.probe_sample(v.objects, 400)


@query("smp13_flag_families", "family:s annotation_id:i selection_rank:s", "flags", _FLAG_ROWS)
def _(v):
    return S.case_families(_flags(v), S.FLAG_FAMILIES)


@query("smp13_shift_families", "family:s annotation_id:i selection_rank:s", "ctx", _CASES.format(rows=_families("ctx", S.SHIFT_FAMILIES)))
def _(v):
    return S.case_families(v.context, S.SHIFT_FAMILIES)


@query("smp13_corrupted_families", "family:s annotation_id:i selection_rank:s", "wide", _CASES.format(rows=_families("wide", S.CORRUPTED_FAMILIES)))
def _(v):
    return S.case_families(v.wide, S.CORRUPTED_FAMILIES)


_SEL = "SELECT annotation_id, image_id, category_id, scale, risk_score, least(19, CAST(floor(risk_score * 20) AS INTEGER)) AS risk_bin FROM risk WHERE "
_GAP = "SELECT 'unequal_{0}' AS \"check\", (SELECT sum(abs(d)) FROM (SELECT {0}, sum(s) AS d FROM sel GROUP BY 1)) AS value"
O.cte("sel", "risk", f"SELECT *, 1 AS s FROM ({_SEL} annotation_id % 3 = 0) UNION ALL SELECT *, -1 FROM ({_SEL} annotation_id % 3 = 1)")


@query("smp14_audit_selection", "check:s value:d passed:b", "sel", f"""SELECT *, value <= CASE WHEN "check" = 'mean_risk_gap' THEN 0.03 ELSE 0 END AS passed FROM (SELECT 'repeated_annotation_id' AS "check", 0e0 AS value UNION ALL SELECT 'repeated_image_id', (SELECT count(*) - count(DISTINCT (s, image_id)) FROM sel)
 UNION ALL {_GAP.format('category_id')} UNION ALL {_GAP.format('scale')} UNION ALL {_GAP.format('risk_bin')} UNION ALL SELECT 'mean_risk_gap', (SELECT abs(avg(risk_score) FILTER (WHERE s = 1) - avg(risk_score) FILTER (WHERE s = -1)) FROM sel))""")
def _(v):
    return S.audit_selection(v.risk.where("annotation_id % 3 = 0"), v.risk.where("annotation_id % 3 = 1"))


@query("set1_build_views", "path:s image_id:i role:s", "crops images", f"""SELECT 'images/' || image_id || '.jpg' AS path, image_id, 'original' AS role FROM ({_BASE}) JOIN (SELECT image_id, split FROM images) USING (image_id) WHERE part = 'base' AND split = 'core'
 UNION ALL SELECT 'crops/' || annotation_id || '.jpg', image_id, 'crop' FROM crops UNION ALL SELECT 'images/' || image_id || '.jpg', image_id, 'dev' FROM images WHERE split = 'dev'""")
def _(v):
    base = S.base_split(v.images, 1000).where("part = 'base'").join(v.images.where("split = 'core'").select("image_id"), "image_id", "left_semi")
    return S.build_views(base, v.crops, v.images.where("split = 'dev'"))


@query("set1_repeated_paths", "path:s copies:i", "images", "SELECT 'images/' || image_id || '.jpg' AS path, 2 AS copies FROM images WHERE split = 'dev' AND image_id % 4 = 0")
def _(v):
    again = v.images.where("split = 'core' OR image_id % 4 = 0")
    return S.repeated_paths(S.build_views(again, v.crops, v.images.where("split = 'dev'")))


@query("set2_check_partition", "overlapping:i missing:i foreign:i", "images", "SELECT count(*) FILTER (WHERE image_id % 14 = 0) AS overlapping, count(*) FILTER (WHERE image_id % 14 = 1) AS missing, 0 AS \"foreign\" FROM images")
def _(v):
    return S.check_partition([v.images.where("image_id % 14 <> 1"), v.images.where("split = 'dev'")], v.images)


O.cte("sets", "members", "SELECT 'central' AS combination, subset, annotation_id, image_id FROM members UNION ALL SELECT 'low', subset, annotation_id, image_id FROM members WHERE risk_score < 0.9e0 UNION ALL SELECT 'high', subset, annotation_id, image_id FROM members WHERE risk_score >= 0.6e0")


@query("set3_subset_drift", "combination:s subset:s objects:i images:i central_objects:i intersection:i union:i jaccard:d", "sets", """SELECT s.*, c.objects AS central_objects, s.objects AS "intersection", c.objects AS "union", s.objects / c.objects AS jaccard FROM (SELECT combination, subset, count(*) AS objects, count(DISTINCT image_id) AS images FROM sets GROUP BY 1, 2) s JOIN (SELECT subset, count(*) AS objects FROM sets WHERE combination = 'central' GROUP BY 1) c USING (subset)""")
def _(v):
    named = lambda df, n: df.select(F.lit(n).alias("combination"), "subset", "annotation_id", "image_id")
    m = v.members
    sets = named(m, "central").unionByName(named(m.where("risk_score < 0.9"), "low")).unionByName(named(m.where("risk_score >= 0.6"), "high"))
    return RI.subset_drift(sets, "central")


_VARIANTS = "(SELECT unnest([" + ", ".join(f"'{c}'" for c in K.CORRUPTIONS) + "]) AS corruption), (SELECT unnest([1, 2, 3]) AS severity)"
_HEX = "sha256('20260809|' || image_id || '|' || corruption || '|' || severity)"


@query("sc11_variant_plan", "image_id:i corruption:s severity:i seed_hex:s", "images", "SELECT image_id, corruption, severity, " + " || ".join(f"substr(x, {2 * i + 1}, 2)" for i in range(7, -1, -1)) + f" AS seed_hex FROM (SELECT *, {_HEX} AS x FROM images, {_VARIANTS})")
def _(v):
    return ST.variant_plan(v.images)


# --- statistics -------------------------------------------------------------------------------


#: Replicates of the registered bootstrap summary; the row-by-row comparison with SQL uses fewer.
EVIDENCE_REPLICATES = O.DRAWS


def _boot(v: Views) -> DataFrame:
    if not hasattr(v, "_boot_deltas"):
        v._boot_deltas = written(lambda: ST.paired_bootstrap(v.objects, v.images, {m: v.cache[m] for m in SCORES}, "a", O.REPLICATES))
    return v._boot_deltas


@query("st1_bootstrap_weights", "replicate:i image_id:i weight:i", "draws", "SELECT replicate, wi AS image_id, weight FROM draws")
def _(v):
    return ST.bootstrap_weights(v.images, O.DRAWS)


_DELTAS = " UNION ALL ".join(f"""SELECT 'b_minus_a' AS comparison, replicate, '{m}' AS metric, b."{m}" - a."{m}" AS delta FROM summary_boot_a a JOIN summary_boot_b b USING (replicate)""" for m in ST.METRICS)


@query("st1_paired_bootstrap", "comparison:s replicate:i metric:s delta:d", "summary_boot_a summary_boot_b", _DELTAS)
def _(v):
    return _boot(v)


@query("st1_bootstrap_evidence", "metric:s replicates:i mean:d standard_error:d median:d ci_low:d ci_high:d stable:b p_value:d evidence_role:s bh_q_value:d significant:b")
def _(v):
    """Summary, p-values and adjusted q-values of the bootstrap's own deltas, at ``EVIDENCE_REPLICATES`` replicates."""
    deltas = ST.paired_bootstrap(v.objects, v.images, {m: v.cache[m] for m in SCORES}, "a", EVIDENCE_REPLICATES)
    by = ["comparison", "metric"]
    tested = ST.bh_adjust(ST.evidence_role(ST.empirical_p(deltas, by), {"b_minus_a": ["AP"]}))
    return ST.delta_summary(deltas, by).join(tested, by)


O.cte("rowdelta", "wide", """SELECT 'c' || (category_id % 3) AS comparison, scale AS metric, image_id % 50 AS replicate, avg(CASE WHEN b_detected THEN 1e0 ELSE 0e0 END - CASE WHEN a_detected THEN 1e0 ELSE 0e0 END) AS delta FROM wide GROUP BY 1, 2, 3""")


def _row_deltas(v: Views) -> DataFrame:
    one = lambda m: F.col(f"{m}_detected").cast("double")
    return v.wide.groupBy(
        F.concat(F.lit("c"), F.col("category_id") % 3).alias("comparison"), F.col("scale").alias("metric"), (F.col("image_id") % 50).alias("replicate")
    ).agg(F.avg(one("b") - one("a")).alias("delta"))


_SUMMARY = """SELECT *, ci_low <= 0 AND ci_high >= 0 AS crosses_zero, NOT (ci_low <= 0 AND ci_high >= 0) AS stable FROM (SELECT comparison, metric, count(delta) AS replicates, avg(delta) AS mean, stddev_samp(delta) AS standard_error, quantile_cont(delta, 0.5) AS median, quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high FROM rowdelta GROUP BY 1, 2)"""


@query("st1_delta_summary", "comparison:s metric:s replicates:i mean:d standard_error:d median:d ci_low:d ci_high:d crosses_zero:b stable:b", "rowdelta", _SUMMARY)
def _(v):
    return ST.delta_summary(_row_deltas(v), ["comparison", "metric"])


_P = """SELECT comparison, metric, least(1, 2 * least((count(*) FILTER (WHERE delta <= 0) + 1) / (count(*) + 1), (count(*) FILTER (WHERE delta >= 0) + 1) / (count(*) + 1))) AS p_value FROM rowdelta GROUP BY 1, 2"""


@query("st2_empirical_p", "comparison:s metric:s p_value:d", "rowdelta", _P)
def _(v):
    return ST.empirical_p(_row_deltas(v), ["comparison", "metric"])


@query("st3_bh_adjust", "comparison:s metric:s p_value:d evidence_role:s bh_q_value:d significant:b", "rowdelta", f"""WITH p AS ({_P}), r AS (SELECT *, CASE WHEN comparison = 'c0' AND metric = 'small' THEN 'primary' ELSE 'secondary' END AS evidence_role FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY p_value, metric) AS k, count(*) OVER (PARTITION BY comparison) AS n FROM r WHERE evidence_role = 'secondary'),
 q AS (SELECT a.comparison, a.metric, min(least(1, b.p_value * b.n / b.k)) AS bh_q_value FROM k a JOIN k b ON a.comparison = b.comparison AND b.k >= a.k GROUP BY 1, 2) SELECT r.*, bh_q_value, bh_q_value < 0.05 AS significant FROM r LEFT JOIN q USING (comparison, metric)""")
def _(v):
    p = ST.empirical_p(_row_deltas(v), ["comparison", "metric"])
    return ST.bh_adjust(ST.evidence_role(p, {"c0": ["small"]}))


@query("st4_ratio_bootstrap", "scale:s replicate:i ratio:d", "wide draws", "SELECT scale, replicate, sum(weight * CASE WHEN a_detected THEN 1 ELSE 0 END) / sum(weight) AS ratio FROM wide JOIN draws ON wi = image_id GROUP BY 1, 2")
def _(v):
    counts = v.wide.groupBy("scale", "image_id").agg(F.count_if("a_detected").alias("matched"), F.count("*").alias("gt"))
    return ST.ratio_bootstrap(counts, ST.bootstrap_weights(v.images, O.DRAWS), ["scale"])


_CMP = " UNION ALL ".join(f"""SELECT '{a}' AS left_model, '{b}' AS right_model, corruption, severity, """ + ", ".join(f'l."{m}" - r."{m}" AS "delta_{m}"' for m in _M3) + f" FROM corruptions l JOIN corruptions r USING (corruption, severity) WHERE l.model = '{a}' AND r.model = '{b}'" for a, b in (("m1", "m0"), ("m2", "m0")))


def _compare(v: Views) -> DataFrame:
    return ST.compare(v.corruption_metrics, [("m1", "m0"), ("m2", "m0")], ["corruption", "severity"], _M3)


@query("st5_compare", "left_model:s right_model:s corruption:s severity:i " + " ".join(f"delta_{m}:d" for m in _M3), "corruptions", _CMP)
def _(v):
    return _compare(v)


@query("st6_compare_summary", "left_model:s right_model:s metric:s mean_delta:d positive_fraction:d conditions:i", "corruptions", " UNION ALL ".join(f"""SELECT left_model, right_model, '{m}' AS metric, avg("delta_{m}") AS mean_delta, avg(CASE WHEN "delta_{m}" > 0 THEN 1e0 ELSE 0e0 END) AS positive_fraction, count("delta_{m}") AS conditions FROM ({_CMP}) GROUP BY 1, 2""" for m in _M3))
def _(v):
    return ST.compare_summary(_compare(v), _M3)


_ATTR_METRICS = ["AP", "AP75", "lr"]
O.cte("start", "curves", 'SELECT * FROM curves WHERE arm = \'common\' AND epoch = (SELECT max(epoch) FROM curves WHERE arm = \'common\')')
O.cte("attributed", "curves start", " UNION ALL ".join(f"""SELECT epoch, '{m}' AS metric, c."{m}" AS common, u."{m}" AS uniform, r."{m}" AS risk, u."{m}" - c."{m}" AS shared_effect, r."{m}" - u."{m}" AS residual, r."{m}" - c."{m}" AS total_effect FROM (SELECT * FROM curves WHERE arm = 'uniform') u JOIN (SELECT * FROM curves WHERE arm = 'risk') r USING (epoch), (SELECT * EXCLUDE (epoch) FROM start) c""" for m in _ATTR_METRICS))


def _attribution(v: Views) -> DataFrame:
    curves = materialize(v.curves)
    common = curves.where("arm = 'common'").agg(F.max(F.struct("epoch", *_ATTR_METRICS)).alias("m")).select("m.*")
    return CU.attribute(curves, common, _ATTR_METRICS)


@query("st7_attribute", "epoch:i metric:s common:d uniform:d risk:d shared_effect:d residual:d total_effect:d identity_holds:b", "attributed", "SELECT *, true AS identity_holds FROM attributed")
def _(v):
    return _attribution(v)


_AUC_SQL = lambda c, n: f"(SELECT metric, sum((epoch - pe) * ({c} + pv) / 2) / (max(epoch) - min(epoch)) AS {n} FROM (SELECT *, lag(epoch) OVER w AS pe, lag({c}) OVER w AS pv FROM attributed WINDOW w AS (PARTITION BY metric ORDER BY epoch)) GROUP BY 1)"


@query("st7_attribution_summary", "metric:s uniform_mean:d risk_mean:d delta_mean:d positive:i zero:i negative:i minimum_delta:d maximum_delta:d terminal_delta:d uniform_auc:d risk_auc:d delta_auc:d", "attributed", f"""SELECT * FROM (SELECT metric, avg(uniform) AS uniform_mean, avg(risk) AS risk_mean, avg(residual) AS delta_mean, count(*) FILTER (WHERE residual > 0) AS positive, count(*) FILTER (WHERE abs(residual) <= 1e-12) AS zero, count(*) FILTER (WHERE residual < 0) AS negative, min(residual) AS minimum_delta, max(residual) AS maximum_delta, arg_max(residual, epoch) AS terminal_delta FROM attributed GROUP BY 1)
 JOIN {_AUC_SQL('uniform', 'uniform_auc')} USING (metric) JOIN {_AUC_SQL('risk', 'risk_auc')} USING (metric) JOIN {_AUC_SQL('residual', 'delta_auc')} USING (metric)""")
def _(v):
    return CU.attribution_summary(materialize(_attribution(v)))


O.cte("grid", "objects det_events", f"SELECT t AS threshold, macro_f1 FROM ({_at(_GRID)})")
_PLATEAU = "SELECT maximum, 0.95e0 * maximum AS minimum, n AS rows, point, threshold, macro_f1 FROM (SELECT max(macro_f1) AS maximum FROM grid), (SELECT count(*) AS n FROM grid WHERE macro_f1 >= 0.95e0 * (SELECT max(macro_f1) FROM grid)), ({points})".format(
    points=" UNION ALL ".join(
        f"(SELECT '{n}' AS point, threshold, macro_f1 FROM grid WHERE macro_f1 >= 0.95e0 * (SELECT max(macro_f1) FROM grid) ORDER BY {o} LIMIT 1)"
        for n, o in (("low", "threshold"), ("central", "round(macro_f1, 14) DESC, threshold"), ("high", "threshold DESC"))
    )
)


@query("st8_plateau", "point:s threshold:d macro_f1:d maximum:d minimum:d rows:i", "grid", _PLATEAU)
def _(v):
    return C.plateau(C.threshold_grid(v.events, v.gt_counts, 0.305))


@query("st8_sensitivity", "combination:s subset:s objects:i images:i central_objects:i intersection:i union:i jaccard:d", "combined_sets", """SELECT s.*, c.objects AS central_objects, met AS "intersection", s.objects + c.objects - met AS "union", met / (s.objects + c.objects - met) AS jaccard FROM (
 SELECT combination, subset, count(*) AS objects, count(DISTINCT image_id) AS images, count(*) FILTER (WHERE m.annotation_id IS NOT NULL) AS met FROM combined_sets s LEFT JOIN (SELECT subset, annotation_id FROM combined_sets WHERE combination = 'a_central__b_central') m USING (subset, annotation_id) GROUP BY 1, 2) s
 JOIN (SELECT subset, count(*) AS objects FROM combined_sets WHERE combination = 'a_central__b_central' GROUP BY 1) c USING (subset)""")
def _(v):
    """Failure subsets at nine combinations of operating points against the central one, from one match per detector."""
    return SE.sensitivity(v.objects, v.pairs, O.POINTS, "a_central__b_central", v.hot)


@query("st8_combinations", "combination:s a_threshold:d b_threshold:d", "grid", f"SELECT 'a_' || l.point || '__b_' || r.point AS combination, l.threshold AS a_threshold, r.threshold AS b_threshold FROM ({_PLATEAU}) l, ({_PLATEAU}) r")
def _(v):
    p = C.plateau(C.threshold_grid(v.events, v.gt_counts, 0.305))
    return C.combinations(p, p)


_DIR = "SELECT 'left' AS comparison, corruption AS metric, model || severity AS combination, \"AP\" - 0.25e0 AS delta FROM corruptions"


@query("st9_direction_stability", "comparison:s metric:s central_sign:i combinations:i same_direction:i minimum_delta:d maximum_delta:d", "corruptions", f"""SELECT d.comparison, d.metric, c.s AS central_sign, count(*) AS combinations, count(*) FILTER (WHERE (CASE WHEN abs(delta) <= 1e-12 THEN 0 ELSE sign(delta) END) = c.s) AS same_direction, min(delta) AS minimum_delta, max(delta) AS maximum_delta
 FROM ({_DIR}) d JOIN (SELECT metric, CASE WHEN abs(delta) <= 1e-12 THEN 0 ELSE sign(delta) END AS s FROM ({_DIR}) WHERE combination = 'm01') c USING (metric) GROUP BY 1, 2, 3""")
def _(v):
    d = v.corruption_metrics.select(
        F.lit("left").alias("comparison"), F.col("corruption").alias("metric"), F.concat("model", "severity").alias("combination"), (F.col("AP") - 0.25).alias("delta")
    )
    return ST.direction_stability(d, "m01")


_RULE_METRICS = [m for _, m, _, _ in ST.GATE_RULES]
_RULE_NAMES = "[" + ", ".join(f"'{m}'" for m in _RULE_METRICS) + "]"
O.cte("ruledelta", "", f"SELECT ({_RULE_NAMES})[CAST(1 + l_orderkey % {len(_RULE_METRICS)} AS INTEGER)] AS metric, avg(l_quantity) / 1000 - 0.025e0 AS delta FROM lineitem GROUP BY 1")
_RULE_ROWS = " UNION ALL ".join(f"SELECT '{g}' AS gate, '{m}' AS metric, {t!r}e0 AS at_least, {a} AS alt" for g, m, t, a in ST.GATE_RULES)


@query("st10_apply_rules", "gate:s rules:i passed:b", "ruledelta", f"""SELECT gate, sum(n) AS rules, coalesce(bool_and(ok) FILTER (WHERE alt = 0), true) AND coalesce(bool_or(ok) FILTER (WHERE alt > 0), true) AS passed FROM (SELECT gate, alt, count(*) AS n, bool_and(delta >= at_least) AS ok FROM ({_RULE_ROWS}) JOIN ruledelta USING (metric) GROUP BY 1, 2) GROUP BY 1""")
def _(v):
    names = F.array(*[F.lit(m) for m in _RULE_METRICS])
    d = v.table("lineitem").groupBy(F.element_at(names, (1 + F.col("l_orderkey") % len(_RULE_METRICS)).cast("int")).alias("metric")).agg((F.avg("l_quantity") / 1000 - 0.025).alias("delta"))
    return ST.apply_rules(d)


@query("st11_restart_ratio", "curve:s column:s restart_ratio:d", "curves", " UNION ALL ".join(f"""SELECT arm AS curve, '{c}' AS "column", arg_min("{c}", epoch) / (SELECT arg_max("{c}", epoch) FROM curves WHERE arm = 'common') AS restart_ratio FROM curves WHERE arm <> 'common' GROUP BY 1""" for c in ("lr", "AP")))
def _(v):
    return CU.restart_ratio(v.curves.withColumnRenamed("arm", "curve"), "common", ["lr", "AP"])


@query("st12_table_diff", "column:s only_a:i only_b:i max_difference:d null_mismatches:i agrees:b", "status_a status_b", """WITH j AS (SELECT a.annotation_id AS ka, b.annotation_id AS kb, a.best_same_all_iou AS ai, b.best_same_all_iou AS bi, a.matched_score AS am, b.matched_score AS bm FROM (SELECT * FROM status_a WHERE annotation_id % 11 <> 0) a FULL JOIN (SELECT * FROM status_b WHERE annotation_id % 7 <> 0) b USING (annotation_id)),
 n AS (SELECT count(*) FILTER (WHERE kb IS NULL) AS only_a, count(*) FILTER (WHERE ka IS NULL) AS only_b FROM j)
 SELECT 'best_same_all_iou' AS "column", only_a, only_b, (SELECT max(abs(ai - bi)) FROM j) AS max_difference, 0 AS null_mismatches, false AS agrees FROM n
 UNION ALL SELECT 'matched_score', only_a, only_b, (SELECT max(abs(am - bm)) FROM j), (SELECT count(*) FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND (am IS NULL) <> (bm IS NULL)), false FROM n""")
def _(v):
    return ST.table_diff(v.status["a"].where("annotation_id % 11 <> 0"), v.status["b"].where("annotation_id % 7 <> 0"), ["annotation_id"], ["best_same_all_iou", "matched_score"], 1e-9)


# --- files: written to the shared folder and read back --------------------------------------


def _path(v: Views) -> str:
    return f"{shared_folder(v.spark)}/boxwise-{uuid.uuid4().hex}"


_IMG = "SELECT image_id, width, height, timeofday, weather, scene FROM images"


def _documents(v: Views) -> str:
    """Annotation documents of about 64 images each, one per line."""
    path = _path(v)
    WR.write_coco(v.images, v.objects.withColumn("segmentation", F.expr("array(array(x, y, x + w, y, x + w, y + h))")), path)
    return path


_NAME = "CASE category_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in K.CATEGORIES.items()) + " END"


@query("src1_read_coco_images", "image_id:i file_name:s width:i height:i weather:s scene:s timeofday:s", "images", "SELECT *, image_id || '.jpg' AS file_name FROM images")
def _(v):
    return RD.read_coco(v.spark, _documents(v), multiline=False)[0]


@query("src1_read_coco_objects", "annotation_id:i image_id:i category_id:i x:d y:d w:d h:d area:d iscrowd:i occluded:b truncated:b corner:d", "objects", "SELECT *, 0 AS iscrowd, y + h AS corner FROM objects")
def _(v):
    return RD.read_coco(v.spark, _documents(v), multiline=False)[1].withColumn("corner", F.expr("segmentation[0][5]"))


@query("src1_read_coco_categories", "category_id:i category:s", "objects", f"SELECT DISTINCT category_id, {_NAME} AS category FROM objects")
def _(v):
    used = v.objects.select("category_id").distinct()
    return RD.read_coco(v.spark, _documents(v), multiline=False)[2].join(used, "category_id", "left_semi")




def _class_name():
    return F.element_at(F.create_map(*[F.lit(x) for kv in K.CATEGORIES.items() for x in kv]), F.col("category_id"))


@query("src2_read_box_labels", "name:s label_index:i category:s x1:d y1:d x2:d y2:d occluded:b truncated:b", "objects", f"SELECT CAST(image_id AS VARCHAR) AS name, row_number() OVER (PARTITION BY image_id ORDER BY annotation_id) - 1 AS label_index, {_NAME} AS category, x AS x1, y AS y1, x + w AS x2, y + h AS y2, occluded, truncated FROM objects")
def _(v):
    label = F.struct(
        "annotation_id", F.col("annotation_id").cast("string").alias("id"), _class_name().alias("category"),
        F.expr("struct(x AS x1, y AS y1, x + w AS x2, y + h AS y2) AS box2d"), F.struct("occluded", "truncated").alias("attributes"),
    )
    path = _path(v)
    labels = v.objects.groupBy("image_id").agg(F.sort_array(F.collect_list(label)).alias("labels"))
    v.images.join(labels, "image_id", "left").select(F.col("image_id").cast("string").alias("name"), F.struct("weather", "scene", "timeofday").alias("attributes"), "labels").write.json(path)
    return RD.read_box_labels(v.spark, path, multiline=False)[1]


@query("src2_image_ids", "image_id:i name:s weather:s scene:s timeofday:s", "images", "SELECT row_number() OVER (ORDER BY image_id) AS image_id, CAST(image_id AS VARCHAR) AS name, weather, scene, timeofday FROM images")
def _(v):
    """Image ids by the order of label records in their files."""
    path = _path(v)
    record = v.images.select("image_id", F.col("image_id").cast("string").alias("name"), F.struct("weather", "scene", "timeofday").alias("attributes"))
    record.orderBy("image_id").drop("image_id").write.json(path)
    return RD.read_box_labels(v.spark, path, multiline=False, numbered=True)[0]


@query("src3_read_polygon_labels", "object_id:i category:s x1:d y1:d x2:d y2:d occluded:b truncated:b", "objects", f"SELECT annotation_id AS object_id, {_NAME} AS category, x AS x1, y AS y1, x + w AS x2, y + h AS y2, occluded, truncated FROM objects WHERE rn % 6 <> 5")
def _(v):
    flags = F.expr("concat(\"{'occluded': \", IF(occluded, 'True', 'False'), \", 'truncated': \", IF(truncated, 'True', 'False'), '}')")
    thing = F.struct(
        F.col("annotation_id").alias("id"), _class_name().alias("classTitle"), F.expr("IF(rn % 6 = 5, 'polygon', 'rectangle') AS geometryType"),
        F.expr("named_struct('exterior', array(array(x, y), array(x + w, y + h))) AS points"), F.array(F.struct(F.lit("attributes").alias("name"), flags.alias("value"))).alias("tags"),
    )
    tag = lambda n: F.struct(F.lit(n).alias("name"), F.col(n).alias("value"))
    things = v.objects.groupBy("image_id").agg(F.collect_list(thing).alias("objects"))
    path = _path(v)
    v.images.join(things, "image_id", "left").select(F.struct("width", "height").alias("size"), F.array(tag("weather"), tag("scene"), tag("timeofday")).alias("tags"), "objects").write.json(path)
    return RD.read_polygon_labels(v.spark, path, multiline=False)[1]


@query("src4_read_detections", "model:s prediction_index:i image_id:i category_id:i score:d x:d y:d w:d h:d", "d_a", "SELECT 'a' AS model, row_number() OVER (PARTITION BY image_id // 64 ORDER BY prediction_index) - 1 AS prediction_index, image_id, category_id, score, x, y, w, h FROM d_a")
def _(v):
    row = F.struct("prediction_index", F.struct("image_id", "category_id", "score", F.array(*"xywh").alias("bbox")).alias("d"))
    lists = v.dets["a"].groupBy(F.floor(F.col("image_id") / 64).alias("shard")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    path = _path(v)
    body = F.to_json(F.transform("r", lambda q: q["d"]))
    lists.select(F.when(F.col("shard") % 2 == 0, body).otherwise(F.concat(F.lit('{"predictions": '), body, F.lit("}"))).alias("value")).write.text(path)
    return RD.read_detections(v.spark, path, "a", one_per_line=True)


@query("src4_false_positives_of_files", "image_id:i prediction_index:i fp_type:s best_gt_iou:d", "fp_a d_a", "SELECT f.image_id, p.prediction_index, fp_type, best_gt_iou FROM (SELECT fp_a.*, d_a.image_id FROM fp_a JOIN d_a USING (prediction_index)) f JOIN (SELECT image_id, prediction_index AS q, row_number() OVER (PARTITION BY image_id ORDER BY prediction_index) - 1 AS prediction_index FROM d_a) p ON p.q = f.prediction_index")
def _(v):
    """Several detection documents, numbered anew by image, through the false positives."""
    row = F.struct("prediction_index", F.struct("image_id", "category_id", "score", F.array(*"xywh").alias("bbox")).alias("d"))
    lists = v.dets["a"].groupBy(F.floor(F.col("image_id") / 64).alias("shard")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    path = _path(v)
    lists.select(F.to_json(F.transform("r", lambda q: q["d"])).alias("value")).write.text(path)
    dets = RD.number_detections(RD.read_detections(v.spark, path, "a", one_per_line=True))
    return M.false_positives(v.objects, materialize(dets), SCORES["a"], hot=v.hot)


@query("src5_read_norm_labels", "class_index:i cx:d cy:d nw:d nh:d", "objects", "SELECT category_id - 1 AS class_index, (x + w / 2) / 1280 AS cx, (y + h / 2) / 720 AS cy, w / 1280 AS nw, h / 720 AS nh FROM objects")
def _(v):
    path = _path(v)
    norm = PR.to_norm(v.objects.withColumns({"width": F.lit(1280), "height": F.lit(720)}))
    WR.norm_label_lines(norm).select("text").write.text(path)
    return RD.read_norm_labels(v.spark, path)[0]


@query("src5_rejected_label_lines", "line:s n:i", "images", "SELECT CASE image_id % 3 WHEN 0 THEN '1 0.5 0.5 nan 0.1' WHEN 1 THEN '1.5 0.5 0.5 0.1 0.1' ELSE 'four fields in all' END AS line, count(*) AS n FROM images GROUP BY 1")
def _(v):
    path = _path(v)
    odd = F.expr("CASE image_id % 3 WHEN 0 THEN '1 0.5 0.5 nan 0.1' WHEN 1 THEN '1.5 0.5 0.5 0.1 0.1' ELSE 'four fields in all' END")
    v.images.select(F.concat(F.lit("3.0 0.5 0.5 0.1 0.1 0.9\n"), odd, F.lit("\n\n")).alias("text")).write.text(path)
    return RD.read_norm_labels(v.spark, path)[1].groupBy("line").agg(F.count("*").alias("n"))


@query("src6_read_id_set", "image_id:i", "images", "SELECT image_id FROM images WHERE split = 'dev'")
def _(v):
    path = _path(v)
    ids = v.images.where("split = 'dev'").groupBy(F.floor(F.col("image_id") / 4096).alias("shard")).agg(F.collect_list("image_id").alias("ids"))
    plain, named, nested = F.to_json("ids"), F.to_json(F.struct(F.col("ids").alias("image_ids"))), F.to_json(F.transform("ids", lambda i: F.struct(i.alias("id"))))
    ids.select(F.when(F.col("shard") % 3 == 0, plain).when(F.col("shard") % 3 == 1, named).otherwise(nested).alias("value")).write.text(path)
    return RD.read_id_set(v.spark, path, one_per_line=True)


@query("src7_read_jsonl", "image_id:i width:i height:i timeofday:s weather:s scene:s", "images", _IMG)
def _(v):
    path = _path(v)
    v.images.write.json(path)
    return RD.read_jsonl(v.spark, path, "image_id bigint, width int, height int, timeofday string, weather string, scene string")


@query("src8_read_table_csv", "annotation_id:i status:s matched_iou:d matched_score:d", "status_a", "SELECT annotation_id, status, matched_iou, matched_score FROM status_a")
def _(v):
    path = _path(v)
    WR.write_result(v.status["a"].select("annotation_id", "image_id", "status", "matched_iou", "matched_score"), path, "csv")
    return RD.read_table_csv(v.spark, path, "annotation_id bigint, status string, matched_iou double, matched_score double")


@query("snk1_write_coco", "id:i image_id:i category_id:i area:d iscrowd:i x:d", "objects", "SELECT annotation_id AS id, image_id, category_id, w * h AS area, 0 AS iscrowd, x FROM objects")
def _(v):
    path = _path(v)
    WR.write_coco(v.images, v.objects, path)
    return RD.read_coco(v.spark, path, multiline=False)[1].withColumnRenamed("annotation_id", "id")


@query("snk1_write_coco_images", "image_id:i width:i height:i timeofday:s weather:s scene:s", "images", _IMG)
def _(v):
    path = _path(v)
    WR.write_coco(v.images, v.objects, path)
    return RD.read_coco(v.spark, path, multiline=False)[0]


@query("snk2_norm_label_lines", "image_id:i class_index:i cx:d cy:d nw:d nh:d", "objects", "SELECT image_id, category_id - 1 AS class_index, (x + w / 2) / 1280 AS cx, (y + h / 2) / 720 AS cy, w / 1280 AS nw, h / 720 AS nh FROM objects")
def _(v):
    """The lines at the default digits, taken apart again as numbers: texts of half-way values differ between engines."""
    lines = WR.norm_label_lines(PR.to_norm(v.objects.withColumns({"width": F.lit(1280), "height": F.lit(720)})))
    part = F.split("line", " ")
    number = lambda i: F.get(part, F.lit(i)).cast("double")
    return lines.select("image_id", F.explode(F.split("text", "\n")).alias("line")).select(
        "image_id", number(0).cast("int").alias("class_index"), *[number(i + 1).alias(c) for i, c in enumerate(("cx", "cy", "nw", "nh"))]
    )


@query("snk3_write_result", "image_id:i num:i", "status_a", "SELECT image_id, count(*) AS num FROM status_a GROUP BY 1")
def _(v):
    path = _path(v)
    WR.write_result(v.status["a"].groupBy("image_id").agg(F.count("*").alias("num")), path)
    return v.spark.read.parquet(path)
