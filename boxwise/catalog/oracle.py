"""SQL counterparts of the shared views, as common table expressions.

Written from the definitions, not from the Spark code: candidate lists are folded
with ``list_reduce``, ranks are plain windows, precision is interpolated point by point.
"""

from __future__ import annotations

from boxwise import constants as K
from boxwise.catalog.views import SCORES
from boxwise.sources.fixtures import DETECTOR_KEYS

OBJECTS_SQL = """
WITH o AS (SELECT l_orderkey AS image_id, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM {lineitem}),
b AS (SELECT image_id, pk, sk, rn, 1 + pk % 10 AS c0,
 (pk*37 + ln*211 + rn*89) % 1000 AS x0, (sk*53 + ln*97 + rn*41) % 520 AS y0,
 CASE WHEN (pk+sk) % 2 = 0 THEN 6 + (pk*7+sk) % 22 ELSE 24 + (pk*7+sk) % 180 END AS w0,
 CASE WHEN (pk+sk) % 2 = 0 THEN 6 + (sk*11+rn*13) % 22 ELSE 24 + (sk*11+rn*13) % 160 END AS h0 FROM o),
l AS (SELECT *, lag(x0) OVER w AS px, lag(y0) OVER w AS py, lag(w0) OVER w AS pw, lag(h0) OVER w AS ph, lag(c0) OVER w AS pc FROM b WINDOW w AS (PARTITION BY image_id ORDER BY rn)),
r AS (SELECT image_id*1024 + rn AS annotation_id, image_id, pk, sk, rn,
 CASE WHEN rn % 4 = 0 THEN pc ELSE c0 END AS category_id,
 CASE WHEN rn % 4 = 0 THEN px + 1 ELSE x0 END AS x, CASE WHEN rn % 4 = 0 THEN py + 1 ELSE y0 END AS y,
 CASE WHEN rn % 4 = 0 THEN pw ELSE w0 END AS w, CASE WHEN rn % 4 = 0 THEN ph ELSE h0 END AS h FROM l)
SELECT annotation_id, image_id, CAST(category_id AS INTEGER) AS category_id, pk, sk, rn,
 CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h,
 CAST(w*h AS DOUBLE) AS area, x AS xi, y AS yi, w AS wi, h AS hi FROM r
"""

DETECTIONS_SQL = """
WITH v AS (SELECT *, (pk*{k1} + sk*{k2} + rn*{k3}) % 10 AS v, (pk*{k3} + sk*{k1} + rn*{k2}) % 700 AS s FROM {objects}),
d AS (
 SELECT image_id*4096 + rn*2 AS prediction_index, image_id,
  CASE WHEN v = 3 THEN 1 + category_id % 10 ELSE category_id END AS category_id,
  CASE WHEN v = 1 THEN 20 + s % 180 ELSE 300 + s END AS s1000,
  xi*10 + CASE WHEN v = 2 THEN wi*6 ELSE wi END AS x10, yi*10 AS y10, wi*10 AS w10, hi*10 AS h10 FROM v WHERE v <> 0
 UNION ALL
 SELECT image_id*4096 + rn*2 + 1, image_id, category_id, 250 + s % 50, xi*10 + wi*2, yi*10, wi*10, hi*10 FROM v WHERE v = 4
 UNION ALL
 SELECT image_id*4096, image_id, 1 + image_id % 10, 300 + image_id % 700, 11000, 6000, 400, 400 FROM (SELECT DISTINCT image_id FROM {objects}) q WHERE image_id % 3 = 0)
SELECT prediction_index, image_id, CAST(category_id AS INTEGER) AS category_id, CAST(s1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS score,
 CAST(x10 AS DOUBLE)/CAST(10 AS DOUBLE) AS x, CAST(y10 AS DOUBLE)/CAST(10 AS DOUBLE) AS y, CAST(w10 AS DOUBLE)/CAST(10 AS DOUBLE) AS w, CAST(h10 AS DOUBLE)/CAST(10 AS DOUBLE) AS h FROM d
"""

IMAGES_SQL = """
SELECT o_orderkey AS image_id, 1280 AS width, 720 AS height,
 CASE o_custkey % 5 WHEN 0 THEN 'daytime' WHEN 1 THEN 'night' WHEN 2 THEN 'dawn' WHEN 3 THEN 'dusk' ELSE 'undefined' END AS timeofday,
 o_orderpriority AS weather, o_orderstatus AS scene,
 CASE WHEN o_orderkey % 14 = 0 THEN 'dev' ELSE 'core' END AS split FROM {orders}
"""


def _detections(model: str) -> str:
    k1, k2, k3 = DETECTOR_KEYS[model]
    text = DETECTIONS_SQL.replace("{objects}", "objects")
    return text.replace("{k1}", str(k1)).replace("{k2}", str(k2)).replace("{k3}", str(k3))


def iou_sql(a: str = "o", b: str = "d") -> str:
    inter = inter_sql(a, b)
    return f"({inter} / ({a}.w*{a}.h + {b}.w*{b}.h - {inter}))"


TOUCH = "o.x < d.x+d.w AND d.x < o.x+o.w AND o.y < d.y+d.h AND d.y < o.y+o.h"
def inter_sql(a: str = "o", b: str = "d") -> str:
    return f"(greatest(least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x), 0e0) * greatest(least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y), 0e0))"


TAKE = "lambda acc, q: CASE WHEN len(list_filter(acc, lambda m: m.a = q.a OR m.p = q.p)) > 0 THEN acc ELSE list_append(acc, q) END"
SCALE = "CASE WHEN {0} < 1024 THEN 'small' WHEN {0} < 9216 THEN 'medium' ELSE 'large' END"


def greedy_sql(pairs: str, keys: str, iou: float, tie: str = "a", where: str = "true") -> str:
    """Greedy choice over rows (keys, score, p, iou, a)."""
    return f"""SELECT {keys}, m.a AS annotation_id, m.p AS prediction_index, m.iou AS iou, m.score AS score FROM (
 SELECT {keys}, unnest(list_reduce(ps, {TAKE}, ps[1:0])) AS m FROM (
  SELECT {keys}, list(struct_pack(score := score, p := p, iou := iou, a := a) ORDER BY score DESC, p, iou DESC, {tie}) AS ps
  FROM {pairs} WHERE iou >= {iou!r}e0 AND {where} GROUP BY ALL))"""


CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, deps: str, text: str) -> None:
    CTES[name] = (deps, text)


cte("objects0", "", OBJECTS_SQL.replace("{lineitem}", "lineitem"))
cte("objects", "objects0", "SELECT *, " + SCALE.format("area") + " AS scale, rn % 3 = 0 AS occluded, rn % 5 = 0 AS truncated FROM objects0")
cte("images", "", IMAGES_SQL.replace("{orders}", "orders"))
def status_ctes(tag: str, M: str, T: float) -> None:
    """Match, best candidates and status of detector M at the threshold T."""
    cte(f"greedy_{tag}", f"pairs_{M}", greedy_sql(f"pairs_{M}", "image_id, gc", 0.5, where=f"gc = dc AND score >= {T!r}e0"))
    cte(f"best_{tag}", f"pairs_{M}", f"""SELECT a,
 arg_max(p, r) FILTER (WHERE same) AS sa_p, coalesce(max(iou) FILTER (WHERE same), 0) AS sa_iou, arg_max(score, r) FILTER (WHERE same) AS sa_s,
 arg_max(p, r) FILTER (WHERE same AND op) AS so_p, coalesce(max(iou) FILTER (WHERE same AND op), 0) AS so_iou, arg_max(score, r) FILTER (WHERE same AND op) AS so_s,
 arg_max(p, r) FILTER (WHERE NOT same AND op) AS wr_p, coalesce(max(iou) FILTER (WHERE NOT same AND op), 0) AS wr_iou, arg_max(score, r) FILTER (WHERE NOT same AND op) AS wr_s,
 arg_max(dc, r) FILTER (WHERE NOT same AND op) AS wr_c
 FROM (SELECT *, gc = dc AS same, score >= {T!r}e0 AS op, -row_number() OVER (PARTITION BY a ORDER BY iou DESC, p) AS r FROM pairs_{M}) GROUP BY a""")
    cte(f"status_{tag}", f"greedy_{tag} best_{tag}", f"""SELECT o.image_id, o.annotation_id, o.category_id, o.scale, g.prediction_index AS matched_prediction_index, g.iou AS matched_iou, g.score AS matched_score,
 b.sa_p AS best_same_all_prediction_index, coalesce(b.sa_iou, 0) AS best_same_all_iou, b.sa_s AS best_same_all_score,
 b.so_p AS best_same_op_prediction_index, coalesce(b.so_iou, 0) AS best_same_op_iou, b.so_s AS best_same_op_score,
 b.wr_p AS best_wrong_prediction_index, coalesce(b.wr_iou, 0) AS best_wrong_iou, b.wr_s AS best_wrong_score, b.wr_c AS best_wrong_category_id,
 CASE WHEN g.prediction_index IS NOT NULL THEN 'detected' WHEN b.so_iou >= 0.5 THEN 'assignment_conflict_candidate'
  WHEN b.sa_iou >= 0.5 AND b.sa_s < {T!r}e0 THEN 'low_confidence_candidate' WHEN b.wr_iou >= 0.5 THEN 'classification_error_candidate'
  WHEN b.so_iou >= 0.1 THEN 'localization_error_candidate' ELSE 'missed' END AS status,
 CASE WHEN g.prediction_index IS NOT NULL THEN 'detected'
  WHEN b.sa_iou >= 0.5 AND b.sa_s < {T!r}e0 THEN 'low_confidence_candidate' WHEN b.wr_iou >= 0.5 THEN 'class_confusion_candidate'
  WHEN b.so_iou >= 0.1 AND b.so_iou < 0.5 THEN 'localization_candidate' ELSE 'missed' END AS status_v,
 g.prediction_index IS NOT NULL AS detected
 FROM objects o LEFT JOIN greedy_{tag} g USING (annotation_id) LEFT JOIN best_{tag} b ON b.a = o.annotation_id""")


for M, T in SCORES.items():
    cte(f"d_{M}", "objects", _detections(M))
    cte(f"pairs_{M}", f"d_{M}", f"""SELECT o.image_id, o.annotation_id AS a, o.category_id AS gc, o.area AS garea, d.prediction_index AS p,
 d.category_id AS dc, d.score, {iou_sql()} AS iou FROM objects o JOIN d_{M} d ON o.image_id = d.image_id AND {TOUCH}""")
    status_ctes(M, M, T)
    cte(f"fp_{M}", f"greedy_{M}", f"""SELECT d.*, -(b.na) AS best_gt_annotation_id, b.gc AS best_gt_category_id, coalesce(b.iou, 0) AS best_gt_iou,
 CASE WHEN b.iou >= 0.5 AND d.category_id = b.gc THEN 'duplicate_candidate' WHEN b.iou >= 0.5 THEN 'classification_candidate'
  WHEN b.iou >= 0.1 AND d.category_id = b.gc THEN 'localization_candidate' WHEN b.iou >= 0.1 THEN 'overlap_candidate' ELSE 'background_candidate' END AS fp_type,
 CASE WHEN b.iou >= 0.5 AND d.category_id <> b.gc THEN 'class_confusion_fp' WHEN b.iou >= 0.5 THEN 'duplicate_fp'
  WHEN b.iou >= 0.1 THEN 'localization_fp' ELSE 'background_or_unmatched' END AS fp_type_v
 FROM d_{M} d LEFT JOIN (SELECT p, iou, -a AS na, gc FROM pairs_{M} WHERE iou > 0 QUALIFY row_number() OVER (PARTITION BY p ORDER BY iou DESC, a) = 1) b ON b.p = d.prediction_index
 WHERE d.score >= {T!r}e0 AND NOT EXISTS (SELECT 1 FROM greedy_{M} g WHERE g.prediction_index = d.prediction_index)""")

cte("dense_o", "objects", "SELECT * REPLACE (image_id // 4096 AS image_id) FROM objects")
cte("dense_d", "d_a", "SELECT * REPLACE (image_id // 4096 AS image_id) FROM d_a")
cte("dense_pairs", "dense_o dense_d", f"""SELECT o.image_id, o.annotation_id AS a, o.category_id AS gc, d.prediction_index AS p, d.category_id AS dc, d.score, {iou_sql()} AS iou
 FROM dense_o o JOIN dense_d d ON o.image_id = d.image_id AND o.category_id = d.category_id AND {TOUCH}""")
cte("dense_greedy", "dense_pairs", greedy_sql("dense_pairs", "image_id, gc", 0.5))
cte("wide", "status_a status_b", """SELECT a.annotation_id, a.image_id, a.category_id, a.scale,
 a.status AS a_status, b.status AS b_status, a.detected AS a_detected, b.detected AS b_detected,
 a.matched_score AS a_ms, a.matched_iou AS a_mi, a.best_same_all_score AS a_bs, a.best_same_all_iou AS a_bi,
 b.matched_score AS b_ms, b.matched_iou AS b_mi, b.best_same_all_score AS b_bs, b.best_same_all_iou AS b_bi
 FROM status_a a JOIN status_b b USING (annotation_id)""")


def support_sql(s: str, t: float) -> str:
    return f"(CASE WHEN {s} <= {t!r}e0 THEN 0.5e0 * {s} / {t!r}e0 ELSE 0.5e0 + 0.5e0 * ({s} - {t!r}e0) / {1.0 - t!r}e0 END)"


def quality_sql(m: str, t: float) -> str:
    s = f"coalesce(CASE WHEN {m}_detected THEN {m}_ms ELSE {m}_bs END, 0e0)"
    i = f"coalesce(CASE WHEN {m}_detected THEN {m}_mi ELSE {m}_bi END, 0e0)"
    return f"(CASE WHEN {m}_detected THEN 1e0 ELSE 0.5e0 END * sqrt({support_sql(s, t)} * {i}))"


_F = K.MACRO_F1
_WA, _WB = _F["a"] / (_F["a"] + _F["b"]), _F["b"] / (_F["a"] + _F["b"])
cte("quality", "wide", f"SELECT *, {quality_sql('a', SCORES['a'])} AS a_quality, {quality_sql('b', SCORES['b'])} AS b_quality FROM wide")
cte("joint", "quality", f"""SELECT *, 1e0 - (1e0 - consensus_risk) * (1e0 - disagreement) AS joint_raw_risk FROM (
 SELECT *, {_WA!r}e0 * (1e0 - a_quality) + {_WB!r}e0 * (1e0 - b_quality) AS consensus_risk, abs((1e0 - a_quality) - (1e0 - b_quality)) AS disagreement FROM quality)""")


#: (threshold, macro F1) of the operating points of the sensitivity query.
POINTS = {"a": {"low": (0.15, 0.6), "central": (0.22, 0.62), "high": (0.35, 0.61)}, "b": {"low": (0.2, 0.58), "central": (0.3, 0.6), "high": (0.45, 0.57)}}
for M, own in POINTS.items():
    for P, (T, _) in own.items():
        status_ctes(f"{M}_{P}", M, T)
_COMBINED = [(p, q) for p in POINTS["a"] for q in POINTS["b"]]
_SIDES = ", ".join(f"{m}.status AS {m}_status, {m}.detected AS {m}_detected, {m}.matched_score AS {m}_ms, {m}.matched_iou AS {m}_mi, {m}.best_same_all_score AS {m}_bs, {m}.best_same_all_iou AS {m}_bi" for m in "ab")


def _combined_sql(p: str, q: str) -> str:
    (ta, fa), (tb, fb) = POINTS["a"][p], POINTS["b"][q]
    inner = f"SELECT a.annotation_id, a.image_id, a.category_id, a.scale, {_SIDES} FROM status_a_{p} a JOIN status_b_{q} b USING (annotation_id)"
    return f"""SELECT 'a_{p}__b_{q}' AS combination, *, 1e0 - (1e0 - ({fa / (fa + fb)!r}e0 * (1e0 - qa) + {fb / (fa + fb)!r}e0 * (1e0 - qb))) * (1e0 - abs((1e0 - qa) - (1e0 - qb))) AS joint
 FROM (SELECT *, {quality_sql('a', ta)} AS qa, {quality_sql('b', tb)} AS qb FROM ({inner}))"""


cte("combined", " ".join(f"status_{m}_{p}" for m in "ab" for p in POINTS[m]), " UNION ALL ".join(_combined_sql(p, q) for p, q in _COMBINED))
_MID = "(rank() OVER ({0} ORDER BY joint) - 1 + (count(*) OVER ({0}, joint) - 1) / 2e0) / (count(*) OVER ({0}) - 1)"
cte("combined_risk", "combined", f"""SELECT *, cn / (cn + {K.CLASS_PRIOR!r}e0) * cp + (1e0 - cn / (cn + {K.CLASS_PRIOR!r}e0)) * gp AS risk_score FROM (
 SELECT *, {_MID.format('PARTITION BY combination')} AS gp, {_MID.format('PARTITION BY combination, category_id')} AS cp,
 count(*) OVER (PARTITION BY combination, category_id) AS cn FROM combined)""")
cte("combined_sets", "combined_risk", """SELECT combination, annotation_id, image_id, unnest(list_filter([CASE WHEN scale = 'small' AND NOT a_detected AND NOT b_detected THEN 'small_jointly_missed' END,
 CASE WHEN b_detected AND NOT a_detected THEN 'b_supported_a_failure' END, CASE WHEN a_status = 'low_confidence_candidate' THEN 'a_low_confidence' END,
 CASE WHEN a_status = 'localization_error_candidate' THEN 'a_localization' END, CASE WHEN a_status = 'classification_error_candidate' THEN 'a_classification' END,
 CASE WHEN scale = 'small' AND risk_score >= 0.75e0 THEN 'small_high_risk' END], lambda x: x IS NOT NULL)) AS subset FROM combined_risk""")


def mid_sql(value: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    same = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    n = f"count(*) OVER ({part})"
    rank = f"(rank() OVER ({part} ORDER BY {value}) - 1 + (count(*) OVER ({same}) - 1) / 2e0)"
    return f"CASE WHEN {n} = 1 THEN 0.5e0 ELSE {rank} / ({n} - 1) END"


cte("ranked", "joint", f"""SELECT *, {mid_sql('joint_raw_risk')} AS global_percentile, {mid_sql('joint_raw_risk', 'category_id')} AS class_percentile,
 count(*) OVER (PARTITION BY category_id) AS class_count FROM joint""")
cte("scored", "ranked", """SELECT *, class_count / (class_count + 500e0) * class_percentile + (1e0 - class_count / (class_count + 500e0)) * global_percentile AS risk_score FROM ranked""")
cte("risk", "scored", """SELECT *, CASE WHEN risk_score >= 0.9e0 THEN 'critical' WHEN risk_score >= 0.75e0 THEN 'high' WHEN risk_score >= 0.5e0 THEN 'medium' ELSE 'standard' END AS risk_tier FROM scored""")
SUBSETS = {
    "small_jointly_missed": "scale = 'small' AND NOT a_detected AND NOT b_detected",
    "b_supported_a_failure": "b_detected AND NOT a_detected",
    "a_low_confidence": "a_status = 'low_confidence_candidate'",
    "a_localization": "a_status = 'localization_error_candidate'",
    "a_classification": "a_status = 'classification_error_candidate'",
    "small_high_risk": "scale = 'small' AND risk_score >= 0.75e0",
}
cte("members", "risk", " UNION ALL ".join(f"SELECT '{n}' AS subset, annotation_id, image_id, category_id, scale, risk_score FROM risk WHERE {c}" for n, c in SUBSETS.items()))
cte("grouped", "risk", """SELECT *, CASE WHEN scale = 'small' AND NOT a_detected AND NOT b_detected THEN 'small_joint_not_detected'
 WHEN b_detected AND NOT a_detected THEN 'b_supported_a_failure' WHEN a_status = 'low_confidence_candidate' THEN 'a_low_confidence'
 WHEN scale = 'small' AND risk_tier IN ('high', 'critical') THEN 'small_high_or_critical'
 WHEN a_status IN ('localization_error_candidate', 'assignment_conflict_candidate') THEN 'a_geometric_failure'
 WHEN a_status = 'classification_error_candidate' THEN 'a_classification_failure'
 WHEN NOT a_detected AND NOT b_detected THEN 'other_joint_not_detected' WHEN risk_tier IN ('high', 'critical') THEN 'other_high_or_critical'
 ELSE 'standard_support' END AS failure_group FROM risk""")

# Segment regions: the triangle leaves its box on the left, the rectangle is the box.
cte("seg_pairs", "pairs_a", "SELECT * FROM pairs_a WHERE gc = dc AND dc NOT IN (2, 10) AND score >= 0.05e0")
cte("seg_match", "seg_pairs", greedy_sql("seg_pairs", "image_id, gc", 0.5))
cte("seg_region", "seg_match d_a", """SELECT m.annotation_id, m.prediction_index, m.score, m.iou, d.prediction_index % 4 = 0 AS tri,
 greatest(o.x, d.x) AS l, least(o.x+o.w, d.x+d.w) AS r, greatest(o.y, d.y) AS t, least(o.y+o.h, d.y+d.h) AS b,
 o.x AS ox, o.y AS oy, o.w AS ow, o.h AS oh, d.x, d.y, d.w, d.h
 FROM seg_match m JOIN d_a d USING (prediction_index) JOIN objects o ON o.annotation_id = m.annotation_id""")
# The triangle (x-w,y) (x+w,y) (x+w,y+h) is clipped by integrating its height over the overlap in x.
cte("seg_area", "seg_region", """SELECT *, w*h AS area,
 CASE WHEN NOT tri THEN (r - l) * (b - t) ELSE
  (SELECT CASE WHEN xr <= xl OR hi <= lo THEN 0e0 ELSE
    (CASE WHEN xr > greatest(xl, xs) THEN ((least(xr, greatest(xe, xl)) - greatest(xl, xs)) * (((greatest(xl, xs) - x + w) * h / (2*w) + y - lo) + ((least(xr, greatest(xe, xl)) - x + w) * h / (2*w) + y - lo)) / 2 + (xr - least(xr, greatest(xe, xl))) * (hi - lo)) ELSE 0e0 END)
   END FROM (SELECT greatest(ox, x - w) AS xl, least(ox + ow, x + w) AS xr, greatest(oy, y) AS lo, least(oy + oh, y + h) AS hi,
     x - w + (greatest(oy, y) - y) * 2 * w / h AS xs, x - w + (least(oy + oh, y + h) - y) * 2 * w / h AS xe) z)
 END AS inside FROM seg_region""")
cte("evidence", "seg_area seg_pairs", """SELECT o.annotation_id, o.image_id, o.category_id, o.category_id NOT IN (2, 10) AS applicable, s.prediction_index, s.score AS seg_score, s.iou AS seg_bbox_iou,
 s.area AS polygon_area, s.inside AS inside_area, s.inside / s.area AS inside_ratio, s.inside / (s.ow * s.oh) AS gt_coverage, q.iou AS best_same_class_iou,
 CASE WHEN o.category_id IN (2, 10) THEN 'not_applicable' WHEN s.inside / s.area >= 0.5 THEN 'region_supported' WHEN s.prediction_index IS NOT NULL THEN 'bbox_matched_weak_region_overlap'
  WHEN q.iou >= 0.1 THEN 'localization_candidate' ELSE 'no_spatial_support' END AS seg_status
 FROM objects o LEFT JOIN seg_area s USING (annotation_id) LEFT JOIN (SELECT a, max(iou) AS iou FROM seg_pairs GROUP BY a) q ON q.a = o.annotation_id""")
cte("graded", "evidence", """SELECT *, CASE WHEN applicable THEN seg_status = 'region_supported' END AS support,
 CASE WHEN NOT applicable THEN 'not_applicable' WHEN seg_status <> 'region_supported' THEN 'none' WHEN seg_score >= 0.25 THEN 'strong' WHEN seg_score >= 0.1 THEN 'moderate' WHEN seg_score >= 0.05 THEN 'weak' ELSE 'none' END AS evidence FROM evidence""")
_NAMES = " ".join(f"WHEN {i} THEN '{n}'" for i, n in K.CATEGORIES.items())
cte("tax", "wide graded images", f"""SELECT w.*, g.applicable, g.support, g.evidence, i.timeofday, i.weather, i.scene, CASE w.category_id {_NAMES} END AS category,
 CASE WHEN a_detected AND b_detected THEN CASE WHEN evidence = 'not_applicable' THEN 'stable_detection_no_seg_evidence' WHEN evidence <> 'none' THEN 'stable_detection_with_region_evidence' ELSE 'detection_success_without_seg_support' END
  WHEN b_detected THEN CASE WHEN evidence = 'not_applicable' THEN 'a_architecture_sensitive_candidate_no_seg_evidence' WHEN evidence <> 'none' THEN 'a_specific_detection_failure_candidate' ELSE 'a_architecture_sensitive_candidate_without_seg_support' END
  WHEN a_detected THEN CASE WHEN evidence = 'not_applicable' THEN 'b_architecture_sensitive_candidate_no_seg_evidence' WHEN evidence <> 'none' THEN 'b_specific_detection_failure_candidate' ELSE 'b_architecture_sensitive_candidate_without_seg_support' END
  ELSE CASE WHEN evidence = 'not_applicable' THEN 'shared_detection_difficulty_no_seg_evidence' WHEN evidence <> 'none' THEN 'shared_detection_difficulty_with_region_evidence' ELSE 'shared_visual_hard_sample_candidate' END END AS taxonomy,
 CASE WHEN NOT applicable THEN CASE WHEN a_detected AND b_detected THEN 'stable_detection_no_seg_evidence' WHEN b_detected THEN 'a_architecture_sensitive_candidate_no_seg' WHEN NOT a_detected THEN 'shared_detection_difficulty_no_seg_evidence' ELSE 'b_architecture_sensitive_candidate_no_seg' END
  WHEN a_detected AND b_detected THEN CASE WHEN support THEN 'stable' ELSE 'fine_grained_perception_degradation_candidate' END
  WHEN b_detected THEN CASE WHEN support THEN 'a_specific_detection_failure_candidate' ELSE 'architecture_sensitive_a_failure_mixed_seg_evidence' END
  WHEN NOT a_detected THEN CASE WHEN support THEN 'shared_detection_difficulty_candidate' ELSE 'shared_visual_hard_sample_candidate' END
  ELSE CASE WHEN support THEN 'b_specific_detection_failure_candidate' ELSE 'architecture_sensitive_b_failure_mixed_seg_evidence' END END AS failure_type
 FROM wide w JOIN graded g USING (annotation_id) JOIN images i ON i.image_id = w.image_id""")

# Precision: masks as rows, one per (detection, area, threshold).
_THR = ", ".join(f"{t!r}e0" for t in K.IOU_THRESHOLDS)
cte("cells", "", f"SELECT a.k AS area, t.k AS thr, ([{_THR}])[t.k + 1] AS iou, ([0e0, 0e0, 1024e0, 9216e0])[a.k + 1] AS lo, ([1e10, 1024e0, 9216e0, 1e10])[a.k + 1] AS hi FROM (SELECT unnest(range(4)) AS k) a, (SELECT unnest(range(10)) AS k) t")
cte("gtc", "objects cells", "SELECT o.image_id, o.category_id, c.area, count(*) AS n FROM objects o JOIN cells c ON c.thr = 0 AND o.area BETWEEN c.lo AND c.hi GROUP BY ALL")
for M in SCORES:
    cte(f"cut_{M}", f"d_{M}", f"SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, prediction_index) AS rank FROM d_{M} QUALIFY rank <= 100")
    cte(f"found_{M}", f"cut_{M} pairs_{M} cells", f"""SELECT area, thr, m.p AS p, m.ign AS ign FROM (
 SELECT image_id, gc, area, thr, unnest(list_reduce(ps, {TAKE}, ps[1:0])) AS m FROM (
  SELECT x.image_id, x.gc, c.area, c.thr, list(struct_pack(p := x.p, a := x.a, ign := NOT (x.garea BETWEEN c.lo AND c.hi)) ORDER BY r.rank, NOT (x.garea BETWEEN c.lo AND c.hi), x.iou DESC, x.a DESC) AS ps
  FROM pairs_{M} x JOIN cut_{M} r ON r.prediction_index = x.p JOIN cells c ON x.iou >= c.iou WHERE x.gc = x.dc GROUP BY ALL))""")
    cte(f"hit_{M}", f"found_{M}", f"""SELECT r.image_id, r.category_id, r.prediction_index, r.score, r.rank, c.area, c.thr, CASE WHEN f.p IS NOT NULL AND NOT f.ign THEN 1 ELSE 0 END AS tp,
 CASE WHEN f.ign OR (f.p IS NULL AND NOT (r.w * r.h BETWEEN c.lo AND c.hi)) THEN 1 ELSE 0 END AS ign
 FROM cut_{M} r JOIN cells c ON true LEFT JOIN found_{M} f ON f.p = r.prediction_index AND f.area = c.area AND f.thr = c.thr""")

# Crowds: always ignored, measured by the part of the detection that they cover, matched any number of times.
cte("crowd_o", "objects", """SELECT * REPLACE (w * h AS area) FROM (SELECT * REPLACE (CASE WHEN rn % 4 = 3 THEN x - w ELSE x END AS x, CASE WHEN rn % 4 = 3 THEN y - h ELSE y END AS y,
 CASE WHEN rn % 4 = 3 THEN w * 3 ELSE w END AS w, CASE WHEN rn % 4 = 3 THEN h * 3 ELSE h END AS h), rn % 4 = 3 AS crowd FROM objects)""")
cte("crowd_pairs", "crowd_o cut_a", f"""SELECT o.image_id, o.annotation_id AS a, o.category_id AS gc, o.area AS garea, o.crowd, d.prediction_index AS p, d.rank,
 CASE WHEN o.crowd THEN {inter_sql()} / (d.w * d.h) ELSE {iou_sql()} END AS iou FROM crowd_o o JOIN cut_a d ON o.image_id = d.image_id AND o.category_id = d.category_id AND {TOUCH}""")
_CROWD_TAKE = "lambda acc, q: CASE WHEN len(list_filter(acc, lambda m: (m.a = q.a AND NOT q.c) OR m.p = q.p)) > 0 THEN acc ELSE list_append(acc, q) END"
cte("found_crowd", "crowd_pairs cells", f"""SELECT area, thr, m.p AS p, m.ign AS ign FROM (
 SELECT image_id, gc, area, thr, unnest(list_reduce(ps, {_CROWD_TAKE}, ps[1:0])) AS m FROM (
  SELECT image_id, gc, area, thr, list(struct_pack(p := p, a := a, c := crowd, ign := ign) ORDER BY rank, ign, iou DESC, a DESC) AS ps
  FROM (SELECT x.*, c.area, c.thr, x.crowd OR NOT (x.garea BETWEEN c.lo AND c.hi) AS ign FROM crowd_pairs x JOIN cells c ON x.iou >= c.iou) GROUP BY ALL))""")
cte("hit_crowd", "found_crowd cut_a cells", """SELECT r.image_id, r.category_id, r.prediction_index, r.score, r.rank, c.area, c.thr, CASE WHEN f.p IS NOT NULL AND NOT f.ign THEN 1 ELSE 0 END AS tp,
 CASE WHEN f.ign OR (f.p IS NULL AND NOT (r.w * r.h BETWEEN c.lo AND c.hi)) THEN 1 ELSE 0 END AS ign
 FROM cut_a r JOIN cells c ON true LEFT JOIN found_crowd f ON f.p = r.prediction_index AND f.area = c.area AND f.thr = c.thr""")
cte("gtc_crowd", "crowd_o cells", "SELECT o.image_id, o.category_id, c.area, count(*) AS n FROM crowd_o o JOIN cells c ON c.thr = 0 AND NOT o.crowd AND o.area BETWEEN c.lo AND c.hi GROUP BY ALL")


def precision_ctes(tag: str, model: str, by: str = "", join: str = "", weight: str = "1", deps: str = "", counts: str = "gtc") -> None:
    """CTEs cells_<tag> and summary_<tag>; ``by`` ends with a comma when given."""
    keys = f"{by} category_id"
    cte(f"gt_{tag}", f"{counts} {deps}", f"SELECT {keys}, area, sum(n * {weight}) AS gt FROM {counts} {join} GROUP BY ALL HAVING sum(n * {weight}) > 0")
    cte(f"run_{tag}", f"hit_{model} {deps}", f"""SELECT {keys}, area, thr, tp, rank, {weight} AS wt, sum(tp * {weight}) OVER w AS t, sum((1 - ign) * {weight}) OVER w AS n FROM hit_{model} {join}
 WINDOW w AS (PARTITION BY {keys}, area, thr ORDER BY score DESC, image_id, rank ROWS UNBOUNDED PRECEDING)""")
    cte(f"point_{tag}", f"run_{tag} gt_{tag}", f"""SELECT {keys}, area, thr, k, max(prec) AS prec FROM (
  SELECT {keys}, area, thr, t / (n + 2.220446049250313e-16) AS prec, list_max(list_filter(range(101), lambda k: k * 0.01e0 <= CAST(t AS DOUBLE) / CAST(gt AS DOUBLE))) AS k
  FROM run_{tag} JOIN gt_{tag} USING ({keys}, area) WHERE tp = 1) GROUP BY ALL""")
    cte(f"ap_{tag}", f"point_{tag}", f"""SELECT {keys}, area, thr, sum(best) / 101e0 AS ap FROM (
  SELECT {keys}, area, thr, s.k AS at_k, max(prec) AS best FROM point_{tag} q JOIN (SELECT unnest(range(101)) AS k) s ON q.k >= s.k GROUP BY ALL) GROUP BY ALL""")
    cte(f"recall_{tag}", f"run_{tag}", f"SELECT {keys}, area, thr, sum(tp * wt) AS t100, sum(tp * wt) FILTER (WHERE rank <= 10) AS t10, sum(tp * wt) FILTER (WHERE rank <= 1) AS t1 FROM run_{tag} GROUP BY ALL")
    cte(f"cells_{tag}", f"ap_{tag} recall_{tag}", f"""SELECT {keys}, area, s.k AS thr, gt, coalesce(ap, 0) AS ap, coalesce(t100, 0) / CAST(gt AS DOUBLE) AS r100, coalesce(t10, 0) / CAST(gt AS DOUBLE) AS r10, coalesce(t1, 0) / CAST(gt AS DOUBLE) AS r1
 FROM (SELECT *, unnest(range(10)) AS k, k AS thr FROM gt_{tag}) s LEFT JOIN ap_{tag} USING ({keys}, area, thr) LEFT JOIN recall_{tag} USING ({keys}, area, thr)""")
    metric = ", ".join(
        [
            "avg(ap) FILTER (WHERE area = 0) AS \"AP\"", "avg(ap) FILTER (WHERE area = 0 AND thr = 0) AS \"AP50\"", "avg(ap) FILTER (WHERE area = 0 AND thr = 5) AS \"AP75\"",
            *[f"avg(ap) FILTER (WHERE area = {k}) AS \"AP_{n}\"" for k, n in ((1, "small"), (2, "medium"), (3, "large"))],
            "avg(r1) FILTER (WHERE area = 0) AS \"AR1\"", "avg(r10) FILTER (WHERE area = 0) AS \"AR10\"", "avg(r100) FILTER (WHERE area = 0) AS \"AR100\"",
            *[f"avg(r100) FILTER (WHERE area = {k}) AS \"AR_{n}\"" for k, n in ((1, "small"), (2, "medium"), (3, "large"))],
        ]
    )
    cte(f"summary_{tag}", f"cells_{tag}", f"SELECT {by} {metric} FROM cells_{tag} GROUP BY ALL")
    cte(f"classes_{tag}", f"cells_{tag}", f"SELECT {by} category_id, {metric} FROM cells_{tag} GROUP BY ALL")


for M in SCORES:
    precision_ctes(M, M)
precision_ctes("crowd", "crowd", counts="gtc_crowd")
cte("membership", "images", "SELECT image_id AS mi, 'overall' AS dimension, 'all' AS value FROM images " + " ".join(f"UNION ALL SELECT image_id, '{d}', {d} FROM images" for d in ("timeofday", "weather", "scene")))
precision_ctes("cond", "a", "dimension, value,", "JOIN membership ON mi = image_id", deps="membership")
#: Replicates of the bootstrap's metrics in SQL, which copies every detection for each of them and forty cells.
REPLICATES = 2
#: Replicates of weights and ratios.
DRAWS = 50
cte("places", "images", "SELECT image_id, row_number() OVER (ORDER BY image_id) AS place, count(*) OVER () AS n FROM images")


def uniform_sql(label: str, seed: int) -> str:
    return f"((CAST('0x' || substr(sha256('{seed}:' || {label}), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


for name, size in (("weights", REPLICATES), ("draws", DRAWS)):
    cte(name, "places", f"""SELECT replicate, image_id AS wi, weight FROM (
 SELECT replicate, 1 + CAST(floor({uniform_sql("'replicate' || replicate || ':' || place", K.BOOTSTRAP_SEED)} * n) AS BIGINT) AS place, count(*) AS weight
 FROM places, (SELECT unnest(range({size})) AS replicate) GROUP BY ALL) JOIN places USING (place)""")
for M in SCORES:
    precision_ctes(f"boot_{M}", M, "replicate,", "JOIN weights ON wi = image_id", "weight", "weights")


def with_ctes(needs: str, body: str) -> str:
    """Prefix a query with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0].split():
            visit(dep)
        order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body
