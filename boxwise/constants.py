"""Fixed values shared by the operators.

These are thresholds, quotas and name lists of the study whose results the
operators reproduce; they are parameters' defaults, never hidden limits.
"""

# Class ids and names.
CATEGORIES = {
    1: "pedestrian",
    2: "rider",
    3: "car",
    4: "truck",
    5: "bus",
    6: "train",
    7: "motorcycle",
    8: "bicycle",
    9: "traffic light",
    10: "traffic sign",
}

# Accepted spellings of class names.
SYNONYMS = {
    "person": "pedestrian",
    "motor": "motorcycle",
    "bike": "bicycle",
}

# Box scale classes by area in square pixels.
SMALL_AREA = 1024.0
MEDIUM_AREA = 9216.0
SCALES = ("small", "medium", "large")

# Matching and operating thresholds.
MATCH_IOU = 0.5
LOCALIZATION_IOU = 0.1
OPERATING_SCORE = {"a": 0.22527144849300385, "b": 0.4963708519935608}
VALIDATION_SCORE = 0.25
SCORE_FLOOR = 0.001
MAX_DETECTIONS = 100

# Calibration and risk.
MACRO_F1 = {"a": 0.6945657943717607, "b": 0.7012245282327485}
NONDETECTION_MULTIPLIER = 0.5
CLASS_PRIOR = 500
MIN_CLASS_GT = 100
TIERS = (("critical", 0.90), ("high", 0.75), ("medium", 0.50))

# Evidence grades of a supported region by score.
EVIDENCE_GRADES = (("strong", 0.25), ("moderate", 0.10), ("weak", 0.05))

# Sampling.
SAMPLING_SEED = 20260809
BOOTSTRAP_SEED = 20260816
RISK_BINS = 20
MAX_CLASS_FRACTION = 0.35
MIN_CLASS_SUPPORT = 500
MEAN_RISK_GAP = 0.03
GROUP_QUOTAS = {
    "a_geometric_failure": 1950,
    "a_classification_failure": 1365,
    "other_joint_not_detected": 975,
    "other_high_or_critical": 585,
    "b_supported_a_failure": 3900,
    "a_low_confidence": 1950,
    "small_high_or_critical": 975,
    "small_joint_not_detected": 7800,
}

# Crop policy per group (min height, max height, low and high context factor).
CONTROL_CROP = (192.0, 560.0, 7.0, 14.0)
CROP_POLICY = {
    "small_joint_not_detected": (144.0, 400.0, 9.0, 16.0),
    "b_supported_a_failure": (192.0, 560.0, 7.0, 14.0),
    "a_low_confidence": (192.0, 560.0, 8.0, 14.0),
    "small_high_or_critical": (144.0, 400.0, 9.0, 16.0),
    "a_geometric_failure": (256.0, 640.0, 6.0, 12.0),
    "a_classification_failure": (288.0, 680.0, 7.0, 12.0),
    "other_joint_not_detected": (256.0, 640.0, 6.0, 12.0),
    "other_high_or_critical": (192.0, 560.0, 7.0, 13.0),
}
BALANCED_CROP_POLICY = {
    **CROP_POLICY,
    "small_joint_not_detected": (192.0, 560.0, 7.0, 14.0),
    "a_low_confidence": (288.0, 680.0, 10.0, 18.0),
    "small_high_or_critical": (128.0, 360.0, 7.0, 12.0),
}
CENTRE_JITTER = 0.08
MIN_VISIBLE = 0.50
MIN_SIDE = 2.0
NETWORK_SIZE = 960.0

# Image variants.
CORRUPTIONS = ("low_light", "fog", "rain", "blur", "noise")
SEVERITIES = (1, 2, 3)

# Average-precision protocol.
IOU_THRESHOLDS = tuple(0.5 + 0.05 * i for i in range(10))
AREA_RANGES = ("all", "small", "medium", "large")
