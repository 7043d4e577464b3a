"""Fixed values of the cohort model.

Everything here is data, not logic: feature lists, label strings,
thresholds, the norm table and the fixed-coefficient scores.  Functions
elsewhere read these tables; change a value here and every query, oracle
and test follows.
"""

from __future__ import annotations

# --- fixed values: row key and the eight numeric features of the cohort ---
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
FEATURES = [
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "p_retailprice",
    "o_totalprice",
    "c_acctbal",
    "p_size",
]
LABEL = "outcome"
GROUP = "country"

# --- fixed values: split and hashing ---
HASH_SPAN = 4294967296.0  # 2**32: eight hex digits of md5
TEST_MODULUS = 5  # test row when h_split mod 5 = 0 (an 80/20 split)
N_FOLDS = 5

# --- fixed values: region dimension (nations with key below this are mapped) ---
MAPPED_NATION_LIMIT = 20
UNMAPPED_REGION = "Other"
ALL_OPTION = "All"

# --- fixed values: decision threshold, tiers and zones ---
DECISION_PCT = 50.0  # label = positive when probability*100 >= 50 (inclusive)
TIER_HIGH_PCT = 75.0
TIER_MODERATE_PCT = 50.0
POSITIVE = "Positive"
NEGATIVE = "Negative"
TIER_HIGH = "High"
TIER_MODERATE = "Moderate"
TIER_LOW = "Low"
MESSAGE_HIGH = "Score in the top tier; a specialist should look at it."
MESSAGE_MODERATE = "Score in the middle tier; worth a follow-up."
MESSAGE_LOW = "Score in the bottom tier; nothing to do now."
ZONE_LOW_BELOW = 0.3
ZONE_MODERATE_BELOW = 0.7
ZONE_LOW = "Low Risk"
ZONE_MODERATE = "Moderate Risk"
ZONE_HIGH = "High Risk"

# --- fixed values: z-score interpretation chain (checked in this order) ---
Z_HIGH = "High (above average)"
Z_SLIGHT_HIGH = "Slightly above average"
Z_LOW = "Low (below average)"
Z_SLIGHT_LOW = "Slightly below average"
Z_NORMAL = "Normal range"
Z_INTENSITY_SPAN = 3.0

# --- fixed values: norm table (feature, mean, population std) for z-scores ---
NORMS = [
    ("l_quantity", 25.5, 14.4),
    ("l_extendedprice", 53000.0, 30000.0),
    ("l_discount", 0.05, 0.03),
    ("l_tax", 0.04, 0.02),
    ("p_retailprice", 950.0, 29.0),
    ("o_totalprice", 250000.0, 144000.0),
    ("c_acctbal", 4460.0, 3200.0),
    ("p_size", 25.5, 14.4),
]
# integer features whose norm statistics are cut to integers before use
TRUNCATED_NORMS = ["l_quantity", "p_size"]

# --- fixed values: alert rules (name, feature, comparison, threshold) ---
ALERT_RULES = [
    ("high_quantity", "l_quantity", ">", 45.0),
    ("negative_balance", "c_acctbal", "<", 0.0),
    ("large_order", "o_totalprice", ">", 450000.0),
]

# --- fixed values: input bounds per feature, checked in this order ---
BOUNDS = [
    ("l_quantity", 1.0, 48.0),
    ("l_extendedprice", 0.0, 1000000.0),
    ("l_discount", 0.0, 0.1),
    ("l_tax", 0.0, 0.08),
    ("p_retailprice", 0.0, 10000.0),
    ("o_totalprice", 0.0, 1000000.0),
    ("c_acctbal", 0.0, 9000.0),
    ("p_size", 1.0, 50.0),
]
VALID = "valid"
REJECTED = "rejected"
NO_REASON = "none"

# --- fixed values: the fixed-coefficient scores (deterministic "models") ---
# each standardised term is (feature, centre, scale); a model is an
# intercept plus weights on those terms.  Declared order breaks ties.
SCORE_TERMS = {
    "z_q": ("l_quantity", 25.5, 14.4),
    "z_s": ("p_size", 25.5, 14.4),
    "z_d": ("l_discount", 0.05, 0.03),
}
SCORE_MODELS = [
    ("full", -0.8, {"z_q": 1.0, "z_s": 0.6, "z_d": -0.4}),
    ("quantity", -0.8, {"z_q": 1.0}),
    ("size", -0.8, {"z_s": 0.6}),
]
# the planted outcome uses the `full` logit against a second hash
PLANTED_MODEL = "full"
SCORE_DIGITS = 6

# --- fixed values: histogram / density grids ---
PROB_BINS = 25
RANGE_BINS = 20
KDE_GRID = 200

# --- fixed values: streaming score of events: logit = (value - 50) / 50 ---
EVENT_CENTRE = 50.0
EVENT_SCALE = 50.0
# input bounds of a scored event (out-of-range rows are flagged, still scored)
EVENT_BOUNDS = [("value", 0.0, 100.0)]
