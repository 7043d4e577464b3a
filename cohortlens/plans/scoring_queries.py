"""Catalogue: deterministic scoring, evaluation, splits and folds.

The three fixed-coefficient scores stand in for fitted models so that every
evaluation operator has an exact oracle.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.derive import (
    fixed_score,
    is_test,
    predicted_label,
    prediction_text,
    risk_tier,
    risk_zone,
    standardised,
)
from ..operators import evaluate as E
from ..operators import grouping as G
from ..operators import prep as P
from ..operators import scoring as SC
from ..operators import stats as ST
from ..sources import tables as T
from . import oracle_sql as S
from .registry import query

MODELS = [m[0] for m in C.SCORE_MODELS]
SCORED = S.with_cohort(S.SCORES_CTE, S.TEST_SCORES_CTE)
PCT = S.d(100.0)


def _scores(spark, sf_dir, test_only=False):
    c = T.cohort(spark, sf_dir)
    if test_only:
        c = c.where(is_test("h_split"))
    return E.fixed_scores_long(c, [*C.KEYS, "h_split", C.LABEL, C.GROUP])


# ------------------------------------------------------------------- scores
@query(
    "logistic_score",
    SCORED + "\nSELECT model, country, round(avg(p), 6) AS avg_p FROM scores GROUP BY model, country",
)
def logistic_score(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return G.rounded(s.groupBy("model", C.GROUP).agg(F.avg("p").alias("avg_p")))


def _tier_sql(p: str) -> str:
    return (
        f"CASE WHEN {p} * {PCT} >= {S.d(C.TIER_HIGH_PCT)} THEN {S.q(C.TIER_HIGH)} "
        f"WHEN {p} * {PCT} >= {S.d(C.TIER_MODERATE_PCT)} THEN {S.q(C.TIER_MODERATE)} ELSE {S.q(C.TIER_LOW)} END"
    )


def _prediction_sql(p: str) -> str:
    return f"CASE WHEN {p} * {PCT} >= {S.d(C.DECISION_PCT)} THEN {S.q(C.POSITIVE)} ELSE {S.q(C.NEGATIVE)} END"


def _label_sql(p: str) -> str:
    return f"CASE WHEN {p} * {PCT} >= {S.d(C.DECISION_PCT)} THEN 1 ELSE 0 END"


@query(
    "risk_tiers",
    SCORED
    + f"\nSELECT {_prediction_sql('p')} AS prediction, {_tier_sql('p')} AS tier, count(*) AS n "
    "FROM scores WHERE model = 'full' GROUP BY 1, 2",
)
def risk_tiers(spark, sf_dir):
    c = T.cohort(spark, sf_dir).withColumn("p", fixed_score("full"))
    return c.groupBy(prediction_text(F.col("p")).alias("prediction"), risk_tier(F.col("p")).alias("tier")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "risk_zones",
    SCORED
    + f"""
SELECT CASE WHEN p < {S.d(C.ZONE_LOW_BELOW)} THEN {S.q(C.ZONE_LOW)} WHEN p < {S.d(C.ZONE_MODERATE_BELOW)} THEN {S.q(C.ZONE_MODERATE)}
            ELSE {S.q(C.ZONE_HIGH)} END AS zone, outcome, count(*) AS n
FROM test_scores WHERE model = 'full' GROUP BY 1, 2""",
)
def risk_zones(spark, sf_dir):
    c = T.cohort(spark, sf_dir).where(is_test("h_split")).withColumn("p", fixed_score("full"))
    return c.groupBy(risk_zone(F.col("p")).alias("zone"), C.LABEL).agg(F.count(F.lit(1)).alias("n"))


def _alert_sql() -> str:
    parts = [
        f"SELECT {S.q(name)} AS rule, count(*) FILTER (WHERE CAST({f} AS DOUBLE) {op} {S.d(t)}) AS n FROM cohort"
        for name, f, op, t in C.ALERT_RULES
    ]
    return S.with_cohort() + "\n" + "\nUNION ALL ".join(parts)


@query("alert_rules", _alert_sql())
def alert_rules(spark, sf_dir):
    return SC.rule_hits(T.cohort(spark, sf_dir))


def _validation_sql() -> str:
    whens = " ".join(
        f"WHEN {f} IS NULL OR CAST({f} AS DOUBLE) < {S.d(lo)} OR CAST({f} AS DOUBLE) > {S.d(hi)} THEN {S.q(f)}"
        for f, lo, hi in C.BOUNDS
    )
    return (
        S.with_cohort(f"v AS (SELECT CASE {whens} ELSE NULL END AS r FROM cohort)")
        + f"\nSELECT CASE WHEN r IS NULL THEN {S.q(C.VALID)} ELSE {S.q(C.REJECTED)} END AS status, "
        f"coalesce(r, {S.q(C.NO_REASON)}) AS reason, count(*) AS n FROM v GROUP BY 1, 2"
    )


@query("range_validation", _validation_sql())
def range_validation(spark, sf_dir):
    return G.count_by(SC.validate(T.cohort(spark, sf_dir)), "status", "reason")


def _zscore_sql() -> str:
    norms = " UNION ALL ".join(
        f"SELECT {S.q(f)} AS feature, {S.d(int(m) if f in C.TRUNCATED_NORMS else m)} AS mean, {S.d(int(s) if f in C.TRUNCATED_NORMS else s)} AS std"
        for f, m, s in C.NORMS
    )
    unpiv = " UNION ALL ".join(f"SELECT {S.q(f)} AS feature, CAST({f} AS DOUBLE) AS x FROM cohort" for f in C.FEATURES)
    z = "CAST(round_even(CAST((l.x - nt.mean) / nt.std AS DECIMAL(18,8)), 2) AS DOUBLE)"
    interp = (
        f"CASE WHEN z >= {S.d(1)} THEN {S.q(C.Z_HIGH)} WHEN z >= {S.d(0.5)} THEN {S.q(C.Z_SLIGHT_HIGH)} "
        f"WHEN z <= {S.d(-1)} THEN {S.q(C.Z_LOW)} WHEN z <= {S.d(-0.5)} THEN {S.q(C.Z_SLIGHT_LOW)} ELSE {S.q(C.Z_NORMAL)} END"
    )
    direction = "CASE WHEN z > 0 THEN 'above' WHEN z < 0 THEN 'below' ELSE 'at' END"
    return (
        S.with_cohort(
            f"nt AS ({norms})",
            f"l AS ({unpiv})",
            f"zz AS (SELECT l.feature, {z} AS z FROM l JOIN nt ON l.feature = nt.feature)",
        )
        + f"\nSELECT feature, {interp} AS interpretation, {direction} AS direction, count(*) AS n, round(max(abs(z)), 6) AS max_abs_z, "
        f"round(avg(least(abs(z) / {S.d(C.Z_INTENSITY_SPAN)}, {S.d(1)})), 6) AS avg_intensity FROM zz GROUP BY 1, 2, 3"
    )


@query("zscore_profile", _zscore_sql())
def zscore_profile(spark, sf_dir):
    c = T.cohort(spark, sf_dir)
    return G.rounded(SC.zscore_profile(c, SC.norm_table(spark, truncate=C.TRUNCATED_NORMS)))


@query(
    "prediction_report",
    SCORED
    + f"""
SELECT {S.KEY_LIST}, {S.FEATURE_LIST}, round(p * {PCT}, 4) AS probability_pct,
       {_prediction_sql('p')} AS prediction,
       CASE WHEN p * {PCT} >= {S.d(C.TIER_HIGH_PCT)} THEN {S.q(C.MESSAGE_HIGH)}
            WHEN p * {PCT} >= {S.d(C.TIER_MODERATE_PCT)} THEN {S.q(C.MESSAGE_MODERATE)} ELSE {S.q(C.MESSAGE_LOW)} END AS message
FROM (SELECT c.*, {S.score_sql('full')} AS p FROM cohort c)""",
)
def prediction_report(spark, sf_dir):
    c = T.cohort(spark, sf_dir).withColumn("p", fixed_score("full"))
    return SC.report_rows(c, "p", [*C.KEYS, *C.FEATURES])


# --------------------------------------------------------------- evaluation
def _metrics_sql(src: str, by: str = "model") -> str:
    lab = _label_sql("p")
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {sel}round(100.0 * (tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, "
        f"round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE 100.0 * tp / (tp + fp) END, 6) AS precision, "
        f"round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE 100.0 * tp / (tp + fn) END, 6) AS recall, "
        f"round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 100.0 * 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 "
        f"FROM (SELECT {sel}CAST(sum(CASE WHEN outcome = 1 AND {lab} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, "
        f"CAST(sum(CASE WHEN outcome = 0 AND {lab} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, "
        f"CAST(sum(CASE WHEN outcome = 1 AND {lab} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn, "
        f"CAST(sum(CASE WHEN outcome = 0 AND {lab} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM {src}{grp})"
    )


def _model_metrics(spark, sf_dir):
    s = E.with_prediction(_scores(spark, sf_dir, test_only=True))
    return E.binary_metrics(s, ["model"], C.LABEL, "pred")


@query("model_metrics", SCORED + "\n" + _metrics_sql("test_scores"))
def model_metrics(spark, sf_dir):
    return G.rounded(_model_metrics(spark, sf_dir))


@query(
    "metric_series",
    SCORED
    + f"\n, mm AS ({_metrics_sql('test_scores')})\n"
    "SELECT model, 'accuracy' AS metric, accuracy AS value FROM mm UNION ALL SELECT model, 'f1' AS metric, f1 AS value FROM mm",
)
def metric_series(spark, sf_dir):
    long = _model_metrics(spark, sf_dir).unpivot(["model"], ["accuracy", "precision", "recall", "f1"], "metric", "value")
    return G.rounded(long.where(F.col("metric").isin("accuracy", "f1")))


@query(
    "picked_model",
    SCORED
    + f"\n, mm AS ({_metrics_sql('test_scores')})\n"
    f"SELECT * FROM mm WHERE model = {S.q(MODELS[-1])}",
)
def picked_model(spark, sf_dir):
    """All metrics of one model picked by name."""
    return G.rounded(E.select_model(_model_metrics(spark, sf_dir), MODELS[-1]))


@query(
    "best_model",
    SCORED
    + f"\n, mm AS ({_metrics_sql('test_scores')}), mo AS (SELECT DISTINCT model, model_order FROM scores)\n"
    "SELECT mm.model, mm.accuracy FROM mm JOIN mo ON mm.model = mo.model ORDER BY accuracy DESC, model_order LIMIT 1",
)
def best_model(spark, sf_dir):
    order = spark.createDataFrame([(m, i) for i, m in enumerate(MODELS)], "model string, model_order int")
    m = G.rounded(_model_metrics(spark, sf_dir)).join(F.broadcast(order), "model")
    return E.best_by(m, "accuracy", "model_order", ["model", "accuracy"])


@query(
    "confusion_matrix",
    SCORED
    + f"""
, lab AS (SELECT DISTINCT model, l.label FROM test_scores, (VALUES (0), (1)) l(label)),
cnt AS (SELECT model, outcome AS label, sum(CASE WHEN {_label_sql('p')} = 0 THEN 1 ELSE 0 END) AS pred_0,
               sum(CASE WHEN {_label_sql('p')} = 1 THEN 1 ELSE 0 END) AS pred_1 FROM test_scores GROUP BY 1, 2)
SELECT lab.model, lab.label, CAST(coalesce(pred_0, 0) AS BIGINT) AS pred_0, CAST(coalesce(pred_1, 0) AS BIGINT) AS pred_1
FROM lab LEFT JOIN cnt ON lab.model = cnt.model AND lab.label = cnt.label""",
)
def confusion_matrix(spark, sf_dir):
    s = E.with_prediction(_scores(spark, sf_dir, test_only=True))
    return E.confusion_matrix(s, ["model"], C.LABEL, "pred")


ROC_CTE = """agg AS (SELECT model, p, sum(outcome) AS pos, sum(1 - outcome) AS neg FROM test_scores GROUP BY model, p),
cum AS (SELECT model, p, pos, neg,
               sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS cp, sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS cn,
               sum(pos) OVER (PARTITION BY model) AS tp_all, sum(neg) OVER (PARTITION BY model) AS tn_all FROM agg)"""


@query(
    "roc_curve",
    SCORED
    + ",\n"
    + ROC_CTE
    + """
SELECT model, p AS threshold, round(CAST(cn AS DOUBLE) / CAST(tn_all AS DOUBLE), 6) AS fpr,
       round(CAST(cp AS DOUBLE) / CAST(tp_all AS DOUBLE), 6) AS tpr FROM cum
UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr FROM agg""",
)
def roc_curve(spark, sf_dir):
    s = _scores(spark, sf_dir, test_only=True)
    pts = E.roc_curve(s, ["model"], C.LABEL, "p").select("model", "threshold", "fpr", "tpr")
    return G.rounded(pts, skip=("threshold",))


@query(
    "auc_exact",
    SCORED
    + ",\n"
    + ROC_CTE
    + """
SELECT model, round(sum(CAST(neg AS DOUBLE) * (CAST(cp AS DOUBLE) - CAST(pos AS DOUBLE) / 2.0)) /
                    (max(CAST(tp_all AS DOUBLE)) * max(CAST(tn_all AS DOUBLE))), 6) AS auc
FROM cum GROUP BY model""",
)
def auc_exact(spark, sf_dir):
    return G.rounded(E.auc(_scores(spark, sf_dir, test_only=True), ["model"], C.LABEL, "p"))


@query(
    "prob_histogram",
    SCORED
    + f"\nSELECT CAST(least(floor(p * {S.d(C.PROB_BINS)}), {C.PROB_BINS - 1}) AS INTEGER) AS bin, outcome, count(*) AS n "
    "FROM test_scores WHERE model = 'full' GROUP BY 1, 2",
)
def prob_histogram(spark, sf_dir):
    s = _scores(spark, sf_dir, test_only=True).where(F.col("model") == "full")
    return ST.fixed_bins(s, "p", C.PROB_BINS, by=[C.LABEL])


@query(
    "range_histogram",
    SCORED
    + f"""
, rng AS (SELECT min(p) AS lo, max(p) AS hi FROM test_scores WHERE model = 'full'),
b AS (SELECT CAST(least(coalesce(floor(((p - lo) / (hi - lo)) * {S.d(C.RANGE_BINS)}), 0), {C.RANGE_BINS - 1}) AS INTEGER) AS bin,
             outcome, lo, hi FROM test_scores, rng WHERE model = 'full')
SELECT bin, round(lo + CAST(bin AS DOUBLE) * ((hi - lo) / {S.d(C.RANGE_BINS)}), 6) AS lo,
       round(lo + CAST(bin + 1 AS DOUBLE) * ((hi - lo) / {S.d(C.RANGE_BINS)}), 6) AS hi, outcome, count(*) AS n
FROM b GROUP BY bin, lo, hi, outcome""",
)
def range_histogram(spark, sf_dir):
    s = _scores(spark, sf_dir, test_only=True).where(F.col("model") == "full")
    return G.rounded(ST.range_bins(s, "p", C.RANGE_BINS, by=[C.LABEL]))


@query(
    "kde_curve",
    SCORED
    + f"""
, st AS (SELECT outcome, count(p) AS n, stddev_samp(p) AS sd, min(p) AS lo, max(p) AS hi FROM test_scores WHERE model = 'full' GROUP BY outcome),
bw AS (SELECT *, pow(CAST(n AS DOUBLE), {S.d(-0.2)}) * sd AS h FROM st),
dist AS (SELECT outcome, p, count(*) AS w FROM test_scores WHERE model = 'full' GROUP BY outcome, p),
grid AS (SELECT bw.*, g FROM bw, range(0, {C.KDE_GRID}) t(g))
SELECT grid.outcome, CAST(g AS INTEGER) AS grid_index,
       round(lo + CAST(g AS DOUBLE) * ((hi - lo) / {S.d(C.KDE_GRID - 1)}), 6) AS x,
       round(sum(CAST(w AS DOUBLE) * exp({S.d(-0.5)} * pow((lo + CAST(g AS DOUBLE) * ((hi - lo) / {S.d(C.KDE_GRID - 1)}) - p) / h, 2)))
             / (CAST(n AS DOUBLE) * h * {S.d(2.5066282746310002)}), 6) AS density
FROM grid JOIN dist ON grid.outcome = dist.outcome GROUP BY grid.outcome, g, lo, hi, n, h""",
)
def kde_curve(spark, sf_dir):
    s = _scores(spark, sf_dir, test_only=True).where(F.col("model") == "full")
    return G.rounded(ST.kde_curve(s, "p", C.LABEL, C.KDE_GRID))


def _importance_sql() -> str:
    sds = ", ".join(
        f"stddev_pop((CAST({f} AS DOUBLE) - {S.d(c)}) / {S.d(s)}) AS sd_{t}" for t, (f, c, s) in C.SCORE_TERMS.items()
    )
    rows = []
    for name, _, weights in C.SCORE_MODELS:
        for t, (f, _c, _s) in C.SCORE_TERMS.items():
            rows.append(f"SELECT {S.q(name)} AS model, {S.q(f)} AS feature, abs({S.d(weights.get(t, 0.0))}) * sd_{t} AS raw FROM sds")
    return (
        S.with_cohort(f"sds AS (SELECT {sds} FROM cohort)", "r AS (" + " UNION ALL ".join(rows) + ")")
        + "\nSELECT model, feature, round(CASE WHEN sum(raw) OVER (PARTITION BY model) <> 0 "
        "THEN raw / sum(raw) OVER (PARTITION BY model) ELSE raw END, 6) AS importance FROM r"
    )


@query("importance_normalised", _importance_sql())
def importance_normalised(spark, sf_dir):
    """|weight| x spread of the standardised term on the data, summing to 1 per model."""
    c = T.cohort(spark, sf_dir)
    terms = list(C.SCORE_TERMS.items())
    wide = c.agg(*[F.stddev_pop(standardised(f, ce, sc)).alias(f"sd_{t}") for t, (f, ce, sc) in terms])
    entries = [
        F.struct(F.lit(name).alias("model"), F.lit(f).alias("feature"), (F.lit(abs(float(w.get(t, 0.0)))) * F.col(f"sd_{t}")).alias("raw"))
        for name, _, w in C.SCORE_MODELS
        for t, (f, _c, _s) in terms
    ]
    long = wide.select(F.inline(F.array(*entries)))
    return G.rounded(E.normalise(long, ["model"], "raw", "importance").select("model", "feature", "importance"))


# ------------------------------------------------------------ splits, folds
@query(
    "split_counts",
    S.with_cohort()
    + f"\nSELECT CASE WHEN h_split % {C.TEST_MODULUS} = 0 THEN 'test' ELSE 'train' END AS part, outcome, count(*) AS n "
    "FROM cohort GROUP BY 1, 2",
)
def split_counts(spark, sf_dir):
    return G.count_by(P.hash_split(T.cohort(spark, sf_dir)), "part", C.LABEL)


RANKED_CTE = (
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY h_split, "
    f"{S.KEY_LIST}, {S.FEATURE_LIST}) AS rnk, count(*) OVER (PARTITION BY outcome) AS cls_n FROM cohort)"
)
TEST_SHARE = Fraction(1, C.TEST_MODULUS)


def _split_sql(n: str, ranks: str = "") -> str:
    return f"""
SELECT CASE WHEN rnk * {TEST_SHARE.denominator} <= {n} * {TEST_SHARE.numerator} + {TEST_SHARE.denominator - 1}
            THEN 'test' ELSE 'train' END AS part,
       outcome, count(*) AS n, {ranks}min(h_split) AS min_hash, max(h_split) AS max_hash, sum(h_split % 1000) AS hash_sum FROM ranked GROUP BY 1, 2"""


def _split_rows(parts, *ranks):
    return parts.groupBy("part", C.LABEL).agg(
        F.count(F.lit(1)).alias("n"), *ranks, F.min("h_split").alias("min_hash"), F.max("h_split").alias("max_hash"), F.sum(F.col("h_split") % 1000).alias("hash_sum")
    )


@query("stratified_split", S.with_cohort(RANKED_CTE) + _split_sql("cls_n", "min(rnk) AS min_rank, max(rnk) AS max_rank, "))
def stratified_split(spark, sf_dir):
    """A fifth of each class (rounded up), by every row's rank in it."""
    ranked = P.stratified_split(T.cohort(spark, sf_dir), TEST_SHARE)
    return _split_rows(ranked, F.min("rank").cast("bigint").alias("min_rank"), F.max("rank").cast("bigint").alias("max_rank"))


@query(
    "exact_split",
    S.with_cohort(f"ranked AS (SELECT *, row_number() OVER (ORDER BY h_split, {S.KEY_LIST}, {S.FEATURE_LIST}) AS rnk, count(*) OVER () AS n FROM cohort)")
    + _split_sql("ranked.n"),
)
def exact_split(spark, sf_dir):
    """Exactly a fifth of all rows (rounded up), whatever their class."""
    return _split_rows(P.exact_split(T.cohort(spark, sf_dir), TEST_SHARE))


@query(
    "fold_assignment",
    S.with_cohort(RANKED_CTE)
    + f"\nSELECT CAST(rnk % {C.N_FOLDS} AS INTEGER) AS fold, outcome, count(*) AS n FROM ranked GROUP BY 1, 2",
)
def fold_assignment(spark, sf_dir):
    return G.count_by(P.fold_column(T.cohort(spark, sf_dir), C.N_FOLDS), "fold", C.LABEL)


@query(
    "cv_confidence",
    S.with_cohort(
        RANKED_CTE,
        "fs AS ("
        + " UNION ALL ".join(
            f"SELECT {S.q(m)} AS model, CAST(rnk % {C.N_FOLDS} AS INTEGER) AS fold, outcome, {S.score_sql(m)} AS p FROM ranked"
            for m in MODELS
        )
        + ")",
        f"acc AS (SELECT model, fold, avg(CASE WHEN {_label_sql('p')} = outcome THEN 1.0 ELSE 0.0 END) AS a FROM fs GROUP BY 1, 2)",
    )
    + f"\nSELECT model, round(avg(a), 6) AS mean_acc, round(stddev_pop(a), 6) AS std_acc, "
    f"round({S.d(1.96)} * stddev_pop(a) / sqrt(CAST(count(a) AS DOUBLE)), 6) AS ci95 FROM acc GROUP BY model",
)
def cv_confidence(spark, sf_dir):
    folded = P.fold_column(T.cohort(spark, sf_dir), C.N_FOLDS)
    s = E.with_prediction(E.fixed_scores_long(folded, ["fold", C.LABEL]))
    acc = s.groupBy("model", "fold").agg(
        F.avg(F.when(F.col("pred") == F.col(C.LABEL), F.lit(1.0)).otherwise(F.lit(0.0))).alias("a")
    )
    return G.rounded(E.cv_summary(acc, ["model"], "a"))


@query(
    "soft_vote_combine",
    S.with_cohort(
        "sv AS (SELECT outcome, ("
        + " + ".join(S.score_sql(m) for m in MODELS)
        + f") / {S.d(len(MODELS))} AS p FROM cohort WHERE h_split % {C.TEST_MODULUS} = 0)"
    )
    + "\n"
    + _metrics_sql("sv", by=""),
)
def soft_vote_combine(spark, sf_dir):
    c = T.cohort(spark, sf_dir).where(is_test("h_split"))
    mean = sum((fixed_score(m) for m in MODELS[1:]), fixed_score(MODELS[0])) / F.lit(float(len(MODELS)))
    voted = c.select(C.LABEL, predicted_label(mean).alias("pred"))
    return G.rounded(E.binary_metrics(voted, [], C.LABEL, "pred"))

