"""Scoring-side operators: z-score profiles, alert rules, validation, report.

All of them are column expressions over every row plus one aggregation;
the norm and rule tables are fixed-size literals (broadcast, bounded by
construction).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C

from ..functions.derive import (
    alert_names,
    dbl,
    fixed_score,
    prediction_text,
    risk_message,
    risk_tier,
    rule_hit,
    validation_status,
    violation_reason,
    z_direction,
    z_intensity,
    z_interpretation,
    z_score,
)


def norm_table(spark, norms=C.NORMS, truncate: Sequence[str] = ()) -> DataFrame:
    """(feature, mean, std) literal; ``truncate`` lists features whose statistics
    are cut to integers first (the integer-feature convention)."""
    rows = [(f, float(int(m)) if f in truncate else m, float(int(s)) if f in truncate else s) for f, m, s in norms]
    return spark.createDataFrame(rows, "feature string, mean double, std double")


def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return df.select(*keep, F.inline(entries))


def z_long(df: DataFrame, norms: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, x, z, interpretation, intensity, direction) for every row and feature."""
    long = unpivot_features(df, features, keep)
    z = z_score(F.col("x"), F.col("mean"), F.col("std"))
    return (
        long.join(F.broadcast(norms), "feature")
        .withColumn("z", z)
        .select(*keep, "feature", "x", "z", z_interpretation(F.col("z")).alias("interpretation"), z_intensity(F.col("z")).alias("intensity"), z_direction(F.col("z")).alias("direction"))
    )


def zscore_profile(df: DataFrame, norms: DataFrame, features: Sequence[str] = C.FEATURES) -> DataFrame:
    return (
        z_long(df, norms, features)
        .groupBy("feature", "interpretation", "direction")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.abs(F.col("z"))).alias("max_abs_z"),
            F.avg("intensity").alias("avg_intensity"),
        )
    )


def rule_hits(df: DataFrame, rules=C.ALERT_RULES) -> DataFrame:
    """(rule, n): rows triggering each rule, conditional counts in one pass."""
    wide = df.agg(*[F.count(F.when(rule_hit(f, op, t), F.lit(1))).alias(f"r{i}") for i, (_, f, op, t) in enumerate(rules)])
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, (name, *_rest) in enumerate(rules)]))
    )


def validate(df: DataFrame, bounds=C.BOUNDS) -> DataFrame:
    """Adds ``reason`` (first violated bound, or ``none``) and ``status``."""
    reason = violation_reason(bounds)
    return df.withColumn("_reason", reason).select(
        "*",
        validation_status(F.col("_reason")).alias("status"),
        F.coalesce(F.col("_reason"), F.lit(C.NO_REASON)).alias("reason"),
    ).drop("_reason")


def report_rows(df: DataFrame, score: str, keep: Sequence[str]) -> DataFrame:
    """The report: inputs, probability in percent, prediction and message."""
    p = F.col(score)
    return df.select(
        *keep,
        F.round(p * dbl(100.0), 4).alias("probability_pct"),
        prediction_text(p).alias("prediction"),
        risk_message(p).alias("message"),
    )


def score_requests(requests: DataFrame, model=None, defaults: dict | None = None) -> DataFrame:
    """Score a table of requests the way a single request is scored, for all rows.

    Missing inputs take ``defaults`` (feature -> value); every row is checked
    against the bounds (``status``/``reason``), scored with a fitted
    ``pyspark.ml`` model (positive-class probability) or, without one, with
    the fixed ``full`` score, and gets prediction, tier, message and alerts.
    """
    filled = requests
    for f, v in (defaults or {}).items():
        filled = filled.withColumn(f, F.coalesce(F.col(f), F.lit(v)))
    checked = validate(filled)
    if model is None:
        scored = checked.withColumn("_p", fixed_score("full"))
    else:
        scored = model.transform(checked).withColumn("_p", vector_to_array(F.col("probability"))[1])
    keep = [c for c in requests.columns] + ["status", "reason"]
    return scored.select(
        *keep,
        F.round(F.col("_p") * dbl(100.0), 4).alias("probability_pct"),
        prediction_text(F.col("_p")).alias("prediction"),
        risk_tier(F.col("_p")).alias("tier"),
        risk_message(F.col("_p")).alias("message"),
        alert_names().alias("alerts"),
    )
