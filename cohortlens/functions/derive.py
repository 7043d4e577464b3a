"""Pure Column expressions: hashing, scores, tiers, zones, z-scores, rules.

Every function returns a ``Column`` so it stays inside whole-stage codegen;
none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def dbl(x) -> Column:
    """A double column or literal (never DECIMAL: see the casting trap)."""
    if isinstance(x, Column):
        return x.cast("double")
    if isinstance(x, str):
        return F.col(x).cast("double")
    return F.lit(float(x))


def row_hash(tag: str, keys: Sequence[str] = C.KEYS) -> Column:
    """Engine-independent 32-bit hash of the row key, as bigint in [0, 2**32).

    First eight hex digits of md5 over ``tag|k1|k2|...`` (integer keys only).
    """
    key = F.concat_ws("|", F.lit(tag), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def standardised(feature: str, centre: float, scale: float) -> Column:
    return (dbl(feature) - dbl(centre)) / dbl(scale)


def logit_of(intercept: float, weights: dict[str, float]) -> Column:
    expr = dbl(intercept)
    for term, w in weights.items():
        feature, centre, scale = C.SCORE_TERMS[term]
        expr = expr + dbl(w) * standardised(feature, centre, scale)
    return expr


def sigmoid(logit: Column) -> Column:
    return dbl(1.0) / (dbl(1.0) + F.exp(-logit))


def stable_round(c: Column, digits: int = 6) -> Column:
    """Round the value's 9-place decimal rendering, half away from zero.

    Summation order moves the last bits of a double; when the exact value is
    a tie at ``digits`` places (common for means of 2-decimal data) rounding
    the binary double would go either way.  The decimal rendering absorbs
    that noise, so every engine lands on the same side.  A value beyond the
    decimal's range (1e29) has no digits behind the point to round and is
    kept as it is; infinities and NaN become NULL.
    """
    x = c.cast("double")
    wide = (F.abs(x) >= dbl(1e28)) & (F.abs(x) < dbl(float("inf")))
    return F.when(wide, x).otherwise(F.round(x.try_cast("decimal(38,9)"), digits).cast("double"))


def fixed_score(model: str, digits: int | None = C.SCORE_DIGITS) -> Column:
    """Probability of one fixed-coefficient model, rounded to ``digits``.

    The rounding is part of the definition: mathematically equal logits
    computed along different paths must tie in every engine.
    """
    for name, intercept, weights in C.SCORE_MODELS:
        if name == model:
            p = sigmoid(logit_of(intercept, weights))
            return stable_round(p, digits) if digits is not None else p
    raise KeyError(model)


def planted_outcome(keys: Sequence[str] = C.KEYS) -> Column:
    """Outcome drawn from the `full` model with a second hash as the uniform."""
    _, intercept, weights = next(m for m in C.SCORE_MODELS if m[0] == C.PLANTED_MODEL)
    u = row_hash("y", keys).cast("double") / dbl(C.HASH_SPAN)
    return F.when(u < sigmoid(logit_of(intercept, weights)), 1).otherwise(0)


def is_test(h_split: Column | str = "h_split") -> Column:
    h = F.col(h_split) if isinstance(h_split, str) else h_split
    return F.pmod(h, F.lit(C.TEST_MODULUS)) == 0


# ---------------------------------------------------------------- decisions
def predicted_label(p: Column) -> Column:
    """1 when probability*100 >= 50 (inclusive: Spark's own classifiers use >)."""
    return F.when(p * dbl(100.0) >= dbl(C.DECISION_PCT), 1).otherwise(0)


def prediction_text(p: Column) -> Column:
    return F.when(p * dbl(100.0) >= dbl(C.DECISION_PCT), F.lit(C.POSITIVE)).otherwise(F.lit(C.NEGATIVE))


def risk_tier(p: Column) -> Column:
    pct = p * dbl(100.0)
    return (
        F.when(pct >= dbl(C.TIER_HIGH_PCT), F.lit(C.TIER_HIGH))
        .when(pct >= dbl(C.TIER_MODERATE_PCT), F.lit(C.TIER_MODERATE))
        .otherwise(F.lit(C.TIER_LOW))
    )


def risk_message(p: Column) -> Column:
    pct = p * dbl(100.0)
    return (
        F.when(pct >= dbl(C.TIER_HIGH_PCT), F.lit(C.MESSAGE_HIGH))
        .when(pct >= dbl(C.TIER_MODERATE_PCT), F.lit(C.MESSAGE_MODERATE))
        .otherwise(F.lit(C.MESSAGE_LOW))
    )


def risk_zone(p: Column) -> Column:
    return (
        F.when(p < dbl(C.ZONE_LOW_BELOW), F.lit(C.ZONE_LOW))
        .when(p < dbl(C.ZONE_MODERATE_BELOW), F.lit(C.ZONE_MODERATE))
        .otherwise(F.lit(C.ZONE_HIGH))
    )


# ---------------------------------------------------------------- z-scores
def round_half_even(x: Column, digits: int) -> Column:
    """Half-to-even rounding of the value's 8-place decimal rendering.

    Rounding the binary double directly differs between engines at ties
    such as 0.015; both engines agree on the decimal form.
    """
    return F.bround(x.cast("decimal(18,8)"), digits).cast("double")


def z_score(x: Column, mean: Column, std: Column, digits: int = 2) -> Column:
    """Rounded z; NULL when the std is 0 (e.g. a truncated statistic)."""
    return round_half_even(F.try_divide(dbl(x) - dbl(mean), dbl(std)), digits)


def z_interpretation(z: Column) -> Column:
    return (
        F.when(z >= dbl(1.0), F.lit(C.Z_HIGH))
        .when(z >= dbl(0.5), F.lit(C.Z_SLIGHT_HIGH))
        .when(z <= dbl(-1.0), F.lit(C.Z_LOW))
        .when(z <= dbl(-0.5), F.lit(C.Z_SLIGHT_LOW))
        .otherwise(F.lit(C.Z_NORMAL))
    )


def z_intensity(z: Column) -> Column:
    return F.least(F.abs(z) / dbl(C.Z_INTENSITY_SPAN), dbl(1.0))


def z_direction(z: Column) -> Column:
    return F.when(z > 0, F.lit("above")).when(z < 0, F.lit("below")).otherwise(F.lit("at"))


# ---------------------------------------------------------------- rules
def _compare(c: Column, op: str, v: float) -> Column:
    return {">": c > dbl(v), "<": c < dbl(v), ">=": c >= dbl(v), "<=": c <= dbl(v)}[op]


def rule_hit(feature: str, op: str, threshold: float) -> Column:
    return F.coalesce(_compare(dbl(feature), op, threshold), F.lit(False))


def alert_names(rules: Iterable[tuple[str, str, str, float]] = C.ALERT_RULES) -> Column:
    """Array of the names of the rules a row triggers (possibly empty)."""
    hits = [F.when(rule_hit(f, op, t), F.lit(name)) for name, f, op, t in rules]
    return F.array_compact(F.array(*hits))


def violation_reason(bounds: Iterable[tuple[str, float, float]] = C.BOUNDS) -> Column:
    """Name of the first feature outside its bounds (missing counts as outside)."""
    checks = []
    for feature, lo, hi in bounds:
        v = dbl(feature)
        checks.append(F.when(v.isNull() | (v < dbl(lo)) | (v > dbl(hi)), F.lit(feature)))
    return F.coalesce(*checks)


def validation_status(reason: Column) -> Column:
    return F.when(reason.isNull(), F.lit(C.VALID)).otherwise(F.lit(C.REJECTED))
