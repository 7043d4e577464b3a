"""Exact evaluation of binary scores: counts, metrics, confusion, ROC, AUC.

Everything is grouped by a model column, so N models are evaluated in one
pass over a long ``(model, label, score)`` table.  ROC needs a running sum
over the distinct scores of each model; it uses the bucketed running sums
of ``ordered`` so no task holds a whole model's scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import materialize
from ..functions.derive import dbl, fixed_score, predicted_label
from .joins import broadcast_if_bounded
from .ordered import bucket_count, bucket_splits, bucketize, running_totals


def fixed_scores_long(df: DataFrame, keep: Sequence[str], models=C.SCORE_MODELS) -> DataFrame:
    """One row per (row, fixed model): ``keep..., model, model_order, p``."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.lit(i).alias("model_order"), fixed_score(name).alias("p"))
            for i, (name, _, _) in enumerate(models)
        ]
    )
    return df.select(*keep, F.inline(entries))


def with_prediction(df: DataFrame, score: str = "p", alias: str = "pred") -> DataFrame:
    return df.withColumn(alias, predicted_label(F.col(score)))


def _is(c: str, v: int) -> Column:
    return F.when(F.col(c) == v, 1).otherwise(0)


def confusion_counts(df: DataFrame, by: Sequence[str], label: str, pred: str) -> DataFrame:
    both = lambda a, b: F.sum(_is(label, a) * _is(pred, b))
    return df.groupBy(*by).agg(
        both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(0, 0).alias("tn")
    )


def binary_metrics(df: DataFrame, by: Sequence[str], label: str, pred: str, scale: float = 100.0) -> DataFrame:
    """accuracy, precision, recall, F1 (zero_division = 0), times ``scale``."""
    c = confusion_counts(df, by, label, pred)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    zero = lambda e: F.coalesce(e, dbl(0.0)) * dbl(scale)
    return c.select(
        *by,
        zero(F.try_divide(tp + tn, tp + fp + fn + tn)).alias("accuracy"),
        zero(F.try_divide(tp, tp + fp)).alias("precision"),
        zero(F.try_divide(tp, tp + fn)).alias("recall"),
        zero(F.try_divide(dbl(2.0) * tp, dbl(2.0) * tp + fp + fn)).alias("f1"),
    )


def confusion_matrix(df: DataFrame, by: Sequence[str], label: str, pred: str, labels=(0, 1)) -> DataFrame:
    """One row per (group, true label) with a count per predicted label; absent cells are 0."""
    # one row per group with every cell, then a row per true label: one pass over the rows
    cells = [F.sum(_is(label, t) * _is(pred, v)).cast("bigint").alias(f"_{t}_{v}") for t in labels for v in labels]
    entries = [F.struct(F.lit(t).alias("label"), *[F.col(f"_{t}_{v}").alias(f"pred_{v}") for v in labels]) for t in labels]
    return df.groupBy(*by).agg(*cells).select(*by, F.inline(F.array(*entries)))


def score_counts(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score (the ROC's support)."""
    return df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(_is(label, 1)).alias("pos"), F.sum(_is(label, 0)).alias("neg")
    )


def roc_curve(df: DataFrame, by: Sequence[str], label: str, score: str, origin: bool = True) -> DataFrame:
    """(group, threshold, fpr, tpr, pos, neg, cum_pos, cum_neg) per distinct score, descending.

    ``origin`` adds the (0, 0) point with an infinite threshold.
    """
    by = list(by)
    # the windows below run over distinct scores: cut buckets on those, and
    # read the (aggregated) input once for the passes that follow
    counts = materialize(score_counts(df, by, label, score))
    n = counts.count()
    splits = bucket_splits(counts, ["threshold"], bucket_count(n))
    staged = bucketize(counts, ["threshold"], ["_b"], splits)
    cum = running_totals(staged, by, "_b", [F.col("threshold").desc()], ["pos", "neg"], descending=True)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pts = cum.join(broadcast_if_bounded(totals, 100_000), by).select(
        *by,
        "threshold",
        F.try_divide(F.col("cum_neg").cast("double"), F.col("_N").cast("double")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("_P").cast("double")).alias("tpr"),
        "pos",
        "neg",
        "cum_pos",
        "cum_neg",
        "_P",
        "_N",
    )
    if origin:
        zero = totals.select(
            *by,
            F.lit(float("inf")).alias("threshold"),
            dbl(0.0).alias("fpr"),
            dbl(0.0).alias("tpr"),
            F.lit(0).cast("bigint").alias("pos"),
            F.lit(0).cast("bigint").alias("neg"),
            F.lit(0).cast("bigint").alias("cum_pos"),
            F.lit(0).cast("bigint").alias("cum_neg"),
            "_P",
            "_N",
        )
        pts = pts.unionByName(zero)
    return pts


def auc(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Exact area under the ROC (trapezoid rule = rank-sum with averaged ties).

    Each distinct score adds neg/N * (cum_pos - pos/2)/P: the trapezoid
    between it and the previous point, without any ``lag``.
    """
    pts = roc_curve(df, by, label, score, origin=False)
    piece = F.col("neg").cast("double") * (F.col("cum_pos").cast("double") - F.col("pos").cast("double") / dbl(2.0))
    return pts.groupBy(*by).agg(
        F.try_divide(F.sum(piece), F.first("_P").cast("double") * F.first("_N").cast("double")).alias("auc")
    )


def best_by(df: DataFrame, metric: str, tie_order: str, cols: Sequence[str]) -> DataFrame:
    """Arg-max of ``metric``; ties go to the earliest ``tie_order`` (top-1, no full sort)."""
    return df.orderBy(F.col(metric).desc(), F.col(tie_order).asc()).select(*cols).limit(1)


def cv_summary(fold_metric: DataFrame, by: Sequence[str], metric: str, z: float = 1.96) -> DataFrame:
    """mean, population std and the normal 95 % half-width over folds."""
    m = F.col(metric).cast("double")
    return fold_metric.groupBy(*by).agg(
        F.avg(m).alias("mean_acc"),
        F.stddev_pop(m).alias("std_acc"),
        (dbl(z) * F.stddev_pop(m) / F.sqrt(F.count(m).cast("double"))).alias("ci95"),
    )


def normalise(df: DataFrame, by: Sequence[str], value: str, alias: str) -> DataFrame:
    """``value / sum(value)`` within each group (left unchanged when the sum is 0)."""
    total = F.sum(F.col(value)).over(Window.partitionBy(*by))
    return df.withColumn(alias, F.when(total != 0, F.col(value) / total).otherwise(F.col(value)))


def select_model(metrics: DataFrame, name: str, model_col: str = "model") -> DataFrame:
    """One model's rows of a metrics table (empty when the name is unknown)."""
    return metrics.where(F.col(model_col) == F.lit(name))
