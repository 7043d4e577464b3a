"""Catalogue: fitted models.

Training data is prepared once per call: the cohort (a three-way join) is
written as a reliable checkpoint in the shared folder named by
``spark.checkpoint.dir``, so iterative fits never recompute the join and a
lost executor re-reads the checkpoint instead of the whole lineage.  Models
that are fitted several times over (hold-out bake-offs, cross-validations,
ensembles) go through ``crossfit``: every fold of a model, and every boosted
ensemble, is optimised in the same passes.  A query's result is written before
it is returned, and all it kept in memory is released.

Logistic regression has one optimum, so its query returns the score
equations, whose right side SQL can state; ``fit_facts`` and ``cv_facts`` do
the like for the other models.
"""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.derive import is_test
from ..operators import boosting, forest
from ..operators import evaluate as E
from ..operators import grouping as G
from ..operators import models as M
from ..operators.crossfit import Fitted, Logistic, Neighbours, SupportVectors, crossfit
from ..operators.prep import fold_column, one_hot_stages, with_row_id
from ..session import ensure_checkpoint_dir, materialize, shuffles_freed
from ..sources import tables as T
from . import oracle_sql as S
from .registry import query

FEATURES = C.FEATURES
LABEL_COL = "label"

#: Settings by model name.
MODELS = {
    "logistic_regression": Logistic(),
    "random_forest": forest.Spec(200),
    "gradient_boosting": boosting.Spec("gradient_boosting", "gradient", 150, 0.05, 3),
    "xgboost_like": boosting.Spec("xgboost_like", "newton", 100, 0.3, 6),
    "rbf_svm": SupportVectors(),
    "knn": Neighbours(5),
    "knn15": Neighbours(15),
}
#: Members of the two ensembles.
ENSEMBLES = {
    "plain": {"logistic_regression": MODELS["logistic_regression"], "random_forest": forest.Spec(150), "gradient_boosting": MODELS["gradient_boosting"]},
    "tuned": {
        "random_forest": forest.Spec(200, 5),
        "gradient_boosting": boosting.Spec("gradient_boosting", "gradient", 200, 0.05, 4),
        "xgboost_like": boosting.Spec("xgboost_like", "newton", 200, 0.05, 4),
    },
}


class Kept(list):
    """Frames kept in memory until the block ends."""

    def __call__(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.append(df)
        return df

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        for df in self:
            df.unpersist()


def fitted(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir, keep)``; its result is written, then what it kept is released."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            with shuffles_freed(spark), Kept() as keep:
                return materialize(fn(spark, sf_dir, keep))

        return query(name, sql)(run)

    return register


def prepared(spark, sf_dir: str, keep: Kept, folds: bool = False, more: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """Keys, features, label, hash split and fold: checkpointed, then kept.

    Without ``folds`` the test rows are fold 0 and all others fold 1.  Row
    ids depend on the rows alone; they take a sort of all rows, and ``ids``
    leaves them and the keys out where no fit reads them.
    """
    ensure_checkpoint_dir(spark)
    c = T.cohort(spark, sf_dir)
    c = c.select(*C.KEYS, *FEATURES, *more, C.LABEL, "h_split")
    c = fold_column(c, C.N_FOLDS) if folds else c.withColumn("fold", F.when(is_test("h_split"), 0).otherwise(1))
    data = c.withColumn(LABEL_COL, F.col(C.LABEL).cast("double")).drop(C.LABEL)
    if not ids:
        return keep(materialize(data.drop(*C.KEYS)))
    return keep(with_row_id(data, [*C.KEYS, *FEATURES]))


def split(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    return data.where(~is_test("h_split")), data.where(is_test("h_split"))


def classifier(n_train: int) -> Pipeline:
    """Scaler + assembler (fitted on the training rows) + logistic regression."""
    return Pipeline(stages=M.feature_stages(FEATURES) + [M.logistic(n_train, labelCol=LABEL_COL)])


def held_out(data: DataFrame, names) -> Fitted:
    """The named models, fitted on the training rows; scores of the test rows."""
    return crossfit(data, FEATURES, LABEL_COL, names if isinstance(names, dict) else {n: MODELS[n] for n in names}, [0])


def cross_validated(data: DataFrame, models: dict) -> Fitted:
    return crossfit(data, FEATURES, LABEL_COL, models, range(C.N_FOLDS))


METRIC_COLS = ["accuracy", "precision", "recall", "f1"]


def metrics_with_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """accuracy, precision, recall, F1 (fractions) and exact AUC per group."""
    keys = list(by) or ["_all"]
    if not by:
        scored = scored.withColumn("_all", F.lit(0))
    m = E.binary_metrics(scored, keys, LABEL_COL, M.PRED, scale=1.0)
    a = E.auc(scored.withColumn(LABEL_COL, F.col(LABEL_COL).cast("int")), keys, LABEL_COL, M.SCORE)
    out = m.join(a, keys)
    return out if by else out.drop("_all")


def _single(spark, sf_dir, keep, name) -> DataFrame:
    scores = held_out(prepared(spark, sf_dir, keep), [name]).scores
    return G.rounded(metrics_with_auc(scores, ["model"]))


def _score_equations_sql() -> str:
    train = f"FROM cohort WHERE h_split % {C.TEST_MODULUS} <> 0"
    rows = [f"SELECT {S.q(t)} AS term, count(*) AS n_train, round(avg(CAST(outcome AS DOUBLE)), 6) AS base_rate, CAST(0 AS DOUBLE) AS residual {train}" for t in ["intercept", *FEATURES]]
    return S.with_cohort() + "\n" + "\nUNION ALL ".join(rows)


@fitted("logreg_fit", _score_equations_sql())
def logreg_fit(spark, sf_dir, keep):
    """The optimum's score equations: at the fitted weights every residual is 0 (to 4 places).

    For a feature the residual is the training mean of ``z * (p - y)`` plus
    the penalty's ``w / n``; for the intercept the mean of ``p - y``.
    """
    data = prepared(spark, sf_dir, keep, ids=False)
    train, _ = split(data)
    n = train.count()
    model = classifier(n).fit(train)
    weights = M.last_stage(model).coefficients.toArray()
    scored = M.positive_probability(model.transform(train))
    z, miss = vector_to_array("features"), F.col(M.SCORE) - F.col(LABEL_COL)
    wide = scored.agg(F.avg(LABEL_COL).alias("rate"), F.avg(miss).alias("r0"), *[F.avg(z[i] * miss).alias(f"r{i + 1}") for i in range(len(FEATURES))])
    penalty = [0.0, *[float(w) / n for w in weights]]
    rows = [F.struct(F.lit(t).alias("term"), F.lit(n).cast("long").alias("n_train"), F.col("rate").alias("base_rate"), (F.round(F.col(f"r{i}") + F.lit(penalty[i]), 4) + F.lit(0.0)).alias("residual")) for i, t in enumerate(["intercept", *FEATURES])]
    return G.rounded(wide.select(F.inline(F.array(*rows))))


@fitted("rf_fit")
def rf_fit(spark, sf_dir, keep):
    """200 trees without a depth limit."""
    return _single(spark, sf_dir, keep, "random_forest")


@fitted("gbt_fit")
def gbt_fit(spark, sf_dir, keep):
    return _single(spark, sf_dir, keep, "gradient_boosting")


@fitted("xgb_fit")
def xgb_fit(spark, sf_dir, keep):
    """Second-order boosting with 100 rounds of 0.3, depth 6."""
    return _single(spark, sf_dir, keep, "xgboost_like")


@fitted("rbf_svm_fit")
def rbf_svm_fit(spark, sf_dir, keep):
    """The exact dual solution with cross-fitted probabilities."""
    return _single(spark, sf_dir, keep, "rbf_svm")


def _vote(spark, sf_dir, keep, name) -> DataFrame:
    fitted = held_out(prepared(spark, sf_dir, keep), ENSEMBLES[name])
    return G.rounded(metrics_with_auc(fitted.vote(f"soft_vote_{name}", list(ENSEMBLES[name])), ["model"]))


@fitted("soft_vote")
def soft_vote(spark, sf_dir, keep):
    """Logistic regression, 150 full trees and boosting (150 rounds of 0.05, depth 3)."""
    return _vote(spark, sf_dir, keep, "plain")


@fitted("soft_vote_tuned")
def soft_vote_tuned(spark, sf_dir, keep):
    """200 trees of depth 5 and two boosted ensembles of 200 rounds of 0.05, depth 4."""
    return _vote(spark, sf_dir, keep, "tuned")


@fitted("soft_vote_cv")
def soft_vote_cv(spark, sf_dir, keep):
    """5-fold CV of the tuned ensemble: metrics by fold."""
    fitted = cross_validated(prepared(spark, sf_dir, keep, folds=True), ENSEMBLES["tuned"])
    return G.rounded(metrics_with_auc(fitted.vote("soft_vote_tuned", list(ENSEMBLES["tuned"])), ["fold"]))


CHARTED = ["logistic_regression", "random_forest", "rbf_svm", "knn15"]


def _charted(spark, sf_dir, keep) -> DataFrame:
    """Hold-out scores of the charted models, one row per (model, test row)."""
    scores = held_out(prepared(spark, sf_dir, keep), CHARTED).scores
    return materialize(scores.withColumn(LABEL_COL, F.col(LABEL_COL).cast("int")))


@fitted("fitted_roc")
def fitted_roc(spark, sf_dir, keep):
    pts = E.roc_curve(_charted(spark, sf_dir, keep), ["model"], LABEL_COL, M.SCORE).select("model", "threshold", "fpr", "tpr")
    return G.rounded(pts, skip=("threshold",))


@fitted("fitted_confusion")
def fitted_confusion(spark, sf_dir, keep):
    return E.confusion_matrix(_charted(spark, sf_dir, keep), ["model"], LABEL_COL, M.PRED)


@fitted("grouped_logreg")
def grouped_logreg(spark, sf_dir, keep):
    """Hold-out metrics of LR on the standardised features and the one-hot country."""
    data = prepared(spark, sf_dir, keep, more=(C.GROUP,), ids=False)
    train, test = split(data)
    scaler, assembler = M.feature_stages(FEATURES)
    inputs = [*assembler.getInputCols(), "_country_vec"]
    stages = [scaler, *one_hot_stages(C.GROUP, "_country_vec"), assembler.copy().setInputCols(inputs), M.logistic(train.count(), labelCol=LABEL_COL)]
    _, scored = M.fit_scored(Pipeline(stages=stages), train, test)
    return G.rounded(metrics_with_auc(scored.withColumn("model", F.lit("grouped_logreg")), ["model"]))


BAKEOFF = ["logistic_regression", "random_forest", "rbf_svm", "knn", "xgboost_like"]


@fitted("model_bakeoff")
def model_bakeoff(spark, sf_dir, keep):
    scores = held_out(prepared(spark, sf_dir, keep), BAKEOFF).scores
    order = spark.createDataFrame([(m, i) for i, m in enumerate(BAKEOFF)], "model string, model_order int")
    return G.rounded(metrics_with_auc(scores, ["model"])).join(F.broadcast(order), "model")


@fitted("cv_scores")
def cv_scores(spark, sf_dir, keep):
    """5-fold CV of logistic regression on the stratified fold column, metrics per fold."""
    fitted = cross_validated(prepared(spark, sf_dir, keep, folds=True), {"logistic_regression": Logistic()})
    return G.rounded(metrics_with_auc(fitted.scores, ["fold"]))


COMPARED = ["logistic_regression", "random_forest", "rbf_svm", "xgboost_like", "knn"]


@fitted("model_comparison")
def model_comparison(spark, sf_dir, keep):
    """Per-model mean and std (sample and population) of fold metrics."""
    scores = cross_validated(prepared(spark, sf_dir, keep, folds=True), {n: MODELS[n] for n in COMPARED}).scores
    per_fold = metrics_with_auc(scores, ["model", "fold"])
    aggs = []
    for m in [*METRIC_COLS, "auc"]:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.stddev_pop(m).alias(f"{m}_std_pop")]
    return G.rounded(per_fold.groupBy("model").agg(*aggs))


@fitted("scaling_ablation")
def scaling_ablation(spark, sf_dir, keep):
    """LR AUC on raw against standardised features (no internal standardisation)."""
    data = prepared(spark, sf_dir, keep, ids=False)
    train, test = split(data)
    n = train.count()
    out = []
    for variant, scaled in (("raw", False), ("scaled", True)):
        pipe = Pipeline(stages=M.feature_stages(FEATURES, scaled=scaled) + [M.logistic(n, labelCol=LABEL_COL, max_iter=100)])
        _, s = M.fit_scored(pipe, train, test)
        out.append(s.select(F.lit(variant).alias("variant"), LABEL_COL, M.SCORE, M.PRED))
    return G.rounded(E.auc(out[0].unionByName(out[1]).withColumn(LABEL_COL, F.col(LABEL_COL).cast("int")), ["variant"], LABEL_COL, M.SCORE))


def importance_rows(name: str, model) -> list[tuple[str, str, float]]:
    """Importance with the usual fallback chain: tree importances, |coefficients|, zeros."""
    last = M.last_stage(model)
    if isinstance(last, M.SoftVotingModel):  # a voting model speaks through its first member
        last = M.last_stage(last.fitted[0][1])
    if hasattr(last, "featureImportances"):
        raw = list(last.featureImportances.toArray())
    elif hasattr(last, "coefficients"):
        raw = [abs(float(v)) for v in last.coefficients.toArray()]
    else:
        raw = [0.0] * len(FEATURES)
    return [(name, f, float(v)) for f, v in zip(FEATURES, raw)]


def fitted_importance(model):
    """The same chain for models of ``crossfit``: impurity or gain, |weights|, zeros."""
    if isinstance(model, forest.Forest):
        return model.importance[0]
    if isinstance(model, list) and hasattr(model[0], "importance"):
        return model[0].importance()
    if isinstance(model, list) and hasattr(model[0], "weights"):
        return abs(model[0].weights[1:])
    return [0.0] * len(FEATURES)


@fitted("feature_importance")
def feature_importance(spark, sf_dir, keep):
    data = prepared(spark, sf_dir, keep)
    names = ("logistic_regression", "random_forest", "gradient_boosting")
    models = held_out(data, names).models
    models["soft_vote_tuned"] = held_out(data, {"first": ENSEMBLES["tuned"]["random_forest"]}).models["first"]  # a vote speaks through its first member
    rows = [(name, f, float(v)) for name, model in models.items() for f, v in zip(FEATURES, fitted_importance(model))]
    long = spark.createDataFrame(rows, "model string, feature string, raw double")
    out = E.normalise(long, ["model"], "raw", "importance").select("model", "feature", "importance")
    return G.rounded(out).orderBy("model", F.desc("importance"), "feature")


@fitted("coef_table")
def coef_table(spark, sf_dir, keep):
    """LR coefficients on standardised features (plus the intercept), largest first."""
    data = prepared(spark, sf_dir, keep, ids=False)
    train, _ = split(data)
    lr = M.last_stage(classifier(train.count()).fit(train))
    rows = [("intercept", float(lr.intercept))] + [(f, float(v)) for f, v in zip(FEATURES, lr.coefficients.toArray())]
    return G.rounded(spark.createDataFrame(rows, "term string, coefficient double")).orderBy(F.desc("coefficient"), "term")


@fitted("eval_by_split")
def eval_by_split(spark, sf_dir, keep):
    """Accuracy and AUC of the LR pipeline on train, test and all rows."""
    data = prepared(spark, sf_dir, keep, ids=False)
    train, _ = split(data)
    model = classifier(train.count()).fit(train)
    scored = M.positive_probability(model.transform(data)).withColumn(
        "part", F.when(is_test("h_split"), F.lit("test")).otherwise(F.lit("train"))
    )
    both = scored.select("part", LABEL_COL, M.SCORE, M.PRED).unionByName(
        scored.select(F.lit("all").alias("part"), LABEL_COL, M.SCORE, M.PRED)
    )
    return G.rounded(metrics_with_auc(both, ["part"]).select("part", "accuracy", "auc"))


# ------------------------------------------------------------ facts SQL can state
FACT_MODELS = ["logistic_regression", "random_forest", "gradient_boosting", "xgboost_like", "rbf_svm", "knn"]


def _fit_facts_sql() -> str:
    test, train = (f"h_split % {C.TEST_MODULUS} {op} 0" for op in ("=", "<>"))
    rows = []
    for m in [*FACT_MODELS, "soft_vote"]:
        rows += [(m, "rows_scored", "test_n"), (m, "positives", "test_pos"), (m, "cells", "test_n"), (m, "scores_outside", "0")]
    rows += [("random_forest", f, v) for f, v in (("impure_leaves", "0"), ("importance", "1"))]
    rows += [("xgboost_like", f, v) for f, v in (("first_tree_rows", "n"), ("first_tree_gradients", "n / 2.0 - pos"), ("first_tree_hessians", "n / 4.0"), ("importance", "1"), ("rounds", str(MODELS["xgboost_like"].rounds)), ("rises", "0"))]
    rows += [("gradient_boosting", f, v) for f, v in (("first_tree_rows", "n"), ("first_tree_gradients", "0"), ("first_tree_hessians", "pos * (1 - pos / CAST(n AS DOUBLE))"), ("importance", "1"), ("rounds", str(MODELS["gradient_boosting"].rounds)), ("rises", "0"))]
    rows += [("rbf_svm", f, v) for f, v in (("machines", "6"), ("violating", "0"), ("imbalance", "0"))]
    facts = "facts AS (SELECT " + ", ".join(
        [f"count(*) FILTER ({test}) AS test_n", f"coalesce(sum(outcome) FILTER ({test}), 0) AS test_pos", f"count(*) FILTER ({train}) AS n", f"coalesce(sum(outcome) FILTER ({train}), 0) AS pos"]
    ) + " FROM cohort)"
    return S.with_cohort(facts) + "\n" + "\nUNION ALL ".join(f"SELECT {S.q(m)} AS model, {S.q(f)} AS fact, round(CAST({v} AS DOUBLE), 6) AS value FROM facts" for m, f, v in rows)


def _score_facts(scores: DataFrame, by: list[str]) -> DataFrame:
    """Rows, positives, cells of the confusion matrix and scores outside [0, 1], long."""
    m = E.confusion_counts(scores, by, LABEL_COL, M.PRED)
    n = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(LABEL_COL).alias("positives"), F.sum(F.when(F.col(M.SCORE).between(0.0, 1.0), 0).otherwise(1)).alias("outside"))
    facts = {"rows_scored": F.col("rows"), "positives": F.col("positives"), "cells": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "scores_outside": F.col("outside")}
    entries = [F.struct(F.lit(k).alias("fact"), v.cast("double").alias("value")) for k, v in facts.items()]
    return n.join(m, by).select(*by, F.inline(F.array(*entries)))


@fitted("fit_facts", _fit_facts_sql())
def fit_facts(spark, sf_dir, keep):
    """What is true of the fitted models whatever the data, and what SQL can count.

    Each scores every test row once, with a probability.  A full tree's leaves
    are pure.  The first boosted tree's leaf sums of gradients, Hessians and
    rows are those of the whole training table, and no round raises the loss.
    The support-vector machines hold their optimality conditions.
    """
    fitted = held_out(prepared(spark, sf_dir, keep), FACT_MODELS)
    rows = []
    ((_, impure),) = forest.leaves(fitted.models["random_forest"])
    rows += [("random_forest", "impure_leaves", float(impure)), ("random_forest", "importance", float(sum(fitted.models["random_forest"].importance[0])))]
    for name in ("xgboost_like", "gradient_boosting"):
        (model,) = fitted.models[name]
        g, h, n = model.trees[0].leaf_sums()
        rises = sum(b > a for a, b in zip(model.losses, model.losses[1:]))
        rows += [(name, f, float(v) + 0.0) for f, v in (("first_tree_rows", n), ("first_tree_gradients", round(g, 6)), ("first_tree_hessians", h), ("importance", sum(model.importance())), ("rounds", len(model.trees)), ("rises", rises))]
    machines = fitted.models["rbf_svm"]
    rows += [("rbf_svm", "machines", float(len(machines))), ("rbf_svm", "violating", float(sum(m.gap > 1e-3 for m in machines))), ("rbf_svm", "imbalance", round(max(abs(m.balance) for m in machines), 6))]
    scores = fitted.scores.unionByName(fitted.vote("soft_vote", ["logistic_regression", "random_forest", "gradient_boosting"]))
    facts = _score_facts(scores, ["model"])
    return G.rounded(facts.unionByName(spark.createDataFrame(rows, "model string, fact string, value double")))


CV_FACT_MODELS = {
    "logistic_regression": Logistic(),
    "random_forest": forest.Spec(200, 5),
    "gradient_boosting": MODELS["gradient_boosting"],
    "xgboost_like": boosting.Spec("xgboost_like", "newton", 100, 0.3, 3),
}
CV_FACT_VOTE = ["random_forest", "gradient_boosting", "xgboost_like"]


def _cv_facts_sql() -> str:
    ranked = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY h_split, {S.KEY_LIST}, {S.FEATURE_LIST}) % {C.N_FOLDS} AS fold FROM cohort)"
    folds = f"folds AS (SELECT CAST(f AS INTEGER) AS fold, count(*) FILTER (fold = f) AS held, coalesce(sum(outcome) FILTER (fold = f), 0) AS held_pos, count(*) FILTER (fold <> f) AS n, coalesce(sum(outcome) FILTER (fold <> f), 0) AS pos FROM ranked, range({C.N_FOLDS}) r(f) GROUP BY f)"
    rows = []
    for m in [*CV_FACT_MODELS, "soft_vote"]:
        rows += [(m, "rows_scored", "held"), (m, "positives", "held_pos"), (m, "cells", "held"), (m, "scores_outside", "0")]
    rows += [("xgboost_like", f, v) for f, v in (("first_tree_rows", "n"), ("first_tree_gradients", "n / 2.0 - pos"), ("rises", "0"))]
    rows += [("gradient_boosting", f, v) for f, v in (("first_tree_rows", "n"), ("first_tree_hessians", "pos * (1 - pos / CAST(n AS DOUBLE))"), ("rises", "0"))]
    rows += [("logistic_regression", "base_rate", "pos / CAST(n AS DOUBLE)")]
    return S.with_cohort(ranked, folds) + "\n" + "\nUNION ALL ".join(f"SELECT {S.q(m)} AS model, fold, {S.q(f)} AS fact, round(CAST({v} AS DOUBLE), 6) AS value FROM folds" for m, f, v in rows)


@fitted("cv_facts", _cv_facts_sql())
def cv_facts(spark, sf_dir, keep):
    """The like by fold of a 5-fold cross-validation.

    For logistic regression the base rate is the mean fitted probability of
    the fold's training rows, which the optimum makes equal to it.
    """
    data = prepared(spark, sf_dir, keep, folds=True)
    fitted = cross_validated(data, CV_FACT_MODELS)
    rows = []
    for fold in range(C.N_FOLDS):
        for name in ("xgboost_like", "gradient_boosting"):
            model = fitted.models[name][fold]
            g, h, n = model.trees[0].leaf_sums()
            rises = sum(b > a for a, b in zip(model.losses, model.losses[1:]))
            rows += [(name, fold, "first_tree_rows", float(n)), (name, fold, "rises", float(rises))]
            rows.append((name, fold, "first_tree_gradients", float(g)) if name == "xgboost_like" else (name, fold, "first_tree_hessians", float(h)))
    rates = []
    for fold, model in enumerate(fitted.models["logistic_regression"]):
        margin = F.lit(float(model.weights[0]))
        for c, w, m, s in zip(FEATURES, model.weights[1:], model.mean, model.std):
            margin = margin + F.lit(float(w)) * (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s))
        rates.append(F.avg(F.when(F.col("fold") != fold, 1.0 / (1.0 + F.exp(-margin)))).alias(f"r{fold}"))
    means = data.agg(*rates).first()
    rows += [("logistic_regression", fold, "base_rate", float(means[fold])) for fold in range(C.N_FOLDS)]
    scores = fitted.scores.unionByName(fitted.vote("soft_vote", CV_FACT_VOTE))
    facts = _score_facts(scores, ["model", "fold"]).select("model", "fold", "fact", "value")
    return G.rounded(facts.unionByName(spark.createDataFrame(rows, "model string, fold int, fact string, value double")))
