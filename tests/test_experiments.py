"""Fitted queries end to end on the smallest table, with small models where the full ones take long."""

from __future__ import annotations

import pytest

from cohortlens import constants as C
from cohortlens.operators import boosting, forest
from cohortlens.operators.crossfit import Logistic
from cohortlens.plans import experiments as X
from cohortlens.plans.catalogue import QUERIES
from paths import SF_SMALL

SMALL = {
    "logistic_regression": Logistic(),
    "random_forest": forest.Spec(8),
    "gradient_boosting": boosting.Spec("gradient_boosting", "gradient", 4, 0.1, 2),
    "xgboost_like": boosting.Spec("xgboost_like", "newton", 3, 0.3, 3),
}


@pytest.mark.parametrize("name", ["cv_scores", "grouped_logreg", "scaling_ablation", "eval_by_split"])
def test_metrics_are_shares(spark, name):
    rows = [r.asDict() for r in QUERIES[name][0](spark, SF_SMALL).collect()]
    assert rows and all(0.0 <= v <= 1.0 for r in rows for k, v in r.items() if isinstance(v, float))
    assert all(r["auc"] > 0.6 for r in rows)


@pytest.fixture
def small(monkeypatch):
    for name, spec in SMALL.items():
        monkeypatch.setitem(X.MODELS, name, spec)
    monkeypatch.setattr(X, "ENSEMBLES", {k: {n: SMALL[n] for n in ms} for k, ms in X.ENSEMBLES.items()})
    monkeypatch.setattr(X, "COMPARED", ["logistic_regression", "random_forest", "xgboost_like"])


def test_comparison_is_written_as_csv(spark, small, tmp_path):
    from cohortlens.plans.reports import write_model_comparison

    write_model_comparison(spark, SF_SMALL, str(tmp_path / "report"))
    out = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "report"))
    assert out.columns == ["model"] + [f"{m}_{p}" for m in ("accuracy", "precision", "recall", "f1", "roc_auc") for p in ("mean", "std")]
    rows = {r["model"]: r for r in out.collect()}
    assert set(rows) == {"logistic_regression", "random_forest", "xgboost_like"}
    assert all(0.5 < r["accuracy_mean"] < 1 and 0 < r["accuracy_std"] < 0.1 for r in rows.values())


def test_votes_by_fold_and_importances(spark, small):
    folds = QUERIES["soft_vote_cv"][0](spark, SF_SMALL).collect()
    assert sorted(r["fold"] for r in folds) == list(range(C.N_FOLDS)) and all(r["auc"] > 0.6 for r in folds)
    (vote,) = QUERIES["soft_vote"][0](spark, SF_SMALL).collect()
    assert vote["model"] == "soft_vote_plain" and vote["auc"] > 0.6
    shares = {}
    for r in QUERIES["feature_importance"][0](spark, SF_SMALL).collect():
        shares[r["model"]] = shares.get(r["model"], 0.0) + r["importance"]
    assert set(shares) == {"logistic_regression", "random_forest", "gradient_boosting", "soft_vote_tuned"}
    assert all(abs(v - 1) < 1e-4 for v in shares.values())


def test_fits_that_read_no_row_ids_do_not_make_them(spark, monkeypatch):
    """``logreg_fit`` and its like take no sort of all rows; rows with equal keys or null keys all stay."""
    from cohortlens import constants as C
    from cohortlens.plans import experiments as X

    rows = [(*[None if i % 7 == 0 else i % 5] * len(C.KEYS), *[float((i * (j + 3)) % 11) for j in range(len(C.FEATURES))], i % 2, i) for i in range(60)]
    schema = ", ".join([f"{c} long" for c in C.KEYS] + [f"{c} double" for c in C.FEATURES] + [f"{C.LABEL} int", "h_split long"])
    monkeypatch.setattr(X.T, "cohort", lambda s, d: spark.createDataFrame(rows, schema))

    def refuse(*a, **kw):
        raise AssertionError("no row ids are read")

    monkeypatch.setattr(X, "with_row_id", refuse)
    n_train = sum(not (i % C.TEST_MODULUS == 0) for i in range(60))
    got = X.logreg_fit(spark, "").collect()
    assert len(got) == len(C.FEATURES) + 1 and {r["n_train"] for r in got} == {n_train} and all(r["residual"] == 0 for r in got)
    with X.Kept() as keep:
        assert X.prepared(spark, "", keep, ids=False).count() == 60
