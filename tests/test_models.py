"""Model-side tests: parameter recovery, persistence, encoders, sources/sinks, stream."""

from __future__ import annotations


import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions.derive import standardised
from cohortlens.operators import models as M
from cohortlens.operators.prep import one_hot_stages
from cohortlens.sources import io
from cohortlens.sources.schema import COHORT_SCHEMA
from cohortlens.sources.tables import cohort
from cohortlens.streaming.score import score_events, stream_to_table, tier_counts
from paths import SF_MID, SF_SMALL


def test_logistic_regression_recovers_planted_effects(spark):
    c = cohort(spark, SF_MID)
    terms = {t: standardised(f, ce, sc) for t, (f, ce, sc) in C.SCORE_TERMS.items()}
    df = c.select(*[v.alias(t) for t, v in terms.items()], standardised("l_tax", 0.04, 0.02).alias("z_t"), F.col("outcome").cast("double").alias("label"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["z_q", "z_s", "z_d", "z_t"], outputCol="features"),
                            M.LogisticRegression(regParam=0.0, standardization=False, maxIter=200)])
    lr = pipe.fit(df).stages[-1]
    q, s, d, t = lr.coefficients.toArray()
    assert abs(q - 1.0) < 0.1 and abs(s - 0.6) < 0.1 and abs(d + 0.4) < 0.1 and abs(t) < 0.1
    assert abs(lr.intercept + 0.8) < 0.1


def test_pipeline_persistence_gives_identical_scores(spark, tmp_path):
    c = cohort(spark, SF_SMALL).select(*C.FEATURES, F.col("outcome").cast("double").alias("label"))
    model = Pipeline(stages=M.feature_stages(C.FEATURES) + [M.logistic(6000, max_iter=50)]).fit(c)
    path = str(tmp_path / "model")
    io.save_model(model, path)
    again = io.load_model(path)
    a = model.transform(c).select(vector_to_array("probability")[1].alias("p")).collect()
    b = again.transform(c).select(vector_to_array("probability")[1].alias("p")).collect()
    assert a == b


def test_rff_svm_separates_a_planted_signal(spark):
    c = cohort(spark, SF_SMALL).select(*C.FEATURES, F.col("outcome").cast("double").alias("label"))
    pipe = Pipeline(stages=M.feature_stages(C.FEATURES) + [M.rbf_svm(6000, len(C.FEATURES), components=50)])
    scored = M.positive_probability(pipe.fit(c).transform(c))
    acc = scored.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.68
    assert scored.where((F.col("score") < 0) | (F.col("score") > 1)).isEmpty()


def test_one_hot_encoder_drops_alphabetically_first(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "r string")
    out = Pipeline(stages=one_hot_stages("r")).fit(df).transform(df)
    vecs = {r.r: tuple(r.v) for r in out.select("r", vector_to_array("r_vec").alias("v")).collect()}
    assert vecs["a"] == (0.0, 0.0)
    assert sum(vecs["b"]) == 1.0 and sum(vecs["c"]) == 1.0 and vecs["b"] != vecs["c"]


def test_csv_source_and_report_sink(spark, tmp_path):
    src = tmp_path / "cohort.csv"
    header = ",".join(COHORT_SCHEMA.fieldNames())
    src.write_text(header + "\n" + "1,2,3,4,10.0,100.0,0.05,0.04,900.0,1000.0,NA,12,NATION_1,1\n")
    df = io.read_csv(spark, str(src), COHORT_SCHEMA)
    row = df.first()
    assert row.c_acctbal is None and row.p_size == 12 and row.outcome == 1
    out = str(tmp_path / "report")
    io.write_csv_report(df.select("l_orderkey", io.fixed2(F.col("l_quantity")).alias("q")), out)
    back = spark.read.option("header", True).csv(out).first()
    assert back.q == "10.00"


def test_number_formats(spark):
    df = spark.createDataFrame([(0.1234, 3.0)], "s double, n double")
    r = df.select(io.percent1(F.col("s")).alias("a"), io.number_text(F.col("n"), F.lit(True)).alias("b")).first()
    assert (r.a, r.b) == ("12.3%", "3")


def test_stream_equals_batch(spark):
    sink = stream_to_table(spark, f"{SF_SMALL}/events.parquet")
    counts = lambda df: {(r.event_type, r.status, r.tier): r.n for r in tier_counts(df).collect()}
    streamed = counts(spark.read.parquet(sink))
    batch = counts(score_events(spark.read.parquet(f"{SF_SMALL}/events.parquet")))
    assert streamed == batch and sum(streamed.values()) == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_stream_reads_a_folder_and_keeps_rows_without_a_value(spark, tmp_path):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(300)
    holes = events.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    holes.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    out = spark.read.parquet(stream_to_table(spark, str(tmp_path / "events.parquet")))
    assert out.count() == 300
    empty = out.where("value IS NULL").collect()
    assert empty and all(r.status == "rejected" and r.p is None and r.tier is None for r in empty)


def test_stream_applies_a_saved_model(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from cohortlens.streaming.score import score_with

    rows = [(i, float(i % 50), None if i % 10 == 0 else float(i % 7), float(i % 50 > 25)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LogisticRegression()])
    pipe.fit(df.na.drop()).write().overwrite().save(str(tmp_path / "model"))
    model = PipelineModel.load(str(tmp_path / "model"))
    records = df.drop("label")
    records.repartition(3).write.parquet(str(tmp_path / "records"))
    score = score_with(model, ["a", "b"])
    out = spark.read.parquet(stream_to_table(spark, str(tmp_path / "records"), "fitted", records.schema, score))
    key = lambda df: sorted((r.id, r.status, r.tier, None if r.p is None else round(r.p, 9)) for r in df.collect())
    assert key(out) == key(score(records)) and out.count() == 400
    assert out.where("status = 'rejected'").count() == 40 and out.where("b IS NULL AND p IS NOT NULL").count() == 0


def test_chart_data_tables_written(spark, tmp_path):
    from cohortlens.plans.reports import write_chart_data

    paths = write_chart_data(spark, SF_SMALL, str(tmp_path / "charts"), names=["roc_curve", "confusion_matrix"])
    assert spark.read.parquet(paths["confusion_matrix"]).count() == 6
    assert spark.read.parquet(paths["roc_curve"]).count() > 3


def test_written_cohort_equals_lazy_cohort(spark, tmp_path):
    from cohortlens.operators.grouping import prevalence
    from cohortlens.sources.tables import write_cohort

    stored = write_cohort(spark, SF_SMALL, str(tmp_path / "cohort"))
    lazy = cohort(spark, SF_SMALL)
    assert stored.count() == lazy.count() == 6000
    a = {r.country: r.prevalence for r in prevalence(stored, region="ASIA").collect()}
    b = {r.country: r.prevalence for r in prevalence(lazy, region="ASIA").collect()}
    assert a == b and len(a) == 4


def test_soft_voting_model_persists(spark, tmp_path):
    c = cohort(spark, SF_SMALL).select(*C.FEATURES, F.col("outcome").cast("double").alias("label"))
    prep = Pipeline(stages=M.feature_stages(C.FEATURES)).fit(c)
    x = prep.transform(c)
    members = [("lr", M.logistic(6000, max_iter=50)), ("rf", M.random_forest(trees=5, depth=4)),
               ("svm", M.rbf_svm(6000, len(C.FEATURES), components=20))]
    model = M.SoftVotingClassifier(members).fit(x)
    path = str(tmp_path / "vote")
    model.write().save(path)
    again = M.SoftVotingModel.load(path)
    a = [r.score for r in model.transform(x).select(M.SCORE).collect()]
    b = [r.score for r in again.transform(x).select(M.SCORE).collect()]
    assert a == b and all(0.0 <= v <= 1.0 for v in a)


def test_score_requests_fixed_and_fitted(spark):
    from cohortlens.operators.scoring import score_requests

    reqs = cohort(spark, SF_SMALL).select(*C.FEATURES).limit(50).withColumn("l_tax", F.lit(None).cast("double"))
    out = score_requests(reqs, defaults={"l_tax": 0.04})
    rows = out.collect()
    assert len(rows) == 50 and all(r.l_tax == 0.04 for r in rows)
    assert {r.tier for r in rows} <= {C.TIER_HIGH, C.TIER_MODERATE, C.TIER_LOW}
    train = cohort(spark, SF_SMALL).select(*C.FEATURES, F.col("outcome").cast("double").alias("label"))
    model = Pipeline(stages=M.feature_stages(C.FEATURES) + [M.logistic(6000, max_iter=30)]).fit(train)
    fitted = score_requests(reqs, model=model, defaults={"l_tax": 0.04}).collect()
    assert all(0.0 <= r.probability_pct <= 100.0 for r in fitted)


def test_prepared_training_table_has_unique_stable_row_ids(spark):
    from cohortlens.plans.experiments import Kept, prepared

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with Kept() as keep:
        data = prepared(spark, SF_SMALL, keep)
        stats = data.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("d")).first()
        assert stats.n == stats.d == 6000
        first = sorted(r.row_id for r in data.select("row_id").collect())
        again = sorted(r.row_id for r in data.select("row_id").collect())
        assert first == again
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def _separable(spark, n=600):
    rng = np.random.RandomState(8)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    rows = [(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, label double")


def test_trees_boosting_and_voting_recover_a_planted_rule(spark):
    from pyspark.ml import Pipeline

    df = _separable(spark)
    train, test = df.where("row_id % 5 <> 0"), df.where("row_id % 5 = 0")
    members = [("forest", M.random_forest(20, 12)), ("boosted", M.boosted_trees(20, 0.2, 3)), ("logistic", M.logistic(480))]
    heads = {**dict(members), "vote": M.SoftVotingClassifier(members), "svm": M.rbf_svm(480, 2)}
    for name, head in heads.items():
        _, scored = M.fit_scored(Pipeline(stages=M.feature_stages(["a", "b"]) + [head]), train, test)
        hits = scored.where(F.col(M.PRED) == F.col("label")).count()
        assert hits >= 0.9 * test.count(), name


def test_voting_importance_speaks_through_its_first_member(spark):
    from cohortlens.plans import experiments as X

    df = _separable(spark, 200).select(F.array("a", "b").alias("v"), "label")
    from pyspark.ml.functions import array_to_vector

    vec = df.select(array_to_vector("v").alias("features"), "label")
    vote = M.SoftVotingClassifier([("boosted", M.boosted_trees(5, 0.2, 3)), ("logistic", M.logistic(200))]).fit(vec)
    rows = X.importance_rows("vote", vote)
    assert [r[2] for r in rows] == [float(v) for v in vote.fitted[0][1].featureImportances.toArray()]


def test_tree_memory_follows_the_session(spark):
    assert 256 <= M.tree_memory_mb() <= 1024
    assert M._memory_mb("16g") == 16384 and M._memory_mb("512m") == 512 and M._memory_mb("2048") == 2048


def test_stream_rows_carry_validation(spark):
    scored = score_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    counts = {r.status: r.n for r in scored.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(counts) <= {C.VALID, C.REJECTED} and sum(counts.values()) == scored.count()
    bad = scored.where(F.col("status") == C.REJECTED).select("value", "reason").collect()
    assert all(r.value > 100.0 and r.reason == "value" for r in bad)
