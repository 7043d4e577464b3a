"""Unit, boundary and property tests of the operators on hand-made frames."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions.derive import (
    predicted_label,
    risk_tier,
    risk_zone,
    stable_round,
    z_interpretation,
    z_score,
)
from cohortlens.operators import evaluate as E
from cohortlens.operators import grouping as G
from cohortlens.operators import ordered as O
from cohortlens.operators import stats as ST
from cohortlens.operators.knn import knn, knn_vote
from cohortlens.operators.prep import PopStandardScaler, PopStandardScalerModel, class_ranks


# ------------------------------------------------------------------ tiers
def test_tier_zone_and_label_boundaries(spark):
    ps = [0.2999999, 0.3, 0.4999999, 0.5, 0.6999999, 0.7, 0.7499999, 0.75, 1.0, 0.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    rows = df.select("p", risk_tier(F.col("p")).alias("t"), risk_zone(F.col("p")).alias("z"), predicted_label(F.col("p")).alias("y")).collect()
    got = {r.p: (r.t, r.z, r.y) for r in rows}
    assert got[0.5] == (C.TIER_MODERATE, C.ZONE_MODERATE, 1)  # 50 % is inclusive
    assert got[0.4999999][2] == 0
    assert got[0.75][0] == C.TIER_HIGH and got[0.7499999][0] == C.TIER_MODERATE
    assert got[0.3][1] == C.ZONE_MODERATE and got[0.2999999][1] == C.ZONE_LOW
    assert got[0.7][1] == C.ZONE_HIGH and got[0.6999999][1] == C.ZONE_MODERATE


def test_z_interpretation_chain(spark):
    zs = [1.0, 0.99, 0.5, 0.49, 0.0, -0.49, -0.5, -0.99, -1.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = {r.z: r.i for r in df.select("z", z_interpretation(F.col("z")).alias("i")).collect()}
    assert got[1.0] == C.Z_HIGH and got[0.99] == C.Z_SLIGHT_HIGH and got[0.5] == C.Z_SLIGHT_HIGH
    assert got[0.49] == C.Z_NORMAL and got[-0.49] == C.Z_NORMAL
    assert got[-0.5] == C.Z_SLIGHT_LOW and got[-1.0] == C.Z_LOW


def test_z_score_rounds_half_even_on_decimal_rendering(spark):
    df = spark.createDataFrame([(0.015, 0.0, 1.0), (0.025, 0.0, 1.0), (-0.015, 0.0, 1.0)], "x double, m double, s double")
    got = [r.z for r in df.select(z_score(F.col("x"), F.col("m"), F.col("s")).alias("z")).collect()]
    assert got == [0.02, 0.02, -0.02]


def test_stable_round_ties_and_infinities(spark):
    df = spark.createDataFrame([(0.0499185,), (0.04991849999999999,), (float("inf"),)], "x double")
    got = [r.r for r in df.select(stable_round(F.col("x")).alias("r")).collect()]
    assert got == [0.049919, 0.049919, None]


# ------------------------------------------------------------- grouping
def test_prevalence_drops_null_groups_and_empty_region(spark):
    df = spark.createDataFrame(
        [("a", "R1", 1), ("a", "R1", 0), (None, "R1", 1), ("b", "R2", 1)], "country string, region string, outcome int"
    )
    p = {r.country: r.prevalence for r in G.prevalence(df).collect()}
    assert p == {"a": 0.5, "b": 1.0}
    assert G.prevalence(df, region="nowhere").isEmpty()


def test_share_of_total_sums_to_one(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.5)], "k string, v double")
    assert math.isclose(sum(r.share for r in G.share_of_total(df, "v").collect()), 1.0)


def test_lookup_default_other(spark):
    from cohortlens.sources.tables import lookup_region

    facts = spark.createDataFrame([("x",), ("y",)], "country string")
    dim = spark.createDataFrame([("x", "R")], "country string, region string")
    got = {r.country: r.region for r in lookup_region(facts, dim).collect()}
    assert got == {"x": "R", "y": C.UNMAPPED_REGION}


# ---------------------------------------------------------------- ordered
def test_images_keep_the_order_of_doubles():
    xs = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 1e-310, 0.1, 2.5, 1e300, np.inf])
    keys = O.image(xs)
    assert all(a <= b for a, b in zip(keys, keys[1:])) and keys[4] == keys[5]
    assert [O.double(int(k)) for k in keys] == [float(x) for x in xs]


@pytest.mark.parametrize("ranges", [512, 3])
def test_exact_quantiles_match_numpy_by_group(spark, monkeypatch, ranges):
    monkeypatch.setattr(O, "RANGES", ranges)
    rng = random.Random(7)
    vals = [rng.choice([1.0, 2.0, 2.0, 3.5]) if i % 3 == 0 else rng.gauss(0, 10) for i in range(3000)]
    groups = [i % 2 for i in range(3000)]
    df = spark.createDataFrame(list(zip(groups, vals)), "g int, v double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    q = O.exact_quantiles(df, ["v"], probs, by=["g"])
    got = {(r.g, r.prob): r.value for r in q.collect()}
    for g in (0, 1):
        arr = np.array([v for gg, v in zip(groups, vals) if gg == g])
        for p in probs:
            assert math.isclose(got[(g, p)], float(np.percentile(arr, p * 100)), rel_tol=1e-12, abs_tol=1e-12)


def test_running_totals_equal_single_window(spark):
    rng = random.Random(3)
    rows = [(i % 3, rng.random(), rng.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, x double, w int")
    splits = O.bucket_splits(df, ["x"], 20)
    assert len(splits[0]) == 21
    staged = O.bucketize(df, ["x"], ["b"], splits)
    got = O.running_totals(staged, ["g"], "b", [F.col("x")], ["w"]).collect()
    for g in range(3):
        mine = sorted((r.x, r.cum_w) for r in got if r.g == g)
        acc, expect = 0, []
        for x, w in sorted((x, w) for gg, x, w in rows if gg == g):
            acc += w
            expect.append((x, acc))
        assert mine == expect


def test_class_ranks_are_a_permutation(spark):
    from cohortlens.functions.derive import row_hash

    df = spark.range(0, 5000).select(
        F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("outcome")
    ).withColumn("h_split", row_hash("split", ["k"]))
    ranked, sizes = class_ranks(df, tie_breakers=["k"])
    for cls, n in sizes.items():
        ranks = sorted(r["rank"] for r in ranked.where(F.col("outcome") == cls).select("rank").collect())
        assert ranks == list(range(1, n + 1))


def test_stratified_split_ranks_every_row(spark):
    from cohortlens.operators.prep import stratified_split

    rows = [(k, None if k % 7 == 0 else k % 2, (k * 7919) % 40) for k in range(300)]  # hashes tie, a class is null
    df = spark.createDataFrame(rows, "k int, outcome int, h_split long")
    got = {r["k"]: (r["rank"], r["part"]) for r in stratified_split(df, tie_breakers=["k"]).collect()}
    for cls in (None, 0, 1):
        own = sorted((h, k) for k, y, h in rows if y == cls)
        cut = math.ceil(len(own) / 5)
        assert [got[k] for _, k in own] == [(i, "test" if i <= cut else "train") for i in range(1, len(own) + 1)]


def test_stratified_split_query_returns_ranks(spark):
    from cohortlens.plans.catalogue import QUERIES
    from paths import SF_SMALL

    by = {(r["part"], r["outcome"]): r for r in QUERIES["stratified_split"][0](spark, SF_SMALL).collect()}
    for y in {y for _, y in by}:
        test, train = by[("test", y)], by[("train", y)]
        assert (test["min_rank"], test["max_rank"]) == (1, test["n"])
        assert (train["min_rank"], train["max_rank"]) == (test["n"] + 1, test["n"] + train["n"])


# -------------------------------------------------------------- evaluate
def _scored(spark, rows):
    return spark.createDataFrame(rows, "model string, y int, p double")


def _brute_auc(rows):
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_equals_rank_sum_with_ties_and_flip(spark):
    rng = random.Random(11)
    rows = [("m", rng.randint(0, 1), round(rng.random(), 1)) for _ in range(400)]
    a = E.auc(_scored(spark, rows), ["model"], "y", "p").first().auc
    assert math.isclose(a, _brute_auc(rows), rel_tol=1e-12)
    flipped = [(m, y, 1 - p) for m, y, p in rows]
    b = E.auc(_scored(spark, flipped), ["model"], "y", "p").first().auc
    assert math.isclose(a + b, 1.0, rel_tol=1e-9)


def test_auc_single_class_is_null_and_roc_ends_at_one(spark):
    rows = [("m", 1, 0.2), ("m", 1, 0.9)]
    assert E.auc(_scored(spark, rows), ["model"], "y", "p").first().auc is None
    rows = [("m", 1, 0.2), ("m", 0, 0.9), ("m", 1, 0.9), ("m", 0, 0.1)]
    pts = E.roc_curve(_scored(spark, rows), ["model"], "y", "p").collect()
    last = min(pts, key=lambda r: r.threshold)
    assert (last.fpr, last.tpr) == (1.0, 1.0)
    assert any(r.threshold == float("inf") and r.fpr == 0.0 for r in pts)


def test_confusion_has_absent_cells_as_zero_and_sums_to_n(spark):
    df = spark.createDataFrame([("m", 1, 1), ("m", 1, 1), ("m", 1, 0)], "model string, y int, pred int")
    rows = E.confusion_matrix(df, ["model"], "y", "pred").collect()
    cells = {r.label: (r.pred_0, r.pred_1) for r in rows}
    assert cells == {0: (0, 0), 1: (1, 2)}


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 0, 0)], "model string, y int, pred int")
    r = E.binary_metrics(df, ["model"], "y", "pred").first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (100.0, 0.0, 0.0, 0.0)


def test_best_model_ties_by_declared_order(spark):
    df = spark.createDataFrame([("b", 90.0, 1), ("a", 90.0, 0), ("c", 80.0, 2)], "model string, accuracy double, o int")
    assert E.best_by(df, "accuracy", "o", ["model"]).first().model == "a"


# ------------------------------------------------------------------ stats
def test_corr_constant_column_is_null_and_diagonal_one(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.1), (3.0, 5.0, 5.9)], "a double, c double, b double")
    got = {(r.feature_i, r.feature_j): r.corr for r in ST.corr_matrix(df, ["a", "c", "b"]).collect()}
    assert got[("a", "c")] is None and got[("c", "c")] is None
    assert math.isclose(got[("a", "a")], 1.0)
    assert math.isclose(got[("a", "b")], float(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1]))


@pytest.mark.parametrize("t,nu", [(2.228, 10.0), (12.706, 1.0), (4.303, 2.0), (1.960, 1e6)])
def test_student_t_p_value_at_table_points(spark, t, nu):
    df = spark.createDataFrame([(t, nu)], "t double, nu double")
    p = df.select(ST.student_t_two_sided_p(F.col("t"), F.col("nu")).alias("p")).first().p
    assert abs(p - 0.05) < 2e-4


def test_histogram_counts_sum_to_n(spark):
    df = spark.createDataFrame([(x / 100.0,) for x in range(101)], "p double")
    assert sum(r.n for r in ST.fixed_bins(df, "p", 25).collect()) == 101
    rb = ST.range_bins(df, "p", 20).collect()
    assert sum(r.n for r in rb) == 101 and max(r.bin for r in rb) == 19


def test_kde_integrates_to_about_one(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(0, rng.gauss(0, 1)) for _ in range(500)], "g int, x double")
    pts = sorted((r.x, r.density) for r in ST.kde_curve(df, "x", "g", 200).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert 0.9 < area < 1.0


def test_one_hot_drops_alphabetically_first(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "r string")
    out, names = ST.one_hot(df, "r")
    assert names == ["r_b", "r_c"]
    assert {r.level: r.n for r in ST.column_sums(out, names).collect()} == {"r_b": 1, "r_c": 1}


# ---------------------------------------------------------------- scaler
def test_pop_scaler_mean_zero_pop_std_one_and_persists(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (6.0, 3.0)], "a double, k double")
    model = PopStandardScaler(inputCols=["a", "k"], outputCols=["za", "zk"]).fit(df)
    out = model.transform(df).agg(F.avg("za").alias("m"), F.stddev_pop("za").alias("s"), F.max(F.abs("zk")).alias("k")).first()
    assert abs(out.m) < 1e-12 and math.isclose(out.s, 1.0) and out.k == 0.0
    path = str(tmp_path / "scaler")
    model.write().overwrite().save(path)
    again = PopStandardScalerModel.load(path)
    assert again.getOrDefault(again.means) == model.getOrDefault(model.means)


# ------------------------------------------------------------------- kNN
def test_knn_matches_brute_force_with_small_clusters(spark):
    rng = np.random.RandomState(0)
    centres = rng.normal(0, 5, size=(4, 3))
    vecs = [centres[i % 4] + rng.normal(0, 1, size=3) for i in range(300)]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = knn(df, 4, leaf_size=10, probe=1).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append((r.rank, r.neighbour_id))
    arr = np.array(vecs)
    for q in range(300):
        d = ((arr - arr[q]) ** 2).sum(axis=1)
        order = [j for j in sorted(range(300), key=lambda j: (round(d[j], 9), j)) if j != q][:4]
        assert [n for _, n in sorted(mine[q])] == order
    votes = knn_vote(knn(df, 5, leaf_size=10), df)
    assert votes.count() == 300


# ------------------------------------------------------------ partitioning
def test_results_invariant_under_repartition(spark):
    rng = random.Random(2)
    rows = [("m", rng.randint(0, 1), round(rng.random(), 2)) for _ in range(500)]
    a = E.auc(_scored(spark, rows), ["model"], "y", "p").first().auc
    b = E.auc(_scored(spark, rows).repartition(13), ["model"], "y", "p").first().auc
    assert a == b


def test_norm_table_truncates_listed_statistics(spark):
    from cohortlens.operators.scoring import norm_table

    rows = {r.feature: (r.mean, r.std) for r in norm_table(spark, truncate=["l_quantity"]).collect()}
    assert rows["l_quantity"] == (25.0, 14.0)
    assert rows["p_size"] == (25.5, 14.4)


def test_alert_names_and_validation_reason(spark):
    from cohortlens.functions.derive import alert_names
    from cohortlens.operators.scoring import validate

    df = spark.createDataFrame(
        [(46.0, -1.0, 500000.0, 0.05, 0.04, 1000.0, 900.0, 10), (10.0, 100.0, 1000.0, 0.05, 0.04, 1000.0, 900.0, 10)],
        "l_quantity double, c_acctbal double, o_totalprice double, l_discount double, l_tax double, "
        "l_extendedprice double, p_retailprice double, p_size int",
    )
    alerts = [r.a for r in df.select(alert_names().alias("a")).collect()]
    assert alerts == [["high_quantity", "negative_balance", "large_order"], []]
    v = [(r.status, r.reason) for r in validate(df).collect()]
    assert v == [(C.REJECTED, "c_acctbal"), (C.VALID, C.NO_REASON)]


# ------------------------------------------------------- library cross-checks
def test_auc_matches_spark_evaluator_without_binning(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    rng = random.Random(21)
    rows = [("m", rng.randint(0, 1), round(rng.random(), 2)) for _ in range(1000)]
    df = _scored(spark, rows)
    mine = E.auc(df, ["model"], "y", "p").first().auc
    raw = df.select(F.col("y").cast("double").alias("label"), array_to_vector(F.array(1 - F.col("p"), F.col("p"))).alias("raw"))
    theirs = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", numBins=0).evaluate(raw)
    assert abs(mine - theirs) < 1e-12


def test_kde_matches_mllib_kernel_density(spark):
    from pyspark.mllib.stat import KernelDensity

    rng = random.Random(4)
    xs = [rng.gauss(2, 1.5) for _ in range(400)]
    df = spark.createDataFrame([(0, x) for x in xs], "g int, x double")
    mine = sorted((r.x, r.density) for r in ST.kde_curve(df, "x", "g", 50).collect())
    h = len(xs) ** -0.2 * float(np.std(xs, ddof=1))
    kd = KernelDensity()
    kd.setSample(spark.sparkContext.parallelize(xs))
    kd.setBandwidth(h)
    theirs = kd.estimate([x for x, _ in mine])
    for (_, a), b in zip(mine, theirs):
        assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def test_corr_matches_ml_stat_correlation(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    rng = np.random.RandomState(9)
    data = rng.normal(size=(500, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]]) + [1e5, 0, -3]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    mine = {(r.feature_i, r.feature_j): r.corr for r in ST.corr_matrix(df, ["a", "b", "c"]).collect()}
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df)
    m = Correlation.corr(vec, "v").first()[0].toArray()
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            assert abs(mine[(a, b)] - m[i, j]) < 1e-9


def test_one_hot_counts_equal_indicator_sums(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), ("c",), (None,)], "r string")
    out, names = ST.one_hot(df, "r")
    sums = {r.level: r.n for r in ST.column_sums(out, names).collect()}
    counts = {r.level: r.n for r in ST.one_hot_counts(df, "r").collect()}
    assert sums == counts == {"r_b": 1, "r_c": 2}


def test_encoder_counts_equal_group_counts(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), ("c",), (None,)], "r string")
    assert {r.level: r.n for r in ST.encoded_counts(df, "r").collect()} == {"r_b": 1, "r_c": 2}


def _brute_knn(ids, arr, k):
    out = {}
    for qi, q in enumerate(ids):
        d = ((arr - arr[qi]) ** 2).sum(axis=1)
        out[int(q)] = [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (round(d[j], 9), ids[j])) if j != qi][:k]
    return out


@pytest.mark.parametrize(("n", "distinct"), [(1, 1), (3, 3), (100, 100), (256, 256), (900, 20), (2000, 1921)])
def test_knn_on_small_and_duplicated_tables(spark, n, distinct):
    rng = np.random.RandomState(n)
    base = rng.normal(0, 1, size=(distinct, 3))
    arr = base[np.concatenate([np.arange(distinct), np.zeros(n - distinct, dtype=int) if distinct > 1000 else rng.randint(0, distinct, n - distinct)])]
    ids = rng.permutation(n * 3)[:n]
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, arr)], "vec_id long, embedding array<double>")
    rows = knn(df, 5).collect()
    assert len(rows) == n * min(5, n - 1)
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.neighbour_id)
    want = _brute_knn(ids, arr, 5)
    assert all(got.get(q, []) == w for q, w in want.items())


def test_pivot_tree_of_three_levels_bounds_every_row(spark):
    """Each row lies within the radius of every ancestor's pivot, and the pruned search over three levels is exact."""
    from cohortlens.operators.knn import pivot_tree

    rng = np.random.RandomState(5)
    arr = np.round(rng.normal(size=(400, 3)), 2)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(arr)], "_id long, _v array<double>")
    leaves, levels = pivot_tree(df, 8, 4, 64)
    assert len(levels) >= 3
    balls = {r["_node"]: r for level in levels for r in level.collect()}
    rows = leaves.collect()
    assert sorted(r["_id"] for r in rows) == list(range(400))
    sizes = {}
    for r in rows:
        node = r["_node"]
        assert not balls[node]["_open"]
        while node:
            ball = balls[node]
            sizes[node] = sizes.get(node, 0) + 1
            assert math.dist(r["_v"], ball["_mu"]) <= ball["_r"] + 1e-12
            node = ball["_parent"]
    assert all(balls[n]["_n"] == m for n, m in sizes.items()) and len(sizes) == len(balls)
    got = {}
    for r in knn(df.toDF("vec_id", "embedding"), 4, leaf_size=8, branch=4, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbour_id))
    want = _brute_knn(list(range(400)), arr, 4)
    assert {q: [n for _, n in sorted(v)] for q, v in got.items()} == {q: [x if not isinstance(x, tuple) else x[-1] for x in v] for q, v in want.items()}


def test_knn_refuses_mixed_lengths_and_leaves_out_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        knn(df, 1)
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.neighbour_id) for r in knn(df, 2).collect()} == {(1, 3), (3, 1)}


def test_broadcast_check_sees_a_grown_table(spark, tmp_path):
    from cohortlens.operators.joins import is_bounded

    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    assert is_bounded(spark.read.parquet(path), 100)
    spark.range(1000).write.mode("overwrite").parquet(path)
    assert not is_bounded(spark.read.parquet(path), 100)


def test_correlation_with_missing_values_is_pairwise(spark):
    rng = np.random.RandomState(5)
    a = rng.normal(1000, 1, 400)
    rows = [(float(x), None if i % 7 == 0 else float(x + rng.normal()), 3.0) for i, x in enumerate(a)]
    got = {(r.feature_i, r.feature_j): r["corr"] for r in ST.corr_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    x, y = zip(*[(u, v) for u, v, _ in rows if v is not None])
    assert abs(got[("a", "b")] - np.corrcoef(x, y)[0, 1]) < 1e-9 and got[("c", "c")] is None and got[("a", "c")] is None
    assert abs(got[("b", "b")] - 1) < 1e-12


def test_wide_values_survive_rounding(spark):
    from cohortlens.functions.derive import stable_round

    r = spark.createDataFrame([(1e35, 0.1234565, float("inf"))], "a double, b double, c double").select(*[stable_round(F.col(c)).alias(c) for c in "abc"]).first()
    assert r.a == 1e35 and r.b == 0.123457 and r.c is None


def test_knn_with_hot_duplicate_vectors_matches_brute_force(spark):
    rng = np.random.RandomState(3)
    base = rng.normal(0, 3, size=(40, 4))
    # a third of the rows share one vector; others repeat a few times
    vecs = [base[0]] * 100 + [base[1 + (i % 39)] + (0 if i % 4 else rng.normal(0, 0.1, 4)) for i in range(200)]
    ids = rng.permutation(10_000)[:300]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    k = 5
    got = {}
    for r in knn(df, k, leaf_size=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbour_id))
    arr = np.array(vecs)
    for qi, q in enumerate(ids):
        d = ((arr - arr[qi]) ** 2).sum(axis=1)
        order = [int(ids[j]) for j in sorted(range(300), key=lambda j: (round(d[j], 9), ids[j])) if j != qi][:k]
        assert [n for _, n in sorted(got[int(q)])] == order
    # searching a second table against the first
    qdf = spark.createDataFrame(rows[:30], "vec_id long, embedding array<double>").withColumn("vec_id", F.col("vec_id") + 100_000)
    got2 = {}
    for r in knn(df, k, leaf_size=16, queries=qdf).collect():
        got2.setdefault(r.query_id, []).append((r.rank, r.neighbour_id))
    for qi in range(30):
        d = ((arr - arr[qi]) ** 2).sum(axis=1)
        order = [int(ids[j]) for j in sorted(range(300), key=lambda j: (round(d[j], 9), ids[j]))][:k]
        assert [n for _, n in sorted(got2[int(ids[qi]) + 100_000])] == order


def test_degenerate_inputs_do_not_fail(spark):
    df = spark.createDataFrame([(0, 0.5), (0, 0.5), (1, 0.3), (1, 0.7)], "g int, x double")
    rows = ST.kde_curve(df, "x", "g", 5).collect()
    assert all(r.density is None for r in rows if r.g == 0)
    assert all(r.density is not None and r.density > 0 for r in rows if r.g == 1)
    same = spark.createDataFrame([("m", 1, 0.5), ("m", 0, 0.5), ("m", 1, 0.5)], "model string, y int, p double")
    assert E.auc(same, ["model"], "y", "p").first().auc == 0.5


def test_select_model_picks_one_and_unknown_is_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, accuracy double")
    assert [r.accuracy for r in E.select_model(df, "b").collect()] == [2.0]
    assert E.select_model(df, "zzz").isEmpty()


def test_knn_tasks_return_numbers_of_children_not_vectors():
    """A query may go on to all children of a node: its vector is not repeated for each, and a leaf returns nothing beyond the bound."""
    import numpy as np
    import pandas as pd

    from cohortlens.operators.knn import _block_topk, _choose

    rng = np.random.RandomState(2)
    asked = pd.DataFrame({"_qid": range(5), "_qv": list(rng.normal(size=(5, 64))), "_D": [np.inf] * 5})
    kids = pd.DataFrame({"_child": range(7), "_mu": list(rng.normal(size=(7, 64))), "_r": [1.0] * 7, "_open": [True] * 7})
    out = _choose(None)(asked, kids)
    assert list(out.columns) == ["_qid", "_node", "_open"] and len(out) == 35
    q = pd.DataFrame({"_qid": [1], "_qv": [np.zeros(1)], "_D": [2.0]})
    p = pd.DataFrame({"_id": [10, 11, 12, 13], "_v": [np.array([x]) for x in (1.0, -2.0, 2.0, 3.0)]})
    assert _block_topk(4, False)(q, p)["_nid"].tolist() == [10, 11, 12]
