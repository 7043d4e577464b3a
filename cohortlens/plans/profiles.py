"""Catalogue: cohort profiles (describe, correlation, scaling, one-hot,
box plot, Welch's t-test)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.derive import is_test
from ..operators import grouping as G
from ..operators import stats as ST
from ..operators.prep import PopStandardScaler
from ..sources import tables as T
from . import oracle_sql as S
from .registry import query

CORR_COLS = [*C.FEATURES, C.LABEL]


def _describe_sql() -> str:
    parts = []
    for f in C.FEATURES:
        x = f"CAST({f} AS DOUBLE)"
        parts.append(
            f"SELECT {S.q(f)} AS feature, count({x}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
            f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM cohort"
        )
    return S.with_cohort() + "\n" + "\nUNION ALL ".join(parts)


@query("describe_long", _describe_sql())
def describe_long(spark, sf_dir):
    return G.rounded(ST.describe(T.cohort(spark, sf_dir), C.FEATURES))


def _corr_sql() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            xa = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            xb = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            parts.append(
                f"SELECT {S.q(a)} AS feature_i, {S.q(b)} AS feature_j, "
                f"round(covar_pop({xa}, {xb}) / (stddev_pop({xa}) * stddev_pop({xb})), 6) AS corr FROM cohort"
            )
    return S.with_cohort() + "\n" + "\nUNION ALL ".join(parts)


@query("corr_matrix", _corr_sql())
def corr_matrix(spark, sf_dir):
    return G.rounded(ST.corr_matrix(T.cohort(spark, sf_dir), CORR_COLS))


TRAIN_WHERE = f"h_split % {C.TEST_MODULUS} <> 0"
TEST_WHERE = f"h_split % {C.TEST_MODULUS} = 0"


def _scaler_sql() -> str:
    parts = [
        f"SELECT {S.q(f)} AS feature, round(avg(CAST({f} AS DOUBLE)), 6) AS mean, "
        f"round(stddev_pop(CAST({f} AS DOUBLE)), 6) AS std FROM cohort WHERE {TRAIN_WHERE}"
        for f in C.FEATURES
    ]
    return S.with_cohort() + "\n" + "\nUNION ALL ".join(parts)


@query("scaler_stats", _scaler_sql())
def scaler_stats(spark, sf_dir):
    train = T.cohort(spark, sf_dir).where(~is_test("h_split"))
    return G.rounded(ST.mean_pop_std(train, C.FEATURES))


def _standardize_sql() -> str:
    stats = ", ".join(
        f"avg(CAST({f} AS DOUBLE)) AS m_{f}, stddev_pop(CAST({f} AS DOUBLE)) AS s_{f}" for f in C.FEATURES
    )
    parts = []
    for f in C.FEATURES:
        z = f"((CAST({f} AS DOUBLE) - m_{f}) / (CASE WHEN s_{f} > 0 THEN s_{f} ELSE 1.0 END))"
        parts.append(
            f"SELECT {S.q(f)} AS feature, round(avg({z}), 6) AS mean_z, round(stddev_pop({z}), 6) AS std_z "
            f"FROM cohort, train_stats WHERE {TEST_WHERE}"
        )
    return S.with_cohort(f"train_stats AS (SELECT {stats} FROM cohort WHERE {TRAIN_WHERE})") + "\n" + "\nUNION ALL ".join(parts)


@query("standardize", _standardize_sql())
def standardize(spark, sf_dir):
    c = T.cohort(spark, sf_dir)
    zcols = [f"z_{f}" for f in C.FEATURES]
    scaler = PopStandardScaler(inputCols=C.FEATURES, outputCols=zcols).fit(c.where(~is_test("h_split")))
    scaled = scaler.transform(c.where(is_test("h_split")))
    wide = scaled.agg(
        *[F.avg(z).alias(f"m{i}") for i, z in enumerate(zcols)], *[F.stddev_pop(z).alias(f"s{i}") for i, z in enumerate(zcols)]
    )
    long = wide.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean_z"), F.col(f"s{i}").alias("std_z")) for i, f in enumerate(C.FEATURES)]
            )
        )
    )
    return G.rounded(long)


@query(
    "one_hot",
    S.with_cohort()
    + "\nSELECT 'region_' || region AS level, count(*) AS n FROM cohort "
    "WHERE region <> (SELECT min(region) FROM cohort) GROUP BY region",
)
def one_hot(spark, sf_dir):
    return ST.encoded_counts(T.cohort(spark, sf_dir).select("region"), "region")


def _boxplot_sql() -> str:
    return S.with_cohort(
        "q AS (SELECT outcome, quantile_cont(CAST(l_quantity AS DOUBLE), 0.25) AS q25, "
        "quantile_cont(CAST(l_quantity AS DOUBLE), 0.5) AS q50, quantile_cont(CAST(l_quantity AS DOUBLE), 0.75) AS q75 "
        "FROM cohort GROUP BY outcome)",
        "f AS (SELECT c.outcome, CAST(c.l_quantity AS DOUBLE) AS x, q.q25, q.q50, q.q75, "
        "q.q25 - CAST(1.5 AS DOUBLE) * (q.q75 - q.q25) AS lof, q.q75 + CAST(1.5 AS DOUBLE) * (q.q75 - q.q25) AS hif "
        "FROM cohort c JOIN q ON c.outcome = q.outcome)",
    ) + """
SELECT outcome, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
       round(min(CASE WHEN x >= lof AND x <= hif THEN x END), 6) AS lo,
       round(max(CASE WHEN x >= lof AND x <= hif THEN x END), 6) AS hi,
       count(CASE WHEN NOT (x >= lof AND x <= hif) THEN 1 END) AS outliers
FROM f GROUP BY outcome, q25, q50, q75"""


@query("boxplot_stats", _boxplot_sql())
def boxplot_stats(spark, sf_dir):
    return G.rounded(ST.boxplot_stats(T.cohort(spark, sf_dir), "l_quantity", C.LABEL))


# ------------------------------------------------------------ Welch t-test
WELCH_CASES = ("outcome_quantity", "quality_letter_share", "returnflag_quantity")


def _simpson_sql(a: str, b: str, nu: str, n: int = ST.SIMPSON_INTERVALS) -> str:
    step = f"(({b} - {a}) / {S.d(n)})"
    w = f"(CASE WHEN i = 0 OR i = {n} THEN {S.d(1)} WHEN i % 2 = 1 THEN {S.d(4)} ELSE {S.d(2)} END)"
    body = f"{w} * pow(cos({a} + CAST(i AS DOUBLE) * {step}), {nu} - {S.d(1)})"
    return f"(list_sum(list_transform(range(0, {n + 1}), lambda i: {body})) * {step} / {S.d(3)})"


def _welch_sql() -> str:
    def summary(name, src, x, g):
        return (
            f"SELECT {S.q(name)} AS case_name, count({x}) FILTER (WHERE NOT ({g})) AS n1, avg({x}) FILTER (WHERE NOT ({g})) AS m1, "
            f"var_samp({x}) FILTER (WHERE NOT ({g})) AS v1, count({x}) FILTER (WHERE {g}) AS n2, "
            f"avg({x}) FILTER (WHERE {g}) AS m2, var_samp({x}) FILTER (WHERE {g}) AS v2 FROM {src}"
        )

    letter = (
        "CAST(length(regexp_replace(d.text, '[^\\p{L}]', '', 'g')) AS DOUBLE) / CAST(d.n_chars AS DOUBLE)"
    )
    docs = f"(SELECT {letter} AS x, lb.quality = 1 AS g FROM documents d JOIN labels lb ON d.doc_id = lb.doc_id) dc"
    s = "\nUNION ALL ".join(
        [
            summary(WELCH_CASES[0], "cohort", "CAST(l_quantity AS DOUBLE)", "outcome = 1"),
            summary(WELCH_CASES[1], docs, "x", "g"),
            summary(WELCH_CASES[2], "cohort", "CAST(l_quantity AS DOUBLE)", "l_returnflag = 'R'"),
        ]
    )
    se1, se2 = "(v1 / CAST(n1 AS DOUBLE))", "(v2 / CAST(n2 AS DOUBLE))"
    tt = (
        f"tt AS (SELECT case_name, (m1 - m2) / sqrt({se1} + {se2}) AS t, "
        f"pow({se1} + {se2}, 2) / (pow({se1}, 2) / CAST(n1 - 1 AS DOUBLE) + pow({se2}, 2) / CAST(n2 - 1 AS DOUBLE)) AS df FROM s)"
    )
    lim = (
        f"lim AS (SELECT case_name, t, df, least({S.d(3.141592653589793 / 2)}, {S.d(ST.TAIL_SIGMAS)} / sqrt(df)) AS u, "
        "atan(abs(t) / sqrt(df)) AS th0 FROM tt)"
    )
    p = (
        f"CASE WHEN th0 >= u THEN {S.d(0)} ELSE greatest({S.d(0)}, least({S.d(1)}, "
        f"{_simpson_sql('th0', 'u', 'df')} / {_simpson_sql(S.d(0), 'u', 'df')})) END"
    )
    return (
        S.with_cohort(f"s AS ({s})", tt, lim)
        + f"\nSELECT case_name, round(t, 6) AS t, round(df, 6) AS df, round(p, 6) AS p, p < {S.d(0.05)} AS significant "
        f"FROM (SELECT case_name, t, df, {p} AS p FROM lim)"
    )


@query("welch_ttest", _welch_sql())
def welch_ttest(spark, sf_dir):
    c = T.cohort(spark, sf_dir)
    docs = T.doc_cohort(spark, sf_dir)
    # both cohort cases in one pass over the cohort; the documents case apart
    on_cohort = ST.welch_summaries(
        c,
        [
            (WELCH_CASES[0], F.col("l_quantity"), F.col(C.LABEL) == 1),
            (WELCH_CASES[2], F.col("l_quantity"), F.col("l_returnflag") == "R"),
        ],
    )
    on_docs = ST.welch_summaries(docs, [(WELCH_CASES[1], F.col("letter_share"), F.col("quality") == 1)])
    s = on_cohort.unionByName(on_docs)
    return G.rounded(ST.welch_test(s).select("case_name", "t", "df", "p", "significant"))
