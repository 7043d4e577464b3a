"""DuckDB twins of the catalogue queries (the correctness oracle).

The SQL is generated from the same fixed values as the Spark side
(``constants``), so a changed threshold moves both.  Every double literal
is cast to DOUBLE: a bare ``25.5`` is DECIMAL in both engines.
"""

from __future__ import annotations

from .. import constants as C


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def logit_sql(model: str) -> str:
    _, intercept, weights = next(m for m in C.SCORE_MODELS if m[0] == model)
    parts = [d(intercept)]
    for term, w in weights.items():
        feature, centre, scale = C.SCORE_TERMS[term]
        parts.append(f"{d(w)} * ((CAST({feature} AS DOUBLE) - {d(centre)}) / {d(scale)})")
    return " + ".join(parts)


def score_sql(model: str) -> str:
    return f"round({d(1.0)} / ({d(1.0)} + exp(-({logit_sql(model)}))), {C.SCORE_DIGITS})"


def hash_sql(tag: str, key_expr: str = "rk") -> str:
    return f"CAST(('0x' || substr(md5({q(tag + '|')} || {key_expr}), 1, 8)) AS BIGINT)"


FEATURE_LIST = ", ".join(C.FEATURES)
KEY_LIST = ", ".join(C.KEYS)

COHORT_CTE = f"""
geo_dim AS (
  SELECT n2.n_name AS country, r.r_name AS region
  FROM nation n2 JOIN region r ON n2.n_regionkey = r.r_regionkey
  WHERE n2.n_nationkey < {C.MAPPED_NATION_LIMIT}
),
geo AS (
  SELECT n.n_nationkey, n.n_name AS country, COALESCE(g.region, {q(C.UNMAPPED_REGION)}) AS region
  FROM nation n LEFT JOIN geo_dim g ON n.n_name = g.country
),
cohort_base AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber,
         l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax,
         p.p_retailprice, o.o_totalprice, c.c_acctbal, p.p_size,
         geo.country, geo.region, l.l_returnflag,
         concat_ws('|', l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber) AS rk
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN geo ON c.c_nationkey = geo.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
cohort AS (
  SELECT * EXCLUDE (rk),
         {hash_sql('split')} AS h_split,
         CASE WHEN CAST({hash_sql('y')} AS DOUBLE) / {d(C.HASH_SPAN)}
                   < {d(1.0)} / ({d(1.0)} + exp(-({logit_sql(C.PLANTED_MODEL)})))
              THEN 1 ELSE 0 END AS outcome
  FROM cohort_base
)"""


def with_cohort(*ctes: str) -> str:
    """``WITH`` clause holding the cohort plus extra CTEs."""
    return "WITH " + ",\n".join([COHORT_CTE.strip(), *ctes])


SCORES_CTE = "scores AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT {KEY_LIST}, h_split, outcome, country, {q(name)} AS model, {i} AS model_order, {score_sql(name)} AS p FROM cohort"
    for i, (name, _, _) in enumerate(C.SCORE_MODELS)
) + "\n)"

TEST_SCORES_CTE = f"test_scores AS (SELECT * FROM scores WHERE h_split % {C.TEST_MODULUS} = 0)"
