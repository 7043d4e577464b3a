"""The query catalogue: one Spark query per operator, each with its DuckDB twin.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
Every query reads the given tables (or data Spark derives from them) in
full; outputs are aliased identically on both sides and doubles are rounded
to six places.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import grouping as G
from ..sources import schema as SC
from ..sources import tables as T
from . import oracle_sql as S
from .registry import QUERIES, query


# ===================================================================== scans
@query(
    "preview_head",
    S.with_cohort()
    + f"""
SELECT {S.KEY_LIST}, l_quantity, outcome FROM cohort
ORDER BY {S.KEY_LIST}, {S.FEATURE_LIST} LIMIT 5""",
)
def preview_head(spark, sf_dir):
    # top-k: TakeOrderedAndProject keeps 5 rows per partition, no full sort
    c = T.cohort(spark, sf_dir)
    return c.orderBy(*C.KEYS, *C.FEATURES).select(*C.KEYS, "l_quantity", C.LABEL).limit(5)


@query(
    "feature_projection",
    S.with_cohort()
    + f"SELECT {S.KEY_LIST}, {S.FEATURE_LIST}, CAST(outcome AS INTEGER) AS label FROM cohort",
)
def feature_projection(spark, sf_dir):
    c = T.cohort(spark, sf_dir)
    x = SC.drop_columns(c, [C.GROUP, "region", "l_returnflag", "h_split"], strict=True)
    return x.select(*C.KEYS, *SC.numeric_features(x, exclude=C.KEYS + [C.LABEL]), SC.target(x, C.LABEL))


# =============================================================== region/prev
@query(
    "region_lookup",
    S.with_cohort() + "\nSELECT region, count(*) AS n FROM cohort GROUP BY region",
)
def region_lookup(spark, sf_dir):
    return G.count_by(T.cohort(spark, sf_dir), "region")


@query("distinct_regions", S.with_cohort() + "\nSELECT DISTINCT region FROM cohort")
def distinct_regions(spark, sf_dir):
    return G.distinct_values(T.cohort(spark, sf_dir), "region").orderBy("region")


@query(
    "region_options",
    S.with_cohort()
    + f"\nSELECT {S.q(C.ALL_OPTION)} AS option UNION ALL SELECT DISTINCT region AS option FROM cohort",
)
def region_options(spark, sf_dir):
    return G.with_all_option(G.distinct_values(T.cohort(spark, sf_dir), "region"), "region")


@query(
    "prevalence_country",
    S.with_cohort()
    + "\nSELECT country, round(avg(CAST(outcome AS DOUBLE)), 6) AS prevalence FROM cohort "
    "WHERE country IS NOT NULL GROUP BY country ORDER BY prevalence DESC, country",
)
def prevalence_country(spark, sf_dir):
    p = G.prevalence(T.cohort(spark, sf_dir)).select(C.GROUP, "prevalence")
    return G.rounded(p).orderBy(F.desc("prevalence"), C.GROUP)


@query(
    "prevalence_region",
    S.with_cohort()
    + "\nSELECT country, round(avg(CAST(outcome AS DOUBLE)), 6) AS prevalence FROM cohort "
    "WHERE region = 'ASIA' AND country IS NOT NULL GROUP BY country",
)
def prevalence_region(spark, sf_dir):
    p = G.prevalence(T.cohort(spark, sf_dir), region="ASIA").select(C.GROUP, "prevalence")
    return G.rounded(p).orderBy(F.desc("prevalence"), C.GROUP)


@query(
    "prevalence_share",
    S.with_cohort(
        "prev AS (SELECT country, avg(CAST(outcome AS DOUBLE)) AS prevalence FROM cohort "
        "WHERE country IS NOT NULL GROUP BY country)"
    )
    + "\nSELECT country, round(prevalence, 6) AS prevalence, "
    "round(prevalence / (SELECT sum(prevalence) FROM prev), 6) AS share FROM prev",
)
def prevalence_share(spark, sf_dir):
    p = G.prevalence(T.cohort(spark, sf_dir)).select(C.GROUP, "prevalence")
    return G.rounded(G.share_of_total(p, "prevalence")).orderBy(F.desc("share"), C.GROUP)


@query(
    "prevalence_rollup",
    S.with_cohort()
    + """
SELECT region, country,
       CASE WHEN grouping(country) = 0 THEN 'country' WHEN grouping(region) = 0 THEN 'region' ELSE 'total' END AS level,
       round(avg(CAST(outcome AS DOUBLE)), 6) AS prevalence, count(*) AS n
FROM cohort GROUP BY ROLLUP (region, country)""",
)
def prevalence_rollup(spark, sf_dir):
    return G.rounded(G.prevalence_rollup(T.cohort(spark, sf_dir)))


# the other topic modules register themselves on import
from . import profiles as _profiles  # noqa: E402,F401
from . import scoring_queries as _scoring  # noqa: E402,F401
from . import neighbours as _neighbours  # noqa: E402,F401
from . import experiments as _experiments  # noqa: E402,F401
from . import stream_queries as _stream  # noqa: E402,F401
from . import reports as _reports  # noqa: E402,F401
