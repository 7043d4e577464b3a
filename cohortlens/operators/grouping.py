"""Group-level operators: prevalence, share of total, rollup, distinct, options.

All aggregates run as partial (map-side) + final hash aggregation, so the
shuffle carries one row per group and partition whatever the row count.
Windows here only ever run over *aggregated* tables whose size is the
number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.derive import stable_round
from ..session import materialize


def prevalence(
    df: DataFrame,
    by: str = C.GROUP,
    label: str = C.LABEL,
    region: str | None = None,
    region_col: str = "region",
) -> DataFrame:
    """Mean of a 0/1 label per group, null groups dropped; optional region filter.

    ``region=None`` means all regions.  The filter is a plain predicate, so
    Catalyst pushes it to the dimension side of the region lookup.
    """
    rows = df if region is None else df.where(F.col(region_col) == F.lit(region))
    return (
        rows.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.avg(F.col(label).cast("double")).alias("prevalence"), F.count(F.lit(1)).alias("n"))
    )


def share_of_total(df: DataFrame, value: str, alias: str = "share") -> DataFrame:
    """``value / sum(value)`` over an aggregated table (one row per group).

    The table is checkpointed once; its total is one number brought to the
    driver and applied as a literal (no single-partition window).
    """
    table = materialize(df)
    total = table.agg(F.sum(F.col(value)).alias("t")).first()["t"]
    return table.withColumn(alias, F.try_divide(F.col(value), F.lit(total).cast("double")))


def level_name(levels: Sequence[str]) -> Column:
    """Name of the rollup level of a row: the finest non-aggregated column."""
    expr = F.lit("total")
    for name in levels:
        expr = F.when(F.grouping(name) == 0, F.lit(name)).otherwise(expr)
    return expr


def prevalence_rollup(df: DataFrame, levels: Sequence[str] = ("region", C.GROUP), label: str = C.LABEL) -> DataFrame:
    """Prevalence at every level of the hierarchy in one aggregation (ROLLUP)."""
    return df.rollup(*levels).agg(
        level_name(levels).alias("level"),
        F.avg(F.col(label).cast("double")).alias("prevalence"),
        F.count(F.lit(1)).alias("n"),
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def with_all_option(values: DataFrame, col: str, alias: str = "option", all_label: str = C.ALL_OPTION) -> DataFrame:
    """Prepend the literal ``All`` choice to a list of values (a union)."""
    spark = values.sparkSession
    head = spark.createDataFrame([(all_label,)], f"{alias} string")
    return head.unionByName(values.select(F.col(col).cast("string").alias(alias)))


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column (both engines' last bits differ)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float") and f.name not in skip:
            out.append(stable_round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
