"""Schema operators: explicit schemas, strict/tolerant drops, dtype selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

COHORT_SCHEMA = T.StructType(
    [T.StructField(k, T.LongType() if k != "l_linenumber" else T.IntegerType()) for k in C.KEYS]
    + [T.StructField(f, T.IntegerType() if f == "p_size" else T.DoubleType()) for f in C.FEATURES]
    + [T.StructField(C.GROUP, T.StringType()), T.StructField(C.LABEL, T.IntegerType())]
)


def drop_columns(df: DataFrame, cols: Sequence[str], strict: bool = False) -> DataFrame:
    """``drop`` that by default tolerates absent names; ``strict`` checks first."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns, in schema order, minus ``exclude``."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)
    ]


def target(df: DataFrame, col: str, alias: str = "label") -> Column:
    return F.col(col).cast("int").alias(alias)
