"""Sources and sinks: CSV/parquet cohorts with explicit schemas, report and
chart-data sinks, model artifacts.

Writers are distributed (one file per partition) and never go through the
driver.  Paths are caller-supplied; on a cluster they live on the shared file
system.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, null_value: str = "NA") -> DataFrame:
    """Header CSV with an explicit schema (never inferred) and ``NA`` as null."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", null_value)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_csv_report(df: DataFrame, path: str, header: bool = True) -> None:
    """The prediction report as CSV (UTF-8, header), one file per partition."""
    df.write.mode("overwrite").option("header", header).option("encoding", "UTF-8").csv(path)


def write_tables(tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """One table per chart/report under ``base`` (overwrite); returns the paths."""
    out = {}
    for name, df in tables.items():
        path = f"{base.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(path)
        out[name] = path
    return out


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ----------------------------------------------------------- display format
def fixed2(c: Column) -> Column:
    """Two decimals as text (``{:.2f}``)."""
    return F.format_string("%.2f", c)


def percent1(c: Column) -> Column:
    """A share as a percentage with one decimal (``{:.1%}``)."""
    return F.concat(F.format_string("%.1f", c * F.lit(100.0)), F.lit("%"))


def number_text(c: Column, integral: Column) -> Column:
    """Integers without decimals, other values with two."""
    return F.when(integral, F.format_string("%d", c.cast("long"))).otherwise(fixed2(c))
