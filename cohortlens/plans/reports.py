"""Report writers: the data behind every chart and table, one table each.

The reference renders figures into a directory; here the *data* of each
figure is written as its own table (parquet by default) so any tool can
draw it.  Each table is a catalogue query, computed and written by the
executors.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.io import write_csv_report, write_tables

CHART_TABLES = [
    "roc_curve",
    "auc_exact",
    "confusion_matrix",
    "prob_histogram",
    "range_histogram",
    "kde_curve",
    "corr_matrix",
    "boxplot_stats",
    "prevalence_share",
    "zscore_profile",
    "metric_series",
    "importance_normalised",
]


def write_chart_data(spark: SparkSession, sf_dir: str, out_dir: str, names=CHART_TABLES) -> dict[str, str]:
    """Write one table per chart under ``out_dir`` (overwrite); returns paths."""
    from .catalogue import QUERIES

    return write_tables({n: QUERIES[n][0](spark, sf_dir) for n in names}, out_dir)


def write_prediction_report(spark: SparkSession, sf_dir: str, out_dir: str) -> None:
    """The prediction report over every scored row, as CSV with header."""
    from .catalogue import QUERIES

    write_csv_report(QUERIES["prediction_report"][0](spark, sf_dir), out_dir)


#: fixed values: the columns of the comparison report, metric by metric
COMPARISON_METRICS = {"accuracy": "accuracy", "precision": "precision", "recall": "recall", "f1": "f1", "roc_auc": "auc"}


def write_model_comparison(spark: SparkSession, sf_dir: str, out_dir: str) -> None:
    """Mean and deviation of every fold metric by model, as CSV with header."""
    from pyspark.sql import functions as F

    from .catalogue import QUERIES

    wide = QUERIES["model_comparison"][0](spark, sf_dir)
    columns = [F.col(f"{own}_{part}").alias(f"{name}_{part}") for name, own in COMPARISON_METRICS.items() for part in ("mean", "std")]
    write_csv_report(wide.select("model", *columns).orderBy("model"), out_dir)
