"""Plan checks: row work stays JVM-side, scans are pruned, broadcasts are bounded."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from cohortlens.plans.catalogue import QUERIES
from paths import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapCoGroupsInPandas", "FlatMapGroupsInPandas", "MapInPandas")
# kNN computes its distance blocks with numpy in an Arrow-batched cogroup, on purpose
PYTHON_ALLOWED = {"knn_topk", "knn_classify"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def executed_plan(df) -> str:
    """The plan that ran: adaptive execution fills it in while the query's own rows are collected."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=false" not in text
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted({n for n, (_, sql) in QUERIES.items() if sql} - PYTHON_ALLOWED))
def test_no_python_in_oracle_query_plans(spark, name):
    text = plan_text(entry.queries()[name](spark, SF_SMALL))
    assert not any(node in text for node in PYTHON_NODES), name


def test_cohort_scan_reads_only_needed_columns(spark):
    text = plan_text(entry.queries()["prevalence_country"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    lineitem = [s for s in schemas if "l_orderkey" in s and "l_linenumber" in s]
    assert lineitem, text
    assert all("l_extendedprice" not in s and "l_tax" not in s and "l_returnflag" not in s for s in lineitem)


def test_filters_reach_the_scan(spark):
    from cohortlens.sources import tables as T

    text = plan_text(T.cohort(spark, SF_SMALL).where("l_quantity > 45 AND l_discount < 0.05").groupBy("country").count())
    assert "GreaterThan(l_quantity,45.0)" in text and "LessThan(l_discount,0.05)" in text


ONE_SCAN = ["corr_matrix", "confusion_matrix", "model_metrics", "zscore_profile", "alert_rules", "prevalence_country"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_executed_plan_scans_the_rows_once(spark, name):
    text = executed_plan(entry.queries()[name](spark, SF_SMALL))
    assert len(re.findall(r"FileScan parquet \[l_orderkey", text)) <= 1, text


CHECKPOINTED = ["boxplot_stats", "range_histogram", "kde_curve", "describe_long", "roc_curve"]


@pytest.mark.parametrize("name", CHECKPOINTED)
def test_repeated_passes_read_the_written_columns(spark, name):
    text = executed_plan(entry.queries()[name](spark, SF_SMALL))
    assert "lineitem.parquet" not in text, text
    assert "approx_percentile" not in text and "percentile" not in text


def test_class_statistics_are_broadcast(spark):
    for name in ("kde_curve", "boxplot_stats"):
        text = executed_plan(entry.queries()[name](spark, SF_SMALL))
        assert "SortMergeJoin" not in text, name
