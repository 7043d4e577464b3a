"""Join helpers: size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def is_bounded(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    Reads at most ``max_rows + 1`` rows (a limit job), so the check itself is
    cheap whatever the size of ``df``.  It runs each time: a table may have
    grown since the last query.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only behind a row-count check; otherwise let Spark pick.

    Beyond the bound the plain DataFrame is returned and the planner falls
    back to its own size-checked choice (sort-merge / shuffled hash join,
    AQE re-planning at runtime).
    """
    return F.broadcast(df) if is_bounded(df, max_rows) else df
