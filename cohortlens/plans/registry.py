"""Registry of catalogue queries: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROUND = re.compile(r"(?<![A-Za-z_])round\(")


def stable_rounding(sql: str, digits: int = 6) -> str:
    """Evaluate every ``round(x, 6)`` of an oracle query on the 9-place
    decimal rendering of ``x``, exactly as ``grouping.stable_round`` does on
    the Spark side (ties then fall the same way in both engines)."""
    out, pos = [], 0
    for m in _ROUND.finditer(sql):
        if m.start() < pos:
            continue
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[m.end() : i - 1]
        head, sep, tail = inner.rpartition(",")
        if not sep or tail.strip() != str(digits):
            continue
        out.append(sql[pos : m.start()])
        out.append(f"CAST(round(TRY_CAST(({stable_rounding(head, digits)}) AS DECIMAL(38,9)), {digits}) AS DOUBLE)")
        pos = i
    out.append(sql[pos:])
    return "".join(out)


QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = (fn, stable_rounding(sql) if sql else None)
        return fn

    return register
