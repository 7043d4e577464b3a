"""Catalogue: the scoring stream over ``events`` equals the batch score."""

from __future__ import annotations

from .. import constants as C
from ..streaming.score import stream_to_table, tier_counts
from . import oracle_sql as S
from .registry import query

_P = f"round({S.d(1.0)} / ({S.d(1.0)} + exp(-((CAST(value AS DOUBLE) - {S.d(C.EVENT_CENTRE)}) / {S.d(C.EVENT_SCALE)}))), 6)"


@query(
    "stream_score_parity",
    f"""
SELECT event_type, CASE WHEN value IS NULL OR value < {S.d(0)} OR value > {S.d(100)} THEN {S.q(C.REJECTED)} ELSE {S.q(C.VALID)} END AS status,
       CASE WHEN p IS NULL THEN NULL WHEN p * {S.d(100.0)} >= {S.d(C.TIER_HIGH_PCT)} THEN {S.q(C.TIER_HIGH)}
            WHEN p * {S.d(100.0)} >= {S.d(C.TIER_MODERATE_PCT)} THEN {S.q(C.TIER_MODERATE)} ELSE {S.q(C.TIER_LOW)} END AS tier,
       count(*) AS n
FROM (SELECT event_type, value, {_P} AS p FROM events) GROUP BY 1, 2, 3""",
)
def stream_score_parity(spark, sf_dir):
    sink = stream_to_table(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    return tier_counts(spark.read.parquet(sink))
