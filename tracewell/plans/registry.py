"""The registry of queries and of the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The dense day grid of adapters.day_traces, for the oracles: recording_id, roi_idx, frame, v.
GRID = """
users AS (SELECT DISTINCT user_id FROM events),
daily AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS frame, round(sum(value), 6) AS s FROM events GROUP BY ALL),
grid AS (
  SELECT u.user_id % 5 AS recording_id, u.user_id AS roi_idx, CAST(f.frame AS INT) AS frame, coalesce(d.s, 0.0) AS v
  FROM users u CROSS JOIN range(0, 30) f(frame) LEFT JOIN daily d ON d.user_id = u.user_id AND d.frame = f.frame)"""

#: Strict peaks of the grid, plateaus collapsed: recording_id, roi_idx, frame, v.
PEAKS = GRID + """,
marked AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY roi_idx ORDER BY frame) THEN 0 ELSE 1 END AS fresh FROM grid),
runs AS (SELECT recording_id, roi_idx, run, min(frame) AS a, max(frame) AS b, max(v) AS v
         FROM (SELECT *, sum(fresh) OVER (PARTITION BY roi_idx ORDER BY frame) AS run FROM marked) GROUP BY ALL),
sides AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM runs WINDOW w AS (PARTITION BY roi_idx ORDER BY run)),
peaks AS (SELECT recording_id, roi_idx, CAST((a + b) // 2 AS INT) AS frame, v FROM sides WHERE v > l AND v > r)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
