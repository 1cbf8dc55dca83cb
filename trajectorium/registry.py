"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.views import DET_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: p: pairs of one frame whose axis-aligned boxes overlap.
PAIRS_SQL = f"WITH {DET_SQL}, p AS (SELECT a.frame, a.event_id a_event_id, b.event_id b_event_id, (least(a.cx+a.w/2, b.cx+b.w/2) - greatest(a.cx-a.w/2, b.cx-b.w/2)) * (least(a.cy+a.h/2, b.cy+b.h/2) - greatest(a.cy-a.h/2, b.cy-b.h/2)) inter, a.w*a.h + b.w*b.h total FROM det a JOIN det b ON a.frame = b.frame AND a.event_id < b.event_id AND abs(a.cx-b.cx) < (a.w+b.w)/2 AND abs(a.cy-b.cy) < (a.h+b.h)/2)"


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def r(c, d: int = 4):
    return F.round(c, d)


def r_half(c, d: int = 4):
    """Rounded as SQL engines round doubles, by a multiplication: values on the edge, as those in the middle of two, go the same way."""
    return F.round(F.col(c) * 10**d) / 10**d
