"""Joins of two streams within an interval of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, by: list[str], on: str, before: str, late: str = "1 hour", how: str = "left_outer") -> DataFrame:
    """Rows of `left` with the rows of `right` that are equal in `by` and at most `before` earlier in `on`; `left_outer` gives those without any, too, once none can come.

    Both sides keep in state only what a row of the other side that is no later than `late` could still meet: of `right`, `before` and
    `late` behind the slower watermark, of `left`, `late`. Rows later than that are dropped. Nulls in `by` or `on` equal nothing: such left rows are unmatched (without a time,
    they are never given). Column names of the sides must differ but for `by` and `on`, of which the left ones are returned.
    """
    a, b = left.withWatermark(on, late).alias("l"), right.withWatermark(on, late).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in by]
    near = (F.col(f"r.{on}") <= F.col(f"l.{on}")) & (F.col(f"r.{on}") >= F.col(f"l.{on}") - F.expr(f"INTERVAL {before}"))
    condition = near
    for c in same:
        condition = condition & c
    return a.join(b, condition, how).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in (*by, on)])
