"""Sessions by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessionize(df: DataFrame, by: list[str], on: str, gap: str) -> DataFrame:
    """`df` with session: the number (from 1) of the run of rows, within `by`, that are no more than `gap` apart. Rows without a time are in none (null)."""
    order = Window.partitionBy(*by).orderBy(on)
    new = F.coalesce(F.col(on) > F.lag(on).over(order) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    new = F.when(F.col(on).isNotNull(), new.cast("int"))
    session = F.when(F.col(on).isNotNull(), F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("__new", new).withColumn("session", session).drop("__new")
