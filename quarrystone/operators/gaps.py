"""Regular series of irregular ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fill_gaps(df: DataFrame, by: list[str], slot: str, value: str) -> DataFrame:
    """by, slot, value, carried, interpolated: a row for every whole number from a key's first slot to its last.

    `value` is null in slots that `df` has no row for, or null in; `carried` is the last value known there, `interpolated` lies on the line between the last and
    the next known one. `df` has a row a key and slot, as an aggregate gives; slots without a value at a key's ends are left out, since nothing lies on both sides, and so are null slots. Null keys are a key.

    Each known value brings its own slots up to the next one: one window and no join with a spine, so a key takes as many rows as slots, however many rows were aggregated into them.
    """
    known = df.where(F.col(slot).isNotNull() & F.col(value).isNotNull()).select(*by, F.col(slot).cast("long").alias(slot), value)
    order = Window.partitionBy(*by).orderBy(slot)
    known = known.withColumns({"__next": F.lead(slot).over(order), "__after": F.lead(value).over(order)})
    steps = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__next") - F.col(slot) - 1, F.lit(0).cast("long")))
    rows = known.withColumn("__i", F.explode(steps))
    between = F.col(value) + (F.col("__after") - F.col(value)) * F.col("__i") / (F.col("__next") - F.col(slot))
    return rows.select(
        *by,
        (F.col(slot) + F.col("__i")).alias(slot),
        F.when(F.col("__i") == 0, F.col(value)).alias(value),
        F.col(value).alias("carried"),
        F.when(F.col("__i") == 0, F.col(value).cast("double")).otherwise(between.cast("double")).alias("interpolated"),
    )
