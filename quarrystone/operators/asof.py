"""As-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.functions import micros

DAY = 86_400_000_000


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, value: list[str], suffix: str = "_asof", chunk: int = DAY) -> DataFrame:
    """Each row of `left` with the columns `value` of the last row of `right` at or before it in `on`, among rows equal in `by`.

    A key's rows are cut into chunks of `chunk` microseconds of `on` (a time, a date, or a number). One window runs over the rows of both sides in each chunk, and what an earlier chunk
    leaves is a row at the chunk's start, from a window over a row a chunk; so no task holds a key of many rows, and no row is compared with another. Of right rows
    with equal `on`, the one with the largest `value` counts. Rows without an earlier right row get nulls. A null in `by` or `on` equals
    nothing, as in SQL: such left rows get nulls, such right rows match none.
    """
    nulls = " or ".join(f"`{c}` is null" for c in [*by, on])
    unmatched, left, right = left.where(nulls), left.where(f"not ({nulls})"), right.where(f"not ({nulls})")
    keys = [f"k{i}" for i in range(len(by))]
    kind = right.select(F.struct(*value).alias("x")).schema["x"].dataType

    def rows(df: DataFrame, side: int, r: Column, row: Column) -> DataFrame:
        own = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
        return df.select(*own, F.col(on).alias("at"), F.floor(micros(df, on) / chunk).alias("chunk"), F.lit(side).alias("side"), r.alias("r"), row.alias("l"))

    a, b = rows(left, 1, F.lit(None).cast(kind), F.struct("*")), rows(right, 0, F.struct(*value), F.lit(None).cast(left.schema))
    # The last right row of each chunk, for the chunks after it that left rows are in.
    last = b.groupBy(*keys, "chunk").agg(F.max(F.struct("at", "r")).alias("m"))
    asked = a.groupBy(*keys, "chunk").agg(F.lit(True).alias("asked"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(asked, [*keys, "chunk"], "full").withColumn("m", F.last("m", ignorenulls=True).over(before)).where("asked and m is not null")
    carried = carried.select(*keys, F.col("m.at").alias("at"), "chunk", F.lit(0).alias("side"), F.col("m.r").alias("r"), F.lit(None).cast(left.schema).alias("l"))
    order = Window.partitionBy(*keys, "chunk").orderBy("at", "side", "r").rowsBetween(Window.unboundedPreceding, 0)
    found = a.union(b).union(carried).withColumn("r", F.last("r", ignorenulls=True).over(order)).where("side = 1")
    found = found.select("l.*", *[F.col(f"r.{v}").alias(v + suffix) for v in value])
    return found.union(unmatched.select("*", *[F.lit(None).cast(kind[v].dataType).alias(v + suffix) for v in value]))
