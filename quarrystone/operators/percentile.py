"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_percentiles(df: DataFrame, by: str, wanted: dict[str, tuple[str, float]], accuracy: int = 10_000) -> DataFrame:
    """(by, a column for each of `wanted`): of each group, interpolated percentiles of values that are not null; `wanted` is name: (column, p).

    Mergeable sketches bracket each rank to within 2 / `accuracy` of a group's rows, all in one aggregate; in a second scan values below a bracket are counted, and
    only those in it, with their counts, are put in order. No buffer holds a group's values, unlike that of the built-in exact function.
    Groups without any value give no row, a column without values in a group is null; a null group is one. The groups themselves must fit a join's small side or a shuffle.
    """
    asked = list(wanted.values())
    rows = df.select(F.col(by).alias("g"), *[F.col(c).cast("double").alias(f"x{i}") for i, (c, _) in enumerate(asked)])
    edges = [(max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)) for _, p in asked]
    of = [x for i, e in enumerate(edges) for x in (F.percentile_approx(f"x{i}", list(e), accuracy).alias(f"e{i}"), F.count(f"x{i}").alias(f"n{i}"), F.min(f"x{i}").alias(f"least{i}"), F.max(f"x{i}").alias(f"most{i}"))]
    bracket = rows.groupBy("g").agg(*of)
    low = lambda i: F.col(f"least{i}") if edges[i][0] == 0 else F.get(f"e{i}", 0)
    high = lambda i: F.col(f"most{i}") if edges[i][1] == 1 else F.get(f"e{i}", 1)
    bracket = bracket.select(F.col("g").alias("of"), F.array(*[F.struct(F.col(f"n{i}").alias("n"), low(i).alias("low"), high(i).alias("high")) for i in range(len(asked))]).alias("b"))
    # What lies below a bracket is one row with its count.
    value = lambda i: F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x"), F.col("b")[i]["n"].alias("n"), F.col("b")[i]["low"].alias("low"), F.col("b")[i]["high"].alias("high"))
    near = rows.join(bracket, F.col("g").eqNullSafe(F.col("of"))).select("g", F.explode(F.array(*map(value, range(len(asked))))).alias("v")).select("g", "v.*").where("x <= high")
    near = near.groupBy("g", "i", "n", F.when(F.col("x") >= F.col("low"), F.col("x")).alias("x")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy("g", "i").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.array(*[F.lit(p) for _, p in asked])[F.col("i")] * (F.col("n") - 1)
    at = near.withColumn("to", F.sum("c").over(upto)).withColumn("rank", rank).where("x is not null")
    # Ranks from 0: a value holds ranks to - c up to to - 1.
    holds = lambda r: F.min(F.when(F.col("to") > r, F.col("x")))
    found = at.groupBy("g", "i").agg(holds(F.floor("rank")).alias("a"), holds(F.ceil("rank")).alias("b"), F.first("rank").alias("rank"))
    found = found.withColumn("p", F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank")))
    return found.groupBy(F.col("g").alias(by)).agg(*[F.max(F.when(F.col("i") == i, F.col("p"))).alias(name) for i, name in enumerate(wanted)])


def exact_percentile(df: DataFrame, by: str, value: str, p: float, accuracy: int = 10_000) -> DataFrame:
    """(by, percentile) of one column; see `exact_percentiles`."""
    return exact_percentiles(df, by, {"percentile": (value, p)}, accuracy)
