"""Column functions shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(name: str) -> Column:
    """Money is stored as DOUBLE; a decimal sum does not depend on the order of its terms."""
    return F.col(name).cast("decimal(18,2)")


def total(name: str) -> Column:
    return F.sum(money(name)).cast("decimal(28,2)")


def dot(a: str, b: str) -> Column:
    """The inner product of two arrays of numbers, in their order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def utc(name: str) -> Column:
    """An instant as a timestamp without zone, of its time in UTC whatever the session's zone."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({name}), TIMESTAMP_NTZ '1970-01-01 00:00:00')")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time (without a zone: as if in UTC) or a date; whole numbers as they are."""
    kind, c = df.schema[name].dataType.typeName(), F.col(f"`{name}`")
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01")).cast("long") * 86_400_000_000
    return c.cast("long")


def at_micros(name: str) -> Column:
    """The time without a zone at a number of microseconds since 1970."""
    return F.expr(f"timestampadd(MICROSECOND, `{name}`, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
