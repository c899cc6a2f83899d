"""Columns by name, matched as the session matches them: without regard to case, unless it is told otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def fold(df: DataFrame) -> Callable[[str], str]:
    """What makes two names the same."""
    return str if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower


def named(df: DataFrame, name: str) -> str:
    """The spelling of the one column of `df` that `name` means; ValueError where there is none, or more than one."""
    same = fold(df)
    found = [c for c in df.columns if same(c) == same(name)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns of {df.columns} are named {name}; one is needed")
    return found[0]


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of `df` that none of `names` means; ValueError where two of them have one name."""
    same = fold(df)
    out = [c for c in df.columns if same(c) not in {same(x) for x in names}]
    if len({same(c) for c in out}) < len(out):
        raise ValueError(f"columns share a name: {out}")
    return out
