"""Expectations: each gives the rows that violate it; `require` stops on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.operators.tables import n_distinct


class Violation(ValueError):
    """An expectation that doesn't hold, with a few of the rows."""


def require(violations: DataFrame, what: str) -> None:
    some = violations.limit(5).collect()
    if some:
        raise Violation(f"{what}: {some}")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are there more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_value(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys with several values of a column, null being one."""
    return df.groupBy(*keys).agg(n_distinct(F.col(column)).alias("n")).where("n > 1")


def all_true(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of which a condition isn't true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def same_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row if two tables differ in their numbers of rows."""
    n = a.agg(F.count(F.lit(1)).alias("n_before")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_after")))
    return n.where("n_before != n_after")


def twin_lots(df: DataFrame, key: str, cancelled: str) -> DataFrame:
    """Lots there several times that aren't one cancelled and one other row."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(cancelled).cast("int")).alias("n_cancelled"))
    return g.where("n > 1 AND NOT (n = 2 AND n_cancelled = 1)")


def spaced_numbers(df: DataFrame, column: str) -> DataFrame:
    """Fields in which only white space stands between two numbers."""
    return df.where(F.col(column).rlike(r"(?<!\d)\d{8}\s+\d{8}(?!\d)"))


def required(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise Violation(f"columns are missing: {missing}")


def all_of(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """(expectation, violations) for several expectations in one table."""
    return reduce(DataFrame.unionByName, [f.agg(F.lit(n).alias("expectation"), F.count(F.lit(1)).alias("violations")) for n, f in frames])
