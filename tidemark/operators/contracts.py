"""Contracts as columns: what is wrong with a row, as a list of messages; such rows go aside instead of stopping a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(column: str) -> tuple[Column, str]:
    return F.col(column).isNull(), f"{column}: missing"


def between(column: str, low: float | None = None, high: float | None = None) -> tuple[Column, str]:
    c = F.col(column)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return bad, f"{column}: out of range"


def one_of(column: str, *values: str) -> tuple[Column, str]:
    return ~F.col(column).isin(*values), f"{column}: not allowed"


def pattern(column: str, regex: str) -> tuple[Column, str]:
    return ~F.col(column).rlike(regex), f"{column}: malformed"


def every(column: str, test, message: str) -> tuple[Column, str]:
    return ~F.forall(F.col(column), test), f"{column}: {message}"


def violations(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for bad, message in rules]), lambda x: x.isNotNull())


def split(df: DataFrame, rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and those that do not with their ``violations``."""
    judged = df.withColumn("violations", violations(rules))
    return judged.filter(F.size("violations") == 0).drop("violations"), judged.filter(F.size("violations") > 0)
