"""Artifact history: an append-only table (service, artifact_type, stored_at, payload); the latest one is a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def save(artifacts: DataFrame, path: str) -> None:
    artifacts.write.mode("append").partitionBy("artifact_type").parquet(path)


def history(artifacts: DataFrame, n: int, keys: tuple[str, ...] = ("service", "artifact_type"), tie: str | None = None) -> DataFrame:
    """The last n of each key, newest first; ranks are limited before the shuffle."""
    order: list[Column] = [F.desc("stored_at"), *([F.desc(tie)] if tie else [])]
    return artifacts.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("turn") <= n)


def latest(artifacts: DataFrame, keys: tuple[str, ...] = ("service", "artifact_type"), tie: str | None = None) -> DataFrame:
    """Each key's newest payload, by an aggregate that is combined before the shuffle."""
    newest = F.struct("stored_at", tie) if tie else F.col("stored_at")
    return artifacts.groupBy(*keys).agg(F.max_by("payload", newest).alias("payload"), F.max("stored_at").alias("stored_at"))


def services(artifacts: DataFrame, keys: tuple[str, ...] = ("service",)) -> DataFrame:
    return artifacts.select(*keys).distinct().orderBy(*keys)


def supported(artifacts: DataFrame, versions: tuple[int, ...] = (1,)) -> tuple[DataFrame, DataFrame]:
    """Rows of a supported schema version, and those to put aside."""
    fine = F.coalesce(F.col("schema_version").isin(*versions), F.lit(False))
    return artifacts.filter(fine), artifacts.filter(~fine)


def write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """An artifact table for all services at once."""
    df.write.mode("overwrite").format(fmt).save(path)
