"""Status of services from their latest artifacts. ``keys`` name a service: its name, or namespace and name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of severities in the monitor.
RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
SERVICE = ("service",)
STATUSES = ("healthy", "degraded", "critical", "improving", "baselined", "unknown")


def status(has_drift: Column, has_baseline: Column, breached: Column, dominant: Column, severity: Column) -> Column:
    drifted = F.when(~breached, "healthy").when(dominant.isin("latency_improvement", "error_rate_reduction"), "improving").when(severity.isin("critical", "high"), "critical").otherwise("degraded")
    return F.when(has_drift, drifted).when(has_baseline, "baselined").otherwise("unknown")


def service_status(artifacts: DataFrame, order: Column, keys: Sequence[str] = SERVICE) -> DataFrame:
    """One row per service from its newest artifacts (keys, artifact_type, stored_at, breached, class, severity, maturity_tier), in one aggregate."""
    newest = lambda kind, column: F.max_by(F.when(F.col("artifact_type") == kind, F.col(column)), F.when(F.col("artifact_type") == kind, order))
    has = lambda kind: F.bool_or(F.col("artifact_type") == kind)
    rows = artifacts.groupBy(*keys).agg(
        has("baseline").alias("has_baseline"), has("proposal").alias("has_proposal"), has("drift-signal").alias("has_drift_signal"), has("drift-report").alias("has_drift_report"),
        newest("baseline", "stored_at").alias("last_baseline"), newest("drift-signal", "stored_at").alias("last_drift"), newest("drift-signal", "breached").alias("breached"), newest("drift-signal", "class").alias("drift_class"), newest("drift-report", "severity").alias("drift_severity"), F.coalesce(newest("baseline", "maturity_tier"), F.lit("unknown")).alias("maturity_tier"),
    )
    return rows.withColumn("status", status(F.col("has_drift_signal"), F.col("has_baseline"), F.coalesce("breached", F.lit(False)), F.col("drift_class"), F.coalesce("drift_severity", F.lit("unknown")))).drop("breached")


def summary(statuses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many services there are of each status, in all or ``by`` namespace."""
    return statuses.groupBy(*by).agg(F.count(F.lit(1)).alias("total_services"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[F.coalesce(severity, F.lit("info"))], F.lit(5))


def drift_monitor(statuses: DataFrame, keys: Sequence[str] = SERVICE) -> DataFrame:
    """Services with drift, gravest first."""
    rows = statuses.filter("has_drift_signal").select(*keys, "drift_class", "drift_severity", severity_rank(F.col("drift_severity")).alias("severity_rank"))
    return rows.withColumn("drifting", ~F.coalesce(F.col("drift_class") == "no_significant_drift", F.lit(False))).orderBy("severity_rank", *keys)


def drift_counts(monitored: DataFrame) -> DataFrame:
    """How many services drift and how many do not, by severity, of ``drift_monitor``'s rows."""
    return monitored.groupBy("drifting", F.coalesce("drift_severity", F.lit("info")).alias("severity")).agg(F.count(F.lit(1)).alias("services"))


def recommendations(reports: DataFrame, keys: Sequence[str] = SERVICE) -> DataFrame:
    """One row per recommendation of (keys, recommendations array<struct<action, confidence, rationale>>)."""
    return reports.select(*keys, F.posexplode("recommendations").alias("place", "r")).select(*keys, "place", "r.*")
