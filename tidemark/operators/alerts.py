"""Recording series, burn-rate alerts over two windows, budgets, and the rows behind objectives and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import alert_name, duration_seconds
from tidemark.operators.series import over_time, per_second, ratio_over_time


def latency_steps(rows: DataFrame, keys: list[str], targets: DataFrame, value: str, at: Column) -> DataFrame:
    """Rows and those within their agreement per step."""
    return rows.join(targets, keys).groupBy(*keys, at.alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) <= F.col("sla_target")).alias("hits"))


def cpu_utilization(gauges: DataFrame, keys: list[str], value: str, at: Column) -> DataFrame:
    """Mean utilization per step; a step without a sample has none."""
    return gauges.filter(F.col(value).isNotNull()).groupBy(*keys, at.alias("epoch")).agg(F.avg(value).alias("cpu"))


def latency_ratio(rows: DataFrame, keys: list[str], targets: DataFrame, value: str, at: Column) -> DataFrame:
    """Share of rows within their agreement per step; ``targets`` has one row per key: ``keys``, sla_target."""
    return latency_steps(rows, keys, targets, value, at).select(*keys, "epoch", F.try_divide("hits", "n").alias("good_ratio"))


def alert_rules(targets: DataFrame, keys: list[str]) -> DataFrame:
    """One rule per target and window: threshold = burn rate times the budget."""
    rules = targets.select(*keys, "sli_name", "sli_type", "sla_target", "error_budget_percent", F.inline("burn_windows"))
    return rules.withColumns({"threshold": F.round(F.col("burn_rate") * F.col("error_budget_percent") / 100, 9), "alert": alert_name(F.col("sli_name"), F.col("severity")), "status": F.lit("armed")})


def evaluate(steps: DataFrame, rules: DataFrame, keys: list[str], value: str | tuple[str, ...], windows: list[int], fires) -> DataFrame:
    """Steps at which a rule's condition holds over both of its windows.

    Each window length is one pass over time blocks; then rules, few per service, are joined. ``value`` is averaged over a window,
    a pair (hits, rows) summed and divided, one in a tuple summed and divided by the window's seconds. ``fires(value)`` is the condition.
    """
    named = {f"w{seconds}": seconds for seconds in windows}
    if isinstance(value, str):
        steps = over_time(steps, keys, value, named)
    else:
        steps = ratio_over_time(steps, keys, *value, named) if len(value) == 2 else per_second(steps, keys, *value, named)
    by_window = lambda c: F.coalesce(*[F.when(duration_seconds(F.col(c)) == s, F.col(f"w{s}")) for s in windows])
    met = steps.join(rules, keys).withColumns({"long_value": by_window("long_window"), "short_value": by_window("short_window")})
    return met.withColumn("firing", F.coalesce(fires(F.col("long_value")) & fires(F.col("short_value")), F.lit(False)))


def over_budget(value: Column) -> Column:
    """Availability and errors: the mean ratio is above the threshold."""
    return value > F.col("threshold")


def slow(value: Column) -> Column:
    """Latency: the share beyond the agreement is above the threshold."""
    return 1 - value > F.col("threshold")


def starved(value: Column) -> Column:
    """Throughput: below the agreement by the budget burnt."""
    return value < F.col("sla_target") * (1 - F.col("burn_rate") * F.col("error_budget_percent") / 100)


def saturated(value: Column) -> Column:
    """Saturation: above the agreement by the budget burnt."""
    return value > F.col("sla_target") + F.col("burn_rate") * F.col("error_budget_percent") / 100


def summary(rules: DataFrame, keys: tuple[str, ...] = ("service",)) -> DataFrame:
    return rules.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.countDistinct(*keys).alias("services"))


def budgets(targets: DataFrame, drift: DataFrame, keys: list[str]) -> DataFrame:
    """A target burns if a breached indicator of its service has the target's type in its name."""
    breached = drift.filter("band_breach").groupBy(*keys).agg(F.collect_set("name").alias("breached"))
    burning = F.coalesce(F.exists("breached", lambda n: F.contains(n, F.col("sli_type"))), F.lit(False))
    return targets.join(breached, keys, "left").withColumn("budget_status", F.when(burning, "burning").otherwise("healthy")).drop("breached")


def objectives(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an objectives file: for latency the target is the share within the value, for others the value itself."""
    is_latency = F.col("sli_type") == "latency"
    return targets.select(*keys, "sli_name", "sli_type", "target_op", F.when(is_latency, (100 - F.col("error_budget_percent")) / 100).otherwise(F.col("slo_target")).alias("target"), F.when(is_latency, F.col("slo_target")).alias("value"))


def alert_policies(targets: DataFrame, keys: list[str]) -> DataFrame:
    rows = targets.select(*keys, "sli_name", F.inline("burn_windows"))
    return rows.select(*keys, "sli_name", "severity", F.col("burn_rate").alias("threshold"), F.col("long_window").alias("lookback"), F.col("short_window").alias("alert_after"))
