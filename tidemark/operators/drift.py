"""Drift of a live window against the stored baseline, for all services: bands, breaches, classes, dominant signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 2.0
# What a relative deviation is taken from at least, by unit.
EPSILON = {"ratio": 0.001, "ms": 1.0, "rps": 0.01}
NONE = "no_significant_drift"
# Category of remedy by report class.
REMEDIES = {
    "latency_regression": "performance",
    "latency_improvement": "monitoring",
    "error_rate_elevation": "reliability",
    "error_rate_reduction": "monitoring",
    "throughput_collapse": "capacity",
    "throughput_surge": "capacity",
    "saturation_approach": "capacity",
    "availability_drop": "reliability",
    "distribution_shift": "performance",
    "no_significant_drift": "none",
}
#: Severity by magnitude above these; a table, as rubrics differ.
SEVERITIES = ((10.0, "critical"), (5.0, "high"), (2.0, "medium"), (0.0, "low"))
IMPROVED = ("latency_improvement", "error_rate_reduction")


def indicators(baselines: DataFrame, keys: list[str]) -> DataFrame:
    """A baseline row as one row per indicator, in fixed order, with the spread that its band takes."""
    share = lambda c, part, least: f"if({c} > 0, {c} * {part}D, {least}D)"
    rows = (
        # name, column, spread, unit, available, core
        ("latency_p99_ms", "p99_ms", "stddev_ms", "ms", "p99_ms is not null", True),
        ("latency_p50_ms", "p50_ms", "stddev_ms", "ms", "p50_ms is not null", True),
        ("error_rate_ratio", "error_ratio", "error_stddev", "ratio", "error_ratio is not null", True),
        ("availability_ratio", "availability", "error_stddev", "ratio", "availability is not null", True),
        ("throughput_mean_rps", "mean_rps", "stddev_rps", "rps", "mean_rps is not null", True),
        ("cpu_mean_ratio", "cpu_mean_ratio", "0.1D", "ratio", "saturation_available", False),
        ("memory_mean_ratio", "memory_mean_ratio", "0.1D", "ratio", "saturation_available", False),
        ("dependency_p99_ms", "top_dependency_p99_ms", share("top_dependency_p99_ms", 0.2, 10.0), "ms", "trace_available", False),
        ("error_top_category_ratio", "top_category_ratio", share("top_category_ratio", 0.1, 0.05), "ratio", "breakdown_available", False),
    )
    structs = [f"struct({i} as ord, '{name}' as name, double({value}) as value, double({sd}) as sd, '{unit}' as unit, {available} as available, {core} as core)" for i, (name, value, sd, unit, available, core) in enumerate(rows, 1)]
    return baselines.select(*keys, F.expr(f"inline(array({', '.join(structs)}))"))


def first_pass(name: Column, direction: Column, breach: Column) -> Column:
    """A class by the indicator's name, tried in order."""
    up, down = direction == "increasing", direction == "decreasing"
    named = lambda *parts: name.rlike("|".join(parts))
    cases = (
        (named("dependency"), F.when(up, "dependency_latency_regression").otherwise(NONE)),
        (named("category", "breakdown"), F.lit("error_category_shift")),
        (named("latency"), F.when(up, "latency_regression").otherwise("latency_improvement")),
        (named("error"), F.when(up, "error_rate_elevation").otherwise("error_rate_reduction")),
        (named("throughput"), F.when(down, "throughput_collapse").otherwise("throughput_surge")),
        (named("cpu", "memory", "saturation"), F.when(up, "saturation_approach").otherwise(NONE)),
        (named("availability"), F.when(down, "availability_drop").otherwise(NONE)),
    )
    found = F.when(~breach, NONE)
    for condition, value in cases:
        found = found.when(condition, value)
    return found.otherwise(NONE)


def deviation(pairs: DataFrame, live: str = "live_value", base: str = "baseline_value", sd: str = "sd", unit: str = "unit", band: float = BAND) -> DataFrame:
    """abs_deviation, rel_deviation, direction, band_upper, band_lower, band_breach, breach_magnitude; an infinite magnitude where the band has no width."""
    epsilon = F.coalesce(*[F.when(F.col(unit) == u, F.lit(e)) for u, e in EPSILON.items()], F.lit(0.001))
    diff = F.col(live) - F.col(base)
    df = pairs.withColumns({"abs_deviation": F.abs(diff), "rel_deviation": diff / F.greatest(F.abs(F.col(base)), epsilon), "band_upper": F.col(base) + band * F.col(sd), "band_lower": F.col(base) - band * F.col(sd)})
    df = df.withColumn("direction", F.when(F.abs(diff) < epsilon * 0.01, "stable").when(diff > 0, "increasing").otherwise("decreasing"))
    df = df.withColumn("band_breach", (F.col(live) > F.col("band_upper")) | (F.col(live) < F.col("band_lower")))
    half = (F.col("band_upper") - F.col("band_lower")) / 2
    size = F.when(half > 0, F.when(F.col("band_breach"), F.col("abs_deviation") / F.nullif(half, F.lit(0.0))).otherwise(0.0)).otherwise(F.when(F.col("abs_deviation") > 0, float("inf")).otherwise(0.0))
    return df.withColumn("breach_magnitude", size)


def drift_indicators(live: DataFrame, base: DataFrame, keys: list[str], band: float = BAND) -> DataFrame:
    """Drift of one table of baseline rows against another one."""
    b = indicators(base, keys).select(*keys, "ord", "name", F.col("value").alias("baseline_value"), "sd", "unit", F.col("available").alias("b_ok"), "core")
    now = indicators(live, keys).select(*keys, "ord", F.col("value").alias("live_value"), F.col("available").alias("l_ok"))
    return judged(b.join(now, [*keys, "ord"], "left"), keys, band)


def drift_of_windows(baselines: DataFrame, keys: list[str], window: str, live: str, stored: str, band: float = BAND) -> DataFrame:
    """The same from one table that has both windows, told apart by ``window``: read once, its rows paired by an aggregate."""
    rows = indicators(baselines, [*keys, window])
    part = lambda w, *columns: F.max(F.when(F.col(window) == w, F.struct(*columns)))
    both = rows.groupBy(*keys, "ord", "name", "unit", "core").agg(part(stored, "value", "sd", "available").alias("b"), part(live, "value", "available").alias("l")).filter("b is not null")
    pairs = both.select(*keys, "ord", "name", F.col("b.value").alias("baseline_value"), F.col("b.sd").alias("sd"), "unit", F.col("b.available").alias("b_ok"), "core", F.col("l.value").alias("live_value"), F.col("l.available").alias("l_ok"))
    return judged(pairs, keys, band)


def judged(pairs: DataFrame, keys: list[str], band: float = BAND) -> DataFrame:
    """One row per key and indicator of the baseline. Core indicators and saturation that the live window lacks are skipped, with zeros; other ones leave no row."""
    pairs = pairs.withColumn("measured", F.coalesce(F.col("b_ok") & F.col("l_ok"), F.lit(False)))
    skips = F.col("core") | (F.col("b_ok") & F.col("name").isin("cpu_mean_ratio", "memory_mean_ratio"))
    pairs = pairs.filter(F.col("measured") | skips)
    out = deviation(pairs, band=band)
    out = out.withColumn("first_pass_class", first_pass(F.col("name"), F.col("direction"), F.col("band_breach")))
    measured = F.col("measured")
    zero = lambda c: F.when(measured, F.col(c)).otherwise(0.0)
    out = out.withColumns({c: zero(c) for c in ("live_value", "abs_deviation", "rel_deviation", "band_upper", "band_lower", "breach_magnitude")})
    reason = F.when(~measured, F.when(F.col("core"), "unmeasured").otherwise("live_gauges_absent"))
    out = out.withColumns({"baseline_value": F.coalesce("baseline_value", F.lit(0.0)), "direction": F.when(measured, F.col("direction")).otherwise("stable"), "band_breach": F.when(measured, F.col("band_breach")).otherwise(False), "first_pass_class": F.when(measured, F.col("first_pass_class")).otherwise(NONE), "status": F.when(measured, "measured").otherwise("skipped"), "skip_reason": reason})
    return out.select(*keys, "ord", "name", "live_value", "baseline_value", "abs_deviation", "rel_deviation", "direction", "band_upper", "band_lower", "band_breach", "breach_magnitude", "first_pass_class", "status", "skip_reason")


def drift_signal(drift: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: breached indicators by falling magnitude, the first of them dominant. Magnitudes are compared rounded, so float noise decides no tie."""
    rank = F.struct((-F.round("breach_magnitude", 9)).alias("m"), "ord", "name", "first_pass_class", "breach_magnitude")
    breached = F.array_sort(F.collect_list(F.when(F.col("band_breach"), rank)))
    row = drift.groupBy(*keys).agg(breached.alias("b"), F.count(F.lit(1)).alias("indicators"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    top = F.try_element_at("b", F.lit(1))
    return row.select(
        *keys, "indicators", "skipped", F.coalesce(top["name"], F.lit("none")).alias("dominant_indicator"), F.coalesce(top["first_pass_class"], F.lit(NONE)).alias("dominant_class"), F.coalesce(top["breach_magnitude"], F.lit(0.0)).alias("dominant_magnitude"),
        F.transform("b", lambda x: x["name"]).alias("all_breached_indicators"), F.array_distinct(F.transform("b", lambda x: x["first_pass_class"])).alias("breached_classes"),
    )


def _mapped(c: Column) -> Column:
    return F.when(c == "dependency_latency_regression", "latency_regression").when(c == "error_category_shift", "error_rate_elevation").otherwise(c)


def report_class(signal: DataFrame) -> DataFrame:
    """The class of a report: refined classes mapped, a category shift with other breaches a distribution shift."""
    several = F.size(F.filter(F.array_distinct(F.transform("breached_classes", _mapped)), lambda c: c != NONE)) > 1
    shift = F.col("dominant_class") == "error_category_shift"
    return signal.withColumn("report_class", F.when(shift & several, "distribution_shift").otherwise(_mapped(F.col("dominant_class"))))


def severity(magnitude: Column, cls: Column, table: tuple[tuple[float, str], ...] = SEVERITIES) -> Column:
    found = F.when(cls.isin(*IMPROVED, NONE), "info")
    for above, name in table:
        found = found.when(magnitude > above, name)
    return found.otherwise("info")


def patterns(drift: DataFrame, keys: list[str]) -> DataFrame:
    """Which known patterns the breaches form."""
    hit = lambda name, direction=None: F.coalesce(F.bool_or((F.col("name") == name) & F.col("band_breach") & (F.lit(True) if direction is None else F.col("direction") == direction)), F.lit(False))
    up99, up50 = hit("latency_p99_ms", "increasing"), hit("latency_p50_ms")
    return drift.groupBy(*keys).agg(
        (up99 & ~up50).alias("tail_only"), (up99 & hit("throughput_mean_rps", "decreasing")).alias("capacity_saturation"), (up99 & hit("error_rate_ratio", "increasing")).alias("upstream_failure"), (hit("dependency_p99_ms", "increasing") & ~up50).alias("dependency_isolated"),
    )


def promotions(signal: DataFrame, live_targets: DataFrame, keys: list[str]) -> DataFrame:
    """Services that drifted to the better or not at all, with targets from their live values."""
    fine = signal.filter(F.col("dominant_class").isin(*IMPROVED, NONE)).select(*keys, "dominant_class")
    return fine.join(live_targets, keys)


def remedy(cls: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in REMEDIES.items() for x in pair])[cls]
