"""Objectives and agreements from a baseline, and checks of given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Direction by type of indicator, and margins in standard deviations by maturity.
OPERATORS = {"latency": "lte", "error_rate": "lte", "saturation": "lte", "availability": "gte", "throughput": "gte"}
MARGINS = {"new": (2.0, 3.0), "growing": (1.0, 2.0), "mature": (0.5, 1.0)}
# Fixed values: (long window, short window, burn rate, severity).
BURN_WINDOWS = (("1h", "5m", 14.4, "critical"), ("6h", "30m", 6.0, "warning"))
LOOSEST = 5.0


def operator_of(sli_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in OPERATORS.items() for x in pair])[sli_type]


def observed(baselines: DataFrame, keys: list[str], saturation: bool = False) -> DataFrame:
    """(keys, sli_type, sli_name, observed, sd): availability takes the errors' spread, saturation none."""
    one = lambda kind, name, value, sd: F.struct(F.lit(kind).alias("sli_type"), F.lit(name).alias("sli_name"), F.col(value).cast("double").alias("observed"), sd.cast("double").alias("sd"))
    rows = [one("latency", "latency_p99", "p99_ms", F.col("stddev_ms")), one("error_rate", "error_rate", "error_ratio", F.col("error_stddev")), one("availability", "availability", "availability", F.col("error_stddev")), one("throughput", "throughput", "mean_rps", F.col("stddev_rps"))]
    if saturation:
        rows += [one("saturation", "cpu", "cpu_mean_ratio", F.lit(None)), one("saturation", "memory", "memory_mean_ratio", F.lit(None))]
    return baselines.select(*keys, F.inline(F.array(*rows)))


def margins(maturity: Column, end: int) -> Column:
    return F.coalesce(*[F.when(maturity == m, F.lit(x[end])) for m, x in MARGINS.items()])


def propose(seen: DataFrame, maturity: Column, slo_sds: float = 0.75) -> DataFrame:
    """Targets of each observed indicator: the objective tighter by part of a spread, the agreement looser by the maturity's margin.

    Without spread the margins are shares of the value. Perfect availability gets practical defaults, indicators that are zero none.
    """
    seen = seen.filter(F.col("observed") != 0).withColumn("maturity_tier", maturity).withColumn("target_op", operator_of(F.col("sli_type")))
    sign = F.when(F.col("target_op") == "lte", 1.0).otherwise(-1.0)
    spread = F.coalesce(F.col("sd") > 0, F.lit(False))
    flat = lambda lte, gte: F.col("observed") * F.when(F.col("target_op") == "lte", lte).otherwise(gte)
    lo, hi = margins(F.col("maturity_tier"), 0), margins(F.col("maturity_tier"), 1)
    off = lambda n: F.col("observed") + sign * n * F.col("sd")
    perfect = (F.col("sli_type") == "availability") & (F.col("observed") == 1.0)
    pick = lambda whole, spreaded, share: F.when(perfect, whole).when(spread, spreaded).otherwise(share)
    out = seen.withColumns({
        "slo_target": pick(0.999, off(F.lit(-slo_sds)), flat(0.85, 1.15)), "sla_lo": pick(0.995, off(lo), flat(1.5, 0.7)), "sla_hi": pick(0.995, off(hi), flat(1.5, 0.7)), "sla_target": pick(0.995, off((lo + hi) / 2), flat(1.5, 0.7)),
    })
    reason = F.when(perfect, "practical default").when(spread, "standard deviations").otherwise("share of observed")
    out = out.withColumn("headroom", F.struct(F.col("observed").alias("observed_value"), F.abs(F.col("sla_target") - F.col("observed")).alias("margin"), reason.alias("margin_rationale")))
    return out.withColumn("error_budget_percent", error_budget(F.col("sli_type"), F.col("sla_target"))).withColumn("burn_windows", burn_windows())


def error_budget(sli_type: Column, sla: Column, other: float = 0.5) -> Column:
    """Percent of a budget; for latency, throughput and saturation a parameter."""
    value = F.when(sli_type == "availability", (1 - sla) * 100).when(sli_type == "error_rate", sla * 100).otherwise(other)
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))


def burn_windows() -> Column:
    return F.array(*[F.struct(F.lit(a).alias("long_window"), F.lit(b).alias("short_window"), F.lit(r).alias("burn_rate"), F.lit(s).alias("severity")) for a, b, r, s in BURN_WINDOWS])


def is_tighter(op: Column, target: Column, seen: Column) -> Column:
    return F.when(op == "lte", target < seen).otherwise(target > seen)


def looseness(op: Column, target: Column, seen: Column, sd: Column) -> Column:
    """How many standard deviations a target lies on the loose side of what is observed."""
    return F.try_divide(F.when(op == "lte", target - seen).otherwise(seen - target), F.nullif(sd, F.lit(0.0)))


def check(targets: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``violations`` to rows (sli_type, target_op, slo_target, sla_target, observed, sd).

    A wrong operator is judged first. A value at its limit (nothing better is possible) is judged no further; unless ``strict``, a throughput of 1 counts as such.
    """
    op = F.coalesce(operator_of(F.col("sli_type")), F.lit("lte"))
    slo, sla, seen, sd = (F.col(c) for c in ("slo_target", "sla_target", "observed", "sd"))
    limit = ((op == "gte") & (seen >= 1.0)) | ((op == "lte") & (seen <= 0))
    if strict:
        limit = limit & (F.col("sli_type") != "throughput")
    judged = seen.isNotNull() & ~limit
    crossed = F.when(op == "lte", slo >= sla).otherwise(slo <= sla)
    rules = [
        (operator_of(F.col("sli_type")).isNotNull() & (F.col("target_op") != op), "wrong_op"),
        (judged & ~is_tighter(op, slo, seen), "slo_not_tighter"),
        (judged & is_tighter(op, sla, seen), "sla_tighter"),
        (judged & (slo == seen), "slo_equals_observed"),
        (judged & (sla == seen), "sla_equals_observed"),
        (judged & (sd > 0) & (looseness(op, sla, seen, sd) > LOOSEST), "too_loose"),
        (judged & crossed, "wrong_order"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rules]), lambda x: x.isNotNull())
    return targets.withColumn("violations", found)


def quality(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Per proposal: both targets leave a margin everywhere; every operator fits its type."""
    margin = (F.col("slo_target") != F.col("observed")) & (F.col("sla_target") != F.col("observed"))
    direction = F.col("target_op") == operator_of(F.col("sli_type"))
    return targets.groupBy(*keys).agg(F.bool_and(F.coalesce(margin, F.lit(True))).alias("margin_ok"), F.bool_and(F.coalesce(direction, F.lit(True))).alias("direction_ok"))
