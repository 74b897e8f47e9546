"""Operators on sample series (keys, ts, value): steps, resets, rates, rolling means, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks


def step_seconds(lookback: int) -> int:
    """About 500 steps of a minute at least."""
    return max(lookback // 500, 60)


def epoch(ts: str = "ts") -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def align(samples: DataFrame, keys: list[str], start: str, end: str, step: int, stale: int = 300, tie: list[str] | None = None) -> DataFrame:
    """The last sample at or before each step of a grid, null where it is older than ``stale`` seconds: an as-of join in time blocks."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    at = F.col("ts").cast("timestamp").cast("double")
    grid = samples.select(*keys).distinct().select(*keys, F.explode(F.sequence(lo, hi, F.expr(f"make_dt_interval(0, 0, 0, {step})"))).alias("ts"))
    seen = samples.withColumn("_at", at).filter((F.col("_at") >= lo.cast("double") - stale) & (F.col("_at") <= hi.cast("double")))
    aligned = blocks.as_of(seen, grid.withColumn("_at", at), keys, ["_at", *(tie or [])], ["value"], "_row", stale, "_at")
    return aligned.select(*keys, "ts", F.col("_row.value").alias("value"))


def coverage(samples: DataFrame, keys: list[str], kind: str, kinds: tuple[str, ...], lookback: int) -> DataFrame:
    """Points of the given kinds as a share of those expected, one at most; and the share of steps that hold any."""
    step = step_seconds(lookback)
    expected = lookback / step
    points = F.sum(F.when(F.col(kind).isin(*kinds), 1).otherwise(0))
    steps = F.countDistinct(F.floor(epoch() / step))
    return samples.groupBy(*keys).agg(F.least(points / (expected * len(kinds)), F.lit(1.0)).alias("coverage"), (steps / expected).alias("step_coverage"))


def deltas(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a counter gained since its previous sample (``order`` begins with its time); after a reset it gained its value."""
    rows = blocks.previous(samples.withColumn("_epoch", epoch(order[0])), keys, order, "value", "_was", "_epoch")
    previous = F.col("_was")
    gained = F.when(previous.isNull(), 0.0).when(F.col("value") < previous, F.col("value")).otherwise(F.col("value") - previous)
    return rows.withColumn("delta", gained).select(*samples.columns, "delta")


def increase(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return deltas(samples, keys, order).groupBy(*keys).agg(F.sum("delta").alias("increase"))


def rate(samples: DataFrame, keys: list[str], order: list[str], seconds: int) -> DataFrame:
    """Gain per second over the last ``seconds`` at each sample, the ends not extrapolated."""
    rows = deltas(samples, keys, order).withColumn("epoch", epoch(order[0]))
    return blocks.framed(rows, keys, {"rate": (seconds, F.sum("delta"))}).withColumn("rate", F.col("rate") / seconds)


def last_value(samples: DataFrame, series: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """A counter's total per key: the last value of each series, summed."""
    last = samples.groupBy(*keys, *series).agg(F.max_by("value", F.struct(*order)).alias("value"))
    return last.groupBy(*keys).agg(F.sum("value").alias("total"))


def over_time(df: DataFrame, keys: list[str], value: str, windows: dict[str, int]) -> DataFrame:
    """Means of the last so many seconds at each row, its own time included: ``windows`` gives each one's name and length."""
    sums = {f"_{part}_{name}": (seconds - 1, c) for name, seconds in windows.items() for part, c in (("s", F.sum(F.col(value).cast("double"))), ("n", F.count(value)))}
    out = blocks.framed(df, keys, sums).withColumns({name: F.try_divide(f"_s_{name}", f"_n_{name}") for name in windows})
    return out.drop(*sums)


def ratio_over_time(df: DataFrame, keys: list[str], hits: str, total: str, windows: dict[str, int]) -> DataFrame:
    """Hits over rows of the last so many seconds at each step, its own time included."""
    sums = {f"_{part}_{name}": (seconds - 1, F.sum(c)) for name, seconds in windows.items() for part, c in (("h", hits), ("t", total))}
    out = blocks.framed(df, keys, sums).withColumns({name: F.try_divide(f"_h_{name}", f"_t_{name}") for name in windows})
    return out.drop(*sums)


def per_second(df: DataFrame, keys: list[str], count: str, windows: dict[str, int]) -> DataFrame:
    """Rows of the last so many seconds over those seconds at each step, its own time included."""
    out = blocks.framed(df, keys, {name: (seconds - 1, F.sum(count)) for name, seconds in windows.items()})
    return out.withColumns({name: F.col(name) / seconds for name, seconds in windows.items()})


def ratio_per_step(rows: DataFrame, keys: list[str], step: int, good: Column) -> DataFrame:
    """Rows, good rows and their ratio per step: both sides of a matched ratio in one pass."""
    at = (F.floor(epoch() / step) * step).alias("epoch")
    counted = rows.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("hits"))
    return counted.withColumn("ratio", F.try_divide("hits", "n"))
