"""Where a baseline comes from and how far to trust it: rows, span of time and coverage by key, staleness, and what a write has seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Coverage under the first fails, under the second warns; a baseline older than so many days is stale. A band is widened by so much where coverage warns.
FAILS, WARNS, STALE_DAYS, WIDER = 0.5, 0.9, 90, 1.5


def coverage_status(ratio: Column) -> Column:
    """``fail``, ``warn`` or ``ok``; without a ratio ``fail``."""
    return F.when(F.coalesce(ratio, F.lit(0.0)) < FAILS, "fail").when(ratio < WARNS, "warn").otherwise("ok")


def sources(samples: DataFrame, keys: list[str], source: str, step: int, ts: str = "ts") -> DataFrame:
    """Per key: rows, first and last time, the share of the steps between a window's ends (those of ``keys`` but the first) that hold a row, and the name of the source."""
    at = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / step)
    own = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_rows"), F.min(ts).cast("timestamp").alias("first_ts"), F.max(ts).cast("timestamp").alias("last_ts"), F.countDistinct(at).alias("_steps"))
    # The window's length is that of all services together: a row per window.
    ends = samples.groupBy(*keys[1:]).agg((F.max(at) - F.min(at) + 1).alias("_all"))
    both = own.join(ends, keys[1:]) if keys[1:] else own.crossJoin(F.broadcast(ends))
    return both.select(*keys, "source_rows", "first_ts", "last_ts", F.try_divide("_steps", "_all").alias("coverage_ratio"), F.lit(source).alias("source"))


def judged(expected: DataFrame, found: DataFrame, keys: list[str], now: str) -> DataFrame:
    """Every expected key with its provenance: status (``no_data``, ``stale`` or ``ok``), coverage_status, band_multiplier and baseline_age_days at ``now``. What has no row has no age."""
    rows = expected.join(found, keys, "left")
    age = F.datediff(F.to_date(F.lit(now)), F.to_date("last_ts"))
    status = F.when(F.coalesce("source_rows", F.lit(0)) == 0, "no_data").when(age > STALE_DAYS, "stale").otherwise("ok")
    cover = coverage_status(F.col("coverage_ratio"))
    return rows.withColumns({"source_rows": F.coalesce("source_rows", F.lit(0)), "status": status, "coverage_status": cover, "band_multiplier": F.when(cover == "warn", WIDER).otherwise(1.0), "baseline_age_days": age})


RUNS = "name string, path string, rows long, keys_without_data long, first_ts timestamp, last_ts timestamp, coverage double"


def write_observed(rows: DataFrame, path: str, name: str, log: str) -> dict:
    """Writes ``rows`` (of ``judged``) and, from metrics that the same pass has observed, a row of the run log; gives that row. No second scan."""
    seen = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "no_data").alias("keys_without_data"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.avg("coverage_ratio").alias("coverage")]
    rows.observe(seen, *metrics).write.mode("overwrite").parquet(path)
    row = {"name": name, "path": path, **seen.get}
    spark = rows.sparkSession
    columns = [c.split()[0] for c in RUNS.split(", ")]
    spark.createDataFrame([tuple(row[c] for c in columns)], RUNS).coalesce(1).write.mode("append").parquet(log)
    return row
