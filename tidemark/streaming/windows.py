"""Streaming indicators, drift and recording rules by event-time windows; late rows are dropped by the watermark and their number goes on record.

``keys`` name a service: its name, or namespace and name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.functions.folds import quantile
from tidemark.operators.drift import deviation, drift_signal, first_pass, report_class, severity

#: Upper bounds of latency buckets in milliseconds; a window's state is a count for each.
BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


SERVICE = ("service",)


def _timed(rows: DataFrame, late: str) -> DataFrame:
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def stream_indicators(requests: DataFrame, length: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes", bounds: tuple[float, ...] = BOUNDS, keys: Sequence[str] = SERVICE) -> DataFrame:
    """Sliding live windows per service: count, error ratio, p99 and p50 interpolated in buckets, as the baseline's are. Works on a stream and on a batch alike.

    The state of a window is a few sums and a count for each bound, however many rows it has; percentiles are taken when it is handed out.
    """
    window = F.window("ts", length, slide)
    upto = [F.count_if(F.col("latency_ms") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    out = _timed(requests, late).groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("timed"), F.avg(F.col("is_error").cast("double")).alias("error_ratio"), *upto)
    bucket = lambda le, count: F.struct(F.lit(le).alias("le"), F.col(count).cast("double").alias("count"))
    buckets = F.array(*[bucket(repr(b), f"b{i}") for i, b in enumerate(bounds)], bucket("+Inf", "timed"))
    p: dict[str, Column] = {name: quantile(buckets, F.col("timed"), q) for name, q in (("p99_ms", 0.99), ("p50_ms", 0.5))}
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "error_ratio", *[c.alias(name) for name, c in p.items()])


def stream_record(requests: DataFrame, targets: DataFrame | None = None, late: str = "10 minutes", length: str = "5 minutes", keys: Sequence[str] = SERVICE) -> DataFrame:
    """Tumbling recording rules: requests per second, error ratio and, with ``targets`` (keys, sla_target; a table), the share within the agreement.

    A service without a target has no such share; requests without a latency count as beyond it.
    """
    rows = _timed(requests, late)
    rows = rows.join(targets, list(keys), "left") if targets is not None else rows.withColumn("sla_target", F.lit(None).cast("double"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    good = F.when(F.col("sla_target").isNotNull(), F.coalesce(F.col("latency_ms") <= F.col("sla_target"), F.lit(False)).cast("double"))
    out = rows.groupBy(*keys, F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_error").cast("double")).alias("error_ratio"), F.avg(good).alias("good_ratio"))
    return out.select(*keys, F.col("w.start").alias("window_start"), (F.col("n") / seconds).alias("rps"), "error_ratio", "good_ratio")


def stream_cpu(gauges: DataFrame, late: str = "10 minutes", length: str = "5 minutes", keys: Sequence[str] = SERVICE) -> DataFrame:
    """The recording rule of utilization, over a stream of gauges: mean of each window's samples; a window without one leaves no row."""
    rows = _timed(gauges, late).filter(F.col("cpu").isNotNull())
    out = rows.groupBy(*keys, F.window("ts", length).alias("w")).agg(F.avg("cpu").alias("cpu"))
    return out.select(*keys, F.col("w.start").alias("window_start"), "cpu")


def stream_drift(windows: DataFrame, base: DataFrame, keys: Sequence[str] = SERVICE) -> DataFrame:
    """Each window's indicators against the stored baseline (keys, p99_ms, p50_ms, stddev_ms, error_ratio, error_stddev, availability, mean_rps, stddev_rps): one row per window and indicator.

    A join of a stream with a table, or of two tables; what rates and gauges a stream of requests lacks leaves no row.
    """
    named = (  # ord, name, live, baseline, spread, unit
        (1, "latency_p99_ms", "p99_ms", "p99_ms", "stddev_ms", "ms"), (2, "latency_p50_ms", "p50_ms", "p50_ms", "stddev_ms", "ms"), (3, "error_rate_ratio", "error_ratio", "error_ratio", "error_stddev", "ratio"),
        (4, "availability_ratio", "availability", "availability", "error_stddev", "ratio"), (5, "throughput_mean_rps", "rps", "mean_rps", "stddev_rps", "rps"),
    )
    rows = windows.withColumns({"availability": 1 - F.col("error_ratio"), "rps": F.col("n") / (F.unix_timestamp("window_end") - F.unix_timestamp("window_start"))})
    stored = base.select(*keys, F.struct(*[c for c in base.columns if c not in keys]).alias("b"))
    one = lambda o, name, live, was, sd, unit: F.struct(F.lit(o).alias("ord"), F.lit(name).alias("name"), F.col(live).alias("live_value"), F.col("b")[was].alias("baseline_value"), F.col("b")[sd].alias("sd"), F.lit(unit).alias("unit"))
    rows = rows.join(stored, list(keys)).select(*keys, "window_start", "window_end", F.inline(F.array(*[one(*x) for x in named])))
    return deviation(rows).withColumns({"first_pass_class": first_pass(F.col("name"), F.col("direction"), F.col("band_breach")), "status": F.lit("measured")})


def window_signals(windows: DataFrame, base: DataFrame, keys: Sequence[str] = SERVICE) -> DataFrame:
    """One row per service and window of a batch: its breached indicators, the dominant one, the class and severity of a report."""
    signal = report_class(drift_signal(stream_drift(windows, base, keys), [*keys, "window_start", "window_end"]))
    return signal.withColumn("severity", severity(F.col("dominant_magnitude"), F.col("report_class")))


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is closed to a Parquet table, once through what is there."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_batches(stream: DataFrame, save, checkpoint: str) -> StreamingQuery:
    """Hands each batch and its number to ``save``; a batch may come again after a failure, so ``save`` replaces what it wrote under that number."""
    return stream.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RUN_LOG = "query string, batch long, rows long, dropped long, state_rows long, watermark string"


class RunLog(StreamingQueryListener):
    """Writes a row for each batch of a named query: rows read, rows that the watermark dropped, rows of state, the watermark.

    Spark counts what is dropped after it has summed within a task: late rows of one key, window and task count as one. A batch that ends without progress leaves no row; a folder of
    the batch's number is replaced if the batch comes again.
    """

    def __init__(self, spark: SparkSession, name: str, path: str) -> None:
        self.spark, self.name, self.path = spark, name, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.name:
            row = (p.name, p.batchId, p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators), sum(s.numRowsTotal for s in p.stateOperators), p.eventTime.get("watermark"))
            self.spark.createDataFrame([row], RUN_LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={p.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def run_logged(spark: SparkSession, stream: DataFrame, name: str, out: str, checkpoint: str, log: str) -> None:
    """``run_to_table`` to its end, with a run log at ``log``."""
    listener = RunLog(spark, name, log)
    spark.streams.addListener(listener)
    try:
        stream.writeStream.queryName(name).outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
