"""Evidence documents: one nested row per service and window, and baselines from them alone.

A document's arrays are bounded by its contract (bounds of a histogram, steps of a window), so indicators are folds over them: no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.folds import deviation_of, mean_of, quantile, rank_of, spread
from tidemark.operators.baseline import INF, bucketize


def bundles(requests: DataFrame, rates: DataFrame, gauges: DataFrame, own: DataFrame, dependencies: DataFrame, categories: DataFrame, keys: list[str], bounds: list[float], namespace: Column, lookback: str, endpoint: str) -> DataFrame:
    """Documents of the evidence contract, one per key: seconds for latencies, the rates and gauges of ``rates`` (hour, rps) and ``gauges`` (day, cpu, mem) in order, what ``own`` (service_p99_ms, service_p50_ms, own_spans), ``dependencies`` (dependency, p99_ms, call_count) and ``categories`` (category, n, ratio) have."""
    nested = lambda df, name, *order: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))
    seconds = F.when(F.col("le") == INF, "+Inf").otherwise((F.col("le") / 1000).cast("string"))
    hist = nested(bucketize(requests, keys, "latency_ms", bounds).withColumn("text", seconds), "buckets", "le", "text", "cum")
    totals = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("bad"), (F.sum("latency_ms") / 1000).alias("sum"), F.count("latency_ms").alias("timed"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    row = totals.join(hist, keys, "left").join(nested(rates, "rates", "hour", "rps"), keys, "left").join(nested(gauges, "gauges", "day", "cpu", "mem"), keys, "left").join(own, keys, "left")
    row = row.join(nested(dependencies, "deps", (-F.col("p99_ms")).alias("m"), "dependency", "p99_ms", "call_count"), keys, "left").join(nested(categories, "cats", (-F.col("ratio")).alias("m"), "category", "n", "ratio"), keys, "left")
    metric = lambda name: F.lit(name).alias("metric_name")
    gauge = lambda name: F.struct(metric(name), F.filter(F.transform("gauges", lambda g: g[name].cast("double")), lambda x: x.isNotNull()).alias("samples"))
    present = lambda condition, s: F.when(condition, s)
    series = F.struct(
        F.struct(metric("request_seconds"), F.transform("buckets", lambda b: F.struct(b["text"].alias("le"), b["cum"].cast("double").alias("count"))).alias("buckets"), F.col("timed").cast("double").alias("total_count"), "sum").alias("latency_histogram"),
        F.struct(metric("requests"), F.col("n").cast("double").alias("total"), F.transform("rates", lambda r: F.struct(r["hour"].cast("timestamp").alias("timestamp"), r["rps"].alias("value"))).alias("rate_samples")).alias("request_total"),
        F.struct(metric("errors"), F.col("bad").cast("double").alias("total")).alias("error_total"),
        present(F.col("gauges").isNotNull(), F.struct(gauge("cpu").alias("cpu"), gauge("mem").alias("memory"), F.lit(True).alias("available"))).alias("saturation"),
        present(F.col("deps").isNotNull(), F.struct(F.lit(True).alias("available"), F.lit("spans").alias("source"), F.col("own_spans").alias("service_spans"), F.col("service_p99_ms").alias("span_latency_p99_ms"), F.col("service_p50_ms").alias("span_latency_p50_ms"), F.transform(F.slice("deps", 1, 5), lambda x: F.struct(x["dependency"].alias("service"), x["p99_ms"].alias("p99_ms"), x["call_count"].alias("call_count"))).alias("top_dependencies"))).alias("traces"),
        present(F.col("cats").isNotNull(), F.struct(F.lit(True).alias("available"), F.lit("logs").alias("source"), F.aggregate("cats", F.lit(0).cast("bigint"), lambda s, c: s + c["n"]).alias("error_entries"), F.transform("cats", lambda c: F.struct(c["category"].alias("category"), c["n"].alias("count"), c["ratio"].alias("ratio"))).alias("error_breakdown"))).alias("logs"),
    )
    provenance = F.struct(F.lit(endpoint).alias("prometheus_endpoint"), F.struct(F.col("a").alias("start"), F.col("b").alias("end")).alias("query_timestamps"), F.create_map(F.lit("latency"), F.lit("request_seconds_bucket"), F.lit("error_total"), F.lit("errors")).alias("queries"))
    filled = F.size(F.filter("rates", lambda r: r["rps"] > 0))
    return row.select(F.lit(2).cast("bigint").alias("schema_version"), *keys, namespace.alias("namespace"), F.lit(lookback).alias("lookback_window"), F.col("b").alias("collected_at"), F.coalesce(F.try_divide(filled, F.size("rates")), F.lit(0.0)).alias("coverage_ratio"), series.alias("series"), provenance.alias("provenance"))


def _first_most(values: Column, by: str) -> Column:
    """The element with the greatest ``by``, of equals the first."""
    return F.aggregate(values, F.try_element_at(values, F.lit(1)), lambda s, x: F.when(x[by] > s[by], x).otherwise(s))


def baselines(documents: DataFrame, keys: list[str]) -> DataFrame:
    """A baseline row per document, with the columns of ``baseline.baseline`` and provenance. What a document lacks is null, or zero where a baseline says so."""
    doc = lambda path: F.col(f"series.{path}")
    buckets, total = doc("latency_histogram.buckets"), doc("latency_histogram.total_count")
    ms = lambda c: c * 1000
    count, bad = F.floor(doc("request_total.total")), F.floor(doc("error_total.total"))
    ratio = F.try_divide(bad, count)
    rates = F.coalesce(F.transform(doc("request_total.rate_samples"), lambda r: r["value"]), F.array().cast("array<double>"))
    gauges = F.coalesce(doc("saturation.available"), F.lit(False))
    cpu, mem = (F.coalesce(doc(f"saturation.{c}.samples"), F.array().cast("array<double>")) for c in ("cpu", "memory"))
    traced, logged = (F.coalesce(doc(f"{c}.available"), F.lit(False)) for c in ("traces", "logs"))
    top, kind = _first_most(doc("traces.top_dependencies"), "p99_ms"), _first_most(doc("logs.error_breakdown"), "ratio")
    own = F.coalesce(doc("traces.span_latency_p99_ms"), F.lit(0.0))
    when = lambda condition, c: F.when(condition, c)
    return documents.select(
        *keys, "namespace", "lookback_window", F.col("collected_at").alias("generated_at"),
        *[ms(quantile(buckets, total, q)).alias(name) for name, q in (("p50_ms", 0.5), ("p90_ms", 0.9), ("p95_ms", 0.95), ("p99_ms", 0.99))], ms(spread(buckets, total, doc("latency_histogram.sum"))).alias("stddev_ms"), total.cast("bigint").alias("sample_count"),
        ratio.alias("error_ratio"), F.sqrt(F.try_divide(ratio * (1 - ratio), count)).alias("error_stddev"), bad.alias("error_count"), count.alias("total_count"), (1 - ratio).alias("availability"),
        mean_of(rates).alias("mean_rps"), rank_of(rates, 0.95).alias("p95_rps"), deviation_of(rates).alias("stddev_rps"), F.size(rates).cast("bigint").alias("rate_samples"),
        *[when(gauges, f).alias(name) for name, f in (("cpu_mean_ratio", mean_of(cpu)), ("cpu_p95_ratio", rank_of(cpu, 0.95)), ("memory_mean_ratio", mean_of(mem)), ("memory_p95_ratio", rank_of(mem, 0.95)))], gauges.alias("saturation_available"),
        when(traced, own).alias("service_p99_ms"), when(traced, F.coalesce(top["service"], F.lit("unknown"))).alias("top_dependency"), when(traced, F.coalesce(top["p99_ms"], F.lit(0.0))).alias("top_dependency_p99_ms"),
        when(traced, F.coalesce(F.when(own > 0, F.try_divide(top["p99_ms"], own)), F.lit(0.0))).alias("top_dependency_contribution"), traced.alias("trace_available"),
        when(logged, F.coalesce(kind["category"], F.lit("unknown"))).alias("top_category"), when(logged, F.coalesce(kind["ratio"], F.lit(0.0))).alias("top_category_ratio"), when(logged, F.coalesce(F.size(doc("logs.error_breakdown")), F.lit(0))).alias("categories"), logged.alias("breakdown_available"),
        "coverage_ratio", "provenance",
    )


def baseline_documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``baselines`` as nested documents of the baseline contract."""
    part = lambda available, *columns: F.when(F.col(available), F.struct(*columns, F.lit(True).alias("available")))
    query = lambda name: F.coalesce(F.col("provenance.queries")[name], F.lit("")).alias("source_query")
    indicators = F.struct(
        F.struct("p50_ms", "p90_ms", "p95_ms", "p99_ms", "stddev_ms", "sample_count", query("latency")).alias("latency"),
        F.struct(F.col("error_ratio").alias("ratio"), F.col("error_stddev").alias("stddev"), "error_count", "total_count", query("error_total")).alias("error_rate"),
        F.struct(F.col("availability").alias("ratio"), F.lit("1 - (error_count / total_count)").alias("definition")).alias("availability"),
        F.struct("mean_rps", "p95_rps", "stddev_rps", F.col("rate_samples").alias("sample_count")).alias("throughput"),
        part("saturation_available", "cpu_mean_ratio", "cpu_p95_ratio", "memory_mean_ratio", "memory_p95_ratio").alias("saturation"),
        part("trace_available", "service_p99_ms", "top_dependency", "top_dependency_p99_ms", "top_dependency_contribution").alias("trace_latency"),
        part("breakdown_available", "top_category", "top_category_ratio", "categories").alias("error_breakdown"),
    )
    provenance = F.struct("provenance.prometheus_endpoint", "provenance.query_timestamps", "coverage_ratio")
    return rows.select(F.lit(1).cast("bigint").alias("schema_version"), *keys, "namespace", "lookback_window", "generated_at", indicators.alias("indicators"), provenance.alias("provenance"))
