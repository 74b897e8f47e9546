"""Baselines of all services at once: histogram percentiles and spread, errors, throughput, saturation, dependencies, error categories.

``keys`` are the columns that name a service and window. Exact percentiles count equal values first and sort only the
values near the rank that is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import blocks

INF = float("inf")


def bucketize(rows: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts (keys, le, cum) of raw values: each row to its first bucket, counted, then a running sum over the bounds."""
    first = F.coalesce(*[F.when(F.col(value) <= b, F.lit(b)) for b in bounds if b < INF], F.lit(INF))
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, first.alias("le")).agg(F.count(F.lit(1)).alias("n"))
    # One row per key, and one per bound of each.
    packed = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("le", "n"))).alias("m"))
    every = packed.select(*keys, "m", F.explode(F.array(*[F.lit(float(b)) for b in bounds])).alias("le"))
    running = Window.partitionBy(*keys).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return every.select(*keys, "le", F.sum(F.coalesce(F.try_element_at("m", F.col("le")), F.lit(0))).over(running).alias("cum"))


def assemble(samples: DataFrame, keys: list[str], series: list[str], order: str = "ts") -> DataFrame:
    """A histogram from bucket counters: the last count of each series and bound, summed over series; bounds that are no number go."""
    last = samples.withColumn("le", F.col("le").try_cast("double")).filter("le is not null").groupBy(*keys, *series, "le").agg(F.max_by("value", order).alias("value"))
    return last.groupBy(*keys, "le").agg(F.sum("value").alias("cum"))


def _buckets(h: DataFrame, keys: list[str]) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy("le")
    previous = lambda c: F.coalesce(F.lag(c).over(ordered), F.lit(0.0))
    return h.withColumn("pc", previous("cum")).withColumn("pb", previous("le")).withColumn("total", F.max("cum").over(Window.partitionBy(*keys)))


def _quantile(q: float) -> Column:
    finite, rank = F.col("le") < INF, F.lit(q) * F.col("total")
    part = F.when(F.col("cum") <= F.col("pc"), 0.0).otherwise((rank - F.col("pc")) / F.nullif(F.col("cum") - F.col("pc"), F.lit(0)))
    value = F.col("pb") + part * (F.col("le") - F.col("pb"))
    hit = F.min_by(F.when(finite & (F.col("cum") >= rank), value), F.when(finite & (F.col("cum") >= rank), F.col("le")))
    return F.coalesce(hit, F.max(F.when(finite, F.col("le"))), F.lit(0.0))


def hist_quantiles(h: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Interpolated percentiles in one pass over the buckets; beyond the last finite bound, that bound."""
    return _buckets(h, keys).groupBy(*keys).agg(*[_quantile(q).alias(n) for n, q in quantiles.items()], F.max("total").cast("bigint").alias("sample_count"))


def hist_stddev(h: DataFrame, sums: DataFrame, keys: list[str], total: str = "value_sum") -> DataFrame:
    """Spread around sum/count with every row at its bucket's middle; the open bucket's middle is twice its lower bound."""
    b = _buckets(h, keys).join(sums.select(*keys, total), keys)
    middle = F.when(F.col("le") < INF, (F.col("pb") + F.col("le")) / 2).otherwise(F.when(F.col("pb") == 0, 1.0).otherwise(2 * F.col("pb")))
    mean = F.try_divide(F.col(total), F.col("total"))
    square = (F.col("cum") - F.col("pc")) * (middle - mean) * (middle - mean)
    return b.withColumn("square", square).groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum("square"), F.max("total"))).alias("stddev"))


def latency(rows: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    h = bucketize(rows, keys, value, bounds)
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("value_sum"))
    four = hist_quantiles(h, keys, {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99})
    return four.join(hist_stddev(h, sums, keys).withColumnRenamed("stddev", "stddev_ms"), keys)


def errors(rows: DataFrame, keys: list[str], is_error: Column) -> DataFrame:
    """Ratio of errors, its binomial spread, availability; null ratios where there is no request."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_count"), F.count_if(is_error).alias("error_count"))
    ratio = F.try_divide("error_count", "total_count")
    counted = counted.withColumn("error_ratio", ratio)
    spread = F.sqrt(F.col("error_ratio") * (1 - F.col("error_ratio")) / F.col("total_count"))
    return counted.withColumn("error_stddev", spread).withColumn("availability", 1 - F.col("error_ratio"))


def ranked_values(rows: DataFrame, keys: list[str], value: Column | str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Exact percentiles by rank: ``ceil`` takes the value of rank ceil(q n), ``floor`` that of floor(q (n - 1)) + 1. Equal values are counted first; only the bucket of values that holds a rank is sorted."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counted = rows.select(*keys, v.alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    rank = {"ceil": lambda q: F.ceil(F.lit(q) * F.col("_all")), "floor": lambda q: F.floor(F.lit(q) * (F.col("_all") - 1)) + 1}
    return blocks.ranked(counted, keys, {name: rank[rule](q) for name, (q, rule) in wanted.items()})


def throughput(rates: DataFrame, keys: list[str], value: str = "rps") -> DataFrame:
    """Mean, population spread, p95 and count of rates; a key without any has zeros."""
    moments = rates.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_rps"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("stddev_rps"), F.count(value).alias("rate_samples"))
    p95 = ranked_values(rates, keys, value, {"p95_rps": (0.95, "ceil")}).drop("n")
    return moments.join(p95, keys, "left").withColumn("p95_rps", F.coalesce("p95_rps", F.lit(0.0)))


def saturation(gauges: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and p95 of cpu and memory; available if there is a sample of either. Both come from counts of equal values, so gauges are read once."""
    counted = gauges.select(*keys, F.expr("inline(array(struct('cpu' as kind, double(cpu) as _v), struct('mem' as kind, double(mem) as _v)))")).groupBy(*keys, "kind", "_v").agg(F.expr("count(1) as _n"))
    # A key without a sample keeps its row: null values are counted too.
    means = counted.groupBy(*keys, "kind").agg(F.expr("try_divide(sum(_v * _n), sum(if(_v is not null, _n, null))) as mean"))
    p95 = blocks.ranked(counted.filter("_v is not null"), [*keys, "kind"], {"p95": F.expr("ceil(0.95D * _all)")})
    of = lambda kind, c: f"max(if(kind = '{kind}', {c}, null))"
    row = means.join(p95, [*keys, "kind"], "left").groupBy(*keys)
    return row.agg(*[F.expr(e) for e in (f"coalesce({of('cpu', 'mean')}, 0D) as cpu_mean_ratio", f"coalesce({of('mem', 'mean')}, 0D) as memory_mean_ratio", "bool_or(mean is not null) as saturation_available", f"{of('cpu', 'p95')} as cpu_p95_ratio", f"{of('mem', 'p95')} as memory_p95_ratio")])


def span_counts(spans: DataFrame, keys: list[str]) -> DataFrame:
    return spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_spans"), F.count_if(F.col("service") == F.col("root_service")).alias("service_spans"))


def service_latency(spans: DataFrame, keys: list[str]) -> DataFrame:
    own = spans.filter(F.col("service") == F.col("root_service"))
    return ranked_values(own, keys, F.col("duration_ns") / 1e6, {"service_p99_ms": (0.99, "floor"), "service_p50_ms": (0.5, "floor")}).withColumnRenamed("n", "own_spans")


def with_fallback(spans: DataFrame, traces: DataFrame, keys: list[str]) -> DataFrame:
    """Spans, and for keys without a span of their own service the traces' durations as such spans."""
    has_own = spans.filter(F.col("service") == F.col("root_service")).select(*keys).distinct()
    stand_in = traces.join(has_own, keys, "left_anti").withColumn("service", F.col("root_service")).withColumn("duration_ns", F.col("trace_ms") * 1_000_000)
    return spans.unionByName(stand_in.select(*spans.columns))


def dependencies(spans: DataFrame, keys: list[str]) -> DataFrame:
    others = spans.filter(F.col("service") != F.col("root_service")).withColumnRenamed("service", "dependency")
    return ranked_values(others, [*keys, "dependency"], F.col("duration_ns") / 1e6, {"p99_ms": (0.99, "floor")}).withColumnRenamed("n", "call_count")


def top_dependencies(deps: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p99_ms"), "dependency"))
    return deps.withColumn("turn", turn).filter(F.col("turn") <= n)


def trace_latency(deps: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """The slowest dependency and its share of the service's own p99; the first by name of equals."""
    top = top_dependencies(deps, keys, 1).select(*keys, F.col("dependency").alias("top_dependency"), F.col("p99_ms").alias("top_dependency_p99_ms"))
    share = F.coalesce(F.try_divide("top_dependency_p99_ms", F.nullif(F.col("service_p99_ms"), F.lit(0.0))), F.lit(0.0))
    return top.join(own.select(*keys, "service_p99_ms"), keys, "left").withColumn("top_dependency_contribution", share)


def traces(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``trace_latency`` in one pass over spans: percentiles of every service below a root, then its own and the slowest other one picked."""
    ranked = ranked_values(spans, [*keys, "root_service", "service"], F.col("duration_ns") / 1e6, {"p99": (0.99, "floor")})
    own = F.col("service") == F.col("root_service")
    first = F.min(F.when(~own, F.struct((-F.col("p99")).alias("m"), F.col("service").alias("dependency"))))
    row = ranked.groupBy(*keys).agg(first.alias("first"), F.max(F.when(own, F.col("p99"))).alias("service_p99_ms")).filter("first is not null")
    row = row.select(*keys, F.col("first.dependency").alias("top_dependency"), (-F.col("first.m")).alias("top_dependency_p99_ms"), "service_p99_ms")
    share = F.coalesce(F.try_divide("top_dependency_p99_ms", F.nullif(F.col("service_p99_ms"), F.lit(0.0))), F.lit(0.0))
    return row.withColumn("top_dependency_contribution", share)


def slow_pattern(dependency: Column, share: Column) -> Column:
    return F.format_string("%s accounts for %.0f%% of p99 tail latency", dependency, share * 100)


def log_categories(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Count and share of each category; an empty one is unknown."""
    category = F.coalesce(F.nullif(F.col("error_type"), F.lit("")), F.lit("unknown"))
    counted = logs.groupBy(*keys, category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("ratio", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))))


def category_map(categories: DataFrame, keys: list[str]) -> DataFrame:
    return categories.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "ratio")))).alias("error_rate_by_category"))


def error_breakdown(categories: DataFrame, keys: list[str]) -> DataFrame:
    first = F.min_by("category", F.struct(-F.col("ratio"), "category"))
    return categories.groupBy(*keys).agg(first.alias("top_category"), F.max("ratio").alias("top_category_ratio"), F.count(F.lit(1)).alias("categories"))


def cells(requests: DataFrame, keys: list[str], bounds: list[float], step: Column) -> DataFrame:
    """One pass over requests: per key, step and bucket the rows (n), those with a latency (timed), errors, and the latencies' sum."""
    bucket = F.when(F.col("latency_ms").isNotNull(), F.coalesce(*[F.when(F.col("latency_ms") <= b, F.lit(b)) for b in bounds if b < INF], F.lit(INF)))
    return requests.groupBy(*keys, step.alias("hour"), bucket.alias("le")).agg(F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("timed"), F.count_if("is_error").alias("errors"), F.sum("latency_ms").alias("value_sum"))


def request_indicators(cells_: DataFrame, keys: list[str], bounds: list[float]) -> DataFrame:
    """Latency, errors and availability from cells, by one aggregate: the counts up to each bound are columns of the row, and what follows from them plain expressions.

    A percentile is interpolated within the first bucket up to which its rank lies; beyond the last finite bound it is that bound. The spread takes every
    request at its bucket's middle, in the open one at twice its lower bound.
    """
    upto = [F.expr(f"double(coalesce(sum(case when le <= {_number(b)} then timed end), 0))").alias(f"_b{i}") for i, b in enumerate(bounds)]
    row = cells_.groupBy(*keys).agg(*upto, F.expr("sum(n) as total_count"), F.expr("sum(errors) as error_count"), F.expr("sum(timed) as sample_count"), F.expr("sum(value_sum) as value_sum"))
    ratio = "try_divide(error_count, total_count)"
    four = {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99}
    return row.selectExpr(
        *keys, *[f"{_percentile(q, bounds)} as {n}" for n, q in four.items()], "sample_count", f"{_deviation(bounds)} as stddev_ms", "total_count", "error_count",
        f"{ratio} as error_ratio", f"sqrt({ratio} * (1 - {ratio}) / total_count) as error_stddev", f"1 - {ratio} as availability",
    )


def _number(b: float) -> str:
    return "double('Infinity')" if b == INF else f"{float(b)!r}D"


def _lower(i: int, bounds: list[float]) -> tuple[str, str]:
    """The count up to bucket i's lower bound, and that bound."""
    return (f"_b{i - 1}", _number(bounds[i - 1])) if i else ("0D", "0D")


def _percentile(q: float, bounds: list[float]) -> str:
    rank, cases = f"({q!r}D * sample_count)", []
    for i, b in enumerate(bounds):
        if b < INF:
            below, low = _lower(i, bounds)
            part = f"if(_b{i} > {below}, ({rank} - {below}) / (_b{i} - {below}), 0D)"
            cases.append(f"when _b{i} >= {rank} then {low} + {part} * ({_number(b)} - {low})")
    return f"case {' '.join(cases)} else {_number(max(b for b in bounds if b < INF))} end"


def _deviation(bounds: list[float]) -> str:
    terms = []
    for i, b in enumerate(bounds):
        below, low = _lower(i, bounds)
        middle = f"({low} + {_number(b)}) / 2" if b < INF else f"2 * {low}" if i else "1D"
        terms.append(f"(_b{i} - {below}) * pow({middle} - try_divide(value_sum, sample_count), 2)")
    return f"sqrt(try_divide({' + '.join(terms)}, sample_count))"


def rate_indicators(rates: DataFrame, keys: list[str]) -> DataFrame:
    """``throughput`` where a key's rates are one per step of a window, and so few: by one aggregate, the percentile from an array."""
    row = rates.groupBy(*keys).agg(F.expr("coalesce(avg(rps), 0D) as mean_rps"), F.expr("coalesce(stddev_pop(rps), 0D) as stddev_rps"), F.expr("count(rps) as rate_samples"), F.expr("array_sort(collect_list(rps)) as r"))
    return row.selectExpr(*keys, "mean_rps", "stddev_rps", "rate_samples", "coalesce(get(r, int(ceil(0.95D * size(r))) - 1), 0D) as p95_rps")


def baseline(cells_: DataFrame, rates: DataFrame, gauges: DataFrame, traces: DataFrame, logs: DataFrame, keys: list[str], bounds: list[float], provenance: dict[str, Column] | None = None) -> DataFrame:
    """One row per key with every indicator; what a key lacks is null. ``cells_`` and ``rates`` come from one pass over requests, ``traces`` is a trace_latency table; the tables joined have one row per key."""
    row = request_indicators(cells_, keys, bounds)
    row = row.join(rate_indicators(rates, keys), keys, "left").join(saturation(gauges, keys), keys, "left").join(traces, keys, "left")
    row = row.join(error_breakdown(log_categories(logs, keys), keys), keys, "left")
    row = row.withColumn("saturation_available", F.coalesce("saturation_available", F.lit(False)))
    return row.withColumns({"trace_available": F.col("top_dependency").isNotNull(), "breakdown_available": F.col("top_category").isNotNull(), **(provenance or {})})
