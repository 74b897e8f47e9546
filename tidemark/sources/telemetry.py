"""Readers of telemetry: metric samples, trace spans, log lines, evidence documents; and their simple selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SAMPLES = "struct<data:struct<result:array<struct<metric:map<string,string>,values:array<string>,value:string>>>>"
TRACES = "traces array<struct<traceID:string,rootServiceName:string,rootTraceName:string,durationMs:bigint,spanSets:array<struct<spans:array<struct<spanID:string,name:string,serviceName:string,durationNanos:string>>>>>>"
LOGS = "data struct<result:array<struct<stream:map<string,string>,values:array<array<string>>>>>"
_RATES = "array<struct<timestamp:timestamp,value:double>>"
EVIDENCE = (
    "schema_version bigint, service string, namespace string, lookback_window string, collected_at timestamp, coverage_ratio double, series struct<"
    "latency_histogram:struct<metric_name:string,buckets:array<struct<le:string,count:double>>,total_count:double,sum:double>,"
    f"request_total:struct<metric_name:string,total:double,rate_samples:{_RATES}>,error_total:struct<metric_name:string,total:double,rate_samples:{_RATES}>,"
    "saturation:struct<cpu:struct<metric_name:string,samples:array<double>>,memory:struct<metric_name:string,samples:array<double>>,available:boolean>,"
    "traces:struct<available:boolean,source:string,total_spans:bigint,service_spans:bigint,span_latency_p99_ms:double,span_latency_p50_ms:double,"
    "top_dependencies:array<struct<service:string,p99_ms:double,call_count:bigint,error_rate:double>>,slow_span_pattern:string>,"
    "logs:struct<available:boolean,source:string,total_entries:bigint,error_entries:bigint,error_breakdown:array<struct<category:string,count:bigint,ratio:double>>,error_rate_by_category:map<string,double>>>, "
    "provenance struct<prometheus_endpoint:string,query_timestamps:struct<start:timestamp,end:timestamp>,queries:map<string,string>>"
)


def scan_samples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(labels, ts, value) of matrix payloads, one JSON document a file or, with ``lines``, a line; each value a pair of seconds and text."""
    docs = spark.read.schema("data struct<result:array<struct<metric:map<string,string>,values:array<string>>>>").option("multiLine", not lines).json(path)
    series = docs.select(F.explode_outer("data.result").alias("s")).select(F.col("s.metric").alias("labels"), F.explode_outer("s.values").alias("v"))
    pair = F.from_json("v", "array<string>")
    return series.filter("v is not null").select("labels", pair[0].cast("double").alias("epoch"), F.timestamp_millis((pair[0].cast("double") * 1000).cast("bigint")).alias("ts"), pair[1].try_cast("double").alias("value"))


def scan_spans(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(trace_id, root_service, trace_ms, service, span, duration_ns) of trace payloads; traces without spans keep a row."""
    docs = spark.read.schema(TRACES).option("multiLine", not lines).json(path)
    traces = docs.select(F.explode("traces").alias("t")).select("t.traceID", "t.rootServiceName", "t.durationMs", F.explode_outer("t.spanSets").alias("set"))
    spans = traces.select("traceID", "rootServiceName", "durationMs", F.explode_outer("set.spans").alias("s"))
    return spans.select(F.col("traceID").alias("trace_id"), F.col("rootServiceName").alias("root_service"), F.col("durationMs").alias("trace_ms"), F.col("s.serviceName").alias("service"), F.col("s.name").alias("span"), F.col("s.durationNanos").cast("bigint").alias("duration_ns"))


def scan_logs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(stream labels, ts_ns, line) of log payloads."""
    docs = spark.read.schema(LOGS).option("multiLine", not lines).json(path)
    streams = docs.select(F.explode("data.result").alias("s")).select(F.col("s.stream").alias("labels"), F.explode("s.values").alias("v"))
    return streams.select("labels", F.col("v")[0].cast("bigint").alias("ts_ns"), F.col("v")[1].alias("line"))


def read_evidence(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Evidence documents, one a file or, with ``lines``, a line; bounds like +Inf are read as text and cast where they are used."""
    return spark.read.schema(StructType.fromDDL(EVIDENCE)).option("multiLine", not lines).json(path)


def select_labels(df: DataFrame, **equal: str) -> DataFrame:
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df


def in_window(df: DataFrame, end: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Rows of the last ``seconds`` up to ``end``, both ends included; the end is always given."""
    at = F.lit(end).cast("timestamp")
    return df.filter((F.col(ts) >= at - F.expr(f"make_dt_interval(0, 0, 0, {seconds})")) & (F.col(ts) <= at))


def instant(samples: DataFrame, at: str, series: list[str], tie: list[str] | None = None) -> DataFrame:
    """Each series' last value at or before a time; of samples at one time the last by ``tie``."""
    return samples.filter(F.col("ts") <= F.lit(at).cast("timestamp")).groupBy(*series).agg(F.max_by("value", F.struct("ts", *(tie or []))).alias("value"))


def discover(samples: DataFrame, metric: str, keys: list[str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Which metric serves each role, per key: the standard name if it is there, else the least that fits the role's pattern; and where it came from."""
    aggregates: list[Column] = []
    for role, (standard, pattern) in wanted.items():
        aggregates += [F.max(F.when(F.col(metric) == standard, F.col(metric))).alias(f"_{role}"), F.min(F.when(F.col(metric).rlike(pattern), F.regexp_replace(metric, "_bucket$", ""))).alias(f"__{role}")]
    found = samples.groupBy(*keys).agg(*aggregates)
    standard = [F.col(f"_{r}").isNotNull() for r in wanted]
    other = [F.col(f"__{r}").isNotNull() for r in wanted]
    every = lambda xs: F.array_min(F.array(*[x.cast("int") for x in xs])) == 1
    some = lambda xs: F.array_max(F.array(*[x.cast("int") for x in xs])) == 1
    kind = F.when(every(standard), "standard").when(some(standard + other), "discovered").otherwise("container-only")
    return found.select(*keys, *[F.coalesce(F.col(f"_{r}"), F.col(f"__{r}")).alias(r) for r in wanted], kind.alias("origin"))
