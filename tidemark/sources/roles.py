"""Roles of the test tables: requests, rates, counters, gauges, spans, logs and artifacts drawn from events, lineitem, documents and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import blocks

#: Upper bounds of latency buckets in milliseconds.
BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, float("inf")]
LIVE_FROM, GAUGES_LIVE_FROM = "2024-01-24", "1997-01-01"
KEYS = ["service", "win"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def service(number: Column | str) -> Column:
    n = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit("svc-"), F.lpad((n % 10).cast("string"), 2, "0"))


def namespace(service_: Column | str) -> Column:
    """Services with an even number belong to one namespace, those with an odd one to another."""
    s = F.col(service_) if isinstance(service_, str) else service_
    return F.when(F.substring(s, 5, 2).cast("int") % 2 == 0, "shop").otherwise("core")


def shared_namespace(number: Column | str) -> Column:
    """Of a service that runs in two namespaces: which of them a row is of."""
    n = F.col(number) if isinstance(number, str) else number
    return F.when(n % 20 < 10, "shop").otherwise("core")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from events; three services are slower by four in the live window."""
    return requests_by_namespace(spark, sf_dir).drop("namespace")


def requests_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the namespace; every service's name is in use in both."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    live = F.col("ts") >= F.lit(LIVE_FROM).cast("timestamp")
    slow = live & (F.col("user_id") % 10 < 3)
    is_error = F.col("event_type") == "error"
    return e.select("event_id", service("user_id").alias("service"), F.when(live, "live").otherwise("baseline").alias("win"), "ts", "event_type", F.when(slow, F.col("value") * 4).otherwise(F.col("value")).alias("latency_ms"), is_error.alias("is_error"), F.when(is_error, "500").otherwise("200").alias("code"), "props", shared_namespace("user_id").alias("namespace"))


def rates(reqs: DataFrame) -> DataFrame:
    """Requests per second of every hour between a window's first and last, zero where there is none."""
    return rates_of(reqs.groupBy(*KEYS, F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")))


def rates_of(counted: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The same from counts (keys with win, hour, n) of the hours that have any."""
    ends = counted.groupBy("win").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = counted.select(*keys).distinct().join(ends, "win").select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return grid.join(counted, [*keys, "hour"], "left").select(*keys, "hour", (F.coalesce("n", F.lit(0)) / 3600).alias("rps"))


def counters(reqs: DataFrame) -> DataFrame:
    """Running counts per service and code in time order; they start anew after every 97th."""
    rows = reqs.select("event_id", "service", "code", "ts", F.unix_timestamp("ts").alias("_epoch"))
    rows = blocks.numbered(rows, ["service", "code"], ["ts", "event_id"], "_number", "_epoch")
    return rows.select("event_id", "service", "code", "ts", ((F.col("_number") - 1) % 97 + 1).cast("double").alias("value"))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(service("l_suppkey").alias("service"), _gauge_window().alias("win"), (F.col("l_quantity") / 50).alias("cpu"), (F.col("l_discount") * 10).alias("mem"), F.col("l_shipdate").cast("timestamp").alias("ts"))


def _gauge_window() -> Column:
    return F.when(F.col("l_shipdate") >= F.lit(GAUGES_LIVE_FROM).cast("timestamp_ntz"), "live").otherwise("baseline")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spans of their order; the first line's service is the root."""
    li = table(spark, sf_dir, "lineitem").withColumn("service", service("l_suppkey"))
    first = F.min(F.struct("l_linenumber", "l_suppkey", "service")).over(Window.partitionBy("l_orderkey"))
    both = li.withColumn("root", first["service"])
    return both.select(F.col("root").alias("service_key"), _gauge_window().alias("win"), F.col("l_orderkey").alias("trace_id"), F.col("root").alias("root_service"), "service", F.round(F.col("l_extendedprice") * 1000).cast("bigint").alias("duration_ns"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents as error lines, their source as the category."""
    labels = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(labels, "doc_id").select(service("doc_id").alias("service"), F.when(F.col("doc_id") % 4 == 3, "live").otherwise("baseline").alias("win"), F.when(F.col("source") == "src3", "").otherwise(F.col("source")).alias("error_type"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts_by_namespace(spark, sf_dir).drop("namespace")


def artifacts_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "drift-signal").when(F.col("o_orderstatus") == "O", "baseline").otherwise("drift-report")
    severity = F.lower(F.split("o_orderpriority", "-")[0])
    return o.select(F.concat(F.lit("svc-"), (F.col("o_custkey") % 50).cast("string")).alias("service"), kind.alias("artifact_type"), F.col("o_orderdate").alias("stored_at"), F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("payload"), (F.col("o_totalprice") > 150000).alias("breached"), F.when(F.col("o_totalprice") > 300000, "latency_improvement").when(F.col("o_totalprice") > 150000, "latency_regression").otherwise("no_significant_drift").alias("class"), severity.alias("priority"), F.when(F.col("o_orderkey") % 3 == 0, "critical").when(F.col("o_orderkey") % 3 == 1, "medium").otherwise("info").alias("severity"), F.when(F.col("o_orderkey") % 2 == 0, "new").otherwise("mature").alias("maturity_tier"), shared_namespace("o_custkey").alias("namespace"))
