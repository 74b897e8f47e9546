"""Registered queries: operators over the roles of the given tables. Doubles are rounded so that engines agree."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.functions import canonical
from tidemark.operators import alerts, audit, contracts, documents, drift, evidence, fleet, grading, provenance, series, targets
from tidemark.operators import baseline as base
from tidemark.sources import artifacts as store
from tidemark.sources import roles, telemetry
from tidemark.sources.roles import BOUNDS, KEYS, table
from tidemark.streaming import windows as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WINDOW_END = "2024-01-30 00:00:00"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Sources, labels, names


@query
def scan_events_window(spark, d):
    rows = telemetry.in_window(roles.requests(spark, d), WINDOW_END, 7 * 86400)
    return rounded(telemetry.select_labels(rows, event_type="error").select("event_id", "service", "latency_ms"))


@query
def label_regex_5xx(spark, d):
    return roles.requests(spark, d).filter(fn.label_match(F.col("code"), "5..") & fn.pod_of(F.concat("service", F.lit("-a")), F.col("service"))).groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query
def name_validity(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.valid_name(F.col("p_name")).alias("as_is"), fn.valid_name(fn.resource_name(F.col("p_name"))).alias("as_resource"), fn.resource_name(F.col("p_name")).alias("resource"))


@query
def metric_segment(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.metric_segment(F.col("c_name")).alias("segment"), fn.metric_segment(F.concat(F.col("c_custkey").cast("string"), F.lit(" - X_y!"))).alias("numbered"))


@query
def alert_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.alert_name(F.lower("o_orderpriority"), F.lit("critical")).alias("alert"))


@query
def duration_parse(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("s", "m", "h", "d", "w")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    text = F.concat((F.col("o_custkey") % 100).cast("string"), unit)
    seconds = fn.duration_seconds(text)
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"), F.coalesce(seconds, F.lit(-1)).alias("seconds"), fn.duration_text(seconds).alias("back"))


@query
def metric_discovery(spark, d):
    wanted = {"latency": ("view", "view|click"), "requests": ("click", "click|signup"), "errors": ("http_errors", "error")}
    return telemetry.discover(roles.requests(spark, d), "event_type", ["service"], wanted)


@query
def contract_violations(spark, d):
    rules = [contracts.required("o_orderkey"), contracts.between("o_totalprice", 1000, 250000), contracts.one_of("o_orderstatus", "F", "O"), contracts.pattern("o_orderpriority", "^[1-4]-")]
    _, aside = contracts.split(table(spark, d, "orders"), rules)
    return aside.select("o_orderkey", F.array_join("violations", "; ").alias("violations"))


@query
def supported_versions(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("schema_version"))
    good, aside = store.supported(rows, (1, 2))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
    return count(good, "supported").unionByName(count(aside, "aside"))


@query
def canonical_round(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.canonical(F.sqrt("l_extendedprice")).alias("value"))


@query
def json_props(spark, d):
    payload = fn.strip_fence(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    return roles.requests(spark, d).withColumn("p", F.from_json(payload, "k int")).groupBy("p.k").agg(F.count(F.lit(1)).alias("n")).select(F.col("k").cast("int").alias("k"), "n")


# Series


def samples(spark, d) -> DataFrame:
    return roles.requests(spark, d).select("event_id", "service", "code", "win", "ts", F.col("latency_ms").alias("value"))


@query
def instant_latest(spark, d):
    return rounded(telemetry.instant(samples(spark, d), "2024-01-20 12:00:00", ["service", "code"], ["event_id"]))


@query
def step_grid_asof(spark, d):
    grid = series.align(samples(spark, d), ["service"], "2024-01-10 00:00:00", "2024-01-12 00:00:00", series.step_seconds(30 * 86400), 3600, ["event_id"])
    return rounded(grid)


@query
def coverage(spark, d):
    rows = roles.requests(spark, d)
    return rounded(series.coverage(rows, ["service"], "event_type", ("view", "click", "error"), 30 * 86400))


@query
def counter_total(spark, d):
    return series.last_value(roles.counters(roles.requests(spark, d)), ["code"], ["service"], ["ts", "event_id"])


@query
def counter_increase(spark, d):
    return series.increase(roles.counters(roles.requests(spark, d)), ["service", "code"], ["ts", "event_id"])


@query
def counter_rate(spark, d):
    rows = series.rate(roles.counters(roles.requests(spark, d)), ["service", "code"], ["ts", "event_id"], 6 * 3600)
    return rounded(rows.select("event_id", "service", "code", "rate"), 9)


@query
def rate_by_service(spark, d):
    rows = series.deltas(roles.counters(roles.requests(spark, d)), ["service", "code"], ["ts", "event_id"])
    steps = rows.groupBy("service", (F.floor(series.epoch() / 3600) * 3600).alias("epoch")).agg((F.sum("delta") / 3600).alias("rps"))
    return rounded(steps, 9)


@query
def avg_by(spark, d):
    return rounded(samples(spark, d).groupBy("service", (F.floor(series.epoch() / 86400) * 86400).alias("epoch")).agg(F.avg("value").alias("mean")))


@query
def avg_over_time(spark, d):
    rows = samples(spark, d).withColumn("epoch", series.epoch())
    return rounded(series.over_time(rows, ["service"], "value", {"mean": 86400}).select("event_id", "mean"), 9)


@query
def error_ratio_series(spark, d):
    return rounded(series.ratio_per_step(roles.requests(spark, d), ["service"], 6 * 3600, F.col("is_error")))


@query
def quantile_over_time(spark, d):
    keys = ["service", "day"]
    rows = roles.requests(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(base.hist_quantiles(base.bucketize(rows, keys, "latency_ms", BOUNDS), keys, {"p99_ms": 0.99, "p50_ms": 0.5}))


# Baseline


def histogram(spark, d) -> DataFrame:
    return base.bucketize(roles.requests(spark, d), KEYS, "latency_ms", BOUNDS)


@query
def bucketize(spark, d):
    return histogram(spark, d)


@query
def hist_assemble(spark, d):
    h = histogram(spark, d).withColumn("pod", F.concat(F.col("win"), F.lit("-0")))
    raw = h.select("service", "pod", F.when(F.col("le") == base.INF, "+Inf").otherwise(F.col("le").cast("string")).alias("le"), F.col("cum").cast("double").alias("value"), F.lit("2024-01-24").cast("timestamp").alias("ts"))
    older = raw.withColumns({"value": F.lit(0.0), "ts": F.lit("2024-01-01").cast("timestamp")})
    broken = raw.withColumn("le", F.lit("wide"))
    return base.assemble(raw.unionByName(older).unionByName(broken), ["service"], ["pod"])


@query
def latency_indicator(spark, d):
    return rounded(base.latency(roles.requests(spark, d), KEYS, "latency_ms", BOUNDS), 5)


@query
def error_availability(spark, d):
    return rounded(base.errors(roles.requests(spark, d), KEYS, F.col("is_error")), 9)


@query
def throughput(spark, d):
    return rounded(base.throughput(roles.rates(roles.requests(spark, d)), KEYS), 9)


@query
def saturation(spark, d):
    return rounded(base.saturation(roles.gauges(spark, d), KEYS))


def own_spans(spark, d) -> DataFrame:
    return roles.spans(spark, d)


@query
def span_counts(spark, d):
    return base.span_counts(own_spans(spark, d), ["service_key", "win"])


@query
def service_latency(spark, d):
    return rounded(base.service_latency(own_spans(spark, d), ["service_key", "win"]))


@query
def trace_fallback(spark, d):
    s = own_spans(spark, d).filter((F.col("service_key") != "svc-03") | (F.col("service") != F.col("root_service")))
    traces = s.groupBy("service_key", "win", "trace_id", "root_service").agg((F.max("duration_ns") / 1e6).cast("bigint").alias("trace_ms"))
    return rounded(base.service_latency(base.with_fallback(s, traces, ["service_key", "win"]), ["service_key", "win"]))


@query
def dependencies_top5(spark, d):
    return rounded(base.top_dependencies(base.dependencies(own_spans(spark, d), ["service_key", "win"]), ["service_key", "win"]))


def _trace(spark, d) -> DataFrame:
    return base.traces(own_spans(spark, d), ["service_key", "win"])


@query
def trace_latency(spark, d):
    t = _trace(spark, d)
    return rounded(t.withColumn("slow_span_pattern", base.slow_pattern(F.col("top_dependency"), F.round("top_dependency_contribution", 2))))


@query
def log_categories(spark, d):
    return rounded(base.log_categories(roles.logs(spark, d), KEYS))


@query
def category_map(spark, d):
    m = base.category_map(base.log_categories(roles.logs(spark, d), KEYS), KEYS)
    text = F.array_join(F.transform(F.map_entries("error_rate_by_category"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",")
    return m.select(*KEYS, text.alias("rates"))


@query
def error_breakdown(spark, d):
    return rounded(base.error_breakdown(base.log_categories(roles.logs(spark, d), KEYS), KEYS))


def baselines(spark, d) -> DataFrame:
    cells = base.cells(roles.requests(spark, d), KEYS, BOUNDS, F.date_trunc("hour", "ts"))
    rates = roles.rates_of(cells.groupBy(*KEYS, "hour").agg(F.sum("n").alias("n")))
    t = _trace(spark, d).withColumnRenamed("service_key", "service")
    return base.baseline(cells, rates, roles.gauges(spark, d), t, roles.logs(spark, d), KEYS, BOUNDS)


@query
def baseline(spark, d):
    return rounded(baselines(spark, d).withColumns({"lookback_window": F.lit("30d"), "categories": F.coalesce("categories", F.lit(0))}), 5)


@query
def baseline_provenance(spark, d):
    """Of every service that a customer asks for, with and without requests."""
    number = F.concat(F.lit("svc-"), F.lpad((F.col("c_custkey") % 12).cast("string"), 2, "0"))
    windows = F.explode(F.array(F.lit("baseline"), F.lit("live")))
    expected = table(spark, d, "customer").select(number.alias("service")).distinct().select("service", windows.alias("win"))
    found = provenance.sources(roles.requests(spark, d), KEYS, "events", 3600)
    rows = provenance.judged(expected, found, KEYS, "2024-04-25")
    return rounded(rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")}), 7)


# Evidence documents


def bundles(spark, d) -> DataFrame:
    reqs = roles.requests(spark, d)
    daily = roles.gauges(spark, d).groupBy(*KEYS, F.to_date("ts").alias("day")).agg(F.avg("cpu").alias("cpu"), F.avg("mem").alias("mem"))
    keyed = lambda df: df.withColumnRenamed("service_key", "service")
    own, deps = (keyed(f(own_spans(spark, d), ["service_key", "win"])) for f in (base.service_latency, base.dependencies))
    return evidence.bundles(reqs, roles.rates(reqs), daily, own, deps, base.log_categories(roles.logs(spark, d), KEYS), KEYS, BOUNDS, roles.namespace("service"), "30d", "events")


@query
def evidence_baseline(spark, d):
    rows = evidence.baselines(bundles(spark, d), KEYS)
    text = F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss")
    return rounded(rows.withColumns({"generated_at": text, "categories": F.coalesce("categories", F.lit(0))}).drop("provenance"), 7)


def _faulty_bundles(spark, d) -> DataFrame:
    """Evidence with one fault a service, at different depths."""
    n = F.substring("service", 5, 2).cast("int")
    s = F.col("series")
    worse = lambda name, f: F.transform(s["latency_histogram"]["buckets"], lambda b, i: F.struct(b["le"].alias("le"), F.when(i == 3, -1.0).otherwise(b["count"]).alias("count")) if name == "count" else f(b))
    negative = s.withField("latency_histogram.buckets", worse("count", None))
    wide = s.withField("latency_histogram.buckets", worse("le", lambda b: F.struct(F.when(b["le"] == "+Inf", "wide").otherwise(b["le"]).alias("le"), b["count"].alias("count"))))
    shares = s.withField("logs.error_breakdown", F.transform(s["logs"]["error_breakdown"], lambda c: c.withField("ratio", c["ratio"] * 3)))
    series_ = F.when(n == 2, negative).when(n == 5, s.withField("error_total", F.lit(None).cast(s_type(bundles(spark, d), "error_total")))).when(n == 8, shares).when(n == 9, wide).otherwise(s)
    return bundles(spark, d).withColumns({"coverage_ratio": F.when(n == 1, 1.5).otherwise(F.col("coverage_ratio")), "namespace": F.when(n == 3, "").otherwise(F.col("namespace")), "lookback_window": F.when(n == 4, "30 days").otherwise(F.col("lookback_window")), "schema_version": F.when(n == 7, F.lit(3)).otherwise(F.col("schema_version")), "series": series_})


def s_type(df: DataFrame, part: str):
    return df.schema["series"].dataType[part].dataType


@query
def evidence_violations(spark, d):
    _, aside = documents.quarantine(_faulty_bundles(spark, d), documents.EVIDENCE)
    return documents.by_path(aside, KEYS)


@query
def baseline_documents(spark, d):
    """Baselines from evidence as documents of their contract, and how many violate it."""
    docs = evidence.baseline_documents(evidence.baselines(bundles(spark, d), KEYS), KEYS)
    return docs.select(*KEYS, F.size(documents.violations(docs, documents.BASELINE)).alias("violations"))


# Drift


def drifts(spark, d) -> DataFrame:
    return drift.drift_of_windows(baselines(spark, d), ["service"], "win", "live", "baseline")


def _drift(spark, d, *names: str) -> DataFrame:
    return rounded(drifts(spark, d).filter(F.col("name").isin(*names)), 5)


@query
def drift_core(spark, d):
    return _drift(spark, d, "latency_p99_ms", "latency_p50_ms", "error_rate_ratio", "availability_ratio", "throughput_mean_rps")


@query
def drift_saturation(spark, d):
    return _drift(spark, d, "cpu_mean_ratio", "memory_mean_ratio")


@query
def drift_dependency(spark, d):
    return _drift(spark, d, "dependency_p99_ms")


@query
def drift_category(spark, d):
    return _drift(spark, d, "error_top_category_ratio")


@query
def drift_skipped(spark, d):
    b = baselines(spark, d)
    live = b.filter("win = 'live' and service not in ('svc-04', 'svc-05')").drop("win").withColumn("saturation_available", F.col("service") != "svc-06")
    out = drift.drift_indicators(live, b.filter("win = 'baseline'").drop("win"), ["service"])
    return out.filter("status = 'skipped'").select("service", "name", "live_value", "band_breach", "first_pass_class", "skip_reason")


def _signals(spark, d) -> tuple[DataFrame, DataFrame]:
    """Drift rows and their signals, both from one frame."""
    rows = drifts(spark, d)
    return rows, drift.report_class(drift.drift_signal(rows, ["service"]))


def signals(spark, d) -> DataFrame:
    return _signals(spark, d)[1]


@query
def drift_signal(spark, d):
    s = signals(spark, d).withColumn("all_breached_indicators", F.array_join("all_breached_indicators", ",")).drop("breached_classes", "report_class")
    return rounded(s, 5)


@query
def report_class(spark, d):
    s = signals(spark, d)
    return s.select("service", "report_class", drift.severity(F.col("dominant_magnitude"), F.col("report_class")).alias("severity"), drift.remedy(F.col("report_class")).alias("remediation_category"))


@query
def patterns(spark, d):
    return drift.patterns(drifts(spark, d), ["service"])


# Targets, alerts, budgets


def maturity() -> Column:
    n = F.substring("service", 5, 2).cast("int") % 3
    return F.when(n == 0, "new").when(n == 1, "growing").otherwise("mature")


def proposals(spark, d, win: str = "baseline") -> DataFrame:
    return proposals_of(baselines(spark, d).filter(F.col("win") == win).drop("win"))


def proposals_of(b: DataFrame) -> DataFrame:
    return targets.propose(targets.observed(b, ["service"], saturation=True), maturity())


@query
def target_rows(spark, d):
    return rounded(proposals(spark, d).drop("headroom", "burn_windows").withColumn("sd", F.coalesce("sd", F.lit(-1.0))), 5)


@query
def target_headroom(spark, d):
    rows = proposals(spark, d).select("service", "sli_name", "headroom.*")
    return rounded(rows, 7)


@query
def promotion(spark, d):
    live = proposals(spark, d, "live").filter("sli_type in ('latency', 'error_rate')").select("service", "sli_type", "slo_target")
    return rounded(drift.promotions(signals(spark, d), live, ["service"]), 5)


@query
def target_violations(spark, d):
    p = proposals(spark, d).filter("sli_type != 'saturation'")
    n = F.substring("service", 5, 2).cast("int")
    bad = p.withColumns({"slo_target": F.when(n == 1, F.col("observed")).when(n == 2, F.col("sla_target")).otherwise(F.col("slo_target")), "sla_target": F.when(n == 3, F.col("observed") + 9 * F.coalesce("sd", F.lit(0.0))).when(n == 4, F.col("slo_target")).otherwise(F.col("sla_target")), "target_op": F.when(n == 5, "gte").otherwise(F.col("target_op"))})
    return targets.check(bad).select("service", "sli_name", F.array_join("violations", ",").alias("violations"))


@query
def margin_direction(spark, d):
    p = proposals(spark, d)
    n = F.substring("service", 5, 2).cast("int")
    return targets.quality(p.withColumns({"slo_target": F.when(n == 1, F.col("observed")).otherwise(F.col("slo_target")), "target_op": F.when(n == 5, "gte").otherwise(F.col("target_op"))}), ["service"])


@query
def burn_windows(spark, d):
    return rounded(targets_rules(spark, d).select("service", "sli_name", "alert", "severity", "long_window", "short_window", "burn_rate", "threshold", "status"), 7)


def targets_rules(spark, d) -> DataFrame:
    return alerts.alert_rules(proposals(spark, d), ["service"])


@query
def alert_summary(spark, d):
    return alerts.summary(targets_rules(spark, d))


@query
def objectives(spark, d):
    return rounded(alerts.objectives(proposals(spark, d), ["service"]).withColumn("value", F.coalesce("value", F.lit(-1.0))), 5)


@query
def alert_policies(spark, d):
    return alerts.alert_policies(proposals(spark, d), ["service"])


@query
def budget_status(spark, d):
    p = proposals(spark, d)
    return alerts.budgets(p.select("service", "sli_name", "sli_type"), drifts(spark, d), ["service"])


@query
def record_latency(spark, d):
    sla = proposals(spark, d).filter("sli_type = 'latency'").select("service", F.round("sla_target", 4).alias("sla_target"))
    return rounded(alerts.latency_ratio(roles.requests(spark, d), ["service"], sla, "latency_ms", F.floor(series.epoch() / 86400) * 86400))


@query
def alerts_fired(spark, d):
    steps = series.ratio_per_step(roles.requests(spark, d), ["service"], 3600, F.col("is_error"))
    rules = targets_rules(spark, d).filter("sli_type = 'error_rate'").select("service", "alert", F.round("threshold", 5).alias("threshold"), F.lit("6h").alias("long_window"), F.lit("1h").alias("short_window"))
    # Test data are sparse, so a twentieth of the threshold is watched.
    fired = alerts.evaluate(steps, rules, ["service"], "ratio", [21600, 3600], lambda v: v > F.col("threshold") / 20)
    return rounded(fired.select("service", "alert", "epoch", "long_value", "short_value", "firing"))


@query
def throughput_alerts(spark, d):
    hourly = roles.rates(roles.requests(spark, d)).withColumn("epoch", F.unix_timestamp("hour"))
    rules = targets_rules(spark, d).filter("sli_type = 'throughput' and severity = 'warning'").select("service", F.round("sla_target", 7).alias("sla_target"), "burn_rate", "error_budget_percent", F.lit("24h").alias("long_window"), F.lit("6h").alias("short_window"))
    fired = alerts.evaluate(hourly, rules, ["service"], "rps", [86400, 21600], alerts.starved)
    return fired.groupBy("service", "win").agg(F.count_if("firing").alias("firing"), F.count(F.lit(1)).alias("steps"))


def _counted(fired: DataFrame) -> DataFrame:
    return rounded(fired.groupBy("service", "alert").agg(F.count(F.lit(1)).alias("steps"), F.count_if("firing").alias("firing"), F.max("long_value").alias("long_peak"), F.max("short_value").alias("short_peak")))


#: Seconds of the windows that targets' rules name, both of each rule.
RULE_WINDOWS = [300, 1800, 3600, 21600]


@query
def error_alerts(spark, d):
    steps = series.ratio_per_step(roles.requests(spark, d), ["service"], 300, F.col("is_error"))
    rules = targets_rules(spark, d).filter("sli_type = 'error_rate'").select("service", "alert", F.round("threshold", 6).alias("threshold"), "long_window", "short_window")
    return _counted(alerts.evaluate(steps, rules, ["service"], "ratio", RULE_WINDOWS, alerts.over_budget))


@query
def availability_alerts(spark, d):
    """Availability is watched by the ratio of errors, against its own budget."""
    steps = series.ratio_per_step(roles.requests(spark, d), ["service"], 300, F.col("is_error"))
    rules = targets_rules(spark, d).filter("sli_type = 'availability'").select("service", "alert", F.round("threshold", 6).alias("threshold"), "long_window", "short_window")
    return _counted(alerts.evaluate(steps, rules, ["service"], "ratio", RULE_WINDOWS, alerts.over_budget))


@query
def throughput_rule_alerts(spark, d):
    """Both severities at the rules' own windows: requests of a window over its seconds, at each step that holds a request."""
    steps = roles.requests(spark, d).groupBy("service", (F.floor(series.epoch() / 300) * 300).alias("epoch")).agg(F.count(F.lit(1)).alias("n"))
    rules = targets_rules(spark, d).filter("sli_type = 'throughput'").select("service", "alert", F.round("sla_target", 9).alias("sla_target"), "burn_rate", "error_budget_percent", "long_window", "short_window")
    return _counted(alerts.evaluate(steps, rules, ["service"], ("n",), RULE_WINDOWS, alerts.starved))


@query
def latency_alerts(spark, d):
    rules = targets_rules(spark, d).filter("sli_type = 'latency'").select("service", "alert", "threshold", "long_window", "short_window")
    sla = proposals(spark, d).filter("sli_type = 'latency'").select("service", F.round("sla_target", 4).alias("sla_target"))
    steps = alerts.latency_steps(roles.requests(spark, d), ["service"], sla, "latency_ms", F.floor(series.epoch() / 300) * 300)
    return _counted(alerts.evaluate(steps, rules, ["service"], ("hits", "n"), RULE_WINDOWS, alerts.slow))


def cpu_steps(spark, d) -> DataFrame:
    return alerts.cpu_utilization(roles.gauges(spark, d), ["service"], "cpu", F.floor(series.epoch() / 86400) * 86400)


@query
def record_cpu(spark, d):
    return rounded(cpu_steps(spark, d))


@query
def saturation_alerts(spark, d):
    # Gauges come by the day, so a week and a day stand for the rules' hours.
    rules = targets_rules(spark, d).filter("sli_type = 'saturation' and sli_name = 'cpu'").select("service", "alert", F.round("sla_target", 6).alias("sla_target"), "burn_rate", "error_budget_percent", F.lit("7d").alias("long_window"), F.lit("1d").alias("short_window"))
    return _counted(alerts.evaluate(cpu_steps(spark, d), rules, ["service"], "cpu", [7 * 86400, 86400], alerts.saturated))


# Payloads: the tables as documents of the sources' interfaces, read by their readers


def _payloads(spark, docs: DataFrame) -> str:
    """A folder with a JSON document of every row a line."""
    at = f"{_work_dir(spark)}/payloads"
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.text(at)
    return at


#: Samples of a document at most.
PAYLOAD_ROWS = 4000


@query
def payload_spans(spark, d):
    s = own_spans(spark, d)
    span = F.struct(F.col("trace_id").cast("string").alias("spanID"), F.lit("line").alias("name"), F.col("service").alias("serviceName"), F.col("duration_ns").cast("string").alias("durationNanos"))
    traces = s.groupBy("trace_id", "root_service").agg((F.max("duration_ns") / 1e6).cast("bigint").alias("ms"), F.collect_list(span).alias("spans"))
    trace = F.struct(F.col("trace_id").cast("string").alias("traceID"), F.col("root_service").alias("rootServiceName"), F.col("ms").alias("durationMs"), F.array(F.struct("spans")).alias("spanSets"))
    read = telemetry.scan_spans(spark, _payloads(spark, traces.select(F.array(trace).alias("traces"))), lines=True)
    return read.groupBy("root_service", "service").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("trace_id").alias("traces"), F.sum("duration_ns").alias("duration_ns"), F.sum("trace_ms").alias("trace_ms"))


@query
def payload_logs(spark, d):
    rows = roles.logs(spark, d).withColumn("n", F.monotonically_increasing_id())
    stream = F.struct(F.create_map(F.lit("service"), F.col("service"), F.lit("error_type"), F.col("error_type")).alias("stream"), F.array(F.array(F.col("n").cast("string"), F.concat(F.lit('failed with "'), F.col("error_type"), F.lit('"')))).alias("values"))
    read = telemetry.scan_logs(spark, _payloads(spark, rows.select(F.struct(F.array(stream).alias("result")).alias("data"))), lines=True)
    return read.groupBy(F.col("labels")["service"].alias("service"), F.col("labels")["error_type"].alias("error_type")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query
def payload_samples(spark, d):
    # A source limits the points of a response, so a document holds those of so many rows of input at most.
    batch = F.floor(F.monotonically_increasing_id() / PAYLOAD_ROWS)
    docs = samples(spark, d).withColumn("batch", batch).groupBy("service", "code", "batch").agg(F.array_sort(F.collect_list(F.struct(F.unix_timestamp("ts").alias("t"), F.col("value").alias("v")))).alias("rows"))
    pairs = F.transform("rows", lambda r: F.format_string('[%d,"%s"]', r["t"], F.round(r["v"], 3).cast("string")))
    result = F.struct(F.create_map(F.lit("service"), F.col("service"), F.lit("code"), F.col("code")).alias("metric"), pairs.alias("values"))
    # Pairs of unlike kinds are spliced into the text, as JSON of a typed array would quote them.
    text = F.concat(F.lit('{"data":{"result":[{"metric":'), F.to_json("r.metric"), F.lit(',"values":['), F.array_join("r.values", ","), F.lit("]}]}}"))
    at = f"{_work_dir(spark)}/payloads"
    docs.select(result.alias("r")).select(text.alias("value")).write.text(at)
    read = telemetry.scan_samples(spark, at, lines=True)
    return rounded(read.groupBy(F.col("labels")["service"].alias("service"), F.col("labels")["code"].alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("epoch").cast("bigint").alias("first"), F.max("epoch").cast("bigint").alias("last")), 3)


@query
def payload_evidence(spark, d):
    """Evidence written as JSON and read again gives the same baselines; none violates its contract."""
    read = telemetry.read_evidence(spark, _payloads(spark, bundles(spark, d).drop("win").withColumn("service", F.concat("service", F.lit("/"), F.date_format("collected_at", "dd")))), lines=True)
    good, _ = documents.quarantine(read, documents.EVIDENCE)
    rows = evidence.baselines(good, ["service"])
    return rounded(rows.select("service", "namespace", "p50_ms", "p99_ms", "stddev_ms", "error_ratio", "mean_rps", "p95_rps", "cpu_mean_ratio", "top_dependency", "top_category", "sample_count"), 6)


@query
def span_rows(spark, d):
    """Spans of each root by service: calls, traces, longest."""
    s = own_spans(spark, d)
    rows = s.groupBy("service_key", "win", "service").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("trace_id").alias("traces"), (F.max("duration_ns") / 1e6).alias("longest_ms"))
    return rounded(rows)


@query
def log_lines(spark, d):
    return roles.logs(spark, d).groupBy("service", "win", F.coalesce(F.nullif("error_type", F.lit("")), F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("lines"))


# Fleet, artifacts


@query
def latest_artifact(spark, d):
    return store.latest(roles.artifacts(spark, d), tie="o_orderkey")


@query
def artifact_history(spark, d):
    return store.history(roles.artifacts(spark, d), 10, tie="o_orderkey").select("service", "artifact_type", "turn", "payload")


@query
def list_services(spark, d):
    return store.services(roles.artifacts(spark, d))


def statuses(spark, d) -> DataFrame:
    return fleet.service_status(roles.artifacts(spark, d), F.struct("stored_at", "o_orderkey"))


@query
def service_status(spark, d):
    return statuses(spark, d)


@query
def fleet_summary(spark, d):
    return fleet.summary(statuses(spark, d))


@query
def drift_monitor(spark, d):
    return fleet.drift_monitor(statuses(spark, d))


@query
def drift_counts(spark, d):
    return fleet.drift_counts(fleet.drift_monitor(statuses(spark, d)))


@query
def recommendations(spark, d):
    reports = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("s"), "l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("action"), "l_returnflag"))).alias("recommendations"))
    reports = reports.select(F.concat(F.lit("svc-"), F.col("s").cast("string")).alias("service"), "l_orderkey", "recommendations")
    rows = fleet.recommendations(reports)
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("open"), F.max("place").alias("last_place"))


# Grading, audit


def _cited_text() -> Column:
    return F.concat(F.lit("p99 of "), F.round("l_extendedprice", 0).cast("bigint").cast("string"), F.lit(" vs "), F.col("l_quantity").cast("bigint").cast("string"), F.lit("% in 24h, -"), F.col("l_linenumber").cast("string"), F.lit(".5x and "), F.col("l_suppkey").cast("string"), F.lit(" or 0 days, 7hot"))


@query
def cited_numbers(spark, d):
    numbers = fn.cited_numbers(_cited_text())
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(numbers, lambda x: F.format_string("%.1f", x)), ",").alias("cited"))


@query
def cited_in_conversations(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([0-9]+)"), F.lit(1)))).alias("numbers"), F.count_if(fn.has_actuation(F.col("text"))).alias("actuation"))


@query
def grounding(spark, d):
    v = grading.signal_values(drifts(spark, d), ["service"])
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", roles.service("l_suppkey").alias("service"), F.col("l_quantity").alias("q"))
    both = li.join(v, "service")
    text = F.concat(F.lit("about "), F.col("q").cast("string"))
    return both.groupBy("service").agg(F.count_if(grading.grounded(text, F.col("values"))).alias("grounded"), F.count(F.lit(1)).alias("n"))


@query
def actuation_hits(spark, d):
    docs = table(spark, d, "documents")
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " run kubectl now").when(F.col("doc_id") % 3 == 1, " POST https://x").otherwise(" postpone helmets"))
    return docs.select("doc_id", fn.has_actuation(text).alias("hit"))


def _reports(spark, d) -> DataFrame:
    """A report per service, each with a fault of its own or an oddity that is none."""
    drift_rows, s = _signals(spark, d)
    v = grading.signal_values(drift_rows, ["service"])
    n = F.substring("service", 5, 2).cast("int")
    cls = F.when(n == 7, "throughput_surge").otherwise(F.col("report_class"))
    sev = F.when(n == 8, "critical").otherwise(drift.severity(F.col("dominant_magnitude"), cls))
    most = F.element_at("values", -1)
    # One cites the magnitude alone, one a name, a share and a time, which are no values.
    cited = F.when(n == 1, F.col("dominant_magnitude")).when(n == 4, most * 1.5).otherwise(most)
    rationale = F.when(n == 6, F.lit("no figure")).otherwise(F.concat(F.lit("latency error capacity at "), F.format_string("%.4f", cited), F.when(n == 0, " by p99, up 40% in 24h").otherwise("")))
    action = F.when(n == 9, "kubectl scale").when(n == 2, "continue monitoring in 3 steps").otherwise("continue monitoring")
    plan = F.struct(F.lit("immediate").alias("priority"), F.lit("signals").alias("evidence_basis"), F.when(n != 5, "run again").alias("verification_method"))
    rec = F.array(F.struct(action.alias("action"), F.lit("high").alias("confidence"), rationale.alias("rationale"), plan.alias("remediation_plan")))
    cause = F.when(n == 3, "").otherwise("seen in signals")
    truth = s.join(v, "service").select(F.lit(1).alias("schema_version"), "service", F.col("report_class").alias("class"), "report_class", F.col("dominant_magnitude").alias("magnitude"), "values", cls.alias("classification"), sev.alias("severity"), cause.alias("likely_cause"), rec.alias("recommendations"))
    return truth.withColumns({"severity_range": F.array(F.lit("info"), F.lit("low"), F.lit("medium"), F.lit("high")), "category": drift.remedy(F.col("class"))})


@query
def grading_grid(spark, d):
    return grading.grade_reports(_reports(spark, d)).select("service", *grading.REPORT_GATES, "pass")


@query
def grading_totals(spark, d):
    return grading.gate_totals(grading.grade_reports(_reports(spark, d)), grading.REPORT_GATES)


def _graded_proposals(spark, d) -> DataFrame:
    """A proposal per service, some with a fault of their own."""
    b = baselines(spark, d).filter("win = 'baseline'")
    context = b.select("service", "top_dependency", "top_category", grading.baseline_values(b).alias("values"))
    n = F.substring("service", 5, 2).cast("int")
    seen = proposals_of(b.drop("win")).filter("sli_type != 'saturation'")
    faulty = seen.withColumns({"slo_target": F.when(n == 1, F.col("observed")).otherwise(F.col("slo_target")), "target_op": F.when(n == 5, "gte").otherwise(F.col("target_op"))})
    p = targets.check(faulty).join(context, "service")
    figure = F.when(n == 3, F.lit("no figure")).when(n == 4, F.lit("123456789.5")).otherwise(F.format_string("%.6f", "observed"))
    rationale = F.concat(F.lit("observed "), figure, F.lit(" with "), F.coalesce("top_dependency", F.lit("")), F.lit(" and "), F.when(n == 2, "").otherwise(F.coalesce("top_category", F.lit(""))))
    budget = F.when(n == 6, 101.0).when(n == 7, 0.0).otherwise(F.col("error_budget_percent"))
    p = p.withColumns({"rationale": F.when(n == 8, "").otherwise(rationale), "error_budget_percent": budget, "sli_definition": F.concat(F.lit("observed "), F.col("sli_type")), "burn_rate_policy": F.struct(F.col("burn_windows").alias("windows"))})
    return grading.grade_proposals(p, ["service"])


@query
def proposal_grid(spark, d):
    return _graded_proposals(spark, d)


@query
def proposal_totals(spark, d):
    return grading.gate_totals(_graded_proposals(spark, d), grading.PROPOSAL_GATES)


@query
def scorecard(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("prompt"), (F.col("o_totalprice") > 100000).alias("pass"), (F.col("o_totalprice") / 1000).alias("latency_s"))
    return rounded(grading.scorecard(o, ["model", "prompt"]), 5)


def _sections(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("section"), F.col("doc_id").alias("id"), F.struct(F.sha2("text", 256).alias("sha256"), F.length("text").alias("n")).alias("text"), "lang", (F.length("text") / 7).alias("ratio"))
    return canonical.serialize(docs, ["ratio", "text", "lang", "id"])[0].select("doc_id", "section", "payload")


@query
def canonical_quarantine(spark, d):
    n = F.col("l_linenumber")
    odd = F.when(n == 3, float("nan")).when(n == 5, float("inf")).otherwise(F.col("l_discount"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.struct(odd.alias("share"), F.sqrt("l_extendedprice").alias("root"))).alias("parts"))
    good, aside = canonical.serialize(rows, ["parts", "l_linenumber"])
    counted = lambda df, name, *more: df.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), *more).withColumn("kind", F.lit(name))
    return counted(good, "kept", F.sum(F.conv(F.substring(F.md5("payload"), 1, 6), 16, 10).cast("bigint")).alias("digest")).unionByName(counted(aside, "aside", F.lit(0).cast("bigint").alias("digest")))


@query
def audit_hash(spark, d):
    return audit.audit(_sections(spark, d), ["doc_id"])


@query
def audit_verify(spark, d):
    s = _sections(spark, d)
    hashes = audit.audit(s, ["doc_id"]).filter("doc_id % 10 != 0").withColumn("sha256", F.when(F.col("doc_id") % 10 == 1, "x").otherwise(F.col("sha256")))
    checked = audit.verify(s.filter("doc_id % 10 != 2"), hashes, ["doc_id"])
    return checked.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query
def reproducible(spark, d):
    # The second run deals its rows anew, so that it shares no stage with the first.
    a, b = (audit.audit(s, ["doc_id"]).select("doc_id", "sha256") for s in (_sections(spark, d), _sections(spark, d).repartition(13, "section")))
    return audit.differences(a, b).agg(F.count(F.lit(1)).alias("differences"))


# Streams; the batch twins have SQL


def _stream_of(spark, d, name: str) -> DataFrame:
    """The rows of a table as a stream, whether it is a file or a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    is_dir = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", "*.parquet" if is_dir else f"{name}.parquet").parquet(f"{d}/{name}.parquet" if is_dir else d)


def _request_stream(spark, d) -> DataFrame:
    return _stream_of(spark, d, "events").select(roles.service("user_id").alias("service"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("is_error"))


def _work_dir(spark) -> str:
    base_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not base_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base_dir = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
    return f"{base_dir.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _through(spark, stream: DataFrame) -> DataFrame:
    at = _work_dir(spark)
    streaming.run_to_table(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query
def stream_indicators(spark, d):
    return _through(spark, streaming.stream_indicators(_request_stream(spark, d)))


def _latency_targets(spark, d) -> DataFrame:
    return proposals(spark, d).filter("sli_type = 'latency'").select("service", F.round("sla_target", 4).alias("sla_target"))


@query
def stream_record(spark, d):
    at = f"{_work_dir(spark)}/targets"
    _latency_targets(spark, d).write.parquet(at)  # so that no batch computes them again
    return _through(spark, streaming.stream_record(_request_stream(spark, d), spark.read.parquet(at)))


@query
def stream_cpu(spark, d):
    gauges = _stream_of(spark, d, "lineitem").select(roles.service("l_suppkey").alias("service"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_quantity") / 50).alias("cpu"))
    return _through(spark, streaming.stream_cpu(gauges))


@query
def stream_run_log(spark, d):
    at = _work_dir(spark)
    streaming.run_logged(spark, streaming.stream_indicators(_request_stream(spark, d)), f"indicators-{uuid.uuid4().hex}", f"{at}/out", f"{at}/state", f"{at}/log")
    return spark.read.schema(streaming.RUN_LOG).parquet(f"{at}/log").select("batch", "rows", "dropped", "state_rows")


def _stored_baseline(spark, d, at: str) -> DataFrame:
    """The baseline as a table, so that no batch of a stream computes it again."""
    columns = ["service", "p99_ms", "p50_ms", "stddev_ms", "error_ratio", "error_stddev", "availability", "mean_rps", "stddev_rps"]
    baselines(spark, d).filter("win = 'baseline'").select(*columns).write.parquet(at)
    return spark.read.parquet(at)


def _batches(spark, stream: DataFrame, make, at: str) -> DataFrame:
    """What ``make`` gives for each batch of the stream, one folder per batch."""
    # A run without a batch leaves the schema at least.
    make(spark.createDataFrame([], stream.schema)).write.parquet(f"{at}/out/batch=-1")
    streaming.run_batches(stream, lambda df, n: make(df).write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


@query
def stream_drift(spark, d):
    at = _work_dir(spark)
    b = _stored_baseline(spark, d, f"{at}/baseline")
    windows = streaming.stream_indicators(_request_stream(spark, d), "1 day", "12 hours")
    return _batches(spark, windows, lambda df: streaming.window_signals(df, b), at)


@query
def stream_status(spark, d):
    at = _work_dir(spark)
    b = _stored_baseline(spark, d, f"{at}/baseline")
    windows = streaming.stream_indicators(_request_stream(spark, d), "1 day", "12 hours")

    def artifacts(df: DataFrame) -> DataFrame:
        s = streaming.window_signals(df, b)
        both = F.array(*[F.struct(F.lit(kind).alias("artifact_type")) for kind in ("drift-signal", "drift-report")])
        return s.select("service", F.inline(both), F.col("window_end").alias("stored_at"), (F.size("all_breached_indicators") > 0).alias("breached"), F.col("report_class").alias("class"), "severity", F.lit(None).cast("string").alias("maturity_tier"))

    return fleet.service_status(_batches(spark, windows, artifacts, at), F.col("stored_at"))


@query
def batch_indicators(spark, d):
    rows = streaming.stream_indicators(roles.requests(spark, d), "1 day", "12 hours")
    return rounded(rows.select("service", F.unix_timestamp("window_end").alias("epoch"), "n", "error_ratio", "p99_ms", "p50_ms"))


@query
def batch_record(spark, d):
    rows = streaming.stream_record(roles.requests(spark, d), _latency_targets(spark, d))
    return rounded(rows.select("service", F.unix_timestamp("window_start").alias("epoch"), "rps", "error_ratio", "good_ratio"))


@query
def batch_cpu(spark, d):
    return rounded(streaming.stream_cpu(roles.gauges(spark, d)).select("service", F.unix_timestamp("window_start").alias("epoch"), "cpu"))


# The same by namespace and name: a name may be in use in several namespaces, as other services


NAMED = ["namespace", "service"]


@query
def baseline_by_namespace(spark, d):
    keys = [*NAMED, "win"]
    cells = base.cells(roles.requests_by_namespace(spark, d), keys, BOUNDS, F.date_trunc("hour", "ts"))
    rates = roles.rates_of(cells.groupBy(*keys, "hour").agg(F.sum("n").alias("n")), keys)
    rows = base.request_indicators(cells, keys, BOUNDS).join(base.rate_indicators(rates, keys), keys, "left")
    return rounded(rows, 5)


@query
def error_ratio_by_namespace(spark, d):
    return rounded(series.ratio_per_step(roles.requests_by_namespace(spark, d), NAMED, 6 * 3600, F.col("is_error")))


@query
def rate_by_namespace(spark, d):
    """Rates of counters of each namespace, summed by hour."""
    rows = roles.requests_by_namespace(spark, d).select(*NAMED, "event_id", "code", "ts", F.col("latency_ms").alias("value"))
    steps = series.deltas(rows, [*NAMED, "code"], ["ts", "event_id"]).groupBy(*NAMED, (F.floor(series.epoch() / 3600) * 3600).alias("epoch")).agg((F.sum("delta") / 3600).alias("rps"))
    return rounded(steps)


def _named_statuses(spark, d) -> DataFrame:
    return fleet.service_status(roles.artifacts_by_namespace(spark, d), F.struct("stored_at", "o_orderkey"), NAMED)


@query
def status_by_namespace(spark, d):
    return _named_statuses(spark, d)


@query
def fleet_by_namespace(spark, d):
    return fleet.summary(_named_statuses(spark, d), ["namespace"])


@query
def drift_monitor_by_namespace(spark, d):
    return fleet.drift_monitor(_named_statuses(spark, d), NAMED)


@query
def latest_by_namespace(spark, d):
    return store.latest(roles.artifacts_by_namespace(spark, d), (*NAMED, "artifact_type"), tie="o_orderkey")


@query
def batch_record_by_namespace(spark, d):
    """Each namespace's recorded share of good requests is against its own median as the agreement."""
    reqs = roles.requests_by_namespace(spark, d)
    targets = base.ranked_values(reqs, NAMED, "latency_ms", {"sla_target": (0.5, "ceil")}).drop("n")
    rows = streaming.stream_record(reqs, targets, keys=NAMED)
    return rounded(rows.select(*NAMED, F.unix_timestamp("window_start").alias("epoch"), "rps", "error_ratio", "good_ratio"))
