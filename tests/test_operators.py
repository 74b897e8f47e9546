import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import alerts, audit, baseline, contracts, drift, fleet, grading, provenance, series, targets
from tidemark.sources import artifacts, telemetry

INF = float("inf")
#: Bounds in seconds and cumulative counts of a service's latency; 42000 s in 100000 requests.
BUCKETS = [(0.005, 100), (0.01, 500), (0.025, 2000), (0.05, 5000), (0.1, 15000), (0.25, 40000), (0.5, 70000), (1.0, 85000), (2.5, 95000), (5.0, 99000), (10.0, 99800), (INF, 100000)]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_percentiles_and_spread_of_a_known_histogram(spark):
    h = spark.createDataFrame([("s", le * 1000, float(n)) for le, n in BUCKETS], "service string, le double, cum double")
    got = one(baseline.hist_quantiles(h, ["service"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}))
    assert [got.p50, got.p90, got.p95, got.p99] == pytest.approx([333.3333, 1750, 2500, 5000], rel=1e-5)
    seconds = h.withColumn("le", F.col("le") / 1000)
    sums = spark.createDataFrame([("s", 42000.0)], "service string, value_sum double")
    assert one(baseline.hist_stddev(seconds, sums, ["service"])).stddev * 1000 == pytest.approx(1356.368, rel=1e-5)


def test_percentile_beyond_the_finite_bounds_and_of_nothing(spark):
    h = spark.createDataFrame([("a", 5.0, 1.0), ("a", INF, 100.0), ("b", INF, 3.0), ("c", 5.0, 0.0), ("c", INF, 0.0)], "service string, le double, cum double")
    got = {r.service: r.q for r in baseline.hist_quantiles(h, ["service"], {"q": 0.99}).collect()}
    assert got == {"a": 5.0, "b": 0.0, "c": 0.0}


def test_errors(spark):
    df = spark.range(100000).select(F.lit("s").alias("service"), (F.col("id") < 230).alias("is_error"))
    got = one(baseline.errors(df, ["service"], F.col("is_error")))
    assert (got.error_ratio, got.error_stddev, got.availability) == pytest.approx((0.0023, 0.000151483, 0.9977), rel=1e-5)


@pytest.mark.parametrize("n", [1, 2, 7, 20, 99, 400])
def test_rank_percentiles(spark, n):
    values = sorted(float(i * 7 % 31) for i in range(n))
    df = spark.createDataFrame([("s", v) for v in values], "service string, v double")
    got = one(baseline.ranked_values(df, ["service"], "v", {"up": (0.95, "ceil"), "down": (0.99, "floor")}))
    assert got.up == values[math.ceil(0.95 * n) - 1] and got.down == values[int(0.99 * (n - 1))]


def test_top_dependencies_and_fallback(spark):
    rows = [("t1", "api", "api", 150), ("t1", "api", "db", 80), ("t2", "api", "api", 200), ("t2", "api", "db", 60), ("t3", "web", "db", 90)]
    s = spark.createDataFrame([("k", t, r, v, ms * 1_000_000) if r == "api" else ("w", t, r, v, ms * 1_000_000) for t, r, v, ms in rows], "key string, trace_id string, root_service string, service string, duration_ns long")
    own = {r.key: r.service_p99_ms for r in baseline.service_latency(s, ["key"]).collect()}
    assert own == {"k": 150.0}
    dep = one(baseline.top_dependencies(baseline.dependencies(s.filter("key = 'k'"), ["key"]), ["key"]))
    assert (dep.dependency, dep.p99_ms, dep.call_count) == ("db", 60.0, 2)
    traces = spark.createDataFrame([("w", "t3", "web", 120), ("k", "t1", "api", 999)], "key string, trace_id string, root_service string, trace_ms long")
    own = {r.key: r.service_p99_ms for r in baseline.service_latency(baseline.with_fallback(s, traces, ["key"]), ["key"]).collect()}
    assert own == {"k": 150.0, "w": 120.0}


def test_categories(spark):
    logs = spark.createDataFrame([("s", "timeout")] * 3 + [("s", "null_pointer"), ("t", ""), ("t", None)], "service string, error_type string")
    c = baseline.log_categories(logs, ["service"])
    assert {(r.service, r.category): r.ratio for r in c.collect()} == {("s", "timeout"): 0.75, ("s", "null_pointer"): 0.25, ("t", "unknown"): 1.0}
    assert one(baseline.category_map(c, ["service"]).filter("service = 's'")).error_rate_by_category == {"timeout": 0.75, "null_pointer": 0.25}


def deviations(spark, rows):
    return drift.deviation(spark.createDataFrame(rows, "live_value double, baseline_value double, sd double, unit string")).collect()


def test_bands_breaches_and_magnitudes(spark):
    a, b, c, d, e = deviations(spark, [(5000.0, 500.0, 100.0, "ms"), (700.0, 500.0, 100.0, "ms"), (0.5, 0.4, 0.0, "ratio"), (0.4, 0.4, 0.0, "ratio"), (0.0, 0.0, 0.1, "rps")])
    assert (a.band_lower, a.band_upper, a.breach_magnitude, a.rel_deviation, a.direction) == (300, 700, 22.5, 9.0, "increasing")
    assert not b.band_breach and b.breach_magnitude == 0
    assert c.breach_magnitude == INF and d.breach_magnitude == 0 and d.direction == e.direction == "stable"


def test_first_pass_classes(spark):
    names = [("latency_p99_ms", "decreasing"), ("error_rate_ratio", "increasing"), ("throughput_mean_rps", "decreasing"), ("cpu_mean_ratio", "decreasing"), ("availability_ratio", "decreasing"), ("dependency_p99_ms", "increasing"), ("error_top_category_ratio", "decreasing")]
    df = spark.createDataFrame(names, "n string, d string").select(drift.first_pass(F.col("n"), F.col("d"), F.lit(True)).alias("c"))
    assert [r.c for r in df.collect()] == ["latency_improvement", "error_rate_elevation", "throughput_collapse", "no_significant_drift", "availability_drop", "dependency_latency_regression", "error_category_shift"]


def test_dominant_signal_breaks_ties_in_indicator_order(spark):
    rows = [("s", 3, "error_rate_ratio", True, 4.000000000000001, "error_rate_elevation", "measured"), ("s", 4, "availability_ratio", True, 4.0000000000000036, "availability_drop", "measured"), ("s", 1, "latency_p99_ms", False, 0.0, "no_significant_drift", "measured"), ("t", 1, "latency_p99_ms", False, 0.0, "no_significant_drift", "skipped")]
    df = spark.createDataFrame(rows, "service string, ord int, name string, band_breach boolean, breach_magnitude double, first_pass_class string, status string")
    s, t = drift.report_class(drift.drift_signal(df, ["service"])).orderBy("service").collect()
    assert s.dominant_indicator == "error_rate_ratio" and s.all_breached_indicators == ["error_rate_ratio", "availability_ratio"]
    assert (t.dominant_indicator, t.dominant_class, t.dominant_magnitude, t.skipped, t.report_class) == ("none", "no_significant_drift", 0.0, 1, "no_significant_drift")


def test_severities(spark):
    df = spark.createDataFrame([(22.5, "latency_regression"), (5.0, "x"), (1.3, "x"), (0.0, "x"), (9.0, "latency_improvement")], "m double, c string")
    assert [r.s for r in df.select(drift.severity(F.col("m"), F.col("c")).alias("s")).collect()] == ["critical", "medium", "low", "info", "info"]


def test_targets_keep_their_own_checks(spark):
    seen = spark.createDataFrame([("latency", "l", 500.0, 95.0), ("availability", "a", 0.998, 0.0006), ("availability", "p", 1.0, 0.0), ("throughput", "t", 0.5, 0.1), ("saturation", "c", 0.2, None), ("error_rate", "z", 0.0, 0.0)], "sli_type string, sli_name string, observed double, sd double")
    p = targets.propose(seen, F.lit("growing"))
    got = {r.sli_name: r for r in targets.check(p).collect()}
    assert "z" not in got and all(not r.violations for r in got.values())
    assert got["l"].slo_target == pytest.approx(428.75) and got["l"].sla_target == pytest.approx(642.5) and got["l"].headroom.margin == pytest.approx(142.5)
    assert (got["p"].slo_target, got["p"].sla_target) == (0.999, 0.995)
    assert (got["c"].slo_target, got["c"].sla_target) == pytest.approx((0.17, 0.3))
    assert got["a"].error_budget_percent == pytest.approx((1 - got["a"].sla_target) * 100)


def test_violations_of_targets(spark):
    rows = [("latency", "gte", 400.0, 600.0, 500.0, 50.0), ("latency", "lte", 500.0, 500.0, 500.0, 50.0), ("latency", "lte", 450.0, 900.0, 500.0, 50.0), ("latency", "lte", 620.0, 600.0, 500.0, 50.0), ("throughput", "gte", 1.0, 9.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "sli_type string, target_op string, slo_target double, sla_target double, observed double, sd double")
    assert [r.violations for r in targets.check(df).collect()] == [["wrong_op"], ["slo_not_tighter", "slo_equals_observed", "sla_equals_observed", "wrong_order"], ["too_loose"], ["slo_not_tighter", "wrong_order"], []]
    assert targets.check(df, strict=True).collect()[-1].violations


def test_counters_with_resets_and_rates(spark):
    df = spark.createDataFrame([("s", i * 60, v) for i, v in enumerate([10.0, 15.0, 3.0, 8.0])], "k string, t int, value double").withColumn("ts", F.timestamp_seconds("t"))
    assert one(series.increase(df, ["k"], ["ts"])).increase == 13.0
    assert series.rate(df, ["k"], ["ts"], 300).orderBy("t").collect()[-1].rate == pytest.approx(13 / 300)


def test_step_grid(spark):
    df = spark.createDataFrame([("s", 30, 1.0), ("s", 60, 2.0), ("s", 1000, 9.0)], "k string, t int, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = series.align(df, ["k"], "1970-01-01 00:00:00", "1970-01-01 00:20:00", 60, 300).orderBy("ts").collect()
    assert [r.value for r in got] == [None] + [2.0] * 6 + [None] * 10 + [9.0] * 4


def test_alerts_need_both_windows(spark):
    steps = spark.createDataFrame([("s", i * 3600, 1.0 if i in (5, 6) else 0.0) for i in range(12)], "service string, epoch long, ratio double")
    rules = spark.createDataFrame([("s", "1h", "6h", 0.2)], "service string, short_window string, long_window string, threshold double")
    got = alerts.evaluate(steps, rules, ["service"], "ratio", [21600, 3600], alerts.over_budget).filter("firing").select("epoch").collect()
    assert [r.epoch // 3600 for r in got] == [6]


def test_budgets_follow_breached_names(spark):
    t = spark.createDataFrame([("s", "latency"), ("s", "saturation"), ("u", "latency")], "service string, sli_type string")
    d = spark.createDataFrame([("s", "latency_p99_ms", True), ("s", "cpu_mean_ratio", True), ("u", "latency_p99_ms", False)], "service string, name string, band_breach boolean")
    assert {(r.service, r.sli_type): r.budget_status for r in alerts.budgets(t, d, ["service"]).collect()} == {("s", "latency"): "burning", ("s", "saturation"): "healthy", ("u", "latency"): "healthy"}


def test_durations_names_and_numbers(spark):
    df = spark.createDataFrame([("30d",), ("90s",), ("5w",), ("36h",)], "t string").select(fn.duration_seconds(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [2592000, 90, None, 129600]
    assert [r.t for r in df.select(fn.duration_text(F.col("s")).alias("t")).collect()] == ["30d", "90s", None, "36h"]
    names = spark.createDataFrame([("Web-API latency",), ("9 lives!",), ("--",)], "n string")
    assert [r.m for r in names.select(fn.metric_segment(F.col("n")).alias("m")).collect()] == ["web_api_latency", "_9_lives", "unnamed"]
    assert one(names.limit(1).select(fn.alert_name(F.lit("web-api p99"), F.lit("critical")).alias("a"))).a == "SLOWebApiP99BurnRateCritical"
    text = "p99 rose to 640.5 from -3, 40% in 24h or 2x over 7hot 0 v8"
    assert one(spark.createDataFrame([(text,)], "t string").select(fn.cited_numbers(F.col("t")).alias("n"))).n == [640.5, -3.0, 7.0]
    acts = spark.createDataFrame([("use kubectl now",), ("helmets, curls",), ("```yaml\na",), ("put http://x",), (None,)], "t string")
    assert [r.h for r in acts.select(fn.has_actuation(F.col("t")).alias("h")).collect()] == [True, False, True, True, False]
    nums = spark.createDataFrame([(123456.789,), (INF,), (float("nan"),)], "x double").select(fn.canonical(F.col("x")).alias("c")).collect()
    assert [r.c for r in nums] == [123457.0, None, None]
    assert one(spark.createDataFrame([("1503", "x-1", "x")], "c string, p string, s string").select(fn.label_match(F.col("c"), "5..").alias("m"), fn.pod_of(F.col("p"), F.col("s")).alias("o")))[:] == (False, True)


def test_statuses(spark):
    rows = [("a", "drift-signal", 2, False, "x", None, None), ("a", "drift-signal", 1, True, "x", None, None), ("b", "drift-signal", 1, True, "latency_improvement", None, None), ("c", "drift-signal", 1, True, "x", None, None), ("c", "drift-report", 1, None, None, "high", None), ("d", "drift-signal", 1, True, "x", None, None), ("e", "baseline", 1, None, None, None, "new"), ("f", "proposal", 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "service string, artifact_type string, stored_at int, breached boolean, class string, severity string, maturity_tier string")
    s = fleet.service_status(df, F.col("stored_at"))
    assert {r.service: r.status for r in s.collect()} == {"a": "healthy", "b": "improving", "c": "critical", "d": "degraded", "e": "baselined", "f": "unknown"}
    assert one(fleet.summary(s))[:] == (6, 1, 1, 1, 1, 1, 1)
    assert [r.service for r in fleet.drift_monitor(s).collect()] == ["c", "a", "b", "d"]


def test_audit_finds_what_is_wrong(spark):
    p = spark.createDataFrame([("r", "a", "{}"), ("r", "b", "1"), ("r", "c", "2")], "run string, section string, payload string")
    h = audit.audit(p, ["run"])
    bad = h.filter("section != 'b'").withColumn("sha256", F.when(F.col("section") == "c", "x").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("r", "d", "", "y")], h.schema))
    assert {r.section: r.problem for r in audit.verify(p, bad, ["run"]).collect()} == {"a": None, "b": "missing hash", "c": "hash mismatch", "d": "orphan hash"}
    assert one(h.filter("section = 'a'")).sha256 == "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"
    assert audit.differences(h, h).isEmpty()


def test_contracts_split_rows(spark):
    df = spark.createDataFrame([("a", 1.0, [1.0]), (None, 2.0, [-1.0]), ("c", None, None)], "service string, x double, xs array<double>")
    good, aside = contracts.split(df, [contracts.required("service"), contracts.between("x", 0, 1.5), contracts.every("xs", lambda v: v > 0, "not positive")])
    assert [r.service for r in good.collect()] == ["a", "c"] and one(aside).violations == ["service: missing", "x: out of range", "xs: not positive"]


def test_grounding(spark):
    df = spark.createDataFrame([("p99 is 505 now", [500.0]), ("p99 is 520 now", [500.0]), ("no number", [0.0]), ("anything 7", [])], "t string, v array<double>")
    assert [r.g for r in df.select(grading.grounded(F.col("t"), F.col("v")).alias("g")).collect()] == [True, False, True, True]


def _report(spark, cls="latency_regression", severity="high", cause="p99 rose to 505", action="profile the latency", rationale="p99 at 505 against 500", plan=("immediate", "p99", "more", "look again"), values=(500.0, 0.0, 7.7), expected="latency_regression", magnitude=7.7, confidence="high"):
    schema = "schema_version int, service string, classification string, severity string, likely_cause string, recommendations array<struct<action:string,confidence:string,rationale:string,remediation_plan:struct<priority:string,evidence_basis:string,expected_impact:string,verification_method:string>>>, values array<double>, report_class string, magnitude double, class string, severity_range array<string>, category string"
    row = (1, "s", cls, severity, cause, [(action, confidence, rationale, plan)], list(values), expected, magnitude, expected, ["high", "critical"], "performance")
    return one(grading.grade_reports(spark.createDataFrame([row], schema)))


def test_gates_of_reports(spark):
    gates = lambda **x: (lambda r: [g for g in grading.REPORT_GATES if not r[g]])(_report(spark, **x))
    assert gates() == [] and _report(spark)["pass"]
    # The dominant magnitude is a value, steps in an action are no citation, a latency regression may be a shift.
    assert gates(cause="breach of 7.7", rationale="p99 is 7.7 spreads off") == []
    assert gates(action="profile the latency in 3 steps") == [] and gates(cls="distribution_shift") == ["classification_accuracy"]
    assert gates(rationale="p99 at 505, 40% up in 24h, 4x") == [] and gates(rationale="p99 at 505 and 3 more") == ["grounding"]
    assert gates(cause="0.00000000001 left of 505") == [] and gates(cause="0.00000000001 left of 505", values=(500.0,)) == ["grounding"]
    assert gates(cls="error_rate_elevation") == ["class_validity", "classification_accuracy"] and gates(cls="worse") == ["schema_valid", "class_validity", "classification_accuracy"]
    assert gates(expected="unheard_of") == ["classification_accuracy"]
    assert gates(action="kubectl get latency") == ["no_actuation"] and gates(rationale="no figure of latency") == ["rationale_quality"]
    assert gates(severity="info") == ["severity_calibration", "severity_consistent"] and gates(action="wait", rationale="at 505", cause="505") == ["remediation_relevance"]
    assert gates(plan=None) == ["remediation_depth"] and gates(plan=("now", "p99", "more", "look again")) == ["schema_valid"] and gates(confidence="sure") == ["schema_valid"]
    assert gates(cause="") == ["schema_valid"] and not _report(spark, cause="")["pass"]


def test_refined_classes_of_signals_are_mapped(spark):
    rows = [("a", "dependency_p99_ms", 9.0, "dependency_latency_regression"), ("b", "error_top_category_ratio", 9.0, "error_category_shift"), ("c", "error_top_category_ratio", 9.0, "error_category_shift"), ("c", "latency_p99_ms", 3.0, "latency_regression")]
    df = spark.createDataFrame([(s, i, n, m, c, True, "measured", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0) for i, (s, n, m, c) in enumerate(rows)], "service string, ord int, name string, breach_magnitude double, first_pass_class string, band_breach boolean, status string, live_value double, baseline_value double, abs_deviation double, rel_deviation double, band_upper double, band_lower double")
    classes = {r.service: r.report_class for r in drift.report_class(drift.drift_signal(df, ["service"])).collect()}
    assert classes == {"a": "latency_regression", "b": "error_rate_elevation", "c": "distribution_shift"}
    values = {r.service: r["values"] for r in grading.signal_values(df, ["service"]).collect()}
    assert values["c"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 9.0]


def test_gates_of_proposals(spark):
    windows = "struct<windows:array<struct<long_window:string,short_window:string,burn_rate:double,severity:string>>>"
    schema = f"service string, sli_name string, sli_type string, sli_definition string, slo_target double, sla_target double, target_op string, error_budget_percent double, burn_rate_policy {windows}, rationale string, observed double, violations array<string>, values array<double>, top_dependency string, top_category string"
    fine = dict(service="s", sli_name="n", sli_type="latency", sli_definition="d", slo_target=400.0, sla_target=600.0, target_op="lte", error_budget_percent=0.5, burn_rate_policy=([("1h", "5m", 14.4, "critical")],), rationale="500 ms, db", observed=500.0, violations=[], values=[500.0, 0.002], top_dependency="DB", top_category="null_pointer")
    ratio = dict(fine, sli_name="e", sli_type="error_rate", slo_target=0.001, sla_target=0.003, observed=0.002, rationale="0.002, null pointer")

    def gates(first=None, second=None):
        rows = [dict(fine, **(first or {})), dict(ratio, **(second or {}))]
        r = one(grading.grade_proposals(spark.createDataFrame([tuple(x[c] for c in fine) for x in rows], schema), ["service"]))
        assert r["pass"] == all(r[g] for g in grading.PROPOSAL_GATES)
        return [g for g in grading.PROPOSAL_GATES if not r[g]]

    assert gates() == [] and gates({"rationale": "about -500, db"}) == [] and gates({"rationale": "504 db"}) == []
    assert gates({"rationale": "506 db"}) == ["grounding", "rationale_quality"] and gates({"rationale": ""}) == ["schema_valid", "grounding", "rationale_quality", "trace_log_citation"]
    assert gates({"violations": ["too_loose"]}) == ["consistency"] and gates({"sli_type": "throughput"}) == ["indicator_appropriateness", "direction_validity"]
    assert gates({"error_budget_percent": 0.0}) == ["budget_coherence"] and gates({"error_budget_percent": 101.0}) == ["schema_valid", "budget_coherence"]
    assert gates({"burn_rate_policy": ([],)}) == ["schema_valid", "budget_coherence"] and gates({"slo_target": 500.0}) == ["margin_quality"] and gates({"slo_target": 500.0, "observed": None}) == []
    assert gates(None, {"target_op": "gte"}) == ["direction_validity"] and gates({"rationale": "500 ms"}) == ["trace_log_citation"] and gates(None, {"rationale": "0.002"}) == ["trace_log_citation"]


def test_readers_of_payloads(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text('{"data":{"result":[{"metric":{"le":"+Inf"},"values":[[1609459200,"100"],[1609459260,"x"]]}]}}')
    got = telemetry.scan_samples(spark, str(tmp_path / "m")).orderBy("epoch").collect()
    assert [(r.labels, r.epoch, r.value) for r in got] == [({"le": "+Inf"}, 1609459200.0, 100.0), ({"le": "+Inf"}, 1609459260.0, None)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text('{"traces":[{"traceID":"1","rootServiceName":"api","durationMs":9,"spanSets":[{"spans":[{"spanID":"x","name":"q","serviceName":"db","durationNanos":"80000000"}]}]},{"traceID":"2","rootServiceName":"api","durationMs":7}]}')
    got = telemetry.scan_spans(spark, str(tmp_path / "t")).orderBy("trace_id").collect()
    assert [(r.trace_id, r.service, r.duration_ns) for r in got] == [("1", "db", 80000000), ("2", None, None)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.json").write_text('{"data":{"result":[{"stream":{"level":"error"},"values":[["5","boom"],["6","bang"]]}]}}')
    assert [(r.ts_ns, r.line) for r in telemetry.scan_logs(spark, str(tmp_path / "l")).orderBy("ts_ns").collect()] == [(5, "boom"), (6, "bang")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e/a.json").write_text('{"schema_version":1,"service":"s","series":{"latency_histogram":{"buckets":[{"le":0.5,"count":1},{"le":"+Inf","count":2}]}}}')
    row = one(telemetry.read_evidence(spark, str(tmp_path / "e")).select("service", F.transform("series.latency_histogram.buckets", lambda b: b["le"].cast("double")).alias("le")))
    assert (row.service, row.le) == ("s", [0.5, INF])


def test_artifact_store(spark, tmp_path):
    path = str(tmp_path / "store")
    for i in range(3):
        artifacts.save(spark.createDataFrame([("s", "baseline", i, str(i)), (f"t{i}", "drift", i, "x")], "service string, artifact_type string, stored_at int, payload string"), path)
    a = spark.read.parquet(path)
    assert one(artifacts.latest(a).filter("service = 's'")).payload == "2"
    assert [r.payload for r in artifacts.history(a, 2).filter("service = 's'").orderBy("turn").collect()] == ["2", "1"]
    assert [r.service for r in artifacts.services(a).collect()] == ["s", "t0", "t1", "t2"]


def test_provenance_of_expected_keys(spark, tmp_path):
    rows = [("a", "w", f"2026-01-01 {h:02d}:30:00") for h in range(10)] + [("b", "w", f"2026-01-01 {h:02d}:00:00") for h in (0, 1, 2, 3, 4, 5, 9)] + [("c", "w", "2026-01-01 05:00:00")]
    samples = spark.createDataFrame(rows, "service string, win string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    expected = spark.createDataFrame([(s, "w") for s in "abcd"], "service string, win string")
    judged = provenance.judged(expected, provenance.sources(samples, ["service", "win"], "events", 3600), ["service", "win"], "2026-04-20")
    got = {r.service: (r.source_rows, r.status, r.coverage_status, r.band_multiplier, r.baseline_age_days) for r in judged.collect()}
    assert got == {"a": (10, "stale", "ok", 1.0, 109), "b": (7, "stale", "warn", 1.5, 109), "c": (1, "stale", "fail", 1.0, 109), "d": (0, "no_data", "fail", 1.0, None)}
    fresh = provenance.judged(expected, provenance.sources(samples, ["service", "win"], "events", 3600), ["service", "win"], "2026-02-01")
    assert {r.service: r.status for r in fresh.collect()} == {"a": "ok", "b": "ok", "c": "ok", "d": "no_data"}
    for _ in range(2):
        row = provenance.write_observed(judged, str(tmp_path / "out"), "baselines", str(tmp_path / "log"))
    assert (row["rows"], row["keys_without_data"]) == (4, 1) and row["coverage"] == pytest.approx((1 + 0.7 + 0.1) / 3)
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(log) == 2 and log[0].rows == 4 and str(log[0].last_ts) == "2026-01-01 09:30:00" and spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_one_pass_over_requests_equals_the_parts(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), "w", f"2026-01-01 {rng.randrange(24):02d}:00:00", rng.choice([None, 3.0, 30.0, 300.0, 3000.0, rng.uniform(0, 600)]), rng.random() < 0.2) for _ in range(600)]
    reqs = spark.createDataFrame(rows, "service string, win string, ts string, latency_ms double, is_error boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    keys, bounds = ["service", "win"], [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, INF]
    got = {r.service: r for r in baseline.request_indicators(baseline.cells(reqs, keys, bounds, F.date_trunc("hour", "ts")), keys, bounds).collect()}
    for r in baseline.latency(reqs, keys, "latency_ms", bounds).join(baseline.errors(reqs, keys, F.col("is_error")), keys).collect():
        mine = got[r.service].asDict()
        assert all(mine[c] == (pytest.approx(v) if isinstance(v, float) else v) for c, v in r.asDict().items())


def test_drift_of_two_windows_in_one_table(spark):
    columns = "p99_ms p50_ms stddev_ms error_ratio error_stddev availability mean_rps stddev_rps cpu_mean_ratio memory_mean_ratio top_dependency_p99_ms top_category_ratio".split()
    flags = "saturation_available trace_available breakdown_available".split()
    rows = [("a", "live", *[2.0] * 12, True, True, True), ("a", "base", *[1.0] * 12, True, False, True), ("b", "base", *[1.0] * 12, True, True, True), ("c", "live", *[1.0] * 12, True, True, True)]
    df = spark.createDataFrame(rows, "service string, win string, " + ", ".join(f"{c} double" for c in columns) + ", " + ", ".join(f"{f} boolean" for f in flags))
    of = lambda w: df.filter(F.col("win") == w).drop("win")
    apart = drift.drift_indicators(of("live"), of("base"), ["service"])
    assert audit.differences(drift.drift_of_windows(df, ["service"], "win", "live", "base"), apart).isEmpty() and apart.count() == 8 + 7


def test_a_name_in_two_namespaces_is_two_services(spark):
    keys = ["namespace", "service"]
    rows = [("shop", "a", "drift-signal", 1, True, "x", None, None), ("core", "a", "baseline", 1, None, None, None, "new"), (None, "a", "drift-signal", 1, False, "x", None, None), ("core", "b", "drift-signal", 2, True, "x", None, None), ("core", "b", "drift-report", 1, None, None, "high", None)]
    df = spark.createDataFrame(rows, "namespace string, service string, artifact_type string, stored_at int, breached boolean, class string, severity string, maturity_tier string")
    s = fleet.service_status(df, F.col("stored_at"), keys)
    assert {(r.namespace, r.service): r.status for r in s.collect()} == {("shop", "a"): "degraded", ("core", "a"): "baselined", (None, "a"): "healthy", ("core", "b"): "critical"}
    assert {r.namespace: (r.total_services, r.critical) for r in fleet.summary(s, ["namespace"]).collect()} == {"shop": (1, 0), "core": (2, 1), None: (1, 0)}
    assert [(r.namespace, r.service) for r in fleet.drift_monitor(s, keys).collect()][0] == ("core", "b")
    rules = spark.createDataFrame([("shop", "a", "critical"), ("core", "a", "warning"), ("core", "a", "critical")], "namespace string, service string, severity string")
    assert one(alerts.summary(rules, ("namespace", "service")))[:] == (3, 2, 1, 2)


def test_streams_keep_namespaces_apart(spark):
    from tidemark.streaming import windows

    keys = ["namespace", "service"]
    rows = [(n, "a", f"2026-01-01 08:{m:02d}:00", 20.0 if n == "shop" else 300.0, n == "core" and m % 2 == 0) for n in ("shop", "core") for m in range(60)]
    reqs = spark.createDataFrame(rows, "namespace string, service string, ts string, latency_ms double, is_error boolean")
    seen = windows.stream_indicators(reqs, "1 hour", "1 hour", keys=keys)
    assert {r.namespace: (r.n, r.error_ratio) for r in seen.collect()} == {"shop": (60, 0.0), "core": (60, 0.5)}
    sla = spark.createDataFrame([("shop", "a", 10.0), ("core", "a", 400.0)], "namespace string, service string, sla_target double")
    assert {r.namespace: r.good_ratio for r in windows.stream_record(reqs, sla, length="1 hour", keys=keys).collect()} == {"shop": 0.0, "core": 1.0}
    base = spark.createDataFrame([(n, "a", 25.0, 20.0, 5.0, 0.0, 0.01, 1.0, 60 / 3600, 0.001) for n in ("shop", "core")], "namespace string, service string, p99_ms double, p50_ms double, stddev_ms double, error_ratio double, error_stddev double, availability double, mean_rps double, stddev_rps double")
    assert {r.namespace: r.report_class != "no_significant_drift" for r in windows.window_signals(seen, base, keys).collect()} == {"shop": False, "core": True}
