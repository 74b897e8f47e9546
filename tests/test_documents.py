import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.operators import documents, evidence
from tidemark.sources import telemetry

BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, "+Inf"]
COUNTS = [100, 500, 2000, 5000, 15000, 40000, 70000, 85000, 95000, 99000, 99800, 100000]
CPU = [0.32, 0.35, 0.41, 0.38, 0.29, 0.72, 0.45, 0.33, 0.36, 0.40]
MEMORY = [0.58, 0.61, 0.63, 0.59, 0.65, 0.78, 0.62, 0.60, 0.64, 0.61]


def document(**changes):
    day = lambda i: f"2026-01-{i + 1:02d}T00:00:00Z"
    doc = {
        "schema_version": 2, "service": "checkout", "namespace": "shop", "lookback_window": "30d", "collected_at": day(30), "coverage_ratio": 0.98,
        "series": {
            "latency_histogram": {"metric_name": "h", "buckets": [{"le": b, "count": c} for b, c in zip(BOUNDS, COUNTS)], "total_count": 100000, "sum": 42000.0},
            "request_total": {"metric_name": "r", "total": 100000, "rate_samples": [{"timestamp": day(i), "value": 2.0 + i / 10} for i in range(30)]},
            "error_total": {"metric_name": "e", "total": 230},
            "saturation": {"cpu": {"metric_name": "c", "samples": CPU}, "memory": {"metric_name": "m", "samples": MEMORY}, "available": True},
            "traces": {"available": True, "span_latency_p99_ms": 200.0, "top_dependencies": [{"service": "db", "p99_ms": 80.0, "call_count": 2}, {"service": "cache", "p99_ms": 150.0, "call_count": 9}, {"service": "late", "p99_ms": 150.0, "call_count": 1}]},
            "logs": {"available": True, "error_breakdown": [{"category": "timeout", "count": 3, "ratio": 0.75}, {"category": "null_pointer", "count": 1, "ratio": 0.25}]},
        },
        "provenance": {"prometheus_endpoint": "http://m", "query_timestamps": {"start": day(0), "end": day(30)}, "queries": {"latency": "q1"}},
    }
    for path, value in changes.items():
        at = doc
        *to, last = path.split("__")
        for p in to:
            at = at[int(p)] if p.isdigit() else at[p]
        if value is None:
            del at[int(last) if last.isdigit() else last]
        else:
            at[int(last) if last.isdigit() else last] = value
    return doc


def read(spark, tmp_path, docs):
    for i, doc in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc | {"service": f"{i}"} if doc.get("service") == "checkout" else doc))
    return telemetry.read_evidence(spark, str(tmp_path))


def test_baseline_of_a_document(spark, tmp_path):
    (row,) = evidence.baselines(read(spark, tmp_path, [document()]), ["service"]).collect()
    near = lambda x: pytest.approx(x, rel=1e-5)
    assert (row.p50_ms, row.p90_ms, row.p95_ms, row.p99_ms, row.stddev_ms) == (near(1000 / 3), near(1750), near(2500), near(5000), near(1356.37)) and row.sample_count == 100000
    assert (row.error_ratio, row.error_stddev, row.availability, row.error_count, row.total_count) == (near(0.0023), near(0.000151483), near(0.9977), 230, 100000)
    assert (row.mean_rps, row.p95_rps, row.rate_samples) == (near(3.45), near(4.8), 30) and row.stddev_rps == near(math.sqrt(sum((i / 10 - 1.45) ** 2 for i in range(30)) / 30))
    assert (row.cpu_mean_ratio, row.cpu_p95_ratio, row.memory_mean_ratio, row.memory_p95_ratio, row.saturation_available) == (near(0.401), 0.72, near(0.631), 0.78, True)
    assert (row.top_dependency, row.top_dependency_p99_ms, row.top_dependency_contribution, row.service_p99_ms) == ("cache", 150.0, 0.75, 200.0)
    assert (row.top_category, row.top_category_ratio, row.categories, row.coverage_ratio) == ("timeout", 0.75, 2, 0.98)


def test_documents_that_lack_parts(spark, tmp_path):
    bare = document(series__saturation=None, series__traces=None, series__logs=None, series__request_total__rate_samples=None)
    none = document(series__request_total__total=0, series__error_total__total=0, series__latency_histogram__total_count=0, series__latency_histogram__buckets=[], series__traces__top_dependencies=[], series__logs__error_breakdown=[], series__saturation__cpu__samples=[])
    beyond = document(series__latency_histogram__buckets=[{"le": 0.5, "count": 1}, {"le": "+Inf", "count": 100}], series__latency_histogram__total_count=100)
    bare, none, beyond = evidence.baselines(read(spark, tmp_path, [bare, none, beyond]), ["service"]).orderBy("service").collect()
    assert (bare.mean_rps, bare.p95_rps, bare.stddev_rps, bare.rate_samples) == (0.0, 0.0, 0.0, 0) and bare.cpu_mean_ratio is None and not (bare.saturation_available or bare.trace_available or bare.breakdown_available)
    assert none.error_ratio is None and none.p50_ms == 0.0 and none.stddev_ms is None and (none.top_dependency, none.top_dependency_contribution, none.top_category, none.categories, none.cpu_mean_ratio) == ("unknown", 0.0, "unknown", 0, 0.0)
    assert (beyond.p50_ms, beyond.p99_ms) == (500.0, 500.0)


def test_violations_name_their_paths(spark, tmp_path):
    cases = [
        (document(), []), (document(coverage_ratio=1.2), [("coverage_ratio", "above")]), (document(namespace=""), [("namespace", "too short")]), (document(lookback_window="30 days"), [("lookback_window", "malformed")]),
        (document(schema_version=0), [("schema_version", "below")]), (document(series__error_total=None), [("series.error_total", "missing")]), (document(series__error_total__metric_name=None), [("series.error_total.metric_name", "missing")]),
        (document(series__latency_histogram__buckets__2__count=-1), [("series.latency_histogram.buckets[2].count", "below")]), (document(series__latency_histogram__buckets__0__le="wide"), [("series.latency_histogram.buckets[0].le", "malformed")]),
        (document(series__logs__error_breakdown__1__ratio=7.0, series__traces__top_dependencies__0__p99_ms=None), [("series.traces.top_dependencies[0].p99_ms", "missing"), ("series.logs.error_breakdown[1].ratio", "above")]),
        (document(series__saturation=None, series__traces=None, series__logs=None), []), (document(provenance__query_timestamps=None), [("provenance.query_timestamps", "missing")]),
    ]
    df = read(spark, tmp_path, [doc for doc, _ in cases])
    got = {int(r.service): [tuple(v) for v in r.v] for r in df.select("service", documents.violations(df, documents.EVIDENCE).alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    good, aside = documents.quarantine(df, documents.EVIDENCE)
    assert good.count() == 2 and documents.by_path(aside, ["service"]).count() == 11


def test_a_baseline_from_evidence_keeps_its_contract(spark, tmp_path):
    docs = evidence.baseline_documents(evidence.baselines(read(spark, tmp_path, [document(), document(series__traces=None)]), ["service"]), ["service"])
    assert docs.filter(documents.keeps(docs, documents.BASELINE)).count() == 2
    assert docs.filter("indicators.trace_latency is null").count() == 1
    worse = docs.withColumn("indicators", F.col("indicators").withField("availability.ratio", F.lit(1.5)))
    assert worse.select(documents.violations(worse, documents.BASELINE).alias("v")).first().v[0].path == "indicators.availability.ratio"
    assert documents.violations(docs.drop("namespace"), documents.BASELINE) is not None and docs.drop("namespace").filter(documents.keeps(docs.drop("namespace"), documents.BASELINE)).isEmpty()


def test_contracts_of_signals_reports_and_proposals(spark):
    kept = lambda text, name: (lambda df: [tuple(v) for v in df.select(documents.violations(df, documents.CONTRACTS[name]).alias("v")).first().v])(spark.createDataFrame([(text,)], "t string").select(F.from_json("t", F.schema_of_json(F.lit(text))).alias("d")).select("d.*"))
    report = {"schema_version": 1, "service": "s", "classification": "latency_regression", "severity": "high", "likely_cause": "c", "recommendations": [{"action": "a", "confidence": "high", "rationale": "r", "remediation_plan": {"priority": "immediate", "evidence_basis": "e", "expected_impact": "i", "verification_method": "v"}}]}
    assert kept(json.dumps(report), "drift-report") == []
    worse = report | {"classification": "worse", "recommendations": [report["recommendations"][0] | {"confidence": "sure", "remediation_plan": {"priority": "now"}}, {"action": "", "confidence": "low", "rationale": "r"}]}
    assert kept(json.dumps(worse), "drift-report") == [("classification", "not allowed"), ("recommendations[0].confidence", "not allowed"), ("recommendations[0].remediation_plan.priority", "not allowed"), ("recommendations[1].action", "too short")]
    slo = {"sli_name": "n", "sli_type": "latency", "sli_definition": "d", "slo_target": 1.5, "sla_target": 2.5, "target_op": "lte", "error_budget_percent": 0.5, "burn_rate_policy": {"windows": [{"long_window": "1h", "short_window": "5m", "burn_rate": 14.4, "severity": "critical"}]}, "rationale": "r"}
    proposal = {"schema_version": 3, "service": "s", "baseline_schema_version": 1, "slos": [slo, slo | {"target_op": "eq", "error_budget_percent": 101.0}, slo | {"burn_rate_policy": {"windows": []}}]}
    assert kept(json.dumps(proposal), "proposal") == [("slos[1].target_op", "not allowed"), ("slos[1].error_budget_percent", "above"), ("slos[2].burn_rate_policy.windows", "too short")]
    signal = {"schema_version": 2, "service": "s", "evaluation_window": "24h", "evaluated_at": "t", "baseline_schema_version": 1, "indicators": [{"name": "x", "direction": "up"}], "dominant_signal": {"indicator": "x", "class": "error_category_shift", "breach_magnitude": 1.0}, "all_breached_indicators": [], "provenance": {"prometheus_endpoint": "p", "query_timestamps": {"start": "a", "end": "b"}, "coverage_ratio": 1.0}}
    found = kept(json.dumps(signal), "drift-signal")
    assert ("schema_version", "not allowed") in found and ("indicators[0].direction", "not allowed") in found and ("indicators[0].live_value", "missing") in found and len(found) == 10


def test_unknown_keys(spark):
    df = spark.createDataFrame([('{"service":"s","extra":1}',), ("no json",), (None,)], "payload string")
    assert [[tuple(v) for v in r.v] for r in df.select(documents.unknown_keys(F.col("payload"), documents.EVIDENCE).alias("v")).collect()] == [[("extra", "unknown")], [], []]


def cleaned(x):
    if isinstance(x, float):
        return float(f"{x:.6g}")
    return {k: cleaned(v) for k, v in x.items()} if isinstance(x, dict) else [cleaned(v) for v in x] if isinstance(x, list) else x


def test_canonical_json_is_sorted_at_every_depth(spark):
    values = [0.0, 0.0023, 42000.0, 333.3333333, 1e-5, 1.5e-7, 123456789.0, 1e15, 1.2345678e16, 1e300, -0.5, 99999.96, 1.0, 0.00012345678]
    parts = [{"b": v, "a": i, "t": {"z": True, "y": 'é "quoted"\n\\ 😀'}, "none": []} for i, v in enumerate(values)]
    schema = "b double, a int, t struct<z:boolean,y:string>, none array<int>, m map<string,double>"
    rows = [(p["b"], p["a"], (True, p["t"]["y"]), [], {"k2": p["b"], "k1": 1.0}) for p in parts]
    df = spark.createDataFrame(rows, schema)
    good, aside = canonical.serialize(df, ["b", "t", "a", "none", "m"])
    want = {p["a"]: json.dumps(cleaned(p | {"m": {"k2": p["b"], "k1": 1.0}}), sort_keys=True, indent=2, ensure_ascii=True) + "\n" for p in parts}
    assert {r.a: r.payload for r in good.collect()} == want and aside.isEmpty()
    other = canonical.serialize(df.select("m", "none", "a", "t", "b"), ["m", "none", "a", "t", "b"])[0]
    assert {r.a: r.payload for r in other.collect()} == want


def test_what_json_cannot_say_goes_aside(spark):
    rows = [(1, [(1.0,)], {"k": 2.0}), (2, [(float("nan"),)], {}), (3, [], {"k": float("inf")}), (4, None, None), (5, [None], {"k": None})]
    good, aside = canonical.serialize(spark.createDataFrame(rows, "id int, parts array<struct<x:double>>, m map<string,double>"), ["id", "parts", "m"])
    assert {r.id for r in aside.collect()} == {2, 3} and {r.id: json.loads(r.payload) for r in good.collect()} == {1: {"id": 1, "parts": [{"x": 1.0}], "m": {"k": 2.0}}, 4: {"id": 4}, 5: {"id": 5, "parts": [None], "m": {"k": None}}}


def test_a_value_is_rendered_once_however_deep(spark):
    values = [0.0, -0.0, 1e-5, 9.9999999e-5, 0.00012345678, 0.1, -1 / 3, 42000.0, 999999.6, 123456789.0, 9.999999e15, 1e16, 1e-300, -1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    kept, _ = canonical.serialize(df.select("x", F.array(F.struct(F.array(F.struct(F.array(F.struct("x")).alias("c"))).alias("b"))).alias("a")), ["a"])
    # The form of six digits, of the plain one where it is short and of the other where it isn't.
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("format_string") == 3

    def want(v):
        six = float(f"{v:.5e}")
        return repr(six) if six and not 1e-4 <= abs(six) < 1e16 else "0.0" if not six else repr(six)

    for r in kept.collect():
        assert json.loads(r.payload) == {"a": [{"b": [{"c": [{} if r.x is None else {"x": float(f"{r.x:.5e}")}]}]}]}
        assert r.x is None or f'"x": {want(r.x)}\n' in r.payload, (r.x, r.payload)
