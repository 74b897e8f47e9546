"""Contracts of nested documents, as data: what a field must be, compiled into columns that name the path of every violation.

A document is a row; its parts are structs, arrays and maps. Rows with violations go aside, with the list of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tidemark.operators.drift import REMEDIES
from tidemark.operators.fleet import RANKS
from tidemark.operators.targets import MARGINS, OPERATORS

FOUND = "array<struct<path: string, rule: string>>"


@dataclass(frozen=True)
class Field:
    """What a value must be. ``parts``: fields of a struct, ``items``: what each element of an array must be, ``least`` and ``most``: bounds of a number, ``shortest``: of a text or array."""

    required: bool = False
    least: float | None = None
    most: float | None = None
    one_of: tuple = ()
    pattern: str | None = None
    shortest: int = 0
    parts: dict[str, Field] = field(default_factory=dict)
    items: Field | None = None

    def needed(self) -> Field:
        return Field(True, self.least, self.most, self.one_of, self.pattern, self.shortest, self.parts, self.items)


def _join(arrays: list[Column]) -> Column:
    return reduce(F.concat, arrays) if arrays else F.lit(None).cast(FOUND)


def _one(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def _none() -> Column:
    return F.array().cast(FOUND)


def _found(value: Column, path: Column, rule: Field, kind: DataType) -> Column:
    checks = []
    if rule.least is not None:
        checks.append((value < F.lit(rule.least), "below"))
    if rule.most is not None:
        checks.append((value > F.lit(rule.most), "above"))
    if rule.one_of:
        checks.append((~value.isin(*rule.one_of), "not allowed"))
    if rule.pattern:
        checks.append((~value.rlike(rule.pattern), "malformed"))
    if rule.shortest:
        size = F.size(value) if isinstance(kind, ArrayType) else F.length(value)
        checks.append((size < rule.shortest, "too short"))
    found = [F.when(F.coalesce(bad, F.lit(False)), _one(path, name)).otherwise(_none()) for bad, name in checks]
    if rule.parts:
        if not isinstance(kind, StructType):
            raise TypeError(f"a field with parts must be a struct, not {kind.simpleString()}")
        have = {f.name: f.dataType for f in kind.fields}
        for name, part in rule.parts.items():
            at = F.concat(path, F.lit(f".{name}"))
            if name in have:
                found.append(_found(value[name], at, part, have[name]))
            elif part.required:
                found.append(_one(at, "missing"))
    if rule.items is not None:
        if not isinstance(kind, ArrayType):
            raise TypeError(f"a field with items must be an array, not {kind.simpleString()}")
        each = F.transform(value, lambda x, i: _found(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), rule.items, kind.elementType))
        found.append(F.flatten(each))
    inside = _join(found) if found else _none()
    return F.when(value.isNull(), _one(path, "missing") if rule.required else _none()).otherwise(inside)


def violations(df: DataFrame, contract: dict[str, Field]) -> Column:
    """Every violation of a row: path (``series.buckets[2].count``) and rule (missing, below, above, not allowed, malformed, too short). A column that is not there is missing throughout."""
    have = {f.name: f.dataType for f in df.schema.fields}
    found = [_found(F.col(f"`{name}`"), F.lit(name), rule, have[name]) if name in have else (_one(F.lit(name), "missing") if rule.required else _none()) for name, rule in contract.items()]
    return _join(found)


def unknown_keys(payload: Column, contract: dict[str, Field]) -> Column:
    """Top-level keys of a document's text that its contract does not name, as violations."""
    extra = F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*[F.lit(n) for n in contract]))
    return F.transform(extra, lambda k: F.struct(k.alias("path"), F.lit("unknown").alias("rule")))


def keeps(df: DataFrame, contract: dict[str, Field]) -> Column:
    return F.size(violations(df, contract)) == 0


def quarantine(df: DataFrame, contract: dict[str, Field]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and those that do not, with their ``violations``."""
    judged = df.withColumn("violations", violations(df, contract))
    return judged.filter(F.size("violations") == 0).drop("violations"), judged.filter(F.size("violations") > 0)


def by_path(aside: DataFrame, keys: list[str]) -> DataFrame:
    """One row per violation of ``quarantine``'s second table: keys, path, rule."""
    return aside.select(*keys, F.inline("violations"))


# The contracts


def _struct(required: bool = True, **parts: Field) -> Field:
    return Field(required, parts=parts)


def _list(item: Field, required: bool = True, shortest: int = 0) -> Field:
    return Field(required, shortest=shortest, items=item)


def _version(*numbers: int) -> Field:
    return Field(True, one_of=numbers)


TEXT, FILLED, NUMBER = Field(), Field(True, shortest=1), Field()
COUNT, SHARE = Field(least=0), Field(least=0, most=1)
NEED, NEED_COUNT, NEED_SHARE = Field(True), COUNT.needed(), SHARE.needed()
#: A bucket's bound is read as text: a number or the open end.
BOUND = Field(True, pattern=r"^(\+Inf|-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?)$")
DURATION = Field(True, pattern=r"^[0-9]+[smhd]$")
CLASSES = tuple(REMEDIES)
#: Classes of a first pass beside those of a report.
REFINED = ("dependency_latency_regression", "error_category_shift")
_SPAN = _struct(start=NEED, end=NEED)
_SAMPLES = _struct(False, metric_name=TEXT, samples=Field(items=NUMBER))

EVIDENCE = {
    "schema_version": Field(True, least=1, most=2), "service": FILLED, "namespace": FILLED, "lookback_window": DURATION, "collected_at": NEED, "coverage_ratio": NEED_SHARE,
    "series": _struct(
        latency_histogram=_struct(metric_name=NEED, buckets=_list(_struct(False, le=BOUND, count=NEED_COUNT)), total_count=COUNT, sum=COUNT),
        request_total=_struct(metric_name=NEED, total=NEED_COUNT, rate_samples=_list(_struct(False, timestamp=NEED, value=NEED_COUNT), False)),
        error_total=_struct(metric_name=NEED, total=NEED_COUNT),
        saturation=_struct(False, cpu=_SAMPLES, memory=_SAMPLES, available=TEXT),
        traces=_struct(False, total_spans=COUNT, service_spans=COUNT, span_latency_p99_ms=COUNT, span_latency_p50_ms=COUNT, top_dependencies=_list(_struct(False, service=NEED, p99_ms=NEED_COUNT, call_count=NEED_COUNT, error_rate=SHARE), False)),
        logs=_struct(False, total_entries=COUNT, error_entries=COUNT, error_breakdown=_list(_struct(False, category=NEED, count=NEED_COUNT, ratio=NEED_SHARE), False)),
    ),
    "provenance": _struct(prometheus_endpoint=NEED, query_timestamps=_SPAN, queries=NEED),
}

BASELINE = {
    "schema_version": _version(1), "service": FILLED, "namespace": FILLED, "context_type": Field(one_of=("service", "infra")), "maturity_tier": Field(one_of=tuple(MARGINS)), "lookback_window": DURATION, "generated_at": NEED,
    "indicators": _struct(
        latency=_struct(p50_ms=NEED, p90_ms=NEED, p95_ms=NEED, p99_ms=NEED, stddev_ms=NEED_COUNT, sample_count=NEED_COUNT, source_query=NEED),
        error_rate=_struct(ratio=NEED_SHARE, stddev=NEED_COUNT, error_count=NEED_COUNT, total_count=NEED_COUNT, source_query=NEED),
        availability=_struct(ratio=NEED_SHARE, definition=NEED),
        throughput=_struct(mean_rps=NEED_COUNT, p95_rps=NEED_COUNT, stddev_rps=NEED_COUNT, sample_count=NEED_COUNT),
        saturation=_struct(False, cpu_mean_ratio=SHARE, cpu_p95_ratio=SHARE, memory_mean_ratio=SHARE, memory_p95_ratio=SHARE, available=TEXT),
        trace_latency=_struct(False, service_p99_ms=COUNT, top_dependency=TEXT, top_dependency_p99_ms=COUNT, top_dependency_contribution=SHARE, available=TEXT),
        error_breakdown=_struct(False, top_category=TEXT, top_category_ratio=SHARE, categories=COUNT, available=TEXT),
    ),
    "provenance": _struct(prometheus_endpoint=NEED, query_timestamps=_SPAN, coverage_ratio=NEED_SHARE),
}

DRIFT_SIGNAL = {
    "schema_version": _version(1), "service": FILLED, "evaluation_window": DURATION, "evaluated_at": NEED, "baseline_schema_version": NEED,
    "indicators": _list(_struct(
        False, name=NEED, live_value=NEED, baseline_value=NEED, abs_deviation=NEED_COUNT, rel_deviation=NEED, direction=Field(True, one_of=("increasing", "decreasing", "stable")), band_upper=NEED, band_lower=NEED, band_breach=NEED,
        first_pass_class=Field(True, one_of=CLASSES + REFINED), status=Field(one_of=("measured", "skipped")), skip_reason=TEXT,
    )),
    "dominant_signal": _struct(**{"indicator": NEED, "class": Field(True, one_of=CLASSES + REFINED), "breach_magnitude": NEED}), "all_breached_indicators": _list(NEED),
    "provenance": _struct(prometheus_endpoint=NEED, query_timestamps=_SPAN, coverage_ratio=NEED_SHARE),
}

# Steps of confidence and of a plan's priority.
LEVELS, PRIORITIES = ("high", "medium", "low"), ("immediate", "short_term", "long_term")
DRIFT_REPORT = {
    "schema_version": _version(1), "service": FILLED, "classification": Field(True, one_of=CLASSES), "severity": Field(True, one_of=tuple(RANKS)), "likely_cause": FILLED,
    "recommendations": _list(_struct(
        action=FILLED, confidence=Field(True, one_of=LEVELS), rationale=FILLED,
        remediation_plan=_struct(False, priority=Field(one_of=PRIORITIES), evidence_basis=Field(shortest=1), expected_impact=Field(shortest=1), verification_method=Field(shortest=1)),
    ), shortest=1),
}

PROPOSAL = {
    "schema_version": _version(3), "service": FILLED, "baseline_schema_version": NEED, "maturity_tier": Field(one_of=tuple(MARGINS)),
    "slos": _list(_struct(
        sli_name=NEED, sli_type=Field(True, one_of=tuple(OPERATORS)), sli_definition=NEED, slo_target=NEED, sla_target=NEED, target_op=Field(True, one_of=("lte", "gte")), target_unit=TEXT, error_budget_percent=Field(True, least=0, most=100),
        burn_rate_policy=_struct(windows=_list(_struct(long_window=NEED, short_window=NEED, burn_rate=NEED_COUNT, severity=NEED), shortest=1)), rationale=FILLED,
    ), shortest=1),
}

CONTRACTS = {"evidence": EVIDENCE, "baseline": BASELINE, "drift-signal": DRIFT_SIGNAL, "drift-report": DRIFT_REPORT, "proposal": PROPOSAL}
