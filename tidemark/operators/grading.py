"""Gates and scores of proposals and drift reports, one row per document, all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import cited_numbers, has_actuation
from tidemark.operators import documents
from tidemark.operators.drift import IMPROVED, NONE, REMEDIES
from tidemark.operators.targets import operator_of

# Words by which a remedy's category is known.
KEYWORDS = {
    "performance": ("latency", "performance", "profil", "optimiz", "regression", "slow", "response time", "critical path"),
    "monitoring": ("monitor", "baseline", "update", "track", "observe", "sustain", "verif", "confirm"),
    "reliability": ("error", "reliab", "fail", "log", "rollback", "deploy", "health", "readiness", "availab"),
    "capacity": ("capacity", "scal", "resource", "cpu", "memory", "throughput", "load", "replica", "pod", "autoscal"),
    "none": ("no action", "continue monitor", "no significant"),
}
NUMBER, UNSIGNED = r"-?[0-9]+\.?[0-9]*", r"[0-9]+\.?[0-9]*"


def signal_values(signals: DataFrame, keys: list[str]) -> DataFrame:
    """All values that a report may cite: six of each indicator, and the dominant magnitude."""
    six = ("live_value", "baseline_value", "abs_deviation", "rel_deviation", "band_upper", "band_lower")
    dominant = F.coalesce(F.max(F.when(F.col("band_breach"), F.col("breach_magnitude"))), F.lit(0.0))
    return signals.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list(F.array(*six))), F.array(dominant)))).alias("values"))


#: Columns of a baseline whose values a proposal may cite.
BASELINE_NUMBERS = (
    "p50_ms", "p90_ms", "p95_ms", "p99_ms", "stddev_ms", "sample_count", "error_ratio", "error_stddev", "error_count", "total_count", "availability", "mean_rps", "p95_rps", "stddev_rps", "rate_samples",
    "cpu_mean_ratio", "cpu_p95_ratio", "memory_mean_ratio", "memory_p95_ratio", "service_p99_ms", "top_dependency_p99_ms", "top_dependency_contribution", "top_category_ratio", "categories",
)


def baseline_values(baselines: DataFrame) -> Column:
    """All numbers of a baseline row that are there."""
    return F.filter(F.array(*[F.col(c).cast("double") for c in BASELINE_NUMBERS if c in baselines.columns]), lambda v: v.isNotNull())


def near(number: Column, values: Column, tolerance: float) -> Column:
    return F.exists(values, lambda v: (v != 0) & (F.abs(number - v) / F.greatest(F.abs(v), F.lit(1e-10)) < tolerance))


def grounded(text: Column, values: Column, tolerance: float = 0.02) -> Column:
    """Every number that the text cites is near one of the values; without values nothing can be wrong. Next to nothing is near a value of zero."""
    nothing = lambda n: (F.abs(n) < 1e-10) & F.array_contains(values, 0.0)
    return (F.size(values) == 0) | F.forall(cited_numbers(text), lambda n: near(n, values, tolerance) | nothing(n))


def cites_value(text: Column, values: Column, tolerance: float) -> Column:
    """Some number in the text is near one of the values, zeros apart."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))
    return F.exists(F.filter(numbers, lambda n: n != 0), lambda n: near(n, values, tolerance))


def cites_baseline(text: Column, values: Column, tolerance: float = 0.01) -> Column:
    """Some number in the text, taken without a sign, is one of the values or near one."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"({UNSIGNED})"), F.lit(1)), lambda x: x.cast("double"))
    return F.exists(numbers, lambda n: F.array_contains(values, n) | near(n, values, tolerance))


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def relevant(recommendations: Column, category: Column) -> Column:
    """Some recommendation has a word of the expected category; for none, its action speaks of waiting or watching."""
    action = lambda r: F.lower(F.coalesce(r["action"], F.lit("")))
    both = lambda r: F.concat_ws(" ", action(r), F.lower(F.coalesce(r["rationale"], F.lit(""))))
    found = F.when(category == "none", F.exists(recommendations, lambda r: _any_word(action(r), KEYWORDS["none"] + KEYWORDS["monitoring"])))
    speaks_of = lambda words: F.exists(recommendations, lambda r: _any_word(both(r), words))
    for name, words in KEYWORDS.items():
        if name != "none":
            found = found.when(category == name, speaks_of(words))
    return found.otherwise(True)


def deep(recommendations: Column, cls: Column) -> Column:
    """A drift for the worse needs a plan with priority, evidence and a way to verify."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    plan = lambda r: r["remediation_plan"]
    planned = F.exists(recommendations, lambda r: filled(plan(r)["priority"]) & filled(plan(r)["evidence_basis"]) & filled(plan(r)["verification_method"]))
    return cls.isin(*IMPROVED, NONE) | planned


def class_consistent(cls: Column, expected: Column) -> Column:
    """The class is one of a report's and fits the signal's, which is mapped (``report_class``); a regression of latency may be called a shift. An unknown signal fits all."""
    fits = (cls == expected) | ((expected == "latency_regression") & (cls == "distribution_shift")) | ~F.coalesce(expected.isin(*REMEDIES), F.lit(False))
    return F.coalesce(cls.isin(*REMEDIES) & fits, F.lit(False))


def severity_violations(severity: Column, magnitude: Column, cls: Column) -> Column:
    grave = severity.isin("critical", "high")
    rules = [((magnitude == 0) & grave, "too high without breach"), ((magnitude > 2) & (severity == "info"), "too low for breach"), (cls.isin(*IMPROVED) & grave, "too high for improvement")]
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull())


#: Gates of a report and of a proposal.
REPORT_GATES = ("schema_valid", "grounding", "class_validity", "no_actuation", "classification_accuracy", "severity_calibration", "remediation_relevance", "rationale_quality", "remediation_depth", "severity_consistent")
PROPOSAL_GATES = ("schema_valid", "grounding", "consistency", "indicator_appropriateness", "budget_coherence", "rationale_quality", "margin_quality", "direction_validity", "trace_log_citation")


def gate_totals(graded: DataFrame, gates: tuple[str, ...]) -> DataFrame:
    """The grid in long form, summed: documents and passes of each gate and of all gates together."""
    long = graded.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("passed")) for g in (*gates, "pass")])))
    return long.groupBy("gate").agg(F.count(F.lit(1)).alias("documents"), F.count_if("passed").alias("passed"))


def grade_reports(reports: DataFrame) -> DataFrame:
    """Gates of reports, documents of the report contract, each with its signal (values, report_class, magnitude) and the truth (class, severity_range, category).

    Numbers are grounded in cause and rationales; actions are read for actuation as well.
    """
    of = lambda *parts: F.array_join(F.transform("recommendations", lambda r: F.concat_ws(" ", *[r[p] for p in parts])), " ")
    said, told = F.concat_ws(" ", "likely_cause", of("rationale")), F.concat_ws(" ", "likely_cause", of("action", "rationale"))
    values = F.col("values")
    rationale = F.forall("recommendations", lambda r: cites_value(F.coalesce(r["rationale"], F.lit("")), values, 0.02))
    gates = {
        "schema_valid": documents.keeps(reports, documents.DRIFT_REPORT),
        "grounding": grounded(said, values), "class_validity": class_consistent(F.col("classification"), F.col("report_class")), "no_actuation": ~has_actuation(told),
        "classification_accuracy": F.col("classification") == F.col("class"), "severity_calibration": F.array_contains("severity_range", F.col("severity")), "remediation_relevance": relevant(F.col("recommendations"), F.col("category")),
        "rationale_quality": (F.size(values) == 0) | rationale, "remediation_depth": deep(F.col("recommendations"), F.col("classification")), "severity_consistent": F.size(severity_violations(F.col("severity"), F.col("magnitude"), F.col("classification"))) == 0,
    }
    graded = reports.withColumns({g: F.coalesce(c, F.lit(False)) for g, c in gates.items()})
    return graded.withColumn("pass", F.array_min(F.array(*[F.col(g).cast("int") for g in REPORT_GATES])) == 1)


def grade_proposals(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Gates per proposal of target rows (fields of a proposal's targets) with observed, ``violations``, ``values`` of the baseline and the context's names.

    A proposal's schema holds if each of its rows keeps the contract of one target. Without an observed value nothing is said of a margin.
    """
    text = F.coalesce("rationale", F.lit(""))
    cites = cites_baseline(text, F.col("values"))
    windows = F.col("burn_rate_policy.windows")
    budget = (F.col("error_budget_percent") > 0) & (F.col("error_budget_percent") <= 100) & (F.size(windows) > 0) & F.forall(windows, lambda w: w["burn_rate"] > 0)
    lower = F.lower(text)
    dependency = (F.col("sli_type") != "latency") | F.col("top_dependency").isNull() | F.contains(lower, F.lower("top_dependency"))
    category = ~F.col("sli_type").isin("error_rate", "availability") | F.col("top_category").isNull() | F.contains(lower, F.lower("top_category")) | F.contains(lower, F.lower(F.replace("top_category", F.lit("_"), F.lit(" "))))
    margin = F.coalesce((F.col("slo_target") != F.col("observed")) & (F.col("sla_target") != F.col("observed")), F.lit(True))
    direction = F.coalesce(F.col("target_op") == operator_of(F.col("sli_type")), operator_of(F.col("sli_type")).isNull())
    kinds = F.collect_set("sli_type")
    judged = targets.withColumn("_kept", documents.keeps(targets, documents.PROPOSAL["slos"].items.parts))
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    graded = judged.groupBy(*keys).agg(
        every(F.col("_kept")).alias("schema_valid"), every(cites).alias("grounding"), every(F.size("violations") == 0).alias("consistency"), (F.array_contains(kinds, "latency") & F.arrays_overlap(kinds, F.array(F.lit("availability"), F.lit("error_rate")))).alias("indicator_appropriateness"),
        every(budget).alias("budget_coherence"), every(cites).alias("rationale_quality"), every(margin).alias("margin_quality"), every(direction).alias("direction_validity"), every(dependency & category).alias("trace_log_citation"),
    )
    return graded.withColumn("pass", F.array_min(F.array(*[F.col(g).cast("int") for g in PROPOSAL_GATES])) == 1)


def scorecard(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Pass rate and mean latency of recorded attempts, with totals over each key."""
    cubed = attempts.cube(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.avg(F.col("pass").cast("double")).alias("pass_rate"), F.avg("latency_s").alias("mean_latency_s"))
    return cubed.select(*[F.coalesce(F.col(k).cast("string"), F.lit("all")).alias(k) for k in keys], "attempts", "pass_rate", "mean_latency_s")
