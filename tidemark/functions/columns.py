"""Column functions: labels, names, durations, canonical numbers, cited numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DURATION = r"^([0-9]+)([smhd])$"
# Seconds of a duration's unit.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def label_match(col: Column, pattern: str) -> Column:
    """An anchored label regex: the whole value must match."""
    return col.rlike(f"^(?:{pattern})$")


def pod_of(col: Column, service: Column) -> Column:
    return F.startswith(col, F.concat(service, F.lit("-")))


def duration_seconds(col: Column) -> Column:
    """Seconds of a text like 30d; null where it is none."""
    unit = F.regexp_extract(col, DURATION, 2)
    factor = F.coalesce(*[F.when(unit == u, F.lit(n)) for u, n in UNIT_SECONDS.items()])
    return F.when(col.rlike(DURATION), F.regexp_extract(col, DURATION, 1).try_cast("bigint") * factor)


def duration_text(seconds: Column) -> Column:
    """Days if it is a whole number of days, else hours, minutes or seconds likewise."""
    whole = lambda n: (seconds >= n) & (seconds % n == 0)
    text = lambda n, u: F.concat((seconds / n).cast("bigint").cast("string"), F.lit(u))
    return F.when(whole(86400), text(86400, "d")).when(whole(3600), text(3600, "h")).when(whole(60), text(60, "m")).otherwise(text(1, "s"))


def valid_name(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^[a-z0-9]([-a-z0-9]*[a-z0-9])?$") & (F.length(col) <= 63), F.lit(False))


def metric_segment(col: Column) -> Column:
    """A name as a segment of a metric's name."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col), "[- ]", "_"), "[^a-z0-9_]", "")
    s = F.trim(F.regexp_replace(s, "_+", "_"), F.lit("_"))
    return F.when(s == "", "unnamed").when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def resource_name(col: Column) -> Column:
    """A name as a cluster resource's name."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[ _]", "-"), "[^a-z0-9-]", "")


def alert_name(sli: Column, severity: Column) -> Column:
    """Words of both names with capital first letters, in the pattern of an alert's name."""
    pascal = lambda c: F.array_join(F.transform(F.split(c, "[-_ ]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")
    return F.concat(F.lit("SLO"), pascal(sli), F.lit("BurnRate"), pascal(severity))


def canonical(col: Column) -> Column:
    """Six significant digits; NaN and infinities, which an artifact may not hold, become null."""
    fine = ~F.isnan(col) & (F.abs(col) < float("inf"))
    return F.when(fine, F.format_string("%.5e", col).cast("double"))


def strip_fence(col: Column) -> Column:
    """A reply's payload without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def cited_numbers(text: Column) -> Column:
    """Numbers that a text cites as values: not parts of names (p99), percentages, multipliers, times of hours or days, or zero.

    A match is taken with what tells it apart, a letter before it or a mark after it, and dropped with that.
    """
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z]-?[0-9]+\.?[0-9]*|-?[0-9]+\.?[0-9]*(?:[%xX]|[hd](?![A-Za-z]))?)"), F.lit(1))
    kept = F.filter(found, lambda x: x.rlike(r"^-?[0-9]+\.?[0-9]*$"))
    return F.filter(F.transform(kept, lambda x: x.cast("double")), lambda x: x != 0)


# Fixed value: what counts as actuation.
ACTUATION = r"(?i)\b(?:kubectl|oc|curl|docker|helm)\b|```(?:yaml|yml|json)\b|\b(?:POST|PUT|PATCH|DELETE)\s+https?://"


def has_actuation(text: Column) -> Column:
    """Commands, configuration blocks or calls in a text that should only advise."""
    return F.coalesce(text.rlike(ACTUATION), F.lit(False))
