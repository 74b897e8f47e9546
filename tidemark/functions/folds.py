"""Folds over the arrays of one row: percentiles and spread of a histogram, moments and ranks of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _bound(b: Column) -> Column:
    return F.when(b["le"] == "+Inf", INF).otherwise(b["le"].try_cast("double"))


def quantile(buckets: Column, total: Column, q: float) -> Column:
    """Interpolated within the first bucket up to which the rank lies; beyond the last finite bound, that bound."""
    state = lambda pc, pb, hit: F.struct(pc.alias("pc"), pb.alias("pb"), hit.alias("hit"))
    none, zero, rank = F.lit(None).cast("double"), F.lit(0.0), F.lit(q) * total

    def step(s: Column, b: Column) -> Column:
        le, n = _bound(b), b["count"].cast("double")
        part = F.when(n > s["pc"], (rank - s["pc"]) / F.nullif(n - s["pc"], zero)).otherwise(zero)
        hit = F.when(n >= rank, s["pb"] + part * (le - s["pb"]))
        return F.when(s["hit"].isNotNull() | le.isNull() | (le == INF), s).otherwise(state(F.when(hit.isNull(), n).otherwise(s["pc"]), F.when(hit.isNull(), le).otherwise(s["pb"]), hit))

    return F.aggregate(buckets, state(zero, zero, none), step, lambda s: F.coalesce(s["hit"], s["pb"]))


def spread(buckets: Column, total: Column, sum_: Column) -> Column:
    """Deviation from sum/total with every sample at its bucket's middle, in the open one at twice its lower bound."""
    mean = F.try_divide(sum_, total)
    state = lambda pc, pb, acc: F.struct(pc.alias("pc"), pb.alias("pb"), acc.alias("acc"))

    def step(s: Column, b: Column) -> Column:
        le, n = _bound(b), b["count"].cast("double")
        middle = F.when(le < INF, (s["pb"] + le) / 2).otherwise(F.when(s["pb"] > 0, s["pb"] * 2).otherwise(1.0))
        return F.when(le.isNull(), s).otherwise(state(n, F.when(le < INF, le).otherwise(s["pb"]), s["acc"] + (n - s["pc"]) * (middle - mean) * (middle - mean)))

    return F.aggregate(buckets, state(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step, lambda s: F.sqrt(F.try_divide(s["acc"], total)))


def mean_of(values: Column) -> Column:
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values)), F.lit(0.0))


def deviation_of(values: Column) -> Column:
    # An array of one binds the mean, so that it is not taken anew at each value.
    squares = F.transform(F.array(mean_of(values)), lambda mean: F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)))
    return F.coalesce(F.sqrt(F.try_divide(F.get(squares, 0), F.size(values))), F.lit(0.0))


def rank_of(values: Column, q: float) -> Column:
    """The value of rank ceil(q n), 0 of none."""
    return F.coalesce(F.get(F.array_sort(values), F.ceil(F.lit(q) * F.size(values)).cast("int") - 1), F.lit(0.0))
