import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import baseline, blocks, series

SF = "/root/testdata/sf0.001"


def rows_of(n, seed, span=40_000):
    """A series that holds nine tenths of all rows, and two others; some rows share a time."""
    rng = random.Random(seed)
    return [(i, rng.choice(["big"] * 18 + ["a", "b"]), rng.randrange(span), float(rng.randrange(50))) for i in range(n)]


def make(spark, rows):
    return spark.createDataFrame(rows, "id int, service string, epoch long, value double").repartition(5)


def by_series(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("seconds", [0, 7, 300, 5000])
def test_framed_equals_a_loop(spark, seconds):
    rows = rows_of(700, seconds)
    got = blocks.framed(make(spark, rows), ["service"], {"total": (seconds, F.sum("value")), "n": (seconds // 3, F.count("value"))})
    want = {r[0]: (sum(x[3] for x in rs if r[2] - seconds <= x[2] <= r[2]), sum(r[2] - seconds // 3 <= x[2] <= r[2] for x in rs)) for rs in by_series(rows).values() for r in rs}
    assert {r.id: (r.total, r.n) for r in got.collect()} == want and got.columns == ["id", "service", "epoch", "value", "total", "n"]


def test_frames_are_running_aggregates(spark):
    """No window slides, so that a frame's rows are not added up anew at each row; nulls, infinities and null times keep their places."""
    inf = math.inf
    rows = [(0, "a", 0, 1.0), (1, "a", 9, inf), (2, "a", 10, None), (3, "a", 20, 2.0), (4, "a", 31, None), (5, None, 20, 4.0), (6, "a", None, 5.0), (7, "a", None, 6.0)]
    got = series.over_time(make(spark, rows), ["service"], "value", {"mean": 11})
    assert {r.id: r.mean for r in got.collect()} == {0: 1.0, 1: inf, 2: inf, 3: 2.0, 4: None, 5: 4.0, 6: 5.5, 7: 5.5}
    for name in ("avg_over_time", "counter_rate", "error_alerts"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan and not re.search(r"RangeFrame, -\d+", plan)


@pytest.mark.parametrize("block", [1, 500, 86_400])
def test_previous_and_numbered_cross_empty_blocks(spark, block):
    rows = rows_of(300, block)
    df = make(spark, rows)
    before, number = {}, {}
    for rs in by_series(rows).values():
        for i, r in enumerate(rs):
            before[r[0]], number[r[0]] = (rs[i - 1][3] if i else None), i + 1
    got = blocks.previous(df, ["service"], ["epoch", "id"], "value", "was", seconds=block)
    assert {r.id: r.was for r in got.collect()} == before and got.count() == len(rows)
    assert {r.id: r.number for r in blocks.numbered(df, ["service"], ["epoch", "id"], "number", seconds=block).collect()} == number


@pytest.mark.parametrize("stale", [0, 50, 900])
def test_as_of_takes_the_last_row_that_is_fresh(spark, stale):
    rows, asked = rows_of(300, stale), [(s, t) for s in ("big", "a", "none") for t in range(0, 40_000, 333)]
    got = blocks.as_of(make(spark, rows), spark.createDataFrame(asked, "service string, epoch long"), ["service"], ["epoch", "id"], ["id", "value"], "last", stale)
    series_ = by_series(rows)
    want = {}
    for s, t in asked:
        known = [r for r in series_.get(s, []) if t - stale <= r[2] <= t]
        want[s, t] = known[-1][0] if known else None
    assert {(r.service, r.epoch): r.last.id if r.last else None for r in got.collect()} == want and got.count() == len(asked)


def test_values_by_rank(spark):
    rng = random.Random(4)
    values = {"a": [rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 8) for _ in range(400)] + [0.0] * 30, "b": [5.0], "c": [float(i) for i in range(100)] * 2, "d": [math.inf, -math.inf, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)], "service string, v double")
    got = {r.service: r for r in baseline.ranked_values(df, ["service"], "v", {"up": (0.95, "ceil"), "down": (0.99, "floor"), "low": (0.01, "ceil")}).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        s = sorted(vs)
        want = (s[math.ceil(0.95 * len(s)) - 1], s[math.floor(0.99 * (len(s) - 1))], s[math.ceil(0.01 * len(s)) - 1], len(s))
        assert (got[k].up, got[k].down, got[k].low, got[k].n) == want


def test_buckets_rise_with_values(spark):
    values = sorted({s * m * 2.0**e for s in (-1, 1) for m in (1.0, 1.001, 1.5, 1.999999) for e in (-1074, -500, -3, 0, 1, 52, 1000)} | {0.0, math.inf, -math.inf})
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", blocks.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert [r.b for r in df] == sorted(r.b for r in df)


def test_counters_reset_over_blocks(spark):
    rows = [(i, "s", t, v) for i, (t, v) in enumerate([(0, 5.0), (100_000, 8.0), (100_001, 2.0), (900_000, 3.0)])]
    df = make(spark, rows).withColumn("ts", F.timestamp_seconds("epoch"))
    got = series.deltas(df, ["service"], ["ts", "id"]).orderBy("id").collect()
    assert [r.delta for r in got] == [0.0, 3.0, 2.0, 1.0] and got[0].asDict().keys() == {"id", "service", "epoch", "value", "ts", "delta"}


@pytest.mark.parametrize("name", ["step_grid_asof", "counter_rate", "avg_over_time", "error_alerts", "latency_alerts", "throughput_alerts", "saturation_alerts"])
def test_no_window_over_a_whole_series(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
    # Histograms, of eight rows a service, and counts by category are no series.
    partitions = [re.search(r"\], \[([^\]]*)\](?:, \[|$)", line).group(1) for line in windows]
    assert any("_block#" in p for p in partitions) and not any(re.fullmatch(r"service#\d+(, (code|win)#\d+)?", p) and "n#" not in line and " le#" not in line for line, p in zip(windows, partitions)), windows
