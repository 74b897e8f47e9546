import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
STREAMS = ["stream_indicators", "stream_record", "stream_cpu", "stream_run_log", "stream_drift", "stream_status"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})")
    assert normal(map(tuple, df.select(*columns).collect())) == normal(want.fetchall())


def test_payloads_of_samples_are_bounded(spark, tmp_path, monkeypatch):
    """A document's samples are not those of a day, which grow with the table."""
    from tidemark.plans import queries

    monkeypatch.setattr(queries, "PAYLOAD_ROWS", 50, raising=False)
    monkeypatch.setattr(queries, "_work_dir", lambda spark: f"file://{tmp_path}")
    e = spark.read.parquet(f"{SF}/events.parquet").limit(400)
    one_day = e.selectExpr("event_id", "cast('2024-01-02 03:04:05' as timestamp) as ts", "10L as user_id", "'view' as event_type", "if(event_id % 9 = 0, null, value) as value", "props")
    one_day.coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet")
    (row,) = queries.QUERIES["payload_samples"](spark, f"{tmp_path}/in").collect()
    assert (row.service, row.code, row.n, row.first, row.last) == ("svc-00", "200", 400, 1704164645, 1704164645)
    texts = [len(line.value) for line in spark.read.text(f"{tmp_path}/payloads").collect()]
    assert len(texts) == 8 and max(texts) < 50 * 40


def test_every_query_without_sql_is_known():
    from tidemark.plans.queries import QUERIES

    assert set(QUERIES) - set(ORACLE_SQL) == set(STREAMS) and not set(ORACLE_SQL) - set(QUERIES)


def test_stream_signals_equal_those_of_the_batch(spark):
    from tidemark.plans.queries import _request_stream, baselines
    from tidemark.sources import roles
    from tidemark.streaming.windows import stream_indicators, window_signals

    columns = ["service", "window_start", "dominant_indicator", "report_class", "severity", "all_breached_indicators"]
    got = {(r.service, r.window_start): r for r in entry.queries()["stream_drift"](spark, SF).select(columns).collect()}
    names = _request_stream(spark, SF).columns
    raw = roles.table(spark, SF, "events").select(roles.service("user_id").alias("service"), "ts", roles.F.col("value").alias("latency_ms"), (roles.F.col("event_type") == "error").alias("is_error")).select(names)
    batch = window_signals(stream_indicators(raw, "1 day", "12 hours"), baselines(spark, SF).filter("win = 'baseline'"))
    want = {(r.service, r.window_start): r for r in batch.select(columns).collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == r for k, r in got.items())
    status = entry.queries()["stream_status"](spark, SF).collect()
    assert len(status) == 10 and all(r.has_drift_signal and r.status in ("healthy", "degraded", "critical", "improving") for r in status)


def test_closed_stream_windows_equal_the_batch(spark):
    from tidemark.sources import roles
    from tidemark.streaming.windows import stream_indicators

    closed = {(r.service, r.window_start): (r.n, r.p99_ms) for r in entry.queries()["stream_indicators"](spark, SF).collect()}
    reqs = roles.requests(spark, SF).withColumn("latency_ms", roles.F.col("latency_ms"))
    raw = roles.table(spark, SF, "events").select(roles.service("user_id").alias("service"), "ts", roles.F.col("value").alias("latency_ms"), (roles.F.col("event_type") == "error").alias("is_error"))
    batch = {(r.service, r.window_start): (r.n, r.p99_ms) for r in stream_indicators(raw).collect()}
    assert reqs.count() and len(closed) > 0.9 * len(batch) and all(batch[k] == v for k, v in closed.items())


def test_recorded_stream_windows_equal_the_batch(spark):
    from tidemark.plans.queries import QUERIES, _latency_targets, _request_stream
    from tidemark.sources import roles
    from tidemark.streaming.windows import stream_cpu, stream_record

    key = lambda rows, *names: {(r.service, r.window_start): tuple(None if r[n] is None else round(r[n], 9) for n in names) for r in rows}
    raw = roles.table(spark, SF, "events").select(roles.service("user_id").alias("service"), "ts", roles.F.col("value").alias("latency_ms"), (roles.F.col("event_type") == "error").alias("is_error")).select(_request_stream(spark, SF).columns)
    closed = key(QUERIES["stream_record"](spark, SF).collect(), "rps", "error_ratio", "good_ratio")
    batch = key(stream_record(raw, _latency_targets(spark, SF)).collect(), "rps", "error_ratio", "good_ratio")
    assert len(closed) > 0.9 * len(batch) and all(batch[k] == v for k, v in closed.items()) and any(v[2] not in (None, 0.0) for v in closed.values())
    closed, batch = key(QUERIES["stream_cpu"](spark, SF).collect(), "cpu"), key(stream_cpu(roles.gauges(spark, SF)).collect(), "cpu")
    assert len(closed) > 0.9 * len(batch) and all(batch[k] == v for k, v in closed.items())


def test_late_rows_and_bounded_state_go_on_record(spark, tmp_path):
    from tidemark.streaming.windows import RUN_LOG, run_logged, stream_indicators, stream_record

    schema = "service string, ts timestamp, latency_ms double, is_error boolean"
    hour = lambda h, m=0: f"2026-01-01 {h:02d}:{m:02d}:00"
    on_time = [("a", hour(8 + i % 4, i % 60), float(i % 700), i % 5 == 0) for i in range(2000)] + [("a", hour(12), 1.0, False)]
    late = [(s, hour(9, 1), 5.0, False) for s in "abcd"] + [("a", hour(12, 30), 5.0, False)]
    # A batch is judged by the watermark that the one before it began with.
    for i, rows in enumerate([on_time, [("a", hour(12, 20), 5.0, False)], late, [("a", hour(14), 5.0, False)]]):
        df = spark.createDataFrame(rows, "service string, ts string, latency_ms double, is_error boolean").withColumn("ts", roles_ts("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    run_logged(spark, stream_record(stream()), "recorded", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "log"))
    log = {r.batch: r for r in spark.read.schema(RUN_LOG).parquet(str(tmp_path / "log")).collect()}
    assert [log[i].rows for i in range(4)] == [2001, 1, 5, 1] and [log[i].dropped for i in range(4)] == [0, 0, 4, 0]
    run_logged(spark, stream_indicators(stream()), "sliding", str(tmp_path / "out2"), str(tmp_path / "state2"), str(tmp_path / "log2"))
    # A row of state for each service and open window, whatever their values.
    log = spark.read.schema(RUN_LOG).parquet(str(tmp_path / "log2")).collect()
    assert max(r.state_rows for r in log) <= 2 * (12 - 7 + 1) + 2
    assert spark.read.schema(stream_indicators(stream()).schema).parquet(str(tmp_path / "out2")).filter("n > 100").count() > 4


def roles_ts(column):
    from pyspark.sql import functions as F

    return F.col(column).cast("timestamp")
