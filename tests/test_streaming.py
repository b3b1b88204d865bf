"""Streams give what the batch gives, in one or many micro-batches and over restarts."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from riskloom.functions.scoring import Inputs, naive_risk_score
from riskloom.sources import readers, writers
from riskloom.streaming import jobs

BASE = dt.datetime(2024, 1, 1)


def event(i, ts, amount=100.0, customer="CUST1", location="US"):
    return {"transaction_id": f"T{i}", "customer_id": customer, "amount": amount, "timestamp": ts.isoformat(),
            "location": location, "merchant_id": "M1", "customer_age": 30}


def feed(folder, batches):
    os.makedirs(folder, exist_ok=True)
    for n, batch in enumerate(batches):
        path = os.path.join(folder, f"{n:04d}.txt")
        with open(path, "w") as f:
            f.writelines((line if isinstance(line, str) else json.dumps(line)) + "\n" for line in batch)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def drain(df, tmp, name="out"):
    writers.write_stream_append(df, f"{tmp}/{name}", f"{tmp}/{name}-cp", trigger=None).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp}/{name}")


@pytest.mark.parametrize("files", [1, 5])
def test_scored_stream_equals_batch(spark, tmp_path, files):
    events = [event(i, BASE + dt.timedelta(hours=i), 5000.0 * i, "NEW1" if i % 2 else "CUST1") for i in range(20)]
    feed(tmp_path / "in", [events[k::files] for k in range(files)])
    parsed = readers.parse_transactions(readers.read_feed(spark, str(tmp_path / "in"), max_files=1))
    got = drain(jobs.stream_score(parsed).drop("processing_timestamp"), tmp_path)
    batch = naive_risk_score(readers.parse_transactions(spark.read.text(str(tmp_path / "in"))), Inputs(ts="timestamp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.count() == 20


def test_bad_texts_are_quarantined(spark, tmp_path):
    feed(tmp_path / "in", [[event(1, BASE), "not json", {"transaction_id": "T2"}]])
    text = spark.read.text(str(tmp_path / "in"))
    assert readers.parse_transactions(text).count() == 1
    assert readers.quarantine_transactions(text).count() == 2


def test_repeats_inside_the_ttl_are_dropped(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    feed(tmp_path / "in", [
        [event(1, BASE), event(2, BASE + 5 * minute), event(1, BASE + 3 * minute)],
        [event(2, BASE + 20 * minute)],
        [event(3, BASE + 300 * minute)],
        [event(4, BASE + 301 * minute)],  # state is released by the batch after the watermark has moved
        [event(1, BASE + 302 * minute)]])
    parsed = readers.parse_transactions(readers.read_feed(spark, str(tmp_path / "in"), max_files=1))
    got = drain(jobs.stream_dedup_ttl(parsed, "transaction_id", "timestamp", "30 minutes"), tmp_path)
    assert sorted(r.transaction_id for r in got.collect()) == ["T1", "T1", "T2", "T3", "T4"]


def test_exact_lifetime_passes_the_first_request_after_it(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    feed(tmp_path / "in", [
        [event(1, BASE), event(1, BASE + 29 * minute), event(1, BASE + 30 * minute), event(2, BASE)],
        [event(1, BASE + 59 * minute), event(1, BASE + 61 * minute)],
        [event(2, BASE + 500 * minute)],
        [event(1, BASE + 501 * minute)]])
    parsed = readers.parse_transactions(readers.read_feed(spark, str(tmp_path / "in"), max_files=1))
    got = drain(jobs.stream_misses_ttl(parsed, "transaction_id", "timestamp", "30 minutes"), tmp_path)
    assert sorted((r.transaction_id, (r.timestamp - BASE) // minute) for r in got.collect()) == [
        ("T1", 0), ("T1", 30), ("T1", 61), ("T1", 501), ("T2", 0), ("T2", 500)]


def assessment_lines(rows):
    return [{"assessment_id": f"A{i}", "risk_score": s, "risk_level": lvl, "recommended_action": "BLOCK" if lvl == "HIGH" else "APPROVE",
             "processing_time_ms": 10, "assessment_timestamp": ts.isoformat()} for i, ts, s, lvl in rows]


ASSESSMENT = "assessment_id string, risk_score double, risk_level string, recommended_action string, processing_time_ms int, assessment_timestamp timestamp"


def assessments(spark, path):
    text = readers.read_feed(spark, str(path), max_files=1)
    return text.select(F.from_json("value", ASSESSMENT).alias("e")).select("e.*")


def test_hourly_metrics_drop_late_rows(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    feed(tmp_path / "in", [
        assessment_lines([(1, BASE, 0.9, "HIGH"), (2, BASE + hour / 2, 0.1, "LOW")]),
        assessment_lines([(3, BASE + 5 * hour, 0.6, "MEDIUM")]),
        assessment_lines([(6, BASE + 5 * hour, 0.6, "MEDIUM")]),  # rows count as late from the batch after the watermark has moved
        assessment_lines([(4, BASE + hour / 4, 0.9, "HIGH")]),
        assessment_lines([(5, BASE + 9 * hour, 0.6, "MEDIUM")])])
    got = {r.hour: r for r in drain(jobs.stream_hourly_metrics(assessments(spark, tmp_path / "in")), tmp_path).collect()}
    assert set(got) == {BASE, BASE + 5 * hour}
    first = got[BASE]
    assert (first.total_assessments, first.high_risk_count, first.low_risk_count, first.blocked_transactions) == (2, 1, 1, 1)
    assert first.avg_risk_score == pytest.approx(0.5)


def test_daily_table_survives_a_restart(spark, tmp_path):
    day = dt.timedelta(days=1)
    source = tmp_path / "in"
    feed(source, [assessment_lines([(1, BASE, 0.9, "HIGH"), (2, BASE + day, 0.1, "LOW")])])

    def run():
        summary = jobs.stream_daily_summary(assessments(spark, source), "2 days")
        jobs.write_daily_summary(summary, f"{tmp_path}/daily", f"{tmp_path}/cp", trigger=None).awaitTermination()
        return {r.assessment_date: r.total_assessments for r in jobs.read_daily_summary(spark, f"{tmp_path}/daily").collect()}

    assert run() == {BASE.date(): 1, (BASE + day).date(): 1}
    feed(source, [assessment_lines([(1, BASE, 0.9, "HIGH"), (2, BASE + day, 0.1, "LOW")]),
                  assessment_lines([(3, BASE + day, 0.5, "MEDIUM")])])
    assert run() == {BASE.date(): 1, (BASE + day).date(): 2}


def test_sliding_windows_alerts_and_gauge(spark, tmp_path):
    day = dt.timedelta(days=1)
    feed(tmp_path / "t", [[event(1, BASE), event(2, BASE + day)], [event(3, BASE + 60 * day)]])
    parsed = readers.parse_transactions(readers.read_feed(spark, str(tmp_path / "t"), max_files=1))
    sliding = drain(jobs.stream_sliding_customer(parsed, "2 days", "1 day", ts="timestamp"), tmp_path, "sliding").collect()
    assert {(r.window_start, r.transaction_count) for r in sliding} == {(BASE - day, 1), (BASE, 2), (BASE + day, 1)}

    feed(tmp_path / "a", [assessment_lines([(1, BASE, 0.9, "HIGH"), (2, BASE + dt.timedelta(minutes=5), 0.1, "LOW")]),
                          assessment_lines([(3, BASE + day, 0.3, "LOW")])])
    gauge = drain(jobs.metrics_gauge(assessments(spark, tmp_path / "a")), tmp_path, "gauge").collect()
    assert [(r.last_score, r.score_histogram["0.8-1.0"], r.score_histogram["0.0-0.2"]) for r in gauge] == [(0.1, 1, 1)]

    lines = [{"metric_name": n, "metric_value": v, "metric_time": (BASE + o).isoformat()} for n, v, o in (
        ("cpu_usage", 90.0, dt.timedelta(0)), ("cpu_usage", 85.0, dt.timedelta(minutes=1)), ("error_rate", 1.0, dt.timedelta(0)), ("model_accuracy", 0.8, dt.timedelta(0)), ("x", 1.0, day))]
    feed(tmp_path / "m", [lines])
    metrics = readers.read_feed(spark, str(tmp_path / "m")).select(
        F.from_json("value", "metric_name string, metric_value double, metric_time timestamp").alias("e")).select("e.*")
    assert {(r.metric_name, r.avg_value, r.alert_status) for r in drain(jobs.stream_alerts(metrics), tmp_path, "alerts").collect()} == {
        ("cpu_usage", 87.5, "HIGH_CPU"), ("model_accuracy", 0.8, "LOW_ACCURACY")}
    feed(tmp_path / "m2", [lines])
    again = readers.read_feed(spark, str(tmp_path / "m2")).select(
        F.from_json("value", "metric_name string, metric_value double, metric_time timestamp").alias("e")).select("e.*")
    custom = drain(jobs.stream_alerts(again, thresholds={"error_rate": 0.5}), tmp_path, "alerts2").collect()
    assert {(r.metric_name, r.alert_status) for r in custom} == {("error_rate", "HIGH_ERROR_RATE"), ("model_accuracy", "LOW_ACCURACY")}


def sliding_rows(rows, span, step, closed):
    """Windows by hand: (start, customer) -> (count, mean) of those that end by ``closed``."""
    out, epoch = {}, dt.datetime(1970, 1, 1)
    for customer, at, amount in rows:
        start = epoch + (at - epoch) // step * step
        while start + span > at:
            if start + span <= closed:
                out.setdefault((start, customer), []).append(amount)
            start -= step
    return {k: (len(v), sum(v) / len(v)) for k, v in out.items()}


@pytest.mark.parametrize("length, slide", [("5 days", "1 day"), ("10 hours", "4 hours")])
def test_sliding_windows_are_combined_from_panes(spark, tmp_path, length, slide):
    hour = dt.timedelta(hours=1)
    unit = {"days": 24 * hour, "day": 24 * hour, "hours": hour}
    span, step = (int(x.split()[0]) * unit[x.split()[1]] for x in (length, slide))
    rows = [("AB"[i % 3 == 0], BASE + (i * 7 % 11) * hour + i * 5 * hour, float(i)) for i in range(60)] + [("C", BASE + 2 * hour, 5.0)]
    rows += [("A", BASE + 900 * hour, 1.0), ("A", BASE + 901 * hour, 1.0)]
    batches = [rows[:1] + rows[60:61], rows[1:25], rows[25:60], rows[61:62]]  # rows inside the watermark come out of order
    lines = [[event(i, at, amount, customer) for i, (customer, at, amount) in enumerate(b)] for b in batches]

    def run():
        parsed = readers.parse_transactions(readers.read_feed(spark, str(tmp_path / "t"), max_files=1))
        return drain(jobs.stream_sliding_customer(parsed, length, slide, ts="timestamp"), tmp_path, "sliding").collect()

    feed(tmp_path / "t", lines[:2])
    run()
    late = [event(0, BASE, 99.0, "A"), event(1, rows[62][1], 1.0, "A")]
    feed(tmp_path / "t", [*lines, late])
    got = run()  # a restart keeps the panes
    want = sliding_rows(rows, span, step, rows[62][1] - 24 * hour)
    assert len(got) == len({(r.window_start, r.customer_id) for r in got})
    assert {(r.window_start, r.customer_id): (r.transaction_count, r.avg_amount) for r in got} == want
    assert all(r.window_end - r.window_start == span for r in got)


def test_sliding_windows_keep_one_state_row_an_event(spark, tmp_path):
    day = dt.timedelta(days=1)
    feed(tmp_path / "t", [[event(i, BASE + i * day / 40, customer=f"C{i}") for i in range(40)]])
    parsed = readers.parse_transactions(readers.read_feed(spark, str(tmp_path / "t")))
    run = writers.write_stream_append(jobs.stream_sliding_customer(parsed, ts="timestamp"), f"{tmp_path}/out", f"{tmp_path}/cp", trigger=None)
    run.awaitTermination()
    operators = [o for p in run.recentProgress for o in p["stateOperators"]]
    assert sum(o["numRowsUpdated"] for o in operators) <= 40 and max(o["numRowsTotal"] for o in operators) <= 40


def test_sliding_windows_share_state_rows_and_leave_as_runs(spark, tmp_path):
    """200 customers in four state rows; thirty equal windows of an event are one row of Python; rows without a customer or amount count."""
    day = dt.timedelta(days=1)
    rows = [(None if i == 7 else f"C{i}", BASE + (i % 5) * day / 7, None if i == 9 else float(i)) for i in range(200)]
    late = [("Z", BASE + 90 * day, 1.0)]
    schema = "customer_id string, transaction_timestamp timestamp_ntz, amount double"
    for part in (rows, late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", "2").parquet(f"{tmp_path}/in")
    run = writers.write_stream_append(jobs.stream_sliding_customer(feed, buckets=4), f"{tmp_path}/out", f"{tmp_path}/cp", trigger=None)
    run.awaitTermination()
    assert max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) <= 4
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 200 * 30 and all(r.transaction_count == 1 for r in got)
    assert {(r.customer_id, r.avg_amount) for r in got} == {(c, a) for c, _, a in rows}


def test_messages_are_routed_by_type(spark):
    lines = [json.dumps({"type": "risk_assessment", "data": {"id": "1", "riskScore": 0.5, "features": {"amount": 2.0}, "businessRules": ["A"]}}),
             json.dumps({"type": "system_metrics", "data": {"cpuUsage": 12.5}}), json.dumps({"type": "other", "data": {}}), "junk",
             json.dumps({"type": "notification", "data": "text"}), json.dumps({"type": "system_metrics", "data": {"cpuUsage": "high"}}),
             json.dumps({"type": "statistics_update", "data": None}), json.dumps({"type": "notification", "data": [1]}), json.dumps({"data": {}})]
    routed = readers.route_messages(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = routed["risk_assessment"].first()
    assert (r.id, r.riskScore, r.features, r.businessRules) == ("1", 0.5, {"amount": 2.0}, ["A"])
    assert routed["system_metrics"].first().cpuUsage == 12.5
    assert routed["notification"].count() == 0
    assert sorted(r.raw for r in routed["unrouted"].collect()) == sorted(lines[2:])


def test_stream_is_routed_in_one_query(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"type": t, "data": d}) for t, d in (
        ("risk_assessment", {"id": "1"}), ("statistics_update", {"totalAssessments": 3}), ("system_metrics", {"cpuUsage": 1.5}),
        ("model_performance", {"accuracy": 0.5}), ("notification", {"message": "m"}), ("other", {}))]
    for i, part in enumerate((lines[:3], lines[3:])):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(part))
    feed = readers.read_feed(spark, str(tmp_path / "in"), max_files=1)
    readers.route_stream(feed, f"{tmp_path}/out", f"{tmp_path}/cp", trigger=None).awaitTermination()
    tables = {k: spark.read.parquet(f"{tmp_path}/out/{k}").drop("batch").collect() for k in [*readers.MESSAGE_SCHEMAS, "unrouted"]}
    assert {k: len(v) for k, v in tables.items()} == dict.fromkeys(tables, 1)
    assert (tables["risk_assessment"][0].id, tables["model_performance"][0].accuracy, tables["unrouted"][0].raw) == ("1", 0.5, lines[5])


def test_kafka_reader_builds_the_subscription(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        readers.read_kafka(spark, "broker:9092", ["transactions", "risk-events"])
