"""Readers, sinks, schemas and the batch run."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from riskloom.plans import batch
from riskloom.schemas import DEFAULTS, TABLES, conform, create_tables
from riskloom.session import scratch_path, shared_dir
from riskloom.sources import readers, writers

DAY = dt.datetime(2024, 1, 1)


def test_extension_picks_the_reader(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, name string")
    df.write.csv(f"{tmp_path}/x.csv", header=True)
    df.coalesce(1).write.json(f"{tmp_path}/x.json")
    assert sorted(map(tuple, readers.read_by_extension(spark, f"{tmp_path}/x.csv").collect())) == [(1, "a,b"), (2, None)]
    assert sorted(map(tuple, readers.read_by_extension(spark, f"{tmp_path}/x.json", "id int, name string").collect())) == [(1, "a,b"), (2, None)]
    (tmp_path / "y.json").write_text('[{"id": 1},\n {"id": 2}]')
    assert readers.read_by_extension(spark, f"{tmp_path}/y.json", "id int", multi_line=True).count() == 2
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_by_extension(spark, "x.xlsx")


def test_merged_schemas(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{tmp_path}/t/p=1")
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(f"{tmp_path}/t/p=2")
    assert {(r.a, r.b) for r in readers.read_table(spark, f"{tmp_path}/t").collect()} == {(1, None), (2, "x")}


def test_tables_and_defaults(spark):
    tables = create_tables(spark)
    assert set(tables) == set(TABLES) and all(t.count() == 0 for t in tables.values())
    row = conform(spark.createDataFrame([("t", 12.345, None)], "transaction_id string, amount double, status string"), "transactions", DAY).first()
    assert (str(row.amount), row.currency, row.status, row.created_at) == ("12.35", "USD", DEFAULTS["transactions"]["status"], DAY)


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    writers.write_overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    writers.write_overwrite(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert {(r.v, r.p) for r in spark.read.parquet(path).collect()} == {(1, "a"), (9, "b")}


def test_daily_refresh_touches_only_its_months(spark, tmp_path):
    cols = "risk_level string, risk_score double, processing_time_ms int, recommended_action string, assessment_timestamp timestamp_ntz"
    a = spark.createDataFrame([("HIGH", 0.9, 5, "BLOCK", DAY), ("LOW", 0.1, 7, "APPROVE", DAY + dt.timedelta(days=40))], cols)
    path = f"{tmp_path}/daily"
    writers.refresh_daily_summary(a, a, path)
    late = spark.createDataFrame([("LOW", 0.3, 9, "APPROVE", DAY)], cols)
    writers.refresh_daily_summary(a.unionAll(late), late, path)
    got = {r.assessment_date: r.total_assessments for r in spark.read.parquet(path).collect()}
    assert got == {DAY.date(): 2, (DAY + dt.timedelta(days=40)).date(): 1}
    writers.refresh_daily_summary(late, a, path)   # the second month has become empty
    assert [(r.assessment_date, r.total_assessments) for r in writers.read_daily_table(spark, path).collect()] == [(DAY.date(), 1)]
    writers.refresh_daily_summary(late, a.limit(0), path)
    plan = spark.read.parquet(path).filter(F.col("assessment_month") == F.lit(DAY.date()))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(assessment_month" in plan


def test_latest_version_wins(spark, tmp_path):
    path = f"{tmp_path}/a"
    cols = "assessment_id string, risk_score double, assessment_timestamp timestamp_ntz"
    writers.append_assessments(spark.createDataFrame([("A", 0.1, DAY), ("B", 0.2, DAY)], cols), path)
    writers.append_assessments(spark.createDataFrame([("A", 0.9, DAY + dt.timedelta(seconds=1))], cols), path)
    assert {(r.assessment_id, r.risk_score) for r in writers.read_assessments(spark, path).collect()} == {("A", 0.9), ("B", 0.2)}


def test_layout_prunes_partitions(spark, tmp_path):
    rows = [(f"c{i % 5}", DAY + dt.timedelta(days=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "customer_id string, ts timestamp_ntz")
    writers.table_layout(df, f"{tmp_path}/l", "ts")
    back = spark.read.parquet(f"{tmp_path}/l")
    assert back.count() == 20
    text = back.filter(F.col("event_period") == F.lit(DAY.date()))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_period" in text


def test_bucketed_tables_join_without_a_shuffle(spark):
    ids = spark.range(100).select(F.concat(F.lit("T"), F.col("id")).alias("transaction_id"), "id")
    spark.sql("DROP TABLE IF EXISTS bucketed_a")
    spark.sql("DROP TABLE IF EXISTS bucketed_b")
    for table in ("bucketed_a", "bucketed_b"):
        writers.bucketed_layout(ids, table, "transaction_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b").withColumnRenamed("id", "id2"), "transaction_id")
        assert joined.count() == 100
        text = joined._jdf.queryExecution().toString()
        assert "Exchange" not in text[text.index("== Physical Plan =="):]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_events_carry_key_and_json(spark):
    df = spark.createDataFrame([("T1", 0.5, "MEDIUM", DAY, "x")], "transaction_id string, risk_score double, risk_level string, assessment_timestamp timestamp_ntz, extra string")
    r = writers.risk_event_sink(df).first()
    assert r.key == "T1" and '"risk_score":0.5' in r.value and "extra" not in r.value
    assert '"extra":"x"' in writers.risk_event_sink(df, full=True).first().value


def test_batch_run_writes_valid_rows(spark, warehouse, tmp_path):
    warehouse.transactions_dirty.write.parquet(f"{tmp_path}/raw")
    report = batch.run(spark, f"{tmp_path}/raw", f"{tmp_path}/out").first()
    assert report.duplicate_count > 0
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() > 0
    assert out.filter("amount <= 0 OR customer_age < 18 OR risk_score > 1 OR amount_zscore >= 3 OR location IS NULL").count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x") and os.path.dirname(scratch_path(spark, "x")) == shared_dir(spark)
