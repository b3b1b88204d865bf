"""Sinks. Table writes keep a layout that prunes on read; streams keep their state in a checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_stream_append(df: DataFrame, path: str, checkpoint: str, trigger: str | None = "10 seconds",
                        format: str = "parquet") -> StreamingQuery:
    """Append a stream to files; ``trigger=None`` drains what is there and stops."""
    writer = df.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start(path)


def write_overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table, or only the partitions present in ``df`` when it is partitioned."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def risk_event_sink(df: DataFrame, ts: str = "assessment_timestamp", full: bool = False) -> DataFrame:
    """(key, value) messages: id and JSON of id, score, level, time; ``full`` sends every column."""
    fields = df.columns if full else ["transaction_id", "risk_score", "risk_level", F.col(ts).alias("timestamp")]
    return df.select(F.col("transaction_id").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest_by_id(df: DataFrame, id_col: str, ts: str) -> DataFrame:
    """Newest version per id; copies shrink to one per map task before the shuffle."""
    comparable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    newest = F.max_by(F.struct(*df.columns), F.struct(ts, *[c for c in comparable if c != ts]))
    return df.groupBy(F.col(id_col).alias("__id")).agg(newest.alias("row")).select("row.*")


def append_assessments(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_assessments(spark: SparkSession, path: str, id_col: str = "assessment_id",
                     ts: str = "assessment_timestamp") -> DataFrame:
    """Appended assessments, one row per id."""
    return latest_by_id(spark.read.parquet(path), id_col, ts)


def daily_summary_mv(assessments: DataFrame) -> DataFrame:
    from riskloom.plans.warehouse import q11_daily_summary

    return q11_daily_summary(assessments)


def refresh_daily_summary(assessments: DataFrame, changed: DataFrame, path: str,
                          ts: str = "assessment_timestamp") -> None:
    """Recompute only the months touched by ``changed`` and overwrite their partitions.

    A day is one row, so months keep the files from becoming tiny. The first and last touched month bound the scan by
    literals that reach the files. A touched month without rows is overwritten by a row that ``read_daily_table`` leaves out.
    """
    def month(col):
        return F.date_trunc("month", col).cast("date")

    touched = changed.select(month(ts).alias("assessment_month")).filter("assessment_month IS NOT NULL").distinct()
    first, last = touched.agg(F.min("assessment_month"), F.add_months(F.max("assessment_month"), 1)).first()
    if first is None:
        return
    kind = assessments.schema[ts].dataType
    near = assessments.filter((F.col(ts) >= F.lit(first).cast(kind)) & (F.col(ts) < F.lit(last).cast(kind)))
    summary = daily_summary_mv(near).withColumn("assessment_month", month("assessment_date"))
    fresh = touched.join(summary, "assessment_month", "left").select(*summary.columns)
    write_overwrite(fresh.repartition("assessment_month"), path, ["assessment_month"])


def read_daily_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``refresh_daily_summary`` keeps."""
    return spark.read.parquet(path).filter("assessment_date IS NOT NULL").drop("assessment_month")


def table_layout(df: DataFrame, path: str, ts: str, sort_by: Sequence[str] = ("customer_id",), by: str = "day") -> None:
    """Period partitions with rows sorted inside each file, so time and key filters skip data.

    Rows are rebalanced by period: a heavy period is split over several tasks at run time, light ones share one.
    """
    period = df.withColumn("event_period", F.date_trunc(by, ts).cast("date")).hint("rebalance", "event_period")
    period.sortWithinPartitions("event_period", *sort_by).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("event_period").parquet(path)


def bucketed_layout(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Catalog table bucketed and sorted by a join key.

    Tables written with the same key and number of buckets join on it without a shuffle, which pays off
    for transactions and assessments, both large and always joined on the transaction.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
