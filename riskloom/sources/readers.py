"""Readers for tables, files and event feeds."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.schemas import TXN


def read_table(spark: SparkSession, path: str, format: str = "parquet", merge_schema: bool = True) -> DataFrame:
    """Lazy table scan: no count and no caching, so filters and columns still reach the files."""
    return spark.read.format(format).option("mergeSchema", str(merge_schema).lower()).load(path)


def read_by_extension(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                      multi_line: bool = False) -> DataFrame:
    """CSV with a header or JSON. JSON is one object a line, as ``export_json`` writes it, so that files can be split;
    ``multi_line`` reads files that hold one array or one object over several lines, each in one task."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".csv"):
        return reader.csv(path, header=True, inferSchema=schema is None)
    if path.endswith(".json"):
        return reader.json(path, multiLine=multi_line)
    raise ValueError(f"unsupported file format: {path}")


def read_kafka(spark: SparkSession, servers: str, topics: Sequence[str], starting: str = "latest") -> DataFrame:
    """Topic subscription; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting)
        .load())


def read_feed(spark: SparkSession, path: str, max_files: int | None = None, glob: str | None = None) -> DataFrame:
    """Text files as a feed with a ``value`` column, for any deployment without a broker."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def parse_events(df: DataFrame, schema: T.StructType = TXN, value_col: str = "value") -> DataFrame:
    """Adds ``raw`` and ``event``; ``event`` is null when the text is not JSON or lacks a required field."""
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    parsed = df.select(F.col(value_col).cast("string").alias("raw")).withColumn(
        "event", F.from_json("raw", nullable))
    complete = F.lit(True)
    for f in schema.fields:
        if not f.nullable:
            complete = complete & F.col("event")[f.name].isNotNull()
    return parsed.withColumn("event", F.when(F.col("event").isNotNull() & complete, F.col("event")))


def parse_transactions(df: DataFrame, value_col: str = "value", schema: T.StructType = TXN) -> DataFrame:
    """Well-formed events as columns."""
    return parse_events(df, schema, value_col).filter("event IS NOT NULL").select("event.*")


def quarantine_transactions(df: DataFrame, value_col: str = "value", schema: T.StructType = TXN) -> DataFrame:
    """The texts ``parse_transactions`` leaves out."""
    return parse_events(df, schema, value_col).filter("event IS NULL").select("raw")


# Message types of the dashboard feed.
MESSAGE_SCHEMAS = {
    "risk_assessment": "id string, transactionId string, customerId string, amount double, riskScore double, "
                       "riskLevel string, confidence double, recommendedAction string, timestamp timestamp, "
                       "processingTime double, features map<string,double>, businessRules array<string>",
    "statistics_update": "totalAssessments bigint, highRiskCount bigint, mediumRiskCount bigint, lowRiskCount bigint, "
                         "averageRiskScore double, averageProcessingTime double, successRate double, errorRate double",
    "system_metrics": "cpuUsage double, memoryUsage double, diskUsage double, networkLatency double, "
                      "activeConnections bigint, requestsPerSecond double, errorRate double, cacheHitRate double",
    "model_performance": "accuracy double, precision double, recall double, f1Score double, auc double, "
                         "confusionMatrix array<array<bigint>>, featureImportance map<string,double>, "
                         "driftScore double, lastUpdated timestamp",
    "notification": "id string, message string, type string, timestamp timestamp",
}


def route_messages(df: DataFrame, schemas: Mapping[str, str] = MESSAGE_SCHEMAS,
                   value_col: str = "value") -> dict[str, DataFrame]:
    """One typed frame per message type of a mixed feed, and the other texts as ``unrouted``: those of no known type, and those
    whose ``data`` is no object or holds a value that its type's schema cannot read. Works on batches and streams (there
    ``route_stream`` reads the feed once)."""
    text = F.col(value_col).cast("string")
    envelope = df.select(
        text.alias("raw"), F.get_json_object(text, "$.type").alias("type"), F.get_json_object(text, "$.data").alias("data"))
    bad = "__unreadable"
    data = {kind: F.from_json("data", f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad}) for kind, schema in schemas.items()}

    def readable(kind: str) -> Column:
        return F.coalesce((F.col("type") == kind) & F.ltrim("data").startswith("{") & data[kind][bad].isNull(), F.lit(False))

    routed = functools.reduce(operator.or_, map(readable, schemas), F.lit(False))
    return {"unrouted": envelope.filter(~routed).select("raw")} | {
        kind: envelope.filter(readable(kind)).select(data[kind].alias("d")).select("d.*").drop(bad) for kind in schemas}


def route_stream(stream: DataFrame, path: str, checkpoint: str, schemas: Mapping[str, str] = MESSAGE_SCHEMAS,
                 value_col: str = "value", trigger: str | None = "10 seconds") -> StreamingQuery:
    """Route a stream in one query: each micro-batch is read once and appended to one table per type below ``path``.

    A replayed micro-batch overwrites its own folder, so no message is written twice.
    """
    def split(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, rows in route_messages(batch, schemas, value_col).items():
            rows.write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(split)
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()
