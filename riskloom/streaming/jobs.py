"""Structured Streaming jobs: the batch expressions on a streaming frame, plus keyed and windowed state.

Event times must be TIMESTAMP; ``event_time`` converts columns that carry no time zone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.functions.columns import score_bucket
from riskloom.functions.scoring import Inputs, Profile, naive_risk_score, score_batch
from riskloom.ml.metrics import ACCURACY_FLOOR
from riskloom.operators.ordered import interval_micros
from riskloom.plans.warehouse import assessment_counts, metric_alert


def event_time(df: DataFrame, ts: str) -> DataFrame:
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


def stream_score(df: DataFrame, profile: Profile | str = "naive", ts: str = "timestamp",
                 model_col: str | None = None, invalid: Column | None = None, on_error: str = "default") -> DataFrame:
    """Score parsed events; stateless, so batches and streams give the same rows. Errors are treated as in
    ``score_batch``; the naive profile has no such treatment."""
    stamped = df.withColumn("processing_timestamp", F.current_timestamp())
    if profile == "naive":
        return naive_risk_score(stamped, Inputs(ts=ts))
    return score_batch(stamped, profile, model_col, invalid=invalid, on_error=on_error)


def stream_dedup_ttl(df: DataFrame, id_col: str, ts: str, ttl: str = "30 minutes") -> DataFrame:
    """Drop repeats of an id within ``ttl`` of event time.

    An id is remembered until the watermark is ``ttl`` past its first row and the next micro-batch has run;
    repeats after that pass again.
    """
    return event_time(df, ts).withWatermark(ts, ttl).dropDuplicatesWithinWatermark([id_col])


def stream_misses_ttl(df: DataFrame, id_col: str, ts: str, ttl: str = "30 minutes") -> DataFrame:
    """The requests a cache with this lifetime would not answer, exactly.

    The first request of an id passes and fills the cache; requests less than ``ttl`` later are answered;
    the first one after that passes and fills it again. State is one instant per id, released when the
    watermark passes its expiry. Requests of one micro-batch are taken in event order; one that arrives
    after a later fill of its id is answered by that fill. Where dropping some repeats just after the
    lifetime is acceptable, ``stream_dedup_ttl`` does the same without Python.
    """
    keep = interval_micros(ttl)
    stamped = event_time(df, ts).withWatermark(ts, ttl)

    def misses(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        expires = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        at = rows[ts].to_numpy().astype("datetime64[us]").astype("int64")
        passed = np.zeros(len(rows), dtype=bool)
        nxt = 0 if expires is None else int(np.searchsorted(at, expires))
        while nxt < len(at):
            passed[nxt], expires = True, int(at[nxt]) + keep
            nxt = int(np.searchsorted(at, expires))
        state.update((expires,))
        state.setTimeoutTimestamp(max(expires // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[passed]

    return stamped.groupBy(id_col).applyInPandasWithState(
        misses, stamped.schema, "expires bigint", "append", GroupStateTimeout.EventTimeTimeout)


def stream_with_snapshot(stream: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Events with the history of their key, joined from a table that is refreshed on its own schedule."""
    return stream.join(snapshot, key, "left")


def stream_hourly_metrics(df: DataFrame, watermark: str = "1 hour", ts: str = "assessment_timestamp") -> DataFrame:
    """Hourly roll-up; an hour is emitted once the watermark has passed its end."""
    return event_time(df, ts).withWatermark(ts, watermark).groupBy(F.window(ts, "1 hour").alias("w")).agg(
        *assessment_counts()).select(F.col("w.start").alias("hour"), *[
            "total_assessments", "high_risk_count", "medium_risk_count", "low_risk_count",
            "avg_risk_score", "avg_processing_time", "blocked_transactions"])


def stream_daily_summary(df: DataFrame, watermark: str = "1 day", ts: str = "assessment_timestamp") -> DataFrame:
    daily = event_time(df, ts).withWatermark(ts, watermark).groupBy(F.window(ts, "1 day").alias("w")).agg(
        *assessment_counts())
    return daily.select(
        F.to_date("w.start").alias("assessment_date"), "total_assessments", "high_risk_count", "medium_risk_count",
        "low_risk_count", "avg_risk_score", "avg_processing_time",
        F.col("blocked_transactions").alias("blocked_count"))


def write_daily_summary(summary: DataFrame, path: str, checkpoint: str, trigger: str | None = "10 seconds") -> StreamingQuery:
    """Maintain the daily table: every micro-batch overwrites the partitions of the days it changed.

    In update mode a changed day arrives with its full totals. Only the last micro-batch is ever replayed, and it writes
    the same days again, so restarts leave the table as it was; the table holds one partition per day.
    """
    def write_changes(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("assessment_date").parquet(path)

    writer = summary.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write_changes)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start()


def read_daily_summary(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select("assessment_date", *[c for c in rows.columns if c != "assessment_date"])


_PANE = ["customer_id", "pane", "n", "total", "n_amount"]


def stream_sliding_customer(df: DataFrame, length: str = "30 days", slide: str = "1 day", watermark: str = "1 day",
                            ts: str = "transaction_timestamp", buckets: int = 1024) -> DataFrame:
    """Customer counts and averages over sliding windows of event time.

    Customers are dealt over ``buckets`` by hash; the one state row of a bucket holds the panes (parts of time that windows share) of its
    customers' windows not ended yet. When the watermark passes windows, all that are due in a bucket are combined at once, and
    neighbouring windows of a customer that hold the same panes leave Python as one row. Events are summed by (customer, pane) before
    they are shuffled, so a customer with a third of all events sends a few rows from each task. An event counts in every
    window that has not ended by the watermark of its micro-batch, and in none that has. Events without a time count nowhere, those
    without a customer are one customer. A checkpoint belongs to its number of buckets.
    """
    span, step = interval_micros(length), interval_micros(slide)
    width = math.gcd(span, step)
    kind = df.schema["customer_id"].dataType.simpleString()

    def by_pane(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["pane"] = b["at"] // width * width
            yield b.groupby(["customer_id", "pane"], dropna=False, as_index=False).agg(
                at=("at", "max"), n=("at", "size"), total=("amount", "sum"), n_amount=("amount", "count"))

    def windows(pane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the first and last window of each pane."""
        return -((span - pane - width) // step) * step + span, pane // step * step + span

    def next_end(at: int) -> int:
        """The first end of a window after ``at``."""
        return span + ((at - span) // step + 1) * step

    def runs(held: pd.DataFrame, done: int, now: int) -> pd.DataFrame:
        """Windows that end in (done, now], as runs of neighbouring ones of a customer that hold the same panes."""
        who, customers = pd.factorize(held["customer_id"], use_na_sentinel=False)
        order = np.lexsort((held["pane"].to_numpy(), who))
        who, (pane, n, total, n_amount) = who[order], (held[c].to_numpy()[order] for c in _PANE[1:])
        first, last = windows(pane)
        edges = np.unique(np.stack([np.tile(who, 2), np.concatenate([first, last + step])], axis=1), axis=0)
        its, begin = edges[:-1, 0], np.maximum(edges[:-1, 1], next_end(done))
        end = np.minimum(edges[1:, 1], next_end(now)) - step
        due = (its == edges[1:, 0]) & (begin <= end)
        its, begin, end = its[due], begin[due], end[due]
        low = pane.min(initial=2**62) - span                        # places on one line: customers side by side, in panes
        room = (pane.max(initial=-2**62) + 2 * span + step - low) // width + 2
        places = who * room + (pane - low) // width
        lo, hi = (np.searchsorted(places, its * room + (x - low) // width) for x in (begin - span, begin))
        some = hi > lo
        its, begin, end, at = its[some], begin[some], end[some], np.stack([lo[some], hi[some]], axis=1).ravel()
        counts, totals, amounts = (np.add.reduceat(np.append(x, 0), at)[::2] if len(at) else x[:0] for x in (n, total, n_amount))
        means = np.where(amounts > 0, totals / np.maximum(amounts, 1), np.nan)  # NaN leaves as null
        return pd.DataFrame({"first": begin, "last": end, "customer_id": np.asarray(customers, dtype=object)[its],
                             "transaction_count": counts, "avg_amount": means})

    def combine(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        now = mark * 1000 + span if mark > 0 else -2**61  # the state outlives the watermark by the length of a window
        *columns, done = state.get if state.exists else ([], [], [], [], [], now)
        held = pd.DataFrame({c: pd.Series(v, dtype=t) for c, v, t in zip(_PANE, columns, (object, "int64", "int64", "float64", "int64"))})
        if len(held) and now > done:
            yield runs(held, done, now)
        if not state.hasTimedOut:
            for b in batches:
                held = pd.concat([held, b[_PANE]]) if len(held) else b[_PANE]
                held = held.groupby(["customer_id", "pane"], dropna=False, as_index=False).sum()
        first, last = windows(held["pane"].to_numpy())
        held, first = held[last > now], first[last > now]
        if held.empty:
            state.remove()
            return
        known = held["customer_id"].astype(object).where(held["customer_id"].notna(), None)
        state.update((known.tolist(), *(held[c].tolist() for c in _PANE[1:]), now))
        following = np.where(first > now, first, next_end(now)).min()
        state.setTimeoutTimestamp(max(-(-int(following - span) // 1000) - 1, mark, 1))

    events = event_time(df, ts).filter(F.col(ts).isNotNull()).select(
        "customer_id", F.unix_micros(ts).alias("at"), F.col("amount").cast("double").alias("amount"))
    sums = events.mapInPandas(by_pane, f"customer_id {kind}, pane bigint, at bigint, n bigint, total double, n_amount bigint")
    combined = sums.withColumns({"at": F.timestamp_micros("at"), "bucket": F.pmod(F.xxhash64("customer_id"), F.lit(buckets))}) \
        .withWatermark("at", f"{interval_micros(watermark) + span} microseconds") \
        .groupBy("bucket").applyInPandasWithState(
            combine, f"first bigint, last bigint, customer_id {kind}, transaction_count bigint, avg_amount double",
            f"customer_id array<{kind}>, pane array<bigint>, n array<bigint>, total array<double>, n_amount array<bigint>, done bigint",
            "append", GroupStateTimeout.EventTimeTimeout)
    ended = combined.withColumn("end", F.explode(F.sequence("first", "last", F.lit(step).cast("bigint"))))
    return ended.select(F.timestamp_micros(F.col("end") - span).alias("window_start"), F.timestamp_micros("end").alias("window_end"),
                        "customer_id", "transaction_count", "avg_amount")


def stream_alerts(metrics: DataFrame, watermark: str = "1 hour", ts: str = "metric_time",
                  thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Hourly metric means beyond their limit; ``thresholds`` replaces the built-in limits by name.

    An hourly mean of ``model_accuracy`` below its floor is an alert in either case.
    """
    hourly = event_time(metrics, ts).withWatermark(ts, watermark).groupBy(
        F.window(ts, "1 hour").alias("w"), "metric_name").agg(F.avg("metric_value").alias("avg_value"))
    name, value = F.col("metric_name"), F.col("avg_value")
    if thresholds is None:
        alert = metric_alert(name, value)
    else:
        alert = F.lit(None).cast("string")
        for metric, limit in thresholds.items():
            alert = F.when((name == metric) & (value > limit), F.concat(F.lit("HIGH_"), F.upper(name))).otherwise(alert)
        alert = F.coalesce(alert, F.lit("NORMAL"))
    alert = F.when((name == "model_accuracy") & (value < ACCURACY_FLOOR), "LOW_ACCURACY").otherwise(alert)
    return hourly.select(F.col("w.start").alias("hour"), "metric_name", "avg_value", alert.alias("alert_status")) \
        .filter("alert_status <> 'NORMAL'")


def metrics_gauge(df: DataFrame, window: str = "1 hour", watermark: str = "1 hour",
                  ts: str = "assessment_timestamp") -> DataFrame:
    """Per window: score histogram, mean duration and the newest score (a gauge)."""
    buckets = ["0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"]
    bucket = score_bucket("risk_score", None)
    histogram = F.create_map(*[x for b in buckets for x in (F.lit(b), F.count_if(bucket == b))])
    return event_time(df, ts).withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w")).agg(
        histogram.alias("score_histogram"), F.avg("processing_time_ms").alias("avg_processing_time"),
        F.max_by("risk_score", F.struct(ts, "assessment_id")).alias("last_score"),
    ).select(F.col("w.start").alias("window_start"), "score_histogram", "avg_processing_time", "last_score")
