"""The named warehouse reports.

Each report takes its tables, an ``as_of`` instant (default: newest row of the filtered table, as a
scalar subquery) and a look-back. Joins carry no hints: Catalyst and AQE broadcast a side only below
``spark.sql.autoBroadcastJoinThreshold`` and split skewed partitions otherwise.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import (
    case_day_name, coalesce_delta, day_of_week, distinct_count, percent, round_half_up, score_bucket, snap)
from riskloom.functions.scoring import risk_level
from riskloom.operators.joins import (
    join_customer_fanout, join_merchant_3way, join_txn_assessment, json_lateral)
from riskloom.operators.relational import lookback_filter, win_lag, win_row_number_topn, win_total_share


def is_level(level: str) -> Column:
    return F.col("risk_level") == level


def is_blocked() -> Column:
    return F.col("recommended_action") == "BLOCK"


def assessment_counts() -> list[Column]:
    """The roll-up columns shared by the dashboard, the daily summary and the streams."""
    return [
        F.count(F.lit(1)).alias("total_assessments"),
        F.count_if(is_level("HIGH")).alias("high_risk_count"),
        F.count_if(is_level("MEDIUM")).alias("medium_risk_count"),
        F.count_if(is_level("LOW")).alias("low_risk_count"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.avg("processing_time_ms").alias("avg_processing_time"),
        F.count_if(is_blocked()).alias("blocked_transactions"),
    ]


def q01_dashboard(assessments: DataFrame, as_of=None, hours: float = 24) -> DataFrame:
    recent = lookback_filter(assessments, "assessment_timestamp", hours / 24, as_of)
    hourly = recent.groupBy(
        F.date_trunc("hour", "assessment_timestamp").cast("timestamp_ntz").alias("hour")).agg(*assessment_counts())
    return hourly.select(
        "hour", "total_assessments", "high_risk_count", "medium_risk_count", "low_risk_count",
        round_half_up("avg_risk_score", 4).alias("avg_risk_score"),
        round_half_up("avg_processing_time", 2).alias("avg_processing_time_ms"),
        "blocked_transactions",
        percent("high_risk_count", "total_assessments").alias("high_risk_percentage"),
        percent("blocked_transactions", "total_assessments").alias("block_rate"),
    ).orderBy(F.desc("hour"))


def q02_customer_profile(customers: DataFrame, assessments: DataFrame, transactions: DataFrame, as_of=None,
                         days: float = 30, fanout: bool = True, approx: bool = False) -> DataFrame:
    recent = lookback_filter(assessments, "assessment_timestamp", days, as_of)
    profile = join_customer_fanout(customers, recent, transactions, fanout, approx)
    high = F.col("avg_risk_score") > 0.7
    return profile.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        round_half_up(F.avg("avg_risk_score"), 4).alias("segment_avg_risk_score"),
        round_half_up(F.avg("total_assessments"), 2).alias("avg_assessments_per_customer"),
        round_half_up(F.avg("total_amount"), 2).alias("avg_total_amount"),
        round_half_up(F.avg("unique_merchants"), 2).alias("avg_unique_merchants"),
        F.count_if(high).alias("high_risk_customers"),
        percent(F.count_if(high), F.count(F.lit(1))).alias("high_risk_percentage"),
    ).orderBy(F.desc_nulls_first("segment_avg_risk_score"))


def q03_geographic(transactions: DataFrame, assessments: DataFrame, as_of=None, days: float = 7,
                   min_transactions: int = 10, top: int = 50, approx: bool = False) -> DataFrame:
    recent = lookback_filter(transactions, "transaction_timestamp", days, as_of)
    place = ["location_country", "location_region", "location_city"]
    grouped = join_txn_assessment(recent, assessments).groupBy(*place).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        snap(F.avg("risk_score")).alias("avg_risk"),
        F.count_if(is_level("HIGH")).alias("high_risk_count"),
        F.sum("amount").alias("sum_amount"),
        F.avg("amount").alias("mean_amount"),
        distinct_count("customer_id", approx).alias("unique_customers"),
        distinct_count("merchant_id", approx).alias("unique_merchants"),
    ).filter(F.col("transaction_count") >= min_transactions)
    ordered = grouped.orderBy(F.desc_nulls_first("avg_risk"), F.desc("transaction_count"), *place).limit(top)
    return ordered.select(
        *place, "transaction_count",
        round_half_up("avg_risk", 4).alias("avg_risk_score"), "high_risk_count",
        percent("high_risk_count", "transaction_count").alias("high_risk_percentage"),
        round_half_up("sum_amount", 2).alias("total_amount"),
        round_half_up("mean_amount", 2).alias("avg_amount"),
        "unique_customers", "unique_merchants",
        round_half_up(F.col("mean_amount") * F.col("unique_customers"), 2).alias("risk_weighted_score"),
    )


def q04_merchant(merchants: DataFrame, transactions: DataFrame, assessments: DataFrame, as_of=None,
                 days: float = 30, min_transactions: int = 5, approx: bool = False) -> DataFrame:
    recent = lookback_filter(transactions, "transaction_timestamp", days, as_of)
    who = ["merchant_id", "merchant_name", "merchant_category", "merchant_country"]
    grouped = join_merchant_3way(merchants, recent, assessments).groupBy(*who).agg(
        F.count("transaction_id").alias("transaction_count"),
        snap(F.avg("risk_score")).alias("avg_risk"),
        F.count_if(is_level("HIGH")).alias("high_risk_count"),
        F.sum("amount").alias("sum_amount"),
        F.avg("amount").alias("mean_amount"),
        distinct_count("customer_id", approx).alias("unique_customers"),
        F.count_if(is_blocked()).alias("blocked_transactions"),
    ).filter(F.col("transaction_count") >= min_transactions)
    return grouped.orderBy(F.desc_nulls_first("avg_risk"), F.desc("transaction_count"), "merchant_id").select(
        *who, "transaction_count",
        round_half_up("avg_risk", 4).alias("avg_risk_score"), "high_risk_count",
        percent("high_risk_count", "transaction_count").alias("high_risk_percentage"),
        round_half_up("sum_amount", 2).alias("total_amount"),
        round_half_up("mean_amount", 2).alias("avg_amount"),
        "unique_customers", "blocked_transactions",
        percent("blocked_transactions", "transaction_count").alias("block_rate"),
        F.coalesce(risk_level("avg_risk", "merchant"), F.lit("LOW")).alias("merchant_risk_level"),
    )


def q05_time_patterns(transactions: DataFrame, assessments: DataFrame, as_of=None, days: float = 30) -> DataFrame:
    recent = lookback_filter(transactions, "transaction_timestamp", days, as_of)
    grouped = join_txn_assessment(recent, assessments).groupBy(
        F.hour("transaction_timestamp").alias("hour_of_day"),
        day_of_week("transaction_timestamp").alias("dow"),
    ).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        snap(F.avg("risk_score")).alias("avg_risk"),
        F.count_if(is_level("HIGH")).alias("high_risk_count"),
        F.sum("amount").alias("sum_amount"),
        F.avg("amount").alias("mean_amount"),
    )
    return grouped.orderBy("dow", "hour_of_day").select(
        "hour_of_day", case_day_name("dow").alias("day_name"), "transaction_count",
        round_half_up("avg_risk", 4).alias("avg_risk_score"), "high_risk_count",
        percent("high_risk_count", "transaction_count").alias("high_risk_percentage"),
        round_half_up("sum_amount", 2).alias("total_amount"),
        round_half_up("mean_amount", 2).alias("avg_amount"),
    )


def drift_status(drift: Column | str) -> Column:
    c = F.col(drift) if isinstance(drift, str) else drift
    return F.when(c > 0.1, "HIGH_DRIFT").when(c > 0.05, "MEDIUM_DRIFT").otherwise("LOW_DRIFT")


def q06_model_performance(performance: DataFrame, as_of=None, days: float = 30) -> DataFrame:
    recent = lookback_filter(performance, "created_at", days, as_of)
    lagged = win_lag(recent, ["model_name"], ["created_at", "model_version"], ["accuracy", "f1_score"])
    return lagged.select(
        "model_name", "model_version",
        round_half_up("accuracy", 4).alias("accuracy"),
        round_half_up("precision_score", 4).alias("precision"),
        round_half_up("recall_score", 4).alias("recall"),
        round_half_up("f1_score", 4).alias("f1_score"),
        round_half_up("auc_score", 4).alias("auc"),
        round_half_up("drift_score", 4).alias("drift_score"),
        "training_samples", "validation_samples", "training_duration_seconds",
        round_half_up(coalesce_delta("accuracy", "prev_accuracy"), 4).alias("accuracy_change"),
        round_half_up(coalesce_delta("f1_score", "prev_f1_score"), 4).alias("f1_change"),
        drift_status("drift_score").alias("drift_status"), "created_at",
    ).orderBy(F.desc_nulls_first("created_at"), "model_name", "model_version")


def q07_feature_importance(performance: DataFrame, as_of=None, days: float = 7, top: int = 20) -> DataFrame:
    recent = lookback_filter(performance, "created_at", days, as_of)
    pairs = json_lateral(recent.select("model_name", "model_version", "created_at", "feature_importance"),
                         "feature_importance", "feature_name", "importance")
    ranked = win_row_number_topn(pairs, ["model_name", "model_version"],
                                 [F.desc_nulls_first("importance"), F.asc("feature_name")], top, "feature_rank")
    return ranked.select(
        "model_name", "model_version", "feature_name",
        round_half_up("importance", 6).alias("importance_score"), "feature_rank", "created_at",
    ).orderBy("model_name", "model_version", "feature_rank")


def metric_alert(name: Column, avg_value: Column) -> Column:
    # Alert limits.
    return (
        F.when((name == "cpu_usage") & (avg_value > 80), "HIGH_CPU")
        .when((name == "memory_usage") & (avg_value > 80), "HIGH_MEMORY")
        .when((name == "error_rate") & (avg_value > 5), "HIGH_ERROR_RATE")
        .otherwise("NORMAL"))


def q08_system_metrics(metrics: DataFrame, as_of=None, hours: float = 24) -> DataFrame:
    recent = lookback_filter(metrics, "metric_time", hours / 24, as_of)
    value = F.col("metric_value")
    hourly = recent.groupBy(
        F.date_trunc("hour", "metric_time").cast("timestamp_ntz").alias("hour"), "metric_name",
    ).agg(F.avg(value).alias("mean"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.stddev(value).alias("sd"))
    return hourly.select(
        "hour", "metric_name",
        round_half_up("mean", 4).alias("avg_value"), round_half_up("hi", 4).alias("max_value"),
        round_half_up("lo", 4).alias("min_value"), round_half_up("sd", 4).alias("stddev_value"),
        metric_alert(F.col("metric_name"), F.col("mean")).alias("alert_status"),
    ).orderBy(F.desc("hour"), "metric_name")


def q09_score_distribution(assessments: DataFrame, as_of=None, days: float = 7) -> DataFrame:
    recent = lookback_filter(assessments, "assessment_timestamp", days, as_of)
    buckets = recent.groupBy(score_bucket("risk_score").alias("risk_score_bucket")).agg(
        F.count(F.lit(1)).alias("assessment_count"),
        F.avg("processing_time_ms").alias("mean_ms"),
        F.count_if(is_blocked()).alias("blocked_count"),
    )
    return win_total_share(buckets, "assessment_count", "percentage").select(
        "risk_score_bucket", "assessment_count", "percentage",
        round_half_up("mean_ms", 2).alias("avg_processing_time_ms"), "blocked_count",
        percent("blocked_count", "assessment_count").alias("block_rate"),
    ).orderBy("risk_score_bucket")


def customer_segment_label() -> Column:
    # Segment names and limits.
    risk, amount, highs = F.col("avg_risk_score"), F.col("total_amount"), F.col("high_risk_count")
    medium = risk.between(0.4, 0.7)
    return (
        F.when((risk > 0.7) & (highs > 2), "HIGH_RISK_FREQUENT")
        .when((risk > 0.7) & (highs <= 2), "HIGH_RISK_OCCASIONAL")
        .when(medium & (amount > 10000), "MEDIUM_RISK_HIGH_VALUE")
        .when(medium & (amount <= 10000), "MEDIUM_RISK_STANDARD")
        .when((risk < 0.4) & (amount > 50000), "LOW_RISK_PREMIUM")
        .when((risk < 0.4) & amount.between(10000, 50000), "LOW_RISK_STANDARD")
        .otherwise("LOW_RISK_BASIC"))


def volatility_label() -> Column:
    sd = F.col("risk_score_stddev")
    return (F.when(sd > 0.3, "HIGH_VOLATILITY").when(sd.between(0.1, 0.3), "MEDIUM_VOLATILITY")
            .otherwise("LOW_VOLATILITY"))


def q10_segmentation(customers: DataFrame, assessments: DataFrame, transactions: DataFrame, as_of=None,
                     days: float = 90, fanout: bool = True, approx: bool = False) -> DataFrame:
    recent = lookback_filter(assessments, "assessment_timestamp", days, as_of)
    profile = join_customer_fanout(customers, recent, transactions, fanout, approx)
    labelled = profile.select(
        customer_segment_label().alias("advanced_segment"), volatility_label().alias("risk_volatility"),
        "avg_risk_score", "total_amount", "unique_merchants", "unique_countries", "customer_lifespan_days",
        (F.col("high_risk_count") > 0).alias("has_high"))
    return labelled.groupBy("advanced_segment", "risk_volatility").agg(
        F.count(F.lit(1)).alias("customer_count"),
        round_half_up(F.avg("avg_risk_score"), 4).alias("segment_avg_risk_score"),
        round_half_up(F.avg("total_amount"), 2).alias("segment_avg_total_amount"),
        round_half_up(F.avg("unique_merchants"), 2).alias("segment_avg_merchants"),
        round_half_up(F.avg("unique_countries"), 2).alias("segment_avg_countries"),
        round_half_up(F.avg("customer_lifespan_days"), 2).alias("segment_avg_lifespan_days"),
        F.count_if("has_high").alias("customers_with_high_risk"),
        percent(F.count_if("has_high"), F.count(F.lit(1))).alias("high_risk_percentage"),
    ).orderBy(F.desc_nulls_first("segment_avg_risk_score"), F.desc("customer_count"))


def q11_daily_summary(assessments: DataFrame) -> DataFrame:
    return assessments.groupBy(F.to_date("assessment_timestamp").alias("assessment_date")).agg(
        *assessment_counts()).withColumnRenamed("blocked_transactions", "blocked_count")


def q12_dq_assessments(assessments: DataFrame) -> DataFrame:
    from riskloom.operators.quality import dq_assessments

    return dq_assessments(assessments)


def q13_dq_transactions(transactions: DataFrame) -> DataFrame:
    from riskloom.operators.quality import dq_transactions

    return dq_transactions(transactions)


def q14_system_health(metrics: DataFrame, as_of=None, hours: float = 1) -> DataFrame:
    recent = lookback_filter(metrics, "metric_time", hours / 24, as_of)
    value = F.col("metric_value")
    return recent.groupBy("metric_name").agg(
        F.count(F.lit(1)).alias("data_points"),
        round_half_up(F.avg(value), 4).alias("avg_value"),
        round_half_up(F.max(value), 4).alias("max_value"),
        round_half_up(F.min(value), 4).alias("min_value"),
        round_half_up(F.stddev(value), 4).alias("stddev_value"),
        F.max("metric_time").alias("latest_reading"),
    ).orderBy("metric_name")


def q15_statistics(assessments: DataFrame, start: dt.datetime | Column, end: dt.datetime | Column) -> DataFrame:
    from riskloom.operators.relational import risk_statistics

    return risk_statistics(assessments, start, end)
