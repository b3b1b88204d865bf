"""Feature tables for training and for online scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import age_features, amount_transforms, calendar_features, present_map
from riskloom.operators.joins import join_customer_features, join_location_features, lookup_left
from riskloom.operators.relational import customer_features, location_features
from riskloom.operators.temporal import trailing_by_keys
from riskloom.session import scratch_path


Stage = Callable[[DataFrame], DataFrame]


def lazily(df: DataFrame) -> DataFrame:
    """Default stage: leave the frame in the plan."""
    return df


def staged(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Its exact size is then known before the join is planned, so Spark broadcasts it if it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and the large side is not shuffled; it is also computed once.
    """
    path = scratch_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def feature_matrix(df: DataFrame, ts: str = "transaction_timestamp", stage: Stage = lazily) -> DataFrame:
    """Full feature set; a group of features appears only when its input columns do.

    ``stage`` is applied to the per-customer and per-location tables before they are joined back.
    """
    have = set(df.columns)
    out = df
    if ts in have:
        out = out.withColumns(calendar_features(ts, sunday=1))
    if "amount" in have:
        out = out.withColumns(amount_transforms("amount"))
    if "customer_id" in have:
        per_customer = [F.count(F.lit(1)).alias("customer_transaction_count")]
        if "amount" in have:
            per_customer.append(F.avg("amount").alias("customer_avg_amount"))
        if "risk_score" in have:
            per_customer.append(F.avg("risk_score").alias("customer_risk_history"))
        known = df.filter(F.col("customer_id").isNotNull())
        out = lookup_left(out, stage(known.groupBy("customer_id").agg(*per_customer)), "customer_id")
    if "location" in have:
        per_location = [F.count(F.lit(1)).alias("location_transaction_count")]
        if "amount" in have:
            per_location.append(F.avg("amount").alias("location_avg_amount"))
        known = df.filter(F.col("location").isNotNull())
        out = lookup_left(out, stage(known.groupBy("location").agg(*per_location)), "location")
    if {"amount", "customer_age"} <= have:
        out = out.withColumn("amount_age_ratio", F.try_divide("amount", "customer_age"))
    if {"amount", "customer_id"} <= have:
        out = out.withColumn("amount_frequency_ratio", F.try_divide("amount", "customer_transaction_count"))
    return out


def engineer_features(df: DataFrame, ts: str = "transaction_timestamp", keep_null_location: bool = False,
                      stage: Stage = lazily) -> DataFrame:
    """Rows with the totals of their customer and location, ratio, location risk and calendar features."""
    with_customer = join_customer_features(df, stage(customer_features(df)))
    with_location = join_location_features(with_customer, stage(location_features(df)), keep_null_location)
    return with_location.withColumns(calendar_features(ts, sunday=1))


def online_features(df: DataFrame, profile: str = "engine", ts: str = "transaction_timestamp",
                    score: str = "risk_score") -> DataFrame:
    """Adds ``features``: map<string,double> as the scoring service would build it at each row's time.

    History covers the 30 days (customer) and 7 days (location) before the row. The ``engine`` profile
    leaves unknown ages and locations out of the map and uses the plain log; ``gateway`` uses log(x+1)
    and age 0.
    """
    both = trailing_by_keys(df, ts, {
        "customer_id": (30, {"__c_n": ("count", None), "__c_avg": ("avg", "amount"), "__c_risk": ("avg", score)}),
        "location": (7, {"__l_n": ("count", None), "__l_risk": ("avg", score)})})
    engine = profile == "engine"
    amounts, cal = amount_transforms("amount", plus_one=not engine), calendar_features(ts)
    entries = {
        "amount": F.col("amount"), "amount_log": amounts["amount_log"], "amount_sqrt": amounts["amount_sqrt"],
        "hour": cal["hour"], "day_of_week": cal["day_of_week"],
        "is_weekend": cal["is_weekend"], "is_night": cal["is_night"],
        "customer_transaction_count": F.col("__c_n"), "customer_avg_amount": F.col("__c_avg"),
        "customer_risk_history": F.col("__c_risk"),
        "location_risk_score": F.col("__l_risk"),
        "location_transaction_count": F.when(F.col("location").isNotNull() | F.lit(not engine), F.col("__l_n")),
    }
    if engine:
        ages = age_features("customer_age")
        entries |= {"amount_squared": amounts["amount_squared"], "customer_age": F.col("customer_age"),
                    "is_young": ages["is_young"], "is_senior": ages["is_senior"]}
    else:
        entries["customer_age"] = F.coalesce("customer_age", F.lit(0))
    return both.withColumn("features", present_map(**entries)).drop("__c_n", "__c_avg", "__c_risk", "__l_n", "__l_risk")
