"""Equi joins of the warehouse.

No join here carries a broadcast hint. Spark checks the size of a side against
``spark.sql.autoBroadcastJoinThreshold`` (again at run time, under AQE) and otherwise shuffles both
sides, splitting partitions of hot keys. The sides joined back are always unique on the key, so a hot
key never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import days_between, distinct_count, json_map, snap
from riskloom.functions.scoring import location_risk


def join_txn_assessment(transactions: DataFrame, assessments: DataFrame) -> DataFrame:
    extra = [c for c in assessments.columns if c == "transaction_id" or c not in transactions.columns]
    return transactions.join(assessments.select(*extra), "transaction_id", "inner")


def join_merchant_3way(merchants: DataFrame, transactions: DataFrame, assessments: DataFrame) -> DataFrame:
    return join_txn_assessment(transactions, assessments).join(merchants, "merchant_id", "inner")


def join_customer_fanout(customers: DataFrame, assessments: DataFrame, transactions: DataFrame,
                         fanout: bool = True, approx: bool = False) -> DataFrame:
    """Per-customer profile over customers x their assessments x their transactions.

    Joining both detail tables on the customer repeats every assessment once per transaction and the
    other way round. Each table is aggregated per customer first; counts and sums are then multiplied
    by the number of repeats, averages, extremes and distinct counts need no correction, and the
    sample deviation is rebuilt from the centred sum of squares. ``fanout=False`` reports the numbers
    without repeats. Customers without an assessment do not appear.
    """
    a = assessments.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_a"),
        F.count("assessment_id").alias("n_ids"),
        F.count("risk_score").alias("n_scores"),
        snap(F.avg("risk_score")).alias("avg_risk_score"),
        F.max("risk_score").alias("max_risk_score"),
        F.var_samp("risk_score").alias("var_score"),
        F.count_if(F.col("risk_level") == "HIGH").alias("n_high"),
        F.count_if(F.col("recommended_action") == "BLOCK").alias("n_blocked"),
    )
    asked = transactions.join(a.select("customer_id"), "customer_id", "left_semi")  # only those a profile needs
    t = asked.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_t"),
        F.sum("amount").alias("sum_amount"),
        F.avg("amount").alias("avg_amount"),
        distinct_count("merchant_id", approx).alias("unique_merchants"),
        distinct_count("location_country", approx).alias("unique_countries"),
        F.max("transaction_timestamp").alias("last_transaction"),
        F.min("transaction_timestamp").alias("first_transaction"),
    )
    joined = customers.join(a, "customer_id").join(t, "customer_id", "left")
    repeats_a = F.greatest(F.coalesce("n_t", F.lit(0)), F.lit(1)).cast("bigint") if fanout else F.lit(1).cast("bigint")
    repeats_t = F.col("n_a") if fanout else F.lit(1)
    squares = F.coalesce("var_score", F.lit(0.0)) * (F.col("n_scores") - 1)
    n_repeated = F.col("n_scores") * repeats_a
    return joined.select(
        "customer_id", "customer_segment",
        (F.col("n_ids") * repeats_a).alias("total_assessments"),
        "avg_risk_score", "max_risk_score",
        F.when(n_repeated > 1, F.sqrt(squares * repeats_a / (n_repeated - 1))).alias("risk_score_stddev"),
        (F.col("n_high") * repeats_a).alias("high_risk_count"),
        (F.col("n_blocked") * repeats_a).alias("blocked_count"),
        (F.col("sum_amount") * repeats_t).alias("total_amount"),
        "avg_amount",
        F.coalesce("unique_merchants", F.lit(0)).cast("bigint").alias("unique_merchants"),
        F.coalesce("unique_countries", F.lit(0)).cast("bigint").alias("unique_countries"),
        "last_transaction", "first_transaction",
        days_between("first_transaction", "last_transaction").alias("customer_lifespan_days"),
    )


def join_customer_features(transactions: DataFrame, features: DataFrame) -> DataFrame:
    return transactions.join(features, "customer_id", "inner").withColumn(
        "amount_ratio", F.try_divide("amount", "avg_amount"))


def join_location_features(transactions: DataFrame, features: DataFrame, keep_null: bool = False) -> DataFrame:
    """Rows without a location drop out unless ``keep_null``."""
    joined = transactions.join(features, "location", "left" if keep_null else "inner")
    return joined.withColumn("location_risk_score", location_risk("location_transaction_count"))


def lookup_left(df: DataFrame, dim: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left lookup against a side that is unique on ``key``; no match gives nulls."""
    return df.join(dim, key, "left")


def json_lateral(df: DataFrame, col: str, key_name: str = "key", value_name: str = "value") -> DataFrame:
    """One row per entry of a JSON object column."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.explode(json_map(col)).alias(key_name, value_name))
