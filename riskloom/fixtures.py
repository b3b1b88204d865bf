"""Warehouse views derived from the star-schema test tables (definitions in FIXTURES.md).

Every view is lazy; column pruning removes whatever a query does not touch, including the
line-item aggregate when no merchant is asked for.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import is_night, is_weekend
from riskloom.session import scratch_path

# Columns of the source tables. Stating them spares a schema inference job per scan.
SOURCES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _secs(col: Column) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, col.cast("decimal(18,6)"))


def _text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _customer_key(col: str) -> Column:
    return F.concat(F.when(F.col(col) % 20 == 0, "NEW").otherwise("CUST"), _text(col))


#: Time column of the tables that are also read as feeds.
STREAM_TIME = {"orders": "o_orderdate", "events": "ts"}


class Warehouse:
    """Lazy warehouse tables over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, orders: DataFrame | None = None,
                 events: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._given = {"orders": orders, "events": events}

    def raw(self, name: str) -> DataFrame:
        """A source table, or the stream given in its place."""
        given = self._given.get(name)
        return given if given is not None else self.spark.read.schema(SOURCES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str, batches: int = 3, files: int = 4) -> DataFrame:
        """A source table as a feed of several micro-batches in time order, so state is carried from one to the next."""
        table, at = self.spark.read.schema(SOURCES[name]).parquet(f"{self.sf_dir}/{name}.parquet"), STREAM_TIME[name]
        path = scratch_path(self.spark, f"feed-{name}")
        first, last = table.agg(F.min(at), F.max(at)).first()
        edges = [first + (last - first) * i / batches for i in range(1, batches)] if first is not None else []
        part = sum((F.coalesce(F.col(at) >= F.lit(e), F.lit(False)).cast("int") for e in edges), F.lit(0))
        for i in range(len(edges) + 1):
            table.filter(part == i).repartition(files).write.mode("append").parquet(path)
        return self.spark.readStream.schema(SOURCES[name]).option("maxFilesPerTrigger", str(files)).parquet(path)

    @cached_property
    def transactions(self) -> DataFrame:
        orders, customer = self.raw("orders"), self.raw("customer")
        nation, region = self.raw("nation"), self.raw("region")
        first_supplier = self.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("suppkey"))
        joined = (
            orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .join(first_supplier, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        )
        priority = F.col("o_orderpriority")
        return joined.select(
            F.concat(F.lit("TXN"), _text("o_orderkey")).alias("transaction_id"),
            _customer_key("o_custkey").alias("customer_id"),
            F.concat(F.lit("M"), _text("suppkey")).alias("merchant_id"),
            (F.col("o_totalprice") * F.lit(0.025)).alias("amount"),
            F.when(priority == "1-URGENT", "CREDIT").when(priority == "2-HIGH", "DEBIT")
            .when(priority == "3-MEDIUM", "CASH").otherwise("DIGITAL").alias("payment_method"),
            F.col("n_name").alias("location_country"),
            F.col("r_name").alias("location_region"),
            F.concat(F.lit("CITY_"), _text(F.col("c_custkey") % 5)).alias("location_city"),
            F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("string"))
            .when(F.col("n_nationkey") % 8 == 7, F.concat("n_name", F.lit("_HIGH_RISK")))
            .otherwise(F.col("n_name")).alias("location"),
            F.when(F.col("o_custkey") % 31 == 0, F.lit(None).cast("int"))
            .otherwise((16 + (F.col("o_custkey") * 37) % 70).cast("int")).alias("customer_age"),
            (F.col("o_orderdate") + _secs((F.col("o_orderkey") * 7919) % 86400)).alias("transaction_timestamp"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("risk_label"),
            F.col("o_orderkey").alias("k"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        t = self.transactions.withColumn(
            "base_score", ((F.col("k") * F.lit(2654435761)) % 10000) / F.lit(10000.0))
        ts, zero = "transaction_timestamp", F.lit(0.0)
        floors = [
            F.when(F.col("amount") > 10000, 0.7).otherwise(zero),
            F.when(F.col("customer_id").startswith("NEW"), 0.5).otherwise(zero),
            F.when(is_night(ts), 0.3).otherwise(zero),
            F.when(is_weekend(ts), 0.2).otherwise(zero),
            F.when((F.col("customer_age") < 25) | (F.col("customer_age") > 65), 0.2).otherwise(zero),
        ]
        return t.withColumn("risk_score", F.least(F.lit(1.0), F.greatest("base_score", *floors)))

    @cached_property
    def risk_assessments(self) -> DataFrame:
        score = F.col("risk_score")
        return self.scored.select(
            F.concat(F.lit("A"), _text("k")).alias("assessment_id"),
            "transaction_id", "customer_id", "risk_score",
            F.when(score >= 0.8, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW").alias("risk_level"),
            F.lit(0.8).alias("confidence_score"),
            F.when(score >= 0.8, "BLOCK").when(score >= 0.5, "REVIEW").otherwise("APPROVE").alias("recommended_action"),
            (5 + F.col("k") % 95).cast("int").alias("processing_time_ms"),
            F.concat(F.lit("v"), _text(F.col("k") % 3)).alias("model_version"),
            (F.col("transaction_timestamp") + _secs(F.lit(1))).alias("assessment_timestamp"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        origin = F.lit("1994-01-01 00:00:00").cast("timestamp_ntz")
        return self.raw("customer").select(
            _customer_key("c_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("customer_segment"),
            (origin + _secs((F.col("c_custkey") % 365) * 86400)).alias("registration_date"),
        )

    @cached_property
    def merchants(self) -> DataFrame:
        supplier, nation = self.raw("supplier"), self.raw("nation")
        return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("M"), _text("s_suppkey")).alias("merchant_id"),
            F.col("s_name").alias("merchant_name"),
            F.concat(F.lit("CAT_"), _text(F.col("s_suppkey") % 7)).alias("merchant_category"),
            F.col("n_name").alias("merchant_country"),
            (F.col("s_acctbal") < 0).alias("is_high_risk"),
        )

    @cached_property
    def model_performance(self) -> DataFrame:
        positive, flagged = F.col("risk_label") == 1, F.col("base_score") > 0.5
        runs = (
            self.scored.groupBy(
                F.concat(F.lit("model_"), _text(F.col("k") % 4)).alias("model_name"),
                F.concat(F.lit("v"), _text(F.year("transaction_timestamp"))).alias("model_version"))
            .agg(
                F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p"), F.count_if(flagged).alias("pp"),
                F.count_if(positive & flagged).alias("tp"), F.count_if(positive == flagged).alias("tp_tn"),
                F.avg("base_score").alias("mean_score"), F.max("transaction_timestamp").alias("created_at"))
        )

        def share(factor: int) -> Column:
            return F.lpad(_text((F.col("n") * factor) % 1000), 3, "0")

        importance = F.concat(
            F.lit('{"amount":0.'), share(7), F.lit(',"hour":0.'), share(11),
            F.lit(',"customer_age":0.'), share(13), F.lit("}"))
        return runs.select(
            "model_name", "model_version",
            F.concat_ws(":", "model_name", "model_version").alias("model_id"),
            (F.col("tp_tn") / F.col("n")).alias("accuracy"),
            F.try_divide("tp", "pp").alias("precision_score"),
            F.try_divide("tp", "p").alias("recall_score"),
            F.try_divide(2 * F.col("tp"), F.col("pp") + F.col("p")).alias("f1_score"),
            (F.col("tp_tn") / F.col("n")).alias("auc_score"),
            (F.abs(F.col("mean_score") - 0.5) * 10).alias("drift_score"),
            F.col("n").alias("training_samples"), F.col("p").alias("validation_samples"),
            (F.col("n") % 600).cast("int").alias("training_duration_seconds"), "created_at",
            importance.alias("feature_importance"),
        )

    @cached_property
    def model_updates(self) -> DataFrame:
        return self.model_performance.filter("model_name = 'model_0'").select(
            F.col("model_id").alias("new_model_id"), F.col("created_at").alias("event_time"))

    @cached_property
    def system_metrics(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("metric_id"),
            F.when(kind == "click", "cpu_usage").when(kind == "view", "memory_usage")
            .when(kind == "error", "error_rate").otherwise(kind).alias("metric_name"),
            F.col("value").alias("metric_value"), F.col("ts").alias("metric_time"),
            F.concat(F.lit("svc_"), _text(F.col("user_id") % 5)).alias("service_name"),
        )

    @cached_property
    def transactions_dirty(self) -> DataFrame:
        t = self.transactions
        both = t.unionAll(t.filter(F.col("k") % 50 == 0))
        amount = (
            F.when(F.col("k") % 211 == 0, -F.col("amount"))
            .when(F.col("k") % 503 == 0, F.col("amount") * 200)
            .when(F.col("k") % 307 == 0, F.lit(None).cast("double"))
            .otherwise(F.col("amount")))
        return both.select("transaction_id", "customer_id", "merchant_id", amount.alias("amount"),
                           "location", "customer_age", "transaction_timestamp", "k")

    @cached_property
    def enriched_assessments(self) -> DataFrame:
        """Assessments with amount, location and event time of their transaction."""
        t = self.transactions.select("transaction_id", "amount", "location", "merchant_id", "customer_age",
                                     "payment_method", "transaction_timestamp")
        return self.risk_assessments.join(t, "transaction_id")
