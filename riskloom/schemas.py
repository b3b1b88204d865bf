"""Schemas and column defaults of the warehouse tables and of the event feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TXN = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("location", T.StringType(), True),
    T.StructField("merchant_id", T.StringType(), True),
    T.StructField("customer_age", T.IntegerType(), True),
])
RISK_EVENT = "transaction_id string, risk_score double, risk_level string, timestamp timestamp"
EXPLANATION = (
    "feature_importance map<string,double>, shap_values map<string,double>, "
    "lime_explanation array<struct<feature:string,score:double>>, decision_path array<string>")

# Table columns and defaults.
TABLES = {
    "customers": (
        "customer_id string, first_name string, last_name string, email string, phone string, date_of_birth date, "
        "address_line1 string, address_line2 string, city string, state string, country string, postal_code string, "
        "customer_segment string, registration_date timestamp_ntz, last_login timestamp_ntz, is_active boolean, "
        "risk_profile string, created_at timestamp_ntz, updated_at timestamp_ntz"),
    "transactions": (
        "transaction_id string, customer_id string, merchant_id string, amount decimal(15,2), currency string, "
        "transaction_type string, payment_method string, device_fingerprint string, ip_address string, "
        "location_country string, location_region string, location_city string, latitude decimal(10,8), "
        "longitude decimal(11,8), transaction_timestamp timestamp_ntz, processing_timestamp timestamp_ntz, "
        "status string, created_at timestamp_ntz"),
    "risk_assessments": (
        "assessment_id string, transaction_id string, customer_id string, risk_score decimal(5,4), "
        "risk_level string, confidence_score decimal(5,4), recommended_action string, processing_time_ms int, "
        "model_version string, features string, explanation string, business_rules_applied array<string>, "
        "assessment_timestamp timestamp_ntz, created_at timestamp_ntz"),
    "merchants": (
        "merchant_id string, merchant_name string, merchant_category string, merchant_country string, "
        "merchant_region string, risk_score decimal(5,4), is_high_risk boolean, created_at timestamp_ntz, "
        "updated_at timestamp_ntz"),
    "model_performance": (
        "model_id string, model_name string, model_version string, accuracy decimal(5,4), "
        "precision_score decimal(5,4), recall_score decimal(5,4), f1_score decimal(5,4), auc_score decimal(5,4), "
        "confusion_matrix string, feature_importance string, drift_score decimal(5,4), training_samples int, "
        "validation_samples int, training_duration_seconds int, created_at timestamp_ntz"),
    "system_metrics": (
        "metric_id bigint, metric_name string, metric_value decimal(15,4), metric_unit string, "
        "metric_time timestamp_ntz, service_name string, environment string"),
}
DEFAULTS = {
    "customers": {"is_active": True, "risk_profile": "MEDIUM"},
    "transactions": {"currency": "USD", "status": "PENDING"},
    "merchants": {"is_high_risk": False},
}
NOW_DEFAULTS = {
    "customers": ("created_at", "updated_at"),
    "transactions": ("created_at",),
    "risk_assessments": ("assessment_timestamp", "created_at"),
    "merchants": ("created_at", "updated_at"),
    "model_performance": ("created_at",),
    "system_metrics": ("metric_time",),
}
# End of fixed values.


def struct_of(ddl: str) -> T.StructType:
    """Schema of a column list; parsed by the running session."""
    return T.StructType.fromDDL(ddl)


def create_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The warehouse tables, empty, by name."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def conform(df: DataFrame, table: str, as_of) -> DataFrame:
    """``df`` in the columns and types of a table: absent columns are null, then defaults apply."""
    defaults, now = DEFAULTS.get(table, {}), NOW_DEFAULTS[table]
    out = []
    for f in struct_of(TABLES[table]).fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        elif f.name in now:
            c = F.coalesce(c, as_of.cast(f.dataType) if hasattr(as_of, "cast") else F.lit(str(as_of)).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)
