"""Filters, cleaning, roll-ups, ranks and top-k.

Reference points in time are columns: a literal keeps static partition pruning, and the default
(newest value present) is a scalar subquery, so no operator runs a job while the plan is built.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskloom.functions.columns import distinct_count, percent

# Defaults for missing inputs and the accepted ranges.
DEFAULTS = {"amount": 0.0, "customer_age": 30, "transaction_count": 0}
CASTS = {"amount": "double", "customer_age": "int", "transaction_count": "int"}
VALIDATION_RULES = {
    "amount_positive": "amount > 0",
    "age_in_range": "customer_age >= 18 AND customer_age <= 100",
    "amount_within_limit": "amount <= 1000000",
    "score_in_range": "risk_score >= 0 AND risk_score <= 1",
}


def instant(value: dt.datetime | str | Column | None, df: DataFrame, col: str) -> Column:
    """A point in time as a column; ``None`` means the newest ``col`` in ``df``."""
    if value is None:
        return df.agg(F.max(col)).scalar()
    if isinstance(value, Column):
        return value
    kind = "timestamp_ntz" if isinstance(df.schema[col].dataType, T.TimestampNTZType) else "timestamp"
    return F.lit(str(value)).cast(kind)


def seconds(n: float) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, F.lit(n).cast("decimal(18,6)"))


# -- filters and cleaning ---------------------------------------------------------------------

def fill_defaults(df: DataFrame, defaults: Mapping[str, object] = DEFAULTS) -> DataFrame:
    return df.na.fill({c: v for c, v in defaults.items() if c in df.columns})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fill_zero_numeric(df: DataFrame) -> DataFrame:
    return df.na.fill(0, subset=numeric_columns(df))


def cast_types(df: DataFrame, types: Mapping[str, str] = CASTS, count_failures: bool = False) -> DataFrame:
    """Cast present columns; text that does not parse becomes null (and is flagged on request)."""
    present = {c: t for c, t in types.items() if c in df.columns}
    casts = {c: F.col(c).try_cast(t) for c, t in present.items()}
    if count_failures:
        failed = [F.when(F.col(c).isNotNull() & casts[c].isNull(), F.lit(c)) for c in present]
        df = df.withColumn("cast_failures", F.array_compact(F.array(*failed)))
    return df.withColumns(casts)


def drop_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def zscore_filter(df: DataFrame, col: str, limit: float = 3.0, two_sided: bool = False) -> DataFrame:
    """Keep rows whose z-score is below ``limit``; unknown scores are dropped.

    Mean and deviation come from one aggregate read as a scalar subquery, never from a window over
    all rows.
    """
    stats = df.agg(F.struct(F.avg(col).alias("mean"), F.stddev(col).alias("sd"))).scalar()
    z = F.try_divide(F.col(col) - F.col("__stats.mean"), F.col("__stats.sd"))
    out = df.withColumn("__stats", stats).withColumn(f"{col}_zscore", z).drop("__stats")
    score = F.abs(F.col(f"{col}_zscore")) if two_sided else F.col(f"{col}_zscore")
    return out.filter(score < limit)


def validate_rules(df: DataFrame, rules: Mapping[str, str] = VALIDATION_RULES, quarantine: bool = False) -> DataFrame:
    """Rows passing every rule; with ``quarantine`` the failing rows and the rules they break.

    A rule that cannot be decided because of a null counts as broken.
    """
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    if quarantine:
        return df.withColumn("violations", broken).filter(F.size("violations") > 0)
    out = df
    for rule in rules.values():
        out = out.filter(F.expr(rule))
    return out


def request_required(df: DataFrame, cols: Sequence[str] = ("transaction_id", "customer_id", "amount"),
                     zero_is_missing: bool = True) -> DataFrame:
    """Adds ``rejected_because``: the first required field that is absent, empty or zero; null if complete."""
    reason = F.lit(None).cast("string")
    for c in reversed(list(cols)):
        missing = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, T.StringType):
            missing = missing | (F.col(c) == "")
        elif zero_is_missing and isinstance(df.schema[c].dataType, T.NumericType):
            missing = missing | (F.col(c) == 0)
        reason = F.when(missing, F.lit(c)).otherwise(reason)
    return df.withColumn("rejected_because", reason)


def default_timestamp(df: DataFrame, col: str, as_of) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), instant(as_of, df, col)))


def lookback_filter(df: DataFrame, col: str, days: float, as_of=None) -> DataFrame:
    return df.filter(F.col(col) >= instant(as_of, df, col) - seconds(days * 86400))


def time_range_filter(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Both ends included; defaults are the newest instant and 24 hours before it."""
    upper = instant(end, df, col)
    lower = upper - seconds(86400) if start is None else instant(start, df, col)
    return df.filter(F.col(col).between(lower, upper))


def dashboard_filter(df: DataFrame, level: str = "ALL", hours: float = 1, amount_range=(0, 100000), as_of=None,
                     ts: str = "assessment_timestamp") -> DataFrame:
    upper = instant(as_of, df, ts)
    out = df.filter((F.col(ts) >= upper - seconds(hours * 3600)) & (F.col(ts) <= upper))
    out = out.filter(F.col("amount").between(*amount_range))
    return out if level == "ALL" else out.filter(F.col("risk_level") == level)


# -- roll-ups ---------------------------------------------------------------------------------

def customer_features(df: DataFrame, approx: bool = False) -> DataFrame:
    return df.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.max("amount").alias("max_amount"),
        F.min("amount").alias("min_amount"),
        F.stddev("amount").alias("amount_std"),
        distinct_count("merchant_id", approx).alias("unique_merchants"),
        distinct_count("location", approx).alias("unique_locations"),
    )


def location_features(df: DataFrame) -> DataFrame:
    return df.groupBy("location").agg(
        F.count(F.lit(1)).alias("location_transaction_count"),
        F.avg("amount").alias("location_avg_amount"),
    )


def risk_statistics(df: DataFrame, start=None, end=None, ts: str = "assessment_timestamp") -> DataFrame:
    level = F.col("risk_level")
    return time_range_filter(df, ts, start, end).agg(
        F.count(F.lit(1)).alias("total_assessments"),
        F.count_if(level == "HIGH").alias("high_risk_count"),
        F.count_if(level == "MEDIUM").alias("medium_risk_count"),
        F.count_if(level == "LOW").alias("low_risk_count"),
        F.avg("risk_score").alias("average_risk_score"),
        F.avg("processing_time_ms").alias("average_processing_time_ms"),
    )


def service_rates(log: DataFrame, ts: str = "request_time", status: str = "status", cached: str = "cache_hit",
                  by: Sequence[str] = ()) -> DataFrame:
    """Request totals and rates over a log with a status ('OK' or other) and a cache-hit flag."""
    ok, n = F.count_if(F.col(status) == "OK"), F.count(F.lit(1))
    hits = F.count_if(F.col(cached))
    span = F.extract(F.lit("DAY"), F.max(ts) - F.min(ts)) * 86400.0 \
        + F.extract(F.lit("HOUR"), F.max(ts) - F.min(ts)) * 3600.0 \
        + F.extract(F.lit("MINUTE"), F.max(ts) - F.min(ts)) * 60.0 \
        + F.extract(F.lit("SECOND"), F.max(ts) - F.min(ts)).cast("double")
    return log.groupBy(*by).agg(
        n.alias("total_requests"), ok.alias("successful_requests"), (n - ok).alias("failed_requests"),
        percent(ok, n, 4).alias("success_rate"), percent(n - ok, n, 4).alias("error_rate"),
        percent(hits, n, 4).alias("cache_hit_rate"),
        F.round(F.try_divide(n, span), 6).alias("requests_per_second"),
    )


# -- windows and top-k ------------------------------------------------------------------------

def win_lag(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in cols})


def win_row_number_topn(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int,
                        rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Each map task keeps only its own first ``n`` before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def win_total_share(df: DataFrame, col: str, out: str = "share", digits: int = 2) -> DataFrame:
    """Percentage of the column total, for a frame already aggregated to a handful of groups.

    The window spans all rows, so it is meant for bounded group sets such as the five score buckets.
    """
    return df.withColumn(out, percent(F.col(col), F.sum(col).over(Window.partitionBy()), digits))


def history_by_customer(df: DataFrame, n: int, customer: str | None = None, ts: str = "assessment_timestamp",
                        tie: str = "assessment_id") -> DataFrame:
    """Newest ``n`` rows of one customer, or of every customer."""
    if customer is not None:
        return df.filter(F.col("customer_id") == customer).orderBy(F.desc(ts), F.asc(tie)).limit(n)
    return win_row_number_topn(df, ["customer_id"], [F.desc(ts), F.asc(tie)], n, "recency")


def latest_n(df: DataFrame, ts: str, n: int = 100, tie: str = "assessment_id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(ts), F.asc(tie)).limit(n)


def top_locations(df: DataFrame, n: int = 50, score: str = "avg_risk_score", count: str = "transaction_count",
                  tie: Sequence[str] = ("location",)) -> DataFrame:
    return df.orderBy(F.desc_nulls_first(score), F.desc_nulls_first(count), *tie).limit(n)


def topk_importance(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("importance"), F.asc("feature")).limit(n)


def sort_multi(df: DataFrame, *cols: Column | str) -> DataFrame:
    return df.orderBy(*cols)


def sort_by_time(df: DataFrame, ts: str, *ties: str) -> DataFrame:
    return df.orderBy(ts, *ties)
