"""Data quality as aggregates: every report is one pass, no job per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordered import long_form, quantile_row
from riskloom.operators.relational import numeric_columns

# Pass limits of the quality report and the whisker factor.
COMPLETENESS_LIMIT, UNIQUENESS_LIMIT = 0.95, 0.99
WHISKER = 1.5


def _counted_rows(df: DataFrame) -> DataFrame:
    """Digests of distinct rows with their multiplicity and null flags: what is shuffled does not grow with the columns."""
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return df.select(F.sha2(F.to_json(F.struct(*df.columns), exact), 256).alias("__row"), F.array(*[F.col(c).isNull() for c in df.columns]).alias("__nulls")) \
        .groupBy("__row").agg(F.count(F.lit(1)).alias("__copies"), F.first("__nulls").alias("__nulls"))


def _null_map(cols: Sequence[str]) -> Column:
    pairs = []
    for i, c in enumerate(cols):
        pairs += [F.lit(c), F.coalesce(F.sum(F.when(F.col("__nulls")[i], F.col("__copies"))), F.lit(0))]
    return F.create_map(*pairs)


def dq_profile(df: DataFrame) -> DataFrame:
    """Rows, nulls and types per column, duplicates, completeness, uniqueness, pass flag.

    Completeness counts nulls of all columns against rows, so it can fall below 0; the share of filled
    cells is given beside it.
    """
    cols = df.columns
    base = _counted_rows(df).agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("total_records"),
        F.count(F.lit(1)).alias("distinct_records"),
        _null_map(cols).alias("null_counts"))
    nulls = F.aggregate(F.map_values("null_counts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = F.col("total_records")
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return base.select(
        "total_records", "null_counts", types.alias("data_types"),
        (rows - F.col("distinct_records")).alias("duplicate_count"),
        F.try_divide(rows - nulls, rows).alias("completeness"),
        F.try_divide(F.col("distinct_records"), rows).alias("uniqueness"),
        (1 - F.try_divide(nulls, rows * len(cols))).alias("cell_completeness"),
    ).withColumn("passed", F.coalesce(
        (F.col("completeness") > COMPLETENESS_LIMIT) & (F.col("uniqueness") > UNIQUENESS_LIMIT), F.lit(False)))


def dq_profile_cells(df: DataFrame) -> DataFrame:
    """Missing share of all cells and per column, duplicate share; all in percent."""
    cols = df.columns
    base = _counted_rows(df).agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("__distinct"), _null_map(cols).alias("missing_by_column"))
    missing = F.aggregate(F.map_values("missing_by_column"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = F.col("total_rows")
    return base.select(
        "total_rows", F.lit(len(cols)).alias("total_columns"), missing.alias("missing_values"),
        F.try_divide(missing * 100.0, rows * len(cols)).alias("missing_percentage"), "missing_by_column",
        F.transform_values("missing_by_column", lambda _, n: F.try_divide(n * 100.0, rows)).alias(
            "missing_percentage_by_column"),
        (rows - F.col("__distinct")).alias("duplicate_rows"),
        F.try_divide((rows - F.col("__distinct")) * 100.0, rows).alias("duplicate_percentage"))


def _fences(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    quartiles = quantile_row(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = (F.col("q3") - F.col("q1")) * WHISKER
    return quartiles.withColumns({"low_fence": F.col("q1") - spread, "high_fence": F.col("q3") + spread})


def _fence_map(df: DataFrame, cols: Sequence[str]) -> Column:
    """column -> quartiles and fences, read as a scalar: one entry per checked column, computed once."""
    entries = F.map_from_entries(F.collect_list(F.struct("column", F.struct("q1", "median", "q3", "low_fence", "high_fence"))))
    return _fences(df, cols).agg(entries).scalar()


def dq_iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Values outside the quartile fences, summed over the numeric columns."""
    cols = list(cols) if cols else numeric_columns(df)
    fences = _fence_map(df, cols)
    outside = None
    for c in cols:
        fence = F.try_element_at("__fences", F.lit(c))
        v = F.col(c).cast("double")
        n = F.count_if((v < fence["low_fence"]) | (v > fence["high_fence"]))
        outside = n if outside is None else outside + n
    return df.withColumn("__fences", fences).agg(outside.alias("outliers_count"))


def dq_box_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: quartiles, whisker ends (extreme values inside the fences), number outside.

    Fences reach the values as a map with one entry per column, so the values are aggregated where they
    are read and only one row per column and task is shuffled.
    """
    cols = list(cols) if cols else numeric_columns(df)
    values = long_form(df, cols).filter(F.col("value").isNotNull()).withColumn("__fences", _fence_map(df, cols))
    v, fence = F.col("value"), F.try_element_at("__fences", F.col("column"))
    inside = (v >= fence["low_fence"]) & (v <= fence["high_fence"])
    whiskers = values.groupBy("column").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), *[F.first(fence[q]).alias(q) for q in ("q1", "median", "q3")])
    return whiskers.select("column", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")


def dq_assessments(df: DataFrame) -> DataFrame:
    score = F.col("risk_score")
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(score.isNull()).alias("null_risk_scores"),
        F.count_if(F.col("risk_level").isNull()).alias("null_risk_levels"),
        F.count_if(F.col("customer_id").isNull()).alias("null_customer_ids"),
        F.count_if(F.col("transaction_id").isNull()).alias("null_transaction_ids"),
        F.count_if((score < 0) | (score > 1)).alias("invalid_risk_scores"),
        F.min("assessment_timestamp").alias("earliest_timestamp"),
        F.max("assessment_timestamp").alias("latest_timestamp"),
    ).select(F.lit("risk_assessments").alias("table_name"), "*")


def dq_transactions(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("amount").isNull()).alias("null_amounts"),
        F.count_if(F.col("amount") <= 0).alias("invalid_amounts"),
        F.count_if(F.col("customer_id").isNull()).alias("null_customer_ids"),
        F.count_if(F.col("transaction_timestamp").isNull()).alias("null_timestamps"),
        F.min("transaction_timestamp").alias("earliest_timestamp"),
        F.max("transaction_timestamp").alias("latest_timestamp"),
    ).select(F.lit("transactions").alias("table_name"), "*")


def dq_pk(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Key values that occur more than once, or are null, with their number of rows."""
    keys = [key] if isinstance(key, str) else list(key)
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > 1) | any_null)


def dq_fk(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def dq_missing_pattern(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows per combination of missing columns; the pattern has a 1 for every missing column."""
    cols = list(cols) if cols else df.columns
    pattern = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def data_summary(df: DataFrame, head: int = 6) -> DataFrame:
    """One row: row and column counts, names, types and the first rows as JSON."""
    names, types = df.columns, [f.dataType.simpleString() for f in df.schema.fields]
    first = df.limit(head).agg(F.collect_list(F.to_json(F.struct(*names)))).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(names)).alias("columns"), F.array(*map(F.lit, names)).alias("column_names"),
        F.create_map(*[F.lit(x) for pair in zip(names, types) for x in pair]).alias("data_types"),
        first.alias("head"))
