"""The batch run: ingest, quality, clean, features, score, validate, save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.columns import amount_transforms, is_night, is_weekend
from riskloom.functions.scoring import Inputs, naive_risk_score
from riskloom.operators.features import Stage, engineer_features, lazily, staged
from riskloom.operators.quality import dq_profile
from riskloom.operators.relational import cast_types, drop_duplicates, fill_defaults, validate_rules, zscore_filter
from riskloom.sources.readers import read_table
from riskloom.sources.writers import write_overwrite


def clean(df: DataFrame, ts: str = "transaction_timestamp", stage: Stage = lazily) -> DataFrame:
    """Distinct rows with defaults, types and transforms, without the outliers of ``amount``.

    ``stage`` is applied before the outlier filter, whose mean and deviation then need one column of a
    written table instead of a second removal of duplicates.
    """
    filled = cast_types(fill_defaults(drop_duplicates(df)))
    amounts = amount_transforms("amount")
    shaped = filled.withColumns({
        "amount_log": amounts["amount_log"], "amount_sqrt": amounts["amount_sqrt"],
        "is_weekend": is_weekend(ts).cast("int"), "is_night": is_night(ts).cast("int")})
    return zscore_filter(stage(shaped), "amount")


def process(df: DataFrame, ts: str = "transaction_timestamp", stage: Stage = lazily,
            stage_features: Stage = lazily) -> DataFrame:
    """Validated, scored feature rows. Scoring precedes validation, which checks the score.

    The cleaned rows feed the customer totals, the location totals and the output, so staging them spares
    cleaning three times; staging the totals lets Spark plan their joins by exact size.
    """
    features = engineer_features(clean(df, ts, stage), ts, stage=stage_features)
    return validate_rules(naive_risk_score(features, Inputs(ts=ts)))


def run(spark: SparkSession, source: str, target: str, ts: str = "transaction_timestamp", format: str = "parquet") -> DataFrame:
    """Process a table into ``target``; returns the quality report of the input."""
    raw = read_table(spark, source, format)
    write_overwrite(process(raw, ts, staged, staged), target)
    return dq_profile(raw)
