"""Group fairness measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bias_baseline(df: DataFrame, label: str) -> DataFrame:
    rate = F.avg(F.col(label).cast("double"))
    return df.agg(rate.alias("overall_positive_rate"), (1 - rate).alias("overall_negative_rate"))


def bias_groups(df: DataFrame, label: str, pred: str, attributes: Sequence[str]) -> DataFrame:
    """Rates per protected attribute and value; a rate without rows is 0. Unknown attributes are skipped.

    All attributes share one aggregate over (attribute, value).
    """
    present = [a for a in attributes if a in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "attribute string, value string, n bigint, positive_rate double, "
                                                   "prediction_rate double, true_positive_rate double, false_positive_rate double")
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in present])
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    flat = df.select(y.alias("y"), p.alias("p"), F.inline(pairs))
    return flat.groupBy("attribute", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("positive_rate"), F.avg("p").alias("prediction_rate"),
        F.coalesce(F.avg(F.when(F.col("y") == 1, F.col("p"))), F.lit(0.0)).alias("true_positive_rate"),
        F.coalesce(F.avg(F.when(F.col("y") == 0, F.col("p"))), F.lit(0.0)).alias("false_positive_rate"))
