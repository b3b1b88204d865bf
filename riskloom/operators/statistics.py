"""The tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.columns import cut_levels
from riskloom.operators.ordered import exact_quantiles
from riskloom.operators.relational import numeric_columns


def _bin_counts(df: DataFrame, col: str, bins: int) -> tuple[DataFrame, Column]:
    """(bin, n) for equal bins over [min, max], last bin closed, and the range as a scalar struct."""
    v = F.col(col).cast("double")
    known = df.filter(v.isNotNull() & ~F.isnan(v))
    stats = known.agg(F.struct(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev(v).alias("sd"),
        F.count(F.lit(1)).alias("total"))).scalar()
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    index = F.least(F.coalesce(F.floor(F.try_divide(v - F.col("s.lo"), width)), F.lit(0)), F.lit(bins - 1))
    counts = known.withColumn("s", stats).groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts, stats


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Count and density of every bin, empty ones included, with the mean and the median."""
    counts, stats = _bin_counts(df, col, bins)
    median = exact_quantiles(df, [], col, [0.5]).agg(F.max("quantile")).scalar()
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    low, high, n = F.col("s.lo"), F.col("s.hi"), F.coalesce("n", F.lit(0)).cast("bigint")
    width = (high - low) / bins
    return every.join(counts, "bin", "left").withColumns({"s": stats, "median": median}).select(
        "bin", (low + F.col("bin") * width).alias("lower"), (low + (F.col("bin") + 1) * width).alias("upper"),
        n.alias("n"), F.try_divide(n, F.col("s.total") * width).alias("density"), F.col("s.mean").alias("mean"), "median")


def density_curve(df: DataFrame, col: str, grid: int = 512, bins: int = 1000) -> DataFrame:
    """Gaussian kernel density on an even grid over the data range widened by three bandwidths.

    Rows are binned first, so the kernel sum runs over at most ``bins`` x ``grid`` pairs however many
    rows there are. The bandwidth is the usual 0.9 * min(sd, IQR / 1.34) * n^(-1/5).
    """
    counts, stats = _bin_counts(df, col, bins)
    iqr = exact_quantiles(df, [], col, [0.25, 0.75]).agg(F.max("quantile") - F.min("quantile")).scalar()
    low, high, h = F.col("s.lo"), F.col("s.hi"), F.col("h")
    spread = F.least(F.col("s.sd"), F.nullif(F.col("iqr") / 1.34, F.lit(0.0)))
    frame = counts.withColumns({"s": stats, "iqr": iqr}).withColumn(
        "h", 0.9 * spread * F.pow(F.col("s.total").cast("double"), F.lit(-0.2)))
    centre = low + (F.col("bin") + 0.5) * (high - low) / bins
    step = (high - low + 6 * h) / (grid - 1)
    points = frame.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))) \
        .withColumns({"x": low - 3 * h + F.col("i") * step, "centre": centre})
    u = (F.col("x") - F.col("centre")) / h
    kernel = F.exp(-0.5 * u * u) / F.sqrt(2 * F.pi())
    return points.groupBy("i").agg(
        F.max("x").alias("x"), F.sum(F.col("n") * kernel / (F.col("s.total") * h)).alias("density"))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlations in long form over rows complete in all columns, from one aggregate."""
    cols = list(cols) if cols else numeric_columns(df)
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    pairs = list(combinations(cols, 2))
    row = complete.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])

    def entry(a: str, b: str, value):
        return F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), value.alias("value"))

    entries = [entry(c, c, F.lit(1.0)) for c in cols]
    for i, (a, b) in enumerate(pairs):
        entries += [entry(a, b, F.col(f"c{i}")), entry(b, a, F.col(f"c{i}"))]
    return row.select(F.inline(F.array(*entries)))


def time_series(df: DataFrame, ts: str, col: str, every: str = "day", smooth: int = 7) -> DataFrame:
    """Mean per period in time order, with a centred moving average over ``smooth`` periods.

    The moving average runs over one row per calendar period.
    """
    periods = df.groupBy(F.date_trunc(every, ts).cast("timestamp_ntz").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(col).alias("value"))
    half = smooth // 2
    w = Window.partitionBy().orderBy("period").rowsBetween(-half, half)
    return periods.withColumn("smoothed", F.avg("value").over(w)).orderBy("period")


def level_distribution(df: DataFrame, score: str = "risk_score") -> DataFrame:
    return df.groupBy(cut_levels(score).alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


def linear_trend(df: DataFrame, x: str = "amount", y: str = "risk_score", log_x: bool = True) -> DataFrame:
    """Least-squares line of ``y`` on log10(``x``) (or plain ``x``)."""
    v = F.when(F.col(x) > 0, F.log10(F.col(x))) if log_x else F.col(x).cast("double")
    pairs = df.select(v.alias("x"), F.col(y).cast("double").alias("y"))
    return pairs.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                     F.regr_count("y", "x").alias("n"))


def score_summary(df: DataFrame, col: str) -> DataFrame:
    v = F.col(col).cast("double")
    quartiles = exact_quantiles(df, [], col, [0.25, 0.5, 0.75]).agg(
        F.map_from_entries(F.collect_list(F.struct("q", "quantile")))).scalar()
    return df.agg(
        F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"),
        F.stddev(v).alias("sd"), F.variance(v).alias("variance"),
    ).withColumn("__q", quartiles).select("*", *[F.try_element_at("__q", F.lit(q)).alias(name) for name, q in
                   (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]).drop("__q")


def model_comparison(metrics: DataFrame) -> DataFrame:
    return metrics.select("model", "rmse", "r_squared").orderBy("rmse", "model")


def prediction_vs_actual(predictions: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return predictions.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
