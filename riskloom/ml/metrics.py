"""Model metrics as DataFrame aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.ordered import exact_quantiles, running_totals, fine_chunk

# Fixed value: accuracy below this asks for retraining.
ACCURACY_FLOOR = 0.85


def label_counts(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    known = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    return known.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def auc_exact(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; equal scores count one half. Null when a class is missing.

    Rows without label or score, or with NaN as score, do not count.
    """
    return auc_of_counts(label_counts(df, label, score, by), by)


def auc_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``auc_exact`` of rows already counted: ``by``, threshold, pos and neg, one row for each threshold of a group."""
    by = list(by)
    ranked = running_totals(counts, by, "threshold", fine_chunk("threshold"),
                            {"pos": ("pos_before", "positives"), "neg": ("neg_before", "negatives")})
    wins = F.col("pos") * (F.col("neg_before").cast("double") + F.col("neg") / 2.0)
    return ranked.groupBy(*by).agg(
        F.sum(wins).alias("__wins"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
    ).select(*by, F.try_divide("__wins", F.col("positives").cast("double") * F.col("negatives")).alias("auc"),
             "positives", "negatives")


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall when every score at or above the threshold is called positive; rows as in ``auc_exact``."""
    ranked = running_totals(label_counts(df, label, score, []), [], "threshold", fine_chunk("threshold"),
                            {"pos": ("pos_before", "positives"), "neg": ("neg_before", "negatives")})
    tp = F.col("positives") - F.col("pos_before")
    fp = F.col("negatives") - F.col("neg_before")
    return ranked.select("threshold", tp.alias("tp"), fp.alias("fp"),
                         F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, F.col("positives")).alias("recall"))


def classification_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *by, "n", "tp", "fp", "tn", "fn",
        F.try_divide(tp + tn, F.col("n")).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"))


def regression_metrics(df: DataFrame, actual: str, predicted: Sequence[str]) -> DataFrame:
    """RMSE, MAE and squared correlation per prediction column, from one pass."""
    y = F.col(actual).cast("double")
    pairs = [F.struct(F.lit(m).alias("model"), y.alias("y"), F.col(m).cast("double").alias("p")) for m in predicted]
    error = F.col("y") - F.col("p")
    return df.select(F.inline(F.array(*pairs))).groupBy("model").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.pow(F.corr("y", "p"), F.lit(2.0)).alias("r_squared"))


def model_health(performance: DataFrame, floor: float = ACCURACY_FLOOR) -> DataFrame:
    """Newest run of every model with a retrain flag."""
    newest = F.max_by(F.struct("model_version", "accuracy", "created_at"), F.struct("created_at", "model_version"))
    return performance.groupBy("model_name").agg(newest.alias("run")).select(
        "model_name", "run.*", F.coalesce(F.col("run.accuracy") < floor, F.lit(True)).alias("needs_retraining"))


def drift_psi(base: DataFrame, current: DataFrame, col: str, bins: int = 10, smallest: float = 1e-6) -> DataFrame:
    """Population stability index against the quantile bins of ``base``, with the two shares per bin.

    Shares are floored at ``smallest`` so that an empty bin stays finite.
    """
    cuts = exact_quantiles(base, [], col, [i / bins for i in range(1, bins)])
    edges = cuts.agg(F.array_sort(F.collect_list("quantile"))).scalar()
    v = F.col(col).cast("double")

    def shares(df: DataFrame, name: str) -> DataFrame:
        index = sum((F.when(v > F.get("__edges", F.lit(i)), 1).otherwise(0) for i in range(bins - 1)), F.lit(0))
        counts = df.filter(v.isNotNull()).withColumn("__edges", edges).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias(f"{name}_n"))
        return counts

    every = base.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    table = every.join(shares(base, "base"), "bin", "left").join(shares(current, "current"), "bin", "left").na.fill(0)
    every_bin = Window.partitionBy()
    a = F.greatest(F.try_divide("base_n", F.sum("base_n").over(every_bin)), F.lit(smallest))
    b = F.greatest(F.try_divide("current_n", F.sum("current_n").over(every_bin)), F.lit(smallest))
    return table.select("bin", a.alias("base_share"), b.alias("current_share"),
                        ((b - a) * F.ln(b / a)).alias("psi"))


def drift_score(base: DataFrame, current: DataFrame, col: str, bins: int = 10) -> DataFrame:
    return drift_psi(base, current, col, bins).agg(F.sum("psi").alias("drift_score"))


def register_model_run(metrics: DataFrame, model_name: str, model_version: str, created_at, training_samples: int | None = None,
                       auc: Column | None = None, drift: Column | None = None, importance: Column | None = None) -> DataFrame:
    """One row per evaluated model in the columns of the model performance table.

    ``auc`` and ``drift`` are numbers (literals or scalar subqueries), ``importance`` a map of feature to importance.
    """
    from riskloom.schemas import conform

    none = F.lit(None)
    return conform(metrics.withColumns({
        "model_name": F.lit(model_name), "model_version": F.lit(model_version),
        "model_id": F.lit(f"{model_name}:{model_version}"),
        "validation_samples": F.col("n"), "training_samples": F.lit(training_samples).cast("int"),
        "precision_score": F.col("precision"), "recall_score": F.col("recall"),
        "auc_score": none if auc is None else auc, "drift_score": none if drift is None else drift,
        "feature_importance": none if importance is None else F.to_json(importance),
        "confusion_matrix": F.to_json(F.struct("confusion_matrix")), "created_at": F.lit(str(created_at)),
    }), "model_performance", created_at)


def append_model_run(run: DataFrame, path: str) -> None:
    """Append a run to the model performance table at ``path``."""
    run.write.mode("append").parquet(path)


def ab_assign(df: DataFrame, id_col: str, n: int = 2, seed: int = 42) -> DataFrame:
    """Adds ``variant`` 0..n-1, fixed by the id: eight hex digits of its MD5, modulo ``n``."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8)
    return df.withColumn("variant", F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(n)).cast("int"))
