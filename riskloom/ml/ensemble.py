"""Combining models: weighted and mean ensembles, weight search, importances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.ml import trees
from riskloom.ml.metrics import auc_of_counts, label_counts
from riskloom.operators.features import staged

# Default ensemble weights and the number of weight draws.
DEFAULT_WEIGHTS = (0.4, 0.3, 0.3)
WEIGHT_DRAWS = 100


def ensemble_weighted(df: DataFrame, weights: Mapping[str, float], normalize: bool = True) -> DataFrame:
    """Weighted mean of probability columns, its class at 0.5 and both class probabilities."""
    total = sum(weights.values()) if normalize else 1.0
    p = None
    for c, w in weights.items():
        term = F.lit(float(w)) * F.col(c)
        p = term if p is None else p + term
    p = p / F.lit(float(total))
    return df.withColumns({"ensemble_probability": p}).withColumns({
        "ensemble_prediction": (F.col("ensemble_probability") > 0.5).cast("int"),
        "ensemble_probabilities": F.array(1 - F.col("ensemble_probability"), F.col("ensemble_probability"))})


def ensemble_mean(df: DataFrame, cols: Sequence[str], out: str = "ensemble") -> DataFrame:
    return df.withColumn(out, sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / F.lit(float(len(cols))))


def weight_draws(n_models: int, n: int = WEIGHT_DRAWS, seed: int = 42) -> np.ndarray:
    raw = np.random.default_rng(seed).uniform(0, 1, size=(n, n_models))
    return raw / raw.sum(axis=1, keepdims=True)


def _merged(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """(``cols``, __pos, __neg): rows with equal scores of all members as one, before they are multiplied by the draws.

    Counts are combined before the shuffle. What is left is dealt evenly, as each of its rows makes one a draw.
    """
    y = F.col(label)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.filter(y.isNotNull()).groupBy(*[F.col(c).cast("double").alias(c) for c in cols]).agg(
        F.count_if(y == 1).alias("__pos"), F.count_if(y != 1).alias("__neg")).repartition(parts)


def _drawn_scores(merged: DataFrame, cols: Sequence[str], draws: Mapping[int, np.ndarray]) -> DataFrame:
    """(__pos, __neg, draw, score): every merged row under every draw that gives it a number."""
    scores = F.array(*[
        F.struct(F.lit(i).alias("draw"), sum((F.lit(float(w)) * F.col(c) for c, w in zip(cols[1:], row[1:])), F.lit(float(row[0])) * F.col(cols[0])).alias("score"))
        for i, row in draws.items()])
    return merged.select("__pos", "__neg", F.inline(scores)).filter(F.col("score").isNotNull() & ~F.isnan("score"))


def _exact_search(merged: DataFrame, cols: Sequence[str], draws: Mapping[int, np.ndarray]) -> DataFrame:
    counts = _drawn_scores(merged, cols, draws).groupBy("draw", F.col("score").alias("threshold")).agg(
        F.sum("__pos").alias("pos"), F.sum("__neg").alias("neg"))
    table = F.create_map(*[x for i, row in draws.items() for x in (F.lit(i), F.array(*[F.lit(float(w)) for w in row]))])
    return auc_of_counts(counts, ["draw"]).select(
        "draw", F.element_at(table, F.col("draw")).alias("weights"), "auc").orderBy(F.desc("auc"), "draw")


def optimize_weights(df: DataFrame, label: str, cols: Sequence[str], n: int = WEIGHT_DRAWS, seed: int = 42) -> DataFrame:
    """Exact AUC of ``n`` random weightings: (draw, weights, auc), best first. Give it held-out predictions.

    A row that a member gives no score, or no number, counts under no draw. Rows with equal member scores are merged first; merged
    rows times draws are grouped by score; where only the best draw is asked for, ``search_weights`` groups far fewer.
    """
    return _exact_search(_merged(df, label, cols), cols, dict(enumerate(weight_draws(len(cols), n, seed))))


def weight_bounds(df: DataFrame, label: str, cols: Sequence[str], draws: Mapping[int, np.ndarray], bins: int = 2048) -> DataFrame:
    """(draw, low, high): an AUC between the two for each draw, from counts by equal bins of the score.

    Pairs of different bins are ordered for certain, those of one bin either way. Counts are combined before the shuffle, so a
    task sends at most draws times bins rows, however many it reads.
    """
    return _bounds(_merged(df, label, cols), cols, draws, bins)


def _bounds(merged: DataFrame, cols: Sequence[str], draws: Mapping[int, np.ndarray], bins: int) -> DataFrame:
    low, high = merged.select(*[F.nanvl(c, F.lit(None)).alias(c) for c in cols]).agg(
        F.min(F.least(*cols)), F.max(F.greatest(*cols))).first()
    low, high = (F.lit(x).cast("double") for x in (low, high))
    place = F.try_divide(F.col("score") - low, high - low) * bins
    place = F.when(F.isnan(place), 0.0).otherwise(F.coalesce(place, F.lit(0.0)))
    counts = _drawn_scores(merged, cols, draws).groupBy(
        "draw", F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(bins - 1.0))).alias("bin")).agg(
        F.sum("__pos").alias("pos"), F.sum("__neg").alias("neg"))
    before = Window.partitionBy("draw").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.col("pos") * F.coalesce("neg_before", F.lit(0)).cast("double")
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return counts.withColumn("neg_before", F.sum("neg").over(before)).groupBy("draw").agg(
        F.try_divide(F.sum(sure), pairs).alias("low"), F.try_divide(F.sum(sure + F.col("pos") * F.col("neg").cast("double")), pairs).alias("high"))


def search_weights(df: DataFrame, label: str, cols: Sequence[str], n: int = WEIGHT_DRAWS, seed: int = 42, bins: int = 2048) -> DataFrame:
    """The draws of ``optimize_weights`` that may be the best, with their exact AUC, best first; the first row is the same.

    Rows with equal member scores are merged and written first. A first pass over them bounds the AUC of every draw (``weight_bounds``); a draw whose upper bound lies below another's lower bound goes. Only
    the others are scored and grouped exactly. The bounds, one row a draw, are read here; without rows of both classes no draw goes.
    """
    draws = dict(enumerate(weight_draws(len(cols), n, seed)))
    merged = staged(_merged(df, label, cols))
    bounds = [r for r in _bounds(merged, cols, draws, bins).collect() if r["low"] is not None]
    floor = max((r["low"] for r in bounds), default=0.0) - 1e-9  # sums of doubles
    gone = {r["draw"] for r in bounds if r["high"] < floor}
    return _exact_search(merged, cols, {i: row for i, row in draws.items() if i not in gone})


def best_weights(search: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = search.first()
    return dict(zip(cols, row["weights"]))


def model_importances(models: Mapping[str, PipelineModel], features: Sequence[str], spark) -> DataFrame:
    """(model, feature, importance) of the models that report importances."""
    rows = []
    for name, model in models.items():
        stage = model.stages[-1]
        if hasattr(stage, "featureImportances"):
            rows += [(name, f, float(v)) for f, v in zip(features, stage.featureImportances.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def feature_importance(importances: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Importance per feature, summed over models by weight; unlisted models have weight 0."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("model") == name, F.lit(float(w))).otherwise(weight)
    return importances.groupBy("feature").agg(F.sum(F.col("importance") * weight).alias("importance"))


def permutation_importance(model: PipelineModel, df: DataFrame, label: str, features: Sequence[str], id_col: str,
                           seed: int = 42, rows_per_bucket: int = 100_000) -> DataFrame:
    """Drop in AUC when one feature is shuffled: (feature, auc, importance).

    A row takes the value of the next row in hash order inside its hash bucket (the last one takes the
    first), so the shuffle is exact and repeatable; the number of buckets grows with the rows. All variants are
    scored once, and counted by score.
    """
    features = list(features)
    buckets = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows_per_bucket))).scalar()
    bucket = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), buckets)
    w = Window.partitionBy("__bucket").orderBy("__order", id_col)
    base = df.select(id_col, label, *features).withColumns({
        "__bucket": bucket, "__order": F.xxhash64(F.col(id_col), F.lit(seed + 1))})
    first = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = base.withColumns({
        f"__next_{i}": F.coalesce(F.lead(F.struct(f)).over(w), F.first(F.struct(f)).over(first))[f]
        for i, f in enumerate(features)})

    def variant(shuffled: int | None):
        name = "" if shuffled is None else features[shuffled]
        return F.struct(F.lit(name).alias("variant"), *[
            (F.col(f"__next_{i}") if i == shuffled else F.col(f)).alias(f) for i, f in enumerate(features)])

    variants = mixed.select(label, F.inline(F.array(variant(None), *[variant(i) for i in range(len(features))])))
    scored = trees.with_probability(model, variants, "__p")
    counts = staged(label_counts(scored.select("variant", label, "__p"), label, "__p", ["variant"]))  # read several times below
    aucs = auc_of_counts(counts, ["variant"])
    intact = F.max(F.when(F.col("variant") == "", F.col("auc"))).over(Window.partitionBy())
    return aucs.withColumn("__base", intact).filter("variant <> ''").select(
        F.col("variant").alias("feature"), "auc", (F.col("__base") - F.col("auc")).alias("importance"))
