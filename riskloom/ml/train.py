"""Model training with Spark ML. Inputs are plain numeric columns; every model is a PipelineModel."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassificationModel,
    RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import (
    FMRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scoring import risk_level
from riskloom.ml import cells, search, trees
from riskloom.operators.features import staged
from riskloom.session import scratch_path

# Model inputs and the tuning grid.
TRAIN_FEATURES = ["amount", "customer_age", "transaction_count", "total_transactions", "avg_amount", "amount_ratio"]
TUNE_FEATURES = ["amount", "customer_age", "transaction_count"]
TUNE_GRID = {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15], "maxBins": [32, 64, 128]}
RANDOM_RANGES = {"maxIter": (100, 1000), "maxDepth": (3, 10), "stepSize": (0.01, 0.3), "subsamplingRate": (0.6, 1.0),
                 "minInstancesPerNode": (1, 10), "featureSubsetStrategy": (0.6, 1.0)}
# End of fixed values.


def hash_split(df: DataFrame, id_col: str, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable split: a row's side depends on its id only, not on partitioning or retries."""
    slot = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10_000))
    limit = int(round(train * 10_000))
    return df.filter(slot < limit), df.filter(slot >= limit)


def assembled(features: Sequence[str], scale: bool = True) -> tuple[list, str]:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    if not scale:
        return [assembler], "features"
    return [assembler, StandardScaler(inputCol="features", outputCol="scaled_features")], "scaled_features"


def classifiers(label: str, features_col: str, n_features: int, trees: int = 100, iterations: int = 100,
                depth: int = 10, boost_depth: int = 6, layers: Sequence[int] = (512, 256, 128), seed: int = 42) -> dict:
    return {
        "random_forest": RandomForestClassifier(labelCol=label, featuresCol=features_col, numTrees=trees, maxDepth=depth, seed=seed),
        "gbt": GBTClassifier(labelCol=label, featuresCol=features_col, maxIter=iterations, maxDepth=boost_depth, stepSize=0.1, seed=seed),
        "logistic_regression": LogisticRegression(labelCol=label, featuresCol=features_col, maxIter=iterations),
        "neural_network": MultilayerPerceptronClassifier(
            labelCol=label, featuresCol=features_col, layers=[n_features, *layers, 2], maxIter=iterations, seed=seed),
    }


def dealt(df: DataFrame, cols: Sequence[str], rows_per_task: int = 1_000_000, least: int = 10_000) -> DataFrame:
    """The columns of ``df`` computed once and dealt evenly, for fits that go over their rows many times; persisted, the caller lets go.

    A task of a forest's fit holds the bins of all open nodes and sends them on, so there is about one part a core, and more only for over
    ``rows_per_task`` rows each; few rows stay together.
    """
    data = staged(df.select(*dict.fromkeys(cols)))
    rows, cores = data.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-rows // rows_per_task), min(cores, -(-rows // least)), 1)
    return data.repartition(parts).persist()


def fit_trees(kind: str, estimator, stages: Sequence, data: DataFrame, label: str, features: Sequence[str],
              counted: cells.Counted | None = None) -> PipelineModel:
    """``Pipeline(stages=[*stages, estimator]).fit(data)`` for a ``forest`` or ``boosting`` on assembled (and scaled) features.

    The trees grow on the counted cells of all rows (``cells.count``), which is one pass over the rows however many trees and rounds
    there are; Spark fits where the bins cut too many cells. A null or NaN in the rows is an error, as in Spark's fit.
    """
    p = {name: estimator.getOrDefault(name) for name in search.DEFAULTS[kind]}
    if counted is None:
        counted = cells.count(data, label, features, {p["maxBins"]})
    if counted is None:
        return Pipeline(stages=[*stages, estimator]).fit(data)
    if counted.up.sum() + counted.down.sum() != data.count():
        raise ValueError(f"null or NaN in {label} or the features")
    prepared = Pipeline(stages=list(stages)).fit(data).stages
    factors = trees.scale_factors(prepared[1]) if len(prepared) > 1 else None
    nodes = search.fitted(counted, p, kind, data.sparkSession, estimator.getSeed(), factors)
    return PipelineModel([*prepared, as_model(kind, estimator, nodes, len(features))])


def as_model(kind: str, estimator, nodes: DataFrame, n_features: int):
    """Spark's model of the trees ``nodes`` (``search.grown``), through the files that Spark writes for one."""
    spark, path = nodes.sparkSession, scratch_path(nodes.sparkSession, "fitted")
    threshold = F.when(F.col("threshold").isNull(), F.array().cast("array<double>")).otherwise(F.array("threshold"))
    nodes.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("cover").alias("rawCount"), "gain", F.col("left").alias("leftChild"),
        F.col("right").alias("rightChild"), F.struct(F.col("feature").alias("featureIndex"), threshold.alias("leftCategoriesOrThreshold"),
                                                     F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData")).write.parquet(f"{path}/data")
    whole, part, n = ("RandomForest", "classification.DecisionTreeClassification", estimator.getOrDefault("numTrees")) if kind == "forest" else \
        ("GBT", "regression.DecisionTreeRegression", estimator.getOrDefault("maxIter"))
    told = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    given, default = ({p.name: v for p, v in some.items()} for some in (estimator._paramMap, estimator._defaultParamMap))
    tree = told | {"class": f"org.apache.spark.ml.{part}Model", "uid": f"{estimator.uid}_tree", "paramMap": {}, "defaultParamMap": {}}
    counts = {"numFeatures": n_features, "numTrees": n} | ({"numClasses": 2} if kind == "forest" else {})
    model = told | {"class": f"org.apache.spark.ml.classification.{whole}ClassificationModel", "uid": estimator.uid, "paramMap": given, "defaultParamMap": default} | counts
    weights = [1.0 if kind == "forest" or i == 0 else float(estimator.getOrDefault("stepSize")) for i in range(n)]
    spark.createDataFrame([(i, json.dumps(tree), w) for i, w in enumerate(weights)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return (RandomForestClassificationModel if kind == "forest" else GBTClassificationModel).load(path)


def train_rf_pipeline(df: DataFrame, label: str = "risk_label", features: Sequence[str] = TRAIN_FEATURES,
                      trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    stages, col = assembled(features)
    forest = RandomForestClassifier(labelCol=label, featuresCol=col, numTrees=trees, maxDepth=depth, seed=seed)
    data = dealt(df, [*features, label])
    try:
        return fit_trees("forest", forest, stages, data, label, features)
    finally:
        data.unpersist()


def tune_cv(df: DataFrame, label: str = "risk_label", grid: dict | None = None, folds: int = 5,
            features: Sequence[str] = TUNE_FEATURES, seed: int = 42) -> PipelineModel:
    """Forest with the grid point of the best cross-validated AUC; the search and the fit go over all of ``df``."""
    return _tuned("forest", search.grid_draws(grid or TUNE_GRID), df, label, features, folds, seed)


def random_draws(n: int, seed: int, ranges: dict | None = None) -> list[dict]:
    """``n`` parameter draws; a range of whole numbers gives whole numbers."""
    rng = np.random.default_rng(seed)
    draws = []
    for _ in range(n):
        draw = {}
        for name, (low, high) in (ranges or RANDOM_RANGES).items():
            whole = isinstance(low, int) and isinstance(high, int)
            value = int(rng.integers(low, high + 1)) if whole else float(rng.uniform(low, high))
            draw[name] = str(value) if name == "featureSubsetStrategy" else value  # a share of the columns
        draws.append(draw)
    return draws


def tune_random(df: DataFrame, label: str = "risk_label", n: int = 50, seed: int = 42, folds: int = 5,
                features: Sequence[str] = TUNE_FEATURES, ranges: dict | None = None) -> PipelineModel:
    """Boosted trees with the best of ``n`` random parameter draws by cross-validated AUC; the search and the fit go over all of ``df``."""
    return _tuned("boosting", random_draws(n, seed, ranges), df, label, features, folds, seed)


def _tuned(kind: str, draws: list[dict], df: DataFrame, label: str, features: Sequence[str], folds: int, seed: int) -> PipelineModel:
    data = dealt(df, [*features, label])
    try:
        counted = cells.count(data, label, features, {(search.DEFAULTS[kind] | d)["maxBins"] for d in draws})
        best = draws[search.best_draw(search.nested_search(data, label, features, draws, kind, folds, seed, counted))]
        stages, col = assembled(features, scale=False)
        estimator = search.ESTIMATORS[kind](labelCol=label, featuresCol=col, seed=seed)
        return fit_trees(kind, estimator.setParams(**best), stages, data, label, features, counted)
    finally:
        data.unpersist()


def fourier_stages(features: Sequence[str], n_random: int, gamma: float, seed: int) -> tuple[list, str]:
    """Random Fourier features of a Gaussian kernel on standardised inputs, as SQL expressions."""
    rng = np.random.default_rng(seed)
    omega = rng.normal(0.0, np.sqrt(2 * gamma), size=(n_random, len(features)))
    phase = rng.uniform(0, 2 * np.pi, size=n_random)
    arr = "__z"
    parts = []
    for i in range(n_random):
        dot = " + ".join(f"({w!r} * {arr}[{j}])" for j, w in enumerate(map(float, omega[i])))
        parts.append(f"sqrt(2.0D / {n_random}) * cos({dot} + {float(phase[i])!r}) AS __rff_{i}")
    to_columns = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    gather = VectorAssembler(inputCols=[f"__rff_{i}" for i in range(n_random)], outputCol="fourier_features")
    return [to_columns, gather], "fourier_features"


def train_kernel_svm(df: DataFrame, label: str, features: Sequence[str], n_random: int = 128, gamma: float | None = None,
                     iterations: int = 50, seed: int = 42) -> PipelineModel:
    """Gaussian-kernel SVM through random Fourier features, with probabilities from a logistic fit of the margin."""
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                   *[F.stddev(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    scaled = ", ".join(
        f"(CAST({c} AS DOUBLE) - {float(stats[f'm{i}'])!r}) / {float(stats[f's{i}'] or 1.0) or 1.0!r}"
        for i, c in enumerate(features))
    standardise = SQLTransformer(statement=f"SELECT *, array({scaled}) AS __z FROM __THIS__")
    stages, col = fourier_stages(features, n_random, gamma or 1.0 / (2 * len(features)), seed)
    svm = LinearSVC(labelCol=label, featuresCol=col, maxIter=iterations, rawPredictionCol="margin",
                    predictionCol="svm_prediction")
    platt = LogisticRegression(labelCol=label, featuresCol="margin", maxIter=iterations)
    return Pipeline(stages=[standardise, *stages, svm, platt]).fit(df)


def train_zoo(df: DataFrame, label: str = "risk_label", seed: int = 42, features: Sequence[str] = TRAIN_FEATURES,
              trees: int = 500, iterations: int = 100, depth: int = 10, boost_depth: int = 6, svm_iterations: int = 50,
              layers: Sequence[int] = (512, 256, 128), n_random: int = 128,
              tuned: PipelineModel | None = None) -> dict[str, PipelineModel]:
    """One fitted pipeline per classifier, all exposing ``probability``; ``tuned`` joins them as ``tuned_boosting``."""
    stages, col = assembled(features)
    data = dealt(df, [*features, label])
    spread = data.repartition(df.sparkSession.sparkContext.defaultParallelism)  # the network's passes cost far more than its rows
    kinds = {"random_forest": "forest", "gbt": "boosting"}
    try:
        models = {
            name: fit_trees(kinds[name], estimator, stages, data, label, features) if name in kinds else
            Pipeline(stages=[*stages, estimator]).fit(spread if name == "neural_network" else data)
            for name, estimator in classifiers(label, col, len(features), trees, iterations, depth, boost_depth, layers, seed).items()}
        models["svm"] = train_kernel_svm(data, label, features, n_random, iterations=svm_iterations, seed=seed)
    finally:
        data.unpersist()
    if tuned is not None:
        models["tuned_boosting"] = tuned
    return models


def bounded(df: DataFrame, id_col: str, max_rows: int, seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows to fit on, drawn by a hash of the id, so a run repeats itself."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(max_rows)


def save_ensemble(models: dict[str, PipelineModel], weights: dict[str, float], features: Sequence[str], path: str, spark) -> None:
    """Write every member below ``path``, and one row with weights and features beside them."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    spark.createDataFrame([(dict(weights), list(features), list(models))],
                          "weights map<string,double>, features array<string>, members array<string>") \
        .write.mode("overwrite").parquet(f"{path}/ensemble")


def load_ensemble(path: str, spark) -> tuple[dict[str, PipelineModel], dict[str, float], list[str]]:
    """Members, weights and features written by ``save_ensemble``."""
    row = spark.read.parquet(f"{path}/ensemble").first()
    return {name: PipelineModel.load(f"{path}/{name}") for name in row["members"]}, dict(row["weights"]), list(row["features"])


def train_regressors(df: DataFrame, target: str = "risk_score", seed: int = 42, features: Sequence[str] | None = None,
                     id_col: str = "transaction_id", trees: int = 100, iterations: int = 100,
                     max_fit_rows: int | None = None) -> dict:
    """Five regressors on a repeatable 80/20 split; returns models and the held-out predictions.

    ``predictions`` has the id, ``label`` and one column per model plus their mean as ``ensemble``. The fits see at most
    ``max_fit_rows`` rows of the training part; every held-out row is predicted.
    """
    from riskloom.operators.relational import numeric_columns

    cols = list(features) if features else [c for c in numeric_columns(df) if c != target]
    clean = df.select(id_col, F.col(target).cast("double").alias("label"),
                      *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    train, test = hash_split(clean, id_col, 0.8, seed)
    if max_fit_rows is not None:
        train = bounded(train, id_col, max_fit_rows, seed)
    stages, col = assembled(cols)
    common = {"labelCol": "label", "featuresCol": col}
    estimators = {
        "random_forest": RandomForestRegressor(numTrees=trees, seed=seed, featureSubsetStrategy="sqrt", **common),
        "boosted_trees": GBTRegressor(maxIter=iterations, seed=seed, **common),
        "factorization": FMRegressor(maxIter=iterations, stepSize=0.01, factorSize=4, seed=seed, **common),
        "generalized_linear": GeneralizedLinearRegression(family="gaussian", link="identity", regParam=0.1, **common),
        "linear_regression": LinearRegression(maxIter=iterations, **common),
    }
    train = train.persist()
    try:
        models = {name: Pipeline(stages=[*stages, e.setPredictionCol(name)]).fit(train) for name, e in estimators.items()}
    finally:
        train.unpersist()
    scored = test
    for model in models.values():
        scored = model.transform(scored).drop("features", "scaled_features")
    members = list(models)
    predictions = scored.select(id_col, "label", *members).withColumn(
        "ensemble", sum((F.col(m) for m in members[1:]), F.col(members[0])) / len(members))
    return {"models": models, "predictions": predictions}


def predict_risk(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = trees.with_probability(model, df, "confidence")
    return scored.withColumn("risk_level", risk_level(F.col("confidence"), "three_level"))


def probabilities(models: dict[str, PipelineModel], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus one class-1 probability column per model, from a single scan."""
    out = df
    base = list(df.columns)
    for name, model in models.items():
        out = trees.with_probability(model, out, f"p_{name}")
        done = [c for c in out.columns if c.startswith("p_")]
        out = out.select(*base, *[c for c in done if c not in base])
    return out.select(*keep, *[f"p_{n}" for n in models])
