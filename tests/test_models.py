"""Training, metrics, explanation and fairness on learnable data."""

import numpy as np
import pandas as pd
import pytest
from itertools import combinations
from math import factorial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from riskloom.ml import cells, ensemble, explain, fairness, metrics, search, train, trees

FEATURES = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(800, 3))
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["id"] = [f"r{i}" for i in range(len(pdf))]
    pdf["label"] = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.normal(size=len(pdf)) > 0).astype(int)
    pdf["target"] = 0.3 * x[:, 0] - 0.2 * x[:, 1] + 0.5
    pdf["group"] = np.where(np.arange(len(pdf)) % 3 == 0, "a", "b")
    return spark.createDataFrame(pdf).persist()


@pytest.fixture(scope="module")
def forest(frame):
    return train.train_rf_pipeline(frame, "label", FEATURES, trees=20, depth=5)


def auc_of(model, df):
    return metrics.auc_exact(train.predict_risk(model, df), "label", "confidence").first().auc


def test_forest_learns_and_reloads(frame, forest, tmp_path):
    fit, held = train.hash_split(frame, "id")
    assert 0.7 < fit.count() / frame.count() < 0.9 and fit.join(held, "id").count() == 0
    model = train.train_rf_pipeline(fit, "label", FEATURES, trees=20, depth=5)
    assert auc_of(model, held) > 0.9
    model.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    assert auc_of(again, held) == auc_of(model, held)


def test_auc_matches_the_evaluator_and_counts_ties_half(spark, frame, forest):
    scored = forest.transform(frame)
    expected = BinaryClassificationEvaluator(labelCol="label", numBins=0).evaluate(scored)
    assert auc_of(forest, frame) == pytest.approx(expected, abs=1e-12)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, s double")
    assert metrics.auc_exact(tied, "label", "s").first().auc == 0.875
    one_class = spark.createDataFrame([(1, 0.5)], "label int, s double")
    assert metrics.auc_exact(one_class, "label", "s").first().auc is None


def test_weights_by_bounds_are_those_of_the_whole_search(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 3000)
    members = np.stack([0.3 * y + rng.normal(0, s, len(y)) for s in (0.3, 0.6, 2.0)], axis=1).round(2)
    rows = [(int(l), *map(float, m)) for l, m in zip(y, members)] + [(1, None, 0.5, 0.5), (0, float("nan"), 0.1, 0.2), (None, 9.0, 9.0, 9.0)]
    df, cols = spark.createDataFrame(rows, "y int, a double, b double, c double"), ["a", "b", "c"]
    whole = ensemble.optimize_weights(df, "y", cols, n=30).collect()
    found = ensemble.search_weights(df, "y", cols, n=30).collect()
    assert found == whole[:len(found)] and 1 <= len(found) < 15
    draws = dict(enumerate(ensemble.weight_draws(3, 30)))
    for bins in (16, 2048):
        bounds = {r.draw: r for r in ensemble.weight_bounds(df, "y", cols, draws, bins).collect()}
        assert all(bounds[r.draw].low - 1e-12 <= r.auc <= bounds[r.draw].high + 1e-12 for r in whole)
    assert len(ensemble.search_weights(df.filter("y = 1"), "y", cols, n=5).collect()) == 5  # no AUC, none goes
    assert ensemble.search_weights(df.limit(0), "y", cols, n=5).count() == 0
    tied = spark.createDataFrame([(1, 0.5, 0.5, float("inf")), (0, 0.5, 0.5, 0.5)], "y int, a double, b double, c double")
    assert {r.auc for r in ensemble.search_weights(tied, "y", cols, n=5).collect()} == {1.0}


def test_weight_search_merges_equal_rows_before_the_draws(spark):
    rows = spark.range(20_000).selectExpr("int(id % 2) AS y", "(id % 7) / 7.0D AS a", "(id % 3) / 3.0D AS b")
    cols, draws = ["a", "b"], dict(enumerate(ensemble.weight_draws(2, 5)))
    merged = ensemble._merged(rows, "y", cols)
    assert ensemble._drawn_scores(merged, cols, draws).count() == 21 * 5
    got = {r.draw: r.auc for r in ensemble.optimize_weights(rows, "y", cols, n=5).collect()}
    for i, (wa, wb) in draws.items():
        scored = rows.withColumn("s", F.lit(float(wb)) * F.col("b") + F.lit(float(wa)) * F.col("a"))
        assert got[i] == pytest.approx(metrics.auc_exact(scored, "y", "s").first().auc, abs=1e-12)


def test_zoo_and_weight_search(frame):
    fit, held = train.hash_split(frame, "id")
    models = train.train_zoo(fit, "label", features=FEATURES, trees=10, iterations=20, depth=4, layers=(8,), n_random=64)
    preds = train.probabilities(models, held, ["id", "label"]).persist()
    cols = [c for c in preds.columns if c.startswith("p_")]
    assert len(cols) == 5
    for c in cols:
        assert metrics.auc_exact(preds, "label", c).first().auc > 0.85, c
    search = ensemble.optimize_weights(preds, "label", cols, n=20)
    weights = ensemble.best_weights(search, cols)
    assert sum(weights.values()) == pytest.approx(1)
    combined = ensemble.ensemble_weighted(preds, weights)
    exact = metrics.auc_exact(combined, "label", "ensemble_probability").first().auc
    assert exact == pytest.approx(search.first().auc, abs=0.01)
    low, high = F.least(*cols), F.greatest(*cols)
    assert combined.filter((F.col("ensemble_probability") < low - 1e-9) | (F.col("ensemble_probability") > high + 1e-9)).count() == 0
    importances = ensemble.model_importances(models, FEATURES, frame.sparkSession)
    total = ensemble.feature_importance(importances, {"random_forest": 0.5, "gbt": 0.5}).toPandas().set_index("feature")["importance"]
    assert total.sum() == pytest.approx(1) and total["x1"] == total.max()


def test_searches_return_working_models(frame):
    cv = train.tune_cv(frame, "label", {"numTrees": [3, 10], "maxDepth": [2]}, folds=2, features=FEATURES)
    assert auc_of(cv, frame) > 0.85
    ranges = {"maxIter": (3, 5), "maxDepth": (2, 3), "stepSize": (0.1, 0.3)}
    rs = train.tune_random(frame, "label", n=2, folds=2, features=FEATURES, ranges=ranges)
    assert auc_of(rs, frame) > 0.85


def test_nested_search_picks_the_draw_of_the_plain_search(frame):
    """Trees cut off at one level or a single round are far worse, so that both searches must agree."""
    stages, col = train.assembled(FEATURES, scale=False)
    for kind, grid, name in ((RandomForestClassifier, {"numTrees": [1, 30], "maxDepth": [1, 6], "maxBins": [2, 32]}, "forest"),
                             (GBTClassifier, {"maxIter": [1, 25], "maxDepth": [1, 3], "stepSize": [0.001, 0.3]}, "boosting")):
        estimator = kind(labelCol="label", featuresCol=col, seed=42)
        builder = ParamGridBuilder()
        for p, values in grid.items():
            builder = builder.addGrid(estimator.getParam(p), values)
        evaluator = BinaryClassificationEvaluator(labelCol="label")
        plain = CrossValidator(estimator=Pipeline(stages=[*stages, estimator]), estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=2, seed=1).fit(frame)
        draws = search.grid_draws(grid)
        assert [{p.name: v for p, v in m.items()} for m in plain.getEstimatorParamMaps()] == draws
        found = search.nested_search(frame, "label", FEATURES, draws, name, folds=2)
        got = {r["draw"]: r["auc"] for r in found.collect()}
        assert len(got) == len(draws) and max(abs(got[i] - plain.avgMetrics[i]) for i in got) < 0.08
        assert search.best_draw(found) == int(np.argmax(plain.avgMetrics))


def test_prefixes_are_the_shorter_runs():
    """One run of the largest size gives what a run of each size gives by itself."""
    rng = np.random.default_rng(0)
    x = search.binned(rng.normal(size=(300, 3)), 16)
    y = ((x[:, 0] > 7) ^ (x[:, 1] > 9)).astype(float)
    train_rows, p = np.arange(300) % 3 > 0, search.DEFAULTS["forest"]
    whole = {(t, d): s for t, d, s in search.forest_scores(x, y, train_rows, p, {3, 8}, {2, 5}, np.random.default_rng(5))}
    for t, d in whole:
        alone = {k: s for *k, s in [(a, b, s) for a, b, s in search.forest_scores(x, y, train_rows, p, {t}, {5, d}, np.random.default_rng(5))] for k in [tuple(k)]}
        assert np.allclose(alone[t, d], whole[t, d])
    q = search.DEFAULTS["boosting"] | {"subsamplingRate": 0.7}
    runs = dict(search.boosted_scores(x, y, train_rows, q, {2, 9}, np.random.default_rng(5)))
    assert np.allclose(dict(search.boosted_scores(x, y, train_rows, q, {2}, np.random.default_rng(5)))[2], runs[2])
    assert search.auc(y, runs[9]) > 0.95 and len(search.shared_fits(search.grid_draws(train.TUNE_GRID), "forest")) == 3


def test_level_split_is_the_best_of_all_splits():
    rng = np.random.default_rng(1)
    x, y, w = search.binned(rng.normal(size=(60, 2)), 8), rng.normal(size=60), rng.integers(0, 3, 60).astype(float)
    *_, got = search.levels(x, y, w, 1, 4.0, 2, rng)

    def loss(mask):
        return sum((w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() for m in (mask, ~mask))

    masks = [x[:, f] <= c for f in range(2) for c in range(8)]
    fits = [m for m in masks if w[m].sum() >= 4 and w[~m].sum() >= 4]
    best = min(fits, key=loss)
    assert np.allclose(got, np.where(best, np.average(y[best], weights=w[best]), np.average(y[~best], weights=w[~best])))


def by_subsets(ensemble_of, x, n):
    """Shapley values from the expectation under every subset of known features."""
    def value(known):
        def walk(t, node):
            f = ensemble_of.feature[t, node]
            if f < 0:
                return ensemble_of.value[t, node]
            left, right = ensemble_of.left[t, node], ensemble_of.right[t, node]
            if f in known:
                return walk(t, left if x[f] <= ensemble_of.threshold[t, node] else right)
            c = ensemble_of.cover[t]
            return (c[left] * walk(t, left) + c[right] * walk(t, right)) / c[node]

        return sum(walk(t, 0) for t in range(len(ensemble_of.feature)))

    out = np.zeros(n)
    for i in range(n):
        others = [f for f in range(n) if f != i]
        for k in range(n):
            for s in combinations(others, k):
                out[i] += factorial(k) * factorial(n - k - 1) / factorial(n) * (value({*s, i}) - value({*s}))
    return out


def test_tree_shapley_values_are_those_of_all_subsets(frame, forest):
    stages, col = train.assembled(FEATURES)
    boosted = Pipeline(stages=[*stages, GBTClassifier(labelCol="label", featuresCol=col, maxIter=4, maxDepth=3, seed=1)]).fit(frame)
    few = frame.orderBy("id").limit(12)
    for model, target in ((forest, "probability"), (boosted, "margin")):
        flat, told = trees.flatten(model, frame.sparkSession)
        got = {r["id"]: r for r in trees.shap_trees(model, few, "id").collect()}
        assert told == target and len(got) == 12
        scaled = model.transform(few).select("id", vector_to_array("scaled_features").alias("x"), vector_to_array("probability").alias("p")).collect()
        for r in scaled:
            mine = got[r["id"]]
            assert np.allclose(mine["contributions"], by_subsets(flat, np.array(r["x"]), 3), atol=1e-12)
            assert abs(sum(mine["contributions"]) + mine["base"] - mine["score"]) < 1e-12
            assert abs((mine["score"] if target == "probability" else 1 / (1 + np.exp(-2 * mine["score"]))) - r["p"][1]) < 1e-9
    plan = explain.shap_values(forest, frame, FEATURES, "id")._jdf.queryExecution().toString()
    assert "Exchange" not in plan[plan.index("== Physical Plan =="):]
    assert explain.shap_values(forest, frame.limit(0), FEATURES, "id").count() == 0
    zoo = Pipeline(stages=[*stages, train.classifiers("label", col, 3)["logistic_regression"]]).fit(frame)
    sampled = explain.shap_values(zoo, few, FEATURES, "id", frame, n_perm=2, n_background=3)
    assert sampled.count() == 36 and sampled.filter("gap IS NOT NULL").count() == 0


def test_deep_paths_are_exact():
    """A path of eight features, against all their subsets."""
    rng = np.random.default_rng(3)
    n = 8
    nodes = 2 * n + 1
    f, left, right = np.full((1, nodes), -1), np.full((1, nodes), -1), np.full((1, nodes), -1)
    value, cover, cut = rng.normal(size=(1, nodes)), np.ones((1, nodes)), rng.normal(size=(1, nodes))
    at, rows = 0, 1000.0
    for i in range(n):
        f[0, at], left[0, at], right[0, at], cover[0, at] = i, at + 1, at + 2, rows
        cover[0, at + 1], rows = rows * 0.3, rows * 0.7
        cover[0, at + 2] = rows
        at += 2
    chain = trees.Trees(f, cut, left, right, value, cover, n)
    x = rng.normal(size=(5, n))
    got = trees.shapley([chain.leaves(0)], n, x)
    assert all(np.allclose(g, by_subsets(chain, r, n), atol=1e-12) for g, r in zip(got, x))
    assert np.allclose(got.sum(axis=1) + chain.expected(), chain.score(x))


def test_tables_give_what_the_trees_give(frame, forest):
    """Scores bit by bit, also on thresholds; Shapley values to rounding; probabilities are those of Spark."""
    flat, _ = trees.flatten(forest, frame.sparkSession)
    every = [flat.leaves(t) for t in range(len(flat.feature))]
    cuts = trees.grid(flat)
    x = np.random.default_rng(2).normal(0, 2, size=(300, 3))
    x[:100] = np.stack([np.resize(c, 100) for c in cuts], axis=1)
    told = trees.shapley_table(flat, every)(x)
    assert (told[:, 0] == flat.score(x)).all()
    assert np.allclose(told[:, 1:], trees.shapley(every, 3, x), rtol=0, atol=1e-12)
    stages, col = train.assembled(FEATURES)
    boosted = Pipeline(stages=[*stages, GBTClassifier(labelCol="label", featuresCol=col, maxIter=4, maxDepth=3, seed=1)]).fit(frame)
    for model, wide in ((forest, trees.TABLE), (forest, 1), (boosted, trees.TABLE)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(trees, "TABLE", wide)
            assert isinstance(trees.class_scorer(model, frame.sparkSession), trees.Table) == (wide > 1)
            both = trees.with_probability(model, frame, "p").select("p", vector_to_array("probability")[1].alias("q")).collect()
        assert all(r.p == r.q for r in both) if model is forest else all(abs(r.p - r.q) < 1e-12 for r in both)
    plan = train.predict_risk(forest, frame).select("confidence")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "probability" not in plan[plan.index("== Optimized Logical Plan =="):plan.index("== Physical Plan ==")]


def test_offsets_in_batches_are_those_of_the_columns(frame):
    few = frame.limit(3).select("id", F.xxhash64("id").alias("key"))
    rows = few.crossJoin(frame.sparkSession.range(4).select(F.col("id").cast("int").alias("i"))).select(
        "key", "i", *[explain._offset(F.col("id"), F.col("i"), j, 42).alias(f"z{j}") for j in range(2)]).collect()
    keys = np.array(sorted({r.key for r in rows}))
    z = explain._offsets(keys, 4, 2, 42)
    assert len(rows) == 12 and all(np.allclose(z[np.searchsorted(keys, r.key), r.i], [r.z0, r.z1], rtol=0, atol=1e-12) for r in rows)
    assert abs(explain._offsets(np.arange(500), 200, 2, 42)[:, 1:].std() - 1) < 0.01


def test_regressors_and_metrics(frame):
    result = train.train_regressors(frame, "target", features=FEATURES, id_col="id", trees=10, iterations=10)
    names = [*result["models"], "ensemble"]
    table = metrics.regression_metrics(result["predictions"], "label", names).toPandas().set_index("model")
    assert len(table) == 6
    assert table.loc["linear_regression", "rmse"] < 0.01 and table.loc["linear_regression", "r_squared"] > 0.999
    pdf = result["predictions"].toPandas()
    err = pdf["label"] - pdf["ensemble"]
    assert table.loc["ensemble", "mae"] == pytest.approx(err.abs().mean())
    assert table.loc["ensemble", "r_squared"] == pytest.approx(np.corrcoef(pdf["label"], pdf["ensemble"])[0, 1] ** 2)


def test_permutation_importance_finds_the_signal(frame, forest):
    got = ensemble.permutation_importance(forest, frame, "label", FEATURES, "id", rows_per_bucket=200).toPandas().set_index("feature")["importance"]
    assert got["x1"] > got["x2"] > got["x3"] and abs(got["x3"]) < 0.02


def test_permuted_rows_are_scored_once(frame, forest):
    plan = ensemble.permutation_importance(forest, frame, "label", FEATURES, "id")._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan =="):]
    assert "ArrowEvalPython" not in plan and "UDF" not in plan and "Scan parquet" in plan


def test_fits_read_their_rows_once_and_dealt(frame):
    data = train.dealt(frame, ["x1", "label", "x1"], rows_per_task=300)
    assert data.columns == ["x1", "label"] and data.rdd.getNumPartitions() == 3 and data.count() == 800
    assert data.storageLevel.useMemory
    data.unpersist()


def test_shapley_values_add_up(frame, forest):
    rows = frame.orderBy("id").limit(6)
    phi = explain.shap_sampling(forest, rows, frame, FEATURES, "id", n_perm=5, n_background=8)
    total = {r.id: r.s for r in phi.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    background = frame.select("id", *FEATURES).orderBy(F.xxhash64(F.col("id"), F.lit(42)), "id").limit(8)
    mean = train.predict_risk(forest, background).agg(F.avg("confidence")).first()[0]
    for r in train.predict_risk(forest, rows).collect():
        assert total[r.id] == pytest.approx(r.confidence - mean, abs=1e-9)
    assert phi.count() == 18


def test_linear_shap_and_lime_agree_on_direction(frame, forest):
    rows = frame.orderBy("id").limit(5)
    lime = explain.lime_local(forest, rows, FEATURES, "id", scale=frame, n=300, k=2).toPandas()
    assert len(lime) == 10 and set(lime["rank"]) == {1, 2}
    again = explain.lime_local(forest, rows.repartition(3), FEATURES, "id", scale=frame, n=300, k=2).toPandas()
    key = ["id", "rank"]
    assert np.allclose(lime.sort_values(key)["score"], again.sort_values(key)["score"])
    assert (lime[lime.feature == "x1"]["score"] > -0.05).all()
    linear = explain.shap_linear(frame, {"x1": 2.0}, "id")
    assert linear.agg(F.sum("contribution")).first()[0] == pytest.approx(0, abs=1e-6)


def test_lime_solves_the_weighted_ridge(frame, forest):
    one = frame.filter("id = 'r0'")
    got = explain.lime_local(forest, one, FEATURES, "id", scale=frame, n=50, k=3, ridge=1.0).toPandas().set_index("feature")["score"]
    sd = {f: frame.agg(F.stddev(f)).first()[0] for f in FEATURES}
    x = one.first()
    draws = one.select("id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(49))))
    z = draws.select("i", *[F.when(F.col("i") == 0, 0.0).otherwise(explain._normal(F.col("id"), F.col("i"), F.lit(j), F.lit(42))).alias(f"z{j}") for j in range(3)])
    pts = z.select("i", "z0", "z1", "z2", *[(F.lit(x[f]) + F.col(f"z{j}") * sd[f]).alias(f) for j, f in enumerate(FEATURES)])
    pdf = train.predict_risk(forest, pts).select("z0", "z1", "z2", "confidence").toPandas()
    zz = pdf[["z0", "z1", "z2"]].to_numpy()
    w = np.exp(-(zz**2).sum(1) / (0.75**2 * 3))
    d = np.column_stack([np.ones(50), zz])
    beta = np.linalg.solve(d.T @ (d * w[:, None]) + np.diag([0, 1, 1, 1]), d.T @ (w * pdf["confidence"].to_numpy()))
    assert np.allclose([got[f] for f in FEATURES], beta[1:])


def test_bias_matches_numpy(frame, forest):
    scored = train.predict_risk(forest, frame).withColumn("pred", (F.col("confidence") > 0.5).cast("int"))
    pdf = scored.select("group", "label", "pred").toPandas()
    got = {r.value: r for r in fairness.bias_groups(scored, "label", "pred", ["group", "missing"]).collect()}
    for value, part in pdf.groupby("group"):
        r = got[value]
        assert r.positive_rate == pytest.approx(part["label"].mean())
        assert r.true_positive_rate == pytest.approx(part[part.label == 1]["pred"].mean())
        assert r.false_positive_rate == pytest.approx(part[part.label == 0]["pred"].mean())
    none = fairness.bias_groups(frame.filter("label = 1").withColumn("pred", F.lit(1)), "label", "pred", ["group"]).first()
    assert none.false_positive_rate == 0.0


def test_drift_is_zero_without_change_and_grows(frame):
    same = metrics.drift_score(frame, frame, "x1").first().drift_score
    moved = metrics.drift_score(frame, frame.withColumn("x1", F.col("x1") + 1), "x1").first().drift_score
    assert same == pytest.approx(0, abs=1e-12) and moved > 0.5


def test_run_log_and_health(spark, frame, forest):
    scored = train.predict_risk(forest, frame).withColumn("pred", (F.col("confidence") > 0.5).cast("int"))
    run = metrics.register_model_run(metrics.classification_metrics(scored, "label", "pred"), "rf", "v1", "2024-01-01 00:00:00", auc=F.lit(0.9))
    r = run.first()
    assert (r.model_id, r.validation_samples, float(r.auc_score)) == ("rf:v1", 800, 0.9) and float(r.accuracy) > 0.85
    assert metrics.model_health(run).first().needs_retraining is False
    old = spark.createDataFrame([("m", "v1", 0.9, "2024-01-01"), ("m", "v2", 0.8, "2024-02-01")], "model_name string, model_version string, accuracy double, created_at string")
    assert [tuple(x)[:2] + (x.needs_retraining,) for x in metrics.model_health(old).collect()] == [("m", "v2", True)]


def test_scores_that_are_no_numbers_do_not_count(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.8), (1, 0.8, 0.9), (0, 0.1, 0.2), (0, None, 0.9), (0, float("nan"), 0.9), (None, 0.5, 0.5)], "y int, a double, b double")
    assert metrics.auc_exact(rows, "y", "a").first().auc == 1.0
    assert {r.auc for r in ensemble.optimize_weights(rows, "y", ["a", "b"], n=5).collect()} == {1.0}
    assert metrics.pr_curve(rows, "y", "a").count() == 3


def test_bias_without_known_attributes_is_empty(spark):
    assert fairness.bias_groups(spark.createDataFrame([(1, 1)], "y int, p int"), "y", "p", ["none"]).collect() == []


def test_ensemble_comes_back(spark, frame, forest, tmp_path):
    train.save_ensemble({"rf": forest}, {"rf": 1.0}, ["x1"], str(tmp_path), spark)
    models, weights, features = train.load_ensemble(str(tmp_path), spark)
    assert (weights, features) == ({"rf": 1.0}, ["x1"])
    assert models["rf"].transform(frame).select("prediction").collect() == forest.transform(frame).select("prediction").collect()


def test_explanation_struct(spark):
    df = spark.createDataFrame([("a", {"x": 1.0}, ["step"])], "id string, s map<string,double>, p array<string>")
    on = explain.explanation_struct(df, None, "s", None, "p").first().explanation
    assert (on.shap_values, on.decision_path, on.lime_explanation) == ({"x": 1.0}, ["step"], None)
    assert explain.explanation_struct(df, None, "s", None, "p", enabled=False).first().explanation is None


def test_cells_hold_every_row_by_exact_quantiles(spark):
    rng = np.random.default_rng(11)
    n = 25_000
    pdf = pd.DataFrame({"a": np.round(rng.normal(0, 50, n), 2) - 0.0, "b": rng.integers(-3, 20, n).astype(float), "c": np.where(rng.random(n) < 0.9, 1e6, 1e6 + rng.random(n))})
    pdf["label"] = (rng.random(n) < 0.3).astype(int)
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([(None, 1.0, 1.0, 1), (1.0, float("nan"), 1.0, 0)], "a double, b double, c double, label bigint"))
    got = cells.count(df, "label", ["a", "b", "c"], {8, 32})
    assert got.up.sum() == pdf["label"].sum() and got.up.sum() + got.down.sum() == n
    for bins in (8, 32):
        for j, c in enumerate("abc"):
            values, counts = np.unique(pdf[c], return_counts=True)
            ends = values[np.unique(np.searchsorted(np.cumsum(counts), np.arange(1, bins) * n / bins))] if len(values) > bins else values[:-1]
            assert np.array_equal(got.edges[bins][j], ends)
        x, rows = cells.merged(got.bins(bins), np.stack([got.up, got.down], axis=1))
        want = np.stack([np.searchsorted(got.edges[bins][j], pdf[c]) for j, c in enumerate("abc")], axis=1)
        told: dict = {}
        for k, y in zip(map(tuple, want.tolist()), pdf["label"]):
            up, down = told.get(k, (0, 0))
            told[k] = (up + y, down + 1 - y)
        assert {tuple(k): tuple(v) for k, v in zip(x.tolist(), rows.tolist())} == told
    assert cells.cuts(df.select(F.col("a").alias("x0"), F.col("c").alias("x1")).na.drop(), ["x0", "x1"], {32}, most=10) is None


def test_searches_see_every_row(spark, monkeypatch):
    """Class 1 is rare enough that the old draw of 20,000 rows left some of it out."""
    df = spark.range(50_000).selectExpr("double(id % 7) AS x1", "double(id % 11) AS x2", "int(id % 1000 = 3 OR id % 7 = 2) AS label")
    seen, merged = [], cells.merged
    monkeypatch.setattr(cells, "merged", lambda x, rows: seen.append(int(rows.sum())) or merged(x, rows))
    for kind, draws in (("forest", [{"numTrees": 2, "maxDepth": 2}]), ("boosting", [{"maxIter": 3, "maxDepth": 2}])):
        assert search.nested_search(df, "label", ["x1", "x2"], draws, kind).first()["auc"] > 0.9
    assert seen == [50_000, 50_000]


def test_fitted_trees_are_models_of_all_rows(frame):
    """What the model gives is what the trees gave as they grew, also in scaled features; every row counts at the roots."""
    rounds = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 1.0}
    counted = cells.count(frame, "label", FEATURES, {32})
    x, rows = cells.merged(counted.bins(32), np.stack([counted.up, counted.down], axis=1))
    *_, margin = search.boosted_rounds(x, rows[:, 0], rows[:, 1], search.DEFAULTS["boosting"] | rounds, 6, np.random.default_rng(42))
    pdf = frame.orderBy("id").toPandas()
    at = {tuple(c): m for c, m in zip(x.tolist(), margin)}
    want = [at[tuple(np.searchsorted(counted.edges[32][j], r[c]) for j, c in enumerate(FEATURES))] for _, r in pdf.iterrows()]
    for scale in (False, True):
        stages, col = train.assembled(FEATURES, scale=scale)
        estimator = GBTClassifier(labelCol="label", featuresCol=col, seed=42).setParams(**rounds)
        model = train.fit_trees("boosting", estimator, stages, frame, "label", FEATURES)
        flat, target = trees.flatten(model, frame.sparkSession)
        assert target == "margin" and flat.feature.shape[0] == 6 and set(flat.cover[:, 0]) == {800.0}
        got = [r.m for r in model.transform(frame).orderBy("id").select(vector_to_array("rawPrediction")[1].alias("m")).collect()]
        assert np.allclose(got, want)
    broken = frame.withColumn("x1", F.when(F.col("id") != "r1", F.col("x1")))
    with pytest.raises(ValueError):
        train.fit_trees("boosting", estimator, stages, broken, "label", FEATURES)


def test_too_many_cells_go_to_sparks_fits(frame, monkeypatch):
    draws = [{"numTrees": 5, "maxDepth": 1}, {"numTrees": 5, "maxDepth": 4}]
    by_cells = {r.draw: r.auc for r in search.nested_search(frame, "label", FEATURES, draws, "forest", folds=2).collect()}
    monkeypatch.setattr(cells, "CELLS", 100)
    assert cells.count(frame, "label", FEATURES, {32}) is None
    plain = {r.draw: r.auc for r in search.nested_search(frame, "label", FEATURES, draws, "forest", folds=2).collect()}
    assert all(abs(plain[i] - by_cells[i]) < 0.1 for i in by_cells) and len(plain) == 2
    assert auc_of(train.tune_cv(frame, "label", {"numTrees": [5], "maxDepth": [2, 4]}, folds=2, features=FEATURES), frame) > 0.85


def test_lime_looks_scores_up_as_the_search_does(frame, monkeypatch):
    """The model of the local explanations comes from counted cells, and points are placed and turned by arithmetic alone."""
    v = (np.arange(0, 2**32, 104_729) + 0.5) / 2.0**32
    assert np.abs(explain._cosine_of_turns(v.copy()) - np.cos(2 * np.pi * v)).max() < 2e-15
    rng = np.random.default_rng(2)
    cuts = [np.array([-1.0, 0.0, 2.0]), np.empty(0), np.arange(70.0)]
    table = trees.Table(cuts, rng.random(4 * 71))
    x = np.column_stack([rng.integers(-3, 5, 2000) / 1.0, rng.random(2000), rng.integers(-2, 75, 2000) / 1.0])
    x[:2, 0] = np.nan, np.inf
    assert np.array_equal(table(x), table.values[np.searchsorted(cuts[0], x[:, 0]) * 71 + np.searchsorted(cuts[2], x[:, 2])])
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *given: pytest.fail("Spark's fit goes over the rows for every level"))
    model = train.train_rf_pipeline(frame, "label", FEATURES, trees=3, depth=3)
    assert explain.lime_local(model, frame.limit(20), FEATURES, "id", scale=frame, n=50, k=2).count() == 40
