"""Bounds on the rows of a fit leave out no row of what is explained or evaluated."""

import inspect

import pytest
from paths import SF

from riskloom import registry
from riskloom.ml import metrics, train


@pytest.mark.parametrize("name", ["shap_sampling", "lime_local"])
def test_every_transaction_is_explained(spark, warehouse, monkeypatch, name):
    monkeypatch.setattr(registry, "FIT_ROWS", 50)
    rows = registry.queries()[name](spark, SF).select("rows").distinct().collect()
    assert [r["rows"] for r in rows] == [warehouse.transactions.count()]


def test_every_held_out_row_is_evaluated(spark, warehouse, monkeypatch):
    seen, evaluate = [], metrics.regression_metrics
    monkeypatch.setattr(registry, "FIT_ROWS", 50)
    monkeypatch.setattr(metrics, "regression_metrics", lambda df, *more: seen.append(df.count()) or evaluate(df, *more))
    assert registry.queries()["train_regressors"](spark, SF).count() == 6
    _, held = train.hash_split(warehouse.transactions, "transaction_id")
    assert seen == [held.count()] and seen[0] > 200


@pytest.mark.parametrize("name, settings", [("tune_cv", {"grid", "folds"}), ("tune_random", {"n", "folds", "ranges"}), ("train_zoo", {"trees", "iterations", "depth", "boost_depth"})])
def test_searches_and_zoo_run_as_the_operators_do(spark, monkeypatch, name, settings):
    class Seen(Exception):
        pass

    operator = inspect.signature(getattr(train, name))

    def look(*given, **named):
        raise Seen(operator.bind(*given, **named).arguments)

    monkeypatch.setattr(train, name, look)
    with pytest.raises(Seen) as seen:
        registry.queries()[name](spark, SF)
    assert not settings & set(seen.value.args[0])


@pytest.mark.parametrize("name", ["tune_cv", "tune_random", "train_zoo"])
def test_searches_and_zoo_fit_on_every_training_row(spark, warehouse, monkeypatch, name):
    class Seen(Exception):
        pass

    def look(rows, *more, **named):
        raise Seen(rows.count())

    monkeypatch.setattr(registry, "FIT_ROWS", 50)
    monkeypatch.setattr(train, name, look)
    with pytest.raises(Seen) as seen:
        registry.queries()[name](spark, SF)
    fit, _ = train.hash_split(warehouse.transactions, "transaction_id")
    assert seen.value.args[0] == fit.count() > 1000
