"""Operators against brute force on small data, hot keys included."""

import bisect
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import features as FE
from riskloom.operators import joins as J
from riskloom.operators import ordered as O
from riskloom.operators import quality as Q
from riskloom.operators import relational as R
from riskloom.operators import statistics as ST
from riskloom.operators import temporal as TP

BASE = dt.datetime(2024, 1, 1)


def hot_rows(n=600, seed=1):
    """A third of the rows share one key; many share an instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        ts = BASE + dt.timedelta(hours=rng.randrange(24 * 40), seconds=rng.choice([0, 0, 1, 1800]))
        rows.append((i, key, ts, round(rng.uniform(1, 100), 2), rng.choice([None, 0.1, 0.5, 0.9])))
    return rows


SCHEMA = "id int, key string, ts timestamp_ntz, amount double, score double"


def test_trailing_features_match_a_self_join(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r for r in TP.trailing_features(df, "key", "ts", 7, {
        "n": ("count", None), "n_score": ("count", "score"), "total": ("sum", "amount"), "mean": ("avg", "score")}).collect()}
    assert len(got) == len(rows)
    for i, key, ts, _, _ in rows:
        past = [r for r in rows if key is not None and r[1] == key and ts - dt.timedelta(days=7) < r[2] < ts]
        scores = [r[4] for r in past if r[4] is not None]
        assert got[i].n == len(past) and got[i].n_score == len(scores)
        assert got[i].total == (pytest.approx(sum(r[3] for r in past)) if past else None)
        assert got[i].mean == (pytest.approx(sum(scores) / len(scores)) if scores else None)


def test_trailing_window_ends_are_open(spark):
    week = dt.timedelta(days=7)
    df = spark.createDataFrame([(1, "a", BASE, 1.0, 1.0), (2, "a", BASE + week - dt.timedelta(microseconds=1), 1.0, 1.0),
                                (3, "a", BASE + week, 1.0, 1.0)], SCHEMA)
    got = {r.id: r.n for r in TP.trailing_features(df, "key", "ts", 7, {"n": ("count", None)}).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_active_model_matches_a_scan(spark):
    rng = random.Random(3)
    updates = [(BASE + dt.timedelta(minutes=rng.randrange(60 * 24 * 9)), f"m{i}") for i in range(25)]
    updates += [(updates[0][0], "m_tie")]
    rows = [(i, BASE + dt.timedelta(minutes=rng.randrange(-1000, 60 * 24 * 12))) for i in range(300)] + [(900, updates[3][0])]
    got = TP.active_model_asof(spark.createDataFrame(rows, "id int, assessment_timestamp timestamp_ntz"),
                               spark.createDataFrame(updates, "event_time timestamp_ntz, new_model_id string")).collect()
    assert len(got) == len(rows)
    for r in got:
        past = [u for u in updates if u[0] <= r.assessment_timestamp]
        assert r.active_model == (max(past)[1] if past else None)


def test_a_hot_hour_is_merged_without_pairs(spark):
    """Ten thousand updates and many rows in one hour, a third of them at one instant; rows without a time, and columns with the merge's names."""
    hour = "timestamp_ntz'2024-01-01 10:00:00'"
    rows = spark.range(60_000).selectExpr("id", f"{hour} + make_dt_interval(0, 0, 0, CASE WHEN id % 3 = 0 THEN 1800 ELSE pmod(xxhash64(id), 3600000) / 1000.0 END) AS assessment_timestamp",
                                          "id AS __order", "id AS __part")
    rows = rows.unionByName(spark.range(5).selectExpr("-id - 1 AS id", "CAST(NULL AS timestamp_ntz) AS assessment_timestamp", "id AS __order", "id AS __part"))
    updates = spark.range(10_000).selectExpr(f"{hour} + make_dt_interval(0, 0, 0, pmod(xxhash64(id, 7), 3600000) / 1000.0) AS event_time", "concat('m', id) AS new_model_id")
    got = TP.active_model_asof(rows, updates, rows_per_task=2_500)
    assert got.columns == [*rows.columns, "active_model"]
    seen = [(u.event_time, u.new_model_id) for u in updates.collect()]
    best = {}
    for t, m in seen:
        best[t] = max(m, best.get(t, ""))
    times = sorted(best)
    told = got.collect()
    assert len(told) == 60_005 and len({r.id for r in told}) == 60_005
    for r in told:
        at = bisect.bisect_right(times, r.assessment_timestamp) if r.assessment_timestamp else 0
        assert r.active_model == (best[times[at - 1]] if at else None) and r["__order"] == r["__part"]
    sizes = got._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in sizes and "CartesianProduct" not in sizes
    whole = TP.active_model_asof(rows, updates).select("id", F.col("active_model").alias("other"))
    assert got.join(whole, "id").filter("NOT active_model <=> other").count() == 0
    assert TP.active_model_asof(rows.limit(0), updates).count() == 0
    assert TP.active_model_asof(rows, updates.limit(0)).filter("active_model IS NOT NULL").count() == 0


def repeats(rows, ttl):
    last, n = {}, 0
    for key, at in sorted(rows):
        n += key in last and at - last[key] < ttl
        last[key] = at
    return n


@pytest.mark.parametrize("ttl,text", [(dt.timedelta(minutes=30), "30 minutes"), (dt.timedelta(hours=7), "7 hours")])
def test_repeats_match_a_loop(spark, ttl, text):
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", BASE + dt.timedelta(seconds=rng.randrange(0, 86400 * 4)))
            for i in range(3000)]
    rows += rows[:200]
    row = TP.repeat_rate(spark.createDataFrame([*rows, (None, BASE), ("x", None)], "id string, ts timestamp_ntz"), "id", "ts", text).first()
    assert (row.total_requests, row.repeated_requests) == (len(rows), repeats(rows, ttl))


@pytest.mark.parametrize("by", [["key"], []])
def test_ewma_matches_the_loop(spark, by):
    rows = [r for r in hot_rows(400, 9) if r[1] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.key if by else None): r.ewma for r in O.ewma(df, by, ["ts", "id"], "amount").collect()}
    for key in got:
        m = 0.0
        for r in sorted((r for r in rows if not by or r[1] == key), key=lambda r: (r[2], r[0])):
            m = 0.9 * m + 0.1 * r[3]
        assert got[key] == pytest.approx(m, rel=1e-12)


@pytest.mark.parametrize("values", [
    [5.0] * 40 + [1.0, 2.0, 3.5], list(np.random.default_rng(1).lognormal(6, 2, 501)), [-3.0, -1e9, 0.0, 2.5, 1e12], [7.0],
    list(0.5 + np.random.default_rng(8).uniform(0, 1e-5, 400))])
def test_exact_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    got = {r.q: r.quantile for r in O.quantiles(df, "v", qs).collect()}
    assert got == {q: pytest.approx(float(np.quantile(values, q)), rel=1e-12) for q in qs}


def test_selection_by_brackets_is_bit_equal(spark, monkeypatch):
    """Beyond the rows kept whole: brackets from sketches of ordered, repeated and heavy-tailed columns, with nulls, NaN and infinities."""
    monkeypatch.setattr(O, "SMALL", 500)
    n = 60_000
    df = spark.range(n, numPartitions=7).selectExpr(
        "id", "CAST(id AS double) AS ordered", "CASE WHEN id % 3 = 0 THEN 1.5 ELSE CAST(pmod(xxhash64(id), 7) AS double) END AS repeated",
        "exp((pmod(xxhash64(id, 3), 100000) - 50000) / 100.0) AS tails",
        "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 11 = 0 THEN double('NaN') WHEN id % 997 = 0 THEN double('Infinity') WHEN id % 991 = 0 THEN double('-Infinity') ELSE -sqrt(id) END AS holes",
        "CAST(NULL AS double) AS empty", "CASE WHEN id < 3 THEN CAST(id AS double) END AS few")
    qs = (0.0, 0.001, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {(r.column, r.q): r.quantile for r in O.selected_quantiles(df, df.columns[1:], qs).collect()}
    values = df.toPandas()
    for c in df.columns[1:]:
        x = values[c].dropna().to_numpy(dtype=float)
        x.sort()
        for q in qs:
            if not len(x):
                assert (c, q) not in got
                continue
            at = (len(x) - 1) * q
            low, high = int(np.floor(at)), int(np.ceil(at))
            want = x[low] * (1 - (at - low)) + x[high] * (at - low)
            assert got[c, q] == want or (np.isnan(got[c, q]) and np.isnan(want)), (c, q)


def test_brackets_keep_few_rows(spark):
    """What is grouped by value is a small share of the rows."""
    df = spark.range(400_000).selectExpr("CAST(pmod(xxhash64(id), 1000000007) AS double) AS v")
    bracket = df.select(O.rank_brackets(df, ["v"], [0.25, 0.5]).alias("b")).first()["b"]["v"]
    kept = df.filter(" OR ".join(f"v BETWEEN {a!r} AND {b!r}" for a, b in zip(bracket["lows"], bracket["highs"]))).count()
    assert 0 < kept < 2 * 400_000 * (2 * O.MARGIN + 2) / O.ACCURACY


def test_approximate_quantiles_stay_close(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("v"))
    got = {r.q: r.quantile for r in O.quantiles(df, "v", (0.25, 0.5), exact=False).collect()}
    assert got == {0.25: pytest.approx(2500, abs=2), 0.5: pytest.approx(5000, abs=2)}


def test_fanout_equals_the_literal_double_join(spark):
    rng = random.Random(11)
    customers = [(f"c{i}", f"s{i % 2}") for i in range(6)]
    a = [(f"a{i}", rng.choice(["c0", "c1", "c2", "c3"]), rng.choice([0.1, 0.6, 0.9]), "HIGH", "BLOCK") for i in range(30)] + [("one", "c4", 0.4, "LOW", "APPROVE")]
    t = [(rng.choice(["c0", "c0", "c1", "c5"]), rng.choice([1.0, 2.5]), rng.choice(["m1", "m2", None]), "x", BASE) for i in range(25)]
    cd = spark.createDataFrame(customers, "customer_id string, customer_segment string")
    ad = spark.createDataFrame(a, "assessment_id string, customer_id string, risk_score double, risk_level string, recommended_action string")
    td = spark.createDataFrame(t, "customer_id string, amount double, merchant_id string, location_country string, transaction_timestamp timestamp_ntz")
    literal = cd.join(ad, "customer_id").join(td, "customer_id", "left").groupBy("customer_id").agg(
        F.count("assessment_id").alias("n"), F.stddev("risk_score").alias("sd"), F.sum("amount").alias("total")).collect()
    ours = {r.customer_id: r for r in J.join_customer_fanout(cd, ad, td).collect()}
    assert len(ours) == len(literal) == 5
    for r in literal:
        o = ours[r.customer_id]
        assert o.total_assessments == r.n
        assert o.risk_score_stddev == (pytest.approx(r.sd) if r.sd is not None else None)
        assert o.total_amount == (pytest.approx(r.total) if r.total is not None else None)
    single = {r.customer_id: r for r in J.join_customer_fanout(cd, ad, td, fanout=False).collect()}
    assert sum(r.total_assessments for r in single.values()) == len(a)


def test_gap_fill_has_every_hour(spark):
    end = dt.datetime(2024, 1, 2, 12, 30)
    rows = [(end - dt.timedelta(hours=1), 0.4, "HIGH"), (end - dt.timedelta(minutes=1), 0.6, "LOW"),
            (end - dt.timedelta(hours=24), 0.8, "CRITICAL"), (end, 1.0, "HIGH"), (end - dt.timedelta(hours=25), 1.0, "HIGH")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, risk_score double, risk_level string")
    got = TP.gap_fill_hours(df, "ts", end).collect()
    assert [r.hours_ago for r in got] == list(range(23, -1, -1))
    filled = {r.hours_ago: (r.assessments, r.high_risk, round(r.average_risk_score, 9)) for r in got if r.assessments}
    assert filled == {0: (2, 1, 0.5), 23: (1, 1, 0.8)}


def test_quality_profile_counts_copies_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", None), (None, None)], "k string, v double")
    r = Q.dq_profile(df).first()
    assert (r.total_records, r.duplicate_count, r.null_counts) == (4, 1, {"k": 1, "v": 2})
    assert (r.completeness, r.uniqueness, r.cell_completeness, r.passed) == (0.25, 0.75, 0.625, False)
    empty = Q.dq_profile(df.filter("1 = 0")).first()
    assert (empty.total_records, empty.passed) == (0, False)


def test_box_stats_and_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, one int")
    box = {r.column: r for r in Q.dq_box_stats(df).collect()}
    assert (box["v"].q1, box["v"].median, box["v"].q3, box["v"].whisker_low, box["v"].whisker_high, box["v"].outliers) == (2, 3, 4, 1, 4, 1)
    assert Q.dq_iqr_outliers(df).first()[0] == 1


def test_keys_and_orphans(spark):
    parent = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    assert {(r.k, r.rows) for r in Q.dq_pk(parent, "k").collect()} == {("a", 2), (None, 1)}
    child = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "k string, id int")
    assert [r.id for r in Q.dq_fk(child, parent, "k").collect()] == [2]


def test_zscore_of_constant_column_is_unknown(spark):
    df = spark.createDataFrame([(1.0,)] * 3, "v double")
    assert R.zscore_filter(df, "v").count() == 0


def test_empty_inputs_do_not_fail(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.zscore_filter(empty, "amount").count() == 0
    assert ST.histogram(empty, "amount").count() == 30
    assert O.quantiles(empty, "amount").count() == 0
    assert ST.score_summary(empty, "score").first()["median"] is None
    assert TP.trailing_features(empty, "key", "ts", 7, {"n": ("count", None)}).count() == 0


def test_histogram_of_constant_column(spark):
    got = ST.histogram(spark.createDataFrame([(2.0,)] * 5, "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in got] == [5, 0, 0, 0]


def test_density_integrates_to_one(spark):
    values = np.random.default_rng(2).normal(0, 1, 2000)
    got = ST.density_curve(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", grid=200).orderBy("i").toPandas()
    assert float(np.trapezoid(got["density"], got["x"])) == pytest.approx(1, abs=0.01)


def test_correlations_match_pandas(spark):
    frame = pd.DataFrame(np.random.default_rng(4).normal(size=(200, 3)), columns=["a", "b", "c"])
    frame["c"] += frame["a"]
    got = ST.correlation_matrix(spark.createDataFrame(frame)).toPandas().pivot(index="var1", columns="var2", values="value")
    assert np.allclose(got.to_numpy(), frame.corr().to_numpy())


def test_cast_failures_are_flagged(spark):
    df = spark.createDataFrame([("1.5", "x"), (None, "7")], "amount string, customer_age string")
    got = R.cast_types(df, count_failures=True).collect()
    assert [(r.amount, r.customer_age, r.cast_failures) for r in got] == [(1.5, None, ["customer_age"]), (None, 7, [])]


def test_online_features_are_made_in_one_pass_for_each_key(spark, warehouse):
    """The features of a location come from the rows, not from rows joined with those of the customer, which would be made twice."""
    df = warehouse.scored.select("transaction_id", "customer_id", "location", "amount", "customer_age", "transaction_timestamp", "risk_score").localCheckpoint()
    got = FE.online_features(df)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 7  # rows, and three reads of each key's points
    chained = TP.trailing_features(TP.trailing_features(df, "customer_id", "transaction_timestamp", 30, {"c": ("count", None)}),
                                   "location", "transaction_timestamp", 7, {"l": ("count", None), "r": ("avg", "risk_score")})
    want = {r["transaction_id"]: (r["c"], r["l"], r["r"], r["location"]) for r in chained.collect()}
    rows = got.collect()
    assert len(rows) == len(want) > 1000 and got.columns == [*df.columns, "features"]
    for r in rows:
        c, n, avg, place = want[r["transaction_id"]]
        assert r["features"]["customer_transaction_count"] == c and r["features"].get("location_transaction_count") == (n if place else None)
        assert (r["features"].get("location_risk_score") is None) == (avg is None) and abs((avg or 0) - r["features"].get("location_risk_score", 0)) < 1e-9
