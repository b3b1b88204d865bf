"""Registered queries: every operator over the whole fixture warehouse of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schemas
from riskloom.fixtures import Warehouse
from riskloom.functions import columns as C
from riskloom.functions import scoring as S
from riskloom.ml import ensemble, explain, fairness, metrics, train
from riskloom.operators import features as FE
from riskloom.operators import joins as J
from riskloom.operators import ordered as O
from riskloom.operators import quality as Q
from riskloom.operators import relational as R
from riskloom.operators import statistics as ST
from riskloom.operators import temporal as TP
from riskloom.plans import batch
from riskloom.plans import warehouse as W
from riskloom.schemas import RISK_EVENT, conform
from riskloom.session import scratch_path
from riskloom.sources import readers, writers
from riskloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

T_COLS = ["transaction_id", "customer_id", "merchant_id", "amount", "location", "customer_age",
          "transaction_timestamp", "k"]


def query(fn: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Warehouse(spark, sf_dir))
    return fn


def rounded(df: DataFrame, digits: int = 6, cols: Sequence[str] | None = None, **special: int) -> DataFrame:
    """Round double columns, so that summation order does not show."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType) and (cols is None or f.name in cols or f.name in special):
            out[f.name] = C.round_half_up(f.name, special.get(f.name, digits))
    return df.withColumns(out) if out else df


def ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def model_scored(w: Warehouse) -> DataFrame:
    """Transactions with a model score that is missing for every third order."""
    return w.scored.drop("risk_score").withColumn("model_score", F.when(F.col("k") % 3 != 0, F.col("base_score"))) \
        .drop("base_score")


# -- named reports ----------------------------------------------------------------------------

@query
def q01_dashboard(w):
    return W.q01_dashboard(w.risk_assessments, hours=365 * 24)


@query
def q02_customer_profile(w):
    return W.q02_customer_profile(w.customers, w.risk_assessments, w.transactions, days=365)


@query
def q03_geographic(w):
    return W.q03_geographic(w.transactions, w.risk_assessments, days=365)


@query
def q04_merchant(w):
    return W.q04_merchant(w.merchants, w.transactions, w.risk_assessments, days=365)


@query
def q05_time_patterns(w):
    return W.q05_time_patterns(w.transactions, w.risk_assessments, days=365)


@query
def q06_model_performance(w):
    return W.q06_model_performance(w.model_performance, days=3650)


@query
def q07_feature_importance(w):
    return W.q07_feature_importance(w.model_performance, days=3650)


@query
def q08_system_metrics(w):
    return W.q08_system_metrics(w.system_metrics)


@query
def q09_score_distribution(w):
    return W.q09_score_distribution(w.risk_assessments, days=365)


@query
def q10_segmentation(w):
    return W.q10_segmentation(w.customers, w.risk_assessments, w.transactions, days=365)


@query
def q11_daily_summary(w):
    return rounded(W.q11_daily_summary(w.risk_assessments))


@query
def q12_dq_assessments(w):
    return W.q12_dq_assessments(w.risk_assessments)


@query
def q13_dq_transactions(w):
    return W.q13_dq_transactions(w.transactions_dirty)


@query
def q14_system_health(w):
    return W.q14_system_health(w.system_metrics)


@query
def q15_statistics(w):
    return rounded(W.q15_statistics(w.risk_assessments, "1997-01-01 00:00:00", "1998-12-31 23:59:59"))


# -- sources and sinks ------------------------------------------------------------------------

@query
def read_table(w):
    return readers.read_table(w.spark, f"{w.sf_dir}/orders.parquet")


@query
def read_by_extension(w):
    path = scratch_path(w.spark, "metrics") + ".csv"
    w.system_metrics.select("metric_id", "metric_name", "metric_value", "service_name").write.csv(path, header=True)
    return rounded(readers.read_by_extension(
        w.spark, path, "metric_id bigint, metric_name string, metric_value double, service_name string"))


@query
def read_json_lines(w):
    path = scratch_path(w.spark, "metrics") + ".json"
    writers.export_json(w.system_metrics.select("metric_id", "metric_name", "metric_value", "service_name"), path)
    return rounded(readers.read_by_extension(
        w.spark, path, "metric_id bigint, metric_name string, metric_value double, service_name string"))


def transaction_messages(w: Warehouse) -> DataFrame:
    event = F.struct("transaction_id", "customer_id", "amount",
                     F.col("transaction_timestamp").cast("timestamp").alias("timestamp"),
                     "location", "merchant_id", "customer_age")
    return w.transactions.select("transaction_id", F.to_json(event).alias("value"))


@query
def parse_transactions(w):
    return ntz(readers.parse_transactions(transaction_messages(w)), "timestamp")


@query
def parse_quarantine(w):
    broken = transaction_messages(w).select(F.concat_ws(" ", "transaction_id", F.lit("{")).alias("value"))
    mixed = transaction_messages(w).select("value").unionAll(broken)
    return readers.quarantine_transactions(mixed).select(F.split("raw", " ")[0].alias("transaction_id"))


@query
def risk_event_sink(w):
    events = writers.risk_event_sink(w.risk_assessments)
    parsed = events.select("key", F.from_json("value", RISK_EVENT).alias("e"))
    return ntz(parsed.select("key", "e.*"), "timestamp")


@query
def append_assessments(w):
    path = scratch_path(w.spark, "assessments")
    cols = ["assessment_id", "transaction_id", "risk_score", "risk_level", "assessment_timestamp"]
    first = w.risk_assessments.select(*cols)
    writers.append_assessments(first, path)
    writers.append_assessments(first.withColumns({
        "risk_score": F.lit(1.0), "risk_level": F.lit("HIGH"),
        "assessment_timestamp": F.col("assessment_timestamp") + F.expr("INTERVAL '60' SECOND")}), path)
    return writers.read_assessments(w.spark, path)


@query
def create_tables(w):
    table = conform(w.customers, "customers", "2024-01-01 00:00:00")
    return table.select("customer_id", "customer_segment", "registration_date", "is_active", "risk_profile",
                        "created_at", "updated_at", "email")


@query
def create_tables_all(w):
    """Each column of the six tables: rows, rows with a value and rows with the column's default, once the tables hold the warehouse."""
    parts = []
    for name, empty in schemas.create_tables(w.spark).items():
        rows = empty.unionByName(conform(getattr(w, name), name, "2024-01-01 00:00:00"))
        defaults = dict.fromkeys(schemas.NOW_DEFAULTS[name], "2024-01-01 00:00:00") | schemas.DEFAULTS.get(name, {})
        parts.append(rows.agg(F.array(*[F.struct(
            F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count(f.name).alias("n_filled"),
            F.count_if(F.col(f.name) == F.lit(defaults.get(f.name)).cast(f.dataType)).alias("n_default")) for f in rows.schema.fields]).alias("c")))
    return reduce(DataFrame.unionByName, parts).select(F.inline("c"))


@query
def write_overwrite(w):
    path = scratch_path(w.spark, "transactions")
    writers.write_overwrite(w.transactions.select(*T_COLS), path)
    return w.spark.read.parquet(path)


@query
def export_json(w):
    path = scratch_path(w.spark, "export")
    writers.export_json(w.risk_assessments.select("assessment_id", "risk_score", "risk_level"), path)
    return w.spark.read.schema("assessment_id string, risk_score double, risk_level string").json(path)


@query
def table_layout(w):
    path = scratch_path(w.spark, "layout")
    monthly = w.transactions.select(*T_COLS)
    writers.table_layout(monthly, path, "transaction_timestamp", by="month")
    return w.spark.read.parquet(path).withColumn("event_date", F.to_date("transaction_timestamp")).drop("event_period")


@query
def daily_summary_mv(w):
    return rounded(writers.daily_summary_mv(w.risk_assessments))


@query
def refresh_daily_summary(w):
    path = scratch_path(w.spark, "daily")
    a = w.risk_assessments
    late = F.col("assessment_timestamp") >= F.lit("1998-01-15").cast("timestamp_ntz")
    writers.refresh_daily_summary(a.filter(~late), a.filter(~late), path)
    writers.refresh_daily_summary(a, a.filter(late), path)
    return rounded(writers.read_daily_table(w.spark, path))


def dashboard_messages(w: Warehouse) -> DataFrame:
    a = w.risk_assessments
    assessment = F.struct(
        F.col("assessment_id").alias("id"), F.col("transaction_id").alias("transactionId"),
        F.col("risk_score").alias("riskScore"), F.col("risk_level").alias("riskLevel"))
    note = F.struct(F.col("assessment_id").alias("id"), F.col("recommended_action").alias("message"))
    kinds = (("risk_assessment", assessment), ("notification", note))
    frames = [a.select(F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data"))).alias("value"))
              for kind, data in kinds]
    return frames[0].unionAll(frames[1])


@query
def route_messages(w):
    return readers.route_messages(dashboard_messages(w))["risk_assessment"].select(
        "transactionId", "riskScore", "riskLevel")


@query
def route_notifications(w):
    return readers.route_messages(dashboard_messages(w))["notification"].select("id", "message")


# -- filters and cleaning ---------------------------------------------------------------------

@query
def fill_defaults(w):
    return R.fill_defaults(w.transactions_dirty)


@query
def fill_zero_numeric(w):
    return R.fill_zero_numeric(w.transactions_dirty)


@query
def cast_types(w):
    text = w.transactions.select(
        "transaction_id",
        F.when(F.col("k") % 7 == 0, "n/a").otherwise(F.concat(F.col("k").cast("string"), F.lit(".5"))).alias("amount"),
        F.when(F.col("k") % 5 == 0, "old").otherwise(F.col("customer_age").cast("string")).alias("customer_age"))
    return R.cast_types(text)


@query
def drop_duplicates(w):
    return R.drop_duplicates(w.transactions_dirty)


@query
def zscore_filter(w):
    return rounded(R.zscore_filter(w.transactions_dirty, "amount"), cols=["amount_zscore"])


@query
def zscore_two_sided(w):
    return rounded(R.zscore_filter(w.transactions_dirty, "amount", two_sided=True), cols=["amount_zscore"])


def dirty_scored(w: Warehouse) -> DataFrame:
    scores = w.scored.select("transaction_id", "risk_score")
    return w.transactions_dirty.join(scores, "transaction_id").select(
        "transaction_id", "amount", "customer_age", "risk_score")


@query
def validate_rules(w):
    return R.validate_rules(dirty_scored(w))


@query
def validate_quarantine(w):
    return R.validate_rules(dirty_scored(w), quarantine=True).withColumn(
        "violations", F.array_join("violations", ","))


@query
def request_required(w):
    return R.request_required(w.transactions_dirty).select("transaction_id", "amount", "rejected_because")


@query
def default_timestamp(w):
    gaps = w.transactions.select("transaction_id", F.when(
        F.col("k") % 11 != 0, F.col("transaction_timestamp")).alias("transaction_timestamp"))
    return R.default_timestamp(gaps, "transaction_timestamp", "2002-01-01 00:00:00")


@query
def lookback_filter(w):
    return R.lookback_filter(w.transactions.select(*T_COLS), "transaction_timestamp", 90)


@query
def time_range_filter(w):
    return R.time_range_filter(w.transactions.select(*T_COLS), "transaction_timestamp",
                               "1997-01-01 00:00:00", "1997-06-30 00:00:00")


@query
def dashboard_filter(w):
    return R.dashboard_filter(w.enriched_assessments, "MEDIUM", 8760, (0, 9000)).select(
        "assessment_id", "amount", "risk_score", "risk_level")


@query
def history_by_customer(w):
    return R.history_by_customer(w.risk_assessments, 5).select(
        "assessment_id", "customer_id", "assessment_timestamp", "risk_score", "recency")


# -- joins ------------------------------------------------------------------------------------

@query
def join_txn_assessment(w):
    return J.join_txn_assessment(w.transactions, w.risk_assessments).select(
        "transaction_id", "customer_id", "amount", "assessment_id", "risk_score", "risk_level")


@query
def join_merchant_3way(w):
    return J.join_merchant_3way(w.merchants, w.transactions, w.risk_assessments).select(
        "transaction_id", "merchant_id", "merchant_name", "merchant_category", "amount", "risk_score")


@query
def join_customer_fanout(w):
    recent = R.lookback_filter(w.risk_assessments, "assessment_timestamp", 365)
    profile = J.join_customer_fanout(w.customers, recent, w.transactions)
    return rounded(profile.withColumn("customer_lifespan_days", F.col("customer_lifespan_days").cast("bigint")),
                   cols=["avg_risk_score", "risk_score_stddev", "avg_amount"], total_amount=6)


@query
def join_customer_features(w):
    joined = J.join_customer_features(w.transactions, R.customer_features(w.transactions))
    return rounded(joined.select("transaction_id", "amount", "total_transactions", "avg_amount", "amount_ratio"),
                   cols=["avg_amount", "amount_ratio"])


@query
def join_location_features(w):
    joined = J.join_location_features(w.transactions, R.location_features(w.transactions))
    return rounded(joined.select("transaction_id", "location", "location_transaction_count", "location_avg_amount",
                                 "location_risk_score"))


@query
def lookup_left(w):
    dim = w.transactions.groupBy("location").agg(C.round_half_up(F.avg("amount"), 6).alias("location_avg_amount"))
    return J.lookup_left(w.transactions.select("transaction_id", "location"), dim, "location")


@query
def trailing_features(w):
    out = TP.trailing_features(w.scored, "customer_id", "transaction_timestamp", 30, {
        "customer_count": ("count", None), "customer_avg_amount": ("avg", "amount"),
        "customer_avg_score": ("avg", "risk_score")})
    return rounded(out.select("transaction_id", "customer_count", "customer_avg_amount", "customer_avg_score"))


@query
def trailing_location(w):
    out = TP.trailing_features(w.scored, "location", "transaction_timestamp", 7, {
        "location_count": ("count", None), "location_avg_score": ("avg", "risk_score")})
    return rounded(out.select("transaction_id", "location_count", "location_avg_score"))


@query
def active_model_asof(w):
    return TP.active_model_asof(w.risk_assessments.select("assessment_id", "assessment_timestamp"), w.model_updates)


@query
def json_lateral(w):
    return J.json_lateral(w.model_performance.select("model_id", "feature_importance"), "feature_importance",
                          "feature_name", "importance")


# -- aggregates, windows, top-k ---------------------------------------------------------------

@query
def agg_basic(w):
    return w.transactions.groupBy("location_country").agg(
        F.count(F.lit(1)).alias("n"), F.count("customer_age").alias("n_age"),
        C.round_half_up(F.sum("amount"), 6).alias("sum_amount"), C.round_half_up(F.avg("amount"), 6).alias("avg_amount"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"))


@query
def agg_conditional_count(w):
    return w.risk_assessments.groupBy("customer_id").agg(*W.assessment_counts()[:4])


@query
def agg_distinct(w):
    return w.transactions.groupBy("location_region").agg(
        F.count_distinct("customer_id").alias("customers"), F.count_distinct("merchant_id").alias("merchants"),
        F.count_distinct("location").alias("locations"))


@query
def agg_stddev_var(w):
    return w.transactions.groupBy("customer_id").agg(
        C.round_half_up(F.stddev("amount"), 6).alias("sd"), C.round_half_up(F.variance("amount"), 3).alias("var"))


@query
def agg_ratio(w):
    return w.risk_assessments.groupBy("customer_id").agg(
        C.percent(F.count_if(F.col("risk_level") == "HIGH"), F.count(F.lit(1))).alias("high_risk_percentage"))


@query
def agg_having(w):
    return w.transactions.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")


@query
def agg_two_level(w):
    per_customer = w.transactions.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    return w.customers.join(per_customer, "customer_id").groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customers"), C.round_half_up(F.avg("n"), 6).alias("avg_transactions"),
        C.round_half_up(F.avg("total"), 6).alias("avg_total"))


@query
def agg_group_expr(w):
    return w.transactions.groupBy(
        F.date_trunc("month", "transaction_timestamp").cast("timestamp_ntz").alias("month"),
        F.hour("transaction_timestamp").alias("hour"),
        F.when(F.col("amount") > 10000, "LARGE").otherwise("SMALL").alias("size"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def customer_features(w):
    return rounded(R.customer_features(w.transactions), cols=["avg_amount", "amount_std"], total_amount=6)


@query
def location_features(w):
    return rounded(R.location_features(w.transactions))


@query
def risk_statistics(w):
    return rounded(R.risk_statistics(w.risk_assessments, "1997-01-01 00:00:00", "1998-12-31 23:59:59"))


@query
def service_rates(w):
    log = w.system_metrics.select(
        "service_name", F.col("metric_time").alias("request_time"),
        F.when(F.col("metric_name") == "error_rate", "FAILED").otherwise("OK").alias("status"),
        (F.col("metric_value") < 10).alias("cache_hit"))
    return R.service_rates(log, by=["service_name"])


@query
def quantiles(w):
    return rounded(O.quantiles(w.transactions_dirty, "amount", (0.25, 0.5, 0.75, 0.99)))


@query
def ewma(w):
    return rounded(O.ewma(w.system_metrics, ["service_name"], ["metric_time", "metric_id"], "metric_value"))


@query
def win_lag(w):
    lagged = R.win_lag(w.model_performance, ["model_name"], ["created_at", "model_version"], ["accuracy", "f1_score"])
    return rounded(lagged.select("model_id", "prev_accuracy", "prev_f1_score"))


@query
def win_row_number_topn(w):
    return R.win_row_number_topn(w.transactions.select("transaction_id", "location_city", "amount"), ["location_city"],
                                 [F.desc("amount"), F.asc("transaction_id")], 20)


@query
def win_total_share(w):
    counts = w.transactions.groupBy("payment_method").agg(F.count(F.lit(1)).alias("n"))
    return R.win_total_share(counts, "n")


@query
def win_global_stats(w):
    return rounded(R.zscore_filter(w.transactions, "amount", limit=float("inf")).select("transaction_id", "amount_zscore"))


@query
def sort_multi(w):
    grouped = w.transactions.groupBy("location_country", "payment_method").agg(
        F.count(F.lit(1)).alias("n"), C.round_half_up(F.sum("amount"), 6).alias("amount"))
    return R.sort_multi(grouped, F.desc("n"), F.asc("location_country"))


@query
def top_locations(w):
    grouped = w.scored.filter("location IS NOT NULL").groupBy("location").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.avg("risk_score").alias("avg_risk_score"))
    return rounded(R.top_locations(grouped, 50))


@query
def latest_n(w):
    return R.latest_n(w.risk_assessments.select("assessment_id", "assessment_timestamp", "risk_score"),
                      "assessment_timestamp", 100)


@query
def topk_importance(w):
    pairs = J.json_lateral(w.model_performance.select("model_id", "feature_importance"), "feature_importance",
                           "key", "importance")
    return rounded(R.topk_importance(pairs.select(F.concat_ws("/", "model_id", "key").alias("feature"), "importance")))


@query
def sort_by_time(w):
    return R.sort_by_time(w.risk_assessments.select("assessment_id", "assessment_timestamp", "risk_score"),
                          "assessment_timestamp", "assessment_id")


# -- scalar functions -------------------------------------------------------------------------

def _with(df: DataFrame, cols: dict) -> DataFrame:
    return df.select("transaction_id", *[c.alias(n) for n, c in cols.items()])


@query
def amount_transforms(w):
    cols = C.amount_transforms("amount")
    cols["amount_cubed"] = cols["amount_cubed"] / 1e6
    return rounded(_with(w.transactions, cols), amount_squared=2, amount_cubed=2)


@query
def calendar_features(w):
    return _with(w.transactions, C.calendar_features("transaction_timestamp"))


@query
def age_features(w):
    return _with(w.transactions, C.age_features("customer_age"))


@query
def interaction_features(w):
    joined = J.join_customer_features(w.transactions, R.customer_features(w.transactions))
    return rounded(_with(joined, C.interaction_features("amount", "customer_age", "total_transactions", "avg_amount")))


@query
def round_half_up(w):
    return _with(w.scored, {"r0": C.round_half_up("amount", 0), "r3": C.round_half_up("base_score", 3)})


@query
def coalesce_delta(w):
    lagged = R.win_lag(w.model_performance, ["model_name"], ["created_at", "model_version"], ["accuracy"])
    return rounded(lagged.select("model_id", C.coalesce_delta("accuracy", "prev_accuracy").alias("accuracy_change")))


@query
def date_functions(w):
    return _with(w.transactions, C.date_functions("transaction_timestamp"))


@query
def case_day_name(w):
    return _with(w.transactions, {"day_name": C.case_day_name(C.day_of_week("transaction_timestamp"))})


@query
def score_bucket(w):
    score = F.when(F.col("processing_time_ms") != 50, F.col("risk_score"))
    return w.risk_assessments.select("assessment_id", C.score_bucket(score).alias("bucket"))


@query
def cut_levels(w):
    return w.risk_assessments.select("assessment_id", C.cut_levels(F.col("risk_score") * 1.2).alias("level"))


@query
def string_predicates(w):
    return _with(w.transactions, C.string_predicates("customer_id", "location", "merchant_id")).na.fill(
        False, ["is_csv_or_json"])


@query
def clamp(w):
    return _with(w.transactions_dirty, {"clamped": C.clamp(F.col("amount") / 5000 - 0.5)})


@query
def json_functions(w):
    pairs = w.model_performance.select("model_id", C.json_functions("feature_importance")["pairs"].alias("pairs"))
    return pairs.select("model_id", F.inline("pairs"))


@query
def map_array_features(w):
    built = _with(w.transactions, C.map_array_features("amount", "transaction_timestamp", "customer_age"))
    at = {n: F.try_element_at("features", F.lit(n)) for n in ("amount", "hour", "customer_age")}
    return built.select("transaction_id", *[c.alias(n) for n, c in at.items()],
                        F.size("features").alias("n_features"), F.array_join("flags", ",").alias("flags"))


# -- scoring ----------------------------------------------------------------------------------

def _joined_rules(df: DataFrame) -> DataFrame:
    return df.withColumn("rules", F.array_join("business_rules_applied", ","))


@query
def naive_risk_score(w):
    return rounded(S.naive_risk_score(w.transactions_dirty), 6).select("transaction_id", "risk_score", "risk_level")


@query
def rules_max(w):
    return _joined_rules(S.rules_max(w.scored, "engine")).select("transaction_id", "risk_score", "rules")


@query
def rules_max_service(w):
    return _joined_rules(S.rules_max(w.scored, "service")).select("transaction_id", "risk_score", "rules")


@query
def rules_additive(w):
    return rounded(S.rules_additive(w.transactions, "engine").select("transaction_id", "risk_score"), 6)


@query
def rules_additive_gateway(w):
    return rounded(S.rules_additive(w.transactions, "gateway").select("transaction_id", "risk_score"), 6)


@query
def score_with_fallback(w):
    return rounded(S.score_with_fallback(model_scored(w), "model_score", "gateway").select(
        "transaction_id", "base_score", "confidence"), 6)


def _naive_with_confidence(w: Warehouse) -> DataFrame:
    return S.naive_risk_score(w.transactions_dirty).withColumn("confidence", F.lit(0.9))


@query
def error_policy(w):
    return rounded(S.error_policy(_naive_with_confidence(w), F.col("amount") <= 0).select(
        "transaction_id", "risk_score", "risk_level", "confidence"), 6)


@query
def error_policy_drop(w):
    return rounded(S.error_policy(_naive_with_confidence(w), F.col("amount") <= 0, "drop").select(
        "transaction_id", "risk_score"), 6)


@query
def risk_level(w):
    return w.scored.select(
        "transaction_id", S.risk_level("risk_score").alias("three_level"),
        S.risk_level("risk_score", "four_level").alias("four_level"),
        S.risk_level("risk_score", "merchant").alias("merchant_level"),
        S.risk_level("risk_score", "cut").alias("cut_level"))


@query
def recommended_action(w):
    return w.scored.select("transaction_id", S.recommended_action(S.risk_level("risk_score", "four_level")).alias("action"))


@query
def location_risk(w):
    return w.transactions.groupBy("location").agg(S.location_risk(F.count(F.lit(1))).alias("location_risk"))


@query
def decision_path(w):
    exact = w.scored.withColumn("risk_score", F.round(F.col("risk_score") * 1000) / 1000)
    return S.decision_path(exact).select("transaction_id", F.array_join("decision_path", " | ").alias("decision_path"))


@query
def score_batch(w):
    return rounded(_joined_rules(S.score_batch(model_scored(w), "engine", "model_score")).select(
        "transaction_id", "risk_score", "confidence", "rules", "risk_level", "recommended_action"), 6)


@query
def score_batch_service(w):
    scored = w.scored.withColumnRenamed("base_score", "model_score").drop("risk_score")
    return rounded(S.score_batch(scored, "service", "model_score").select(
        "transaction_id", "risk_score", "risk_level", "recommended_action"), 6)


@query
def score_batch_gateway(w):
    return rounded(S.score_batch(w.transactions, "gateway").select(
        "transaction_id", "risk_score", "risk_level", "recommended_action", "confidence"), 6)


# -- data quality -----------------------------------------------------------------------------

@query
def dq_profile(w):
    report = Q.dq_profile(w.transactions_dirty)
    return rounded(report.select(
        "total_records", "duplicate_count", "completeness", "uniqueness", "cell_completeness", "passed",
        F.col("null_counts")["amount"].alias("null_amounts"), F.col("null_counts")["location"].alias("null_locations")), 6)


@query
def dq_profile_cells(w):
    report = Q.dq_profile_cells(w.transactions_dirty)
    return rounded(report.select(
        "total_rows", "total_columns", "missing_values", "missing_percentage", "duplicate_rows", "duplicate_percentage",
        F.col("missing_percentage_by_column")["customer_age"].alias("missing_age_percentage")), 6)


@query
def dq_iqr_outliers(w):
    return Q.dq_iqr_outliers(w.transactions_dirty)


@query
def dq_box_stats(w):
    return rounded(Q.dq_box_stats(w.transactions_dirty, ["amount", "customer_age"]))


@query
def dq_assessments(w):
    return Q.dq_assessments(w.risk_assessments)


@query
def dq_transactions(w):
    return Q.dq_transactions(w.transactions_dirty)


@query
def dq_pk(w):
    return Q.dq_pk(w.transactions_dirty, "transaction_id")


@query
def dq_fk(w):
    """Orphans of each foreign key of the schema, and of one relation that does not hold."""
    risky = w.risk_assessments.filter("risk_score >= 0.5").select("customer_id")
    relations = {
        "transactions.customer_id": (w.transactions, w.customers, "customer_id"),
        "transactions.merchant_id": (w.transactions, w.merchants, "merchant_id"),
        "risk_assessments.transaction_id": (w.risk_assessments, w.transactions, "transaction_id"),
        "risk_assessments.customer_id": (w.risk_assessments, w.customers, "customer_id"),
        "transactions.customer_id, risky only": (w.transactions, risky, "customer_id")}
    counts = [Q.dq_fk(child.select(key), parent, key).agg(F.count(F.lit(1)).alias("orphans")).withColumn("relation", F.lit(name))
              for name, (child, parent, key) in relations.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def dq_missing_pattern(w):
    return Q.dq_missing_pattern(w.transactions_dirty)


@query
def data_summary(w):
    return Q.data_summary(w.transactions_dirty).select(
        "rows", "columns", F.array_join("column_names", ",").alias("column_names"))


# -- features and model arithmetic ------------------------------------------------------------

@query
def feature_matrix(w):
    return rounded(FE.feature_matrix(w.scored).select(
        "transaction_id", "hour", "day_of_week", "is_weekend", "is_night", "amount_log", "customer_transaction_count",
        "customer_avg_amount", "customer_risk_history", "location_transaction_count", "location_avg_amount",
        "amount_age_ratio", "amount_frequency_ratio"))


@query
def engineer_features(w):
    return rounded(FE.engineer_features(w.transactions).select(
        "transaction_id", "total_transactions", "total_amount", "amount_std", "unique_merchants", "unique_locations",
        "amount_ratio", "location_transaction_count", "location_risk_score", "hour", "day_of_week"), total_amount=6)


@query
def online_features(w):
    names = ["amount", "amount_log", "customer_transaction_count", "customer_avg_amount", "location_transaction_count",
             "location_risk_score", "customer_age"]
    built = FE.online_features(w.scored, "engine")
    return rounded(built.select("transaction_id", *[F.try_element_at("features", F.lit(n)).alias(n) for n in names]),
                   cols=["amount_log", "customer_avg_amount", "location_risk_score"])


@query
def batch_process(w):
    out = batch.process(w.transactions_dirty, stage=FE.staged).select(
        "transaction_id", "amount", "customer_age", "amount_zscore", "total_transactions", "amount_ratio",
        "location_transaction_count", "risk_score", "risk_level")
    return rounded(out, cols=["amount_zscore", "amount_ratio"], risk_score=6)


def member_predictions(w: Warehouse) -> DataFrame:
    base = F.col("base_score")
    return w.scored.select("transaction_id", "risk_label", F.col("risk_score").alias("label"), base.alias("model_a"),
                           (1 - base).alias("model_b"), ((base + 0.5) / 2).alias("model_c"))


MEMBERS = ["model_a", "model_b", "model_c"]


@query
def regression_metrics(w):
    return rounded(metrics.regression_metrics(member_predictions(w), "label", MEMBERS))


@query
def model_comparison(w):
    return rounded(ST.model_comparison(metrics.regression_metrics(member_predictions(w), "label", MEMBERS)))


@query
def prediction_vs_actual(w):
    return ST.prediction_vs_actual(member_predictions(w), "label", "model_a")


@query
def ensemble_weighted(w):
    out = ensemble.ensemble_weighted(member_predictions(w), dict(zip(MEMBERS, ensemble.DEFAULT_WEIGHTS)))
    exact = out.withColumn("ensemble_prediction", (C.snap("ensemble_probability") > 0.5).cast("int"))
    return rounded(exact.select("transaction_id", "ensemble_probability", "ensemble_prediction"), 6)


@query
def ensemble_mean(w):
    return rounded(ensemble.ensemble_mean(member_predictions(w), MEMBERS).select("transaction_id", "ensemble"), 6)


@query
def auc_exact(w):
    return rounded(metrics.auc_exact(w.scored, "risk_label", "base_score"), 6)


@query
def pr_curve(w):
    return rounded(metrics.pr_curve(w.scored, "risk_label", "base_score"), 6)


@query
def classification_metrics(w):
    flagged = w.scored.withColumn("pred", (F.col("base_score") > 0.5).cast("int"))
    return rounded(metrics.classification_metrics(flagged, "risk_label", "pred").drop("confusion_matrix"), 6)


@query
def feature_importance(w):
    pairs = J.json_lateral(w.model_performance.select(F.col("model_name").alias("model"), "feature_importance"),
                           "feature_importance", "feature", "importance")
    return rounded(ensemble.feature_importance(pairs, {"model_0": 0.4, "model_1": 0.3, "model_2": 0.2, "model_3": 0.1}))


@query
def model_health(w):
    return rounded(metrics.model_health(w.model_performance))


@query
def drift_psi(w):
    t, cut = w.transactions, F.lit("1998-01-01").cast("timestamp_ntz")
    before = t.filter(F.col("transaction_timestamp") < cut)
    after = t.filter(F.col("transaction_timestamp") >= cut)
    return rounded(metrics.drift_psi(before, after, "amount"))


@query
def shap_linear(w):
    return rounded(explain.shap_linear(w.scored, {"amount": 0.0001, "base_score": -1.5}, "transaction_id"))


def protected(w: Warehouse) -> DataFrame:
    return w.scored.withColumn("pred", (F.col("base_score") > 0.5).cast("int"))


@query
def bias_baseline(w):
    return rounded(fairness.bias_baseline(protected(w), "risk_label"), 6)


@query
def bias_groups(w):
    return rounded(fairness.bias_groups(protected(w), "risk_label", "pred",
                                        ["location_region", "payment_method", "not_a_column"]), 6)


# -- chart tables -----------------------------------------------------------------------------

@query
def histogram(w):
    return rounded(ST.histogram(w.transactions, "amount"), density=8)


@query
def density_curve(w):
    return rounded(ST.density_curve(w.transactions, "amount"), density=8)


@query
def correlation_matrix(w):
    return rounded(ST.correlation_matrix(w.scored, ["amount", "customer_age", "risk_score"]))


@query
def time_series(w):
    return rounded(ST.time_series(w.risk_assessments, "assessment_timestamp", "risk_score"))


@query
def level_distribution(w):
    return ST.level_distribution(w.risk_assessments)


@query
def linear_trend(w):
    return rounded(ST.linear_trend(w.scored))


@query
def score_summary(w):
    return rounded(ST.score_summary(w.risk_assessments, "risk_score"))


# -- streams (the folder's files as a feed, drained to the end) -------------------------------

def streaming(w: Warehouse) -> Warehouse:
    return Warehouse(w.spark, w.sf_dir, orders=w.stream("orders"))


def event_stream(w: Warehouse) -> DataFrame:
    return Warehouse(w.spark, w.sf_dir, events=w.stream("events")).system_metrics


def drained(df: DataFrame, name: str) -> DataFrame:
    """Run a stream until its input is used up and read back what it wrote."""
    spark, target = df.sparkSession, scratch_path(df.sparkSession, name)
    writers.write_stream_append(df, f"{target}/table", f"{target}/checkpoint", trigger=None).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{target}/table")


@query
def stream_score(w):
    scored = jobs.stream_score(streaming(w).transactions, "naive", "transaction_timestamp")
    return rounded(drained(scored.select("transaction_id", "risk_score", "risk_level"), "score"), 6)


@query
def write_stream_append(w):
    scored = jobs.stream_score(streaming(w).transactions, "gateway", "transaction_timestamp")
    return rounded(drained(scored.select("transaction_id", "risk_score", "risk_level"), "append"), 6)


@query
def stream_dedup_ttl(w):
    dirty = streaming(w).transactions_dirty
    return drained(jobs.stream_dedup_ttl(dirty, "transaction_id", "transaction_timestamp").select("transaction_id"), "dedup")


@query
def stream_misses_ttl(w):
    out = drained(jobs.stream_misses_ttl(streaming(w).transactions.select("location", "transaction_id", "transaction_timestamp")
                                         .filter("location IS NOT NULL"), "location", "transaction_timestamp", "5 days"), "misses")
    return ntz(out.select("location", "transaction_timestamp"), "transaction_timestamp")


@query
def stream_with_snapshot(w):
    snapshot = TP.trailing_snapshot(w.scored, "customer_id", "transaction_timestamp", 365, {
        "transaction_count": ("count", None), "avg_amount": ("avg", "amount"), "risk_history": ("avg", "risk_score")})
    joined = jobs.stream_with_snapshot(streaming(w).transactions.select("transaction_id", "customer_id"), snapshot, "customer_id")
    return rounded(drained(joined, "snapshot"))


@query
def stream_hourly_metrics(w):
    return rounded(ntz(drained(jobs.stream_hourly_metrics(streaming(w).risk_assessments), "hourly"), "hour"))


@query
def stream_daily_summary(w):
    target = scratch_path(w.spark, "daily-stream")
    summary = jobs.stream_daily_summary(streaming(w).risk_assessments)
    jobs.write_daily_summary(summary, f"{target}/table", f"{target}/checkpoint", trigger=None).awaitTermination()
    return rounded(jobs.read_daily_summary(w.spark, f"{target}/table"))


@query
def stream_sliding_customer(w):
    out = drained(jobs.stream_sliding_customer(streaming(w).transactions), "sliding")
    return rounded(ntz(out, "window_start", "window_end"))


@query
def stream_alerts(w):
    return rounded(ntz(drained(jobs.stream_alerts(event_stream(w)), "alerts"), "hour"))


@query
def metrics_gauge(w):
    gauge = drained(jobs.metrics_gauge(streaming(w).risk_assessments, "1 day"), "gauge")
    return rounded(ntz(gauge, "window_start").select(
        "window_start", F.col("score_histogram")["0.0-0.2"].alias("lowest"),
        F.col("score_histogram")["0.8-1.0"].alias("highest"), "avg_processing_time", "last_score"))


@query
def gap_fill_hours(w):
    feed = w.system_metrics.select(
        "metric_time", F.col("metric_value").alias("risk_score"),
        F.when(F.col("metric_name") == "error_rate", "HIGH").otherwise("LOW").alias("risk_level"))
    return rounded(TP.gap_fill_hours(feed, "metric_time"))


@query
def batch_cache_hits(w):
    return TP.repeat_rate(w.transactions, "location", "transaction_timestamp", "5 days")


# -- models -----------------------------------------------------------------------------------

ONLINE = ["amount", "customer_age", "hour", "day_of_week"]


def training_rows(w: Warehouse) -> DataFrame:
    """Feature rows of all transactions, labelled by whether the engine rules reach HIGH."""
    features = J.join_customer_features(w.scored, R.customer_features(w.transactions))
    return features.select(
        "transaction_id", "risk_label", "risk_score", "amount", F.coalesce("customer_age", F.lit(0)).alias("customer_age"),
        F.col("total_transactions").alias("transaction_count"), "total_transactions", "avg_amount", "amount_ratio",
        F.hour("transaction_timestamp").alias("hour"), C.day_of_week("transaction_timestamp").alias("day_of_week"),
        (F.col("risk_score") >= 0.7).cast("int").alias("label"))


#: Rows that the regressors' fits see at most; trees and iterations are those of the operator.
FIT_ROWS = 2_000


#: Held-out AUC and squared correlation that a model of these few columns reaches; chance is one half, and zero.
LEARNT, EXPLAINED = 0.55, 0.01


def training_part(w: Warehouse) -> DataFrame:
    return train.hash_split(training_rows(w), "transaction_id")[0]


def risk_model(w: Warehouse):
    return train.train_rf_pipeline(training_part(w), "label", ONLINE)


def learnt(scored: DataFrame, score: str):
    """Whether ``score`` tells the labels of the held-out rows apart, as one value for all rows."""
    held = train.hash_split(scored.select("transaction_id", "label", score), "transaction_id")[1]
    return metrics.auc_exact(held, "label", score).select(F.coalesce(F.col("auc") >= LEARNT, F.lit(False))).scalar()


def checked(predicted: DataFrame) -> DataFrame:
    """Per row: whether its probability is one, its level the one of that probability, and the model better than chance."""
    predicted = FE.staged(predicted.select("transaction_id", "label", "risk_level", "confidence"))  # read twice below
    p = F.col("confidence")
    fits = F.col("risk_level") == F.when(p >= 0.8, "HIGH").when(p >= 0.5, "MEDIUM").otherwise("LOW")
    return predicted.select("transaction_id", p.between(0, 1).alias("is_probability"), fits.alias("level_fits"),
                            learnt(predicted, "confidence").alias("has_learnt"))


@query
def train_rf_pipeline(w):
    return checked(train.predict_risk(train.train_rf_pipeline(training_part(w), "label"), training_rows(w)))


@query
def predict_risk(w):
    return checked(train.predict_risk(risk_model(w), training_rows(w)))


@query
def tune_cv(w):
    model = train.tune_cv(training_part(w), "label")
    return checked(train.predict_risk(model, training_rows(w)))


@query
def tune_random(w):
    model = train.tune_random(training_part(w), "label")
    return checked(train.predict_risk(model, training_rows(w)))


@query
def train_zoo(w):
    models = train.train_zoo(training_part(w), "label", features=ONLINE)
    out = FE.staged(train.probabilities(models, training_rows(w), ["transaction_id", "label"]))
    names = [c for c in out.columns if c.startswith("p_")]
    return out.select("transaction_id", *[(F.col(c).between(0, 1) & learnt(out, c)).alias(c) for c in names])


@query
def train_regressors(w):
    """Per model: whether its errors are in order, and its predictions go with the held-out values."""
    result = train.train_regressors(training_rows(w), "risk_score", features=ONLINE, max_fit_rows=FIT_ROWS)
    out = metrics.regression_metrics(result["predictions"], "label", [*result["models"], "ensemble"])
    return out.select("model", ((F.col("rmse") >= F.col("mae")) & (F.col("mae") >= 0)).alias("ordered"), (F.col("r_squared") >= EXPLAINED).alias("has_learnt"))


@query
def optimize_weights(w):
    search = ensemble.optimize_weights(member_predictions(w), "risk_label", MEMBERS)
    return rounded(search.select("draw", *[F.col("weights")[i].alias(f"w{i}") for i in range(len(MEMBERS))], "auc"))


@query
def search_weights(w):
    """The best of the draws, by bounds; draws may tie, so the row tells its AUC."""
    return rounded(ensemble.search_weights(member_predictions(w), "risk_label", MEMBERS).agg(F.max("auc").alias("auc")))


@query
def permutation_importance(w):
    out = ensemble.permutation_importance(risk_model(w), training_rows(w), "label", ONLINE, "transaction_id")
    return out.select("feature", F.col("auc").between(0, 1).alias("is_auc"), F.col("importance").between(-1, 1).alias("is_difference"))


@query
def register_model_run(w):
    flagged = w.scored.withColumn("pred", (F.col("base_score") > 0.5).cast("int"))
    auc = metrics.auc_exact(w.scored, "risk_label", "base_score").select("auc").scalar()
    run = metrics.register_model_run(
        metrics.classification_metrics(flagged, "risk_label", "pred"), "baseline", "v1", "2024-01-01 00:00:00", 100,
        auc, F.lit(0.25), F.create_map(F.lit("base_score"), F.lit(1.0)))
    path = scratch_path(w.spark, "runs")
    metrics.append_model_run(run, path)
    metrics.append_model_run(run.withColumn("model_version", F.lit("v2")), path)
    told = w.spark.read.parquet(path)
    return rounded(told.select("model_name", "model_version", "training_samples", "validation_samples", "feature_importance", "confusion_matrix",
                               *[F.col(c).cast("double").alias(c) for c in ("accuracy", "precision_score", "recall_score", "f1_score", "auc_score", "drift_score")]), 3)


@query
def shap_sampling(w):
    """Over all rows: how many features are explained, and whether the parts add up to what sets the row's score apart."""
    out = explain.shap_values(risk_model(w), training_rows(w), ONLINE, "transaction_id")
    sums = out.groupBy("transaction_id").agg(F.count("feature").alias("features"), F.max(F.abs("gap")).alias("gap"))
    return sums.agg(F.count(F.lit(1)).alias("rows"), F.min("features").alias("least"), F.max("features").alias("most"),
                    F.bool_and(F.col("gap") < 1e-9).alias("additive"))


@query
def lime_local(w):
    """Per rank: the rows that have a feature there."""
    out = explain.lime_local(risk_model(w), training_rows(w), ONLINE, "transaction_id")
    return out.groupBy("rank").agg(F.count_distinct("transaction_id").alias("rows"))


@query
def explanation_struct(w):
    """All four parts of the explanation, read back from the struct."""
    exact = w.scored.withColumn("risk_score", F.round(F.col("risk_score") * 1000) / 1000)
    parts = explain.shap_linear(exact, {"amount": 0.0001, "base_score": -1.5}, "transaction_id")
    shap = explain.contribution_maps(parts, "transaction_id")
    pairs = J.json_lateral(w.model_performance.select(F.col("model_name").alias("model"), "feature_importance"),
                           "feature_importance", "feature", "importance")
    importance = ensemble.feature_importance(pairs, {f"model_{i}": 0.25 for i in range(4)}).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "importance"))))).scalar()
    rows = S.decision_path(exact).join(shap, "transaction_id").withColumns({
        "importance": importance,
        "local": F.array(F.struct(F.lit("amount").alias("feature"), (F.col("amount") * 0.0001).alias("score")))})
    e = explain.explanation_struct(rows, "importance", "shap_values", "local", "decision_path").select("transaction_id", "explanation.*")
    return rounded(e.select(
        "transaction_id", F.size("feature_importance").alias("features"), F.col("feature_importance")["amount"].alias("amount_importance"),
        F.col("shap_values")["amount"].alias("amount_shap"), F.col("shap_values")["base_score"].alias("base_shap"),
        F.col("lime_explanation")[0]["feature"].alias("local_feature"), F.col("lime_explanation")[0]["score"].alias("local_score"),
        F.array_join("decision_path", " | ").alias("decision_path")))


@query
def ab_assign(w):
    out = metrics.ab_assign(w.risk_assessments, "transaction_id", 2).groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg("risk_score").alias("avg_risk_score"),
        F.avg((F.col("recommended_action") == "BLOCK").cast("double")).alias("block_rate"))
    return rounded(out)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
