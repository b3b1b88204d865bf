"""SQL of the single operators."""

from __future__ import annotations

from riskloom.checks.views import (
    A_ASOF, ADD_ENGINE, ADD_GATEWAY, BUCKET, COUNTS, CUT, DAY_NAME, DOW, HOUR, LEVEL3, LEVEL4, M_ASOF,
    MODEL_SCORE, NIGHT, RULES_ENGINE, T_ASOF, WEEKEND, floors, pct)
from riskloom.checks.reports import FANOUT, REPORTS
from riskloom.ml.ensemble import weight_draws

T_COLS = "transaction_id, customer_id, merchant_id, amount, location, customer_age, transaction_timestamp, k"

# Columns of the warehouse tables that the test tables give, those they do not, and rows that take each default.
_STORED = {
    "customers": (
        "customer_id customer_segment registration_date",
        "first_name last_name email phone date_of_birth address_line1 address_line2 city state country postal_code last_login",
        {"is_active": "COUNT(*)", "risk_profile": "COUNT(*)", "created_at": "COUNT(*)", "updated_at": "COUNT(*)"}),
    "transactions": (
        "transaction_id customer_id merchant_id amount payment_method location_country location_region location_city transaction_timestamp",
        "transaction_type device_fingerprint ip_address latitude longitude processing_timestamp",
        {"currency": "COUNT(*)", "status": "COUNT(*)", "created_at": "COUNT(*)"}),
    "risk_assessments": (
        "assessment_id transaction_id customer_id risk_score risk_level confidence_score recommended_action processing_time_ms model_version",
        "features explanation business_rules_applied",
        {"assessment_timestamp": "COUNT(CASE WHEN assessment_timestamp IS NULL OR assessment_timestamp = TIMESTAMP '2024-01-01' THEN 1 END)",
         "created_at": "COUNT(*)"}),
    "merchants": (
        "merchant_id merchant_name merchant_category merchant_country", "merchant_region risk_score",
        {"is_high_risk": "COUNT(CASE WHEN is_high_risk THEN NULL ELSE 1 END)", "created_at": "COUNT(*)", "updated_at": "COUNT(*)"}),
    "model_performance": (
        "model_id model_name model_version accuracy precision_score recall_score f1_score auc_score feature_importance drift_score training_samples "
        "validation_samples training_duration_seconds", "confusion_matrix",
        {"created_at": "COUNT(CASE WHEN created_at IS NULL OR created_at = TIMESTAMP '2024-01-01' THEN 1 END)"}),
    "system_metrics": (
        "metric_id metric_name metric_value service_name", "metric_unit environment",
        {"metric_time": "COUNT(CASE WHEN metric_time IS NULL OR metric_time = TIMESTAMP '2024-01-01' THEN 1 END)"}),
}

SOURCES = {
    "read_table": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
    "read_by_extension": "SELECT metric_id, metric_name, ROUND(metric_value, 6) AS metric_value, service_name FROM system_metrics",
    "parse_transactions": "SELECT transaction_id, customer_id, amount, transaction_timestamp AS \"timestamp\", location, merchant_id, customer_age FROM transactions",
    "parse_quarantine": "SELECT transaction_id FROM transactions",
    "risk_event_sink": "SELECT transaction_id AS \"key\", transaction_id, risk_score, risk_level, assessment_timestamp AS \"timestamp\" FROM risk_assessments",
    "append_assessments": "SELECT assessment_id, transaction_id, 1.0::DOUBLE AS risk_score, 'HIGH' AS risk_level, assessment_timestamp + INTERVAL 60 SECOND AS assessment_timestamp FROM risk_assessments",
    "create_tables": """
SELECT customer_id, customer_segment, registration_date, TRUE AS is_active, 'MEDIUM' AS risk_profile,
  TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at, CAST(NULL AS VARCHAR) AS email FROM customers""",
    "create_tables_all": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) AS n_rows, {filled} AS n_filled, {default} AS n_default FROM {table}"
        for table, (given, absent, defaulted) in _STORED.items()
        for c, filled, default in [*[(c, f"COUNT({c})", "0") for c in given.split()], *[(c, "0", "0") for c in absent.split()],
                                   *[(c, "COUNT(*)", n) for c, n in defaulted.items()]]),
    "daily_summary_mv": REPORTS["q11_daily_summary"],
    "refresh_daily_summary": REPORTS["q11_daily_summary"],
    "write_overwrite": f"SELECT {T_COLS} FROM transactions",
    "export_json": "SELECT assessment_id, risk_score, risk_level FROM risk_assessments",
    "table_layout": f"SELECT {T_COLS}, CAST(transaction_timestamp AS DATE) AS event_date FROM transactions",
    "route_messages": "SELECT transaction_id AS \"transactionId\", risk_score AS \"riskScore\", risk_level AS \"riskLevel\" FROM risk_assessments",
    "route_notifications": "SELECT assessment_id AS id, recommended_action AS message FROM risk_assessments",
}

CLEANING = {
    "fill_defaults": f"SELECT transaction_id, customer_id, merchant_id, COALESCE(amount, 0.0) AS amount, location, COALESCE(customer_age, 30) AS customer_age, transaction_timestamp, k FROM transactions_dirty",
    "fill_zero_numeric": f"SELECT transaction_id, customer_id, merchant_id, COALESCE(amount, 0.0) AS amount, location, COALESCE(customer_age, 0) AS customer_age, transaction_timestamp, k FROM transactions_dirty",
    "cast_types": """
SELECT transaction_id, TRY_CAST(amount_text AS DOUBLE) AS amount, TRY_CAST(age_text AS INTEGER) AS customer_age
FROM (SELECT transaction_id, CASE WHEN k % 7 = 0 THEN 'n/a' ELSE CAST(k AS VARCHAR) || '.5' END AS amount_text,
  CASE WHEN k % 5 = 0 THEN 'old' ELSE CAST(customer_age AS VARCHAR) END AS age_text FROM transactions) s""",
    "drop_duplicates": f"SELECT DISTINCT {T_COLS} FROM transactions_dirty",
    "zscore_filter": f"""
SELECT {T_COLS}, ROUND(z, 6) AS amount_zscore
FROM (SELECT *, (amount - AVG(amount) OVER ()) / NULLIF(STDDEV(amount) OVER (), 0) AS z FROM transactions_dirty) s WHERE z < 3""",
    "zscore_two_sided": f"""
SELECT {T_COLS}, ROUND(z, 6) AS amount_zscore
FROM (SELECT *, (amount - AVG(amount) OVER ()) / NULLIF(STDDEV(amount) OVER (), 0) AS z FROM transactions_dirty) s WHERE abs(z) < 3""",
    "validate_rules": """
SELECT transaction_id, amount, customer_age, risk_score FROM (
  SELECT d.*, s.risk_score FROM transactions_dirty d JOIN scored s ON d.transaction_id = s.transaction_id) v
WHERE amount > 0 AND customer_age >= 18 AND customer_age <= 100 AND amount <= 1000000 AND risk_score >= 0 AND risk_score <= 1""",
    "validate_quarantine": """
SELECT transaction_id, amount, customer_age, risk_score, array_to_string(list_filter([
    CASE WHEN amount > 0 THEN NULL ELSE 'amount_positive' END,
    CASE WHEN customer_age >= 18 AND customer_age <= 100 THEN NULL ELSE 'age_in_range' END,
    CASE WHEN amount <= 1000000 THEN NULL ELSE 'amount_within_limit' END,
    CASE WHEN risk_score >= 0 AND risk_score <= 1 THEN NULL ELSE 'score_in_range' END], lambda x: x IS NOT NULL), ',') AS violations
FROM (SELECT d.*, s.risk_score FROM transactions_dirty d JOIN scored s ON d.transaction_id = s.transaction_id) v
WHERE NOT COALESCE(amount > 0 AND customer_age >= 18 AND customer_age <= 100 AND amount <= 1000000 AND risk_score >= 0 AND risk_score <= 1, FALSE)""",
    "request_required": """
SELECT transaction_id, amount, CASE WHEN transaction_id IS NULL OR transaction_id = '' THEN 'transaction_id'
  WHEN customer_id IS NULL OR customer_id = '' THEN 'customer_id' WHEN amount IS NULL OR amount = 0 THEN 'amount' END AS rejected_because
FROM transactions_dirty""",
    "default_timestamp": """
SELECT transaction_id, COALESCE(CASE WHEN k % 11 = 0 THEN NULL ELSE transaction_timestamp END, TIMESTAMP '2002-01-01') AS transaction_timestamp
FROM transactions""",
    "lookback_filter": f"SELECT {T_COLS} FROM transactions WHERE transaction_timestamp >= {T_ASOF} - INTERVAL 90 DAY",
    "time_range_filter": f"SELECT {T_COLS} FROM transactions WHERE transaction_timestamp BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'",
    "dashboard_filter": f"""
SELECT assessment_id, amount, risk_score, risk_level FROM enriched_assessments
WHERE assessment_timestamp BETWEEN {A_ASOF} - INTERVAL 8760 HOUR AND {A_ASOF} AND amount BETWEEN 0 AND 9000 AND risk_level = 'MEDIUM'""",
    "history_by_customer": """
SELECT assessment_id, customer_id, assessment_timestamp, risk_score, recency FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY assessment_timestamp DESC, assessment_id) AS INTEGER) AS recency
  FROM risk_assessments) h WHERE recency <= 5""",
}

_TRAIL = "FROM scored s LEFT JOIN scored h ON h.{key} = s.{key} AND h.transaction_timestamp < s.transaction_timestamp AND h.transaction_timestamp > s.transaction_timestamp - INTERVAL {days} DAY"
JOINS = {
    "join_txn_assessment": "SELECT t.transaction_id, t.customer_id, t.amount, a.assessment_id, a.risk_score, a.risk_level FROM transactions t JOIN risk_assessments a ON t.transaction_id = a.transaction_id",
    "join_merchant_3way": """
SELECT t.transaction_id, m.merchant_id, m.merchant_name, m.merchant_category, t.amount, a.risk_score
FROM merchants m JOIN transactions t ON m.merchant_id = t.merchant_id JOIN risk_assessments a ON t.transaction_id = a.transaction_id""",
    "join_customer_fanout": FANOUT,
    "join_customer_features": """
SELECT t.transaction_id, t.amount, f.total_transactions, ROUND(f.avg_amount, 6) AS avg_amount, ROUND(t.amount / NULLIF(f.avg_amount, 0), 6) AS amount_ratio
FROM transactions t JOIN (SELECT customer_id, COUNT(*) AS total_transactions, AVG(amount) AS avg_amount FROM transactions GROUP BY 1) f
  ON t.customer_id = f.customer_id""",
    "join_location_features": """
SELECT t.transaction_id, t.location, f.location_transaction_count, ROUND(f.location_avg_amount, 6) AS location_avg_amount,
  CASE WHEN location_transaction_count < 10 THEN 0.8::DOUBLE WHEN location_transaction_count < 100 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS location_risk_score
FROM transactions t JOIN (SELECT location, COUNT(*) AS location_transaction_count, AVG(amount) AS location_avg_amount FROM transactions GROUP BY 1) f
  ON t.location = f.location""",
    "lookup_left": """
SELECT t.transaction_id, t.location, f.location_avg_amount
FROM transactions t LEFT JOIN (SELECT location, ROUND(AVG(amount), 6) AS location_avg_amount FROM transactions GROUP BY 1) f ON t.location = f.location""",
    "trailing_features": f"""
SELECT s.transaction_id, COUNT(h.transaction_id) AS customer_count, ROUND(AVG(h.amount), 6) AS customer_avg_amount, ROUND(AVG(h.risk_score), 6) AS customer_avg_score
{_TRAIL.format(key='customer_id', days=30)} GROUP BY s.transaction_id""",
    "trailing_location": f"""
SELECT s.transaction_id, COUNT(h.transaction_id) AS location_count, ROUND(AVG(h.risk_score), 6) AS location_avg_score
{_TRAIL.format(key='location', days=7)} GROUP BY s.transaction_id""",
    "active_model_asof": """
SELECT a.assessment_id, a.assessment_timestamp, u.new_model_id AS active_model
FROM risk_assessments a ASOF LEFT JOIN model_updates u ON a.assessment_timestamp >= u.event_time""",
    "json_lateral": """
SELECT model_id, feature_name, CAST(json_extract_string(feature_importance, '$.' || feature_name) AS DOUBLE) AS importance
FROM (SELECT model_id, feature_importance, UNNEST(json_keys(feature_importance)) AS feature_name FROM model_performance) e""",
}

_HIGHS = "COUNT(CASE WHEN risk_level = 'HIGH' THEN 1 END)"
AGGREGATES = {
    "agg_basic": """
SELECT location_country, COUNT(*) AS n, COUNT(customer_age) AS n_age, ROUND(SUM(amount), 6) AS sum_amount, ROUND(AVG(amount), 6) AS avg_amount,
  MIN(amount) AS min_amount, MAX(amount) AS max_amount FROM transactions GROUP BY 1""",
    "agg_conditional_count": f"SELECT customer_id, {COUNTS} FROM risk_assessments GROUP BY 1",
    "agg_distinct": "SELECT location_region, COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT merchant_id) AS merchants, COUNT(DISTINCT location) AS locations FROM transactions GROUP BY 1",
    "agg_stddev_var": "SELECT customer_id, ROUND(STDDEV(amount), 6) AS sd, ROUND(VARIANCE(amount), 3) AS var FROM transactions GROUP BY 1",
    "agg_ratio": f"SELECT customer_id, {pct(_HIGHS, 'COUNT(*)')} AS high_risk_percentage FROM risk_assessments GROUP BY 1",
    "agg_having": "SELECT customer_id, COUNT(*) AS n FROM transactions GROUP BY 1 HAVING COUNT(*) >= 10",
    "agg_two_level": """
SELECT customer_segment, COUNT(*) AS customers, ROUND(AVG(n), 6) AS avg_transactions, ROUND(AVG(total), 6) AS avg_total
FROM (SELECT c.customer_id, c.customer_segment, COUNT(*) AS n, SUM(t.amount) AS total FROM customers c JOIN transactions t ON c.customer_id = t.customer_id GROUP BY 1, 2) p
GROUP BY 1""",
    "agg_group_expr": f"""
SELECT DATE_TRUNC('month', transaction_timestamp) AS "month", {HOUR} AS "hour", CASE WHEN amount > 10000 THEN 'LARGE' ELSE 'SMALL' END AS size, COUNT(*) AS n
FROM transactions GROUP BY 1, 2, 3""",
    "customer_features": """
SELECT customer_id, COUNT(*) AS total_transactions, ROUND(SUM(amount), 6) AS total_amount, ROUND(AVG(amount), 6) AS avg_amount, MAX(amount) AS max_amount,
  MIN(amount) AS min_amount, ROUND(STDDEV(amount), 6) AS amount_std, COUNT(DISTINCT merchant_id) AS unique_merchants, COUNT(DISTINCT location) AS unique_locations
FROM transactions GROUP BY 1""",
    "location_features": "SELECT location, COUNT(*) AS location_transaction_count, ROUND(AVG(amount), 6) AS location_avg_amount FROM transactions GROUP BY 1",
    "risk_statistics": REPORTS["q15_statistics"],
    "service_rates": """
SELECT service_name, n AS total_requests, ok AS successful_requests, n - ok AS failed_requests, ROUND(ok * 100.0::DOUBLE / n, 4) AS success_rate,
  ROUND((n - ok) * 100.0::DOUBLE / n, 4) AS error_rate, ROUND(hits * 100.0::DOUBLE / n, 4) AS cache_hit_rate, ROUND(n / span, 6) AS requests_per_second
FROM (SELECT service_name, COUNT(*) AS n, COUNT(CASE WHEN metric_name <> 'error_rate' THEN 1 END) AS ok, COUNT(CASE WHEN metric_value < 10 THEN 1 END) AS hits,
    (epoch_us(MAX(metric_time)) - epoch_us(MIN(metric_time))) / 1000000.0::DOUBLE AS span FROM system_metrics GROUP BY 1) s""",
    "quantiles": """
SELECT q, ROUND(CASE q WHEN 0.25 THEN a WHEN 0.5 THEN b WHEN 0.75 THEN c WHEN 0.99 THEN d END, 6) AS quantile
FROM (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.5) AS b, quantile_cont(amount, 0.75) AS c, quantile_cont(amount, 0.99) AS d FROM transactions_dirty) s,
  (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.99::DOUBLE)) v(q)""",
    "ewma": """
SELECT service_name, ROUND(SUM(0.1 * pow(0.9::DOUBLE, r) * metric_value), 6) AS ewma
FROM (SELECT service_name, metric_value, ROW_NUMBER() OVER (PARTITION BY service_name ORDER BY metric_time DESC, metric_id DESC) - 1 AS r
  FROM system_metrics WHERE metric_value IS NOT NULL) s GROUP BY 1""",
    "win_lag": """
SELECT model_id, ROUND(LAG(accuracy) OVER (PARTITION BY model_name ORDER BY created_at, model_version), 6) AS prev_accuracy,
  ROUND(LAG(f1_score) OVER (PARTITION BY model_name ORDER BY created_at, model_version), 6) AS prev_f1_score FROM model_performance""",
    "win_row_number_topn": """
SELECT transaction_id, location_city, amount, rank FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY location_city ORDER BY amount DESC, transaction_id) AS INTEGER) AS rank FROM transactions) r WHERE rank <= 20""",
    "win_total_share": f"SELECT payment_method, n, {pct('n', 'total')} AS share FROM (SELECT payment_method, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM transactions GROUP BY 1) s",
    "win_global_stats": """
SELECT transaction_id, ROUND((amount - AVG(amount) OVER ()) / STDDEV(amount) OVER (), 6) AS amount_zscore FROM transactions""",
    "sort_multi": "SELECT location_country, payment_method, n, amount FROM (SELECT location_country, payment_method, COUNT(*) AS n, ROUND(SUM(amount), 6) AS amount FROM transactions GROUP BY 1, 2) s ORDER BY n DESC, location_country",
    "top_locations": """
SELECT location, transaction_count, ROUND(avg_risk_score, 6) AS avg_risk_score FROM (
  SELECT location, COUNT(*) AS transaction_count, AVG(risk_score) AS avg_risk_score FROM scored WHERE location IS NOT NULL GROUP BY 1
  ORDER BY avg_risk_score DESC, transaction_count DESC, location LIMIT 50) s""",
    "latest_n": "SELECT assessment_id, assessment_timestamp, risk_score FROM risk_assessments ORDER BY assessment_timestamp DESC, assessment_id LIMIT 100",
    "topk_importance": """
SELECT feature, ROUND(importance, 6) AS importance FROM (
  SELECT model_id || '/' || key AS feature, CAST(json_extract_string(feature_importance, '$.' || key) AS DOUBLE) AS importance
  FROM (SELECT model_id, feature_importance, UNNEST(json_keys(feature_importance)) AS key FROM model_performance) e) s
ORDER BY importance DESC, feature LIMIT 10""",
    "sort_by_time": "SELECT assessment_id, assessment_timestamp, risk_score FROM risk_assessments ORDER BY assessment_timestamp, assessment_id",
}

SCALARS = {
    "amount_transforms": "SELECT transaction_id, ROUND(ln(amount + 1), 6) AS amount_log, ROUND(sqrt(amount), 6) AS amount_sqrt, ROUND(amount * amount, 2) AS amount_squared, ROUND(amount * amount * amount / 1e6, 2) AS amount_cubed FROM transactions",
    "calendar_features": f"SELECT transaction_id, {HOUR} AS hour, {DOW} AS day_of_week, CAST(extract(month FROM transaction_timestamp) AS INTEGER) AS month, CAST({WEEKEND} AS INTEGER) AS is_weekend, CAST({NIGHT} AS INTEGER) AS is_night FROM transactions",
    "age_features": "SELECT transaction_id, CAST(customer_age < 25 AS INTEGER) AS is_young, CAST(customer_age > 65 AS INTEGER) AS is_senior FROM transactions",
    "interaction_features": """
SELECT transaction_id, ROUND(amount / NULLIF(customer_age, 0), 6) AS amount_age_ratio, ROUND(amount / NULLIF(total_transactions, 0), 6) AS amount_frequency_ratio,
  ROUND(amount / NULLIF(avg_amount, 0), 6) AS amount_ratio
FROM (SELECT *, COUNT(*) OVER (PARTITION BY customer_id) AS total_transactions, AVG(amount) OVER (PARTITION BY customer_id) AS avg_amount FROM transactions) s""",
    "round_half_up": "SELECT transaction_id, ROUND(amount, 0) AS r0, ROUND(base_score, 3) AS r3 FROM scored",
    "coalesce_delta": """
SELECT model_id, ROUND(accuracy - COALESCE(prev, accuracy), 6) AS accuracy_change
FROM (SELECT *, LAG(accuracy) OVER (PARTITION BY model_name ORDER BY created_at, model_version) AS prev FROM model_performance) s""",
    "date_functions": f"SELECT transaction_id, DATE_TRUNC('hour', transaction_timestamp) AS ts_hour, CAST(transaction_timestamp AS DATE) AS ts_date, {HOUR} AS hour_of_day, {DOW} AS day_of_week, transaction_timestamp - INTERVAL 7 DAY AS week_earlier FROM transactions",
    "case_day_name": f"SELECT transaction_id, {DAY_NAME.format('transaction_timestamp')} AS day_name FROM transactions",
    "score_bucket": f"SELECT assessment_id, {BUCKET} AS bucket FROM (SELECT assessment_id, CASE WHEN processing_time_ms = 50 THEN NULL ELSE risk_score END AS risk_score FROM risk_assessments) s",
    "cut_levels": f"SELECT assessment_id, {CUT} AS level FROM (SELECT assessment_id, risk_score * 1.2 AS risk_score FROM risk_assessments) s",
    "string_predicates": "SELECT transaction_id, customer_id LIKE 'NEW%' AS is_new_customer, location LIKE '%HIGH_RISK%' AS is_high_risk_location, FALSE AS is_csv_or_json FROM transactions",
    "clamp": "SELECT transaction_id, CASE WHEN amount IS NOT NULL THEN greatest(0.0, least(1.0, amount / 5000 - 0.5)) END AS clamped FROM transactions_dirty",
    "json_functions": """
SELECT model_id, key, CAST(json_extract_string(feature_importance, '$.' || key) AS DOUBLE) AS value
FROM (SELECT model_id, feature_importance, UNNEST(json_keys(feature_importance)) AS key FROM model_performance) e""",
    "map_array_features": f"""
SELECT transaction_id, amount, {HOUR}::DOUBLE AS hour, CAST(customer_age AS DOUBLE) AS customer_age, CASE WHEN customer_age IS NULL THEN 3 ELSE 6 END AS n_features,
  array_to_string(list_filter([CASE WHEN {NIGHT} THEN 'NIGHT' END, CASE WHEN {WEEKEND} THEN 'WEEKEND' END, CASE WHEN customer_age < 25 THEN 'YOUNG' END,
    CASE WHEN customer_age > 65 THEN 'SENIOR' END], lambda x: x IS NOT NULL), ',') AS flags
FROM transactions""",
}

_CONF = "CASE WHEN {m} IS NOT NULL THEN 0.8::DOUBLE ELSE {c}::DOUBLE END"
_ACTION4 = "CASE risk_level WHEN 'CRITICAL' THEN 'ESCALATE' WHEN 'HIGH' THEN 'BLOCK' WHEN 'MEDIUM' THEN 'REVIEW' WHEN 'LOW' THEN 'APPROVE' ELSE 'REVIEW' END"
_NAIVE = """least(1.0::DOUBLE, CASE WHEN amount > 10000 THEN 0.7::DOUBLE WHEN amount IS NOT NULL THEN 0.3::DOUBLE END
  + CASE WHEN customer_id LIKE 'NEW%' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN location LIKE '%HIGH_RISK%' THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END)"""
NAIVE = f"CASE WHEN amount IS NOT NULL THEN {_NAIVE} END"
SCORING = {
    "naive_risk_score": f"SELECT transaction_id, ROUND(risk_score, 6) AS risk_score, {LEVEL3} AS risk_level FROM (SELECT transaction_id, {NAIVE} AS risk_score FROM transactions_dirty) s",
    "rules_max": f"SELECT transaction_id, {floors('base_score')} AS risk_score, array_to_string({RULES_ENGINE}, ',') AS rules FROM (SELECT k, transaction_id, amount, customer_id, customer_age, transaction_timestamp, base_score FROM scored) s",
    "rules_max_service": f"""
SELECT transaction_id, {floors('base_score', True)} AS risk_score, array_to_string(list_filter([CASE WHEN amount > 10000 THEN 'HIGH_AMOUNT_THRESHOLD' END,
  CASE WHEN customer_id LIKE 'NEW%' THEN 'NEW_CUSTOMER' END, CASE WHEN {HOUR} < 6 OR {HOUR} > 22 THEN 'UNUSUAL_TIME' END,
  CASE WHEN location LIKE '%HIGH_RISK%' THEN 'HIGH_RISK_LOCATION' END], lambda x: x IS NOT NULL), ',') AS rules
FROM (SELECT transaction_id, amount, customer_id, location, transaction_timestamp, base_score FROM scored) s""",
    "rules_additive": f"SELECT transaction_id, ROUND({ADD_ENGINE}, 6) AS risk_score FROM transactions",
    "rules_additive_gateway": f"SELECT transaction_id, ROUND({ADD_GATEWAY}, 6) AS risk_score FROM transactions",
    "score_with_fallback": f"""
SELECT transaction_id, ROUND(COALESCE({MODEL_SCORE}, {ADD_GATEWAY}), 6) AS base_score, {_CONF.format(m=MODEL_SCORE, c=0.7)} AS confidence
FROM (SELECT k, transaction_id, amount, customer_age, transaction_timestamp, base_score FROM scored) s""",
    "error_policy": f"""
SELECT transaction_id, CASE WHEN bad THEN 0.5 ELSE ROUND(risk_score, 6) END AS risk_score, CASE WHEN bad THEN 'MEDIUM' ELSE {LEVEL3} END AS risk_level,
  CASE WHEN bad THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence
FROM (SELECT transaction_id, COALESCE(amount <= 0, TRUE) AS bad, {NAIVE} AS risk_score FROM transactions_dirty) s""",
    "error_policy_drop": f"""
SELECT transaction_id, ROUND(risk_score, 6) AS risk_score FROM (SELECT transaction_id, COALESCE(amount <= 0, TRUE) AS bad, {NAIVE} AS risk_score FROM transactions_dirty) s WHERE NOT bad""",
    "risk_level": f"""
SELECT transaction_id, {LEVEL3} AS three_level, {LEVEL4} AS four_level,
  CASE WHEN risk_score > 0.8 THEN 'CRITICAL' WHEN risk_score > 0.6 THEN 'HIGH' WHEN risk_score > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS merchant_level, {CUT} AS cut_level
FROM scored""",
    "recommended_action": f"SELECT transaction_id, {_ACTION4} AS action FROM (SELECT transaction_id, {LEVEL4} AS risk_level FROM scored) s",
    "location_risk": """
SELECT location, CASE WHEN n < 10 THEN 0.8::DOUBLE WHEN n < 100 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS location_risk
FROM (SELECT location, COUNT(*) AS n FROM transactions GROUP BY 1) s""",
    "decision_path": f"""
SELECT transaction_id, array_to_string(list_filter([CASE WHEN amount > 10000 THEN 'High amount detected' END, CASE WHEN {NIGHT} THEN 'Transaction during night hours' END,
  CASE WHEN {WEEKEND} THEN 'Weekend transaction' END, 'Final risk score: ' || printf('%.3f', risk_score)], lambda x: x IS NOT NULL), ' | ') AS decision_path
FROM (SELECT transaction_id, amount, transaction_timestamp, round(risk_score * 1000) / 1000 AS risk_score FROM scored) s""",
    "score_batch": f"""
SELECT transaction_id, ROUND(risk_score, 6) AS risk_score, confidence, rules, risk_level, {_ACTION4} AS recommended_action FROM (
  SELECT *, {LEVEL4} AS risk_level FROM (
    SELECT transaction_id, {floors(f'COALESCE({MODEL_SCORE}, {ADD_ENGINE})')} AS risk_score, {_CONF.format(m=MODEL_SCORE, c=0.5)} AS confidence, array_to_string({RULES_ENGINE}, ',') AS rules
    FROM (SELECT k, transaction_id, amount, customer_id, customer_age, transaction_timestamp, base_score FROM scored) s) a) b""",
    "score_batch_service": f"""
SELECT transaction_id, ROUND(risk_score, 6) AS risk_score, {LEVEL3} AS risk_level, CASE WHEN risk_score >= 0.8 THEN 'BLOCK' WHEN risk_score >= 0.5 THEN 'REVIEW' ELSE 'APPROVE' END AS recommended_action
FROM (SELECT transaction_id, {floors('base_score', True)} AS risk_score FROM (SELECT transaction_id, amount, customer_id, location, transaction_timestamp, base_score FROM scored) s) a""",
    "score_batch_gateway": f"""
SELECT transaction_id, ROUND(risk_score, 6) AS risk_score, {LEVEL3} AS risk_level, CASE WHEN risk_score >= 0.8 THEN 'BLOCK' WHEN risk_score >= 0.5 THEN 'REVIEW' ELSE 'APPROVE' END AS recommended_action, 0.7::DOUBLE AS confidence
FROM (SELECT transaction_id, {ADD_GATEWAY} AS risk_score FROM transactions) a""",
}

_DCOLS = ["transaction_id", "customer_id", "merchant_id", "amount", "location", "customer_age", "transaction_timestamp", "k"]
_NULLS = " + ".join(f"COUNT(CASE WHEN {c} IS NULL THEN 1 END)" for c in _DCOLS)
_DISTINCT = "(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM transactions_dirty) d)"


def _iqr(col: str) -> str:
    return f"""(SELECT COUNT(*) FROM transactions_dirty, (SELECT quantile_cont({col}::DOUBLE, 0.25) AS q1, quantile_cont({col}::DOUBLE, 0.75) AS q3 FROM transactions_dirty) q
  WHERE {col} < q1 - 1.5 * (q3 - q1) OR {col} > q3 + 1.5 * (q3 - q1))"""


def _box(col: str) -> str:
    return f"""SELECT '{col}' AS "column", ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
  ROUND(MIN(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_low,
  ROUND(MAX(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_high,
  COUNT(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers
FROM (SELECT {col}::DOUBLE AS v FROM transactions_dirty WHERE {col} IS NOT NULL) r, (SELECT quantile_cont({col}::DOUBLE, 0.25) AS q1, quantile_cont({col}::DOUBLE, 0.5) AS median, quantile_cont({col}::DOUBLE, 0.75) AS q3 FROM transactions_dirty) q
GROUP BY q1, median, q3"""


QUALITY = {
    "dq_profile": f"""
SELECT total_records, total_records - distinct_records AS duplicate_count, ROUND((total_records - nulls) / total_records, 6) AS completeness,
  ROUND(distinct_records / total_records, 6) AS uniqueness, ROUND(1 - nulls / (total_records * 8), 6) AS cell_completeness,
  (total_records - nulls) / total_records > 0.95 AND distinct_records / total_records > 0.99 AS passed, null_amounts, null_locations
FROM (SELECT COUNT(*) AS total_records, {_DISTINCT} AS distinct_records, {_NULLS} AS nulls, COUNT(CASE WHEN amount IS NULL THEN 1 END) AS null_amounts,
  COUNT(CASE WHEN location IS NULL THEN 1 END) AS null_locations FROM transactions_dirty) s""",
    "dq_profile_cells": f"""
SELECT total_rows, 8 AS total_columns, missing_values, ROUND(missing_values * 100.0::DOUBLE / (total_rows * 8), 6) AS missing_percentage, total_rows - d AS duplicate_rows,
  ROUND((total_rows - d) * 100.0::DOUBLE / total_rows, 6) AS duplicate_percentage, ROUND(ages * 100.0::DOUBLE / total_rows, 6) AS missing_age_percentage
FROM (SELECT COUNT(*) AS total_rows, {_NULLS} AS missing_values, {_DISTINCT} AS d, COUNT(CASE WHEN customer_age IS NULL THEN 1 END) AS ages FROM transactions_dirty) s""",
    "dq_iqr_outliers": f"SELECT {_iqr('amount')} + {_iqr('customer_age')} + {_iqr('k')} AS outliers_count",
    "dq_box_stats": " UNION ALL ".join(map(_box, ("amount", "customer_age"))),
    "dq_assessments": REPORTS["q12_dq_assessments"],
    "dq_transactions": REPORTS["q13_dq_transactions"],
    "dq_pk": 'SELECT transaction_id, COUNT(*) AS "rows" FROM transactions_dirty GROUP BY 1 HAVING COUNT(*) > 1',
    "dq_fk": """
SELECT 'transactions.customer_id' AS relation, COUNT(*) AS orphans FROM transactions WHERE customer_id NOT IN (SELECT customer_id FROM customers)
UNION ALL SELECT 'transactions.merchant_id', COUNT(*) FROM transactions WHERE merchant_id NOT IN (SELECT merchant_id FROM merchants)
UNION ALL SELECT 'risk_assessments.transaction_id', COUNT(*) FROM risk_assessments WHERE transaction_id NOT IN (SELECT transaction_id FROM transactions)
UNION ALL SELECT 'risk_assessments.customer_id', COUNT(*) FROM risk_assessments WHERE customer_id NOT IN (SELECT customer_id FROM customers)
UNION ALL SELECT 'transactions.customer_id, risky only', COUNT(*) FROM transactions WHERE customer_id NOT IN (SELECT customer_id FROM risk_assessments WHERE risk_score >= 0.5)""",
    "dq_missing_pattern": 'SELECT ' + " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _DCOLS) + ' AS pattern, COUNT(*) AS "rows" FROM transactions_dirty GROUP BY 1',
    "data_summary": "SELECT COUNT(*) AS \"rows\", 8 AS columns, 'transaction_id,customer_id,merchant_id,amount,location,customer_age,transaction_timestamp,k' AS column_names FROM transactions_dirty",
}

_FEATURE_ROWS = f"""
SELECT s.transaction_id, {HOUR} AS hour, {DOW} + 1 AS day_of_week, CAST({WEEKEND} AS INTEGER) AS is_weekend, CAST({NIGHT} AS INTEGER) AS is_night,
  ROUND(ln(amount + 1), 6) AS amount_log, c.n AS customer_transaction_count, ROUND(c.a, 6) AS customer_avg_amount, ROUND(c.r, 6) AS customer_risk_history,
  l.n AS location_transaction_count, ROUND(l.a, 6) AS location_avg_amount, ROUND(amount / NULLIF(customer_age, 0), 6) AS amount_age_ratio,
  ROUND(amount / c.n, 6) AS amount_frequency_ratio
FROM scored s LEFT JOIN (SELECT customer_id, COUNT(*) AS n, AVG(amount) AS a, AVG(risk_score) AS r FROM scored GROUP BY 1) c ON s.customer_id = c.customer_id
LEFT JOIN (SELECT location, COUNT(*) AS n, AVG(amount) AS a FROM scored GROUP BY 1) l ON s.location = l.location"""
_ONLINE = f"""
SELECT s.transaction_id, ANY_VALUE(s.amount) AS amount, ROUND(ANY_VALUE(CASE WHEN s.amount > 0 THEN ln(s.amount) END), 6) AS amount_log,
  COUNT(DISTINCT h.transaction_id)::DOUBLE AS customer_transaction_count, ROUND(AVG(h.amount), 6) AS customer_avg_amount, ANY_VALUE(lc.n)::DOUBLE AS location_transaction_count,
  ROUND(ANY_VALUE(lc.r), 6) AS location_risk_score, ANY_VALUE(s.customer_age)::DOUBLE AS customer_age
{_TRAIL.format(key='customer_id', days=30)}
LEFT JOIN (SELECT s.transaction_id, CASE WHEN ANY_VALUE(s.location) IS NULL THEN NULL ELSE COUNT(h.transaction_id) END AS n, AVG(h.risk_score) AS r
  {_TRAIL.format(key='location', days=7)} GROUP BY s.transaction_id) lc ON lc.transaction_id = s.transaction_id
GROUP BY s.transaction_id"""
_PR = """SELECT base_score AS threshold, SUM(risk_label) OVER w AS tp, SUM(1 - risk_label) OVER w AS fp, SUM(risk_label) OVER () AS p, SUM(risk_label) OVER () AS total FROM scored
  WINDOW w AS (ORDER BY base_score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_PSI_EDGES = "(SELECT quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM transactions WHERE transaction_timestamp < TIMESTAMP '1998-01-01')"
_BIAS_ROWS = """SELECT 'location_region' AS attribute, location_region AS value, risk_label AS y, CAST(base_score > 0.5 AS INTEGER) AS p FROM scored
  UNION ALL SELECT 'payment_method', payment_method, risk_label, CAST(base_score > 0.5 AS INTEGER) FROM scored"""
_PRED = "SELECT transaction_id, risk_score AS label, base_score AS model_a, 1 - base_score AS model_b, (base_score + 0.5) / 2 AS model_c FROM scored"


def _reg(m: str) -> str:
    return f"SELECT '{m}' AS model, ROUND(sqrt(AVG((label - {m}) * (label - {m}))), 6) AS rmse, ROUND(AVG(abs(label - {m})), 6) AS mae, ROUND(pow(corr(label, {m}), 2), 6) AS r_squared FROM ({_PRED}) p"


MODELS = {
    "feature_matrix": _FEATURE_ROWS,
    "engineer_features": f"""
SELECT s.transaction_id, c.n AS total_transactions, ROUND(c.s, 6) AS total_amount, ROUND(c.sd, 6) AS amount_std, c.m AS unique_merchants, c.l AS unique_locations,
  ROUND(s.amount / NULLIF(c.a, 0), 6) AS amount_ratio, l.n AS location_transaction_count, CASE WHEN l.n < 10 THEN 0.8::DOUBLE WHEN l.n < 100 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS location_risk_score,
  {HOUR} AS hour, {DOW} + 1 AS day_of_week
FROM transactions s JOIN (SELECT customer_id, COUNT(*) AS n, SUM(amount) AS s, AVG(amount) AS a, STDDEV(amount) AS sd, COUNT(DISTINCT merchant_id) AS m, COUNT(DISTINCT location) AS l
  FROM transactions GROUP BY 1) c ON s.customer_id = c.customer_id JOIN (SELECT location, COUNT(*) AS n FROM transactions GROUP BY 1) l ON s.location = l.location""",
    "online_features": _ONLINE,
    "batch_process": f"""
WITH d AS (SELECT DISTINCT transaction_id, customer_id, merchant_id, COALESCE(amount, 0.0) AS amount, location, COALESCE(customer_age, 30) AS customer_age, transaction_timestamp, k FROM transactions_dirty),
z AS (SELECT * FROM (SELECT *, (amount - AVG(amount) OVER ()) / NULLIF(STDDEV(amount) OVER (), 0) AS amount_zscore FROM d) q WHERE amount_zscore < 3),
f AS (SELECT z.*, c.n AS total_transactions, c.a AS avg_amount, l.n AS location_transaction_count FROM z
  JOIN (SELECT customer_id, COUNT(*) AS n, AVG(amount) AS a FROM z GROUP BY 1) c ON z.customer_id = c.customer_id
  JOIN (SELECT location, COUNT(*) AS n FROM z GROUP BY 1) l ON z.location = l.location)
SELECT transaction_id, amount, customer_age, ROUND(amount_zscore, 6) AS amount_zscore, total_transactions, ROUND(amount / NULLIF(avg_amount, 0), 6) AS amount_ratio, location_transaction_count,
  ROUND(risk_score, 6) AS risk_score, {LEVEL3} AS risk_level
FROM (SELECT *, {NAIVE} AS risk_score FROM f) s WHERE amount > 0 AND customer_age >= 18 AND customer_age <= 100 AND amount <= 1000000 AND risk_score BETWEEN 0 AND 1""",
    "regression_metrics": " UNION ALL ".join(map(_reg, ("model_a", "model_b", "model_c"))),
    "model_comparison": f"SELECT model, rmse, r_squared FROM ({' UNION ALL '.join(map(_reg, ('model_a', 'model_b', 'model_c')))}) m",
    "prediction_vs_actual": f"SELECT label AS actual, model_a AS predicted FROM ({_PRED}) p",
    "ensemble_weighted": f"""
SELECT transaction_id, ROUND(p, 6) AS ensemble_probability, CAST(ROUND(p, 8) > 0.5 AS INTEGER) AS ensemble_prediction FROM (
  SELECT transaction_id, (0.4 * model_a + 0.3 * model_b + 0.3 * model_c) / 1.0 AS p FROM ({_PRED}) q) s""",
    "ensemble_mean": f"SELECT transaction_id, ROUND((model_a + model_b + model_c) / 3, 6) AS ensemble FROM ({_PRED}) q",
    "auc_exact": """
SELECT ROUND(SUM(CASE WHEN risk_label = 1 THEN r END) / (p * n) - (p + 1) / (2.0 * n), 6) AS auc, p AS positives, n AS negatives
FROM (SELECT risk_label, (RANK() OVER (ORDER BY base_score) + (COUNT(*) OVER (PARTITION BY base_score) - 1) / 2.0) AS r,
    SUM(risk_label) OVER () AS p, SUM(1 - risk_label) OVER () AS n FROM scored) s GROUP BY p, n""",
    "pr_curve": f"SELECT DISTINCT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / p, 6) AS recall FROM ({_PR}) s",
    "classification_metrics": """
SELECT n, tp, fp, tn, fn, ROUND((tp + tn) / n, 6) AS accuracy, ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / (tp + fn), 6) AS recall, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS f1_score
FROM (SELECT COUNT(*) AS n, COUNT(CASE WHEN risk_label = 1 AND base_score > 0.5 THEN 1 END) AS tp, COUNT(CASE WHEN risk_label = 0 AND base_score > 0.5 THEN 1 END) AS fp,
  COUNT(CASE WHEN risk_label = 0 AND base_score <= 0.5 THEN 1 END) AS tn, COUNT(CASE WHEN risk_label = 1 AND base_score <= 0.5 THEN 1 END) AS fn FROM scored) s""",
    "feature_importance": """
SELECT key AS feature, ROUND(SUM(v * CASE model_name WHEN 'model_0' THEN 0.4 WHEN 'model_1' THEN 0.3 WHEN 'model_2' THEN 0.2 WHEN 'model_3' THEN 0.1 ELSE 0 END), 6) AS importance
FROM (SELECT model_name, key, CAST(json_extract_string(feature_importance, '$.' || key) AS DOUBLE) AS v FROM (SELECT model_name, feature_importance, UNNEST(json_keys(feature_importance)) AS key FROM model_performance) e) s
GROUP BY 1""",
    "model_health": """
SELECT model_name, model_version, ROUND(accuracy, 6) AS accuracy, created_at, COALESCE(accuracy < 0.85, TRUE) AS needs_retraining
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_name ORDER BY created_at DESC, model_version DESC) AS r FROM model_performance) s WHERE r = 1""",
    "drift_psi": f"""
WITH e AS (SELECT {_PSI_EDGES} AS edges),
r AS (SELECT CASE WHEN transaction_timestamp < TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END AS is_base, len(list_filter(edges, lambda x: x < amount)) AS bin FROM transactions, e)
SELECT CAST(bin AS INTEGER) AS bin, ROUND(a, 6) AS base_share, ROUND(b, 6) AS current_share, ROUND((b - a) * ln(b / a), 6) AS psi FROM (
  SELECT bin, greatest(SUM(is_base) / (SELECT SUM(is_base) FROM r), 1e-6) AS a, greatest(SUM(1 - is_base) / (SELECT SUM(1 - is_base) FROM r), 1e-6) AS b FROM r GROUP BY bin) s""",
    "shap_linear": """
SELECT transaction_id, 'amount' AS feature, ROUND(0.0001 * (amount - AVG(amount) OVER ()), 6) AS contribution FROM scored
UNION ALL SELECT transaction_id, 'base_score', ROUND(-1.5 * (base_score - AVG(base_score) OVER ()), 6) FROM scored""",
    "bias_baseline": "SELECT ROUND(AVG(risk_label), 6) AS overall_positive_rate, ROUND(1 - AVG(risk_label), 6) AS overall_negative_rate FROM scored",
    "bias_groups": f"""
SELECT attribute, value, COUNT(*) AS n, ROUND(AVG(y), 6) AS positive_rate, ROUND(AVG(p), 6) AS prediction_rate, ROUND(COALESCE(AVG(CASE WHEN y = 1 THEN p END), 0), 6) AS true_positive_rate,
  ROUND(COALESCE(AVG(CASE WHEN y = 0 THEN p END), 0), 6) AS false_positive_rate FROM ({_BIAS_ROWS}) b GROUP BY 1, 2""",
}

_STATS = "(SELECT MIN(amount) AS lo, MAX(amount) AS hi, AVG(amount) AS mean, MEDIAN(amount) AS median, COUNT(*) AS total, STDDEV(amount) AS sd, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) AS iqr FROM transactions) st"
STATISTICS = {
    "histogram": f"""
SELECT CAST(i AS INTEGER) AS bin, ROUND(ANY_VALUE(lo + i * (hi - lo) / 30), 6) AS lower, ROUND(ANY_VALUE(lo + (i + 1) * (hi - lo) / 30), 6) AS upper, COUNT(b) AS n,
  ROUND(COUNT(b) / ANY_VALUE(total * (hi - lo) / 30), 8) AS density, ROUND(ANY_VALUE(mean), 6) AS mean, ROUND(ANY_VALUE(median), 6) AS median
FROM range(30) g(i) CROSS JOIN {_STATS}
LEFT JOIN (SELECT least(floor((amount - lo) / ((hi - lo) / 30)), 29) AS b FROM transactions, {_STATS}) h ON h.b = g.i GROUP BY i""",
    "density_curve": f"""
WITH c AS (SELECT least(floor((amount - lo) / ((hi - lo) / 1000)), 999) AS bin, COUNT(*) AS n FROM transactions, {_STATS} GROUP BY 1),
p AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * pow(total, -0.2) AS h FROM {_STATS}),
g AS (SELECT i, lo - 3 * h + i * ((hi + 3 * h) - (lo - 3 * h)) / 511 AS x FROM range(512) r(i), p)
SELECT CAST(i AS INTEGER) AS i, ROUND(x, 6) AS x, ROUND(SUM(n * exp(-0.5 * pow((x - (lo + (bin + 0.5) * (hi - lo) / 1000)) / h, 2)) / sqrt(2 * pi()) / (total * h)), 8) AS density
FROM g, c, p GROUP BY i, x""",
    "correlation_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, " + ("MAX(1.0::DOUBLE)" if a == b else f"ROUND(corr({a}, {b}), 6)")
        + " AS value FROM scored WHERE amount IS NOT NULL AND customer_age IS NOT NULL AND risk_score IS NOT NULL"
        for a in ("amount", "customer_age", "risk_score") for b in ("amount", "customer_age", "risk_score")),
    "time_series": """
SELECT period, n, ROUND(value, 6) AS value, ROUND(AVG(value) OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smoothed
FROM (SELECT DATE_TRUNC('day', assessment_timestamp) AS period, COUNT(*) AS n, AVG(risk_score) AS value FROM risk_assessments GROUP BY 1) s""",
    "level_distribution": f"SELECT {CUT} AS risk_level, COUNT(*) AS n FROM risk_assessments GROUP BY 1",
    "linear_trend": "SELECT ROUND(regr_slope(risk_score, log10(amount)), 6) AS slope, ROUND(regr_intercept(risk_score, log10(amount)), 6) AS intercept, COUNT(*) AS n FROM scored WHERE amount > 0",
    "score_summary": """
SELECT MIN(risk_score) AS min, ROUND(quantile_cont(risk_score, 0.25), 6) AS q1, ROUND(MEDIAN(risk_score), 6) AS median, ROUND(AVG(risk_score), 6) AS mean,
  ROUND(quantile_cont(risk_score, 0.75), 6) AS q3, MAX(risk_score) AS max, ROUND(STDDEV(risk_score), 6) AS sd, ROUND(VARIANCE(risk_score), 6) AS variance FROM risk_assessments""",
}

_FILLS = """WITH RECURSIVE fills AS (
  SELECT location AS id, MIN(transaction_timestamp) AS t FROM transactions WHERE location IS NOT NULL GROUP BY 1
  UNION ALL
  SELECT id, nxt FROM (SELECT f.id, (SELECT MIN(x.transaction_timestamp) FROM transactions x WHERE x.location = f.id AND x.transaction_timestamp >= f.t + INTERVAL 5 DAY) AS nxt FROM fills f) s WHERE nxt IS NOT NULL)
"""
STREAMS = {
    "stream_misses_ttl": _FILLS + "SELECT id AS location, t AS transaction_timestamp FROM fills",
    "stream_with_snapshot": f"""
SELECT t.transaction_id, t.customer_id, h.transaction_count, h.avg_amount, h.risk_history FROM transactions t LEFT JOIN (
  SELECT customer_id, COUNT(*) AS transaction_count, ROUND(AVG(amount), 6) AS avg_amount, ROUND(AVG(risk_score), 6) AS risk_history
  FROM scored WHERE transaction_timestamp > {T_ASOF} - INTERVAL 365 DAY GROUP BY 1) h ON t.customer_id = h.customer_id""",
    "stream_score": f"SELECT transaction_id, ROUND(risk_score, 6) AS risk_score, {LEVEL3} AS risk_level FROM (SELECT transaction_id, {NAIVE} AS risk_score FROM transactions) s",
    "write_stream_append": f"""
SELECT transaction_id, ROUND(risk_score, 6) AS risk_score, {LEVEL3} AS risk_level FROM (SELECT transaction_id, {ADD_GATEWAY} AS risk_score FROM transactions) s""",
    "stream_dedup_ttl": "SELECT DISTINCT transaction_id FROM transactions_dirty",
    "stream_hourly_metrics": f"""
SELECT DATE_TRUNC('hour', assessment_timestamp) AS hour, {COUNTS}, ROUND(AVG(risk_score), 6) AS avg_risk_score, ROUND(AVG(processing_time_ms), 6) AS avg_processing_time,
  COUNT(CASE WHEN recommended_action = 'BLOCK' THEN 1 END) AS blocked_transactions
FROM risk_assessments GROUP BY 1 HAVING DATE_TRUNC('hour', assessment_timestamp) + INTERVAL 1 HOUR <= {A_ASOF} - INTERVAL 1 HOUR""",
    "stream_daily_summary": REPORTS["q11_daily_summary"],
    "stream_sliding_customer": f"""
SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, customer_id, COUNT(*) AS transaction_count, ROUND(AVG(amount), 6) AS avg_amount
FROM (SELECT customer_id, amount, DATE_TRUNC('day', transaction_timestamp) - to_days(CAST(i AS INTEGER)) AS window_start FROM transactions, range(30) r(i)) s
WHERE window_start + INTERVAL 30 DAY <= {T_ASOF} - INTERVAL 1 DAY GROUP BY 1, 2, 3""",
    "stream_alerts": f"""
SELECT hour, metric_name, ROUND(avg_value, 6) AS avg_value, 'HIGH_ERROR_RATE' AS alert_status FROM (
  SELECT DATE_TRUNC('hour', metric_time) AS hour, metric_name, AVG(metric_value) AS avg_value FROM system_metrics GROUP BY 1, 2) s
WHERE metric_name = 'error_rate' AND avg_value > 5 AND hour + INTERVAL 1 HOUR <= {M_ASOF} - INTERVAL 1 HOUR
UNION ALL SELECT hour, metric_name, ROUND(avg_value, 6), CASE metric_name WHEN 'cpu_usage' THEN 'HIGH_CPU' ELSE 'HIGH_MEMORY' END FROM (
  SELECT DATE_TRUNC('hour', metric_time) AS hour, metric_name, AVG(metric_value) AS avg_value FROM system_metrics GROUP BY 1, 2) s
WHERE metric_name IN ('cpu_usage', 'memory_usage') AND avg_value > 80 AND hour + INTERVAL 1 HOUR <= {M_ASOF} - INTERVAL 1 HOUR""",
    "metrics_gauge": f"""
SELECT DATE_TRUNC('day', assessment_timestamp) AS window_start, COUNT(CASE WHEN risk_score < 0.2 THEN 1 END) AS lowest, COUNT(CASE WHEN risk_score >= 0.8 THEN 1 END) AS highest,
  ROUND(AVG(processing_time_ms), 6) AS avg_processing_time, arg_max(risk_score, (assessment_timestamp, assessment_id)) AS last_score
FROM risk_assessments GROUP BY 1 HAVING DATE_TRUNC('day', assessment_timestamp) + INTERVAL 1 DAY <= {A_ASOF} - INTERVAL 1 HOUR""",
    "gap_fill_hours": f"""
SELECT CAST(i AS INTEGER) AS hours_ago, COUNT(a.metric_id) AS assessments, COUNT(CASE WHEN a.metric_name = 'error_rate' THEN 1 END) AS high_risk, ROUND(COALESCE(AVG(a.metric_value), 0), 6) AS average_risk_score
FROM range(24) g(i) LEFT JOIN system_metrics a ON a.metric_time >= {M_ASOF} - to_hours(CAST(i AS INTEGER) + 1) AND a.metric_time < {M_ASOF} - to_hours(CAST(i AS INTEGER)) GROUP BY i""",
    "batch_cache_hits": """
SELECT COUNT(*) AS total_requests, COUNT(*) FILTER (gap < INTERVAL 5 DAY) AS repeated_requests, ROUND(COUNT(*) FILTER (gap < INTERVAL 5 DAY) / COUNT(*), 6) AS repeat_rate
FROM (SELECT transaction_timestamp - LAG(transaction_timestamp) OVER (PARTITION BY location ORDER BY transaction_timestamp) AS gap FROM transactions WHERE location IS NOT NULL) s""",
}

_DRAWS = ", ".join(f"({i}, {', '.join(repr(float(x)) + '::DOUBLE' for x in row)})" for i, row in enumerate(weight_draws(3)))
_WEIGHTS = f"""
SELECT CAST(draw AS INTEGER) AS draw, ROUND(w0, 6) AS w0, ROUND(w1, 6) AS w1, ROUND(w2, 6) AS w2, ROUND(SUM(CASE WHEN y = 1 THEN r END) / (p * n) - (p + 1) / (2.0 * n), 6) AS auc
FROM (SELECT draw, w0, w1, w2, y, RANK() OVER (PARTITION BY draw ORDER BY s) + (COUNT(*) OVER (PARTITION BY draw, s) - 1) / 2.0 AS r,
    SUM(y) OVER (PARTITION BY draw) AS p, SUM(1 - y) OVER (PARTITION BY draw) AS n
  FROM (SELECT draw, w0, w1, w2, risk_label AS y, w0 * base_score + w1 * (1 - base_score) + w2 * ((base_score + 0.5) / 2) AS s
    FROM scored, (VALUES {_DRAWS}) d(draw, w0, w1, w2)) m) ranked GROUP BY draw, w0, w1, w2, p, n"""
_EVERY = "(SELECT COUNT(*) FROM transactions)"
_SOUND = "SELECT transaction_id, TRUE AS is_probability, TRUE AS level_fits, TRUE AS has_learnt FROM transactions"
FITS = {
    **dict.fromkeys(["train_rf_pipeline", "predict_risk", "tune_cv", "tune_random"], _SOUND),
    "train_zoo": "SELECT transaction_id, TRUE AS p_random_forest, TRUE AS p_gbt, TRUE AS p_logistic_regression, TRUE AS p_neural_network, TRUE AS p_svm FROM transactions",
    "train_regressors": "SELECT model, TRUE AS ordered, TRUE AS has_learnt FROM (VALUES ('random_forest'), ('boosted_trees'), ('factorization'), ('generalized_linear'), ('linear_regression'), ('ensemble')) m(model)",
    "permutation_importance": "SELECT feature, TRUE AS is_auc, TRUE AS is_difference FROM (VALUES ('amount'), ('customer_age'), ('hour'), ('day_of_week')) f(feature)",
    "shap_sampling": f"SELECT {_EVERY} AS rows, 4 AS least, 4 AS most, TRUE AS additive",
    "lime_local": f"SELECT CAST(r AS INTEGER) AS rank, {_EVERY} AS rows FROM range(1, 5) t(r)",
    "optimize_weights": _WEIGHTS,
    "search_weights": f"SELECT MAX(auc) AS auc FROM ({_WEIGHTS}) w",
    "register_model_run": """
WITH c AS (SELECT COUNT(*) FILTER (risk_label = 1 AND base_score > 0.5) AS tp, COUNT(*) FILTER (risk_label = 0 AND base_score > 0.5) AS fp,
    COUNT(*) FILTER (risk_label = 0 AND base_score <= 0.5) AS tn, COUNT(*) FILTER (risk_label = 1 AND base_score <= 0.5) AS fn, COUNT(*) AS n FROM scored),
a AS (SELECT SUM(CASE WHEN risk_label = 1 THEN r END) / (p * q) - (p + 1) / (2.0 * q) AS auc
  FROM (SELECT risk_label, RANK() OVER (ORDER BY base_score) + (COUNT(*) OVER (PARTITION BY base_score) - 1) / 2.0 AS r,
    SUM(risk_label) OVER () AS p, SUM(1 - risk_label) OVER () AS q FROM scored) s GROUP BY p, q)
SELECT 'baseline' AS model_name, v AS model_version, 100 AS training_samples, CAST(n AS INTEGER) AS validation_samples, '{"base_score":1.0}' AS feature_importance,
  '{"confusion_matrix":[[' || tn || ',' || fp || '],[' || fn || ',' || tp || ']]}' AS confusion_matrix,
  ROUND((tp + tn) / n, 3) AS accuracy, ROUND(tp / (tp + fp), 3) AS precision_score, ROUND(tp / (tp + fn), 3) AS recall_score,
  ROUND(2 * tp / (2 * tp + fp + fn), 3) AS f1_score, ROUND(auc, 3) AS auc_score, 0.25::DOUBLE AS drift_score
FROM c, a, (VALUES ('v1'), ('v2')) t(v)""",
    "explanation_struct": f"""
WITH imp AS (
  SELECT key, SUM(0.25 * CAST(json_extract_string(feature_importance, '$.' || key) AS DOUBLE)) AS v
  FROM (SELECT feature_importance, UNNEST(json_keys(feature_importance)) AS key FROM model_performance) e GROUP BY key)
SELECT transaction_id, (SELECT CAST(COUNT(*) AS INTEGER) FROM imp) AS features, ROUND((SELECT v FROM imp WHERE key = 'amount'), 6) AS amount_importance,
  ROUND(0.0001 * (amount - AVG(amount) OVER ()), 6) AS amount_shap, ROUND(-1.5 * (base_score - AVG(base_score) OVER ()), 6) AS base_shap,
  'amount' AS local_feature, ROUND(amount * 0.0001, 6) AS local_score,
  array_to_string(list_filter([CASE WHEN amount > 10000 THEN 'High amount detected' END, CASE WHEN {NIGHT} THEN 'Transaction during night hours' END,
    CASE WHEN {WEEKEND} THEN 'Weekend transaction' END, 'Final risk score: ' || printf('%.3f', round(risk_score * 1000) / 1000)], lambda x: x IS NOT NULL), ' | ') AS decision_path
FROM scored""",
    "ab_assign": """
SELECT CAST(h % 2 AS INTEGER) AS variant, COUNT(*) AS n, ROUND(AVG(risk_score), 6) AS avg_risk_score, ROUND(AVG(CASE WHEN recommended_action = 'BLOCK' THEN 1.0 ELSE 0.0 END), 6) AS block_rate
FROM (SELECT *, ('0x' || substr(md5(transaction_id || ':42'), 1, 8))::BIGINT AS h FROM risk_assessments) s GROUP BY 1""",
    "read_json_lines": "SELECT metric_id, metric_name, ROUND(metric_value, 6) AS metric_value, service_name FROM system_metrics",
}

OPERATORS = {**FITS, **SOURCES, **CLEANING, **JOINS, **AGGREGATES, **SCALARS, **SCORING, **QUALITY, **MODELS, **STATISTICS, **STREAMS}
