"""SQL of the named warehouse reports, derived from their definitions.

Labels, limits and output names are fixed values of the reports.
"""

from __future__ import annotations

from riskloom.checks.views import A_ASOF, M_ASOF, P_ASOF, T_ASOF, pct


def ladder(value: str, steps: list[tuple[str, str]], rest: str) -> str:
    """The label of the first limit that ``value`` fulfils."""
    return f"(CASE {' '.join(f'WHEN {value} {test} THEN {label!r}' for test, label in steps)} ELSE {rest!r} END)"


def level(name: str) -> str:
    return f"count(*) FILTER (risk_level = '{name}')"


BLOCKED = "count(*) FILTER (recommended_action = 'BLOCK')"
LEVELS = ", ".join(f"{level(n.upper())} AS {n}_risk_count" for n in ("high", "medium", "low"))
# transactions of the last year with their assessment
_SCORED_YEAR = f"""scored_year AS (
  SELECT * FROM risk_assessments JOIN transactions USING (transaction_id, customer_id)
  WHERE transaction_timestamp >= {T_ASOF} - INTERVAL 365 DAY)"""
# Every customer's assessments of the last year, each as often as the customer has transactions (once without any).
_CUSTOMERS = f"""year AS (
  SELECT customer_id, assessment_id, risk_score AS score, risk_level = 'HIGH' AS high, recommended_action = 'BLOCK' AS blocked
  FROM risk_assessments WHERE assessment_timestamp >= {A_ASOF} - INTERVAL 365 DAY),
crossed AS (SELECT y.*, x.amount, x.merchant_id, x.location_country, x.transaction_timestamp AS moment
  FROM year y LEFT JOIN transactions x USING (customer_id)),
customer_facts AS (
  SELECT customer_id, count(*) AS n, avg(score) AS mean_score, stddev_samp(score) AS spread, count(*) FILTER (high) AS highs,
    sum(amount) AS spent, count(DISTINCT merchant_id) AS shops, count(DISTINCT location_country) AS countries,
    date_part('day', max(moment) - min(moment)) AS days
  FROM crossed GROUP BY customer_id)"""
#: The profile of each customer, in the columns of the operator.
FANOUT = f"""
WITH {_CUSTOMERS}, extremes AS (
  SELECT customer_id, max(score) AS top, count(*) FILTER (blocked) AS blocks, avg(amount) AS mean_amount, max(moment) AS latest, min(moment) AS earliest
  FROM crossed GROUP BY customer_id)
SELECT customer_id, customer_segment, n AS total_assessments, ROUND(mean_score, 6) AS avg_risk_score, top AS max_risk_score,
  ROUND(spread, 6) AS risk_score_stddev, highs AS high_risk_count, blocks AS blocked_count, ROUND(spent, 6) AS total_amount,
  ROUND(mean_amount, 6) AS avg_amount, shops AS unique_merchants, countries AS unique_countries, latest AS last_transaction,
  earliest AS first_transaction, days AS customer_lifespan_days
FROM customer_facts JOIN extremes USING (customer_id) JOIN customers USING (customer_id)"""
# mean scores decide limits without the noise of their sum
_CLEAN = "CAST(printf('%.13e', mean_score) AS DOUBLE)"
_HOT = f"count(*) FILTER ({_CLEAN} > 0.7)"
_DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def rounded(digits: int, **named: str) -> str:
    return ", ".join(f"ROUND({expr}, {digits}) AS {name}" for name, expr in named.items())


REPORTS = {
    "q01_dashboard": f"""
SELECT date_trunc('hour', assessment_timestamp) AS hour, count(*) AS total_assessments, {LEVELS},
  {rounded(4, avg_risk_score='avg(risk_score)')}, {rounded(2, avg_processing_time_ms='avg(processing_time_ms)')},
  {BLOCKED} AS blocked_transactions, {pct(level('HIGH'), 'count(*)')} AS high_risk_percentage, {pct(BLOCKED, 'count(*)')} AS block_rate
FROM risk_assessments WHERE {A_ASOF} - assessment_timestamp <= INTERVAL 365 DAY
GROUP BY hour""",
    "q02_customer_profile": f"""
WITH {_CUSTOMERS}
SELECT customer_segment, count(*) AS customer_count, {rounded(4, segment_avg_risk_score=f'avg({_CLEAN})')},
  {rounded(2, avg_assessments_per_customer='avg(n)', avg_total_amount='avg(spent)', avg_unique_merchants='avg(shops)')},
  {_HOT} AS high_risk_customers, {pct(_HOT, 'count(*)')} AS high_risk_percentage
FROM customer_facts JOIN customers USING (customer_id) GROUP BY customer_segment""",
    "q03_geographic": f"""
WITH {_SCORED_YEAR}, places AS (
  SELECT location_country, location_region, location_city, count(*) AS n, avg(risk_score) AS mean_score, {level('HIGH')} AS highs,
    sum(amount) AS spent, avg(amount) AS mean_amount, count(DISTINCT customer_id) AS buyers, count(DISTINCT merchant_id) AS shops
  FROM scored_year GROUP BY ALL)
SELECT location_country, location_region, location_city, n AS transaction_count, {rounded(4, avg_risk_score=_CLEAN)}, highs AS high_risk_count,
  {pct('highs', 'n')} AS high_risk_percentage,
  {rounded(2, total_amount='spent', avg_amount='mean_amount', risk_weighted_score='mean_amount * buyers')},
  buyers AS unique_customers, shops AS unique_merchants
FROM places WHERE n >= 10
QUALIFY row_number() OVER (ORDER BY {_CLEAN} DESC, n DESC, location_country, location_region, location_city) <= 50""",
    "q04_merchant": f"""
WITH {_SCORED_YEAR}, sold AS (
  SELECT merchant_id, count(*) AS n, avg(risk_score) AS mean_score, {level('HIGH')} AS highs, {BLOCKED} AS blocked,
    sum(amount) AS spent, avg(amount) AS mean_amount, count(DISTINCT customer_id) AS buyers
  FROM scored_year GROUP BY merchant_id HAVING n >= 5)
SELECT merchant_id, merchant_name, merchant_category, merchant_country, n AS transaction_count, {rounded(4, avg_risk_score=_CLEAN)},
  highs AS high_risk_count, {pct('highs', 'n')} AS high_risk_percentage, {rounded(2, total_amount='spent', avg_amount='mean_amount')},
  buyers AS unique_customers, blocked AS blocked_transactions, {pct('blocked', 'n')} AS block_rate,
  {ladder(_CLEAN, [('> 0.8', 'CRITICAL'), ('> 0.6', 'HIGH'), ('> 0.4', 'MEDIUM')], 'LOW')} AS merchant_risk_level
FROM sold JOIN merchants USING (merchant_id)""",
    "q05_time_patterns": f"""
WITH {_SCORED_YEAR}
SELECT hour(transaction_timestamp)::INTEGER AS hour_of_day, {_DAYS!r}[dayofweek(transaction_timestamp) + 1] AS day_name,
  count(*) AS transaction_count, {rounded(4, avg_risk_score='avg(risk_score)')}, {level('HIGH')} AS high_risk_count,
  {pct(level('HIGH'), 'count(*)')} AS high_risk_percentage, {rounded(2, total_amount='sum(amount)', avg_amount='avg(amount)')}
FROM scored_year GROUP BY 1, 2""",
    "q06_model_performance": f"""
SELECT model_name, model_version, {rounded(4, accuracy='accuracy', precision='precision_score', recall='recall_score', f1_score='f1_score', auc='auc_score', drift_score='drift_score')},
  training_samples, validation_samples, training_duration_seconds,
  {rounded(4, accuracy_change='accuracy - lag(accuracy, 1, accuracy) OVER runs', f1_change='f1_score - lag(f1_score, 1, f1_score) OVER runs')},
  {ladder('drift_score', [('> 0.1', 'HIGH_DRIFT'), ('> 0.05', 'MEDIUM_DRIFT')], 'LOW_DRIFT')} AS drift_status, created_at
FROM model_performance WHERE {P_ASOF} - created_at <= INTERVAL 3650 DAY
WINDOW runs AS (PARTITION BY model_name ORDER BY created_at, model_version)""",
    "q07_feature_importance": f"""
WITH named AS (
  SELECT model_name, model_version, created_at, feature_importance AS told, unnest(json_keys(feature_importance)) AS feature_name
  FROM model_performance WHERE {P_ASOF} - created_at <= INTERVAL 3650 DAY),
valued AS (SELECT *, json_extract(told, feature_name)::DOUBLE AS importance FROM named)
SELECT model_name, model_version, feature_name, {rounded(6, importance_score='importance')},
  row_number() OVER best ::INTEGER AS feature_rank, created_at
FROM valued WINDOW best AS (PARTITION BY model_name, model_version ORDER BY importance DESC, feature_name) QUALIFY feature_rank <= 20""",
    "q08_system_metrics": f"""
WITH hours AS (
  SELECT date_trunc('hour', metric_time) AS hour, metric_name, avg(metric_value) AS mean, max(metric_value) AS top, min(metric_value) AS low,
    stddev_samp(metric_value) AS spread
  FROM system_metrics WHERE {M_ASOF} - metric_time <= INTERVAL 24 HOUR GROUP BY ALL),
limits(metric_name, most, label) AS (VALUES ('cpu_usage', 80, 'HIGH_CPU'), ('memory_usage', 80, 'HIGH_MEMORY'), ('error_rate', 5, 'HIGH_ERROR_RATE'))
SELECT hour, metric_name, {rounded(4, avg_value='mean', max_value='top', min_value='low', stddev_value='spread')},
  CASE WHEN mean > most THEN label ELSE 'NORMAL' END AS alert_status
FROM hours LEFT JOIN limits USING (metric_name)""",
    "q09_score_distribution": f"""
WITH binned AS (
  SELECT coalesce(least(floor(risk_score * 10 / 2), 4), 4)::INTEGER AS bin, processing_time_ms, recommended_action FROM risk_assessments
  WHERE {A_ASOF} - assessment_timestamp <= INTERVAL 365 DAY)
SELECT ['0.0-0.2', '0.2-0.4', '0.4-0.6', '0.6-0.8', '0.8-1.0'][bin + 1] AS risk_score_bucket, count(*) AS assessment_count,
  {pct('count(*)', '(SELECT count(*) FROM binned)')} AS percentage, {rounded(2, avg_processing_time_ms='avg(processing_time_ms)')},
  {BLOCKED} AS blocked_count, {pct(BLOCKED, 'count(*)')} AS block_rate
FROM binned GROUP BY bin""",
    "q10_segmentation": f"""
WITH {_CUSTOMERS}, cleaned AS (SELECT customer_facts.*, {_CLEAN} AS risk FROM customer_facts JOIN customers USING (customer_id)),
placed AS (
  SELECT *, CASE
      WHEN risk > 0.7 THEN CASE WHEN highs > 2 THEN 'HIGH_RISK_FREQUENT' ELSE 'HIGH_RISK_OCCASIONAL' END
      WHEN risk >= 0.4 THEN CASE WHEN spent > 10000 THEN 'MEDIUM_RISK_HIGH_VALUE' WHEN spent IS NOT NULL THEN 'MEDIUM_RISK_STANDARD' ELSE 'LOW_RISK_BASIC' END
      WHEN spent > 50000 THEN 'LOW_RISK_PREMIUM' WHEN spent >= 10000 THEN 'LOW_RISK_STANDARD' ELSE 'LOW_RISK_BASIC' END AS advanced_segment,
    {ladder('spread', [('> 0.3', 'HIGH_VOLATILITY'), ('>= 0.1', 'MEDIUM_VOLATILITY')], 'LOW_VOLATILITY')} AS risk_volatility
  FROM cleaned)
SELECT advanced_segment, risk_volatility, count(*) AS customer_count, {rounded(4, segment_avg_risk_score='avg(risk)')},
  {rounded(2, segment_avg_total_amount='avg(spent)', segment_avg_merchants='avg(shops)', segment_avg_countries='avg(countries)', segment_avg_lifespan_days='avg(days)')},
  count(*) FILTER (highs > 0) AS customers_with_high_risk, {pct('count(*) FILTER (highs > 0)', 'count(*)')} AS high_risk_percentage
FROM placed GROUP BY ALL""",
    "q11_daily_summary": f"""
SELECT assessment_timestamp::DATE AS assessment_date, count(*) AS total_assessments, {LEVELS},
  {rounded(6, avg_risk_score='avg(risk_score)', avg_processing_time='avg(processing_time_ms)')}, {BLOCKED} AS blocked_count
FROM risk_assessments GROUP BY assessment_date""",
    "q12_dq_assessments": """
SELECT 'risk_assessments' AS table_name, count(*) AS total_rows, count(*) - count(risk_score) AS null_risk_scores,
  count(*) - count(risk_level) AS null_risk_levels, count(*) - count(customer_id) AS null_customer_ids,
  count(*) - count(transaction_id) AS null_transaction_ids, count(*) FILTER (risk_score NOT BETWEEN 0 AND 1) AS invalid_risk_scores,
  min(assessment_timestamp) AS earliest_timestamp, max(assessment_timestamp) AS latest_timestamp FROM risk_assessments""",
    "q13_dq_transactions": """
SELECT 'transactions' AS table_name, count(*) AS total_rows, count(*) - count(amount) AS null_amounts,
  count(*) FILTER (NOT amount > 0) AS invalid_amounts, count(*) - count(customer_id) AS null_customer_ids,
  count(*) - count(transaction_timestamp) AS null_timestamps,
  min(transaction_timestamp) AS earliest_timestamp, max(transaction_timestamp) AS latest_timestamp FROM transactions_dirty""",
    "q14_system_health": f"""
SELECT metric_name, count(*) AS data_points,
  {rounded(4, avg_value='avg(metric_value)', max_value='max(metric_value)', min_value='min(metric_value)', stddev_value='stddev_samp(metric_value)')},
  max(metric_time) AS latest_reading
FROM system_metrics WHERE {M_ASOF} - metric_time <= INTERVAL 1 HOUR GROUP BY metric_name""",
    "q15_statistics": f"""
SELECT count(*) AS total_assessments, {LEVELS},
  {rounded(6, average_risk_score='avg(risk_score)', average_processing_time_ms='avg(processing_time_ms)')}
FROM risk_assessments WHERE year(assessment_timestamp) IN (1997, 1998)""",
}
