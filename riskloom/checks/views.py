"""Fixture views and shared fragments of the independent SQL, in the DuckDB dialect.

The texts follow the definitions literally (double joins, window frames over whole tables, correlated
ranges), not the rewrites used on Spark, so a match checks the rewrites.
"""

from __future__ import annotations

import re

# The fixture views of FIXTURES.md.
VIEWS: dict[str, str] = {
    "transactions": """
SELECT 'TXN' || CAST(o.o_orderkey AS VARCHAR) AS transaction_id,
  CASE WHEN o.o_custkey % 20 = 0 THEN 'NEW' ELSE 'CUST' END || CAST(o.o_custkey AS VARCHAR) AS customer_id,
  'M' || CAST(m.suppkey AS VARCHAR) AS merchant_id,
  o.o_totalprice * CAST(0.025 AS DOUBLE) AS amount,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'CREDIT' WHEN '2-HIGH' THEN 'DEBIT' WHEN '3-MEDIUM' THEN 'CASH' ELSE 'DIGITAL' END AS payment_method,
  n.n_name AS location_country, r.r_name AS location_region, 'CITY_' || CAST(c.c_custkey % 5 AS VARCHAR) AS location_city,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN n.n_nationkey % 8 = 7 THEN n.n_name || '_HIGH_RISK' ELSE n.n_name END AS location,
  CASE WHEN o.o_custkey % 31 = 0 THEN NULL ELSE CAST(16 + (o.o_custkey * 37) % 70 AS INT) END AS customer_age,
  o.o_orderdate + to_seconds((o.o_orderkey * 7919) % 86400) AS transaction_timestamp,
  CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS risk_label,
  o.o_orderkey AS k
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT l_orderkey, MIN(l_suppkey) AS suppkey FROM lineitem GROUP BY l_orderkey) m ON o.o_orderkey = m.l_orderkey""",
    "scored": """
SELECT b.*, least(CAST(1.0 AS DOUBLE), greatest(base_score,
    CASE WHEN amount > 10000 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END,
    CASE WHEN customer_id LIKE 'NEW%' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END,
    CASE WHEN extract(hour FROM transaction_timestamp) >= 22 OR extract(hour FROM transaction_timestamp) <= 6 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END,
    CASE WHEN extract(dow FROM transaction_timestamp) IN (0, 6) THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END,
    CASE WHEN customer_age < 25 OR customer_age > 65 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) AS risk_score
FROM (SELECT t.*, ((t.k * 2654435761) % 10000) / CAST(10000 AS DOUBLE) AS base_score FROM transactions t) b""",
    "risk_assessments": """
SELECT 'A' || CAST(k AS VARCHAR) AS assessment_id, transaction_id, customer_id, risk_score,
  CASE WHEN risk_score >= 0.8 THEN 'HIGH' WHEN risk_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CAST(0.8 AS DOUBLE) AS confidence_score,
  CASE WHEN risk_score >= 0.8 THEN 'BLOCK' WHEN risk_score >= 0.5 THEN 'REVIEW' ELSE 'APPROVE' END AS recommended_action,
  CAST(5 + k % 95 AS INT) AS processing_time_ms,
  'v' || CAST(k % 3 AS VARCHAR) AS model_version,
  transaction_timestamp + to_seconds(1) AS assessment_timestamp
FROM scored""",
    "customers": """
SELECT CASE WHEN c_custkey % 20 = 0 THEN 'NEW' ELSE 'CUST' END || CAST(c_custkey AS VARCHAR) AS customer_id,
  c_mktsegment AS customer_segment,
  CAST('1994-01-01 00:00:00' AS TIMESTAMP) + to_seconds((c_custkey % 365) * 86400) AS registration_date
FROM customer""",
    "merchants": """
SELECT 'M' || CAST(s.s_suppkey AS VARCHAR) AS merchant_id, s.s_name AS merchant_name,
  'CAT_' || CAST(s.s_suppkey % 7 AS VARCHAR) AS merchant_category, n.n_name AS merchant_country,
  s.s_acctbal < 0 AS is_high_risk
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "model_performance": """
SELECT model_name, model_version, model_name || ':' || model_version AS model_id,
  tp_tn / n AS accuracy, tp / NULLIF(pp, 0) AS precision_score, tp / NULLIF(p, 0) AS recall_score,
  2 * tp / NULLIF(pp + p, 0) AS f1_score, tp_tn / n AS auc_score, abs(mean_score - 0.5) * 10 AS drift_score,
  n AS training_samples, p AS validation_samples, CAST(n % 600 AS INT) AS training_duration_seconds, created_at,
  '{"amount":0.' || lpad(CAST((n * 7) % 1000 AS VARCHAR), 3, '0') || ',"hour":0.' || lpad(CAST((n * 11) % 1000 AS VARCHAR), 3, '0')
    || ',"customer_age":0.' || lpad(CAST((n * 13) % 1000 AS VARCHAR), 3, '0') || '}' AS feature_importance
FROM (
  SELECT 'model_' || CAST(k % 4 AS VARCHAR) AS model_name, 'v' || CAST(extract(year FROM transaction_timestamp) AS VARCHAR) AS model_version,
    COUNT(*) AS n, COUNT(CASE WHEN risk_label = 1 THEN 1 END) AS p, COUNT(CASE WHEN base_score > 0.5 THEN 1 END) AS pp,
    COUNT(CASE WHEN risk_label = 1 AND base_score > 0.5 THEN 1 END) AS tp,
    COUNT(CASE WHEN (risk_label = 1) = (base_score > 0.5) THEN 1 END) AS tp_tn,
    AVG(base_score) AS mean_score, MAX(transaction_timestamp) AS created_at
  FROM scored GROUP BY 1, 2) g""",
    "model_updates": """
SELECT model_id AS new_model_id, created_at AS event_time FROM model_performance WHERE model_name = 'model_0'""",
    "system_metrics": """
SELECT event_id AS metric_id,
  CASE event_type WHEN 'click' THEN 'cpu_usage' WHEN 'view' THEN 'memory_usage' WHEN 'error' THEN 'error_rate' ELSE event_type END AS metric_name,
  value AS metric_value, ts AS metric_time, 'svc_' || CAST(user_id % 5 AS VARCHAR) AS service_name
FROM events""",
    "transactions_dirty": """
SELECT transaction_id, customer_id, merchant_id,
  CASE WHEN k % 211 = 0 THEN -amount WHEN k % 503 = 0 THEN amount * 200 WHEN k % 307 = 0 THEN NULL ELSE amount END AS amount,
  location, customer_age, transaction_timestamp, k
FROM (SELECT * FROM transactions UNION ALL SELECT * FROM transactions WHERE k % 50 = 0) u""",
    "enriched_assessments": """
SELECT a.*, t.amount, t.location, t.merchant_id, t.customer_age, t.payment_method, t.transaction_timestamp
FROM risk_assessments a JOIN transactions t ON a.transaction_id = t.transaction_id""",
}

# Frequent fragments. Labels, limits and rule weights are fixed values.
NIGHT = "(extract(hour FROM transaction_timestamp) >= 22 OR extract(hour FROM transaction_timestamp) <= 6)"
WEEKEND = "(extract(dow FROM transaction_timestamp) IN (0, 6))"
DOW = "CAST(extract(dow FROM transaction_timestamp) AS INTEGER)"
HOUR = "CAST(extract(hour FROM transaction_timestamp) AS INTEGER)"
AGE_OUT = "(customer_age < 25 OR customer_age > 65)"
LEVEL3 = "CASE WHEN risk_score >= 0.8 THEN 'HIGH' WHEN risk_score >= 0.5 THEN 'MEDIUM' WHEN risk_score IS NOT NULL THEN 'LOW' END"
LEVEL4 = ("CASE WHEN risk_score >= 0.9 THEN 'CRITICAL' WHEN risk_score >= 0.7 THEN 'HIGH' "
          "WHEN risk_score >= 0.4 THEN 'MEDIUM' WHEN risk_score IS NOT NULL THEN 'LOW' END")
BUCKET = ("CASE WHEN risk_score < 0.2 THEN '0.0-0.2' WHEN risk_score < 0.4 THEN '0.2-0.4' WHEN risk_score < 0.6 THEN '0.4-0.6' "
          "WHEN risk_score < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END")
CUT = ("CASE WHEN risk_score < 0 OR risk_score > 1 THEN NULL WHEN risk_score <= 0.3 THEN 'Low' WHEN risk_score <= 0.6 THEN 'Medium' "
       "WHEN risk_score <= 0.8 THEN 'High' WHEN risk_score <= 1 THEN 'Critical' END")
DAY_NAME = ("CASE extract(dow FROM {0}) WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' "
            "WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday' END")
COUNTS = """COUNT(*) AS total_assessments,
  COUNT(CASE WHEN risk_level = 'HIGH' THEN 1 END) AS high_risk_count,
  COUNT(CASE WHEN risk_level = 'MEDIUM' THEN 1 END) AS medium_risk_count,
  COUNT(CASE WHEN risk_level = 'LOW' THEN 1 END) AS low_risk_count"""


def pct(part: str, whole: str) -> str:
    """Percentage to two digits, rounded half up on integers."""
    return f"(CAST(({part}) * 20000 + ({whole}) AS BIGINT) // CAST(2 * ({whole}) AS BIGINT)) / 100.0::DOUBLE"


def with_views(body: str) -> str:
    """Prefix ``body`` with the fixture views it mentions, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, view in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(view)
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = half_up(body.strip())
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in needed]
    if not ctes:
        return body
    if re.match(r"WITH\s+RECURSIVE\s", body, re.I):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + re.sub(r"^WITH\s+RECURSIVE\s", "", body, flags=re.I)
    if re.match(r"WITH\s", body, re.I):
        return "WITH " + ",\n".join(ctes) + ",\n" + re.sub(r"^WITH\s", "", body, flags=re.I)
    return "WITH " + ",\n".join(ctes) + "\n" + body


def half_up(sql: str) -> str:
    """Rewrite ``ROUND(x, n)`` to round a decimal, as the DECIMAL columns of the warehouse do.

    Fourteen significant digits are kept first on both sides, which removes the noise of binary sums before ties are decided.
    """
    start = sql.find("ROUND(")
    if start < 0:
        return sql
    depth, at, comma = 0, start + len("ROUND("), -1
    while True:
        ch = sql[at]
        if ch in "([":
            depth += 1
        elif ch in ")]" and depth == 0:
            break
        elif ch in ")]":
            depth -= 1
        elif ch == "," and depth == 0:
            comma = at
        at += 1
    inner, digits = half_up(sql[start + len("ROUND("):comma]), sql[comma + 1:at].strip()
    return f"{sql[:start]}CAST(round(CAST(printf('%.13e', ({inner})::DOUBLE) AS DECIMAL(38, 12)), {digits}) AS DOUBLE){half_up(sql[at + 1:])}"


def as_of(col: str, table: str) -> str:
    return f"(SELECT MAX({col}) FROM {table})"


A_ASOF = as_of("assessment_timestamp", "risk_assessments")
T_ASOF = as_of("transaction_timestamp", "transactions")
M_ASOF = as_of("metric_time", "system_metrics")
P_ASOF = as_of("created_at", "model_performance")
RULES_ENGINE = f"""list_filter([CASE WHEN amount > 10000 THEN 'HIGH_AMOUNT_THRESHOLD' END,
    CASE WHEN customer_id LIKE 'NEW%' THEN 'NEW_CUSTOMER' END,
    CASE WHEN {NIGHT} THEN 'UNUSUAL_TIME' END,
    CASE WHEN {WEEKEND} THEN 'WEEKEND_TRANSACTION' END,
    CASE WHEN {AGE_OUT} THEN 'AGE_BASED_RISK' END], lambda x: x IS NOT NULL)"""
ADD_ENGINE = f"""least(1.0::DOUBLE, CASE WHEN amount > 10000 THEN 0.4::DOUBLE WHEN amount > 5000 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN {NIGHT} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {WEEKEND} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN {AGE_OUT} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)"""
ADD_GATEWAY = f"""least(1.0::DOUBLE, CASE WHEN amount > 10000 THEN 0.3::DOUBLE WHEN amount > 5000 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN {NIGHT} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {WEEKEND} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN COALESCE(customer_age, 0) < 25 OR customer_age > 65 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)"""
# Model score of the scoring queries: known unless the order key is a multiple of 3.
MODEL_SCORE = "CASE WHEN k % 3 <> 0 THEN base_score END"


def floors(base: str, service: bool = False) -> str:
    """Score raised to the floors, for the two rule sets."""
    parts = ["CASE WHEN amount > 10000 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END", "CASE WHEN customer_id LIKE 'NEW%' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"]
    if service:
        parts += [f"CASE WHEN {HOUR} < 6 OR {HOUR} > 22 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END",
                  "CASE WHEN location LIKE '%HIGH_RISK%' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END"]
    else:
        parts += [f"CASE WHEN {NIGHT} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END", f"CASE WHEN {WEEKEND} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END",
                  f"CASE WHEN {AGE_OUT} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"]
    return f"least(1.0::DOUBLE, greatest({base}, {', '.join(parts)}))"
