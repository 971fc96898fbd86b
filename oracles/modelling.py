"""Oracles of model inputs and prediction outputs."""

from __future__ import annotations

from oracles.base import LABELLED, TXN, query, rounded
from oracles.relational import MART
from oracles.series import FEATURES

SQL: dict[str, str] = {}

FILLED = (
    "seconds_since_last_txn card_txn_count_1h card_txn_count_24h card_txn_count_7d card_amount_sum_24h card_mcc_freq "
    "card_merchant_freq amount_zscore card_errors_7d client_distinct_cards_24h client_avg_amount_last50 "
    "client_std_amount_last50 amount_vs_client_max above_client_p90 gap_zscore card_age_months"
)
SQL["prepare_features"] = query(MART, "SELECT transaction_id, CAST(card_has_chip AS INTEGER) AS card_has_chip, " + ", ".join(
    f"ROUND(COALESCE(CAST({c} AS DOUBLE),0),6)+CAST(0 AS DOUBLE) AS {c}" for c in FILLED.split()) + " FROM mart")

# model order of the features a request does not carry
PADDED_NUMBERS = (
    "amount_to_limit_ratio amount_zscore client_avg_amount_last50 client_std_amount_last50 amount_vs_client_max "
    "above_client_p90 txn_day_of_week txn_month txn_year is_weekend has_bad_expiration has_bad_card_number has_bad_pin "
    "has_insufficient_balance has_technical_glitch card_errors_7d is_out_of_home_state card_txn_count_1h card_txn_count_7d "
    "card_amount_sum_24h gap_zscore card_mcc_freq card_merchant_freq card_distinct_mcc_7d client_distinct_cards_24h "
    "is_new_merchant is_new_mcc rapid_succession online_new_merchant online_high_amount oos_new_merchant error_online "
    "card_has_chip card_age_months current_age total_debt yearly_income debt_to_income_ratio"
)
SQL["score_padding"] = query(LABELLED, f"""
, g AS (SELECT AVG(is_fraud) AS g FROM labelled)
, a AS (SELECT mcc, (SUM(is_fraud)+10*(SELECT g FROM g))/(COUNT(*)+10) AS te FROM labelled GROUP BY 1)
, b AS (SELECT merchant_id, (SUM(is_fraud)+10*(SELECT g FROM g))/(COUNT(*)+10) AS te FROM labelled GROUP BY 1)
, q AS (SELECT *, CAST(regexp_extract(props,'[0-9]+') AS BIGINT) AS k, CAST(CAST(-value AS DECIMAL(18,2)) AS DOUBLE) AS amt FROM events
  WHERE NOT (event_id%50=7 OR event_id%40=3 OR event_id%60=11 OR hour(ts) + (CASE WHEN event_id%30=5 THEN 24 ELSE 0 END) > 23))
SELECT CAST(event_id AS VARCHAR) AS transaction_id, amt+CAST(0 AS DOUBLE) AS amount, abs(amt) AS abs_amount, ROUND(ln(abs(amt)+1),6) AS log_amount,
  CAST(amt<0 AS INTEGER) AS is_expense, CAST(event_type IN ('click','error') AS INTEGER) AS is_online,
  CASE WHEN k%7=0 THEN 1 ELSE 0 END AS has_bad_cvv, CAST(event_type='error' AS INTEGER) AS has_any_error,
  CAST(hour(ts) AS INTEGER) AS txn_hour, CAST(1000+k*10 AS DOUBLE) AS credit_limit, CAST(450+k AS INTEGER) AS credit_score,
  CAST(k%5 AS INTEGER) AS card_txn_count_24h, CAST(CASE WHEN k%3>0 THEN k*60 ELSE 0 END AS DOUBLE) AS seconds_since_last_txn,
  CASE WHEN event_type IN ('click','error') THEN 'Online Transaction' ELSE 'Swipe Transaction' END AS use_chip,
  '0' AS card_brand, '0' AS card_type, ROUND(COALESCE(a.te,(SELECT g FROM g)),6) AS mcc_te,
  ROUND(COALESCE(b.te,(SELECT g FROM g)),6) AS merchant_id_te, {', '.join(f'0 AS {c}' for c in PADDED_NUMBERS.split())}
FROM q LEFT JOIN a ON a.mcc=5000+q.k%30 LEFT JOIN b ON b.merchant_id=q.k""")
ANSWERS = """
, answers AS (SELECT transaction_id, CASE WHEN has_any_error*300 + is_online*120 + (merchant_id*7)%200 + transaction_id%97 + 1 >= 370
    THEN 'Yes' ELSE 'No' END AS prediction FROM txn UNION ALL SELECT -transaction_id-1, 'No' FROM txn)"""
SQL["prediction_output"] = query(TXN, ANSWERS + "SELECT * FROM answers")
SQL["prediction_summary"] = query([FEATURES, TXN], ANSWERS + f"""
, a AS (SELECT COUNT(*) AS n_predictions, COUNT(*) FILTER (prediction='Yes') AS n_positive FROM answers)
, l AS (SELECT * FROM feats QUALIFY ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY expense_month DESC)=1)
, f AS (SELECT COUNT(rmean_12) AS n_forecasts, QUANTILE_CONT(rmean_12,0.5) AS median_forecast, AVG(rmean_12) AS mean_forecast FROM l)
SELECT n_predictions, n_positive, ROUND(n_positive/CAST(n_predictions AS DOUBLE),6) AS positive_share, n_forecasts,
  {rounded('median_forecast mean_forecast')} FROM a, f""")

# what any fitted model's answers must satisfy
SPLIT = """
, r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY transaction_date, transaction_id) AS i, COUNT(*) OVER () AS n FROM labelled)
, parts AS (SELECT transaction_id, is_fraud, CASE WHEN i <= floor(n*0.85) THEN 'train' ELSE 'val' END AS split FROM r)"""
SQL["fraud_model"] = query(LABELLED, SPLIT + """
SELECT transaction_id, is_fraud AS label, CAST(0.37 AS DOUBLE) AS threshold, TRUE AS score_valid, TRUE AS flag_agrees
FROM parts WHERE split = 'val'""")
SQL["fraud_model_fit"] = query(LABELLED, SPLIT + """
SELECT split, COUNT(*) AS n, CAST(SUM(is_fraud) AS BIGINT) AS n_fraud, TRUE AS loss_fell FROM parts GROUP BY 1""")
SQL["score_requests"] = """
SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(0.35 AS DOUBLE) AS threshold, TRUE AS score_valid, TRUE AS flag_agrees FROM events
WHERE NOT (event_id%50=7 OR event_id%40=3 OR event_id%60=11 OR hour(ts) + (CASE WHEN event_id%30=5 THEN 24 ELSE 0 END) > 23)"""
SQL["stream_score"] = SQL["score_requests"]
SQL["feature_importance"] = """
SELECT CAST(i AS INTEGER) AS rank, true AS known, true AS met_once, true AS falling FROM range(1, 11) AS r(i)"""
_TARGETS = """
, known AS (SELECT expense_month, horizon FROM feats, (SELECT unnest([1,2,3]) AS horizon) h WHERE lag_12 IS NOT NULL
  AND (CASE horizon WHEN 1 THEN target_h1 WHEN 2 THEN target_h2 ELSE target_h3 END) IS NOT NULL)"""
SQL["forecast_model"] = query(FEATURES, _TARGETS + """
SELECT CAST(horizon AS INTEGER) AS horizon, COUNT(*) AS n, true AS better_than_mean, true AS scores_agree FROM known GROUP BY horizon""")
SQL["forecast_batch"] = query(FEATURES, """
, last AS (SELECT date_trunc('month', MAX(transaction_date)) AS m FROM ledger)
, h AS (SELECT unnest([1,2,3]) AS horizon)
, seen AS (SELECT DISTINCT client_id AS known_client FROM feats)
SELECT CAST(c_custkey AS BIGINT) AS client_id, strftime(m + CAST(horizon AS INTEGER) * INTERVAL 1 MONTH, '%Y-%m') AS month,
  CAST(horizon AS INTEGER) AS horizon, CASE WHEN known_client IS NULL THEN 'client not found' ELSE 'ok' END AS status, true AS answer_valid
FROM customer CROSS JOIN h CROSS JOIN last LEFT JOIN seen ON known_client = c_custkey""")
SQL["saved_artifacts"] = query([FEATURES, LABELLED], """
, codes AS (SELECT mcc FROM labelled GROUP BY 1)
, shops AS (SELECT merchant_id FROM labelled GROUP BY 1)
SELECT 'target_encodings' AS artifact, true AS is_loaded, (SELECT COUNT(*) FROM codes) + (SELECT COUNT(*) FROM shops) AS n_rows
UNION ALL SELECT 'client_features', true, COUNT(DISTINCT client_id) FROM feats
UNION ALL SELECT unnest(['fraud_model', 'forecast_h1', 'forecast_h2', 'forecast_h3']), false, 0""")
SQL["walk_forward_scores"] = query(FEATURES, _TARGETS + """
, last AS (SELECT MAX(expense_month) AS m FROM feats WHERE lag_12 IS NOT NULL)
, v AS (SELECT CAST(unnest(generate_series(m - INTERVAL 10 MONTH, m - INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS DATE) AS val_month FROM last)
, n AS (SELECT val_month, horizon, COUNT(*) FILTER (expense_month < val_month) AS n_train, COUNT(*) FILTER (expense_month = val_month) AS n
  FROM known, v GROUP BY ALL)
SELECT CAST(val_month AS VARCHAR) AS val_month, CAST(horizon AS INTEGER) AS horizon, n_train, n,
  CASE WHEN n >= 10 AND n_train >= 100 THEN 'ok' ELSE 'too few rows' END AS status, CASE WHEN n >= 10 AND n_train >= 100 THEN true END AS scored
FROM n""")
