"""Oracles of exploration, data quality, encoding, splits and metrics."""

from __future__ import annotations

from oracles.base import CARDS, LABELLED, LABELS, MCC, MONTHLY, SCORED, TXN, USERS, query, rounded
from oracles.relational import AWAY, HOMES
from oracles.series import FEATURES

SQL: dict[str, str] = {}
ZERO = "CAST(0 AS DOUBLE)"

SQL["data_profile"] = query([TXN, LABELS], """
SELECT COUNT(*) AS n_rows, CAST(CAST(MIN(transaction_date) AS DATE) AS VARCHAR) AS first_date,
  CAST(CAST(MAX(transaction_date) AS DATE) AS VARCHAR) AS last_date, COUNT(is_fraud) AS n_labelled,
  ROUND(COUNT(is_fraud)/CAST(COUNT(*) AS DOUBLE),6) AS labelled_share, ROUND(AVG(is_fraud),6) AS fraud_rate,
  COUNT(DISTINCT client_id) AS n_clients FROM txn LEFT JOIN lab USING (transaction_id)""")
SQL["eda_class_balance"] = query(LABELLED, "SELECT is_fraud, COUNT(*) AS n FROM labelled GROUP BY 1")
RATE = "ROUND(AVG(is_fraud),6) AS fraud_rate, COUNT(*) AS n"
MULT = "ROUND(AVG(is_fraud)/(SELECT AVG(is_fraud) FROM labelled),6) AS multiplier"
KINDS = {
    "Bad CVV": "has_bad_cvv=1", "Bad Expiration": "has_bad_expiration=1", "Bad Card Number": "has_bad_card_number=1",
    "Bad PIN": "has_bad_pin=1", "Insufficient Balance": "has_insufficient_balance=1",
    "Technical Glitch": "has_technical_glitch=1", "No Error": "has_any_error=0",
}
SQL["eda_error_rate"] = query(LABELLED, " UNION ALL ".join(
    f"SELECT '{k}' AS error_type, {RATE}, {MULT} FROM labelled WHERE {c}" for k, c in KINDS.items()))
SQL["eda_channel_rate"] = query(LABELLED, f"SELECT use_chip, {RATE}, {MULT} FROM labelled GROUP BY 1")
SQL["eda_hourly_rate"] = query(LABELLED,
    f"SELECT CAST(hour(transaction_date) AS INTEGER) AS txn_hour, {RATE}, {MULT} FROM labelled GROUP BY 1")
SQL["eda_weekday_rate"] = query(LABELLED,
    f"SELECT dayname(transaction_date) AS day_name, CAST(isodow(transaction_date) AS INTEGER) AS day_order, {RATE} FROM labelled GROUP BY 1,2")
QUARTILES = query(LABELLED, """
SELECT is_fraud, COUNT(*) AS n, ROUND(QUANTILE_CONT(x,0.25),6) AS q1, ROUND(QUANTILE_CONT(x,0.5),6) AS median, ROUND(QUANTILE_CONT(x,0.75),6) AS q3
FROM (SELECT is_fraud, CAST(abs(amount) AS DOUBLE) AS x FROM labelled) GROUP BY 1""")
SQL["eda_amount_quantiles"] = QUARTILES
SQL["eda_amount_quantiles_cut"] = QUARTILES


def histogram(source: str, group: str, value: str, bins: int, ctes) -> str:
    return query(ctes, f"""
, h AS (SELECT {group} AS g, CAST({value} AS DOUBLE) AS x FROM {source})
, e AS (SELECT g, MIN(x) AS lo, MAX(x) AS hi, COUNT(x) AS total FROM h GROUP BY 1)
, b AS (SELECT g, lo, hi, total, CAST(LEAST(CASE WHEN hi>lo THEN floor((x-lo)*{bins}/(hi-lo)) ELSE 0 END, {bins - 1}) AS INTEGER) AS bin FROM h JOIN e USING (g))
SELECT g AS {group.split()[-1]}, bin, ROUND(lo+bin*(hi-lo)/{bins},6)+{ZERO} AS bin_start, COUNT(*) AS n,
  ROUND(CASE WHEN hi>lo THEN COUNT(*)*{bins}/(total*(hi-lo)) END,6) AS density FROM b GROUP BY g, bin, lo, hi, total""")


SQL["eda_amount_histogram"] = histogram("labelled", "is_fraud", "LEAST(abs(amount), 500)", 50, LABELLED)
SQL["score_histogram"] = histogram("scored", "label", "score", 100, SCORED)
SQL["residual_histogram"] = histogram(
    "res", "quarter", "ROUND(rmean_12-total_expenses,4)", 80,
    FEATURES + ", res AS (SELECT *, CAST(quarter(expense_month) AS INTEGER) AS quarter FROM feats WHERE lag_12 IS NOT NULL)")
SQL["eda_out_of_state"] = query(LABELLED, f"""
, home AS (SELECT client_id, merchant_state AS home_state FROM labelled WHERE merchant_state <> '' GROUP BY 1,2
  QUALIFY ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY COUNT(*) DESC, merchant_state)=1)
SELECT (home_state IS NOT NULL AND merchant_state IS DISTINCT FROM home_state) AS out_of_state, {RATE} FROM labelled LEFT JOIN home USING (client_id) GROUP BY 1""")
SQL["leak_check_zip"] = query([LABELLED, HOMES], f"""
, r AS (SELECT t.is_fraud, {AWAY} FROM labelled t LEFT JOIN home h ON t.client_id=h.client_id LEFT JOIN homezip hz ON t.client_id=hz.client_id)
SELECT is_different_zip, {RATE} FROM r GROUP BY 1""")
SQL["psi_drift"] = query(TXN, f"""
, r AS (SELECT CAST(abs(amount) AS DOUBLE) AS x, day(transaction_date)>20 AS newer FROM txn)
, q AS (SELECT QUANTILE_CONT(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM r WHERE NOT newer)
, b AS (SELECT newer, CAST(len(list_filter(e, lambda c: ROUND(c,9) < x)) AS INTEGER) AS bin FROM r, q)
, c AS (SELECT bin, COUNT(*) FILTER (NOT newer) AS n_older, COUNT(*) FILTER (newer) AS n_newer FROM b GROUP BY 1)
, s AS (SELECT *, GREATEST(n_older/SUM(n_older) OVER (), 1e-6) AS o, GREATEST(n_newer/SUM(n_newer) OVER (), 1e-6) AS w FROM c)
SELECT bin, n_older, n_newer, ROUND((w-o)*ln(w/o),6)+{ZERO} AS psi FROM s""")

# --- data quality ------------------------------------------------------------------------


def nulls(table: str, columns: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS n_null, COUNT(*) AS n_rows FROM {source}"
        for c in columns.split())


SQL["dq_not_null"] = query([TXN, CARDS, USERS, MCC, MONTHLY], " UNION ALL ".join([
    nulls("transactions", "transaction_id transaction_date client_id card_id amount mcc zip errors", "txn"),
    nulls("cards", "card_id client_id credit_limit", "cards"), nulls("users", "client_id", "users"),
    nulls("mcc", "mcc category_name", "mcc"), nulls("monthly", "client_id expense_month avg_expense_amount", "monthly")]))


def repeats(table: str, keys: str, source: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{keys.replace(', ', '+')}' AS key_columns, COUNT(*) AS n_keys,
  CAST(COALESCE(SUM(n-1),0) AS BIGINT) AS n_surplus FROM (SELECT COUNT(*) AS n FROM {source} GROUP BY {keys} HAVING COUNT(*)>1)"""


SQL["dq_unique"] = query([TXN, USERS, MCC, MONTHLY], " UNION ALL ".join([
    repeats("transactions", "transaction_id", "txn"), repeats("users", "client_id", "users"), repeats("mcc", "mcc", "mcc"),
    repeats("monthly", "client_id, expense_month", "monthly"), repeats("lineitem", "l_orderkey, l_linenumber", "lineitem")]))
SQL["dq_deduplicate"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice)=1"""
STAGED = (
    "transaction_id transaction_date client_id card_id amount use_chip merchant_id merchant_city merchant_state zip mcc errors "
    "has_bad_cvv has_bad_expiration has_bad_card_number has_bad_pin has_insufficient_balance has_technical_glitch has_any_error is_online"
)
SQL["dq_null_counts"] = query(TXN, " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS n_null, COUNT(*) AS n_rows FROM txn" for c in STAGED.split()))


def fence(name: str, x: str, source: str) -> str:
    return f"""SELECT '{name}' AS column_name, q1, q3, q1-3*(q3-q1) AS lower_bound, q3+3*(q3-q1) AS upper_bound FROM
  (SELECT QUANTILE_CONT(CAST({x} AS DOUBLE),0.25) AS q1, QUANTILE_CONT(CAST({x} AS DOUBLE),0.75) AS q3 FROM {source})"""


SQL["dq_iqr_fences"] = f"""
SELECT column_name, {rounded('q1 q3 lower_bound upper_bound')} FROM ({fence('value', 'value', 'events')} UNION ALL {fence('size', 'abs(value)', 'events')})"""
SQL["dq_iqr_outliers"] = query(TXN, f"""
, f AS ({fence('amount', 'amount', 'txn')} UNION ALL {fence('size', 'abs(amount)', 'txn')})
, l AS (SELECT transaction_id, 'amount' AS column_name, CAST(amount AS DOUBLE) AS value FROM txn
  UNION ALL SELECT transaction_id, 'size', CAST(abs(amount) AS DOUBLE) FROM txn)
SELECT column_name, transaction_id, {rounded('value lower_bound upper_bound')} FROM l JOIN f USING (column_name)
WHERE value<lower_bound OR value>upper_bound""")
SQL["dq_request_rules"] = """
WITH r AS (
  SELECT event_id, hour(ts) + (CASE WHEN event_id%30=5 THEN 24 ELSE 0 END) AS h FROM events),
m AS (SELECT event_id, list_filter([
    CASE WHEN event_id%50=7 THEN 'amount: not a number' END, CASE WHEN event_id%40=3 THEN 'mcc: missing' END,
    CASE WHEN event_id%60=11 THEN 'is_online: outside 0..1' END, CASE WHEN h>23 THEN 'txn_hour: outside 0..23' END], lambda x: x IS NOT NULL) AS reasons FROM r)
SELECT CAST(event_id AS VARCHAR) AS transaction_id, array_to_string(reasons, '; ') AS reasons, len(reasons)=0 AS is_valid FROM m"""

# --- encoding and splits -----------------------------------------------------------------


def out_of_fold(column: str) -> str:
    return query(LABELLED, f"""
, o AS (SELECT transaction_id, {column}, is_fraud, NTILE(5) OVER (ORDER BY transaction_date, transaction_id) AS f FROM labelled)
, g AS (SELECT AVG(is_fraud) AS g FROM labelled)
SELECT o.transaction_id, o.{column}, ROUND(
  (COALESCE((SELECT SUM(b.is_fraud) FROM s b WHERE b.{column}=o.{column} AND b.f<>o.f),0)+10*g)
  /(COALESCE((SELECT SUM(b.n) FROM s b WHERE b.{column}=o.{column} AND b.f<>o.f),0)+10),6) AS {column}_te
FROM o, g""").replace(", g AS", f", s AS (SELECT {column}, f, SUM(is_fraud) AS is_fraud, COUNT(*) AS n FROM o GROUP BY 1,2)\n, g AS")


SQL["target_encode_oof"] = out_of_fold("mcc")
SQL["target_encode_oof_cut"] = out_of_fold("merchant_id")
SQL["target_encode_apply"] = query(LABELLED, """
, g AS (SELECT AVG(is_fraud) AS g FROM labelled)
, a AS (SELECT mcc, (SUM(is_fraud)+10*(SELECT g FROM g))/(COUNT(*)+10) AS te FROM labelled GROUP BY 1)
, b AS (SELECT merchant_id, (SUM(is_fraud)+10*(SELECT g FROM g))/(COUNT(*)+10) AS te FROM labelled GROUP BY 1)
SELECT transaction_id, ROUND(COALESCE(a.te,(SELECT g FROM g)),6) AS mcc_te, ROUND(COALESCE(b.te,(SELECT g FROM g)),6) AS merchant_id_te
FROM txn LEFT JOIN a USING (mcc) LEFT JOIN b USING (merchant_id)""")
SQL["temporal_split"] = query(LABELLED, """
, r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY transaction_date, transaction_id) AS i, COUNT(*) OVER () AS n FROM labelled)
SELECT CASE WHEN i <= floor(n*0.85) THEN 'train' ELSE 'val' END AS split, COUNT(*) AS n, ROUND(AVG(is_fraud),6) AS fraud_rate,
  MIN(transaction_date) AS first_time, MAX(transaction_date) AS last_time FROM r GROUP BY 1""")

# --- metrics -----------------------------------------------------------------------------

CURVE = SCORED + """,
cu AS (SELECT score, SUM(label) AS pos, COUNT(*) AS n FROM scored GROUP BY 1),
curve AS (SELECT score, pos, SUM(pos) OVER s AS tp, SUM(n) OVER s AS flagged, SUM(pos) OVER () AS p FROM cu WINDOW s AS (ORDER BY score DESC))"""
SQL["average_precision"] = query(CURVE, """
SELECT ROUND(SUM(pos/CAST(p AS DOUBLE)*(tp/CAST(flagged AS DOUBLE))),6) AS average_precision, CAST(MAX(p) AS BIGINT) AS n_positive,
  CAST(MAX(flagged) AS BIGINT) AS n_rows FROM curve""")
POINTS = "SELECT ROUND(score,6) AS threshold, ROUND(tp/CAST(flagged AS DOUBLE),6) AS precision, ROUND(tp/CAST(p AS DOUBLE),6) AS recall FROM curve"
SQL["pr_curve"] = query(CURVE, POINTS)
SQL["pr_curve_cut"] = SQL["pr_curve"]
SQL["pr_operating_points"] = query(CURVE, f"""
, q AS ({POINTS})
, t AS (SELECT 'BA-optimal' AS point, CAST(0.08 AS DOUBLE) AS target UNION ALL SELECT 'F1-optimal', CAST(0.37 AS DOUBLE))
SELECT point, target, threshold, precision, recall FROM t, q QUALIFY ROW_NUMBER() OVER (PARTITION BY point ORDER BY abs(threshold-target), threshold)=1""")
SWEEP = SCORED + """,
th AS (SELECT CAST(0.01 AS DOUBLE) + (i-1)*CAST(0.01 AS DOUBLE) AS t FROM range(1,99) r(i)),
sw AS (SELECT t, COUNT(*) FILTER (label=1 AND score>=t) AS tp, COUNT(*) FILTER (score>=t) AS fl, COUNT(*) FILTER (label=1) AS p, COUNT(*) AS n
  FROM th, scored GROUP BY 1),
sweep AS (SELECT ROUND(t,6) AS threshold, tp AS true_positives, fl AS flagged,
  ROUND(CASE WHEN fl>0 THEN tp/CAST(fl AS DOUBLE) ELSE 0 END,6) AS precision, ROUND(tp/CAST(p AS DOUBLE),6) AS recall,
  ROUND(2*tp/CAST(fl+p AS DOUBLE),6) AS f1, ROUND((tp/CAST(p AS DOUBLE) + ((n-p)-(fl-tp))/CAST(n-p AS DOUBLE))/2,6) AS balanced_accuracy FROM sw)"""
SQL["threshold_sweep"] = query(SWEEP, "SELECT * FROM sweep")
SQL["best_thresholds"] = query(SWEEP, """
SELECT * FROM (SELECT 'balanced_accuracy' AS metric, balanced_accuracy AS value, threshold, precision, recall FROM sweep
  QUALIFY ROW_NUMBER() OVER (ORDER BY balanced_accuracy DESC, threshold)=1)
UNION ALL SELECT * FROM (SELECT 'f1', f1, threshold, precision, recall FROM sweep QUALIFY ROW_NUMBER() OVER (ORDER BY f1 DESC, threshold)=1)""")
AT = "(SELECT CAST(0.08 AS DOUBLE) AS threshold UNION ALL SELECT CAST(0.37 AS DOUBLE))"
SQL["confusion_matrix"] = query(SCORED, f"""
SELECT threshold, label, CAST(score>=threshold AS INTEGER) AS predicted, COUNT(*) AS n FROM scored, {AT} GROUP BY ALL""")
SQL["classification_report"] = query(SCORED, f"""
, c AS (SELECT threshold, label, CAST(score>=threshold AS INTEGER) AS predicted FROM scored, {AT})
, k AS (SELECT threshold, CAST(cl AS INTEGER) AS class, COUNT(*) FILTER (label=cl AND predicted=cl) AS hit, COUNT(*) FILTER (predicted=cl) AS said,
  COUNT(*) FILTER (label=cl) AS real FROM c, range(0,2) r(cl) GROUP BY 1,2)
SELECT threshold, class, ROUND(CASE WHEN said>0 THEN hit/CAST(said AS DOUBLE) ELSE 0 END,6) AS precision,
  ROUND(CASE WHEN real>0 THEN hit/CAST(real AS DOUBLE) ELSE 0 END,6) AS recall, ROUND(2*hit/CAST(said+real AS DOUBLE),6) AS f1, real AS support FROM k""")
FOCAL = SCORED + """,
p0 AS (SELECT transaction_id, label, 1/(1+exp(-raw)) AS p FROM scored),
p1 AS (SELECT *, CASE WHEN label=1 THEN p ELSE 1-p END AS pt FROM p0),
p2 AS (SELECT *, CAST(0.25 AS DOUBLE)*power(1-pt,2) AS w FROM p1)"""
SQL["focal_grad_hess"] = query(FOCAL, f"""
SELECT transaction_id, ROUND(p,6) AS probability, ROUND(w,6) AS focal_weight, ROUND(w*(p-label),6)+{ZERO} AS grad,
  ROUND(GREATEST(w*p*(1-p),1e-7),6)+{ZERO} AS hess FROM p2""")
SQL["focal_loss"] = query(FOCAL, "SELECT ROUND(AVG(-w*ln(pt+1e-8)),6) AS focal_loss, COUNT(*) AS n FROM p2")
