"""Shared CTEs of the oracle SQL: the landed and staged tables on the given views."""

from __future__ import annotations

LANDING = """
landing AS (
  SELECT event_id AS id, ts AS date, user_id AS client_id, user_id*2 + event_id%2 AS card_id,
    '$' || CAST(CAST(CASE WHEN event_type='signup' THEN value ELSE -value END AS DECIMAL(18,2)) AS VARCHAR) AS amount,
    CASE WHEN event_type IN ('click','error') THEN 'Online Transaction'
         WHEN event_type='view' THEN 'Chip Transaction' ELSE 'Swipe Transaction' END AS use_chip,
    k AS merchant_id,
    CASE WHEN event_type IN ('click','error') THEN 'ONLINE' ELSE 'City' || (k%25) END AS merchant_city,
    CASE WHEN event_type IN ('click','error') THEN '' ELSE 'S' || (k%10) END AS merchant_state,
    CASE WHEN event_type IN ('click','error') THEN NULL ELSE (10000+k*137) || '.0' END AS zip,
    5000 + k%30 AS mcc,
    CASE WHEN event_type='error' THEN
           ['Bad CVV','Bad Expiration','Bad Card Number','Bad PIN','Insufficient Balance','Technical Glitch',
            'Bad PIN,Insufficient Balance'][k%7+1]
         WHEN k%2=0 THEN '' ELSE NULL END AS errors
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
)"""


def _staged(name: str, source: str) -> str:
    flags = {
        "has_bad_cvv": "bad cvv",
        "has_bad_expiration": "bad expiration",
        "has_bad_card_number": "bad card number",
        "has_bad_pin": "bad pin",
        "has_insufficient_balance": "insufficient balance",
        "has_technical_glitch": "technical glitch",
    }
    parts = ",\n    ".join(
        f"CAST(lower(coalesce(errors,'')) LIKE '%{text}%' AS INTEGER) AS {name_}" for name_, text in flags.items()
    )
    return f"""
{name} AS (
  SELECT id AS transaction_id, date AS transaction_date, client_id, card_id,
    TRY_CAST(regexp_replace(amount, '[$,]', '', 'g') AS DECIMAL(18,2)) AS amount,
    use_chip, merchant_id, merchant_city, merchant_state,
    CAST(CAST(TRY_CAST(zip AS DOUBLE) AS BIGINT) AS VARCHAR) AS zip, mcc,
    NULLIF(trim(errors), '') AS errors,
    {parts},
    CASE WHEN NULLIF(trim(errors),'') IS NOT NULL THEN 1 ELSE 0 END AS has_any_error,
    CASE WHEN use_chip='Online Transaction' THEN 1 ELSE 0 END AS is_online
  FROM {source}
)"""


TXN = LANDING + "," + _staged("txn", "landing")

LEDGER_LANDING = """
ledger_landing AS (
  SELECT o_orderkey AS id, o_orderdate AS date, o_custkey%50 AS client_id,
    (o_custkey%50)*2 + o_orderkey%2 AS card_id,
    '$' || CAST(CAST(CASE WHEN o_orderpriority='1-URGENT' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS VARCHAR) AS amount,
    CASE o_orderstatus WHEN 'O' THEN 'Online Transaction' WHEN 'F' THEN 'Swipe Transaction' ELSE 'Chip Transaction' END AS use_chip,
    o_custkey%100 AS merchant_id,
    CASE WHEN o_orderstatus='O' THEN 'ONLINE' ELSE 'City' || (o_custkey%25) END AS merchant_city,
    CASE WHEN o_orderstatus='O' THEN '' ELSE 'S' || (o_custkey%10) END AS merchant_state,
    CASE WHEN o_orderstatus='O' THEN NULL ELSE (10000 + (o_custkey%100)*137) || '.0' END AS zip,
    5000 + o_custkey%30 AS mcc, '' AS errors
  FROM orders
)"""
LEDGER = LEDGER_LANDING + "," + _staged("ledger", "ledger_landing")

CARDS = """
raw_cards AS (
  SELECT c_custkey AS id, c_custkey//2 AS client_id, ['Visa','Mastercard','Amex'][c_custkey%3+1] AS card_brand,
    CASE WHEN c_custkey%2=0 THEN 'Debit' ELSE 'Credit' END AS card_type,
    CAST(4000000000000000 + c_custkey AS VARCHAR) AS card_number,
    lpad(CAST(1+c_custkey%12 AS VARCHAR),2,'0') || '/' || (2020+c_custkey%6) AS expires,
    CAST(100+c_custkey%900 AS VARCHAR) AS cvv,
    CASE WHEN c_custkey%4=0 THEN 'NO' ELSE 'YES' END AS has_chip,
    CAST(1+c_custkey%3 AS INTEGER) AS num_cards_issued,
    CASE WHEN c_custkey%17=0 THEN 'n/a' ELSE '$' || CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR) END AS credit_limit,
    lpad(CAST(1+c_custkey%12 AS VARCHAR),2,'0') || '/' || (2010+c_custkey%9) AS acct_open_date,
    CAST(2008+c_custkey%12 AS INTEGER) AS year_pin_last_changed, 'No' AS card_on_dark_web
  FROM customer
),
cards AS (
  SELECT id AS card_id, client_id, card_brand, card_type, card_number, expires, cvv, has_chip='YES' AS has_chip,
    num_cards_issued, TRY_CAST(regexp_replace(credit_limit,'[$,]','','g') AS DOUBLE) AS credit_limit, acct_open_date,
    year_pin_last_changed, card_on_dark_web='Yes' AS card_on_dark_web,
    make_date(CAST(split_part(expires,'/',2) AS BIGINT), CAST(split_part(expires,'/',1) AS BIGINT), 1) AS expiry_date
  FROM raw_cards
)"""

USERS = """
raw_users AS (
  SELECT c_custkey AS id, CAST(25+c_custkey%50 AS INTEGER) AS current_age,
    CAST(25+c_custkey%50+(c_custkey*3)%11 AS INTEGER) AS retirement_age,
    CAST(2024-(25+c_custkey%50) AS INTEGER) AS birth_year, CAST(1+c_custkey%12 AS INTEGER) AS birth_month,
    CASE WHEN c_custkey%2=0 THEN 'Female' ELSE 'Male' END AS gender, c_custkey || ' Main Street' AS address,
    CAST(30+c_custkey%20 AS DOUBLE) AS latitude, CAST(-120+c_custkey%50 AS DOUBLE) AS longitude,
    '$' || (9000+(c_custkey*331)%40000) AS per_capita_income, '$' || (20000+(c_custkey*911)%80000) AS yearly_income,
    '$' || ((c_custkey*577)%90000) AS total_debt, CAST(450+(c_custkey*37)%400 AS INTEGER) AS credit_score,
    2 AS num_credit_cards
  FROM customer
),
users AS (
  SELECT id AS client_id, current_age, retirement_age, birth_year, birth_month, gender, address, latitude, longitude,
    TRY_CAST(regexp_replace(per_capita_income,'[$,]','','g') AS DOUBLE) AS per_capita_income,
    TRY_CAST(regexp_replace(yearly_income,'[$,]','','g') AS DOUBLE) AS yearly_income,
    TRY_CAST(regexp_replace(total_debt,'[$,]','','g') AS DOUBLE) AS total_debt, credit_score, num_credit_cards
  FROM raw_users
)"""

MCC = """
mcc AS (SELECT CAST(5000+n_nationkey AS BIGINT) AS mcc, n_name AS category_name FROM nation)"""

LABELS = """
lab AS (
  SELECT event_id AS transaction_id,
    CASE WHEN (event_id*7919)%97 < (CASE WHEN event_type='error' THEN 20 ELSE 2 END) THEN 1 ELSE 0 END AS is_fraud
  FROM events WHERE event_id%10 < 7
)"""

LABELLED = TXN + "," + LABELS + """,
labelled AS (SELECT t.*, l.is_fraud FROM txn t JOIN lab l USING (transaction_id))"""

SCORED = LABELLED + """,
scored0 AS (
  SELECT transaction_id, is_fraud AS label,
    (has_any_error*300 + is_online*120 + (merchant_id*7)%200 + transaction_id%97 + 1) / CAST(1000 AS DOUBLE) AS score
  FROM labelled
),
scored AS (SELECT *, ln(score/(1-score)) AS raw FROM scored0)"""

MONTHLY = LEDGER + """,
monthly AS (
  SELECT client_id, CAST(date_trunc('month', transaction_date) AS DATE) AS expense_month,
    CAST(SUM(CASE WHEN amount<0 THEN abs(amount) ELSE 0 END) AS DOUBLE) AS total_expenses,
    COUNT(*) FILTER (amount<0) AS num_expense_transactions,
    CAST(SUM(abs(amount)) FILTER (amount<0) AS DOUBLE) / COUNT(*) FILTER (amount<0) AS avg_expense_amount,
    CAST(MAX(abs(amount)) FILTER (amount<0) AS DOUBLE) AS max_expense_amount,
    CAST(SUM(CASE WHEN amount>0 THEN amount ELSE 0 END) AS DOUBLE) AS total_earnings,
    COUNT(*) FILTER (amount>0) AS num_earning_transactions,
    COUNT(*) AS total_transactions
  FROM ledger GROUP BY 1, 2
)"""


def rounded(columns: str, digits: int = 6) -> str:
    """ROUND of each named column; adding zero turns a negative zero positive."""
    return ", ".join(f"ROUND(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}" for c in columns.split())


def query(ctes: list[str] | str, select: str) -> str:
    body = ctes if isinstance(ctes, str) else ",".join(ctes)
    return f"WITH {body.strip()}\n{select.strip()}"
