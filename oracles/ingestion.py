"""Oracles of decoding, landing, quarantine, replay and incremental refresh."""

from __future__ import annotations

from oracles.base import LANDING, query
from oracles.relational import MART_COLUMNS, from_mart

SQL: dict[str, str] = {}

RAW = LANDING + """,
raw AS (
  SELECT id, date AS ts, strftime(date_trunc('second', date), '%Y-%m-%d %H:%M:%S') AS date,
    CASE WHEN id%41=0 THEN NULL ELSE client_id END AS client_id, CASE WHEN id%67=5 THEN NULL ELSE card_id END AS card_id,
    amount, use_chip, merchant_id, merchant_city, merchant_state, COALESCE(zip,'') AS zip, mcc, COALESCE(errors,'') AS errors
  FROM landing)"""
GOOD = RAW + """,
good AS (SELECT *, CAST(date AS TIMESTAMP) AS moment FROM raw WHERE client_id IS NOT NULL AND card_id IS NOT NULL)"""
SQL["stream_decode"] = query(RAW, """
SELECT CAST(id AS VARCHAR) AS id, date, CAST(client_id AS DOUBLE) AS client_id, CAST(card_id AS DOUBLE) AS card_id, amount, use_chip,
  merchant_id, merchant_city, merchant_state, TRY_CAST(NULLIF(zip,'') AS DOUBLE) AS zip, mcc, errors FROM raw""")
SQL["stream_landing"] = query(GOOD, """
SELECT id, moment AS date, client_id, card_id, amount, use_chip, merchant_id, merchant_city, merchant_state, zip, mcc, errors,
  CAST(CAST(moment AS DATE) AS VARCHAR) AS day FROM good""")
SQL["stream_quarantine"] = query(RAW, """
, twice AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE id%10=0)
SELECT CAST(id AS VARCHAR) AS id, date, CASE WHEN id%41=0 THEN 'x7' ELSE CAST(client_id AS VARCHAR) END AS client_id,
  CASE WHEN id%67=5 THEN '' ELSE CAST(card_id AS VARCHAR) END AS card_id,
  concat_ws(',', CASE WHEN client_id IS NULL THEN 'client_id' END, CASE WHEN card_id IS NULL THEN 'card_id' END) AS reasons
FROM twice WHERE client_id IS NULL OR card_id IS NULL""")
SQL["replay_malformed_split"] = query(RAW, """
SELECT concat_ws(',', CASE WHEN client_id IS NULL THEN 'client_id' END, CASE WHEN card_id IS NULL THEN 'card_id' END) AS reasons,
  COUNT(*) AS n, MIN(date) AS first_date, MAX(date) AS last_date FROM raw GROUP BY 1""")
SQL["replay_chunk"] = """WITH RECURSIVE """ + GOOD.strip() + """,
a AS (SELECT *, CAST(date AS TIMESTAMP) AS moment, client_id IS NOT NULL AND card_id IS NOT NULL AS ok FROM raw),
runs AS (
  SELECT MIN(moment) - INTERVAL 1 SECOND AS cursor FROM a
  UNION
  SELECT COALESCE((SELECT MAX(moment) FROM a WHERE ok AND moment > cursor AND moment <= cursor + INTERVAL 7 DAY), cursor + INTERVAL 7 DAY)
  FROM runs WHERE cursor < (SELECT MAX(moment) FROM a))
SELECT cursor AS chunk_start,
  COALESCE((SELECT MAX(moment) FROM a WHERE ok AND moment > cursor AND moment <= cursor + INTERVAL 7 DAY), cursor + INTERVAL 7 DAY) AS chunk_end,
  (SELECT COUNT(*) FROM a WHERE ok AND moment > cursor AND moment <= cursor + INTERVAL 7 DAY) AS rows_published,
  (SELECT COUNT(*) FROM a WHERE NOT ok AND moment > cursor AND moment <= cursor + INTERVAL 7 DAY) AS rows_skipped
FROM runs WHERE cursor < (SELECT MAX(moment) FROM a)"""
SQL["replay_stored_cursor"] = SQL["replay_chunk"]
VELOCITY = (
    "card_txn_count_1h card_txn_count_24h card_txn_count_7d card_amount_sum_24h card_errors_7d card_amount_sum_prior_24h"
)
SQL["incremental_mart"] = from_mart("transaction_id card_id " + VELOCITY)
SQL["stream_velocity"] = SQL["incremental_mart"]
SQL["stream_features"] = query(GOOD, f"""
, e AS (SELECT id AS transaction_id, card_id, abs(CAST(replace(amount,'$','') AS DECIMAL(18,2))) AS x,
    epoch_us(moment)//1000000 AS s, CASE WHEN trim(errors) <> '' THEN 1 ELSE 0 END AS err FROM good)
SELECT transaction_id, card_id, COUNT(*) OVER h1 - 1 AS card_txn_count_1h, COUNT(*) OVER h24 - 1 AS card_txn_count_24h,
  COUNT(*) OVER d7 - 1 AS card_txn_count_7d, CAST(SUM(x) OVER h24 - x AS DOUBLE) AS card_amount_sum_24h,
  CAST(SUM(err) OVER d7 AS BIGINT) AS card_errors_7d,
  CAST(SUM(x) OVER (PARTITION BY card_id ORDER BY s RANGE BETWEEN 172800 PRECEDING AND 86400 PRECEDING) AS DOUBLE) AS card_amount_sum_prior_24h
FROM e WINDOW h1 AS (PARTITION BY card_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW),
  h24 AS (PARTITION BY card_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW),
  d7 AS (PARTITION BY card_id ORDER BY s RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)""")
SQL["incremental_mart_all"] = from_mart(MART_COLUMNS)
