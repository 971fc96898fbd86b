"""Oracles of the monthly mart, forecast features, summaries and reports."""

from __future__ import annotations

from oracles.base import LEDGER, MCC, MONTHLY, USERS, query, rounded

SQL: dict[str, str] = {}
MONTH = "client_id, CAST(expense_month AS VARCHAR) AS expense_month"

SQL["mart_client_monthly_expenses"] = query(MONTHLY, f"""
SELECT {MONTH}, {rounded('total_expenses')}, num_expense_transactions, {rounded('avg_expense_amount max_expense_amount total_earnings')},
  num_earning_transactions, total_transactions FROM monthly""")
SQL["mart_fallback"] = SQL["mart_client_monthly_expenses"]
SQL["ledger_buckets"] = query(LEDGER, """
SELECT transaction_id, client_id, COUNT(*) OVER (PARTITION BY client_id ORDER BY transaction_date, transaction_id ROWS UNBOUNDED PRECEDING) AS number,
  CAST(LAG(amount) OVER (PARTITION BY client_id ORDER BY transaction_date, transaction_id) AS DOUBLE) AS amount_before
FROM ledger""")

LAGS = "lag_1 lag_2 lag_3 lag_6 lag_12"
ROLL = "rmean_3 rmean_6 rmean_12 rstd_3 rstd_6 rstd_12 rmedian_6 rmin_6 rmax_6"
TREND = "trend_3v12 trend_3v6 momentum_1 momentum_3 cv_12 cv_6"
CONTEXT = "earn_lag1 earn_rmean_3 earn_expense_ratio txn_lag1 txn_rmean_3 avg_expense_lag1"


def clip(x: str) -> str:
    return f"(CASE WHEN {x}<1 THEN 1 ELSE {x} END)"


FEATURES = MONTHLY + f""",
f1 AS (
  SELECT *,
    {', '.join(f'LAG(total_expenses,{n}) OVER s AS lag_{n}' for n in (1, 2, 3, 6, 12))},
    {', '.join(f'AVG(total_expenses) OVER p{n} AS rmean_{n}, STDDEV_SAMP(total_expenses) OVER p{n} AS rstd_{n}' for n in (3, 6, 12))},
    MEDIAN(total_expenses) OVER p6 AS rmedian_6, MIN(total_expenses) OVER p6 AS rmin_6, MAX(total_expenses) OVER p6 AS rmax_6,
    SUM(CASE WHEN total_expenses=0 THEN 1 ELSE 0 END) OVER p6 / CAST(LEAST(6, ROW_NUMBER() OVER s) AS DOUBLE) AS zero_freq_6m,
    LAG(total_earnings) OVER s AS earn_lag1, AVG(total_earnings) OVER p3 AS earn_rmean_3,
    LAG(num_expense_transactions) OVER s AS txn_lag1, AVG(num_expense_transactions) OVER p3 AS txn_rmean_3,
    LAG(avg_expense_amount) OVER s AS avg_expense_lag1, LAG(max_expense_amount) OVER s AS max_lag1,
    {', '.join(f'LEAD(total_expenses,{h}) OVER s AS target_h{h}' for h in (1, 2, 3))},
    AVG(total_expenses) OVER (PARTITION BY client_id ORDER BY expense_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS client_mean
  FROM monthly
  WINDOW s AS (PARTITION BY client_id ORDER BY expense_month),
    p3 AS (PARTITION BY client_id ORDER BY expense_month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    p6 AS (PARTITION BY client_id ORDER BY expense_month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
    p12 AS (PARTITION BY client_id ORDER BY expense_month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
feats AS (
  SELECT f1.*, (rmean_3-rmean_12)/{clip('rmean_12')} AS trend_3v12, (rmean_3-rmean_6)/{clip('rmean_6')} AS trend_3v6,
    lag_1-lag_2 AS momentum_1, lag_1-lag_3 AS momentum_3, rstd_12/{clip('rmean_12')} AS cv_12, rstd_6/{clip('rmean_6')} AS cv_6,
    earn_lag1/{clip('lag_1')} AS earn_expense_ratio, max_lag1/{clip('rmean_6')} AS max_ratio, rmax_6-rmin_6 AS range_6,
    u.current_age, u.credit_score, u.yearly_income, u.total_debt, u.num_credit_cards,
    CASE WHEN u.yearly_income>0 THEN u.total_debt/u.yearly_income ELSE 0 END AS debt_to_income,
    CAST(month(expense_month) AS INTEGER) AS month_of_year
  FROM f1 LEFT JOIN users u USING (client_id))"""
FEATURES = USERS + "," + FEATURES

SQL["forecast_lags"] = query(FEATURES, f"SELECT {MONTH}, {rounded(LAGS)} FROM feats")
SQL["forecast_rolling"] = query(FEATURES, f"SELECT {MONTH}, {rounded(ROLL)} FROM feats")
SQL["forecast_zero_freq"] = query(FEATURES, f"SELECT {MONTH}, {rounded('total_expenses zero_freq_6m')} FROM feats")
SQL["forecast_context"] = query(FEATURES, f"SELECT {MONTH}, {rounded(CONTEXT + ' max_ratio')} FROM feats")
SQL["forecast_targets"] = query(FEATURES, f"SELECT {MONTH}, {rounded('target_h1 target_h2 target_h3')} FROM feats")
ALL = f"{LAGS} {ROLL} {TREND} zero_freq_6m {CONTEXT} max_ratio range_6"
REST = f"current_age, credit_score, {rounded('yearly_income total_debt')}, num_credit_cards, {rounded('debt_to_income')}, month_of_year"
SQL["forecast_features"] = query(FEATURES, f"SELECT {MONTH}, {rounded('total_expenses ' + ALL)}, {REST} FROM feats")
SQL["latest_client_features"] = query(FEATURES, f"""
SELECT {MONTH}, {rounded('total_expenses ' + ALL)}, {REST} FROM feats
QUALIFY ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY expense_month DESC)=1""")


def folds(condition: str) -> str:
    return query(FEATURES, f"""
, last AS (SELECT CAST(date_trunc('month', MAX(transaction_date)) AS DATE) AS m FROM ledger)
, v AS (SELECT CAST(unnest(generate_series(m - INTERVAL 10 MONTH, m - INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS DATE) AS val_month FROM last)
, h AS (SELECT unnest([1,2,3]) AS horizon)
, known AS (SELECT expense_month, horizon FROM feats, h WHERE lag_12 IS NOT NULL
  AND (CASE horizon WHEN 1 THEN target_h1 WHEN 2 THEN target_h2 ELSE target_h3 END) IS NOT NULL)
SELECT CAST(val_month AS VARCHAR) AS val_month, CAST(horizon AS INTEGER) AS horizon,
  CAST(COUNT(*) FILTER ({condition}) AS BIGINT) AS n_train,
  CAST(COUNT(*) FILTER (expense_month = val_month) AS BIGINT) AS n_val
FROM known, v GROUP BY 1, 2""")


SQL["walk_forward_folds"] = folds("expense_month < val_month")
SQL["walk_forward_folds_strict"] = folds("expense_month + CAST(horizon AS INTEGER) * INTERVAL 1 MONTH < val_month")

SCORES = """COUNT(*) AS n, ROUND(AVG(abs(p-a)),6) AS mae, ROUND(SQRT(AVG((p-a)*(p-a))),6) AS rmse,
  ROUND(CASE WHEN VAR_POP(a)>0 THEN 1 - SUM((p-a)*(p-a))/(VAR_POP(a)*COUNT(a)) END,6) AS r2"""
SQL["forecast_baselines"] = query(FEATURES, f"""
, b AS (SELECT total_expenses AS a, lag_1 AS naive, client_mean, rmean_12 AS mean_12,
  CAST(0.5 AS DOUBLE)*lag_1+CAST(0.3 AS DOUBLE)*lag_2+CAST(0.2 AS DOUBLE)*lag_3 AS ewma, client_mean*0.5+rmean_6*0.5 AS blend FROM feats WHERE lag_12 IS NOT NULL)
, l AS (SELECT 'naive' AS method, a, naive AS p FROM b UNION ALL SELECT 'client_mean', a, client_mean FROM b
  UNION ALL SELECT 'mean_12', a, mean_12 FROM b UNION ALL SELECT 'ewma', a, ewma FROM b UNION ALL SELECT 'blend', a, blend FROM b)
SELECT method, {SCORES} FROM l GROUP BY method""")
SQL["forecast_metrics"] = query(FEATURES, f"""
, l AS (SELECT expense_month, 'target_h1' AS horizon, target_h1 AS a, rmean_12 AS p FROM feats WHERE lag_12 IS NOT NULL
  UNION ALL SELECT expense_month, 'target_h2', target_h2, rmean_12 FROM feats WHERE lag_12 IS NOT NULL
  UNION ALL SELECT expense_month, 'target_h3', target_h3, rmean_12 FROM feats WHERE lag_12 IS NOT NULL)
SELECT CAST(expense_month AS VARCHAR) AS expense_month, horizon, {SCORES} FROM l WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2""")
SQL["per_client_r2"] = query(FEATURES, f"""
, l AS (SELECT client_id, total_expenses AS a, rmean_12 AS p FROM feats WHERE lag_12 IS NOT NULL)
SELECT client_id, {SCORES} FROM l GROUP BY 1""")
SQL["variance_decomposition"] = query(MONTHLY, """
, c AS (SELECT client_id, COUNT(*) AS n, AVG(total_expenses) AS m, VAR_POP(total_expenses) AS v FROM monthly GROUP BY 1)
, d AS (SELECT SUM(n*m*m)/SUM(n) - POWER(SUM(n*m)/SUM(n),2) AS b, SUM(n*v)/SUM(n) AS w FROM c)
SELECT ROUND(b,2) AS between_clients, ROUND(w,2) AS within_clients, ROUND(b/(b+w),6) AS share FROM d""")
SQL["client_volatility"] = query(MONTHLY, """
, r AS (SELECT *, LAG(total_expenses,1) OVER s AS l1, LAG(total_expenses,12) OVER s AS l12 FROM monthly
  WINDOW s AS (PARTITION BY client_id ORDER BY expense_month))
SELECT client_id, COUNT(*) AS n_months, ROUND(STDDEV_SAMP(total_expenses)/AVG(total_expenses),6) AS cv,
  CASE WHEN STDDEV_SAMP(total_expenses)/AVG(total_expenses) > 0.7 THEN 1 ELSE 0 END AS is_volatile,
  ROUND(AVG(CASE WHEN total_expenses=0 THEN 1 ELSE 0 END),6) AS zero_share,
  ROUND(CORR(total_expenses,l1),6)+CAST(0 AS DOUBLE) AS autocorr_1, ROUND(CORR(total_expenses,l12),6)+CAST(0 AS DOUBLE) AS autocorr_12
FROM r GROUP BY 1""")

# --- summaries -------------------------------------------------------------------------------


def requests(days: int) -> str:
    return USERS + f""",
req AS (
  SELECT client_id AS request_id, client_id, CAST(DATE '1996-01-01' + CAST(client_id%24 AS INTEGER) * INTERVAL 1 MONTH AS DATE) AS start_date,
    CAST(DATE '1996-01-01' + CAST(client_id%24 AS INTEGER) * INTERVAL 1 MONTH + INTERVAL {days} DAY AS DATE) AS end_date
  FROM users)"""


ROWS = LEDGER + "," + MCC + """,
rows AS (
  SELECT r.*, t.amount, t.mcc, t.transaction_date FROM req r JOIN ledger t ON t.client_id=r.client_id
    AND t.transaction_date >= CAST(r.start_date AS TIMESTAMP) AND t.transaction_date <= CAST(r.end_date AS TIMESTAMP)),
ee AS (
  SELECT request_id, ROUND(CAST(SUM(CASE WHEN amount>0 THEN amount ELSE 0 END) AS DOUBLE),2) AS earnings,
    ROUND(CAST(SUM(CASE WHEN amount<0 THEN amount ELSE 0 END) AS DOUBLE),2)+CAST(0 AS DOUBLE) AS expenses FROM rows GROUP BY 1),
es AS (
  SELECT request_id, client_id, category_name AS expenses_type, ROUND(CAST(SUM(abs(amount)) AS DOUBLE),2) AS total_amount,
    CAST((2*CAST(SUM(abs(amount))*100 AS HUGEINT)+COUNT(*)) // (2*COUNT(*)) AS DOUBLE)/100 AS average, CAST(abs(MAX(amount)) AS DOUBLE) AS max_amount,
    CAST(abs(MIN(amount)) AS DOUBLE) AS min_amount, COUNT(*) AS num_transactions
  FROM rows JOIN mcc USING (mcc) WHERE amount<0 GROUP BY ALL),
per AS (
  SELECT request_id, client_id, end_date - start_date > 60 AS monthly_, amount,
    CASE WHEN end_date - start_date > 60 THEN CAST(date_trunc('month', transaction_date) AS DATE)
      ELSE CAST(date_trunc('week', transaction_date) AS DATE) + 6 END AS period FROM rows),
agg AS (
  SELECT request_id, client_id, monthly_, period, SUM(CASE WHEN amount>0 THEN amount ELSE 0 END) AS i,
    -SUM(CASE WHEN amount<0 THEN amount ELSE 0 END) AS o FROM per GROUP BY ALL),
spine AS (
  SELECT request_id, client_id, monthly_, CAST(unnest(CASE WHEN monthly_ THEN generate_series(a, b, INTERVAL 1 MONTH) ELSE generate_series(a, b, INTERVAL 7 DAY) END) AS DATE) AS period
  FROM (SELECT request_id, client_id, monthly_, CAST(MIN(period) AS TIMESTAMP) AS a, CAST(MAX(period) AS TIMESTAMP) AS b FROM agg GROUP BY 1, 2, 3)),
cf AS (
  SELECT s.request_id, s.client_id, CASE WHEN s.monthly_ THEN strftime(s.period,'%Y-%m') ELSE strftime(s.period,'%Y-%m-%d') END AS period,
    CAST(COALESCE(i,0) AS DOUBLE) AS inflows, CAST(COALESCE(o,0) AS DOUBLE) AS outflows,
    CAST(COALESCE(i,0)-COALESCE(o,0) AS DOUBLE) AS net_cash_flow,
    CASE WHEN COALESCE(i,0)>0 THEN ROUND(CAST(i-o AS DOUBLE)/CAST(i AS DOUBLE)*100,2)+CAST(0 AS DOUBLE) ELSE 0 END AS pct_savings
  FROM spine s LEFT JOIN agg a ON s.request_id=a.request_id AND s.period=a.period),
cft AS (
  SELECT request_id, ROUND(SUM(inflows),2) AS total_inflows, ROUND(SUM(outflows),2) AS total_outflows,
    ROUND(SUM(net_cash_flow),2)+CAST(0 AS DOUBLE) AS total_net, COUNT(*) FILTER (net_cash_flow>0) AS n_positive, COUNT(*) AS n_periods,
    CASE WHEN SUM(inflows)>0 THEN ROUND(ROUND(SUM(net_cash_flow),2)/ROUND(SUM(inflows),2)*100,1)+CAST(0 AS DOUBLE) ELSE 0 END AS overall_savings_pct
  FROM cf GROUP BY 1),
best AS (SELECT request_id, period AS best_period, inflows AS best_inflow FROM cf
  QUALIFY ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY inflows DESC, period)=1),
cat AS (SELECT request_id, COUNT(*) AS n_categories, ROUND(SUM(total_amount),2) AS total_spent FROM es GROUP BY 1),
top AS (SELECT request_id, expenses_type AS top_category, total_amount AS top_amount, average AS top_average, num_transactions AS top_count FROM es
  QUALIFY ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY total_amount DESC, expenses_type)=1)"""

SQL["earnings_and_expenses"] = query([requests(120), ROWS],
    "SELECT r.request_id, r.client_id, earnings, expenses FROM req r LEFT JOIN ee USING (request_id)")
SQL["expenses_summary"] = query([requests(400), ROWS], "SELECT * FROM es")
SQL["cash_flow_weekly"] = query([requests(55), ROWS], "SELECT * FROM cf")
SQL["cash_flow_monthly"] = query([requests(200), ROWS], "SELECT * FROM cf")
SQL["report_cash_flow_totals"] = query([requests(200), ROWS], "SELECT * FROM cft JOIN best USING (request_id)")


def usd(x: str) -> str:
    return f"format('${{:,.2f}}', abs({x}))"


SQL["report_narrative_facts"] = query([requests(200), ROWS], f"""
, k AS (
  SELECT r.request_id, r.client_id, abs(earnings) AS earnings, abs(expenses) AS expenses,
    ROUND(abs(earnings)-abs(expenses),2)+CAST(0 AS DOUBLE) AS net,
    CASE WHEN abs(earnings)>0 THEN ROUND(ROUND(abs(earnings)-abs(expenses),2)/abs(earnings)*100,1)+CAST(0 AS DOUBLE) ELSE 0 END AS savings_pct
  FROM req r LEFT JOIN ee USING (request_id))
SELECT k.request_id, k.client_id, earnings, expenses, net, savings_pct, CAST(n_categories AS DOUBLE) AS n_categories, top_category, top_amount,
  CAST(n_positive AS DOUBLE) AS n_positive, CAST(n_periods AS DOUBLE) AS n_periods, best_period, best_inflow,
  total_inflows, total_outflows, total_net, overall_savings_pct,
  CASE WHEN earnings IS NULL THEN 'No transaction data available for this period.' ELSE
    'Client ' || k.client_id || ' earned ' || {usd('earnings')} || ' and spent ' || {usd('expenses')} ||
    ' during this period, resulting in net savings of ' || {usd('net')} || ' (' || format('{{:.1f}}', savings_pct) || '% savings rate).' END AS earnings_text,
  COALESCE('Spending was distributed across ' || n_categories || (CASE WHEN n_categories=1 THEN ' category' ELSE ' categories' END) ||
    ', totaling ' || {usd('total_spent')} || '. The largest category was ' || top_category || ' (' || {usd('top_amount')} || ', ' || top_count ||
    ' transactions, avg ' || {usd('top_average')} || ' per transaction).', 'No expense transactions found for this period.') AS category_text,
  COALESCE('Net cash flow was positive in ' || n_positive || ' of ' || n_periods || ' periods. Total inflows: ' || {usd('total_inflows')} ||
    ', total outflows: ' || {usd('total_outflows')} || ', net: ' || {usd('total_net')} || '. The highest inflow period was ' || best_period ||
    ' (' || {usd('best_inflow')} || ').', 'No cash flow data available for this period.') AS period_text
FROM k LEFT JOIN cat USING (request_id) LEFT JOIN top USING (request_id) LEFT JOIN cft USING (request_id) LEFT JOIN best USING (request_id)""")

PROMPTS = USERS + """,
p AS (
  SELECT client_id AS request_id, client_id, CAST(1995+client_id%6 AS VARCHAR) AS y, client_id%9 AS kind FROM users),
asked AS (
  SELECT request_id, client_id, kind,
    CASE kind WHEN 0 THEN 'Create a report from ' || y || '-01-01 to ' || y || '-05-31'
      WHEN 1 THEN 'Between ' || y || '-02-01 and ' || y || '-03-15, please'
      WHEN 2 THEN 'Create a report for the fourth month of ' || y WHEN 3 THEN 'Report on the third quarter of ' || y
      WHEN 4 THEN 'Q2 ' || y || ' summary' WHEN 5 THEN 'Create a report for February ' || y
      WHEN 6 THEN 'Annual report ' || y WHEN 7 THEN 'Report for last spring' ELSE 'the twelfth month of ' || y END AS prompt,
    CASE kind WHEN 0 THEN y || '-01-01' WHEN 1 THEN y || '-02-01' WHEN 2 THEN y || '-04-01' WHEN 3 THEN y || '-07-01'
      WHEN 4 THEN y || '-04-01' WHEN 5 THEN y || '-02-01' WHEN 6 THEN y || '-01-01' WHEN 7 THEN NULL ELSE y || '-12-01' END AS start_date,
    CASE kind WHEN 0 THEN y || '-05-31' WHEN 1 THEN y || '-03-15' WHEN 2 THEN y || '-04-30' WHEN 3 THEN y || '-09-30'
      WHEN 4 THEN y || '-06-30' WHEN 5 THEN y || (CASE WHEN y IN ('1996','2000') THEN '-02-29' ELSE '-02-28' END)
      WHEN 6 THEN y || '-12-31' WHEN 7 THEN NULL ELSE y || '-12-31' END AS end_date
  FROM p)"""
SQL["extract_report_period"] = query(PROMPTS, "SELECT request_id, prompt, start_date, end_date FROM asked")
SQL["parse_period_reply"] = query(PROMPTS, """
, r AS (SELECT *, lpad(CAST(1+request_id%12 AS VARCHAR),2,'0') AS m FROM asked)
SELECT request_id,
  CASE request_id%4 WHEN 0 THEN '2001-' || m || '-01' WHEN 1 THEN '2002-' || m || '-01' ELSE start_date END AS start_date,
  CASE request_id%4 WHEN 0 THEN '2001-' || m || '-28' WHEN 1 THEN '2002-' || m || '-28' ELSE end_date END AS end_date,
  CASE WHEN request_id%4<2 THEN 'remote' ELSE 'remote+regex_fallback' END AS backend_used FROM r""")
REPORT_ROWS = ROWS.replace("rows AS (", """req AS (
  SELECT request_id, client_id, CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date FROM asked
  WHERE start_date IS NOT NULL AND client_id IN (SELECT client_id FROM ledger)),
rows AS (""", 1)
SQL["report_requests"] = query([PROMPTS, REPORT_ROWS], """
SELECT a.request_id, a.client_id, a.start_date, a.end_date,
  a.start_date IS NOT NULL AND a.client_id IN (SELECT client_id FROM ledger) AS create_report,
  abs(earnings) AS earnings, abs(expenses) AS expenses, CAST(n_categories AS DOUBLE) AS n_categories, top_category, CAST(n_periods AS DOUBLE) AS n_periods
FROM asked a LEFT JOIN ee USING (request_id) LEFT JOIN cat USING (request_id) LEFT JOIN top USING (request_id) LEFT JOIN cft USING (request_id)""")
