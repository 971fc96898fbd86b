import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import monthly, questions, summaries

LEDGER = "transaction_id bigint, transaction_date timestamp_ntz, client_id bigint, amount decimal(18,2), mcc bigint"


def ledger(spark, rows):
    values = [(i, datetime.fromisoformat(t), c, Decimal(str(a)), m) for i, (t, c, a, m) in enumerate(rows)]
    return spark.createDataFrame(values, LEDGER)


def months(spark, totals):
    rows = [(1, date(2020 + i // 12, 1 + i % 12, 1), float(x), i, float(x), float(x), float(x), 1, 2) for i, x in enumerate(totals)]
    return spark.createDataFrame(
        rows,
        "client_id bigint, expense_month date, total_expenses double, num_expense_transactions bigint, "
        "avg_expense_amount double, max_expense_amount double, total_earnings double, num_earning_transactions bigint, "
        "total_transactions bigint",
    )


def test_zero_frequency_counts_the_slot_before_the_first_month(spark):
    out = monthly.add_zero_frequency(months(spark, [0, 1, 0, 3, 0, 5, 0, 7, 8])).orderBy("expense_month").toPandas()
    want = [None, 1 / 2, 1 / 3, 1 / 2, 2 / 5, 1 / 2, 1 / 2, 1 / 2, 1 / 2]
    assert pd.isna(out["zero_freq_6m"][0])
    assert out["zero_freq_6m"][1:].tolist() == pytest.approx(want[1:])


def test_rolling_features_match_pandas(spark):
    totals = [5, 0, 9, 2, 7, 7, 1, 3, 8, 4, 6, 10, 2, 5, 9]
    rolled = monthly.add_rolling(monthly.add_lags(months(spark, totals)))
    got = rolled.orderBy("expense_month").toPandas()
    x = pd.Series(totals, dtype=float)
    for n in (3, 6, 12):
        past = x.shift(1).rolling(n, min_periods=1)
        pd.testing.assert_series_equal(got[f"rmean_{n}"], past.mean(), check_names=False)
        pd.testing.assert_series_equal(got[f"rstd_{n}"], past.std(), check_names=False)
    pd.testing.assert_series_equal(got["rmedian_6"], x.shift(1).rolling(6, min_periods=1).median(), check_names=False)
    pd.testing.assert_series_equal(got["lag_6"], x.shift(6), check_names=False)


def test_monthly_measures(spark):
    rows = [("2020-01-05", 1, -10, 1), ("2020-01-06", 1, -30, 1), ("2020-01-31", 1, 100, 1), ("2020-02-01", 1, 0, 1)]
    first, second = monthly.monthly_expenses(ledger(spark, rows)).orderBy("expense_month").collect()
    assert (first.total_expenses, first.num_expense_transactions, first.avg_expense_amount) == (40.0, 2, 20.0)
    assert (first.max_expense_amount, first.total_earnings, first.total_transactions) == (30.0, 100.0, 3)
    assert (second.avg_expense_amount, second.max_expense_amount, second.num_earning_transactions) == (None, None, 0)


def test_latest_features_are_the_last_month(spark):
    rows = months(spark, [3, 4, 5]).select("client_id", "expense_month", "total_expenses")
    got = monthly.latest_features(rows).first()
    assert (got.expense_month, got.total_expenses) == (date(2020, 3, 1), 5.0)


def test_strict_folds_drop_targets_that_reach_the_validation_month(spark):
    rows = monthly.add_targets(monthly.add_lags(months(spark, range(1, 31))))
    last = date(2022, 6, 1)
    loose = {(r.val_month, r.horizon): r.n_train for r in monthly.fold_rows(rows, last).collect()}
    strict = {(r.val_month, r.horizon): r.n_train for r in monthly.fold_rows(rows, last, strict=True).collect()}
    assert len(loose) == 24
    assert all(strict[k] == loose[k] - k[1] for k in loose)


# --- summaries ---


def request(spark, rows, start, end, client=1):
    df = ledger(spark, rows)
    return df, summaries.single_request(df, client, start, end)


def test_week_gaps_are_filled_inside_the_span_only(spark):
    rows = [("2013-01-01", 1, 100, 1), ("2013-01-07", 1, -40, 1), ("2013-01-29", 1, 50, 1), ("2013-01-29", 1, -10, 1)]
    flow = summaries.cash_flow(*request(spark, rows, "2012-12-20", "2013-02-10")).orderBy("period").collect()
    assert [(r.period, r.inflows, r.outflows, r.net_cash_flow, r.pct_savings) for r in flow] == [
        ("2013-01-06", 100.0, 0.0, 100.0, 100.0),
        ("2013-01-13", 0.0, 40.0, -40.0, 0.0),
        ("2013-01-20", 0.0, 0.0, 0.0, 0.0),
        ("2013-01-27", 0.0, 0.0, 0.0, 0.0),
        ("2013-02-03", 50.0, 10.0, 40.0, 80.0),
    ]


def test_longer_periods_are_monthly(spark):
    rows = [("2011-01-05", 1, 10, 1), ("2011-03-05", 1, 20, 1)]
    flow = summaries.cash_flow(*request(spark, rows, "2011-01-01", "2011-04-30")).orderBy("period").collect()
    assert [(r.period, r.inflows) for r in flow] == [("2011-01", 10.0), ("2011-02", 0.0), ("2011-03", 20.0)]
    sixty = summaries.cash_flow(*request(spark, rows, "2011-01-04", "2011-03-05")).collect()
    assert all(len(r.period) == 10 for r in sixty)


def test_range_ends_at_midnight_of_the_end_date(spark):
    rows = [("2011-01-01 00:00:00", 1, 1, 1), ("2011-01-31 00:00:00", 1, 2, 1), ("2011-01-31 00:00:01", 1, 4, 1)]
    got = summaries.earnings_and_expenses(*request(spark, rows, "2011-01-01", "2011-01-31")).first()
    assert (got.earnings, got.expenses) == (3.0, 0.0)


def test_max_is_the_smallest_magnitude(spark):
    df, asked = request(spark, [("2011-01-02", 1, -99, 5), ("2011-01-03", 1, -50, 5), ("2011-01-04", 1, 70, 5)], "2011-01-01", "2011-02-01")
    mcc = spark.createDataFrame([(5, "Food")], "mcc bigint, category_name string")
    got = summaries.expenses_summary(df, asked, mcc).first()
    assert (got.total_amount, got.average, got.max_amount, got.min_amount, got.num_transactions) == (149.0, 74.5, 50.0, 99.0, 2)


def test_single_client_filter_equals_the_join(spark):
    rows = [("2011-01-02", 1, -9, 5), ("2011-01-03", 2, 50, 5), ("2011-05-04", 1, 70, 5)]
    df, asked = request(spark, rows, "2011-01-01", "2011-02-01")
    narrow = summaries.client_rows(df, 1, "2011-01-01", "2011-02-01")
    assert summaries.earnings_and_expenses(narrow, asked).collect() == summaries.earnings_and_expenses(df, asked).collect()


def test_reports_answer_known_clients_only(spark):
    df = ledger(spark, [("2017-04-03", 1, 100, 5), ("2017-04-04", 1, -40, 5)])
    mcc = spark.createDataFrame([(5, "Food")], "mcc bigint, category_name string")
    prompts = spark.createDataFrame(
        [(1, 1, "Create a report for the fourth month of 2017"), (2, 7000, "Report for 2017, Q2"), (3, 1, "no period")],
        "request_id bigint, client_id bigint, prompt string",
    )
    got = {r.request_id: r for r in summaries.report_requests(prompts, df, mcc).collect()}
    assert (got[1].start_date, got[1].end_date, got[1].create_report) == ("2017-04-01", "2017-04-30", True)
    assert (got[1].net, got[1].savings_pct, got[1].top_category, got[1].best_period) == (60.0, 60.0, "Food", "2017-04-09")
    assert got[1].earnings_text == (
        "Client 1 earned $100.00 and spent $40.00 during this period, resulting in net savings of $60.00 (60.0% savings rate)."
    )
    assert got[2].create_report is False and got[2].earnings is None
    assert got[3].create_report is False and got[3].start_date is None


def test_questions_keep_ties(spark):
    cards = spark.createDataFrame(
        [(1, date(2024, 1, 1), 5.0), (2, date(2025, 1, 1), 9.0), (3, date(2025, 1, 1), 7.0), (4, date(2025, 1, 1), 7.0), (5, date(2025, 1, 1), None)],
        "card_id bigint, expiry_date date, credit_limit double",
    )
    assert sorted(r.card_id for r in questions.latest_expiry_card(cards).collect()) == [3, 4]


def test_no_unpartitioned_window_in_the_questions(tables):
    plan = questions.largest_online_year_end(tables.ledger)._jdf.queryExecution().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("column", ["rmean_12", "lag_12"])
def test_forecast_matrix_has_36_features(tables, column):
    assert len(monthly.FORECAST_COLUMNS) == 36 and column in monthly.FORECAST_COLUMNS
    assert tables.forecast_features.columns[3:] == monthly.FORECAST_COLUMNS
    assert tables.forecast_features.select(F.count_if(F.col(column).isNotNull())).first()[0] > 0


def test_range_totals_of_overlapping_requests(spark):
    rng = random.Random(2)
    first = datetime(2011, 1, 1)
    rows = [(rng.randint(1, 3), first + timedelta(hours=12 * rng.randint(0, 80)), Decimal(rng.randint(-900, 900)) / 100, "5000") for _ in range(300)]
    ledger = spark.createDataFrame(rows, "client_id bigint, transaction_date timestamp_ntz, amount decimal(18,2), mcc string")
    days = [first.date() + timedelta(days=k) for k in range(-3, 45)]
    asked = [(f"r{i}", rng.choice([1, 2, 3, 9, None]), rng.choice([*days, None]), rng.choice([*days, None])) for i in range(150)]
    requests = spark.createDataFrame(asked, "request_id string, client_id bigint, start_date date, end_date date")
    want = {}
    for key, client, start, end in asked:
        inside = [a for c, w, a, _ in rows if None not in (client, start, end) and c == client and start <= w.date() and w <= datetime.combine(end, datetime.min.time())]
        want[key] = (float(sum(a for a in inside if a > 0)), float(sum(a for a in inside if a < 0))) if inside else (None, None)
    got = {r.request_id: (r.earnings, r.expenses) for r in summaries.earnings_and_expenses(ledger, requests).collect()}
    assert got == want and sum(v != (None, None) for v in want.values()) > 30
    assert summaries.earnings_and_expenses(ledger, requests.filter("false")).count() == 0


def test_range_and_clients_reach_one_scan_of_the_ledger(spark, tables):
    asked = summaries.single_request(tables.ledger, 7, "1996-01-01", "1996-03-01")
    daily = summaries.daily_totals(summaries.asked_rows(tables.ledger, asked), "mcc")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = daily._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "o_orderdate" in line]
    assert len(scans) == 1 and "GreaterThanOrEqual(o_orderdate" in scans[0] and "LessThanOrEqual(o_orderdate" in scans[0]
