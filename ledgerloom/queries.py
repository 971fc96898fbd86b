"""Every query by name: a callable over (spark, data folder) returning a DataFrame.

Doubles are rounded to six places so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.periods import period_of, period_of_reply
from ledgerloom.operators import encoding, enrich, evaluate, quality, staging
from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.operators.windows import heavy_entities
from ledgerloom.plans import explore, fraud_mart, models, monthly, questions, summaries
from ledgerloom.session import scratch_path, stage
from ledgerloom.sources import artifacts, given_tables, readers, sinks
from ledgerloom.streaming.landing import decode, start_landing, with_reasons
from ledgerloom.streaming.refresh import LANDED, VELOCITY_COLUMNS, refresh, refresh_mart, start_refresh, start_scoring
from ledgerloom.streaming.replay import replay_rest, replay_statuses, store_by_day
from ledgerloom.streaming.velocity import start_velocity
from ledgerloom.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a function of the staged tables under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return tidy(function(Tables(spark, folder)))

    REGISTRY[function.__name__] = run
    return function


# whole numbers that are NULL where there is nothing to count from
NULLABLE = {"seconds_since_last_txn", "min_gap_24h", "txn_lag1"}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles; show decimals and nullable counts as doubles and dates as text."""

    def shown(name: str, kind: str):
        if name in NULLABLE:
            return F.col(name).cast("double").alias(name)
        if kind == "date":
            return F.col(name).cast("string").alias(name)
        if kind == "double":
            return F.round(name, digits).alias(name)
        return F.col(name).cast("double").alias(name) if kind.startswith("decimal") else F.col(name)

    return df.select(*[shown(name, kind) for name, kind in df.dtypes])


# --- scans, sources and sinks -------------------------------------------------------------


@query
def scan_transactions(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "transactions-csv")
    sinks.write_csv(t.landing, path)
    return readers.read_transactions(t.spark, path)


@query
def scan_dims(t: Tables) -> DataFrame:
    paths = {name: scratch_path(t.spark, f"{name}-csv") for name in ("cards", "users", "mcc")}
    for name, df in (("cards", t.raw_cards), ("users", t.raw_users), ("mcc", t.raw_mcc)):
        sinks.write_csv(df, paths[name])
    cards = readers.read_cards(t.spark, paths["cards"])
    users = readers.read_users(t.spark, paths["users"])
    codes = readers.read_mcc_codes(t.spark, paths["mcc"])
    return (
        cards.select(F.lit("cards").alias("table_name"), F.col("id").alias("row_key"), F.col("expires").alias("detail"))
        .unionByName(users.select(F.lit("users").alias("table_name"), F.col("id").alias("row_key"), F.col("yearly_income").alias("detail")))
        .unionByName(
            codes.select(
                F.lit("mcc").alias("table_name"),
                F.col("mcc_code").try_cast("bigint").alias("row_key"),
                F.col("category_name").alias("detail"),
            )
        )
    )


def _table_name(path: str) -> str:
    """A name that no other table has, from a scratch folder's own name."""
    return path.rsplit("/", 1)[1].replace("-", "_")


@query
def mart_fallback(t: Tables) -> DataFrame:
    """The monthly mart from its files, since no table of the name exists."""
    path = scratch_path(t.spark, "monthly-mart")
    t.monthly.write.parquet(path)
    return readers.read_mart(t.spark, f"{sinks.PRESENTATION}.{_table_name(path)}", path, t.monthly.columns)


@query
def ledger_buckets(t: Tables) -> DataFrame:
    """The staged ledger saved in buckets by client; numbers and gaps of a client's rows, read without an exchange."""
    rows = t.ledger.select("client_id", "transaction_date", "transaction_id", "amount")
    path = scratch_path(t.spark, "ledger-buckets")
    saved = sinks.save_buckets(rows, _table_name(path), ["client_id"], ["transaction_date", "transaction_id"], 8, path=path)
    order = Window.partitionBy("client_id").orderBy("transaction_date", "transaction_id")
    return saved.select(
        "transaction_id",
        "client_id",
        F.row_number().over(order).cast("bigint").alias("number"),
        F.lag("amount").over(order).alias("amount_before"),
    )


@query
def explode_labels(t: Tables) -> DataFrame:
    event = F.col("event_id")
    answer = F.when((event * 7919) % 97 < F.when(F.col("event_type") == "error", 20).otherwise(2), "Yes").otherwise("No")
    plain = F.format_string('{"%d": "%s"}', event, answer)
    wrapped = F.concat(F.lit('{"target": '), plain, F.lit("}"))
    documents = t.given("events").select(F.when(event % 2 == 0, wrapped).otherwise(plain).alias("value"))
    return readers.explode_labels(documents)


@query
def explode_mcc(t: Tables) -> DataFrame:
    return readers.explode_mcc(t.raw_mcc.select(F.to_json(F.create_map("mcc_code", "category_name")).alias("value")))


@query
def prediction_targets(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    documents = t.given("customer").select(
        F.format_string(
            '{"target": {"%d": {"1999-%02d": 0.0, "1998-11": 0.0, "1999-12": 1.5}}}', key, (key % 11 + 1).cast("int")
        ).alias("value")
    )
    return readers.explode_targets(documents)


@query
def sink_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "labels-csv")
    sinks.write_csv(
        t.labels.select(
            F.col("transaction_id").cast("string").alias("transaction_id"),
            F.when(F.col("is_fraud") == 1, "Yes").otherwise("No").alias("is_fraud"),
        ),
        path,
    )
    return readers.typed_labels(readers.read_labels(t.spark, path))


# --- staging ------------------------------------------------------------------------------


@query
def stg_transactions(t: Tables) -> DataFrame:
    return t.transactions


@query
def stg_cards(t: Tables) -> DataFrame:
    return t.cards


@query
def stg_users(t: Tables) -> DataFrame:
    return t.users


@query
def stg_mcc(t: Tables) -> DataFrame:
    return t.mcc


@query
def clean_transactions(t: Tables) -> DataFrame:
    return staging.clean_transactions(t.landing)


@query
def clean_cards(t: Tables) -> DataFrame:
    return staging.clean_cards(t.raw_cards)


@query
def clean_users(t: Tables) -> DataFrame:
    return staging.clean_users(t.raw_users)


# --- joins --------------------------------------------------------------------------------


@query
def int_transactions_enriched(t: Tables) -> DataFrame:
    return t.enriched


@query
def int_client_transactions(t: Tables) -> DataFrame:
    return enrich.client_transactions(t.enriched, t.users, t.cards)


@query
def client_home_state(t: Tables) -> DataFrame:
    return enrich.home_state(t.transactions)


@query
def client_home_zip(t: Tables) -> DataFrame:
    return enrich.home_zip(t.transactions)


@query
def home_state_features(t: Tables) -> DataFrame:
    rows = fraud_mart.home_columns(t.transactions, enrich.client_homes(t.transactions))
    return rows.select(
        "transaction_id", "client_id", "is_out_of_home_state", "is_different_zip", "zip_region_distance"
    )


@query
def home_state_point_in_time(t: Tables) -> DataFrame:
    return fraud_mart.home_state_so_far(t.transactions)


@query
def load_features_by_id(t: Tables) -> DataFrame:
    """The model's mart columns of the labelled rows."""
    wanted = t.labels.select("transaction_id")
    columns = [c for c in models.FRAUD_FEATURES if not c.endswith("_te")]
    return t.mart().join(wanted, "transaction_id", "left_semi").select("transaction_id", *columns)


@query
def attach_labels(t: Tables) -> DataFrame:
    return explore.attach_labels(t.transactions, t.labels).select(
        "transaction_id", F.col("is_fraud").cast("double").alias("is_fraud")
    )


# --- single-row features ------------------------------------------------------------------


@query
def feat_time(t: Tables) -> DataFrame:
    return fraud_mart.time_columns(t.transactions).select(
        "transaction_id", "txn_hour", "txn_day_of_week", "txn_month", "txn_year", "is_weekend", "txn_epoch"
    )


@query
def feat_amount(t: Tables) -> DataFrame:
    rows = fraud_mart.card_columns(fraud_mart.amount_columns(t.transactions), t.cards)
    return rows.select("transaction_id", "abs_amount", "is_expense", "log_amount", "amount_to_limit_ratio")


@query
def feat_card_age(t: Tables) -> DataFrame:
    return fraud_mart.card_columns(t.transactions, t.cards).select("transaction_id", "card_age_months")


@query
def feat_user(t: Tables) -> DataFrame:
    return fraud_mart.user_columns(t.transactions, t.users).select(
        "transaction_id", "current_age", "credit_score", "total_debt", "yearly_income", "debt_to_income_ratio"
    )


# --- ordered features ---------------------------------------------------------------------


def _events_with_time(t: Tables) -> DataFrame:
    return fraud_mart.amount_columns(fraud_mart.time_columns(t.transactions))


def _card_windows(t: Tables, columns: Sequence[str], cap: int | None = None) -> DataFrame:
    heavy = heavy_entities(t.transactions, "card_id", *([] if cap is None else [cap]))
    rows = fraud_mart.with_card_windows(_events_with_time(t), heavy)
    return rows.select("transaction_id", "card_id", *columns)


def _client_windows(t: Tables, columns: Sequence[str], cap: int | None = None) -> DataFrame:
    heavy = heavy_entities(t.transactions, "client_id", *([] if cap is None else [cap]))
    rows = fraud_mart.with_client_windows(_events_with_time(t), heavy)
    return rows.select("transaction_id", "client_id", *columns)


@query
def win_seconds_since_last(t: Tables) -> DataFrame:
    return _card_windows(t, ["seconds_since_last_txn"])


VELOCITY = ["card_txn_count_1h", "card_txn_count_24h", "card_txn_count_7d"]


@query
def win_velocity_counts(t: Tables) -> DataFrame:
    return _card_windows(t, VELOCITY)


@query
def win_amount_sum_24h(t: Tables) -> DataFrame:
    return _card_windows(t, ["card_amount_sum_24h"])


@query
def win_prior_24h(t: Tables) -> DataFrame:
    return _card_windows(t, ["card_amount_sum_prior_24h"])


@query
def win_card_errors_7d(t: Tables) -> DataFrame:
    return _card_windows(t, ["card_errors_7d"])


@query
def win_card_frequency(t: Tables) -> DataFrame:
    return _card_windows(t, ["card_mcc_freq", "card_merchant_freq"])


@query
def win_lag_patterns(t: Tables) -> DataFrame:
    return _card_windows(t, ["channel_switched", "card_testing_pattern", "prev_txn_amount"])


@query
def win_gap_stats(t: Tables) -> DataFrame:
    return _card_windows(t, ["card_avg_gap_last20", "card_std_gap_last20"])


@query
def win_min_gap_24h(t: Tables) -> DataFrame:
    return _card_windows(t, ["min_gap_24h"])


@query
def distinct_proxies(t: Tables) -> DataFrame:
    return _card_windows(t, ["card_distinct_mcc_7d", "client_distinct_cards_24h", "card_distinct_merchants_1h"])


@query
def win_client_last50(t: Tables) -> DataFrame:
    return _client_windows(t, ["client_avg_amount_last50", "client_std_amount_last50"])


@query
def win_client_max_hist(t: Tables) -> DataFrame:
    return _client_windows(t, ["client_max_amount_hist"])


@query
def win_client_p90(t: Tables) -> DataFrame:
    return _client_windows(t, ["client_p90_amount_last50"])


@query
def win_avg_hour(t: Tables) -> DataFrame:
    return _client_windows(t, ["client_avg_hour_last50"])


@query
def win_distinct_exact(t: Tables) -> DataFrame:
    return fraud_mart.distinct_features(t.transactions).select(
        "transaction_id",
        "card_distinct_mcc_7d_exact",
        "card_distinct_merchants_1h_exact",
        "client_distinct_cards_24h_exact",
    )


CARD_CUT = [*VELOCITY, "card_errors_7d", "card_mcc_freq", "prev_txn_amount", "card_std_gap_last20", "min_gap_24h"]


@query
def card_windows_cut(t: Tables) -> DataFrame:
    """The path for cards with very many rows, taken here by every card above 35 rows."""
    return _card_windows(t, CARD_CUT, cap=35)


CLIENT_CUT = ["client_avg_amount_last50", "client_max_amount_hist"]


@query
def client_windows_cut(t: Tables) -> DataFrame:
    """The path for clients with very many rows, taken here by every client above 65 rows."""
    return _client_windows(t, CLIENT_CUT, cap=65)


# --- the mart -----------------------------------------------------------------------------


@query
def mart_fraud_features(t: Tables) -> DataFrame:
    return t.mart()


@query
def feat_deviation(t: Tables) -> DataFrame:
    return t.mart().select(
        "transaction_id", "amount_zscore", "amount_vs_client_max", "above_client_p90", "gap_zscore"
    )


@query
def feat_novelty(t: Tables) -> DataFrame:
    return t.mart().select("transaction_id", "is_new_merchant", "is_new_mcc", "rapid_succession")


@query
def feat_combined_risk(t: Tables) -> DataFrame:
    return t.mart().select(
        "transaction_id", "online_new_merchant", "online_high_amount", "oos_new_merchant", "error_online"
    )


@query
def feat_behaviour(t: Tables) -> DataFrame:
    return t.mart().select(
        "transaction_id", "spend_acceleration", "daily_utilization", "hour_deviation", "is_night_txn"
    )


# --- monthly mart and forecast features ---------------------------------------------------


@query
def mart_client_monthly_expenses(t: Tables) -> DataFrame:
    return t.monthly


KEY = ["client_id", "expense_month"]


@query
def forecast_lags(t: Tables) -> DataFrame:
    return monthly.add_lags(t.monthly).select(*KEY, *monthly.LAG_COLUMNS)


@query
def forecast_rolling(t: Tables) -> DataFrame:
    return monthly.add_rolling(t.monthly).select(*KEY, *monthly.ROLLING_COLUMNS)


@query
def forecast_zero_freq(t: Tables) -> DataFrame:
    return monthly.add_zero_frequency(t.monthly).select(*KEY, "total_expenses", "zero_freq_6m")


@query
def forecast_context(t: Tables) -> DataFrame:
    return t.forecast_features.select(*KEY, *monthly.CONTEXT_COLUMNS, "max_ratio")


@query
def forecast_targets(t: Tables) -> DataFrame:
    return monthly.add_targets(t.monthly).select(*KEY, *[f"target_h{h}" for h in monthly.HORIZONS])


@query
def forecast_features(t: Tables) -> DataFrame:
    return t.forecast_features


@query
def latest_client_features(t: Tables) -> DataFrame:
    return monthly.latest_features(t.forecast_features)


def _last_month(t: Tables):
    return t.ledger.select(F.trunc(F.max("transaction_date"), "MM")).scalar()


@query
def walk_forward_folds(t: Tables) -> DataFrame:
    rows = monthly.add_targets(monthly.add_lags(t.monthly))
    return monthly.fold_rows(rows, _last_month(t))


@query
def walk_forward_folds_strict(t: Tables) -> DataFrame:
    rows = monthly.add_targets(monthly.add_lags(t.monthly))
    return monthly.fold_rows(rows, _last_month(t), strict=True)


@query
def forecast_baselines(t: Tables) -> DataFrame:
    rows = explore.with_baselines(t.forecast_features).filter(F.col("lag_12").isNotNull())
    long = rows.unpivot(["client_id", "expense_month", "total_expenses"], list(explore.BASELINES), "method", "forecast")
    return evaluate.regression_scores(long, ["method"], "total_expenses", "forecast")


@query
def forecast_metrics(t: Tables) -> DataFrame:
    """Twelve-month mean as the forecast of every horizon, scored per horizon and month."""
    rows = monthly.add_targets(t.forecast_features).filter(F.col("lag_12").isNotNull())
    long = rows.unpivot(
        ["expense_month", "rmean_12"], [f"target_h{h}" for h in monthly.HORIZONS], "horizon", "actual"
    )
    return evaluate.regression_scores(long, ["expense_month", "horizon"], "actual", "rmean_12")


@query
def per_client_r2(t: Tables) -> DataFrame:
    rows = explore.with_baselines(t.forecast_features).filter(F.col("lag_12").isNotNull())
    return evaluate.regression_scores(rows, ["client_id"], "total_expenses", "mean_12")


@query
def variance_decomposition(t: Tables) -> DataFrame:
    return tidy(explore.variance_decomposition(t.monthly).select(
        *[F.round(c, 2).alias(c) for c in ("between_clients", "within_clients")], "share"
    ))


@query
def client_volatility(t: Tables) -> DataFrame:
    return explore.client_volatility(t.monthly)


# --- questions ----------------------------------------------------------------------------


@query
def q1_latest_expiry_card(t: Tables) -> DataFrame:
    return questions.latest_expiry_card(t.cards)


@query
def q2_retiring_client(t: Tables) -> DataFrame:
    return questions.retiring_client(t.users)


@query
def q3_largest_online_dec31(t: Tables) -> DataFrame:
    return questions.largest_online_year_end(t.ledger)


@query
def q4_top_visa_client(t: Tables) -> DataFrame:
    return questions.top_brand_client(t.ledger, t.cards, t.users, "visa", 1996, 2, 40)


# --- summaries and reports ----------------------------------------------------------------


def _requests(t: Tables, start: str, days: int) -> DataFrame:
    """One request per client, starting in a different month for each."""
    begin = F.add_months(F.lit(start).cast("date"), (F.col("client_id") % 24).cast("int"))
    return t.users.select(
        F.col("client_id").alias("request_id"),
        "client_id",
        begin.alias("start_date"),
        F.date_add(begin, days).alias("end_date"),
    )


@query
def earnings_and_expenses(t: Tables) -> DataFrame:
    return summaries.earnings_and_expenses(t.ledger, _requests(t, "1996-01-01", 120))


@query
def expenses_summary(t: Tables) -> DataFrame:
    return summaries.expenses_summary(t.ledger, _requests(t, "1996-01-01", 400), t.mcc)


@query
def cash_flow_weekly(t: Tables) -> DataFrame:
    return summaries.cash_flow(t.ledger, _requests(t, "1996-01-01", 55))


@query
def cash_flow_monthly(t: Tables) -> DataFrame:
    return summaries.cash_flow(t.ledger, _requests(t, "1996-01-01", 200))


@query
def report_cash_flow_totals(t: Tables) -> DataFrame:
    return summaries.cash_flow_totals(summaries.cash_flow(t.ledger, _requests(t, "1996-01-01", 200)))


@query
def report_narrative_facts(t: Tables) -> DataFrame:
    facts = summaries.report_facts(t.ledger, _requests(t, "1996-01-01", 200), t.mcc)
    return facts.withColumns({c: F.col(c).cast("double") for c in ("n_categories", "n_positive", "n_periods")})


def _prompts(t: Tables) -> DataFrame:
    """One prompt per client, in nine phrasings with years that vary by client."""
    key = F.col("client_id")
    year = (1995 + key % 6).cast("string")
    phrasings = [
        F.concat(F.lit("Create a report from "), year, F.lit("-01-01 to "), year, F.lit("-05-31")),
        F.concat(F.lit("Between "), year, F.lit("-02-01 and "), year, F.lit("-03-15, please")),
        F.concat(F.lit("Create a report for the fourth month of "), year),
        F.concat(F.lit("Report on the third quarter of "), year),
        F.concat(F.lit("Q2 "), year, F.lit(" summary")),
        F.concat(F.lit("Create a report for February "), year),
        F.concat(F.lit("Annual report "), year),
        F.lit("Report for last spring"),
        F.concat(F.lit("the twelfth month of "), year),
    ]
    return t.users.select(
        key.alias("request_id"),
        "client_id",
        F.element_at(F.array(*phrasings), (key % len(phrasings) + 1).cast("int")).alias("prompt"),
    )


@query
def extract_report_period(t: Tables) -> DataFrame:
    prompts = _prompts(t).withColumn("p", period_of(F.col("prompt")))
    return prompts.select("request_id", "prompt", "p.start_date", "p.end_date")


@query
def parse_period_reply(t: Tables) -> DataFrame:
    key = F.col("request_id")
    month = F.lpad((1 + key % 12).cast("string"), 2, "0")
    as_json = F.concat(
        F.lit('Sure: {"start_date": "2001-'), month, F.lit('-01", "end_date": "2001-'), month, F.lit('-28"} done')
    )
    as_lines = F.concat(F.lit("Start Date: 2002-"), month, F.lit("-01\nend_date: 2002-"), month, F.lit("-28"))
    broken = F.lit('{"start_date": "soon", "end_date": "later"}')
    reply = F.element_at(F.array(as_json, as_lines, broken, F.lit("I do not know")), (key % 4 + 1).cast("int"))
    rows = _prompts(t).withColumn("r", period_of_reply(reply, F.col("prompt"), "remote"))
    return rows.select("request_id", "r.start_date", "r.end_date", "r.backend_used")


@query
def report_requests(t: Tables) -> DataFrame:
    report = summaries.report_requests(_prompts(t), t.ledger, t.mcc)
    return report.select(
        "request_id",
        "client_id",
        "start_date",
        "end_date",
        "create_report",
        "earnings",
        "expenses",
        F.col("n_categories").cast("double").alias("n_categories"),
        "top_category",
        F.col("n_periods").cast("double").alias("n_periods"),
    )


# --- exploration --------------------------------------------------------------------------


@query
def data_profile(t: Tables) -> DataFrame:
    return explore.data_profile(explore.attach_labels(t.transactions, t.labels))


@query
def eda_class_balance(t: Tables) -> DataFrame:
    return t.labelled.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"))


@query
def eda_error_rate(t: Tables) -> DataFrame:
    return explore.error_rates(t.labelled)


@query
def eda_channel_rate(t: Tables) -> DataFrame:
    return explore.rate_by(t.labelled, F.col("use_chip"), "use_chip")


@query
def eda_hourly_rate(t: Tables) -> DataFrame:
    return explore.rate_by(t.labelled, F.hour("transaction_date"), "txn_hour")


@query
def eda_weekday_rate(t: Tables) -> DataFrame:
    return explore.weekday_rates(t.labelled)


@query
def eda_amount_quantiles(t: Tables) -> DataFrame:
    return explore.amount_quantiles(t.labelled)


@query
def eda_amount_quantiles_cut(t: Tables) -> DataFrame:
    """The same quantiles over many slots, as for a large table."""
    return explore.amount_quantiles(t.labelled, rows_per_slot=1000)


@query
def eda_amount_histogram(t: Tables) -> DataFrame:
    return explore.amount_histogram(t.labelled)


@query
def score_histogram(t: Tables) -> DataFrame:
    return explore.histogram(t.scored(), "label", F.col("score"), 100)


@query
def residual_histogram(t: Tables) -> DataFrame:
    """Residuals of the twelve-month mean, per quarter of the year."""
    rows = t.forecast_features.filter(F.col("lag_12").isNotNull()).withColumn("quarter", F.quarter("expense_month"))
    return explore.histogram(rows, "quarter", F.round(F.col("rmean_12") - F.col("total_expenses"), 4), 80)


@query
def eda_out_of_state(t: Tables) -> DataFrame:
    return explore.out_of_state_rates(t.labelled)


@query
def leak_check_zip(t: Tables) -> DataFrame:
    rows = fraud_mart.home_columns(t.transactions, enrich.client_homes(t.transactions))
    return explore.home_zip_rates(rows.join(t.labels, "transaction_id"))


@query
def psi_drift(t: Tables) -> DataFrame:
    rows = t.transactions.withColumn("size", F.abs("amount"))
    return explore.psi_drift(rows, F.dayofmonth("transaction_date") > 20, "size")


# --- data quality -------------------------------------------------------------------------


@query
def dq_not_null(t: Tables) -> DataFrame:
    tables = {"transactions": t.transactions, "cards": t.cards, "users": t.users, "mcc": t.mcc, "monthly": t.monthly}
    columns = {
        "transactions": ["transaction_id", "transaction_date", "client_id", "card_id", "amount", "mcc", "zip", "errors"],
        "cards": ["card_id", "client_id", "credit_limit"],
        "users": ["client_id"],
        "mcc": ["mcc", "category_name"],
        "monthly": ["client_id", "expense_month", "avg_expense_amount"],
    }
    return quality.null_counts_by_table(tables, columns)


@query
def dq_unique(t: Tables) -> DataFrame:
    tables = {
        "transactions": t.transactions,
        "users": t.users,
        "mcc": t.mcc,
        "monthly": t.monthly,
        "lineitem": t.given("lineitem"),
    }
    keys = {
        "transactions": ["transaction_id"],
        "users": ["client_id"],
        "mcc": ["mcc"],
        "monthly": ["client_id", "expense_month"],
        "lineitem": ["l_orderkey", "l_linenumber"],
    }
    return quality.repeated_keys(tables, keys)


@query
def dq_deduplicate(t: Tables) -> DataFrame:
    lines = t.given("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return quality.keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query
def dq_null_counts(t: Tables) -> DataFrame:
    return quality.null_counts(t.transactions)


@query
def dq_iqr_fences(t: Tables) -> DataFrame:
    return quality.fences(t.given("events").select("value", F.abs("value").alias("size")), ["value", "size"])


@query
def dq_iqr_outliers(t: Tables) -> DataFrame:
    return quality.outliers(t.transactions.withColumn("size", F.abs("amount")), "transaction_id", ["amount", "size"])


def _raw_requests(t: Tables) -> DataFrame:
    """Scoring requests as received text, some fields broken by rule of the event's number."""
    event, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
    text = "string"
    return t.given("events").select(
        event.cast(text).alias("transaction_id"),
        F.when(event % 50 == 7, "abc").otherwise((-F.col("value")).cast("decimal(18,2)").cast(text)).alias("amount"),
        F.when(F.col("event_type").isin("click", "error"), "Online Transaction")
        .otherwise("Swipe Transaction")
        .alias("use_chip"),
        F.when(event % 40 != 3, (5000 + k % 30).cast(text)).alias("mcc"),
        k.cast(text).alias("merchant_id"),
        F.when(event % 60 == 11, "2").otherwise(F.col("event_type").isin("click", "error").cast("int").cast(text)).alias("is_online"),
        F.when(k % 7 == 0, "1").otherwise("0").alias("has_bad_cvv"),
        (F.col("event_type") == "error").cast("int").cast(text).alias("has_any_error"),
        (F.hour("ts") + F.when(event % 30 == 5, 24).otherwise(0)).cast(text).alias("txn_hour"),
        (1000 + k * 10).cast(text).alias("credit_limit"),
        (450 + k).cast(text).alias("credit_score"),
        (k % 5).cast(text).alias("card_txn_count_24h"),
        F.when(k % 3 > 0, (k * 60).cast(text)).alias("seconds_since_last_txn"),
    )


@query
def dq_request_rules(t: Tables) -> DataFrame:
    checked = quality.checked_requests(_raw_requests(t))
    return checked.select(
        "transaction_id", F.concat_ws("; ", "reasons").alias("reasons"), (F.size("reasons") == 0).alias("is_valid")
    )


# --- encoding and splits ------------------------------------------------------------------

TIME_ORDER = ["transaction_date", "transaction_id"]


@query
def target_encode_oof(t: Tables) -> DataFrame:
    rows = t.labelled.select("transaction_id", "transaction_date", "mcc", "merchant_id", "is_fraud")
    encoded = encoding.encode_out_of_fold(rows, ["mcc"], "is_fraud", TIME_ORDER)
    return encoded.select("transaction_id", "mcc", "mcc_te")


@query
def target_encode_oof_cut(t: Tables) -> DataFrame:
    """Out-of-fold encoding of the merchants with the row order cut into many slots."""
    rows = t.labelled.select("transaction_id", "transaction_date", "merchant_id", "is_fraud")
    encoded = encoding.encode_out_of_fold(rows, ["merchant_id"], "is_fraud", TIME_ORDER, rows_per_slot=900)
    return encoded.select("transaction_id", "merchant_id", "merchant_id_te")


@query
def target_encode_apply(t: Tables) -> DataFrame:
    encoded = encoding.apply_encoding(t.transactions, t.labelled, "mcc", "is_fraud")
    return encoding.apply_encoding(encoded, t.labelled, "merchant_id", "is_fraud").select(
        "transaction_id", "mcc_te", "merchant_id_te"
    )


@query
def temporal_split(t: Tables) -> DataFrame:
    rows = encoding.temporal_split(t.labelled.select(*TIME_ORDER, "is_fraud"), TIME_ORDER)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("is_fraud").alias("fraud_rate"),
        F.min("transaction_date").alias("first_time"),
        F.max("transaction_date").alias("last_time"),
    )


# --- metrics ------------------------------------------------------------------------------


@query
def average_precision(t: Tables) -> DataFrame:
    return evaluate.average_precision(t.scored())


@query
def pr_curve(t: Tables) -> DataFrame:
    return evaluate.pr_curve(t.scored())


@query
def pr_curve_cut(t: Tables) -> DataFrame:
    """The curve with its distinct scores cut into many slots."""
    return evaluate.pr_curve(t.scored(), rows_per_slot=50)


@query
def pr_operating_points(t: Tables) -> DataFrame:
    return evaluate.operating_points(t.scored())


@query
def threshold_sweep(t: Tables) -> DataFrame:
    return evaluate.threshold_sweep(t.scored())


@query
def best_thresholds(t: Tables) -> DataFrame:
    return evaluate.best_thresholds(evaluate.threshold_sweep(t.scored()))


@query
def confusion_matrix(t: Tables) -> DataFrame:
    return evaluate.confusion(t.scored(), list(evaluate.OPERATING_POINTS.values()))


@query
def classification_report(t: Tables) -> DataFrame:
    return evaluate.class_report(t.scored(), list(evaluate.OPERATING_POINTS.values()))


@query
def focal_grad_hess(t: Tables) -> DataFrame:
    return t.scored().select("transaction_id", *[c.alias(n) for n, c in evaluate.focal_terms(F.col("label"), F.col("raw")).items()])


@query
def focal_loss(t: Tables) -> DataFrame:
    return t.scored().agg(evaluate.focal_loss(F.col("label"), F.col("raw")).alias("focal_loss"), F.count(F.lit(1)).alias("n"))


# --- ingestion and streaming --------------------------------------------------------------


def _raw_messages(events: DataFrame) -> DataFrame:
    """Transactions as received text; some client and card numbers do not parse."""
    landing = given_tables.landing_of(events)
    event, text = F.col("id"), "string"
    return landing.select(
        event.cast(text).alias("id"),
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.when(event % 41 == 0, "x7").otherwise(F.col("client_id").cast(text)).alias("client_id"),
        F.when(event % 67 == 5, "").otherwise(F.col("card_id").cast(text)).alias("card_id"),
        "amount",
        "use_chip",
        F.col("merchant_id").cast(text).alias("merchant_id"),
        "merchant_city",
        "merchant_state",
        F.coalesce("zip", F.lit("")).alias("zip"),
        F.col("mcc").cast(text).alias("mcc"),
        F.coalesce("errors", F.lit("")).alias("errors"),
    )


def _message_stream(t: Tables) -> DataFrame:
    """The events file as a stream of messages, every tenth delivered twice."""
    events = (
        t.spark.readStream.schema(given_tables.SCHEMAS["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(t.folder)
    )
    copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return _raw_messages(events.withColumn("copy", F.explode(copies)).drop("copy"))


def _land_everything(t: Tables) -> tuple[str, str]:
    base = scratch_path(t.spark, "stream")
    landing, quarantine = f"{base}/landing", f"{base}/quarantine"
    start_landing(_message_stream(t), landing, quarantine, f"{base}/checkpoint").awaitTermination()
    return landing, quarantine


@query
def stream_decode(t: Tables) -> DataFrame:
    raw = _raw_messages(t.given("events"))
    payloads = raw.select(F.base64(F.to_json(F.struct(*raw.columns)).cast("binary")).alias("data"))
    rows = decode(payloads)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("client_id", "card_id")})


@query
def stream_landing(t: Tables) -> DataFrame:
    landing, _ = _land_everything(t)
    return t.spark.read.schema(LANDED).parquet(landing)


@query
def stream_quarantine(t: Tables) -> DataFrame:
    _, quarantine = _land_everything(t)
    rows = t.spark.read.parquet(quarantine)
    return rows.select("id", "date", "client_id", "card_id", F.concat_ws(",", "reasons").alias("reasons"))


@query
def replay_chunk(t: Tables) -> DataFrame:
    return replay_statuses(_raw_messages(t.given("events")), days=7)


@query
def replay_stored_cursor(t: Tables) -> DataFrame:
    """The same chunks landed one run after the other, each from the cursor that the run before stored."""
    base = scratch_path(t.spark, "replay")
    raw = store_by_day(_raw_messages(t.given("events")), f"{base}/raw")
    return replay_rest(raw, f"{base}/cursor", f"{base}/landing", f"{base}/quarantine", days=7)


@query
def replay_malformed_split(t: Tables) -> DataFrame:
    checked = with_reasons(_raw_messages(t.given("events")))
    return (
        checked.groupBy(F.concat_ws(",", "reasons").alias("reasons"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    )


@query
def incremental_mart(t: Tables) -> DataFrame:
    """Velocity features refreshed in three steps: first the last ten days, then the rest in two parts."""
    base = scratch_path(t.spark, "incremental")
    landing, features = f"{base}/landing", f"{base}/features"
    rows = t.landing.withColumn("day", F.to_date("date"))
    parts = [rows.filter("dayofmonth(day) > 20"), rows.filter("dayofmonth(day) <= 10"), rows.filter("dayofmonth(day) between 11 and 20")]
    for part in parts:
        part.write.mode("append").partitionBy("day").parquet(landing)
        refresh(t.spark, landing, features, part.select("day"))
    return t.spark.read.parquet(features).select("transaction_id", "card_id", *VELOCITY_COLUMNS)


@query
def incremental_mart_all(t: Tables) -> DataFrame:
    """All columns of the mart, refreshed in three steps whose rows arrive out of order."""
    base = scratch_path(t.spark, "incremental-all")
    landing, mart = f"{base}/landing", f"{base}/mart"
    day = F.dayofmonth("date")
    for part in (t.landing.filter(day > 20), t.landing.filter(day <= 10), t.landing.filter((day > 10) & (day <= 20))):
        part.write.mode("append").parquet(landing)
        landed = t.spark.read.schema(part.schema).parquet(landing)
        refresh_mart(landed, part, mart, t.mcc, t.cards, t.users)
    return t.spark.read.parquet(mart).select(*fraud_mart.MART_COLUMNS)


@query
def stream_features(t: Tables) -> DataFrame:
    """Velocity features kept current by the landing stream."""
    base = scratch_path(t.spark, "stream-features")
    features = f"{base}/features"
    start_refresh(
        _message_stream(t), f"{base}/landing", f"{base}/quarantine", features, f"{base}/checkpoint"
    ).awaitTermination()
    return t.spark.read.parquet(features).select("transaction_id", "card_id", *VELOCITY_COLUMNS)


@query
def stream_velocity(t: Tables) -> DataFrame:
    """Velocity features answered inside the stream from keyed state: three runs of one stream, each going on from the last checkpoint."""
    base = scratch_path(t.spark, "stream-velocity")
    day = F.dayofmonth("date")
    for part in (t.landing.filter(day <= 10), t.landing.filter((day > 10) & (day <= 20)), t.landing.filter(day > 20)):
        part.write.mode("append").parquet(f"{base}/landed")
        stream = t.spark.readStream.schema(part.schema).parquet(f"{base}/landed")
        start_velocity(stream, f"{base}/answers", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{base}/answers").select("transaction_id", "card_id", *VELOCITY_COLUMNS)


# --- models -------------------------------------------------------------------------------

@query
def prepare_features(t: Tables) -> DataFrame:
    rows = models.prepare_features(t.mart())
    return rows.select("transaction_id", "card_has_chip", *[F.col(c).cast("double").alias(c) for c in models.FILL_ZERO])


def _valid_requests(t: Tables) -> DataFrame:
    return quality.checked_requests(_raw_requests(t)).filter(F.size("reasons") == 0)


@query
def score_padding(t: Tables) -> DataFrame:
    """Request features in model order, absent ones 0, encodings learnt on the labelled rows."""
    rows = models.request_features(_valid_requests(t))
    train = t.labelled.withColumnRenamed("is_fraud", "label")
    rows = models.with_encodings(rows, train, TIME_ORDER, False).drop(*models.ENCODED)
    return models.padded(rows, models.FRAUD_FEATURES)


def _training_rows(t: Tables) -> DataFrame:
    # the mart's other columns are neither a feature nor asked for
    mart = t.mart()
    wanted = dict.fromkeys([*TIME_ORDER, *models.ENCODED, *[f for f in models.FRAUD_FEATURES if f in mart.columns]])
    return models.training_rows(mart.select(*wanted), t.labels, TIME_ORDER)


_fitted: dict[tuple[str, str], tuple[models.FocalModel, DataFrame]] = {}


def _fraud_model(t: Tables) -> tuple[models.FocalModel, DataFrame]:
    """The focal model at its full settings and its rows; fitted once per application and folder."""
    place = (t.spark.sparkContext.applicationId, t.folder)
    if place not in _fitted:
        rows = _training_rows(t)
        _fitted[place] = models.fit_focal(rows), rows
    return _fitted[place]


def _encoding_rows(t: Tables) -> DataFrame:
    """Labels and the columns to encode of the labelled rows, staged: every table and mean of the encodings reads them."""
    return stage(t.labelled.select(*models.ENCODED, F.col("is_fraud").alias("label")), "encoding-rows")


def _stated(scored: DataFrame, *columns: str) -> DataFrame:
    """What can be said of any model's scores: they are probabilities, and the flag follows from them."""
    p = F.col("probability")
    return scored.select(
        *columns,
        "threshold",
        F.coalesce((p > 0) & (p < 1), F.lit(False)).alias("score_valid"),
        F.coalesce((F.col("predicted") == 1) == (p >= F.col("threshold")), F.lit(False)).alias("flag_agrees"),
    )


@query
def fraud_model(t: Tables) -> DataFrame:
    """Validation rows as the focal model answers them at the F1 threshold."""
    model, rows = _fraud_model(t)
    scored = model.score(rows.filter("split = 'val'"), evaluate.OPERATING_POINTS["F1-optimal"])
    return _stated(scored, "transaction_id", "label")


@query
def fraud_model_fit(t: Tables) -> DataFrame:
    """One row per split: its size, and whether boosting lowered the focal loss against no trees."""
    model, rows = _fraud_model(t)
    scored = model.raw(rows)
    loss = evaluate.focal_loss(F.col("label"), F.col("raw"))
    untrained = evaluate.focal_loss(F.col("label"), F.lit(0.0))
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_fraud"), (loss < untrained).alias("loss_fell")
    )


@query
def feature_importance(t: Tables) -> DataFrame:
    """The ten features split on most often: each a model input, met once, with no more splits than the one before."""
    model, _ = _fraud_model(t)
    top = [(rank, name, splits) for rank, (name, splits) in enumerate(model.importance()[:10], 1)]
    ranked = t.spark.createDataFrame(top, "rank int, feature string, splits bigint")
    order = Window.orderBy("rank")  # ten rows
    return ranked.select(
        "rank",
        F.col("feature").isin(models.FRAUD_FEATURES).alias("known"),
        (F.count(F.lit(1)).over(Window.partitionBy("feature")) == 1).alias("met_once"),
        ((F.col("splits") > 0) & (F.col("splits") <= F.coalesce(F.lag("splits").over(order), F.col("splits")))).alias("falling"),
    )


@query
def score_requests(t: Tables) -> DataFrame:
    """Scoring requests answered by the focal model at the serving threshold."""
    model, _ = _fraud_model(t)
    train = _encoding_rows(t)
    rows = models.with_encodings(models.request_features(_valid_requests(t)), train, TIME_ORDER, False)
    return _stated(model.score(models.padded(rows, models.FRAUD_FEATURES)), "transaction_id")


@query
def stream_score(t: Tables) -> DataFrame:
    """The same requests arriving as a stream."""
    base = scratch_path(t.spark, "stream-score")
    _raw_requests(t).write.parquet(f"{base}/requests")
    model, _ = _fraud_model(t)
    train = _encoding_rows(t)
    tables = [stage(encoding.encoding_table(train, c, "label"), "encoding") for c in models.ENCODED]
    mean = train.agg(F.avg("label")).first()[0]

    def score(batch: DataFrame) -> DataFrame:
        rows = models.request_features(quality.checked_requests(batch).filter(F.size("reasons") == 0))
        for column, table in zip(models.ENCODED, tables, strict=True):
            rows = rows.join(table, column, "left").fillna({f"{column}_te": mean})
        scored = model.score(models.padded(rows, models.FRAUD_FEATURES))
        return scored.select("transaction_id", "probability", "predicted", "threshold")

    schema = t.spark.read.parquet(f"{base}/requests").schema
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/requests")
    start_scoring(stream, score, f"{base}/scores", f"{base}/checkpoint").awaitTermination()
    return _stated(t.spark.read.parquet(f"{base}/scores"), "transaction_id")


@query
def saved_artifacts(t: Tables) -> DataFrame:
    """Status of all artifacts after saving encodings and latest client features (no model), and the rows read back."""
    path = scratch_path(t.spark, "artifacts")
    train = t.labelled.withColumnRenamed("is_fraud", "label")
    encodings = [f"target_encodings/{column}" for column in models.ENCODED]
    for name, column in zip(encodings, models.ENCODED, strict=True):
        artifacts.save_table(encoding.encoding_table(train, column, "label"), path, name)
    artifacts.save_table(train.agg(F.avg("label").alias("mean")), path, "target_encodings/overall")
    artifacts.save_table(monthly.latest_features(t.forecast_features), path, "client_features")
    rows = {
        "target_encodings": t.spark.read.parquet(f"{path}/{encodings[0]}").select("mcc_te").unionAll(
            t.spark.read.parquet(f"{path}/{encodings[1]}").select("merchant_id_te")
        ),
        "client_features": t.spark.read.parquet(f"{path}/client_features"),
    }
    counted = [df.agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("n_rows")) for name, df in rows.items()]
    status = artifacts.artifact_status(t.spark, path)
    return status.join(counted[0].unionAll(counted[1]), "artifact", "left").fillna(0, "n_rows")


@query
def prediction_output(t: Tables) -> DataFrame:
    """Yes or No for every transaction, labelled or not, and for as many ids without a transaction (No)."""
    scored = t.scored(t.transactions).select("transaction_id", (F.col("score") >= 0.37).cast("int").alias("predicted"))
    ids = t.transactions.select("transaction_id")
    absent = ids.select((-F.col("transaction_id") - 1).alias("transaction_id"))
    return sinks.fraud_predictions(ids.unionByName(absent), scored)


@query
def prediction_summary(t: Tables) -> DataFrame:
    """Share of positive answers, and the spread of the baseline forecasts."""
    answers = prediction_output(t)
    positive = F.count_if(F.col("prediction") == "Yes")
    latest = monthly.latest_features(t.forecast_features).select(F.lit("all").alias("part"), "rmean_12")
    middle = exact_quantiles(latest, ["part"], "rmean_12", {"median": 0.5})
    return answers.agg(
        F.count(F.lit(1)).alias("n_predictions"),
        positive.alias("n_positive"),
        (positive / F.count(F.lit(1))).alias("positive_share"),
    ).withColumns(
        {
            "n_forecasts": middle.select("n").scalar(),
            "median_forecast": middle.select("median").scalar(),
            "mean_forecast": latest.select(F.avg("rmean_12")).scalar(),
        }
    )


_forecasts: dict[tuple[str, str], tuple[dict, DataFrame]] = {}


def _horizon_models(t: Tables) -> tuple[dict, DataFrame]:
    """The three horizon models at their full settings and their rows; fitted once per application and folder."""
    place = (t.spark.sparkContext.applicationId, t.folder)
    if place not in _forecasts:
        rows = models.trained_rows(t.monthly, t.users)
        _forecasts[place] = models.fit_horizons(rows), rows
    return _forecasts[place]


@query
def forecast_model(t: Tables) -> DataFrame:
    """One row per horizon: its rows, and whether the model misses less than the mean of its rows would."""
    fitted, rows = _horizon_models(t)
    parts = []
    for h, model in fitted.items():
        target = f"target_h{h}"
        answered = model.transform(rows.filter(F.col(target).isNotNull()))
        parts.append(answered.select(F.lit(h).alias("horizon"), F.col(target).alias("actual"), "prediction"))
    pooled = parts[0].unionByName(parts[1]).unionByName(parts[2])
    scores = evaluate.regression_scores(pooled, ["horizon"], "actual", "prediction")
    return scores.select("horizon", "n", (F.col("r2") > 0).alias("better_than_mean"), (F.col("rmse") >= F.col("mae")).alias("scores_agree"))


def _targets(t: Tables) -> DataFrame:
    """The three months after the data for every client, including clients without history."""
    last = t.ledger.select(F.trunc(F.max("transaction_date"), "MM")).scalar()
    return t.users.select(
        "client_id", F.posexplode(F.array(*[F.date_format(F.add_months(last, h), "yyyy-MM") for h in monthly.HORIZONS]))
    ).select("client_id", F.col("col").alias("month"), (F.col("pos") + 1).alias("horizon"))


@query
def forecast_batch(t: Tables) -> DataFrame:
    """Forecasts of the next three months for every client; an answer is an amount, and only known clients get one."""
    fitted, _ = _horizon_models(t)
    answers = models.forecast_batch(_targets(t), monthly.latest_features(t.forecast_features), fitted)
    answer = F.col("predicted_expense")
    valid = F.when(F.col("status") == "ok", answer.isNotNull() & (answer >= 0)).otherwise(answer.isNull())
    return answers.select("client_id", "month", "horizon", "status", valid.alias("answer_valid"))


@query
def walk_forward_scores(t: Tables) -> DataFrame:
    """Every fold of the walk-forward at full settings: its rows, and whether its scores are those of a forecast."""
    _, rows = _horizon_models(t)
    folds = models.walk_forward(rows)
    scored = F.col("r2").isNotNull() & (F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae")) & (F.col("r2") <= 1)
    return folds.select("val_month", "horizon", "n_train", "n", "status", F.when(F.col("status") == "ok", scored).alias("scored"))


def names() -> list[str]:
    return list(REGISTRY)
