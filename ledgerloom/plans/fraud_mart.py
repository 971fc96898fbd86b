"""The fraud feature mart: one row per transaction, 80 columns.

Client features come first, then all card features, so the plan needs one exchange per
entity; frequency windows over (card, mcc) and (card, merchant) reuse the card exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import epoch_seconds, exact_mean, flag, part, ratio
from ledgerloom.operators.enrich import client_homes, with_category
from ledgerloom.operators.windows import BLOCK_ROWS, ENTITY_ROWS, Earlier, History, Rows, Span, add_features, heavy_entities

HOUR, DAY, WEEK = 3600, 86400, 604800

AMOUNT = "cast(abs_amount as double)"


def time_columns(df: DataFrame) -> DataFrame:
    when = F.col("transaction_date")
    return df.withColumns(
        {
            "txn_hour": F.hour(when),
            "txn_day_of_week": F.dayofweek(when),
            "txn_month": F.month(when),
            "txn_year": F.year(when),
            "is_weekend": flag(F.dayofweek(when).isin(1, 7)),
            "txn_epoch": epoch_seconds(when),
        }
    )


def amount_columns(df: DataFrame) -> DataFrame:
    amount = F.col("amount")
    return df.withColumns(
        {
            "abs_amount": F.abs(amount),
            "is_expense": flag(amount < 0),
            "log_amount": F.log1p(F.abs(amount).cast("double")),
        }
    )


def card_columns(df: DataFrame, cards: DataFrame) -> DataFrame:
    """Attributes of the card, which must belong to the client, and its age in months."""
    attributes = cards.select(
        "card_id",
        "client_id",
        "card_brand",
        "card_type",
        "credit_limit",
        F.col("has_chip").alias("card_has_chip"),
        "acct_open_date",
    )
    opened_month, opened_year = part("acct_open_date", 1), part("acct_open_date", 2)
    when = F.col("transaction_date")
    return (
        df.join(attributes, ["card_id", "client_id"], "left")
        .withColumns(
            {
                "amount_to_limit_ratio": ratio(F.abs("amount").cast("double"), F.col("credit_limit")),
                "card_age_months": (F.year(when) - opened_year) * 12 + (F.month(when) - opened_month),
            }
        )
        .drop("acct_open_date")
    )


def user_columns(df: DataFrame, users: DataFrame) -> DataFrame:
    attributes = users.select("client_id", "current_age", "credit_score", "total_debt", "yearly_income")
    return df.join(attributes, "client_id", "left").withColumn(
        "debt_to_income_ratio", ratio(F.col("total_debt"), F.col("yearly_income"))
    )


def home_columns(df: DataFrame, homes: DataFrame) -> DataFrame:
    """Distance from the client's usual state and zip, taken over all rows.

    An online row has a blank state, which differs from every home state, so it counts
    as out of home. The zip distance keeps the fraction of the division by 100.
    """
    state, zip_code = F.col("merchant_state"), F.col("zip")
    both = F.col("home_zip").isNotNull() & zip_code.isNotNull()
    return (
        df.join(homes, "client_id", "left")
        .withColumns(
            {
                "is_out_of_home_state": flag(F.col("home_state").isNotNull() & (state != F.col("home_state"))),
                "is_different_zip": flag(both & (zip_code != F.col("home_zip"))),
                "zip_region_distance": F.when(
                    both, F.abs(zip_code.cast("bigint") / 100 - F.col("home_zip").cast("bigint") / 100)
                ).otherwise(F.lit(0.0)),
            }
        )
        .drop("home_state", "home_zip")
    )


def base_features(transactions: DataFrame, mcc: DataFrame, cards: DataFrame, users: DataFrame) -> DataFrame:
    """The single-row part of the mart, plus the zip for later use."""
    df = amount_columns(time_columns(with_category(transactions, mcc)))
    df = user_columns(card_columns(df, cards), users)
    return home_columns(df, client_homes(transactions)).drop("errors", "zip")


CLIENT_FEATURES = (
    # the mean comes from an exact decimal sum, so it does not depend on summation order
    Rows("_sum_last50", "sum", "abs_amount", 50),
    Rows("_n_last50", "count", "abs_amount", 50),
    Rows("client_std_amount_last50", "stddev", AMOUNT, 50),
    History("client_max_amount_hist", "max", AMOUNT),
    Rows("client_avg_hour_last50", "avg", "txn_hour", 50),
)

CARD_FEATURES = (
    Earlier("_prev_epoch", "txn_epoch"),
    Earlier("_prev_chip", "use_chip"),
    Earlier("prev_txn_amount", AMOUNT),
    Span("_n_1h", "count", "1", HOUR),
    Span("_n_24h", "count", "1", DAY),
    Span("_n_7d", "count", "1", WEEK),
    Span("_sum_24h", "sum", "abs_amount", DAY),
    Span("card_errors_7d", "sum", "has_any_error", WEEK),
    Span("_sum_prior", "sum", "abs_amount", 2 * DAY, DAY),
)

GAP_AND_FREQUENCY_FEATURES = (
    Rows("card_avg_gap_last20", "avg", "seconds_since_last_txn", 20),
    Rows("card_std_gap_last20", "stddev", "seconds_since_last_txn", 20),
    Span("min_gap_24h", "min", "seconds_since_last_txn", DAY),
    # last, since their windows need sorts of their own
    History("card_mcc_freq", "count", "1", ("mcc",)),
    History("card_merchant_freq", "count", "1", ("merchant_id",)),
)


def client_p90() -> Column:
    """avg + 1.3 std, 0 where either is missing or the deviation is 0."""
    return F.coalesce(
        F.col("client_avg_amount_last50") + 1.3 * F.nullif(F.col("client_std_amount_last50"), F.lit(0.0)), F.lit(0.0)
    )


def with_client_windows(df: DataFrame, heavy: DataFrame | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    wide = add_features(df, "client_id", CLIENT_FEATURES, heavy, block_rows=block_rows)
    mean = exact_mean(F.col("_sum_last50"), F.col("_n_last50"))
    wide = wide.withColumn("client_avg_amount_last50", mean).drop("_sum_last50", "_n_last50")
    return wide.withColumn("client_p90_amount_last50", client_p90())


def with_card_windows(df: DataFrame, heavy: DataFrame | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Velocity, frequency, lag and gap features per card.

    Span counts and sums exclude the current row by subtraction, so rows of the same
    second count whichever comes first; the error sum includes the current row.
    """
    wide = add_features(df, "card_id", CARD_FEATURES, heavy, block_rows=block_rows)
    own = F.col("abs_amount")
    wide = wide.withColumns(
        {
            "seconds_since_last_txn": F.col("txn_epoch") - F.col("_prev_epoch"),
            "card_txn_count_1h": F.col("_n_1h") - 1,
            "card_txn_count_24h": F.col("_n_24h") - 1,
            "card_txn_count_7d": F.col("_n_7d") - 1,
            "card_amount_sum_24h": (F.col("_sum_24h") - own).cast("double"),
            "card_amount_sum_prior_24h": F.col("_sum_prior").cast("double"),
            "channel_switched": flag(F.col("use_chip") != F.col("_prev_chip")),
            "card_testing_pattern": flag((F.col("prev_txn_amount") < 5) & (own > 100)),
        }
    ).drop("_prev_epoch", "_prev_chip", "_n_1h", "_n_24h", "_n_7d", "_sum_24h", "_sum_prior")
    wide = wide.withColumns(
        {
            # stand-ins for distinct counts; exact ones are in distinct_features
            "card_distinct_mcc_7d": F.col("card_txn_count_7d"),
            "client_distinct_cards_24h": F.lit(1),
            "card_distinct_merchants_1h": F.col("card_txn_count_1h"),
        }
    )
    return add_features(wide, "card_id", GAP_AND_FREQUENCY_FEATURES, heavy, block_rows=block_rows)


def zscore(value, mean, deviation):
    return F.when(deviation > 0, (value - F.coalesce(mean, value)) / deviation).otherwise(F.lit(0.0))


def derived_columns(df: DataFrame) -> DataFrame:
    c = F.col
    amount = c("abs_amount").cast("double")
    spent = c("card_amount_sum_24h") + amount
    fresh = c("card_merchant_freq") == 0
    online = c("is_online") == 1
    gap = c("seconds_since_last_txn")
    return df.withColumns(
        {
            "amount_zscore": zscore(amount, c("client_avg_amount_last50"), c("client_std_amount_last50")),
            "amount_vs_client_max": ratio(amount, c("client_max_amount_hist")),
            "above_client_p90": flag(amount > c("client_p90_amount_last50")),
            "gap_zscore": F.when(
                gap.isNotNull(), zscore(gap, c("card_avg_gap_last20"), c("card_std_gap_last20"))
            ).otherwise(F.lit(0.0)),
            "is_new_merchant": flag(fresh),
            "is_new_mcc": flag(c("card_mcc_freq") == 0),
            "rapid_succession": flag(gap < 60),
            "online_new_merchant": flag(online & fresh),
            "online_high_amount": flag(online & (amount > c("client_avg_amount_last50") * 2)),
            "oos_new_merchant": flag((c("is_out_of_home_state") == 1) & fresh),
            "error_online": flag((c("has_any_error") == 1) & online),
            "spend_acceleration": ratio(spent, c("card_amount_sum_prior_24h")),
            "daily_utilization": ratio(spent, c("credit_limit")),
            "hour_deviation": F.when(
                c("client_avg_hour_last50").isNotNull(), F.abs(c("txn_hour") - c("client_avg_hour_last50"))
            ).otherwise(F.lit(0.0)),
            "is_night_txn": flag(c("txn_hour").between(1, 5)),
        }
    )


# the mart's columns in order
BASE = (
    "transaction_id client_id card_id amount transaction_date use_chip mcc merchant_category merchant_city "
    "merchant_state merchant_id has_bad_cvv has_bad_expiration has_bad_card_number has_bad_pin "
    "has_insufficient_balance has_technical_glitch has_any_error is_online txn_hour txn_day_of_week txn_month "
    "txn_year is_weekend abs_amount is_expense log_amount card_brand card_type credit_limit card_has_chip "
    "amount_to_limit_ratio card_age_months current_age credit_score total_debt yearly_income "
    "debt_to_income_ratio is_out_of_home_state is_different_zip zip_region_distance txn_epoch"
).split()
WINDOWED = (
    "seconds_since_last_txn card_txn_count_1h card_txn_count_24h card_txn_count_7d card_amount_sum_24h "
    "client_avg_amount_last50 client_std_amount_last50 client_max_amount_hist client_p90_amount_last50 "
    "card_mcc_freq card_merchant_freq card_errors_7d card_amount_sum_prior_24h channel_switched "
    "card_testing_pattern prev_txn_amount client_avg_hour_last50"
).split()
PROXIES = "card_distinct_mcc_7d client_distinct_cards_24h card_distinct_merchants_1h".split()
GAPS = "card_avg_gap_last20 card_std_gap_last20 min_gap_24h".split()
DERIVED = (
    "amount_zscore amount_vs_client_max above_client_p90 gap_zscore is_new_merchant is_new_mcc rapid_succession "
    "online_new_merchant online_high_amount oos_new_merchant error_online spend_acceleration daily_utilization "
    "hour_deviation is_night_txn"
).split()
MART_COLUMNS = [*BASE, *WINDOWED, *PROXIES, *GAPS, *DERIVED]


def fraud_features(
    transactions: DataFrame,
    mcc: DataFrame,
    cards: DataFrame,
    users: DataFrame,
    cap: int = ENTITY_ROWS,
    block_rows: int = BLOCK_ROWS,
    beside: Sequence[str] = (),
) -> DataFrame:
    """The whole mart from staged tables; columns of the transactions named in ``beside`` follow its own."""
    df = base_features(transactions, mcc, cards, users)
    df = with_client_windows(df, heavy_entities(transactions, "client_id", cap), block_rows)
    df = with_card_windows(df, heavy_entities(transactions, "card_id", cap), block_rows)
    return derived_columns(df).select(*MART_COLUMNS, *beside)


def distinct_features(transactions: DataFrame, cap: int = ENTITY_ROWS) -> DataFrame:
    """Exact distinct counts over time spans, the current row included."""
    df = time_columns(transactions)
    by_card = add_features(
        df,
        "card_id",
        [
            Span("card_distinct_mcc_7d_exact", "distinct", "mcc", WEEK),
            Span("card_distinct_merchants_1h_exact", "distinct", "merchant_id", HOUR),
        ],
        heavy_entities(transactions, "card_id", cap),
    )
    return add_features(
        by_card,
        "client_id",
        [Span("client_distinct_cards_24h_exact", "distinct", "card_id", DAY)],
        heavy_entities(transactions, "client_id", cap),
    )


def home_state_so_far(transactions: DataFrame) -> DataFrame:
    """Home state from strictly earlier days only, and whether the row lies outside it.

    Rows are counted per client, state and day first. A state's count only grows, so the
    leader up to a day is the largest count reached by any state on any day so far: a
    running minimum of (-count, state). Every window holds one client's days at most.
    """
    day = F.to_date("transaction_date")
    has_state = F.col("merchant_state").isNotNull() & (F.col("merchant_state") != "")
    daily = transactions.groupBy("client_id", day.alias("day"), "merchant_state").agg(F.count_if(has_state).alias("n"))
    by_state = Window.partitionBy("client_id", "merchant_state").orderBy("day")
    reached = F.sum("n").over(by_state.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = daily.withColumn("reached", reached)
    best = F.min(F.when(F.col("n") > 0, F.struct(-F.col("reached"), F.col("merchant_state").alias("state"))))
    earlier_days = Window.partitionBy("client_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    homes = (
        counted.groupBy("client_id", "day")
        .agg(best.alias("best"))
        .select("client_id", "day", F.min("best").over(earlier_days)["state"].alias("home_state_so_far"))
    )
    rows = transactions.select("transaction_id", "client_id", day.alias("day"), "merchant_state")
    home = F.col("home_state_so_far")
    return rows.join(homes, ["client_id", "day"], "left").select(
        "transaction_id",
        "client_id",
        "home_state_so_far",
        flag(home.isNotNull() & (F.col("merchant_state") != home)).alias("is_out_of_home_so_far"),
    )
