"""Per-client monthly expenses and the forecast feature matrix built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import at_least, exact_mean, ratio

HORIZONS = (1, 2, 3)
LAGS = (1, 2, 3, 6, 12)
WINDOWS = (3, 6, 12)

# the forecast matrix in order
LAG_COLUMNS = [f"lag_{n}" for n in LAGS]
ROLLING_COLUMNS = [
    *[f"rmean_{n}" for n in WINDOWS],
    *[f"rstd_{n}" for n in WINDOWS],
    "rmedian_6",
    "rmin_6",
    "rmax_6",
]
TREND_COLUMNS = ["trend_3v12", "trend_3v6", "momentum_1", "momentum_3", "cv_12", "cv_6"]
CONTEXT_COLUMNS = ["earn_lag1", "earn_rmean_3", "earn_expense_ratio", "txn_lag1", "txn_rmean_3", "avg_expense_lag1"]
DEMOGRAPHIC_COLUMNS = [
    "current_age",
    "credit_score",
    "yearly_income",
    "total_debt",
    "num_credit_cards",
    "debt_to_income",
]
FORECAST_COLUMNS = [
    *LAG_COLUMNS,
    *ROLLING_COLUMNS,
    *TREND_COLUMNS,
    "zero_freq_6m",
    *CONTEXT_COLUMNS,
    "max_ratio",
    "range_6",
    *DEMOGRAPHIC_COLUMNS,
    "month_of_year",
]


def monthly_expenses(transactions: DataFrame) -> DataFrame:
    """Seven measures per client and month. Sums are exact decimals, combined map-side."""
    amount = F.col("amount")
    spent, earned = amount < 0, amount > 0
    expense = F.sum(F.when(spent, F.abs(amount)).otherwise(F.lit(0)))
    return (
        transactions.groupBy("client_id", F.trunc("transaction_date", "MM").alias("expense_month"))
        .agg(
            expense.cast("double").alias("total_expenses"),
            F.count_if(spent).alias("num_expense_transactions"),
            exact_mean(F.sum(F.when(spent, F.abs(amount))), F.count_if(spent)).alias("avg_expense_amount"),
            F.max(F.when(spent, F.abs(amount))).cast("double").alias("max_expense_amount"),
            F.sum(F.when(earned, amount).otherwise(F.lit(0))).cast("double").alias("total_earnings"),
            F.count_if(earned).alias("num_earning_transactions"),
            F.count(F.lit(1)).alias("total_transactions"),
        )
    )


def _months():
    # a client has one row per month, so a partition is bounded by the calendar
    return Window.partitionBy("client_id").orderBy("expense_month")


def _past(months: int):
    return _months().rowsBetween(-months, -1)


def add_lags(monthly: DataFrame) -> DataFrame:
    """Earlier totals by row: a missing month is skipped, not filled."""
    return monthly.withColumns({f"lag_{n}": F.lag("total_expenses", n).over(_months()) for n in LAGS})


def add_rolling(monthly: DataFrame) -> DataFrame:
    """Statistics of the previous rows; the sample deviation of one value is NULL."""
    x = F.col("total_expenses")
    return monthly.withColumns(
        {
            **{f"rmean_{n}": F.avg(x).over(_past(n)) for n in WINDOWS},
            **{f"rstd_{n}": F.stddev_samp(x).over(_past(n)) for n in WINDOWS},
            "rmedian_6": F.percentile(x, F.lit(0.5)).over(_past(6)),
            "rmin_6": F.min(x).over(_past(6)),
            "rmax_6": F.max(x).over(_past(6)),
        }
    )


def add_zero_frequency(monthly: DataFrame) -> DataFrame:
    """Share of zero months among the previous six; the slot before a client's first month counts as non-zero."""
    zeros = F.sum(F.when(F.col("total_expenses") == 0, 1).otherwise(0)).over(_past(6))
    return monthly.withColumn("zero_freq_6m", zeros / F.least(F.lit(6), F.row_number().over(_months())))


def add_context(monthly: DataFrame) -> DataFrame:
    """Earnings and activity of the previous rows."""
    return monthly.withColumns(
        {
            "earn_lag1": F.lag("total_earnings", 1).over(_months()),
            "earn_rmean_3": F.avg("total_earnings").over(_past(3)),
            "txn_lag1": F.lag("num_expense_transactions", 1).over(_months()),
            "txn_rmean_3": F.avg("num_expense_transactions").over(_past(3)),
            "avg_expense_lag1": F.lag("avg_expense_amount", 1).over(_months()),
            "_max_lag1": F.lag("max_expense_amount", 1).over(_months()),
        }
    )


def add_targets(monthly: DataFrame) -> DataFrame:
    """The total h rows ahead, for each horizon h."""
    return monthly.withColumns({f"target_h{h}": F.lead("total_expenses", h).over(_months()) for h in HORIZONS})


def demographics(users: DataFrame) -> DataFrame:
    return users.select(
        "client_id",
        *DEMOGRAPHIC_COLUMNS[:-1],
        ratio(F.col("total_debt"), F.col("yearly_income")).alias("debt_to_income"),
    )


def _trends() -> dict[str, Column]:
    c = F.col
    per_12, per_6 = at_least(c("rmean_12"), 1.0), at_least(c("rmean_6"), 1.0)
    return {
        "trend_3v12": (c("rmean_3") - c("rmean_12")) / per_12,
        "trend_3v6": (c("rmean_3") - c("rmean_6")) / per_6,
        "momentum_1": c("lag_1") - c("lag_2"),
        "momentum_3": c("lag_1") - c("lag_3"),
        "cv_12": c("rstd_12") / per_12,
        "cv_6": c("rstd_6") / per_6,
        "earn_expense_ratio": c("earn_lag1") / at_least(c("lag_1"), 1.0),
        "max_ratio": c("_max_lag1") / per_6,
        "range_6": c("rmax_6") - c("rmin_6"),
        "month_of_year": F.month("expense_month"),
    }


def forecast_features(monthly: DataFrame, users: DataFrame) -> DataFrame:
    """36 features per client and month, all from earlier months; one exchange on the client."""
    df = add_context(add_zero_frequency(add_rolling(add_lags(monthly))))
    df = df.withColumns(_trends()).join(demographics(users), "client_id", "left")
    return df.select("client_id", "expense_month", "total_expenses", *FORECAST_COLUMNS)


def latest_features(features: DataFrame) -> DataFrame:
    """The last row of every client, as an aggregate."""
    values = [c for c in features.columns if c not in ("client_id", "expense_month")]
    last = F.max_by(F.struct("expense_month", *values), "expense_month").alias("last")
    return features.groupBy("client_id").agg(last).select("client_id", "last.*")


def fold_rows(features: DataFrame, last_month, folds: int = 8, strict: bool = False) -> DataFrame:
    """Which rows train and which validate, per fold and horizon.

    Returns (val_month, horizon, n_train, n_val). ``last_month`` is the newest month of the
    data; the folds are the ``folds`` months ending three months before it. ``strict`` keeps
    only training rows whose target month lies before the validation month.
    """
    spine = F.sequence(
        F.add_months(F.lit(last_month), -2 - folds), F.add_months(F.lit(last_month), -3), F.expr("interval 1 month")
    )
    long = (
        features.filter(F.col("lag_12").isNotNull())
        .select(
            "expense_month",
            *[
                F.struct(F.lit(h).alias("horizon"), F.col(f"target_h{h}").isNotNull().alias("known")).alias(f"h{h}")
                for h in HORIZONS
            ],
        )
        .select("expense_month", F.inline(F.array(*[f"h{h}" for h in HORIZONS])))
        .filter("known")
        # counts per month first: the fold expansion then works on a few hundred rows
        .groupBy("expense_month", "horizon")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ahead = F.col("horizon") if strict else F.lit(0)
    train = F.add_months("expense_month", ahead) < F.col("val_month")
    return (
        long.withColumn("val_month", F.explode(spine))
        .groupBy("val_month", "horizon")
        .agg(
            F.sum(F.when(train, F.col("n")).otherwise(0)).alias("n_train"),
            F.sum(F.when(F.col("expense_month") == F.col("val_month"), F.col("n")).otherwise(0)).alias("n_val"),
        )
    )
