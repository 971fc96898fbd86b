"""Exploratory rate tables, distribution tables and forecast diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import flag
from ledgerloom.operators.enrich import home_state
from ledgerloom.operators.ordered import ROWS_PER_SLOT
from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.operators.staging import ERROR_FLAGS

# fixed values: histogram clip and number of bins, drift bins
CLIP = 500
BINS = 50


def attach_labels(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``is_fraud`` (NULL where unlabelled)."""
    return transactions.join(labels, "transaction_id", "left")


def labelled_only(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("is_fraud").isNotNull())


def _rate() -> Column:
    return F.avg("is_fraud")


def rate_by(rows: DataFrame, group: Column, name: str) -> DataFrame:
    """Fraud rate, count and multiple of the overall rate per group, from one pass over the rows."""
    counts = rows.groupBy(group.alias(name)).agg(F.sum("is_fraud").alias("frauds"), F.count(F.lit(1)).alias("n"))
    rate = F.col("frauds") / F.col("n")
    everything = Window.partitionBy()  # one row per group
    base = F.sum("frauds").over(everything) / F.sum("n").over(everything)
    return counts.select(name, rate.alias("fraud_rate"), "n", F.try_divide(rate, base).alias("multiplier"))


def error_rates(rows: DataFrame) -> DataFrame:
    """Rates of the overlapping error kinds and of rows without an error."""
    kinds = [F.when(F.col(c) == 1, F.lit(phrase)) for c, phrase in ERROR_FLAGS.items()]
    kinds.append(F.when(F.col("has_any_error") == 0, F.lit("No Error")))
    base = rows.select(F.avg("is_fraud")).scalar()
    exploded = rows.select("is_fraud", F.explode(F.array_compact(F.array(*kinds))).alias("error_type"))
    rates = exploded.groupBy("error_type").agg(_rate().alias("fraud_rate"), F.count(F.lit(1)).alias("n"))
    return rates.withColumn("multiplier", F.try_divide("fraud_rate", base))


def weekday_rates(rows: DataFrame) -> DataFrame:
    """Rates by day name with a Monday-first order number."""
    day = F.col("transaction_date")
    return (
        rows.groupBy(F.date_format(day, "EEEE").alias("day_name"), (F.weekday(day) + 1).alias("day_order"))
        .agg(_rate().alias("fraud_rate"), F.count(F.lit(1)).alias("n"))
    )


def amount_quantiles(rows: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Quartiles of the magnitude per class."""
    sized = rows.select("is_fraud", F.abs("amount").alias("size"))
    return exact_quantiles(
        sized, ["is_fraud"], "size", {"q1": 0.25, "median": 0.5, "q3": 0.75}, rows_per_slot
    )


def histogram(rows: DataFrame, group: str, value: Column, bins: int) -> DataFrame:
    """Equal-width bins from each group's minimum to its maximum, with counts and densities."""
    sized = rows.select(F.col(group), value.cast("double").alias("x"))
    # Spark decides from the measured size of the edges how to join them
    edges = sized.groupBy(group).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("total"))
    width = F.col("hi") - F.col("lo")
    position = F.when(width > 0, F.floor((F.col("x") - F.col("lo")) * bins / width)).otherwise(F.lit(0))
    counted = (
        sized.join(edges, group)
        .groupBy(group, "lo", "hi", "total", F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        group,
        "bin",
        (F.col("lo") + F.col("bin") * width / bins).alias("bin_start"),
        "n",
        F.when(width > 0, F.col("n") * bins / (F.col("total") * width)).alias("density"),
    )


def amount_histogram(rows: DataFrame) -> DataFrame:
    return histogram(rows, "is_fraud", F.least(F.abs("amount"), F.lit(CLIP)), BINS)


def data_profile(rows: DataFrame) -> DataFrame:
    """One row: size, date range, label cover, fraud rate and number of clients."""
    labelled = F.count("is_fraud")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.to_date("transaction_date")).alias("first_date"),
        F.max(F.to_date("transaction_date")).alias("last_date"),
        labelled.alias("n_labelled"),
        F.try_divide(labelled, F.count(F.lit(1))).alias("labelled_share"),
        F.avg("is_fraud").alias("fraud_rate"),
        F.count_distinct("client_id").alias("n_clients"),
    )


def out_of_state_rates(rows: DataFrame) -> DataFrame:
    """Rates of rows in and out of the client's usual state among labelled rows; a missing state is out of a known home."""
    homes = home_state(rows)
    away = F.col("home_state").isNotNull() & ~F.col("merchant_state").eqNullSafe(F.col("home_state"))
    return (
        rows.join(homes, "client_id", "left")
        .groupBy(away.alias("out_of_state"))
        .agg(_rate().alias("fraud_rate"), F.count(F.lit(1)).alias("n"))
    )


def home_zip_rates(mart: DataFrame) -> DataFrame:
    """Rates inside and outside the home zip: a large gap marks a leaking feature."""
    return mart.groupBy("is_different_zip").agg(_rate().alias("fraud_rate"), F.count(F.lit(1)).alias("n"))


# --- forecast diagnostics ---------------------------------------------------------------


def variance_decomposition(monthly: DataFrame) -> DataFrame:
    """Share of the variance of monthly totals that lies between clients."""
    per_client = monthly.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("total_expenses").alias("mean"),
        F.var_pop("total_expenses").alias("var"),
    )
    # squares of distances from the overall mean: the difference of two large squares would lose digits
    per_client = per_client.withColumn("overall", monthly.select(F.avg("total_expenses")).scalar())
    n, off = F.col("n"), F.col("mean") - F.col("overall")
    within = F.try_divide(F.sum(n * F.col("var")), F.sum(n))
    between = F.try_divide(F.sum(n * off * off), F.sum(n))
    return per_client.agg(
        between.alias("between_clients"), within.alias("within_clients"), F.try_divide(between, between + within).alias("share")
    )


def client_volatility(monthly: DataFrame) -> DataFrame:
    """Per client: variation, share of zero months, and correlation with 1 and 12 rows before."""
    months = Window.partitionBy("client_id").orderBy("expense_month")
    x = F.col("total_expenses")
    rows = monthly.withColumns({"_l1": F.lag(x, 1).over(months), "_l12": F.lag(x, 12).over(months)})
    cv = F.when(F.avg(x) > 0, F.stddev_samp(x) / F.avg(x))
    return rows.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_months"),
        cv.alias("cv"),
        flag(cv > 0.7).alias("is_volatile"),
        F.avg(flag(x == 0)).alias("zero_share"),
        F.corr("total_expenses", "_l1").alias("autocorr_1"),
        F.corr("total_expenses", "_l12").alias("autocorr_12"),
    )


# fixed values: weights of the exponentially weighted and blended baselines, newest first
EWMA_WEIGHTS = {"lag_1": 0.5, "lag_2": 0.3, "lag_3": 0.2}
BLEND = 0.5


def with_baselines(features: DataFrame) -> DataFrame:
    """Forecasts without a model: last value, past mean, twelve-month mean, weighted lags, blend."""
    past = (
        Window.partitionBy("client_id").orderBy("expense_month").rowsBetween(Window.unboundedPreceding, -1)
    )
    weighted = sum((F.col(c) * w for c, w in EWMA_WEIGHTS.items()), F.lit(0.0))
    df = features.withColumns(
        {
            "naive": F.col("lag_1"),
            "client_mean": F.avg("total_expenses").over(past),
            "mean_12": F.col("rmean_12"),
            "ewma": weighted,
        }
    )
    return df.withColumn("blend", F.col("client_mean") * BLEND + F.col("rmean_6") * (1 - BLEND))


BASELINES = ("naive", "client_mean", "mean_12", "ewma", "blend")


def psi_drift(rows: DataFrame, split: Column, value: str, bins: int = 10, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Stability of a value between two parts of a table (split is true for the newer part).

    Bin edges are exact quantiles of the older part; shares are floored at 1e-6.
    """
    marked = rows.select(split.cast("int").alias("newer"), F.col(value).cast("double").alias("x")).filter(
        F.col("x").isNotNull()
    )
    cuts = {f"c{i}": i / bins for i in range(1, bins)}
    older = marked.filter("newer = 0").select(F.lit("older").alias("part"), "x")
    edges = exact_quantiles(older, ["part"], "x", cuts, rows_per_slot).select(F.array(*cuts).alias("edges"))
    # a single row of bin edges, attached as a scalar
    cut_points = edges.scalar()
    binned = marked.withColumn("edges", cut_points).withColumn(
        "bin", F.size(F.filter("edges", lambda e: e < F.col("x")))
    )
    counts = binned.groupBy("bin").agg(
        F.count_if(F.col("newer") == 0).alias("n_older"), F.count_if(F.col("newer") == 1).alias("n_newer")
    )
    whole = Window.partitionBy()  # one row per bin
    old_share = F.greatest(F.try_divide(F.col("n_older"), F.sum("n_older").over(whole)), F.lit(1e-6))
    new_share = F.greatest(F.try_divide(F.col("n_newer"), F.sum("n_newer").over(whole)), F.lit(1e-6))
    return counts.select(
        "bin", "n_older", "n_newer", ((new_share - old_share) * F.log(new_share / old_share)).alias("psi")
    )
