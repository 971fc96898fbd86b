"""Data-quality reports: missing values, duplicates, outliers and rule failures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import ROWS_PER_SLOT
from ledgerloom.operators.quantiles import exact_quantiles

# fixed value: an outlier lies more than this many interquartile ranges outside the quartiles
IQR_REACH = 3


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the order; ties in the order are broken by the other columns.

    The minimum of a struct is an aggregate that combines map-side, so a key with very
    many copies is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*[c for c in order if c not in keys], *rest)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_null, n_rows) for every column, from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot(["n_rows"], df.columns, "column_name", "n_null").select("column_name", "n_null", "n_rows")


def null_counts_by_table(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Failures of the not-null rules of several tables."""
    reports = [
        null_counts(tables[name].select(*wanted)).select(F.lit(name).alias("table_name"), "*")
        for name, wanted in columns.items()
    ]
    return _union(reports)


def repeated_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Failures of the unique rules: keys seen more than once and the rows beyond the first."""
    reports = []
    for name, columns in keys.items():
        counted = tables[name].groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        reports.append(
            counted.agg(
                F.count(F.lit(1)).alias("n_keys"),
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_surplus"),
            ).select(
                F.lit(name).alias("table_name"), F.lit("+".join(columns)).alias("key_columns"), "n_keys", "n_surplus"
            )
        )
    return _union(reports)


def _union(reports: list[DataFrame]) -> DataFrame:
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def fences(df: DataFrame, columns: Sequence[str], rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """(column_name, q1, q3, lower_bound, upper_bound) from exact quartiles."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = values.unpivot([], list(columns), "column_name", "value")
    quartiles = exact_quantiles(long, ["column_name"], "value", {"q1": 0.25, "q3": 0.75}, rows_per_slot)
    spread = (F.col("q3") - F.col("q1")) * IQR_REACH
    return quartiles.select(
        "column_name",
        "q1",
        "q3",
        (F.col("q1") - spread).alias("lower_bound"),
        (F.col("q3") + spread).alias("upper_bound"),
    )


def outliers(df: DataFrame, key: str, columns: Sequence[str], rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Every value outside its column's fences; nothing is removed from the table."""
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [key], list(columns), "column_name", "value"
    )
    # the fences hold one row per column
    return (
        long.join(F.broadcast(fences(df, columns, rows_per_slot)), "column_name")
        .filter((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
        .select("column_name", key, "value", "lower_bound", "upper_bound")
    )


# request fields: name -> (type, lowest, highest, required)
REQUEST_FIELDS = {
    "transaction_id": ("string", None, None, True),
    "amount": ("double", None, None, True),
    "use_chip": ("string", None, None, True),
    "mcc": ("int", None, None, True),
    "merchant_id": ("int", None, None, True),
    "is_online": ("int", 0, 1, True),
    "has_bad_cvv": ("int", 0, 1, False),
    "has_any_error": ("int", 0, 1, False),
    "txn_hour": ("int", 0, 23, True),
    "credit_limit": ("double", None, None, False),
    "credit_score": ("int", None, None, False),
    "card_txn_count_24h": ("int", None, None, False),
    "seconds_since_last_txn": ("double", None, None, False),
}


def request_errors() -> Column:
    """The reasons a scoring request is invalid, as an array in field order."""
    reasons = []
    for name, (kind, low, high, required) in REQUEST_FIELDS.items():
        text = F.col(name)
        value = text.try_cast(kind)
        if required:
            reasons.append(F.when(text.isNull(), f"{name}: missing"))
        if kind != "string":
            reasons.append(F.when(text.isNotNull() & value.isNull(), f"{name}: not a number"))
        if low is not None:
            reasons.append(F.when(~value.between(low, high), f"{name}: outside {low}..{high}"))
    return F.array_compact(F.array(*reasons))


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``reasons``; valid ones have none, the others go to quarantine."""
    return requests.withColumn("reasons", request_errors())
