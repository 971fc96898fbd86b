"""Joins to the dimensions and per-client modes.

No side is hinted as broadcast: Catalyst broadcasts a dimension whose file size is
below ``spark.sql.autoBroadcastJoinThreshold``, adaptive execution does the same from
measured shuffle sizes, and otherwise splits skewed keys of a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import blank_to_null

# fixed value: category of a transaction whose code is not in the lookup
UNKNOWN_CATEGORY = "Unknown"


def with_category(transactions: DataFrame, mcc: DataFrame) -> DataFrame:
    return (
        transactions.join(mcc, "mcc", "left")
        .withColumn("merchant_category", F.coalesce("category_name", F.lit(UNKNOWN_CATEGORY)))
        .drop("category_name")
    )


def enriched_transactions(transactions: DataFrame, mcc: DataFrame) -> DataFrame:
    return with_category(transactions, mcc).select(
        "transaction_id",
        "transaction_date",
        "client_id",
        "card_id",
        "amount",
        "use_chip",
        "merchant_id",
        "merchant_city",
        "merchant_state",
        "zip",
        "mcc",
        "errors",
        "merchant_category",
    )


def client_transactions(enriched: DataFrame, users: DataFrame, cards: DataFrame) -> DataFrame:
    """Transactions with the client's and the card's attributes; a card must belong to the client."""
    user_columns = users.select(
        "client_id",
        "current_age",
        "retirement_age",
        "credit_score",
        "total_debt",
        "yearly_income",
        "per_capita_income",
        "gender",
    )
    card_columns = cards.select(
        "card_id",
        "client_id",
        "card_brand",
        "card_type",
        "credit_limit",
        F.col("has_chip").alias("card_has_chip"),
        "card_on_dark_web",
        F.col("expiry_date").alias("card_expiry_date"),
    )
    return (
        enriched.drop("zip", "errors")
        .join(user_columns, "client_id", "left")
        .join(card_columns, ["card_id", "client_id"], "left")
        .select(
            *[c for c in enriched.columns if c not in ("zip", "errors")],
            *user_columns.columns[1:],
            *card_columns.columns[2:],
        )
    )


def most_frequent(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Per key the most frequent value of each named expression, the smaller value on a tie.

    NULL is not counted. All expressions are counted in one scan; counts combine map-side
    and the winner is an aggregate, so a key holding a large share of the rows costs no
    more than its number of distinct values.
    """
    seen = F.array(*[F.struct(F.lit(name).alias("_of"), value.alias("_value")) for name, value in values.items()])
    counts = (
        df.select(key, F.inline(seen))
        .filter(F.col("_value").isNotNull())
        .groupBy(key, "_of", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    rank = F.struct(-F.col("_n"), F.col("_value"))
    winners = [F.min_by("_value", F.when(F.col("_of") == name, rank)).alias(name) for name in values]
    return counts.groupBy(key).agg(*winners)


def known_state() -> Column:
    return blank_to_null("merchant_state")


def client_homes(transactions: DataFrame) -> DataFrame:
    """(client_id, home_state, home_zip): NULL where the client never had one."""
    return most_frequent(transactions, "client_id", {"home_state": known_state(), "home_zip": F.col("zip")})


def home_state(transactions: DataFrame) -> DataFrame:
    return most_frequent(transactions, "client_id", {"home_state": known_state()})


def home_zip(transactions: DataFrame) -> DataFrame:
    return most_frequent(transactions, "client_id", {"home_zip": F.col("zip")})
