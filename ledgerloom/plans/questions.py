"""Ranking questions with ties kept.

Rank 1 over a whole table is equality with a global extreme: one aggregate and one filter
instead of a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import mentions


def keep_highest(df: DataFrame, value: Column) -> DataFrame:
    return df.filter(value == df.select(F.max(value)).scalar())


def keep_lowest(df: DataFrame, value: Column) -> DataFrame:
    return df.filter(value == df.select(F.min(value)).scalar())


def latest_expiry_card(cards: DataFrame) -> DataFrame:
    """Card(s) expiring last and, among those, with the lowest credit limit."""
    latest = keep_highest(cards, F.col("expiry_date"))
    return keep_lowest(latest, F.col("credit_limit")).select("card_id")


def retiring_client(users: DataFrame) -> DataFrame:
    """Client(s) retiring next year with the lowest credit score, then the highest debt."""
    retiring = users.filter(F.col("retirement_age") - F.col("current_age") == 1)
    return keep_highest(keep_lowest(retiring, F.col("credit_score")), F.col("total_debt")).select("client_id")


def largest_online_year_end(transactions: DataFrame) -> DataFrame:
    """Online transaction(s) of a December 31 with the largest magnitude."""
    day = F.col("transaction_date")
    rows = transactions.filter((F.month(day) == 12) & (F.dayofmonth(day) == 31) & mentions("use_chip", "online"))
    return keep_highest(rows, F.abs("amount")).select("transaction_id")


def top_brand_client(
    transactions: DataFrame, cards: DataFrame, users: DataFrame, brand: str, year: int, month: int, over_age: int
) -> DataFrame:
    """Client and card of the brand with the most distinct transactions in a month."""
    day = F.col("transaction_date")
    held = cards.filter(mentions("card_brand", brand)).select("card_id", "client_id")
    older = users.filter(F.col("current_age") > over_age).select("client_id")
    counts = (
        transactions.filter((F.month(day) == month) & (F.year(day) == year))
        .join(held, ["card_id", "client_id"])
        .join(older, "client_id")
        .groupBy("client_id", "card_id")
        .agg(F.count_distinct("transaction_id").alias("total_transactions"))
    )
    return keep_highest(counts, F.col("total_transactions"))
