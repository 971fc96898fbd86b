"""Landed tables to typed, cleaned staging tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import (
    blank_to_null,
    clean_zip,
    dollars,
    first_of_month,
    flag,
    mentions,
    money,
    part,
)

# fixed values: error phrases found in the errors text and their flag columns
ERROR_FLAGS = {
    "has_bad_cvv": "Bad CVV",
    "has_bad_expiration": "Bad Expiration",
    "has_bad_card_number": "Bad Card Number",
    "has_bad_pin": "Bad PIN",
    "has_insufficient_balance": "Insufficient Balance",
    "has_technical_glitch": "Technical Glitch",
}
ONLINE = "Online Transaction"


def stage_transactions(landing: DataFrame) -> DataFrame:
    """Rename, parse dollars and zip, blank errors to NULL, raise error and channel flags."""
    errors = blank_to_null("errors")
    return landing.select(
        F.col("id").alias("transaction_id"),
        F.col("date").alias("transaction_date"),
        "client_id",
        "card_id",
        money("amount").alias("amount"),
        "use_chip",
        "merchant_id",
        "merchant_city",
        # a CSV reader turns the blank state of an online row into NULL
        F.coalesce("merchant_state", F.lit("")).alias("merchant_state"),
        clean_zip("zip").alias("zip"),
        "mcc",
        errors.alias("errors"),
        *[flag(mentions("errors", phrase)).alias(name) for name, phrase in ERROR_FLAGS.items()],
        flag(errors.isNotNull()).alias("has_any_error"),
        flag(F.col("use_chip") == ONLINE).alias("is_online"),
    )


def stage_cards(cards: DataFrame) -> DataFrame:
    return cards.select(
        F.col("id").alias("card_id"),
        "client_id",
        "card_brand",
        "card_type",
        "card_number",
        "expires",
        "cvv",
        (F.col("has_chip") == "YES").alias("has_chip"),
        "num_cards_issued",
        dollars("credit_limit").alias("credit_limit"),
        "acct_open_date",
        "year_pin_last_changed",
        (F.col("card_on_dark_web") == "Yes").alias("card_on_dark_web"),
        first_of_month("expires").alias("expiry_date"),
    )


def stage_users(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("id").alias("client_id"),
        "current_age",
        "retirement_age",
        "birth_year",
        "birth_month",
        "gender",
        "address",
        "latitude",
        "longitude",
        dollars("per_capita_income").alias("per_capita_income"),
        dollars("yearly_income").alias("yearly_income"),
        dollars("total_debt").alias("total_debt"),
        "credit_score",
        "num_credit_cards",
    )


def stage_mcc(mcc_codes: DataFrame) -> DataFrame:
    return mcc_codes.select(F.col("mcc_code").try_cast("bigint").alias("mcc"), "category_name")


def clean_users(users: DataFrame) -> DataFrame:
    """All columns kept; money parsed and the birth date derived."""
    birth = F.when(
        F.col("birth_month").between(1, 12), F.make_date(F.col("birth_year"), F.col("birth_month"), F.lit(1))
    )
    return users.select(
        "id",
        *[F.col(c).try_cast("int").alias(c) for c in ("current_age", "retirement_age", "birth_year", "birth_month")],
        "gender",
        "address",
        "latitude",
        "longitude",
        *[dollars(c).alias(c) for c in ("per_capita_income", "yearly_income", "total_debt")],
        *[F.col(c).try_cast("int").alias(c) for c in ("credit_score", "num_credit_cards")],
        birth.alias("birth_date"),
    )


def clean_cards(cards: DataFrame) -> DataFrame:
    """All columns kept; numbers, booleans and the expiry month, year and date derived."""
    return cards.select(
        "id",
        "client_id",
        "card_brand",
        "card_type",
        F.col("card_number").try_cast("bigint").alias("card_number"),
        "expires",
        F.col("cvv").try_cast("int").alias("cvv"),
        (F.col("has_chip") == "YES").alias("has_chip"),
        F.col("num_cards_issued").try_cast("int").alias("num_cards_issued"),
        dollars("credit_limit").alias("credit_limit"),
        "acct_open_date",
        "year_pin_last_changed",
        (F.col("card_on_dark_web") == "Yes").alias("card_on_dark_web"),
        part("expires", 1).alias("expiry_month"),
        part("expires", 2).alias("expiry_year"),
        first_of_month("expires").alias("expiry_date"),
    )


def clean_transactions(landing: DataFrame) -> DataFrame:
    """All columns kept; dollars parsed, merchant nullable, missing mcc becomes 0.

    The errors text is kept: coercing it to a number would destroy it.
    """
    return landing.select(
        "id",
        "date",
        "client_id",
        "card_id",
        money("amount").alias("amount"),
        "use_chip",
        F.col("merchant_id").try_cast("bigint").alias("merchant_id"),
        "merchant_city",
        "merchant_state",
        "zip",
        F.coalesce(F.col("mcc").try_cast("bigint"), F.lit(0).cast("bigint")).alias("mcc"),
        "errors",
    )
