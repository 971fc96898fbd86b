"""The given parquet tables mapped onto the landed card-transaction shapes (FIXTURES.md section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import MONEY


SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def _dollar_text(amount):
    return F.concat(F.lit("$"), amount.cast(MONEY).cast("string"))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return landing_of(table(spark, folder, "events"))


def landing_of(events: DataFrame) -> DataFrame:
    """Landed transactions from ``events``: second-level times, channels, errors."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    online = F.col("event_type").isin("click", "error")
    error_names = F.array(
        *[
            F.lit(name)
            for name in (
                "Bad CVV",
                "Bad Expiration",
                "Bad Card Number",
                "Bad PIN",
                "Insufficient Balance",
                "Technical Glitch",
                "Bad PIN,Insufficient Balance",
            )
        ]
    )
    return (
        events.withColumn("k", k)
        .select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("date"),
            F.col("user_id").alias("client_id"),
            (F.col("user_id") * 2 + F.col("event_id") % 2).alias("card_id"),
            _dollar_text(F.when(F.col("event_type") == "signup", F.col("value")).otherwise(-F.col("value"))).alias(
                "amount"
            ),
            F.when(online, "Online Transaction")
            .when(F.col("event_type") == "view", "Chip Transaction")
            .otherwise("Swipe Transaction")
            .alias("use_chip"),
            F.col("k").alias("merchant_id"),
            F.when(online, "ONLINE").otherwise(F.concat(F.lit("City"), F.col("k") % 25)).alias("merchant_city"),
            F.when(online, "").otherwise(F.concat(F.lit("S"), F.col("k") % 10)).alias("merchant_state"),
            F.when(~online, F.concat(10000 + F.col("k") * 137, F.lit(".0"))).alias("zip"),
            (5000 + F.col("k") % 30).alias("mcc"),
            F.when(F.col("event_type") == "error", F.element_at(error_names, (F.col("k") % 7 + 1).cast("int")))
            .when(F.col("k") % 2 == 0, "")
            .alias("errors"),
        )
    )


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Yes/No fraud labels for seven of ten transactions, as the label file holds them."""
    cut = F.when(F.col("event_type") == "error", 20).otherwise(2)
    return (
        table(spark, folder, "events")
        .filter(F.col("event_id") % 10 < 7)
        .select(
            F.col("event_id").cast("string").alias("transaction_id"),
            F.when((F.col("event_id") * 7919) % 97 < cut, "Yes").otherwise("No").alias("is_fraud"),
        )
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Landed transactions from ``orders``: seven years of days for monthly work."""
    client = F.col("o_custkey") % 50
    online = F.col("o_orderstatus") == "O"
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("date"),
        client.alias("client_id"),
        (client * 2 + F.col("o_orderkey") % 2).alias("card_id"),
        _dollar_text(
            F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
        ).alias("amount"),
        F.when(online, "Online Transaction")
        .when(F.col("o_orderstatus") == "F", "Swipe Transaction")
        .otherwise("Chip Transaction")
        .alias("use_chip"),
        (F.col("o_custkey") % 100).alias("merchant_id"),
        F.when(online, "ONLINE").otherwise(F.concat(F.lit("City"), F.col("o_custkey") % 25)).alias("merchant_city"),
        F.when(online, "").otherwise(F.concat(F.lit("S"), F.col("o_custkey") % 10)).alias("merchant_state"),
        F.when(~online, F.concat(10000 + F.col("o_custkey") % 100 * 137, F.lit(".0"))).alias("zip"),
        (5000 + F.col("o_custkey") % 30).alias("mcc"),
        F.lit("").alias("errors"),
    )


def cards(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    month = F.lpad((1 + key % 12).cast("string"), 2, "0")
    return table(spark, folder, "customer").select(
        key.alias("id"),
        F.floor(key / 2).cast("bigint").alias("client_id"),
        F.element_at(F.array(F.lit("Visa"), F.lit("Mastercard"), F.lit("Amex")), (key % 3 + 1).cast("int")).alias(
            "card_brand"
        ),
        F.when(key % 2 == 0, "Debit").otherwise("Credit").alias("card_type"),
        (4000000000000000 + key).cast("string").alias("card_number"),
        F.concat(month, F.lit("/"), 2020 + key % 6).alias("expires"),
        (100 + key % 900).cast("string").alias("cvv"),
        F.when(key % 4 == 0, "NO").otherwise("YES").alias("has_chip"),
        (1 + key % 3).cast("int").alias("num_cards_issued"),
        F.when(key % 17 == 0, "n/a").otherwise(_dollar_text(F.abs(F.col("c_acctbal")))).alias("credit_limit"),
        F.concat(month, F.lit("/"), 2010 + key % 9).alias("acct_open_date"),
        (2008 + key % 12).cast("int").alias("year_pin_last_changed"),
        F.lit("No").alias("card_on_dark_web"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    age = 25 + key % 50
    return table(spark, folder, "customer").select(
        key.alias("id"),
        age.cast("int").alias("current_age"),
        (age + (key * 3) % 11).cast("int").alias("retirement_age"),
        (2024 - age).cast("int").alias("birth_year"),
        (1 + key % 12).cast("int").alias("birth_month"),
        F.when(key % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.concat(key.cast("string"), F.lit(" Main Street")).alias("address"),
        (30 + key % 20).cast("double").alias("latitude"),
        (-120 + key % 50).cast("double").alias("longitude"),
        F.concat(F.lit("$"), 9000 + (key * 331) % 40000).alias("per_capita_income"),
        F.concat(F.lit("$"), 20000 + (key * 911) % 80000).alias("yearly_income"),
        F.concat(F.lit("$"), (key * 577) % 90000).alias("total_debt"),
        (450 + (key * 37) % 400).cast("int").alias("credit_score"),
        F.lit(2).alias("num_credit_cards"),
    )


def mcc_codes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        (5000 + F.col("n_nationkey")).cast("string").alias("mcc_code"), F.col("n_name").alias("category_name")
    )
