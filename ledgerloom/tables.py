"""The staged tables of one data folder, built lazily."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import enrich, staging
from ledgerloom.plans import explore, fraud_mart, monthly
from ledgerloom.session import configure
from ledgerloom.sources import given_tables
from ledgerloom.sources.readers import typed_labels


class Tables:
    """Landed and staged tables: ``transactions`` from events, ``ledger`` from orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def given(self, name: str) -> DataFrame:
        return given_tables.table(self.spark, self.folder, name)

    @cached_property
    def landing(self) -> DataFrame:
        return given_tables.transactions(self.spark, self.folder)

    @cached_property
    def transactions(self) -> DataFrame:
        return staging.stage_transactions(self.landing)

    @cached_property
    def ledger(self) -> DataFrame:
        return staging.stage_transactions(given_tables.ledger(self.spark, self.folder))

    @cached_property
    def raw_cards(self) -> DataFrame:
        return given_tables.cards(self.spark, self.folder)

    @cached_property
    def cards(self) -> DataFrame:
        return staging.stage_cards(self.raw_cards)

    @cached_property
    def raw_users(self) -> DataFrame:
        return given_tables.users(self.spark, self.folder)

    @cached_property
    def users(self) -> DataFrame:
        return staging.stage_users(self.raw_users)

    @cached_property
    def raw_mcc(self) -> DataFrame:
        return given_tables.mcc_codes(self.spark, self.folder)

    @cached_property
    def mcc(self) -> DataFrame:
        return staging.stage_mcc(self.raw_mcc)

    @cached_property
    def labels(self) -> DataFrame:
        return typed_labels(given_tables.labels(self.spark, self.folder))

    @cached_property
    def enriched(self) -> DataFrame:
        return enrich.enriched_transactions(self.transactions, self.mcc)

    @cached_property
    def labelled(self) -> DataFrame:
        """Staged transactions that have a label."""
        return explore.labelled_only(explore.attach_labels(self.transactions, self.labels))

    @cached_property
    def monthly(self) -> DataFrame:
        return monthly.monthly_expenses(self.ledger)

    @cached_property
    def forecast_features(self) -> DataFrame:
        return monthly.forecast_features(self.monthly, self.users)

    def mart(self, **limits) -> DataFrame:
        return fraud_mart.fraud_features(self.transactions, self.mcc, self.cards, self.users, **limits)

    def scored(self, rows: DataFrame | None = None) -> DataFrame:
        """Transactions (the labelled ones if none are given) with a simple risk score, for the metric queries."""
        rows = self.labelled if rows is None else rows.withColumn("is_fraud", F.lit(None).cast("int"))
        points = (
            F.col("has_any_error") * 300
            + F.col("is_online") * 120
            + F.col("merchant_id") * 7 % 200
            + F.col("transaction_id") % 97
        )
        score = (points + 1) / F.lit(1000.0)
        return rows.select(
            "transaction_id",
            F.col("is_fraud").alias("label"),
            score.alias("score"),
            F.log(score / (1 - score)).alias("raw"),
        )
