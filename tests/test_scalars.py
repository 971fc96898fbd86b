from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as s
from ledgerloom.operators.staging import stage_cards, stage_transactions
from ledgerloom.sources import schemas


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


def test_money_parses_signs_and_commas_and_rejects_text(spark):
    got = values(spark, s.money("x"), ["$-77.00", "$1,234.50", "n/a", "", None])
    assert got == [Decimal("-77.00"), Decimal("1234.50"), None, None, None]


def test_zip_loses_its_fraction(spark):
    assert values(spark, s.clean_zip("x"), ["58523.0", "1234", "", None, "1e40"]) == ["58523", "1234", None, None, None]


def test_month_year_dates(spark):
    got = values(spark, s.first_of_month("x"), ["12/2022", "1/2020", "13/2020", "2020", None])
    assert got == [date(2022, 12, 1), date(2020, 1, 1), None, None, None]


def test_weeks_end_on_sunday(spark):
    got = values(spark, s.week_ending_sunday(F.col("x").cast("timestamp_ntz")), ["2013-01-01", "2013-01-06", "2013-01-07"])
    assert got == [date(2013, 1, 6), date(2013, 1, 6), date(2013, 1, 13)]


def test_clip_keeps_null(spark):
    assert values(spark, s.at_least(F.col("x"), 1.0), [0.2, 3.0, None], "double") == [1.0, 3.0, None]


def test_ratio_guards_zero(spark):
    assert values(spark, s.ratio(F.lit(6.0), F.col("x")), [0.0, 2.0, None], "double") == [0.0, 3.0, 0.0]


def test_currency_text(spark):
    assert values(spark, s.as_currency(F.col("x")), [-1234.5, 0.0], "double") == ["$1,234.50", "$0.00"]


def test_staging_flags_and_blanks(spark):
    row = (1, None, 1, 1, "$-5.00", "Online Transaction", 1, "ONLINE", "", None, 1, " Bad PIN,Insufficient Balance ")
    blank = (2, None, 1, 1, "bad", "Swipe Transaction", 1, "X", "S", "10.0", 1, "  ")
    rows = stage_transactions(spark.createDataFrame([row, blank], schemas.LANDING_TRANSACTIONS)).orderBy("transaction_id")
    first, second = rows.collect()
    assert (first.has_bad_pin, first.has_insufficient_balance, first.has_bad_cvv, first.has_any_error) == (1, 1, 0, 1)
    assert (first.is_online, first.zip, second.errors, second.has_any_error, second.amount) == (1, None, None, 0, None)


def test_cards_keep_malformed_limits_as_null(spark):
    card = (1, 1, "Visa", "Debit", "4", "xx/2020", "1", "YES", 1, "n/a", "02/2010", 2010, "No")
    got = stage_cards(spark.createDataFrame([card], schemas.CARDS)).first()
    assert (got.has_chip, got.card_on_dark_web, got.credit_limit, got.expiry_date) == (True, False, None, None)
