"""Velocity features kept in stream state against the batch features."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming.refresh import LANDED, VELOCITY_COLUMNS, velocity
from ledgerloom.streaming.velocity import start_velocity

KEY = ["transaction_id", "card_id", *VELOCITY_COLUMNS]


def table(df):
    return df.select(*KEY).toPandas().sort_values("transaction_id").reset_index(drop=True).astype({c: "float64" for c in VELOCITY_COLUMNS})


def run(spark, folder, part, **options):
    """Add files to the source folder and run the stream until they are answered."""
    part.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
    start_velocity(stream, f"{folder}/out", f"{folder}/cp", **options).awaitTermination()


def test_parts_in_time_order_equal_the_batch_and_resume_from_the_checkpoint(spark, tables, folder):
    rows = tables.landing
    for a, b in ((0, 9), (9, 10), (10, 21), (21, 32)):
        run(spark, folder, rows.filter((F.dayofmonth("date") >= a) & (F.dayofmonth("date") < b)))
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == rows.count()
    pd.testing.assert_frame_equal(table(got), table(velocity(rows)))


START = datetime(2020, 1, 1)


def landed(spark, rows):
    """(id, seconds after START, card, amount, errors) as landed rows."""
    values = [
        (i, None if s is None else START + timedelta(seconds=s), 1, card, amount, "Chip Transaction", 3, "X", "S1", None, 5000, errors)
        for i, s, card, amount, errors in rows
    ]
    return spark.createDataFrame(values, ", ".join(LANDED.split(", ")[:-1]))


def answers(spark, folder):
    rows = spark.read.parquet(f"{folder}/out").orderBy("transaction_id").collect()
    return {r.transaction_id: (r.seconds_since_last_txn, r.card_txn_count_1h, r.card_txn_count_7d, r.card_amount_sum_24h, r.card_errors_7d) for r in rows}


def test_ties_late_rows_and_rows_without_time_amount_or_card(spark, folder):
    run(spark, folder, landed(spark, [(1, 100, 7, "$5.00", ""), (2, 100, 7, "$-1.10", "Bad PIN"), (3, None, 7, "$1.00", ""), (4, 200, 7, "", ""), (5, 50, None, "$2.00", "")]))
    assert answers(spark, folder) == {
        1: (None, 2 - 1, 2 - 1, 1.1, 1),
        2: (0, 1, 1, 5.0, 1),
        3: (None,) * 5,
        4: (100, 2, 2, None, 1),
        5: (None, 0, 0, 0.0, 0),
    }
    # same second as an answered row, one before it, and one after more than the reach
    run(spark, folder, landed(spark, [(6, 100, 7, "$1.00", ""), (7, 40, 7, "$1.00", ""), (8, 700_000, 7, "$3.00", "")]))
    got = answers(spark, folder)
    assert (got[6], got[7], got[8]) == ((0, 3, 3, 7.1, 1), (None, 0, 0, 0.0, 0), (699_800, 0, 0, 0.0, 0))


def test_an_idle_card_is_forgotten(spark, folder):
    run(spark, folder, landed(spark, [(1, 100, 7, "$5.00", "")]), idle=0)
    run(spark, folder, landed(spark, [(2, 100, 8, "$5.00", "")]), idle=0)  # the timer of card 7 fires
    run(spark, folder, landed(spark, [(3, 160, 7, "$5.00", "")]), idle=0)
    assert answers(spark, folder)[3][:2] == (None, 0)


@pytest.mark.parametrize("idle", [3600])
def test_a_card_with_newer_rows_is_kept(spark, folder, idle):
    run(spark, folder, landed(spark, [(1, 100, 7, "$5.00", "")]), idle=idle)
    run(spark, folder, landed(spark, [(2, 160, 7, "$5.00", "")]), idle=idle)
    assert answers(spark, folder)[2][:2] == (60, 1)


@pytest.mark.parametrize("buckets", [1, 3])
def test_cards_share_keys_and_stay_apart(spark, folder, buckets):
    rows = [(i, 40_000 * (i % 50) + i % 3, (i * 7) % 23 if i % 29 else None, f"${i}.25", "Bad PIN" if i % 5 == 0 else "") for i in range(600)]
    for low, high in ((0, 9), (9, 11), (11, 50)):
        run(spark, folder, landed(spark, [r for r in rows if low <= r[0] % 50 < high]), buckets=buckets)
    got = table(spark.read.parquet(f"{folder}/out"))
    pd.testing.assert_frame_equal(got, table(velocity(landed(spark, rows))))


def test_a_number_beside_a_null_keeps_its_digits(spark, folder):
    rows = landed(spark, [(1, 100, 7, "$5.00", ""), (2, 160, 7, "$5.00", "")])
    rows = rows.withColumn("client_id", F.when(F.col("id") == 1, F.lit(2**53 + 1)))
    run(spark, folder, rows, buckets=1)
    got = spark.read.parquet(f"{folder}/out").orderBy("transaction_id")
    assert [r.client_id for r in got.collect()] == [2**53 + 1, None]
    assert got.schema["client_id"].dataType.simpleString() == "bigint"


def test_state_has_a_key_per_bucket_not_per_card(spark, folder):
    parts = spark.range(300).select(F.col("id")).collect()
    run(spark, folder, landed(spark, [(r.id, 100, r.id, "$5.00", "") for r in parts]), buckets=2)
    kept = spark.read.format("statestore").option("path", f"{folder}/cp").option("stateVarName", "cards").load()
    assert kept.count() == 2
