from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.sources import schemas
from ledgerloom.streaming import replay
from ledgerloom.streaming.landing import decode, kept_quarantine, land_batch, start_landing
from ledgerloom.operators.staging import stage_transactions
from ledgerloom.plans.fraud_mart import MART_COLUMNS, fraud_features
from ledgerloom.streaming.refresh import LANDED, VELOCITY_COLUMNS, refresh, refresh_mart, start_refresh, velocity


def raw(spark, rows):
    """(id, date, client) triples as received rows."""
    values = [(str(i), d, c, "7", "$-5.00", "Swipe Transaction", "3", "X", "S1", "", "5000", "") for i, d, c in rows]
    return spark.createDataFrame(values, schemas.RAW_TRANSACTIONS)


ROWS = [(1, "2020-01-01 10:00:00", "1"), (2, "2020-01-02 10:00:00", "1"), (3, "2020-01-03 00:00:00", "bad"), (4, "2020-03-01 00:00:00", "1")]


def test_cursor_stops_at_the_last_good_row_and_meets_the_bad_tail_again(spark):
    got = [tuple(r) for r in replay.replay_statuses(raw(spark, ROWS), days=30).orderBy("chunk_start").collect()]
    assert [r[2:] for r in got] == [(2, 1), (0, 1), (1, 0)]
    assert got[0][1] == datetime(2020, 1, 2, 10)  # not the bad row's time
    assert got[1][1] == datetime(2020, 2, 1, 10)  # an empty chunk moves to its bound


def test_replay_runs_share_a_stored_cursor(spark, folder):
    rows, cursor, landing = raw(spark, ROWS), f"{folder}/cursor", f"{folder}/landing"
    assert replay.read_cursor(spark, cursor) == replay.FIRST_CURSOR
    replay.write_cursor(spark, cursor, replay.first_cursor(rows))
    published = [replay.replay_next(rows, cursor, landing, f"{folder}/bad", 30).first().rows_published for _ in range(3)]
    assert published == [2, 0, 1]
    assert sorted(r.id for r in spark.read.parquet(landing).collect()) == [1, 2, 4]
    # the bad row lies after the last good one of its chunk, so two chunks met it
    assert [r.id for r in kept_quarantine(spark, f"{folder}/bad").collect()] == ["3", "3"]
    assert replay.read_cursor(spark, cursor) == datetime(2020, 3, 1)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_stored_by_day_is_pruned_to_the_chunk(spark, folder):
    rows = replay.store_by_day(raw(spark, [*ROWS, (9, "someday", "1")]), f"{folder}/raw")
    part = replay.chunk(rows, datetime(2020, 1, 1, 10), 1)
    assert [r.id for r in part.collect()] == ["2"]
    assert "day" not in part.columns
    plan = scans(part)
    assert "PartitionFilters: [isnotnull(day" in plan and "2020-01-02" in plan.split("PartitionFilters")[1].split("]")[0]
    replay.quarantine_undated(rows, f"{folder}/bad")
    assert [r.id for r in kept_quarantine(spark, f"{folder}/bad").collect()] == ["9"]


def test_replay_to_the_end_follows_the_same_chunks(spark, folder):
    rows = replay.store_by_day(raw(spark, ROWS), f"{folder}/raw")
    got = replay.replay_rest(rows, f"{folder}/cursor", f"{folder}/landing", f"{folder}/bad", 30)
    want = replay.replay_statuses(raw(spark, ROWS), days=30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # nothing is left for another call
    assert replay.replay_rest(rows, f"{folder}/cursor", f"{folder}/landing", f"{folder}/bad", 30).count() == 0
    empty = replay.replay_rest(rows.filter("false"), f"{folder}/c2", f"{folder}/l2", f"{folder}/b2", 30)
    assert empty.count() == 0


def test_a_chunk_without_rows_moves_the_cursor_to_its_bound(spark, folder):
    replay.write_cursor(spark, f"{folder}/cursor", datetime(2020, 1, 5))
    got = replay.replay_next(raw(spark, ROWS), f"{folder}/cursor", f"{folder}/landing", f"{folder}/bad", 10).first()
    assert tuple(got) == (datetime(2020, 1, 5), datetime(2020, 1, 15), 0, 0)


def test_a_late_row_leaves_the_days_between_alone(spark, tables, folder):
    days = tables.landing.withColumn("day", F.to_date("date"))
    days.write.partitionBy("day").parquet(f"{folder}/landing")
    refresh(spark, f"{folder}/landing", f"{folder}/features", days.select("day"))
    before = {p.name: min(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in Path(f"{folder}/features").glob("day=*")}
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    refresh(spark, f"{folder}/landing", f"{folder}/features", spark.createDataFrame([(ends.a,), (ends.b,), (None,)], "day date"))
    after = {p.name: min(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in Path(f"{folder}/features").glob("day=*")}
    near = {f"day={ends.a + timedelta(days=i)}" for i in range(8)} | {f"day={ends.b}"}
    assert {name for name in after if after[name] != before[name]} == near & set(after)
    assert len(near & set(after)) < len(after)
    refresh(spark, f"{folder}/landing", f"{folder}/features", days.select("day").filter("false"))
    key = ["transaction_id", *VELOCITY_COLUMNS]
    got = spark.read.parquet(f"{folder}/features").select(*key).toPandas().sort_values("transaction_id").reset_index(drop=True)
    want = velocity(tables.landing).select(*key).toPandas().sort_values("transaction_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_rows_without_a_date_are_set_apart(spark, folder):
    replay.quarantine_undated(raw(spark, [(1, "2020-01-01 10:00:00", "1"), (2, "someday", "1")]), f"{folder}/bad")
    assert [(r.id, r.reasons) for r in kept_quarantine(spark, f"{folder}/bad").collect()] == [("2", ["date"])]


def test_chunk_bounds_are_open_and_closed(spark):
    checked = replay.chunk(raw(spark, ROWS), datetime(2020, 1, 1, 10), 1)
    assert [r.id for r in checked.collect()] == ["2"]


def test_redelivered_and_repeated_batches_land_once(spark, folder):
    landing, quarantine = f"{folder}/landing", f"{folder}/quarantine"
    batch = raw(spark, ROWS + ROWS[:1])
    land_batch(batch, 0, landing, quarantine)
    land_batch(batch, 0, landing, quarantine)  # the batch runs again
    land_batch(raw(spark, [(2, "2020-01-02 10:00:00", "1"), (5, "2020-01-02 11:00:00", "1")]), 1, landing, quarantine)
    assert sorted(r.id for r in spark.read.schema(LANDED).parquet(landing).collect()) == [1, 2, 4, 5]
    assert [(r.id, r.reasons) for r in spark.read.parquet(quarantine).filter("size(reasons) > 0").collect()] == [("3", ["client_id"])]


def test_decode_keeps_odd_fields_null(spark):
    payload = '{"id": "1", "date": "d", "client_id": "x", "zip": "58523.0", "mcc": "5", "amount": "$1"}'
    df = spark.createDataFrame([(payload,)], "p string").select(F.base64(F.col("p").cast("binary")).alias("data"))
    got = decode(df).first()
    assert (got.id, got.client_id, got.zip, got.mcc, got.errors) == ("1", None, 58523.0, 5, None)


def message_files(spark, tables, folder, parts):
    """The landed rows as received text, in several files."""
    text = tables.landing.select(*[F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias(c) if c == "date" else F.col(c).cast("string").alias(c) for c in tables.landing.columns])
    # a hash spread puts early and late rows into every file: batches arrive out of order
    text.repartition(parts, "id").write.parquet(folder)
    return spark.readStream.schema(schemas.RAW_TRANSACTIONS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_features_equal_batch_features(spark, tables, folder):
    stream = message_files(spark, tables, f"{folder}/in", 3)
    start_refresh(stream, f"{folder}/landing", f"{folder}/bad", f"{folder}/features", f"{folder}/cp").awaitTermination()
    whole = tables.landing.withColumn("date", F.date_trunc("second", "date").cast("timestamp_ntz"))
    key = ["transaction_id", "card_id", *VELOCITY_COLUMNS]
    got = spark.read.parquet(f"{folder}/features").select(*key).toPandas().sort_values("transaction_id").reset_index(drop=True)
    want = velocity(whole).select(*key).toPandas().sort_values("transaction_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_landing_stream_resumes_from_its_checkpoint(spark, tables, folder):
    stream = message_files(spark, tables, f"{folder}/in", 2)
    for _ in range(2):
        start_landing(stream, f"{folder}/landing", f"{folder}/bad", f"{folder}/cp").awaitTermination()
    landed = spark.read.schema(LANDED).parquet(f"{folder}/landing")
    assert landed.count() == landed.select("id").distinct().count() == tables.landing.count()


def test_cut_entities_refresh_to_the_same_features(spark, tables, folder):
    days = tables.landing.withColumn("day", F.to_date("date"))
    days.write.partitionBy("day").parquet(f"{folder}/landing")
    refresh(spark, f"{folder}/landing", f"{folder}/features", days.select("day"), cap=30)
    key = ["transaction_id", *VELOCITY_COLUMNS]
    got = spark.read.parquet(f"{folder}/features").select(*key).toPandas().sort_values("transaction_id").reset_index(drop=True)
    want = velocity(tables.landing).select(*key).toPandas().sort_values("transaction_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_all_mart_columns_follow_late_rows_and_repeated_batches(spark, tables, folder):
    landing, mart = f"{folder}/landing", f"{folder}/mart"
    late, rest = F.col("client_id") % 5 == 1, F.dayofmonth("date") < 12
    parts = [tables.landing.filter(~late), tables.landing.filter(late & ~rest), tables.landing.filter(late & rest)]
    for part in parts:
        part.write.mode("append").parquet(landing)
        landed = spark.read.schema(part.schema).parquet(landing)
        refresh_mart(landed, part, mart, tables.mcc, tables.cards, tables.users)
    refresh_mart(landed, parts[1], mart, tables.mcc, tables.cards, tables.users)
    read = lambda df: df.select(*MART_COLUMNS).toPandas().sort_values("transaction_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(read(spark.read.parquet(mart)), read(tables.mart()), check_dtype=False)


def test_a_refresh_keeps_rows_whose_number_is_missing_or_comes_again(spark, tables, folder):
    """Row 1 of client 1 and row 1 of client 2 are two rows, and so is one without a number."""
    rows = [(1, 1, 7), (1, 2, 8), (None, 1, 7), (3, None, 8), (4, 5, 9)]
    values = [(i, datetime(2020, 1, n + 1), c, k, "$5.00", "Chip Transaction", 3, "X", "S1", None, 5000, "") for n, (i, c, k) in enumerate(rows)]
    landed = spark.createDataFrame(values, ", ".join(LANDED.split(", ")[:-1]))
    mart = f"{folder}/mart"
    refresh_mart(landed, landed, mart, tables.mcc, tables.cards, tables.users, buckets=1)
    refresh_mart(landed, landed.filter("client_id = 1"), mart, tables.mcc, tables.cards, tables.users, buckets=1)
    want = fraud_features(stage_transactions(landed), tables.mcc, tables.cards, tables.users)
    read = lambda df: sorted(map(repr, df.select(*MART_COLUMNS).collect()))
    assert read(spark.read.parquet(mart)) == read(want)
