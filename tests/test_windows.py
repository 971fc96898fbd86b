from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import place, positions, running
from ledgerloom.operators.windows import Earlier, History, Rows, Span, add_features, heavy_entities
from ledgerloom.plans import fraud_mart

FEATURES = [
    Earlier("previous", "x"),
    Rows("mean_3", "avg", "x", 3),
    Rows("dev_3", "stddev", "x", 3),
    History("top", "max", "x"),
    History("same_kind", "count", "1", ("kind",)),
    Span("n_60", "count", "1", 60),
    Span("sum_60", "sum", "x", 60),
    Span("sum_before", "sum", "x", 120, 60),
    Span("low_60", "min", "x", 60),
    Span("kinds_60", "distinct", "kind", 60),
]
COLUMNS = "id bigint, card bigint, epoch bigint, kind string, x decimal(18,2)"


def brute_force(rows):
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    out = {}
    for i, (key, card, epoch, kind, x) in enumerate(rows):
        same = [r for r in rows if r[1] == card]
        before = [r for r in rows[:i] if r[1] == card]
        inside = [r for r in same if epoch - 60 <= r[2] <= epoch]
        prior = [r for r in same if epoch - 120 <= r[2] <= epoch - 60]
        last = [float(r[4]) for r in before[-3:]]
        out[key] = {
            "previous": before[-1][4] if before else None,
            "mean_3": np.mean(last) if last else None,
            "dev_3": np.std(last, ddof=1) if len(last) > 1 else None,
            "top": max((r[4] for r in before), default=None),
            "same_kind": sum(r[3] == kind for r in before),
            "n_60": len(inside),
            "sum_60": sum(r[4] for r in inside),
            "sum_before": sum(r[4] for r in prior) if prior else None,
            "low_60": min(r[4] for r in inside),
            "kinds_60": len({r[3] for r in inside}),
        }
    return out


def test_rows_without_a_time_are_alike_on_both_paths(spark):
    rows = [(i, i % 2, None if i % 9 == 0 else i * 7 % 150, "ab"[i % 2], None if i % 5 == 0 else Decimal(i)) for i in range(60)]
    df = spark.createDataFrame(rows, COLUMNS)
    both = []
    for cap in (1000, 10):
        heavy = heavy_entities(df, "card", cap)
        assert (heavy is None) == (cap == 1000)
        got = add_features(df, "card", FEATURES, heavy, epoch="epoch", order=("id",), block_rows=4).collect()
        both.append({r.id: r for r in got})
    assert both[0].keys() == both[1].keys()
    for key, plain in both[0].items():
        for name in (f.name for f in FEATURES):
            assert plain[name] == (pytest.approx(both[1][key][name]) if isinstance(plain[name], float) else both[1][key][name]), (key, name)
        if plain.epoch is None:
            assert all(plain[f.name] is None for f in FEATURES if isinstance(f, Span))


def check(spark, rows, cap, block_rows=4):
    df = spark.createDataFrame(rows, COLUMNS)
    heavy = heavy_entities(df, "card", cap)
    got = add_features(df, "card", FEATURES, heavy, epoch="epoch", order=("id",), block_rows=block_rows).collect()
    want = brute_force(rows)
    assert len(got) == len(rows)
    for row in got:
        for name, value in want[row.id].items():
            if isinstance(value, float):
                assert float(row[name]) == pytest.approx(value, abs=1e-6), (name, row)
            else:
                assert row[name] == value, (name, row, value)


def fixture_rows(n=60, cards=3, seed=1):
    rng = np.random.default_rng(seed)
    # many rows share a second, and one card has most of the rows
    return [
        (
            i,
            int(0 if rng.random() < 0.6 else rng.integers(cards)),
            int(1_700_000_000 + rng.integers(0, 400)),
            "abc"[rng.integers(3)],
            Decimal(int(rng.integers(0, 500))) / 100,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("cap", [10**9, 20, 0], ids=["windows", "mixed", "cut"])
def test_features_equal_brute_force(spark, cap):
    check(spark, fixture_rows(), cap)


def test_rows_of_one_second_and_the_span_edge(spark):
    start = 1_700_000_000
    rows = [(1, 7, start, "a", Decimal(1)), (2, 7, start, "b", Decimal(2)), (3, 7, start + 60, "a", Decimal(4)), (4, 7, start + 61, "a", Decimal(8))]
    for cap in (100, 0):
        check(spark, rows, cap)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 150), st.sampled_from("ab"), st.integers(0, 9)), min_size=1, max_size=25))
def test_cut_features_equal_brute_force_on_any_rows(spark, drawn):
    check(spark, [(i, c, t, k, Decimal(x)) for i, (c, t, k, x) in enumerate(drawn)], cap=0, block_rows=3)


def test_null_entity_is_a_group_of_its_own(spark):
    rows = [(1, None, 10, "a", Decimal(1)), (2, None, 11, "a", Decimal(2)), (3, 5, 11, "a", Decimal(2))]
    df = spark.createDataFrame(rows, COLUMNS)
    spans = [Span("n", "count", "1", 60), Earlier("previous", "x")]
    for cap in (100, 0):
        out = add_features(df, "card", spans, heavy_entities(df, "card", cap), epoch="epoch", order=("id",))
        assert {r.id: r.n for r in out.collect()} == {1: 1, 2: 2, 3: 1}


def test_positions_over_many_slots(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("v"), (F.col("id") % 3).alias("g"))
    got = positions(df, ["v"], rows_per_slot=60).toPandas()
    assert (got["v"] == got["_pos"]).all()
    per_key = positions(df, ["v"], ["g"], rows_per_slot=60).toPandas()
    want = per_key.sort_values("v").groupby("g").cumcount()
    assert (per_key["_pos"] == want.reindex(per_key.index)).all()
    assert place(df, ["v"], 60).select("_slot").distinct().count() > 3


def test_running_sums_keep_nulls_apart(spark):
    df = spark.createDataFrame([(i, None if i % 4 else i) for i in range(40)], "i int, x int")
    out = running(place(df, ["i"], 7), ["i"], {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, inclusive=False)
    pdf = out.toPandas().sort_values("i")
    assert pd.isna(pdf["s"].iloc[0])
    assert pdf["s"].iloc[-1] == sum(i for i in range(39) if i % 4 == 0)
    assert pdf["m"].iloc[-1] == 36


def test_mart_keeps_every_row_once_and_counts_are_not_negative(tables):
    mart = tables.mart()
    pdf = mart.toPandas()
    assert len(pdf) == tables.transactions.count() == pdf["transaction_id"].nunique()
    assert len(mart.columns) == 80
    counts = [c for c in mart.columns if "count" in c or "freq" in c]
    assert (pdf[counts] >= 0).all().all()


def test_cut_mart_equals_plain_mart(tables):
    key = "transaction_id"
    plain = tables.mart().toPandas().sort_values(key).reset_index(drop=True)
    cut = tables.mart(cap=30, block_rows=60).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, cut, rtol=1e-9)


def test_future_rows_do_not_change_past_features(spark, tables):
    rows = tables.transactions
    cut = datetime(2024, 1, 20)
    usual_home = ["is_out_of_home_state", "is_different_zip", "zip_region_distance", "oos_new_merchant"]
    others = [c for c in fraud_mart.MART_COLUMNS if c not in usual_home]

    def mart(df):
        features = fraud_mart.fraud_features(df, tables.mcc, tables.cards, tables.users)
        return features.filter(F.col("transaction_date") < F.lit(cut)).select(*others).toPandas().sort_values("transaction_id").reset_index(drop=True)

    earlier = rows.filter(F.col("transaction_date") < F.lit(cut))
    pd.testing.assert_frame_equal(mart(rows), mart(earlier), rtol=1e-9)


def test_point_in_time_home_ignores_the_same_and_later_days(spark):
    day = datetime(2024, 1, 1)
    rows = [
        (1, day, 1, "S1"),
        (2, day + timedelta(days=1), 1, "S2"),
        (3, day + timedelta(days=1, hours=1), 1, "S2"),
        (4, day + timedelta(days=2), 1, "S1"),
        (5, day + timedelta(days=3), 1, ""),
    ]
    df = spark.createDataFrame(rows, "transaction_id bigint, transaction_date timestamp_ntz, client_id bigint, merchant_state string")
    got = {r.transaction_id: (r.home_state_so_far, r.is_out_of_home_so_far) for r in fraud_mart.home_state_so_far(df).collect()}
    assert got == {1: (None, 0), 2: ("S1", 1), 3: ("S1", 1), 4: ("S2", 1), 5: ("S1", 1)}
