from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import encoding

ORDER = ("at", "id")


def rows(spark, times):
    data = [(i, times[i], i % 3) for i in range(len(times))]
    return spark.createDataFrame(data, "id int, at timestamp_ntz, label int")


@pytest.mark.parametrize("slot", [1_000, 20])
def test_folds_and_split_are_those_of_the_positions(spark, slot):
    start = datetime(2024, 1, 1)
    df = rows(spark, [None if i % 11 == 0 else start + timedelta(days=i * 37 % 50) for i in range(103)])
    ordered = sorted(df.collect(), key=lambda r: (r.at is not None, r.at or start, r.id))
    place = {r.id: i for i, r in enumerate(ordered)}
    cuts = encoding.cut_in_order(df, ORDER, [21, 42, 63, 83], "fold", slot)
    folds = cuts.select("id", "fold").collect()
    assert {r.id: r.fold for r in folds} == {i: sum(p >= c for c in (21, 42, 63, 83)) for i, p in place.items()}
    split = encoding.temporal_split(df, ORDER, slot).collect()
    assert {r.id for r in split if r.split == "train"} == {i for i, p in place.items() if p < int(103 * 0.85)}


def test_ties_on_both_sides_of_a_cut_are_parted(spark):
    df = spark.createDataFrame([(None, None)] * 2 + [(1, None)] * 6 + [(2, None)] * 2, "id int, at timestamp_ntz")
    got = encoding.temporal_split(df, ORDER).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 8, "val": 2}
    cut = encoding.cut_in_order(df, ORDER, [5, 20], "part").groupBy("id", "part").agg(F.count("*").alias("n")).collect()
    assert {(r.id, r.part): r.n for r in cut} == {(None, 0): 2, (1, 0): 3, (1, 1): 3, (2, 1): 2}


def test_the_split_deals_no_whole_rows(spark):
    """A wide row is neither sorted nor exchanged: its place is found among the order's columns."""
    df = rows(spark, [datetime(2024, 1, 1 + i % 20) for i in range(60)]).withColumn("wide", F.repeat(F.lit("x"), F.col("id")))
    plan = encoding.temporal_split(df, ORDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subqueries")[0] and "Window" not in plan
