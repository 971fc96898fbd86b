import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.sources import readers, sinks


def test_csv_fields_may_hold_line_breaks(spark, folder):
    with open(f"{folder}/t.csv", "w") as f:
        f.write('id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,merchant_state,zip,mcc,errors\n')
        f.write('1,2020-01-01 00:00:00,1,2,$-7.00,Swipe Transaction,3,"New\nTown",S,58523.0,5000,"Bad PIN,Insufficient Balance"\n')
    row = readers.read_transactions(spark, f"{folder}/t.csv").first()
    assert (row.merchant_city, row.errors, row.amount) == ("New\nTown", "Bad PIN,Insufficient Balance", "$-7.00")


def test_json_dictionaries(spark, folder):
    with open(f"{folder}/labels.json", "w") as f:
        json.dump({"target": {"5": "Yes", "6": "No"}}, f, indent=1)
    with open(f"{folder}/plain.json", "w") as f:
        json.dump({"7": "Yes"}, f)
    for name, want in (("labels", [(5, 1), (6, 0)]), ("plain", [(7, 1)])):
        documents = readers.read_text_documents(spark, f"{folder}/{name}.json")
        assert sorted(tuple(r) for r in readers.explode_labels(documents).collect()) == want
    targets = spark.createDataFrame([(json.dumps({"target": {"4": {"2019-12": 0, "2019-11": 1}}}),)], "value string")
    assert [tuple(r) for r in readers.explode_targets(targets).orderBy("horizon").collect()] == [(4, "2019-11", 1), (4, "2019-12", 2)]


def test_mart_falls_back_to_files(spark, folder):
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(f"{folder}/m")
    got = readers.read_mart(spark, "no_such_mart", f"{folder}/m", ["id"])
    assert got.columns == ["id"] and got.count() == 3
    spark.range(5).createOrReplaceTempView("some_mart")
    assert readers.read_mart(spark, "some_mart", f"{folder}/m", ["id"]).count() == 5


def test_a_broken_view_is_no_missing_mart(spark, folder):
    spark.range(3).write.parquet(f"{folder}/m")
    spark.sql("CREATE DATABASE IF NOT EXISTS presentation")
    assert readers.read_mart(spark, "presentation.absent", f"{folder}/m").count() == 3
    spark.range(3).createOrReplaceTempView("few_columns")
    with pytest.raises(AnalysisException):
        readers.read_mart(spark, "few_columns", f"{folder}/m", ["no_such_column"])


def test_buckets_serve_windows_without_an_exchange(spark, folder):
    # half of the rows share one key, some have none
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 9 > 0, F.col("id") % 50).alias("k"), "id")
    saved = sinks.save_buckets(rows, "bucket_test", ["k"], ["id"], 4, path=f"{folder}/b")
    order = Window.partitionBy("k").orderBy("id")
    number = F.row_number().over(order).alias("number")
    got = saved.select("id", number)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in saved.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.select("id", number).collect()))
    assert len(list(Path(f"{folder}/b").glob("*.parquet"))) <= 16


def test_unscored_targets_are_answered_no(spark):
    targets = spark.createDataFrame([(1,), (2,), (3,)], "transaction_id bigint")
    scored = spark.createDataFrame([(1, 1), (2, 0)], "transaction_id bigint, predicted int")
    assert {r.transaction_id: r.prediction for r in sinks.fraud_predictions(targets, scored).collect()} == {1: "Yes", 2: "No", 3: "No"}


def test_forecast_lines(spark):
    df = spark.createDataFrame([(4, "2019-12", 2.346), (4, "2019-11", 1.0)], "client_id bigint, month string, predicted_expense double")
    assert json.loads(sinks.forecast_predictions(df).first().value) == {"4": {"2019-11": 1.0, "2019-12": 2.35}}
