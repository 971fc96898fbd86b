from pyspark.sql import functions as F

from ledgerloom import jobs
from ledgerloom.plans import models
from ledgerloom.sources import artifacts, sinks


def test_raw_files_to_predictions(spark, tables, folder):
    for name, df in (
        ("transactions_data", tables.landing),
        ("cards_data", tables.raw_cards),
        ("users_data", tables.raw_users),
        ("mcc_codes", tables.raw_mcc),
    ):
        sinks.write_csv(df, f"{folder}/{name}.csv")
    raw = jobs.read_raw(spark, folder)
    marts = jobs.build_marts(spark, raw)
    mart = marts[jobs.FRAUD_MART]
    assert mart.count() == tables.landing.count()
    assert jobs.check_marts(marts).isEmpty()
    assert spark.table("logic_int_client_transactions").count() == mart.count()

    path = f"{folder}/models"
    jobs.train_fraud(mart, tables.labels, path, rounds=2, rate=0.3, depth=3, leaf_rows=20, patience=2)
    scored = jobs.score_fraud(mart, path, 0.5)
    assert scored.count() == mart.count()
    assert scored.filter("probability <= 0 or probability >= 1").isEmpty()

    small = lambda target: models.gbt(target, rounds=1, depth=2)
    users = spark.table("logic_stg_users")
    jobs.train_forecast(tables.monthly, users, path, small)
    targets = spark.createDataFrame([(1, "2001-10", 1), (-5, "2001-10", 1)], "client_id bigint, month string, horizon int")
    assert {r.client_id: r.status for r in jobs.forecast(targets, path).collect()} == {1: "ok", -5: "client not found"}
    assert artifacts.artifact_status(spark, path).filter(~F.col("is_loaded")).isEmpty()


def test_strict_training_encodes_on_the_training_part_only(tables):
    rows = models.training_rows(tables.mart(), tables.labels, jobs.TIME_ORDER, strict=True)
    n = tables.labels.count()
    assert rows.count() == n and rows.filter("mcc_te is null or merchant_id_te is null").isEmpty()
    assert rows.filter("split = 'train'").count() == int(n * 0.85)
