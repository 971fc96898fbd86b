"""The batch jobs end to end: raw files to marts, marts to models, models to predictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import encoding, enrich, quality, staging
from ledgerloom.plans import fraud_mart, models, monthly
from ledgerloom.session import configure, stage
from ledgerloom.sources import artifacts, readers, sinks

TIME_ORDER = ("transaction_date", "transaction_id")
FRAUD_MART, MONTHLY_MART = "mart_fraud_features", "mart_client_monthly_expenses"


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four raw tables of a folder of CSV files or folders."""
    configure(spark)
    return {
        "transactions": readers.read_transactions(spark, f"{folder}/transactions_data.csv"),
        "cards": readers.read_cards(spark, f"{folder}/cards_data.csv"),
        "users": readers.read_users(spark, f"{folder}/users_data.csv"),
        "mcc": readers.read_mcc_codes(spark, f"{folder}/mcc_codes.csv"),
    }


def stage_all(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Staging and intermediate tables as lazy frames, registered as views of the logic layer."""
    staged = {
        "stg_transactions": staging.stage_transactions(raw["transactions"]),
        "stg_cards": staging.stage_cards(raw["cards"]),
        "stg_users": staging.stage_users(raw["users"]),
        "stg_mcc_codes": staging.stage_mcc(raw["mcc"]),
    }
    staged["int_transactions_enriched"] = enrich.enriched_transactions(
        staged["stg_transactions"], staged["stg_mcc_codes"]
    )
    staged["int_client_transactions"] = enrich.client_transactions(
        staged["int_transactions_enriched"], staged["stg_users"], staged["stg_cards"]
    )
    sinks.register_views(sinks.LOGIC, staged)
    return staged


def build_marts(spark: SparkSession, raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Write both marts to the presentation database and return them as tables."""
    staged = stage_all(raw)
    marts = {
        FRAUD_MART: fraud_mart.fraud_features(
            staged["stg_transactions"], staged["stg_mcc_codes"], staged["stg_cards"], staged["stg_users"]
        ),
        MONTHLY_MART: monthly.monthly_expenses(staged["int_transactions_enriched"]),
    }
    # by year: reports and model loads read ranges of time
    sinks.save_marts(spark, marts, {FRAUD_MART: "txn_year"})
    return {name: spark.table(f"{sinks.PRESENTATION}.{name}") for name in marts}


def check_marts(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Rule failures of the marts: missing keys and repeated keys, zero rows when all hold."""
    missing = quality.null_counts_by_table(
        marts,
        {
            FRAUD_MART: ["transaction_id", "client_id", "card_id", "mcc"],
            MONTHLY_MART: ["client_id", "expense_month", "total_expenses"],
        },
    )
    repeated = quality.repeated_keys(
        marts, {FRAUD_MART: ["transaction_id"], MONTHLY_MART: ["client_id", "expense_month"]}
    )
    return (
        missing.select("table_name", F.lit("not_null").alias("rule"), "column_name", F.col("n_null").alias("failures"))
        .unionByName(
            repeated.select(
                "table_name",
                F.lit("unique").alias("rule"),
                F.col("key_columns").alias("column_name"),
                F.col("n_surplus").alias("failures"),
            )
        )
        .filter("failures > 0")
    )


def train_fraud(mart: DataFrame, labels: DataFrame, path: str, strict: bool = False, **fit_options) -> models.FocalModel:
    """Fit, save the model and the encodings learnt on all labelled rows."""
    spark = mart.sparkSession
    columns = ["transaction_id", "transaction_date", *models.ENCODED]
    wanted = list(dict.fromkeys([*columns, *[f for f in models.FRAUD_FEATURES if f in mart.columns]]))
    rows = stage(models.training_rows(mart.select(*wanted), labels, TIME_ORDER, strict), "training")
    model = models.fit_focal(rows, **fit_options)
    artifacts.save_fraud_model(model, spark, path)
    labelled = mart.select(*columns).join(labels.withColumnRenamed("is_fraud", "label"), "transaction_id")
    for column in models.ENCODED:
        table = encoding.encoding_table(labelled, column, "label")
        artifacts.save_table(table, path, f"target_encodings/{column}")
    mean = labelled.agg(F.avg("label").alias("mean"))
    artifacts.save_table(mean, path, "target_encodings/overall")
    return model


def score_fraud(rows: DataFrame, path: str, threshold: float = models.SERVING_THRESHOLD) -> DataFrame:
    """Score mart rows or request features with the saved model and encodings."""
    spark = rows.sparkSession
    mean = spark.read.parquet(f"{path}/target_encodings/overall").first()[0]
    for column in models.ENCODED:
        table = spark.read.parquet(f"{path}/target_encodings/{column}")
        rows = rows.join(table, column, "left").fillna({f"{column}_te": mean})
    ready = models.prepare_features(models.padded(rows, models.FRAUD_FEATURES))
    scored = artifacts.load_fraud_model(spark, path).score(ready, threshold)
    return scored.select("transaction_id", "probability", "predicted", "threshold")


def train_forecast(monthly_mart: DataFrame, users: DataFrame, path: str, learner=models.gbt) -> dict:
    """Fit one model per horizon; save them and every client's latest features."""
    fitted = models.fit_horizons(models.trained_rows(monthly_mart, users), learner)
    artifacts.save_forecast_models(fitted, path)
    latest = monthly.latest_features(monthly.forecast_features(monthly_mart, users))
    artifacts.save_table(latest, path, "client_features")
    return fitted


def forecast(targets: DataFrame, path: str) -> DataFrame:
    """Forecast (client_id, month, horizon) targets with the saved models."""
    latest = targets.sparkSession.read.parquet(f"{path}/client_features")
    return models.forecast_batch(targets, latest, artifacts.load_forecast_models(targets.sparkSession, path))
