"""Saving and loading of models, encodings and latest client features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.models import FocalModel, ensemble
from ledgerloom.session import present

HEAD = "features string, rate double, n_trees int"


def save_fraud_model(model: FocalModel, spark: SparkSession, path: str) -> None:
    model.inputs.write().overwrite().save(f"{path}/fraud/inputs")
    if model.trees:
        ensemble(model.trees, model.rate).write().overwrite().save(f"{path}/fraud/trees")
    head = spark.createDataFrame([(",".join(model.features), model.rate, len(model.trees))], HEAD)
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/fraud/head")


def load_fraud_model(spark: SparkSession, path: str) -> FocalModel:
    head = spark.read.schema(HEAD).parquet(f"{path}/fraud/head").first()
    trees = GBTRegressionModel.load(f"{path}/fraud/trees").trees if head.n_trees else []
    inputs = PipelineModel.load(f"{path}/fraud/inputs")
    return FocalModel(inputs, head.features.split(","), head.rate, trees)


def save_forecast_models(models: dict[int, GBTRegressionModel], path: str) -> None:
    for h, model in models.items():
        model.write().overwrite().save(f"{path}/forecast_h{h}")


def load_forecast_models(spark: SparkSession, path: str, horizons=(1, 2, 3)) -> dict[int, GBTRegressionModel]:
    """The horizons that are present; a missing one is left out, a broken one fails."""
    places = {h: f"{path}/forecast_h{h}" for h in horizons}
    return {h: GBTRegressionModel.load(place) for h, place in places.items() if present(spark, place)}


def save_table(df: DataFrame, path: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}")


def artifact_status(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, is_loaded) of everything a scoring job may need."""
    places = {
        "fraud_model": "fraud/head",
        "forecast_h1": "forecast_h1/data",
        "forecast_h2": "forecast_h2/data",
        "forecast_h3": "forecast_h3/data",
        "target_encodings": "target_encodings/overall",
        "client_features": "client_features",
    }
    # a finished write leaves this mark, so a folder that a failed job left does not count
    rows = [(name, present(spark, f"{path}/{place}/_SUCCESS")) for name, place in places.items()]
    return spark.createDataFrame(rows, "artifact string, is_loaded boolean")
