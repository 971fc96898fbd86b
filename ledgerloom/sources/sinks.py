"""Layered tables, CSV outputs and prediction files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: layer names
LANDING, LOGIC, PRESENTATION = "landing", "logic", "presentation"


def register_views(layer: str, tables: Mapping[str, DataFrame]) -> None:
    """Staging and intermediate tables stay views: a mart query is one Catalyst plan."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{layer}_{name}")


def save_buckets(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], buckets: int, files: int = 4, path: str | None = None) -> DataFrame:
    """Write a table of the presentation database in buckets of its keys, and return it.

    Windows, groups and joins on the keys (or on more columns) then read it without an
    exchange. A bucket is written by ``files`` tasks, each in the given order, so a key with
    many rows is not one task's work and the table has ``buckets * files`` files at most. A
    null key has a bucket like any other. ``path`` puts the files outside the warehouse.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {PRESENTATION}")
    own = F.pmod(F.hash(*keys), F.lit(buckets))  # the rule by which Spark numbers buckets
    part = F.pmod(F.xxhash64(*order), F.lit(files))
    writer = df.repartition(buckets * files, own, part).write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, *keys).sortBy(*order)
    (writer.option("path", path) if path else writer).saveAsTable(f"{PRESENTATION}.{name}")
    return spark.table(f"{PRESENTATION}.{name}")


def save_marts(
    spark: SparkSession, marts: Mapping[str, DataFrame], partition_by: Mapping[str, str] | None = None
) -> None:
    """Write marts as tables of the presentation database, partitioned where asked."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {PRESENTATION}")
    for name, df in marts.items():
        writer = df.write.mode("overwrite").format("parquet")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.saveAsTable(f"{PRESENTATION}.{name}")


def write_csv(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    writer.csv(path, header=True, quote='"', escape='"')


def fraud_predictions(targets: DataFrame, scored: DataFrame) -> DataFrame:
    """Yes or No for every requested transaction; No where none was scored."""
    answers = scored.select("transaction_id", F.when(F.col("predicted") == 1, "Yes").otherwise("No").alias("answer"))
    return targets.join(answers, "transaction_id", "left").select(
        "transaction_id", F.coalesce("answer", F.lit("No")).alias("prediction")
    )


def forecast_predictions(forecasts: DataFrame) -> DataFrame:
    """One JSON line per client: {client: {month: amount}}, amounts rounded to cents."""
    months = F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("month", F.round("predicted_expense", 2).alias("amount"))))
    )
    # a client has as many rows as horizons
    return forecasts.groupBy("client_id").agg(months.alias("months")).select(
        F.to_json(F.create_map(F.col("client_id").cast("string"), "months")).alias("value")
    )


def write_predictions(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
