"""Readers with declared schemas, and parsers of JSON dictionaries held in a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header and quoted fields.

    Quoted line breaks need ``multi_line``, which reads each file in one task: keep landing
    files of ordinary block size. Pass False where no field holds a line break.
    """
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=multi_line)


def read_transactions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, schemas.LANDING_TRANSACTIONS, multi_line)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CARDS)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.USERS)


def read_mcc_codes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.MCC_CODES)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows as text, before typing."""
    return read_csv(spark, path, schemas.LABELS, multi_line=False)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one per file, as a column ``value``."""
    return spark.read.text(path, wholetext=True)


def typed_labels(labels: DataFrame) -> DataFrame:
    """Yes/No text to (transaction_id bigint, is_fraud 0/1)."""
    return labels.select(
        F.col("transaction_id").try_cast("bigint").alias("transaction_id"),
        F.when(F.col("is_fraud") == "Yes", 1).otherwise(0).alias("is_fraud"),
    )


def explode_labels(documents: DataFrame) -> DataFrame:
    """``{"target": {id: "Yes" | "No"}}``, the wrapper being optional, to typed label rows."""
    wrapped = F.from_json("value", "map<string,map<string,string>>")["target"]
    plain = F.from_json("value", "map<string,string>")
    body = F.when(F.get_json_object("value", "$.target").isNotNull(), wrapped).otherwise(plain)
    return typed_labels(documents.select(F.explode(body).alias("transaction_id", "is_fraud")))


def explode_mcc(documents: DataFrame) -> DataFrame:
    """``{code: category}`` to (mcc, category_name)."""
    codes = documents.select(F.explode(F.from_json("value", "map<string,string>")).alias("code", "category_name"))
    return codes.select(F.col("code").try_cast("int").alias("mcc"), "category_name")


def explode_targets(documents: DataFrame) -> DataFrame:
    """``{"target": {client: {month: value}}}`` to (client_id, month, horizon).

    A client's months in order are its horizons 1, 2, ...
    """
    clients = F.from_json(F.get_json_object("value", "$.target"), "map<string,map<string,double>>")
    months = documents.select(F.explode(clients).alias("client", "months")).select(
        F.col("client").cast("bigint").alias("client_id"),
        F.posexplode(F.sort_array(F.map_keys("months"))).alias("position", "month"),
    )
    return months.select("client_id", "month", (F.col("position") + 1).alias("horizon"))


def read_mart(spark: SparkSession, name: str, fallback_path: str, columns: list[str] | None = None) -> DataFrame:
    """A mart by table name, else (no table or view of that name) its files; only the wanted columns are read."""
    mart = spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(fallback_path)
    return mart.select(*columns) if columns else mart
