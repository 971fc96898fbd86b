"""Payload decoding and the landing job: good rows once, bad rows to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.scalars import blank_to_null
from ledgerloom.operators.quality import keep_first
from ledgerloom.session import present
from ledgerloom.sources import schemas

# fixed value: fields that must be whole numbers in a message
WHOLE_NUMBERS = ("id", "client_id", "card_id", "merchant_id", "mcc")


def decode(payloads: DataFrame) -> DataFrame:
    """Base64 JSON messages in ``data`` to landing-table rows (id as text, zip as a number)."""
    message = F.from_json(F.unbase64("data").cast("string"), schemas.RAW_TRANSACTIONS)
    rows = payloads.select(message.alias("m")).select("m.*")
    return rows.select(
        "id",
        "date",
        *[F.col(c).try_cast("bigint").alias(c) for c in ("client_id", "card_id")],
        "amount",
        "use_chip",
        F.col("merchant_id").try_cast("bigint").alias("merchant_id"),
        "merchant_city",
        "merchant_state",
        blank_to_null("zip").try_cast("double").alias("zip"),
        F.col("mcc").try_cast("bigint").alias("mcc"),
        "errors",
    )


def with_reasons(raw: DataFrame) -> DataFrame:
    """Add ``reasons``: the fields of a raw row that do not parse."""
    checks = [F.when(F.col(c).try_cast("bigint").isNull(), c) for c in WHOLE_NUMBERS]
    checks.append(F.when(F.col("date").try_cast("timestamp_ntz").isNull(), "date"))
    return raw.withColumn("reasons", F.array_compact(F.array(*checks)))


def well_formed(checked: DataFrame) -> DataFrame:
    """Typed landing rows of the raw rows without reasons."""
    good = checked.filter(F.size("reasons") == 0)
    return good.select(
        F.col("id").try_cast("bigint").alias("id"),
        F.col("date").try_cast("timestamp_ntz").alias("date"),
        *[F.col(c).try_cast("bigint").alias(c) for c in ("client_id", "card_id")],
        "amount",
        "use_chip",
        F.col("merchant_id").try_cast("bigint").alias("merchant_id"),
        "merchant_city",
        "merchant_state",
        "zip",
        F.col("mcc").try_cast("bigint").alias("mcc"),
        "errors",
    )


def malformed(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)


def land_batch(raw: DataFrame, batch_id: int, landing: str, quarantine: str) -> DataFrame:
    """Append the batch's new rows to the landing table and its bad rows to quarantine.

    A message may be delivered again, in this batch or a later one, and a failed batch runs
    again. A copy is a row with the same id and day, in the batch and across batches. Copies inside
    the batch are reduced by an aggregate; earlier copies are found by an anti join with the landing
    partitions of the batch's own days, which a join with these days picks. Quarantine is written
    per batch and replaced when the batch runs again.

    Returns the batch's typed rows.
    """
    spark = raw.sparkSession
    checked = with_reasons(raw)
    rows = keep_first(well_formed(checked).withColumn("day", F.to_date("date")), ["id", "day"], ["date"])
    days = F.broadcast(well_formed(checked).select(F.to_date("date").alias("day")).distinct())  # the calendar bounds it
    fresh = rows
    if present(spark, landing):  # a first batch finds none
        landed = spark.read.schema(rows.schema).parquet(landing).select("id", "day").join(days, "day", "left_semi")
        fresh = rows.join(landed, ["id", "day"], "left_anti")
    fresh.select(*rows.columns).write.mode("append").partitionBy("day").parquet(landing)
    bad = malformed(checked).withColumn("received", F.current_date())
    bad.write.mode("overwrite").partitionBy("received").parquet(f"{quarantine}/batch_id={batch_id}")
    return rows


def start_landing(
    stream: DataFrame, landing: str, quarantine: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Run ``land_batch`` on a stream of raw rows; by default until all input is consumed.

    Bound the rows of a batch with the source's ``maxFilesPerTrigger`` or
    ``maxOffsetsPerTrigger``.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read by several actions; replayed from the source if an executor is lost
        land_batch(batch, batch_id, landing, quarantine)
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def kept_quarantine(spark: SparkSession, quarantine: str, keep_days: int = 7) -> DataFrame:
    """The quarantine rows still within their retention; only partitions of those days are read."""
    rows = spark.read.option("basePath", quarantine).parquet(quarantine)
    return rows.filter(F.col("received") > F.date_sub(F.current_date(), keep_days))
