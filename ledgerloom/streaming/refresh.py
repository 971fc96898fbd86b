"""Incremental refresh of velocity features, and scoring of landed batches.

Velocity features look back at most seven days, so new rows change only the features of
their own day and the seven days after. A refresh reads those days and the seven before
them, and replaces the partitions of the changed days. Rows may arrive in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.scalars import epoch_seconds
from ledgerloom.operators.ordered import null_safe_join
from ledgerloom.operators.staging import stage_transactions
from ledgerloom.operators.windows import ENTITY_ROWS, Span, add_features, heavy_entities
from ledgerloom.plans.fraud_mart import CARD_FEATURES, fraud_features
from ledgerloom.session import discard, present, stage, stage_at
from ledgerloom.streaming.landing import land_batch

REACH_DAYS = 7
MART_BUCKETS = 64
VELOCITY = [f for f in CARD_FEATURES if isinstance(f, Span)]
VELOCITY_COLUMNS = (
    "card_txn_count_1h card_txn_count_24h card_txn_count_7d card_amount_sum_24h card_errors_7d "
    "card_amount_sum_prior_24h"
).split()
LANDED = (
    "id bigint, date timestamp_ntz, client_id bigint, card_id bigint, amount string, use_chip string, "
    "merchant_id bigint, merchant_city string, merchant_state string, zip string, mcc bigint, errors string, day date"
)


def velocity(landed: DataFrame, cap: int = ENTITY_ROWS) -> DataFrame:
    """The span features of the mart, from landed rows alone."""
    rows = stage_transactions(landed).withColumns(
        {"txn_epoch": epoch_seconds("transaction_date"), "abs_amount": F.abs("amount")}
    )
    wide = add_features(rows, "card_id", VELOCITY, heavy_entities(landed, "card_id", cap))
    own = F.col("abs_amount")
    return wide.select(
        "transaction_id",
        "card_id",
        (F.col("_n_1h") - 1).alias("card_txn_count_1h"),
        (F.col("_n_24h") - 1).alias("card_txn_count_24h"),
        (F.col("_n_7d") - 1).alias("card_txn_count_7d"),
        (F.col("_sum_24h") - own).cast("double").alias("card_amount_sum_24h"),
        "card_errors_7d",
        F.col("_sum_prior").cast("double").alias("card_amount_sum_prior_24h"),
        F.to_date("transaction_date").alias("day"),
    )


def _around(days: DataFrame, before: int, after: int) -> DataFrame:
    """The days from ``before`` days before each of ``days`` to ``after`` days after it; the calendar bounds their number."""
    span = F.sequence(F.date_sub("day", before), F.date_add("day", after))
    return F.broadcast(days.select(F.explode(span).alias("day")).distinct())


def refresh(spark: SparkSession, landing: str, features: str, days: DataFrame, cap: int = ENTITY_ROWS) -> None:
    """Recompute the features that rows of ``days`` (one column, day) change.

    Only these days, those within reach after them and what these look back on are read and
    replaced: a late row of an old day leaves the days between alone. No days change nothing.
    """
    days = stage(days.filter("day IS NOT NULL").distinct(), "changed-days")
    if days.isEmpty():
        return
    landed = spark.read.schema(LANDED).parquet(landing)
    # one more day before: a span is measured in seconds and may start within a day
    near = landed.join(_around(days, REACH_DAYS + 1, REACH_DAYS), "day", "left_semi").drop("day")
    changed = velocity(near, cap).join(_around(days, 0, REACH_DAYS), "day", "left_semi")
    (
        changed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(features)
    )


def land_and_refresh(raw: DataFrame, batch_id: int, landing: str, quarantine: str, features: str) -> None:
    """Land a batch and refresh the features it changes; safe to run again."""
    raw.persist()
    rows = land_batch(raw, batch_id, landing, quarantine)
    refresh(raw.sparkSession, landing, features, rows.select("day"))
    raw.unpersist()


def _of_keys(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows that share a client or a card with one of the chosen rows; a missing key is a key of its own."""
    marked = rows
    for key in ("client_id", "card_id"):
        keys = chosen.select(F.col(key).alias(f"_{key}"), F.lit(True).alias(f"_has_{key}")).distinct()
        marked = marked.join(keys, F.col(key).eqNullSafe(F.col(f"_{key}")), "left").drop(f"_{key}")
    return marked.filter("_has_client_id OR _has_card_id").drop("_has_client_id", "_has_card_id")


def refresh_mart(landed: DataFrame, batch: DataFrame, mart: str, mcc: DataFrame, cards: DataFrame, users: DataFrame, buckets: int = MART_BUCKETS) -> None:
    """Bring all columns of a saved mart up to date with the rows of ``batch``, which have landed already.

    Every row of a client or card in the batch can change (its home state, its maxima, the
    rows after a late one), and no other row can. These rows are computed again from all rows
    of their clients and cards, whatever the order of arrival. Which rows these are is found
    among the pairs of client and card, so landed rows meet their pair in one join. The mart is
    kept in buckets by client; the buckets they lie in are replaced, so running a batch again
    changes nothing.
    """
    spark, pair = landed.sparkSession, ["client_id", "card_id"]
    pairs = stage(landed.select(*pair).distinct(), "pairs")
    changed = stage(_of_keys(pairs, batch.select(*pair).distinct()), "changed-pairs")
    needed = null_safe_join(_of_keys(pairs, changed), changed.withColumn("_changed", F.lit(True)), pair, "left")
    rows = null_safe_join(stage_transactions(landed), stage(needed, "needed-pairs"), pair, "inner")
    bucket = F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int")
    # a column beside the mart's own, so that the wide rows need no join to tell which of them are changed
    fresh = fraud_features(rows, mcc, cards, users, beside=["_changed"]).filter("_changed").drop("_changed").withColumn("bucket", bucket)
    path = None
    if present(spark, mart):
        touched = [r.bucket for r in changed.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
        kept = null_safe_join(spark.read.schema(fresh.schema).parquet(mart).filter(F.col("bucket").isin(touched)), changed, pair, "left_anti")
        # written apart first: the buckets replaced are also read
        kept, path = stage_at(kept, "kept")
        fresh = fresh.unionByName(kept)
    # rows of a bucket meet first, in parts of Spark's advisory size, so that not every task writes a file per bucket
    fresh = fresh.hint("rebalance", "bucket")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(mart)
    if path:
        discard(spark, path)


def start_refresh(stream: DataFrame, landing: str, quarantine: str, features: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(lambda b, n: land_and_refresh(b, n, landing, quarantine, features))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_scoring(stream: DataFrame, score, output: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch scoring function to a stream of requests; each batch replaces its own output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
