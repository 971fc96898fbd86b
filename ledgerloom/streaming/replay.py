"""Replay of a raw transaction table in time chunks with a stored cursor."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import discard, present, stage, stage_at
from ledgerloom.streaming.landing import land_batch, with_reasons

# fixed values: days per chunk and the cursor before any run
CHUNK_DAYS = 30
FIRST_CURSOR = datetime(1970, 1, 1)

STATUS = "chunk_start timestamp_ntz, chunk_end timestamp_ntz, rows_published bigint, rows_skipped bigint"


def store_by_day(raw: DataFrame, path: str) -> DataFrame:
    """Write a raw table in one folder per calendar day (none for dates that do not parse) and read it back.

    Only a table with this ``day`` column is pruned to the days of a chunk.
    """
    day = F.to_date(F.col("date").try_cast("timestamp_ntz"))
    raw.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)
    return raw.sparkSession.read.schema(raw.withColumn("day", day).schema).parquet(path)


def chunk(raw: DataFrame, cursor: datetime, days: int) -> DataFrame:
    """Raw rows after the cursor and up to ``days`` later, with the reasons they are bad.

    A table stored by day is read only in the days of the chunk; any other is scanned whole.
    """
    when = F.col("date").try_cast("timestamp_ntz")
    end = cursor + timedelta(days=days)
    if "day" in raw.columns:
        raw = raw.filter(F.col("day").between(cursor.date(), end.date())).drop("day")
    inside = (when > F.lit(cursor).cast("timestamp_ntz")) & (when <= F.lit(end).cast("timestamp_ntz"))
    return with_reasons(raw.filter(inside))


def _counters() -> list[Column]:
    """What the status needs of a chunk: its last good row, as text, and its good and bad rows."""
    good = F.size("reasons") == 0
    last = F.max(F.when(good, F.col("date").try_cast("timestamp_ntz")))
    return [last.cast("string").alias("last"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad")]


def first_cursor(raw: DataFrame) -> datetime:
    """A second before the first row, so that no empty chunks precede the data."""
    first = raw.select(F.min(F.col("date").try_cast("timestamp_ntz"))).first()[0]
    return first - timedelta(seconds=1) if first else FIRST_CURSOR


def read_cursor(spark: SparkSession, path: str) -> datetime:
    if not present(spark, path):
        return FIRST_CURSOR
    stored = spark.read.schema("position timestamp_ntz").parquet(path).agg(F.max("position")).first()[0]
    return stored or FIRST_CURSOR


def write_cursor(spark: SparkSession, path: str, position: datetime) -> None:
    """Append the new position; the newest is the current one, so a failed run leaves the old one."""
    spark.createDataFrame([(position,)], "position timestamp_ntz").coalesce(1).write.mode("append").parquet(path)


def quarantine_undated(raw: DataFrame, quarantine: str) -> None:
    """Set apart the rows whose date does not parse: no chunk can ever hold them.

    Run once per raw table; running again replaces the same quarantine folder.
    """
    if "day" in raw.columns:
        raw = raw.filter("day IS NULL").drop("day")
    undated = with_reasons(raw.filter(F.col("date").try_cast("timestamp_ntz").isNull()))
    rows = undated.withColumn("received", F.current_date())
    rows.write.mode("overwrite").partitionBy("received").parquet(f"{quarantine}/batch_id=-1")


def replay_next(raw: DataFrame, cursor_path: str, landing: str, quarantine: str, days: int = CHUNK_DAYS) -> DataFrame:
    """One run: land the next chunk, advance the cursor, return the status row.

    The raw table is read once: the chunk is staged, and its rows are counted by that write.
    The status names where the chunk starts and ends, rows published and rows skipped. A chunk
    ends at its last good row, or at its bound when there is none; bad rows after the last good
    one are therefore met again by the next chunk.

    The cursor moves last. A run that fails before that is repeated by the next one, which
    skips the rows already landed.
    """
    spark = raw.sparkSession
    cursor = read_cursor(spark, cursor_path)
    counted = Observation("chunk")
    checked, staged = stage_at(chunk(raw, cursor, days).observe(counted, *_counters()), "chunk")
    land_batch(checked.drop("reasons"), int(cursor.replace(tzinfo=UTC).timestamp()), landing, quarantine)
    found = counted.get
    end = datetime.fromisoformat(found["last"]) if found["last"] else cursor + timedelta(days=days)
    write_cursor(spark, cursor_path, end)
    discard(spark, staged)
    return spark.createDataFrame([(cursor, end, found["good"], found["bad"])], STATUS)


def replay_rest(raw: DataFrame, cursor_path: str, landing: str, quarantine: str, days: int = CHUNK_DAYS) -> DataFrame:
    """Runs of ``replay_next`` up to the table's last row; their status rows. An empty table needs no run."""
    spark = raw.sparkSession
    last = raw.select(F.max(F.col("date").try_cast("timestamp_ntz"))).first()[0]
    if last and read_cursor(spark, cursor_path) == FIRST_CURSOR:
        write_cursor(spark, cursor_path, first_cursor(raw))
    runs = []
    while last and read_cursor(spark, cursor_path) < last:
        runs += replay_next(raw, cursor_path, landing, quarantine, days).collect()
    return spark.createDataFrame(runs, STATUS)


def replay_statuses(raw: DataFrame, days: int = CHUNK_DAYS) -> DataFrame:
    """The status rows of all runs that replay the whole table.

    Good and bad rows are counted per second in one pass and staged in time order. The
    cursor rule is sequential, so the chunks follow one by one, each reading only the
    counted seconds of its own range.
    """
    good = F.size("reasons") == 0
    counted = (
        with_reasons(raw)
        .withColumn("moment", F.col("date").try_cast("timestamp_ntz"))
        .filter(F.col("moment").isNotNull())
        .groupBy("moment")
        .agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    )
    seconds = stage(counted.repartitionByRange("moment"), "replay")
    bounds = seconds.agg(F.min("moment").alias("first"), F.max("moment").alias("last")).first()
    statuses = []
    cursor = bounds.first - timedelta(seconds=1) if bounds.first else None
    while cursor is not None and cursor < bounds.last:
        end = cursor + timedelta(days=days)
        inside = seconds.filter((F.col("moment") > F.lit(cursor)) & (F.col("moment") <= F.lit(end)))
        found = inside.agg(
            F.max(F.when(F.col("good") > 0, F.col("moment"))).alias("last"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        ).first()
        statuses.append((cursor, found.last or end, found.good, found.bad))
        cursor = found.last or end
    return raw.sparkSession.createDataFrame(statuses, STATUS)
