"""Session settings, staged tables and row keys shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import batch_rows, configure, ship, stage

__all__ = ["BATCH_ROWS", "batch_rows", "keyed", "null_safe", "prepare", "release", "stage", "table", "word_array"]

# rows of one Arrow batch: a few hundred long documents stay in the tens of MB
BATCH_ROWS = 400

SPACE = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the operators, adaptive execution and small Arrow batches; ships the package."""
    configure(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no table needs any more; it does so when the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text and `fp`, a hash of the text.

    (doc_id, fp) stands for a document where rows have to be found again: a
    repeated doc_id with another text stays apart, repeated rows share results.
    """
    return docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("fp"))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys of the left side stay."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def word_array(text: Column) -> Column:
    """Words of a text: maximal runs without ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
