"""Smoothed target encoding of high-cardinality columns, and ordered splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import ROWS_PER_SLOT, null_safe_join, positions
from ledgerloom.session import stage

# fixed values: smoothing strength, number of folds, share of the training part
ALPHA = 10
FOLDS = 5
TRAIN_SHARE = 0.85


def contiguous_fold(position: Column, rows: int, folds: int = FOLDS) -> Column:
    """0-based fold of a 0-based position; the first ``rows % folds`` folds are one row larger."""
    size, larger = divmod(rows, folds)
    cut = larger * (size + 1)
    late = larger + F.floor((position - cut) / max(size, 1))
    return F.when(position < cut, F.floor(position / (size + 1))).otherwise(late).cast("int")


def with_order_position(
    df: DataFrame, order: Sequence[str], name: str = "position", rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    return positions(df, order, name=name, rows_per_slot=rows_per_slot)


def cut_in_order(
    df: DataFrame, order: Sequence[str], cuts: Sequence[int], name: str, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Add how many of the cuts, 0-based positions in the order, are not above the row's own.

    Only the order's columns are sorted: the rows at the cuts are found there, and every other
    row is compared with them. Where rows that tie lie on both sides of a cut, whole rows are placed.
    """
    ends = with_order_position(df.select(*order), order, "_position", rows_per_slot)
    wanted = sorted({p for c in cuts for p in (c - 1, c)})
    ends = stage(ends.filter(F.col("_position").isin(wanted)), "cuts")
    met = {r["_position"]: r[:-1] for r in ends.select(*order, "_position").collect()}  # two rows per cut
    if any(c in met and met[c] == met.get(c - 1) for c in cuts):
        position = F.col("_position")
        count = sum((F.when(position >= c, 1).otherwise(0) for c in cuts), F.lit(0))
        placed = with_order_position(df, order, "_position", rows_per_slot).withColumn(name, count).drop("_position")
        return stage(placed, "tied")  # another run could number tied rows otherwise
    key = F.struct(*order)
    begins = [ends.filter(F.col("_position") == c).select(key).scalar() for c in cuts]
    return df.withColumn(name, sum((F.when(key >= begin, 1).otherwise(0) for begin in begins), F.lit(0)))


def temporal_split(df: DataFrame, order: Sequence[str], rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Add ``split``: the first 85 % of the rows in order train, the rest validate."""
    cut = int(df.count() * TRAIN_SHARE)
    placed = cut_in_order(df, order, [cut], "_part", rows_per_slot)
    return placed.withColumn("split", F.when(F.col("_part") < 1, "train").otherwise("val")).drop("_part")


def smoothed(total: Column, count: Column, mean: Column) -> Column:
    return (total + ALPHA * mean) / (count + ALPHA)


def encode_out_of_fold(
    df: DataFrame, columns: Sequence[str], label: str, order: Sequence[str], rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Add ``<column>_te`` for each column: the smoothed label mean of the value over the other folds.

    Sums per value and fold come from one aggregate; a value's other folds are its total
    minus its own fold. A value unseen elsewhere gets the overall mean.
    """
    size, larger = divmod(df.count(), FOLDS)
    # where the folds after the first begin, as `contiguous_fold` deals the positions
    begins = [f * size + min(f, larger) for f in range(1, FOLDS)]
    out = cut_in_order(df, order, begins, "_fold", rows_per_slot)
    mean = df.select(F.avg(label)).scalar()
    for column in columns:
        per_fold = out.groupBy(column, "_fold").agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
        every_fold = Window.partitionBy(column)  # at most one row per fold
        others = [F.sum(c).over(every_fold) - F.col(c) for c in ("_s", "_n")]
        encoded = per_fold.select(column, "_fold", smoothed(*others, mean).alias(f"{column}_te"))
        # of known size, so that few values are sent to the rows and not the rows dealt anew
        out = null_safe_join(out, stage(encoded, "encoding"), [column, "_fold"], "left")
    return out.drop("_fold")


def encoding_table(train: DataFrame, column: str, label: str) -> DataFrame:
    """(value, encoded) from all training rows."""
    mean = train.select(F.avg(label)).scalar()
    return train.groupBy(column).agg(F.sum(label).alias("_s"), F.count(label).alias("_n")).select(
        column, smoothed(F.col("_s"), F.col("_n"), mean).alias(f"{column}_te")
    )


def apply_encoding(df: DataFrame, train: DataFrame, column: str, label: str) -> DataFrame:
    """Add ``<column>_te`` learnt on ``train``; unknown values get the overall mean."""
    mean = train.select(F.avg(label)).scalar()
    name = f"{column}_te"
    return df.join(encoding_table(train, column, label), column, "left").withColumn(
        name, F.coalesce(F.col(name), mean)
    )
