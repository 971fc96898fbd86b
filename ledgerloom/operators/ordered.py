"""Ordered work over groups, or whole tables, too large for one task.

``place`` cuts a table into balanced ranges of its order (slots). A running total is
then the total of the earlier slots plus the running total inside the slot, so no task
ever holds more than one slot, whatever share of the rows one key has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stage

SLOT = "_slot"
ROWS_PER_SLOT = 1_000_000

_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_LOCAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def place(df: DataFrame, order: Sequence[Column | str], rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Add ``_slot``: rows of a lower slot precede rows of a higher one in the order.

    A table that fits one slot (counted) is returned as it is, lazy and without the column.
    A larger one is range-partitioned and staged, since range bounds come from a sample and
    must not be drawn twice.
    """
    total = df.count()
    if total <= rows_per_slot:
        return df
    slots = -(-total // rows_per_slot)
    return stage(df.repartitionByRange(slots, *order).withColumn(SLOT, F.spark_partition_id()), "slots")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys match, keeping the left side's key columns."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def running(
    placed: DataFrame,
    order: Sequence[Column | str],
    measures: Mapping[str, tuple[str, Column]],
    keys: Sequence[str] = (),
    inclusive: bool = True,
    slot: str = SLOT,
    totals: bool = False,
) -> DataFrame:
    """Running aggregates in order, per key or over the whole table.

    measures: output name -> (sum | count | max | min, expression). Excluding the current
    row (``inclusive=False``) makes the first row NULL for sum, max and min, 0 for count.
    ``totals`` adds ``<name>_total``, the aggregate over all rows of the key.
    """
    last = Window.currentRow if inclusive else -1
    up_to = Window.unboundedPreceding, last
    if slot not in placed.columns:  # one slot
        here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*up_to)
        columns = {name: _LOCAL[how](e).over(here) for name, (how, e) in measures.items()}
        if totals:
            whole = Window.partitionBy(*keys)
            columns |= {f"{name}_total": _LOCAL[how](e).over(whole) for name, (how, e) in measures.items()}
        return placed.withColumns(columns)
    # one row per slot and key: at most (rows / rows_per_slot) rows for any key
    parts = placed.groupBy(*keys, slot).agg(
        *[_LOCAL[how](expression).alias(f"_t_{name}") for name, (how, expression) in measures.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = [_MERGE[how](f"_t_{name}").over(earlier).alias(f"_o_{name}") for name, (how, _) in measures.items()]
    if totals:
        whole = Window.partitionBy(*keys)
        offsets += [
            _MERGE[how](f"_t_{name}").over(whole).alias(f"{name}_total") for name, (how, _) in measures.items()
        ]
    local = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(*up_to)
    joined = null_safe_join(placed, parts.select(*keys, slot, *offsets), [*keys, slot], "left")
    combined = joined.withColumns(
        {name: _combine(how, F.col(f"_o_{name}"), _LOCAL[how](e).over(local)) for name, (how, e) in measures.items()}
    )
    return combined.drop(*[f"_o_{name}" for name in measures])


def _combine(how: str, before: Column, here: Column) -> Column:
    if how == "max":
        return F.greatest(before, here)
    if how == "min":
        return F.least(before, here)
    if how == "count":
        return F.coalesce(before, F.lit(0)) + here
    return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)


def positions(
    df: DataFrame,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    name: str = "_pos",
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """0-based position of every row in the order (which must have no ties), per key if given."""
    placed = place(df, [*keys, *order], rows_per_slot)
    return running(placed, order, {name: ("count", F.lit(1))}, keys, inclusive=False).drop(SLOT)
