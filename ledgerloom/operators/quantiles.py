"""Exact quantiles with linear interpolation, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import ROWS_PER_SLOT, place, running


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """One row per group with the named quantiles and ``n`` non-NULL values.

    Equal values are counted first. Ranks come from running counts over slots of the
    distinct values, and each quantile is the interpolation of the two values around it.
    """
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = place(counts, [*group, "_v"], rows_per_slot)
    ranked = running(placed, ["_v"], {"_upto": ("sum", F.col("_n"))}, keys=group, totals=True)
    ranked = ranked.withColumnRenamed("_upto_total", "n")
    around = []
    for name, q in quantiles.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        # smallest value whose running count passes the rank
        around += [
            F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v"))).cast("double").alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v"))).cast("double").alias(f"_hi_{name}"),
        ]
    found = ranked.groupBy(*group, "n").agg(*around)
    interpolated = [
        (
            F.col(f"_lo_{name}")
            + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
            * ((F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q))))
        ).alias(name)
        for name, q in quantiles.items()
    ]
    return found.select(*group, "n", *interpolated)
