"""Per-entity ordered features that stay bounded when one entity holds a large share of rows.

A feature is one of

* ``Earlier`` - the value on the previous row,
* ``Rows``    - an aggregate over a fixed number of rows before the current one,
* ``History`` - an aggregate over all rows before the current one, optionally among rows
  that share further columns,
* ``Span``    - an aggregate over a time span in seconds, ends included.

Entities with at most ``cap`` rows use ordinary Spark windows. Entities above it are cut:
row features over blocks of consecutive rows that carry the last rows of the block before,
span features over time slices of per-second totals, where a sum over a span becomes a
running sum of amounts entering and leaving. Both give the same values.
A row without a time (NULL epoch) has no span features: they are NULL. Row features place it
before the rows with a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import null_safe_join, positions, running
from ledgerloom.session import stage

# An entity above this many rows is cut. It bounds the quadratic cost of sliding frames.
ENTITY_ROWS = 20_000
BLOCK_ROWS = 50_000
SLOT_BLOCKS = 20


@dataclass(frozen=True)
class Earlier:
    name: str
    value: str  # SQL expression


@dataclass(frozen=True)
class Rows:
    name: str
    how: str  # avg | stddev | max | min | sum | count
    value: str  # SQL expression
    first: int  # rows before the current row
    last: int = 1


@dataclass(frozen=True)
class History:
    name: str
    how: str  # max | count
    value: str  # SQL expression
    within: tuple[str, ...] = ()


@dataclass(frozen=True)
class Span:
    name: str
    how: str  # count | sum | min | distinct
    value: str  # SQL expression
    start: int  # seconds before the current second
    end: int = 0


Feature = Earlier | Rows | History | Span

_AGGREGATES = {
    "avg": F.avg,
    "stddev": F.stddev_samp,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "count": F.count,
}


def heavy_entities(df: DataFrame, entity: str, cap: int = ENTITY_ROWS) -> DataFrame | None:
    """Entities with more than ``cap`` rows as a staged table, None when there are none.

    Measure it on the narrowest table that has the same rows: the count reads one column
    and combines map-side.
    """
    heavy = df.groupBy(entity).count().filter(F.col("count") > cap).select(entity)
    return None if heavy.isEmpty() else stage(heavy, "heavy")


def add_features(
    df: DataFrame,
    entity: str,
    features: Sequence[Feature],
    heavy: DataFrame | None,
    epoch: str = "txn_epoch",
    order: Sequence[str] = ("transaction_date", "transaction_id"),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the features per entity; ``order`` must be free of ties and agree with ``epoch``.

    ``heavy`` are the entities to cut, from ``heavy_entities``.
    """
    if heavy is None:
        return _with_windows(df, entity, features, epoch, order)
    df = stage(df, "entities")  # read several times below
    light = _with_windows(null_safe_join(df, heavy, [entity], "left_anti"), entity, features, epoch, order)
    cut = _with_cuts(null_safe_join(df, heavy, [entity], "left_semi"), entity, features, epoch, order, block_rows)
    return light.unionByName(cut)


# --- ordinary windows -----------------------------------------------------------------


def _row_window(entity: str, order: Sequence[str], epoch: str, within: Sequence[str] = ()):
    # ordering by the epoch first lets the span windows reuse this sort
    return Window.partitionBy(entity, *within).orderBy(epoch, *order)


def _window_column(feature: Feature, entity, epoch, order):
    if isinstance(feature, Earlier):
        return F.lag(F.expr(feature.value)).over(_row_window(entity, order, epoch))
    if isinstance(feature, Rows):
        frame = _row_window(entity, order, epoch).rowsBetween(-feature.first, -feature.last)
        return _AGGREGATES[feature.how](F.expr(feature.value)).over(frame)
    if isinstance(feature, History):
        frame = _row_window(entity, order, epoch, feature.within).rowsBetween(Window.unboundedPreceding, -1)
        return _AGGREGATES[feature.how](F.expr(feature.value)).over(frame)
    frame = Window.partitionBy(entity).orderBy(epoch).rangeBetween(-feature.start, -feature.end)
    if feature.how == "distinct":
        inside = F.size(F.collect_set(F.expr(feature.value)).over(frame)).cast("bigint")
    else:
        inside = _AGGREGATES[feature.how](F.expr(feature.value)).over(frame)
    return F.when(F.col(epoch).isNotNull(), inside)


def _sort_rank(feature: Feature) -> int:
    """Row windows first: spans reuse their longer sort. Finer partitions last: they sort anew."""
    if isinstance(feature, Span):
        return 1
    return 2 if isinstance(feature, History) and feature.within else 0


def _with_windows(df, entity, features, epoch, order):
    wide = df
    for rank in (0, 1, 2):
        columns = {f.name: _window_column(f, entity, epoch, order) for f in features if _sort_rank(f) == rank}
        wide = wide.withColumns(columns) if columns else wide
    return wide.select(*df.columns, *[f.name for f in features])


# --- cut entities ---------------------------------------------------------------------


def _with_cuts(df, entity, features, epoch, order, block_rows):
    row_features = [f for f in features if isinstance(f, Earlier | Rows)]
    histories = [f for f in features if isinstance(f, History)]
    spans = [f for f in features if isinstance(f, Span)]
    out = df
    if row_features or histories:
        reach = max([1] + [f.first for f in row_features if isinstance(f, Rows)])
        block_rows = max(block_rows, reach)
        # the order is cut into slots of many blocks, then each entity into blocks of its own
        out = positions(df, [epoch, *order], [entity], rows_per_slot=SLOT_BLOCKS * block_rows).withColumn(
            "_block", F.floor(F.col("_pos") / block_rows)
        )
        if row_features:
            out = _block_features(out, entity, row_features, reach, block_rows)
        for feature in histories:
            out = running(
                out,
                ["_pos"],
                {feature.name: (feature.how, F.expr(feature.value))},
                [entity, *feature.within],
                inclusive=False,
                slot="_block",
            )
    timed = df.filter(F.col(epoch).isNotNull())
    totals = [f for f in spans if f.how in ("count", "sum")]
    if totals:
        out = null_safe_join(out, _span_totals(timed, entity, totals, epoch), [entity, epoch], "left")
    for feature in spans:
        if feature.how == "min":
            out = null_safe_join(out, _span_min(timed, entity, feature, epoch), [entity, epoch], "left")
        elif feature.how == "distinct":
            out = null_safe_join(out, _span_distinct(timed, entity, feature, epoch), [entity, epoch], "left")
    return out.select(*df.columns, *[f.name for f in features])


def _block_features(df, entity, features, reach, block_rows):
    """Row features inside blocks, each led by the last rows of the block before it."""
    tail = df.filter(F.col("_pos") % block_rows >= block_rows - reach)
    led = df.withColumn("_lead", F.lit(False)).unionByName(
        tail.withColumn("_block", F.col("_block") + 1).withColumn("_lead", F.lit(True))
    )
    window = Window.partitionBy(entity, "_block").orderBy("_pos")
    columns = {}
    for feature in features:
        if isinstance(feature, Earlier):
            columns[feature.name] = F.lag(F.expr(feature.value)).over(window)
        else:
            frame = window.rowsBetween(-feature.first, -feature.last)
            columns[feature.name] = _AGGREGATES[feature.how](F.expr(feature.value)).over(frame)
    return led.withColumns(columns).filter(~F.col("_lead")).drop("_lead")


def _slices(df, epoch, width):
    """Each second in its own time slice and, as history, in the next one."""
    own = F.floor(F.col(epoch) / width)
    return df.withColumn("_own", own).withColumn("_slice", F.explode(F.array(own, own + 1)))


def _span_totals(df, entity, spans, epoch):
    """Sums and counts over spans, per entity and second.

    A second's total enters a span at (second + end) and leaves it at (second + start + 1),
    so the span's value is the running sum of what entered minus what left. A group holds
    the seconds of two slices, at most 2 x width, however many rows fall into them.
    """
    width = max(f.start for f in spans) + 1
    per_second = df.groupBy(entity, epoch).agg(
        *[F.count(F.expr(f.value)).alias(f"_n{i}") for i, f in enumerate(spans)],
        *[F.sum(F.expr(f.value)).alias(f"_s{i}") for i, f in enumerate(spans) if f.how == "sum"],
    )
    tracked = [f"_n{i}" for i in range(len(spans))] + [f"_s{i}" for i, f in enumerate(spans) if f.how == "sum"]
    types = dict(per_second.dtypes)

    def change(at, name, sign):
        # an entry of one tracked total; every other total is unchanged at that moment
        values = [
            (F.col(c) * F.lit(sign) if c == name else F.lit(None)).cast(_sum_type(types[c])).alias(c) for c in tracked
        ]
        return F.struct(at.cast("bigint").alias("_at"), F.lit(False).alias("_ask"), *values)

    second = F.col(epoch)
    moves = [
        F.struct(
            second.cast("bigint").alias("_at"),
            (F.col("_own") == F.col("_slice")).alias("_ask"),
            *[F.lit(None).cast(_sum_type(types[c])).alias(c) for c in tracked],
        )
    ]
    for i, f in enumerate(spans):
        for name in [f"_n{i}"] + ([f"_s{i}"] if f.how == "sum" else []):
            moves += [change(second + f.end, name, 1), change(second + f.start + 1, name, -1)]
    timeline = (
        _slices(per_second, epoch, width)
        .select(entity, "_slice", F.inline(F.array(*moves)))
        .groupBy(entity, "_slice", "_at")
        .agg(F.max("_ask").alias("_ask"), *[F.sum(c).alias(c) for c in tracked])
    )
    so_far = (
        Window.partitionBy(entity, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    levels = timeline.withColumns({c: F.sum(c).over(so_far) for c in tracked}).filter("_ask")
    results = []
    for i, f in enumerate(spans):
        counted = F.coalesce(F.col(f"_n{i}"), F.lit(0))
        if f.how == "count":
            results.append(counted.cast("bigint").alias(f.name))
        else:
            results.append(F.when(counted > 0, F.col(f"_s{i}").cast(types[f"_s{i}"])).alias(f.name))
    return levels.select(entity, F.col("_at").alias(epoch), *results)


def _sum_type(type_name: str) -> str:
    return "decimal(38,2)" if type_name.startswith("decimal") else type_name


def _span_min(df, entity, feature, epoch):
    """Minimum over (second - start .. second), per entity and second.

    With blocks one span long, the span is a tail of the block before and a head of the
    current block: two running minima, one from each end.
    """
    if feature.end != 0:
        raise ValueError("a minimum span ends at the current second")
    length = feature.start + 1
    per_second = (
        df.groupBy(entity, epoch)
        .agg(F.min(F.expr(feature.value)).alias("_v"))
        .withColumn("_block", F.floor(F.col(epoch) / length))
    )
    heads = per_second.select(
        entity,
        F.col(epoch).alias("_for"),
        F.min("_v")
        .over(
            Window.partitionBy(entity, "_block")
            .orderBy(epoch)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        .alias("_v"),
    )
    second = F.col(epoch)
    points = per_second.select(
        entity,
        F.inline(
            F.array(
                F.struct(
                    F.col("_block").alias("_block"),
                    second.alias("_at"),
                    F.col("_v").alias("_v"),
                    F.lit(None).cast("bigint").alias("_for"),
                ),
                F.struct(
                    (F.col("_block") - 1).alias("_block"),
                    (second - feature.start).alias("_at"),
                    F.lit(None).cast(dict(per_second.dtypes)["_v"]).alias("_v"),
                    second.cast("bigint").alias("_for"),
                ),
            )
        ),
    )
    from_end = (
        Window.partitionBy(entity, "_block")
        .orderBy(F.desc("_at"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    tails = points.withColumn("_v", F.min("_v").over(from_end)).filter(F.col("_for").isNotNull())
    return (
        heads.unionByName(tails.select(entity, "_for", "_v"))
        .groupBy(entity, F.col("_for").alias(epoch))
        .agg(F.min("_v").alias(feature.name))
    )


def _span_distinct(df, entity, feature, epoch):
    """Number of distinct values over (second - start .. second), per entity and second.

    A value counts from its second until it is seen again or the span has passed.
    """
    if feature.end != 0:
        raise ValueError("a distinct span ends at the current second")
    width = feature.start + 1
    seen = _slices(df.select(entity, epoch, F.expr(feature.value).alias("_x")).distinct(), epoch, width)
    again = F.lead(epoch).over(Window.partitionBy(entity, "_slice", "_x").orderBy(epoch))
    counts = F.when(F.col("_x").isNotNull(), 1).otherwise(0)
    timeline = (
        seen.withColumn("_until", F.least(again, F.col(epoch) + width))
        .select(
            entity,
            "_slice",
            F.inline(
                F.array(
                    F.struct(
                        F.col(epoch).alias("_at"), (F.col("_own") == F.col("_slice")).alias("_ask"), counts.alias("_d")
                    ),
                    F.struct(F.col("_until").alias("_at"), F.lit(False).alias("_ask"), (-counts).alias("_d")),
                )
            ),
        )
        .groupBy(entity, "_slice", "_at")
        .agg(F.max("_ask").alias("_ask"), F.sum("_d").alias("_d"))
    )
    so_far = (
        Window.partitionBy(entity, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        timeline.withColumn(feature.name, F.sum("_d").over(so_far))
        .filter("_ask")
        .select(entity, F.col("_at").alias(epoch), feature.name)
    )
