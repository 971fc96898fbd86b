"""Velocity features inside the stream: each arriving transaction with the counts of its card's last days.

Keyed state holds, per card, what happened in each second of the reach of the spans: rows,
amounts and errors, in time order. So a card with a large share of the rows keeps a bounded
number of seconds. Cards share keys, ``buckets`` of them by hash, and all cards of a bucket are
added and answered at once: a key costs some milliseconds, however few rows it has. A checkpoint
goes on with the number of buckets it was begun with. A batch is added first and answered then,
which gives the values of the mart wherever rows arrive in batches of time order: rows of one
batch may come in any order, and a second counts as a whole.

A row that arrives later than rows already answered gets the counts of all rows received so
far in its own spans, as long as they are kept (``REACH`` behind the card's newest row, and
``late`` more); answers already given are not given again. The newest second is always kept,
for the gap to the next row. A card without rows for ``idle`` is forgotten by a timer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructType

from ledgerloom.functions.scalars import epoch_seconds
from ledgerloom.operators.staging import stage_transactions

HOUR, DAY = 3600, 86400
REACH = 7 * DAY
IDLE = 7 * DAY
BUCKETS = 4096
TASKS_PER_CORE = 2
NO_CARD = -1  # the bucket of rows without a card

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
# arrays of 64-bit numbers: per card (ascending) its number of seconds and when it is forgotten; per second, by card and time, its totals
_STATE = "cards binary, n_seconds binary, due binary, seconds binary, totals binary"
_TOTALS = ("n", "priced", "cents", "errors")
_OWN = ["bucket", "card", "row_order", "priced", "cents"]
FEATURES = (
    "seconds_since_last_txn bigint, card_txn_count_1h bigint, card_txn_count_24h bigint, card_txn_count_7d bigint, "
    "card_amount_sum_24h double, card_errors_7d bigint, card_amount_sum_prior_24h double"
)


class _Kept(NamedTuple):
    """What is kept of the cards of a bucket."""

    cards: np.ndarray
    n_seconds: np.ndarray
    due: np.ndarray
    seconds: np.ndarray
    totals: np.ndarray

    @classmethod
    def read(cls, stored: Row | None) -> _Kept:
        arrays = [np.frombuffer(v, np.int64) for v in stored] if stored is not None else [np.zeros(0, np.int64)] * 5
        return cls(*arrays[:4], arrays[4].reshape(-1, len(_TOTALS)))

    def stored(self) -> tuple[bytes, ...]:
        return tuple(np.ascontiguousarray(v, np.int64).tobytes() for v in self)

    def of_seconds(self) -> np.ndarray:
        """Place of the card of each second."""
        return np.repeat(np.arange(len(self.cards)), self.n_seconds)

    def only(self, chosen: np.ndarray) -> _Kept:
        """The chosen cards."""
        inside = np.repeat(chosen, self.n_seconds)
        return _Kept(self.cards[chosen], self.n_seconds[chosen], self.due[chosen], self.seconds[inside], self.totals[inside])


def _added(kept: _Kept, rows: pd.DataFrame, due: int) -> tuple[_Kept, np.ndarray]:
    """What is kept after the rows of a batch, and the rows of each row's second that had come before."""
    card, at = rows["card"].to_numpy(np.int64), rows["txn_epoch"].to_numpy(np.int64)
    new = np.stack([np.ones(len(rows)), rows["priced"], rows["cents"], rows["has_any_error"]], axis=1).astype(np.int64)
    cards, place = np.unique(np.concatenate([kept.cards, card]), return_inverse=True)
    dues = np.zeros(len(cards), np.int64)
    dues[place[: len(kept.cards)]] = kept.due
    dues[place[len(kept.cards) :]] = due
    of = np.concatenate([place[: len(kept.cards)][kept.of_seconds()], place[len(kept.cards) :]])
    every = np.concatenate([kept.seconds, at])
    order = np.lexsort((every, of))
    of, every = of[order], every[order]
    begins = np.ones(len(every), bool)
    begins[1:] = (of[1:] != of[:-1]) | (every[1:] != every[:-1])
    second = np.empty(len(order), np.int64)
    second[order] = np.cumsum(begins) - 1
    totals = np.zeros((begins.sum(), len(_TOTALS)), np.int64)
    old, now = second[: len(kept.seconds)], second[len(kept.seconds) :]
    totals[old] = kept.totals
    earlier = totals[now, 0]
    np.add.at(totals, now, new)
    return _Kept(cards, np.bincount(of[begins], minlength=len(cards)), dues, every[begins], totals), earlier


def _answers(kept: _Kept, rows: pd.DataFrame, earlier: np.ndarray) -> pd.DataFrame:
    """Features of rows in time order within their card; `earlier`: rows of their seconds that had come before."""
    sums = np.concatenate([np.zeros((1, len(_TOTALS)), np.int64), np.cumsum(kept.totals, axis=0)])
    # card and second as one number; no span reaches from a card into the one before
    low = kept.seconds.min() - REACH
    width = kept.seconds.max() - low + 1
    keys = kept.of_seconds() * width + (kept.seconds - low)
    first_key = np.searchsorted(kept.cards, rows["card"].to_numpy(np.int64)) * width
    at = first_key + (rows["txn_epoch"].to_numpy(np.int64) - low)

    def within(first: int, last: int = 0) -> np.ndarray:
        return sums[np.searchsorted(keys, at - last, "right")] - sums[np.searchsorted(keys, at - first, "left")]

    hour, day, week, prior = within(HOUR), within(DAY), within(REACH), within(2 * DAY, DAY)
    previous = np.searchsorted(keys, at) - 1
    known = (previous >= 0) & (keys[previous] >= first_key)
    before = np.where(known, at - keys[previous], -1)
    nth = pd.Series(at).groupby(at).cumcount().to_numpy() + earlier
    gap = np.where(nth > 0, 0, before)
    own = np.where(rows["priced"], rows["cents"].to_numpy(np.float64), np.nan)
    return pd.DataFrame(
        {
            "seconds_since_last_txn": pd.array(gap, "Int64").copy(),
            "card_txn_count_1h": hour[:, 0] - 1,
            "card_txn_count_24h": day[:, 0] - 1,
            "card_txn_count_7d": week[:, 0] - 1,
            # cents are whole numbers, so the quotient is the double next to the exact sum
            "card_amount_sum_24h": (day[:, 2] - own) / 100,
            "card_errors_7d": week[:, 3],
            "card_amount_sum_prior_24h": np.where(prior[:, 1] > 0, prior[:, 2] / 100, np.nan),
        },
        index=rows.index,
    ).assign(seconds_since_last_txn=lambda d: d["seconds_since_last_txn"].mask(d["seconds_since_last_txn"] < 0))


def _recent(kept: _Kept, late: int) -> _Kept:
    """Without the seconds that lie further behind the newest one of their card."""
    newest = kept.seconds[np.cumsum(kept.n_seconds) - 1]
    of = kept.of_seconds()
    recent = kept.seconds >= newest[of] - REACH - late
    n_seconds = np.bincount(of[recent], minlength=len(kept.cards))
    return kept._replace(n_seconds=n_seconds, seconds=kept.seconds[recent], totals=kept.totals[recent])


class CardVelocity(StatefulProcessor):
    """State and answers of the cards of one bucket."""

    def __init__(self, columns: list[str], late: int, idle: int) -> None:
        self._columns, self._late, self._idle = columns, late, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = handle.getValueState("cards", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # a bucket's rows of one batch, which the source bounds
        batch = pd.concat(list(rows), ignore_index=True)
        timed = batch["txn_epoch"].notna()
        features = {f.split()[0]: None for f in FEATURES.split(", ")}
        if (~timed).any():
            yield batch[~timed].assign(**features)[self._columns]
        batch = batch[timed].sort_values(["card", "txn_epoch", "transaction_date", "row_order"], kind="stable")
        if not len(batch):
            return
        due = timerValues.getCurrentProcessingTimeInMs() + self._idle * 1000
        kept, earlier = _added(_Kept.read(self._kept.get()), batch, due)
        answers = _answers(kept, batch, earlier)
        yield batch.assign(**{c: answers[c] for c in answers})[self._columns]
        self._kept.update(_recent(kept, self._late).stored())
        self._handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = _Kept.read(self._kept.get())
        # later rows have moved the time when their cards are forgotten
        left = kept.only(kept.due > expiredTimerInfo.getExpiryTimeInMs())
        if len(left.cards):
            self._kept.update(left.stored())
        else:
            self._kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def velocity_stream(landed: DataFrame, late: int = REACH, idle: int = IDLE, buckets: int = BUCKETS) -> DataFrame:
    """Staged transactions of a stream of landed rows with the velocity features of their card."""
    rows = stage_transactions(landed).withColumns(
        {"txn_epoch": epoch_seconds("transaction_date"), "abs_amount": F.abs("amount").cast("double")}
    )
    cents = (F.abs("amount") * 100).cast("bigint")
    rows = rows.withColumns(
        {
            "bucket": F.when(F.col("card_id").isNull(), NO_CARD).otherwise(F.pmod(F.xxhash64("card_id"), F.lit(buckets)).cast("int")),
            "card": F.coalesce(F.col("card_id"), F.lit(0)),
            "row_order": F.col("transaction_id"),
            "priced": cents.isNotNull().cast("int"),
            "cents": F.coalesce(cents, F.lit(0)),
            "amount": F.col("amount").cast("double"),
        }
    )
    given = [f for f in rows.schema.fields if f.name not in _OWN]
    # whole numbers next to a null would reach the processor as doubles; it does not look at these
    passed = [f.name for f in given if isinstance(f.dataType, LongType) and f.name != "txn_epoch"]
    rows = rows.withColumns({c: F.col(c).cast("string") for c in passed})
    kept = StructType([f for f in rows.schema.fields if f.name not in _OWN])
    schema = StructType([*kept.fields, *StructType.fromDDL(FEATURES).fields])
    answered = rows.groupBy("bucket").transformWithStateInPandas(CardVelocity(schema.names, late, idle), schema, "append", "ProcessingTime")
    return answered.withColumns({c: F.col(c).cast("bigint") for c in passed})


def start_velocity(
    landed: DataFrame,
    output: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame] | None = None,
    late: int = REACH,
    idle: int = IDLE,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Answer every landed row of a stream, by `score` if given; each batch replaces its own output."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (score(batch) if score else batch).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    with _settings(landed.sparkSession):
        return (
            velocity_stream(landed, late, idle, buckets)
            .writeStream.foreachBatch(write)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Settings a query takes over when it starts: the store that timers need, no batches without rows, and no more
    partitions of the state than keep the cores busy, since each costs a store and a Python process in every batch.

    With processing time Spark would go on with empty batches for ever; timers that are due fire in the next batch.
    """
    partitions = "spark.sql.shuffle.partitions"
    most = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    settings = {**_SETTINGS, partitions: str(min(int(spark.conf.get(partitions)), most))}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
