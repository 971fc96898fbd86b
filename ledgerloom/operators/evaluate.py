"""Metrics of scored rows: ``label`` is 0/1, ``score`` a probability.

Rows are first counted per distinct score (or per threshold bucket), so later steps work
on counts; cumulative counts over many distinct scores run over slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import ROWS_PER_SLOT, place, running

# fixed values: focal loss focusing and balance, and the 98 swept thresholds
FOCAL_GAMMA = 2.0
FOCAL_ALPHA = 0.25
THRESHOLDS = 98
STEP = 0.01
# operating points reported from the precision-recall curve
OPERATING_POINTS = {"BA-optimal": 0.08, "F1-optimal": 0.37}


def _cumulative(scored: DataFrame, rows_per_slot: int) -> DataFrame:
    """Per distinct score: positives and negatives at or above it, and those at it."""
    counts = scored.groupBy("score").agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    falling = F.desc("score")
    ranked = running(
        place(counts, [falling], rows_per_slot),
        [falling],
        {"tp": ("sum", F.col("pos")), "flagged": ("sum", F.col("n"))},
        totals=True,
    )
    return ranked.withColumnRenamed("tp_total", "total_pos").drop("flagged_total")


def average_precision(scored: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Sum of precision weighted by the recall gained at each distinct score (no interpolation)."""
    # without positives nothing is gained
    gained = F.coalesce(F.try_divide("pos", "total_pos"), F.lit(0.0)) * (F.col("tp") / F.col("flagged"))
    return _cumulative(scored, rows_per_slot).agg(
        F.sum(gained).alias("average_precision"),
        F.max("total_pos").alias("n_positive"),
        F.max("flagged").alias("n_rows"),
    )


def pr_curve(scored: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    return _cumulative(scored, rows_per_slot).select(
        F.col("score").alias("threshold"),
        (F.col("tp") / F.col("flagged")).alias("precision"),
        F.coalesce(F.try_divide("tp", "total_pos"), F.lit(0.0)).alias("recall"),
    )


def operating_points(scored: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """The curve's point nearest to each operating threshold, the lower one on a tie."""
    nearest = [
        F.min_by(
            F.struct(F.lit(name).alias("point"), F.lit(t).alias("target"), "threshold", "precision", "recall"),
            F.struct(F.abs(F.col("threshold") - t), F.col("threshold")),
        ).alias(f"p{i}")
        for i, (name, t) in enumerate(OPERATING_POINTS.items())
    ]
    points = pr_curve(scored, rows_per_slot).agg(*nearest)
    return points.select(F.inline(F.array(*[f"p{i}" for i in range(len(OPERATING_POINTS))])))


def _threshold(index: Column) -> Column:
    return F.lit(STEP) + (index - 1) * F.lit(STEP)


def _passed(score: Column) -> Column:
    """How many of the swept thresholds the score reaches.

    The integer part of score * 100 can be off by one against the stepped thresholds, so
    it is corrected by comparing with the thresholds themselves.
    """
    guess = F.greatest(F.lit(0), F.least(F.lit(THRESHOLDS), F.floor(score * 100).cast("int")))
    up = (guess < THRESHOLDS) & (score >= _threshold(guess + 1))
    down = (guess > 0) & (score < _threshold(guess))
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1, balanced accuracy and rows flagged at every swept threshold."""
    counts = (
        scored.groupBy(_passed(F.col("score")).alias("passed"))
        .agg(F.sum(F.col("label").cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    every = scored.sparkSession.range(0, THRESHOLDS + 1).select(
        F.col("id").cast("int").alias("passed"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("n")
    )
    buckets = counts.unionByName(every).groupBy("passed").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    # 99 rows: one bucket per number of thresholds passed
    above = Window.orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    swept = buckets.select(
        "passed",
        F.sum("pos").over(above).alias("tp"),
        F.sum("n").over(above).alias("flagged"),
        F.sum("pos").over(whole).alias("p"),
        F.sum("n").over(whole).alias("rows"),
    ).filter("passed > 0")
    tp, flagged, p = F.col("tp"), F.col("flagged"), F.col("p")
    negatives = F.col("rows") - p
    precision = F.when(flagged > 0, tp / flagged).otherwise(F.lit(0.0))
    recall = F.when(p > 0, tp / p).otherwise(F.lit(0.0))
    specificity = F.try_divide(negatives - (flagged - tp), negatives)
    # a class without rows has no recall of its own
    balanced = F.when(p == 0, specificity).when(negatives == 0, recall).otherwise((recall + specificity) / 2)
    return swept.select(
        _threshold(F.col("passed")).alias("threshold"),
        tp.alias("true_positives"),
        flagged.alias("flagged"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(flagged + p > 0, 2 * tp / (flagged + p)).otherwise(F.lit(0.0)).alias("f1"),
        balanced.alias("balanced_accuracy"),
    )


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """The lowest threshold reaching the highest balanced accuracy, and the highest F1."""
    best = [
        F.max_by(
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), "threshold", "precision", "recall"),
            F.struct(F.col(m), -F.col("threshold")),
        ).alias(m)
        for m in ("balanced_accuracy", "f1")
    ]
    return sweep.agg(*best).select(F.inline(F.array("balanced_accuracy", "f1")))


def confusion(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Counts per threshold, label and prediction."""
    flags = F.array(
        *[F.struct(F.lit(t).alias("threshold"), (F.col("score") >= t).cast("int").alias("predicted")) for t in thresholds]
    )
    return (
        scored.select("label", F.inline(flags))
        .groupBy("threshold", "label", "predicted")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_report(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall, F1 and support of both classes at each threshold."""
    counts = confusion(scored, thresholds)

    def of(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    label, predicted = F.col("label"), F.col("predicted")
    rows = [
        F.struct(
            F.lit(c).alias("class"), F.col(f"hit{c}").alias("hit"), F.col(f"said{c}").alias("said"),
            F.col(f"real{c}").alias("real"),
        )
        for c in (0, 1)
    ]
    wide = counts.groupBy("threshold").agg(
        *[of((label == c) & (predicted == c)).alias(f"hit{c}") for c in (0, 1)],
        *[of(predicted == c).alias(f"said{c}") for c in (0, 1)],
        *[of(label == c).alias(f"real{c}") for c in (0, 1)],
    )
    hit, said, real = F.col("hit"), F.col("said"), F.col("real")
    return wide.select("threshold", F.inline(F.array(*rows))).select(
        "threshold",
        "class",
        F.when(said > 0, hit / said).otherwise(F.lit(0.0)).alias("precision"),
        F.when(real > 0, hit / real).otherwise(F.lit(0.0)).alias("recall"),
        F.when(said + real > 0, 2 * hit / (said + real)).otherwise(F.lit(0.0)).alias("f1"),
        real.alias("support"),
    )


def focal_terms(label: Column, raw: Column) -> dict[str, Column]:
    """Probability, focal weight, gradient and hessian of a raw score."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))
    pt = F.when(label == 1, p).otherwise(1 - p)
    weight = F.lit(FOCAL_ALPHA) * F.pow(1 - pt, F.lit(FOCAL_GAMMA))
    return {
        "probability": p,
        "focal_weight": weight,
        "grad": weight * (p - label),
        "hess": F.greatest(weight * p * (1 - p), F.lit(1e-7)),
    }


def focal_loss(label: Column, raw: Column) -> Column:
    """Mean focal loss, as an aggregate."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))
    pt = F.when(label == 1, p).otherwise(1 - p)
    return F.avg(-F.lit(FOCAL_ALPHA) * F.pow(1 - pt, F.lit(FOCAL_GAMMA)) * F.log(pt + F.lit(1e-8)))


def regression_scores(rows: DataFrame, groups: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R2 per group, from one aggregate."""
    error = F.col(predicted) - F.col(actual)
    squares = F.sum(error * error)
    spread = F.var_pop(actual) * F.count(actual)
    return (
        rows.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.when(spread > 0, 1 - squares / spread).alias("r2"),
        )
    )
