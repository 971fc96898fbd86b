"""Fraud classification with a focal objective and multi-horizon expense forecasting.

Trees of the classifier grow on rows that are binned once (`operators/trees.py`) and become
Spark ML trees; the driver only loops over rounds. Any number of trees scores as one ensemble
expression. Every few rounds the binned rows with their score so far are checkpointed, so
lineage stays short, an executor loss repeats little work, and the scratch folder never holds
more than three copies.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel, Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import sigmoid
from ledgerloom.operators import encoding, evaluate, trees
from ledgerloom.plans import monthly
from ledgerloom.session import batch_rows, discard, keep_checkpoints, ship, stage, stage_at

# fixed values: the model's features, the columns filled with 0, and the encoded columns
FRAUD_FEATURES = (
    "amount abs_amount log_amount is_expense amount_to_limit_ratio amount_zscore client_avg_amount_last50 "
    "client_std_amount_last50 amount_vs_client_max above_client_p90 txn_hour txn_day_of_week txn_month txn_year "
    "is_weekend has_bad_cvv has_bad_expiration has_bad_card_number has_bad_pin has_insufficient_balance "
    "has_technical_glitch has_any_error card_errors_7d is_online is_out_of_home_state seconds_since_last_txn "
    "card_txn_count_1h card_txn_count_24h card_txn_count_7d card_amount_sum_24h gap_zscore card_mcc_freq "
    "card_merchant_freq card_distinct_mcc_7d client_distinct_cards_24h is_new_merchant is_new_mcc rapid_succession "
    "online_new_merchant online_high_amount oos_new_merchant error_online credit_limit card_has_chip card_age_months "
    "current_age credit_score total_debt yearly_income debt_to_income_ratio use_chip card_brand card_type mcc_te "
    "merchant_id_te"
).split()
CATEGORICAL = ("use_chip", "card_brand", "card_type")
FILL_ZERO = (
    "seconds_since_last_txn card_txn_count_1h card_txn_count_24h card_txn_count_7d card_amount_sum_24h card_mcc_freq "
    "card_merchant_freq amount_zscore card_errors_7d client_distinct_cards_24h client_avg_amount_last50 "
    "client_std_amount_last50 amount_vs_client_max above_client_p90 gap_zscore card_age_months"
).split()
ENCODED = ("mcc", "merchant_id")
SERVING_THRESHOLD = 0.35
MISSING = -1.0
# rows of a block of binned rows, and of one task
BLOCK_ROWS = 20_000
LEAST_ROWS, MOST_ROWS = 40_000, 2_000_000


def prepare_features(df: DataFrame) -> DataFrame:
    """Chip flag to 0/1 and the named columns filled with 0 (those that are present)."""
    if "card_has_chip" in df.columns:
        df = df.withColumn("card_has_chip", F.col("card_has_chip").cast("int"))
    return df.fillna(0, [c for c in FILL_ZERO if c in df.columns])


def numeric_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Columns a forecast model may use when no list is given: numeric or boolean, minus the excluded."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [name for name, kind in df.dtypes if kind in kinds and name not in exclude]


def with_encodings(rows: DataFrame, train: DataFrame, order: Sequence[str], out_of_fold: bool) -> DataFrame:
    """Encoded columns, out of fold for training rows or from all of ``train`` for others."""
    if out_of_fold:
        return encoding.encode_out_of_fold(rows, ENCODED, "label", order)
    for column in ENCODED:
        rows = encoding.apply_encoding(rows, train, column, "label")
    return rows


def padded(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features in order; one that the table lacks becomes 0, other columns stay in front."""
    others = [c for c in df.columns if c not in features]
    return df.select(
        *others,
        *[
            F.col(f) if f in df.columns else F.lit("0" if f in CATEGORICAL else 0).alias(f)
            for f in features
        ],
    )


# --- requests -----------------------------------------------------------------------------


def request_features(requests: DataFrame) -> DataFrame:
    """Model inputs that a scoring request implies."""
    amount = F.col("amount").try_cast("double")

    def number(name: str, kind: str = "int"):
        return F.coalesce(F.col(name).try_cast(kind), F.lit(0).cast(kind)).alias(name)

    return requests.select(
        "transaction_id",
        amount.alias("amount"),
        F.abs(amount).alias("abs_amount"),
        F.log(F.abs(amount) + 1).alias("log_amount"),
        (amount < 0).cast("int").alias("is_expense"),
        *[number(c) for c in ("is_online", "has_bad_cvv", "has_any_error", "txn_hour")],
        number("credit_limit", "double"),
        *[number(c) for c in ("credit_score", "card_txn_count_24h")],
        number("seconds_since_last_txn", "double"),
        "use_chip",
        *[number(c, "bigint") for c in ENCODED],
    )


# --- focal boosting -----------------------------------------------------------------------


def assembler(features: Sequence[str]) -> Pipeline:
    """Feature vector with indexed categories; other missing values become -1."""
    indexers = [
        StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in CATEGORICAL if c in features
    ]
    inputs = [f"{c}_index" if c in CATEGORICAL else c for c in features]
    return Pipeline(stages=[*indexers, VectorAssembler(inputCols=inputs, outputCol="features")])


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features if c not in CATEGORICAL}
    texts = {c: F.coalesce(F.col(c), F.lit("none")) for c in features if c in CATEGORICAL}
    return df.withColumns({**numbers, **texts})


@dataclass
class FocalModel:
    """Boosted regression trees on the log-odds scale."""

    inputs: PipelineModel
    features: list[str]
    rate: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def raw(self, df: DataFrame) -> DataFrame:
        """Add the raw score; without trees it is 0."""
        scored = self.inputs.transform(filled(df, self.features)).withColumn("raw", F.lit(0.0))
        scored = add_trees(scored, self.trees, self.rate)
        return scored.drop("features", *[f"{c}_index" for c in CATEGORICAL if c in self.features])

    def score(self, df: DataFrame, threshold: float = SERVING_THRESHOLD) -> DataFrame:
        scored = self.raw(df).withColumn("probability", sigmoid(F.col("raw")))
        return scored.withColumns(
            {"predicted": (F.col("probability") >= threshold).cast("int"), "threshold": F.lit(threshold)}
        )

    def importance(self) -> list[tuple[str, int]]:
        """Number of splits per feature over all trees, highest first."""
        # every split is printed once as "If (feature 12 ..." and once as "Else (..."
        splits = Counter(int(n) for tree in self.trees for n in re.findall(r"If \(feature (\d+) ", tree.toDebugString))
        return sorted(((name, splits[i]) for i, name in enumerate(self.features)), key=lambda p: (-p[1], p[0]))


def ensemble(trees: Sequence[DecisionTreeRegressionModel], rate: float) -> GBTRegressionModel:
    """The trees, each weighted by the rate, as one Spark model."""
    context = SparkSession.active().sparkContext
    regression = context._jvm.org.apache.spark.ml.regression
    each = context._gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    weights = context._gateway.new_array(context._jvm.double, len(trees))
    for i, tree in enumerate(trees):
        each[i], weights[i] = tree._java_obj, rate
    return GBTRegressionModel(regression.GBTRegressionModel(f"focal_{uuid.uuid4().hex}", each, weights))


def add_trees(df: DataFrame, trees: Sequence[DecisionTreeRegressionModel], rate: float) -> DataFrame:
    """``raw`` plus what the trees say, as one expression however many there are."""
    if not trees:
        return df
    step = ensemble(trees, rate).transform(df)
    return step.withColumn("raw", F.col("raw") + F.col("prediction")).drop("prediction")


def _focal_terms(label: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian as in `evaluate.focal_terms`, for blocks of rows."""
    p = 1 / (1 + np.exp(-raw))
    pt = np.where(label == 1, p, 1 - p)
    weight = evaluate.FOCAL_ALPHA * (1 - pt) ** evaluate.FOCAL_GAMMA
    return weight * (p - label), np.maximum(weight * p * (1 - p), 1e-7)


def _focal_losses(label: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The loss of each row, whose mean is `evaluate.focal_loss`."""
    p = 1 / (1 + np.exp(-raw))
    pt = np.where(label == 1, p, 1 - p)
    return -evaluate.FOCAL_ALPHA * (1 - pt) ** evaluate.FOCAL_GAMMA * np.log(pt + 1e-8)


def fit_focal(
    rows: DataFrame,
    features: Sequence[str] = FRAUD_FEATURES,
    rounds: int = 1000,
    rate: float = 0.05,
    depth: int = 6,
    leaf_rows: int = 300,
    patience: int = 100,
    stage_every: int = 25,
) -> FocalModel:
    """Newton boosting on the focal gradient.

    ``rows`` hold the features, ``label`` and ``split`` (train or val). A tree is grown on
    gradient and hessian, so a leaf's answer is the Newton step. Rows are binned once and stay
    in the executors with their score; a round is one pass per level, and the first of them
    also gives the validation loss of the round before. Stops when that focal loss has not
    improved for ``patience`` rounds and keeps the trees of the best round. Without validation
    rows all rounds run and are kept.
    """
    features, spark = list(features), rows.sparkSession
    ready = filled(rows, features)
    inputs = assembler(features).fit(ready.filter("split = 'train'"))
    cut = trees.binning(ready.filter("split = 'train'"), inputs)
    ship(spark)
    keep_checkpoints(spark)
    known = ready.filter("split IN ('train', 'val')").withColumn("learnt", F.col("split") == "train")
    with batch_rows(spark, BLOCK_ROWS):
        staged, place = stage_at(trees.binned(known, inputs, cut), "boost")
    many, parallel = staged.agg(F.sum("n")).first()[0], spark.sparkContext.defaultParallelism
    # a task has some rows at least, since every task sends its sums, and a bounded number at most
    tasks = max(1, min(parallel, many // LEAST_ROWS)) * max(1, -(-many // (parallel * MOST_ROWS)))
    at = trees.blocks(staged, tasks).persist(StorageLevel.MEMORY_AND_DISK)
    model, grown, kept = FocalModel(inputs, features, rate), [], None
    root, _, _ = trees.first_sums(at, cut, _focal_terms, _focal_losses)
    best, best_round = float("inf"), 0
    for n in range(1, rounds + 1):
        grown.append(trees.grow(at, root, cut, _focal_terms, depth, leaf_rows))
        before, at = at, trees.add_tree(at, grown[-1], rate).persist(StorageLevel.MEMORY_AND_DISK)
        if n % stage_every == 0:
            at.checkpoint()
        root, lost, held = trees.first_sums(at, cut, _focal_terms, _focal_losses)
        before.unpersist()
        if n % stage_every == 0:
            _drop(spark, kept)
            kept = at.getCheckpointFile()
        if not held:
            best_round = n
            continue
        model.losses.append(lost / held)
        if model.losses[-1] < best:
            best, best_round = model.losses[-1], n
        elif n - best_round >= patience:
            break
    at.unpersist()
    _drop(spark, kept)
    discard(spark, place)
    model.trees = [trees.spark_tree(spark, tree, cut) for tree in grown[:best_round]]
    return model


def _drop(spark: SparkSession, path: str | None) -> None:
    if path:
        discard(spark, path)


def training_rows(mart: DataFrame, labels: DataFrame, order: Sequence[str], strict: bool = False) -> DataFrame:
    """Labelled mart rows with encodings, filled features and an 85/15 split in time.

    As described by default, encodings see the validation rows; ``strict`` learns them on
    the training part only.
    """
    labelled = stage(mart.join(labels.withColumnRenamed("is_fraud", "label"), "transaction_id"), "labelled")
    parts = encoding.temporal_split(labelled, order)
    if strict:
        parts = stage(parts, "parts")
        train = parts.filter("split = 'train'")
        rows = with_encodings(train, train, order, True).unionByName(
            with_encodings(parts.filter("split = 'val'"), train, order, False)
        )
    else:
        rows = with_encodings(parts, labelled, order, True)
    return prepare_features(rows)


def ablation(
    rows: DataFrame, base: Sequence[str], candidates: Sequence[str], **fit_options
) -> DataFrame:
    """Average precision on the validation part with the base features and with one more at a time."""
    results = []
    for extra in (None, *candidates):
        used = [*base, extra] if extra else list(base)
        scored = fit_focal(rows, used, **fit_options).raw(rows.filter("split = 'val'"))
        value = evaluate.average_precision(scored.select("label", F.col("raw").alias("score"))).first()
        results.append((extra or "(base)", value.average_precision))
    return rows.sparkSession.createDataFrame(results, "feature string, average_precision double")


# --- expense forecasting ------------------------------------------------------------------

KEEP = ("client_id", "expense_month")
HELD = "held_back"
FITS_AT_ONCE = 8


def gbt(
    target: str, rounds: int = 500, rate: float = 0.03, depth: int = 6, leaf_rows: int = 30, least_gain: float = 0.0
) -> GBTRegressor:
    """Boosted trees that stop early: when a round does not lower the error of the rows held back by more than ``least_gain`` of it.

    Row sampling was switched on without a frequency, hence off.
    """
    return GBTRegressor(
        validationIndicatorCol=HELD,
        validationTol=least_gain,
        featuresCol="features",
        labelCol=target,
        maxIter=rounds,
        stepSize=rate,
        maxDepth=depth,
        minInstancesPerNode=leaf_rows,
        seed=42,
    )


def forecast_vectors(features: DataFrame, columns: Sequence[str] = monthly.FORECAST_COLUMNS) -> DataFrame:
    """Rows with a feature vector (missing values 0); the other columns stay."""
    numbers = features.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(numbers)


def held_back() -> Column:
    """Every fifth row, by a hash of client and month: it says when a fit stops and is not learnt from."""
    return (F.pmod(F.xxhash64(*KEEP), F.lit(5)) == 0).alias(HELD)


def _at_once(spark: SparkSession, work: Callable, items: Sequence) -> list:
    """Results of ``work`` for every item; the jobs of several fits share the cluster, since one fit is a chain of small jobs."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def fit_horizons(rows: DataFrame, learner: Callable[[str], Estimator] = gbt) -> dict:
    """One model per horizon on rows with ``features`` and the horizon's target, fitted side by side."""

    def fit(h: int):
        target = f"target_h{h}"
        return learner(target).fit(rows.filter(F.col(target).isNotNull()))

    return dict(zip(monthly.HORIZONS, _at_once(rows.sparkSession, fit, monthly.HORIZONS), strict=True))


def trained_rows(monthly_rows: DataFrame, users: DataFrame) -> DataFrame:
    """The forecast matrix with targets and vectors, staged: every fit and fold reads it."""
    features = monthly.forecast_features(monthly_rows, users)
    with_targets = monthly.add_targets(features).filter(F.col("lag_12").isNotNull())
    targets = [f"target_h{h}" for h in monthly.HORIZONS]
    return stage(forecast_vectors(with_targets).select(*KEEP, held_back(), "features", *targets), "forecast")


def forecast_batch(targets: DataFrame, latest: DataFrame, models: dict) -> DataFrame:
    """Forecast (client_id, month, horizon) rows from each client's latest features.

    The calendar month is the target's. A client without history gets a status row.
    """
    known = targets.join(latest, "client_id", "left").withColumn(
        "month_of_year", F.month(F.to_date(F.concat("month", F.lit("-01"))))
    )
    found = F.col("total_expenses").isNotNull()
    parts = [
        known.filter(~found | ~F.col("horizon").isin(list(models))).select(
            "client_id",
            "month",
            "horizon",
            F.lit(None).cast("double").alias("predicted_expense"),
            F.when(found, "no model for horizon").otherwise("client not found").alias("status"),
        )
    ]
    for h, model in models.items():
        rows = forecast_vectors(known.filter(found & (F.col("horizon") == h)))
        parts.append(
            model.transform(rows).select(
                "client_id",
                "month",
                "horizon",
                F.greatest(F.col("prediction"), F.lit(0.0)).alias("predicted_expense"),
                F.lit("ok").alias("status"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def walk_forward(
    rows: DataFrame,
    learner: Callable[[str], Estimator] = gbt,
    folds: int = 8,
    strict: bool = False,
    least_val: int = 10,
    least_train: int = 100,
) -> DataFrame:
    """MAE, RMSE and R2 per validation month and horizon.

    Trains on the months before the validation month; ``strict`` also requires the target
    month to lie before it. A fold with fewer rows than ``least_val`` or ``least_train`` gets a
    row without scores and the status ``too few rows``.
    """
    last = rows.agg(F.max("expense_month")).first()[0]
    if last is None:
        return _scores(rows.sparkSession, [])
    counts = monthly.fold_rows(
        rows.withColumn("lag_12", F.lit(0)), last, folds, strict
    ).collect()  # one row per fold and horizon

    def score(fold) -> tuple:
        if fold.n_val < least_val or fold.n_train < least_train:
            return str(fold.val_month), fold.horizon, fold.n_train, fold.n_val, "too few rows", None, None, None
        target = f"target_h{fold.horizon}"
        usable = rows.filter(F.col(target).isNotNull())
        ahead = fold.horizon if strict else 0
        train = usable.filter(F.add_months("expense_month", ahead) < F.lit(fold.val_month))
        validate = usable.filter(F.col("expense_month") == F.lit(fold.val_month))
        forecast = learner(target).fit(train).transform(validate)
        clipped = forecast.select(F.col(target).alias("actual"), F.greatest("prediction", F.lit(0.0)).alias("forecast"))
        s = evaluate.regression_scores(clipped, [], "actual", "forecast").first()
        return str(fold.val_month), fold.horizon, fold.n_train, s.n, "ok", s.mae, s.rmse, s.r2

    ordered = sorted(counts, key=lambda c: (c.val_month, c.horizon))
    return _scores(rows.sparkSession, _at_once(rows.sparkSession, score, ordered))


def _scores(spark, results) -> DataFrame:
    return spark.createDataFrame(
        results,
        "val_month string, horizon int, n_train bigint, n bigint, status string, mae double, rmse double, r2 double",
    )


def walk_forward_pooled(rows: DataFrame, learner: Callable[[str], Estimator] = gbt, months: int = 8) -> DataFrame:
    """One-step forecasts of the last distinct months, scored together."""
    last = [r[0] for r in rows.select("expense_month").distinct().orderBy(F.desc("expense_month")).limit(months).collect()]
    parts = []
    for month in sorted(last):
        usable = rows.filter(F.col("target_h1").isNotNull())
        validate = usable.filter(F.col("expense_month") == F.lit(month))
        if validate.isEmpty():
            continue
        model = learner("target_h1").fit(usable.filter(F.col("expense_month") < F.lit(month)))
        parts.append(model.transform(validate).select(F.col("target_h1").alias("actual"), F.col("prediction").alias("forecast")))
    return evaluate.regression_scores(reduce(DataFrame.unionByName, parts), [], "actual", "forecast")


def fold_means(scores: DataFrame) -> DataFrame:
    """Mean scores over the folds per horizon and overall."""
    means = [F.avg(c).alias(c) for c in ("r2", "mae", "rmse")]
    return scores.filter("status = 'ok'").rollup("horizon").agg(*means).withColumn("horizon", F.coalesce(F.col("horizon").cast("string"), F.lit("overall")))


def two_stage_forecast(rows: DataFrame, score_rows: DataFrame, target: str, learner: Callable[[str], Estimator] = gbt) -> DataFrame:
    """P(non-zero) times the expected amount of non-zero months."""
    known = rows.filter(F.col(target).isNotNull())
    chance = learner("_nonzero").fit(known.withColumn("_nonzero", (F.col(target) > 0).cast("double")))
    amount = learner(target).fit(known.filter(F.col(target) > 0))
    first = chance.transform(score_rows).withColumnRenamed("prediction", "_chance")
    both = amount.transform(first)
    bounded = F.least(F.greatest(F.col("_chance"), F.lit(0.0)), F.lit(1.0))
    return both.withColumn("forecast", F.greatest(bounded * F.col("prediction"), F.lit(0.0))).drop("_chance", "prediction")


def residual_forecast(rows: DataFrame, score_rows: DataFrame, target: str, base: str, learner: Callable[[str], Estimator] = gbt) -> DataFrame:
    """A baseline column plus a model of what it misses."""
    known = rows.filter(F.col(target).isNotNull() & F.col(base).isNotNull())
    model = learner("_missed").fit(known.withColumn("_missed", F.col(target) - F.col(base)))
    return model.transform(score_rows).withColumn(
        "forecast", F.greatest(F.coalesce(F.col(base), F.lit(0.0)) + F.col("prediction"), F.lit(0.0))
    ).drop("prediction")
