import math

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate
from ledgerloom.plans import models, monthly
from ledgerloom.sources import artifacts

FEATURES = ["a", "b", "use_chip"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    a, b = rng.random(600), rng.random(600)
    label = (a + 0.3 * rng.random(600) > 0.85).astype(int)
    data = [
        (i, float(a[i]), None if i % 9 == 0 else float(b[i]), ["x", "y", None][i % 3], int(label[i]), "val" if i >= 450 else "train")
        for i in range(600)
    ]
    return spark.createDataFrame(data, "id int, a double, b double, use_chip string, label int, split string")


@pytest.fixture(scope="module")
def model(rows):
    return models.fit_focal(rows, FEATURES, rounds=8, rate=0.5, depth=3, leaf_rows=10, patience=3, stage_every=3)


def test_focal_terms_at_a_known_point(spark):
    got = spark.range(1).select(*[c.alias(n) for n, c in evaluate.focal_terms(F.lit(1), F.lit(0.0)).items()]).first()
    assert (got.probability, got.focal_weight, got.grad, got.hess) == (0.5, 0.0625, -0.03125, 0.015625)


def test_boosting_lowers_the_focal_loss(model, rows):
    assert min(model.losses) < model.losses[0]
    assert len(model.trees) == model.losses.index(min(model.losses)) + 1
    assert model.importance()[0][0] == "a"
    scored = model.raw(rows.filter("split = 'val'")).select("label", F.col("raw").alias("score"))
    assert evaluate.average_precision(scored).first().average_precision > 0.8


def test_ensemble_equals_the_sum_of_its_trees(model, rows):
    inputs = model.inputs.transform(models.filled(rows, FEATURES))
    want = dict.fromkeys(range(600), 0.0)
    for tree in model.trees:
        for r in tree.transform(inputs).collect():
            want[r.id] += model.rate * r.prediction
    assert {r.id: r.raw for r in model.raw(rows).collect()} == pytest.approx(want)
    assert sum(n for _, n in model.importance()) == sum((t.numNodes - 1) // 2 for t in model.trees)


def test_training_keeps_one_copy_and_needs_no_validation_rows(spark, rows):
    from pathlib import Path

    from ledgerloom.session import scratch_dir

    copies = set(Path(scratch_dir(spark)).glob("boost-*"))
    fitted = models.fit_focal(rows.filter("split = 'train'"), FEATURES, rounds=3, depth=2, leaf_rows=10, stage_every=2)
    assert len(fitted.trees) == 3 and fitted.losses == []
    assert set(Path(scratch_dir(spark)).glob("boost-*")) == copies


def test_saved_model_scores_alike(spark, model, rows, folder):
    artifacts.save_fraud_model(model, spark, folder)
    loaded = artifacts.load_fraud_model(spark, folder)
    want = {r.id: r.probability for r in model.score(rows).collect()}
    assert {r.id: r.probability for r in loaded.score(rows).collect()} == pytest.approx(want)
    status = {r.artifact: r.is_loaded for r in artifacts.artifact_status(spark, folder).collect()}
    assert status["fraud_model"] and not status["forecast_h1"]
    assert artifacts.load_forecast_models(spark, folder) == {}


def test_ablation_reports_each_candidate(rows):
    options = dict(rounds=2, rate=0.5, depth=2, leaf_rows=10, patience=2)
    got = {r.feature: r.average_precision for r in models.ablation(rows, ["b"], ["a"], **options).collect()}
    assert got["a"] > got["(base)"]


def test_padding_orders_features_and_fills_zero(spark):
    df = spark.createDataFrame([("t", 2.0)], "transaction_id string, b double")
    out = models.padded(df, ["use_chip", "b", "c"])
    assert out.columns == ["transaction_id", "use_chip", "b", "c"]
    assert tuple(out.first()) == ("t", "0", 2.0, 0)


def test_request_features(spark):
    names = ["transaction_id", "amount", "use_chip", "mcc", "merchant_id", "is_online", "has_bad_cvv", "has_any_error",
             "txn_hour", "credit_limit", "credit_score", "card_txn_count_24h", "seconds_since_last_txn"]
    df = spark.createDataFrame([("1", "-20", "c", "5", "6", "1", None, None, "3", None, None, None, None)], ", ".join(f"{n} string" for n in names))
    got = models.request_features(df).first()
    assert (got.abs_amount, got.is_expense, got.has_bad_cvv, got.seconds_since_last_txn) == (20.0, 1, 0, 0.0)
    assert got.log_amount == pytest.approx(math.log(21))


def small_tree(target):
    return DecisionTreeRegressor(featuresCol="features", labelCol=target, maxDepth=2, seed=1)


def test_forecast_batch_answers_every_target(spark, tables):
    rows = models.trained_rows(tables.monthly, tables.users)
    fitted = models.fit_horizons(rows, small_tree)
    targets = spark.createDataFrame([(1, "2001-09", 1), (1, "2001-10", 2), (10**9, "2001-09", 1)], "client_id bigint, month string, horizon int")
    got = {(r.client_id, r.horizon): r for r in models.forecast_batch(targets, monthly.latest_features(tables.forecast_features), fitted).collect()}
    assert got[(1, 1)].status == "ok" and got[(1, 2)].predicted_expense >= 0
    assert got[(10**9, 1)].status == "client not found" and got[(10**9, 1)].predicted_expense is None


def test_walk_forward_skips_small_folds(spark):
    from datetime import date

    from pyspark.ml.linalg import Vectors

    def rows(clients):
        return spark.createDataFrame(
            [(c, date(2020 + m // 12, 1 + m % 12, 1), Vectors.dense([float(m)]), *([float(c + m + h) if m + h < 24 else None for h in (1, 2, 3)])) for c in range(clients) for m in range(24)],
            ["client_id", "expense_month", "features", "target_h1", "target_h2", "target_h3"],
        )

    few = models.walk_forward(rows(3), small_tree, folds=2)
    assert [(r.status, r.n, r.r2) for r in few.collect()] == [("too few rows", 3, None)] * 6
    assert models.walk_forward(rows(3), small_tree, folds=2, least_val=3, least_train=30).filter("status = 'ok'").count() == 6
    scores = models.walk_forward(rows(12), small_tree, folds=2)
    assert scores.filter("status = 'ok'").count() == 6
    assert "overall" in [r.horizon for r in models.fold_means(scores).collect()]
    assert models.walk_forward_pooled(rows(12), small_tree, months=3).first().n == 24


def test_two_stage_and_residual_forecasts_are_not_negative(spark, tables):
    features = monthly.add_targets(tables.forecast_features).filter("lag_12 is not null")
    vectors = models.forecast_vectors(features)
    for got in (
        models.two_stage_forecast(vectors, vectors, "target_h1", small_tree),
        models.residual_forecast(vectors, vectors, "target_h1", "rmean_12", small_tree),
    ):
        assert got.filter("forecast < 0 or forecast is null").isEmpty()
