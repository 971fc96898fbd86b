import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, trees
from ledgerloom.plans import models

FEATURES = ["a", "b", "use_chip"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [
        (float(rng.integers(0, 40)), float(rng.integers(0, 9)), ["x", "y", "z", None][rng.integers(0, 4)], "val" if i % 5 == 0 else "train")
        for i in range(3000)
    ]
    data = [(*r[:3], int(r[0] + 9 * (r[2] == "y") + 3 * r[1] + 20 * rng.random() > 55), r[3]) for r in data]
    return spark.createDataFrame(data, "a double, b double, use_chip string, label int, split string")


def test_a_tree_equals_the_one_of_spark(rows):
    """Values and categories are few, so both have the same bins."""
    fitted = models.fit_focal(rows, FEATURES, rounds=1, rate=1.0, depth=4, leaf_rows=20)
    ready = fitted.inputs.transform(models.filled(rows, FEATURES)).withColumn("raw", F.lit(0.0))
    terms = evaluate.focal_terms(F.col("label"), F.col("raw"))
    train = ready.filter("split = 'train'").withColumns({"hess": terms["hess"], "target": -terms["grad"] / terms["hess"]})
    learner = DecisionTreeRegressor(labelCol="target", weightCol="hess", maxDepth=4, maxBins=64, minInstancesPerNode=20)
    spark_tree = learner.fit(train)
    assert fitted.trees[0].numNodes == spark_tree.numNodes > 15
    both = spark_tree.transform(fitted.trees[0].transform(ready).withColumnRenamed("prediction", "own").drop("raw"))
    assert both.filter(F.abs(F.col("own") - F.col("prediction")) > 1e-9).isEmpty()


def test_losses_are_those_of_the_scored_rows(rows):
    fitted = models.fit_focal(rows, FEATURES, rounds=7, rate=0.3, depth=3, leaf_rows=20, stage_every=3)
    scored = fitted.raw(rows.filter("split = 'val'"))
    assert scored.agg(evaluate.focal_loss(F.col("label"), F.col("raw"))).first()[0] == pytest.approx(min(fitted.losses))


def test_a_round_is_one_job_per_level(spark, rows):
    context, jobs = spark.sparkContext, []
    for n in (2, 8):
        context.setJobGroup(f"rounds-{n}", "")
        models.fit_focal(rows, FEATURES, rounds=n, rate=0.3, depth=3, leaf_rows=20)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"rounds-{n}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1] - jobs[0] <= 6 * 3


def test_rows_in_many_blocks_give_the_same_tree(rows, monkeypatch):
    monkeypatch.setattr(models, "BLOCK_ROWS", 100)
    many = models.fit_focal(rows, FEATURES, rounds=2, rate=0.3, depth=3, leaf_rows=20)
    monkeypatch.setattr(models, "BLOCK_ROWS", 10_000)
    one = models.fit_focal(rows, FEATURES, rounds=2, rate=0.3, depth=3, leaf_rows=20)
    assert many.losses == pytest.approx(one.losses)


def test_edges_of_many_values_share_the_rows():
    values = np.arange(10_000.0)
    edges = trees._edges(values)
    assert len(edges) == trees.BINS - 1
    assert np.diff(np.searchsorted(edges, values)).max() == 1
    assert np.bincount(np.searchsorted(edges, values)).max() <= 10_000 / trees.BINS + 2
    assert trees._edges(np.array([1.0, 1.0, 4.0])).tolist() == [2.5]


def test_features_that_share_a_code_keep_their_bins():
    rng = np.random.default_rng(3)
    edges = [np.arange(63.0), np.array([0.5]), np.array([0.5]), np.zeros(0), np.array([1.0, 2.0])]
    cut = trees.Binning([*edges, np.zeros(0)], [0, 0, 0, 0, 0, 4])
    values = np.column_stack([rng.integers(0, 70, 500), *rng.integers(0, 2, (2, 500)), np.zeros(500), rng.integers(0, 4, (2, 500)).T])
    assert len(cut.bundles) == 2 and sorted(f for b in cut.bundles for f in b) == list(range(6))
    codes, weight = cut.codes(values.astype(float)), rng.random(500)
    sums = np.stack([np.bincount(c, weight, trees.CODES) for c in codes])[:, None]
    got = cut.apart(cut.parted(sums)[None])[0, 0]
    for f in range(6):
        bins = values[:, f].astype(int) if f == 5 else np.searchsorted(cut.edges[f], values[:, f], "left")
        assert got[f] == pytest.approx(np.bincount(bins, weight, trees.BINS))


def test_few_tasks_leave_no_shuffle_files_in_a_round(spark, rows):
    """Sums of a pass go to the driver, not through a shuffle whose files stay on disk."""
    at = spark.sparkContext.parallelize([(np.zeros((1, 5), np.uint8), np.ones(5, np.float32), np.zeros(5), 3)] * 8, 8)
    cut, tracker = trees.Binning([np.array([0.5])], [0]), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pass", "")
    root, lost, n = trees.first_sums(at, cut, lambda label, raw: (label, label), lambda label, raw: label)
    (job,) = tracker.getJobIdsForGroup("pass")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobInfo(job).stageIds) == 1
    assert root[:, 0, 0, 0].tolist() == [24, 24, 24] and (lost, n) == (16, 16)
