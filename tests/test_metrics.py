import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import encoding, evaluate, quality
from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.plans import explore


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    score = np.round(rng.random(400), 2)
    label = (rng.random(400) < score * 0.4).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "label": label, "score": score}))
    return df, label, score


def sweep_by_hand(label, score):
    out = []
    for t in np.arange(0.01, 0.99, 0.01):
        flagged = score >= t
        tp = (flagged & (label == 1)).sum()
        recall = tp / label.sum()
        specificity = (~flagged & (label == 0)).sum() / (label == 0).sum()
        out.append((t, tp, flagged.sum(), 2 * tp / (flagged.sum() + label.sum()), (recall + specificity) / 2))
    return np.array(out)


def test_sweep_and_best_thresholds(scored):
    df, label, score = scored
    sweep = evaluate.threshold_sweep(df)
    got = sweep.orderBy("threshold").toPandas()
    want = sweep_by_hand(label, score)
    columns = ["threshold", "true_positives", "flagged", "f1", "balanced_accuracy"]
    np.testing.assert_allclose(got[columns].to_numpy(float), want, rtol=1e-12)
    best = {r.metric: r.threshold for r in evaluate.best_thresholds(sweep).collect()}
    assert best["f1"] == pytest.approx(want[want[:, 3].argmax(), 0])
    assert best["balanced_accuracy"] == pytest.approx(want[want[:, 4].argmax(), 0])


@pytest.mark.parametrize("rows_per_slot", [10**6, 9])
def test_average_precision(scored, rows_per_slot):
    df, label, score = scored
    total, seen_recall = 0.0, 0.0
    for s in sorted(set(score), reverse=True):
        flagged = score >= s
        tp = label[flagged].sum()
        total += (tp / label.sum() - seen_recall) * tp / flagged.sum()
        seen_recall = tp / label.sum()
    got = evaluate.average_precision(df, rows_per_slot).first()
    assert got.average_precision == pytest.approx(total)
    assert (got.n_positive, got.n_rows) == (label.sum(), 400)


def test_confusion_adds_up(scored):
    df, _, _ = scored
    totals = evaluate.confusion(df, [0.2, 0.6]).groupBy("threshold").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in totals} == {400}


@pytest.mark.parametrize("rows_per_slot", [10**6, 11])
def test_quantiles_are_those_of_numpy(spark, rows_per_slot):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "v": np.round(rng.exponential(20, 300), 1)})
    qs = {"q1": 0.25, "mid": 0.5, "q9": 0.9}
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", qs, rows_per_slot).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, q in qs.items():
            assert got.loc[g, name] == pytest.approx(part["v"].quantile(q))


@pytest.mark.parametrize("rows_per_slot", [10**6, 13])
def test_out_of_fold_encoding(spark, rows_per_slot):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"i": range(103), "c": rng.integers(0, 8, 103), "y": rng.integers(0, 2, 103)})
    pdf.loc[50, "c"] = 99  # a value of one fold only
    got = encoding.encode_out_of_fold(spark.createDataFrame(pdf), ["c"], "y", ["i"], rows_per_slot)
    got = got.toPandas().sort_values("i").reset_index(drop=True)
    mean = pdf["y"].mean()
    start = 0
    for fold in range(5):
        size = 103 // 5 + (fold < 103 % 5)
        inside = pdf.index.isin(range(start, start + size))
        stats = pdf[~inside].groupby("c")["y"].agg(["sum", "count"])
        table = (stats["sum"] + 10 * mean) / (stats["count"] + 10)
        want = pdf.loc[inside, "c"].map(table).fillna(mean)
        np.testing.assert_allclose(got.loc[inside, "c_te"], want)
        start += size


def test_temporal_split_cut(spark):
    df = spark.range(101).select(((F.col("id") * 37) % 101).alias("t"))
    parts = encoding.temporal_split(df, ["t"], rows_per_slot=10).groupBy("split").agg(F.count("t").alias("n"), F.max("t").alias("last"))
    assert {r.split: (r.n, r.last) for r in parts.collect()} == {"train": (85, 84), "val": (16, 100)}


def test_keep_first_and_repeats(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "c"), (1, 1, "a"), (2, 9, "z")], "k int, o int, v string")
    assert sorted(tuple(r) for r in quality.keep_first(df, ["k"], ["o"]).collect()) == [(1, 1, "a"), (2, 9, "z")]
    got = quality.repeated_keys({"t": df}, {"t": ["k"]}).first()
    assert (got.n_keys, got.n_surplus) == (1, 2)


def test_null_counts(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {r.column_name: r.n_null for r in quality.null_counts(df).collect()} == {"a": 1, "b": 2}


def test_outliers_are_reported_not_removed(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(50)] + [(50, 1000.0)], "id int, v double")
    got = quality.outliers(df, "id", ["v"], rows_per_slot=4).collect()
    assert [(r.id, r.value) for r in got] == [(50, 1000.0)]


def test_request_rules(spark):
    good = dict(transaction_id="1", amount="-5", use_chip="x", mcc="1", merchant_id="2", is_online="1", txn_hour="23")
    bad = dict(good, transaction_id="2", is_online="2", txn_hour="24", amount="x", mcc=None)
    rows = [{name: r.get(name) for name in quality.REQUEST_FIELDS} for r in (good, bad)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in quality.REQUEST_FIELDS))
    got = {r.transaction_id: r.reasons for r in quality.checked_requests(df).collect()}
    assert got["1"] == []
    assert got["2"] == ["amount: not a number", "mcc: missing", "is_online: outside 0..1", "txn_hour: outside 0..23"]


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(101)], "g int, x double")
    got = explore.histogram(df, "g", F.col("x"), 10).groupBy("g").agg(F.sum("n").alias("n"), F.max("bin").alias("b"))
    assert {r.g: (r.n, r.b) for r in got.collect()} == {0: (51, 9), 1: (50, 9)}


def test_drift_of_equal_parts_is_zero(spark):
    df = spark.createDataFrame([(i % 2, float(i // 2)) for i in range(400)], "part int, x double")
    got = explore.psi_drift(df, F.col("part") == 1, "x", rows_per_slot=30).agg(F.sum("psi").alias("p"), F.count("bin").alias("n")).first()
    assert got.p == pytest.approx(0.0) and got.n == 10


@pytest.mark.parametrize("label", [0, 1])
def test_metrics_with_one_class_absent(spark, label):
    scored = spark.createDataFrame([(i / 10, label) for i in range(10)], "score double, label int")
    assert evaluate.average_precision(scored).first()["average_precision"] == pytest.approx(label)
    assert all(r["recall"] is not None for r in evaluate.pr_curve(scored).collect())
    sweep = evaluate.threshold_sweep(scored).orderBy("threshold").collect()
    flagged = {r["threshold"]: r["flagged"] for r in sweep}
    for r in sweep:
        share = flagged[r["threshold"]] / 10
        assert r["balanced_accuracy"] == pytest.approx(share if label else 1 - share)


def test_rates_without_fraud(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "b")], "is_fraud int, kind string")
    assert [r["multiplier"] for r in explore.rate_by(rows, F.col("kind"), "kind").collect()] == [None, None]
