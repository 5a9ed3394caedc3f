"""Metrics and statistics against plain NumPy and pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.operators import metrics, statistics

RNG = np.random.default_rng(11)
N = 700
SCORES = np.round(RNG.random(N), 2)
LABELS = (RNG.random(N) < 0.2 + 0.5 * SCORES).astype(int)


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(i, int(y), float(s)) for i, (y, s) in enumerate(zip(LABELS, SCORES))],
                                 "primaryid long, serious int, score double").repartition(5)


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def brute_average_precision(y, s):
    total = 0.0
    for t in np.unique(s):
        hit = s >= t
        total += ((s == t) & (y == 1)).sum() * (y[hit].sum() / hit.sum())
    return total / y.sum()


def counts(t):
    hit = SCORES >= t
    return [int((hit & (LABELS == 1)).sum()), int((hit & (LABELS == 0)).sum()),
            int((~hit & (LABELS == 0)).sum()), int((~hit & (LABELS == 1)).sum())]


def test_ranking_metrics(scored):
    row = metrics.ranking_metrics(scored).first()
    assert row["auc_roc"] == pytest.approx(brute_auc(LABELS, SCORES), abs=1e-12)
    assert row["auc_pr"] == pytest.approx(brute_average_precision(LABELS, SCORES), abs=1e-12)


def test_ranking_metrics_by_group(scored):
    found = metrics.ranking_metrics(scored.withColumn("fold", F.col("primaryid") % 3), by="fold").collect()
    for row in found:
        mask = np.arange(N) % 3 == row["fold"]
        assert row["auc_roc"] == pytest.approx(brute_auc(LABELS[mask], SCORES[mask]), abs=1e-12)


def test_one_class_has_no_auc(spark):
    rows = spark.createDataFrame([(1, 0.2), (1, 0.8)], "serious int, score double")
    row = metrics.compute_metrics(rows).first()
    assert row["auc_roc"] is None and row["recall"] == 0.5 and row["specificity"] == 0.0
    assert metrics.confusion_metrics(rows).select("tp", "fp", "tn", "fn").first() == (1, 0, 0, 1)


def test_unlabelled_rows_do_not_count(spark, scored):
    more = scored.unionByName(spark.createDataFrame([(-1, None, 0.9)], scored.schema))
    assert metrics.compute_metrics(more).first() == metrics.compute_metrics(scored).first()


def test_confusion(scored):
    row = metrics.confusion_metrics(scored, threshold=0.37).first()
    tp, fp, tn, fn = counts(0.37)
    assert [row["tp"], row["fp"], row["tn"], row["fn"]] == [tp, fp, tn, fn]
    assert row["precision"] == tp / (tp + fp) and row["recall"] == tp / (tp + fn)
    assert row["f1"] == 2 * tp / (2 * tp + fp + fn) and row["specificity"] == tn / (tn + fp)


def test_threshold_grid_is_the_exact_one(scored):
    assert len(metrics.THRESHOLDS) == 80 and metrics.THRESHOLDS[40] == 0.4999999999999998
    found = {r["threshold"]: [r["tp"], r["fp"], r["fn"]] for r in metrics.threshold_sweep(scored).collect()}
    assert found == {t: [counts(t)[0], counts(t)[1], counts(t)[3]] for t in metrics.THRESHOLDS}


def test_scores_on_and_next_to_thresholds(spark):
    edges = [x for t in metrics.THRESHOLDS for x in (t, np.nextafter(t, 0), np.nextafter(t, 1))] + [0.0, 1.0, 0.5]
    rows = spark.createDataFrame([(1, float(x)) for x in edges], "serious int, score double")
    found = {r["threshold"]: r["tp"] for r in metrics.threshold_sweep(rows).collect()}
    assert found == {t: sum(x >= t for x in edges) for t in metrics.THRESHOLDS}


def test_best_threshold_takes_the_first_maximum(scored):
    f1 = [2 * a / (2 * a + b + d) for a, b, _, d in map(counts, metrics.THRESHOLDS)]
    row = metrics.best_threshold(scored).first()
    assert (row["threshold"], row["f1"]) == (metrics.THRESHOLDS[int(np.argmax(f1))], max(f1))


def test_class_report(scored):
    rows = {r["label"]: r for r in metrics.class_report(scored).collect()}
    tp, fp, tn, fn = counts(0.5)
    assert rows["Serious"]["support"] == tp + fn and rows["Non-Serious"]["support"] == tn + fp
    assert rows["accuracy"]["f1"] == pytest.approx((tp + tn) / N)
    assert rows["macro avg"]["recall"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
    assert rows["weighted avg"]["recall"] == pytest.approx((tp + tn) / N)


def test_log_loss_clips(spark, scored):
    p = np.clip(np.where(LABELS == 1, SCORES, 1 - SCORES), 1e-15, 1 - 1e-15)
    assert metrics.log_loss(scored).first()[0] == pytest.approx(-np.log(p).mean())


def test_fold_summary_lists_folds_in_order(spark):
    rows = spark.createDataFrame([(2, 0.5), (0, 0.7), (1, 0.9)], "fold int, auc_roc double")
    row = metrics.fold_summary(rows).first()
    assert row["fold_aucs"] == [0.7, 0.9, 0.5] and row["std_auc"] == pytest.approx(np.std([0.7, 0.9, 0.5]))


@pytest.mark.parametrize("values", [RNG.normal(50, 20, 2_000), RNG.integers(1, 100, 2_000).astype(float), np.full(9, 4.0)])
def test_histogram_as_numpy(spark, values):
    rows = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "serious int, x double")
    found = statistics.histogram(rows, "x").orderBy("serious", "bin").collect()
    for label in (0, 1):
        expected, edges = np.histogram(values[np.arange(len(values)) % 2 == label], bins=30)
        mine = [r for r in found if r["serious"] == label]
        assert [r["n"] for r in mine] == expected.tolist()
        np.testing.assert_allclose([r["bin_low"] for r in mine], edges[:-1])


def test_boxplot(spark):
    values = np.concatenate([RNG.normal(0, 1, 500), [9.0, 9.0, -8.0]])
    rows = spark.createDataFrame([(1, str(float(v))) for v in values] + [(1, "unk")], "serious int, dose_amt string")
    q1, median, q3 = np.percentile(values, [25, 50, 75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    row = statistics.boxplot(rows).first()
    assert row["n"] == len(values) and row["n_outliers"] == len(values) - len(inside)
    np.testing.assert_allclose([row["q1"], row["median"], row["q3"], row["whisker_low"], row["whisker_high"]],
                               [q1, median, q3, inside.min(), inside.max()])
    outliers = {r["outlier"]: r["n"] for r in statistics.boxplot_outliers(rows).collect()}
    assert outliers[9.0] == 2 and sum(outliers.values()) == row["n_outliers"]


def test_correlation_as_pandas(spark):
    frame = pd.DataFrame(RNG.normal(size=(300, 3)), columns=["a", "b", "c"])
    frame.loc[::7, "a"] = None
    frame["k"] = 1.0
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
    found = statistics.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, k double"), list("abck"))
    expected = frame.corr()
    for row in found.collect():
        if "k" in (row["feature_a"], row["feature_b"]):
            assert row["correlation"] is None
        else:
            assert row["correlation"] == pytest.approx(expected.loc[row["feature_a"], row["feature_b"]])
    assert found.count() == 16


def test_age_bands_are_closed_on_the_right(spark):
    ages = spark.createDataFrame([(a,) for a in (0, 1, 18, 19, 40, 65, 66, 100, 101, None)], "age int")
    bands = [r[0] for r in ages.select(statistics.age_band(F.col("age"))).collect()]
    assert bands == [None, "<18", "<18", "18-40", "18-40", "40-65", "65+", "65+", None, None]


def test_crosstab_fills_zero(spark):
    rows = spark.createDataFrame([("M", 1), ("F", 0), ("F", 0)], "sex string, serious int")
    assert {tuple(r) for r in statistics.crosstab(rows).collect()} == {("M", 0, 1), ("F", 2, 0)}


def test_counts_shares_and_rates(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1)], "drugname string, serious int")
    assert [tuple(r) for r in statistics.top_values(rows, "drugname").collect()] == [("a", 2), ("b", 1)]
    assert [r["drugname"] for r in statistics.top_rates(rows, "drugname", k=1).collect()] == ["b"]
    assert {(r["class_name"], r["percent"]) for r in statistics.class_share(rows).collect()} == {("Serious", 75.0), ("Non-Serious", 25.0)}
    assert statistics.overall_rate(rows).first()["serious_rate"] == 0.75
